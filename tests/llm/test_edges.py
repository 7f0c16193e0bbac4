"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftwork.llm import conversations as C
from weftwork.llm import encoding as E
from weftwork.llm import handwritten as H
from weftwork.llm import secrets as K
from weftwork.llm import sentences as S

FACTS = "repo string, path string, content_hash string, loc int, truncated boolean, definitions array<struct<kind string, name string, signature string, docstring string>>, imports array<struct<specifier string, names array<string>>>, calls array<struct<callee string, enclosing string>>, inheritance array<struct<child string, parent_name string>>"
EXCERPTS = "repo string, path string, lines array<string>, start_line int"


def test_files_with_nulls_everywhere(spark):
    nothing = (None,) * 9
    holes = ("r", "a.py", None, None, None, [None, (None, None, None, None)], [None, (None, None)], [None, (None, None)], None)
    named = ("r", "node_modules/x/a.js", "h", 3, False, None, None, None, None)
    empty_own = ("r", "pkg/__init__.py", H.EMPTY_HASH, 1, False, [], [], [], [])
    rows = [nothing, holes, holes, ("r", None, *holes[2:]), (None, "b.py", *holes[2:]), named, named, empty_own, ("s", "min/app.min.js", *holes[2:])]
    facts = spark.createDataFrame(rows, FACTS).withColumns({"key": F.lit(1), "tokens": F.lit("x"), "foreign": F.lit(True), "rule": F.lit(2)})
    excerpts = spark.createDataFrame([(None, None, None, None), ("r", "a.py", [None, None], None), ("r", "gone.py", ["# @generated by x"], 1), ("r", "a.py", [], 1)], EXCERPTS).withColumn("made", F.lit(1))
    got = {(r["repo"], r["path"]): r["reasons"] for r in H.made_files(facts, excerpts).collect()}
    assert got == {("r", "node_modules/x/a.js"): ["foreign"], ("s", "min/app.min.js"): ["named_shrunk"]}
    assert H.made_files(facts.limit(0), excerpts).count() == 0 and H.made_files(facts, excerpts.limit(0)).count() == 2


def test_rules_are_stable_and_the_bound_is_exact():
    a = [f"w{i * 7 % 23}" for i in range(60)]
    inner = set(H.shared_rules(a))
    moved = set(H.shared_rules(["x", "y", "z", *a, "q"]))
    assert len(inner & moved) >= 0.5 * len(inner) and H.shared_rules([]) == [] == H.shared_rules(["a"])
    import random

    r = random.Random(4)
    for _ in range(60):
        t = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(2, 80))]
        exact = H.saved(t)
        for least in (0.2, 0.5):
            assert (H.saved(t, least) >= least) == (exact >= least)
    rest, rules = H.repair([0, 1, 0, 1, 0, 1, 2])

    def spelt(x):
        return [x] if x not in rules else spelt(rules[x][0]) + spelt(rules[x][1])

    assert [y for x in rest for y in spelt(x)] == [0, 1, 0, 1, 0, 1, 2]


def test_a_folder_is_foreign_by_what_it_shares_not_by_its_name(spark):
    def file(repo, path, words):
        return (repo, path, f"{repo}{path}", 90, False, [("function", w, f"{w}(x)", None) for w in words], [], [], [])

    own = [file(f"r{i % 4}", f"deps/own{i}.py", [f"o{i}x{k}" for k in range(9)]) for i in range(40)]
    shared = [file(f"r{i % 4}", f"lib/js/kit{i // 4}.js", [f"k{i // 4}x{k}" for k in range(9)]) for i in range(96)]
    got = {r["path"] for r in H.made_files(spark.createDataFrame(own + shared, FACTS), spark.createDataFrame([], EXCERPTS)).collect()}
    assert got == {f"lib/js/kit{i}.js" for i in range(24)}  # forty files of its own outweigh the usual name "deps"


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, "It ran. It fell.", ["x"], 1, 1, "k")], "doc_id int, text string, lines array<string>, start_at int, ids int, kind string")
    for bad in (lambda: S.sentence_units(df, ["doc_id", "start_at"], openers=S.KNOWN_OPENERS), lambda: K.secrets_in(df, ["doc_id", "kind"]), lambda: E.encode(df, "text", ["ids"]), lambda: E.encode_with_offsets(df, "text", ["ids"])):
        with pytest.raises(ValueError):
            bad()
    assert S.sentence_units(df, ["doc_id"]).count() == 2 and E.encode(df, "text", ["doc_id", "kind"]).columns == ["doc_id", "kind", "ids"]


def test_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([], "doc_id int, text string, lines array<string>")
    assert S.sentence_units(df, ["doc_id"]).count() == E.encode(df, "text", ["doc_id"]).count() == K.secrets_in(df, ["doc_id"]).count() == 0
    long = "It went well. " * 20_000
    one = spark.createDataFrame([(1, long)], "doc_id int, text string")
    assert S.sentence_units(one, ["doc_id"]).count() == 20_000
    assert K.find_secrets(["x" * 500_000, 'password = "q7Rt9Lm2Vx4K"' + " " * 100_000])[0][:2] == (1, 12)


def test_messages_with_nulls_and_ties(spark):
    schema = "workspace_id string, channel string, ts string, user string, text string, thread_ts string, received_at long, row_id long, turn int, root_us string"
    rows = [(None,) * 10, *[(None, None, f"{100 + i}.5", f"u{i % 2}", "hi", None, 1, i, 7, "x") for i in range(4)], (None, None, "100.5", "u9", "tie", None, 1, 99, 7, "x"), (None, None, "nan", "u1", "x", "inf", 1, 5, 7, "x")]
    got = C.conversations(spark.createDataFrame(rows, schema)).orderBy("turn").collect()
    assert [r["role"] for r in got] == ["opener", "replier", "replier", "replier"] and got[0]["workspace_id"] is None
