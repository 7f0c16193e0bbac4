from __future__ import annotations

import datetime
import random

from weftwork.operators import search as S
from weftwork.plans.search_plans import rt14_same_words


def test_sets_with_all_words_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SETS", 40)
    monkeypatch.setattr(S, "QUERIES", 9)
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [30 / (i + 1) for i in range(60)]
    sets = [(scope, f"{scope}{i}", sorted(set(r.choices(vocabulary, weights, k=25)))) for scope in ("a", "b") for i in range(300)]
    sets += [(None, "n", vocabulary), ("c", "c", vocabulary), ("d", "d", [])]
    queries = {(scope, tuple(r.sample(vocabulary[:20], 3))) for scope in ("a", "b", "e") for _ in range(60)} | {("d", ("w1", "w2", "w3")), (None, ("w1", "w2", "w3")), ("a", ("w1", "w2", "other"))}
    found = S.sets_with_all(spark.createDataFrame(list(queries), "scope string, words array<string>"), spark.createDataFrame(sets, "scope string, id string, words array<string>"), 3)
    wanted = {q: sum(s == q[0] and set(q[1]) <= set(w) for s, _, w in sets) for q in queries if q[0] is not None}
    assert {(x["scope"], tuple(x["words"])): x["n"] for x in found.collect()} == {q: n for q, n in wanted.items() if n}
    assert max(wanted.values()) > S.COMMON


def test_same_words_writes_no_row_for_a_word_of_a_text(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    title = "alpha bravo charlie delta echoes"
    rows = [(1, "i1", "w", title, None), (2, "i2", "w", title, "more"), (3, "i3", "w", "short one", f"Echoes: {title}"), (4, "i4", "v", title, None), (5, "i5", "w", "alpha bravo charlie delta golf", None), (6, "i5", None, title, None), (7, None, "w", title, None)]
    rows = [(*x, at + datetime.timedelta(days=-x[0])) for x in rows]
    spark.createDataFrame(rows, "row_id long, item_id string, workspace_id string, title string, description_md string, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/service.parquet")
    found = rt14_same_words(spark, str(tmp_path))
    assert {x["query_id"]: x["n"] for x in found.collect()} == {"i1": 2, "i2": 2}
    assert "explode(all" not in found._jdf.queryExecution().analyzed().toString()
