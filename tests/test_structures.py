from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import codegraph as G
from weftwork.operators import graphstore as S
from weftwork.operators import running as N
from weftwork.operators import search as Q
from weftwork.operators import trees as T
from weftwork.operators import usage as U
from weftwork.operators import views as V


def test_ancestors_with_loops_gaps_and_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)]
    odd = [("a", "gone"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("self", "self"), (None, "a")]
    got = {r["id"]: r["ancestors"] for r in T.ancestors(spark.createDataFrame(chain + odd, "id string, parent string")).collect()}
    assert got["n39"] == [f"n{i}" for i in range(39)] and got["n0"] == [] and got["a"] == [] and got["b"] == ["a"]
    assert got["x"] == got["y"] == got["z"] == got["self"] == [] and None not in got


def test_groups_moves_and_titles(spark):
    tree = spark.createDataFrame([("r", []), ("a", ["r"]), ("b", ["r", "a"]), ("c", ["r", "a", "b"]), ("d", ["r"])], "id string, ancestors array<string>")
    gone = spark.createDataFrame([("a",), ("c",), ("d",), ("d",)], "id string")
    assert {r["id"]: r["group"] for r in T.groups_of_gone(tree, gone).collect()} == {"a": "a", "c": "a", "d": "d"}
    assert {r["id"]: r["ancestors"] for r in T.rebased(tree, "a", ["r", "d"]).collect()} == {"r": [], "a": ["r", "d"], "b": ["r", "d", "a"], "c": ["r", "d", "a", "b"], "d": ["r"]}
    titles = spark.createDataFrame([("r", "Root"), ("b", "Bee")], "id string, title string")
    assert {r["id"]: r["crumbs"] for r in T.titled(tree, titles).collect()}["c"] == ["Root", "Bee"]


def test_first_steps_are_shortest_and_by_order(spark):
    moves = spark.createDataFrame([("s", "a", "b", 1), ("s", "a", "c", 0), ("s", "b", "d", 3), ("s", "c", "d", 3), ("s", "d", "e", 4), ("t", "a", "b", 1)], "scope string, a string, b string, pos int")
    got = {(r["scope"], r["start"], r["goal"]): (r["first"], r["steps"]) for r in T.first_steps(moves).collect()}
    assert got["s", "a", "d"] == ("c", 2) and got["s", "a", "e"] == ("c", 3) and ("s", "e", "a") not in got and len(got) == 10


TREE = [("r", "Repository", "r"), ("r:ui", "Module", "ui"), ("r:api", "Module", "api"), ("r:ui/p.ts", "File", "p.ts"), *[(f"r:api/f{i:02}.ts", "File", f"f{i:02}.ts") for i in range(20)]]


def view_graph(spark):
    nodes = spark.createDataFrame([(i, l, "r", n) for i, l, n in TREE], "id string, label string, repo string, name string")
    contains = [("r", "r:ui", "CONTAINS", 1), ("r", "r:api", "CONTAINS", 1), ("r:ui", "r:ui/p.ts", "CONTAINS", 1), *[("r:api", f"r:api/f{i:02}.ts", "CONTAINS", 1) for i in range(20)]]
    edges = spark.createDataFrame(contains + [("r:ui/p.ts", "r:api/f00.ts", "IMPORTS", 2), ("r:ui/p.ts", "r:api/f19.ts", "IMPORTS", 7), ("r:api/f00.ts", "r:api/f01.ts", "IMPORTS", None)], "source string, target string, type string, count int")
    return nodes, edges


@pytest.mark.parametrize("opened, want", [
    ([], {("r:ui", "r:api"): (9, True)}),
    (["r:api/deep"], {("r:ui", "r:api"): (9, True)}),  # not there, so not open
    (["r:api"], {("r:ui", "r:api/f00.ts"): (2, True), ("r:ui", "r:api/f19.ts"): (7, True), ("r:api/f00.ts", "r:api/f01.ts"): (1, False)}),
])
def test_views_fold_edges_onto_what_is_drawn(spark, opened, want):
    nodes, edges = view_graph(spark)
    seen, markers, hidden = V.drawn(nodes, edges, spark.createDataFrame([(x,) for x in opened], "id string"), ["IMPORTS"], page=20)
    got = {(r["source"], r["target"]): (r["weight"], r["collapsed"]) for r in V.view_edges(edges, seen, hidden, ["IMPORTS"]).collect()}
    assert got == want and markers.count() == 0


def test_a_page_keeps_the_best_connected_and_a_marker_stands_for_the_rest(spark):
    nodes, edges = view_graph(spark)
    opened = spark.createDataFrame([("r:api",)], "id string")
    seen, markers, hidden = V.drawn(nodes, edges, opened, ["IMPORTS"], page=2)
    assert sorted(r["id"] for r in seen.collect() if r["parent"] == "r:api") == ["r:api/f00.ts", "r:api/f01.ts"]
    assert [tuple(r) for r in markers.collect()] == [("r:api::more", "r:api", 2, 18)]
    got = {(r["source"], r["target"]): r["weight"] for r in V.view_edges(edges, seen, hidden, ["IMPORTS"]).collect()}
    assert got == {("r:ui", "r:api/f00.ts"): 2, ("r:ui", "r:api::more"): 7, ("r:api/f00.ts", "r:api/f01.ts"): 1}  # nothing is lost
    assert ("r:api", "r:api::more") in [tuple(r) for r in V.containment(seen, markers).collect()]
    whole, none, _ = V.drawn(nodes, edges, opened, ["IMPORTS"], page=2, revealed=opened)
    assert whole.count() == 23 and none.count() == 0
    cut = V.capped(spark.createDataFrame([("r", f"s{i}", "t", "X") for i in range(5)], "repo string, source string, target string, type string"), most=3).collect()
    assert len(cut) == 3 and all(r["truncated"] for r in cut)


def test_graph_writes_are_idempotent_and_detach(spark):
    n = "id string, label string, name string"
    e = "source string, type string, target string, count int"
    old_n, old_e = spark.createDataFrame([("a", "F", "a"), ("b", "F", "b"), ("c", "F", None)], n), spark.createDataFrame([("a", "X", "b", 1), ("a", "X", "c", 1), ("b", "X", "c", 2)], e)
    new_n, new_e = spark.createDataFrame([("a", "F", "a2"), ("c", "F", None), ("d", "F", "d")], n), spark.createDataFrame([("a", "X", "c", 1), ("a", "X", "d", 5), ("d", "X", "zz", 1)], e)
    wn, we, dn, de = S.diff(old_n, old_e, new_n, new_e)
    assert sorted(r["id"] for r in wn.collect()) == ["a", "d"] and [r["id"] for r in dn.collect()] == ["b"]
    assert sorted((r["source"], r["target"]) for r in we.collect()) == [("a", "d"), ("d", "zz")] and sorted((r["source"], r["target"]) for r in de.collect()) == [("a", "b"), ("b", "c")]
    nodes = S.written_nodes(old_n, wn, dn)
    edges = S.written_edges(old_e, nodes, we, de)
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, new_n.collect()), key=str)
    assert sorted(map(tuple, edges.collect())) == [("a", "X", "c", 1), ("a", "X", "d", 5)]  # an end that isn't there: no edge
    again = S.written_edges(edges, S.written_nodes(nodes, wn, dn), we, de)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, edges.collect()))


def test_running_sums_and_neighbours_of_hot_and_null_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), i, r.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {x["i"]: (x["s"], x["n"]) for x in N.running_sums(df, ["k"], [F.col("i").asc()], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    sums, want = {}, {}
    for k, i, v in rows:
        s, n = sums.get(k, (0, 0))
        sums[k] = want[i] = (s + (v or 0), n + 1)
    assert got == want
    near = {x["i"]: (x["b"], x["a"]) for x in N.neighbours(df.select("k", "i"), ["k"], ["i"], "i", "b", "a").collect()}
    for key in ("hot", "b", None):
        own = [i for k, i, _ in rows if k == key]
        assert [near[i] for i in own] == list(zip([None, *own[:-1]], [*own[1:], None]))
    m = {x["k"]: x["median"] for x in U.exact_medians(df, ["k"], "v").collect()}
    assert m == {k: statistics.median(v for kk, _, v in rows if kk == k and v is not None) for k in ("hot", "b", None)}
    assert N.numbered(df.limit(0), ["k"], [F.col("i").asc()]).count() == 0


def test_nearest_against_brute_force_with_odd_vectors(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 8)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, []), (302, [0.0] * 8), (303, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    u = np.zeros((304, 8))
    for i, v in rows:
        if v:
            u[i] = np.array(v) / max(np.linalg.norm(v), 1e-300)
    for block in (4096, 5):
        got = {}
        for r in Q.nearest(q, df, 4, block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        for i in range(0, 304, 20):
            s = np.round(u @ u[i], 12)
            assert [v for _, v in sorted(got[i])] == sorted(range(304), key=lambda j: (-s[j], j))[:4]
    clusters = g.normal(size=(6, 8))
    y = [(i, (clusters[i % 6] + 0.05 * g.normal(size=8)).tolist()) for i in range(600)]
    v = spark.createDataFrame(y, "vec_id long, embedding array<double>")
    p = v.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding")
    exact, found = Q.nearest(p, v, 10).select("query_id", "vec_id"), Q.indexed(p, v, 10, lists=12, probes=4).select("query_id", "vec_id")
    assert exact.join(found, ["query_id", "vec_id"], "left_semi").count() >= 0.9 * exact.count()


def test_unknown_kinds_are_errors(spark):
    from weftwork.plans.function_plans import G_kinds

    with pytest.raises(ValueError):
        G_kinds(["CALLS", "LIKES"])
    with pytest.raises(ValueError):
        G.neighbourhood(spark.createDataFrame([], "source string, target string"), spark.createDataFrame([], "id string"), 4)


def test_module_totals_of_folders_whose_files_have_no_language(spark):
    rows = [("r", "a/x.py", "python", [1, 2]), ("r", "a/b/y", None, [3]), ("r", "a/b/z", None, []), ("r", "top", None, [4])]
    found = G.module_totals(spark.createDataFrame(rows, "repo string, path string, language string, definitions array<int>"))
    assert {x["module"]: (x["file_count"], x["definition_count"], x["language"], x["depth"]) for x in found.collect()} == {"a": (3, 3, "python", 1), "a/b": (2, 1, None, 2)}
