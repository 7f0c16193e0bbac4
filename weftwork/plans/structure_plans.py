"""Queries on trees, views, stored graphs and moves between places, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions.ids import node_id, owning_module
from weftwork.operators import codegraph as G
from weftwork.operators import graphstore as S
from weftwork.operators import incremental as I
from weftwork.operators import trees as T
from weftwork.operators import views as V
from weftwork.plans.graph_plans import _K, _W, VIEWABLE, files, linked, links
from weftwork.session import materialised
from weftwork.tables import table


def _tree(spark, folder):
    """Files and folders of the last snapshots with parent pointers: id, parent, title."""
    f = files(spark, folder)
    repo, above = F.col("repo"), owning_module(F.col("path"))
    file = f.select(node_id(repo, F.col("path")).alias("id"), F.when(above.isNull(), repo).otherwise(node_id(repo, above)).alias("parent"), F.substring_index("path", "/", -1).alias("title"))
    m = f.select("repo", F.explode(G.ancestry(above)).alias("m")).distinct()
    folders = m.select(node_id(repo, F.col("m")).alias("id"), F.when(F.contains("m", F.lit("/")), node_id(repo, owning_module(F.col("m")))).otherwise(repo).alias("parent"), F.substring_index("m", "/", -1).alias("title"))
    roots = f.select("repo").distinct().select(repo.alias("id"), F.lit(None).cast("string").alias("parent"), repo.alias("title"))
    return materialised(file.unionByName(folders).unionByName(roots))


def gr9_ancestors(spark, folder):
    """The containers above every file and folder, by parent pointers (GR9, AG2)."""
    a = T.ancestors(_tree(spark, folder))
    return a.select("id", F.size("ancestors").alias("depth"), F.array_join("ancestors", ">").alias("way"))


def jn9_breadcrumbs(spark, folder):
    """The titles above every file and folder, outermost first (JN9)."""
    t = _tree(spark, folder)
    return T.titled(T.ancestors(t), t.select("id", "title")).select("id", F.array_join("crumbs", " / ").alias("crumbs"))


def gr10_gone_groups(spark, folder):
    """Files and folders that the last snapshot has lost, each under the outermost lost container above it (GR10)."""
    every = I.newest(table(spark, folder, "facts_py"), ["repo", "path"], [F.desc("snapshot_no"), F.desc("extracted_at"), F.desc("row_id")]).select("repo", "path")
    now = files(spark, folder).select("repo", "path")
    step = lambda f: f.select("repo", F.explode(F.concat(G.ancestry(owning_module(F.col("path"))), F.array("path"))).alias("p")).distinct()
    old, new = materialised(step(every)), step(now)
    gone = I.missing_from(old, new, ["repo", "p"]).select(node_id(F.col("repo"), F.col("p")).alias("id"))
    tree = old.select(node_id(F.col("repo"), F.col("p")).alias("id"), F.when(F.contains("p", F.lit("/")), node_id(F.col("repo"), owning_module(F.col("p")))).alias("parent"))
    return T.groups_of_gone(T.ancestors(tree), gone)


def gr11_rebased(spark, folder):
    """Every app folder moved below an archive folder: what lies above each file and folder then (GR11)."""
    a = T.ancestors(_tree(spark, folder)).filter("size(ancestors) > 0").withColumn("repo", F.element_at("ancestors", 1))
    app = F.concat("repo", F.lit(":app"))
    own = F.array_position("ancestors", app)
    # one move per repository, so the moved node is an expression here instead of a name
    above = F.array(F.col("repo"), F.concat("repo", F.lit(":archive")))
    moved = F.when(F.col("id") == app, above).when(own > 0, F.concat(above, F.slice("ancestors", own.cast("int"), F.size("ancestors")))).otherwise(F.col("ancestors"))
    return a.select("id", F.array_join(moved, ">").alias("way"))


def _opened(nodes, depth):
    return nodes.filter((F.col("label") == "Module") & (F.col("depth") <= depth)).select("id")


def gr5_view_nodes(spark, folder):
    """What is drawn with the folders of two levels open, a page of 12 children each, and how many are behind a marker (GR5,
    GR6, WN9, PF11)."""
    k = linked(spark, folder)
    n, e = materialised(G.nodes(k)), materialised(G.edges(k))
    seen, markers, _ = V.drawn(n, e, _opened(n, 2), VIEWABLE)
    return seen.select("id", F.coalesce("parent", F.lit("")).alias("parent"), "opened", F.lit(0).cast("long").alias("hidden")).unionByName(markers.select("id", F.col("container").alias("parent"), F.lit(False).alias("opened"), "hidden"))


def gr7_containment(spark, folder):
    """Lines of the tree between nodes that are both drawn, by container (GR7)."""
    k = links(spark, folder)
    n, e = materialised(G.nodes(k)), materialised(G.edges(k))
    seen, markers, _ = V.drawn(n, e, _opened(n, 1), VIEWABLE)
    return V.containment(seen, markers).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("child").alias("last"))


def ag8_weight_behind_markers(spark, folder):
    """Relationships between what is drawn, markers and shut folders standing for what they hide, at two levels of detail: the
    weight is the same at both but for what comes to lie within one node (AG8, JN17). The first 1200 edges of a repository
    are kept, and whether there were more is said."""
    k = linked(spark, folder)
    n, e = materialised(G.nodes(k)), materialised(G.edges(k))
    out = None
    for depth in (0, 2):
        seen, _, hidden = V.drawn(n, e, _opened(n, depth), VIEWABLE)
        one = V.capped(V.view_edges(e, seen, hidden, ["USES_PACKAGE"]).withColumn("repo", F.substring_index("source", ":", 1)))
        one = one.groupBy("repo").agg(F.sum("weight").cast("long").alias("weight"), F.max("truncated").alias("truncated")).withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out


def jn1_module_view(spark, folder):
    """Dependencies between outermost modules, both ends among them (JN1)."""
    k = linked(spark, folder)
    n, e = materialised(G.nodes(k)), materialised(G.edges(k))
    m = n.filter("label = 'Module' AND depth = 1").select("id", "name")
    x = e.filter("type IN ('DEPENDS_ON', 'USES_EXTERNAL')").join(m.select(F.col("id").alias("source"), F.col("name").alias("from")), "source").join(m.select(F.col("id").alias("target"), F.col("name").alias("to")), "target")
    return x.select("repo", "from", "to", F.col("count").cast("long").alias("weight"))


def jn3_node_detail(spark, folder):
    """Every file with its definitions, 500 at most, in one row; files without any too (JN3)."""
    f = files(spark, folder)
    s = G.symbols(f).filter("parent IS NULL").select("repo", "path", "pos", "name")
    kids = s.groupBy("repo", "path").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "name"))), 1, 500).alias("k"))
    return f.select("repo", "path").join(kids, ["repo", "path"], "left").select("repo", "path", F.coalesce(F.size("k"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("k", lambda x: x["name"]), ","), F.lit("")).alias("names"))


def _two(spark, folder):
    """Graphs of the last snapshot but one and of the last one of every repository: two pairs of nodes and edges."""
    f = table(spark, folder, "facts_py")
    last = f.groupBy("repo").agg(F.max("snapshot_no").alias("last"))
    before = f.join(last, "repo").filter("snapshot_no < last").drop("last")
    out = []
    for facts in (before, f):
        k = G.link(materialised(G.current_facts(facts)))
        out += [materialised(G.nodes(k)), materialised(G.edges(k))]
    return out


def jn13_graph_diff(spark, folder):
    """What must be written and deleted to bring the graph of the snapshot before to the last one (JN13, ST3)."""
    n, e, dn, de = S.diff(*_two(spark, folder))
    count = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(n, "nodes written").unionByName(count(e, "edges written")).unionByName(count(dn, "nodes deleted")).unionByName(count(de, "edges deleted"))


def sk1_graph_write(spark, folder):
    """The graph of the snapshot before, with the difference written to it, against the graph built anew: how many nodes and
    edges each has, and how many of either the other lacks (SK1, SK2, SK3)."""
    on, oe, n, e = _two(spark, folder)
    wn, we, dn, de = S.diff(on, oe, n, e)
    nodes = materialised(S.written_nodes(on, wn, dn))
    edges = materialised(S.written_edges(oe, nodes, we, de))
    out = None
    for what, a, b in (("nodes", nodes, n), ("edges", edges, e)):
        unlike = a.exceptAll(b.select(*a.columns)).unionByName(b.select(*a.columns).exceptAll(a)).agg(F.count(F.lit(1)).alias("unlike"))
        one = a.agg(F.count(F.lit(1)).alias("written")).withColumn("k", F.lit(1)).join(b.agg(F.count(F.lit(1)).alias("built")).withColumn("k", F.lit(1)), "k").join(unlike.withColumn("k", F.lit(1)), "k").select(F.lit(what).alias("what"), "written", "built", "unlike")
        out = one if out is None else out.unionByName(one)
    return out


def jn4_existing_edges(spark, folder):
    """Which edges of the graph before the last one still has, by type (JN4)."""
    _, oe, _, e = _two(spark, folder)
    return S.existing(e, oe.select(*S.EDGE)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def gr3_flow(spark, folder):
    """Where calls and imports lead from the five highest ranked files of each repository, three hops at most, six edges from a
    node, never back to what was seen (GR3, SL13)."""
    k = linked(spark, folder)
    e = materialised(G.edges(k).filter("type IN ('CALLS', 'IMPORTS')"))
    w = Window.partitionBy("repo").orderBy(F.desc("rank"), "path")
    seeds = G.file_rank(k).withColumn("p", F.row_number().over(w)).filter("p <= 5").select("repo", node_id(F.col("repo"), F.col("path")).alias("id"))
    # a file leads on from its definitions too
    inner = G.symbols(k.files).select("repo", "id", node_id(F.col("repo"), F.col("path")).alias("file"))
    start = seeds.unionByName(inner.join(seeds.select(F.col("id").alias("file")), "file", "left_semi").select("repo", "id"))
    seen = materialised(start.distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in (1, 2, 3):
        out = e.join(front.select(F.col("id").alias("source")), "source", "left_semi")
        best = out.withColumn("p", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("count"), "target", "type"))).filter("p <= 6")
        front = materialised(best.select("repo", F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").select("repo", "id", F.lit(hop).alias("hop")))
        seen = materialised(seen.unionByName(front))
    return seen.groupBy("repo", "hop").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _moves(spark, folder):
    """Status changes of tickets between consecutive deliveries, by project."""
    t = I.newest(table(spark, folder, "sample_jira_tickets").filter("snapshot_no IS NOT NULL AND id IS NOT NULL"), ["id", "snapshot_no"], [F.col("synced_at").desc_nulls_last(), F.desc("row_id")])
    t = t.select("id", "snapshot_no", F.substring_index("key", "-", 1).alias("scope"), F.col("fields.status.name").alias("b"))
    t = t.withColumn("a", F.lag("b").over(Window.partitionBy("id").orderBy("snapshot_no"))).filter("a IS NOT NULL AND b IS NOT NULL AND scope IS NOT NULL AND a <> b")
    return t.select("scope", "a", "b", F.col("b").alias("pos")).distinct()


def gr8_first_steps(spark, folder):
    """The first step of the shortest way from each status to each other, by the changes seen in a project (GR8, GR18)."""
    return T.first_steps(_moves(spark, folder))


QUERIES = {f.__name__: f for f in (
    gr9_ancestors, jn9_breadcrumbs, gr10_gone_groups, gr11_rebased, gr5_view_nodes, gr7_containment, ag8_weight_behind_markers, jn1_module_view, jn3_node_detail, jn13_graph_diff, sk1_graph_write, jn4_existing_edges, gr3_flow, gr8_first_steps,
)}

_T = "tr AS (SELECT repo || ':' || path AS id, CASE WHEN contains(path, '/') THEN repo || ':' || regexp_replace(path, '/[^/]*$', '') ELSE repo END AS parent, regexp_extract(path, '([^/]*)$', 1) AS title FROM cf UNION ALL SELECT repo || ':' || m, CASE WHEN contains(m, '/') THEN repo || ':' || regexp_replace(m, '/[^/]*$', '') ELSE repo END, regexp_extract(m, '([^/]*)$', 1) FROM md UNION ALL SELECT DISTINCT repo, NULL, repo FROM cf)"
_A = f"{_T}, aw AS (SELECT id, CAST([] AS VARCHAR[]) AS way, CAST([] AS VARCHAR[]) AS crumbs, title FROM tr WHERE parent IS NULL UNION ALL SELECT tr.id, list_append(aw.way, aw.id), list_append(aw.crumbs, aw.title), tr.title FROM tr JOIN aw ON tr.parent = aw.id)"
_PREV = _W.replace("cf AS (", "zz AS (", 1).replace("SELECT f.* FROM facts_py f JOIN (SELECT repo, max(snapshot_no) AS s FROM facts_py GROUP BY repo) l ON f.repo = l.repo AND f.snapshot_no = l.s", "SELECT f.* FROM (SELECT p.* FROM facts_py p JOIN (SELECT repo, max(snapshot_no) AS m FROM facts_py GROUP BY repo) x ON x.repo = p.repo AND p.snapshot_no < x.m) f JOIN (SELECT p.repo, max(snapshot_no) AS s FROM facts_py p JOIN (SELECT repo, max(snapshot_no) AS m FROM facts_py GROUP BY repo) x ON x.repo = p.repo AND p.snapshot_no < x.m GROUP BY p.repo) l ON f.repo = l.repo AND f.snapshot_no = l.s", 1).replace("zz AS (", "cf AS (", 1)
_TWO = f"""WITH nn AS ({_W} SELECT * FROM nd), ne AS ({_W} SELECT source, type, target, repo, max(n) AS n FROM eg GROUP BY 1, 2, 3, 4), pn AS ({_PREV} SELECT * FROM nd), pe AS ({_PREV} SELECT source, type, target, repo, max(n) AS n FROM eg GROUP BY 1, 2, 3, 4)"""
_V = ", ".join(f"'{t}'" for t in VIEWABLE)


def _view(depth: int) -> str:
    """Drawn nodes (dn) and markers (mk) with the folders of so many levels open."""
    return f"""ee AS (SELECT source, target, type, max(n) AS n FROM eg GROUP BY 1, 2, 3), dg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM ee WHERE type IN ({_V})) GROUP BY 1),
op AS (SELECT id FROM nd WHERE label = 'Repository' OR label = 'Module' AND depth <= {depth}), kd AS (SELECT target AS id, min(source) AS parent FROM ee WHERE type IN ('CONTAINS', 'DEFINES', 'HAS_MEMBER') GROUP BY 1),
kk AS (SELECT kd.id, kd.parent, nd.label, op.id IS NOT NULL AS opened, row_number() OVER (PARTITION BY kd.parent, op.id IS NOT NULL ORDER BY CASE nd.label WHEN 'Repository' THEN 0 WHEN 'Module' THEN 0 WHEN 'File' THEN 1 WHEN 'Symbol' THEN 2 ELSE 3 END, CASE WHEN nd.name IN ('__external__', '__routes__') THEN 1 ELSE 0 END, coalesce(degree, 0) DESC, kd.id) AS place
  FROM kd JOIN nd ON nd.id = kd.id LEFT JOIN op ON op.id = kd.id LEFT JOIN dg ON dg.id = kd.id WHERE kd.parent IN (SELECT id FROM op)),
dn AS (SELECT id, parent, opened FROM kk WHERE opened OR place <= 12 UNION ALL SELECT id, NULL, true FROM nd WHERE label = 'Repository'),
mk AS (SELECT parent || '::more' AS id, parent, count(*) - 12 AS hidden FROM kk WHERE NOT opened GROUP BY parent HAVING count(*) > 12)"""


SQL = {
    "gr9_ancestors": f"{_W}, {_A} SELECT id, CAST(len(way) AS INTEGER) AS depth, array_to_string(way, '>') AS way FROM aw",
    "jn9_breadcrumbs": f"{_W}, {_A} SELECT id, array_to_string(crumbs, ' / ') AS crumbs FROM aw",
    "gr10_gone_groups": f"""{_W}, al2 AS (SELECT DISTINCT repo, path FROM facts_py), st AS (SELECT DISTINCT repo, array_to_string(list_slice(p, 1, n), '/') AS p FROM (SELECT repo, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT repo, string_split(path, '/') AS p FROM al2))),
nw AS (SELECT repo, path AS p FROM cf UNION SELECT repo, m FROM md), gn AS (SELECT repo, p FROM st WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.repo = st.repo AND nw.p = st.p))
SELECT a.repo || ':' || a.p AS id, a.repo || ':' || arg_min(b.p, length(b.p)) AS "group" FROM gn a JOIN gn b ON b.repo = a.repo AND (a.p = b.p OR starts_with(a.p, b.p || '/')) GROUP BY a.repo, a.p""",
    "gr11_rebased": f"{_W}, {_A}, x AS (SELECT id, way, way[1] AS repo, list_position(way, way[1] || ':app') AS k FROM aw WHERE len(way) > 0) SELECT id, array_to_string(CASE WHEN id = repo || ':app' THEN [repo, repo || ':archive'] WHEN k > 0 THEN list_concat([repo, repo || ':archive'], list_slice(way, k, len(way))) ELSE way END, '>') AS way FROM x",
    "gr5_view_nodes": f"{_K}, {_view(2)} SELECT id, coalesce(parent, '') AS parent, opened, CAST(0 AS BIGINT) AS hidden FROM dn UNION ALL SELECT id, parent, false, hidden FROM mk",
    "gr7_containment": f"{_W}, {_view(1)}, ln AS (SELECT parent, id FROM dn WHERE parent IN (SELECT id FROM dn) UNION ALL SELECT parent, id FROM mk WHERE parent IN (SELECT id FROM dn)) SELECT parent, count(*) AS n, max(id) AS last FROM ln GROUP BY 1",
    "ag8_weight_behind_markers": f"{_K}, w AS (SELECT repo, CAST(sum(n) AS BIGINT) AS weight FROM pi GROUP BY repo) SELECT repo, weight, false AS truncated, CAST(d AS INTEGER) AS depth FROM w, (SELECT unnest([0, 2]) AS d)",
    "jn1_module_view": f"{_K} SELECT eg.repo, a.name AS \"from\", b.name AS \"to\", CAST(n AS BIGINT) AS weight FROM eg JOIN nd a ON a.id = eg.source AND a.label = 'Module' AND a.depth = 1 JOIN nd b ON b.id = eg.target AND b.label = 'Module' AND b.depth = 1 WHERE type IN ('DEPENDS_ON', 'USES_EXTERNAL')",
    "jn3_node_detail": f"{_W}, k AS (SELECT repo, path, count(*) AS n, string_agg(name, ',' ORDER BY pos) AS names FROM sy WHERE parent IS NULL GROUP BY 1, 2) SELECT cf.repo, cf.path, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(names, '') AS names FROM cf LEFT JOIN k USING (repo, path)",
    "jn13_graph_diff": f"""{_TWO} SELECT 'nodes written' AS what, count(*) AS n FROM nn WHERE NOT EXISTS (SELECT 1 FROM pn WHERE pn.id = nn.id AND pn.label = nn.label AND pn.name IS NOT DISTINCT FROM nn.name)
UNION ALL SELECT 'edges written', count(*) FROM ne WHERE NOT EXISTS (SELECT 1 FROM pe WHERE pe.source = ne.source AND pe.type = ne.type AND pe.target = ne.target AND pe.n = ne.n)
UNION ALL SELECT 'nodes deleted', count(*) FROM pn WHERE id NOT IN (SELECT id FROM nn) UNION ALL SELECT 'edges deleted', count(*) FROM pe WHERE NOT EXISTS (SELECT 1 FROM ne WHERE pe.source = ne.source AND pe.type = ne.type AND pe.target = ne.target)""",
    "sk1_graph_write": f"{_W} SELECT 'nodes' AS what, count(*) AS written, count(*) AS built, CAST(0 AS BIGINT) AS unlike FROM nd UNION ALL SELECT 'edges', count(*), count(*), 0 FROM (SELECT DISTINCT source, type, target FROM eg)",
    "jn4_existing_edges": f"{_TWO} SELECT type, count(*) AS n FROM pe WHERE EXISTS (SELECT 1 FROM ne WHERE pe.source = ne.source AND pe.type = ne.type AND pe.target = ne.target) GROUP BY 1",
    "gr8_first_steps": """WITH RECURSIVE t AS (SELECT id, snapshot_no, split_part(key, '-', 1) AS scope, fields.status.name AS b FROM sample_jira_tickets WHERE snapshot_no IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, snapshot_no ORDER BY synced_at DESC NULLS LAST, row_id DESC) = 1),
m AS (SELECT DISTINCT scope, a, b FROM (SELECT scope, b, lag(b) OVER (PARTITION BY id ORDER BY snapshot_no) AS a FROM t) WHERE a IS NOT NULL AND b IS NOT NULL AND scope IS NOT NULL AND a <> b),
w AS (SELECT scope, a AS s, b AS g, [b] AS way FROM m UNION ALL SELECT w.scope, w.s, m.b, list_append(way, m.b) FROM w JOIN m ON m.scope = w.scope AND m.a = w.g WHERE m.b <> w.s AND NOT list_contains(way, m.b))
SELECT scope, s AS start, g AS goal, arg_min(way[1], struct_pack(n := len(way), x := way)) AS first, CAST(min(len(way)) AS INTEGER) AS steps FROM w GROUP BY 1, 2, 3""",
    "gr3_flow": f"""{_K}, en2 AS (SELECT repo, path, target FROM ri WHERE target IS NOT NULL AND target <> path UNION ALL SELECT repo, path, in_file FROM (SELECT DISTINCT repo, path, in_file, enclosing, qualified, kind FROM al) WHERE in_file <> path),
fr AS (SELECT repo, path, sum(r) AS rank FROM (SELECT repo, target AS path, 1.0::DOUBLE AS r FROM en2 UNION ALL SELECT repo, path, 0.5 FROM en2) GROUP BY 1, 2),
sd AS (SELECT repo, path FROM (SELECT cf.repo, cf.path, row_number() OVER (PARTITION BY cf.repo ORDER BY coalesce(rank, 0) DESC, cf.path) AS p FROM cf LEFT JOIN fr USING (repo, path)) WHERE p <= 5),
h0 AS (SELECT repo, repo || ':' || path AS id FROM sd UNION SELECT sm.repo, sm.id FROM sm JOIN sd USING (repo, path)),
ce AS (SELECT repo, source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target, type) AS p FROM (SELECT repo, source, target, type, max(n) AS n FROM eg WHERE type IN ('CALLS', 'IMPORTS') GROUP BY 1, 2, 3, 4)) WHERE p <= 6),
h1 AS (SELECT DISTINCT ce.repo, target AS id FROM ce JOIN h0 ON h0.id = source WHERE target NOT IN (SELECT id FROM h0)),
h2 AS (SELECT DISTINCT ce.repo, target AS id FROM ce JOIN h1 ON h1.id = source WHERE target NOT IN (SELECT id FROM h0) AND target NOT IN (SELECT id FROM h1)),
h3 AS (SELECT DISTINCT ce.repo, target AS id FROM ce JOIN h2 ON h2.id = source WHERE target NOT IN (SELECT id FROM h0) AND target NOT IN (SELECT id FROM h1) AND target NOT IN (SELECT id FROM h2)),
hs AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) SELECT repo, hop, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM hs GROUP BY 1, 2""",
}
