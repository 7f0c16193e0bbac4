"""Queries on the code graph of the last snapshots, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.operators import codegraph as G
from weftwork.operators import extraction as E
from weftwork.operators import linking as L
from weftwork.session import materialised
from weftwork.tables import table

VIEWABLE = ["IMPORTS", "USES_PACKAGE", "CALLS", "RENDERS", "EXTENDS", "IMPLEMENTS", "HANDLES", "REQUESTS"]


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen once and kept as a table, since the graph's parts all start from it."""
    return materialised(G.current_facts(table(spark, folder, "facts_py")))


def links(spark, folder):
    return G.link(files(spark, folder))


def linked_files(spark, folder):
    """Files that import each other. facts_py names no file by its imports, so each file of a repository is made to import
    the next one of its language by path, in one of six ways by its place: relative, by an alias or absolute, from a base
    folder or a root folder, from a package of the repository or a foreign one, and in two ways that lead nowhere. Files of
    the second way pass on what they import. Every file calls the first definition of the next file and of the one after."""
    f = files(spark, folder).withColumn("py", F.col("path").endswith(".py"))
    w = Window.partitionBy("repo", "py").orderBy("path")
    whole = Window.partitionBy("repo", "py")
    one = F.get("definitions", F.lit(0))["name"]
    f = f.withColumns({"k": F.row_number().over(w) - 1, "own": one, "own_q": F.get("definitions", F.lit(0))["qualified_name"]})
    nxt = F.coalesce(F.lead(F.struct("path", "own")).over(w), F.min_by(F.struct("path", "own"), "path").over(whole))
    f = f.withColumn("t", nxt)
    two = F.coalesce(F.lead("t").over(w), F.min_by("t", "path").over(whole))
    f = f.withColumn("t2", two)
    stem = F.regexp_replace("t.path", r"\.(tsx?|jsx?|mjs|cjs|py)$", "")
    depth = F.size(F.split("path", "/")) - 1
    climb = F.when(depth == 0, "./").otherwise(F.repeat(F.lit("../"), depth))
    dotted = F.translate(stem, "/", ".")
    m = F.col("k") % 6
    js = F.when(m == 0, F.concat(climb, stem)).when(m == 1, F.concat(F.lit("@/"), stem)).when(m == 2, stem).when(m == 3, F.when(stem.startswith("app/"), F.concat(F.lit("@ws/"), stem)).otherwise("react")).when(m == 4, "left-pad/x").otherwise(F.concat(F.repeat(F.lit("../"), depth + 1), F.lit("x")))
    py = F.when(m == 0, F.concat(F.repeat(F.lit("."), depth + 1), dotted)).when(m == 1, dotted).when(m == 2, F.regexp_replace(dotted, r"^src\.", "")).when(m == 3, "numpy.linalg").when(m == 4, ".nothing_here").otherwise(F.concat(F.repeat(F.lit("."), depth + 3), F.lit("x")))
    names = F.filter(F.array("t.own", "t2.own"), lambda x: x.isNotNull())
    passes = (m == 1) & ~F.col("py")
    imp = F.struct(F.when(F.col("py"), py).otherwise(js).alias("specifier"), names.alias("names"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("line"), F.lit(False).alias("is_wildcard"), F.lit(False).alias("is_type_only"), passes.alias("is_reexport"), F.when(passes, names).otherwise(F.array().cast("array<string>")).alias("exported_as"))
    call = lambda name, who, line: F.struct(name.alias("callee"), F.lit(line).alias("line"), F.lit(None).cast("string").alias("receiver"), who.alias("enclosing"), F.lit(0).alias("argument_count"), F.lit(False).alias("is_construction"))
    calls = F.filter(F.array(call(F.col("t.own"), F.col("own_q"), 1), call(F.col("t2.own"), F.lit(None).cast("string"), 2)), lambda c: c["callee"].isNotNull())
    return materialised(f.withColumns({"imports": F.array(imp), "calls": F.concat(calls, "calls")}).drop("py", "k", "own", "own_q", "t", "t2"))


def linked(spark, folder):
    """linked_files with the settings that their imports depend on."""
    f = linked_files(spark, folder)
    repos = f.select("repo").distinct()
    scopes = repos.select("repo", F.lit("").alias("dir"), F.lit("").alias("base_url"), F.array(F.struct(F.lit("@/*").alias("pattern"), F.array(F.lit("./*")).alias("targets"))).alias("patterns"))
    roots = repos.select("repo", F.posexplode(F.array(F.lit(""), F.lit("src"))).alias("ord", "root"))
    none = F.array().cast("array<struct<pattern:string,targets:array<string>>>")
    packages = repos.select("repo", F.lit("@ws/app").alias("name"), F.lit("app").alias("dir"), none.alias("exports"), F.array().cast("array<string>").alias("entry"))
    return G.link(f, scopes, roots, packages)


def written_sources(spark, folder):
    """Source text for every file of the last snapshots that says what its facts say: repo, path, text. Names that the
    language couldn't write are left out, as in the SQL."""
    f = files(spark, folder)
    py, word = F.col("path").endswith(".py"), r"^[A-Za-z_][A-Za-z0-9_]*$"
    ok = lambda x: x.rlike(word)
    i = F.filter("imports", lambda x: x["specifier"].rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"))
    names = lambda x: F.array_join(F.filter(F.coalesce(x["names"], F.array().cast("array<string>")), ok), ", ")
    py_import = lambda x: F.when(names(x) == "", F.concat(F.lit("import "), x["specifier"])).otherwise(F.concat(F.lit("from "), x["specifier"], F.lit(" import "), names(x)))
    js_import = lambda x: F.when(names(x) == "", F.concat(F.lit('import "'), x["specifier"], F.lit('";'))).otherwise(F.concat(F.lit("import { "), names(x), F.lit(' } from "'), x["specifier"], F.lit('";')))
    d = F.filter("definitions", lambda x: ok(x["name"]) & x["parent"].isNull())
    py_def = lambda x: F.when(x["kind"] == "class", F.concat(F.lit("class "), x["name"], F.lit(":\n    pass"))).otherwise(F.concat(F.lit("def "), x["name"], F.lit("(a, b):\n    pass")))
    js_def = lambda x: F.when(x["kind"] == "class", F.concat(F.lit("export class "), x["name"], F.lit(" { }"))).otherwise(F.concat(F.lit("function "), x["name"], F.lit("(a, b) { /* f(1) */ }")))
    c = F.filter("calls", lambda x: x["callee"].rlike(r"^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$"))
    call = lambda x: F.concat(x["callee"], F.lit("("), F.array_join(F.array_repeat(F.lit("1"), F.coalesce(x["argument_count"], F.lit(0))), ", "), F.lit(")"), F.when(py, "").otherwise(";"))
    lines = F.concat(F.when(py, F.transform(i, py_import)).otherwise(F.transform(i, js_import)), F.when(py, F.transform(d, py_def)).otherwise(F.transform(d, js_def)), F.transform(c, call))
    return f.select("repo", "path", F.array_join(lines, "\n").alias("text"))


def ux3_extracted_facts(spark, folder):
    """Facts read from source text written from facts: the same imports, definitions and calls come back (UX1, UX3, UX4)."""
    x = E.extracted(written_sources(spark, folder), ["repo", "path"])
    part = lambda c, f: F.array_join(F.transform(c, f), ",")
    return x.select(
        "repo", "path", part("imports", lambda v: F.concat(v["specifier"], F.lit(":"), F.array_join(v["names"], "+"))).alias("imports"), part("definitions", lambda v: F.concat(F.when(v["kind"] == "class", "c:").otherwise("f:"), v["name"])).alias("definitions"),
        part("calls", lambda v: F.concat(v["callee"], F.lit("/"), v["argument_count"].cast("string"))).alias("calls"), "has_syntax_errors",
    )


def gr16_graph_nodes(spark, folder):
    """Every node of the graph (SC7, GR15, GR16, GR17, WN3, FN17)."""
    return G.nodes(links(spark, folder)).select("id", "label", "repo", "name", F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def ag6_graph_counts(spark, folder):
    """How many nodes of each label a repository has (AG6, AG17)."""
    return G.nodes(links(spark, folder)).groupBy("repo", "label").agg(F.count(F.lit(1)).alias("n"))


def gr16_graph_edges(spark, folder):
    """Every edge of the graph, of all 13 types (GR16, GR17, AG12)."""
    return G.edges(linked(spark, folder)).select("source", "target", "type", "repo", F.col("count").cast("long").alias("n"))


def ag9_module_totals(spark, folder):
    """Totals and dominant language of every folder over all below it (AG9, AG10, GR12, GR15)."""
    return G.module_totals(files(spark, folder)).select("repo", "module", "depth", "file_count", "definition_count", F.coalesce("language", F.lit("")).alias("language"))


def wn3_symbol_ids(spark, folder):
    """Ids of definitions, repeated names numbered (WN3, FN17)."""
    return G.symbols(files(spark, folder)).select("id", "repo", "path", F.col("pos").cast("int").alias("pos"), "qualified_name")


def jn18_resolved_imports(spark, folder):
    """What each import of facts_py means: a file, a package, or nothing known (JN18, FN13)."""
    r = L.resolved_imports(files(spark, folder))
    return r.select("repo", "path", F.col("ord").cast("int").alias("ord"), "specifier", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("package", F.lit("")).alias("package"))


def jn18_linked_imports(spark, folder):
    """What imports mean in files that import each other in six ways (JN18, JN19, FN14, FN15)."""
    r = linked(spark, folder).imports
    return r.select("repo", "path", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("package", F.lit("")).alias("package"))


def jn20_bound_references(spark, folder):
    """The definition that each call means, in the file, in an imported one, or passed on by it (JN20, GR14)."""
    b = linked(spark, folder).bound.filter("kind = 'CALLS'")
    return b.select("repo", "path", "callee", F.coalesce("enclosing", F.lit("")).alias("enclosing"), F.col("count").cast("long").alias("n"), F.coalesce("in_file", F.lit("")).alias("in_file"), F.coalesce("qualified", F.lit("")).alias("qualified"))


def ag14_package_names(spark, folder):
    """The names that each file takes from each package (AG14, JN29)."""
    return G.packages(links(spark, folder)).select("repo", "path", "id", F.array_join("names", ",").alias("names"), F.col("count").alias("n"))


def ag12_merged_imports(spark, folder):
    """Imports of a file by another, merged: their number, names and lines (AG12)."""
    return G.file_imports(linked(spark, folder)).select("repo", "path", "target", F.col("count").alias("n"), F.array_join("names", ",").alias("names"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def ag11_module_weights(spark, folder):
    """Imports between outermost folders, and use of packages by them (AG11)."""
    f = linked(spark, folder)
    inner = G.module_dependencies(f).select("repo", "source", "target", "weight", F.lit("DEPENDS_ON").alias("type"))
    outer = G.external_use(f).select("repo", F.col("module").alias("source"), F.lit("__external__").alias("target"), "weight", F.lit("USES_EXTERNAL").alias("type"))
    return inner.unionByName(outer).withColumn("weight", F.col("weight").cast("long"))


def wn16_name_table(spark, folder):
    """One definition per simple name of a file (WN16)."""
    return G.name_table(files(spark, folder))


def ag13_references(spark, folder):
    """References merged by caller and callee, with their lines (AG13, JN28)."""
    return G.references(linked(spark, folder)).select("repo", "path", "source", "target", "type", F.col("count").alias("n"), F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


def ag15_file_rank(spark, folder):
    """How much a file is used by others, with its most used names: the first 40 of each repository, those below app first
    (AG15, SL6, PF9)."""
    near = F.startswith("path", F.lit("app"))
    w = Window.partitionBy("repo").orderBy(near.desc(), F.desc("rank"), "path")
    return G.file_rank(linked(spark, folder)).withColumn("place", F.row_number().over(w)).filter("place <= 40").select("repo", "path", "rank", F.array_join("names", ",").alias("names"), F.col("place").cast("int").alias("place"))


def ag16_resolution_stats(spark, folder):
    """How much of a repository's imports, references and requests is resolved: 16 counts and 3 shares (AG16)."""
    k = linked(spark, folder)
    return L.resolution_stats(k.files, k.imports, k.bound, G.matched_requests(k.files))


def jn14_route_match(spark, folder):
    """The route that serves each request (JN14, FN12)."""
    m = G.matched_requests(files(spark, folder))
    return m.select("repo", "path", "line", "method", "called", F.coalesce("route", F.lit("")).alias("route"))


def gr4_top_children(spark, folder):
    """The 5 best connected children of each container (WN1, GR4, JN2)."""
    return G.top_children(materialised(G.edges(linked(spark, folder))), VIEWABLE, 5).select("parent", "id", "degree", F.col("rank").cast("int").alias("place"))


def wn2_followed(spark, folder):
    """The 3 heaviest edges of every file (WN2)."""
    e = materialised(G.edges(linked(spark, folder)))
    origins = e.filter("type = 'USES_PACKAGE'").select(F.col("source").alias("id")).distinct()
    return G.followed(e, origins, 3, ["USES_PACKAGE", "IMPORTS"]).select("source", "target", "type", F.col("count").cast("long").alias("n"), F.col("rank").cast("int").alias("place"))


def _suppliers(spark, folder):
    l = table(spark, folder, "lineitem")
    return l.select(F.concat(F.lit("S/"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("O/"), F.col("l_orderkey").cast("string")).alias("target"), F.lit("CALLS").alias("type")).distinct()


def gr1_neighbours(spark, folder):
    """Everything within 2 steps of every twentieth supplier, over all line items (GR1)."""
    starts = table(spark, folder, "supplier").filter("s_suppkey % 20 = 0").select(F.concat(F.lit("S/"), F.col("s_suppkey").cast("string")).alias("id"))
    return G.neighbourhood(_suppliers(spark, folder), starts, 2).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def gr2_subtree(spark, folder):
    """All containers and files up to 4 levels below each repository (GR2)."""
    k = links(spark, folder)
    e = materialised(G.edges(k))
    roots = k.files.select(F.col("repo").alias("id")).distinct()
    return G.subtree(e.filter("type = 'CONTAINS'"), roots, 4).select("root", "id", F.coalesce("parent", F.lit("")).alias("parent"), "depth")


def ag8_view_edges(spark, folder):
    """Edges drawn between the outermost folders that are open, and packages (AG7, AG8, JN17)."""
    k = linked(spark, folder)
    visible = G.nodes(k).filter("label = 'Package' OR (label = 'Module' AND depth <= 1) OR label = 'Repository'").select("id")
    return G.rolled_up(materialised(G.edges(k)), visible, VIEWABLE)


def ag8_weight_conserved(spark, folder):
    """Opening folders moves weight, and loses none to the packages: one row per depth, equal weights (AG8)."""
    k = links(spark, folder)
    n, e = materialised(G.nodes(k)), materialised(G.edges(k))
    parts = None
    for d in (1, 2, 3):
        visible = n.filter((F.col("label") == "Package") | (F.col("label") == "Repository") | ((F.col("label") == "Module") & (F.col("depth") <= d))).select("id")
        one = G.rolled_up(e, visible, ["USES_PACKAGE"]).agg(F.sum("weight").cast("long").alias("weight")).select(F.lit(d).alias("depth"), "weight")
        parts = one if parts is None else parts.unionByName(one)
    return parts


QUERIES = {f.__name__: f for f in (
    gr16_graph_nodes, ag6_graph_counts, gr16_graph_edges, ag9_module_totals, wn3_symbol_ids, jn18_resolved_imports, jn18_linked_imports, jn20_bound_references, ag12_merged_imports, ux3_extracted_facts, ag14_package_names, ag11_module_weights, wn16_name_table,
    ag13_references, ag15_file_rank, ag16_resolution_stats, jn14_route_match, gr4_top_children, wn2_followed, gr1_neighbours, gr2_subtree, ag8_view_edges, ag8_weight_conserved,
)}

CF_HEAD = """cf AS (
  SELECT f.* FROM facts_py f JOIN (SELECT repo, max(snapshot_no) AS s FROM facts_py GROUP BY repo) l ON f.repo = l.repo AND f.snapshot_no = l.s
  QUALIFY row_number() OVER (PARTITION BY f.repo, f.path ORDER BY extracted_at DESC, row_id DESC) = 1
), md AS (
  SELECT DISTINCT repo, array_to_string(list_slice(p, 1, n), '/') AS m, n AS depth FROM (
    SELECT repo, p, unnest(range(1, len(p))) AS n FROM (SELECT repo, string_split(path, '/') AS p FROM cf))
), df AS (
  SELECT repo, path, CAST(pos - 1 AS INTEGER) AS pos, definitions[pos] AS d FROM (SELECT repo, path, definitions, unnest(range(1, len(definitions) + 1)) AS pos FROM cf)
), sy AS (
  SELECT repo, path, pos, d.name AS name, d.qualified_name AS q, d.parent AS parent, row_number() OVER (PARTITION BY repo, path, d.qualified_name ORDER BY pos) AS o FROM df
), sm AS (
  SELECT *, repo || ':' || path || '#' || q || CASE WHEN o > 1 THEN '@' || o ELSE '' END AS id FROM sy
"""
_REAL = """), im AS (
  SELECT repo, path, language, CAST(pos - 1 AS INTEGER) AS ord, imports[pos].specifier AS spec, imports[pos].names AS names, imports[pos].is_reexport AS re FROM (SELECT repo, path, language, imports, unnest(range(1, len(imports) + 1)) AS pos FROM cf)
), ib AS (
  SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS here, length(regexp_extract(spec, '^([.]*)', 1)) AS dots,
    replace(regexp_replace(spec, '^[.]+', ''), '.', '/') AS rest FROM im
), ic AS (
  SELECT *, CASE WHEN ends_with(path, '.py') AND dots > 0 THEN
      array_to_string(list_filter([array_to_string(list_slice(string_split(here, '/'), 1, greatest(len(string_split(here, '/')) - (dots - 1), 0)), '/'), rest], lambda x: x <> ''), '/')
    WHEN ends_with(path, '.py') THEN rest
    WHEN starts_with(spec, '.') THEN array_to_string(list_filter([here, regexp_replace(spec, '^[.]/', '')], lambda x: x <> ''), '/') END AS base FROM ib
), cd AS (
  SELECT repo, path, ord, k, base || e AS candidate FROM (
    SELECT repo, path, ord, base, unnest(range(0, len(ex))) AS k, unnest(ex) AS e FROM (
      SELECT *, CASE WHEN ends_with(path, '.py') THEN ['.py', '/__init__.py'] ELSE ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'] END AS ex FROM ic WHERE base IS NOT NULL))
), ht AS (
  SELECT cd.repo, cd.path, ord, arg_min(candidate, k) AS target FROM cd JOIN cf ON cf.repo = cd.repo AND cf.path = cd.candidate GROUP BY 1, 2, 3
), ri AS (
  SELECT im.*, ht.target, CASE WHEN ht.target IS NULL AND NOT starts_with(spec, '.') THEN CASE WHEN ends_with(path, '.py') THEN split_part(spec, '.', 1)
      WHEN starts_with(spec, '@') AND contains(spec, '/') THEN split_part(spec, '/', 1) || '/' || split_part(spec, '/', 2) ELSE split_part(regexp_replace(spec, '^node:', ''), '/', 1) END END AS package
  FROM im LEFT JOIN ht USING (repo, path, ord)
)"""
_LINKED = """), lk AS (
  SELECT cf.*, ends_with(path, '.py') AS py, row_number() OVER w - 1 AS k, definitions[1].name AS own, definitions[1].qualified_name AS own_q,
    coalesce(lead(path) OVER w, first_value(path) OVER w) AS tp FROM cf WINDOW w AS (PARTITION BY repo, ends_with(path, '.py') ORDER BY path)
), lm AS (
  SELECT a.*, b.own AS n1, c.own AS n2, a.k % 6 AS m, regexp_replace(a.tp, '[.](tsx?|jsx?|mjs|cjs|py)$', '') AS stem, b.tp AS tp2 FROM lk a JOIN lk b ON b.repo = a.repo AND b.path = a.tp JOIN lk c ON c.repo = a.repo AND c.path = b.tp
)"""
_MADE = """), lb AS (
  SELECT *, CASE WHEN py THEN CASE WHEN m <= 2 THEN CASE WHEN m = 2 AND starts_with(stem, 'src/') THEN [replace(substr(stem, 5), '.', '/'), 'src/' || replace(substr(stem, 5), '.', '/')] ELSE [replace(stem, '.', '/')] || CASE WHEN m > 0 THEN ['src/' || replace(stem, '.', '/')] ELSE [] END END END
    WHEN m <= 2 OR m = 3 AND starts_with(stem, 'app/') THEN CASE WHEN m = 3 THEN ['@ws/' || stem, stem, 'app/src/' || substr(stem, 5)] ELSE [stem] END END AS bases FROM lm
), cd AS (
  SELECT repo, path, b, e, bases[b] || ex[e] AS candidate FROM (SELECT repo, path, bases, ex, b, unnest(range(1, len(ex) + 1)) AS e FROM (
    SELECT repo, path, bases, unnest(range(1, len(bases) + 1)) AS b, CASE WHEN py THEN ['.py', '/__init__.py'] ELSE ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'] END AS ex FROM lb WHERE bases IS NOT NULL))
), ht AS (
  SELECT cd.repo, cd.path, arg_min(candidate, b * 100 + e) AS target FROM cd JOIN cf ON cf.repo = cd.repo AND cf.path = cd.candidate GROUP BY 1, 2
), ri AS (
  SELECT lb.repo, lb.path, language, 0 AS ord, '' AS spec, list_filter([n1, n2], lambda x: x IS NOT NULL) AS names, NOT py AND m = 1 AS re, ht.target,
    CASE WHEN ht.target IS NULL THEN CASE WHEN py THEN CASE WHEN m = 3 THEN 'numpy' WHEN m IN (1, 2) THEN split_part(replace(CASE WHEN m = 2 AND starts_with(stem, 'src/') THEN substr(stem, 5) ELSE stem END, '/', '.'), '.', 1) END
      WHEN m = 1 THEN '@/' || split_part(stem, '/', 1) WHEN m = 2 THEN split_part(stem, '/', 1) WHEN m = 3 THEN CASE WHEN starts_with(stem, 'app/') THEN '@ws/app' ELSE 'react' END WHEN m = 4 THEN 'left-pad' END END AS package
  FROM lb LEFT JOIN ht USING (repo, path)
)"""
_NAMES = """, pk AS (
  SELECT repo, path, CASE WHEN language = 'python' THEN 'pypi' WHEN language IN ('javascript', 'typescript', 'tsx') THEN 'npm' ELSE 'unknown' END AS eco, package AS name,
    list_sort(list_distinct(flatten(list(coalesce(names, []))))) AS names, count(*) AS n FROM ri WHERE package <> '' AND NOT coalesce(re, false) GROUP BY 1, 2, 3, 4
), pi AS (SELECT *, repo || ':pkg:' || eco || '/' || name AS id FROM pk),
nt AS (
  SELECT repo, path, name, q, repo || ':' || path || '#' || q AS id FROM sm QUALIFY row_number() OVER (PARTITION BY repo, path, name ORDER BY parent IS NULL DESC, CASE WHEN parent IS NULL THEN -pos ELSE pos END) = 1
), bd AS (
  -- an imported name, in the file it comes from or, if that one passes it on, in the next
  SELECT i.repo, i.path, i.name, a.path AS in_file, a.q AS qualified, i.package FROM (SELECT repo, path, target, package, unnest(names) AS name FROM ri WHERE NOT coalesce(re, false)) i LEFT JOIN nt a ON a.repo = i.repo AND a.path = i.target AND a.name = i.name WHERE a.q IS NOT NULL OR i.target IS NULL
  UNION ALL SELECT i.repo, i.path, i.name, b.path, b.q, NULL FROM (SELECT repo, path, target, unnest(names) AS name FROM ri WHERE NOT coalesce(re, false)) i JOIN ri t ON t.repo = i.repo AND t.path = i.target AND t.re AND list_contains(t.names, i.name) JOIN nt b ON b.repo = i.repo AND b.path = t.target AND b.name = i.name
    WHERE NOT EXISTS (SELECT 1 FROM nt a WHERE a.repo = i.repo AND a.path = i.target AND a.name = i.name)
), cl AS (
  {calls}
), br AS (
  SELECT cl.repo, cl.path, cl.callee, cl.enclosing, cl.line, coalesce(nt.path, bd.in_file) AS in_file, coalesce(nt.q, bd.qualified) AS qualified, CASE WHEN nt.q IS NULL AND bd.qualified IS NULL THEN coalesce(bd.package, hp.package) END AS package
  FROM cl LEFT JOIN nt ON nt.repo = cl.repo AND nt.path = cl.path AND nt.name = cl.callee LEFT JOIN (SELECT DISTINCT * FROM bd) bd ON bd.repo = cl.repo AND bd.path = cl.path AND bd.name = cl.callee
  LEFT JOIN (SELECT DISTINCT repo, path, name, package FROM bd WHERE package IS NOT NULL) hp ON hp.repo = cl.repo AND hp.path = cl.path AND hp.name = split_part(cl.callee, '.', 1)
), ih AS (
  SELECT x.repo, x.path, i.kind AS kind, i.child AS child, i.parent_name AS pn, i.line AS line, coalesce(nt.path, bd.in_file) AS in_file, coalesce(nt.q, bd.qualified) AS qualified, CASE WHEN nt.q IS NULL AND bd.qualified IS NULL THEN bd.package END AS package
  FROM (SELECT repo, path, unnest(inheritance) AS i FROM cf) x LEFT JOIN nt ON nt.repo = x.repo AND nt.path = x.path AND nt.name = i.parent_name LEFT JOIN (SELECT DISTINCT * FROM bd) bd ON bd.repo = x.repo AND bd.path = x.path AND bd.name = i.parent_name
), rn AS (
  SELECT x.repo, x.path, i.component AS pn, i.enclosing AS child, i.line AS line, coalesce(nt.path, bd.in_file) AS in_file, coalesce(nt.q, bd.qualified) AS qualified, CASE WHEN nt.q IS NULL AND bd.qualified IS NULL THEN bd.package END AS package
  FROM (SELECT repo, path, unnest(renders) AS i FROM cf) x LEFT JOIN nt ON nt.repo = x.repo AND nt.path = x.path AND nt.name = i.component LEFT JOIN (SELECT DISTINCT * FROM bd) bd ON bd.repo = x.repo AND bd.path = x.path AND bd.name = i.component
), al AS (
  SELECT repo, path, enclosing, line, in_file, qualified, 'CALLS' AS kind FROM br WHERE qualified IS NOT NULL
  UNION ALL SELECT repo, path, child, line, in_file, qualified, 'RENDERS' FROM rn WHERE qualified IS NOT NULL
  UNION ALL SELECT repo, path, child, line, in_file, qualified, CASE WHEN kind = 'implements' THEN 'IMPLEMENTS' ELSE 'EXTENDS' END FROM ih WHERE qualified IS NOT NULL
), rf AS (
  SELECT al.repo, al.path, in_file, coalesce(f.id, al.repo || ':' || al.path) AS source, al.repo || ':' || in_file || '#' || qualified AS target, kind AS type, count(*) AS n, list_sort(list(line)) AS lines
  FROM al LEFT JOIN (SELECT repo, path, q AS enclosing, id FROM sm WHERE o = 1) f USING (repo, path, enclosing) GROUP BY ALL
), """
_GRAPH = """rp AS (
  SELECT x, CASE WHEN q = '' THEN '/' WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS p FROM (
    SELECT x, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(x), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '[{][^/}]*[}]|:[^/]+|\\[[^/\\]]*\\]', '*', 'g'), '/{2,}', '/', 'g'), '/+$', '') AS q
    FROM (SELECT DISTINCT unnest(list_transform(routes, lambda r: r.path)) AS x FROM cf UNION SELECT DISTINCT unnest(list_transform(http_calls, lambda r: r.path)) FROM cf))
), rt AS (
  SELECT repo, path, ord, upper(r.method) AS method, r.handler AS handler, rp.p AS route FROM (SELECT repo, path, pos - 1 AS ord, routes[pos] AS r FROM (SELECT repo, path, routes, unnest(range(1, len(routes) + 1)) AS pos FROM cf)) JOIN rp ON rp.x = r.path
), rc AS (
  SELECT repo, path, ord, r.line AS line, upper(r.method) AS method, r.caller AS caller, rp.p AS called FROM (SELECT repo, path, pos - 1 AS ord, http_calls[pos] AS r FROM (SELECT repo, path, http_calls, unnest(range(1, len(http_calls) + 1)) AS pos FROM cf)) JOIN rp ON rp.x = r.path
), rd AS (SELECT repo, method, route, min(struct_pack(p := path, o := ord)) AS f FROM rt GROUP BY 1, 2, 3),
mt AS (SELECT rc.repo, rc.path, rc.ord, arg_min(route, struct_pack(i := CAST(route <> called AS INTEGER), f := rd.f, r := route)) AS route FROM rc JOIN rd ON rd.repo = rc.repo AND rd.method = rc.method
  AND len(string_split(route, '/')) = len(string_split(called, '/'))
  AND len(list_filter(list_zip(string_split(route, '/'), string_split(called, '/')), lambda z: NOT (z[1] = '*' OR z[1] = z[2]))) = 0 GROUP BY 1, 2, 3),
nd AS (
  SELECT DISTINCT repo AS id, 'Repository' AS label, repo, repo AS name, 0 AS depth FROM cf
  UNION ALL SELECT repo || ':' || m, 'Module', repo, m, depth FROM md
  UNION ALL SELECT DISTINCT repo || ':__external__', 'Module', repo, '__external__', 1 FROM pi UNION ALL SELECT DISTINCT repo || ':__routes__', 'Module', repo, '__routes__', 1 FROM rt
  UNION ALL SELECT repo || ':' || path, 'File', repo, regexp_extract(path, '([^/]*)$', 1), -1 FROM cf
  UNION ALL SELECT id, 'Symbol', repo, name, -1 FROM sm
  UNION ALL SELECT DISTINCT id, 'Package', repo, name, -1 FROM pi
  UNION ALL SELECT DISTINCT repo || ':route:' || method || ' ' || route, 'Route', repo, route, -1 FROM rt
), eg AS (
  SELECT CASE WHEN contains(m, '/') THEN repo || ':' || regexp_replace(m, '/[^/]*$', '') ELSE repo END AS source, repo || ':' || m AS target, 'CONTAINS' AS type, repo, 1 AS n FROM md
  UNION ALL SELECT CASE WHEN contains(path, '/') THEN repo || ':' || regexp_replace(path, '/[^/]*$', '') ELSE repo END, repo || ':' || path, 'CONTAINS', repo, 1 FROM cf
  UNION ALL SELECT coalesce(o.id, s.repo || ':' || s.path), s.id, CASE WHEN o.id IS NULL THEN 'DEFINES' ELSE 'HAS_MEMBER' END, s.repo, 1 FROM sm s LEFT JOIN (SELECT repo, path, q, id FROM sm WHERE o = 1) o ON o.repo = s.repo AND o.path = s.path AND o.q = s.parent
  UNION ALL SELECT repo || ':' || path, repo || ':' || target, 'IMPORTS', repo, count(*) FROM ri WHERE target IS NOT NULL AND target <> path GROUP BY repo, path, target
  UNION ALL SELECT repo || ':' || path, id, 'USES_PACKAGE', repo, n FROM pi
  UNION ALL SELECT source, target, type, repo, sum(n) FROM rf GROUP BY ALL
  UNION ALL SELECT DISTINCT repo, repo || ':__external__', 'CONTAINS', repo, 1 FROM pi UNION ALL SELECT DISTINCT repo || ':__external__', id, 'CONTAINS', repo, 1 FROM pi
  UNION ALL SELECT DISTINCT repo, repo || ':__routes__', 'CONTAINS', repo, 1 FROM rt UNION ALL SELECT DISTINCT repo || ':__routes__', repo || ':route:' || method || ' ' || route, 'CONTAINS', repo, 1 FROM rt
  UNION ALL SELECT coalesce(f.id, rt.repo || ':' || rt.path), rt.repo || ':route:' || method || ' ' || route, 'HANDLES', rt.repo, count(*) FROM rt LEFT JOIN (SELECT repo, path, q AS handler, id FROM sm WHERE o = 1) f USING (repo, path, handler) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT coalesce(f.id, rc.repo || ':' || rc.path), rc.repo || ':route:' || method || ' ' || mt.route, 'REQUESTS', rc.repo, count(*) FROM rc JOIN mt USING (repo, path, ord) LEFT JOIN (SELECT repo, path, q AS caller, id FROM sm WHERE o = 1) f USING (repo, path, caller) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT repo || ':' || split_part(path, '/', 1), repo || ':' || split_part(target, '/', 1), 'DEPENDS_ON', repo, count(*) FROM ri WHERE target IS NOT NULL AND contains(path, '/') AND contains(target, '/') AND split_part(path, '/', 1) <> split_part(target, '/', 1) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT repo || ':' || split_part(path, '/', 1), repo || ':__external__', 'USES_EXTERNAL', repo, count(*) FROM pi WHERE contains(path, '/') GROUP BY 1, 2, 3, 4
)"""
_CALLS = "SELECT repo, path, c.line AS line, c.callee AS callee, c.enclosing AS enclosing FROM (SELECT repo, path, unnest(calls) AS c FROM cf) WHERE c.callee IS NOT NULL"
_MORE_CALLS = """SELECT repo, path, c.line AS line, c.callee AS callee, c.enclosing AS enclosing FROM (SELECT repo, path, unnest(calls) AS c FROM cf) WHERE c.callee IS NOT NULL
  UNION ALL SELECT repo, path, 1, n1, own_q FROM lm WHERE n1 IS NOT NULL UNION ALL SELECT repo, path, 2, n2, NULL FROM lm WHERE n2 IS NOT NULL"""
CF = CF_HEAD + _REAL + _NAMES.replace("{calls}", _CALLS) + _GRAPH
# the same over files that import each other: what each way must mean is said without its specifier
CL = CF_HEAD + _LINKED + _MADE[1:] + _NAMES.replace("{calls}", _MORE_CALLS) + _GRAPH

_W, _K = f"WITH RECURSIVE {CF}", f"WITH RECURSIVE {CL}"
_VIEW = ", ".join(f"'{t}'" for t in VIEWABLE)
_OPEN = "SELECT id FROM nd WHERE label = 'Package' OR label = 'Repository' OR (label = 'Module' AND depth <= 1)"
_SUP = "SELECT DISTINCT 'S/' || l_suppkey AS a, 'O/' || l_orderkey AS b FROM lineitem"


def _rolled(visible: str, kinds: str) -> str:
    return f"""vs AS ({visible}), eo AS (SELECT source, target, type, greatest(coalesce(n, 1), 1) AS w FROM eg WHERE type IN ({kinds})),
en AS (SELECT DISTINCT unnest([source, target]) AS id FROM eo),
ch AS (SELECT id, split_part(id, ':', 1) AS r, substr(id, length(split_part(id, ':', 1)) + 2) AS x FROM en),
ck AS (SELECT id, r, x, string_split(split_part(x, '#', 1), '/') AS p FROM ch),
st AS (SELECT id, -1 AS k, id AS step FROM ck UNION ALL SELECT id, len(p) - n, r || ':' || array_to_string(list_slice(p, 1, n), '/') FROM (SELECT *, unnest(range(1, len(p) + 1)) AS n FROM ck) UNION ALL SELECT id, 1000, r FROM ck),
pl AS (SELECT st.id, arg_min(step, k) AS at_id FROM st JOIN vs ON vs.id = st.step GROUP BY 1),
ru AS (SELECT a.at_id AS source, b.at_id AS target, type, CAST(sum(w) AS BIGINT) AS weight, bool_or(eo.source <> a.at_id OR eo.target <> b.at_id) AS collapsed
  FROM eo JOIN pl a ON a.id = eo.source JOIN pl b ON b.id = eo.target WHERE a.at_id <> b.at_id GROUP BY 1, 2, 3)"""


_N = "list_filter(coalesce(x.names, []), lambda n: regexp_full_match(n, '[A-Za-z_][A-Za-z0-9_]*'))"
SQL = {
    "ux3_extracted_facts": f"""{_W} SELECT repo, path, array_to_string(list_transform(list_filter(imports, lambda x: regexp_full_match(x.specifier, '[A-Za-z_][A-Za-z0-9_.]*')), lambda x: x.specifier || ':' || array_to_string({_N}, '+')), ',') AS imports,
  array_to_string(list_transform(list_filter(definitions, lambda x: regexp_full_match(x.name, '[A-Za-z_][A-Za-z0-9_]*') AND x.parent IS NULL), lambda x: CASE WHEN x.kind = 'class' THEN 'c:' ELSE 'f:' END || x.name), ',') AS definitions,
  array_to_string(list_transform(list_filter(calls, lambda x: regexp_full_match(x.callee, '[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*')), lambda x: x.callee || '/' || coalesce(x.argument_count, 0)), ',') AS calls, false AS has_syntax_errors FROM cf""",
    "gr16_graph_nodes": f"{_W} SELECT id, label, repo, name, CAST(depth AS INTEGER) AS depth FROM nd",
    "ag6_graph_counts": f"{_W} SELECT repo, label, count(*) AS n FROM nd GROUP BY repo, label",
    "gr16_graph_edges": f"{_K} SELECT source, target, type, repo, CAST(max(n) AS BIGINT) AS n FROM eg GROUP BY source, target, type, repo",
    "ag9_module_totals": f"""{_W}, sp AS (SELECT repo, language, len(definitions) AS n, array_to_string(list_slice(p, 1, k), '/') AS module, k FROM (SELECT *, unnest(range(1, len(p))) AS k FROM (SELECT repo, language, definitions, string_split(path, '/') AS p FROM cf))),
lg AS (SELECT repo, module, language, count(*) AS c FROM sp WHERE language IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY repo, module ORDER BY count(*) DESC, language) = 1)
SELECT sp.repo, sp.module, CAST(max(k) AS INTEGER) AS depth, count(*) AS file_count, CAST(sum(n) AS BIGINT) AS definition_count, coalesce(max(lg.language), '') AS language FROM sp LEFT JOIN lg USING (repo, module) GROUP BY sp.repo, sp.module""",
    "wn3_symbol_ids": f"{_W} SELECT id, repo, path, pos, q AS qualified_name FROM sm",
    "jn18_resolved_imports": f"{_W} SELECT repo, path, ord, spec AS specifier, coalesce(target, '') AS target, coalesce(package, '') AS package FROM ri",
    "ag14_package_names": f"{_W} SELECT repo, path, id, array_to_string(names, ',') AS names, n FROM pi",
    "ag11_module_weights": f"""{_K} SELECT repo, split_part(path, '/', 1) AS source, split_part(target, '/', 1) AS target, count(*) AS weight, 'DEPENDS_ON' AS type FROM ri
WHERE target IS NOT NULL AND contains(path, '/') AND contains(target, '/') AND split_part(path, '/', 1) <> split_part(target, '/', 1) GROUP BY 1, 2, 3
UNION ALL SELECT repo, split_part(path, '/', 1), '__external__', count(*), 'USES_EXTERNAL' FROM pi WHERE contains(path, '/') GROUP BY 1, 2, 3""",
    "jn18_linked_imports": f"{_K} SELECT repo, path, coalesce(target, '') AS target, coalesce(package, '') AS package FROM ri",
    "jn20_bound_references": f"{_K} SELECT repo, path, callee, coalesce(enclosing, '') AS enclosing, count(*) AS n, coalesce(in_file, '') AS in_file, coalesce(qualified, '') AS qualified FROM br GROUP BY ALL",
    "ag12_merged_imports": f"{_K} SELECT repo, path, target, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(names)))), ',') AS names, array_to_string(list(1), ',') AS lines FROM ri WHERE target IS NOT NULL AND target <> path GROUP BY 1, 2, 3",
    "wn16_name_table": f"{_W} SELECT repo, path, name, id FROM nt",
    "ag13_references": f"{_K} SELECT repo, path, source, target, type, n, array_to_string(lines, ',') AS lines FROM rf",
    "ag15_file_rank": f"""{_K}, en2 AS (SELECT repo, path, target FROM ri WHERE target IS NOT NULL AND target <> path UNION ALL SELECT repo, path, in_file FROM (SELECT DISTINCT repo, path, in_file, enclosing, qualified, kind FROM al) WHERE in_file <> path),
fr AS (SELECT repo, path, sum(r) AS rank FROM (SELECT repo, target AS path, 1.0::DOUBLE AS r FROM en2 UNION ALL SELECT repo, path, 0.5 FROM en2) GROUP BY 1, 2),
us AS (SELECT repo, in_file AS path, qualified AS name, count(*) AS n FROM al WHERE in_file <> path GROUP BY 1, 2, 3),
dd AS (SELECT repo, path, d.name AS name, min(pos) AS pos FROM (SELECT *, bool_or(coalesce(d.exported, false)) OVER (PARTITION BY repo, path) AS anyone FROM df WHERE d.parent IS NULL) WHERE coalesce(d.exported, false) OR NOT anyone GROUP BY 1, 2, 3),
nm AS (SELECT repo, path, array_to_string(list_slice(list(dd.name ORDER BY coalesce(n, 0) DESC, pos), 1, 5), ',') AS names FROM dd LEFT JOIN us USING (repo, path, name) GROUP BY 1, 2)
SELECT * FROM (SELECT cf.repo, cf.path, coalesce(rank, 0) AS rank, coalesce(names, '') AS names, CAST(row_number() OVER (PARTITION BY cf.repo ORDER BY starts_with(cf.path, 'app') DESC, coalesce(rank, 0) DESC, cf.path) AS INTEGER) AS place
  FROM cf LEFT JOIN fr USING (repo, path) LEFT JOIN nm USING (repo, path)) WHERE place <= 40""",
    "ag16_resolution_stats": f"""{_K}, i AS (SELECT repo, count(*) AS imports_total, count(target) AS imports_to_files, count(package) AS imports_to_packages, count(*) - count(target) - count(package) AS imports_unresolved FROM ri GROUP BY repo),
c AS (SELECT repo, count(*) AS calls_total, count(qualified) AS calls_resolved, count(package) AS calls_to_packages FROM br GROUP BY repo),
r AS (SELECT repo, count(*) AS renders_total, count(qualified) AS renders_resolved, count(package) AS renders_to_packages FROM rn GROUP BY repo),
h AS (SELECT repo, count(*) AS inheritance_total, count(qualified) AS inheritance_resolved, count(package) AS inheritance_to_packages FROM ih GROUP BY repo),
w AS (SELECT repo, CAST(coalesce(sum(len(routes)), 0) AS BIGINT) AS routes_total, CAST(coalesce(sum(len(http_calls)), 0) AS BIGINT) AS http_calls_total FROM cf GROUP BY repo),
q AS (SELECT repo, count(*) AS http_calls_matched FROM mt GROUP BY repo),
z AS (SELECT w.repo, routes_total, http_calls_total, coalesce(imports_total, 0) AS imports_total, coalesce(imports_to_files, 0) AS imports_to_files, coalesce(imports_to_packages, 0) AS imports_to_packages, coalesce(imports_unresolved, 0) AS imports_unresolved,
  coalesce(calls_total, 0) AS calls_total, coalesce(calls_resolved, 0) AS calls_resolved, coalesce(calls_to_packages, 0) AS calls_to_packages, coalesce(renders_total, 0) AS renders_total, coalesce(renders_resolved, 0) AS renders_resolved, coalesce(renders_to_packages, 0) AS renders_to_packages,
  coalesce(inheritance_total, 0) AS inheritance_total, coalesce(inheritance_resolved, 0) AS inheritance_resolved, coalesce(inheritance_to_packages, 0) AS inheritance_to_packages, coalesce(http_calls_matched, 0) AS http_calls_matched
  FROM w LEFT JOIN i USING (repo) LEFT JOIN c USING (repo) LEFT JOIN r USING (repo) LEFT JOIN h USING (repo) LEFT JOIN q USING (repo))
SELECT *, CASE WHEN imports_to_files + imports_unresolved > 0 THEN round(imports_to_files::DOUBLE / (imports_to_files + imports_unresolved), 4) ELSE 1.0 END AS internal_import_resolution,
  CASE WHEN calls_total > 0 THEN round(calls_resolved::DOUBLE / calls_total, 4) ELSE 1.0 END AS call_resolution, CASE WHEN calls_total > 0 THEN round((calls_resolved + calls_to_packages)::DOUBLE / calls_total, 4) ELSE 1.0 END AS calls_accounted FROM z""",
    "jn14_route_match": f"{_W} SELECT rc.repo, rc.path, rc.line, rc.method, rc.called, coalesce(mt.route, '') AS route FROM rc LEFT JOIN mt USING (repo, path, ord)",
    "gr4_top_children": f"""{_K}, ee AS (SELECT source, target, type, max(n) AS n FROM eg GROUP BY 1, 2, 3), dg AS (SELECT id, count(*) AS degree FROM (SELECT unnest([source, target]) AS id FROM ee WHERE type IN ({_VIEW})) GROUP BY 1)
SELECT * FROM (SELECT source AS parent, target AS id, coalesce(degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(degree, 0) DESC, target) AS INTEGER) AS place
  FROM ee LEFT JOIN dg ON dg.id = ee.target WHERE type IN ('CONTAINS', 'DEFINES', 'HAS_MEMBER')) WHERE place <= 5""",
    "wn2_followed": f"""{_K} SELECT * FROM (SELECT source, target, type, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(n, 1) DESC, target, type) AS INTEGER) AS place FROM eg
  WHERE type IN ('USES_PACKAGE', 'IMPORTS') AND source IN (SELECT source FROM eg WHERE type = 'USES_PACKAGE')) WHERE place <= 3""",
    "gr1_neighbours": f"""WITH e AS ({_SUP}), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT 'S/' || s_suppkey AS start FROM supplier WHERE s_suppkey % 20 = 0),
d1 AS (SELECT DISTINCT start, y AS id, 1 AS depth FROM r JOIN s ON s.x = start WHERE y <> start),
d2 AS (SELECT DISTINCT start, y AS id, 2 AS depth FROM d1 JOIN s ON s.x = d1.id WHERE y <> start AND (start, y) NOT IN (SELECT start, id FROM d1))
SELECT start, depth, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY start, depth""",
    "gr2_subtree": f"""{_W}, tr AS (SELECT DISTINCT repo AS root, repo AS id, '' AS parent, 0 AS depth FROM cf UNION ALL SELECT root, target, source, depth + 1 FROM tr JOIN eg ON eg.source = tr.id AND type = 'CONTAINS' WHERE depth < 4)
SELECT root, id, min(parent) AS parent, min(depth) AS depth FROM tr GROUP BY root, id""",
    "ag8_view_edges": f"{_K}, {_rolled(_OPEN, _VIEW)} SELECT * FROM ru",
    "ag8_weight_conserved": f"{_W} SELECT d AS depth, CAST((SELECT sum(n) FROM pi) AS BIGINT) AS weight FROM (SELECT unnest([1, 2, 3]) AS d)",
}
