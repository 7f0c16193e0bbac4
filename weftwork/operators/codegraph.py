"""The typed property graph of source code, built from per-file facts."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.ids import EXTERNAL, ROUTES, ancestry, ecosystem, node_id, outer_module, owning_module, package_id, route_id, symbol_id
from weftwork.functions.text import route_path
from weftwork.operators import linking
from weftwork.operators.incremental import newest
from weftwork.session import materialised

CONTAINMENT = ["CONTAINS", "DEFINES", "HAS_MEMBER"]
#: What counts of a file's outgoing use in its rank, and how many exported names it's described by.
OUTWARD, KEY_NAMES = 0.5, 5


class Links:
    """The files of a graph and what their imports and references mean; each is kept as a table when first asked for."""

    def __init__(self, files: DataFrame, scopes: DataFrame | None = None, roots: DataFrame | None = None, packages: DataFrame | None = None):
        self.files, self._settings = files, (scopes, roots, packages)

    @cached_property
    def imports(self) -> DataFrame:
        return materialised(linking.resolved_imports(self.files, *self._settings))

    @cached_property
    def bound(self) -> DataFrame:
        return materialised(linking.bound_references(self.files, self.imports))


def link(files: DataFrame, scopes: DataFrame | None = None, roots: DataFrame | None = None, packages: DataFrame | None = None) -> Links:
    """Links of files; the settings are those of linking.resolved_imports."""
    return Links(files, scopes, roots, packages)


def current_facts(facts: DataFrame) -> DataFrame:
    """The newest row of each file in the last snapshot of its repository; equal times go to the larger row id."""
    last = facts.groupBy("repo").agg(F.max("snapshot_no").alias("__last"))
    return newest(
        facts.join(last, "repo").filter("snapshot_no = __last").drop("__last"), ["repo", "path"], [F.col("extracted_at").desc_nulls_last(), F.col("row_id").desc_nulls_last()]
    )


def symbols(files: DataFrame) -> DataFrame:
    """repo, path, id, name, kind, qualified_name, parent, exported, start_line, end_line, signature, docstring, pos, ordinal.

    Names repeated in a file are numbered in the order of their definitions; the first keeps the clean id.
    """
    d = files.select("repo", "path", F.posexplode("definitions").alias("pos", "d")).select("repo", "path", "pos", "d.*")
    ordinal = F.row_number().over(Window.partitionBy("repo", "path", "qualified_name").orderBy("pos"))
    d = d.withColumn("ordinal", ordinal)
    return d.withColumn("id", symbol_id(F.col("repo"), F.col("path"), F.col("qualified_name"), F.col("ordinal")))


def module_totals(files: DataFrame) -> DataFrame:
    """repo, module, depth, file_count, definition_count, language: totals of every folder over all that lies below it.

    The language is the one of most files, by name among equals; files without one don't vote, and a folder of such files
    only has none. Counts are combined per
    language before the second aggregate, so each file is spread over its ancestors only once.
    """
    spread = files.select("repo", F.explode(ancestry(owning_module(F.col("path")))).alias("module"), "language", F.size("definitions").alias("n"))
    per = spread.groupBy("repo", "module", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("definitions"))
    votes = F.when(F.col("language").isNotNull(), F.struct(F.col("files").alias("n"), F.col("language").alias("l")))
    # the largest count, then the first name: order by count up and name down
    best = F.array_sort(F.collect_list(votes), lambda a, b: F.when(a.n > b.n, -1).when(a.n < b.n, 1).when(a.l < b.l, -1).when(a.l > b.l, 1).otherwise(0))
    return per.groupBy("repo", "module").agg(
        F.sum("files").cast("long").alias("file_count"), F.sum("definitions").cast("long").alias("definition_count"), F.get(best, F.lit(0))["l"].alias("language")
    ).withColumn("depth", F.size(F.split("module", "/")))


def nodes(links: Links) -> DataFrame:
    """id, label, repo, name, depth of all nodes: repositories, modules, files, symbols, packages and routes. Packages and
    routes lie in a synthetic module each."""
    f = links.files
    none = F.lit(None).cast("int")
    pack, way = packages(links).select("repo", "id", "name").distinct(), routes(f).select("repo", "id", "route").distinct()
    synthetic = pack.select("repo", F.lit(EXTERNAL).alias("m")).unionByName(way.select("repo", F.lit(ROUTES).alias("m"))).distinct()
    parts = [
        f.select("repo").distinct().select(F.col("repo").alias("id"), F.lit("Repository").alias("label"), "repo", F.col("repo").alias("name"), F.lit(0).alias("depth")),
        f.select("repo", F.explode(ancestry(owning_module(F.col("path")))).alias("m")).distinct().select(node_id(F.col("repo"), F.col("m")).alias("id"), F.lit("Module").alias("label"), "repo", F.col("m").alias("name"), F.size(F.split("m", "/")).alias("depth")),
        synthetic.select(node_id(F.col("repo"), F.col("m")).alias("id"), F.lit("Module").alias("label"), "repo", F.col("m").alias("name"), F.lit(1).alias("depth")),
        f.select(node_id(F.col("repo"), F.col("path")).alias("id"), F.lit("File").alias("label"), "repo", F.substring_index("path", "/", -1).alias("name"), none.alias("depth")),
        symbols(f).select("id", F.lit("Symbol").alias("label"), "repo", "name", none.alias("depth")),
        pack.select("id", F.lit("Package").alias("label"), "repo", "name", none.alias("depth")),
        way.select("id", F.lit("Route").alias("label"), "repo", F.col("route").alias("name"), none.alias("depth")),
    ]
    return reduce(DataFrame.unionByName, parts)


def file_imports(links: Links) -> DataFrame:
    """repo, path, target, count, names, lines: imports of other files, merged by importer and target."""
    r = links.imports.filter("target IS NOT NULL AND target <> path")
    return r.groupBy("repo", "path", "target").agg(
        F.count(F.lit(1)).alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("names", F.array().cast("array<string>")))))).alias("names"), F.sort_array(F.collect_list("line")).alias("lines")
    )


def packages(links: Links) -> DataFrame:
    """repo, path, id, ecosystem, name, names, count of every package that a file uses; names is the sorted union of what it
    imports. What is only passed on isn't used."""
    r = links.imports.filter("package IS NOT NULL AND package <> '' AND NOT coalesce(is_reexport, false)").join(links.files.select("repo", "path", "language"), ["repo", "path"])
    return r.groupBy("repo", "path", ecosystem(F.col("language")).alias("ecosystem"), F.col("package").alias("name")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("names", F.array().cast("array<string>")))))).alias("names"), F.count(F.lit(1)).alias("count")
    ).withColumn("id", package_id(F.col("repo"), F.col("ecosystem"), F.col("name")))


def routes(files: DataFrame) -> DataFrame:
    """repo, path, id, method, route, handler, line of every declared route; the path is normalised."""
    r = files.select("repo", "path", F.posexplode("routes").alias("ord", "r")).select("repo", "path", "ord", F.upper("r.method").alias("method"), route_path(F.col("r.path")).alias("route"), "r.handler", "r.line")
    return r.withColumn("id", route_id(F.col("repo"), F.col("method"), F.col("route")))


def matched_requests(files: DataFrame) -> DataFrame:
    """repo, path, line, method, called, route: each request with the route that serves it, or null.

    An exact route wins; else the first declared one of the same method and number of segments in which * stands for one
    segment. Candidates are joined by repository, method and number of segments, never by all pairs.
    """
    c = files.select("repo", "path", F.posexplode("http_calls").alias("ord", "c")).select("repo", "path", "ord", F.upper("c.method").alias("method"), route_path(F.col("c.path")).alias("called"), "c.line", "c.caller")
    parts = lambda x: F.split(x, "/")
    c = c.withColumn("segments", F.size(parts(F.col("called"))))
    declared = routes(files).groupBy("repo", "method", "route").agg(F.min(F.struct("path", "ord")).alias("first")).withColumn("segments", F.size(parts(F.col("route"))))
    fits = F.forall(F.zip_with(parts(F.col("route")), parts(F.col("called")), lambda r, a: (r == "*") | (r == a)), lambda x: x)
    hit = c.select("repo", "path", "ord", "method", "called", "segments").join(declared, ["repo", "method", "segments"]).filter(fits)
    best = hit.groupBy("repo", "path", "ord").agg(F.min_by("route", F.struct((F.col("route") != F.col("called")).alias("inexact"), F.col("first").alias("first"), F.col("route").alias("r"))).alias("route"))
    return c.join(best, ["repo", "path", "ord"], "left").select("repo", "path", "line", "method", "called", "caller", "route")


def name_table(files: DataFrame) -> DataFrame:
    """repo, path, name, id: one definition per simple name of a file."""
    return linking.name_table(files).select("repo", "path", "name", symbol_id(F.col("repo"), F.col("path"), F.col("qualified"), F.lit(1)).alias("id"))


def _symbol(path: str, name: str) -> Column:
    return symbol_id(F.col("repo"), F.col(path), F.col(name), F.lit(1))


def references(links: Links) -> DataFrame:
    """repo, path, in_file, source, target, type, count, lines: calls, renders and inheritance, merged by both ends.

    source is the enclosing definition, else the file; target the definition meant, in this file or another.
    """
    first = symbols(links.files).filter("ordinal = 1").select("repo", "path", F.col("qualified_name").alias("enclosing"), F.col("id").alias("caller"))
    r = linking.merged_references(links.bound).join(first, ["repo", "path", "enclosing"], "left")
    source = F.coalesce("caller", node_id(F.col("repo"), F.col("path")))
    merged = r.groupBy("repo", "path", "in_file", source.alias("source"), _symbol("in_file", "qualified").alias("target"), F.col("kind").alias("type"))
    return merged.agg(F.sum("count").cast("long").alias("count"), F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))


def http_edges(files: DataFrame) -> DataFrame:
    """source, target, type, repo, count: from handlers to their routes (HANDLES) and from callers to the routes that serve
    them (REQUESTS); of an end without a definition the file stands for it."""
    first = symbols(files).filter("ordinal = 1").select("repo", "path", F.col("qualified_name").alias("who"), F.col("id").alias("known"))
    file = node_id(F.col("repo"), F.col("path"))
    handles = routes(files).withColumn("who", F.col("handler")).join(first, ["repo", "path", "who"], "left").select(F.coalesce("known", file).alias("source"), F.col("id").alias("target"), F.lit("HANDLES").alias("type"), "repo")
    asked = matched_requests(files).filter("route IS NOT NULL").withColumn("who", F.col("caller")).join(first, ["repo", "path", "who"], "left")
    requests = asked.select(F.coalesce("known", file).alias("source"), route_id(F.col("repo"), F.col("method"), F.col("route")).alias("target"), F.lit("REQUESTS").alias("type"), "repo")
    return handles.unionByName(requests).groupBy("source", "target", "type", "repo").agg(F.count(F.lit(1)).alias("count"))


def edges(links: Links) -> DataFrame:
    """source, target, type, repo, count of all edges, summaries between outermost folders too. The key is source, type and
    target."""
    files, one = links.files, F.lit(1).cast("long")
    above = F.coalesce(F.when(owning_module(F.col("path")).isNotNull(), node_id(F.col("repo"), owning_module(F.col("path")))), F.col("repo"))
    m = files.select("repo", F.explode(ancestry(owning_module(F.col("path")))).alias("m")).distinct()
    up = F.when(F.contains("m", F.lit("/")), node_id(F.col("repo"), F.regexp_replace("m", "/[^/]*$", ""))).otherwise(F.col("repo"))
    s = symbols(files)
    own = s.filter("ordinal = 1").select("repo", "path", F.col("qualified_name").alias("parent"), F.col("id").alias("__parent"))
    members = s.join(own, ["repo", "path", "parent"], "left")
    pack = packages(links)
    inside = lambda df, m: df.select("repo", "id").distinct().select(node_id(F.col("repo"), F.lit(m)).alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"), "repo", one.alias("count"))
    roots = lambda df, m: df.select("repo").distinct().select(F.col("repo").alias("source"), node_id(F.col("repo"), F.lit(m)).alias("target"), F.lit("CONTAINS").alias("type"), "repo", one.alias("count"))
    depends, external = module_dependencies(links), external_use(links)
    parts = [
        m.select(up.alias("source"), node_id(F.col("repo"), F.col("m")).alias("target"), F.lit("CONTAINS").alias("type"), "repo", one.alias("count")),
        files.select(above.alias("source"), node_id(F.col("repo"), F.col("path")).alias("target"), F.lit("CONTAINS").alias("type"), "repo", one.alias("count")),
        inside(pack, EXTERNAL), roots(pack, EXTERNAL), inside(routes(files), ROUTES), roots(routes(files), ROUTES),
        members.select(F.coalesce("__parent", node_id(F.col("repo"), F.col("path"))).alias("source"), F.col("id").alias("target"), F.when(F.col("__parent").isNull(), "DEFINES").otherwise("HAS_MEMBER").alias("type"), "repo", one.alias("count")),
        file_imports(links).select(node_id(F.col("repo"), F.col("path")).alias("source"), node_id(F.col("repo"), F.col("target")).alias("target"), F.lit("IMPORTS").alias("type"), "repo", "count"),
        pack.select(node_id(F.col("repo"), F.col("path")).alias("source"), F.col("id").alias("target"), F.lit("USES_PACKAGE").alias("type"), "repo", "count"),
        references(links).select("source", "target", "type", "repo", "count"),
        http_edges(files).select("source", "target", "type", "repo", "count"),
        depends.select(node_id(F.col("repo"), F.col("source")).alias("source"), node_id(F.col("repo"), F.col("target")).alias("target"), F.lit("DEPENDS_ON").alias("type"), "repo", F.col("weight").alias("count")),
        external.select(node_id(F.col("repo"), F.col("module")).alias("source"), node_id(F.col("repo"), F.lit(EXTERNAL)).alias("target"), F.lit("USES_EXTERNAL").alias("type"), "repo", F.col("weight").alias("count")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "target", "type", "repo").agg(F.max("count").alias("count"))


def module_dependencies(links: Links) -> DataFrame:
    """repo, source, target, weight: imports between outermost folders, those within one left out."""
    r = links.imports.filter("target IS NOT NULL")
    return r.select("repo", outer_module(F.col("path")).alias("source"), outer_module(F.col("target")).alias("target")).filter("source <> target").groupBy("repo", "source", "target").agg(F.count(F.lit(1)).alias("weight"))


def external_use(links: Links) -> DataFrame:
    """repo, module, weight: how many uses of a package by a file an outermost folder holds."""
    return packages(links).select("repo", outer_module(F.col("path")).alias("module"), "name").filter("module IS NOT NULL").groupBy("repo", "module").agg(F.count(F.lit(1)).alias("weight"))


def file_rank(links: Links) -> DataFrame:
    """repo, path, rank, names: what other files import of and refer to in a file, and half of what it does; and its most
    used exported names, KEY_NAMES at most, in the order of use, then of definition."""
    i = links.imports.filter("target IS NOT NULL AND target <> path").select("repo", "path", "target")
    r = linking.merged_references(links.bound).filter("in_file <> path")
    ends = i.unionByName(r.select("repo", "path", F.col("in_file").alias("target")))
    into = ends.select("repo", F.col("target").alias("path"), F.lit(1.0).alias("r"))
    rank = into.unionByName(ends.select("repo", "path", F.lit(OUTWARD).alias("r"))).groupBy("repo", "path").agg(F.sum("r").alias("rank"))
    used = r.groupBy("repo", F.col("in_file").alias("path"), F.col("qualified").alias("name")).agg(F.sum("count").alias("n"))
    d = links.files.select("repo", "path", F.posexplode("definitions").alias("pos", "d")).filter("d.parent IS NULL").select("repo", "path", "pos", "d.name", F.coalesce("d.exported", F.lit(False)).alias("exported"))
    d = d.withColumn("any", F.max("exported").over(Window.partitionBy("repo", "path"))).filter("exported OR NOT any").groupBy("repo", "path", "name").agg(F.min("pos").alias("pos"))
    d = d.join(used, ["repo", "path", "name"], "left")
    names = d.groupBy("repo", "path").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "pos", "name"))), lambda x: x["name"]), 1, KEY_NAMES).alias("names"))
    none = F.array().cast("array<string>")
    return links.files.select("repo", "path").join(rank, ["repo", "path"], "left").join(names, ["repo", "path"], "left").select("repo", "path", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("names", none).alias("names"))


def degrees(edge: DataFrame, kinds: list[str]) -> DataFrame:
    """id, degree: how many edges of these kinds touch a node, in either direction."""
    e = edge.filter(F.col("type").isin(kinds))
    return e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def top_children(edge: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """parent, id, degree, rank: the k children of each container that have most edges of these kinds, then by id."""
    children = edge.filter(F.col("type").isin(CONTAINMENT)).select(F.col("source").alias("parent"), F.col("target").alias("id"))
    ranked = children.join(degrees(edge, kinds), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    w = Window.partitionBy("parent").orderBy(F.desc("degree"), "id")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def followed(edge: DataFrame, origins: DataFrame, per_node: int, kinds: list[str]) -> DataFrame:
    """source, target, type, count, rank: the per_node heaviest outgoing edges of each origin, so that a busy one can't
    crowd out the others."""
    e = edge.filter(F.col("type").isin(kinds)).join(origins.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    w = Window.partitionBy("source").orderBy(F.desc(F.coalesce("count", F.lit(1))), "target", "type")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_node)


def neighbourhood(edge: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """start, id, depth: all nodes within `depth` steps of each start, at their least distance, the start itself left out.

    depth is at most 3: a few joins of a growing frontier, each reduced to distinct nodes before the next.
    """
    if depth not in (1, 2, 3):
        raise ValueError("depth must be 1, 2 or 3")
    out = edge.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edge.select(F.col("target").alias("a"), F.col("source").alias("b"))
    step = {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.select("start", F.col("id").alias("a")).join(step, "a").select("start", F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def subtree(edge: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """root, id, parent, depth: containment below each root, level by level; a node's parent is the smallest of several."""
    c = edge.filter(F.col("type").isin(CONTAINMENT)).select(F.col("source").alias("p"), F.col("target").alias("c"))
    seen = roots.select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, levels + 1):
        below = frontier.select("root", F.col("id").alias("p")).join(c, "p").groupBy("root", "c").agg(F.min("p").alias("parent"))
        frontier = below.select("root", F.col("c").alias("id"), "parent", F.lit(d).alias("depth")).join(seen.select("root", "id"), ["root", "id"], "left_anti")
        seen = seen.unionByName(frontier)
    return seen


def rolled_up(edge: DataFrame, visible: DataFrame, kinds: list[str]) -> DataFrame:
    """source, target, type, weight, collapsed: edges drawn between the nearest visible containers of their ends.

    Ends are followed up by the id alone: symbol, file, folders, repository. Ends without a visible container and edges
    within one node are dropped; a missing weight counts as 1. collapsed tells whether any end was moved. The sum of
    weights doesn't depend on which containers are open, but for edges that come to lie within one.
    """
    e = edge.filter(F.col("type").isin(kinds)).select("source", "target", "type", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("w"))
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    shown = visible.select(F.col("id").alias("step")).distinct()
    steps = ends.select("id", F.posexplode(_chain(F.col("id"))).alias("k", "step")).join(shown, "step")
    placed = steps.groupBy("id").agg(F.min_by("step", "k").alias("at"))
    a, b = placed.select(F.col("id").alias("source"), F.col("at").alias("from")), placed.select(F.col("id").alias("target"), F.col("at").alias("to"))
    moved = (F.col("source") != F.col("from")) | (F.col("target") != F.col("to"))
    return e.join(a, "source").join(b, "target").filter("from <> to").groupBy("from", "to", "type").agg(F.sum("w").cast("long").alias("weight"), F.max(moved).alias("collapsed")).select(
        F.col("from").alias("source"), F.col("to").alias("target"), "type", "weight", "collapsed"
    )


def _chain(node: Column) -> Column:
    """A node and its containers by id arithmetic, nearest first: repo:a/b/c.py#x, repo:a/b/c.py, repo:a/b, repo:a, repo."""
    repo = F.substring_index(node, ":", 1)
    rest = F.substring(node, F.length(repo) + 2, F.length(node))
    path = F.substring_index(rest, "#", 1)
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.concat(repo, F.lit(":"), F.array_join(F.slice(parts, 1, n), "/")))
    inner = F.when(F.contains(rest, F.lit("#")), F.concat(F.array(node), ups)).otherwise(ups)
    return F.when(F.contains(node, F.lit(":")), F.concat(inner, F.array(repo))).otherwise(F.array(node))
