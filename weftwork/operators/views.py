"""A graph at a level of detail: which nodes are drawn, and how relationships fold onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.codegraph import CONTAINMENT, _chain, degrees
from weftwork.session import materialised

# Children of a container that are drawn before the rest go behind a marker, and edges of a view.
PAGE, MOST_EDGES = 12, 1200
RANK = {"Repository": 0, "Module": 0, "File": 1, "Symbol": 2, "Package": 3, "Route": 3}


def drawn(nodes: DataFrame, edges: DataFrame, opened: DataFrame, kinds: list[str], page: int = PAGE, revealed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, markers and stand-ins of a view.

    nodes: id, label, repo, name. opened: id of containers asked to be open; one counts only if all containers above it are
    open, repositories always are. Nodes drawn: id, parent, label, opened: the children of open containers; open ones all,
    of the others the first `page` by kind, degree and id, unless the container is in `revealed`. Markers: id, container,
    shown, hidden. Stand-ins: id of each child behind a marker, and the marker.
    """
    child = edges.filter(F.col("type").isin(CONTAINMENT)).select(F.col("source").alias("parent"), F.col("target").alias("id")).groupBy("id").agg(F.min("parent").alias("parent"))
    roots = nodes.filter("label = 'Repository'").select("id")
    asked = opened.select("id").distinct().unionByName(roots).distinct()
    # a container is open if it and all above it are asked for
    steps = asked.join(nodes.select("id"), "id", "left_semi").select("id", F.explode(_chain(F.col("id"))).alias("step"))
    ok = steps.join(asked.select(F.col("id").alias("step"), F.lit(1).alias("hit")), "step", "left").groupBy("id").agg(F.min(F.coalesce("hit", F.lit(0))).alias("all")).filter("all = 1").select("id")
    open_ = materialised(ok)
    kids = child.join(open_.select(F.col("id").alias("parent")), "parent", "left_semi").join(nodes.select("id", "label", "name"), "id")
    kids = kids.join(open_.withColumn("opened", F.lit(True)), "id", "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
    kids = kids.join(degrees(edges, kinds), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    group = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("label")) * 2 + F.col("name").isin("__external__", "__routes__").cast("int")
    place = F.row_number().over(Window.partitionBy("parent", "opened").orderBy(group, F.desc("degree"), "id"))
    kids = kids.withColumn("place", place)
    if revealed is not None:
        kids = kids.join(revealed.select(F.col("id").alias("parent"), F.lit(1).alias("whole")), "parent", "left")
    else:
        kids = kids.withColumn("whole", F.lit(None).cast("int"))
    kids = materialised(kids.withColumn("shown", F.col("opened") | F.col("whole").isNotNull() | (F.col("place") <= page)))
    seen = kids.filter("shown").select("id", "parent", "label", "opened").unionByName(roots.select("id", F.lit(None).cast("string").alias("parent"), F.lit("Repository").alias("label"), F.lit(True).alias("opened")))
    marker = F.concat("parent", F.lit("::more"))
    hidden = kids.filter("NOT shown").select("id", marker.alias("marker"))
    counts = kids.filter("NOT opened").groupBy("parent").agg(F.sum(F.col("shown").cast("long")).alias("shown"), F.sum((~F.col("shown")).cast("long")).alias("hidden")).filter("hidden > 0")
    return seen, counts.select(marker.alias("id"), F.col("parent").alias("container"), "shown", "hidden"), hidden


def containment(seen: DataFrame, markers: DataFrame) -> DataFrame:
    """parent, child: the lines of the tree between nodes that are both drawn."""
    ids = seen.select(F.col("id").alias("parent"))
    lines = seen.filter("parent IS NOT NULL").select("parent", F.col("id").alias("child")).unionByName(markers.select(F.col("container").alias("parent"), F.col("id").alias("child")))
    return lines.join(ids, "parent", "left_semi")


def view_edges(edges: DataFrame, seen: DataFrame, hidden: DataFrame, kinds: list[str]) -> DataFrame:
    """source, target, type, weight, collapsed: relationships between what is drawn. An end goes to itself or the nearest
    container or marker that is drawn; edges within one node, and those with an end under nothing, vanish."""
    e = edges.filter(F.col("type").isin(kinds)).select("source", "target", "type", F.greatest(F.coalesce("count", F.lit(1)), F.lit(1)).alias("w"))
    places = seen.select(F.col("id").alias("step"), F.col("id").alias("at")).unionByName(hidden.select(F.col("id").alias("step"), F.col("marker").alias("at")))
    synthetic = F.when(F.col("id").rlike("^[^:]*:pkg:"), F.concat(F.substring_index("id", ":", 1), F.lit(":__external__"))).when(F.col("id").rlike("^[^:]*:route:"), F.concat(F.substring_index("id", ":", 1), F.lit(":__routes__")))
    way = F.when(synthetic.isNotNull(), F.array(F.col("id"), synthetic, F.substring_index("id", ":", 1))).otherwise(_chain(F.col("id")))
    ends = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    placed = ends.select("id", F.posexplode(way).alias("k", "step")).join(places, "step").groupBy("id").agg(F.min_by("at", "k").alias("at"))
    a, b = placed.select(F.col("id").alias("source"), F.col("at").alias("from")), placed.select(F.col("id").alias("target"), F.col("at").alias("to"))
    moved = (F.col("source") != F.col("from")) | (F.col("target") != F.col("to"))
    return e.join(a, "source").join(b, "target").filter("from <> to").groupBy("from", "to", "type").agg(F.sum("w").cast("long").alias("weight"), F.max(moved).alias("collapsed")).select(F.col("from").alias("source"), F.col("to").alias("target"), "type", "weight", "collapsed")


def capped(edges: DataFrame, scope: str = "repo", most: int = MOST_EDGES) -> DataFrame:
    """The first `most` edges of each scope in the order of source, target and type, with `truncated` where there were more.
    The cap is what a view can draw; the rest is reported, not lost."""
    w = Window.partitionBy(scope)
    return edges.withColumns({"__n": F.count(F.lit(1)).over(w), "__k": F.row_number().over(w.orderBy("source", "target", "type"))}).filter(F.col("__k") <= most).withColumn("truncated", F.col("__n") > most).drop("__n", "__k")
