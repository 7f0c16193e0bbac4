"""Trees kept by parent pointers: ancestors, groups, and moves of whole subtrees. Containers are walked by joins that double
their reach, never row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialised

#: Levels of a tree that are followed; what lies deeper, or in a loop, hangs at the top.
DEEPEST = 200


def ancestors(nodes: DataFrame, id_: str = "id", parent: str = "parent") -> DataFrame:
    """id, ancestors: of each node the ids above it, outermost first. A parent that isn't among the nodes is none; a node in
    a loop, or below one, has no ancestors. Each round doubles the reach, so depth costs its logarithm."""
    known = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("parent")).filter("id IS NOT NULL")
    there = known.select(F.col("id").alias("parent")).distinct().withColumn("real", F.lit(1))
    at = known.join(there, "parent", "left").select("id", F.when(F.col("real") == 1, F.array("parent")).otherwise(F.array().cast("array<string>")).alias("up"), F.when(F.col("real") == 1, F.col("parent")).alias("top"))
    at = materialised(at)
    reach = 1
    while reach < DEEPEST and not at.filter("top IS NOT NULL").isEmpty():
        other = at.select(F.col("id").alias("top"), F.col("up").alias("more"), F.col("top").alias("next"))
        at = materialised(at.join(other, "top", "left").select("id", F.concat("up", F.coalesce("more", F.array().cast("array<string>"))).alias("up"), F.col("next").alias("top")))
        reach *= 2
    return at.select("id", F.when(F.col("top").isNull(), F.reverse("up")).otherwise(F.array().cast("array<string>")).alias("ancestors"))


def groups_of_gone(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """id, group: of every gone node the outermost gone one at or above it. tree: id, ancestors. gone: id."""
    lost = tree.join(gone.select("id").distinct(), "id", "left_semi")
    steps = lost.select("id", F.posexplode(F.concat("ancestors", F.array("id"))).alias("k", "step"))
    return steps.join(gone.select(F.col("id").alias("step")).distinct(), "step").groupBy("id").agg(F.min_by("step", "k").alias("group"))


def rebased(tree: DataFrame, moved: str, new_above: list[str]) -> DataFrame:
    """tree with the subtree of `moved` under another place: what lies above it is exchanged in all its ancestors."""
    own = F.array_position("ancestors", moved)
    above = F.array(*[F.lit(x) for x in new_above]) if new_above else F.array().cast("array<string>")
    inside = F.concat(above, F.slice("ancestors", own.cast("int"), F.size("ancestors")))
    return tree.withColumn("ancestors", F.when(F.col("id") == moved, above).when(own > 0, inside).otherwise(F.col("ancestors")))


def titled(tree: DataFrame, titles: DataFrame) -> DataFrame:
    """id, crumbs: the titles of each node's ancestors, outermost first; those that have none are left out. titles: id, title."""
    steps = tree.select("id", F.posexplode("ancestors").alias("k", "step"))
    hit = steps.join(titles.select(F.col("id").alias("step"), "title"), "step").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]).alias("crumbs"))
    return tree.select("id").join(hit, "id", "left").select("id", F.coalesce("crumbs", F.array().cast("array<string>")).alias("crumbs"))


def first_steps(moves: DataFrame, most: int = 16) -> DataFrame:
    """scope, start, goal, first, steps: the first step of the shortest way from each place to each other one.

    moves: scope, a, b, pos (the order of b among the places; of equally short ways the first by it counts). Ways of up to
    `most` steps; a frontier holds one way per pair of places."""
    step = materialised(moves.select("scope", F.col("a").alias("at"), F.col("b").alias("to"), "pos").distinct())
    seen = materialised(step.groupBy("scope", F.col("at").alias("start"), F.col("to").alias("goal")).agg(F.min_by(F.array("pos"), "pos").alias("way")).filter("start <> goal").withColumn("first", F.col("goal")).withColumn("steps", F.lit(1)))
    front = seen
    for n in range(2, most + 1):
        on = front.select("scope", "start", F.col("goal").alias("at"), "way", "first").join(step, ["scope", "at"]).filter("to <> start")
        on = on.groupBy("scope", "start", F.col("to").alias("goal")).agg(F.min(F.struct(F.array_append("way", F.col("pos")).alias("way"), "first")).alias("w"))
        front = materialised(on.join(seen.select("scope", "start", "goal"), ["scope", "start", "goal"], "left_anti").select("scope", "start", "goal", "w.way", "w.first", F.lit(n).alias("steps")))
        if front.isEmpty():
            break
        seen = materialised(seen.unionByName(front))
    return seen.select("scope", "start", "goal", "first", "steps")
