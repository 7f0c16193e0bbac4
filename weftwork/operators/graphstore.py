"""Keeping a stored graph in step with the one built from the facts: what must be written, and writing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.incremental import missing_from

EDGE = ["source", "type", "target"]


def _changed(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key old lacks or holds with other values."""
    values = [c for c in new.columns if c not in key]
    o = old.select(*[F.col(k).alias(f"__{k}") for k in key], F.struct(*values).alias("__old"))
    on = None
    for k in key:
        e = new[k].eqNullSafe(o[f"__{k}"])
        on = e if on is None else on & e
    j = new.join(o, on, "left")
    return j.filter(~F.struct(*values).eqNullSafe(F.col("__old"))).select(*new.columns)


def diff(old_nodes: DataFrame, old_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes to write, edges to write, ids of nodes and keys of edges to delete. Nodes have the key id, edges EDGE."""
    return _changed(old_nodes, nodes, ["id"]), _changed(old_edges, edges, EDGE), missing_from(old_nodes, nodes, ["id"]).select("id"), missing_from(old_edges, edges, EDGE).select(*EDGE)


def written_nodes(stored: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The nodes after a write: those deleted gone, those written in place of what was there."""
    return missing_from(missing_from(stored, deletes, ["id"]), upserts, ["id"]).unionByName(upserts)


def written_edges(stored: DataFrame, nodes: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The edges after a write: keys deleted are gone, and so are edges of a node that is gone; of those written, the ones
    with an end that isn't there are left out."""
    ids = nodes.select("id").distinct()
    after = missing_from(missing_from(stored, deletes, EDGE), upserts, EDGE).unionByName(upserts)
    return after.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi").select(*stored.columns)


def existing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Which of the asked edges (keys) there are."""
    return asked.join(edges.select(*EDGE).distinct(), EDGE, "left_semi")


def without_repository(rows: DataFrame, repo: str) -> DataFrame:
    """All rows but those of one repository."""
    return rows.filter(~F.col("repo").eqNullSafe(F.lit(repo)))
