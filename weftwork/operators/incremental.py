"""Keeping a table in step with another: upserts, sweeps, plans and merges, as new DataFrames of the whole table.

Keys are compared null-safe. Inputs with repeated keys must be reduced first (newest); every function says what wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order`. The filter on the rank is pushed into the sort as a group limit."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = e if on is None else on & e
    return renamed, on


def missing_from(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table lacks (a sweep deletes them)."""
    renamed, on = _on(rows, other.select(*keys).distinct(), keys)
    return rows.join(renamed, on, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """stored with incoming rows put over it by key. Columns in `keep` are set at insertion only: stored values stay."""
    if keep:
        renamed, on = _on(incoming, stored.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__had")), keys)
        merged = incoming.join(renamed, on, "left")
        incoming = merged.select(*[F.when(F.col("__had"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in incoming.columns])
    return missing_from(stored, incoming, keys).unionByName(incoming)


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the incoming rows whose key it lacks."""
    return stored.unionByName(missing_from(incoming, stored, keys))


def versioned_write(stored: DataFrame, changes: DataFrame, key: str, version: str = "version", base: str = "base_version") -> DataFrame:
    """stored with changes applied where the stored version equals the change's base; the version then grows by one."""
    fields = [c for c in changes.columns if c not in (key, base)]
    c = changes.select(F.col(key).alias("__k"), F.col(base).alias("__b"), *[F.col(f).alias(f"__{f}") for f in fields])
    hit = F.col("__b").isNotNull()
    return stored.join(c, (F.col(key) == F.col("__k")) & (F.col(version) == F.col("__b")), "left").select(
        *[F.when(hit, F.col(f"__{f}")).otherwise(F.col(f)).alias(f) if f in fields else (F.col(version) + hit.cast("int")).alias(version) if f == version else F.col(f) for f in stored.columns]
    )


def sync_plan(found: DataFrame, stored: DataFrame, keys: list[str], hash_column: str) -> DataFrame:
    """keys and action: 'extract' (new, changed, or no hash), 'unchanged', 'deleted'."""
    f = found.select(*[F.col(k).alias(f"f_{k}") for k in keys], F.col(hash_column).alias("f_hash"), F.lit(True).alias("f_is"))
    s = stored.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col(hash_column).alias("s_hash"), F.lit(True).alias("s_is"))
    on = None
    for k in keys:
        e = F.col(f"f_{k}") == F.col(f"s_{k}")
        on = e if on is None else on & e
    action = F.when(F.col("f_is").isNull(), "deleted").when(F.col("f_hash") == F.col("s_hash"), "unchanged").otherwise("extract")
    return f.join(s, on, "full_outer").select(*[F.coalesce(f"f_{k}", f"s_{k}").alias(k) for k in keys], action.alias("action"))


def numbered(rows: DataFrame, scope: list[str], order: list[str], base: Column | int = 0) -> DataFrame:
    """rows with `number`, going on from `base` within each scope."""
    return rows.withColumn("number", (F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) + base).cast("long"))
