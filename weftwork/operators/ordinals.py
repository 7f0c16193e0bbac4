"""Dense persistent ordinals for keys."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftwork.session import materialised

#: Hash buckets for numbering. The offset table has one row per bucket, so it is bounded whatever the data.
BUCKETS = 4096


def numbered_keys(keys: DataFrame, columns: list[str], start: int = 0, *, buckets: int = BUCKETS, name: str = "ordinal") -> DataFrame:
    """keys, one row each, with dense ordinals from `start` that don't depend on the partitioning.

    Keys are spread over `buckets` by hash, numbered within their bucket, and shifted by the sizes of the buckets before it,
    so that no task sees more than its buckets and no running number crosses the whole table.
    """
    fresh = keys.withColumn("__b", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(*[F.col(c).asc_nulls_first() for c in columns]))
    ranked = materialised(fresh.withColumn("__r", rank))
    sizes = ranked.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__b", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__o"))
    return ranked.join(F.broadcast(offsets), "__b").withColumn(name, F.lit(start).cast("long") + F.coalesce("__o", F.lit(0)) + F.col("__r") - 1).drop("__b", "__r", "__o")


def extend_dictionary(keys: DataFrame, columns: list[str], known: DataFrame | None = None, *, buckets: int = BUCKETS, name: str = "ordinal") -> DataFrame:
    """keys with the old ordinal of every key of `known`, and a new one, dense from the largest known on, for the others.

    keys has one row per key; its other columns stay. Nulls are keys like any others. An empty table gives no rows.
    """
    if known is None:
        return numbered_keys(keys, columns, buckets=buckets, name=name)
    old = known.select(*[F.col(c).alias(f"__{c}") for c in columns], F.col(name))
    same = None
    for c in columns:
        e = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = e if same is None else same & e
    had = keys.join(old, same).select(*keys.columns, F.col(name).cast("long").alias(name))
    start = known.agg(F.coalesce(F.max(name) + 1, F.lit(0))).first()[0]
    fresh = numbered_keys(keys.join(old, same, "left_anti"), columns, start, buckets=buckets, name=name)
    return had.unionByName(fresh)


def segments(spark: SparkSession, store: str) -> list[str]:
    """The finished segments of a stored dictionary, in the order of writing."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stored_dictionary(keys: DataFrame, columns: list[str], store: str, *, name: str = "ordinal") -> DataFrame:
    """keys with ordinals from the dictionary in the folder `store`, which new keys are added to as one more segment.

    Segments are never rewritten; one that wasn't finished is ignored. One delivery at a time may extend a dictionary.
    """
    spark = keys.sparkSession
    had = segments(spark, store)
    known = spark.read.parquet(*had) if had else None
    found = extend_dictionary(keys, columns, known, name=name)
    start = known.agg(F.coalesce(F.max(name) + 1, F.lit(0))).first()[0] if had else 0
    found.filter(F.col(name) >= start).select(*columns, name).write.parquet(f"{store}/{len(had):06d}-{uuid.uuid4().hex}")
    return found
