"""Running sums, numbers and neighbours within keys of any size.

Rows are split by ranges of (key, order), so that a key that holds a third of all rows lies on many partitions. Each
partition is summed alone; one row per key and partition carries the sums over the borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.session import materialised

_PART = "__part"


def _split(df: DataFrame, keys: list[str], order: list[Column], extra: dict[str, Column]) -> DataFrame:
    rows = df.withColumns(extra) if extra else df
    return materialised(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(_PART, F.spark_partition_id()))


def _joined(rows: DataFrame, parts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    other = parts.withColumnsRenamed({k: f"__{k}" for k in [*keys, _PART]})
    on = rows[_PART] == other[f"__{_PART}"]
    for k in keys:
        on = on & rows[k].eqNullSafe(other[f"__{k}"])
    return rows.join(other, on, how).drop(*[f"__{k}" for k in [*keys, _PART]])


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with a column per entry of `sums`: the sum of its values up to and with the row, within the row's key.

    `order` must be total within a key. A null key is a key; null values count as 0. An empty table stays empty.
    """
    rows = _split(df, keys, order, {f"__v_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    each = rows.groupBy(*keys, _PART).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = each.select(*keys, _PART, *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    here = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(here) for n in sums})
    out = _joined(rows, parts, keys).withColumns({n: F.col(f"__r_{n}") + F.col(f"__o_{n}") for n in sums})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """df with the place of each row in its key, from 1."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")})


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, before: str, after: str) -> DataFrame:
    """df with the values of the rows before and after in the order of the columns `order`, ascending; null at the ends.

    `value` and the order columns must not be null.
    """
    rows = _split(df, keys, [F.col(c) for c in order], {})
    at = F.struct(*order)
    ends = rows.groupBy(*keys, _PART).agg(F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last"))
    way = Window.partitionBy(*keys).orderBy(_PART)
    ends = ends.select(*keys, _PART, F.lag("__last").over(way).alias("__b"), F.lead("__first").over(way).alias("__a"))
    here = Window.partitionBy(*keys, _PART).orderBy(*order)
    rows = rows.withColumns({"__lag": F.lag(value).over(here), "__lead": F.lead(value).over(here)})
    return _joined(rows, ends, keys).select(*df.columns, F.coalesce("__lag", "__b").alias(before), F.coalesce("__lead", "__a").alias(after))
