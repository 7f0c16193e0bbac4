"""Usage totals and fixed-window limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.times import bucket, zone_day
from weftwork.operators.running import running_sums


def usage_totals(calls: DataFrame, actions: DataFrame, zone: str = "UTC") -> DataFrame:
    """level ('day', 'member', 'total'), key, actions, calls, cost over two fact tables, in one pass of grouping sets.

    calls: user_id, at, cost (null counts as 0). actions: user_id, at. A key that only one of them has gets zeros for the
    other. Rows with a null user or time count in the other groupings and in the total.
    """
    rows = calls.select("user_id", "at", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.lit(1).alias("call"), F.lit(0).alias("action")).unionByName(
        actions.select("user_id", "at", F.lit(0.0).alias("cost"), F.lit(0).alias("call"), F.lit(1).alias("action"))
    )
    rows = rows.select(zone_day(F.col("at"), zone).cast("string").alias("day"), F.col("user_id").cast("string").alias("member"), "cost", "call", "action")
    sets = rows.groupingSets([["day"], ["member"], []], "day", "member").agg(
        F.grouping("day").alias("gd"), F.grouping("member").alias("gm"),
        F.sum("action").cast("long").alias("actions"), F.sum("call").cast("long").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"),
    )
    level = F.when((F.col("gd") == 1) & (F.col("gm") == 1), "total").when(F.col("gd") == 0, "day").otherwise("member")
    return sets.select(level.alias("level"), F.coalesce("day", "member", F.lit("")).alias("key"), "actions", "calls", "cost")


def admitted(requests: DataFrame, subject: str, at: str, limit: int, seconds: int, tie: str) -> DataFrame:
    """requests with `bucket` and `admitted`: the first `limit` of each subject in each fixed window are let in."""
    m = requests.withColumn("bucket", bucket(F.col(at), seconds))
    w = Window.partitionBy(subject, "bucket").orderBy(at, tie)
    return m.withColumn("admitted", F.row_number().over(w) <= limit)


def admitted_everywhere(requests: DataFrame, subject: str, at: str, tie: str, windows: list[tuple[int, int]]) -> DataFrame:
    """requests (subject, at, tie) with `admitted`: let in only if every one of several windows (limit, seconds) has room;
    a request that is turned away counts in none.

    The rule depends on order, so requests are sorted within partitions by subject and read as a stream that keeps only
    the counters of the current subject; no group is collected.
    """
    rows = requests.select(F.col(subject).cast("string").alias("subject"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(tie).cast("long").alias("tie"))
    rows = rows.repartition("subject").sortWithinPartitions("subject", "us", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, [(-1, 0)] * len(windows)
        for b in batches:
            out = []
            for s, us in zip(b["subject"].to_pylist(), b["us"].to_pylist()):
                if s != current:
                    current, counts = s, [(-1, 0)] * len(windows)
                if us is None:
                    out.append(False)
                    continue
                now = [us // (sec * 1_000_000) for _, sec in windows]
                have = [n if k == i else 0 for (k, n), i in zip(counts, now)]
                ok = all(n < limit for n, (limit, _) in zip(have, windows))
                counts = [(i, n + ok) for i, n in zip(now, have)]
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b["subject"], b["us"], b["tie"], pa.array(out, pa.bool_())], names=["subject", "us", "tie", "admitted"])

    return rows.mapInArrow(run, "subject string, us long, tie long, admitted boolean")


def coalesced_runs(requests: DataFrame, subject: str, at: str, tie: str, seconds: int, most: int) -> DataFrame:
    """subject, us, tie, runs: how many runs each request has set off. A request to an idle subject starts a run of `seconds`;
    one during a run asks for one more after it, once, and of runs in a row there are `most`.

    Ordered like admitted_everywhere: a stream per partition that keeps the current subject's state only.
    """
    rows = requests.select(F.col(subject).cast("string").alias("subject"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(tie).cast("long").alias("tie")).filter("us IS NOT NULL")
    rows = rows.repartition("subject").sortWithinPartitions("subject", "us", "tie")
    long = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, busy, again, row = None, 0, False, 0
        for b in batches:
            out = []
            for s, us in zip(b["subject"].to_pylist(), b["us"].to_pylist()):
                if s != current:
                    current, busy, again, row = s, -1, False, 0
                if again and us >= busy:
                    busy, again, row = busy + long, False, row + 1
                if busy < 0 or us >= busy:
                    busy, again, row = us + long, False, 1
                    out.append(1)
                elif not again and row < most:
                    again = True
                    out.append(1)
                else:
                    out.append(0)
            yield pa.RecordBatch.from_arrays([b["subject"], b["us"], b["tie"], pa.array(out, pa.int64())], names=["subject", "us", "tie", "runs"])

    return rows.mapInArrow(run, "subject string, us long, tie long, runs long")


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the exact median of the values that aren't null, of groups of any size: values are counted first, and the
    counts summed up over split ranges, so no group is held in one place."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    up = running_sums(counted, keys, [F.col(value).asc()], {"__to": F.col("__n")})
    whole = counted.groupBy(*keys).agg(F.sum("__n").alias("__all")).withColumnsRenamed({k: f"__{k}" for k in keys})
    on = None
    for k in keys:
        e = up[k].eqNullSafe(whole[f"__{k}"])
        on = e if on is None else on & e
    j = up.join(whole, on)
    # the places of the middle values, from 1: one of them twice if there's a single one
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    at = lambda place: F.max(F.when((F.col("__to") - F.col("__n") < place) & (place <= F.col("__to")), F.col(value)))
    return j.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))


def wilson(hits: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share; 0 and 0 without cases."""
    p = hits / total
    centre = (p + z * z / (2 * total)) / (1 + z * z / total)
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    low, high = F.round(F.greatest(F.lit(0.0), centre - spread), 3), F.round(F.least(F.lit(1.0), centre + spread), 3)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)
