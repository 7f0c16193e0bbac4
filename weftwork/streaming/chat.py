"""Message streams: upserts and deletions by key, repeated deliveries, sessions, and readiness by quiet time."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftwork.operators.incremental import newest
from weftwork.session import shared_folder

# A run's longest gap, the quiet after which it's read, how long the first unread one may wait (seconds), and
# what a discussion has at least.
GAP_S, QUIET_S, LONGEST_S = 600, 900, 7200
LEAST_MESSAGES = 3


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder or file of Parquet as a stream, with the schema it has now."""
    schema = spark.read.parquet(path).schema
    source = str(Path(path).parent) if Path(path).is_file() else path
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", Path(path).name) if Path(path).is_file() else r).parquet(source)


def posted(stream: DataFrame) -> DataFrame:
    """Messages that a person posted: with a user and a text that isn't blank."""
    return stream.filter(F.col("user").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S"))


def without_repeats(stream: DataFrame, key: list[str], at: str, delay: str = "30 days") -> DataFrame:
    """Each delivery once; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def upsert_batches(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str) -> int:
    """Keeps `target` in step with a stream of changes: every micro-batch adds one segment with the last change of each of
    its keys, so that what is written follows the changes and not the table. Writing a batch again replaces its segment, so
    a restart after a failure changes nothing. Runs until all input is read; the number of segments."""
    done = [0]

    def write(batch: DataFrame, n: int) -> None:
        newest(batch, key, [F.col(c).desc_nulls_last() for c in order]).write.mode("overwrite").parquet(f"{target}/segment={n}")
        done[0] += 1

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return done[0]


def stored(spark: SparkSession, target: str, key: list[str], order: list[str], schema) -> DataFrame:
    """The newest row of each key over all segments; an empty table if there are none."""
    if not Path(target.removeprefix("file:")).exists() and not _exists(spark, target):
        return spark.createDataFrame([], schema)
    return newest(spark.read.schema(schema).parquet(f"{target}/segment=*"), key, [F.col(c).desc_nulls_last() for c in order])


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def compacted(spark: SparkSession, target: str, key: list[str], order: list[str], schema) -> str:
    """One table of all segments, written beside them; its path. To be run now and then, so that readers open few files."""
    path = f"{target}-compact-{uuid.uuid4().hex}/segment=0"
    stored(spark, target, key, order, schema).write.parquet(path)
    return path.rsplit("/", 1)[0]


def upserted(spark: SparkSession, path: str, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key, kept by upsert_batches from a stream over `path`."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, path).select(*columns)
    upsert_batches(stream, key, order, f"{base}/table", f"{base}/state")
    return stored(spark, f"{base}/table", key, order, stream.schema)


def current_messages(changes: DataFrame, key: list[str], order: list[str], text: str = "text", received: str = "received_at") -> DataFrame:
    """What a stream of changes has come to: the last change of each key, those without a text taken away, with `first_at`,
    when the key was first received, whatever came later."""
    first = changes.groupBy(*key).agg(F.min(received).alias("first_at"))
    last = newest(changes, key, [F.col(c).desc_nulls_last() for c in order]).filter(F.col(text).isNotNull())
    on = None
    renamed = first.withColumnsRenamed({k: f"__{k}" for k in key})
    for k in key:
        e = last[k].eqNullSafe(renamed[f"__{k}"])
        on = e if on is None else on & e
    return last.join(renamed, on).drop(*[f"__{k}" for k in key])


def sessions(stream: DataFrame, key: list[str], at: str, gap_s: int = GAP_S, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a stream by gap: key, start, end, n. A session is emitted when the watermark has passed it; late rows
    within the delay still join theirs. Exactly gap_s apart is the same session."""
    w = F.session_window(at, f"{gap_s} seconds")
    return stream.withWatermark(at, delay).groupBy(*key, w).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")).select(*key, F.col("session_window.start").alias("start"), "last", "n")


def ended(spark: SparkSession, stream: DataFrame, at: str, end) -> DataFrame:
    """A stream with one more row, null but for its time, two days after `end`: the watermark passes all that came before,
    so that nothing stays open when the input ends. Its own key is null."""
    folder = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    row = spark.createDataFrame([(end + pd.Timedelta(days=2),)], f"`{at}` timestamp")
    row.select(*[F.col(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What an append-mode stream emits over all input there is, as a table kept in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Reading:
    """One conversation as its messages come: when it's to be read, and when it's settled without a read."""

    def __init__(self, first: int | None = None, last: int | None = None, n: int = 0, speaker: str | None = None, others: bool = False):
        self.first, self.last, self.n, self.speaker, self.others = first, last, n, speaker, others

    @property
    def discussion(self) -> bool:
        return self.n >= LEAST_MESSAGES and self.others

    def due(self, now: int) -> str | None:
        """'read' for a discussion that is quiet or has waited as long as it may, 'settled' for anything else that is quiet."""
        if self.last is None:
            return None
        quiet, waited = now - self.last >= QUIET_S * 10**6, now - self.first >= LONGEST_S * 10**6
        return "read" if self.discussion and (quiet or waited) else "settled" if quiet else None

    def hear(self, at: int, user: str | None) -> None:
        self.first, self.last, self.n = at if self.first is None else min(self.first, at), at if self.last is None else max(self.last, at), self.n + 1
        if user is not None:
            self.others = self.others or self.speaker is not None and user != self.speaker
            self.speaker = self.speaker if self.speaker is not None else user

    @property
    def state(self) -> tuple:
        return self.first, self.last, self.n, self.speaker, self.others


def readiness(stream: DataFrame, key: list[str], at: str, user: str) -> DataFrame:
    """key, what, first_at, last_at, n, others: conversations as they're due, by event time (Reading). A conversation that
    goes on is due again later; what was read isn't repeated.

    The state of a key is one small record (times, a count, the first speaker and whether there are others), whatever its
    size and however the input is cut into batches. Rows of one batch are taken in the order of time; late ones count with
    what is open.
    """
    out = ", ".join(f"`{k}` string" for k in key) + ", what string, first_at timestamp, last_at timestamp, n long, others boolean"
    columns = [*key, "what", "first_at", "last_at", "n", "others"]

    def step(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = Reading(*state.get) if state.exists else Reading()
        name = [None if x is None else str(x) for x in k]
        rows: list[list] = []

        def check(now: int) -> None:
            nonlocal r
            if (what := r.due(now)) is not None:
                rows.append([*name, what, pd.Timestamp(r.first, unit="us", tz="UTC"), pd.Timestamp(r.last, unit="us", tz="UTC"), r.n, r.others])
                r = Reading()

        if not state.hasTimedOut:
            whole = pd.concat(list(pdfs))
            times = (whole[at].astype("int64") // {"ns": 1000, "us": 1}.get(getattr(whole[at].dtype, "unit", "ns"), 1000)).tolist()
            for t, u in sorted(zip(times, whole[user].astype(object).where(whole[user].notna(), None).tolist()), key=lambda x: (x[0], x[1] or "")):
                check(t)
                r.hear(t, u)
        check(state.getCurrentWatermarkMs() * 1000)
        if r.last is None:
            if state.exists:
                state.remove()
        else:
            state.update(r.state)
            state.setTimeoutTimestamp(max(min(r.last // 1000 + QUIET_S * 1000, r.first // 1000 + LONGEST_S * 1000 if r.discussion else 1 << 60), state.getCurrentWatermarkMs()) + 1)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return stream.groupBy(*key).applyInPandasWithState(step, out, "first long, last long, n long, speaker string, others boolean", "append", GroupStateTimeout.EventTimeTimeout)
