"""Queries whose results come from streams that are read to their end, and the SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.streaming import chat
from weftwork.tables import table

MESSAGE = ["workspace_id", "channel", "ts"]


def sm1_stream_upsert(spark, folder):
    """The newest delivery of each message, kept up by micro-batches (SM1)."""
    t = chat.upserted(spark, f"{folder}/decisions.parquet", MESSAGE, ["received_at", "row_id"], [*MESSAGE, "user", "row_id", "received_at"])
    return t.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").cast("long").alias("rows"))


def sm2_current_messages(spark, folder):
    """Messages as the stream has left them: the newest text, those taken back gone, the first time of receipt kept (SM2,
    SM9, SC13): per channel, how many, how many a person posted, and the sum of the first receipts."""
    changes = chat.finished(chat.read_stream(spark, f"{folder}/decisions.parquet").select(*MESSAGE, "user", "text", "row_id", "received_at"), "changes")
    m = chat.current_messages(changes, MESSAGE, ["received_at", "row_id"])
    people = chat.posted(m).groupBy("workspace_id", "channel").agg(F.count(F.lit(1)).alias("posted"))
    n = m.groupBy("workspace_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.min("first_at").cast("string").alias("first_at"))
    return n.join(people, ["workspace_id", "channel"], "left").select("workspace_id", "channel", "n", "first_at", F.coalesce("posted", F.lit(0)).alias("posted"))


def sm5_stream_sessions(spark, folder):
    """Sessions of each member's events by a gap of ten minutes, as a stream emits them (SM5); the input's end closes all."""
    e = chat.read_stream(spark, f"{folder}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").cast("string").alias("user_id"))
    end = table(spark, folder, "events").agg(F.max("ts")).first()[0]
    if end is None:
        return spark.createDataFrame([], "user_id string, sessions long, events long, longest long")
    s = chat.finished(chat.sessions(chat.ended(spark, e, "at", end), ["user_id"], "at"), "sessions").filter("user_id IS NOT NULL")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").cast("long").alias("events"), F.max("n").cast("long").alias("longest"))


def sm17_first_deliveries(spark, folder):
    """Each event once, however often it is delivered (SC14, SM17): the stream is read twice over and gives every id once."""
    one = chat.read_stream(spark, f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    s = chat.finished(chat.without_repeats(one.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"], "at", "40 days"), "deliveries")
    return s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def sm6_stream_ready(spark, folder):
    """Channels' messages as they are due: a discussion that is quiet or has waited long is read, anything else that is quiet
    is settled (SM6, SM7, AG21)."""
    at = (F.col("ts").cast("double")).cast("timestamp")
    e = chat.read_stream(spark, f"{folder}/decisions.parquet").filter(F.col("ts").rlike(r"^\s*\d+(\.\d*)?\s*$")).select(at.alias("at"), "workspace_id", "channel", "user")
    end = table(spark, folder, "decisions").filter(F.col("ts").rlike(r"^\s*\d+(\.\d*)?\s*$")).agg(F.max(at)).first()[0]
    if end is None:
        return spark.createDataFrame([], "workspace_id string, channel string, what string, times long, messages long, first_at string")
    s = chat.finished(chat.readiness(chat.ended(spark, e, "at", end).withWatermark("at", "10 minutes"), ["workspace_id", "channel"], "at", "user"), "ready").filter("workspace_id IS NOT NULL OR channel IS NOT NULL")
    return s.groupBy("workspace_id", "channel", "what").agg(F.count(F.lit(1)).alias("times"), F.sum("n").cast("long").alias("messages"), F.min("first_at").cast("string").alias("first_at"))


QUERIES = {f.__name__: f for f in (sm1_stream_upsert, sm2_current_messages, sm5_stream_sessions, sm17_first_deliveries, sm6_stream_ready)}

SQL = {
    "sm1_stream_upsert": "SELECT workspace_id, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS rows FROM (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY workspace_id, channel, ts ORDER BY received_at DESC NULLS LAST, row_id DESC) = 1) GROUP BY 1",
    "sm2_current_messages": r"""WITH l AS (SELECT workspace_id, channel, ts, "user" AS u, text, min(received_at) OVER (PARTITION BY workspace_id, channel, ts) AS f, row_number() OVER (PARTITION BY workspace_id, channel, ts ORDER BY received_at DESC NULLS LAST, row_id DESC) AS rn FROM decisions)
SELECT workspace_id, channel, count(*) AS n, CAST(min(f) AS VARCHAR) AS first_at, CAST(sum(CAST(u IS NOT NULL AND regexp_matches(text, '[^\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]') AS INT)) AS BIGINT) AS posted FROM l WHERE rn = 1 AND text IS NOT NULL GROUP BY 1, 2""",
    "sm5_stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 600000000 THEN 0 ELSE 1 END AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), z AS (SELECT user_id, k, count(*) AS n FROM r GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM z GROUP BY 1""",
    "sm17_first_deliveries": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
}
