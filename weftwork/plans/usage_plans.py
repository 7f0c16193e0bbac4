"""Queries on usage, limits and chat, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions.times import bucket, next_month, zone_day
from weftwork.operators import usage as U
from weftwork.session import broadcast_if_small
from weftwork.tables import table

# Which kinds of events stand for model calls and for actions.
CALLS, ACTIONS = ("click", "view", "error"), ("purchase", "signup")


def _facts(spark, folder):
    e = table(spark, folder, "events")
    return (
        e.filter(F.col("event_type").isin(*CALLS)).select("user_id", F.col("ts").alias("at"), F.col("value").alias("cost")),
        e.filter(F.col("event_type").isin(*ACTIONS)).select("user_id", F.col("ts").alias("at")),
    )


def ag5_usage_totals(spark, folder):
    """Totals by day, by member and over all, from two fact tables in one pass (AG4, AG5, ST2, FN27)."""
    return U.usage_totals(*_facts(spark, folder))


def fn27_usage_by_local_day(spark, folder):
    """Calls per local day; an unknown zone is UTC (FN27)."""
    calls, _ = _facts(spark, folder)
    one = lambda z: calls.groupBy(zone_day(F.col("at"), z).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("zone", F.lit(z))
    return one("Asia/Karachi").unionByName(one("Not/AZone"))


def fn28_month_windows(spark, folder):
    """Actions per month, with the key of the window and the moment it ends (FN28, FN29)."""
    _, actions = _facts(spark, folder)
    t = F.col("at")
    return actions.groupBy(F.date_format(t, "yyyyMM").alias("month"), next_month(t).cast("date").cast("string").alias("ends")).agg(F.count(F.lit(1)).alias("n"))


def sm12_hourly_admission(spark, folder):
    """How many requests of a member are let in each hour, 3 at most (SM12, FN29)."""
    e = table(spark, folder, "events")
    return U.admitted(e, "user_id", "ts", 3, 3600, "event_id").groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("asked"), F.sum(F.col("admitted").cast("long")).alias("let_in"))


def sm13_window_stack(spark, folder):
    """Requests let in by hour, day and month at once; one turned away counts nowhere (SM13)."""
    e = table(spark, folder, "events")
    return U.admitted_everywhere(e, "user_id", "ts", "event_id", [(2, 3600), (4, 86400), (60, 30 * 86400)]).groupBy("subject").agg(F.count(F.lit(1)).alias("asked"), F.sum(F.col("admitted").cast("long")).alias("let_in"))


def ag25_type_shares(spark, folder):
    """The share of each kind of event with its 95 % interval, and the median value (AG25)."""
    e = table(spark, folder, "events")
    g = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("hits")).withColumn("total", F.sum("hits").over(Window.partitionBy()))  # a row per kind
    g = g.join(U.exact_medians(e, ["event_type"], "value", "m"), "event_type", "left").withColumn("median_value", F.round("m", 6))
    low, high = U.wilson(F.col("hits"), F.col("total"))
    return g.select("event_type", "hits", "median_value", low.alias("low"), high.alias("high"))


def wn13_newest_per_channel(spark, folder):
    """The 5 newest deliveries of each channel (WN13, SL14)."""
    d = table(spark, folder, "decisions")
    w = Window.partitionBy("workspace_id", "channel").orderBy(F.desc("received_at"), F.desc("row_id"))
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("workspace_id", "channel", "row_id", F.col("place").cast("int").alias("place"))


def wn8_latest_delivery(spark, folder):
    """Of a message delivered again, the last delivery counts (WN8, SM2)."""
    d = table(spark, folder, "decisions").filter("ts IS NOT NULL")
    w = Window.partitionBy("workspace_id", "channel", "ts").orderBy(F.desc("received_at"), F.desc("row_id"))
    return d.withColumn("rn", F.row_number().over(w)).filter("rn = 1").groupBy("workspace_id", "channel").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("text").isNull().cast("long")).alias("taken_back"), F.countDistinct("user").alias("people"))


def wn5_first_read_ref(spark, folder):
    """The first mark of having been read in each thread (WN5, SM4)."""
    d = table(spark, folder, "decisions").filter("thread_ts IS NOT NULL AND read_ref IS NOT NULL")
    return d.groupBy("workspace_id", "channel", "thread_ts").agg(F.min(F.struct("received_at", "row_id", "read_ref"))["read_ref"].alias("first_ref"), F.count(F.lit(1)).alias("n"))


def jn24_watched_channels(spark, folder):
    """Messages of the members' workspaces only, by kind of sender (JN24, JN33): semi-joins with small tables."""
    d, m = table(spark, folder, "decisions"), table(spark, folder, "members")
    known = m.select("workspace_id", F.col("user_id").alias("user")).distinct().withColumn("known", F.lit(True))
    live = d.join(broadcast_if_small(m.select("workspace_id").distinct()), "workspace_id", "left_semi")
    return live.join(broadcast_if_small(known), ["workspace_id", "user"], "left").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.coalesce("known", F.lit(False)).cast("long")).alias("by_members"))


def fn30_retry_after(spark, folder):
    """Seconds until each member's cooldown of one hour ends, as seen at the last event (FN30)."""
    e = table(spark, folder, "events")
    now = e.agg(F.max("ts")).first()[0]
    last = e.groupBy("user_id").agg(F.max("ts").alias("sent"))
    from weftwork.functions.times import retry_after

    return last.select("user_id", retry_after(F.col("sent"), F.lit(now), 3600).alias("seconds"))


def sm16_expired(spark, folder):
    """What a sweep with a retention of 3 days keeps and drops (SM3, SM16, PF20)."""
    d = table(spark, folder, "decisions")
    end = d.agg(F.max("received_at")).first()[0]
    gone = F.col("received_at") < F.lit(end) - F.expr("INTERVAL 3 DAYS")
    return d.groupBy("workspace_id").agg(F.sum(gone.cast("long")).alias("dropped"), F.sum((~gone).cast("long")).alias("kept"))


def sm18_coalesced(spark, folder):
    """Runs of a job of ten minutes that requests ask for: one that comes while a run is on waits for one more run, however
    many there are, three in a row at most (SM18): per member, requests and runs."""
    return U.coalesced_runs(table(spark, folder, "events"), "user_id", "ts", "event_id", 600, 3).groupBy("subject").agg(F.count(F.lit(1)).alias("requests"), F.sum("runs").cast("long").alias("runs"))


def jn32_pushes(spark, folder):
    """Repositories that a push to their main branch concerns, each once (JN32): events as pushes, every third to a branch."""
    e = table(spark, folder, "events").select((F.col("user_id") % 20).alias("no"), F.when(F.col("event_id") % 3 == 0, "refs/heads/main").otherwise(F.concat(F.lit("refs/heads/b"), (F.col("event_id") % 7).cast("string"))).alias("ref"))
    f = table(spark, folder, "facts_py").select("repo").distinct().select("repo", F.regexp_extract("repo", "([0-9]*)$", 1).alias("d")).filter("d <> ''").select("repo", F.col("d").cast("long").alias("no"), F.lit("refs/heads/main").alias("ref"))
    return e.join(broadcast_if_small(f), ["no", "ref"]).groupBy("repo").agg(F.count(F.lit(1)).alias("pushes"))


def st4_shared_kinds(spark, folder):
    """Kinds of events that every part of a month has: an intersection of sets (ST4)."""
    e = table(spark, folder, "events")
    part = lambda lo, hi: e.filter((F.dayofmonth("ts") >= lo) & (F.dayofmonth("ts") < hi)).select("event_type", (F.col("user_id") % 100).alias("group")).distinct()
    return part(1, 8).intersect(part(8, 15)).intersect(part(15, 32))


QUERIES = {f.__name__: f for f in (
    ag5_usage_totals, fn27_usage_by_local_day, fn28_month_windows, sm12_hourly_admission, sm13_window_stack, ag25_type_shares, wn13_newest_per_channel, wn8_latest_delivery, wn5_first_read_ref, jn24_watched_channels, fn30_retry_after, sm16_expired, sm18_coalesced, jn32_pushes, st4_shared_kinds,
)}

_C = "event_type IN ('click', 'view', 'error')"
_A = "event_type IN ('purchase', 'signup')"
SQL = {
    "ag5_usage_totals": f"""WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(user_id AS VARCHAR) AS member, CASE WHEN {_C} THEN coalesce(value, 0) ELSE 0 END AS cost, CAST({_C} AS INTEGER) AS c, CAST({_A} AS INTEGER) AS a FROM events WHERE {_C} OR {_A})
SELECT 'day' AS level, coalesce(day, '') AS key, CAST(sum(a) AS BIGINT) AS actions, CAST(sum(c) AS BIGINT) AS calls, round(sum(cost), 6) AS cost FROM r GROUP BY day
UNION ALL SELECT 'member', coalesce(member, ''), CAST(sum(a) AS BIGINT), CAST(sum(c) AS BIGINT), round(sum(cost), 6) FROM r GROUP BY member
UNION ALL SELECT 'total', '', CAST(sum(a) AS BIGINT), CAST(sum(c) AS BIGINT), round(sum(cost), 6) FROM r""",
    "fn27_usage_by_local_day": f"""SELECT CAST(CAST(ts + INTERVAL 5 HOURS AS DATE) AS VARCHAR) AS day, count(*) AS n, 'Asia/Karachi' AS zone FROM events WHERE {_C} GROUP BY 1
UNION ALL SELECT CAST(CAST(ts AS DATE) AS VARCHAR), count(*), 'Not/AZone' FROM events WHERE {_C} GROUP BY 1""",
    "fn28_month_windows": f"SELECT strftime(ts, '%Y%m') AS month, CAST(CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS ends, count(*) AS n FROM events WHERE {_A} GROUP BY 1, 2",
    "sm12_hourly_admission": """SELECT user_id, bucket, count(*) AS asked, CAST(sum(CASE WHEN rn <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS let_in FROM (
SELECT user_id, epoch_us(ts) // 3600000000 AS bucket, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2""",
    "sm13_window_stack": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, epoch_us(ts) // 86400000000 AS d, epoch_us(ts) // 2592000000000 AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, h, d, m, 1 AS nh, 1 AS nd, 1 AS nm, 1 AS ok FROM o WHERE k = 1
  UNION ALL SELECT user_id, k, h, d, m, ch + ok, cd + ok, cm + ok, ok FROM (SELECT *, CASE WHEN ch < 2 AND cd < 4 AND cm < 60 THEN 1 ELSE 0 END AS ok FROM (
    SELECT o.user_id, o.k, o.h, o.d, o.m, CASE WHEN o.h = r.h THEN nh ELSE 0 END AS ch, CASE WHEN o.d = r.d THEN nd ELSE 0 END AS cd, CASE WHEN o.m = r.m THEN nm ELSE 0 END AS cm FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS subject, count(*) AS asked, CAST(sum(ok) AS BIGINT) AS let_in FROM r GROUP BY 1""",
    "ag25_type_shares": """WITH g AS (SELECT event_type, count(*) AS h, round(median(value), 6) AS median_value FROM events GROUP BY 1), t AS (SELECT *, CAST(sum(h) OVER () AS DOUBLE) AS n FROM g),
x AS (SELECT *, (h / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS s FROM t)
SELECT event_type, h AS hits, median_value, round(greatest(0.0, c - s), 3) AS low, round(least(1.0, c + s), 3) AS high FROM x""",
    "wn13_newest_per_channel": "SELECT * FROM (SELECT workspace_id, channel, row_id, CAST(row_number() OVER (PARTITION BY workspace_id, channel ORDER BY received_at DESC, row_id DESC) AS INTEGER) AS place FROM decisions) WHERE place <= 5",
    "wn8_latest_delivery": """SELECT workspace_id, channel, count(*) AS messages, CAST(sum(CAST(text IS NULL AS INTEGER)) AS BIGINT) AS taken_back, count(DISTINCT "user") AS people FROM (
SELECT * FROM decisions WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace_id, channel, ts ORDER BY received_at DESC, row_id DESC) = 1) GROUP BY 1, 2""",
    "wn5_first_read_ref": "SELECT workspace_id, channel, thread_ts, arg_min(read_ref, struct_pack(a := received_at, b := row_id)) AS first_ref, count(*) AS n FROM decisions WHERE thread_ts IS NOT NULL AND read_ref IS NOT NULL GROUP BY 1, 2, 3",
    "jn24_watched_channels": """SELECT d.workspace_id, count(*) AS messages, CAST(sum(CAST(m.user_id IS NOT NULL AS INTEGER)) AS BIGINT) AS by_members FROM decisions d
LEFT JOIN (SELECT DISTINCT workspace_id, user_id FROM members) m ON m.workspace_id = d.workspace_id AND m.user_id = d."user" WHERE d.workspace_id IN (SELECT workspace_id FROM members) GROUP BY 1""",
    "jn32_pushes": "WITH r AS (SELECT DISTINCT repo, try_cast(regexp_extract(repo, '([0-9]*)$', 1) AS BIGINT) AS no FROM facts_py) SELECT repo, count(*) AS pushes FROM events JOIN r ON r.no = user_id % 20 WHERE event_id % 3 = 0 GROUP BY 1",
    "st4_shared_kinds": 'SELECT event_type, user_id % 100 AS "group" FROM events WHERE day(ts) < 8 INTERSECT SELECT event_type, user_id % 100 FROM events WHERE day(ts) >= 8 AND day(ts) < 15 INTERSECT SELECT event_type, user_id % 100 FROM events WHERE day(ts) >= 15',
    "sm18_coalesced": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t + 600000000 AS busy, false AS again, 1 AS row_, 1 AS runs FROM o WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN t >= b THEN t + 600000000 ELSE b END, CASE WHEN t >= b THEN false WHEN rw < 3 THEN true ELSE ag END, CASE WHEN t >= b THEN 1 ELSE rw END, CASE WHEN t >= b THEN rn + 1 ELSE rn END FROM (
    SELECT o.user_id, o.k, o.t, CASE WHEN again AND o.t >= busy THEN busy + 600000000 ELSE busy END AS b, CASE WHEN again AND o.t >= busy THEN false ELSE again END AS ag, CASE WHEN again AND o.t >= busy THEN row_ + 1 ELSE row_ END AS rw, CASE WHEN again AND o.t >= busy THEN runs + 1 ELSE runs END AS rn
    FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1))
SELECT CAST(user_id AS VARCHAR) AS subject, count(*) AS requests, CAST(arg_max(runs + CAST(again AS INT), k) AS BIGINT) AS runs FROM r GROUP BY 1""",
    "fn30_retry_after": "WITH n AS (SELECT max(ts) AS t FROM events) SELECT user_id, CAST(greatest(0, ceil(3600 - (epoch_us(t) - epoch_us(max(ts))) / 1000000.0)) AS BIGINT) AS seconds FROM events, n GROUP BY user_id, t",
    "sm16_expired": "WITH n AS (SELECT max(received_at) AS t FROM decisions) SELECT workspace_id, CAST(sum(CAST(received_at < t - INTERVAL 3 DAYS AS INTEGER)) AS BIGINT) AS dropped, CAST(sum(CAST(NOT received_at < t - INTERVAL 3 DAYS AS INTEGER)) AS BIGINT) AS kept FROM decisions, n GROUP BY 1",
}
