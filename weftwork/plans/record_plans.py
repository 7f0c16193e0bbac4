"""Queries on records, their evidence and their keeping in step, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions import tracker as K
from weftwork.operators import incremental as I
from weftwork.plans.board_plans import _CM, _I, KEYS, items
from weftwork.session import broadcast_if_small, shared_folder
from weftwork.sources import paged
from weftwork.tables import table


def n_rows(name="n"):
    return F.count(F.lit(1)).alias(name)


def comments(spark, folder):
    return I.newest(table(spark, folder, "comments"), ["comment_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")])


def jn5_sources(spark, folder):
    """References of three kinds (item, page, thread) and how many of them lead to something that is there (JN5, PF8)."""
    c, d, p = table(spark, folder, "comments"), table(spark, folder, "decisions"), table(spark, folder, "documents")
    s = lambda k, x: F.struct(F.lit(k).alias("kind"), x.alias("ref_id"))
    thread = lambda t: F.concat_ws("/", "workspace_id", "channel", t)
    refs = [c.filter("item_id IS NOT NULL").select(s("work_item", F.col("item_id")).alias("r")), d.filter("thread_ts IS NOT NULL").select(s("chat_thread", thread("thread_ts")).alias("r")), p.select(s("document", F.col("doc_id").cast("string")).alias("r"))]
    there = [table(spark, folder, "service").select(s("work_item", F.col("item_id")).alias("r")), d.filter("text IS NOT NULL AND ts IS NOT NULL").select(s("chat_thread", thread("ts")).alias("r")), p.filter("text IS NOT NULL").select(s("document", F.col("doc_id").cast("string")).alias("r"))]
    asked = refs[0].unionByName(refs[1]).unionByName(refs[2]).select("r.*")
    found = there[0].unionByName(there[1]).unionByName(there[2]).select("r.*").distinct().withColumn("found", F.lit(1))
    return asked.join(found, ["kind", "ref_id"], "left").groupBy("kind").agg(n_rows(), F.count("found").alias("found"))


def jn8_memberships(spark, folder):
    """The live workspaces of each member, in the order of joining (JN8)."""
    live = table(spark, folder, "service").select("workspace_id").distinct()
    m = table(spark, folder, "members").join(live, "workspace_id", "left_semi")
    return m.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("joined_at", "workspace_id"))), lambda x: x["workspace_id"]), ",").alias("workspaces"))


def _quote(c):
    return F.substring(F.sha2(F.regexp_extract(F.lower(c), r"^([^.?!\n]+)", 1), 256), 1, 16)


def jn31_new_quotes(spark, folder):
    """Quotes of comments that no earlier comment on the item has, and that weren't passed over before (JN31): two anti-joins
    on item and fingerprint, per workspace."""
    c = comments(spark, folder).filter("item_id IS NOT NULL AND length(trim(body)) > 0").select("workspace_id", "item_id", "created_at", "body", _quote(F.col("body")).alias("fp"))
    late = F.col("created_at") >= F.lit("2026-02-01").cast("timestamp_ntz")
    known = c.filter(~late).select("item_id", "fp").distinct()
    passed = table(spark, folder, "service").filter("description_md IS NOT NULL").select("item_id", _quote(F.col("description_md")).alias("fp")).distinct()
    new = I.missing_from(I.missing_from(c.filter(late), known, ["item_id", "fp"]), passed, ["item_id", "fp"])
    return new.groupBy("workspace_id").agg(n_rows(), F.countDistinct("item_id", "fp").alias("quotes"))


def jn25_waiting_questions(spark, folder):
    """Questions in threads that nobody else has answered since (JN25): per channel."""
    d = I.newest(table(spark, folder, "decisions").filter("ts IS NOT NULL AND thread_ts IS NOT NULL"), ["workspace_id", "channel", "ts"], [F.col("received_at").desc_nulls_last(), F.desc("row_id")])
    m = d.select("workspace_id", "channel", "thread_ts", "user", F.expr("try_cast(ts AS double)").alias("at"), "text").filter("at IS NOT NULL AND user IS NOT NULL AND text IS NOT NULL")
    # of each thread, the last message of each speaker, and the last two speakers: enough to know of an answer
    last = m.groupBy("workspace_id", "channel", "thread_ts", "user").agg(F.max("at").alias("last"))
    two = last.withColumn("rn", F.row_number().over(Window.partitionBy("workspace_id", "channel", "thread_ts").orderBy(F.desc("last"), "user"))).filter("rn <= 2")
    top = two.groupBy("workspace_id", "channel", "thread_ts").agg(F.max(F.when(F.col("rn") == 1, F.struct("user", "last"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("last"))).alias("b"))
    asked = m.filter(F.trim("text").endswith("?")).join(top, ["workspace_id", "channel", "thread_ts"])
    answered = F.when(F.col("a.user") == F.col("user"), F.coalesce(F.col("b") > F.col("at"), F.lit(False))).otherwise(F.col("a.last") > F.col("at"))
    return asked.groupBy("workspace_id", "channel").agg(n_rows("questions"), F.sum((~answered).cast("long")).alias("waiting"))


def jn33_serving(spark, folder):
    """Messages of workspaces that have members and an open item: chained semi-joins (JN33), per workspace."""
    open_ = items(spark, folder).filter("coalesce(status_category, '') <> 'done'").select("workspace_id").distinct()
    d = table(spark, folder, "decisions").join(table(spark, folder, "members").select("workspace_id").distinct(), "workspace_id", "left_semi").join(open_, "workspace_id", "left_semi")
    return d.groupBy("workspace_id").agg(n_rows())


def jn35_nested_mentions(spark, folder):
    """Every item's comments in order, each with the keys it names, in one nested row (JN35, AG29)."""
    from weftwork.functions.text import mentioned_keys

    c = comments(spark, folder).filter("item_id IS NOT NULL").select("item_id", "comment_id", "created_at", F.coalesce(mentioned_keys(F.col("body")), F.array().cast("array<string>")).alias("keys"))
    one = F.array_sort(F.collect_list(F.struct("created_at", "comment_id", "keys")))
    return c.groupBy("item_id").agg(one.alias("c")).select("item_id", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: F.concat(F.right(x["comment_id"], F.lit(6)), F.lit("["), F.array_join(x["keys"], "+"), F.lit("]"))), ",").alias("nested"))


def ag26_numbered_sources(spark, folder):
    """The distinct authors of an item's comments, numbered S1, S2, ... in the order in which they first appear (AG26)."""
    c = comments(spark, folder).filter("item_id IS NOT NULL AND author IS NOT NULL AND author.id IS NOT NULL")
    first = c.groupBy("item_id", F.col("author.id").alias("author")).agg(F.min(F.struct("created_at", "row_id")).alias("at"))
    return first.select("item_id", "author", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("item_id").orderBy("at")).cast("string")).alias("source"))


def ag27_attention(spark, folder):
    """Items that were questioned after the last entry of their history (AG27, WN11): per workspace."""
    h = table(spark, folder, "service").groupBy("item_id").agg(F.max("workspace_id").alias("workspace_id"), F.array_sort(F.collect_list("updated_at")).alias("history"))
    e = comments(spark, folder).filter("item_id IS NOT NULL AND body IS NOT NULL").groupBy("item_id").agg(F.collect_list(F.struct(F.col("created_at").alias("at"), F.contains("body", F.lit("?")).alias("doubts"))).alias("evidence"))
    j = h.join(e, "item_id").withColumn("last", F.try_element_at("history", F.lit(-1)))
    return j.groupBy("workspace_id").agg(n_rows(), F.sum(F.exists("evidence", lambda x: x["doubts"] & (x["at"] > F.col("last"))).cast("long")).alias("attention"))


def sk9_changed_fields(spark, folder):
    """Which fields an item's newest row changes against its first one, and how often (SK9): the least that must be written."""
    s = table(spark, folder, "service")
    first = I.newest(s, ["item_id"], [F.col("updated_at").asc_nulls_first(), F.asc("row_id")])
    last = items(spark, folder)
    fields = ["title", "description_md", "status", "status_category", "priority", "issue_type", "due_date", "story_points", "rank", "tracker_hidden", "updated_at"]
    a = first.select("item_id", *[F.col(f).alias(f"old_{f}") for f in fields])
    changed = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return last.join(a, "item_id").select(F.explode(changed).alias("field")).groupBy("field").agg(n_rows())


def sk12_rekeyed(spark, folder):
    """Rows that get another person's id when people of one name become one, per table and column (SK12)."""
    m = table(spark, folder, "members").filter("name IS NOT NULL")
    ids = m.groupBy("name").agg(F.min("user_id").alias("survivor")).join(m.select("name", "user_id").distinct(), "name").filter("user_id <> survivor").select(F.col("user_id").alias("old"), "survivor").distinct()
    ids = ids.groupBy("old").agg(F.min("survivor").alias("survivor"))
    parts = [(t, c, table(spark, folder, t).select(F.col(e).alias("old"))) for t, c, e in (("comments", "author", "author.id"), ("service", "assignee", "assignee.id"), ("service", "reporter", "reporter.id"), ("decisions", "user", "user"))]
    out = None
    for t, c, p in parts:
        one = p.join(ids, "old").agg(n_rows()).select(F.lit(t).alias("tbl"), F.lit(c).alias("field"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sk7_replaced(spark, folder):
    """The stored facts of all repositories with those of one in three replaced whole by their last snapshot, and files that
    are gone there deleted (SK7, SK4): how many rows each repository has then."""
    f = I.newest(table(spark, folder, "facts_py"), ["repo", "path", "snapshot_no"], [F.desc("extracted_at"), F.desc("row_id")]).select("repo", "path", "snapshot_no", "content_hash")
    ends = f.groupBy("repo").agg(F.min("snapshot_no").alias("first"), F.max("snapshot_no").alias("last")).withColumn("replaced", F.length("repo") % 3 == 0)
    j = f.join(ends, "repo")
    stored = j.filter("snapshot_no = first").select("repo", "path", "content_hash")
    new = j.filter("snapshot_no = last AND replaced").select("repo", "path", "content_hash")
    kept = stored.join(ends.filter("replaced").select("repo"), "repo", "left_anti")
    return kept.unionByName(new).groupBy("repo").agg(n_rows(), F.countDistinct("content_hash").alias("contents"))


def sm8_kept_copies(spark, folder):
    """Kept copies of threads with what came later laid over them, message by message, the new text winning (SM8, ST5): how
    many messages each channel's copies hold and how long their texts are."""
    d = table(spark, folder, "decisions").filter("thread_ts IS NOT NULL AND ts IS NOT NULL AND text IS NOT NULL AND user IS NOT NULL")
    key = ["workspace_id", "channel", "thread_ts", "ts"]
    old = I.newest(d, key, [F.col("received_at").asc_nulls_first(), F.asc("row_id")]).select(*key, "user", "text")
    half = F.col("received_at") >= F.lit("2026-04-03").cast("timestamp_ntz")
    new = I.newest(d.filter(half), key, [F.col("received_at").desc_nulls_last(), F.desc("row_id")]).select(*key, "user", "text")
    merged = I.upsert(old, new, key)
    return merged.groupBy("workspace_id", "channel").agg(n_rows(), F.sum(F.length(F.concat_ws(": ", "user", "text"))).cast("long").alias("size"), F.countDistinct("thread_ts").alias("threads"))


def sm10_conversation_ids(spark, folder):
    """The lasting id of every thread: the one it was read under, else made from its root; and where it opens (SM10, FN33)."""
    d = table(spark, folder, "decisions").filter("thread_ts IS NOT NULL AND workspace_id IS NOT NULL AND channel IS NOT NULL")
    t = d.groupBy("workspace_id", "channel", "thread_ts").agg(F.min("read_ref").alias("read_before"))
    return t.select("workspace_id", "channel", "thread_ts", K.conversation_id(F.col("workspace_id"), F.col("channel"), F.col("thread_ts"), F.col("read_before")).alias("id"), K.permalink(F.concat(F.lit("https://"), F.left("workspace_id", F.lit(8)), F.lit(".chat.test/")), F.col("channel"), F.col("thread_ts")).alias("url"))


def sm11_retries(spark, folder):
    """Minutes until each member's failed work is tried again, by the number of errors on end; null when given up (SM11)."""
    e = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = e.withColumn("ok", F.sum((F.col("event_type") != "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = run.filter("event_type = 'error'").groupBy("user_id", "ok").agg(n_rows("failures"))
    return n.groupBy("failures").agg(n_rows(), F.max(K.retry_minutes(F.col("failures"))).alias("minutes"))


def sm14_pulled(spark, folder):
    """What each delivery after the first would have pulled from five minutes before the last one's end on, and what a full
    one (an hour after the last, or more) reads (SM14, SC11)."""
    t = table(spark, folder, "sample_jira_tickets").filter("snapshot_no IS NOT NULL")
    ends = t.groupBy("snapshot_no").agg(F.max("synced_at").alias("end"))
    w = Window.orderBy("snapshot_no")  # one row per delivery
    ends = ends.withColumn("since", F.lag("end").over(w)).filter("since IS NOT NULL")
    j = t.join(broadcast_if_small(ends), "snapshot_no")
    overlap = F.col("synced_at") >= F.col("since") - F.expr("INTERVAL 5 MINUTES")
    return j.groupBy("snapshot_no").agg(F.max(F.col("end") >= F.col("since") + F.expr("INTERVAL 1 HOUR")).alias("full"), n_rows("items"), F.sum(overlap.cast("long")).alias("pulled"))


def sm15_digests(spark, folder):
    """The local day whose digest is due for each connection, at several moments (SM15, FN31)."""
    e = table(spark, folder, "events")
    c = e.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("connected"), F.max("ts").cast("timestamp").alias("now"))
    zone = F.element_at(F.array(F.lit("UTC"), F.lit("Asia/Karachi"), F.lit("Asia/Tokyo")), (F.col("user_id") % 3 + 1).cast("int"))
    at = (F.col("user_id") * 37 % 1440).cast("int")
    sent = F.when(F.col("user_id") % 5 == 0, F.date_format(F.from_utc_timestamp("now", zone), "yyyy-MM-dd"))
    return c.select("user_id", F.coalesce(K.due_day(F.col("now"), zone, at, F.col("connected"), sent), F.lit("")).alias("day"))


def sc11_paged_items(spark, folder):
    """Items of a paged remote source changed since a moment, a task for each page (SC11, UX5): the deliveries' tickets, put
    on pages in the shared folder."""
    pages = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    table(spark, folder, "sample_jira_tickets").select(F.col("id"), F.col("fields.updated").alias("updated"), "snapshot_no").repartition(4).write.json(pages)
    paged.register(spark)
    got = spark.read.format("paged_items").option("pages", pages).option("since", "2025-11").load()
    return got.groupBy(F.get_json_object("item", "$.snapshot_no").cast("int").alias("snapshot_no")).agg(n_rows(), F.countDistinct("id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    jn5_sources, jn8_memberships, jn31_new_quotes, jn25_waiting_questions, jn33_serving, jn35_nested_mentions, ag26_numbered_sources, ag27_attention, sk9_changed_fields, sk12_rekeyed, sk7_replaced, sm8_kept_copies, sm10_conversation_ids,
    sm11_retries, sm14_pulled, sm15_digests, sc11_paged_items,
)}

_Q = "left(sha256(regexp_extract(lower({x}), '^([^.?!\\n]+)', 1)), 16)"
_F1 = "f AS (SELECT * FROM service QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at ASC NULLS FIRST, row_id) = 1)"
_FIELDS = ["title", "description_md", "status", "status_category", "priority", "issue_type", "due_date", "story_points", "rank", "tracker_hidden", "updated_at"]
SQL = {
    "sc11_paged_items": "SELECT snapshot_no, count(*) AS n, count(DISTINCT id) AS ids FROM sample_jira_tickets WHERE coalesce(fields.updated, '') >= '2025-11' GROUP BY 1",
    "jn5_sources": """WITH r AS (SELECT 'work_item' AS kind, item_id AS ref FROM comments WHERE item_id IS NOT NULL UNION ALL SELECT 'chat_thread', workspace_id || '/' || channel || '/' || thread_ts FROM decisions WHERE thread_ts IS NOT NULL UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents),
t AS (SELECT DISTINCT 'work_item' AS kind, item_id AS ref FROM service UNION SELECT 'chat_thread', workspace_id || '/' || channel || '/' || ts FROM decisions WHERE text IS NOT NULL AND ts IS NOT NULL UNION SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE text IS NOT NULL)
SELECT r.kind, count(*) AS n, count(t.ref) AS found FROM r LEFT JOIN t ON t.kind = r.kind AND t.ref = r.ref GROUP BY 1""",
    "jn8_memberships": "SELECT user_id, string_agg(workspace_id, ',' ORDER BY joined_at, workspace_id) AS workspaces FROM members WHERE workspace_id IN (SELECT workspace_id FROM service) GROUP BY 1",
    "jn31_new_quotes": f"""WITH {_CM}, q AS (SELECT workspace_id, item_id, created_at, {_Q.format(x='body')} AS fp FROM c WHERE item_id IS NOT NULL AND length(trim(body)) > 0), p AS (SELECT DISTINCT item_id, {_Q.format(x='description_md')} AS fp FROM service WHERE description_md IS NOT NULL)
SELECT workspace_id, count(*) AS n, count(DISTINCT (item_id, fp)) AS quotes FROM q WHERE created_at >= TIMESTAMP '2026-02-01' AND NOT EXISTS (SELECT 1 FROM q o WHERE o.item_id = q.item_id AND o.fp = q.fp AND o.created_at < TIMESTAMP '2026-02-01') AND NOT EXISTS (SELECT 1 FROM p WHERE p.item_id = q.item_id AND p.fp = q.fp) GROUP BY 1""",
    "jn25_waiting_questions": """WITH m AS (SELECT workspace_id AS w, channel AS c, thread_ts AS t, "user" AS u, try_cast(ts AS DOUBLE) AS at_s, text FROM (SELECT * FROM decisions WHERE ts IS NOT NULL AND thread_ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace_id, channel, ts ORDER BY received_at DESC NULLS LAST, row_id DESC) = 1)),
k AS (SELECT * FROM m WHERE at_s IS NOT NULL AND u IS NOT NULL AND text IS NOT NULL), q AS (SELECT *, EXISTS (SELECT 1 FROM k o WHERE o.w = k.w AND o.c = k.c AND o.t = k.t AND o.u <> k.u AND o.at_s > k.at_s) AS answered FROM k WHERE ends_with(trim(text), '?'))
SELECT w AS workspace_id, c AS channel, count(*) AS questions, CAST(sum(CAST(NOT answered AS INT)) AS BIGINT) AS waiting FROM q GROUP BY 1, 2""",
    "jn33_serving": f"WITH {_I} SELECT workspace_id, count(*) AS n FROM decisions WHERE workspace_id IN (SELECT workspace_id FROM members) AND workspace_id IN (SELECT workspace_id FROM s WHERE coalesce(status_category, '') <> 'done') GROUP BY 1",
    "jn35_nested_mentions": f"WITH {_CM} SELECT item_id, CAST(count(*) AS INTEGER) AS n, string_agg(right(comment_id, 6) || '[' || array_to_string(list_sort(list_distinct(coalesce({KEYS.format(x="body")}, []))), '+') || ']', ',' ORDER BY created_at, comment_id) AS nested FROM c WHERE item_id IS NOT NULL GROUP BY 1",
    "ag26_numbered_sources": f"WITH {_CM}, f AS (SELECT item_id, author.id AS author, min(struct_pack(a := created_at, b := row_id)) AS k FROM c WHERE item_id IS NOT NULL AND author.id IS NOT NULL GROUP BY 1, 2) SELECT item_id, author, 'S' || row_number() OVER (PARTITION BY item_id ORDER BY k) AS source FROM f",
    "ag27_attention": f"WITH {_CM}, h AS (SELECT item_id, max(workspace_id) AS w, max(updated_at) AS last FROM service GROUP BY 1), e AS (SELECT h.w, h.item_id, bool_or(contains(body, '?') AND created_at > last) AS a FROM h JOIN c USING (item_id) WHERE body IS NOT NULL GROUP BY 1, 2) SELECT w AS workspace_id, count(*) AS n, CAST(sum(CAST(coalesce(a, false) AS INT)) AS BIGINT) AS attention FROM e GROUP BY 1",
    "sk9_changed_fields": f"WITH {_I}, {_F1}, z AS (" + " UNION ALL ".join(f"SELECT '{x}' AS field FROM s JOIN f USING (item_id) WHERE s.{x} IS DISTINCT FROM f.{x}" for x in _FIELDS) + ") SELECT field, count(*) AS n FROM z GROUP BY 1",
    "sk12_rekeyed": """WITH v AS (SELECT name, min(user_id) AS survivor FROM members WHERE name IS NOT NULL GROUP BY 1), i AS (SELECT user_id AS old, min(survivor) AS survivor FROM members JOIN v USING (name) WHERE user_id <> survivor GROUP BY 1)
SELECT 'comments' AS tbl, 'author' AS field, count(*) AS n FROM comments JOIN i ON i.old = author.id UNION ALL SELECT 'service', 'assignee', count(*) FROM service JOIN i ON i.old = assignee.id UNION ALL SELECT 'service', 'reporter', count(*) FROM service JOIN i ON i.old = reporter.id UNION ALL SELECT 'decisions', 'user', count(*) FROM decisions JOIN i ON i.old = "user\"""",
    "sk7_replaced": """WITH x AS (SELECT repo, path, snapshot_no, content_hash FROM facts_py QUALIFY row_number() OVER (PARTITION BY repo, path, snapshot_no ORDER BY extracted_at DESC, row_id DESC) = 1), e AS (SELECT repo, min(snapshot_no) AS a, max(snapshot_no) AS b FROM x GROUP BY 1)
SELECT repo, count(*) AS n, count(DISTINCT content_hash) AS contents FROM x JOIN e USING (repo) WHERE snapshot_no = CASE WHEN length(repo) % 3 = 0 THEN b ELSE a END GROUP BY 1""",
    "sm8_kept_copies": """WITH d AS (SELECT * FROM decisions WHERE thread_ts IS NOT NULL AND ts IS NOT NULL AND text IS NOT NULL AND "user" IS NOT NULL), o AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY workspace_id, channel, thread_ts, ts ORDER BY received_at NULLS FIRST, row_id) = 1),
n AS (SELECT * FROM d WHERE received_at >= TIMESTAMP '2026-04-03' QUALIFY row_number() OVER (PARTITION BY workspace_id, channel, thread_ts, ts ORDER BY received_at DESC NULLS LAST, row_id DESC) = 1),
m AS (SELECT o.workspace_id, o.channel, o.thread_ts, coalesce(n."user", o."user") AS u, coalesce(n.text, o.text) AS t FROM o LEFT JOIN n ON n.workspace_id IS NOT DISTINCT FROM o.workspace_id AND n.channel IS NOT DISTINCT FROM o.channel AND n.thread_ts = o.thread_ts AND n.ts = o.ts)
SELECT workspace_id, channel, count(*) AS n, CAST(sum(length(u || ': ' || t)) AS BIGINT) AS size, count(DISTINCT thread_ts) AS threads FROM m GROUP BY 1, 2""",
    "sm10_conversation_ids": """WITH t AS (SELECT workspace_id, channel, thread_ts, min(read_ref) AS rb FROM decisions WHERE thread_ts IS NOT NULL AND workspace_id IS NOT NULL AND channel IS NOT NULL GROUP BY 1, 2, 3), h AS (SELECT *, sha1(unhex('6f0c3c0e3b1a4f5e9d471a9a5c1d2b77') || encode(workspace_id || ':' || channel || ':' || thread_ts)) AS x FROM t)
SELECT workspace_id, channel, thread_ts, coalesce(rb, substr(x, 1, 12) || '5' || substr(x, 14, 3) || substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 15)) AS id, 'https://' || left(workspace_id, 8) || '.chat.test/archives/' || channel || '/p' || replace(thread_ts, '.', '') AS url FROM h""",
    "sm11_retries": """WITH r AS (SELECT user_id, event_type, sum(CAST(event_type <> 'error' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM events), f AS (SELECT user_id, ok, count(*) AS failures FROM r WHERE event_type = 'error' GROUP BY 1, 2)
SELECT failures, count(*) AS n, max(CASE WHEN failures < 3 THEN CAST(10 * pow(2, failures - 1) AS BIGINT) END) AS minutes FROM f GROUP BY 1""",
    "sm14_pulled": """WITH e AS (SELECT snapshot_no, max(synced_at) AS f FROM sample_jira_tickets WHERE snapshot_no IS NOT NULL GROUP BY 1), l AS (SELECT *, lag(f) OVER (ORDER BY snapshot_no) AS since FROM e)
SELECT t.snapshot_no, bool_or(f >= since + INTERVAL 1 HOUR) AS full, count(*) AS items, CAST(sum(CAST(synced_at >= since - INTERVAL 5 MINUTES AS INT)) AS BIGINT) AS pulled FROM sample_jira_tickets t JOIN l USING (snapshot_no) WHERE since IS NOT NULL GROUP BY 1""",
    "sm15_digests": """WITH c AS (SELECT user_id, min(ts) AS connected, max(ts) AS n FROM events GROUP BY 1), z AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 9 END AS o, user_id * 37 % 1440 AS at_min FROM c), l AS (SELECT *, n + to_hours(o) AS local FROM z),
m AS (SELECT *, CAST(local AS DATE) AS today, hour(local) * 60 + minute(local) AS mi, floor(second(local)) AS se FROM l), d AS (SELECT *, CASE WHEN mi >= at_min THEN today WHEN (mi + 1440 - at_min) * 60 + se <= 3600 THEN today - 1 END AS day FROM m)
SELECT user_id, coalesce(CASE WHEN CAST(day AS TIMESTAMP) + to_minutes(CAST(at_min AS BIGINT)) - to_hours(o) >= connected AND (user_id % 5 <> 0 OR today <> day) THEN CAST(day AS VARCHAR) END, '') AS day FROM d""",
}
