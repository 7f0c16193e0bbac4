"""Queries on predicates, orders and functions of single records, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions import richtext as T
from weftwork.functions import tracker as K
from weftwork.functions import web as Y
from weftwork.operators import codegraph as G
from weftwork.operators import incremental as I
from weftwork.operators import linking as L
from weftwork.plans.board_plans import _I, items
from weftwork.plans.graph_plans import files
from weftwork.sources.files import LANGUAGES, language, line_range
from weftwork.tables import table

def rows():
    return F.count(F.lit(1)).alias("n")


def one(c, name):
    """How many rows a predicate holds for; null is false, as for a store that compares missing fields."""
    return F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)


def pf3_predicates(spark, folder):
    """How many items of a workspace pass each predicate (PF3, PF14, PF19): done long ago or not, room for a label, open by
    bucket. Missing fields pass what asks for a difference."""
    s = items(spark, folder)
    now = F.lit("2026-04-01").cast("timestamp_ntz")
    open_ = ~F.coalesce(F.col("status_category") == "done", F.lit(False))
    return s.groupBy("workspace_id").agg(one(open_ | (F.col("updated_at") >= now - F.expr("INTERVAL 14 DAYS")), "recent"), one(F.coalesce(F.size("labels"), F.lit(0)) < 3, "room"), one(F.col("status_category").isin("todo", "in_progress"), "active"), rows())


def pf20_derived_status(spark, folder):
    """A status worked out when read (PF20): what is open past its day is late, whatever is stored."""
    late = (F.coalesce("status_category", F.lit("")) != "done") & (F.col("due_date") < "2026-03-01")
    return items(spark, folder).select(F.when(late, "late").otherwise(F.coalesce("status_category", F.lit("none"))).alias("status")).groupBy("status").agg(rows())


def pf18_next_due(spark, folder):
    """The item of each workspace and source to be worked on next: not begun and due first, or begun and left for 30 days
    (PF18, PF21, SL14); an item without a time counts as left."""
    s = items(spark, folder)
    stale = F.coalesce(F.col("updated_at") < F.lit("2026-03-01").cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS"), F.lit(True))
    due = ((F.col("status_category") == "todo") & F.col("due_date").isNotNull()) | ((F.col("status_category") == "in_progress") & stale)
    w = Window.partitionBy("workspace_id", "source").orderBy(F.col("due_date").asc_nulls_last(), "item_id")
    return s.filter(due).withColumn("p", F.row_number().over(w)).filter("p = 1").select("workspace_id", "source", "item_id")


def pf22_attempts(spark, folder):
    """Attempts that count: at most five of a member, none later than an hour after the first (PF22)."""
    e = table(spark, folder, "events").filter("event_type = 'error'")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = e.withColumns({"k": F.row_number().over(w), "first": F.min("ts").over(Window.partitionBy("user_id"))})
    return t.groupBy("user_id").agg(one((F.col("k") <= 5) & (F.col("ts") <= F.col("first") + F.expr("INTERVAL 1 HOUR")), "taken"), rows())


def pf10_edge_types(spark, folder):
    """Facts by kind of relation, of the kinds asked for only; an unknown kind is an error before anything runs (PF10)."""
    kinds = G_kinds(["CALLS", "RENDERS", "EXTENDS"])
    return L.mentions(files(spark, folder)).filter(F.col("kind").isin(kinds)).groupBy("kind").agg(rows())


def G_kinds(kinds):
    """The kinds, if all are known."""
    known = {"CONTAINS", "DEFINES", "HAS_MEMBER", "IMPORTS", "USES_PACKAGE", "CALLS", "RENDERS", "EXTENDS", "IMPLEMENTS", "HANDLES", "REQUESTS", "DEPENDS_ON", "USES_EXTERNAL"}
    if set(kinds) - known:
        raise ValueError(f"unknown kinds: {sorted(set(kinds) - known)}")
    return list(kinds)


def sc2_point_lookup(spark, folder):
    """One item by its id, in its workspace (SC2): the smallest id of each workspace, looked up."""
    s = items(spark, folder)
    keys = s.groupBy("workspace_id").agg(F.min("item_id").alias("item_id"))
    return s.join(keys, ["workspace_id", "item_id"], "left_semi").select("workspace_id", "item_id", "title")


def sc6_stored_facts(spark, folder):
    """The fingerprints of the facts in store, by path, of the newest parser only (SC6)."""
    f = table(spark, folder, "facts_py")
    top = f.groupBy("repo").agg(F.max("parser_version").alias("top"))
    return f.join(top, "repo").filter("parser_version = top").groupBy("repo").agg(F.countDistinct("path").alias("paths"), F.countDistinct("content_hash").alias("contents"), F.max("top").alias("parser"))


def sc9_line_ranges(spark, folder):
    """Lines 3 to 12 of every excerpt, 5 at most, and how many were left out (SC9)."""
    c = table(spark, folder, "context").filter("lines IS NOT NULL AND size(lines) > 0")
    r = c.select("block_id", line_range(F.array_join(F.transform("lines", lambda x: F.coalesce(x, F.lit(""))), "\n"), F.lit(3), F.lit(12), 5).alias("r"))
    return r.select("block_id", F.coalesce(F.size("r.lines"), F.lit(0)).alias("shown"), F.coalesce("r.omitted", F.lit(0)).alias("omitted"), F.coalesce(F.length(F.array_join("r.lines", "\n")), F.lit(0)).alias("size"))


def sc5_languages(spark, folder):
    """The language of every path by its ending, against the one stored (SC5)."""
    f = table(spark, folder, "facts_py").select(F.coalesce("language", F.lit("none")).alias("stored"), F.coalesce(language(F.col("path")), F.lit("none")).alias("told"))
    return f.groupBy("stored", "told").agg(rows())


def sc16_backfilled(spark, folder):
    """Pages without a character count get it, all in one pass (SC16)."""
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("n_chars")).alias("n_chars"), "text")
    return d.groupBy(F.col("n_chars").isNull().alias("filled")).agg(rows(), F.coalesce(F.sum(F.coalesce("n_chars", F.length("text"))), F.lit(0)).cast("long").alias("chars"))


def ag2_deepest(spark, folder):
    """The deepest file of each repository (AG2)."""
    return files(spark, folder).groupBy("repo").agg(F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(0)).alias("depth"))


def ag21_discussions(spark, folder):
    """Threads that are discussions: two messages of two people at least (AG21), by channel."""
    d = table(spark, folder, "decisions").filter("thread_ts IS NOT NULL AND user IS NOT NULL AND text IS NOT NULL")
    t = d.groupBy("workspace_id", "channel", "thread_ts").agg(F.countDistinct("ts").alias("m"), F.countDistinct("user").alias("p"))
    return t.groupBy("workspace_id", "channel").agg(one((F.col("m") >= 2) & (F.col("p") >= 2), "discussions"), rows())


def ag30_statuses(spark, folder):
    """Every status that a project's tickets use, once, as first met, in the order of categories (AG30, FN18)."""
    t = table(spark, folder, "sample_jira_tickets").filter("key IS NOT NULL AND fields.status.name IS NOT NULL").select(F.substring_index("key", "-", 1).alias("project"), F.col("fields.status.name").alias("status"), F.col("fields.status.statusCategory.key").alias("k"), "row_id")
    first = t.groupBy("project", "status").agg(F.min_by("k", "row_id").alias("k"), F.min("row_id").alias("at"))
    cat = K.status_category(F.col("k"), F.col("status"))
    order = F.array_position(F.array(*map(F.lit, K.CATEGORY_ORDER)), F.col("category"))
    return first.withColumn("category", cat).select("project", "status", "category", F.row_number().over(Window.partitionBy("project").orderBy(order, "at")).alias("place"))


def ag31_ready(spark, folder):
    """Whether a workspace has anything that can be read (AG31)."""
    return items(spark, folder).groupBy("workspace_id").agg(F.coalesce(F.bool_or((F.col("source") == "jira") & (F.length("description_md") > 0)), F.lit(False)).alias("ready"))


# Fixed values of the query: columns of a board and the statuses they hold, in order.
COLUMNS = [("Waiting", ["Open", "To Do"]), ("Doing", ["In Progress", "In Review"]), ("Stuck", ["Blocked", "In Review"]), ("Ended", ["Closed", "Done", "Won't Do"]), ("Never", ["Nothing"])]


def _columns(spark):
    return spark.createDataFrame([(i, name, list(s)) for i, (name, s) in enumerate(COLUMNS)], "pos int, name string, statuses array<string>")


def jn36_kept_columns(spark, folder):
    """A board's columns with the statuses that a target really uses, each with the category of its first one; columns without
    any are gone (JN36, FN23)."""
    s = items(spark, folder).filter("status IS NOT NULL AND target_key IS NOT NULL")
    used = s.groupBy("target_key", "status").agg(F.min("status_category").alias("category"))
    held = _columns(spark).select("pos", "name", F.posexplode("statuses").alias("k", "status"))
    j = used.join(F.broadcast(held), "status").groupBy("target_key", "pos", "name").agg(F.array_sort(F.collect_list(F.struct("k", "status", "category"))).alias("x"))
    return j.select("target_key", K.column_id(F.col("name")).alias("id"), "name", F.get("x", F.lit(0))["category"].alias("category"), F.array_join(F.transform("x", lambda x: x["status"]), ",").alias("statuses"))


def jn27_item_columns(spark, folder):
    """The column that each item is in: the first that holds its status; none is hidden (JN27)."""
    held = _columns(spark).select("pos", "name", F.explode("statuses").alias("status")).groupBy("status").agg(F.min_by("name", "pos").alias("column"))
    return items(spark, folder).join(F.broadcast(held), "status", "left").groupBy(F.coalesce("column", F.lit("")).alias("column")).agg(rows())


def sl9_open_order(spark, folder):
    """The first ten items of each target as a list shows them: begun ones first, then by day, those without one last (SL9)."""
    s = items(spark, folder).filter("coalesce(status_category, '') <> 'done'")
    w = Window.partitionBy("workspace_id", "target_key").orderBy(F.coalesce(F.col("status_category") != "in_progress", F.lit(True)), F.col("due_date").isNull(), "due_date", "created_at", "item_id")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("item_id", "place")


def sl10_arranged(spark, folder):
    """Statuses in a saved order, those it doesn't name after them by name (SL10)."""
    order = F.array_position(F.array(F.lit("Done"), F.lit("Blocked"), F.lit("To Do")), F.col("status"))
    s = items(spark, folder).filter("status IS NOT NULL").select("source", "status").distinct()
    return s.select("source", "status", F.row_number().over(Window.partitionBy("source").orderBy(F.when(order == 0, 99).otherwise(order), "status")).alias("place"))


def sl11_areas(spark, folder):
    """Labels as areas of an overview: by name whatever the case, items without any under Other, which comes last (SL11, FN39):
    the order of the sections and the head of each."""
    s = items(spark, folder).select("workspace_id", F.explode(F.when(F.coalesce(F.size("labels"), F.lit(0)) == 0, F.array(F.lit("Other"))).otherwise(F.col("labels"))).alias("area"), "item_id", "title")
    a = s.filter("area IS NOT NULL").groupBy("workspace_id", "area").agg(rows(), F.min_by("title", "item_id").alias("first"))
    return a.select("workspace_id", "area", "n", F.row_number().over(Window.partitionBy("workspace_id").orderBy(F.col("area") == "Other", F.lower("area"), "area")).alias("place"), F.concat(F.lit("- **["), F.translate(F.coalesce("first", F.lit("Untitled")), "[]", ""), F.lit("]**")).alias("line"))


def sl5_by_name(spark, folder):
    """Definitions whose name holds a word, the shortest names first, then by id, 20 of a repository (SL5, RT3)."""
    s = G.symbols(files(spark, folder)).filter(F.contains(F.lower("name"), F.lit("queue")))
    w = Window.partitionBy("repo").orderBy(F.length("name"), "id")
    return s.withColumn("place", F.row_number().over(w)).filter("place <= 20").select("repo", "id", "place")


def sl8_worth_embedding(spark, folder):
    """What of a repository is worth a vector, most worth first: files, handlers of routes, shapes, exported functions of four
    lines or more, other ones by length; tests are left out; 4000 of a repository (PF17, SL8)."""
    from weftwork.functions.text import is_test_path

    f = files(spark, folder).filter(~is_test_path(F.col("path")))
    handlers = f.select("repo", "path", F.explode("routes").alias("r")).filter("r.handler IS NOT NULL").select("repo", "path", F.col("r.handler").alias("qualified_name")).distinct().withColumn("handles", F.lit(True))
    d = G.symbols(f).join(handlers, ["repo", "path", "qualified_name"], "left")
    size = F.col("end_line") - F.col("start_line") + 1
    group = F.when(F.col("handles"), 1).when(F.col("kind").isin("class", "component", "interface", "type"), 2).when(F.col("kind").isin("function", "method") & (size >= 4), F.when(F.col("exported"), 3).otherwise(4))
    d = d.withColumn("g", group).filter("g IS NOT NULL").select("repo", "path", "id", "g", F.when(F.col("g") == 4, -size).otherwise(0).alias("s"), "pos")
    every = d.unionByName(f.select("repo", "path", F.concat_ws(":", "repo", "path").alias("id"), F.lit(0).alias("g"), F.lit(0).alias("s"), F.lit(-1).alias("pos")))
    w = Window.partitionBy("repo").orderBy("g", "s", "path", "pos")
    return every.withColumn("place", F.row_number().over(w)).filter("place <= 4000").select("id", F.col("g").cast("int").alias("worth"), "place")


def fn41_file_texts(spark, folder):
    """The text that stands for a file: path, language, kinds and names of its outer definitions with signatures, 60 at most,
    3000 characters (FN41): its fingerprint."""
    top = F.slice(F.filter("definitions", lambda d: d["parent"].isNull()), 1, 60)
    names = F.transform(top, lambda d: F.concat(d["kind"], F.lit(" "), d["qualified_name"], F.when(F.length(d["signature"]) > 0, F.concat(F.lit(": "), d["signature"])).otherwise("")))
    text = F.left(F.concat_ws("\n", F.array("path"), F.array(F.coalesce("language", F.lit(""))), names), F.lit(3000))
    return files(spark, folder).select("repo", "path", F.length(text).alias("size"), F.left(F.sha2(text, 256), F.lit(16)).alias("fp"))


def fn20_current_sprint(spark, folder):
    """The sprint that an item is in now, of sprints made from its labels: an active one, else the next to come (FN20)."""
    state = lambda x: F.element_at(F.array(F.lit("closed"), F.lit("active"), F.lit("future")), F.length(x) % 3 + 1)
    sprints = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.length(x).cast("long").alias("id"), state(x).alias("state"), F.reverse(x).alias("start")))
    s = K.current_sprint(sprints)
    return items(spark, folder).select("item_id", F.coalesce(s["state"], F.lit("backlog")).alias("state"), F.coalesce(s["start"], F.lit("")).alias("start"))


def fn21_link_labels(spark, folder):
    """How links between items read from either side (FN21, JN21): tickets with those of the next number
    and the one before last of their project, as far as there are such, counted by label."""
    t = I.newest(table(spark, folder, "sample_jira_tickets").filter("id IS NOT NULL"), ["id"], [F.col("snapshot_no").desc_nulls_last(), F.desc("row_id")]).select("id", F.substring_index("key", "-", 1).alias("p"), F.substring_index("key", "-", -1).cast("long").alias("no"), "key")
    links = t.select("id", F.explode(F.array(F.struct(F.lit(True).alias("out"), F.concat_ws("-", "p", (F.col("no") + 1).cast("string")).alias("other")), F.struct(F.lit(False).alias("out"), F.concat_ws("-", "p", (F.col("no") - 2).cast("string")).alias("other")))).alias("l")).select("id", "l.*")
    j = links.join(t.select(F.col("key").alias("other")).distinct(), "other")
    label = K.link_label(F.when(F.col("id").cast("long") % 2 == 0, F.lit("blocks")), F.lit("is blocked by"), F.lit("relates"), F.col("out"))
    return j.groupBy(label.alias("label")).agg(rows())


def fn34_image_types(spark, folder):
    """The kind of image that bytes start like (FN34): of heads made from the pages' numbers."""
    heads = ["89504E470D0A1A0A00", "FFD8FFE0", "474946383961", "474946383761", "5249464600000000574542505638", "52494646000000004156", "255044462D"]
    d = table(spark, folder, "documents").select(F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7 + 1).cast("int"))).alias("head"))
    return d.groupBy(F.coalesce(Y.image_type(F.col("head")), F.lit("none")).alias("kind")).agg(rows())


def fn35_page_titles(spark, folder):
    """Titles of pages, from what their heads name or their title element (FN35)."""
    t = F.coalesce("title", F.lit(""))
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<html><head><TITLE>\n "), t, F.lit(" </TITLE></head>"))).otherwise(F.concat(F.lit('<meta name="x" property="og:title" content="'), F.translate(t, '"', "'"), F.lit('"><title>other</title>')))
    return table(spark, folder, "documents").select("doc_id", F.coalesce(Y.page_title(html), F.lit("")).alias("title"))


def fn36_urls(spark, folder):
    """Web addresses in texts that can be previewed, without their fragments (FN36), by host."""
    d = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(https?://[^\s)>\"']+)"), 1)).alias("u"))
    u = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ftp"), F.regexp_replace("u", "^https?", ""))).when(F.col("doc_id") % 5 == 1, F.regexp_replace("u", r"^(https?://[^/]+)", "$1:8080")).when(F.col("doc_id") % 5 == 2, F.concat("u", F.lit("#part"))).otherwise(F.col("u"))
    return d.select(Y.normal_url(u).alias("u")).filter("u IS NOT NULL").groupBy(F.regexp_extract("u", r"^https?://([^/:]+)", 1).alias("host")).agg(rows(), F.countDistinct("u").alias("urls"))


def fn43_repository_names(spark, folder):
    """Whether names are those of repositories (FN43): names seen, and the same with a part taken away or dots put in."""
    r = table(spark, folder, "facts_py").select("repo").distinct()
    v = F.explode(F.array(F.col("repo"), F.substring_index("repo", "/", 1), F.concat("repo", F.lit("/x")), F.lit("../x"), F.concat(F.lit("./"), "repo"), F.concat("repo", F.lit(" y"))))
    return r.select(v.alias("name")).select("name", Y.valid_repository(F.col("name")).alias("ok")).distinct()


def fn24_rich_text(spark, folder):
    """Pages written as rich text, a heading, a list and code, and read back as Markdown, plain text and image ids (FN24, FN25)."""
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} AS x)), 6, length(to_json(struct({c} AS x))) - 6)")
    d = table(spark, folder, "documents").filter("title IS NOT NULL AND space_key IS NOT NULL AND source IS NOT NULL AND length(trim(title)) > 0")
    text = F.concat(
        F.lit('{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":'), quoted("title"), F.lit('}]},{"type":"bulletList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":'), quoted("space_key"),
        F.lit(',"marks":[{"type":"strong"}]}]}]}]},{"type":"codeBlock","attrs":{"language":"py"},"content":[{"type":"text","text":'), quoted("source"), F.lit('}]},{"type":"image","attrs":{"attachmentId":"img-'), (F.col("doc_id") % 7).cast("string"), F.lit('"}}]}'),
    )
    d = d.select("doc_id", text.alias("t"))
    return d.select("doc_id", T.markdown_of(F.col("t")).alias("markdown"), T.text_of(F.col("t")).alias("plain"), F.array_join(T.images_of(F.col("t")), ",").alias("images"))


QUERIES = {f.__name__: f for f in (
    pf3_predicates, pf20_derived_status, pf18_next_due, pf22_attempts, pf10_edge_types, sc2_point_lookup, sc6_stored_facts, sc9_line_ranges, sc5_languages, sc16_backfilled, ag2_deepest, ag21_discussions, ag30_statuses, ag31_ready, jn36_kept_columns,
    jn27_item_columns, sl9_open_order, sl10_arranged, sl11_areas, sl5_by_name, sl8_worth_embedding, fn41_file_texts, fn20_current_sprint, fn21_link_labels, fn34_image_types, fn35_page_titles, fn36_urls, fn43_repository_names, fn24_rich_text,
)}

_CF = "cf AS (SELECT f.* FROM facts_py f JOIN (SELECT repo, max(snapshot_no) AS s FROM facts_py GROUP BY repo) l ON f.repo = l.repo AND f.snapshot_no = l.s QUALIFY row_number() OVER (PARTITION BY f.repo, f.path ORDER BY extracted_at DESC, row_id DESC) = 1)"
_HELD = "h AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', {}, '{}')".format(i, c, k, s.replace("'", "''")) for i, (c, ss) in enumerate(COLUMNS) for k, s in enumerate(ss)) + ") AS t(pos, name, k, status))"
_SYM = f"{_CF}, df AS (SELECT repo, path, CAST(pos - 1 AS INTEGER) AS pos, definitions[pos] AS d FROM (SELECT repo, path, definitions, unnest(range(1, len(definitions) + 1)) AS pos FROM cf)), sy AS (SELECT repo, path, pos, d, repo || ':' || path || '#' || d.qualified_name || CASE WHEN o > 1 THEN '@' || o ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, d.qualified_name ORDER BY pos) AS o FROM df))"
_B = "CAST(sum(CAST(coalesce({}, false) AS INT)) AS BIGINT)"
SQL = {
    "fn24_rich_text": "SELECT doc_id, '## ' || title || chr(10) || chr(10) || '- **' || space_key || '**' || chr(10) || chr(10) || '```py' || chr(10) || source || chr(10) || '```' AS markdown, title || chr(10) || space_key || chr(10) || source || chr(10) AS plain, 'img-' || (doc_id % 7) AS images FROM documents WHERE title IS NOT NULL AND space_key IS NOT NULL AND source IS NOT NULL AND length(trim(title)) > 0",
    "pf3_predicates": f"WITH {_I} SELECT workspace_id, {_B.format('''NOT coalesce(status_category = 'done', false) OR updated_at >= TIMESTAMP '2026-03-18' ''')} AS recent, {_B.format('coalesce(len(labels), 0) < 3')} AS room, {_B.format('''status_category IN ('todo', 'in_progress')''')} AS active, count(*) AS n FROM s GROUP BY 1",
    "pf20_derived_status": f"WITH {_I} SELECT CASE WHEN coalesce(status_category, '') <> 'done' AND due_date < '2026-03-01' THEN 'late' ELSE coalesce(status_category, 'none') END AS status, count(*) AS n FROM s GROUP BY 1",
    "pf18_next_due": f"WITH {_I} SELECT workspace_id, source, item_id FROM s WHERE (status_category = 'todo' AND due_date IS NOT NULL) OR (status_category = 'in_progress' AND coalesce(updated_at < TIMESTAMP '2026-01-30', true)) QUALIFY row_number() OVER (PARTITION BY workspace_id, source ORDER BY due_date NULLS LAST, item_id) = 1",
    "pf22_attempts": f"WITH t AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY user_id) AS f FROM events WHERE event_type = 'error') SELECT user_id, {_B.format('k <= 5 AND ts <= f + INTERVAL 1 HOUR')} AS taken, count(*) AS n FROM t GROUP BY 1",
    "pf10_edge_types": f"WITH {_CF}, m AS (SELECT 'CALLS' AS kind FROM (SELECT unnest(calls) AS c FROM cf) WHERE c.callee IS NOT NULL UNION ALL SELECT 'RENDERS' FROM (SELECT unnest(renders) AS c FROM cf) WHERE c.component IS NOT NULL UNION ALL SELECT 'EXTENDS' FROM (SELECT unnest(inheritance) AS c FROM cf) WHERE c.parent_name IS NOT NULL AND coalesce(c.kind, '') <> 'implements') SELECT kind, count(*) AS n FROM m GROUP BY 1",
    "sc2_point_lookup": f"WITH {_I} SELECT workspace_id, item_id, title FROM s QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY item_id) = 1",
    "sc6_stored_facts": "SELECT repo, count(DISTINCT path) AS paths, count(DISTINCT content_hash) AS contents, max(parser_version) AS parser FROM facts_py f WHERE parser_version = (SELECT max(parser_version) FROM facts_py g WHERE g.repo = f.repo) GROUP BY 1",
    "sc9_line_ranges": "WITH c AS (SELECT block_id, string_split(array_to_string(list_transform(lines, lambda x: coalesce(x, '')), chr(10)), chr(10)) AS l FROM context WHERE len(lines) > 0), r AS (SELECT block_id, len(l) >= 3 AS ok, greatest(least(12, len(l)) - 2, 0) AS m, list_slice(l, 3, least(12, len(l), 7)) AS x FROM c) SELECT block_id, CAST(CASE WHEN ok THEN least(m, 5) ELSE 0 END AS INTEGER) AS shown, CAST(CASE WHEN ok THEN greatest(m - 5, 0) ELSE 0 END AS INTEGER) AS omitted, CAST(CASE WHEN ok THEN length(array_to_string(x, chr(10))) ELSE 0 END AS INTEGER) AS size FROM r",
    "sc5_languages": "SELECT coalesce(language, 'none') AS stored, coalesce(CASE regexp_extract(path, '[^/][.]([^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " END, 'none') AS told, count(*) AS n FROM facts_py GROUP BY 1, 2",
    "sc16_backfilled": "WITH d AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS c, text FROM documents) SELECT c IS NULL AS filled, count(*) AS n, CAST(coalesce(sum(coalesce(c, length(text))), 0) AS BIGINT) AS chars FROM d GROUP BY 1",
    "ag2_deepest": f"WITH {_CF} SELECT repo, CAST(max(len(string_split(path, '/'))) AS INTEGER) AS depth FROM cf GROUP BY 1",
    "ag21_discussions": f"""WITH t AS (SELECT workspace_id, channel, thread_ts, count(DISTINCT ts) AS m, count(DISTINCT "user") AS p FROM decisions WHERE thread_ts IS NOT NULL AND "user" IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3) SELECT workspace_id, channel, {_B.format('m >= 2 AND p >= 2')} AS discussions, count(*) AS n FROM t GROUP BY 1, 2""",
    "ag30_statuses": """WITH t AS (SELECT split_part(key, '-', 1) AS project, fields.status.name AS status, arg_min(fields.status.statusCategory.key, row_id) AS k, min(row_id) AS at_row FROM sample_jira_tickets WHERE key IS NOT NULL AND fields.status.name IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, CASE k WHEN 'new' THEN 'todo' WHEN 'indeterminate' THEN 'in_progress' WHEN 'done' THEN 'done' ELSE CASE WHEN lower(status) IN ('done', 'closed', 'resolved') THEN 'done' WHEN lower(status) IN ('to do', 'todo', 'open', 'backlog') THEN 'todo' ELSE 'in_progress' END END AS category FROM t)
SELECT project, status, category, CAST(row_number() OVER (PARTITION BY project ORDER BY list_position(['todo', 'in_progress', 'done'], category), at_row) AS INTEGER) AS place FROM c""",
    "ag31_ready": f"WITH {_I} SELECT workspace_id, coalesce(bool_or(source = 'jira' AND length(description_md) > 0), false) AS ready FROM s GROUP BY 1",
    "jn36_kept_columns": f"WITH {_I}, {_HELD}, u AS (SELECT target_key, status, min(status_category) AS category FROM s WHERE status IS NOT NULL AND target_key IS NOT NULL GROUP BY 1, 2) SELECT target_key, 'col_' || left(sha1(lower(name)), 10) AS id, name, arg_min(category, k) AS category, string_agg(status, ',' ORDER BY k) AS statuses FROM u JOIN h USING (status) GROUP BY target_key, pos, name",
    "jn27_item_columns": f"WITH {_I}, {_HELD}, f AS (SELECT status, arg_min(name, pos) AS c FROM h GROUP BY 1) SELECT coalesce(c, '') AS \"column\", count(*) AS n FROM s LEFT JOIN f USING (status) GROUP BY 1",
    "sl9_open_order": f"WITH {_I} SELECT item_id, CAST(row_number() OVER (PARTITION BY workspace_id, target_key ORDER BY coalesce(status_category <> 'in_progress', true), due_date IS NULL, due_date, created_at, item_id) AS INTEGER) AS place FROM s WHERE coalesce(status_category, '') <> 'done' QUALIFY place <= 10",
    "sl10_arranged": f"WITH {_I} SELECT source, status, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE status WHEN 'Done' THEN 1 WHEN 'Blocked' THEN 2 WHEN 'To Do' THEN 3 ELSE 99 END, status) AS INTEGER) AS place FROM (SELECT DISTINCT source, status FROM s WHERE status IS NOT NULL)",
    "sl11_areas": f"WITH {_I}, a AS (SELECT workspace_id, unnest(CASE WHEN coalesce(len(labels), 0) = 0 THEN ['Other'] ELSE labels END) AS area, item_id, title FROM s), g AS (SELECT workspace_id, area, count(*) AS n, arg_min(title, item_id) AS f FROM a WHERE area IS NOT NULL GROUP BY 1, 2) SELECT workspace_id, area, n, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY area = 'Other', lower(area), area) AS INTEGER) AS place, '- **[' || replace(replace(coalesce(f, 'Untitled'), '[', ''), ']', '') || ']**' AS line FROM g",
    "sl5_by_name": f"WITH {_SYM} SELECT repo, id, CAST(row_number() OVER (PARTITION BY repo ORDER BY length(d.name), id) AS INTEGER) AS place FROM sy WHERE contains(lower(d.name), 'queue') QUALIFY place <= 20",
    "sl8_worth_embedding": "WITH " + _SYM + """, tp AS (SELECT * FROM cf WHERE NOT regexp_matches(path, '(^|/)(tests|test|__tests__|spec|specs|__mocks__|fixtures)/') AND NOT regexp_matches(path, '(^|/)(test_[^/]*[.]py|[^/]*_test[.]py|conftest[.]py|[^/]*[.](test|spec|stories)[.][^./]+)$')),
hd AS (SELECT DISTINCT repo, path, r.handler AS q FROM (SELECT repo, path, unnest(routes) AS r FROM tp) WHERE r.handler IS NOT NULL),
z AS (SELECT sy.repo, sy.path, sy.id, pos, d.end_line - d.start_line + 1 AS size, CASE WHEN hd.q IS NOT NULL THEN 1 WHEN d.kind IN ('class', 'component', 'interface', 'type') THEN 2 WHEN d.kind IN ('function', 'method') AND d.end_line - d.start_line + 1 >= 4 THEN CASE WHEN d.exported THEN 3 ELSE 4 END END AS g
  FROM sy JOIN tp ON tp.repo = sy.repo AND tp.path = sy.path LEFT JOIN hd ON hd.repo = sy.repo AND hd.path = sy.path AND hd.q = sy.d.qualified_name),
e AS (SELECT repo, path, id, g, CASE WHEN g = 4 THEN -size ELSE 0 END AS s, pos FROM z WHERE g IS NOT NULL UNION ALL SELECT repo, path, repo || ':' || path, 0, 0, -1 FROM tp)
SELECT id, CAST(g AS INTEGER) AS worth, CAST(row_number() OVER (PARTITION BY repo ORDER BY g, s, path, pos) AS INTEGER) AS place FROM e QUALIFY place <= 4000""",
    "fn41_file_texts": f"WITH {_CF}, x AS (SELECT repo, path, left(array_to_string(list_concat([path, coalesce(language, '')], list_transform(list_slice(list_filter(definitions, lambda d: d.parent IS NULL), 1, 60), lambda d: d.kind || ' ' || d.qualified_name || CASE WHEN length(d.signature) > 0 THEN ': ' || d.signature ELSE '' END)), chr(10)), 3000) AS t FROM cf) SELECT repo, path, CAST(length(t) AS INTEGER) AS size, left(sha256(t), 16) AS fp FROM x",
    "fn20_current_sprint": f"WITH {_I}, l AS (SELECT item_id, unnest(labels) AS x FROM s), p AS (SELECT item_id, length(x) AS id, CASE length(x) % 3 WHEN 0 THEN 'closed' WHEN 1 THEN 'active' ELSE 'future' END AS state, reverse(x) AS start FROM l), b AS (SELECT item_id, arg_min(struct_pack(state := state, start := start), struct_pack(a := state <> 'active', s := start, i := id)) AS r FROM p WHERE state <> 'closed' GROUP BY 1) SELECT s.item_id, coalesce(r.state, 'backlog') AS state, coalesce(r.start, '') AS start FROM s LEFT JOIN b USING (item_id)",
    "fn21_link_labels": """WITH t AS (SELECT id, key, split_part(key, '-', 1) AS p, try_cast(regexp_extract(key, '([^-]*)$', 1) AS BIGINT) AS no FROM (SELECT * FROM sample_jira_tickets WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC NULLS LAST, row_id DESC) = 1)), l AS (SELECT id, true AS o, p || '-' || (no + 1) AS k FROM t UNION ALL SELECT id, false, p || '-' || (no - 2) FROM t)
SELECT CASE WHEN o THEN CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'blocks' ELSE 'relates' END ELSE 'is blocked by' END AS label, count(*) AS n FROM l WHERE k IN (SELECT key FROM t) GROUP BY 1""",
    "fn34_image_types": "SELECT CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' ELSE 'none' END AS kind, count(*) AS n FROM documents GROUP BY 1",
    "fn35_page_titles": r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) ELSE CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(regexp_replace(replace(title, '" + '"' + r"', ''''), '\s+', ' ', 'g')) ELSE 'other' END END AS title FROM documents",
    "fn36_urls": r"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(https?://[^\s)>"'']+)', 1)) AS u FROM documents), v AS (SELECT CASE WHEN doc_id % 5 = 2 OR doc_id % 5 > 2 THEN regexp_replace(u, '#.*$', '') END AS u FROM u)
SELECT regexp_extract(u, '^https?://([^/:]+)', 1) AS host, count(*) AS n, count(DISTINCT u) AS urls FROM v WHERE u IS NOT NULL AND length(u) <= 2048 GROUP BY 1""",
    "fn43_repository_names": "WITH r AS (SELECT DISTINCT repo FROM facts_py) SELECT repo AS name, true AS ok FROM r UNION SELECT split_part(repo, '/', 1), false FROM r UNION SELECT repo || '/x', false FROM r UNION SELECT '../x', false FROM r UNION SELECT './' || repo, false FROM r UNION SELECT repo || ' y', false FROM r",
}
