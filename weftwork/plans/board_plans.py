"""Queries on work items, comments, pages and members, and their SQL: filters, joins, pages, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import incremental as I
from weftwork.operators import running as N
from weftwork.tables import table


def items(spark, folder):
    """One row per work item, the newest."""
    return I.newest(table(spark, folder, "service"), ["item_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")])


def board_filter(items, *, source=None, target=None, status=None, categories=None, done_since=None, hide_epics=False, open_only=False, unassigned=False, assignee=None, priority=None, label=None, text=None, sprint=None):
    """The items that pass every option given. An empty list of allowed values, or a sprint that isn't there (an empty
    string), can be met by nothing: the result is empty without a look at the items. A missing field passes what asks for
    a difference, and never what asks for a value."""
    if categories == [] or sprint == "":
        return items.limit(0)
    c = F.lit(True)
    for name, value in (("source", source), ("target_key", target), ("status", status), ("priority", priority)):
        if value is not None:
            c = c & (F.col(name) == value)
    if categories is not None:
        c = c & F.col("status_category").isin(categories)
    if done_since is not None:
        c = c & ((F.coalesce("status_category", F.lit("")) != "done") | (F.col("updated_at") >= F.lit(done_since).cast("timestamp_ntz")))
    if hide_epics:
        c = c & (F.coalesce("issue_type", F.lit("")) != "Epic")
    if open_only:
        c = c & (F.coalesce("status_category", F.lit("")) != "done")
    c = c & ~F.coalesce("tracker_hidden", F.lit(False))
    if unassigned:
        c = c & (F.col("assignee").isNull() | F.col("assignee.id").isNull())
    if assignee is not None:
        c = c & (F.col("assignee.id") == assignee)
    if label is not None:
        c = c & F.array_contains("labels", label)
    if text is not None:
        has = lambda f: F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lit(text.lower()))
        c = c & (has("title") | has("description_md") | has("key"))
    return items.filter(c)


def pf1_board_page(spark, folder):
    """The second page of 50 open, visible items whose key, title or text names a folder (PF1, PF5, PF16, SC1, SL1).

    The page is the feature; the order is total, so pages don't overlap."""
    hit = board_filter(items(spark, folder), open_only=True, hide_epics=True, text="folder")
    return hit.orderBy(F.col("rank").asc_nulls_first(), "item_id").offset(50).limit(50).select("item_id", "key", "rank", "status")


def pf1_board_filters(spark, folder):
    """How many items pass each of several filters of a board, an impossible one too (PF1)."""
    s = items(spark, folder)
    out = None
    for name, options in (("jira bugs", {"source": "jira", "priority": "high", "categories": ["todo", "in_progress"]}), ("recent", {"done_since": "2026-03-01", "hide_epics": True}), ("nobody", {"unassigned": True, "label": "queue"}), ("nothing", {"sprint": ""}), ("none allowed", {"categories": []})):
        one = board_filter(s, **options).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def jn11_closed(spark, folder):
    """Items open before that the last delivery no longer has (JN11): per project, closed upstream."""
    t = I.newest(table(spark, folder, "sample_jira_tickets").filter("snapshot_no IS NOT NULL AND id IS NOT NULL"), ["id", "snapshot_no"], [F.col("synced_at").desc_nulls_last(), F.desc("row_id")])
    last = t.agg(F.max("snapshot_no").alias("last"))
    t = t.withColumn("last", F.lit(last.first()[0]))
    open_ = t.filter("snapshot_no = last - 1 AND coalesce(fields.status.statusCategory.key, '') <> 'done'")
    return I.missing_from(open_, t.filter("snapshot_no = last"), ["id"]).groupBy(F.substring_index("key", "-", 1).alias("project")).agg(F.count(F.lit(1)).alias("n"))


def pf4_null_lane(spark, folder):
    """Items without an assignee in either shape of null, per source (PF4)."""
    return items(spark, folder).filter(F.col("assignee").isNull() | F.col("assignee.id").isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def ag1_lanes(spark, folder):
    """Lanes by assignee with size and name; nobody is 'none' (AG1)."""
    s = items(spark, folder)
    return s.groupBy(F.coalesce(F.col("assignee.id"), F.lit("none")).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("assignee.name"), F.lit("")).alias("label"))


def ag20_tab_counts(spark, folder):
    """Several conditional counts in one scan, null-safe (PF7, AG20, AG28)."""
    s = items(spark, folder)
    done = F.coalesce("status_category", F.lit("")) == "done"
    due = F.coalesce(F.col("due_date") <= "2026-01-01", F.lit(False))
    one = lambda c, n: F.sum(c.cast("long")).alias(n)
    return s.groupBy("workspace_id").agg(one(done, "done"), one(~done & due, "needs_you"), one(~(done | due), "open"), one(F.col("story_points").isNull(), "unsized"))


def pf2_visible_items(spark, folder):
    """Items of sources and targets that were synced lately, and native ones (PF2, JN7, AG19)."""
    s = items(spark, folder)
    live = s.filter("source <> 'native'").groupBy("workspace_id", "source", "target_key").agg(F.max("updated_at").alias("at")).filter(F.col("at") >= F.lit("2026-01-01").cast("timestamp_ntz")).select("workspace_id", "source", "target_key")
    seen = s.filter("source = 'native'").unionByName(s.filter("source <> 'native'").join(live, ["workspace_id", "source", "target_key"], "left_semi").select(s.columns))
    return seen.groupBy("workspace_id", "source").agg(F.count(F.lit(1)).alias("n"))


def pf6_all_words(spark, folder):
    """Pages that have every word in the title or the text (PF6, PF5)."""
    d = table(spark, folder, "documents")
    has = lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(w)) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(w))
    return d.filter(has("folder") & has("cache") & has("board")).select("doc_id", "space_key")


def pf13_label_filter(spark, folder):
    """Items that bear a label, by number of labels (PF13, PF14, AG2)."""
    s = items(spark, folder)
    label = "bridge"
    return s.filter(F.array_contains("labels", label)).groupBy(F.size("labels").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


def sl3_tiered_search(spark, folder):
    """Items by how well they match: key, start of key, title, text; the newest first within (SL3, SL4, FN7, WN12).

    Every tier keeps its 50 newest, which is the feature."""
    q = "cache"
    s = items(spark, folder)
    key, title = F.lower(F.coalesce("key", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    snip = X.snippet(F.coalesce("description_md", F.lit("")), q)
    tier = F.when(key == q, 0).when(F.startswith(key, F.lit(q)), 1).when(F.contains(title, F.lit(q)), 2).when(snip.isNotNull(), 3)
    w = Window.partitionBy("tier").orderBy(F.desc("updated_at"), "item_id")
    return s.withColumn("tier", tier).filter("tier IS NOT NULL").withColumn("place", F.row_number().over(w)).filter("place <= 50").select("item_id", "tier", F.col("place").cast("int").alias("place"), F.coalesce(snip, F.lit("")).alias("snippet"))


def sl2_keyset_page(spark, folder):
    """The newest 20 comments of each item before a moment, and whether there are more (SL2)."""
    c = I.newest(table(spark, folder, "comments"), ["comment_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")])
    w = Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("comment_id"))
    return c.withColumn("rn", F.row_number().over(w)).filter("rn <= 21").groupBy("item_id").agg(F.sum((F.col("rn") <= 20).cast("long")).alias("shown"), F.max((F.col("rn") == 21)).alias("more"), F.max("comment_id").alias("last_id"))


def wn6_neighbours(spark, folder):
    """The ranks before and after each item in its column (WN6, FN32): and the midpoint to move below it."""
    s = N.neighbours(items(spark, folder).filter("rank IS NOT NULL").select("item_id", "workspace_id", "status", "rank"), ["workspace_id", "status"], ["rank", "item_id"], "rank", "last", "next")
    rank, nxt = F.col("rank"), F.col("next")
    return s.select("item_id", F.round(F.coalesce("last", F.lit(-1.0)), 6).alias("before"), F.round(F.coalesce((rank + nxt) / 2, rank + 1), 6).alias("between"), F.coalesce(nxt - rank < 1e-6, F.lit(False)).alias("renumber"))


def wn7_renumbered(spark, folder):
    """Ranks 1 to n by rank and id (WN7)."""
    s = items(spark, folder).select("item_id", "workspace_id", "status", "rank")
    return N.numbered(s, ["workspace_id", "status"], [F.col("rank").asc_nulls_first(), F.col("item_id").asc()]).select("item_id", F.col("number").cast("double").alias("rank"))


def wn9_overflow(spark, folder):
    """The first 12 items of each target by points, the rest as a number (WN9): counts tell how many are behind, so that only
    the page itself is ranked."""
    s = items(spark, folder).select("workspace_id", "target_key", "item_id", "story_points")
    w = Window.partitionBy("workspace_id", "target_key").orderBy(F.col("story_points").desc_nulls_last(), "item_id")
    page = s.withColumn("rn", F.row_number().over(w)).filter("rn <= 12").groupBy("workspace_id", "target_key").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.coalesce("story_points", F.lit(0.0))).alias("points"))
    n = s.groupBy("workspace_id", "target_key").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id")).withColumnsRenamed({"workspace_id": "w", "target_key": "t"})
    return page.join(n, page["workspace_id"].eqNullSafe(n["w"]) & page["target_key"].eqNullSafe(n["t"])).select("workspace_id", "target_key", "shown", (F.col("n") - F.col("shown")).alias("hidden"), "first_id", F.round("points", 6).alias("points"))


def jn30_comment_overlay(spark, folder):
    """Tracker comments with those written here laid over them by external id (JN30, ST5)."""
    c = I.newest(table(spark, folder, "comments"), ["comment_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")])
    a = c.filter("external_id IS NOT NULL")
    own = I.newest(a.filter("author IS NOT NULL"), ["workspace_id", "external_id"], [F.col("created_at").asc(), F.col("comment_id").asc()]).select("workspace_id", "external_id", F.col("comment_id").alias("local_id"), F.col("author.name").alias("local_name"))
    return a.select("workspace_id", "external_id", "comment_id").join(own, ["workspace_id", "external_id"], "left").select("comment_id", F.coalesce("local_id", F.concat(F.lit("tracker:"), "external_id")).alias("shown_id"), F.coalesce("local_name", F.lit("")).alias("name"))


def jn37_orphans(spark, folder):
    """Comments whose item is gone, per workspace (JN10, JN37, JN11)."""
    c, s = table(spark, folder, "comments"), table(spark, folder, "service")
    return I.missing_from(c.filter("item_id IS NOT NULL"), s, ["item_id"]).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("item_id").alias("items"))


def _named(spark, folder, name, column, row_id):
    t = table(spark, folder, name).select(F.col(row_id).alias("row_id"), F.explode(X.mentioned_keys(F.col(column))).alias("key"))
    s = table(spark, folder, "sample_jira_tickets").filter("key IS NOT NULL").select("key", F.col("id").alias("item_id")).distinct()
    return t.join(s, "key").select(F.lit(name).alias("tbl"), "row_id", "key", "item_id")


def jn22_mentions(spark, folder):
    """Which tracker issues are named by key in comments, messages and pages (JN22, FN26)."""
    parts = [_named(spark, folder, *x) for x in (("comments", "body", "row_id"), ("decisions", "text", "row_id"), ("documents", "text", "doc_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def jn23_strongest_relation(spark, folder):
    """The strongest of several reasons that tie a comment to an item: its own, named, or by the same person (JN23, ST1, ST6).

    A comment and an item of one workspace are by the same person if the comment's author reported the item or has it.
    SURVEY JN23's quoted and similar tiers aren't built."""
    c, s = table(spark, folder, "comments").filter("item_id IS NOT NULL"), items(spark, folder)
    own = c.join(s.select("item_id"), "item_id").select("row_id", "item_id", F.lit(0).alias("p"))
    named = _named(spark, folder, "comments", "body", "row_id").select("row_id", "item_id", F.lit(1).alias("p"))
    people = s.select("workspace_id", "item_id", F.explode(F.array_distinct(F.array("assignee.id", "reporter.id"))).alias("person")).filter("person IS NOT NULL")
    every = table(spark, folder, "comments").select("row_id", "workspace_id", F.col("author.id").alias("person"))
    same = every.join(people, ["workspace_id", "person"]).select("row_id", "item_id", F.lit(2).alias("p"))
    best = own.unionByName(named).unionByName(same).groupBy("row_id", "item_id").agg(F.min("p").alias("p"))
    return best.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def jn26_item_board(spark, folder):
    """Items with the size of their target, and with an empty one where there's none (JN26, JN34)."""
    s = items(spark, folder)
    size = s.filter("target_key IS NOT NULL").groupBy("workspace_id", "source", "target_key").agg(F.count(F.lit(1)).alias("size"))
    return s.join(size, ["workspace_id", "source", "target_key"], "left").select("item_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def jn6_evidence_state(spark, folder):
    """Whether the first sentence of a comment is quoted, unchanged, in its item's text (JN6, JN15, FN8).

    A quote is all up to the first full stop or line end, however long. The SQL folds case as far as DuckDB can: lower case, ß, ς and ῶ."""
    c = table(spark, folder, "comments").filter("item_id IS NOT NULL")
    s = items(spark, folder).select("item_id", F.col("description_md").alias("source"))
    quote = F.regexp_extract(F.coalesce("body", F.lit("")), r"^([^.\n]+)", 1)
    j = c.join(s.withColumn("had", F.lit(True)), "item_id", "left")
    state = F.when(F.col("had").isNull(), "missing").when(X.quote_in(F.coalesce("source", F.lit("")), quote), "current").otherwise("changed")
    return j.select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def sk5_upserted(spark, folder):
    """Later rows put over earlier ones by item; rank and creation stay as first set (SK1, SK5, SK9)."""
    s = table(spark, folder, "service")
    first = I.newest(s, ["item_id"], [F.col("updated_at").asc_nulls_first(), F.asc("row_id")])
    last = I.newest(s, ["item_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")])
    return I.upsert(first, last, ["item_id"], keep=["rank", "created_at"]).select("item_id", "row_id", F.round("rank", 6).alias("rank"), F.length(F.coalesce("description_md", F.lit(""))).alias("size"))


def sk6_inserted_absent(spark, folder):
    """Rows of the second half of the members that the first half lacks, by name (SK6, ST3)."""
    m = table(spark, folder, "members")
    a, b = m.filter("role = 'owner' OR role = 'admin'").select("workspace_id", "name"), m.select("workspace_id", "name").distinct()
    return I.insert_absent(a, b, ["workspace_id", "name"]).groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n"))


def sk10_versioned(spark, folder):
    """Pages changed where their version is the one the change was made on (SK10)."""
    d = table(spark, folder, "documents").select("doc_id", "title", "version")
    changes = d.filter("doc_id % 3 = 0").select("doc_id", F.lit("renamed").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("version")).otherwise(F.col("version") - 1).alias("base_version"))
    return I.versioned_write(d, changes, "doc_id").groupBy(F.col("title") == "renamed").agg(F.count(F.lit(1)).alias("n"), F.sum("version").cast("long").alias("versions")).select(F.col("(title = renamed)").alias("renamed"), "n", "versions")


def sk12_merged_members(spark, folder):
    """Memberships of people with one name merged: the highest role and the first date stay (SK12)."""
    m = table(spark, folder, "members")
    level = F.when(F.col("role") == "owner", 3).when(F.col("role") == "admin", 2).otherwise(1)
    return m.groupBy("workspace_id", "name").agg(F.max(level).alias("level"), F.min("joined_at").cast("string").alias("joined"), F.count(F.lit(1)).alias("n"))


def sk13_numbered(spark, folder):
    """Numbers given to items that have no key, going on after those there are (SK13)."""
    s = items(spark, folder)
    base = s.filter("key IS NOT NULL").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("base"))
    new = s.withColumn("bare", F.coalesce("external_id", F.lit("")) == "").filter("bare").join(base, "workspace_id", "left")
    new = new.select("item_id", "workspace_id", "created_at", "base")
    return N.numbered(new, ["workspace_id"], [F.col("created_at").asc(), F.col("item_id").asc()]).select("item_id", (F.col("number") + F.coalesce("base", F.lit(0))).alias("number"))


def sk11_label_changes(spark, folder):
    """Labels with one added, one taken away and repeats dropped (SK11)."""
    s = items(spark, folder)
    out = F.array_sort(F.array_union(F.array_remove(F.coalesce("labels", F.array().cast("array<string>")), "bridge"), F.array(F.lit("seen"))))
    return s.select("item_id", F.array_join(out, ",").alias("labels"))


def st1_found_everywhere(spark, folder):
    """One list of items, pages and comments that hold a word, by kind (ST1)."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("sync"))
    a = items(spark, folder).filter(has("title") | has("description_md")).select(F.lit("item").alias("kind"), "item_id")
    b = table(spark, folder, "documents").filter(has("text")).select(F.lit("page").alias("kind"), F.col("doc_id").cast("string").alias("page_id"))
    c = table(spark, folder, "comments").filter(has("body")).select(F.lit("comment").alias("kind"), "comment_id")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.coalesce("item_id", "page_id", "comment_id")).alias("ids"))


def jn12_sync_plan(spark, folder):
    """What to read again, what is unchanged, what is gone, between all consecutive snapshots of each repository (JN12, AG18)."""
    f = I.newest(table(spark, folder, "facts_py"), ["repo", "path", "snapshot_no"], [F.desc("extracted_at"), F.desc("row_id")]).select("repo", "path", "snapshot_no", "content_hash")
    had = f.select("repo", "snapshot_no").distinct()
    later = had.withColumn("next_no", F.lead("snapshot_no").over(Window.partitionBy("repo").orderBy("snapshot_no"))).filter("next_no IS NOT NULL")
    stored = f.join(later, ["repo", "snapshot_no"]).select("repo", "path", F.col("next_no").alias("snapshot_no"), "content_hash")
    found = f.join(later.select("repo", F.col("next_no").alias("snapshot_no")), ["repo", "snapshot_no"], "left_semi")
    return I.sync_plan(found, stored, ["repo", "snapshot_no", "path"], "content_hash").groupBy("repo", "snapshot_no", "action").agg(F.count(F.lit(1)).alias("n"))


def sk8_shed_rows(spark, folder):
    """Rows that are too large to store lose their calls and renders and are marked (SK8): of a size told by the characters of
    their lists, here 4,000."""
    f = table(spark, folder, "facts_py")
    text = lambda x: F.length(F.coalesce(x, F.lit("")))
    total = lambda c, g: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + g(x)), F.lit(0))
    size = total("calls", lambda x: text(x["callee"]) + text(x["enclosing"]) + 16) + total("renders", lambda x: text(x["component"]) + text(x["enclosing"]) + 16) + total("definitions", lambda x: text(x["qualified_name"]) + text(x["signature"]) + text(x["docstring"]) + 32)
    big = size > 4000
    return f.select(F.when(big, 0).otherwise(F.size("calls")).alias("calls"), F.when(big, 0).otherwise(F.size("renders")).alias("renders"), (big | F.col("truncated")).alias("truncated")).groupBy("truncated").agg(F.count(F.lit(1)).alias("n"), F.sum("calls").cast("long").alias("calls"), F.sum("renders").cast("long").alias("renders"))


def fn22_flat_issues(spark, folder):
    """Raw issues as flat rows, times read in both ways they're written (FN19, FN22, AG30)."""
    t = table(spark, folder, "sample_jira_tickets")
    f = F.col("fields")
    return t.select("row_id", "key", f["status"]["name"].alias("status"), F.coalesce(f["assignee"]["accountId"], F.lit("")).alias("assignee"), F.size(F.coalesce(f["labels"], F.array().cast("array<string>"))).alias("labels"), F.coalesce(F.unix_seconds(X.tracker_time(f["created"])), F.lit(0)).cast("long").alias("created_s"))


def ag3_group_sizes(spark, folder):
    """Sizes of spaces, the largest version and the newest page (AG2, AG3)."""
    d = table(spark, folder, "documents")
    return d.groupBy("space_key").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"), F.max("updated_at").cast("string").alias("newest"))


def sl12_budget_cut(spark, folder):
    """Pages of a space in order of id until 20,000 characters are used up (SL12, WN10)."""
    d = N.running_sums(table(spark, folder, "documents").select("doc_id", "space_key", "n_chars"), ["space_key"], [F.col("doc_id").asc()], {"used": F.col("n_chars")})
    return d.filter("used <= 20000").groupBy("space_key").agg(F.count(F.lit(1)).alias("pages"), F.max("used").cast("long").alias("used"))


QUERIES = {f.__name__: f for f in (
    pf1_board_page, pf1_board_filters, jn11_closed, pf4_null_lane, ag1_lanes, ag20_tab_counts, pf2_visible_items, pf6_all_words, pf13_label_filter, sl3_tiered_search, sl2_keyset_page, wn6_neighbours, wn7_renumbered, wn9_overflow, jn30_comment_overlay, jn37_orphans,
    jn22_mentions, jn23_strongest_relation, jn26_item_board, jn6_evidence_state, sk5_upserted, sk6_inserted_absent, sk10_versioned, sk12_merged_members, sk13_numbered, sk11_label_changes, st1_found_everywhere, jn12_sync_plan, sk8_shed_rows, fn22_flat_issues, ag3_group_sizes, sl12_budget_cut,
)}

_I = "s AS (SELECT * FROM service QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1)"
_CM = "c AS (SELECT * FROM comments QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~#>|]', ' ', 'g'), '\s+', ' ', 'g'))"
#: White space as Unicode knows it, and case folding as far as the tables need it.
_WIDE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]+"
FOLD = r"replace(replace(replace(lower(trim(regexp_replace(regexp_replace(regexp_replace({x}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~#>|]', ' ', 'g'), '" + _WIDE.replace("{", "{{").replace("}", "}}") + r"', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ'), chr(8182), chr(969) || chr(834))"
#: Keys at words' ends in any script: marks between words are doubled, so that each can end one key and begin the next.
KEYS = r"regexp_extract_all(regexp_replace({x}, '([^\p{{L}}\p{{M}}\p{{N}}_-])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Z][A-Z0-9]{{1,9}}-[0-9]+)(?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)', 1)"
_SN = _PLAIN.format(x="coalesce(description_md, '')")
_MEN = r"m AS (SELECT row_id, unnest(list_distinct(regexp_extract_all(body, '\b([A-Z][A-Z0-9]{1,9}-[0-9]+)\b', 1))) AS key FROM comments), jm AS (SELECT DISTINCT m.row_id, m.key, t.id AS item_id FROM m JOIN (SELECT DISTINCT key, id FROM sample_jira_tickets) t ON t.key = m.key)"
SQL = {
    "pf1_board_page": f"WITH {_I} SELECT item_id, key, rank, status FROM s WHERE coalesce(status_category, '') <> 'done' AND NOT coalesce(tracker_hidden, false) AND coalesce(issue_type, '') <> 'Epic' AND (contains(lower(coalesce(title, '')), 'folder') OR contains(lower(coalesce(description_md, '')), 'folder') OR contains(lower(coalesce(key, '')), 'folder')) ORDER BY rank NULLS FIRST, item_id LIMIT 50 OFFSET 50",
    "pf1_board_filters": f"WITH {_I}, v AS (SELECT * FROM s WHERE NOT coalesce(tracker_hidden, false)) SELECT 'jira bugs' AS filter, count(*) AS n FROM v WHERE source = 'jira' AND priority = 'high' AND status_category IN ('todo', 'in_progress') UNION ALL SELECT 'recent', count(*) FROM v WHERE (coalesce(status_category, '') <> 'done' OR updated_at >= TIMESTAMP '2026-03-01') AND coalesce(issue_type, '') <> 'Epic' UNION ALL SELECT 'nobody', count(*) FROM v WHERE assignee.id IS NULL AND list_contains(labels, 'queue') UNION ALL SELECT 'nothing', 0 UNION ALL SELECT 'none allowed', 0",
    "jn11_closed": "WITH t AS (SELECT id, key, snapshot_no, fields.status.statusCategory.key AS k FROM sample_jira_tickets WHERE snapshot_no IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, snapshot_no ORDER BY synced_at DESC NULLS LAST, row_id DESC) = 1), l AS (SELECT max(snapshot_no) AS m FROM t) SELECT split_part(key, '-', 1) AS project, count(*) AS n FROM t, l WHERE snapshot_no = m - 1 AND coalesce(k, '') <> 'done' AND id NOT IN (SELECT id FROM t, l WHERE snapshot_no = m) GROUP BY 1",
    "pf4_null_lane": f"WITH {_I} SELECT source, count(*) AS n FROM s WHERE assignee IS NULL OR assignee.id IS NULL GROUP BY source",
    "ag1_lanes": f"WITH {_I} SELECT coalesce(assignee.id, 'none') AS lane, count(*) AS n, coalesce(min(assignee.name), '') AS label FROM s GROUP BY 1",
    "ag20_tab_counts": f"WITH {_I}, x AS (SELECT workspace_id, coalesce(status_category, '') = 'done' AS d, coalesce(due_date <= '2026-01-01', false) AS u, story_points IS NULL AS p FROM s) SELECT workspace_id, CAST(sum(CAST(d AS INT)) AS BIGINT) AS done, CAST(sum(CAST(NOT d AND u AS INT)) AS BIGINT) AS needs_you, CAST(sum(CAST(NOT (d OR u) AS INT)) AS BIGINT) AS open, CAST(sum(CAST(p AS INT)) AS BIGINT) AS unsized FROM x GROUP BY 1",
    "pf2_visible_items": f"WITH {_I}, l AS (SELECT workspace_id, source, target_key FROM s WHERE source <> 'native' GROUP BY 1, 2, 3 HAVING max(updated_at) >= TIMESTAMP '2026-01-01') SELECT workspace_id, source, count(*) AS n FROM s WHERE source = 'native' OR (source <> 'native' AND EXISTS (SELECT 1 FROM l WHERE l.workspace_id = s.workspace_id AND l.source = s.source AND l.target_key = s.target_key)) GROUP BY 1, 2",
    "pf6_all_words": "SELECT doc_id, space_key FROM documents WHERE " + " AND ".join(f"(contains(lower(coalesce(title, '')), '{w}') OR contains(lower(coalesce(text, '')), '{w}'))" for w in ("folder", "cache", "board")),
    "pf13_label_filter": f"WITH {_I} SELECT CAST(len(labels) AS INTEGER) AS labels, count(*) AS n FROM s WHERE list_contains(labels, 'bridge') GROUP BY 1",
    "sl3_tiered_search": f"""WITH {_I}, p AS (SELECT *, {_SN} AS pl FROM s), a AS (SELECT *, strpos(lower(pl), 'cache') AS at_pos FROM p),
b AS (SELECT item_id, updated_at, CASE WHEN at_pos > 0 THEN CASE WHEN at_pos - 1 - 60 > 0 THEN '…' ELSE '' END || trim(substr(pl, greatest(at_pos - 61, 0) + 1, least(at_pos - 1 + 65, length(pl)) - greatest(at_pos - 61, 0))) || CASE WHEN least(at_pos - 1 + 65, length(pl)) < length(pl) THEN '…' ELSE '' END END AS snip,
  CASE WHEN lower(coalesce(key, '')) = 'cache' THEN 0 WHEN starts_with(lower(coalesce(key, '')), 'cache') THEN 1 WHEN contains(lower(coalesce(title, '')), 'cache') THEN 2 WHEN at_pos > 0 THEN 3 END AS tier FROM a)
SELECT * FROM (SELECT item_id, tier, CAST(row_number() OVER (PARTITION BY tier ORDER BY updated_at DESC, item_id) AS INTEGER) AS place, coalesce(snip, '') AS snippet FROM b WHERE tier IS NOT NULL) WHERE place <= 50""",
    "sl2_keyset_page": f"WITH {_CM} SELECT item_id, CAST(sum(CAST(rn <= 20 AS INT)) AS BIGINT) AS shown, bool_or(rn = 21) AS more, max(comment_id) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, comment_id DESC) AS rn FROM c) WHERE rn <= 21 GROUP BY 1",
    "wn6_neighbours": f"WITH {_I} SELECT item_id, round(coalesce(lag(rank) OVER w, -1.0), 6) AS before, round(coalesce((rank + lead(rank) OVER w) / 2, rank + 1), 6) AS between, coalesce(lead(rank) OVER w - rank < 1e-6, false) AS renumber FROM s WHERE rank IS NOT NULL WINDOW w AS (PARTITION BY workspace_id, status ORDER BY rank, item_id)",
    "wn7_renumbered": f"WITH {_I} SELECT item_id, CAST(row_number() OVER (PARTITION BY workspace_id, status ORDER BY rank NULLS FIRST, item_id) AS DOUBLE) AS rank FROM s",
    "wn9_overflow": f"WITH {_I} SELECT workspace_id, target_key, CAST(sum(CAST(rn <= 12 AS INT)) AS BIGINT) AS shown, CAST(sum(CAST(rn > 12 AS INT)) AS BIGINT) AS hidden, min(item_id) AS first_id, round(sum(CASE WHEN rn <= 12 THEN coalesce(story_points, 0) ELSE 0 END), 6) AS points FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, target_key ORDER BY story_points DESC NULLS LAST, item_id) AS rn FROM s) GROUP BY 1, 2",
    "jn30_comment_overlay": f"WITH {_CM}, a AS (SELECT * FROM c WHERE external_id IS NOT NULL), o AS (SELECT workspace_id, external_id, comment_id AS local_id, author.name AS local_name FROM a WHERE author IS NOT NULL QUALIFY row_number() OVER (PARTITION BY workspace_id, external_id ORDER BY created_at, comment_id) = 1) SELECT a.comment_id, coalesce(o.local_id, 'tracker:' || a.external_id) AS shown_id, coalesce(o.local_name, '') AS name FROM a LEFT JOIN o USING (workspace_id, external_id)",
    "jn37_orphans": "SELECT workspace_id, count(*) AS rows, count(DISTINCT item_id) AS items FROM comments WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM service WHERE item_id IS NOT NULL) GROUP BY 1",
    "jn22_mentions": "WITH m AS (" + " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS row_id, unnest(list_distinct({KEYS.format(x=x)})) AS key FROM {t}" for t, x, i in (("comments", "body", "row_id"), ("decisions", "text", "row_id"), ("documents", "text", "doc_id"))) + ") SELECT DISTINCT tbl, row_id, m.key, t.id AS item_id FROM m JOIN (SELECT DISTINCT key, id FROM sample_jira_tickets) t ON t.key = m.key",
    "jn23_strongest_relation": f"""WITH {_I}, {_MEN}, pp AS (SELECT DISTINCT workspace_id, item_id, person FROM (SELECT workspace_id, item_id, unnest([assignee.id, reporter.id]) AS person FROM s) WHERE person IS NOT NULL),
r AS (SELECT c.row_id, c.item_id, 0 AS p FROM comments c JOIN s ON s.item_id = c.item_id UNION ALL SELECT row_id, item_id, 1 FROM jm UNION ALL SELECT c.row_id, pp.item_id, 2 FROM comments c JOIN pp ON pp.workspace_id = c.workspace_id AND pp.person = c.author.id)
SELECT p, count(*) AS n FROM (SELECT row_id, item_id, min(p) AS p FROM r GROUP BY 1, 2) GROUP BY p""",
    "jn26_item_board": f"WITH {_I}, z AS (SELECT workspace_id, source, target_key, count(*) AS n FROM s WHERE target_key IS NOT NULL GROUP BY 1, 2, 3) SELECT item_id, coalesce(n, 0) AS size FROM s LEFT JOIN z USING (workspace_id, source, target_key)",
    "jn6_evidence_state": f"""WITH {_I}, j AS (SELECT regexp_extract(coalesce(c.body, ''), '^([^.\\n]+)', 1) AS q, s.description_md AS src, s.item_id AS had FROM comments c LEFT JOIN s ON s.item_id = c.item_id WHERE c.item_id IS NOT NULL),
n AS (SELECT had, {FOLD.format(x="q")} AS nq, {FOLD.format(x="coalesce(src, '')")} AS ns FROM j)
SELECT CASE WHEN had IS NULL THEN 'missing' WHEN length(nq) > 0 AND contains(ns, nq) THEN 'current' ELSE 'changed' END AS state, count(*) AS n FROM n GROUP BY 1""",
    "sk5_upserted": f"WITH {_I}, f AS (SELECT * FROM service QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at ASC NULLS FIRST, row_id) = 1) SELECT s.item_id, s.row_id, round(f.rank, 6) AS rank, CAST(length(coalesce(s.description_md, '')) AS INTEGER) AS size FROM s JOIN f USING (item_id)",
    "sk6_inserted_absent": "WITH a AS (SELECT workspace_id, name FROM members WHERE role = 'owner' OR role = 'admin'), b AS (SELECT DISTINCT workspace_id, name FROM members), r AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.workspace_id = b.workspace_id AND a.name IS NOT DISTINCT FROM b.name)) SELECT workspace_id, count(*) AS n FROM r GROUP BY 1",
    "sk10_versioned": "WITH x AS (SELECT *, doc_id % 3 = 0 AND doc_id % 2 = 0 AND version IS NOT NULL AS hit FROM documents), y AS (SELECT CASE WHEN hit THEN 'renamed' ELSE title END AS t, version + CAST(hit AS INT) AS v FROM x) SELECT t = 'renamed' AS renamed, count(*) AS n, CAST(sum(v) AS BIGINT) AS versions FROM y GROUP BY 1",
    "sk12_merged_members": "SELECT workspace_id, name, CAST(max(CASE role WHEN 'owner' THEN 3 WHEN 'admin' THEN 2 ELSE 1 END) AS INTEGER) AS level, CAST(min(joined_at) AS VARCHAR) AS joined, count(*) AS n FROM members GROUP BY 1, 2",
    "sk13_numbered": f"WITH {_I}, b AS (SELECT workspace_id, count(*) AS base FROM s WHERE key IS NOT NULL GROUP BY 1) SELECT item_id, row_number() OVER (PARTITION BY s.workspace_id ORDER BY created_at, item_id) + coalesce(base, 0) AS number FROM s LEFT JOIN b USING (workspace_id) WHERE coalesce(external_id, '') = ''",
    "sk11_label_changes": f"WITH {_I} SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(labels, []), lambda x: x <> 'bridge'), ['seen']))), ',') AS labels FROM s",
    "st1_found_everywhere": f"""WITH {_I} SELECT 'item' AS kind, count(*) AS n, count(DISTINCT item_id) AS ids FROM s WHERE contains(lower(coalesce(title, '')), 'sync') OR contains(lower(coalesce(description_md, '')), 'sync')
UNION ALL SELECT 'page', count(*), count(DISTINCT doc_id) FROM documents WHERE contains(lower(coalesce(text, '')), 'sync') UNION ALL SELECT 'comment', count(*), count(DISTINCT comment_id) FROM comments WHERE contains(lower(coalesce(body, '')), 'sync')""",
    "jn12_sync_plan": """WITH x AS (SELECT repo, path, snapshot_no, content_hash FROM facts_py QUALIFY row_number() OVER (PARTITION BY repo, path, snapshot_no ORDER BY extracted_at DESC, row_id DESC) = 1),
h AS (SELECT repo, snapshot_no, lead(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS nx FROM (SELECT DISTINCT repo, snapshot_no FROM x)),
o AS (SELECT x.repo, x.path, h.nx AS s, x.content_hash FROM x JOIN h USING (repo, snapshot_no) WHERE nx IS NOT NULL), f AS (SELECT x.repo, x.path, x.snapshot_no AS s, x.content_hash FROM x JOIN h ON h.repo = x.repo AND h.nx = x.snapshot_no)
SELECT repo, s AS snapshot_no, action, count(*) AS n FROM (SELECT coalesce(f.repo, o.repo) AS repo, coalesce(f.s, o.s) AS s, CASE WHEN f.repo IS NULL THEN 'deleted' WHEN f.content_hash = o.content_hash THEN 'unchanged' ELSE 'extract' END AS action FROM f FULL JOIN o ON f.repo = o.repo AND f.path = o.path AND f.s = o.s) GROUP BY 1, 2, 3""",
    "sk8_shed_rows": """WITH z AS (SELECT *, coalesce(list_sum(list_transform(calls, lambda x: length(coalesce(x.callee, '')) + length(coalesce(x.enclosing, '')) + 16)), 0) + coalesce(list_sum(list_transform(renders, lambda x: length(coalesce(x.component, '')) + length(coalesce(x.enclosing, '')) + 16)), 0)
  + coalesce(list_sum(list_transform(definitions, lambda x: length(coalesce(x.qualified_name, '')) + length(coalesce(x.signature, '')) + length(coalesce(x.docstring, '')) + 32)), 0) > 4000 AS big FROM facts_py)
SELECT big OR truncated AS truncated, count(*) AS n, CAST(sum(CASE WHEN big THEN 0 ELSE len(calls) END) AS BIGINT) AS calls, CAST(sum(CASE WHEN big THEN 0 ELSE len(renders) END) AS BIGINT) AS renders FROM z GROUP BY 1""",
    "fn22_flat_issues": """SELECT row_id, key, fields.status.name AS status, coalesce(fields.assignee.accountId, '') AS assignee, CAST(coalesce(len(fields.labels), 0) AS INTEGER) AS labels,
coalesce(CAST(epoch(coalesce(try_strptime(regexp_replace(fields.created, 'Z$', '+0000'), '%Y-%m-%dT%H:%M:%S.%g%z'), try_strptime(regexp_replace(fields.created, 'Z$', '+0000'), '%Y-%m-%dT%H:%M:%S%z'))) AS BIGINT), 0) AS created_s FROM sample_jira_tickets""",
    "ag3_group_sizes": "SELECT space_key, count(*) AS n, max(version) AS version, CAST(max(updated_at) AS VARCHAR) AS newest FROM documents GROUP BY 1",
    "sl12_budget_cut": "SELECT space_key, count(*) AS pages, CAST(max(used) AS BIGINT) AS used FROM (SELECT space_key, sum(coalesce(n_chars, 0)) OVER (PARTITION BY space_key ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) WHERE used <= 20000 GROUP BY 1",
}
