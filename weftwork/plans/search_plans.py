"""Queries on text and vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.functions.ids import containers, is_within
from weftwork.functions.web import safe_path
from weftwork.operators import codegraph as G
from weftwork.operators import incremental as I
from weftwork.operators import search as S
from weftwork.plans.board_plans import FOLD
from weftwork.plans.graph_plans import files
from weftwork.session import materialised
from weftwork.tables import table

#: The searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 20


def _code_nodes(spark, folder):
    s = G.symbols(files(spark, folder))
    return s.select("id", "name", F.lit(None).cast("string").alias("path"), F.col("path").alias("file_path"), "qualified_name", "signature", "docstring")


def rt2_keyword_score(spark, folder):
    """Definitions that hold words of a question, by boosted fields (RT2, RT3, FN1, SL5)."""
    return S.keyword_score(_code_nodes(spark, folder), ["scanner", "queue", "load"]).select("id", F.round("score", 6).alias("score"))


def rt1_bm25(spark, folder):
    """Pages by BM25 for three words, statistics over all pages (RT1)."""
    return S.bm25(table(spark, folder, "documents"), "doc_id", "text", ["folder", "cache", "tracker"]).select("doc_id", F.round("score", 6).alias("score"))


def _queries(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def rt5_nearest(spark, folder):
    """The 10 vectors closest to each query vector by cosine, exactly (RT4, RT5, SL7, JN16, PF12)."""
    n = S.nearest(_queries(spark, folder), table(spark, folder, "embeddings"), 10)
    return n.select("query_id", "vec_id", F.round("score", 6).alias("score"))


def rt6_above_threshold(spark, folder):
    """Those of the 10 closest that reach a score, other vectors only (RT6)."""
    n = S.nearest(_queries(spark, folder), table(spark, folder, "embeddings"), 11, least=0.15).filter("query_id <> vec_id")
    return n.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


def _lists(spark, folder):
    """Two rankings of vectors for each query: by cosine, and by the label they share (then by id)."""
    v = table(spark, folder, "embeddings")
    near = S.nearest(_queries(spark, folder), v, 20).filter("query_id <> vec_id").select("query_id", F.col("vec_id").alias("item_id"), "score", "rank")
    q = v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    w = Window.partitionBy("label").orderBy("vec_id")
    few = v.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("label", F.col("vec_id").alias("item_id"), F.col("r").alias("rank"))
    word = q.join(few, "label").select("query_id", "item_id", (F.lit(30.0) - F.col("rank")).alias("score"), "rank")
    return word, near


def rt10_reciprocal_rank(spark, folder):
    """Two rankings fused by reciprocal rank (RT10)."""
    f = S.reciprocal_rank(list(_lists(spark, folder)))
    return f.select("query_id", "item_id", F.round("score", 6).alias("score"))


def rt11_weighted(spark, folder):
    """Two rankings fused by weighted, scaled scores (RT11)."""
    f = S.weighted_fusion(*_lists(spark, folder), 0.3)
    return f.select("query_id", "item_id", F.round("score", 5).alias("score"))


def rt9_routed(spark, folder):
    """Two rankings merged by shares, the first leading (RT7, RT9, WN12)."""
    m = S.routed_merge(*_lists(spark, folder), True, 4, 1)
    return m.filter("place <= 10").select("query_id", "item_id", F.col("place").cast("int").alias("place"))


def rt5_index_recall(spark, folder):
    """How many of the 10 nearest that brute force finds the index finds too: at least nine of ten (RT5)."""
    q, v = _queries(spark, folder), table(spark, folder, "embeddings")
    exact = S.nearest(q, v, 10).select("query_id", "vec_id")
    hit = exact.join(S.indexed(q, v, 10).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").agg(F.count(F.lit(1)).alias("hit"))
    whole = exact.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"))
    return whole.withColumn("one", F.lit(1)).join(hit.withColumn("one", F.lit(1)), "one").select("queries", (F.col("hit") >= 0.9 * F.col("n")).alias("enough"))


def ag24_recall_mrr(spark, folder):
    """How well cosine ranks vectors of the query's label: recall at 5 and 10, mean reciprocal rank (AG24, RT16, WN15)."""
    v = table(spark, folder, "embeddings")
    near = S.nearest(_queries(spark, folder), v, 21).filter("query_id <> vec_id")
    ranked = near.select("query_id", F.col("vec_id").alias("item_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).alias("rank"))
    labels = v.select("vec_id", "label")
    q = v.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    # a query counts if any other vector has its label; only ranked rows are compared
    shared = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("label").alias("wanted"))
    q = q.join(shared, "wanted")
    hits = ranked.join(q, "query_id").join(labels.withColumnRenamed("vec_id", "item_id"), "item_id").filter("label = wanted").groupBy("query_id").agg(F.min("rank").alias("first"))
    return S.quality(q.select("query_id").join(hits, "query_id", "left"))


def rt7_routes(spark, folder):
    """How many texts name code, ask for the layout, or neither (RT7, RT8)."""
    d = table(spark, folder, "documents")
    first = F.regexp_extract(F.coalesce("title", F.lit("")), r"^([^\n]*)", 1)
    return d.select(F.when(X.code_question(first), "keyword").when(X.overview_question(first), "overview").otherwise("meaning").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def rt12_refresh_plan(spark, folder):
    """Which items need a new vector: the fingerprint kept with the first delivery of an item against that of its newest
    text; items without any text have none (RT12, FN9)."""
    s = table(spark, folder, "service")
    text = lambda: F.concat_ws("\n", "title", "description_md")
    fp = F.substring(F.sha2(text(), 256), 1, 16)
    first = I.newest(s, ["item_id"], [F.col("updated_at").asc_nulls_first(), F.asc("row_id")]).filter("description_md IS NOT NULL").select("item_id", fp.alias("had"))
    last = I.newest(s, ["item_id"], [F.col("updated_at").desc_nulls_last(), F.desc("row_id")]).filter(F.length(text()) > 0).select("item_id", fp.alias("fp"))
    plan = F.when(F.col("had").isNull(), "new").when(F.col("fp").isNull(), "gone").when(F.col("had") != F.col("fp"), "changed").otherwise("kept")
    return last.join(first, "item_id", "full_outer").select(plan.alias("plan")).groupBy("plan").agg(F.count(F.lit(1)).alias("n"))


def rt14_same_words(spark, folder):
    """Items whose text has the five longest words of another item's title: the words half of RT14.

    Titles of fewer than five words ask nothing. Equal questions are counted once, and an item doesn't count for its own."""
    from weftwork.plans.board_plans import items

    words = lambda c: F.array_distinct(F.filter(X.words(c), lambda w: F.length(w) > 2))
    longest = F.slice(F.array_sort(F.transform(words(F.col("title")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1, 5)
    s = items(spark, folder).filter("item_id IS NOT NULL").select(F.col("workspace_id").alias("scope"), "item_id", F.transform(longest, lambda x: x["w"]).alias("ws"), words(F.concat_ws(" ", "title", "description_md")).alias("words"))
    s = materialised(s)
    q = s.filter(F.size("ws") == 5).select("scope", "item_id", F.col("ws").alias("words"), (F.size(F.array_intersect("ws", "words")) == 5).cast("long").alias("own"))
    n = S.sets_with_all(q.select("scope", "words").distinct(), s.select("scope", F.col("item_id").alias("id"), "words"), 5)
    return q.join(n, ["scope", "words"]).select(F.col("item_id").alias("query_id"), (F.col("n") - F.col("own")).alias("n")).filter("n > 0")


def rt14_similar(spark, folder):
    """Vectors like every twentieth one by meaning, or by their number's last two digits as words, each once, meaning first, five
    at most (RT14, ST6): how many of either."""
    v = table(spark, folder, "embeddings")
    near = S.nearest(_queries(spark, folder), v, 6, least=0.1).filter("query_id <> vec_id").select("query_id", "vec_id", F.lit(0).alias("how"), F.col("rank").cast("long").alias("r"))
    q = _queries(spark, folder).select("query_id", (F.col("query_id") % 100).alias("w"))
    same = v.select("vec_id", (F.col("vec_id") % 100).alias("w"))
    w = Window.partitionBy("w").orderBy("vec_id")
    few = same.withColumn("r", F.row_number().over(w)).filter("r <= 6")
    word = q.join(few, "w").filter("query_id <> vec_id").select("query_id", "vec_id", F.lit(1).alias("how"), F.col("r").cast("long").alias("r"))
    first = near.unionByName(word).groupBy("query_id", "vec_id").agg(F.min(F.struct("how", "r")).alias("k"))
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "vec_id"))).filter("place <= 5")
    return kept.groupBy("query_id").agg(F.sum((F.col("k.how") == 0).cast("long")).alias("meaning"), F.sum((F.col("k.how") == 1).cast("long")).alias("words"))


def rt13_room(spark, folder):
    """Which vectors are dropped because another model made them, and which of the texts without one get room, of 40 a space, the
    newest first (RT13)."""
    d = table(spark, folder, "documents").filter("text IS NOT NULL")
    stored = d.filter("version > 5").select("doc_id", F.when(F.col("version") % 4 == 0, "old").otherwise("new").alias("model"))
    keep = stored.filter("model = 'new'")
    wanted = d.select("doc_id", "space_key", "updated_at").join(keep.select("doc_id"), "doc_id", "left_anti")
    held = d.join(keep.select("doc_id"), "doc_id", "left_semi").groupBy("space_key").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("space_key").orderBy(F.col("updated_at").desc_nulls_last(), "doc_id")
    ranked = wanted.withColumn("p", F.row_number().over(w)).filter("p <= 40")
    room = ranked.join(held.withColumnRenamed("space_key", "s"), ranked["space_key"].eqNullSafe(F.col("s")), "left").filter("p <= 40 - coalesce(held, 0)")
    purged = stored.filter("model = 'old'").join(d.select("doc_id", "space_key"), "doc_id").groupBy("space_key").agg(F.count(F.lit(1)).alias("n")).select("space_key", F.lit("purged").alias("what"), "n")
    return purged.unionByName(room.groupBy("space_key").agg(F.count(F.lit(1)).alias("n")).select("space_key", F.lit("embedded").alias("what"), "n"))


def sc10_line_hits(spark, folder):
    """Lines of excerpts that hold a term, 20 lines of an excerpt at most, and their best window (SC9, SC10, AG22, WN14, RT15)."""
    c = table(spark, folder, "context").select("block_id", F.posexplode("lines").alias("line_no", "line"))
    return S.best_windows(S.line_hits(c, ["block_id"], ["scanner", "queue", "return"]), ["block_id"]).select("block_id", "terms", "hits", "first_line", "last_line")


def fn10_redacted(spark, folder):
    """Excerpts with credential shapes replaced line by line, by how many lines changed (FN10, FN11)."""
    c = table(spark, folder, "context")
    out = X.redacted_lines(F.transform("lines", lambda x: F.coalesce(x, F.lit(""))))
    return c.select("block_id", F.size(F.filter(out, lambda x: F.contains(x, F.lit("[REDACTED]")))).alias("hidden"), F.size(out).alias("lines"))


def fn8_fingerprints(spark, folder):
    """Fingerprints of comments, unmoved by marks, spacing and case (FN8, FN9)."""
    c = table(spark, folder, "comments").filter("body IS NOT NULL")
    return c.select("row_id", X.fingerprint(F.col("body")).alias("fp"))


def fn12_route_paths(spark, folder):
    """Routes as declared and as compared (FN12, FN17)."""
    f = table(spark, folder, "facts_py").select(F.explode("routes").alias("r"))
    return f.select(F.col("r.path").alias("declared"), X.route_path(F.col("r.path")).alias("route")).distinct()


def fn1_identifier_words(spark, folder):
    """The words of every symbol name (FN1, FN2)."""
    s = G.symbols(files(spark, folder)).select("name").distinct()
    return s.select("name", F.array_join(X.identifier_words(F.col("name")), " ").alias("words"), X.scope_token(F.col("name")).alias("token"))


def fn4_stems(spark, folder):
    """Stems of the words of titles (FN4, FN5)."""
    d = table(spark, folder, "documents").select(F.explode(X.words(F.col("title"))).alias("word")).filter("length(word) > 2").distinct()
    return d.select("word", X.stem(F.col("word")).alias("stem"))


def fn44_clipped(spark, folder):
    """Titles on one line, without fence characters, cut at 20 and 40 characters (FN6, FN44)."""
    d = table(spark, folder, "documents").filter("title IS NOT NULL")
    return d.select("doc_id", X.cleaned(F.col("title"), 40).alias("clean"), X.clipped(F.col("title"), 20).alias("short"))


def gr13_within(spark, folder):
    """How many files lie in each folder 'app', by id arithmetic alone (GR13, GR12, PF9)."""
    f = files(spark, folder).select("repo", F.concat_ws(":", "repo", "path").alias("id"), F.element_at(containers(F.col("repo"), F.col("path")), 1).alias("nearest"))
    return f.filter(is_within(F.col("id"), F.concat(F.col("repo"), F.lit(":app")))).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("nearest").alias("folders"))


def fn40_test_paths(spark, folder):
    """Files for tests, files that are built, and paths that leave their folder when one is put before them, by repository
    (FN40, PF17)."""
    f = files(spark, folder)
    one = lambda c, n: F.sum(c.cast("long")).alias(n)
    up = F.when(F.length("path") % 7 == 0, F.concat(F.lit("../"), "path")).when(F.length("path") % 7 == 1, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    return f.groupBy("repo").agg(one(X.is_test_path(F.col("path")), "tests"), one(X.is_generated(F.col("path")), "built"), one(safe_path(up), "safe"), F.count(F.lit(1)).alias("n"))


def fn5_search_terms(spark, folder):
    """What is worth searching for in the title of every page (FN5)."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(X.search_terms(F.col("title")), " ").alias("terms"))


def fn3_escaped(spark, folder):
    """Titles with the marks of a search language made literal (FN3)."""
    return table(spark, folder, "documents").filter("title IS NOT NULL").select("doc_id", X.query_escaped(F.col("title")).alias("escaped"))


QUERIES = {f.__name__: f for f in (
    rt2_keyword_score, rt1_bm25, rt5_nearest, rt5_index_recall, rt6_above_threshold, rt10_reciprocal_rank, rt11_weighted, rt9_routed, ag24_recall_mrr, rt7_routes, rt12_refresh_plan, rt14_same_words, rt14_similar, rt13_room, sc10_line_hits, fn10_redacted, fn8_fingerprints, fn12_route_paths, fn1_identifier_words, fn4_stems, fn44_clipped, gr13_within, fn40_test_paths, fn5_search_terms, fn3_escaped,
)}

_COS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label AS ql, e AS qe FROM v WHERE vec_id % 20 = 0), n AS (SELECT query_id, vec_id, ql, label, list_cosine_similarity(qe, e) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qe, e), 12) DESC, vec_id) AS rank FROM q, v)"
_LISTS = f"{_COS}, nr AS (SELECT query_id, vec_id AS item_id, score, rank FROM n WHERE rank <= 20 AND query_id <> vec_id), fw AS (SELECT label, vec_id AS item_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM v), wd AS (SELECT query_id, item_id, 30.0::DOUBLE - rank AS score, rank FROM q JOIN fw ON fw.label = q.ql WHERE rank <= 20)"
_TOK = "list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace({x}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~#>|]', ' ', 'g'), '\s+', ' ', 'g'))"
_LONG = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')), lambda w: length(w) > 2)"
_TERMS = ("cache", "folder", "tracker")
_S = "s AS (SELECT * FROM service QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) = 1)"


def _words(x: str) -> str:
    """The words of an identifier, in SQL without looking behind: breaks are marked in four passes, each made twice."""
    y = "z"
    for p, r in (("([a-z0-9])([A-Z])", r"\1_\2"), ("([A-Z])([A-Z][a-z])", r"\1_\2"), ("([A-Za-z])([0-9])", r"\1_\2"), ("([0-9])([A-Za-z])", r"\1_\2")):
        for _ in range(2):
            y = f"regexp_replace({y}, '{p}', '{r}', 'g')"
    every = f"list_transform(flatten(list_transform(regexp_extract_all({x}, '[A-Za-z0-9_]+'), lambda z: list_concat([z], list_filter(string_split({y}, '_'), lambda p: p <> '')))), lambda v: lower(v))"
    return f"list_filter({every}, lambda v, i: list_position({every}, v) = i)"


def _sql_files() -> str:
    return "cf AS (SELECT f.* FROM facts_py f JOIN (SELECT repo, max(snapshot_no) AS s FROM facts_py GROUP BY repo) l ON f.repo = l.repo AND f.snapshot_no = l.s QUALIFY row_number() OVER (PARTITION BY f.repo, f.path ORDER BY extracted_at DESC, row_id DESC) = 1)"


SQL = {
    "rt1_bm25": "WITH d AS (SELECT doc_id, " + _TOK.format(x="text") + " AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))
    + " FROM d), s AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, " + ", ".join(f"sum(CAST(t{i} > 0 AS INT))::DOUBLE AS f{i}" for i in range(3)) + " FROM c) SELECT * FROM (SELECT doc_id, round("
    + " + ".join(f"ln(1 + (docs - f{i} + 0.5) / (f{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(3)) + ", 6) AS score FROM c, s) WHERE score > 0",
    "rt5_nearest": f"WITH {_COS} SELECT query_id, vec_id, round(score, 6) AS score FROM n WHERE rank <= 10",
    "rt6_above_threshold": f"WITH {_COS} SELECT query_id, count(*) AS n, round(max(score), 6) AS best FROM n WHERE rank <= 11 AND score >= 0.15 AND query_id <> vec_id GROUP BY 1",
    "rt10_reciprocal_rank": f"WITH {_LISTS} SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, item_id, rank FROM nr UNION ALL SELECT query_id, item_id, rank FROM wd) GROUP BY 1, 2",
    "rt11_weighted": f"WITH {_LISTS}, z AS (SELECT query_id, item_id, 0.3::DOUBLE * score / max(score) OVER (PARTITION BY query_id) AS s FROM wd UNION ALL SELECT query_id, item_id, (1 - 0.3::DOUBLE) * score FROM nr) SELECT query_id, item_id, round(sum(s), 5) AS score FROM z GROUP BY 1, 2",
    "rt9_routed": f"WITH {_LISTS}, z AS (SELECT query_id, item_id, CASE WHEN rank <= 4 THEN 0 ELSE 2 END AS turn, rank FROM wd UNION ALL SELECT query_id, item_id, CASE WHEN rank <= 1 THEN 1 ELSE 3 END, rank FROM nr), f AS (SELECT query_id, item_id, min(turn * 1000 + rank) AS k FROM z GROUP BY 1, 2) SELECT * FROM (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, item_id) AS INTEGER) AS place FROM f) WHERE place <= 10",
    "ag24_recall_mrr": f"WITH {_COS}, r AS (SELECT query_id, vec_id, ql = label AS good, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n WHERE rank <= 21 AND query_id <> vec_id), h AS (SELECT query_id, min(rank) AS f FROM r WHERE good GROUP BY 1), w AS (SELECT DISTINCT query_id FROM q JOIN v ON v.label = q.ql AND v.vec_id <> q.query_id) SELECT count(*) AS queries, round(avg(CASE WHEN f <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN f <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM w LEFT JOIN h USING (query_id)",
    "rt7_routes": r"""WITH t AS (SELECT regexp_extract(coalesce(title, ''), '^([^\n]*)', 1) AS x FROM documents), k AS (SELECT x, regexp_matches(x, '\b[a-z0-9]+(?:_[a-z0-9]+)+\b|\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b|`[^`\n]+`|@\w+|\w/\w|\b[\w\-]+\.[A-Za-z]{2,5}\b') AS code FROM t)
SELECT CASE WHEN code THEN 'keyword' WHEN regexp_matches(x, '(?i)\b(?:structur\w*|organi[sz]\w*|architecture|layout|laid out|overview|folders?)\b') THEN 'overview' ELSE 'meaning' END AS route, count(*) AS n FROM k GROUP BY 1""",
    "rt12_refresh_plan": f"""WITH {_S}, f AS (SELECT item_id, left(sha256(concat_ws(chr(10), title, description_md)), 16) AS had FROM (SELECT * FROM service QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY updated_at ASC NULLS FIRST, row_id) = 1) WHERE description_md IS NOT NULL),
l AS (SELECT item_id, left(sha256(concat_ws(chr(10), title, description_md)), 16) AS fp FROM s WHERE length(concat_ws(chr(10), title, description_md)) > 0)
SELECT CASE WHEN had IS NULL THEN 'new' WHEN fp IS NULL THEN 'gone' WHEN had <> fp THEN 'changed' ELSE 'kept' END AS plan, count(*) AS n FROM f FULL JOIN l USING (item_id) GROUP BY 1""",
    "rt5_index_recall": "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "fn1_identifier_words": f"WITH {_sql_files()}, n AS (SELECT DISTINCT d.name AS name FROM (SELECT unnest(definitions) AS d FROM cf)) SELECT name, array_to_string({_words('name')}, ' ') AS words, 'r' || left(sha256(name), 24) AS token FROM n",
    "rt2_keyword_score": f"""WITH {_sql_files()}, df AS (SELECT repo, path, pos, definitions[pos] AS d FROM (SELECT repo, path, definitions, unnest(range(1, len(definitions) + 1)) AS pos FROM cf)),
sy AS (SELECT repo || ':' || path || '#' || d.qualified_name || CASE WHEN o > 1 THEN '@' || o ELSE '' END AS id, path, d FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, d.qualified_name ORDER BY pos) AS o FROM df)),
w AS (SELECT id, {_words('d.name')} AS name, {_words('path')} AS file_path, {_words("coalesce(d.signature, '')")} AS signature, {_words("coalesce(d.docstring, '')")} AS docstring, {_words("concat_ws(' ', d.name, path, d.qualified_name)")} AS named FROM sy),
z AS (SELECT id, """ + " + ".join(f"CASE WHEN list_contains({f}, '{t}') THEN {b}::DOUBLE ELSE 0 END" for t in ("scanner", "queue", "load") for f, b in (("name", 4), ("file_path", 2), ("signature", 1), ("docstring", 0.5), ("named", 3)))
    + " + " + " + ".join(f"CASE WHEN len(list_filter(named, lambda x: starts_with(x, '{t}'))) > 0 THEN 0.5::DOUBLE ELSE 0 END" for t in ("scanner", "queue", "load")) + " AS score FROM w) SELECT id, score FROM z WHERE score > 0",
    "fn10_redacted": f"""WITH l AS (SELECT block_id, k, coalesce(lines[k], '') AS x FROM (SELECT block_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM context)),
m AS (SELECT *, regexp_matches(x, '-----BEGIN[A-Z ]*PRIVATE KEY-----') AS b, regexp_matches(x, '-----END[A-Z ]*PRIVATE KEY-----') AS e FROM l),
n AS (SELECT *, last_value(CASE WHEN e THEN 0 WHEN b THEN 1 END IGNORE NULLS) OVER (PARTITION BY block_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM m)
SELECT block_id, CAST(sum(CAST(b OR coalesce(inside, 0) = 1 OR contains(x, '[REDACTED]') OR {" OR ".join(f"regexp_matches(x, '{p}')" for p in X.CREDENTIAL_SHAPES[:8])}
  OR regexp_matches(x, '(?i)\\b(api[_-]?key|secret|token|password|passwd|credential)s?\\b(\\s*[:=]\\s*)("[^''"\\n]{{8,}}"|''[^''"\\n]{{8,}}'')') AS INT)) AS INTEGER) AS hidden, CAST(count(*) AS INTEGER) AS lines FROM n GROUP BY 1""",
    "rt14_similar": f"""WITH {_COS}, a AS (SELECT query_id, vec_id, 0 AS how, rank AS r FROM n WHERE rank <= 6 AND score >= 0.1 AND query_id <> vec_id), f AS (SELECT vec_id, vec_id % 100 AS w, row_number() OVER (PARTITION BY vec_id % 100 ORDER BY vec_id) AS r FROM v),
b AS (SELECT query_id, f.vec_id, 1 AS how, r FROM q JOIN f ON f.w = query_id % 100 WHERE r <= 6 AND query_id <> f.vec_id), m AS (SELECT query_id, vec_id, min(how * 100 + r) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, vec_id) AS p FROM m) SELECT query_id, CAST(sum(CAST(k < 100 AS INT)) AS BIGINT) AS meaning, CAST(sum(CAST(k >= 100 AS INT)) AS BIGINT) AS words FROM z WHERE p <= 5 GROUP BY 1""",
    "rt13_room": """WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, version % 4 = 0 AS old FROM d WHERE version > 5), k AS (SELECT doc_id FROM s WHERE NOT old), h AS (SELECT space_key, count(*) AS c FROM d WHERE doc_id IN (SELECT doc_id FROM k) GROUP BY 1),
r AS (SELECT space_key, row_number() OVER (PARTITION BY space_key ORDER BY updated_at DESC NULLS LAST, doc_id) AS p FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k))
SELECT space_key, 'purged' AS what, count(*) AS n FROM d WHERE doc_id IN (SELECT doc_id FROM s WHERE old) GROUP BY 1 UNION ALL SELECT r.space_key, 'embedded', count(*) FROM r LEFT JOIN h ON h.space_key IS NOT DISTINCT FROM r.space_key WHERE p <= 40 - coalesce(c, 0) GROUP BY 1""",
    "rt14_same_words": f"WITH {_S}, q AS (SELECT item_id AS query_id, workspace_id, list_slice(list_transform(list_sort(list_transform({_LONG.format(x='title')}, lambda w: struct_pack(l := -length(w), w := w))), lambda x: x.w), 1, 5) AS ws FROM s), b AS (SELECT item_id, workspace_id, {_LONG.format(x='concat_ws(chr(32), title, description_md)')} AS al FROM s) SELECT query_id, count(*) AS n FROM q JOIN b ON b.workspace_id = q.workspace_id AND b.item_id <> q.query_id AND len(ws) = 5 AND list_has_all(al, ws) GROUP BY 1",
    "sc10_line_hits": """WITH l AS (SELECT block_id, k - 1 AS line_no, lower(lines[k]) AS x FROM (SELECT block_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM context)), h AS (SELECT block_id, line_no, t AS term FROM l, (SELECT unnest(['scanner', 'queue', 'return']) AS t) WHERE contains(x, t)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY block_id ORDER BY line_no) AS d FROM h), g AS (SELECT *, count(*) OVER (PARTITION BY block_id ORDER BY line_no RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM r WHERE d <= 20)
SELECT block_id, count(DISTINCT term) AS terms, count(*) AS hits, CAST(greatest(arg_max(line_no, struct_pack(a := near, b := -line_no)) - 12, 1) AS INTEGER) AS first_line, CAST(arg_max(line_no, struct_pack(a := near, b := -line_no)) + 12 AS INTEGER) AS last_line FROM g GROUP BY 1""",
    "fn8_fingerprints": f"SELECT row_id, left(sha256({FOLD.format(x='body')}), 16) AS fp FROM comments WHERE body IS NOT NULL",
    "fn12_route_paths": r"""WITH t AS (SELECT DISTINCT unnest(list_transform(routes, lambda r: r.path)) AS declared FROM facts_py), q AS (SELECT declared, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(declared), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '[{][^/}]*[}]|:[^/]+|\[[^/\]]*\]', '*', 'g'), '/{2,}', '/', 'g'), '/+$', '') AS q FROM t)
SELECT declared, CASE WHEN q = '' THEN '/' WHEN starts_with(q, '/') THEN q ELSE '/' || q END AS route FROM q""",
    "fn4_stems": """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{M}\\p{N}_]+')) AS word FROM documents) WHERE length(word) > 2),
x AS (SELECT word, CASE WHEN word LIKE '%ing' AND length(word) >= 7 THEN left(word, length(word) - 3) WHEN word LIKE '%ed' AND NOT (word LIKE '%ing') AND length(word) >= 6 THEN left(word, length(word) - 2) END AS b FROM w)
SELECT word, CASE WHEN b IS NOT NULL THEN CASE WHEN length(b) > 3 AND b[-1] = b[-2] THEN left(b, length(b) - 1) ELSE b END WHEN length(word) > 4 AND word LIKE '%s' AND NOT word LIKE '%ss' THEN left(word, length(word) - 1) ELSE word END AS stem FROM x""",
    "fn44_clipped": r"SELECT doc_id, left(translate(trim(regexp_replace(title, '\s+', ' ', 'g')), '<>[]', '‹›()'), 40) AS clean, CASE WHEN length(title) > 20 THEN left(title, 19) || '…' ELSE title END AS short FROM documents WHERE title IS NOT NULL",
    "gr13_within": f"WITH {_sql_files()} SELECT repo, count(*) AS n, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS folders FROM cf WHERE starts_with(path, 'app/') GROUP BY 1",
    "fn40_test_paths": f"""WITH {_sql_files()}, u AS (SELECT repo, path, CASE length(path) % 7 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path ELSE path END AS up FROM cf)
SELECT repo, CAST(sum(CAST(regexp_matches(path, '(^|/)({"|".join(X.TEST_FOLDERS)})/') OR regexp_matches(path, '{X.TEST_FILE}') AS INT)) AS BIGINT) AS tests, CAST(sum(CAST({" OR ".join(f"ends_with(path, '{x}')" for x in X.GENERATED_SUFFIXES)} AS INT)) AS BIGINT) AS built,
  CAST(sum(CAST(NOT starts_with(up, '/') AND NOT list_contains(string_split(up, '/'), '..') AS INT)) AS BIGINT) AS safe, count(*) AS n FROM u GROUP BY 1""",
    "fn3_escaped": r"""SELECT doc_id, regexp_replace(title, '([+\-&|!(){}\[\]^"~*?:\\/])', '\\\1', 'g') AS escaped FROM documents WHERE title IS NOT NULL""",
    "fn5_search_terms": f"""WITH w AS (SELECT doc_id, k, trim(t, '_') AS w FROM (SELECT doc_id, unnest(x) AS t, unnest(range(0, len(x))) AS k FROM (SELECT doc_id, regexp_extract_all(coalesce(title, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS x FROM documents))),
v AS (SELECT *, CASE WHEN lower(w) LIKE '%ing' THEN length(w) - 3 WHEN lower(w) LIKE '%ed' THEN length(w) - 2 END AS n FROM w WHERE length(w) >= 3 AND lower(w) NOT IN ({", ".join(f"'{x}'" for x in X.STOPWORDS)})),
s AS (SELECT *, CASE WHEN n > 3 THEN CASE WHEN left(w, n)[-1] = left(w, n)[-2] THEN left(w, n - 1) ELSE left(w, n) END WHEN length(w) > 4 AND lower(w) LIKE '%s' AND NOT lower(w) LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS st FROM v),
f AS (SELECT doc_id, k * 2 + 1 AS k, st AS f FROM s UNION ALL SELECT doc_id, k * 2, w FROM s WHERE contains(w, '_') OR regexp_matches(substr(w, 2), '[A-Z]')), g AS (SELECT doc_id, f, min(k) AS k FROM f GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS rn FROM g) SELECT d.doc_id, coalesce(string_agg(f, ' ' ORDER BY k), '') AS terms FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rn <= 8 GROUP BY 1""",
}
