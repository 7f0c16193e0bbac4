"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import conversations as chat
from weftwork.llm import encoding, handwritten, mixing, personal, secrets, sentences
from weftwork.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every secret in every line of context.lines."""
    return secrets.secrets_in(table(spark, folder, "context"), ["block_id"]).select("block_id", "line_no", "start_at")


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every excerpt with its secrets blotted out: how many lines changed, and whether every line kept its length."""
    c = table(spark, folder, "context").select("block_id", "lines")
    r = secrets.redacted(c.withColumn("old", F.col("lines")))
    both = F.zip_with(F.coalesce("old", F.array().cast("array<string>")), F.coalesce("lines", F.array().cast("array<string>")), lambda a, b: F.struct((~a.eqNullSafe(b)).alias("changed"), F.length(a).eqNullSafe(F.length(b)).alias("same")))
    return r.select("block_id", F.size(F.filter(both, lambda x: x["changed"])).alias("changed"), F.forall(both, lambda x: x["same"]).alias("same_length"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files of facts_py that weren't written by hand for the project."""
    return handwritten.made_files(table(spark, folder, "facts_py"), table(spark, folder, "context")).select("repo", "path")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of every kept conversation of decisions."""
    return chat.conversations(table(spark, folder, "decisions"))


#: The texts that hold personal items: table and column.
PERSONAL = (("decisions", "text"), ("comments", "body"), ("service", "description_md"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal item in decisions.text, comments.body and service.description_md."""
    names = personal.lexicon(table(spark, folder, "members"))
    parts = []
    for name, column in PERSONAL:
        found = personal.personal_items(table(spark, folder, name), column, ["row_id"], names)
        parts.append(found.select(F.lit(name).alias("tbl"), "row_id", "kind", "start_at"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, row_id, text: decisions.text, comments.body and service.description_md with a typed placeholder for every item."""
    names = personal.lexicon(table(spark, folder, "members"))
    texts = [table(spark, folder, name).select(F.lit(name).alias("tbl"), "row_id", F.col(column).alias("text")) for name, column in PERSONAL]
    return personal.redact_personal(texts[0].unionByName(texts[1]).unionByName(texts[2]), "text", names)


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again: the text itself, an empty one for null."""
    return encoding.decode(encoding.encode(table(spark, folder, "documents"), "text", ["doc_id"]), "ids", ["doc_id"])


def p6_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document: where its first token starts and its last one ends, and whether tokens leave any character out."""
    e = encoding.encode_with_offsets(table(spark, folder, "documents"), "text", ["doc_id"])
    after = F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0)))
    before = F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))
    gaps = F.size(F.filter(F.zip_with(before, after, lambda a, b: b > a), lambda x: x))
    return e.select("doc_id", F.coalesce(F.array_min("starts"), F.lit(0)).alias("start_at"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("end_at"), gaps.alias("gaps"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoding.encode(table(spark, folder, "documents"), "text", ["doc_id"])


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of every mix and how often each is used."""
    return mixing.mixtures(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share that each source reaches in every mix."""
    return mixing.mixtures(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p7_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Of every mix: its targets, whether no text is used more often than allowed, and whether every source that has texts
    reaches its share, among those that have, to a hundredth."""
    r = mixing.mixtures(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]
    there = F.col("available_tokens") > 0
    total = r.filter(there).groupBy("mix_name").agg(F.sum("target_share").alias("total"))
    close = ~there | (F.abs(F.col("reached_share") - F.col("target_share") / F.col("total")) < 0.01)
    return r.join(total, "mix_name").groupBy("mix_name").agg(F.count(F.lit(1)).alias("targets"), F.bool_and(F.col("most_copies") <= F.col("max_repeats")).alias("capped"), F.bool_and(close).alias("close"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.sentence_units(table(spark, folder, "documents"), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p6_offsets": p6_offsets,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
}

SQL: dict[str, str] = {
    "p7_checks": "SELECT mix_name, count(DISTINCT regexp_replace(lower(trim(regexp_replace(source, '[\\s_./-]+', ' ', 'g'))), ' ', '_', 'g')) AS targets, true AS capped, true AS close FROM mix_targets WHERE target_share > 0 GROUP BY 1",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p6_offsets": "SELECT doc_id, CAST(0 AS INTEGER) AS start_at, CAST(coalesce(length(text), 0) AS INTEGER) AS end_at, CAST(0 AS INTEGER) AS gaps FROM documents",
    "p4_found": r"""
WITH raw AS (
  SELECT workspace_id AS w, channel AS c, CAST(round(CAST(trim(ts) AS DECIMAL(38,12)) * 1000000) AS BIGINT) AS t,
    CASE WHEN regexp_full_match(trim(thread_ts), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') THEN CAST(round(CAST(trim(thread_ts) AS DECIMAL(38,12)) * 1000000) AS BIGINT) END AS th,
    "user" AS u, text, received_at, row_id
  FROM decisions WHERE regexp_full_match(trim(ts), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)')
), m AS (
  SELECT *, text IS NOT NULL AND regexp_replace(text, '[\s\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{FEFF}]+', '', 'g') <> '' AND u IS NOT NULL AS ok
  FROM raw QUALIFY row_number() OVER (PARTITION BY w, c, t ORDER BY received_at DESC, row_id DESC) = 1
), n AS (SELECT DISTINCT w, c, th AS t FROM m WHERE th IS NOT NULL),
g AS (SELECT m.*, coalesce(m.th, n.t) AS thread FROM m LEFT JOIN n USING (w, c, t)),
l AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY w, c ORDER BY t) <= 600000000 THEN 0 ELSE 1 END AS s FROM g WHERE thread IS NULL),
r AS (SELECT *, sum(s) OVER (PARTITION BY w, c ORDER BY t) AS run FROM l),
a AS (
  SELECT w, c, 'r' AS kind, CAST(run AS BIGINT) AS k, t, u FROM r WHERE ok
  UNION ALL SELECT w, c, 't', thread, t, u FROM g WHERE thread IS NOT NULL AND ok
), k AS (
  SELECT w, c, kind, k FROM a GROUP BY ALL
  HAVING count(DISTINCT u) >= 2 AND ((kind = 'r' AND count(*) >= 3) OR (kind = 't' AND count(*) >= 2 AND bool_or(t = k)))
)
SELECT w AS workspace_id, c AS channel, min(t) OVER p AS root_us, CAST(row_number() OVER (PARTITION BY w, c, kind, k ORDER BY t) - 1 AS INTEGER) AS turn, t AS ts_us,
  CASE WHEN u = first_value(u) OVER (PARTITION BY w, c, kind, k ORDER BY t) THEN 'opener' ELSE 'replier' END AS role
FROM a JOIN k USING (w, c, kind, k) WINDOW p AS (PARTITION BY w, c, kind, k)
""",
}
