"""Queries on changes between snapshots (problem 3) and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.operators.ordinals import stored_dictionary
from weftwork.operators.snapshots import file_snapshots, snapshot_changes, ticket_snapshots
from weftwork.session import shared_folder
from weftwork.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """tbl, snapshot_no, record_key, change_kind of all consecutive snapshots of tickets and files."""
    out = "tbl", "snapshot_no", "record_key", "change_kind"
    tickets = snapshot_changes(ticket_snapshots(table(spark, folder, "sample_jira_tickets"))).withColumn("tbl", F.lit("sample_jira_tickets"))
    files = snapshot_changes(file_snapshots(table(spark, folder, "facts_py"))).withColumn("tbl", F.lit("facts_py"))
    return tickets.select(*out).unionByName(files.select(*out))


def p3_ordinals(spark: SparkSession, folder: str) -> DataFrame:
    """Ordinals of ticket ids stored with the first three deliveries and extended by the others: how many keys the
    dictionary held before, how many after, and how many of the old ones have another ordinal now (none)."""
    store = f"{shared_folder(spark)}/ordinals-{uuid.uuid4().hex}"
    ids = table(spark, folder, "sample_jira_tickets").filter("snapshot_no IS NOT NULL")
    early = stored_dictionary(ids.filter("snapshot_no <= 3").select("id").distinct(), ["id"], store).select("id", F.col("ordinal").alias("old"))
    late = stored_dictionary(ids.select("id").distinct(), ["id"], store)
    j = late.join(early.withColumn("known", F.lit(1)), late["id"].eqNullSafe(early["id"]), "left")
    return j.agg(F.count("known").alias("before"), F.count(F.lit(1)).alias("after"), F.coalesce(F.sum((F.col("old") != F.col("ordinal")).cast("long")), F.lit(0)).alias("moved"), (F.max("ordinal") + 1).alias("dense"))


QUERIES = {"p3_found": p3_found, "p3_ordinals": p3_ordinals}

_SPACES = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{001C}-\x{001F}]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(nfc_normalize(coalesce({x}, '')), '{_SPACES}', ' ', 'g'))"


SQL = {
    "p3_ordinals": "SELECT count(DISTINCT CASE WHEN snapshot_no <= 3 THEN id END) AS before, count(DISTINCT id) AS after, CAST(0 AS BIGINT) AS moved, count(DISTINCT id) AS dense FROM sample_jira_tickets WHERE snapshot_no IS NOT NULL",
    "p3_found": f"""
WITH t AS (
  SELECT 'sample_jira_tickets' AS tbl, '' AS scope, id AS k, snapshot_no AS s, synced_at AS tm, row_id,
    concat_ws('|', {_clean('key')}, {_clean('fields.summary')}, {_clean('fields.status.name')}, {_clean('fields.assignee.accountId')},
      {_clean('fields.priority.name')}, {_clean('fields.issuetype.name')}, {_clean('fields.duedate')},
      list_sort(list_filter(list_distinct(list_transform(coalesce(fields.labels, []), lambda x: {_clean('x')})), lambda x: x <> ''))::VARCHAR) AS v
  FROM sample_jira_tickets
  UNION ALL
  SELECT 'facts_py', repo, repo || ':' || path, snapshot_no, extracted_at, row_id, coalesce(content_hash, '') FROM facts_py
), d AS (
  SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY tbl, scope, k, s ORDER BY tm DESC, row_id DESC) = 1
), o AS (
  SELECT tbl, scope, s, lead(s) OVER (PARTITION BY tbl, scope ORDER BY s) AS nxt FROM (SELECT DISTINCT tbl, scope, s FROM d)
), a AS (SELECT d.*, o.nxt FROM d JOIN o USING (tbl, scope, s)),
p AS (
  SELECT a.tbl, a.scope, a.k, a.nxt AS s, a.v FROM a WHERE a.nxt IS NOT NULL
), c AS (
  SELECT d.* FROM d JOIN o ON o.tbl = d.tbl AND o.scope = d.scope AND o.nxt = d.s
)
SELECT coalesce(c.tbl, p.tbl) AS tbl, coalesce(c.s, p.s) AS snapshot_no, coalesce(c.k, p.k) AS record_key,
  CASE WHEN p.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM c FULL JOIN p ON c.tbl = p.tbl AND c.scope = p.scope AND c.k = p.k AND c.s = p.s
WHERE p.k IS NULL OR c.k IS NULL OR c.v <> p.v
""",
}
