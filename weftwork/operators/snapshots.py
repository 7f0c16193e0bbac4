"""What changed between full snapshots of a table.

Keys get persistent ordinals: a stored dictionary is read before a delivery and extended after it, so that a key keeps its
ordinal over all of them. A block holds BLOCK consecutive ordinals; for each snapshot the block has one compressed bitmap of
the ordinals present and one aligned vector of value hashes. AND-NOT of neighbouring bitmaps gives additions and removals,
their AND with unequal vectors gives changes. A block is at most BLOCK keys times the snapshots, so tasks stay bounded
whatever the table, and no key is hot after the newest row of each (key, snapshot) is chosen. Keys travel with their block,
so that the dictionary isn't joined again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.bitmaps import and_not, both, compressed
from weftwork.operators.ordinals import extend_dictionary, stored_dictionary
from weftwork.session import broadcast_if_small, materialised

#: Ordinals in a block.
BLOCK = 1 << 14
KINDS = ("added", "removed", "changed")


def newest_per_snapshot(rows: DataFrame) -> DataFrame:
    """Of the rows of one record in one snapshot, the latest counts; of equal times, the one with the larger row id."""
    w = Window.partitionBy("scope", "record_key", "snapshot_no").orderBy(F.col("at").desc_nulls_last(), F.col("row_id").desc_nulls_last())
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "at", "row_id")


def _block_changes(batch: pa.Table) -> pa.Table:
    """Of one block: scope, record_key, snapshot_no (the later one) and kind of every change.

    batch: ordinal, scope, record_key, had (snapshots of the scope, in order), seen, high, low (parallel lists: the
    snapshots that hold the key, and the two halves of its values' hashes)."""
    low_of = batch["ordinal"].to_numpy() % BLOCK
    row_at = np.zeros(BLOCK, np.int64)
    row_at[low_of] = np.arange(batch.num_rows)
    had = batch["had"].combine_chunks().to_pylist()
    seen, high, low = (batch[c].combine_chunks() for c in ("seen", "high", "low"))
    sizes = np.diff(seen.offsets.to_numpy())
    rows = np.repeat(np.arange(batch.num_rows), sizes)
    numbers, high, low = seen.flatten().to_numpy(), high.flatten().to_numpy(), low.flatten().to_numpy()
    # the place of each snapshot among those of its scope; a block holds few scopes
    places: dict[tuple[int, ...], dict[int, int]] = {}
    orders = [places.setdefault(tuple(h), {n: i for i, n in enumerate(h)}) for h in had]
    seq = np.fromiter((orders[r][n] for r, n in zip(rows.tolist(), numbers.tolist())), np.int64, rows.size)
    reach = np.full(BLOCK, -1, np.int64)
    reach[low_of] = [len(h) - 1 for h in had]
    order = np.argsort(seq, kind="stable")
    seq, at, high, low = seq[order], low_of[rows[order]], high[order], low[order]
    cuts = np.searchsorted(seq, np.arange(int(reach.max(initial=-1)) + 2))
    found: list[tuple[np.ndarray, int, int]] = []
    before, before_high, before_low = compressed(np.zeros(0, np.int64), BLOCK), None, None
    for s in range(int(reach.max(initial=-1)) + 1):
        part = slice(cuts[s], cuts[s + 1])
        now, now_high, now_low = compressed(at[part], BLOCK), np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
        now_high[at[part]], now_low[at[part]] = high[part], low[part]
        if s:
            gone, common = and_not(before, now), both(before, now)
            unlike = (now_high[common] != before_high[common]) | (now_low[common] != before_low[common])
            for kind, hit in ((0, and_not(now, before)), (1, gone[reach[gone] >= s]), (2, common[unlike])):
                if hit.size:
                    found.append((row_at[hit], s, kind))
        before, before_high, before_low = now, now_high, now_low
    hits = np.concatenate([h for h, _, _ in found]) if found else np.zeros(0, np.int64)
    at_seq = np.concatenate([np.full(h.size, s) for h, s, _ in found]) if found else np.zeros(0, np.int64)
    kinds = np.concatenate([np.full(h.size, k) for h, _, k in found]) if found else np.zeros(0, np.int64)
    take = pa.array(hits)
    return pa.table({
        "scope": batch["scope"].take(take), "record_key": batch["record_key"].take(take),
        "snapshot_no": pa.array([had[r][s] for r, s in zip(hits.tolist(), at_seq.tolist())], pa.int32()), "kind": pa.array(kinds, pa.int32()),
    })


def snapshot_changes(rows: DataFrame, store: str | None = None) -> DataFrame:
    """Added, removed and changed records of each pair of consecutive snapshots.

    rows: scope, record_key, snapshot_no, at, row_id, high, low (the 128 bits of the value's hash). Snapshots are ordered
    within a scope; the one before is the last that the scope has. Result: scope, record_key, snapshot_no (the later one),
    change_kind. A first snapshot changes nothing. Rows with a null snapshot_no are no delivery and are ignored; a null key
    is a key. An empty table gives no rows. With `store`, a folder, ordinals are read from there and new ones added.
    """
    rows = rows.select(F.coalesce("scope", F.lit("")).alias("scope"), "record_key", F.col("snapshot_no").cast("int").alias("snapshot_no"), "at", "row_id", "high", "low")
    rows = materialised(newest_per_snapshot(rows.filter("snapshot_no IS NOT NULL")))
    had = rows.groupBy("scope", "snapshot_no").agg(F.lit(1).alias("one")).groupBy("scope").agg(F.array_sort(F.collect_list("snapshot_no")).alias("had"))
    seen = F.array_sort(F.collect_list(F.struct("snapshot_no", "high", "low")))
    keys = rows.groupBy("scope", "record_key").agg(seen.alias("h"))
    keys = keys.select("scope", "record_key", F.col("h.snapshot_no").alias("seen"), F.col("h.high").alias("high"), F.col("h.low").alias("low"))
    key = ["scope", "record_key"]
    numbered = extend_dictionary(keys, key) if store is None else stored_dictionary(keys, key, store)
    blocks = numbered.join(broadcast_if_small(had), "scope").withColumn("block", F.shiftright("ordinal", 14))
    changes = blocks.groupBy("block").applyInArrow(_block_changes, "scope string, record_key string, snapshot_no int, kind int")
    return changes.select("scope", "record_key", "snapshot_no", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("change_kind"))


def _fold(value: str | None) -> str:
    """One Unicode form and single spaces; null equals empty."""
    if not value:
        return ""
    import unicodedata

    return " ".join(value.split() if value.isascii() else unicodedata.normalize("NFC", value).split())


def folded_hash(columns: list[Column], label_set: Column | None = None) -> Column:
    """struct<high, low>: 128 bits of texts, that ignore spacing, Unicode form, null against empty, and the order of
    label_set. Texts in ASCII are folded in Spark; the others go to Python."""
    sep, none = "\x1f", F.array().cast("array<string>")
    fold = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\s\x1c-\x1f]+", " "), "^ | $", "")
    text = F.concat_ws(sep, *[fold(c.cast("string")) for c in columns])
    tags = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(label_set, none), fold), lambda x: x != ""))), "\x1e") if label_set is not None else F.lit("")
    whole = F.concat(text, F.lit("\x1d"), tags)

    @F.pandas_udf("string")
    def canonical(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if v is None:
                out.append(None)
                continue
            fields, _, labels = v.partition("\x1d")
            tag = sorted({x for x in map(_fold, labels.split("\x1e")) if x})
            out.append(sep.join(map(_fold, fields.split(sep))) + "\x1d" + "\x1e".join(tag))
        return pd.Series(out, dtype=object)

    plain = F.when(~whole.rlike(r"[^\x00-\x7F]"), whole)
    known = F.coalesce(plain, canonical(F.when(plain.isNull(), whole)))
    return hashed(known)


def hashed(text: Column) -> Column:
    """struct<high, low>: 128 bits of a text's SHA-256."""
    digest = F.sha2(text, 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return F.struct(half(1).alias("high"), half(16).alias("low"))


def ticket_snapshots(tickets: DataFrame) -> DataFrame:
    """sample_jira_tickets as rows of snapshot_changes. The record key is the id; extra columns are ignored."""
    f = "fields."
    value = folded_hash(
        [F.col("key"), F.col(f + "summary"), F.col(f + "status.name"), F.col(f + "assignee.accountId"), F.col(f + "priority.name"), F.col(f + "issuetype.name"), F.col(f + "duedate")],
        F.col(f + "labels"),
    )
    return tickets.select(F.lit("").alias("scope"), F.col("id").alias("record_key"), "snapshot_no", F.col("synced_at").alias("at"), "row_id", value.alias("v")).select("*", "v.high", "v.low").drop("v")


def file_snapshots(facts: DataFrame) -> DataFrame:
    """facts_py as rows of snapshot_changes. Snapshots belong to a repository; the record key is repo:path."""
    return facts.select(
        F.col("repo").alias("scope"),
        F.concat(F.coalesce("repo", F.lit("")), F.lit(":"), F.coalesce("path", F.lit(""))).alias("record_key"),
        "snapshot_no", F.col("extracted_at").alias("at"), "row_id", hashed(F.coalesce("content_hash", F.lit(""))).alias("v"),
    ).select("*", "v.high", "v.low").drop("v")
