from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftwork.operators import bitmaps as B
from weftwork.operators import ordinals as O
from weftwork.operators import snapshots as S

PLACES = st.one_of(st.sets(st.integers(0, 1023), max_size=300), st.tuples(st.integers(0, 900), st.integers(0, 120)).map(lambda x: set(range(x[0], x[0] + x[1]))), st.sets(st.integers(0, 1023), min_size=700))


@settings(max_examples=150, deadline=None)
@given(PLACES, PLACES)
def test_compressed_bitmaps_are_sets(a, b):
    x, y = (B.compressed(np.array(sorted(s), np.int64), 1024) for s in (a, b))
    assert set(B.places_of(x).tolist()) == a
    assert set(B.and_not(x, y).tolist()) == a - b and set(B.both(x, y).tolist()) == a & b


def test_every_form_of_bitmap_occurs():
    kinds = {B.compressed(np.array(p), 1024)[0] for p in ([5, 9, 700], list(range(200)), list(range(0, 1024, 2)))}
    assert kinds == {"places", "runs", "bits"}


def brute(rows):
    newest = {}
    for scope, key, n, at, rid, value in rows:
        if n is None:
            continue
        k = (scope or "", key, n)
        if k not in newest or (at, rid) > newest[k][0]:
            newest[k] = ((at, rid), value)
    out = []
    for scope in {k[0] for k in newest}:
        had = sorted({k[2] for k in newest if k[0] == scope})
        for a, b in zip(had, had[1:]):
            for key in {k[1] for k in newest if k[0] == scope}:
                x, y = newest.get((scope, key, a)), newest.get((scope, key, b))
                kind = "added" if y and not x else "removed" if x and not y else "changed" if x and y and x[1] != y[1] else None
                if kind:
                    out.append((scope, key, b, kind))
    return sorted(out, key=str)


def test_changes_against_brute_force_and_a_stored_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 1 << 14)
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *(f"k{i}" for i in range(60))]), r.choice([1, 2, 4, None]), r.randint(0, 3), i, r.choice([None, 0, 1, 2])) for i in range(700)]
    df = spark.createDataFrame(rows, "scope string, record_key string, snapshot_no int, at long, row_id long, value long")
    df = df.selectExpr("scope", "record_key", "snapshot_no", "at", "row_id", "coalesce(value, -1) AS high", "0L AS low", "value AS extra")
    want = brute([(*x[:5], -1 if x[5] is None else x[5]) for x in rows])
    assert sorted(map(tuple, S.snapshot_changes(df).collect()), key=str) == want and {x[3] for x in want} == {"added", "removed", "changed"}
    store = str(tmp_path / "store")
    early = df.filter("snapshot_no <= 2")
    assert sorted(map(tuple, S.snapshot_changes(early, store).collect()), key=str) == brute([x for x in rows if x[2] in (1, 2)] and [(*x[:5], -1 if x[5] is None else x[5]) for x in rows if x[2] in (1, 2)])
    before = {(x["scope"], x["record_key"]): x["ordinal"] for x in spark.read.parquet(*O.segments(spark, store)).collect()}
    assert sorted(map(tuple, S.snapshot_changes(df, store).collect()), key=str) == want
    after = {(x["scope"], x["record_key"]): x["ordinal"] for x in spark.read.parquet(*O.segments(spark, store)).collect()}
    assert len(O.segments(spark, store)) == 2 and all(after[k] == v for k, v in before.items())
    assert sorted(after.values()) == list(range(len(after))) and len(after) >= len(before)
    assert S.snapshot_changes(df.filter("row_id < 0")).count() == 0


def test_tickets_differ_by_content_only(spark):
    f = "struct<summary:string,status:struct<name:string>,assignee:struct<accountId:string>,priority:struct<name:string>,issuetype:struct<name:string>,labels:array<string>,duedate:string>"
    def one(rid, n, summary, labels=("b", "a"), due=None):
        return (rid, n, "id1", "K-1", (summary, ("Open",), None, ("High",), ("Bug",), list(labels), due), rid)
    rows = [one(1, 1, "Größe  passt "), one(2, 2, "Größe passt", ("a", "b", "a")), one(3, 3, "Größe passt", ("a", "b"), ""), one(4, 4, "Größe passt nicht")]
    df = spark.createDataFrame(rows, f"row_id long, snapshot_no int, id string, key string, fields {f}, synced_at long")
    assert [tuple(r) for r in S.snapshot_changes(S.ticket_snapshots(df)).collect()] == [("", "id1", 4, "changed")]
