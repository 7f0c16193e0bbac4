from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

from weftwork.plans import stream_plans
from weftwork.streaming import chat


def brute(rows):
    """Channels' messages in the order of time, judged by hand: quiet 900 s, longest wait 7200 s, 3 messages of 2 people."""
    out = {}
    for place in {r[:2] for r in rows}:
        open_ = []

        def due(now, place=place):
            nonlocal open_
            if not open_:
                return
            talk = len(open_) >= 3 and len({u for _, u in open_ if u}) >= 2
            quiet, waited = now - open_[-1][0] >= 900, now - open_[0][0] >= 7200
            what = "read" if talk and (quiet or waited) else "settled" if quiet else None
            if what:
                n, m = out.get((*place, what), (0, 0))
                out[*place, what] = (n + 1, m + len(open_))
                open_ = []

        for t, u in sorted(((r[2], r[3]) for r in rows if r[:2] == place), key=lambda x: (x[0], x[1] or "")):
            due(t)
            open_.append((t, u))
        due(10**12)
    return out


def test_conversations_are_due_whatever_the_batches(spark, tmp_path):
    r, rows, t = random.Random(2), [], 1_700_000_000
    for _ in range(600):
        t += r.choice([5, 100, 899, 900, 2000])
        rows.append(("w", r.choice("abc"), t, r.choice(["u1", "u2", "u3", None])))
    want = brute(rows)
    # more speakers than any cap, then two long talks that never go quiet
    rows += [("w", "many", 1_700_000_000 + 60 * i, f"u{i}") for i in range(200)]
    want = brute(rows)
    for parts in (1, 5):
        folder = tmp_path / f"p{parts}"
        (folder / "decisions.parquet").mkdir(parents=True)
        ordered = sorted(rows, key=lambda x: x[2])
        for k in range(parts):
            some = ordered[k * len(rows) // parts : (k + 1) * len(rows) // parts]
            w, c, ts, u = zip(*some)
            pq.write_table(pa.table({"workspace_id": w, "channel": c, "ts": [f"{x}.000000" for x in ts], "user": u}), folder / f"decisions.parquet/part-{k}.parquet")
        got = {(x["workspace_id"], x["channel"], x["what"]): (x["times"], x["messages"]) for x in stream_plans.sm6_stream_ready(spark, str(folder)).collect()}
        assert got == want
    assert want["w", "many", "read"][0] > 1


def test_segments_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 3, "z")], "k string, at int, text string")
    for n in (0, 1, 1):
        (df if n == 0 else df.filter("at > 1")).write.mode("overwrite").parquet(str(tmp_path / f"t/segment={n}"))
    got = chat.stored(spark, str(tmp_path / "t"), ["k"], ["at"], df.schema)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2, None), ("b", 1, "y"), (None, 3, "z")], key=str)
    path = chat.compacted(spark, str(tmp_path / "t"), ["k"], ["at"], df.schema)
    assert chat.stored(spark, path, ["k"], ["at"], df.schema).count() == 3
    assert chat.stored(spark, str(tmp_path / "none"), ["k"], ["at"], df.schema).count() == 0
    now = chat.current_messages(df, ["k"], ["at"], received="at")
    assert sorted(((r["k"], r["first_at"]) for r in now.collect()), key=str) == sorted([("b", 1), (None, 3)], key=str)
