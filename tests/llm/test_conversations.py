from __future__ import annotations

import itertools
import random

from weftwork.llm import conversations as C


def test_states_of_pieces_combine_as_the_transitions_say():
    m = C.Automaton(2, 3)
    for n in range(5):
        for word in itertools.product(range(4), repeat=n):
            for cut in range(n + 1):
                assert m.then(m.after(list(word[:cut])), m.after(list(word[cut:]))) == m.after(list(word))
    # accepted: three turns with a reply in a run; two with a reply and the named message in a thread
    assert m.run_accepts[m.after([0, 1, 0])] and not m.run_accepts[m.after([0, 0, 0])] and not m.run_accepts[m.after([0, 1])]
    assert m.thread_accepts[m.after([2, 1])] and not m.thread_accepts[m.after([0, 1])] and not m.thread_accepts[m.after([2, 0])]


def brute(rows):
    newest = {}
    for w, c, ts, user, text, thread, at, rid in rows:
        try:
            t = round(float(ts) * 1_000_000)
        except (TypeError, ValueError):
            continue
        if (w, c, t) not in newest or (at, rid) > newest[w, c, t][0]:
            newest[w, c, t] = ((at, rid), user if text and text.strip() else None, round(float(thread) * 1_000_000) if thread else None)
    out = []
    for place in {k[:2] for k in newest}:
        ms = sorted((k[2], v[1], v[2]) for k, v in newest.items() if k[:2] == place)
        named = {th for *_, th in ms if th is not None}
        groups, run, last = {}, None, None
        for t, u, th in ms:
            key = th if th is not None else t if t in named else None
            if key is not None:
                groups.setdefault(("t", key), []).append((t, u))
            else:
                run = t if last is None or t - last > 600_000_000 else run
                last = t
                groups.setdefault(("r", run), []).append((t, u))
        for (kind, key), g in groups.items():
            left = [(t, u) for t, u in g if u is not None]
            if len({u for _, u in left}) < 2 or len(left) < (2 if kind == "t" else 3) or kind == "t" and key not in [t for t, _ in left]:
                continue
            out += [(*place, left[0][0], i, t, "opener" if u == left[0][1] else "replier") for i, (t, u) in enumerate(left)]
    return sorted(out)


def test_against_brute_force_over_many_buckets(spark):
    r = random.Random(3)
    rows, t = [], 1_700_000_000.0
    for i in range(900):
        t += r.choice([1, 30, 600, 601, 5000, 40_000])
        thread = f"{t - r.choice([0, 30, 631]):.6f}" if r.random() < 0.25 else None
        if rows and r.random() < 0.3:
            thread = r.choice(rows)[2]
        rows.append(("w", r.choice("ab"), f"{t:.6f}", r.choice(["u1", "u2", "u3", None]), r.choice(["x", "y", " ", None, "z"]), thread, i, i))
    rows += [("w", "a", rows[5][2], "u9", "again", rows[5][5], 5000, 5000), ("w", "a", "bad", "u1", "x", None, 1, 9001), ("w", "a", None, "u1", "x", None, 1, 9002)]
    df = spark.createDataFrame(rows, "workspace_id string, channel string, ts string, user string, text string, thread_ts string, received_at long, row_id long")
    for bucket_s in (600, C.BUCKET_S):
        got = sorted(tuple(x) for x in C.conversations(df, bucket_s=bucket_s).select("workspace_id", "channel", "root_us", "turn", "ts_us", "role").collect())
        assert got == brute(rows) and len(got) > 30
    assert C.conversations(df.filter("row_id < 0")).count() == 0
