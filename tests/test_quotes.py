from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import duckdb
from weftwork.plans import board_plans, search_plans

BODIES = ["Plain text. More", "Die **Straße** ist frei. Gut", "ΟΔΟΣ ἐδῶ", "переезд　ЗАВТРА", "[Lärm](http://x) hört auf", "看板 已满。", "never there", "", None, "Größe. Rest"]
SOURCES = ["plain  TEXT here", "die STRASSE ist frei heute", "εδώ: οδοσ ἐδῶ", "Переезд завтра", "LÄRM hört  auf", "看板 已满。完", "other", "x", "x", "grösse"]


def plain(text):
    text = re.sub(r"[*_`~#>|]", " ", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text))
    return " ".join(text.split()).casefold()


def written(folder):
    n = range(len(BODIES))
    pq.write_table(pa.table({"row_id": list(n), "item_id": [f"i{k}" for k in n], "body": BODIES}), folder / "comments.parquet")
    n = n[:-1]  # the last comment's item is gone
    pq.write_table(pa.table({"row_id": list(n), "item_id": [f"i{k}" for k in n], "updated_at": [0 for _ in n], "description_md": SOURCES[:-1]}), folder / "service.parquet")
    return str(folder)


def oracle(folder, sql):
    con = duckdb.connect()
    for t in ("comments", "service"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_fingerprints_of_every_script(spark, tmp_path):
    folder = written(tmp_path)
    found = {r["row_id"]: r["fp"] for r in search_plans.fn8_fingerprints(spark, folder).collect()}
    assert found == {k: hashlib.sha256(plain(b).encode()).hexdigest()[:16] for k, b in enumerate(BODIES) if b is not None}
    for row_id, fp in oracle(folder, search_plans.SQL["fn8_fingerprints"]):
        assert found[row_id] == fp


def test_evidence_in_every_script(spark, tmp_path):
    found = {r["state"]: r["n"] for r in board_plans.jn6_evidence_state(spark, written(tmp_path)).collect()}
    want = Counter()
    for k, b in enumerate(BODIES):
        quote = plain((re.match(r"[^.\n]{1,80}", b or "") or [""])[0])
        want["missing" if k == len(BODIES) - 1 else "current" if quote and quote in plain(SOURCES[k]) else "changed"] += 1
    assert found == want and want["current"] == 6
