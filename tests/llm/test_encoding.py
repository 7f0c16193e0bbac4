from __future__ import annotations

import random

import pytest

from weftwork.llm import encoding as E

TEXTS = ["plain words", "", None, "héllo wörld ñ", "日本語のテキスト 😀👩‍👩‍👧", "<|endoftext|> is ordinary", "tabs\tand\r\nlines  ", "\x00\x01", "a" * 300_000]


def test_round_trip_and_offsets(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    ids = E.encode(df, "text", ["doc_id"])
    back = {r["doc_id"]: r["text"] for r in E.decode(ids, "ids", ["doc_id"]).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    plain = {r["doc_id"]: r["ids"] for r in ids.collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in E.token_counts(df, "text", ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in plain.items()} and plain[1] == plain[2] == []
    for r in E.encode_with_offsets(df, "text", ["doc_id"]).collect():
        assert r["ids"] == plain[r["doc_id"]]
        if r["ids"]:
            assert min(r["starts"]) == 0 and max(r["ends"]) == len(TEXTS[r["doc_id"]])
            assert all(a <= b for a, b in zip(r["starts"], r["ends"]))


def test_split_characters_and_unknown_ids():
    t, back = E.load(), E.decoder()
    ids = t.encode("😀é", add_special_tokens=False).ids
    assert back(ids) == "😀é" and back([]) == ""
    r = random.Random(0)
    for _ in range(50):
        text = "".join(chr(r.choice([r.randint(32, 126), r.randint(0x400, 0x4FF), r.randint(0x4E00, 0x4FFF), r.randint(0x1F300, 0x1F5FF)])) for _ in range(60))
        assert back(t.encode(text, add_special_tokens=False).ids) == text
    with pytest.raises(ValueError):
        back([10**9])
