from __future__ import annotations

import pytest

from weftwork.llm import mixing as M


def docs(spark):
    rows = [(i, f"text number {i} with some words in it " * (1 + i % 5), "en" if i % 3 else "de", ["Wiki", " wiki ", "Tickets", "chat-log", None][i % 5], f"S{i % 40}") for i in range(1200)]
    rows += [(5000 + i, rows[i][1], "en", "wiki", "S1") for i in range(50)]  # repeated texts
    rows += [(6000, None, "en", "wiki", "S1"), (6001, "", "en", "wiki", "S1")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, space_key string")


def test_shares_and_repeats(spark):
    goals = spark.createDataFrame([("m", "WIKI", 0.5, 2), ("m", "tickets", 0.3, 1), ("m", "Chat Log", 0.2, 3), ("n", "wiki", 1.0, None), ("n", None, 0.4, 1), ("n", "none", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mix, report = M.mixtures(docs(spark), goals)
    rep = {(r["mix_name"], r["source"]): r for r in report.collect()}
    for s, want in (("wiki", 0.5), ("tickets", 0.3), ("chat_log", 0.2)):
        assert abs(rep["m", s]["reached_share"] - want) < 0.02
        assert rep["m", s]["most_copies"] <= rep["m", s]["max_repeats"]
    assert rep["n", "wiki"]["reached_share"] == 1.0 and rep["n", "none"]["used_tokens"] == 0
    used = mix.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in used}) == len(used) and not any(r["doc_id"] >= 6000 for r in used)


def test_too_many_targets_are_refused_not_cut(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_TARGETS", 3)
    goals = spark.createDataFrame([("m", f"s{i}", 0.25, 1) for i in range(4)], "mix_name string, source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        M.mixtures(docs(spark), goals)


def test_empty_tables(spark):
    d, g = docs(spark), spark.createDataFrame([("m", "wiki", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    mix, report = M.mixtures(d.filter("doc_id < 0"), g)
    assert mix.count() == 0 and report.first()["used_tokens"] == 0
    assert M.mixtures(d, g.filter("mix_name = 'x'"))[1].count() == 0
