from __future__ import annotations

import itertools

from weftwork.llm import sentences as S


def units(text, **kw):
    return [text[a:b] for a, b in S.sentences(text, **kw)]


def test_ambiguous_ends_in_several_scripts():
    assert units("Dr. Ahn paid 3.50 at 5 p.m. on Monday. It was fine.") == ["Dr. Ahn paid 3.50 at 5 p.m. on Monday.", "It was fine."]
    assert units('She said: "Stop. Now." Then she left.') == ['She said: "Stop. Now."', "Then she left."]
    assert units("今日は晴れです。明日は雨！") == ["今日は晴れです。", "明日は雨！"]
    assert units("यह काम करता है। वह नहीं।") == ["यह काम करता है।", "वह नहीं।"]
    assert units("Am 3. Mai beginnt es. Danach z. B. nichts.") == ["Am 3. Mai beginnt es.", "Danach z. B. nichts."]


def test_blocks_and_markers():
    text = "# Head line\n\n- first item\n- second item. More\n\n```py\na = 1. \nb\n```\none line\ngoes on. Then ends.\n"
    assert units(text) == ["Head line", "first item", "second item.", "More", "```py\na = 1. \nb\n```", "one line\ngoes on.", "Then ends."]
    assert units(None) == [] and units("") == [] and units(" \n\t") == []


def test_search_is_exact_against_all_ways_to_cut(monkeypatch):
    # all cuts of a block are scored span by span, as the docstring of the module says
    monkeypatch.setattr(S, "LONG", 30)
    monkeypatch.setattr(S, "LONG_COST", 0.5)
    monkeypatch.setattr(S, "LONG_REACH", 38)
    text = 'He (No. 4 of 7. Or so) asked "Why now? Because." and left. see it... Later? The U.S. Team came at 4. It was ok'
    openers = dict(S.KNOWN_OPENERS) | {"He": (0.4, -0.4), "Later": (-0.5, 0.5)}
    got = list(S.cut(text, 0, len(text), openers))
    inside = S.pairs(text, 0, len(text))
    opened, closed = {o for o, _ in inside}, {c for _, c in inside}
    ends = []
    for m in S.CLUSTER.finditer(text):
        stop = next((at for at in range(m.start(), m.end()) if at in opened or text[at] == "“" and at not in closed), m.end())
        ends.append((stop, S._ending(text, 0, m.start(), stop, len(text), openers), int("?" in m[0])))
    ends.append((len(text), 10.0, 0))
    over = lambda p: 0 if p in (0, len(text)) else sum(o < p <= c for o, c in inside)

    def score(cut):
        total, at = 0.0, 0
        for stop, gain, asks in cut:
            size = stop - at
            fit = openers.get(S.opener_key(text, at, len(text)), (0.0, 0.0))[asks]
            long = min(S.LONG_MOST, max(0.0, S.LONG_COST * (size - S.LONG)))
            total += gain + fit - (3.0 if size < 3 else long) - S.UNBALANCED * (over(at) + over(stop))
            at = stop
        return total

    best = max((score([*cut, ends[-1]]), [*cut, ends[-1]]) for n in range(len(ends)) for cut in itertools.combinations(ends[:-1], n))
    want, at = [], 0
    for stop, *_ in best[1]:
        piece = text[at:stop]
        want.append((at + len(piece) - len(piece.lstrip()), stop - (len(piece) - len(piece.rstrip()))))
        at = stop
    assert got == want and len(got) > 3


def test_quotation_with_more_ends_than_the_old_reach_stays_whole():
    inner = " ".join(["It went on."] * 600)
    text = f"He read « {inner} » and sat down. Nobody spoke."
    assert units(text) == [f"He read « {inner} » and sat down.", "Nobody spoke."]


def test_openers_are_counted_over_all_blocks(spark):
    rows = [(i, f"Zorg {i} runs well.\n\nWhatfor {i} is it?") for i in range(60)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.learned_openers(df)
    assert found["Zorg"][0] > 0 > found["Zorg"][1] and found["Whatfor"][1] > 0
    again = df.unionByName(df.filter("doc_id = 1")).withColumnRenamed("doc_id", "id")
    got = S.sentence_units(again, ["id"]).collect()
    assert sum(r["id"] == 1 for r in got) == 4 and not any(r["id"] in (99, 100) for r in got)
