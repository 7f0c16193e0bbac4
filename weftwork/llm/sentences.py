"""Sentence units across languages and scripts.

Lines are first grouped into blocks: paragraphs, headings, list items and fenced code. Within a block, every end mark is a
place where a sentence might end, and semi-Markov dynamic programming chooses the whole spans whose joint score is best.
A span is scored by its length; by the words that close it (end marks, abbreviations, initials, ordinals) together with
those that open the next; by whether its quotes and brackets balance; and by how well the words that open it fit the mark
that closes it. Which words open sentences, and which of them questions, is counted over the whole corpus: at the starts of
blocks, where sentences certainly start, and over blocks that hold one end mark, which are certainly one sentence.
The search is exact for texts of any length: beyond LONG_REACH characters a span's length costs the same, so the best
earlier place is a running maximum.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftwork.session import materialised

#: An opening word must start at least this share of all blocks, and MIN_COUNT of them; so there are 1 / MIN_SHARE at most.
MIN_SHARE, MIN_COUNT = 2e-5, 3
#: Characters from which a span's length costs, the cost of each further one, and the most that it costs.
LONG, LONG_COST, LONG_MOST = 500, 0.002, 4.0
LONG_REACH = int(LONG + LONG_MOST / LONG_COST)
#: What an opening and a closing that go together count at most.
FIT = 0.5
#: What a quote or bracket that is open at an end of a span costs.
UNBALANCED = 7.0

LINE = re.compile(r"[^\r\n\x0b\x0c\x85  ]*(?:\r\n|[\r\n\x0b\x0c\x85  ]|$)")
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s+|$)")
ITEM = re.compile(r"\s*(?:[-*+•‣–]|(\d{1,9})[.)])\s+")

END = r".!?…。！？｡．؟۔।॥‼⁇⁈⁉"
ASKING = "?？؟⁇⁈⁉"
CLUSTER = re.compile(rf"[{END}]+(?:\s?[»›]|[)\]}}\"'”’“」』）】〉》›»])*")
OPENING = "«„「『（([【《〈‹‚"
CLOSING = {"»": "«", "」": "「", "』": "『", "）": "（(", ")": "(（", "]": "[", "】": "【", "》": "《", "〉": "〈", "›": "‹"}
QUOTES = re.compile("[«„「『（(\\[【《〈‹»」』）)\\]】》〉›“”\"]")
LEAD = re.compile(r"[\s\"“”„«‹「『（(\[【《〈¿¡`'‘*_​-‏‪-‮⁦-⁩]*")
THAI = "฀-๿"
THAI_GAP = re.compile(rf"(?<=[{THAI}])[ \t 　]+(?=\S)|(?<=\S)[ \t 　]+(?=[{THAI}])")
NOSPACE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ฀-໿ក-៿က-႟]")
CASELESS = re.compile(r"[֐-ࣿऀ-෿฀-࿿က-႟ក-៿぀-ヿ㐀-鿿가-힯]")
ABBREVIATED = re.compile(r"[^\W\d_]\.")
WORD = re.compile(r"[^\W\d_][\w'’]*")
TOKEN_BEFORE = re.compile(r"[^\s(\[{«„“\"'「『（¿¡|/]+$")

# Shortened words after which a sentence goes on, whatever follows.
NEVER = set(
    "dr mr mrs ms prof st messrs hon rev gen capt lt sgt vs e.g i.e cf viz al approx "
    "z.b d.h bzw vgl ggf evtl inkl exkl fr hr abschn ca dipl ing "
    "mm mme mlle mgr p.ex ex ej env av sr sra srta sres dra dras prof d dña ud uds aprox pág págs núm ee р рис см прим тов им ул гл т.е т.к напр डॉ श्री रु ڈاکٹر".split()
)
# Shortened words that end a sentence or not, by what follows.
SOMETIMES = set("etc inc ltd co corp jr u.s u.k u.n e.u a.m p.m usw u.a o.ä u.ä bd uu ee.uu т.д т.п др г гг руб коп янв фев мар апр июн июл авг сен сент окт ноя дек jan feb mar apr jun jul aug sep sept oct nov dec".split())
# Shortened words that need a number after them to be such.
NUMBERED = set("no nos nr nrn n fig figs sec secs ch vol pp p art arts s abs bd стр ст п с № num eq ver v tel тел abb kap".split())
# Months after a German ordinal.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep sept okt nov dez".split())
# Words that carry a sentence on after a quotation, in scripts without case.
CARRY_ON = ("她说", "他说", "我说", "他们说", "她问", "他问", "说", "問", "问", "道", "写道", "然后", "然後", "就", "便", "并", "并且", "的", "と", "って", "とは", "という", "の", "に", "を", "が", "は", "も", "から", "まで", "और", "कहकर", "कहा", "ऐसा", "पर", "اور", "کہا", "کہہ", "لیکن", "แล้ว", "ๆ")
# Openers known without a corpus.
OPENERS = set(
    "The A An This That These Those It He She They We I You Our My His Her Their Its There Here What Why How When Where Who Does Do Did Is Are Was Can Could Should Would Will Has Have If In On At To For From With After Before Since Each Every Most Some No Nobody Please Set See Read Use "
    "Der Die Das Ein Eine Es Er Sie Wir Ich Ihr Wenn Warum Wer Was Wie Wo Am Im In Bei Mit Nach Seit Unser Unsere Le La Les L Un Une Il Elle Nous On Ce Cette Ces Notre Qui Que Pourquoi Comment Où Faut Est Je Voir "
    "El Los Las Una Unos Nuestro Nuestra Es Este Esta Esto Por Quién Cómo Cuándo Dónde Qué Se Hay В На По Это Он Она Они Мы Я Наш Наша Кто Что Почему Как Где Когда Если".split()
)


def opener_key(text: str, at: int, end: int) -> str:
    """What stands for the opening words at a place: a word, a few characters of a script without spaces, or a class."""
    m = LEAD.match(text, at, end)
    at = m.end()
    if at >= end:
        return ""
    c = text[at]
    if NOSPACE.match(c):
        return text[at : at + 4]
    if c.isdigit():
        m = re.compile(r"[\d.,:]+\s+([^\W\d_]+)").match(text, at, end)
        return f"9 {m[1]}" if m else "9"
    m = WORD.match(text, at, end)
    if not m:
        return c
    w = m[0]
    if m.end() < end and text[m.end()] == "-" and w.isupper():
        return "KEY-"
    if "_" in w or any(x.isdigit() for x in w):
        return "id_"
    if any(x.isupper() for x in w[1:]) and not w.isupper():
        return "Id"
    return re.split(r"['’]", w)[0]


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """kind ('text', 'item', 'heading', 'code'), start and end of each block, white space around it and markers left out."""

    def trimmed(kind: str, s: int, e: int) -> Iterator[tuple[str, int, int]]:
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            yield kind, s, e

    start, kind, fence, last = -1, "text", "", 0
    for m in LINE.finditer(text):
        s, e = m.span()
        if s == e:
            break
        if fence:
            last = e
            line = m[0].strip()
            if line.startswith(fence) and not line.strip(fence[0]):
                yield from trimmed("code", start, e)
                start, fence = -1, ""
            continue
        if m[0].isspace():
            if start >= 0:
                yield from trimmed(kind, start, s)
                start = -1
            continue
        if (f := FENCE.match(m[0])) is not None and not (f[1][0] == "`" and "`" in m[0][f.end() :]):
            if start >= 0:
                yield from trimmed(kind, start, s)
            start, fence, last = s, f[1], e
            continue
        if (h := HEADING.match(m[0])) is not None:
            if start >= 0:
                yield from trimmed(kind, start, s)
                start = -1
            yield from trimmed("heading", s + h.end(), e)
            continue
        if (i := ITEM.match(m[0])) is not None and i.end() < len(m[0]) and (start < 0 or kind == "item" or i[1] in (None, "1")):
            if start >= 0:
                yield from trimmed(kind, start, s)
            start, kind = s + i.end(), "item"
            continue
        if start < 0:
            start, kind = s, "text"
    if start >= 0:
        yield from trimmed("code" if fence else kind, start, len(text))


def pairs(text: str, s: int, e: int) -> list[tuple[int, int]]:
    """Opening and closing places of matched quotes and brackets. Unmatched marks are ordinary characters."""
    stack: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []
    waiting: Counter[str] = Counter()

    def close(partners: str, at: int) -> bool:
        if not any(waiting[p] for p in partners):
            return False
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in partners:
                found.append((stack[k][1], at))
                waiting.subtract(x for x, _ in stack[k:])
                del stack[k:]
                return True
        return False

    for m in QUOTES.finditer(text, s, e):
        c, at = m[0], m.start()
        if c in CLOSING:
            close(CLOSING[c], at)
        elif c in OPENING or not close({"“": "„”", "”": "“„"}.get(c, c), at):
            stack.append((c, at))
            waiting[c] += 1
    return found


def _ending(text: str, s: int, mark: int, stop: int, e: int, openers: dict[str, tuple[float, float]]) -> float:
    """The evidence that a sentence ends at `stop`, after end marks that begin at `mark`: closing and opening words."""
    cluster = text[mark:stop]
    marks = cluster.rstrip(")]}\"'”’“」』）】〉》›»   ")
    closers = cluster[len(marks) :]
    quoted = any(c in "\"”’“」』»›" for c in closers)
    n = stop
    while n < e and text[n].isspace():
        n += 1
    if n >= e:
        return 10.0
    gap, c = n > stop, text[n]
    if c in ",;:、，；：،؛)]}）」』”’»›،" or c in "–—" or (c == "-" and n + 1 < e and text[n + 1] == " "):
        return -9.0
    key = opener_key(text, n, e)
    opens = key in openers
    lead = LEAD.match(text, n, e).end()
    first = text[lead] if lead < e else c
    lower, upper = first.islower(), first.isupper()
    caseless = bool(CASELESS.match(first))
    wide = marks[-1] in "。！？｡．؟۔।॥"
    if all(m == "…" for m in marks) or (len(marks) > 1 and not marks.strip(".")):
        if lower and not (opens and gap):
            return -6.0
        if not gap:
            return -5.0
        return 3.0 if opens or upper or caseless else -1.0
    if quoted:
        if lower:
            return -6.0
        if caseless:
            if text.startswith(CARRY_ON, n):
                return -6.0
            return 2.5 if gap or opens else -2.0
    if wide or set(marks) & set("!?！？؟"):
        if not gap and not wide:
            if not (opens and upper or caseless or c in "“«„¿¡"):
                return -6.0
        if marks == "．" and first.isdigit() and not gap:
            return -6.0
        return 5.0 if not lower or opens else 3.0
    # a full stop; every shortened word is shorter than 40 characters, so a longer token need not be seen whole
    m = TOKEN_BEFORE.search(text, max(s, mark - 40), mark)
    word = m[0].lower() if m else ""
    bare = word.lstrip("*_`-")
    if not gap:
        if c in "“«„¿¡" and not quoted:
            return 3.0
        if caseless:
            return 3.0
        return 3.0 if upper and opens and len(bare) > 1 and not ("." not in bare and "_" in bare and not opens) else -8.0
    if bare in NEVER:
        return -9.0
    if bare in NUMBERED and first.isdigit():
        return -9.0
    if len(bare) == 1 and bare.isalpha() and m[0].islower() and ABBREVIATED.match(text, n, e):
        return -9.0
    if len(bare) == 1 and bare.isalpha() or (bare.count(".") and all(len(x) <= 1 for x in bare.split("."))) or bare in SOMETIMES:
        if bare.isalpha() and len(bare) == 1 and m and m[0].isupper() and upper and not opens:
            return -6.0
        if lower or (first.isdigit() and not opens):
            return -6.0
        if len(bare) == 1 and bare not in SOMETIMES and bare.isalpha():
            return 1.0 if opens and m and not m[0].isupper() else -3.0
        return 3.0 if opens or caseless and bare in SOMETIMES else -3.0
    if bare.isdigit() and len(bare) <= 2 and key.lower() in MONTHS:
        return -9.0
    if bare.isdigit() and len(bare) <= 3 and upper and not opens:
        return -4.0
    if upper and not opens and key not in ("KEY-", "Id", "id_"):
        return 2.0
    return 3.5


def cut(text: str, s: int, e: int, openers: dict[str, tuple[float, float]]) -> Iterator[tuple[int, int]]:
    """The sentences of a block: of all ways to cut it at its end marks, the one whose spans score best together."""
    ends: list[tuple[int, float, int]] = []
    inside = pairs(text, s, e)
    opened, closed = {o for o, _ in inside}, {c for _, c in inside}
    for m in CLUSTER.finditer(text, s, e):
        stop = m.end()
        for at in range(m.start(), stop):
            if at in opened or text[at] == "“" and at not in closed:
                stop = at
                break
        ends.append((stop, _ending(text, s, m.start(), stop, e, openers), int(any(c in ASKING for c in m[0]))))
    if re.search(f"[{THAI}]", text[s:e]):
        for m in THAI_GAP.finditer(text, s, e):
            a, b = text[m.start() - 1], text[m.end()]
            key = opener_key(text, m.end(), e)
            if a in "ๆฯ" and b not in "ๆ" or b in "ๆฯ" or a in END:
                continue
            left, right = "฀" <= a <= "๿", "฀" <= b <= "๿"
            if left and right:
                ends.append((m.start(), 4.0 if key in openers else 2.0, 0))
            elif left and b.isupper() and key in openers and key not in ("KEY-", "Id", "id_"):
                ends.append((m.start(), 2.0, 0))
            elif left and not b.isalnum() and b not in "([{`@#$%&+-=<>~/" and key in openers:
                ends.append((m.start(), 1.0, 0))
    if not ends or len(ends) == 1 and ends[0][0] >= e:
        yield s, e
        return
    ends.sort()
    if ends[-1][0] < e:
        ends.append((e, 10.0, 0))
    stops = [s, *(p for p, *_ in ends)]
    n = len(stops)
    starts, closes = sorted(o for o, _ in inside), sorted(c for _, c in inside)
    tilt = [0.0] * n
    if inside:
        for k in range(1, n - 1):
            tilt[k] = UNBALANCED * (bisect_left(starts, stops[k]) - bisect_left(closes, stops[k]))
    fits = [openers.get(opener_key(text, p, e), (0.0, 0.0)) for p in stops[:-1]]
    best, back = [0.0] + [-1e18] * (n - 1), [0] * n
    # beyond LONG_REACH only what belongs to the place itself counts: the best such place for each kind of closing mark
    far, far_at, done = [-1e18, -1e18], [0, 0], 0
    for j in range(1, n):
        stop, gain, asks = ends[j - 1]
        gain -= tilt[j]
        while done < j and stop - stops[done] > LONG_REACH:
            for mark in (0, 1):
                if (x := best[done] - tilt[done] + fits[done][mark]) > far[mark]:
                    far[mark], far_at[mark] = x, done
            done += 1
        top, where = far[asks] - LONG_MOST, far_at[asks]
        for i in range(done, j):
            size = stop - stops[i]
            x = best[i] - tilt[i] + fits[i][asks]
            if size > LONG:
                x -= LONG_COST * (size - LONG)
            elif size < 3:
                x -= 3.0
            if x >= top:
                top, where = x, i
        best[j], back[j] = top + gain, where
    chosen, j = [], n - 1
    while j:
        chosen.append((stops[back[j]], stops[j]))
        j = back[j]
    for a, b in reversed(chosen):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b


#: The openers known without a corpus, which say nothing about questions.
KNOWN_OPENERS = dict.fromkeys(OPENERS, (0.0, 0.0))


def sentences(text: str | None, openers: dict[str, tuple[float, float]] = KNOWN_OPENERS) -> list[tuple[int, int]]:
    """start and end of each sentence unit of a text. Null, empty and blank texts have none."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    for kind, s, e in blocks(text):
        if kind == "code":
            out.append((s, e))
        else:
            out.extend(cut(text, s, e, openers))
    return out


def opening_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """key, n, plain, asking: how many blocks of all texts start with each opening key, and how many of those with one end
    mark close with a plain mark or a question mark. Counts are combined before the shuffle."""

    def flushed(counts: dict[str, list[int]]) -> pa.RecordBatch:
        values = [pa.array([v[k] for v in counts.values()], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *values], names=["key", "n", "plain", "asking"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for b in batches:
            for x in b[0].to_pylist():
                for kind, s, e in blocks(x) if x else ():
                    if kind in ("text", "item"):
                        c = counts.setdefault(opener_key(x, s, e), [0, 0, 0])
                        c[0] += 1
                        m = CLUSTER.search(x, s, e)
                        if m and m.end() == e:
                            c[2 if any(k in ASKING for k in m[0]) else 1] += 1
            if len(counts) > 200_000:  # memory only: counts are added up later
                yield flushed(counts)
                counts = {}
        if counts:
            yield flushed(counts)

    found = documents.select(text).mapInArrow(run, "key string, n long, plain long, asking long")
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "plain", "asking")])


def learned_openers(documents: DataFrame, text: str = "text") -> dict[str, tuple[float, float]]:
    """The words that open sentences in the whole corpus and those known without one, each with what it counts before a
    plain closing mark and before a question mark. Only words that start MIN_SHARE of all blocks come to the driver."""
    words = materialised(opening_words(documents, text))
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "plain", "asking")]).first()
    least = max(MIN_COUNT, MIN_SHARE * total["n"])
    usual = math.log((total["asking"] + 1) / (total["plain"] + 1))
    out = dict(KNOWN_OPENERS)
    for r in words.filter(F.col("n") >= least).collect():
        if r["key"]:
            odds = math.log((r["asking"] + 1) / (r["plain"] + 1)) - usual if r["asking"] + r["plain"] >= 10 else 0.0
            odds = max(-FIT, min(FIT, 0.1 * odds))
            out[r["key"]] = (-odds, odds)
    return out


def sentence_units(documents: DataFrame, keep: list[str], text: str = "text", openers: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """`keep` columns of each document and start_at, end_at (code points, end exclusive) of each of its units.

    Whole texts are read, whatever their length; repeated rows yield repeated units. Without `openers` these are counted
    over the table first. Columns to keep that are called start_at or end_at raise ValueError.
    """
    if clash := {"start_at", "end_at"} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    openers = learned_openers(documents, text) if openers is None else openers
    shared = documents.sparkSession.sparkContext.broadcast(dict(openers))
    source = documents.select(*keep, documents[text].alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + [T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            rows, starts, ends = [], [], []
            for r, x in enumerate(b["__text"].to_pylist()):
                for s, e in sentences(x, known):
                    rows.append(r)
                    starts.append(s)
                    ends.append(e)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b[c].take(take) for c in keep] + [pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*keep, "start_at", "end_at"])

    return source.mapInArrow(run, schema)
