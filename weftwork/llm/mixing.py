"""Mixing sources to target weights, in tokens, with a cap on repeats.

Texts are reduced to cells of source, language and topic; a cell's tokens are all that the weights depend on. Iterative
proportional fitting rakes the cells' weights to the targets of the sources, while languages and topics keep the shares
they have among the mix's sources; weights stay below the cap on repeats, and what a capped cell can't take goes to the
other cells of its source. A weight is the expected number of copies of each text in the cell: its whole part is given to
all, the rest is drawn with that probability by a hash of the text. The draw's threshold is then calibrated on the drawn
tokens of each source, so that the shares reached don't depend on luck.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.encoding import NAME, TOKENIZERS, token_counts
from weftwork.session import broadcast_if_small, materialised

#: Topics are the spaces, in this many hash buckets.
TOPICS = 32
#: Targets of all mixes together; more are refused, never cut. Cells that go to the driver are no more than the sources
#: named there, times the 677 language keys, times TOPICS.
MAX_TARGETS = 10_000
#: Steps of the draw's threshold for each source.
BINS = 2048
ROUNDS = 200


def source_key(source: Column) -> Column:
    """One spelling of a source: no case, no blanks at the ends, one separator. Null stays null, blank becomes null."""
    s = F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"(?U)[\s_\-./]+", " "))), " ", "_")
    return F.when(s != "", s)


def language_key(lang: Column) -> Column:
    """The two letters that a language tag begins with, or 'und'."""
    s = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^\s*([a-z]{2})", 1)
    return F.when(s != "", s).otherwise("und")


def sized_texts(documents: DataFrame, *, name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """text_key, doc_id, source, lang, topic, n_tokens: one row per distinct text that has tokens.

    A text kept several times counts once, as the document with the smallest id that has a source; so no text can be
    used more often than allowed because it occurs twice. Texts without any source are left out.
    """
    docs = documents.select("doc_id", "text", F.sha2("text", 256).alias("text_key"), source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), F.pmod(F.xxhash64(F.coalesce("space_key", F.lit(""))), F.lit(TOPICS)).cast("int").alias("topic"))
    counted = token_counts(docs.filter("source IS NOT NULL AND text IS NOT NULL"), "text", ["text_key", "doc_id", "source", "lang", "topic"], name=name, folder=folder)
    first = F.min(F.struct("doc_id", "source", "lang", "topic", "n_tokens")).alias("r")
    return counted.filter("n_tokens > 0").groupBy("text_key").agg(first).select("text_key", "r.*")


def rake(tokens: np.ndarray, source: np.ndarray, margins: list[np.ndarray], share: np.ndarray, cap: np.ndarray, size: float | None = None) -> np.ndarray:
    """Expected copies of each cell. share and cap are by source; margins label the cells by language and topic.

    The size is the largest that all sources with tokens can reach, or `size` if that is smaller. Sources without tokens
    get nothing, and the rest keep their proportions.
    """
    have = np.bincount(source, tokens, len(share))
    use = (have > 0) & (share > 0)
    if not use.any():
        return np.zeros(len(tokens))
    largest = float((cap[use] * have[use] / share[use]).min())
    total = largest if size is None else min(size, largest)
    want = np.where(use, share * total, 0.0)
    limit = cap[source].astype(float)
    weight = np.where(use[source], want[source] / np.maximum(have[source], 1e-12), 0.0)
    natural = [np.bincount(m, tokens * weight) for m in margins]
    # languages and topics: what they are among the texts of the mix's sources
    base = np.where(use[source], tokens, 0.0)
    goal = [np.bincount(m, base, len(n)) * (want.sum() / max(base.sum(), 1e-12)) for m, n in zip(margins, natural)]
    for _ in range(ROUNDS):
        before = weight.copy()
        for m, g in zip(margins, goal):
            now = np.bincount(m, tokens * weight, len(g))
            weight = np.minimum(weight * np.where(now > 0, g / np.maximum(now, 1e-12), 1.0)[m], limit)
        weight = _fill(weight, tokens, source, want, limit)
        if np.abs(weight - before).max(initial=0.0) < 1e-9:
            break
    return weight


def _fill(weight: np.ndarray, tokens: np.ndarray, source: np.ndarray, want: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Weights scaled to the sources' targets; what the cap cuts off goes to the source's cells below it."""
    weight = np.where((weight <= 0) & (want[source] > 0), 1e-9, weight)
    for _ in range(64):
        full = weight >= limit
        fixed = np.bincount(source, tokens * np.where(full, limit, 0.0), len(want))
        free = np.bincount(source, tokens * np.where(full, 0.0, weight), len(want))
        scale = np.where(free > 0, np.maximum(want - fixed, 0.0) / np.maximum(free, 1e-300), 1.0)
        over = fixed > want * (1 + 1e-12)
        new = np.where(full, limit, weight * scale[source])
        if over.any():
            now = np.bincount(source, tokens * new, len(want))
            new = np.where(over[source], new * (want / np.maximum(now, 1e-300))[source], new)
        new = np.minimum(new, limit)
        if np.abs(new - weight).max(initial=0.0) < 1e-12:
            return new
        weight = new
    return weight


def mixtures(documents: DataFrame, targets: DataFrame, *, size: float | None = None, name: str = NAME, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixes, and the shares they reach.

    First: mix_name, doc_id, source, n_tokens, copies of each used text (one row per text and mix). Second: mix_name,
    source, target_share, max_repeats, texts, available_tokens, used_tokens, reached_share, most_copies, one row per
    target; a source without texts has zeros there and the others keep their proportions. Rows of targets without a
    name, source or positive share are ignored, spellings of one source are added up, a null max_repeats counts as 1.
    """
    spark = documents.sparkSession
    goals = [
        r.asDict() for r in targets.filter("mix_name IS NOT NULL").withColumn("source", source_key(F.col("source"))).filter("source IS NOT NULL AND target_share > 0")
        .groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")).orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()
    ]
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = sorted({g["source"] for g in goals})
    texts = materialised(sized_texts(documents, name=name, folder=folder)).filter(F.col("source").isin(wanted) if wanted else F.lit(False))
    by = ["source", "lang", "topic"]
    cells = sorted(texts.groupBy(*by).agg(F.sum("n_tokens").alias("tokens")).collect(), key=lambda r: (r["source"], r["lang"], r["topic"]))
    place = {s: i for i, s in enumerate(wanted)}
    tokens = np.array([float(c["tokens"]) for c in cells])
    source = np.array([place[c["source"]] for c in cells], int)
    margins = [np.unique([str(c[k]) for c in cells], return_inverse=True)[1] if cells else np.zeros(0, int) for k in ("lang", "topic")]
    rows, want = [], {}
    for mix in sorted({g["mix_name"] for g in goals}):
        share, cap = np.zeros(len(wanted)), np.ones(len(wanted))
        for g in goals:
            if g["mix_name"] == mix:
                share[place[g["source"]]], cap[place[g["source"]]] = g["target_share"], max(0, g["max_repeats"])
        weight = rake(tokens, source, margins, share, cap, size)
        for s, i in place.items():
            want[mix, s] = float((tokens * weight)[source == i].sum())
        for c, w in zip(cells, weight):
            if w > 1e-9:
                rows.append((mix, c["source"], c["lang"], c["topic"], int(np.floor(w + 1e-9)), float(max(0.0, w - np.floor(w + 1e-9)))))
    plan = spark.createDataFrame(rows, "mix_name string, source string, lang string, topic int, base int, rest double")
    draw = F.pmod(F.xxhash64("text_key", "mix_name"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    drawn = texts.join(broadcast_if_small(plan), by).withColumn("bin", F.when(F.col("rest") > 0, F.least(F.floor(draw / F.col("rest") * (BINS // 2)), F.lit(BINS - 1))).otherwise(BINS).cast("int"))
    counts = drawn.groupBy("mix_name", "source", "bin").agg(F.sum(F.col("n_tokens") * F.col("base")).alias("sure"), F.sum("n_tokens").alias("extra")).collect()
    steps = []
    for mix, s in sorted({(c["mix_name"], c["source"]) for c in counts}):
        own = [c for c in counts if (c["mix_name"], c["source"]) == (mix, s)]
        sure, extra = sum(c["sure"] for c in own), np.zeros(BINS + 1)
        for c in own:
            if c["bin"] < BINS:
                extra[c["bin"] + 1] += c["extra"]
        reach = sure + np.cumsum(extra)
        steps.append((mix, s, int(np.abs(reach - want[mix, s]).argmin())))
    cut = spark.createDataFrame(steps, "mix_name string, source string, cut int")
    mix = (
        drawn.join(broadcast_if_small(cut), ["mix_name", "source"]).withColumn("copies", F.col("base") + (F.col("bin") < F.col("cut")).cast("int")).filter("copies > 0")
        .select("mix_name", "doc_id", "source", "n_tokens", "copies")
    )
    goal = spark.createDataFrame([(g["mix_name"], g["source"], float(g["target_share"]), int(g["max_repeats"])) for g in goals], "mix_name string, source string, target_share double, max_repeats int")
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = mix.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    total = used.groupBy("mix_name").agg(F.sum("used_tokens").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = goal.join(have, "source", "left").join(used, ["mix_name", "source"], "left").join(total, "mix_name", "left").select(
        "mix_name", "source", "target_share", "max_repeats", zero("texts"), zero("available_tokens"), zero("used_tokens"),
        F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), zero("most_copies"),
    )
    return mix, report
