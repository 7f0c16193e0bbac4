"""Ranking by keywords, by vectors, and by both."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import identifier_words, words
from weftwork.session import broadcast_if_small, materialised

# What a matching word counts in each field, and what a prefix of a word counts.
FIELD_BOOSTS = {"name": 4.0, "path": 2.0, "file_path": 2.0, "signature": 1.0, "docstring": 0.5}
WORDS_BOOST, PREFIX_BOOST, MAX_WORDS = 3.0, 0.5, 12


def _starts(word: str) -> Callable[[Column], Column]:
    return lambda x: F.startswith(x, F.lit(word))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(word)


def keyword_score(nodes: DataFrame, words: list[str]) -> DataFrame:
    """nodes with `score`, the boosts of the fields that hold each word; nodes without any match are left out.

    nodes: name, path, file_path, qualified_name, signature, docstring. A question has MAX_WORDS words; later ones don't
    count.
    """
    words = [w.lower() for w in words[:MAX_WORDS]]
    tokens = {f: identifier_words(F.coalesce(f, F.lit(""))) for f in FIELD_BOOSTS}
    named = identifier_words(*[F.coalesce(c, F.lit("")) for c in ("name", "path", "file_path", "qualified_name")])
    n = nodes.withColumns({f"__{f}": t for f, t in tokens.items()} | {"__words": named})
    score: Column = F.lit(0.0)
    for w in words:
        for f, boost in FIELD_BOOSTS.items():
            score = score + F.when(F.array_contains(f"__{f}", w), boost).otherwise(0.0)
        score = score + F.when(F.array_contains("__words", w), WORDS_BOOST).otherwise(0.0)
        score = score + F.when(F.exists("__words", _starts(w)), PREFIX_BOOST).otherwise(0.0)
    return n.withColumn("score", score).filter("score > 0").drop(*[f"__{f}" for f in FIELD_BOOSTS], "__words")


def bm25(documents: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of every document that holds a term. Statistics are those of all documents.

    Only the terms asked for are counted, inside the scan; document frequency and mean length need one more aggregate.
    """
    terms = sorted({t.lower() for t in terms})
    d = documents.select(key, words(F.col(text)).alias("w")).select(key, F.size("w").alias("n"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    st = d.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), *[F.coalesce(F.sum((F.col(f"tf{i}") > 0).cast("long")), F.lit(0)).alias(f"df{i}") for i in range(len(terms))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (st["docs"] - st[f"df{i}"] + 0.5) / (st[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(st["mean"] or 1.0)))
    return d.withColumn("score", score).filter("score > 0").select(key, "score")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows; null, empty and other vectors of another length, and those without length, are rows of zeros."""
    n = len(column)
    out = np.zeros((n, width))
    if n:
        sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        fits = sizes == width
        if fits.all():
            out[:] = column.flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        elif fits.any():
            out[fits] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        out[~np.isfinite(out).all(axis=1)] = 0.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, equal ones (to 12 digits) by name."""
    order = np.lexsort((names, -np.round(scores, 12)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)


def _ranked(found: DataFrame, k: int, query_id: str, vec_id: str) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", 12)), "v")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("v").alias(vec_id), "score", "rank")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding", least: float | None = None, block: int = 4096) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors closest to each query by cosine, exactly; ties by id.

    queries is a stated set. It's taken in blocks of about `block` vectors, one after the other: the driver and the tasks
    hold the matrix of one block only, and a task keeps the k best of each query over its whole partition, so little more
    than k rows per query and partition are shuffled. A null vector, or one without length, has the score 0. Ids are whole
    numbers.
    """
    spark = queries.sparkSession
    parts = max(1, -(-queries.count() // block))
    found = None
    for part in range(parts):
        rows = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part).select(F.col(query_id).cast("long"), vector).toArrow()
        sizes = pc.list_value_length(rows[1]).fill_null(0).to_numpy()
        width = int(sizes.max(initial=1)) or 1
        shared = spark.sparkContext.broadcast((rows[0].to_numpy(), _matrix(rows[1].combine_chunks(), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                scores = np.concatenate([best, m @ _matrix(b[1], width).T], axis=1)
                names = np.concatenate([who, np.broadcast_to(b[0].to_numpy(zero_copy_only=False), (len(ids), b.num_rows))], axis=1)
                best, who = _best(scores, names, k)
            ok = np.isfinite(best) & (best >= (-np.inf if least is None else least))
            q = np.broadcast_to(ids[:, None], best.shape)
            yield pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(who[ok]), pa.array(best[ok])], names=["q", "v", "score"])

        one = vectors.select(F.col(vec_id).cast("long"), vector).mapInArrow(run, "q long, v long, score double")
        if parts > 1:
            one = materialised(one)
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return _ranked(found, k, query_id, vec_id)


#: Rows that the index is fitted on at most, and vectors and queries that one task scores against each other.
FITTED, CHUNK, QUERY_CHUNK = 20_000, 20_000, 2_000


def centres(vectors: DataFrame, lists: int, *, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = 12, sample: int = FITTED) -> np.ndarray:
    """Centres of `lists` clusters by spherical k-means over a sample of at most `sample` vectors, drawn by a hash of the id."""
    rows = vectors.filter(f"size({vector}) > 0").orderBy(F.xxhash64(vec_id)).select(vector).limit(sample).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 1))
    width = int(pc.list_value_length(rows[0]).to_numpy().max())
    x = _matrix(rows[0].combine_chunks(), width)
    lists = min(lists, len(x))
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-300), c)
    return c


def indexed(queries: DataFrame, vectors: DataFrame, k: int, *, lists: int = 64, probes: int = 40, query_id: str = "query_id", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: like nearest, but a query is compared only with the vectors of the `probes` clusters
    whose centres are closest to it, so some neighbours may be missed. Of the 10 nearest of the test vectors, which are close to
    independent of each other, it finds 94 to 95 in 100; vectors that form clusters need far fewer probes.

    Every vector is indexed; only the centres come from a sample. Clusters are split into chunks of CHUNK vectors and their
    queries into chunks of QUERY_CHUNK, so that no task holds a cluster that has grown large.
    """
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(centres(vectors, lists, vec_id=vec_id, vector=vector))

    def placed(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                near = np.argsort(-(_matrix(b[1], c.shape[1]) @ c.T), axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b[0].take(take), b[1].take(take), pa.array(near.reshape(-1).astype(np.int32))], names=["id", "x", "list"])

        return run

    schema = "id long, x array<float>, list int"
    v = materialised(vectors.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(placed(1), schema))
    q = materialised(queries.select(F.col(query_id).cast("long"), F.col(vector).cast("array<float>")).mapInArrow(placed(probes), schema))
    many = v.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("vs")).join(q.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("qs")), "list")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    many = F.broadcast(many)  # a row per list, of which there are `lists`
    vc = v.join(many, "list").withColumn("vc", F.pmod(F.xxhash64("id"), F.col("vs")).cast("int")).withColumn("qc", each("qs")).select("list", "vc", "qc", "id", "x")
    qc = q.join(many, "list").withColumn("qc", F.pmod(F.xxhash64("id"), F.col("qs")).cast("int")).withColumn("vc", each("vs")).select("list", "vc", "qc", "id", "x")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        width = max(1, int(pc.list_value_length(left["x"]).fill_null(0).to_numpy().max()))
        s = _matrix(left["x"].combine_chunks(), width) @ _matrix(right["x"].combine_chunks(), width).T
        best, who = _best(s, np.broadcast_to(right["id"].to_numpy(), s.shape), k)
        ids = np.broadcast_to(left["id"].to_numpy()[:, None], best.shape)
        return pa.table({"q": ids.reshape(-1), "v": who.reshape(-1), "score": best.reshape(-1)})

    pairs = qc.groupBy("list", "vc", "qc").cogroup(vc.groupBy("list", "vc", "qc")).applyInArrow(score, "q long, v long, score double")
    return _ranked(pairs, k, query_id, vec_id)


def reciprocal_rank(lists: list[DataFrame], query: str = "query_id", item: str = "item_id", k: int = 60) -> DataFrame:
    """query, item, score: each list adds 1 / (k + rank)."""
    every = None
    for x in lists:
        one = x.select(query, item, (F.lit(1.0) / (F.col("rank") + k)).alias("s"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(query, item).agg(F.sum("s").alias("score"))


def weighted_fusion(keyword: DataFrame, meaning: DataFrame, weight: float, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """query, item, score: keyword scores scaled by the query's largest, blended with similarity."""
    top = F.max("score").over(Window.partitionBy(query))
    a = keyword.select(query, item, (weight * F.col("score") / F.when(top > 0, top).otherwise(1.0)).alias("s"))
    return a.unionByName(meaning.select(query, item, ((1 - weight) * F.col("score")).alias("s"))).groupBy(query, item).agg(F.sum("s").alias("score"))


def routed_merge(keyword: DataFrame, meaning: DataFrame, keyword_leads: bool, keyword_share: int, meaning_share: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """query, item, place: the leading list's share, the other's share, then the rest; an item once, where it comes first."""
    def part(x: DataFrame, share: int, lead: bool) -> DataFrame:
        turn = F.when(F.col("rank") <= share, 0 if lead else 1).otherwise(2 if lead else 3)
        return x.select(query, item, F.struct(turn.alias("turn"), F.col("rank").alias("rank")).alias("at"))

    every = part(keyword, keyword_share, keyword_leads).unionByName(part(meaning, meaning_share, not keyword_leads))
    first = every.groupBy(query, item).agg(F.min("at").alias("at"))
    return first.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy("at", item)).alias("place"))


def retrieval_quality(ranked: DataFrame, wanted: DataFrame, ks: tuple[int, ...] = (5, 10), query: str = "query_id", item: str = "item_id") -> DataFrame:
    """One row: queries, recall at each k, mean reciprocal rank of the first wanted item. Queries without one count as 0."""
    hit = ranked.join(wanted.select(query, item).distinct(), [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("first"))
    return quality(wanted.select(query).distinct().join(hit, query, "left"), ks)


def quality(every: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """The measures of retrieval_quality, of one row per query with `first`, the rank of its first wanted item, or null."""
    return every.agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def line_hits(lines: DataFrame, key: list[str], terms: list[str], per_file: int = 20) -> DataFrame:
    """key, line_no, term: lines that hold a term, whatever its case; at most per_file lines of a file, the first ones.

    lines: key, line_no, line. The limit belongs to the operator: it reports, like a search in files.
    """
    low = F.lower("line")
    found = lines.withColumn("term", F.explode(F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))))
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy("line_no"))
    return found.withColumn("__r", rank).filter(F.col("__r") <= per_file).select(*key, "line_no", "term")


def best_windows(hits: DataFrame, key: list[str], reach: int = 12) -> DataFrame:
    """key, terms, hits, first_line, last_line: the window of each file in which most hits lie, the first of equal ones."""
    near = F.count(F.lit(1)).over(Window.partitionBy(*key).orderBy("line_no").rangeBetween(-reach, reach))
    return hits.withColumn("near", near).groupBy(*key).agg(
        F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("hits"), F.max(F.struct("near", (-F.col("line_no")).alias("neg"))).alias("best")
    ).select(*key, "terms", "hits", F.greatest(-F.col("best.neg") - reach, F.lit(1)).alias("first_line"), (-F.col("best.neg") + reach).alias("last_line"))


#: Sets and queries that one task counts at a time, and the sets that a word lies in from which they're kept as bits.
SETS, QUERIES, COMMON = 32_768, 262_144, 32


def _counted(k: int):
    def run(q: pa.Table, b: pa.Table) -> pa.Table:
        sets, asked = b["words"].combine_chunks(), q["words"].combine_chunks()
        flat = sets.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        holder = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy(zero_copy_only=False))
        in_sets = np.bincount(codes, minlength=len(flat.dictionary))
        ends, by_word = np.cumsum(in_sets), holder[np.argsort(codes, kind="stable")]
        wanted = pc.fill_null(pc.index_in(asked.flatten(), value_set=flat.dictionary), -1).to_numpy(zero_copy_only=False).reshape(-1, k)
        at = np.flatnonzero((wanted >= 0).all(axis=1))
        wanted = wanted[at]
        wanted = np.take_along_axis(wanted, np.argsort(in_sets[wanted], axis=1, kind="stable"), axis=1)
        bits: dict[int, int] = {}
        few: dict[int, set[int]] = {}
        for w in np.unique(wanted).tolist():
            where = by_word[ends[w] - in_sets[w] : ends[w]]
            if len(where) < COMMON:
                few[w] = set(where.tolist())
            else:
                row = np.zeros(len(sets), bool)
                row[where] = True
                bits[w] = int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little")
        n = np.zeros(len(at), np.int64)
        for i, (first, *rest) in enumerate(wanted.tolist()):
            if first in few:
                hit = few[first]
                for w in rest:
                    hit = hit & few[w] if w in few else {x for x in hit if bits[w] >> x & 1}
                    if not hit:
                        break
                n[i] = len(hit)
            else:
                every = bits[first]
                for w in rest:
                    every &= bits[w]
                n[i] = every.bit_count()
        found = np.flatnonzero(n)
        out = q.select(["of", "words"]).take(pa.array(at[found])).rename_columns(["scope", "words"])
        return out.append_column("n", pa.array(n[found], pa.int64()))

    return run


def sets_with_all(queries: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """scope, words, n: how many sets of its scope have all k words of each query; a query without any has no row.

    queries: scope, words, distinct; sets: scope, id, words without repeats. A task takes SETS sets and QUERIES queries of a
    scope at a time and intersects the words' postings, the rarest first; no row is written per word or per pair.
    """
    queries, sets = queries.filter("scope IS NOT NULL"), sets.filter("scope IS NOT NULL")
    blocks = lambda df, size, name: df.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    grid = broadcast_if_small(materialised(blocks(sets, SETS, "blocks").join(blocks(queries, QUERIES, "parts"), "scope")))
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    b = sets.join(grid, "scope").select("scope", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), all_of("parts").alias("part"), "words")
    q = queries.join(grid, "scope").select(F.col("scope").alias("of"), all_of("blocks").alias("block"), F.pmod(F.xxhash64("words"), F.col("parts")).cast("int").alias("part"), "words")
    n = q.groupBy("of", "block", "part").cogroup(b.groupBy("scope", "block", "part")).applyInArrow(_counted(k), "scope string, words array<string>, n long")
    return n.groupBy("scope", "words").agg(F.sum("n").alias("n"))
