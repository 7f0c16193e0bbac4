"""Files that weren't written by hand for the project: generated, shrunk, copied from elsewhere, or data kept as code.

Grammars of pairs are inferred over the tokens of every distinct content, its facts and its excerpts:

* Re-Pair replaces the most frequent pair first. What its rules save is the reuse within a file: much of it is code made by
  a tool, over short names code shrunk by one. Literals that even a grammar can't shorten, and hardly anything else, are
  data; so is a file whose many lines yield next to no tokens for a grammar.
* Re-Pair by recompression chooses the pairs by bits of the symbols' hashes instead of their counts, and names a rule by
  what it stands for. So equal passages get equal rules in all files of all repositories, and an edit changes only the
  rules across it. The rules' table says in how many repositories each occurs: contents whose rules recur in other
  repositories are shared; folders whose contents are mostly shared hold foreign code, and a file elsewhere whose rules
  come from such a folder, or from many repositories, is a copy of it.

A list of usual folder names is the prior of the folders' test, which the counts of shared contents outweigh. Generators'
output is mostly written from a template and has no more reuse than other code (figures in the README); the marks that
tools leave in names and in the first lines decide there.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.session import materialised

#: A grammar tells something from this many tokens on.
LEAST_TOKENS = 40
#: Share of tokens that rules save, and share of names of one or two letters, from which an excerpt is shrunk code.
SAVED, SHORT_NAMES = 0.5, 0.6
#: Share of a file's facts that rules save from which the file is made by a tool; excerpts repeat more and take SAVED.
FACTS_SAVED = 0.3
#: Share of an excerpt's characters in literals, and the most that rules may save of them, from which it's data.
LITERALS, LITERALS_SAVED = 0.75, 0.3
#: Tokens of a rule that says something about a content, and the share of a content's rules that makes it shared or a copy.
RULE_TOKENS, COPIED = 4, 0.5
#: Rules in so many repositories are foreign in any folder, for contents of LEAST_RULES rules; people repeat their own files in two or three.
REPOSITORIES, LEAST_RULES = 5, 8
#: A usual folder holds foreign code from this share of shared contents on, each counted in every repository that has it: a
#: library's files are few, so among distinct contents their share falls as repositories are added. The name counts as one
#: shared content of two. Any other folder needs KNOWN distinct contents in SPREAD repositories, and LEARNED of them shared.
SHARED, KNOWN, SPREAD, LEARNED = 0.1, 20, 3, 0.8
#: So many lines for each fact and one more: a file of more is data.
LINES_A_FACT = 2500

# Usual names of folders for foreign code.
FOREIGN = r"(?i)^(node_modules|bower_components|jspm_packages|third[_-]?party|_?vendor|vendored|site-packages|dist-packages|externals?|deps|static/lib)$"
# Names that tools give.
MADE_NAME = (
    r"(_pb2(_grpc)?\.pyi?|_pb\.(js|ts|d\.ts)|_grpc_web_pb\.js|\.pb\.go|\.graphql\.(ts|js)|[._]generated\.\w+|\.g\.(ts|js|dart|py)|\.gen\.(ts|js|py|go)|_gen\.go|\.designer\.\w+)$|(^|/)(__generated__|generated)/"
)
SHRUNK_NAME = r"(\.min\.(js|mjs|css)|[.-]bundle\.js|\.chunk\.js|\.[0-9a-f]{8,20}\.(chunk\.)?js)$"
# What generators write into the first lines, in the languages seen.
MADE_MARK = re.compile(
    r"""@generated\b|<auto-?generated|\bauto-?generated\b.*(?:edit|run|by|from)|code generated\b|\b(?:is|was|automatically|file|files|been) (?:automatically |auto-?)?generated\b|generated (?:on|by|from|with|at)\b.*(?:do not|don't|compiler|edit|modify)|"""
    r"""do not (?:edit|modify)|changes will be (?:lost|overwritten)|automatisch (?:erzeugt|generiert|erstellt)|nicht (?:bearbeiten|ändern|von hand)|généré (?:par|automatiquement|depuis)|ne pas (?:modifier|éditer)|"""
    r"""generado (?:por|automáticamente)|no (?:editar|modificar)|gerado (?:por|automaticamente)|сгенерирован|не (?:редактировать|изменять|править)|自动生成|请勿(?:修改|编辑)|自動生成|編集しないで""",
    re.I,
)
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|--|;|\"\"\"|''')")
#: The head of a file, in which a generator's mark stands: comments that begin within so many lines.
HEAD_LINES = 10
# Fixed value: the hash of an empty file.
EMPTY_HASH = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

TOKEN = re.compile(r"""0x[0-9a-fA-F]+|\d[\d._]*|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\W\d]\w*|\S""")
DATA_STRING = re.compile(r"""^["'](?:[0-9a-fA-F]{4,}|[A-Za-z0-9+/=]{24,}|[\d.,\s-]+)["']$""")
BARE_DATA = re.compile(r"^\s*[A-Za-z0-9+/]{40,}={0,2}\s*$")


def repair(tokens: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The Re-Pair grammar of a sequence: what is left of it, and the rules by symbol. Ties go to the smaller pair.

    Pairs are replaced in place in a linked list; the most frequent pair comes from a heap whose stale entries are
    skipped. Time is near linear in the sequence.
    """
    n = len(tokens)
    seq: list[int | None] = list(tokens)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        places.setdefault((tokens[i], tokens[i + 1]), set()).add(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    rules: dict[int, tuple[int, int]] = {}
    fresh = max(tokens, default=0) + 1
    while heap:
        count, pair = heapq.heappop(heap)
        spots = places.get(pair)
        if not spots or len(spots) < 2:
            continue
        if -count != len(spots):
            heapq.heappush(heap, (-len(spots), pair))
            continue
        a, b = pair
        used: list[int] = []
        for i in sorted(spots):
            j = nxt[i]
            if seq[i] == a and j < n and seq[j] == b and not (used and used[-1] == i):
                used.append(i)
                used.append(j)
        firsts, taken = [], set()
        for i in used[::2]:
            if i not in taken and nxt[i] not in taken:
                firsts.append(i)
                taken.update((i, nxt[i]))
        places.pop(pair, None)
        if len(firsts) < 2:
            continue
        rules[fresh] = pair
        touched: set[tuple[int, int]] = set()
        for i in firsts:
            j = nxt[i]
            p, k = prv[i], nxt[j]
            if p >= 0:
                places.get((seq[p], a), set()).discard(p)
            if k < n:
                places.get((b, seq[k]), set()).discard(j)
            seq[i], seq[j] = fresh, None
            nxt[i] = k
            if k < n:
                prv[k] = i
                places.setdefault((fresh, seq[k]), set()).add(i)
                touched.add((fresh, seq[k]))
            if p >= 0:
                places.setdefault((seq[p], fresh), set()).add(p)
                touched.add((seq[p], fresh))
        for t in touched:
            if len(places.get(t, ())) > 1:
                heapq.heappush(heap, (-len(places[t]), t))
        fresh += 1
    return [x for x in seq if x is not None], rules


def saved(tokens: list[str], least: float = 0.0) -> float:
    """The share of a sequence that its grammar saves: 0 for none, near 1 for endless repetition.

    A grammar isn't inferred, and 0 returned, if it can't save `least`: every distinct pair of neighbours lies across the
    two sides of a rule or of the rest, so rest and rules together are more than the distinct pairs, and every token occurs.
    """
    n = len(tokens)
    if n < 2:
        return 0.0
    number: dict[str, int] = {}
    seq = [number.setdefault(t, len(number)) for t in tokens]
    if 1 - max(len(number), len(set(zip(seq, seq[1:]))) + 1) / n < least:
        return 0.0
    rest, rules = repair(seq)
    return 1 - (len(rest) + 2 * len(rules)) / n


_MASK = (1 << 64) - 1


def _named(a: int, b: int) -> int:
    """The name of the rule that stands for a and b: a hash, the same in every file."""
    x = (a * 0x9E3779B97F4A7C15 + b) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return x ^ (x >> 32)


def shared_rules(tokens: list[str], least: int = RULE_TOKENS) -> list[int]:
    """Names of the rules of at least `least` tokens, by recompression: in each round runs of one symbol become a rule, and
    so does every pair whose first symbol has a 0 and whose second a 1 at the round's bit. Equal passages give equal rules,
    but for a few at their ends, wherever they stand. Time is linear: a round leaves about three quarters."""
    seq = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens]
    size = [1] * len(seq)
    found: set[int] = set()
    for bit in range(64):
        n = len(seq)
        if n < 2:
            break
        one, ones, i = [], [], 0
        while i < n:
            j = i + 1
            while j < n and seq[j] == seq[i]:
                j += 1
            if j - i > 1:
                one.append(_named(seq[i], j - i))
                ones.append(size[i] * (j - i))
                if ones[-1] >= least:
                    found.add(one[-1])
            else:
                one.append(seq[i])
                ones.append(size[i])
            i = j
        seq, size, i, n = [], [], 0, len(one)
        while i < n:
            if i + 1 < n and not one[i] >> bit & 1 and one[i + 1] >> bit & 1:
                seq.append(_named(one[i], one[i + 1]))
                size.append(ones[i] + ones[i + 1])
                if size[-1] >= least:
                    found.add(seq[-1])
                i += 2
            else:
                seq.append(one[i])
                size.append(ones[i])
                i += 1
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


def excerpt_marks(lines: list[str | None] | None, start_line: int | None) -> tuple[bool, bool, bool, bool]:
    """Whether an excerpt bears a generator's mark, reuses rules as only a generator does, is shrunk code, is data."""
    lines = [x or "" for x in lines or []]
    head = HEAD_LINES - (start_line if start_line is not None else 10**9) + 1
    marked = any(COMMENT.match(x) and MADE_MARK.search(x) for x in lines[: max(0, head)])
    total = sum(len(x.strip()) for x in lines)
    tokens = [t for x in lines for t in TOKEN.findall(x)]
    if len(tokens) < LEAST_TOKENS and total < 400:
        return marked, False, False, False
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    own = [t for t in names if t not in ("function", "return", "var", "let", "const", "if", "for", "new", "this", "void", "in", "of", "do")]
    literals = [t for t in tokens if t[0].isdigit() or DATA_STRING.match(t)]
    bare = sum(len(x.strip()) for x in lines if BARE_DATA.match(x))
    shrunk = False
    if own and sum(len(t) <= 2 for t in own) >= SHORT_NAMES * len(own) and len(own) >= 20:
        shape = ["n" if t[0].isalpha() and len(t) <= 2 else "0" if t[0].isdigit() else t for t in tokens]
        shrunk = saved(shape, SAVED) >= SAVED
    data = False
    size = sum(map(len, literals)) + 4 * len(literals)
    if bare < 0.5 * total and len(literals) >= 20 and size >= LITERALS * (total - sum(x.count(" ") for x in lines)) * 0.9 and len(names) <= 0.1 * len(tokens):
        data = saved(literals) <= LITERALS_SAVED
    made = not shrunk and len(tokens) >= LEAST_TOKENS and saved(tokens, SAVED) >= SAVED
    return marked, made, shrunk, data


FACTS = ["definitions", "imports", "calls", "inheritance", "loc", "truncated"]


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def fact_tokens() -> Column:
    """A file's facts in order, as tokens: imports, definitions, calls, inheritance."""
    none = F.array().cast("array<string>")

    def each(column: str, tokens) -> Column:
        real = F.filter(F.col(column), lambda x: x.isNotNull())
        return F.coalesce(F.flatten(F.transform(real, tokens)), none)

    return F.concat(
        each("imports", lambda x: F.concat(F.array(F.lit("import"), _text(x["specifier"])), F.transform(F.coalesce(x["names"], none), _text))),
        each("definitions", lambda x: F.array(_text(x["kind"]), F.coalesce(x["signature"], x["name"], F.lit("")), _text(x["docstring"]))),
        each("calls", lambda x: F.array(F.lit("call"), _text(x["callee"]), _text(x["enclosing"]))),
        each("inheritance", lambda x: F.array(F.lit("extends"), _text(x["child"]), _text(x["parent_name"]))),
    )


def fact_counts() -> list[Column]:
    """names, short_names, facts of a file."""
    n = lambda c: F.greatest(F.size(F.filter(F.col(c), lambda x: x.isNotNull())), F.lit(0))
    short = F.size(F.filter(F.col("definitions"), lambda x: x.isNotNull() & (F.length(_text(x["name"])) <= 2)))
    return [n("definitions").alias("names"), F.greatest(short, F.lit(0)).alias("short_names"), (n("definitions") + n("calls") + n("imports") + n("inheritance")).alias("facts")]


def content_marks(tokens: list[str], names: int, short_names: int) -> tuple[bool, bool, list[int]]:
    """Whether the facts are those of code made by a tool, of shrunk code, and the names of their shared rules."""
    reused = len(tokens) >= LEAST_TOKENS and saved(tokens, FACTS_SAVED) >= FACTS_SAVED
    short = names > 0 and short_names >= SHORT_NAMES * names
    return reused and not short, reused and short, shared_rules(tokens)


def content_evidence(contents: DataFrame) -> DataFrame:
    """key, blank, made, shrunk, data, rules of every distinct content: key, content_hash, loc, truncated, tokens, names, short_names, facts."""
    blank = (F.col("content_hash") == EMPTY_HASH) | (F.coalesce("loc", F.lit(0)) <= 1) & (F.col("facts") == 0)
    data = (F.coalesce("loc", F.lit(0)) >= LINES_A_FACT * (1 + F.col("facts"))) | F.coalesce("truncated", F.lit(False)) & (F.col("facts") <= 1)
    source = contents.select("key", F.coalesce(blank, F.lit(False)).alias("blank"), data.alias("data"), "tokens", "names", "short_names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [content_marks(t, n, k) for t, n, k in zip(b["tokens"].to_pylist(), b["names"].to_pylist(), b["short_names"].to_pylist())]
            cols = list(zip(*found)) if found else [[], [], []]
            kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["key"], b["blank"], b["data"], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["key", "blank", "data", "made", "shrunk", "rules"])

    return source.mapInArrow(run, "key long, blank boolean, data boolean, made boolean, shrunk boolean, rules array<long>")


def excerpt_evidence(excerpts: DataFrame) -> DataFrame:
    """repo, path, marked, made, shrunk, data of every row of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [excerpt_marks(x, s) for x, s in zip(b["lines"].to_pylist(), b["start_line"].to_pylist())]
            cols = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b["repo"], b["path"], *(pa.array(c, pa.bool_()) for c in cols)], names=["repo", "path", "marked", "made", "shrunk", "data"])

    return excerpts.select("repo", "path", "lines", "start_line").mapInArrow(run, "repo string, path string, marked boolean, made boolean, shrunk boolean, data boolean")


def folders_of(path: Column) -> Column:
    """The names of a file's folders, and those of each two in a row."""
    parts = F.split(F.lower(path), "/")
    names = F.slice(parts, 1, F.size(parts) - 1)
    pairs = F.zip_with(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda a, b: F.concat_ws("/", a, b))
    return F.array_distinct(F.concat(names, pairs))


def foreign_folders(files: DataFrame, shared: DataFrame) -> DataFrame:
    """folder: the folder names under which contents mostly recur in other repositories. files: repo, path, key; shared: key."""
    under = files.select("repo", "key", F.explode(folders_of(F.col("path"))).alias("folder")).distinct().join(shared.select("key", F.lit(1).alias("s")), "key", "left")
    n = under.groupBy("folder", "key").agg(F.max(F.coalesce("s", F.lit(0))).alias("s"), F.count(F.lit(1)).alias("repos")).groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("k"), F.sum("repos").alias("places"), F.sum(F.col("s") * F.col("repos")).alias("known")
    )
    repos = under.select("folder", "repo").distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("repos"))
    usual = F.col("folder").rlike(FOREIGN)
    listed = usual & (F.col("known") + 1 >= SHARED * (F.col("places") + 2))
    learned = ~usual & (F.col("n") >= KNOWN) & (F.col("repos") >= SPREAD) & (F.col("k") >= LEARNED * F.col("n"))
    return n.join(repos, "folder").filter(listed | learned).select("folder")


def made_files(facts: DataFrame, excerpts: DataFrame) -> DataFrame:
    """repo, path, reasons: the files of facts_py, in any snapshot, that weren't written by hand for the project.

    reasons is an array of 'foreign', 'copy', 'made' (by the grammar), 'marked' (by a tool's name or mark), 'shrunk',
    'named_shrunk', 'data'. A file without excerpts is judged by its facts. Rows with a null repo or path name no file and
    are ignored. An empty file is a case only in a folder for foreign code. Extra columns are ignored.
    """
    rows = facts.filter("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path", "content_hash", *FACTS)
    rows = rows.withColumn("key", F.xxhash64("content_hash", *FACTS))
    files = materialised(rows.select("repo", "path", "content_hash", "key").distinct())
    once = rows.drop("repo", "path").dropDuplicates(["key"])
    contents = materialised(content_evidence(once.select("key", "content_hash", "loc", "truncated", fact_tokens().alias("tokens"), *fact_counts())))
    full = contents.filter("NOT blank")
    # rules and the repositories they occur in; equal contents are one
    held = files.select("key", F.xxhash64("repo").alias("r")).distinct()
    rules = full.select("key", F.explode("rules").alias("rule"))
    spread = rules.join(held, "key").groupBy("rule", "r").agg(F.lit(1).alias("one")).groupBy("rule").agg(F.count(F.lit(1)).alias("repos"))
    per = rules.join(spread.filter("repos > 1"), "rule").groupBy("key").agg(F.count(F.lit(1)).alias("two"), F.sum((F.col("repos") >= REPOSITORIES).cast("long")).alias("many"))
    rated = materialised(full.select("key", F.size("rules").alias("n")).join(per, "key", "left").fillna(0))
    hashes = files.filter("content_hash IS NOT NULL").join(full.select("key"), "key", "left_semi").groupBy("content_hash").agg(F.max("repo").alias("last"), F.min("repo").alias("first")).filter("first < last")
    shared = rated.filter((F.col("n") > 0) & (F.col("two") >= COPIED * F.col("n"))).select("key").unionByName(files.join(hashes, "content_hash", "left_semi").select("key")).distinct()
    folders = foreign_folders(files.join(full.select("key"), "key", "left_semi"), shared)
    foreign = materialised(files.select("repo", "path", "key", "content_hash", F.explode(folders_of(F.col("path"))).alias("folder")).join(folders, "folder", "left_semi").select("repo", "path", "key", "content_hash").distinct())
    home = files.join(foreign.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    source = foreign.select("key").distinct().join(full.select("key", "rules"), "key")
    anchored = source.select(F.explode("rules").alias("rule")).distinct()
    near = rules.join(anchored, "rule", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("anchored"))
    copied = rated.join(near, "key", "left").filter((F.col("n") > 0) & ((F.coalesce("anchored", F.lit(0)) >= COPIED * F.col("n")) | ((F.col("n") >= LEAST_RULES) & (F.col("many") >= COPIED * F.col("n")))))
    same = foreign.filter("content_hash IS NOT NULL").join(full.select("key"), "key", "left_semi").select("content_hash").distinct()
    copies = home.join(copied.select("key"), "key", "left_semi").select("repo", "path").unionByName(home.join(same, "content_hash", "left_semi").select("repo", "path"))
    kinds = ["foreign", "copy", "made", "marked", "shrunk", "named_shrunk", "data"]

    def part(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("repo", "path", *[given.get(k, F.lit(False)).alias(k) for k in kinds], given.get("listed", F.lit(False)).alias("listed"))

    every = [
        part(files.join(contents, "key"), made=F.col("made"), shrunk=F.col("shrunk"), data=F.col("data"), marked=F.col("path").rlike(MADE_NAME), named_shrunk=F.col("path").rlike(SHRUNK_NAME), listed=F.lit(True)),
        part(foreign, foreign=F.lit(True)),
        part(copies, copy=F.lit(True)),
        part(excerpt_evidence(excerpts).filter("marked OR made OR shrunk OR data"), made=F.col("made"), marked=F.col("marked"), shrunk=F.col("shrunk"), data=F.col("data")),
    ]
    whole = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    out = whole.groupBy("repo", "path").agg(*[F.max(c).alias(c) for c in [*kinds, "listed"]]).filter("listed")
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in kinds]))
    return out.select("repo", "path", reasons.alias("reasons")).filter(F.size("reasons") > 0)
