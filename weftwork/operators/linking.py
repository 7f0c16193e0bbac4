"""What imports and names in source files refer to: files, packages, and definitions in other files.

Everything is joined by equality: an import is spread over the few paths it may mean, a name is looked up in tables of
definitions, imports and re-exports. Re-exports are followed REEXPORTS files deep by as many joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.ids import owning_module
from weftwork.functions.text import npm_package, python_distribution
from weftwork.operators.incremental import newest
from weftwork.session import materialised

# Endings of a JavaScript module path in the order in which they're tried, and those of a Python one.
JS_CANDIDATES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs"]
PY_CANDIDATES = [".py", "/__init__.py"]
# Fixed value: how many files a re-exported name is followed through.
REEXPORTS = 3

SCOPES = "repo string, dir string, base_url string, patterns array<struct<pattern:string,targets:array<string>>>"
ROOTS = "repo string, ord int, root string"
PACKAGES = "repo string, name string, dir string, exports array<struct<pattern:string,targets:array<string>>>, entry array<string>"

_STRINGS = "array<string>"


def normal_path(path: Column) -> Column:
    """A path without '.', '..' and empty parts; null if it leads out of the repository, is absolute, or nothing is left."""
    start = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit(False).alias("out"))

    def step(at: Column, part: Column) -> Column:
        up, done = part == "..", at["done"]
        rest = F.when((part == "") | (part == "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
        return F.struct(rest.alias("done"), (at["out"] | (up & (F.size(done) == 0))).alias("out"))

    whole = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~path.startswith("/") & ~whole["out"] & (F.size(whole["done"]) > 0), F.array_join(whole["done"], "/"))


def joined(folder: Column, path: Column) -> Column:
    return F.when(F.coalesce(folder, F.lit("")) == "", path).otherwise(F.concat(folder, F.lit("/"), path))


def pattern_targets(specifier: Column, patterns: Column) -> Column:
    """The targets that a map of patterns gives a specifier: one * may stand for anything, longer beginnings come first."""

    def one(p: Column, i: Column) -> Column:
        star = F.contains(p["pattern"], F.lit("*"))
        head = F.substring_index(p["pattern"], "*", 1)
        tail = F.substring(p["pattern"], F.length(head) + 2, F.length(p["pattern"]))
        fits = F.when(star, F.startswith(specifier, head) & F.endswith(specifier, tail)).otherwise(specifier == p["pattern"])
        text = F.substring(specifier, F.length(head) + 1, F.length(specifier) - F.length(head) - F.length(tail))
        found = F.when(star, F.transform(p["targets"], lambda t: F.replace(t, F.lit("*"), text))).otherwise(p["targets"])
        return F.struct((-F.length(head)).alias("k"), i.alias("i"), F.when(fits, found).alias("t"))

    ranked = F.array_sort(F.filter(F.transform(F.coalesce(patterns, F.array().cast("array<struct<pattern:string,targets:array<string>>>")), one), lambda x: x["t"].isNotNull()))
    return F.flatten(F.transform(ranked, lambda x: x["t"]))


def imports(files: DataFrame) -> DataFrame:
    """repo, path, ord and what every import says."""
    return files.select("repo", "path", F.posexplode("imports").alias("ord", "i")).select("repo", "path", "ord", F.trim("i.specifier").alias("specifier"), "i.names", "i.alias", "i.line", "i.is_wildcard", "i.is_reexport", "i.exported_as")


def scoped(paths: DataFrame, scopes: DataFrame) -> DataFrame:
    """repo, path, dir, base_url, patterns: the settings of the deepest folder above each file that has any."""
    here = owning_module(F.col("path"))
    up = F.concat(F.array(F.lit("")), F.when(here.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(F.split(here, "/"))), lambda n: F.array_join(F.slice(F.split(here, "/"), F.lit(1), n), "/"))).otherwise(F.array().cast(_STRINGS)))
    steps = paths.select("repo", "path", F.posexplode(up).alias("depth", "dir"))
    hit = steps.join(scopes, ["repo", "dir"])
    return newest(hit, ["repo", "path"], [F.desc("depth")]).select("repo", "path", "dir", "base_url", "patterns")


def resolved_imports(files: DataFrame, scopes: DataFrame | None = None, roots: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """imports with `target` (the path of the file meant, or null) and `package` (what it is otherwise, or null).

    JavaScript: a relative path; else the aliases and the base folder of the settings above the importer (scopes), then a
    package of the same repository (packages), then a foreign package. Python (files ending in .py): relative by dots, else
    every root folder (roots, the repository's own if a repository has none), then a distribution. The first path that is a
    file counts. A relative import without a file, or out of the repository, is neither. Blank specifiers mean nothing.
    """
    spark = files.sparkSession
    scopes = spark.createDataFrame([], SCOPES) if scopes is None else scopes
    roots = spark.createDataFrame([], ROOTS) if roots is None else roots
    packages = spark.createDataFrame([], PACKAGES) if packages is None else packages
    i = imports(files)
    py, spec = F.col("path").endswith(".py"), F.col("specifier")
    here = owning_module(F.col("path"))
    none = F.array().cast(_STRINGS)
    # Python
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    parts = F.when(here.isNull(), none).otherwise(F.split(here, "/"))
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (dots - 1), F.lit(0))), "/")
    py_relative = F.when(dots - 1 <= F.size(parts), F.array(F.when(rest == "", above).otherwise(joined(above, rest)))).otherwise(none)
    own_roots = roots.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "root"))), lambda r: r["root"]).alias("roots"))
    py_absolute = F.transform(F.coalesce("roots", F.array(F.lit(""))), lambda r: joined(r, rest))
    # JavaScript
    name = npm_package(spec)
    base = F.coalesce("base_url", "dir")
    aliases = F.transform(pattern_targets(spec, F.col("patterns")), lambda t: joined(base, F.regexp_replace(t, r"^\./", "")))
    based = F.when(F.col("base_url").isNotNull(), F.array(joined(F.col("base_url"), spec))).otherwise(none)
    sub = F.concat(F.lit("."), F.substring(spec, F.length(name) + 1, F.length(spec)))
    entry = F.when(sub == ".", F.concat(F.coalesce("entry", none), F.array(F.lit("./src/index")))).otherwise(F.array(sub, F.concat(F.lit("./src/"), F.regexp_replace(sub, r"^\./", ""))))
    mapped = F.when(F.coalesce(F.size("exports"), F.lit(0)) > 0, pattern_targets(sub, F.col("exports"))).otherwise(entry)
    inner = F.transform(F.filter(mapped, lambda t: t != ""), lambda t: joined(F.col("home"), t))
    whole = F.when(sub == ".", F.array(F.when(F.col("home") == "", F.lit(".")).otherwise(F.col("home")))).otherwise(none)
    workspace = F.when(F.col("home").isNotNull(), F.concat(inner, whole)).otherwise(none)
    relative = spec.startswith(".")
    js = F.when(relative, F.array(joined(here, spec))).otherwise(F.concat(aliases, based, workspace))
    full = i.join(scoped(files.select("repo", "path"), scopes), ["repo", "path"], "left").join(own_roots, "repo", "left")
    full = full.withColumn("__name", name).join(packages.select("repo", F.col("name").alias("__name"), F.col("dir").alias("home"), "exports", "entry"), ["repo", "__name"], "left")
    places = F.when(spec == "", none).when(py & relative, py_relative).when(py, py_absolute).otherwise(js)
    endings = F.when(py, F.array(*map(F.lit, PY_CANDIDATES))).otherwise(F.array(*map(F.lit, JS_CANDIDATES)))
    spread = full.select("repo", "path", "ord", F.posexplode(places).alias("k", "place"), endings.alias("endings")).withColumn("place", normal_path(F.col("place"))).filter("place IS NOT NULL")
    tried = spread.select("repo", "path", "ord", "k", "place", F.posexplode("endings").alias("e", "ending")).select("repo", "path", "ord", "k", "e", F.concat("place", "ending").alias("candidate"))
    hit = tried.join(files.select("repo", F.col("path").alias("candidate")), ["repo", "candidate"]).groupBy("repo", "path", "ord").agg(F.min_by("candidate", F.struct("k", "e")).alias("target"))
    package = F.when(F.col("target").isNull() & ~relative & (spec != ""), F.when(py, python_distribution(spec)).otherwise(name))
    return i.join(hit, ["repo", "path", "ord"], "left").withColumn("package", package)


# --- names --------------------------------------------------------------------------------------------------------


def name_table(files: DataFrame) -> DataFrame:
    """repo, path, name, qualified: one definition per simple name of a file. The last top-level one wins; without any, the
    first inner one."""
    d = files.select("repo", "path", F.posexplode("definitions").alias("pos", "d")).select("repo", "path", "pos", "d.name", F.col("d.qualified_name").alias("qualified"), F.col("d.parent").isNull().alias("top"))
    return newest(d, ["repo", "path", "name"], [F.desc("top"), F.when(F.col("top"), -F.col("pos")).otherwise(F.col("pos"))]).select("repo", "path", "name", "qualified")


def bindings(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of what imported names mean in a file, the last import of a name counting.

    names: repo, path, name, file, symbol, package. namespaces: repo, path, name, file: whole modules by alias or dotted
    specifier. linked: the result of resolved_imports.
    """
    used = linked.filter("NOT coalesce(is_reexport, false) AND (target IS NOT NULL OR package IS NOT NULL)")
    plain = F.coalesce("names", F.array().cast(_STRINGS))
    each = used.withColumn("n", F.explode(F.transform(plain, lambda x: x)))
    alias = F.col("alias")
    inside, outside = F.col("target").isNotNull(), F.col("target").isNull()
    wild = F.coalesce("is_wildcard", F.lit(False)) & alias.isNotNull()
    null = F.lit(None).cast("string")
    named = [
        each.filter(inside & ~wild & (F.col("n") != "default")).select("repo", "path", F.col("n").alias("name"), F.col("target").alias("file"), F.col("n").alias("symbol"), null.alias("package"), "ord"),
        each.filter(inside & ~wild & (F.col("n") == "default") & alias.isNotNull()).select("repo", "path", alias.alias("name"), F.col("target").alias("file"), F.lit("default").alias("symbol"), null.alias("package"), "ord"),
        each.filter(outside & (F.col("n") != "default")).select("repo", "path", F.col("n").alias("name"), null.alias("file"), null.alias("symbol"), "package", "ord"),
        used.filter(outside & (alias.isNotNull() | (F.size(plain) == 0))).select("repo", "path", F.coalesce("alias", "specifier").alias("name"), null.alias("file"), null.alias("symbol"), "package", "ord"),
    ]
    names = newest(reduce(DataFrame.unionByName, named), ["repo", "path", "name"], [F.desc("ord"), F.col("file").asc_nulls_last()]).drop("ord")
    spaces = [
        used.filter(inside & wild).select("repo", "path", alias.alias("name"), F.col("target").alias("file"), "ord"),
        each.filter(inside & ~wild & (F.col("n") == "default") & alias.isNotNull()).select("repo", "path", alias.alias("name"), F.col("target").alias("file"), "ord"),
        used.filter(inside & ~wild & (F.size(plain) == 0)).select("repo", "path", F.coalesce("alias", "specifier").alias("name"), F.col("target").alias("file"), "ord"),
        used.filter(outside & alias.isNotNull()).select("repo", "path", alias.alias("name"), null.alias("file"), "ord"),
    ]
    namespaces = newest(reduce(DataFrame.unionByName, spaces), ["repo", "path", "name"], [F.desc("ord")]).drop("ord").filter("file IS NOT NULL")
    return names, namespaces


def reexports(linked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names: repo, path, name, file, symbol that a file passes on; stars: repo, path, k, file it passes all on from."""
    r = linked.filter("coalesce(is_reexport, false) AND target IS NOT NULL")
    wild = F.coalesce("is_wildcard", F.lit(False))
    pairs = F.arrays_zip(F.coalesce("names", F.array().cast(_STRINGS)).alias("n"), F.coalesce("exported_as", F.array().cast(_STRINGS)).alias("e"))
    one = r.filter(~wild).select("repo", "path", "ord", F.col("target").alias("file"), F.posexplode(pairs).alias("k", "p")).filter("p.n IS NOT NULL AND p.e IS NOT NULL")
    names = newest(one.select("repo", "path", "ord", "k", F.col("p.e").alias("name"), "file", F.col("p.n").alias("symbol")), ["repo", "path", "name"], [F.desc("ord"), F.desc("k")]).drop("ord", "k")
    stars = r.filter(wild & F.col("alias").isNull()).select("repo", "path", F.col("ord").alias("k"), F.col("target").alias("file"))
    return names, stars


def exported(asked: DataFrame, files: DataFrame, linked: DataFrame) -> DataFrame:
    """repo, file, name, in_file, qualified: where each asked name (repo, file, name) of a file is defined.

    A name is defined in the file; is its default export; or is passed on by it, REEXPORTS files deep, explicitly or, in
    the order of the statements, by passing all on. Names that lead nowhere are left out.
    """
    table = name_table(files).select("repo", F.col("path").alias("at"), F.col("name").alias("eff"), "qualified")
    again, stars = reexports(linked)
    again = again.select("repo", F.col("path").alias("at"), F.col("name").alias("want"), F.col("file").alias("next"), F.col("symbol").alias("next_name"))
    further = again.select("repo", "at", F.col("want").alias("eff"), F.col("next").alias("next_eff"), F.col("next_name").alias("next_eff_name"))
    stars = stars.select("repo", F.col("path").alias("at"), F.col("k").alias("star"), F.col("file").alias("star_file"))
    names = bindings(linked)[0].filter("symbol IS NOT NULL").select("repo", F.col("path").alias("at"), F.col("name").alias("eff"), F.col("file").alias("bound"), F.col("symbol").alias("bound_name"))
    default = files.filter("default_export IS NOT NULL").select("repo", F.col("path").alias("at"), F.col("default_export").alias("own"))
    front = asked.select("repo", "file", "name").distinct().select("repo", "file", "name", F.col("file").alias("at"), F.col("name").alias("want"), F.array().cast("array<int>").alias("way"))
    is_default, key = F.col("want") == "default", ["repo", "file", "name"]
    found = []
    for depth in range(REEXPORTS + 1):
        # a default export stands for a name of its file, unless the file passes a default on
        wide = front.join(again, ["repo", "at", "want"], "left").join(default, ["repo", "at"], "left")
        wide = wide.filter(~is_default | F.col("next").isNotNull() | F.col("own").isNotNull()).withColumn("eff", F.when(is_default, F.col("own")).otherwise(F.col("want")))
        wide = wide.join(table, ["repo", "at", "eff"], "left").join(names, ["repo", "at", "eff"], "left").join(further, ["repo", "at", "eff"], "left")
        passed = is_default & F.col("next").isNotNull()
        go = F.when(passed, F.struct("next", "next_name")).when(F.col("qualified").isNotNull(), None).when(is_default & F.col("bound").isNotNull(), F.struct(F.col("bound").alias("next"), F.col("bound_name").alias("next_name"))).when(
            F.col("next_eff").isNotNull(), F.struct(F.col("next_eff").alias("next"), F.col("next_eff_name").alias("next_name")))
        hit = F.when(~passed, F.col("qualified"))
        wide = materialised(wide.select(*key, "at", "eff", "way", hit.alias("hit"), go.alias("go")))
        found.append(wide.filter("hit IS NOT NULL").select(*key, "way", F.col("at").alias("in_file"), F.col("hit").alias("qualified")))
        if depth < REEXPORTS:
            onward = wide.filter("go IS NOT NULL").select(*key, F.col("go.next").alias("at"), F.col("go.next_name").alias("want"), "way")
            spread = wide.filter("hit IS NULL AND go IS NULL").join(stars, ["repo", "at"]).select(*key, F.col("star_file").alias("at"), F.col("eff").alias("want"), F.array_append("way", F.col("star")).alias("way"))
            front = onward.unionByName(spread)
            if front.isEmpty():
                break
            if depth == 0:  # names that are passed on need the tables again
                again, further, stars, names, table = (materialised(t) for t in (again, further, stars, names, table))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*key).agg(F.min_by(F.struct("in_file", "qualified"), "way").alias("r")).select(*key, "r.in_file", "r.qualified")


def mentions(files: DataFrame) -> DataFrame:
    """repo, path, kind, callee, enclosing, line of every call, render and inheritance."""
    calls = files.select("repo", "path", F.explode("calls").alias("c")).select("repo", "path", F.lit("CALLS").alias("kind"), "c.callee", "c.enclosing", "c.line")
    renders = files.select("repo", "path", F.explode("renders").alias("c")).select("repo", "path", F.lit("RENDERS").alias("kind"), F.col("c.component").alias("callee"), "c.enclosing", "c.line")
    parents = files.select("repo", "path", F.explode("inheritance").alias("c")).select("repo", "path", F.when(F.col("c.kind") == "implements", "IMPLEMENTS").otherwise("EXTENDS").alias("kind"), F.col("c.parent_name").alias("callee"), F.col("c.child").alias("enclosing"), "c.line")
    return calls.unionByName(renders).unionByName(parents).filter("callee IS NOT NULL")


def bound_references(files: DataFrame, linked: DataFrame) -> DataFrame:
    """mentions with `in_file` and `qualified`, the definition meant, or null, and `package`, where the name comes from
    outside.

    A simple name is one of the file's definitions, else an imported name. `self` and `this` mean the class around the
    code, and no other. A dotted name is followed through a namespace, by its first part or all but its last; on any other
    value it stays unknown, since a wrong edge would be worse than none.
    """
    m = mentions(files).groupBy("repo", "path", "kind", "callee", "enclosing").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.count(F.lit(1)).alias("count"))
    dotted = F.contains("callee", F.lit("."))
    head, member = F.substring_index("callee", ".", 1), F.substring_index("callee", ".", -1)
    front = F.regexp_replace("callee", r"\.[^.]*$", "")
    of_self = dotted & head.isin("self", "this")
    owner = F.when(F.contains("enclosing", F.lit(".")), F.regexp_replace("enclosing", r"\.[^.]*$", "")).otherwise(F.col("enclosing"))
    m = m.withColumns({"head": head, "member": member, "front": front, "simple": ~dotted, "of_self": of_self, "wanted": F.when(of_self & (owner != ""), F.concat(owner, F.lit("."), member))})
    names, namespaces = bindings(linked)
    table = name_table(files)
    qualified = files.select("repo", "path", F.explode("definitions").alias("d")).select("repo", "path", F.col("d.qualified_name").alias("wanted")).distinct().withColumn("inner", F.col("wanted"))
    m = m.join(table.select("repo", "path", F.col("name").alias("callee"), F.col("qualified").alias("local")), ["repo", "path", "callee"], "left")
    m = m.join(qualified, ["repo", "path", "wanted"], "left")
    m = m.join(names.select("repo", "path", F.col("name").alias("callee"), F.col("file").alias("name_file"), F.col("symbol").alias("name_symbol"), F.col("package").alias("name_package")), ["repo", "path", "callee"], "left")
    m = m.join(names.filter("package IS NOT NULL").select("repo", "path", F.col("name").alias("head"), F.col("package").alias("head_package")), ["repo", "path", "head"], "left")
    m = m.join(namespaces.select("repo", "path", F.col("name").alias("head"), F.col("file").alias("head_file")), ["repo", "path", "head"], "left")
    m = m.join(namespaces.select("repo", "path", F.col("name").alias("front"), F.col("file").alias("front_file")), ["repo", "path", "front"], "left")
    s, d = F.col("simple"), ~F.col("simple") & ~F.col("of_self")
    asked_file = F.when(s & F.col("local").isNull() & F.col("name_symbol").isNotNull(), F.col("name_file")).when(d, F.coalesce("head_file", "front_file"))
    asked_name = F.when(s, F.col("name_symbol")).otherwise(F.col("member"))
    m = m.withColumns({"file": asked_file, "name": F.when(asked_file.isNotNull(), asked_name)})
    m = materialised(m)
    there = exported(m.filter("file IS NOT NULL"), files, linked)
    m = m.join(there, ["repo", "file", "name"], "left")
    here = F.when(s, F.col("local")).when(F.col("of_self"), F.col("inner"))
    known = F.coalesce(here, F.col("qualified"))
    return m.select(
        "repo", "path", "kind", "callee", "enclosing", "lines", "count", F.when(here.isNotNull(), F.col("path")).when(known.isNotNull(), F.col("in_file")).alias("in_file"),
        known.alias("qualified"), F.when(known.isNull(), F.coalesce("name_package", "head_package")).alias("package"),
    )


def merged_references(bound: DataFrame) -> DataFrame:
    """repo, path, enclosing, in_file, qualified, kind, count, lines: references with a known definition, merged."""
    return bound.filter("qualified IS NOT NULL").groupBy("repo", "path", "enclosing", "in_file", "qualified", "kind").agg(F.sum("count").alias("count"), F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines"))


def resolution_stats(files: DataFrame, linked: DataFrame, bound: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per repository: how much of its imports, references and requests is known, with shares of 4 digits (1.0 where
    there's nothing to know)."""
    one = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n)
    i = linked.groupBy("repo").agg(F.count(F.lit(1)).alias("imports_total"), one(F.col("target").isNotNull(), "imports_to_files"), one(F.col("package").isNotNull(), "imports_to_packages"), one(F.col("target").isNull() & F.col("package").isNull(), "imports_unresolved"))
    parts = []
    for label, kinds in (("calls", ["CALLS"]), ("renders", ["RENDERS"]), ("inheritance", ["EXTENDS", "IMPLEMENTS"])):
        k = F.col("kind").isin(kinds)
        n = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0)).cast("long")
        parts += [n(k).alias(f"{label}_total"), n(k & F.col("qualified").isNotNull()).alias(f"{label}_resolved"), n(k & F.col("package").isNotNull()).alias(f"{label}_to_packages")]
    b = bound.groupBy("repo").agg(*parts)
    r = files.groupBy("repo").agg(F.coalesce(F.sum(F.size("routes")), F.lit(0)).cast("long").alias("routes_total"), F.coalesce(F.sum(F.size("http_calls")), F.lit(0)).cast("long").alias("http_calls_total"))
    q = requests.groupBy("repo").agg(one(F.col("route").isNotNull(), "http_calls_matched"))
    whole = r.join(i, "repo", "left").join(b, "repo", "left").join(q, "repo", "left")
    counts = [c for c in whole.columns if c != "repo"]
    whole = whole.select("repo", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    share = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(1.0)
    inner = F.col("imports_to_files") + F.col("imports_unresolved")
    return whole.select("repo", *counts, share(F.col("imports_to_files"), inner).alias("internal_import_resolution"), share(F.col("calls_resolved"), F.col("calls_total")).alias("call_resolution"), share(F.col("calls_resolved") + F.col("calls_to_packages"), F.col("calls_total")).alias("calls_accounted"))
