from __future__ import annotations

from weftwork.llm import handwritten as H

FACTS = "repo string, path string, content_hash string, loc int, truncated boolean, definitions array<struct<kind string, name string, signature string, docstring string>>, imports array<struct<specifier string, names array<string>>>, calls array<struct<callee string, enclosing string>>, inheritance array<struct<child string, parent_name string>>"
EXCERPTS = "repo string, path string, lines array<string>, start_line int"


def facts(path, words, repo="a/one", calls=(), loc=200, truncated=False, imports=()):
    return (repo, path, f"{repo} {path}", loc, truncated, [("function", w, f"{w}(x)", f"about {w}") for w in words], [(i, [i]) for i in imports], list(calls), [])


def made(spark, rows, excerpts=()):
    found = H.made_files(spark.createDataFrame(rows, FACTS), spark.createDataFrame(list(excerpts), EXCERPTS))
    return {(r["repo"], r["path"]): r["reasons"] for r in found.collect()}


def test_rule_reuse_in_facts_flags_files_without_name_or_excerpt(spark):
    calls = [(c, "register") for _ in range(40) for c in ("writer.field", "writer.type", "writer.end")]
    varied = [(f"step{i}", f"part{i * 7 % 31}") for i in range(120)]
    found = made(spark, [facts("app/messages.py", ["register"], calls=calls), facts("app/steps.py", ["register"], calls=varied)])
    assert found == {("a/one", "app/messages.py"): ["made"]}


def test_rule_reuse_in_excerpts_flags_files_without_a_mark(spark):
    repeated = ["    table.register(field, kind, None)"] * 40
    varied = [f"    step{i}(part{i * 7 % 31}, value{i})" for i in range(40)]
    rows = [facts("app/table.py", ["load"]), facts("app/steps.py", ["save"])]
    found = made(spark, rows, [("a/one", "app/table.py", repeated, 300), ("a/one", "app/steps.py", varied, 300)])
    assert found == {("a/one", "app/table.py"): ["made"]}


def test_truncated_file_without_facts_is_data(spark):
    long = facts("app/long.py", [f"step{i}" for i in range(30)], loc=8000, truncated=True)
    found = made(spark, [facts("app/codes.js", [], loc=2, truncated=True), facts("app/few.js", [], loc=2), long])
    assert found == {("a/one", "app/codes.js"): ["data"]}


WORDS = [f"part{i}" for i in range(24)]


def test_copy_in_many_repositories_is_foreign_without_a_folder_for_it(spark):
    rows = [facts(f"lib/{r}.py", WORDS, repo=f"a/{r}") for r in ("one", "two", "three", "four", "five")]
    rows += [facts(f"lib/{r}.py", [f"own{i}" for i in range(12)], repo=f"a/{r}") for r in ("six", "seven", "eight")]  # repeated in a project's own
    assert made(spark, rows) == {(f"a/{r}", f"lib/{r}.py"): ["copy"] for r in ("one", "two", "three", "four", "five")}


def test_edited_copy_of_foreign_code_is_found(spark):
    edited = ["fresh", *WORDS[:11], "inserted", *WORDS[11:]]
    own = [*WORDS[:4], *[f"own{i}" for i in range(20)]]
    found = made(spark, [facts("vendored/parts.py", WORDS), facts("app/parts.py", edited, repo="a/two"), facts("app/own.py", own, repo="a/two")])
    assert found == {("a/one", "vendored/parts.py"): ["foreign"], ("a/two", "app/parts.py"): ["copy"]}


def test_folder_stays_foreign_when_few_library_files_recur_in_many_repositories(spark):
    """Each repository adds files of its own to the folder, so the one library file is an ever smaller share of the contents."""
    library = [(f"a/r{i}", "vendored/parts.py", "same", *facts("", WORDS)[3:]) for i in range(30)]
    fresh = [facts(f"vendored/own{i}_{j}.py", [f"w{i}_{j}_{k}" for k in range(12)], repo=f"a/r{i}") for i in range(30) for j in range(2)]
    home = [facts(f"app/own{i}.py", [f"h{i}_{k}" for k in range(12)], repo=f"a/r{i}") for i in range(30)]
    assert made(spark, library + fresh + home) == {(r[0], r[1]): ["foreign"] for r in library + fresh}
