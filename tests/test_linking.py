from __future__ import annotations

import pytest

from weftwork.operators import linking as L

DEF = "struct<name:string,kind:string,qualified_name:string,start_line:int,end_line:int,signature:string,docstring:string,exported:boolean,parent:string>"
IMP = "struct<specifier:string,names:array<string>,alias:string,line:int,is_wildcard:boolean,is_type_only:boolean,is_reexport:boolean,exported_as:array<string>>"
CALL = "struct<callee:string,line:int,receiver:string,enclosing:string,argument_count:int,is_construction:boolean>"
SCHEMA = f"repo string, path string, definitions array<{DEF}>, imports array<{IMP}>, calls array<{CALL}>, renders array<struct<component:string,line:int,enclosing:string>>, inheritance array<struct<child:string,parent_name:string,kind:string,line:int>>, default_export string"


def d(name, parent=None):
    return (name.rsplit(".", 1)[-1], "function", name, 1, 2, name, None, True, parent)


def i(spec, *names, alias=None, wild=False, re=None):
    return (spec, list(names), alias, 1, wild, False, re is not None, list(re or []))


def c(callee, enclosing=None, line=1):
    return (callee, line, callee.rpartition(".")[0] or None, enclosing, 0, False)


def repo(spark, *files):
    rows = [("r", f["path"], f.get("defs", []), f.get("imports", []), f.get("calls", []), f.get("renders", []), f.get("parents", []), f.get("default")) for f in files]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("path, want", [("a/./b//c", "a/b/c"), ("a/b/../c", "a/c"), ("../x", None), ("a/../../x", None), ("/etc/x", None), (".", None), ("a/..", None)])
def test_normal_paths(spark, path, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(L.normal_path(F.lit(path)).alias("p")).first()["p"] == want


def test_imports_of_every_kind(spark):
    importer = {"path": "apps/web/src/pages/home.ts", "imports": [
        i("../lib/util", "u"), i("./missing"), i("../../../../../out"), i("@/lib/util"), i("@ui/button"), i("shared/log"), i("@acme/auth/signup"), i("@acme/auth"), i("@acme/plain/deep"), i("react", "useState"), i("@scope/pkg/sub"), i("node:fs/promises"), i("../lib"), i(" "),
    ]}
    python = {"path": "src/pkg/api/handlers.py", "imports": [i("..services", "users"), i(".models"), i("."), i("....up"), i("pkg.core"), i("os.path"), i("pkg.services.users")]}
    rest = [{"path": p} for p in (
        "apps/web/src/lib/util.ts", "apps/web/src/lib/index.tsx", "apps/web/src/lib/util/index.ts", "libs/ui/button.tsx", "shared/log.js", "packages/auth/src/signup.ts", "packages/auth/main.ts", "packages/plain/src/deep.ts",
        "src/pkg/services/__init__.py", "src/pkg/api/models.py", "src/pkg/api/__init__.py", "src/pkg/core.py", "src/pkg/services/users.py",
    )]
    files = repo(spark, importer, python, *rest)
    scopes = spark.createDataFrame([("r", "", "", []), ("r", "apps/web", None, [("@/*", ["./src/*"]), ("@ui/*", ["../../libs/none/*", "../../libs/ui/*"]), ("*", ["./never/*"])])], L.SCOPES)
    roots = spark.createDataFrame([("r", 0, ""), ("r", 1, "src")], L.ROOTS)
    packages = spark.createDataFrame([("r", "@acme/auth", "packages/auth", [("./*", ["./src/*.ts"]), (".", ["./main.ts"])], []), ("r", "@acme/plain", "packages/plain", [], [])], L.PACKAGES)
    got = {(r["path"][-4:], r["ord"]): r["target"] or (r["package"] and "pkg:" + r["package"]) for r in L.resolved_imports(files, scopes, roots, packages).collect()}
    assert [got["e.ts", k] for k in range(14)] == [
        "apps/web/src/lib/util.ts", None, None, "apps/web/src/lib/util.ts", "libs/ui/button.tsx", "pkg:shared", "packages/auth/src/signup.ts", "packages/auth/main.ts", "packages/plain/src/deep.ts",
        "pkg:react", "pkg:@scope/pkg", "pkg:fs", "apps/web/src/lib/index.tsx", None,
    ]
    assert [got["s.py", k] for k in range(7)] == ["src/pkg/services/__init__.py", "src/pkg/api/models.py", "src/pkg/api/__init__.py", None, "src/pkg/core.py", "pkg:os", "src/pkg/services/users.py"]


def test_base_folder_and_deepest_settings(spark):
    files = repo(spark, {"path": "a/b/x.ts", "imports": [i("lib/y"), i("~/z")]}, {"path": "a/x.ts", "imports": [i("lib/y"), i("~/z")]}, {"path": "a/lib/y.ts"}, {"path": "a/b/z.ts"}, {"path": "z.ts"})
    scopes = spark.createDataFrame([("r", "a", "a", [("~/*", ["../*"])]), ("r", "a/b", None, [("~/*", ["./*"])])], L.SCOPES)
    got = {(r["path"], r["ord"]): r["target"] for r in L.resolved_imports(files, scopes).collect()}
    assert got == {("a/b/x.ts", 0): None, ("a/b/x.ts", 1): "a/b/z.ts", ("a/x.ts", 0): "a/lib/y.ts", ("a/x.ts", 1): "z.ts"}


def bound(spark, *files):
    f = repo(spark, *files)
    return {(r["path"], r["callee"], r["enclosing"]): (r["in_file"], r["qualified"]) if r["qualified"] else r["package"] for r in L.bound_references(f, L.resolved_imports(f)).collect()}


def test_names_across_files(spark):
    got = bound(
        spark,
        {"path": "a.ts", "defs": [d("local"), d("C"), d("C.run", "C"), d("C.help", "C"), d("D"), d("D.help", "D")], "imports": [i("./b", "helper", "local"), i("./b", alias="ns", wild=True), i("./b", "default", alias="Form"), i("react", "useState"), i("lodash", "default", alias="_")],
         "calls": [c("local"), c("helper", "C.run"), c("ns.helper"), c("Form"), c("this.help", "C.run"), c("this.gone", "C.run"), c("self.help", "D"), c("useState"), c("_.merge"), c("user.save"), c("unknown")],
         "renders": [("Form", 3, "C.run")], "parents": [("C", "helper", "extends", 1), ("D", "ns.Shape", "implements", 2)]},
        {"path": "b.ts", "defs": [d("helper"), d("form"), d("Shape")], "default": "form"},
        {"path": "m.py", "imports": [i("pkg.users"), i("pkg", "users")], "calls": [c("pkg.users.get_user"), c("users"), c("get_user")]},
        {"path": "pkg/users.py", "defs": [d("get_user")]},
    )
    assert got["a.ts", "local", None] == ("a.ts", "local") and got["a.ts", "helper", "C.run"] == ("b.ts", "helper")
    assert got["a.ts", "ns.helper", None] == ("b.ts", "helper") and got["a.ts", "Form", None] == ("b.ts", "form")
    assert got["a.ts", "this.help", "C.run"] == ("a.ts", "C.help") and got["a.ts", "self.help", "D"] == ("a.ts", "D.help")
    assert got["a.ts", "this.gone", "C.run"] is None and got["a.ts", "user.save", None] is None and got["a.ts", "unknown", None] is None
    assert got["a.ts", "useState", None] == "react" and got["a.ts", "_.merge", None] == "lodash"
    assert got["a.ts", "helper", "C"] == ("b.ts", "helper") and got["a.ts", "ns.Shape", "D"] == ("b.ts", "Shape")
    assert got["m.py", "pkg.users.get_user", None] == ("pkg/users.py", "get_user") and got["m.py", "get_user", None] is None


def test_names_through_barrels(spark):
    user = {"path": "u.ts", "imports": [i("./bar1", "x", "y", "z", "w", "far", "Main")], "calls": [c(n) for n in ("x", "y", "z", "w", "far", "Main")]}
    got = bound(
        spark, user,
        {"path": "bar1.ts", "defs": [d("y")], "imports": [i("./bar2", "inner", re=["x"]), i("./s1", wild=True, re=[]), i("./s2", wild=True, re=[]), i("./bar1", "w", re=["w"]), i("./n1", "far", re=["far"]), i("./form", "default", re=["Main"])]},
        {"path": "bar2.ts", "imports": [i("./deep", "inner", re=["inner"])]},
        {"path": "deep.ts", "defs": [d("inner")]},
        {"path": "s1.ts", "defs": [d("z")]}, {"path": "s2.ts", "defs": [d("z"), d("y")]},
        {"path": "n1.ts", "imports": [i("./n2", "far", re=["far"])]}, {"path": "n2.ts", "imports": [i("./n3", "far", re=["far"])]}, {"path": "n3.ts", "imports": [i("./n4", "far", re=["far"])]}, {"path": "n4.ts", "defs": [d("far")]},
        {"path": "form.ts", "default": "login", "imports": [i("./deep", "inner"), i("./login", "default", alias="login")]}, {"path": "login.ts", "defs": [d("login_form")], "default": "login_form"},
    )
    assert got["u.ts", "x", None] == ("deep.ts", "inner") and got["u.ts", "y", None] == ("bar1.ts", "y")
    assert got["u.ts", "z", None] == ("s1.ts", "z")  # the first of two that pass all on
    assert got["u.ts", "w", None] is None  # a file that passes on from itself
    assert got["u.ts", "far", None] is None  # four files deep is too deep
    assert got["u.ts", "Main", None] == ("login.ts", "login_form")


def test_empty_repository(spark):
    f = repo(spark)
    linked = L.resolved_imports(f)
    assert linked.count() == 0 and L.bound_references(f, linked).count() == 0
