from __future__ import annotations

from weftwork.operators import extraction as X

PY = '''"""Doc."""
import os.path as p
from ..services import users, jobs as j
from . import *

LIMIT = 3

class Base(models.Model):
    """Every base.

    More."""
    def run(self, a, *args, key=None, **rest):
        self.help(1)
        def inner():
            return Thing(a)
        return users.load(a, key=1)

@router.get("/users/{id}")
async def _show(id): return requests.post("/api/x", json={})

@app.route("/old", methods=["POST", "PUT"])
def old(): pass
'''

TS = '''// import nothing from "x"
import React, { useState, type Foo } from "react";
import * as api from "./api";
import type { T } from './t';
import "./side.css";
export { a, b as c } from "./barrel";
export * from "./star"; export * as ns from "./ns";
const re = /import "q" from (x)/g, s = `call(${1})`;
export const LIMIT = 3;
export interface Shape extends Base { x: number }
export type Id = string;
export default class Form extends ui.Panel implements Shape {
  constructor(a) { super(a); }
  render(x, y: number): string { this.help(x); return new Thing(1, f(2)); }
}
export async function load(id, { a, b } = {}, ...rest) { return fetch("/api/users", { method: "POST" }); }
const Box = ({ children }) => { useState(0); return <Panel.Item id={1}><Form/></Panel.Item>; };
const plain = x => x + 1;
app.get("/users/:id", show);
axios.delete("/api/x");
'''


def test_python_files():
    f = X.python_facts(PY)
    assert [(d["qualified_name"], d["kind"], d["signature"], d["docstring"], d["exported"], d["parent"]) for d in f["definitions"]] == [
        ("LIMIT", "constant", "LIMIT", None, True, None), ("Base", "class", "Base", "Every base.", True, None), ("Base.run", "method", "run(self, a, *args, key, **rest)", None, True, "Base"),
        ("Base.run.inner", "function", "inner()", None, True, "Base.run"), ("_show", "function", "_show(id)", None, False, None), ("old", "function", "old()", None, True, None),
    ]
    assert [(i["specifier"], i["names"], i["alias"], i["is_wildcard"]) for i in f["imports"]] == [("os.path", [], "p", False), ("..services", ["users", "jobs"], "j", False), (".", [], None, True)]
    assert [(c["callee"], c["enclosing"], c["argument_count"], c["is_construction"]) for c in f["calls"] if c["enclosing"]] == [
        ("self.help", "Base.run", 1, False), ("Thing", "Base.run.inner", 1, True), ("users.load", "Base.run", 2, False), ("requests.post", "_show", 2, False)]
    assert f["inheritance"] == [{"child": "Base", "parent_name": "models.Model", "kind": "extends", "line": 8}]
    assert [(r["method"], r["path"], r["handler"]) for r in f["routes"]] == [("GET", "/users/{id}", "_show"), ("POST", "/old", "old"), ("PUT", "/old", "old")]
    assert [(h["method"], h["path"], h["caller"]) for h in f["http_calls"]] == [("POST", "/api/x", "_show")]
    assert X.python_facts("def (")["has_syntax_errors"]


def test_script_files():
    f = X.script_facts(TS)
    assert [(i["specifier"], i["names"], i["alias"], i["is_wildcard"], i["is_reexport"], i["exported_as"]) for i in f["imports"]] == [
        ("react", ["default", "useState", "Foo"], "React", False, False, []), ("./api", [], "api", True, False, []), ("./t", ["T"], None, False, False, []), ("./side.css", [], None, False, False, []),
        ("./barrel", ["a", "b"], None, False, True, ["a", "c"]), ("./star", [], None, True, True, []), ("./ns", [], "ns", True, True, []),
    ]
    assert [(d["qualified_name"], d["kind"], d["signature"], d["exported"]) for d in f["definitions"]] == [
        ("LIMIT", "constant", "LIMIT", True), ("Shape", "interface", "Shape", True), ("Id", "type", "Id", True), ("Form", "class", "Form", True), ("Form.render", "method", "render(x, y)", True),
        ("load", "function", "load(id, rest)", True), ("Box", "component", "Box()", False), ("plain", "function", "plain(x)", False),
    ]
    assert [(x["child"], x["parent_name"], x["kind"]) for x in f["inheritance"]] == [("Shape", "Base", "extends"), ("Form", "ui.Panel", "extends"), ("Form", "Shape", "implements")]
    assert f["default_export"] == "Form"
    assert ("this.help", "Form.render", 1, False) in [(c["callee"], c["enclosing"], c["argument_count"], c["is_construction"]) for c in f["calls"]]
    assert ("Thing", True, 2) in [(c["callee"], c["is_construction"], c["argument_count"]) for c in f["calls"]]
    assert [(r["component"], r["enclosing"]) for r in f["renders"]] == [("Panel.Item", "Box"), ("Form", "Box")]
    assert [(r["method"], r["path"], r["handler"]) for r in f["routes"]] == [("GET", "/users/:id", "show")]
    assert [(h["method"], h["path"], h["caller"]) for h in f["http_calls"]] == [("POST", "/api/users", "load"), ("DELETE", "/api/x", None)]


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_CALLS", 5)
    assert X.facts_of("a.py", "\n".join(f"f{i}()" for i in range(9)))["truncated"]
    rows = [("a.py", "x()"), ("a.py", "x()"), ("b.ts", None), ("c.md", "# x()"), (None, "x"), ("d.js", "")]
    got = X.extracted(spark.createDataFrame(rows, "path string, text string"), ["path"]).select("path", "calls.callee").collect()
    assert sorted((r[0] or "", len(r[1])) for r in got) == [("", 0), ("a.py", 1), ("a.py", 1), ("b.ts", 0), ("c.md", 0), ("d.js", 0)]
