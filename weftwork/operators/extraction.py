"""Facts of source files: definitions, imports, calls, renders, inheritance, routes and requests.

Python is read by its own parser. JavaScript and TypeScript are read by a scanner that knows strings, templates, comments
and regular expressions, and a stack of braces that tells what a name stands in; it's exact for declarations, imports and
calls that are written out, and leaves out what only a full parser could tell. Files go through Arrow batches, one at a
time; a file that can't be parsed has no facts and says so.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Facts of one file that are kept at most; one that has more is marked as truncated.
MOST_DEFINITIONS, MOST_CALLS = 10_000, 50_000
# How requests and routes are named.
METHODS = {"get", "post", "put", "patch", "delete", "head", "options"}
CLIENTS = {"requests", "httpx", "axios"}

LISTS = ("definitions", "imports", "calls", "renders", "inheritance", "routes", "http_calls")
DDL = (
    "definitions array<struct<name:string,kind:string,qualified_name:string,start_line:int,end_line:int,signature:string,docstring:string,exported:boolean,parent:string>>, "
    "imports array<struct<specifier:string,names:array<string>,alias:string,line:int,is_wildcard:boolean,is_type_only:boolean,is_reexport:boolean,exported_as:array<string>>>, "
    "calls array<struct<callee:string,line:int,receiver:string,enclosing:string,argument_count:int,is_construction:boolean>>, "
    "renders array<struct<component:string,line:int,enclosing:string>>, inheritance array<struct<child:string,parent_name:string,kind:string,line:int>>, "
    "routes array<struct<method:string,path:string,framework:string,line:int,handler:string>>, http_calls array<struct<method:string,path:string,line:int,caller:string>>, "
    "default_export string, truncated boolean, has_syntax_errors boolean"
)


def empty_facts(broken: bool = False) -> dict:
    return {k: [] for k in LISTS} | {"default_export": None, "truncated": False, "has_syntax_errors": broken}


def _import(specifier, names=(), alias=None, line=0, wild=False, types=False, again=False, exported=()):
    return {"specifier": specifier, "names": list(names), "alias": alias, "line": line, "is_wildcard": wild, "is_type_only": types, "is_reexport": again, "exported_as": list(exported)}


def _definition(name, kind, above, start, end, signature, doc, exported):
    return {"name": name, "kind": kind, "qualified_name": f"{above}.{name}" if above else name, "start_line": start, "end_line": end, "signature": signature, "docstring": doc, "exported": exported, "parent": above or None}


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _arguments(a: ast.arguments) -> str:
    plain = [x.arg for x in (*a.posonlyargs, *a.args)]
    star = [f"*{a.vararg.arg}"] if a.vararg else ["*"] if a.kwonlyargs else []
    return ", ".join([*plain, *star, *(x.arg for x in a.kwonlyargs), *([f"**{a.kwarg.arg}"] if a.kwarg else [])])


def python_facts(text: str) -> dict:
    """The facts of a Python file."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return empty_facts(True)
    out = empty_facts()
    # nodes to look at, what they stand in, whether that is a class, and whether they're at the top
    work: list[tuple[list[ast.AST], str, bool, bool]] = [(tree.body, "", False, True)]
    order: list[tuple[int, int, str, dict]] = []

    def add(node: ast.AST, kind: str, fact: dict) -> None:
        order.append((node.lineno, node.col_offset, kind, fact))

    while work:
        nodes, inside, klass, top = work.pop()
        for child in nodes:
            above = inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                doc = ast.get_docstring(child)
                signature = child.name if is_class else f"{child.name}({_arguments(child.args)})"
                d = _definition(child.name, "class" if is_class else "method" if klass else "function", above, child.lineno, child.end_lineno, signature, doc.strip().split("\n")[0] if doc and doc.strip() else None, not child.name.startswith("_"))
                add(child, "definitions", d)
                for base in child.bases if is_class else ():
                    if (name := _dotted(base)) is not None:
                        add(base, "inheritance", {"child": d["qualified_name"], "parent_name": name, "kind": "extends", "line": base.lineno})
                for mark in child.decorator_list:
                    if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute) and mark.args and isinstance(mark.args[0], ast.Constant) and isinstance(mark.args[0].value, str):
                        if mark.func.attr in METHODS:
                            add(mark, "routes", {"method": mark.func.attr.upper(), "path": mark.args[0].value, "framework": "fastapi", "line": mark.lineno, "handler": d["qualified_name"]})
                        elif mark.func.attr == "route":
                            listed = next((k.value for k in mark.keywords if k.arg == "methods"), None)
                            ways = [x.value for x in listed.elts if isinstance(x, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
                            for way in ways:
                                add(mark, "routes", {"method": str(way).upper(), "path": mark.args[0].value, "framework": "flask", "line": mark.lineno, "handler": d["qualified_name"]})
                # decorators, bases and defaults are outside of what they belong to
                body = {id(x) for x in child.body}
                work.append((child.body, d["qualified_name"], is_class, False))
                work.append(([x for x in ast.iter_child_nodes(child) if id(x) not in body], inside, klass, False))
                continue
            if isinstance(child, ast.Import):
                for x in child.names:
                    add(child, "imports", _import(x.name, alias=x.asname, line=child.lineno))
            elif isinstance(child, ast.ImportFrom):
                spec = "." * child.level + (child.module or "")
                wild = any(x.name == "*" for x in child.names)
                names = [x.name for x in child.names if x.name != "*"]
                add(child, "imports", _import(spec, names, next((x.asname for x in child.names if x.asname), None), child.lineno, wild))
            elif isinstance(child, ast.Call) and (callee := _dotted(child.func)) is not None:
                short = callee.rsplit(".", 1)[-1]
                add(child, "calls", {"callee": callee, "line": child.lineno, "receiver": callee.rpartition(".")[0] or None, "enclosing": inside or None, "argument_count": len(child.args) + len(child.keywords), "is_construction": short[:1].isupper()})
                first = child.args[0] if child.args else None
                if callee.split(".")[0] in CLIENTS and short in METHODS and isinstance(first, ast.Constant) and isinstance(first.value, str):
                    add(child, "http_calls", {"method": short.upper(), "path": first.value, "line": child.lineno, "caller": inside or None})
            elif isinstance(child, ast.Assign) and top:
                for t in child.targets:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        add(child, "definitions", _definition(t.id, "constant", "", child.lineno, child.end_lineno, t.id, None, not t.id.startswith("_")))
            work.append((list(ast.iter_child_nodes(child)), above, klass, False))
    for _, _, kind, fact in sorted(order, key=lambda x: x[:2]):
        out[kind].append(fact)
    return out


_JS = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>)|(?P<spread>\.\.\.)|(?P<mark>[^\s])""",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>") | {"return", "typeof", "case", "in", "of", "=>", ""}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "new", "import", "super", "constructor", "with", "void", "in", "of", "else", "do", "yield", "class", "extends", "delete", "async", "export", "default"}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, line, before = [], 0, 1, ""
    while at < len(text):
        m = _JS.match(text, at)
        kind, value = m.lastgroup, m[0]
        if value == "/" and before in _BEFORE_REGEX and (r := _REGEX.match(text, at)):
            kind, value = "string", r[0]
        if kind != "space":
            out.append((kind, value, line))
            before = value
        line += value.count("\n")
        at += len(value)
    return out


def script_facts(text: str) -> dict:
    """The facts of a JavaScript or TypeScript file."""
    t = _tokens(text)
    out = empty_facts()
    n = len(t)
    value = lambda i: t[i][1] if 0 <= i < n else ""
    kind = lambda i: t[i][0] if 0 <= i < n else ""
    close: dict[int, int] = {}
    stack: list[int] = []
    for i, (k, v, _) in enumerate(t):
        if k == "mark" and v in "([{":
            stack.append(i)
        elif k == "mark" and v in ")]}" and stack:
            close[stack.pop()] = i
    out["has_syntax_errors"] = bool(stack)
    line = lambda i: t[min(i, n - 1)][2]
    scopes: list[tuple[int, str, bool]] = []  # where a definition's body ends, its name, whether it's a class

    def around(i: int) -> tuple[str, bool]:
        while scopes and scopes[-1][0] <= i:
            scopes.pop()
        return (scopes[-1][1], scopes[-1][2]) if scopes else ("", False)

    def arguments(i: int) -> str:
        """The names between the parentheses that begin at i."""
        names, depth, start = [], 0, True
        for j in range(i + 1, close.get(i, i)):
            v = value(j)
            if v in "([{<":
                depth += 1
            elif v in ")]}>":
                depth -= 1
            elif depth == 0 and v == ",":
                start = True
                continue
            if depth == 0 and start and kind(j) == "name":
                names.append(v)
                start = False
        return ", ".join(names)

    def body_end(i: int) -> int:
        """Where the block that begins at or after i ends; i if a statement ends before."""
        j = i
        while j < n and value(j) not in (";", "}"):
            if value(j) == "{":
                return close.get(j, n)
            j = close.get(j, j) + 1 if value(j) in "([" else j + 1
        return i

    i = 0
    while i < n:
        k, v, at = t[i]
        exported = value(i - 1) == "export" or value(i - 1) in ("default", "async", "abstract", "declare") and "export" in (value(i - 2), value(i - 3))
        above, in_class = around(i)
        if v == "import" and k == "name" and value(i + 1) != "(" and value(i - 1) != ".":
            j, names, alias, wild, types = i + 1, [], None, False, False
            if value(j) == "type" and kind(j + 1) in ("name", "mark") and value(j + 1) != "from":
                types, j = True, j + 1
            while j < n and kind(j) != "string" and value(j) != ";":
                if value(j) == "*" and value(j + 1) == "as":
                    wild, alias, j = True, value(j + 2), j + 3
                elif value(j) == "{":
                    for p in range(j + 1, close.get(j, j)):
                        if kind(p) == "name" and value(p) not in ("as", "type") and value(p - 1) in ("{", ",", "type"):
                            names.append(value(p))
                    j = close.get(j, j) + 1
                elif kind(j) == "name" and value(j) != "from":
                    names.append("default")
                    alias, j = value(j), j + 1
                else:
                    j += 1
            if kind(j) == "string":
                out["imports"].append(_import(value(j)[1:-1], names, alias, at, wild, types))
            i = j + 1
            continue
        if v == "export" and k == "name" and value(i + 1) in ("*", "{"):
            j = i + 1
            wild, alias, names, shown = value(j) == "*", None, [], []
            if wild:
                alias, j = (value(j + 2), j + 3) if value(j + 1) == "as" else (None, j + 1)
            else:
                end = close.get(j, j)
                for p in range(j + 1, end):
                    if kind(p) == "name" and value(p) not in ("as", "type") and value(p - 1) in ("{", ",", "type"):
                        names.append(value(p))
                        shown.append(value(p + 2) if value(p + 1) == "as" else value(p))
                j = end + 1
            if value(j) == "from" and kind(j + 1) == "string":
                out["imports"].append(_import(value(j + 1)[1:-1], names, alias, at, wild, False, True, shown))
                i = j + 2
                continue
            i = j
            continue
        if v == "default" and value(i - 1) == "export":
            j = i + 2 if value(i + 1) in ("async", "abstract") else i + 1
            named = value(j + 1) if value(j) in ("function", "class") and kind(j + 1) == "name" else value(j) if kind(j) == "name" and value(j) not in ("function", "class", "new") else None
            out["default_export"] = named if named != "*" else value(j + 2)
        if k == "name" and v in ("function", "class", "interface", "enum") and kind(i + 1) == "name" and value(i - 1) != ".":
            name, j = value(i + 1), i + 2
            while j < n and value(j) not in ("(", "{", ";") and not (value(j) == "=" and v != "class"):
                if value(j) in ("extends", "implements") and kind(j + 1) == "name":
                    p, parent = j + 1, value(j + 1)
                    while value(p + 1) == "." and kind(p + 2) == "name":
                        parent, p = f"{parent}.{value(p + 2)}", p + 2
                    out["inheritance"].append({"child": f"{above}.{name}" if above else name, "parent_name": parent, "kind": value(j), "line": line(j + 1)})
                j += 1
            args = arguments(j) if v == "function" and value(j) == "(" else ""
            end = body_end(close.get(j, j) + 1 if value(j) == "(" else j)
            what = "class" if v in ("class", "enum") else "interface" if v == "interface" else "component" if name[:1].isupper() and any(kind(p) == "mark" and value(p) == "<" and kind(p + 1) == "name" and value(p - 1) in ("return", "(", "=>") for p in range(j, min(end, n))) else "function"
            out["definitions"].append(_definition(name, what, above, at, line(end), f"{name}({args})" if v == "function" else name, None, exported))
            scopes.append((end, f"{above}.{name}" if above else name, v == "class"))
            i = j
            continue
        if k == "name" and v in ("const", "let", "var") and kind(i + 1) == "name" and not in_class:
            name, j = value(i + 1), i + 2
            while j < n and value(j) not in ("=", ";", ",") and line(j) - at < 20:
                j = close.get(j, j) + 1 if value(j) in "([{" else j + 1
            if value(j) == "=":
                j += 2 if value(j + 1) == "async" else 1
                arrow = value(j) == "(" and (value(close.get(j, j) + 1) in ("=>", ":")) or kind(j) == "name" and value(j + 1) == "=>" or value(j) == "function"
                if arrow:
                    p = j if value(j) == "(" else j + 1 if value(j) == "function" and value(j + 1) == "(" else None
                    args = arguments(p) if p is not None else value(j)
                    start = close.get(p, j) + 1 if p is not None else j + 1
                    end = body_end(start) if "{" in (value(start), value(start + 1)) else start + 1
                    out["definitions"].append(_definition(name, "component" if name[:1].isupper() else "function", above, at, line(end), f"{name}({args})", None, exported))
                    scopes.append((end, f"{above}.{name}" if above else name, False))
                elif name.isupper() and not above:
                    out["definitions"].append(_definition(name, "constant", "", at, at, name, None, exported))
            i += 2
            continue
        if k == "name" and v == "type" and kind(i + 1) == "name" and value(i + 2) in ("=", "<") and value(i - 1) in ("export", ";", "}", ""):
            out["definitions"].append(_definition(value(i + 1), "type", above, at, at, value(i + 1), None, exported))
            i += 2
            continue
        if in_class and k == "name" and value(i + 1) == "(" and v not in _NOT_CALLS and value(close.get(i + 1, i) + 1) in ("{", ":") and value(i - 1) not in (".", "new"):
            end = body_end(close.get(i + 1, i) + 1)
            out["definitions"].append(_definition(v, "method", above, at, line(end), f"{v}({arguments(i + 1)})", None, not v.startswith("_")))
            scopes.append((end, f"{above}.{v}", False))
            i += 2
            continue
        if k == "mark" and v == "<" and kind(i + 1) == "name" and value(i + 1)[:1].isupper() and (value(i - 1) in ("(", "return", "=>", ">", "{", "?", ":", "&", "}", ")", ";", "") or value(i - 1) == ","):
            p, name = i + 1, value(i + 1)
            while value(p + 1) == "." and kind(p + 2) == "name":
                name, p = f"{name}.{value(p + 2)}", p + 2
            if value(p + 1) in (">", "/") or kind(p + 1) == "name" or value(p + 1) == "{":
                out["renders"].append({"component": name, "line": at, "enclosing": above or None})
            i = p + 1
            continue
        if k == "name" and v not in _NOT_CALLS and value(i - 1) != ".":
            p, callee = i, v
            while value(p + 1) == "." and kind(p + 2) == "name":
                callee, p = f"{callee}.{value(p + 2)}", p + 2
            if value(p + 1) == "(" and value(i - 1) != "function":
                end = close.get(p + 1, p + 1)
                depth, commas = 0, 0
                for q in range(p + 2, end):
                    depth += (value(q) in "([{") - (value(q) in ")]}") if kind(q) == "mark" else 0
                    commas += depth == 0 and value(q) == ","
                count = 0 if end == p + 2 else commas + 1
                out["calls"].append({"callee": callee, "line": at, "receiver": callee.rpartition(".")[0] or None, "enclosing": above or None, "argument_count": count, "is_construction": value(i - 1) == "new"})
                first = value(p + 2)[1:-1] if kind(p + 2) == "string" else None
                short = callee.rsplit(".", 1)[-1]
                if first is not None and (callee == "fetch" or callee.split(".")[0] in CLIENTS and short in METHODS):
                    way = short.upper() if callee != "fetch" else next((value(q + 2)[1:-1].upper() for q in range(p + 2, end) if value(q) == "method" and value(q + 1) == ":" and kind(q + 2) == "string"), "GET")
                    out["http_calls"].append({"method": way, "path": first, "line": at, "caller": above or None})
                elif first is not None and first.startswith("/") and callee.split(".")[0] in ("app", "router") and short in METHODS:
                    handler = value(end - 1) if kind(end - 1) == "name" else None
                    out["routes"].append({"method": short.upper(), "path": first, "framework": "express", "line": at, "handler": handler})
            i = p + 1
            continue
        i += 1
    return out


def facts_of(path: str | None, text: str | None) -> dict:
    """The facts of a file by its ending; none for other languages, null or empty texts."""
    if not path or not text:
        return empty_facts()
    found = python_facts(text) if path.endswith(".py") else script_facts(text) if re.search(r"\.(jsx?|tsx?|mjs|cjs)$", path) else empty_facts()
    found["truncated"] = len(found["definitions"]) > MOST_DEFINITIONS or len(found["calls"]) > MOST_CALLS
    found["definitions"], found["calls"] = found["definitions"][:MOST_DEFINITIONS], found["calls"][:MOST_CALLS]
    return found


def extracted(sources: DataFrame, keep: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """`keep` columns of sources and the facts of each file. Repeated rows stay; null texts have no facts."""
    source = sources.select(*keep, sources[path].alias("__path"), sources[text].alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if not f.name.startswith("__")] + T.StructType.fromDDL(DDL).fields)
    arrow = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(DDL).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [facts_of(p, x) for p, x in zip(b["__path"].to_pylist(), b["__text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *(pa.array([f[k] for f in found], a) for k, a in arrow.items())], names=[*keep, *arrow])

    return source.mapInArrow(run, schema)
