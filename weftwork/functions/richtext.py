"""Rich text as trackers store it, a tree of nodes in JSON, as plain text and as Markdown.

The tree is nested without bound, so it's read in Python, a batch of rows at a time. Every block becomes a list of lines,
and containers put their marks before the lines of what they hold.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks whose parts stand on lines of their own in plain text, and marks from the innermost to the outermost.
LINED = {"doc", "paragraph", "heading", "bulletList", "orderedList", "listItem", "blockquote", "codeBlock", "panel", "table", "tableRow"}
WRAPPED = [("strong", "**"), ("em", "_"), ("strike", "~~")]
MEDIA = {"mediaSingle", "mediaGroup", "media"}


def parsed(text: str | None) -> dict | None:
    """The tree in a JSON text; null for anything else."""
    try:
        node = json.loads(text) if text else None
    except ValueError:
        return None
    return node if isinstance(node, dict) else None


def _parts(node: dict) -> list[dict]:
    return [x for x in node.get("content") or [] if isinstance(x, dict)]


def _about(node: dict) -> dict:
    return node.get("attrs") or {}


def plain_text(node: dict) -> str:
    """The texts of a tree; the parts of blocks on lines of their own."""
    kind = node.get("type")
    if kind in ("text", "hardBreak"):
        return "\n" if kind == "hardBreak" else node.get("text") or ""
    return ("\n" if kind in LINED else "").join(map(plain_text, _parts(node)))


def emoji(about: dict) -> str:
    """An emoji's character, by its code points; else its text, in which escaped units are undone; else its short name."""
    points = (about.get("id") or "").split("-")
    if all(re.fullmatch("[0-9a-fA-F]{2,6}", p) for p in points):
        codes = [int(p, 16) for p in points]
        if not any(c > 0x10FFFF or 0xD800 <= c < 0xE000 for c in codes):
            return "".join(map(chr, codes))
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), about.get("text") or "")
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") or about.get("shortName") or ""


def _day(about: dict) -> str:
    try:
        return datetime.fromtimestamp(int(about.get("timestamp")) / 1000, timezone.utc).strftime("%Y-%m-%d")
    except (TypeError, ValueError, OverflowError, OSError):
        return ""


def _marked(node: dict) -> str:
    text, marks = node.get("text") or "", {m.get("type"): m.get("attrs") or {} for m in node.get("marks") or []}
    if "code" in marks:
        return f"`{text}`"
    for name, sign in WRAPPED:
        if name in marks:
            text = sign + text + sign
    href = marks.get("link", {}).get("href")
    return f"[{text}]({href})" if href else text


_INLINE: dict[str, Callable[[dict], str]] = {
    "text": _marked, "hardBreak": lambda n: "  \n", "mention": lambda n: _about(n).get("text") or "@someone", "emoji": lambda n: emoji(_about(n)), "status": lambda n: f"`{_about(n).get('text', '')}`",
    "inlineCard": lambda n: _about(n).get("url") or "", "blockCard": lambda n: _about(n).get("url") or "", "date": lambda n: _day(_about(n)),
}


def _inline(node: dict) -> str:
    return "".join(_INLINE.get(x.get("type"), _inline)(x) for x in _parts(node))


def _stacked(nodes: list[dict], note: str, tight: bool = False) -> list[str]:
    """The lines of blocks one below the other, with a blank line between unless they're kept tight."""
    out: list[str] = []
    for lines in filter(any, (_block(x, note) for x in nodes)):
        out += ([""] if out and not tight else []) + lines
    return out


def _list(node: dict, note: str) -> list[str]:
    out, first = [], int(_about(node).get("order", 1))
    for k, item in enumerate(_parts(node)):
        sign = f"{first + k}. " if node["type"] == "orderedList" else "- "
        lines = _stacked(_parts(item), note, tight=True) or [""]
        out += [sign + lines[0], *("  " + x if x else x for x in lines[1:])]
    return out


def _table(node: dict) -> list[str]:
    rows = [[" ".join(map(_inline, _parts(cell))).replace("|", "\\|") for cell in _parts(row)] for row in _parts(node)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
    return [*lines[:1], "|" + "---|" * width, *lines[1:]] if rows else []


def _block(node: dict, note: str) -> list[str]:
    kind, about = node.get("type"), _about(node)
    if kind == "heading":
        return ["#" * min(int(about.get("level", 1)), 6) + " " + _inline(node)]
    if kind in ("bulletList", "orderedList"):
        return _list(node, note)
    if kind == "codeBlock":
        return ["```" + (about.get("language") or ""), *"".join(x.get("text") or "" for x in _parts(node)).split("\n"), "```"]
    if kind in ("blockquote", "panel"):
        return [("> " + x).rstrip() if not x else "> " + x for x in _stacked(_parts(node), note)]
    if kind == "rule":
        return ["---"]
    if kind == "table":
        return _table(node)
    if kind in MEDIA:
        return [f"_[{note}]_"]
    if kind in ("expand", "nestedExpand"):
        head = [f"**{about['title']}**", ""] if about.get("title") else []
        return head + _stacked(_parts(node), note)
    return _inline(node).split("\n")


def markdown(node: dict, note: str = "attachment") -> str | None:
    """A tree as Markdown; media, which need the site's own access, as a note. Null if nothing is left."""
    return "\n".join(_stacked(_parts(node), note)).strip() or None


def shown_images(node: dict) -> list[str]:
    """Ids of the uploaded images in a tree, in order, each once."""
    found, open_ = [], [node]
    while open_:
        x = open_.pop()
        if x.get("type") == "image" and _about(x).get("attachmentId") not in (None, "", *found):
            found.append(_about(x)["attachmentId"])
        open_ += _parts(x)[::-1]
    return found


def _column(text: Column, f: Callable[[dict], object], kind: pa.DataType, ddl: str) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if (n := parsed(t)) is None else f(n) for t in x.to_pylist()], kind)

    return F.arrow_udf(run, ddl)(text)


def text_of(text: Column) -> Column:
    """Rich text (JSON) as plain text; null if it's none."""
    return _column(text, plain_text, pa.string(), "string")


def markdown_of(text: Column) -> Column:
    """Rich text (JSON) as Markdown; null if it's none or blank."""
    return _column(text, markdown, pa.string(), "string")


def images_of(text: Column) -> Column:
    """Ids of the images that rich text (JSON) shows."""
    return _column(text, shown_images, pa.list_(pa.string()), "array<string>")
