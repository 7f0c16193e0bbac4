from __future__ import annotations

from weftwork.functions import richtext as R


def t(text, *marks, **link):
    return {"type": "text", "text": text, "marks": [{"type": m} for m in marks] + ([{"type": "link", "attrs": {"href": link["href"]}}] if link else [])}


def n(kind, *content, **attrs):
    return {"type": kind, "content": list(content), "attrs": attrs}


def p(*x):
    return n("paragraph", *x)


def test_markdown_of_every_block():
    item = lambda *x: n("listItem", *x)
    cell = lambda x: n("tableCell", p(t(x)))
    doc = n(
        "doc", n("heading", t("Head"), level=9), p(t("a", "strong", "em"), t(" b", "code", "strong"), t("c", "strike", href="http://x")), n("orderedList", item(p(t("one")), n("bulletList", item(p(t("in"))))), item(p(t("two"))), order=3),
        n("codeBlock", t("x = 1\ny"), language="py"), n("blockquote", p(t("q")), p(t("r"))), n("rule"), n("table", n("tableRow", cell("a|b"), cell("c")), n("tableRow", cell("d"))), n("mediaSingle"), n("expand", p(t("in it")), title="More"),
        p(n("mention", text="@Ann"), n("hardBreak"), n("status", text="OK"), n("date", timestamp="0"), n("inlineCard", url="http://u"), n("emoji", shortName=":x:", id="1f468-200d-1f469")), n("unknown"),
    )
    assert R.markdown(doc) == (
        "###### Head\n\n_**a**_` b`[~~c~~](http://x)\n\n3. one\n  - in\n4. two\n\n```py\nx = 1\ny\n```\n\n> q\n>\n> r\n\n---\n\n| a\\|b | c |\n|---|---|\n| d |  |\n\n_[attachment]_\n\n**More**\n\nin it\n\n@Ann  \n`OK`1970-01-01http://u👨‍👩"
    )
    assert R.plain_text(n("doc", p(t("a"), n("hardBreak"), t("b")), p(t("c")))) == "a\n\n\nb\nc"
    assert R.markdown(n("doc")) is None and R.parsed("{nope") is None and R.parsed("[1]") is None and R.parsed(None) is None


def test_emoji_and_images():
    assert R.emoji({"text": "\\uD83D\\uDCCA"}) == "📊" and R.emoji({"id": "zz", "shortName": ":a:"}) == ":a:" and R.emoji({"id": "d800", "text": "t"}) == "t" and R.emoji({}) == ""
    doc = n("doc", n("image", attachmentId="b"), p(n("image", attachmentId="a"), n("image", attachmentId="b")), n("image"))
    assert R.shown_images(doc) == ["b", "a"]
