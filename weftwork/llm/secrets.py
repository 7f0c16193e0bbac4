"""Credentials embedded in source code and configuration: finding and blotting out.

A keyword automaton passes over each excerpt once and names the few lines worth a look. On those, issuer formats and
assignment shapes propose values, and structure checks (length, alphabet, character mix, base64 form, neighbours, the
parts of a signed token) decide. Where an issuer's format carries a checksum or an encoded head, a value that fits it is taken
without them; one that doesn't fit is still judged by its structure, since older formats have none. Private keys are followed over lines
with a small state machine, forwards from a first line and backwards from a last one, because excerpts begin and end
anywhere; an excerpt wholly inside a key's body can't be told from one inside a certificate and is left alone.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Words whose presence makes a line worth a look, in lower case.
KEYWORDS = [
    "pass", "pwd", "secret", "token", "key", "auth", "bearer", "basic ", "credential", "contraseña", "passwort", "kennwort", "пароль", "密码", "パスワード",
    "jwt", "://", "curl ", "private key", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "sk-", "sk_live_", "rk_live_",
    "hf_", "npm_", "sg.", "eyj", "aiza", "_live_", "sk_test_", "rk_test_", "dop_v1_", "pypi-", "value:", "services/t",
]

# The public formats of issuers' keys.
ISSUERS = [
    ("aws_key_id", r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    ("github", r"gh[posur]_[A-Za-z0-9]{36,}"),
    ("github_pat", r"github_pat_[A-Za-z0-9]{20,24}_[A-Za-z0-9]{30,62}"),
    ("gitlab", r"glpat-[A-Za-z0-9_\-]{20,}"),
    ("slack", r"xox[abeoprs]-(?:[0-9]+-)+[A-Za-z0-9\-]{16,}"),
    ("sendgrid", r"SG\.[A-Za-z0-9_\-]{16,24}\.[A-Za-z0-9_\-]{32,48}"),
    ("model_api", r"sk-(?:[a-z]+-)?[A-Za-z0-9_\-]{32,}"),
    ("payments", r"[rs]k_(?:live|test)_[A-Za-z0-9]{20,}"),
    ("hub", r"hf_[A-Za-z0-9]{30,}"),
    ("npm", r"npm_[A-Za-z0-9]{36}"),
    ("pypi", r"pypi-[A-Za-z0-9_\-]{50,}"),
    ("cloud", r"dop_v1_[0-9a-f]{64}"),
    ("google", r"AIza[A-Za-z0-9_\-]{35}"),
    ("jwt", r"eyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}"),
    ("live_key", r"[a-z]{2,6}_live_[A-Za-z0-9]{20,}"),
]
ISSUER = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in ISSUERS) + r")(?![A-Za-z0-9_])")
BEGINNING = re.compile(r"(?:AKIA|ASIA|gh[posur]_|github_pat_|glpat-|xox[abeoprs]-|SG\.|sk-|[rs]k_live_|hf_|npm_|pypi-|AIza|eyJ|[a-z]{2,6}_live_)[A-Za-z0-9_.\-]*$")

PEM_FIRST = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_LAST = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_BODY = re.compile(r"""^[\s>|#*]*["'`]?((?:[A-Za-z0-9+/]{4,}={0,3})|(?:Proc-Type|DEK-Info|Comment|Version): [^"'`]+)(?:\\r)?(?:\\n)?["'`]?\s*[+,;)\\.]*\s*$""")

#: A name that ends in one of these holds a secret.
TAILS = {
    "password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "jwt", "apikey", "secretkey", "authtoken", "accesstoken", "clientsecret",
    "privatekey", "contraseña", "contrasena", "passwort", "kennwort", "пароль", "密码", "パスワード", "credentials", "apitoken", "accesskey", "signingkey",
}
BEFORE_KEY = {"api", "secret", "access", "private", "signing", "auth", "encryption", "account", "master", "service", "client", "license", "shared"}
KEY_WORD = re.compile(r"pass|pwd|secret|token|key|jwt|contrase|kennwort|пароль|密码|パスワード|credential", re.I)
NAME_CHARS = re.compile(r"[\w.\-]*")
#: What follows a name: a type, a sign, a value of any length. Possessive repeats keep the time near linear.
ASSIGNED = re.compile(
    r"""(?P<nq>["'`\]]*+)(?:\s*+:\s*+[A-Za-z_][\w\[\], |.]*?(?=\s*=))?\s*+(?P<sep>===?|=>|:=|=|:|,)\s*+"""
    r"""(?:(?P<q>["'`])(?P<quoted>(?:[^"'`\\]|(?!(?P=q))["'`]|\\.)*+)(?P=q)|(?P<bare>[^\s"'`,;&<>(){}\[\]|]++))"""
)
HEADER = re.compile(r"""\b(?:bearer|basic)\s+(?P<v>[A-Za-z0-9+/=._~\-]{12,})""", re.I)
USERINFO = re.compile(r"""[a-z][a-z0-9+.\-]{1,20}://[^\s:/@"'`]*:(?P<v>[^\s/@"'`]+)@""", re.I)
CURL = re.compile(r"""(?:^|\s)(?:-u|--user)[ =]["']?[^\s:"']+:(?P<v>[^\s"']+)""")
ELEMENT = re.compile(r"<(?P<name>[\w.\-]+)>(?P<v>[^<>\s]+)</(?P=name)>")
PAIR = re.compile(r"""\bauth\w*\s*(?:=\s*)?\(\s*["'][^"']*["']\s*,\s*(?P<q>["'])(?P<v>[^"']+)(?P=q)\s*\)""", re.I)
HOOK = re.compile(r"""https://hooks\.[\w.\-]+/services/T[A-Z0-9]+/B[A-Z0-9]+/(?P<v>[A-Za-z0-9]{16,})""")
BLOCK_SCALAR = re.compile(r"""^(?P<pad>\s*)(?:-\s+)?["']?(?P<name>[\w.\-]+)["']?\s*:\s*[|>][+\-0-9]*\s*$""")
ENV_NAME = re.compile(r"""^\s*-?\s*name:\s*["']?(?P<name>[\w.\-]+)["']?\s*$""")
ENV_VALUE = re.compile(r"""^\s*value:\s*["']?(?P<v>[^\s"']+)["']?\s*$""")
OPEN_STRING = re.compile(r"""(?:(?P<name>[\w.\-]+)\s*[=:]\s*\(?\s*)(?P<q>["'`])(?P<v>[^"'`\s]+)(?P=q)\s*(?P<more>\+|\\)?\s*$""")
NEXT_STRING = re.compile(r"""^\s+(?P<q>["'`])(?P<v>[^"'`\s]+)(?P=q)\s*[;),+]*\s*$""")

PLACEHOLDER = re.compile(
    r"""^(?:<.*>|\$\{.*|\$\(.*|\$[A-Za-z_]\w*|\{\{.*|%\(.*|%\w+%|\*+|\.{2,}|x{4,}|0{6,}|(?:your|my|the|insert|enter|some|put)[_\-\s].*|.*(?:changeme|change[_\-]me|placeholder|redacted|"""
    r"""replace[_\-]?me|dummy|not[_\-]?set|hidden).*|password\d*|passwd|secret|token|example|none|null|nil|true|false|undefined|todo|fixme|test(?:ing)?|!vault|vault:.*|env:.*|process\.env.*|os\.environ.*)$""",
    re.I,
)
VERSION = re.compile(r"^[A-Za-z_]*-?v?\d+(?:\.\d+)+(?:-?[A-Za-z]+\.?\d*)?$|^\d+(?:\.\d+)?$|^\d{4}-\d\d-\d\d")
UUID = re.compile(r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.I)
WORDS = re.compile(r"[A-ZÀ-Þ]?[a-zà-ÿ]+|[A-ZÀ-Þ]+(?![a-zà-ÿ])|\d+|[^\W\d_a-zA-ZÀ-ÿ]+")


@lru_cache(maxsize=8192)
def names_secret(name: str) -> bool:
    """Whether the last words of a name say that its value is a secret."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return False
    if words[-1] in TAILS:
        return words[0] != "public"
    return words[-1] == "key" and len(words) > 1 and words[-2] in BEFORE_KEY


def mixed(v: str) -> bool:
    """Whether a value has the mix of characters of a chosen or drawn secret, unlike a word or an identifier."""
    if any(c.isdigit() for c in v):
        return True
    up, low = any(c.isupper() for c in v), any(c.islower() for c in v)
    if up and low and any(not c.isalnum() and c not in "._-/:" for c in v):
        return True
    flips = sum(a.isupper() != b.isupper() for a, b in zip(v, v[1:]) if a.isalpha() and b.isalpha())
    return up and low and flips * 3 >= len(v)


def usable(v: str, least: int = 8) -> bool:
    """Whether a value could be used as a secret: no placeholder, reference, address, path, version, date or record id."""
    if len(v) < least or any(c.isspace() for c in v) or PLACEHOLDER.match(v) or VERSION.match(v) or UUID.match(v):
        return False
    if "://" in v or v[0] in "<{" or re.match(r"\.{0,2}(?:/[a-z_.\-]+)+(?:/|$)", v) or v.startswith("-----") or v.endswith("EXAMPLE"):
        return False
    return len(set(v)) > 3 and mixed(v)


def strong(v: str) -> bool:
    """A long drawn value that says by itself that it's a secret."""
    return len(v) >= 20 and sum(map(str.isdigit, v)) >= 2 and any(map(str.isupper, v)) and any(map(str.islower, v)) and usable(v)


_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_fits(kind: str, v: str) -> bool:
    """Whether a token's last six characters are the CRC32 of those between prefix and them, in base 62."""
    if kind not in ("github", "npm") or len(v) != 40:
        return False
    n, want = zlib.crc32(v[4:-6].encode()), ""
    while n:
        n, k = divmod(n, 62)
        want = _DIGITS[k] + want
    return want.rjust(6, "0") == v[-6:]


def signed_token(v: str) -> bool:
    """Whether the first part of a signed token is a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(v.split(".")[0] + "==="))
    except ValueError:
        return False
    return isinstance(head, dict) and ("alg" in head or "typ" in head)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, len(k))
    a.make_automaton()
    return a


def _candidate_lines(lines: list[str]) -> list[int]:
    low = [x.lower() for x in lines]
    starts, at = [], 0
    for x in low:
        starts.append(at)
        at += len(x) + 1
    return sorted({bisect_right(starts, end) - 1 for end, _ in automaton().iter("\n".join(low))})


def _in_line(line: str) -> list[tuple[int, int, str]]:
    """start, end and kind of the secrets that stand in one line."""
    found: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if not any(s < end and start < e for s, e, _ in found):
            found.append((start, end, kind))

    if (m := PEM_FIRST.search(line)) is not None:
        rest = line[m.end() :]
        last = PEM_LAST.search(line, m.end())
        if last or re.match(r"\\n[A-Za-z0-9+/]", rest):
            end = last.end() if last else m.end() + len(re.match(r"(?:\\n|[A-Za-z0-9+/=])*", rest)[0])
            return [(m.start(), end, "private_key")]
        return []
    for m in ISSUER.finditer(line):
        kind = m.lastgroup or "issuer"
        if checksum_fits(kind, m[0]) or kind == "jwt" and signed_token(m[0]) or len(set(m[0])) > 8 and not m[0].endswith("EXAMPLE"):
            add(m.start(), m.end(), kind)
    for pattern, kind, least in ((USERINFO, "url_password", 6), (CURL, "password", 6), (HOOK, "hook", 16), (PAIR, "password", 6)):
        for m in pattern.finditer(line):
            if usable(m["v"], least):
                add(m.start("v"), m.end("v"), kind)
    for m in HEADER.finditer(line):
        if usable(m["v"], 12) and len(set(m["v"])) > 8:
            add(m.start("v"), m.end("v"), "authorization")
    for m in ELEMENT.finditer(line):
        if names_secret(m["name"]) and usable(m["v"], 6):
            add(m.start("v"), m.end("v"), "password")
    at = 0
    for word in KEY_WORD.finditer(line):
        if word.start() < at:
            continue
        begin, stop = word.start(), NAME_CHARS.match(line, word.end()).end()
        while begin > at and (line[begin - 1].isalnum() or line[begin - 1] in "_.-"):
            begin -= 1
        at, name = stop, line[begin:stop]
        m = ASSIGNED.match(line, stop)
        if m is None:
            continue
        value, where = (m["quoted"], "quoted") if m["quoted"] is not None else (m["bare"], "bare")
        if m["sep"] == "," and not (m["nq"][:1] in ("'", '"') and where == "quoted"):
            continue
        says = names_secret(name) or (m["sep"] in ("==", "===") and where == "quoted" and name.lower() == "key" and len(value) >= 20)
        if not says or not usable(value):
            continue
        if where == "bare":
            tail = line[m.end() :]
            if tail[:1] and tail[0] in "([{" or not re.fullmatch(r"[\w\-.!#%?+/=@$^*~:]+", value) or re.match(r"[A-Za-z_][\w]*\.[A-Za-z_][\w.]*$", value) and not re.search(r"\d", value):
                continue
        start = m.start(where)
        if where == "bare" and "=" in value and not value.endswith("=") and value.index("=") < len(value) - 3 and value[: value.index("=")].replace("_", "").isalpha():
            continue
        add(start, start + len(value), "named")
        at = max(at, m.end())
    return found


def _body(line: str, edge: bool) -> re.Match | None:
    """A line of a private key between first and last. Away from the edges it must be long or padded."""
    m = PEM_BODY.match(line)
    return m if m and (edge or len(m[1]) >= 40 or m[1].endswith("=")) else None


def _private_keys(lines: list[str], looked: list[int]) -> dict[int, tuple[int, int, str]]:
    found: dict[int, tuple[int, int, str]] = {}
    for i in looked:
        line = lines[i]
        first, last = PEM_FIRST.search(line), PEM_LAST.search(line)
        if first and not last and not re.match(r"\\n[A-Za-z0-9+/]", line[first.end() :]):
            found[i] = (first.start(), first.end(), "private_key")
            j = i + 1
            while j < len(lines):
                if (end := PEM_LAST.search(lines[j])) is not None:
                    found[j] = (end.start(), end.end(), "private_key")
                    break
                near = j + 1 < len(lines) and PEM_LAST.search(lines[j + 1]) is not None
                if (m := _body(lines[j], near)) is None:
                    if lines[j].strip(" \t\r\"'+\\n"):
                        break
                else:
                    found[j] = (m.start(1), m.end(1), "private_key")
                j += 1
        elif last and not first and i not in found:
            found[i] = (last.start(), last.end(), "private_key")
            j = i - 1
            while j >= 0 and j not in found and (m := _body(lines[j], j == i - 1)) is not None:
                found[j] = (m.start(1), m.end(1), "private_key")
                j -= 1
    return found


def find_secrets(lines: list[str | None] | None) -> list[tuple[int, int, int, str]]:
    """line_no, start, end, kind of every secret in the lines of an excerpt, in order.

    Null or empty lists and null lines have none. A secret over several lines is one entry in each.
    """
    if not lines:
        return []
    lines = [(x or "").rstrip("\r\n") for x in lines]
    looked = _candidate_lines(lines)
    found: dict[int, list[tuple[int, int, str]]] = {i: [x] for i, x in _private_keys(lines, looked).items()}
    for i in looked:
        if i in found:
            continue
        line = lines[i]
        if hits := _in_line(line):
            found[i] = hits
            continue
        if (m := BLOCK_SCALAR.match(line)) is not None and names_secret(m["name"]):
            j = i + 1
            while j < len(lines) and len(lines[j]) - len(lines[j].lstrip()) > len(m["pad"]) and j not in found:
                v = lines[j].strip()
                if not usable(v):
                    break
                s = lines[j].index(v)
                found[j] = [(s, s + len(v), "named")]
                j += 1
        elif (m := ENV_VALUE.match(line)) is not None:
            before = ENV_NAME.match(lines[i - 1]) if i else None
            if before and names_secret(before["name"]) and usable(m["v"]) or not i and strong(m["v"]):
                found[i] = [(m.start("v"), m.end("v"), "named")]
        elif (m := OPEN_STRING.search(line)) is not None:
            after: list[re.Match] = []
            while i + 1 + len(after) < len(lines) and (more := NEXT_STRING.match(lines[i + 1 + len(after)])) is not None:
                after.append(more)
                if re.search(r"[;),]\s*$", lines[i + len(after)]):
                    break
            whole = m["v"] + "".join(x["v"] for x in after)
            if after and (ISSUER.fullmatch(whole) or names_secret(m["name"]) and strong(whole)):
                found[i] = [(m.start("v"), m.end("v"), "split")]
                for j, x in enumerate(after, i + 1):
                    found[j] = [(x.start("v"), x.end("v"), "split")]
            elif i + 1 == len(lines) and BEGINNING.match(m["v"]):
                found[i] = [(m.start("v"), m.end("v"), "split")]
    if 0 not in found and (m := NEXT_STRING.match(lines[0])) is not None and re.search(r"[;)]\s*$", lines[0]) and len(m["v"]) >= 8 and not m["v"].endswith("\\n") and len(set(m["v"])) > 6 and mixed(m["v"]) and any(c.isdigit() for c in m["v"]):
        found[0] = [(m.start("v"), m.end("v"), "split")]
    return [(i, s, e, kind) for i in sorted(found) for s, e, kind in sorted(found[i])]


def blot(value: str) -> str:
    """A placeholder of the same length and alphabet: hexadecimal stays so, and letters, digits and marks keep their kind."""
    if re.fullmatch(r"[0-9a-f]{16,}", value):
        return re.sub(r"[a-f]", "a", re.sub(r"\d", "0", value))
    return re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", re.sub(r"\d", "0", value)))


FOUND = T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("kind", T.StringType())])


def secrets_in(excerpts: DataFrame, keep: list[str], lines: str = "lines") -> DataFrame:
    """`keep` columns of each excerpt and line_no, start_at, end_at (code points from 0) and kind of each of its secrets.

    Every row is read whole, repeated ones too. Excerpts without lines have none. Columns to keep that have a name of the
    result's own raise ValueError.
    """
    if clash := {n.lower() for n in FOUND.names} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    source = excerpts.select(*keep, excerpts[lines].alias("__lines"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__lines"] + FOUND.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for r, excerpt in enumerate(b["__lines"].to_pylist()):
                for hit in find_secrets(excerpt):
                    rows.append(r)
                    for c, x in zip(cols, hit):
                        c.append(x)
            take = pa.array(rows, pa.int32())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([b[c].take(take) for c in keep] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=[*keep, *FOUND.names])

    return source.mapInArrow(run, schema)


def redacted(excerpts: DataFrame, lines: str = "lines") -> DataFrame:
    """excerpts with every secret replaced in `lines`; all else, other columns and line ends too, stays as it is."""
    schema = excerpts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b[lines].to_pylist()
            for excerpt in texts:
                for i, s, e, _ in reversed(find_secrets(excerpt)):
                    excerpt[i] = excerpt[i][:s] + blot(excerpt[i][s:e]) + excerpt[i][e:]
            at = b.schema.get_field_index(lines)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(i).type) if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    return excerpts.mapInArrow(run, schema)
