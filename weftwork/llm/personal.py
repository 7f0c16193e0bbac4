"""Personal information inside free text: mail addresses, phone numbers, identity numbers, addresses and names.

Generators of high recall propose overlapping spans of each kind. Boosted trees judge every span by its format and its
surroundings, and spans whose calibrated score reaches the kind's threshold are selected, the better ones first where they
overlap. The trees are fitted to labelled sentences made here, TRAINING at most, in words of our own; none of them stands in
the tables (a test compares them). Which words are given and family names is read from the whole directory of members; a
name that isn't in it is proposed where the words around it speak of a person.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.boosting import Boosted

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelled sentences that the trees are fitted to; a third of them is kept for calibration.
TRAINING = 9000
#: The directory goes to all tasks if its names have at most so many distinct words; a larger one is refused, never cut.
DIRECTORY_WORDS = 2_000_000
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words around each kind, in several languages.
PHONE_CUES = r"tel|phone|telephone|telefon\w*|téléphone|teléfono|mobile|mobil|móvil|portable|handy|cell|fax|calls?|call back|dial|text me|sms|whatsapp|direct line|line|line is|ring|reach|reached|unter|rappeler|appeler|appelez|llama|llamar|llame|позвоните|звоните|телефон|тел|номер|电话|電話|手机|手机号|携帯|फ़ोन|फोन|فون|โทร"
ID_CUES = r"national id|passports?|passeport|reisepass|pasaporte|паспорт|护照|パスポート|social security|sécurité sociale|insurance|national insurance|tax|tax id|tax number|steuer-?id|steuernummer|personalausweis|ausweis|dni|nie|nif|numéro|ssn|nino|cnic|tin|身份证|身分證|身份证号|マイナンバー|個人番号|снилс|инн|आधार|पासपोर्ट|شناختی|identity|identity card|driver'?s? licen[cs]e|driving licen[cs]e|id number|id card|identit\w*|cédula"
OTHER_CUES = r"order|orders|part|part number|invoice|invoices|template|epoch|timestamp|build|builds|run|job|batch|range|error|error code|code|codes|node|node at|host|commit|trace|checksum|hash|version|release|ticket|row|rows|item|items|counter|offset|port|page|article|no\.|nr\.|ratio|since|serial|sku|model|sensor|shipment|tracking|id=|bestellung|rechnung|fehler|commande|facture|erreur|pedido|factura|заказ|счёт|ошибка|订单|编号|注文|番号"
NAME_CUES = r"by|from|with|to|for|call|met|and|customer|client|author|signed|name|named|cc|regards|thanks|best|hi|dear|hello|ask|invoice to|ask for|asked for|owner|assignee|contact|spoke with|mit|bitte|bei|von|frag\w*|avec|par|chez|rappeler|a|con|por|llama a|с|у|от|спросите|клиент|коллега|联系|客户|cliente|kunde|kundin|\|"
ADDRESS_CUES = r"address|lives?(?: at)?|living at|moved to|invoice to|ship|send|deliver|delivered|deliver to|return|come to|office|at|to|wohne|wohnt|geht an|anschrift|adresse|livrer|habite|habite au|enviar a|entregar en|dirección|vive en|vivo en|адрес|доставки|живёт|живу|住所|地址|寄到|送到|住在|पता|पتہ"
AFTER_NAME = r"\w+ed\b|wrote|said|says|is|was|has|will|on |und|and |et |y |и |hat|sagt\w*|schrieb|pense|dit|dice|dijo|さん|様|氏|先生|，|,|\(|<|\||:"
_UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")


def _bounded(cues: str) -> str:
    """The cues with a word's boundary before them, but for scripts without spaces."""
    words = cues.split("|")
    spaced = "|".join(w for w in words if not _UNSPACED.search(w))
    dense = "|".join(w for w in words if _UNSPACED.search(w))
    return rf"(?:(?:^|[^\w])(?:{spaced})" + (rf"|(?:{dense}))" if dense else ")")


CUES = [re.compile(rf"{_bounded(c)}[\s:：#.,(（]*(?:(?:is|are|has|have|the|number|no\.?|nummer|号|號|是|is:|au|al|n°|an|a|at|on|to|der|la|le|auf|to:)[\s:：(（<|]+){{0,3}}(?:号|號|是|は|が|：|n°)?[\s:：(（<|]*$", re.I) for c in (PHONE_CUES, ID_CUES, OTHER_CUES, NAME_CUES, ADDRESS_CUES)]
NEAR = [re.compile(rf"{_bounded(c)}(?:[^\w]|$|(?<=[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]))", re.I) for c in (PHONE_CUES, ID_CUES, OTHER_CUES)]
# Words that speak of a person before a name that isn't in the directory.
PERSON = re.compile(r"(?:^|[^\w])(?:signed|regards|author|authored by|called|ask|ask for|asked for|spoke with|talked to|met with|dear|hi|hello|named?|reported by|written by|reviewed by|approved by|assigned to|colleague|llama a|hablé con|rappeler|demandez à|herrn?|frau|fragen sie|gesprochen mit|спросите|kunde|kundin|customer|client|cliente|contact)[:,]?\s+$", re.I)
AFTER = re.compile(rf"^\W{{0,2}}(?:{AFTER_NAME})")
ID_AFTER = re.compile(r"^\W{0,2}(?:is|was|are|of|for|belongs|ist|war|von|est|de|es|у|是|の|は)(?:\W|$)", re.I)

TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sra?|Srta|Dra|Don|Doña|Sir|Mx|г-н|г-жа)\.?|M\."
PART = r"(?:[OoDdLl]['’])?[^\W\d_]+(?:[-‐][OoDd]?['’]?[^\W\d_]+)*"
EMAIL = re.compile(r"(?<![\w.+\-])[\w][\w.+\-%']{0,80}(?:@|＠|\s[@＠]\s|\s?(?:\[at\]|\(at\)|\{at\})\s?)[\w][\w\-]*(?:\.[\w\-]+|\s?(?:\[dot\]|\(dot\))\s?[\w\-]+)*|(?<![\w.+\-])[\w][\w.+\-]{0,80}\sat\s[\w\-]+(?:\sdot\s[\w\-]+)+", re.I)
NUMBER = re.compile(r"(?<![A-Za-z0-9_.,\-/:#@０-９])(?:[A-Z]{1,3}[\s\-]?)?(?:\+\s?|[(（]\s?\+?)?[\d０-９](?:[\s().（）\-－‐‑‒–/   ]{0,2}[\d０-９]){5,30}(?:(?:\s?(?:ext\.?|x|доб\.)\s?\d{1,5})|[\s\-]?[A-Z](?![A-Za-z0-9_]))?(?![A-Za-z0-9_０-９]|[.,:]\d|[\-/][A-Za-z0-9])")
STREETS = "Street|St|Drive|Dr|Close|Lane|Ln|Terrace|Ter|Avenue|Ave|Road|Rd|Boulevard|Blvd|Way|Court|Ct|Place|Pl|Square|Sq|Crescent|Cres|Row|Mews|Parade|Highway|Hwy|Hill|Gardens|Grove|Walk"
HAN = "一-鿿々ヶ"
ADDRESSES = [
    re.compile(rf"(?<![\w.,\-/#])\d{{1,5}}[A-Za-z]?\s+(?:(?:[NSEW]{{1,2}}|[NS]\.[EW])\.?\s+)?(?:[A-Z][\w'’\-]*\.?\s+){{1,4}}(?:{STREETS})\b\.?(?:,\s*(?:Apt|Unit|Suite|Flat|Floor|#)\.?\s*\w+)?(?:,[ \n]?[A-Z][\w\-]+(?: [A-Z][a-z][\w\-]*)?)?(?: [A-Z]{{1,2}}\d\w?\s\d[A-Z]{{2}}|,? [A-Z]{{2}} \d{{5}})?"),
    re.compile(r"(?<![\w\-])[A-ZÄÖÜ][\w\-]*?(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|-Straße|-Weg|-Platz|-Allee)\s\d{1,4}\s?[a-z]?\b(?:,\s*\d{5}\s[A-ZÄÖÜ][\wäöüß\-]+)?"),
    re.compile(r"(?<![\w\-])(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Unter den|Hinter der)\s(?:[A-ZÄÖÜ][\wäöüß\-]*\s){1,3}\d{1,4}\s?[a-z]?\b(?:,\s*\d{5}\s[A-ZÄÖÜ][\wäöüß\-]+)?"),
    re.compile(r"(?<![\w.,\-/])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|quai|impasse|boulevard|bd|place|allée|chemin|cours|route|square|passage|sentier)\s(?:de la |de l['’]|du |des |de |d['’])?[A-ZÀ-Þ][\w'’\-]*(?:\s[A-ZÀ-Þ][\w'’\-]*)*(?:,\s*\d{5}\s[A-ZÀ-Þ][\w\-]+)?"),
    re.compile(r"(?<![\w])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.|Pl\.|Paseo|Pº|Camino|Carrera|Ronda|Travesía|Glorieta)\s?[^,\n\d]{2,45},?\s*(?:n\.?º\s*)?\d{1,4}(?:,\s*\d{1,2}\.?º\s?\w)?"),
    re.compile(r"(?:(?<![\w])г\.\s?[А-ЯЁ][\w\-]+,\s*)?(?<![\w])(?:ул\.|улица|пр-т|пр\.|просп\.|проспект|пер\.|переулок|наб\.|набережная|б-р|бульвар|ш\.|шоссе|пл\.|площадь)\s?[А-ЯЁ][\w\-]*(?:\s[А-ЯЁ]?[\w\-]+){0,3},\s*(?:д\.|дом)?\s?\d+\w?(?:,\s*кв\.?\s?\d+)?"),
    re.compile(rf"(?<![{HAN}])[{HAN}]{{2,16}}(?:町|村|市|区|丁目|番地|字)[\d０-９]+(?:(?:丁目|番地?|号|[-－−‐])[\d０-９]*)*"),
    re.compile(rf"(?<![{HAN}])(?P<lead>寄到|寄往|寄给|送到|送往|发到|发往|地址是|地址为|住址是|地址|住在|家住|位于|搬到|现住)?(?P<a>[{HAN}]{{2,20}}?(?:路|街|巷|大道|胡同|弄|里)[\d０-９]+(?:号|弄|號)(?:[\d０-９]+(?:室|栋|单元|楼|号楼))*)"),
]
DIGIT = re.compile(r"[\d０-９]")
CAPITALS = re.compile(r"[^\W\d_a-zа-яё][^\W\d_]+[ \t\u00a0]+(?:[^\W\d_]\.[ \t\u00a0]?)*[^\W\d_a-zа-яё]|[^\W\d_],[ \t\u00a0][^\W\d_a-zа-яё]")
CYRILLIC_LETTER = re.compile(r"[А-ЯЁ]")
DOTTED = re.compile(rf"(?P<lead>请联系|联系|请找|请问|找|客户|问)?(?P<a>[{HAN}]{{1,6}}[·•・][{HAN}]{{1,8}})|(?P<b>[ァ-ヿー]{{2,}}[・＝=·][ァ-ヿー]{{2,}})")
CYRILLIC = re.compile(r"(?<![\w\-])[А-ЯЁ][а-яё]+\s(?:[А-ЯЁ]\.\s?)*[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?![\w])")
TITLED = re.compile(rf"(?<![\w.])(?:{TITLE})\s({PART})(?:\s({PART}))?")
GENERIC = set("git hg svn ssh noreply no-reply donotreply do-not-reply postmaster mailer-daemon info support admin root team hello contact sales security abuse webmaster help office billing logo icon".split())

#: Lower-case words that make a text worth a generator's pass. Addresses have a list for each pattern, in its order.
TRIGGERS = {
    "email": ["@", "＠", "[at]", "(at)", "{at}", " dot "],
    "address0": [f" {x.lower()}" for x in STREETS.split("|") if len(x) > 2] + [f" {x}{c}" for x in ("st", "rd", "dr", "ln", "ct", "pl", "sq") for c in ".,;\n"] + [" st", " rd"],
    "address1": ["straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "ufer ", "damm "],
    "address2": ["am ", "an der ", "an den ", "im ", "in der ", "zum ", "zur ", "auf dem ", "unter den ", "hinter der "],
    "address3": [" rue ", " avenue ", " av. ", " quai ", " impasse ", " boulevard ", " bd ", " place ", " allée ", " chemin ", " cours ", " route ", " square ", " passage ", " sentier "],
    "address4": ["calle ", "c/", "avenida ", "avda", "av. ", "plaza ", "pza. ", "paseo ", "camino ", "carrera ", "ronda ", "travesía ", "glorieta "],
    "address5": ["ул.", "улиц", "пр-т", "пр.", "просп", "пер.", "переул", "наб.", "набереж", "бульвар", "б-р", "шоссе", "площ"],
    "address6": ["町", "村", "市", "区", "丁目", "番地"],
    "address7": ["路", "街", "巷", "大道", "胡同", "弄", "里"],
    "title": ["mr ", "mr.", "mrs", "ms ", "ms.", "miss ", "dr ", "dr.", "prof", "herr", "frau ", "mme", "mlle", "m. ", "sr ", "sr.", "sra", "srta", "dra", "г-н", "г-жа"],
    "dotted": ["·", "・", "•"],
}
SIGNS = [*TRIGGERS, "given", "family"]
BIT = {name: 1 << i for i, name in enumerate(SIGNS)}


def folded(word: str) -> str:
    """A word without case and accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


#: Two words with a blank between, or turned round with a comma; and those by which the second may be the family name.
_EDGE, _END, _GAP = r"(?<![\w.@+\-/'’])", r"(?![\w@+]|\.[\w@])", r"[ \t\u00a0]"
FORWARD = re.compile(rf"{_EDGE}(?P<g>{PART}){_GAP}(?P<m>(?:[^\W\d_]\.{_GAP}?)*)(?P<f>{PART}){_END}")
TURNED = re.compile(rf"{_EDGE}(?P<f>{PART}),{_GAP}(?P<g>{PART})(?:{_GAP}[^\W\d_]\.)?{_END}")


class Names:
    """Given and family names of a directory: exact words, and how family names begin and end."""

    def __init__(self, given: frozenset[str], family: frozenset[str]):
        self.given, self.family = given, family
        self.starts = {w[:3] for w in family}
        self.ends = {w[-3:] for w in family}
        import ahocorasick

        self.triggers = ahocorasick.Automaton()
        bits: dict[str, int] = {}
        for k, words in [*TRIGGERS.items(), ("given", given), ("family", family)]:
            for w in words:
                bits[w] = bits.get(w, 0) | BIT[k]
        for w, b in bits.items():
            if w:
                self.triggers.add_word(w, b)
        self.triggers.make_automaton()

    def is_given(self, word: str) -> bool:
        return len(word) > 1 and (word.lower() in self.given or folded(word) in self.given)

    def like(self, word: str) -> tuple[int, int, int]:
        """Whether a family name is in the directory, begins, and ends like one in it."""
        w = folded(re.split(r"[-‐]", word)[0])
        w = re.sub(r"^[odl]['’]", "", w)
        return int(w in self.family), int(w[:3] in self.starts), int(w[-3:] in self.ends)

    def pairs(self, text: str, known: bool) -> Iterator[tuple[int, int, int, str, str]]:
        """form, start, end, given and family of every span of two words that may be a name: the given one is in the
        directory, the family one is and both begin with a capital, or the words before speak of a person."""
        for form, pattern in ((20, FORWARD), (21, TURNED)):
            at = 0
            while (m := pattern.search(text, at)) is not None:
                at = m.end("g") if form == 20 else m.end("f")
                g, f = m["g"], m["f"]
                if known and self.is_given(g):
                    at = m.end()
                    yield form, m.start(), m.end(), g, f
                elif g[0].isupper() and f[0].isupper() and len(g) > 1 and len(f) > 2:
                    if self.like(f)[0]:
                        yield form, m.start(), m.end(), g, f
                    elif form == 20 and PERSON.search(text[max(0, m.start() - 40) : m.start()]):
                        yield 25, m.start(), m.end(), g, f


def case_of(text: str) -> int:
    letters = [c for c in text if c.isalpha()]
    if not letters or not any(c.isupper() or c.islower() for c in letters):
        return 3
    if all(not c.islower() for c in letters):
        return 1
    if all(not c.isupper() for c in letters):
        return 2
    return 0


def char_of(text: str, at: int) -> int:
    if at < 0 or at >= len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c in ".,;:!?。，、：；！？" else 3 if c in "()[]<>{}（）" else 4 if c in "/|" else 5 if c.isdigit() else 6 if c.isalpha() else 7


FEATURES = 30


def _features(text: str, s: int, e: int, form: int, extra: dict[int, int] | None = None) -> list[int]:
    span, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 20]
    groups = re.findall(r"[\d０-９]+", span)
    digits = sum(map(len, groups))
    lead = 1 if span[0] == "+" or span[:2] in ("(+", "（+") else 2 if span[0] in "(（" else 3 if span.startswith("00") else 4 if span[:1] in ("0", "０") else 5 if span[:1].isalpha() else 0
    seps = sum(b for c, b in (("-", 1), ("－", 1), ("\u2011", 1), (".", 2), (" ", 4), ("\u00a0", 4), ("/", 8), ("(", 16)) if c in span) if digits else 0
    f = [form, digits, len(groups), lead, seps]
    f += [int(bool(c.search(before))) for c in CUES]
    f += [int(bool(c.search(before))) for c in NEAR]
    f += [int(bool(AFTER.match(after))), int(bool(ID_AFTER.match(after))), char_of(text, s - 1), char_of(text, e), case_of(span), len(span.split())]
    f += [len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, max(map(len, groups), default=0)]
    f += [sum(c.isalpha() and c.isascii() for c in span[:3]) if digits else 0, int(span[-1:].isalpha()) if digits else 0]
    f += [int("@" in before[-40:] or "[at]" in before or "(at)" in before), int(bool(re.search(r"[/|]\s*$", before))), 0, 0, 0, 0][: FEATURES - len(f)]
    f += [0] * (FEATURES - len(f))
    for k, v in (extra or {}).items():
        f[k] = v
    return f


def candidates(text: str, names: Names) -> list[tuple[int, int, int, list[int]]]:
    """kind (place in KINDS), start, end, features of every proposed span."""
    low = text.lower()
    bits = 0
    for _, b in names.triggers.iter(low):
        bits |= b
    digit = DIGIT.search(text) is not None
    out: list[tuple[int, int, int, list[int]]] = []
    if bits & BIT["email"]:
        for m in EMAIL.finditer(text):
            local, _, host = re.split(r"(@|＠|\[at\]|\(at\)|\{at\}|\sat\s)", m[0], maxsplit=1, flags=re.I) if not ("@" in m[0]) else (*m[0].partition("@"),)
            local, host = local.strip(), re.sub(r"\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?", ".", host.strip(), flags=re.I)
            tld = host.rsplit(".", 1)[-1] if "." in host else ""
            ssh = int(text[m.end() : m.end() + 1] == ":" and text[m.end() + 1 : m.end() + 2].isalpha())
            e = m.end() - len(m[0]) + len(m[0].rstrip("."))
            out.append((0, m.start(), e, _features(text, m.start(), e, 1, {24: int(tld.isalpha() and len(tld) >= 2), 25: int(folded(local) in GENERIC), 26: ssh, 27: int(tld.lower() in ("png", "jpg", "jpeg", "gif", "svg", "webp", "py", "js", "ts", "md", "cached")), 28: int(any(c.isdigit() for c in host))})))
    for m in NUMBER.finditer(text) if digit else ():
        s, e = m.span()
        span = m[0]
        if span[0].isalpha():
            head = re.match(r"[A-Z]{1,3}", span)[0]
            if span[len(head)] in " -" and not re.fullmatch(r"[A-Z]{2}(?: \d\d){3} [A-Z]", span):
                s += len(head) + 1
        span = text[s:e]
        depth = span.count("(") + span.count("（") - span.count(")") - span.count("）")
        if depth > 0 and span[0] in "(（":
            s += 1
        if depth < 0:
            e = s + max(span.rfind(")"), span.rfind("）"))
        while e > s and text[e - 1] in " -./(（ ":
            e -= 1
        f = _features(text, s, e, 2)
        out.append((1, s, e, f))
        out.append((2, s, e, f))
    if digit:
        for k, p in enumerate(ADDRESSES):
            if bits & BIT[f"address{k}"]:
                for m in p.finditer(text):
                    s, e = m.span("a") if k == 7 else m.span()
                    out.append((3, s, e, _features(text, s, e, 10 + k)))
    if bits & BIT["given"] or CAPITALS.search(text):
        for form, start, end, g, f in names.pairs(text, bool(bits & BIT["given"])):
            known, starts, ends = names.like(f)
            same = int(case_of(g) == case_of(f))
            out.append((4, start, end, _features(text, start, end, form, {24: int(names.is_given(g)), 25: known, 26: starts, 27: ends, 28: same})))
    if bits & BIT["title"]:
        for m in TITLED.finditer(text):
            a, b = m[1], m[2]
            known, starts, ends = names.like(a)
            given = int(folded(a) in names.given)
            if given and b:
                continue
            out.append((4, m.start(1), m.end(1), _features(text, m.start(1), m.end(1), 22, {24: given, 25: known, 26: starts, 27: ends, 28: int(a[0].isupper())})))
    if bits & BIT["dotted"]:
        for m in DOTTED.finditer(text):
            s, e = m.span("a") if m["a"] else m.span("b")
            out.append((4, s, e, _features(text, s, e, 23)))
    if CYRILLIC_LETTER.search(text):
        for m in CYRILLIC.finditer(text):
            out.append((4, m.start(), m.end(), _features(text, m.start(), m.end(), 24)))
    return out


# --- labelled sentences -------------------------------------------------------------------------------------------

# Invented words for the labelled sentences.
_GIVEN = "Alma Bruno Celia Dario Edda Felix Greta Hugo Ines Jonas Katja Lior Maren Nilo Olga Pavel Quirin Rita Stellan Tamsin".split()
_FAMILY = [a + b for a in "Abel Bern Corva Dunm Estev Farn Grim Hollo Ivers Jarva Keld Lind".split() for b in "gard sted allo marsh ane holt aldsen owby ström etti".split()]
#: The part of them that the directory holds while the trees are fitted; the other families only begin and end alike.
_KNOWN_FAMILY, _KNOWN_GIVEN = _FAMILY[::2], _GIVEN[:12]
#: Family names unlike any in the directory.
_LOOSE = "Brunsvik Odoya Petrou Vasquine Tallmadge Ferreiro Kowalik Haddan Zeltner Marchetti Obuya Tsang Ruuska Fontaine Adeyemi Sorokin Yildiz Nakata".split()
_HOSTS = "alder.example birke.test mail.corva.example nord-labs.example".split()


def _drawn(r: random.Random, digits: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else c for c in digits)


def _person(r: random.Random) -> str:
    g, f = r.choice(_GIVEN), r.choice(_FAMILY if r.random() < 0.8 else _LOOSE)
    if r.random() < 0.15:
        f += "-" + r.choice(_FAMILY)
    if r.random() < 0.08:
        f = "O'" + f
    k = r.random()
    n = f"{g} {r.choice('ABDEFGHKM')}. {f}" if k < 0.15 else f"{f}, {g}" if k < 0.3 else f"{g} {f}"
    c = r.random()
    return n.upper() if c < 0.1 else n.lower() if c < 0.2 else n


def _mail(r: random.Random) -> str:
    g, f, h = r.choice(_GIVEN).lower(), r.choice(_FAMILY).lower(), r.choice(_HOSTS)
    local = r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g[0]}", f"{g}{r.randint(1, 99)}", f"{f}-{r.randint(1, 99)}", f"{g}.{f}+list"])
    k = r.random()
    m = f"{local}@{h}" if k < 0.75 else f"{local} [at] {h.replace('.', ' [dot] ')}" if k < 0.85 else f"{local}(at){h}" if k < 0.92 else f"{local} @ {h}"
    return m.upper() if r.random() < 0.1 else m


def _phone(r: random.Random) -> str:
    return _drawn(r, r.choice(["+1 (999) 999-9999", "(999) 999 9999 ext. 999", "1.999.999.9999", "+19999999999", "020 9999 9999", "+44 20 9999 9999", "0044 9999 999999", "+92 999 9999999", "999-999-9999", "+86 010 9999 9999", "010-99999999", "03-9999-9999", "01.99.99.99.99", "01 99 99 99 99", "8 800 999 99 99", "8 (800) 999-99-99", "900 99 99 99", "(+34) 999-999-999", "030/9999999", "030 9999999", "+49 30 9999999", "0999 999 9999"]))


def _id(r: random.Random) -> str:
    v = _drawn(r, r.choice(["99999-9999999-9", "999 99 9999", "999-99-9999", "@@9999999", "@@999999#", "@@ 99 99 99 #", "99 999 999 999", "99999999#", "99999999-#", "9999 999999", "99 99 999999", "999999999999999999", "99999999999999999X", "999-999-999 99"]))
    v = re.sub("@", lambda _: r.choice("ABKNQRTX"), v)
    return v.replace("#", r.choice("ABCDQV"))


def _address(r: random.Random) -> str:
    n = r.randint(1, 1990)
    name = r.choice(["Birch Hollow", "Seven Oaks", "N.W. Aspen", "E. Harbour", "Old Mill", "Fern"])
    street = r.choice(STREETS.split("|"))
    en = f"{n} {name} {street}" + r.choice(["", ".", ", Apt 12A", ", Unit 5", ", Eastmoor", ", Apt 3B, Eastmoor QX3 9AB"])
    de = r.choice(["Am Neuen Ufer", "Tannenweg", "Kirchgasse", "Lindenstraße", "Hafenstr.", "Zum Roten Turm"]) + f" {n % 200}{r.choice(['', 'a', ' b'])}" + r.choice(["", ", 01234 Neustedt"])
    fr = f"{n % 150}{r.choice(['', ' bis', ' ter'])}, {r.choice(['rue', 'avenue', 'quai', 'impasse'])} {r.choice(['de la Lune', 'des Quatre-Vents', 'du Moulin-Neuf'])}{r.choice(['', ', 01234 Montclair'])}"
    es = f"{r.choice(['Calle', 'C/', 'Avenida', 'Plaza'])} {r.choice(['de la Luna', 'Cuatro Vientos', 'del Roble Alto'])}, {n % 120}{r.choice(['', ', 2.º A'])}"
    ru = f"{r.choice(['', 'г. Северск, '])}{r.choice(['ул. ', 'улица ', 'пр-т ', 'пер. '])}{r.choice(['Зелёных Холмов', 'Лесная', 'Старой Пристани'])}, {r.choice(['д. ', ''])}{n % 99}{r.choice(['', ', кв. 7'])}"
    ja = f"{r.choice(['青丘市', '雲原市', ''])}{r.choice(['南松町', '新港町'])}{n % 9 + 1}-{n % 20 + 1}-{n % 15 + 1}"
    zh = f"{r.choice(['云海市', '松原市', ''])}{r.choice(['五里桥巷', '新港街', '竹林路'])}{n % 300}号"
    return r.choice([en, en, en, de, fr, es, ru, ja, ja, zh, zh])


# Sentences of our own around items.
_CARRIERS = {
    "email": ["Her mailbox is {}", "send the minutes over to {} please", "You can write {name} under {}.", "From: {}", "Reply-To: {name} <{}>", "ping {} once that's merged", "owner={}", "the bounce came back from {}", "account {} can't sign in any more", "Meine neue Mailadresse lautet {}.", "mon courriel : {}", "mi correo es {}", "моя почта {}", "请发邮件到{}", "メールは{}まで", "invite {} too", "({})", "{}; {phone}", "Eine Mail an {} genügt.", "assigned = {}, since May", "| {} |", "[mail]({}) works best", "mailto:{}", "{name}, {}, {phone}", "is {} still with us?", "add {name} ({}) as a reviewer", "> {} schrieb:", "* {}"],
    "phone": ["you get me at {}", "mobile: {}", "Ring {name} back: {}", "my cell is {}", "phone {} (after lunch)", "call back {}", "dial {} and ask for {name}", "Handy {}", "Telefonisch erreichbar unter {}", "mon portable : {}", "mi móvil es {}", "мой номер {}", "тел. {}", "手机号{}", "携帯は{}です", "{name}, {}", "{email}, {}", "T {} or F {phone}", "whatsapp {}", "which line? {}", "{}", "फ़ोन {}", "| {name} | {} |", "{name} can be reached on {} until six", "Call {}!", "tel: {}", "{email} / {}", "bitte {name} anrufen, {}", "appelez {name} au {}", "llame a {name}, {}", "звоните {}, {runame}", "电话：{}", "{janame}さんの電話は（{}）", "電話なら{janame}さんまで（{}）", "有事打电话（{}）", "携帯（{}）", "({}) is the number"],
    "id_number": ["her passport has the number {}", "SSN: {}", "social security no. {}", "national insurance {}", "the driver's licence {} is visible", "tax number {}", "TIN {}", "Personalausweis {}", "meine Steuernummer ist {}", "NIE {}", "mi DNI es {}", "numéro de sécurité sociale {}", "passeport {}", "мой паспорт {}", "ИНН {}", "СНИЛС {}", "身份证 {}", "护照{}", "マイナンバー {}", "आधार {}", "CNIC {}", "identity card {} of {name}", "someone posted the ID card {} here", "holder {name}, passport {}", "insurance number: {}", "my social security number: {}", "tax id {} of the contractor", "national ID {} was in the scan", "Ausweis {} liegt bei", "DNI {} del firmante", "identité : numéro {}", "паспорт {} в архиве", "身份证号：{}", "身份证号{}，", "Reisepass {}", "Steuer-ID: {}", "{name} ({})", "insured under {}, {name}"],
    "address": ["he moved to {}", "our office: {}", "deliver it to {}", "postal address {}", "Please come to {} on Friday", "home address: {}", "ich wohne {}", "Anschrift: {}", "Adresse: {}", "j'habite au {}", "vivo en {}", "мой адрес: {}", "живу: {}", "住所：{}", "地址：{}", "请寄到{}", "勤務先の住所が{}", "新しい住所、{}", "return the laptop to {name}, {}", "{}", "pick it up at {}", "she lives at {}", "Der Rechner geht an {}", "à livrer au {}", "entregar en {}", "{name}, {}", "| {name} | {} |", "ship that to {}.", "({})", "Lieferung nach {}, danke", "parcel for {name}\n{}", "the parcel\n{name}\n{}\nthanks", "{name}\n{}", "Empfang:\n{}"],
    "name": ["thanks {}", "best, {}", "cc {}", "assigned to {}", "{} approved the change", "a review by {}", "ask {} about the contract", "I met {} last week", "her name is {}", "Written by {}", "— {}", "{} hat zugestimmt", "mit {} klären", "demandez à {}, svp", "hablé con {}", "поговорил с {runame}", "наш клиент {runame} ждёт", "联系{zhname}", "{janame}さんに聞いて", "client {} called", "{}: ok for me", "{} <{email}>", "From {} to {name}", "{} lives at {address}", "| {} | {phone} |", "{}", "Name: {}", "{}, {address}", "Author: {}", "customer {} is waiting", "it was {}, I think", "dear {}, see below", "{} and {name} agreed", "{} (new here)", "avec {} hier", "con {} ayer", "gestern {} gesprochen", "客户{zhname}来电", "{janame}様", "спросите, где {runame}", "{email} is {}", "dial {phone}, {} picks up", "owner: {}, since May", "kundin {} wartet", "passport {id_number} of {}", "the desk of {}", "reviewed with {} on Monday", "hi {}!", "signed {}", "{} said no", "{} wohnt weit weg", "let {} know"],
}
_OTHER_SCRIPTS = {"zhname": ["安娜·林德", "米拉·诺尔德", "奥列格·科尔"], "janame": ["アンナ・リンド", "ミラ・ノルド", "オレグ・コール"], "runame": ["Мира Северская", "Тамара Линд", "Олег Корн"]}
# Things that numbers count or name in software texts, and what may follow them.
_THINGS = "order|invoice|build|run|batch|job|ticket|serial|sku|part|article|shipment|tracking|sensor|node|counter|offset|range|port|error|error code|code|version|epoch|timestamp|checksum|commit|trace|row|page|model|host|release|item|template|Bestellung|Rechnung|commande|facture|pedido|заказ|订单|注文".split("|")
_TAILS = ["", " failed", " is done", " again", " in the log", ".", " twice", ", as before", " (old)", " ist fertig", " est prêt", " listo", " готов", " of the rack", " passed", " took long"]
_COUNTS = ["999999999999", "99999999999", "9999999999", "99999999", "9999999", "1699999999", "1699999999-99", "1699999999-999", "999-999-9999", "99-99-9999", "999-99-9999", "100-999-9999", "2024-01-15-999", "2024-01-15-99", "10.99.199.99", "10.199.99.199", "9999 999999", "99999-9999999-9", "QQ999999A", "999 999 999", "99/99/9999", "2024-11-09 10:99", "99.99.99.99", "0.999999999", "978-9-99-999999-9", "1:99999", "9999-9999-9999", "99 99 99 99", "99999999-9", "99999999Q"]
_CAPITALS = [a + " " + b for a in "Quiet Long Happy Blue Silver Second Open Main Fast Old Green North".split() for b in "River Queue Path Theme Street Lane Road Deck Avenue Mode Team Court Sprint Way Board Square".split()]
# Sentences of our own without any item, by what they look like; {cap} is a name of a thing.
_NOISE = {
    "name": ["the {cap} preset is nice", "moved into {cap} today", "{cap} tests are red", "checked by {cap} tooling", "works with {cap} only", "see {cap}, 99 of them", "{cap} wrote 99 rows", "{cap} was renamed", "from {cap} to {cap}", "thanks to {cap}", "the {cap} and the {cap}", "{cap} and {cap} are merged", "{cap}, 99", "{cap}", "name: {cap}", "author: the {cap} group", "with {cap} and {cap} on", "by {cap}", "to {cap} or {cap}", "Новый Отчёт готов.", "Старая Версия удалена", "у нас Большой Релиз", "с Новым Годом", "клиент Старой Версии", "Глава Девятая закрыта.", "Общий Список пуст", "спросите Новый Отчёт"],
    "given": ["{given} is a server", "restart {given} please", "the {given} cluster", "{given} branch is stale", "run {given} twice", "{given} report of May", "on {given} again", "with {given} enabled", "{given} mode", "by {given} only", "{given} node failed", "{given} and the rest", "{given} uses it", "when {given} asks", "{given}, too", "{given} Report is out", "see {given} Board"],
    "title": ["Dr. who?", "Prof. plan is live", "M. is short for minutes", "Mr. merge is a bot", "Ms. is not msec", "Sr. roles only", "Dr build ran", "the Sr level", "Dr. Chapter 9"],
    "email": ["uses @types/node now", "{word}@9.9 is pinned", "{word}@9.99.9 again", "{word}@99.9 there", "{word}@3x.webp is too big", "{word}@2x.png", "git@forge.test:team/{word}.git", "clone git@{word}.birke.test:a/{word}.git", "svn@forge.test:{word}/x", "deploy@alder.example:/srv/{word}", "ssh://git@forge.test/x", "noreply@forge.test sends that", "support@forge.test is a queue", "no-reply@{word}.example", "@here please look", "worker@9.99.9 died", "a @ b is matrix product", "info@birke.test is shared", "{word}@next", "mail at the end dot", "admin@alder.example bounced", "team@nord-labs.example got it", "@{word}.cached", "{word}@{word}"],
    "address": ["99 {cap} cards are left", "9 {cap} mode", "for {cap} we need 99", "to {cap}, at 9", "Am 9. Mai ist Schluss.", "Im Schnitt 99 Zeilen", "Zum Start 9 Knoten", "Zur Zeit 99 Fehler", "Am Montag 99 Builds", "9 rue fermée", "plaza 9 abierta", "第9章99页", "99路测试", "пл. 99 строк", "9 steps on the {cap}", "99 {cap} Lane switches"],
    "number": ["9999 of 99999 done", "99 s, 999 ms", "between 999 and 9999", "x = 999999 + 99", "http://forge.test/9999999999", "#999999", "v9.99.999", "99% of 9999999", "see 99.9.9, chapter 99", "{count} rows", "{count}", "- {count}{tail}", "the {thing} {count}{tail}", "{thing} no. {count}", "{thing}={count}", "{thing}: {count}", "{thing} {count} to {count}"] + ["{thing} {count}{tail}"] * 12,
}
#: How often each look is drawn: numbers look like most.
_LOOKS = ["name", "given", "title", "email", "email", "address", "number", "number", "number"]
# What may stand before and after any sentence, with an item or without.
_BEFORE = ["- ", "> ", "One more thing. ", "还有。", "FYI: ", "2. ", "Well, ", "So ", "Bref, "]
_AFTER = [" for now", " is what I have", ", see below", " of May", " was there", " and so on", " on Monday", " at noon", " im Mai", " en mayo", ", merci", " – ok?", " (again)"]
_WORDS = "core lib parser shot scanner kernel widget loader icon mirror".split()


def labelled(count: int = TRAINING, seed: int = 7) -> list[tuple[str, set[tuple[str, int]]]]:
    """Sentences with the kind and start of each item in them."""
    r = random.Random(seed)
    make = {"email": _mail, "phone": _phone, "id_number": _id, "address": _address, "name": _person}
    titles = ["Mr", "Mrs", "Ms.", "Dr.", "Herr", "Frau", "M.", "Mme", "Sr.", "Sra."]
    out = []
    for i in range(count):
        if i % 3 == 2:
            t = r.choice(_NOISE[r.choice(_LOOKS)])
            for slot, words in (("{thing}", _THINGS), ("{count}", _COUNTS), ("{tail}", _TAILS), ("{cap}", _CAPITALS), ("{word}", _WORDS), ("{given}", [*_GIVEN, *(g.lower() for g in _GIVEN)])):
                while slot in t:
                    t = t.replace(slot, r.choice(words), 1)
            t = re.sub("9", lambda m: str(r.randint(0, 9)), t)
            if r.random() < 0.5 and t[-1:].isalnum():
                t += r.choice(_AFTER)
            if r.random() < 0.3:
                t = r.choice(_BEFORE) + t
            out.append(_joined(r, out, t, set()))
            continue
        kind = KINDS[(i // 3) % 5] if i % 3 else r.choice(KINDS)
        carrier, text, items, value = r.choice(_CARRIERS[kind]), "", set(), "\0"
        for piece in re.split(r"(\{\w*\})", carrier):
            if not piece.startswith("{"):
                text += piece
                continue
            k = piece[1:-1] or kind
            if k in _OTHER_SCRIPTS:
                items.add(("name", len(text)))
                text += r.choice(_OTHER_SCRIPTS[k])
                continue
            if k == "name" and r.random() < 0.25:
                text += r.choice(titles) + " "
                value = r.choice(["", "O'"]) + r.choice(_FAMILY)
            elif k == "name" and r.random() < 0.2:
                script = r.choice(list(_OTHER_SCRIPTS))
                value = r.choice(_OTHER_SCRIPTS[script])
            else:
                value = make[k](r)
            items.add((k, len(text)))
            text += value
        if text.endswith(value) and r.random() < 0.3:
            text += r.choice(_AFTER)
        if r.random() < 0.3:
            head = r.choice(_BEFORE)
            text, items = head + text, {(k, s + len(head)) for k, s in items}
        if r.random() < 0.3:
            text += r.choice([" That took 35 minutes.", "\n\nMore in ABC-12.", " Why 70 of them?", "\nThanks!", "; more later"])
        out.append(_joined(r, out, text, items))
    return out


def _joined(r: random.Random, before: list[tuple[str, set[tuple[str, int]]]], text: str, items: set[tuple[str, int]]) -> tuple[str, set[tuple[str, int]]]:
    """Every third sentence follows an earlier one, so that what is said of one item isn't taken for the next."""
    if not before or r.random() > 0.35:
        return text, items
    head, known = r.choice(before)
    if len(head) > 200:
        return text, items
    head += r.choice([" ", "\n", ". ", "\n\n", "\n- "])
    return head + text, known | {(k, s + len(head)) for k, s in items}


@lru_cache(maxsize=1)
def models(count: int = TRAINING) -> tuple[Boosted, ...]:
    """The fitted and calibrated trees of each kind."""
    names = Names(frozenset(map(folded, _KNOWN_GIVEN)), frozenset(map(folded, _KNOWN_FAMILY)))
    rows: dict[int, list[tuple[list[int], int, int]]] = {k: [] for k in range(5)}
    for n, (text, items) in enumerate(labelled(count)):
        for k, s, _, f in candidates(text, names):
            rows[k].append((f, int((KINDS[k], s) in items), n % 3))
    out = []
    for k in range(5):
        x, y, part = np.array([f for f, _, _ in rows[k]]), np.array([y for _, y, _ in rows[k]]), np.array([p for *_, p in rows[k]])
        out.append(Boosted(trees=40, depth=4).fit(x[part > 0], y[part > 0]).calibrate(x[part == 0], y[part == 0]) if 0 < y.sum() < len(y) else Boosted(0).fit(x, y))
    return tuple(out)


def select(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """kind, start, end of spans that don't overlap. Longer ones win over those they hold, better ones over the rest."""
    kept: list[tuple[int, int, int]] = []
    for k, s, e, _ in sorted(found, key=lambda x: (-(x[2] - x[1]) if x[0] in (0, 3) else 0, -round(x[3], 3), -(x[2] - x[1]), x[1], x[0])):
        if not any(s < b and a < e for _, a, b in kept):
            kept.append((k, s, e))
    return sorted(kept, key=lambda x: x[1:])


def find_personal(texts: list[str | None], names: Names, trees: tuple[Boosted, ...]) -> list[list[tuple[int, int, int]]]:
    """kind, start, end of the items of each text. Null and empty texts have none. Scores are computed per batch."""
    spans: list[tuple[int, int, int, int]] = []
    feats: list[list[int]] = []
    for i, t in enumerate(texts):
        if t:
            for k, s, e, f in candidates(t, names):
                spans.append((i, k, s, e))
                feats.append(f)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not spans:
        return out
    x = np.array(feats, np.int32)
    kind = np.array([k for _, k, _, _ in spans])
    score = np.zeros(len(spans))
    need = np.array([m.threshold for m in trees])
    for k in range(5):
        at = np.flatnonzero(kind == k)
        if at.size:
            score[at] = trees[k].predict(x[at])
    good: dict[int, list[tuple[int, int, int, float]]] = {}
    for j in np.flatnonzero(score >= need[kind]):
        i, k, s, e = spans[j]
        good.setdefault(i, []).append((k, s, e, float(score[j])))
    for i, found in good.items():
        out[i] = select(found)
    return out


def lexicon(members: DataFrame, limit: int = DIRECTORY_WORDS) -> tuple[frozenset[str], frozenset[str]]:
    """Given and family names of the whole directory. One of more than `limit` distinct words raises ValueError."""
    words = F.split(F.trim("name"), r"\s+")
    part = members.filter("name IS NOT NULL").select(F.element_at(words, 1).alias("given"), F.element_at(words, -1).alias("family"), F.size(words).alias("n")).filter("n > 1")
    found = part.select(F.lit(0).alias("k"), F.col("given").alias("w")).unionByName(part.select(F.lit(1).alias("k"), F.col("family").alias("w"))).filter("w <> ''").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"the directory has more than {limit} names; give a smaller one or a larger limit")
    family = {re.sub(r"^[odl]['’]", "", folded(p)) for r in found if r["k"] for p in re.split(r"[-‐]", r["w"])}
    return frozenset(folded(r["w"]) for r in found if not r["k"]), frozenset(f for f in family if len(f) > 2)


def personal_items(df: DataFrame, text: str, keep: list[str], names: tuple[frozenset[str], frozenset[str]], count: int = TRAINING) -> DataFrame:
    """`keep` columns and kind, start_at, end_at of every item in every text, repeated rows included."""
    trees = models(count)
    if clash := {"kind", "start_at", "end_at"} & {c.lower() for c in keep}:
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    source = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text") + ", kind string, start_at int, end_at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(*names)
        for b in batches:
            rows, kinds, starts, ends = [], [], [], []
            for r, items in enumerate(find_personal(b["__text"].to_pylist(), known, trees)):
                for k, s, e in items:
                    rows.append(r)
                    kinds.append(KINDS[k])
                    starts.append(s)
                    ends.append(e)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b[c].take(take) for c in keep] + [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*keep, "kind", "start_at", "end_at"])

    return source.mapInArrow(run, schema)


def redact_personal(df: DataFrame, text: str, names: tuple[frozenset[str], frozenset[str]], count: int = TRAINING) -> DataFrame:
    """df with a typed placeholder for every item in `text`; all else stays as it is."""
    trees = models(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(*names)
        for b in batches:
            at = b.schema.get_field_index(text)
            texts = b.column(at).to_pylist()
            for i, items in enumerate(find_personal(texts, known, trees)):
                for k, s, e in reversed(items):
                    texts[i] = texts[i][:s] + PLACEHOLDERS[KINDS[k]] + texts[i][e:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(j).type) if j == at else b.column(j) for j in range(b.num_columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)
