"""Personal data, also in disguise: transducers rewrite homoglyphs, spelled digits and at/dot disguises, keeping for each
output character the source characters that it stands for; identifiers found in the rewritten text map back to spans.

Offsets are code points. Plain patterns are found in the text as it is; what only the rewritten text shows is added where
it lies in no plain span. Rewriting is local to a disguise, so texts without one cost a search and no more.
"""

import re
import string
from bisect import bisect_right
from hashlib import sha256
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Letters and digits of other scripts that look like ASCII ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g",
    "ⅼ": "l", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@",
}
#: Characters of no width that split an identifier (fixed values).
INVISIBLE = "­​‌‍⁠﻿"
#: English digit words (fixed values).
DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}


def _glyphs() -> dict[str, str]:
    wide = {chr(c + 0xFEE0): chr(c) for c in range(33, 127)}
    scripts = {chr(start + d): str(d) for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE) for d in range(10)}
    return HOMOGLYPHS | wide | scripts | dict.fromkeys(INVISIBLE, "")


#: Last labels that end an address disguised by bare words or spaces, which prose has too; two letters are a country's
#: (fixed values). Brackets and glyphs prove a disguise, whatever the ending.
LAST_LABEL = re.compile(r"\.(?:com|org|net|edu|gov|mil|int|info|biz|app|dev|name|[a-z]{2})\Z", re.IGNORECASE)
GLYPHS = _glyphs()
_GLYPH = "[" + "".join(map(re.escape, GLYPHS)) + "]"
_WORD = "|".join(DIGIT_WORDS)
_NUMBER = rf"(?:{_WORD}|[0-9]{{1,3}})(?:[\s,-]{{1,3}}(?:{_WORD}|[0-9])){{0,2}}"
_TOKEN = re.compile(
    rf"(?P<glyph>{_GLYPH})"
    rf"|(?P<quad>\b{_NUMBER}(?:\s{{1,3}}(?:dot|point)\s{{1,3}}{_NUMBER}){{3}}\b)"
    r"|(?P<at>\s{0,3}[\[({<]\s{0,2}(?:at|AT|At|@)\s{0,2}[\])}>]\s{0,3}|(?<=[A-Za-z0-9])\s{1,2}@\s{1,2}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s{1,3}(?:at|AT)\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\s{1,3}(?:dot|DOT)\s|\s{0,3}[\[({<]\s{0,2}(?:dot|DOT|Dot|\.))))"
    r"|(?P<bare>(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,3}\.[A-Za-z]{2,24}\b))"
    r"|(?P<dot>\s{0,3}[\[({<]\s{0,2}(?:dot|DOT|Dot|\.)\s{0,2}[\])}>]\s{0,3}|(?<=[A-Za-z0-9])\s{1,3}(?:dot|DOT)\s{1,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s{1,2}\.\s{1,2}(?=(?:com|org|net|edu|gov)\b))"
    rf"|(?P<digits>\b(?:plus[\s-]{{1,3}})?(?:{_WORD})(?:[\s,.-]{{1,3}}(?:{_WORD}|[0-9]))+\b)",
    re.IGNORECASE,
)
_ANY_GLYPH = re.compile(_GLYPH, re.IGNORECASE)
_DOT = re.compile(r"\b(?:dot|point)\b")
_BRACKETED = re.compile(r"[\[({<]\s{0,2}(?:dot|\.|(?:at|@)\s{0,2}[\])}>])")
_APART = re.compile(r"\s@\s")
_BARE = re.compile(r"[a-z0-9]\s{1,3}at\s{1,3}[a-z0-9-]{1,63}\.")
#: An address whose only disguise is a bare `at`, as prose has it too ("look at example.com"): its local part must be more
#: than a word, or a word that announces an address must stand before it (fixed values).
_ONLY_AT = re.compile(r"(?P<local>[A-Za-z0-9._%+-]+)\s{1,3}at\s{1,3}[A-Za-z0-9.-]+", re.IGNORECASE)
_MORE = re.compile(r"[0-9._%+-]")
_ANNOUNCED = re.compile(r"\b(?:e-?mail(?:ed)?|mail|contact|reach|write|address)(?:\W{1,4}(?:me|us|to|is|at|him|her|them)){0,2}\W{1,4}\Z", re.IGNORECASE)
#: Both an at and a dot as words or apart: a disguise whatever the ending, unless prose stands there ("look at the dot above"),
#: whose first word after `at` is one of these (fixed values).
_AT_DOT = re.compile(r"[^\s@]\s{1,3}(?:at|@)\s{1,3}(?!(?:the|a|an|this|that|each|every|one|his|her|its|my|your|our|their|which|any|no)\s)[^\s@]+(?:\s{1,3}dot\s{1,3}[^\s@]+)+\Z", re.IGNORECASE)
_WORDY = re.compile(r"\.(?:[a-z]{2,24}|[A-Z]{2,24})\Z")
#: Letters set apart by single spaces before a disguised address's last one.
_APART_LETTERS = re.compile(r"(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9] (?:[A-Za-z0-9._] )*)\Z")
_ENDING = re.compile(r"\.\s{1,2}(?:com|org|net|edu|gov)\b")
_RUNS = {w: re.compile(rf"{w}[\s,.-]{{1,3}}(?:{_WORD}|[0-9])") for w in DIGIT_WORDS}
#: Letters that match s or i without regard to case, but are not so in lower case.
_FOLDED = re.compile("[ſıİ]")
_QUAD = re.compile(rf"{_WORD}|[0-9]|dot|point", re.IGNORECASE)
_ONE = re.compile(rf"{_WORD}|[0-9]|plus", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the local characters before it, not before the last found span; linear in the text's length."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if at > floor and text[at - 1] in _LOCAL and (domain := _DOMAIN.match(text, at)):
            start = at - 1
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", at + 1)
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find(text: str) -> list[Span]:
    """Plain identifiers by kind, then start; leftmost, without overlap in a kind, failing matches dropped."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        if _DOTTED.search(text):
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def rewrite(text: str) -> tuple[str, list[tuple[int, int, int]]]:
    """The text without its disguises, and the rewritten places: (output start, source start, source end).

    Between two places characters map one to one; all output of a place stands for all its source characters.
    """
    out, places, source, size = [], [], 0, 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "glyph":
            new = GLYPHS.get(m[0], m[0])
        elif kind == "quad":
            new = "".join(DIGIT_WORDS.get(w.lower(), "." if w.lower() in ("dot", "point") else w) for w in _QUAD.findall(m[0]))
        elif kind == "digits":
            new = "".join(DIGIT_WORDS.get(w.lower(), "+" if w.lower() == "plus" else w) for w in _ONE.findall(m[0]))
        else:
            new = "." if kind == "dot" else "@"
        out += (text[source : m.start()], new)
        size += m.start() - source
        places.append((size, m.start(), m.end()))
        places.append((size + len(new), m.end(), m.end()))
        size, source = size + len(new), m.end()
    out.append(text[source:])
    return "".join(out), places


def _back(places: list[tuple[int, int, int]], start: int, end: int) -> tuple[int, int, bool]:
    """Source span of the output span, and whether a rewritten place is in it."""

    def at(x: int, last: bool) -> tuple[int, bool]:
        i = bisect_right(places, (x, 1 << 62, 0)) - 1
        if i < 0:
            return (x + 1 if last else x), False
        begin, a, b = places[i]
        inside = b > a
        return (b if last else a) if inside else a + x - begin + last, inside

    (a, one), (b, two) = at(start, False), at(end - 1, True)
    return a, b, one or two or bisect_right(places, (start, 1 << 62, 0)) < bisect_right(places, (end - 1, 1 << 62, 0))


def cued(text: str) -> bool:
    """Whether anything in the text could be a disguise: quick searches, since most texts have none; True wherever _TOKEN
    finds something."""
    if not text.isascii() and (_ANY_GLYPH.search(text) or _FOLDED.search(text)):
        return True
    low = text.lower()
    if "at" in low and _BARE.search(low):
        return True
    if "dot" in low and _DOT.search(low) or _BRACKETED.search(low) or "@" in low and _APART.search(low) or _ENDING.search(low):
        return True
    return any(w in low and run.search(low) for w, run in _RUNS.items())


def find_disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the rewritten text shows, beside the plain ones that none may lie in."""
    if not cued(text):
        return []
    new, places = rewrite(text)
    if not places:
        return []
    taken = sorted((a, b) for _, a, b in plain)
    reach = list(accumulate((b for _, b in taken), max))
    out = []
    for kind, start, end in find(new):
        a, b, changed = _back(places, start, end)
        i = bisect_right(taken, (a, 1 << 62))
        if changed and b > a and not (i and reach[i - 1] >= b):
            if kind != "email" or _address(text, a, b, new[start:end]):
                if kind == "email" and b - a > 2 and text[a + 1].isspace() and (apart := _APART_LETTERS.search(text, max(0, a - 128), a)):
                    a = apart.start()
                out.append((kind, a, b))
    return out


def _address(text: str, start: int, end: int, plain: str) -> bool:
    """Whether what reads as an address without its disguises is one: brackets, glyphs, and an at together with a dot prove
    it; so does an @ apart before a domain that ends in letters of one case; else the ending must be known and no prose."""
    own = text[start:end]
    if _BRACKETED.search(own.lower()) or _ANY_GLYPH.search(own):
        return True
    if _WORDY.search(plain) and (_AT_DOT.search(own) or _APART.search(own)):
        return True
    return bool(LAST_LABEL.search(plain)) and not _prose(text, start, end)


def _prose(text: str, start: int, end: int) -> bool:
    """Whether a span is a word, a bare `at` and a domain that nothing says is an address."""
    only = _ONLY_AT.fullmatch(text, start, end)
    return bool(only) and not _MORE.search(only["local"]) and not _ANNOUNCED.search(text[max(0, start - 24) : start])


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first, in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs.

    n_ counts plain and disguised spans. Null texts count as empty: no spans, the digest of nothing. Repeated rows get a row
    each, null ids are kept, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def spans(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = find(text) if text else []
            every = base + (find_disguised(text, base) if text else [])
            counts = [sum(s[0] == k for s in every) for k in KINDS]
            rows.append((*counts, sha256(spell(base).encode()).hexdigest(), spell(every)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", spans("text").alias("s")).select("doc_id", "s.*")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by its kind; null texts stay null, other columns and repeated rows as
    they are, and an empty table gives no rows."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            base = find(text) if text else []
            every = base + (find_disguised(text, base) if text else [])
            out.append(redact(text, every) if every else text)
        return pd.Series(out, dtype=object)

    quoted = lambda c: F.col(f"`{c}`")
    return docs.select(*(clean(quoted(c)).alias(c) if c == text_col else quoted(c) for c in docs.columns))
