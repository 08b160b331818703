"""Personal data in texts: regular expressions propose, checksums confirm, context words adjust the score.

Base kinds: email, ip (parts up to 255), card (13 to 19 digits, Luhn) and phone (a plus, 9 to 15 digits); of each
kind the leftmost matches that do not overlap, and matches that fail their check are dropped without a retry. Added
spans: cards and phones within a match that failed, next to other numbers; iban (length of the country, mod-97); and,
only where a context word stands close before them, ssn, phone_local and cards written in small groups of digits. A
score starts from the kind's and rises with context words in the `NEAR` characters before the span; added kinds need
`LEAST`, base kinds stay whatever their score.

Within a failed match, a card is a window of whole groups of digits, 13 to 19 in all, that begins with 2 to 6 and
passes Luhn; of windows that overlap, those of the issuer's usual length come first. Without a context word its first
group must have four digits and all but the last three, since one window of small numbers in ten passes Luhn. A phone
begins at the plus and ends after a group: at the length of its country's numbers where that is fixed, or else after
the last group within 15 digits, so that none of its own digits is left over.

Every pattern is written so that the search takes time in proportion to the text: runs are entered at their first
character only, and repeats that cannot help are possessive.

Defined cases: a null text counts as empty and has no spans; offsets count code points and ends are exclusive;
repeated rows are each searched; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_pieces

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local")
NEAR, LEAST = 40, 0.7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
#: Digits of a phone, country code included, where all numbers of the country have as many.
PHONE_LENGTH = {"1": 11, "7": 11, "30": 12, "31": 11, "33": 11, "34": 11, "41": 11, "44": 12, "45": 10, "47": 10, "48": 11, "52": 12, "61": 11, "65": 10, "86": 13, "90": 12, "91": 12, "351": 12, "420": 12, "421": 12}
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE_LOCAL = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NOT_DIGITS = re.compile(r"[^0-9]+")

CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write to|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|client)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|tarjeta|carte|karte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|tax id)\b"),
    "phone_local": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|fax)\b"),
}
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.45, "phone_local": 0.4}
#: All countries of the registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN_OF = {c: re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{n - 1}}}") for c, n in IBAN_LENGTH.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True if the account number, country and check digits moved to its end and letters read as 10 to 35, leaves 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            yield m.span()


def _digits(pattern: re.Pattern[str], text: str, least: int, most: int, check: bool) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        d = _NOT_DIGITS.sub("", m[0])
        if least <= len(d) <= most and (not check or luhn(d)):
            yield m.span()


def _failed(pattern: re.Pattern[str], text: str, least: int, most: int, check: bool) -> Iterator[list[tuple[int, int, str]]]:
    """Groups of digits (start, end, digits) of the matches of `pattern` that `_digits` drops."""
    for m in pattern.finditer(text):
        groups = [(*x.span(), x[0]) for x in _GROUP.finditer(text, m.start(), m.end())]
        d = "".join(g[2] for g in groups)
        if len(d) > most or (check and len(d) >= least and not luhn(d)):
            yield groups


def _usual(digits: str) -> bool:
    return len(digits) == (15 if digits[:2] in ("34", "37") else 14 if digits[:2] in ("30", "36", "38") else 16)


def _cards_inside(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Cards within failed matches: those grouped as cards are, and others."""
    found = []
    for groups in _failed(_CARD, text, 13, 19, True):
        for k, (start, _, head) in enumerate(groups):
            if not "2" <= head[0] <= "6":
                continue
            digits, regular = "", len(head) >= 4
            for _, end, more in groups[k : k + 19]:
                digits += more
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    found.append((not regular, not _usual(digits), start, end))
                regular = regular and len(more) >= 3
    plain: list[tuple[int, int]] = []
    other: list[tuple[int, int]] = []
    # a window is shorter than 40 characters, so those it may overlap begin in its own or a neighbouring forty
    near: dict[int, list[tuple[int, int]]] = {}
    for odd, _, a, b in sorted(found):
        if not any(x < b and a < y for at in (a // 40 - 1, a // 40, a // 40 + 1) for x, y in near.get(at, ())):
            near.setdefault(a // 40, []).append((a, b))
            (other if odd else plain).append((a, b))
    return plain, other


def _phones_inside(text: str) -> Iterator[tuple[int, int]]:
    for groups in _failed(_PHONE, text, 9, 15, False):
        ends, n = {}, 0
        for _, end, more in groups:
            n += len(more)
            if n > 15:
                break
            if n >= 9:
                ends[n] = end
        if ends:
            digits = "".join(g[2] for g in groups[:4])[:3]
            fixed = next((PHONE_LENGTH[digits[:k]] for k in (1, 2, 3) if digits[:k] in PHONE_LENGTH), 0)
            whole = len(groups[0][2]) if len(groups[0][2]) >= 9 else fixed
            yield groups[0][0] - 1, ends[whole if whole in ends else max(ends)]


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country and check digits on, just the country's length; what follows that is no part of it."""
    m = _IBAN.search(text)
    while m:
        at = m.end()
        whole = _IBAN_OF[m[0][:2]].match(text, m.start()) if m[0][:2] in _IBAN_OF else None
        if whole and not text[whole.end() : whole.end() + 1].isalnum() and mod97(whole[0].replace(" ", "")):
            yield whole.span()
            at = whole.end()
        m = _IBAN.search(text, at)


def find(text: str | None) -> list[Span]:
    """All spans by kind in the order of KINDS, then by start."""
    if not text:
        return []
    out = []

    def add(kind: str, places: Iterator[tuple[int, int]], needed: float = 0.0, base: bool = False) -> None:
        for a, b in places:
            score = min(1.0, START[kind] + (0.3 if CONTEXT[kind].search(text, max(0, a - NEAR), a) else 0.0))
            if score >= needed:
                out.append(Span(kind, a, b, round(score, 2), base))

    if "@" in text:
        add("email", _emails(text), base=True)
    add("ip", _ips(text), base=True)
    add("card", _digits(_CARD, text, 13, 19, True), base=True)
    plain, other = _cards_inside(text)
    add("card", iter(plain))
    add("card", iter(other), 1.0)  # with a context word
    if "+" in text:
        add("phone", _digits(_PHONE, text, 9, 15, False), base=True)
        add("phone", _phones_inside(text))
    add("iban", _ibans(text))
    add("ssn", ((m.start(), m.end()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"), LEAST)
    taken = [(s.start, s.end) for s in out]
    add("phone_local", (m.span() for m in _PHONE_LOCAL.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)), LEAST)
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the one that begins first counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
    return "".join(out) + text[at:]


SPAN = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def spans_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per input row: id and `spans`; with `redacted`, also the text without them."""
    rows = df.select(F.col(id_col), F.col(text_col))
    kind = rows.schema[0].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(t) for t in texts]
            cols = [b.column(0), pa.array([[s._asdict() for s in f] for f in found], struct)]
            if redacted:
                cols.append(pa.array([t if t is None else redact(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "spans", "redacted"][: len(cols)])

    return map_pieces(rows, run, f"`{id_col}` {kind}, spans {SPAN}" + ", redacted string" * redacted)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, the digest of these spans, all spans and their scores as text."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
