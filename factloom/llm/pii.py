"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, address schemes and words that announce an identifier. From each anchor
a deterministic parser of its own grows a span to its boundaries and validates
it. Spans of a kind never overlap, since every parser has a cursor that it
doesn't go back behind, and what is known of a run of address characters (its
end, its last at-sign) is kept for all anchors in the run; so the time is linear
in the text.

Base kinds: ``email``, ``ip``, ``card`` (12 to 19 digits, Luhn), ``phone`` (9 to
15 digits). The anchors add ``address`` (an address with a scheme that names a
person: user information before the host, or ``mailto:`` and ``tel:``) and
``account`` (a bank or identity number behind a word that announces it, however
many blanks and marks are between: an IBAN that passes its check digits, 6 to 20
digits, or behind ``passport`` 6 to 9 capital letters and digits, two of them digits).

Defined results: a null or empty text has no spans; a repeated row or id gives a
row each; a null id is kept; other columns are ignored; an empty table gives an
empty result. Texts are never cut.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, redact, span_text, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
#: Characters of an IBAN by country; where words follow one, its length tells them apart.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]*")
_ADDRESS = re.compile(r"[^\s\"'<>`\\^{|}]*")
_LEAD = re.compile(r"[ \t.:#=]*(?:(?:no|nr|num|number)\b[ \t.:#=]*)?", re.IGNORECASE)
#: An IBAN has at most 34 characters; what is longer than that shows in the 35th.
_IBAN_RUN = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9]){0,34}")
_PASSPORT = re.compile(r"(?=(?:[A-Z]*[0-9]){2})[A-Z0-9]{6,9}(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"(?:[A-Za-z][ -]?){2}[0-9][ -]?[0-9]")
_GROUP = re.compile(r"[A-Za-z0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), ("s", SCHEMES), ("c", CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def iban(code: str) -> bool:
    """Two letters, two check digits, 11 to 30 more characters, remainder 1 modulo 97."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start < at and (host := _DOMAIN.match(text, at + 1)):
        return start, host.end()
    return None


def _iban_end(run: str) -> int | None:
    """Where the IBAN that a run begins with ends: of the ends of its groups one of the country's length, or else the last that passes."""
    if not _IBAN_HEAD.match(run):
        return None
    last = None
    for group in _GROUP.finditer(run):
        code = run[: group.end()].upper().replace(" ", "").replace("-", "")
        if len(code) > 34:
            break
        if iban(code):
            last = group.end()
            if len(code) == IBAN_LENGTHS.get(code[:2]):
                break
    return last


def _account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The number behind an announcing word: an IBAN, or else 6 to 20 digits, or a passport's letters and digits."""
    start = _LEAD.match(text, at).end()
    run = _IBAN_RUN.match(text, start)
    if not run:
        return None
    if iban_end := _iban_end(run[0]):
        return start, start + iban_end
    if cue == "passport" and (m := _PASSPORT.match(text, start)):
        return m.span()
    digits = _GROUPED.match(text, start)
    if digits and 6 <= sum(c not in " -" for c in digits[0]) <= 20:
        return digits.span()
    return None


class _Run:
    """A run of address characters: where it ends, and where its last at-sign and its sixth digit from the end are."""

    def __init__(self, text: str, start: int) -> None:
        self.end = _ADDRESS.match(text, start).end()
        self.stop = start + len(text[start : self.end].rstrip(".,;:!?)]*&%$#"))
        self.at = text.rfind("@", start, self.stop)
        self.digits, left = -1, 6
        for i in range(self.stop - 1, start - 1, -1):
            if "0" <= text[i] <= "9":
                left -= 1
                if not left:
                    self.digits = i
                    break


def _address(text: str, start: int, body: int, scheme: str, run: _Run) -> tuple[int, int] | None:
    """An address with a user part, or a mail or telephone address; ends before closing punctuation."""
    if scheme == "mailto:":
        good = run.at >= body
    elif scheme == "tel:":
        good = run.digits >= body
    else:
        slash = text.find("/", body, run.stop)
        host = run.stop if slash < 0 else slash
        at = text.rfind("@", body, host)
        good = body < at < host - 1
    return (start, run.stop) if good else None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, end exclusive."""
    spans: list[tuple[str, int, int]] = []
    email = dotted = grouped = dialled = address = account = 0
    run: _Run | None = None
    for last, (kind, size) in _anchors().iter(text):
        at = last - size + 1
        if kind == "0":
            if at >= dotted:
                m = _DOTTED.match(text, at)
                dotted = m.end()
                if m[0].count(".") >= 3:
                    place, parts = at, m[0].split(".")
                    for i in range(0, len(parts) - 3, 4):
                        four = parts[i : i + 4]
                        end = place + sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                            spans.append(("ip", place, end))
                        place = end + 1
            if at >= grouped:
                m = _GROUPED.match(text, at)
                grouped = m.end()
                if m.end() - at >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", at, m.end()))
        elif kind == "@":
            if found := _email(text, at, email):
                spans.append(("email", *found))
                email = found[1]
        elif kind == "+":
            if at >= dialled and (m := _DIALLED.match(text, at)):
                number = m[0].rstrip(" ().-")
                if len(number) >= 4:
                    dialled = at + len(number)
                    if 9 <= sum("0" <= c <= "9" for c in number) <= 15:
                        spans.append(("phone", at, dialled))
        elif kind == "s":
            if at >= address:
                if run is None or last + 1 > run.end:
                    run = _Run(text, last + 1)
                if found := _address(text, at, last + 1, text[at : last + 1].lower(), run):
                    spans.append(("address", *found))
                    address = found[1]
        elif at >= account and not (at and text[at - 1].isalnum()):
            if found := _account(text, last + 1, text[at : last + 1].lower()):
                spans.append(("account", *found))
                account = found[1]
    return spans


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans and their number, of every whole text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, lists, totals = [], [], []
        for text in texts_of(b.column(1)):
            spans = find_spans(text)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            base = span_text([s for s in spans if s[0] in BASE], KINDS)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            lists.append(span_text(spans, KINDS))
            totals.append(len(spans))
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests), pa.array(lists), pa.array(totals, pa.int64())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        batch,
        "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long",
    )


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null, all rows and columns stay."""
    place = docs.columns.index(text_col)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        new = [x if x is None else redact(x, find_spans(x)) for x in b.column(place).to_pylist()]
        columns = list(b.columns)
        columns[place] = pa.array(new, b.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return arrow_map(docs, batch, docs.schema)
