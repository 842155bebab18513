"""Secrets by a trigram inverted index.

From the parse tree of each rule's expression a Boolean query over trigrams is
derived: every text that the expression matches must satisfy it. A block of
texts is indexed once (trigram -> texts that hold it, only trigrams that some
query names), the postings are intersected and united as the query says, and
the expression runs over the whole text of the candidates alone. Rules without
a mandatory trigram (``hex``) scan every text.

The index folds A-Z to a-z, so one index serves rules of either case; folding
only adds candidates, which the expression then verifies.

Base kinds: ``assign``, ``access``, ``hex``. Added kinds: ``github``, ``slack``,
``stripe``, ``google``, ``jwt``, ``pem``.

Defined results: a null or empty text has no spans; a repeated row or id gives a
row each; a null id is kept; other columns are ignored; an empty table gives an
empty result. Texts are never cut; blocks are bounded in bytes, a longer text is
a block of its own.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from re import _constants as op
from re import _parser as parser

from factloom.llm.common import arrow_map, redact, runs_by_bytes, span_text, texts_of

#: The most strings that a part of an expression may stand for before it is treated as unknown.
MOST_STRINGS = 64
#: Bytes of text that are indexed together.
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """An expression; ``group`` must have at least ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = re.ASCII


RULES = (
    Rule(
        "assign",
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
        flags=re.ASCII | re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(r.kind for r in RULES)

# A query is True (no demand), a trigram, ("and", ...) or ("or", ...).


def _all(parts) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> object:
    """What holds if one of ``strings`` occurs: all trigrams of one of them."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _node(code, arg) -> tuple[set[str] | None, object]:
    """(the strings a node stands for, lower case, or None if too many; its query otherwise)."""
    if code is op.LITERAL and arg < 128:
        return {chr(arg).lower()}, True
    if code is op.IN and arg[0][0] is not op.NEGATE:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is op.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is op.RANGE and x[1] < 128:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if code is op.SUBPATTERN:
        return _sequence(arg[-1])
    if code is op.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            union = set().union(*(s for s, _ in parts))
            if len(union) <= MOST_STRINGS:
                return union, True
        return None, _any(q if s is None else _of_strings(s) for s, q in parts)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == high and strings is not None and len(strings) ** low <= MOST_STRINGS:
            return {"".join(x) for x in product(strings, repeat=low)}, True
        return None, (query if strings is None else _of_strings(strings)) if low else True
    return None, True


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """Adjacent nodes of few strings are joined, so that trigrams may span them."""
    run: set[str] = {""}
    demands, whole = [], True
    for code, arg in nodes:
        strings, query = _node(code, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        demands.append(_of_strings(run))
        run, whole = (strings, False) if strings is not None else ({""}, False)
        demands.append(query)
    return (run, True) if whole else (None, _all([*demands, _of_strings(run)]))


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every match of ``pattern`` satisfies; True if there is none."""
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1:]))


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


@lru_cache(maxsize=1)
def _plan() -> tuple[list[tuple[Rule, re.Pattern, object]], np.ndarray]:
    rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern)) for r in RULES]
    wanted = np.zeros(1 << 24, dtype=bool)
    for _, _, query in rules:
        wanted[[_code(t) for t in _trigrams(query)]] = True
    return rules, wanted


def postings(texts: list[bytes], wanted: np.ndarray) -> dict[int, np.ndarray]:
    """Trigram code -> sorted numbers of the texts that hold it, for the wanted trigrams."""
    joined = np.frombuffer(b"\n\n".join(texts).lower(), dtype=np.uint8)
    if joined.size < 3:
        return {}
    codes = joined[:-2].astype(np.uint32)
    codes <<= 8
    codes |= joined[1:-1]
    codes <<= 8
    codes |= joined[2:]
    at = np.flatnonzero(wanted[codes])
    ends = np.cumsum([len(t) + 2 for t in texts])
    pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
    found, starts = np.unique(pairs >> 32, return_index=True)
    return dict(zip(found.tolist(), np.split(pairs & 0xFFFFFFFF, starts[1:]), strict=True)) if pairs.size else {}


def candidates(query: object, index: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The numbers of the texts that satisfy a query, rarest postings first."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return index.get(_code(query), np.empty(0, np.int64))
    lists = sorted((candidates(q, index, n) for q in query[1:]), key=len)
    found = lists[0]
    for other in lists[1:]:
        if query[0] == "and" and not found.size:
            break
        found = (
            np.intersect1d(found, other, assume_unique=True) if query[0] == "and" else np.union1d(found, other)
        )
    return found


def find_block(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The spans of each text of a block as (kind, start, end) in code points."""
    rules, wanted = _plan()
    index = postings([t.encode("utf-8", "surrogatepass") for t in texts], wanted)
    spans: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for rule, pattern, query in rules:
        for i in candidates(query, index, len(texts)).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[i].append((rule.kind, m.start(), m.end()))
    return spans


def find_spans(texts: list[str]) -> list[list[tuple[str, int, int]]]:
    out = []
    for a, b in runs_by_bytes([len(t) for t in texts], BLOCK_BYTES):
        out += find_block(texts[a:b])
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans of every whole text."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = find_spans(texts_of(b.column(1)))
        base = [span_text([s for s in spans if s[0] in BASE], KINDS) for spans in found]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                *(pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in KINDS),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                pa.array([span_text(spans, KINDS) for spans in found]),
            ],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
        batch,
        "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string",
    )


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; null texts stay null."""
    place = docs.columns.index(text_col)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        old = b.column(place).to_pylist()
        found = find_spans([x or "" for x in old])
        new = [x if x is None else redact(x, s) for x, s in zip(old, found, strict=True)]
        columns = list(b.columns)
        columns[place] = pa.array(new, b.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return arrow_map(docs, batch, docs.schema)
