"""License scans by ordered signature rules.

A text's words (A-Z folded, everything else that is neither digit, letter nor part
of a longer character counts as space) are joined with single spaces; the rules of
``license_rules`` are expressions over that. A keyword prefilter gates them: the
words that every match of a rule must contain follow from its pattern, the longest
of them is its anchor, and only rules whose anchor and other keywords are all among
the text's words run at all. Most texts hold no anchor and cost one look-up a word.

Overlaps are resolved by priority and containment: rules are ordered, and a
detection goes if one of a rule that stands earlier spans all of its words.
Containment is transitive, so it doesn't matter whether that one goes as well.

The base phrases are counted apart, at every place, and their labels always stay.

A text's score is the chance that one of its surviving detections is right,
1 - prod(1 - weight), from the rules' weights; without detection it is 0.

Defined results: a null or empty text has no words, no places, null first and last
words, empty labels and score 0; a repeated row or id gives a row each; a null id
is kept; other columns are ignored, whatever their names; an empty table gives an
empty result. Very long texts are scanned whole: every rule has bounded gaps, so
its time is linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_map, ascii_words
from factloom.llm.license_rules import RULES

#: Phrases whose places are counted, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    """A signature; its place in the list is its priority, ``keywords`` are in every match."""

    label: str
    weight: float
    pattern: re.Pattern
    keywords: frozenset[bytes]
    anchor: bytes


def keywords(pattern: str) -> frozenset[bytes]:
    """The literal words outside of all groups, classes and optional spaces."""
    open_, mark = re.compile(r"\([^()]*\)(?:\{[^}]*\}|[?*+])?"), "\0"
    while open_.search(pattern):
        pattern = open_.sub(mark, pattern)
    pattern = re.sub(r"\[[^\]]*\]|\s\?", mark, pattern)
    if "|" in pattern:
        return frozenset()
    return frozenset(w.encode() for w in pattern.split(" ") if re.fullmatch("[a-z0-9]+", w))


def bounded(pattern: str) -> re.Pattern:
    """The pattern between the bounds of words."""
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


def read_rules(lines: str) -> tuple[Rule, ...]:
    """Rules from ``weight label: pattern`` lines; each must have a keyword, or it couldn't be gated."""
    rules = []
    for line in filter(None, lines.splitlines()):
        head, pattern = line.split(": ", 1)
        weight, label = head.split(" ")
        if not (found := keywords(pattern)):
            raise ValueError(f"no word is in every match of: {pattern}")
        rules.append(Rule(label, float(weight), bounded(pattern), found, max(sorted(found), key=len)))
    return tuple(rules)


class Scanner:
    """Rules by anchor, and the base phrases."""

    def __init__(self, rules: tuple[Rule, ...], base: tuple[tuple[str, str], ...] = BASE) -> None:
        self.rules = rules
        self.by_anchor: dict[bytes, list[int]] = {}
        for k, rule in enumerate(rules):
            self.by_anchor.setdefault(rule.anchor, []).append(k)
        # a look ahead, so that places which overlap are all found
        self.base = [
            (re.compile(rf"(?<![^ ])(?={re.escape(p)}(?![^ ]))".encode()), label, set(p.encode().split())) for p, label in base
        ]
        self.watched = self.by_anchor.keys() | {max(sorted(need), key=len) for _, _, need in self.base}

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Base places as (first word, label), and surviving detections as (first word, end, rule)."""
        watched = self.watched
        if not any(map(watched.__contains__, words)):
            return [], []
        present, text = set(words), b" ".join(words)
        starts: list[np.ndarray] = []

        def word(at: int) -> int:
            if not starts:
                starts.append(np.cumsum([0, *(len(w) + 1 for w in words)]))
            return int(np.searchsorted(starts[0], at))

        places = [(word(m.start()), label) for pattern, label, need in self.base if need <= present for m in pattern.finditer(text)]
        found = [
            (word(m.start()), word(m.end() + 1), k)
            for anchor in self.by_anchor.keys() & present
            for k in self.by_anchor[anchor]
            if self.rules[k].keywords <= present
            for m in self.rules[k].pattern.finditer(text)
        ]
        return sorted(places), surviving(found)


def surviving(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (first word, end, rule) that none of an earlier rule contains, in order."""
    kept: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []  # (end, rule) of what began before and may still contain something
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        open_ = [(e, r) for e, r in open_ if e > start]
        if not any(e >= end and r < rule for e, r in open_):
            kept.append((start, end, rule))
        open_.append((end, rule))
    return kept


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The library's rules, compiled once in a process."""
    if not _scanner:
        _scanner.append(Scanner(read_rules(RULES)))
    return _scanner[0]


RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, detections string"
)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: words, base places, labels, score; ``detections`` lists ``label:first:end`` in words."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = scanner(), []
        for text in b.column(1).to_pylist():
            words = ascii_words(text)
            places, found = own.scan(words)
            base = {label for _, label in places}
            rest = 1.0
            for _, _, k in found:
                rest *= 1 - own.rules[k].weight
            rows.append(
                (
                    len(words),
                    len(places),
                    places[0][0] if places else None,
                    places[-1][0] if places else None,
                    ",".join(sorted(base)),
                    ",".join(sorted(base | {own.rules[k].label for _, _, k in found})),
                    1 - rest,
                    ",".join(f"{own.rules[k].label}:{a}:{z}" for a, z, k in found),
                )
            )
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")), batch, RESULT
    )
