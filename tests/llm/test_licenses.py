"""License scans against every rule on every text, without gate or sweep."""

import random
import re

import pytest
from re import _constants as op
from re import _parser as parser

from factloom.llm import licenses
from factloom.llm.license_rules import RULES

LINES = [x.split(": ", 1) for x in RULES.splitlines() if x]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text):
    w = words(text)
    joined = " ".join(w)
    base = []
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        base += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    base.sort()
    found = []
    for k, (head, pattern) in enumerate(LINES):
        for m in re.finditer(rf"(?<![^ ])(?:{pattern})(?![^ ])", joined):
            a = joined[: m.start()].count(" ")
            found.append((a, a + m.group().count(" ") + 1, k))
    kept = [x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[1] >= x[1] for y in found)]
    kept.sort(key=lambda x: (x[0], -x[1], x[2]))
    name = lambda k: LINES[k][0].split(" ")[1]
    rest = 1.0
    for x in kept:
        rest *= 1 - float(LINES[x[2]][0].split(" ")[0])
    labels = {b for _, b in base}
    return (
        len(w),
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted(labels)),
        ",".join(sorted(labels | {name(k) for *_, k in kept})),
        round(1 - rest, 12),
        ",".join(f"{name(k)}:{a}:{z}" for a, z, k in kept),
    )


def sample(nodes, rng):
    """A text that an expression matches."""
    out = ""
    for code, arg in nodes:
        if code is op.LITERAL:
            out += chr(arg)
        elif code is op.IN:
            kind, x = rng.choice(arg)
            out += "q" if kind is op.NEGATE else chr(x if kind is op.LITERAL else rng.randint(*x))
        elif code is op.NOT_LITERAL:
            out += "q"
        elif code is op.SUBPATTERN:
            out += sample(arg[-1], rng)
        elif code is op.BRANCH:
            out += sample(rng.choice(arg[1]), rng)
        else:
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3))))
    return out


def made():
    rng = random.Random(5)
    texts = [sample(parser.parse(p), rng) for _, p in LINES for _ in range(2)]
    filler = "the word of a license and copy or later version 2 0 public gnu cc by é".split()
    for _ in range(200):
        parts = [rng.choice(texts if rng.random() < 0.3 else filler) for _ in range(rng.randint(1, 40))]
        texts.append(rng.choice([" ", ", ", ".\n"]).join(parts).title() if rng.random() < 0.5 else " ".join(parts))
    return texts


def test_rules_are_gated():
    rules = licenses.read_rules(RULES)
    assert len(rules) > 200
    rng = random.Random(3)
    for rule, (_, pattern) in zip(rules, LINES, strict=True):
        for _ in range(5):
            text = sample(parser.parse(pattern), rng)
            assert rule.pattern.fullmatch(text.encode()), text
            assert rule.anchor in rule.keywords and rule.keywords <= set(text.encode().split())
    with pytest.raises(ValueError):
        licenses.read_rules("0.5 x: (?:a|b)")


def test_equals_plain_rules(spark):
    rows = [*enumerate(made()), (9001, None), (9002, ""), (9002, "CC-BY"), (None, "MIT License"), (9003, "-- .,"), (9003, "cc by cc by-nc 4.0")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, `a.b` int")
    got = licenses.detect(df.repartition(3)).collect()
    got = sorted((r[0], *r[1:7], round(r.score, 12), r.detections) for r in got if r[0] is not None) + [
        (r[0], *r[1:7], round(r.score, 12), r.detections) for r in got if r[0] is None
    ]
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted(got, key=key) == sorted(((i, *plain(t)) for i, t in rows), key=key)


def test_overlaps_by_priority_and_containment():
    own = licenses.scanner()
    found = lambda text: [(own.rules[k].label, a, z) for a, z, k in own.scan(licenses.ascii_words(text.encode()))[1]]
    assert found("Licensed under the Apache License, Version 2.0.") == [("apache-2.0", 0, 8)]
    assert found("GNU General Public License, version 3 or later") == [("gpl-3.0-or-later", 0, 8)]
    assert found("Licensed under CC BY-NC 4.0.") == [("cc-by-nc-4.0", 2, 7)]
    assert found("GNU Affero General Public License") == [("agpl", 0, 5)]
    assert found("a licence to nothing at all") == []


def test_empty_and_very_long(spark):
    schema = "doc_id long, text string"
    assert licenses.detect(spark.createDataFrame([], schema)).count() == 0
    long = "filler words " * 400_000 + "MIT License " * 20_000
    (row,) = licenses.detect(spark.createDataFrame([(1, long)], schema)).collect()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (840_000, 20_000, 800_000, 839_998)
    assert row.labels == row.base_labels == "mit" and 0.99 < row.score <= 1


def test_table(spark, small):
    from factloom.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r[0]: (*r[1:7], round(r.score, 12), r.detections) for r in QUERIES["op11_licenses"](spark, small).collect()}
    assert got == {r.doc_id: plain(r.text) for r in docs}
    assert any(r[1] for r in got.values())
