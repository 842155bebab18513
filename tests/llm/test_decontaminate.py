"""Decontamination against plain window sets."""

import hashlib
import random
import re

import pytest

from factloom.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).update([] if i is None else [str(i)])
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def made():
    random.seed(11)
    vocabulary = ["a", "b", "c", "é", "x9"]
    items = [(k, " ".join(random.choice(vocabulary) for _ in range(random.choice([1, 2, 5, 12, 13, 14, 40])))) for k in range(30)]
    items = [(k, t if len(t) > 12 else f"rare{k} {t}") for k, t in items] + [(99, None), (98, ""), (None, "a b"), (97, "solo"), (97, "a a a a a a a a a a a a a a a")]
    docs = []
    for k in range(120):
        w = [random.choice(vocabulary) for _ in range(random.randint(0, 60))]
        if k % 3 == 0:
            passage = (random.choice(items)[1] or "").split()
            w[5:5] = [x.upper() for x in passage]
        docs.append((k, ", ".join(w)))
    return [*docs, (500, None), (501, ""), (502, "--"), (502, "Solo!"), (None, "solo")], items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_equals_plain_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = made()
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(d, b).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items)
    clean = decontaminate.remove(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not r.contaminated for r in got)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove(d, b).count() == 1
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_matches_are_the_longest(spark):
    passage = " ".join(f"k{i}" for i in range(30))
    d = spark.createDataFrame([(1, f"x y {passage} z")], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(d, b).collect()] == [(1, 2, 32)]


def test_long_texts_and_items_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    random.seed(13)
    passage = [f"k{i % 997}" for i in range(400)]
    items = [(1, " ".join(passage)), (2, " ".join(passage[100:120]))]
    docs = [(1, " ".join([f"f{i}" for i in range(100_000)] + passage[37:80])), (2, " ".join(passage)), (3, " ".join(passage[49:62])), (4, "x " * 300_000)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, found_ranges int, `a.b` int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == plain(docs, items)
    assert sorted(r.doc_id for r in decontaminate.remove(d, b).collect()) == [1, 4]


def test_items_without_id_are_hit_but_not_named(spark):
    d = spark.createDataFrame([(1, "x a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "a b c"), (None, "-"), (None, None)], "item_id long, text string")
    (row,) = decontaminate.report(d, b).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (4, 3, 0, True)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_many_items_share_a_window():
    """10,000 items of the same word and 200 that share a passage, against a text of 500,000 such words."""
    passage = [f"p{i}".encode() for i in range(13)]
    items = [(k, [b"same"]) for k in range(10_000)] + [(20_000 + k, [b"u%d" % k, *passage]) for k in range(200)] + [(7, [b"same", b"same"])]
    tests = decontaminate.TestSuffixes(items)
    texts = [b" ".join([b"same"] * 500_000), b" ".join([b"x", *passage, b"same"]), b"x"]
    found = decontaminate._matches(texts, tests)
    assert [(n, r) for n, r, _ in found] == [(500_000, [(0, 500_000)]), (15, [(1, 15)]), (1, [])]
    assert [len(i) for *_, i in found] == [10_000, 10_200, 0]
