"""The filter audit against filters applied one after the other."""

import random
import re
from itertools import permutations

import pytest

from factloom.llm import audit


def plain(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, t or "", s or "") for i, t, s in docs]
    fails = []
    for i, t, _ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = set()
        if len(w) < 50:
            f.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and t == u for j, u, _ in rows):
            f.add("E")
        fails.append(f)
    out = []
    for part in {s for *_, s in rows}:
        mine = [(rows[k][0], fails[k]) for k in range(len(rows)) if rows[k][2] == part]
        share = dict.fromkeys("ABCDE", 0)
        made = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[f] += len(gone)
                count = lambda s: sum(i in s for i, _ in gone)  # noqa: B023, E731
                failing = sum(f in x[1] for x in mine)
                only = sum(x[1] == {f} for x in mine)
                made.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), only, count(good), count(toxic), f))
        out += [(*m[:-1], share[m[-1]]) for m in made]
    return sorted(out)


def documents():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Straße", "A", "BC", "x|y", "5%"]
    docs = []
    for i in range(150):
        n = rng.choice([0, 1, 30, 49, 50, 51, 80, 200])
        docs.append((i, rng.choice([" ", "\t", "\x0b\n", "  "]).join(rng.choices(vocabulary[: rng.choice([20, 60, 64, 66])], k=n)), rng.choice(["s0", "s0", "s0", "s1", None])))
    docs += [(200 + i, docs[rng.randrange(60)][1], rng.choice(["s0", "s2", ""])) for i in range(60)]
    plain_words = " ".join(f"u{k}" for k in range(60))
    docs += [(300, None, "s1"), (301, "", "s1"), (None, "", "s1"), (None, plain_words, "s1"), (302, plain_words, "s1"), (302, plain_words, "s1"), (303, plain_words, "s9"), (304, "A" * 19 + "\xa0" * 361, "s4"), (305, "A" * 5 + "é" * 95, "s4"), (306, "A" * 6 + "é" * 94, "s4")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in range(0, 306, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("parts", [256, 2])
def test_equals_filters_in_a_row(spark, monkeypatch, parts):
    monkeypatch.setattr(audit, "PARTS", parts)
    docs, labels = documents()
    d = spark.createDataFrame([(*r, 1, "n") for r in docs], "doc_id long, text string, source string, failed int, `a.b` string").repartition(3)
    la = spark.createDataFrame([(*r, "n") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = sorted(map(tuple, audit.audit(d, la).collect()))
    assert got == plain(docs, labels)


def test_table_of_first_failures():
    table = audit.failure_table()
    assert table.shape == (32, 120)
    for bits in range(32):
        for k, order in enumerate(audit.ORDERS):
            steps = [s for s, f in enumerate(order) if bits >> "ABCDE".index(f) & 1]
            assert table[bits, k] == (steps[0] if steps else 5)


def test_empty_and_very_long(spark):
    schema = "doc_id long, text string, source string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], schema), labels).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000))
    got = audit.audit(spark.createDataFrame([(1, long, "s"), (2, long, "s")], schema), labels).where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [r.kept for r in got] == [2, 2, 2, 2, 1] and [r.shapley for r in got] == [0, 0, 0, 0, 120]


def test_table(spark, small):
    from factloom.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, QUERIES["op13_filter_audit"](spark, small).collect())) == plain(docs, labels)
