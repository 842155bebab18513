"""Near-duplicates against all pairs."""

import random
import re
from itertools import combinations

import pytest

from factloom.llm import neardup


def plain_set(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    if len(w) < words:
        return {tuple(w)}
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def plain_clusters(rows, words):
    sets = [(i, plain_set(t, words)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def made_rows(seed, n=160):
    """Families of copies with few and with many edits, short and empty texts."""
    random.seed(seed)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 40
    rows = []
    for k in range(n // 8):
        base = [random.choice(words) for _ in range(random.choice([1, 2, 3, 12, 40, 120, 400]))]
        for e in range(8):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, max(1, len(base) // 12)])):
                copy[random.randrange(len(copy))] = random.choice(words)
            rows.append((8 * k + e, (" " if e % 2 else "\t").join(copy).upper() if e == 3 else "\n".join(copy)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Été été"), (n + 4, "Été été")]


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_equals_all_pairs(spark, seed, words):
    rows = made_rows(seed)
    random.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    assert sorted(map(tuple, neardup.cluster(docs, words).collect())) == plain_clusters(rows, words)


def test_driver_table_equals_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, neardup.cluster(docs, 2).collect())) == plain_clusters(rows, 2)


def test_second_step_finds_what_hubs_leave(spark, monkeypatch):
    """A chain of texts: neighbours are linked, ends aren't."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.cluster(docs, 2).collect())) == plain_clusters(rows, 2)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_components_whose_centres_are_split(spark):
    """Centres with most of the edges, joined by shuffles whose skewed partitions are split."""
    edges = [(0, i) for i in range(1, 6000)] + [(9000 - i, 9000) for i in range(1, 2000)] + [(7000, 20_000), (20_000, 20_001)]
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.advisoryPartitionSizeInBytes": "2k"}
    was = {k: spark.conf.get(f"spark.sql.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()))
    finally:
        for k, v in was.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert got == {**dict.fromkeys(range(6000), 0), **dict.fromkeys([*range(7001, 9001)], 7001), **dict.fromkeys((7000, 20_000, 20_001), 7000)}


def test_remove_keeps_one_of_each_group(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (5, "q r"), (5, "other text"), (5, "Other  TEXT"), (None, "a b c d e f g"), (9, None), (10, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    out = neardup.remove(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "10", "5", "5", "9", "None"]
    assert neardup.remove(docs.limit(0)).count() == 0
    assert neardup.cluster(docs.limit(0)).count() == 0


def test_remove_takes_any_names(spark):
    names = ["gone", "again", "__gone", "a.b", "rep", "component", "keys", "`q`", "kept"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y"), (3, "x y"), (4, None)]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    out = neardup.remove(docs)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, t, *range(len(names))) for i, t in rows[:1] + rows[2:3] + rows[4:])


def test_long_texts_and_marked_ids(spark):
    """A text of a megabyte with a near copy; ids far apart; marks hold for every id."""
    from pyspark.sql import functions as F

    from factloom.llm.common import Marks

    long = [f"w{i * 7919 % 50_021}" for i in range(150_000)]
    rows = [(10**15, " ".join(long)), (-5, " ".join([*long[:-3000], "x"])), (0, "a b c d"), (1 << 40, "a b c e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.cluster(docs, 2).collect())) == plain_clusters(rows, 2)
    ids = spark.range(0, 5000, 7)
    table = spark.range(6000)
    marks = Marks(ids, "id")
    passed = {r.id for r in marks.keep(table, F.col("id")).collect()}
    assert passed | {r.id for r in marks.leave(table, F.col("id")).collect()} == set(range(6000))
    assert marks.leave(table, F.col("id")).count() == 6000 - len(passed)
    assert set(range(0, 5000, 7)) <= passed and len(passed) < 900
    assert Marks(ids.limit(0), "id").keep(table, F.col("id")).count() == 0
