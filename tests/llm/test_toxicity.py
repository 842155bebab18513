"""Held-out accuracy, and labels that don't leak."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    w = toxicity.train(docs, labels)
    rows = toxicity.score(docs, w).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    auc = np.mean(s[y == 1][:, None] > s[y == 0][None, :])
    assert auc > 0.9 and (s[y == 0] >= toxicity.THRESHOLD).mean() < 0.02
    # held-out labels have no influence
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert np.array_equal(w.index, again.index) and np.array_equal(w.value, again.value) and w.bias == again.bias


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "bad words here", 0.5), (2, "x " * 100_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (99, 1), (3, None)], "doc_id long, toxic int")
    w = toxicity.train(docs, labels)
    got = toxicity.score(docs, w).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), w).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.remove(docs, none).columns == docs.columns and toxicity.remove(docs, none).count() == 4


def test_fit_learns_pairs_and_skips():
    h = toxicity.Hasher()
    rows = []
    for i in range(400):
        words = [f"w{i * 7 % 31}".encode(), b"you", f"k{i % 5}".encode(), b"fool"] if i % 2 else [f"w{i * 7 % 31}".encode(), b"fool", b"x", b"you"]
        rows.append((np.unique(h.features(words)), i % 2))
    w = toxicity.fit(rows)
    assert w.score(h.features([b"you", b"zz", b"fool"])) > 0.7 > w.score(h.features([b"fool", b"x", b"you"]))


def plain_ftrl(rows):
    """FTRL-proximal coordinate by coordinate, as published."""
    z, n = {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA)
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return -(zi - (1 if zi > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, label in rows:
            used = [*features.tolist(), "bias"]
            w = {i: weight(i) for i in used}
            p = 1 / (1 + np.exp(-max(-35, min(35, sum(w.values())))))
            g = p - label
            for i in used:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i) != 0}, weight("bias")


def test_weights_and_scores_equal_plain_ftrl(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    h = toxicity.Hasher()
    found = {i: np.unique(h.features(toxicity.ascii_words(t.encode()))) for i, t in texts.items()}
    order = sorted((i for i in known if i in texts), key=lambda i: (zlib.crc32(str(i).encode()), i))
    weights, bias = plain_ftrl([(found[i], known[i]) for i in order])
    w = toxicity.train(docs, labels)
    assert len(weights) > 20 and w.index.tolist() == sorted(weights)
    assert np.allclose(w.value, [weights[i] for i in sorted(weights)], atol=1e-9) and abs(w.bias - bias) < 1e-9
    for r in toxicity.score(docs, w).collect():
        s = bias + sum(weights.get(i, 0.0) for i in found[r.doc_id].tolist())
        assert abs(r.score - 1 / (1 + np.exp(-s))) < 1e-9 and r.predicted == (r.score >= 0.7)


def test_rows_of_a_repeated_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 20)
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"good words {i}") for i in known] + [(known[0], f"other words {k}") for k in range(500)] + [(known[1], "same again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in known], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: toxicity.Weights(np.array([len(rows)]), np.array([1.0]), 0.0))
    seen = toxicity.train(docs, labels).index.tolist()
    assert seen == [20]
