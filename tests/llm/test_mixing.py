"""Budgets and prefixes against plain sharing."""

import hashlib
import random
import re

import pytest

from factloom.llm import mixing


def share(budget, children):
    """children: name -> (capacity, weight); shortages go to siblings."""
    given, live = dict.fromkeys(children, 0.0), {k for k, (_, w) in children.items() if w > 0}
    left = budget
    while live:
        rate = left / sum(children[k][1] for k in live)
        short = {k for k in live if children[k][0] <= rate * children[k][1]}
        if not short:
            for k in live:
                given[k] = rate * children[k][1]
            break
        for k in short:
            given[k] = children[k][0]
            left -= children[k][0]
        live -= short
    return given


def plain(rows, weights, part, epochs):
    docs = []
    for i, text, lang, source in rows:
        domain = "" if source is None else "d" + str(int(hashlib.md5(source.encode()).hexdigest()[0], 16) // 4)
        docs.append((i, (domain, lang or "", source or ""), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    tokens = {}
    for _, leaf, n in docs:
        tokens[leaf] = tokens.get(leaf, 0) + n
    budgets = {(): float(int(sum(tokens.values()) * part))}
    for depth, level in enumerate(mixing.LEVELS):
        following = {}
        for node, b in budgets.items():
            names = {leaf[: depth + 1] for leaf in tokens if leaf[:depth] == node}
            children = {k: (float(epochs * sum(n for leaf, n in tokens.items() if leaf[: depth + 1] == k)), weights.get(level, {}).get(k[-1], 1.0)) for k in names}
            following |= share(b, children)
        budgets = following
    out = []
    for leaf, t in tokens.items():
        if not t:
            continue
        quota = int(budgets[leaf] + 1e-9)
        full = min(quota // t, epochs)
        rest = quota - full * t if full < epochs else 0
        keyed = sorted((hashlib.md5(f"mix:{full}:{'' if i is None else i}".encode()).hexdigest(), i, n) for i, w, n in docs if w == leaf)
        for key, i, n in keyed:
            upto = sum(m for k, _, m in keyed if k <= key)
            copies = full + (rest > 0 and upto <= rest)
            if copies:
                out.append((i, leaf[0], n, copies))
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [0.3, 0.9, 2.5])
def test_equals_plain_sharing(spark, part):
    random.seed(6)
    rows = [(i, "w " * random.randint(0, 40), random.choice(["en", "de", "fr"]), "hot" if i % 3 == 0 else f"s{random.randint(0, 9)}") for i in range(400)]
    rows += [(500, None, "en", "s1"), (501, "a b", None, "s2"), (502, "a b", "en", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, lang string, source string, copies_ int")
    got = mixing.mix(df, share=part, max_epochs=3, weights={"lang": {"en": 2.0}, "source": {"s3": 0.0}})
    want = plain(rows, {"lang": {"en": 2.0}, "source": {"s3": 0.0}}, part, 3)
    assert sorted(((r.doc_id, r.mix_domain, r.mix_tokens, r.copies) for r in got.collect()), key=str) == want


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mix(df).count() == 0
    full = spark.createDataFrame([(1, "a b c", "en", "s"), (1, "a b c", "en", "s")], df.schema)
    plan = mixing.mix(full, share=3.0)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("part_rows", [1, 20])
def test_parts_are_parted_until_they_are_small(spark, monkeypatch, part_rows):
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    random.seed(9)
    rows = [(i, "w " * random.randint(0, 9), "en", "hot") for i in range(300)] + [(7, "a b", "en", "hot")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, share=0.4, max_epochs=2, weights={})
    assert sorted(((r.doc_id, r.mix_domain, r.mix_tokens, r.copies) for r in got.collect()), key=str) == plain(rows, {}, 0.4, 2)


def test_names_of_every_kind_pass_through(spark):
    names = ["a.b", "mix_cut", "mix_id", "mix_epochs", "row", "id", "n", "key", "part", "left", "cut", "domain", "epochs", "`x`", "Copies"]
    rows = [(i, "a b c", "en", "s", *range(len(names))) for i in range(6)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    df = spark.createDataFrame(rows, schema)
    got = mixing.mix(df, share=2.5)
    assert got.columns == [*(c for c in df.columns if c != "Copies"), "mix_domain", "mix_tokens", "copies"]
    out = got.collect()
    assert len(out) == 6 and all(tuple(r)[4:-3] == tuple(range(len(names) - 1)) for r in out)


def test_very_long_texts_count_whole(spark):
    rows = [(1, "word " * 400_000, "en", "a"), (2, "x" * 2_000_000, "en", "a"), (3, "w " * 10, "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, share=0.9, max_epochs=2, weights={})
    assert sorted(((r.doc_id, r.mix_domain, r.mix_tokens, r.copies) for r in got.collect()), key=str) == plain(rows, {}, 0.9, 2)
    assert {r.doc_id: r.text for r in got.collect()}.get(3, rows[2][1]) == rows[2][1]


@pytest.mark.parametrize("part", [0.3, 0.9, 2.5])
def test_many_children_are_shared_out_in_ranges(spark, monkeypatch, part):
    monkeypatch.setattr(mixing, "NODE_ROWS", 1)
    random.seed(16)
    rows = [(i, "w " * random.randint(0, 40), random.choice(["en", "de"]), f"s{random.randint(0, 60)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"lang": {"en": 2.0}, "source": {"s3": 0.0, "s4": 4.0}}
    got = mixing.mix(df, share=part, max_epochs=3, weights=weights)
    assert sorted(((r.doc_id, r.mix_domain, r.mix_tokens, r.copies) for r in got.collect()), key=str) == plain(rows, weights, part, 3)
    plan = mixing.mix(df, share=part, weights=weights)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
