"""Report trees as a source and a sink, the field diff, closed runs, balanced use and questions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators import gates, runs, tasks, topics
from factloom.sources import reports, tree

PATHS = {
    "data/minecraft/recipe/a.json": "recipe",
    "data/minecraft/tags/item/recipe/b.json": "recipe",  # the earlier part decides
    "data/minecraft/tags/item/c.json": "tag",
    "data/minecraft/enchantment/d.json": "enchantment",
    "data/minecraft/datapacks/x/data/minecraft/recipe/e.json": None,
    "other/f.json": None,
}


def test_trees_are_written_whole_and_read_by_category(spark, tmp_path):
    root = str(tmp_path / "tree")
    docs = spark.createDataFrame([(p, json.dumps({"p": p})) for p in PATHS] + [("other/é.json", None)], "path string, body string").repartition(3)
    tree.write_tree(docs, root)
    got = {r.path: r for r in tree.read_tree(spark, root).collect()}
    assert {p: r.category for p, r in got.items()} == {**PATHS, "other/é.json": None}
    assert all(json.loads(r.body)["p"] == p for p, r in got.items() if r.body)
    assert {r.path for r in tree.read_tree(spark, root).where("category = 'recipe'").collect()} == {p for p, c in PATHS.items() if c == "recipe"}
    assert {r.path for r in tree.read_tree(spark, root).where("category in ('tag', 'enchantment') and category <> 'tag'").collect()} == {"data/minecraft/enchantment/d.json"}
    assert {(r.path, r.body) for r in reports.documents(spark, root).collect()} == {(p, r.body) for p, r in got.items() if r.body}
    with pytest.raises(Exception, match="there is a tree"):
        tree.write_tree(docs, root)
    tree.write_tree(docs.where("path like 'other/f%'"), root, overwrite=True)
    assert [r.path for r in tree.read_tree(spark, root).collect()] == ["other/f.json"]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["tree"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    for bad in ("../out.json", "/abs.json", None):
        docs = spark.createDataFrame([("a.json", "{}"), (bad, "{}")], "path string, body string").coalesce(1)
        with pytest.raises(Exception, match="not a path below"):
            tree.write_tree(docs, str(tmp_path / "tree"))
    assert list(tmp_path.iterdir()) == []


def test_folders_of_other_categories_are_not_walked(tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("{}")
    reader = tree.TreeReader({"path": str(tmp_path)})
    reader.wanted = {"recipe"}
    assert reader._may_hold("data/minecraft/tags/") and reader._may_hold("data/minecraft/recipe/x/")
    reader.wanted = {"enchantment"}
    assert not reader._may_hold("data/minecraft/recipe/") and not reader._may_hold("data/minecraft/datapacks/x/")
    assert [p.paths for p in reader.partitions()] == [["data/minecraft/enchantment/d.json"]]


FIELDS = {"result_item": "minecraft:piston", "ingredients": ["a", "b", "b"], "n": 2, "none": None, "o": {"k": [1]}}


@pytest.mark.parametrize(
    "candidate,kind",
    [
        ({"answer": "x y", "structured_claim": {**FIELDS, "ingredients": ["b", "a", "b"], "n": 2.0, "more": 1}}, None),
        ({"answer": "x y", "structured_claim": {k: v for k, v in FIELDS.items() if k != "none"}}, None),
        ({"answer": "x y", "structured_claim": {**FIELDS, "ingredients": ["a", "b"]}}, "fact_mismatch"),
        ({"answer": "x y", "structured_claim": {**FIELDS, "ingredients": [{"item": "a"}, "b", "b"]}}, "fact_mismatch"),
        ({"answer": "x y", "structured_claim": {**FIELDS, "ingredients": "a"}}, "fact_mismatch"),
        ({"answer": "x y", "structured_claim": {**FIELDS, "n": "2"}}, "fact_mismatch"),
        ({"answer": "x y", "structured_claim": {**FIELDS, "o": {"k": [2]}}}, "fact_mismatch"),
        ({"answer": "x y", "structured_claim": [1]}, "malformed_claim"),
        ({"answer": "x y"}, "malformed_claim"),
        ({"structured_claim": FIELDS}, "malformed_answer"),
        ({"answer": ["a"], "structured_claim": FIELDS}, "malformed_answer"),
        ({"answer": "  ", "structured_claim": FIELDS}, "malformed_answer"),
        ({"answer": "There is no information on it.", "structured_claim": FIELDS}, "refusal_answer"),
    ],
)
def test_every_field_is_compared(spark, candidate, kind):
    df = spark.createDataFrame([(json.dumps(candidate), json.dumps(FIELDS))], "c string, f string").select(F.parse_json("c").alias("c"), F.parse_json("f").alias("f"))
    v = df.select(gates.fact_check(F.col("c"), F.col("f")).alias("v")).first().v
    assert (v.success, v.failure_kind) == (kind is None, kind) and bool(v.errors) == (kind is not None)


def plain_run(first, second, target, ratio, most, empty):
    """The batches of one run, made one after the other."""
    a = b = total = misses = 0
    out = []
    while True:
        size = min(max(target - total, 1), most)
        got, made = [], 0
        for k in range(size):  # in the order that the share gives
            take = round((a + b + 1) * ratio) > a
            pool, at = (first, a) if take else (second, b)
            if at >= len(pool):
                break
            got.append(pool[at])
            a, b, made = a + take, b + (not take), made + 1
        if not made:
            return out
        total += sum(got)
        misses = 0 if sum(got) else misses + 1
        state = "exhausted" if made < size else "complete" if total >= target else "aborted" if misses >= empty else "running"
        out.append((made, sum(got), total, state))
        if state != "running":
            return out


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.8, 1.0])
def test_closed_runs_equal_batches_in_a_row(spark, ratio):
    rng = random.Random(int(ratio * 10))
    lanes = {r: ([rng.random() < p for _ in range(n)], [rng.random() < p for _ in range(m)]) for r, (p, n, m) in enumerate([(0.5, 60, 60), (0.0, 50, 50), (0.9, 5, 3), (0.2, 80, 80), (1.0, 0, 40)])}
    rows = [(r, lane, k, ok) for r, pair in lanes.items() for lane, oks in zip(("fact_seeded", "free_recall"), pair, strict=True) for k, ok in enumerate(oks)]
    df = spark.createDataFrame(rows, "run int, lane string, pos long, success boolean").repartition(4)
    ended, admitted = tasks.closed_run(df, "run", 12, ratio, 5, 3)
    got = {}
    for r in ended.orderBy("run", "batch").collect():
        got.setdefault(r.run, []).append((r.size, r.admitted, r.total, r.state))
    want = {r: plain_run(*pair, 12, ratio, 5, 3) for r, pair in lanes.items()}
    want = {r: [*w[:-1], (*w[-1][:3], "exhausted" if w[-1][3] == "running" else w[-1][3])] for r, w in want.items() if w}
    assert got == want
    assert Counter(r.run for r in admitted.collect()) == Counter({r: w[-1][2] for r, w in want.items() if w[-1][2]})


def test_use_is_balanced_and_nobody_is_left_out(spark):
    rng = random.Random(4)
    pairs = [(i, rng.choice([0, 0, 0, *range(12)])) for i in range(120) for _ in range(rng.randint(1, 4))] + [(None, 1), (1, None)]
    got = [tuple(r) for r in runs.balanced_use(spark.createDataFrame(pairs, "item int, part int"), "item", "part", 6).collect()]
    used = Counter(p for _, p in got)
    assert len({i for i, _ in got}) == len(got) and set(got) <= set(pairs) and max(used.values()) <= 6
    assert all(used[p] == 6 for i, p in pairs if i is not None and p is not None and i not in dict(got))
    assert runs.balanced_use(spark.createDataFrame([], "item int, part int"), "item", "part", 6).count() == 0


def test_no_member_is_offered_as_none(spark):
    rng = random.Random(9)
    tags = [(f"t{t}", f"i{rng.randrange(25)}") for t in range(40) for _ in range(rng.randint(1, 40))] + [("whole", f"i{k}") for k in range(25)]
    members = spark.createDataFrame(tags, "tag string, member string").distinct()
    got = dict(map(tuple, topics.non_members(members, "s").collect()))
    held = {}
    for t, m in tags:
        held.setdefault(t, set()).add(m)
    pool = {m for _, m in tags}
    assert set(got) == {t for t, s in held.items() if s != pool} and "whole" not in got
    assert all(m in pool and m not in held[t] for t, m in got.items())
    assert topics.non_members(members.limit(0), "s").count() == 0
