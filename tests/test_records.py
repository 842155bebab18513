"""Fact records, nested documents and peeling."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import adapters, adapters_alt, facts, graph


def documents(spark, bodies):
    return spark.createDataFrame([(p, b if isinstance(b, str) else json.dumps(b)) for p, b in bodies.items()], "path string, body string")


def records(df):
    return {(r.category, r.subject_id): json.loads(r.f) for r in df.select("category", "subject_id", F.to_json("fields").alias("f")).collect()}


def test_records_of_the_first_dialect(spark):
    d = "data/minecraft"
    got = records(
        facts.fact_records(
            documents(
                spark,
                {
                    f"{d}/recipe/trim.json": {"type": "minecraft:smithing_trim", "template": "t", "base": {"tag": "b"}, "addition": ["x", "x"]},
                    f"{d}/recipe/odd.json": {"type": "minecraft:other", "ingredient": "x", "result": {"id": "y"}},
                    f"{d}/recipe/none.json": {"type": "minecraft:stonecutting", "ingredient": [], "result": {"id": "y"}},
                    f"{d}/enchantment/e.json": {"max_level": 3, "slots": "any"},
                    f"{d}/enchantment/text.json": {"max_level": "3"},
                    f"{d}/enchantment/half.json": {"max_level": 1.5},
                    f"{d}/jukebox_song/s.json": {"length_in_seconds": 2.5, "sound_event": "s"},
                    f"{d}/jukebox_song/none.json": {"sound_event": "s"},
                    f"{d}/tags/item/t.json": {"values": [{"id": "a"}, "b", "b", 5, {}]},
                    f"{d}/painting_variant/p.json": {"width": 1, "height": "2"},
                    f"{d}/worldgen/structure/w.json": {"type": "minecraft:jigsaw", "biomes": "#minecraft:x"},
                    f"{d}/elsewhere/x.json": "not JSON, but of no category",
                },
            )
        )
    )
    assert got == {
        ("recipe", "minecraft:trim"): {"recipe_type": "smithing_trim", "result_item": "#b", "result_count": 1, "ingredients": ["#b", "t", "x"], "ingredient_groups": [["t"], ["#b"], ["x"]]},
        ("enchantment", "minecraft:e"): {"max_level": 3, "weight": None, "anvil_cost": None, "slots": "any"},
        ("jukebox_song", "minecraft:s"): {"length_in_seconds": 2.5, "comparator_output": None, "sound_event": "s"},
        ("tag", "minecraft:item/t"): {"members": ["a", "b", "b"]},
        ("worldgen_structure", "minecraft:w"): {"structure_type": "jigsaw", "biomes": "#minecraft:x", "step": None},
    }
    with pytest.raises(Exception, match="not JSON"):
        facts.fact_records(documents(spark, {f"{d}/recipe/x.json": "{bad"})).collect()
    assert facts.fact_records(documents(spark, {"a": "{}"}).limit(0)).count() == 0


def test_records_of_the_second_dialect(spark):
    top = "samples/behavior_pack"
    got = records(
        facts.fact_records_alt(
            documents(
                spark,
                {
                    f"{top}/loot_tables/gameplay/fishing.json": {"pools": [{"entries": [{"type": "loot_table", "name": "loot_tables/gameplay/fishing/junk.json"}]}]},
                    f"{top}/loot_tables/gameplay/fishing/junk.json": {"pools": [{"entries": [{"type": "item", "name": "boots"}, {"type": "empty"}]}, {}]},
                    f"{top}/loot_tables/empty.json": {"pools": []},
                    f"{top}/entities/armadillo.json": '{ // gone\n"minecraft:entity": {"description": {"identifier": "i", "is_spawnable": true}}}',
                    f"{top}/entities/bad.json": "{",
                    f"{top}/biomes/b.biome.json": {"minecraft:biome": {"components": {"minecraft:climate": {"downfall": 1}}}},
                    f"{top}/biomes/none.json": {"minecraft:biome": {}},
                },
            )
        )
    )
    assert got == {
        ("loot_table", "minecraft:gameplay/fishing"): {"drops": ["boots"]},
        ("loot_table", "minecraft:gameplay/fishing/junk"): {"drops": ["boots"]},
        ("entity", "minecraft:armadillo"): {"spawn_category": None, "is_spawnable": True, "is_summonable": False},
        ("biome", "minecraft:b"): {"downfall": 1},
    }


def test_depth_200_in_one_job(spark):
    entry, test = {"type": "minecraft:item", "name": "deep"}, {"test": "has_biome_tag", "value": "deep"}
    for k in range(200):
        entry = {"children": [entry, {"type": "minecraft:tag", "name": f"t{k % 3}"}], "type": "minecraft:sequence"}
        test = {"all_of": [test]} if k % 2 else [{"any_of": test}, {"none_of": {"test": "has_biome_tag", "value": "not"}}]
    loot = {"pools": [{"entries": [entry]}]}
    rule = {"minecraft:spawn_rules": {"conditions": [{"minecraft:biome_filter": test}]}}
    docs = spark.createDataFrame([("a", json.dumps(loot)), ("b", json.dumps(rule)), ("c", "{bad"), ("d", None), ("e", '[{"pools": 1}]')], "id string, body string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "deep")
    assert [tuple(r) for r in adapters.loot_drops(docs).collect()] == [("a", ["#t0", "#t1", "#t2", "deep"])]
    assert [tuple(r) for r in adapters_alt.spawn_rules(docs).collect()] == [("b", ["deep"])]
    assert len(tracker.getJobIdsForGroup("deep")) == 2
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def plain_depths(recipes, tags):
    need, members = {}, {}
    for item, ingredient in recipes:
        need.setdefault(item, set()).add(ingredient)
    for tag, member in tags:
        members.setdefault(tag, set()).add(member)
    names = {i for s in need.values() for i in s} | {m for s in members.values() for m in s}
    depth = {n: 0 for n in names if not n.startswith("#") and n not in need}

    def of(ingredient):
        if ingredient in members:
            return min(depth[m] for m in members[ingredient]) if all(m in depth for m in members[ingredient]) else None
        return depth.get(ingredient)

    while True:
        new = {}
        for item, parts in need.items():
            live = [p for p in parts if p in members or not p.startswith("#")]
            if item not in depth and all(of(p) is not None for p in live):
                new[item] = 1 + max((of(p) for p in live), default=0)
        if not new:
            return depth | {i: None for i in need if i not in depth}
        depth |= new


def plain_levels(recipes, raw, tags):
    level = dict.fromkeys(raw, 0)
    for now in range(1, 10_000):
        hand = set(level) | {t for t, m in tags if m in level}
        parts = {}
        for recipe, item, ingredient in recipes:
            parts.setdefault((recipe, item), set()).add(ingredient)
        new = {item for (_, item), p in parts.items() if p <= hand and item not in level}
        if not new:
            return level
        level |= dict.fromkeys(new, now)


@pytest.mark.parametrize("local", [0, 40, 100_000])
def test_peeling_equals_plain_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(local)
    names = [f"n{k}" for k in range(40)]
    recipes = [(names[k], rng.choice(names[max(0, k - 9) : k] if rng.random() < 0.97 else names)) for k in range(6, 40) for _ in range(2)]
    recipes += [(names[k], f"#g{k % 4}") for k in range(20, 40, 5)] + [("lone", "#unknown"), ("loop", "loop")]
    tags = [(f"#g{g}", names[rng.randrange(4 + 6 * g)]) for g in range(3) for _ in range(3)]
    r = spark.createDataFrame(recipes, "item string, ingredient string")
    t = spark.createDataFrame(tags, "tag string, member string")
    assert dict(map(tuple, graph.depths(r, t).collect())) == plain_depths(recipes, tags)
    ways = [(f"{item}/{k % 2}", item, ingredient) for k, (item, ingredient) in enumerate(recipes)]
    raw = names[:6]
    got = graph.reachable(spark.createDataFrame(ways, "recipe string, item string, ingredient string"), spark.createDataFrame([(x,) for x in raw], "item string"), t)
    assert dict(map(tuple, got.collect())) == plain_levels(ways, raw, tags)


def test_a_long_chain_beside_many_shallow_items(spark):
    """1,000 levels: what is left open after the first round is finished in one task."""
    chain = spark.range(1, 1001).select(F.format_string("c%d", "id").alias("item"), F.format_string("c%d", F.col("id") - 1).alias("ingredient"))
    wide = spark.range(150_000).select(F.format_string("w%d", "id").alias("item"), F.format_string("r%d", F.col("id") % 100).alias("ingredient"))
    found = graph.depths(chain.unionByName(wide), spark.createDataFrame([], "tag string, member string"))
    assert found.where("item like 'c%'").agg(F.max("depth"), F.count("*")).first()[:] == (1000, 1001)
    assert found.where("item like 'w%'").agg(F.min("depth"), F.max("depth"), F.count("*")).first()[:] == (1, 1, 150_000)
