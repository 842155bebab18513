"""Literal fixtures: lookups, slots, closures, depths, documents, gates and scores."""

import json
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.functions import calls, names
from factloom.operators import adapters, adapters_alt, evaluation, gates, graph, lookup, runs, traces
from factloom.plans.registry import QUERIES
from factloom.sources import reports, sinks


def column(spark, value, make):
    return spark.range(1).select(make(F.lit(value)).alias("x")).first().x


def test_slots_of_the_method_named_like_the_result(spark):
    rows = [("torch", "torch", 0, "coal"), ("torch", "torch", 0, "charcoal"), ("torch", "torch", 1, "stick"), ("torch", "alt", 0, "lava")]
    df = spark.createDataFrame(rows, "result_item string, method string, slot int, ingredient string")
    assert evaluation.slot_groups(df, "result_item", "method", "slot", "ingredient").first().slots == "charcoal/coal, stick"


def test_reverse_lookup_hides_the_own_source(spark):
    rows = [("minecraft:blocks/oak_log", "minecraft:oak_log"), ("minecraft:entities/pig", "minecraft:oak_log"), ("minecraft:chests/x", "minecraft:oak_log")]
    df = spark.createDataFrame(rows, "source string, item string")
    assert [r.source for r in lookup.reverse_sources(df, "source", "item", ("blocks", "entities")).collect()] == ["minecraft:entities/pig"]


def test_closure_of_a_cycle_is_full_for_all(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "tag string, ref string")
    members = spark.createDataFrame([("a", "x"), ("b", "y")], "tag string, member string")
    got = {tuple(r) for r in graph.closure(edges, members).collect()}
    assert got == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}
    again = graph.closure(edges, spark.createDataFrame(sorted(got), "tag string, member string"))
    assert {tuple(r) for r in again.collect()} == got


def test_depths_take_the_shallowest_member_of_a_tag(spark):
    recipes = [("plank", "log"), ("stick", "plank"), ("torch", "stick"), ("torch", "#coals"), ("loop", "loop2"), ("loop2", "loop"), ("odd", "#none"), ("odd", "plank")]
    tags = [("#coals", "coal"), ("#coals", "torch2"), ("#coals", "plank")]
    got = graph.depths(
        spark.createDataFrame(recipes, "item string, ingredient string"), spark.createDataFrame(tags, "tag string, member string")
    )
    assert {r.item: r.depth for r in got.collect()} == {
        "log": 0, "coal": 0, "torch2": 0, "plank": 1, "stick": 2, "torch": 3, "odd": 2, "loop": None, "loop2": None,
    }


def test_reachable_needs_every_ingredient(spark):
    recipes = [(1, "a", "r"), (2, "b", "a"), (2, "b", "s"), (3, "c", "b"), (3, "c", "nowhere")]
    got = graph.reachable(spark.createDataFrame(recipes, "recipe int, item string, ingredient string"), spark.createDataFrame([("r",), ("s",)], "item string"))
    assert {r["item"]: r.level for r in got.collect()} == {"r": 0, "s": 0, "a": 1, "b": 2}


def test_rows_pass_the_registry_unsorted(spark, small):
    rows = [(1, "item", "carrot"), (2, "block", "carrot"), (3, "block", "both"), (4, "item", "both"), (5, "item", "corn"), (6, None, "carrot"), (7, "item", None), (1, "item", "carrot")]
    registry = spark.createDataFrame([("item", "carrot"), ("item", "carrot"), ("item", "both"), ("block", "both"), (None, "corn"), ("item", None)], "registry string, id string")
    got = lookup.placed(spark.createDataFrame(rows, "k int, registry string, id string"), registry).select("k", "anywhere", "there")
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, True, True), (1, True, True), (2, True, False), (3, True, True), (4, True, True), (5, True, False), (6, True, False), (7, False, False),
    ]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["registry_scope"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan and "BuildRight" in plan


@pytest.mark.parametrize(
    ("items", "text"), [(["a"], "a"), (["a", "b"], "a, or b"), (["a", "b", "c"], "a, b, or c"), ([], "")]
)
def test_or_list(spark, items, text):
    made = F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")
    assert spark.range(1).select(names.or_list(made).alias("x")).first().x == text


def test_numbers_render_without_trailing_zeros(spark):
    got = spark.sql("SELECT 2.40 AS a, 5.00 AS b, 0.125 AS c").select(*(names.number_text(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(got) == ("2.4", "5", "0.12")


@pytest.mark.parametrize(
    ("text", "n"), [("5 ticks (0.25 seconds)", 0), ("5 ticks (0.5 seconds)", 1), ("1200 ticks (1 minute)", 0), ("no ticks", 0)]
)
def test_ticks(spark, text, n):
    assert column(spark, text, calls.tick_errors) == n


def test_strict_calls(spark):
    good = "<think>a</think>\n<tool_call>lookup(recipe, result_item='piston')</tool_call>"
    bad = [
        "<tool_call>lookup(recipe, item='piston')</tool_call>",
        "say " + good,
        good + good,
        "lookup(recipe, result_item='piston')",
        "<tool_call>lookup(other, item='x')</tool_call>",
    ]
    assert tuple(column(spark, good, calls.parse_strict)) == ("recipe", "piston")
    assert [column(spark, b, calls.parse_strict) for b in bad] == [None] * 5


def test_refusals(spark):
    assert column(spark, "The fact does not provide any information about it.", calls.refused)
    assert not column(spark, "Walls do not provide benefits.", calls.refused)


def test_json_prefix(spark):
    assert column(spark, '{"a": {"b": "}"}} tail }', calls.json_prefix) == '{"a": {"b": "}"}}'
    for bad in ("none", '["a"] {}', '{"a": 1', '{"a": }', "{a: 1}", '{"a": 1 "b": 2}', "} {}", '{"a": "}', ""):
        assert column(spark, bad, calls.json_prefix) is None, bad
    assert column(spark, ' \n{"a": 1, "a": [{}]}]', calls.json_prefix) == '{"a": 1, "a": [{}]}'


def test_json_comments(spark):
    text = '{"a": "x // y", // gone\n "///": 1}'
    assert json.loads(column(spark, text, reports.without_comments)) == {"a": "x // y", "///": 1}


def test_long_json_strings(spark):
    long = "\\\\" * 1_000_000 + '\\"' * 1_000_000 + "// { é" * 1_000_000
    whole = f'{{"a": "{long}"}}'
    assert column(spark, whole + "} tail", calls.json_prefix) == whole
    assert column(spark, whole + " // gone", reports.without_comments) == whole + " "
    open_ = '{"a": "' + '\\" ' * 500_000
    assert column(spark, open_, calls.json_prefix) is None
    assert column(spark, open_, reports.without_comments) == open_


def test_level_claims(spark):
    facts = spark.createDataFrame([("sharpness", 5), ("Protection", 4), ("bane of Arthropods", 5), ("none", None)], "name string, max_level int")
    cases = {
        "Sharpness goes up to level 5": 0,
        "Protection has a maximum level of 4": 0,
        "Sharpness caps at level 6": 1,
        "Bogus goes up to level 9": 0,
        "Sharpness has a maximum level of 6": 1,
        "Sharpness goes up to level 4": 1,
        "Sharpness 6": 0,
        "Sharpness caps at level 6. PROTECTION has a max level of 9, sharpness a cap": 2,
        "Bane of Arthropods caps at level 99999999999999999999999999": 1,
        "Sharpness is good. It goes up to level 9": 0,
        "None caps at level 3": 0,
    }
    texts = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    got = [r.k for r in calls.level_errors(texts, "k", "text", facts).collect()]
    assert [got.count(k) for k in range(len(cases))] == list(cases.values())


def test_guarded_calls(spark):
    def guarded(*calls_):
        rows = [("g", i, tool, f"{tool}({arg})", failed) for i, (tool, arg, failed) in enumerate(calls_)]
        rows.append(("h", 0, *("craft", "craft(a)"), False))  # another trajectory
        df = spark.createDataFrame(rows, "g string, i int, tool string, call string, failed boolean")
        out = runs.guarded_calls(df, "g", ["i"], F.col("tool"), F.col("call"), F.col("failed"))
        return [r.guarded for r in out.where("g = 'g'").orderBy("i").collect()]

    fail, fine = True, False
    assert guarded(("craft", "a", fail), ("craft", "b", fine), ("craft", "a", fine)) == [False, False, False]  # recovery
    assert guarded(("goto", "x", fail), ("craft", "b", fine), ("goto", "x", fail)) == [False, False, True]  # an unrelated craft
    # a repeat of a repeat, whose recorded success clears nothing
    assert guarded(("craft", "a", fail), ("craft", "a", fine), ("craft", "a", fail), ("craft", "b", fine), ("craft", "a", fail)) == [False, True, True, False, False]
    assert guarded(("craft", "a", None), ("craft", "a", fail), ("goto", "a", fine), ("craft", "a", fine)) == [False, False, False, True]


def test_report_tree(spark, tmp_path):
    bodies = {
        "data/minecraft/recipe/piston.json": '{"type": "minecraft:crafting_shaped", "pattern": [], "key": {"z": {"item": "b"}, "a": ["c", {"tag": "t"}]}, "result": {"id": "piston", "count": 2}}',
        "data/minecraft/recipe/cut.json": '{"type": "minecraft:smithing_trim", "template": "t", "base": {"tag": "base"}, "addition": "x"}',
        "data/minecraft/datapacks/p/data/minecraft/recipe/z.json": '{"type": "minecraft:stonecutting", "ingredient": "x", "result": {"id": "y"}}',
        "data/minecraft/worldgen/structure/fort.json": '{"type": "minecraft:jigsaw", "biomes": "#x", "step": "s"}',
    }
    for path, body in bodies.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    docs = reports.strict(reports.documents(spark, str(tmp_path)))
    assert {(r.category, r.id) for r in docs.collect()} >= {("recipe", "minecraft:piston"), ("worldgen_structure", "minecraft:fort")}
    assert docs.where("category is null").count() == 1
    made = {r.id: r for r in adapters.recipes(docs.where("category = 'recipe'")).collect()}
    piston = made["minecraft:piston"]
    assert (piston.result_item, piston.result_count, piston.groups) == ("piston", 2, [["b"], ["#t", "c"]])
    assert made["minecraft:cut"].result_item == "#base"
    counts = sinks.write_tables({"recipe": adapters.recipes(docs.where("category = 'recipe'"))}, str(tmp_path / "out"))
    assert {r.tbl: r.n for r in counts.collect()} == {"recipe": 2}


def test_line_files_and_evidence(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('// note\n\n{"k": 1}\n{"k": 2}\n')
    assert [r.k for r in reports.json_lines(spark, str(tmp_path / "a.jsonl"), "k int", comments=True).collect()] == [1, 2]
    sinks.write_evidence({"b": 1}, str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"b": 1}
    sinks.write_lines(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_first_failing_gate_decides(spark):
    v = gates.layered_fact_check(F.lit("no information"), F.lit(1), F.lit("x"), F.lit("x"))
    assert spark.range(1).select(v.alias("v")).first().v.failure_kind == "registry"
    v = gates.layered_fact_check(F.lit("good answer"), F.lit(0), F.lit("x"), F.lit("x"))
    assert spark.range(1).select(v.alias("v")).first().v.success


@pytest.mark.parametrize(("b", "c", "p"), [(23, 0, 2.384185791015625e-07), (2, 0, 0.5), (0, 0, 1.0), (3, 1, 0.625), (5, 5, 1.0)])
def test_mcnemar(spark, b, c, p):
    pairs = [(1, 0)] * b + [(0, 1)] * c + [(1, 1)]
    got = evaluation.mcnemar(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert (got.b, got.c) == (b, c) and got.p == pytest.approx(p, rel=1e-9)


def test_running_ratio(spark):
    rows = spark.createDataFrame([("x", i, 2) for i in range(5)], "g string, i int, n long")
    got = [2 - r.first_lane for r in runs.running_ratio(rows, "g", "i", "n", 0.8).orderBy("i").collect()]
    assert got == [0, 1, 0, 1, 0]


def test_no_group_is_on_both_sides(spark):
    rows = spark.createDataFrame([(i, f"k{i % 37}") for i in range(500)], "i int, k string")
    got = runs.group_split(rows, F.col("k"), "s", 0.1)
    sides = got.groupBy("k").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert sides == 1 and got.where("split = 'valid'").select("k").distinct().count() == 3 and got.count() == 500


def test_scorer(spark):
    def passes(category, kind, answer, expected, key="x"):
        made = traces.score(F.lit(category), F.lit(kind), F.lit(answer), F.array(*map(F.lit, expected)), F.lit(key))
        return spark.range(1).select(made.alias("x")).first().x

    assert passes("other", "unknown", "There is no data on it", ["a"])
    assert not passes("other", "known", "There is no data on it", ["it"])
    assert not passes("other", "known", "shears", ["shear"])
    assert passes("recipe", "known", "You craft piston from planks", ["planks"], "piston")


def test_second_dialect(spark):
    rule = {"minecraft:spawn_rules": {"conditions": [{"minecraft:biome_filter": {"any_of": [{"test": "has_biome_tag", "value": "a"}, {"none_of": [{"test": "has_biome_tag", "value": "z"}]}, {"test": "has_biome_tag", "operator": "!=", "value": "q"}]}}]}}
    docs = spark.createDataFrame([("r", json.dumps(rule))], "id string, body string")
    assert adapters_alt.spawn_rules(docs).first().biome_tags == ["a"]
    loot = [("x", {"pools": [{"entries": [{"type": "item", "name": "i"}, {"type": "loot_table", "name": "y"}]}]}), ("y", {"pools": [{"entries": [{"type": "item", "name": "j"}, {"type": "loot_table", "name": "x"}]}]})]
    docs = spark.createDataFrame([(k, json.dumps(v)) for k, v in loot], "id string, body string")
    assert {r.id: r.drops for r in adapters_alt.loot_drops(docs).collect()} == {"x": ["i", "j"], "y": ["i", "j"]}


def test_streaming_breaker(spark, tmp_path):
    from factloom.streaming.breaker import breaker

    rows = [("a", i, i in (2, 3, 4, 8)) for i in range(10)] + [("b", i, i % 2 == 0) for i in range(10)]
    spark.createDataFrame(rows, "key string, seq long, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, failed boolean").parquet(str(tmp_path / "in"))
    q = breaker(stream).writeStream.format("memory").queryName("opened").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("opened").collect()] == [("a", 4)]


REPORT = {
    "data/minecraft/tags/item/wolf_food.json": {"values": ["#minecraft:meat", {"id": "minecraft:salmon", "required": False}]},
    "data/minecraft/tags/item/meat.json": {"values": ["minecraft:beef", "#minecraft:wolf_food"]},
    "data/minecraft/tags/block/x.json": {"values": ["minecraft:stone"]},
    "data/minecraft/recipe/piston.json": {"type": "minecraft:crafting_shaped", "key": {"z": "minecraft:stick", "a": "minecraft:iron"}, "result": {"id": "minecraft:piston"}},
    "data/minecraft/recipe/stick.json": {"type": "minecraft:crafting_shapeless", "ingredients": ["minecraft:plank", ["minecraft:plank", "#minecraft:logs"]], "result": {"id": "minecraft:stick", "count": 4}},
    "data/minecraft/enchantment/sharpness.json": {"max_level": 5, "slots": ["hand"]},
    "data/minecraft/loot_table/blocks/stone.json": {"pools": [{"entries": [{"type": "minecraft:item", "name": "minecraft:cobble"}]}]},
    "data/minecraft/jukebox_song/13.json": {"length_in_seconds": 178.0, "sound_event": "s"},
    "data/minecraft/dimension_type/overworld.json": {"min_y": -64, "height": 384},
    "data/minecraft/worldgen/configured_feature/ore_iron.json": {"type": "minecraft:ore", "config": {"targets": [{"state": {"Name": "minecraft:iron_ore"}}, {"state": {"Name": "minecraft:deep_iron_ore"}}]}},
    "data/minecraft/worldgen/placed_feature/ore_iron_low.json": {"feature": "minecraft:ore_iron", "placement": [{"type": "minecraft:count", "count": {"type": "minecraft:uniform", "min_inclusive": 1, "max_inclusive": 4}}, {"type": "minecraft:height_range", "height": {"type": "minecraft:trapezoid", "min_inclusive": {"above_bottom": -10}, "max_inclusive": {"absolute": 72}}}]},
}


def test_whole_build(spark, tmp_path):
    from factloom.plans import oracle

    for path, body in REPORT.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(json.dumps(body))
    tables = oracle.build_oracle(spark, str(tmp_path))
    got = {name: sorted(tuple(r) for r in df.collect()) for name, df in tables.items()}
    assert len(got) == 11
    assert got["breeding_food"] == [("wolf", "minecraft:beef"), ("wolf", "minecraft:salmon")]
    assert ("minecraft:meat", "minecraft:salmon") in got["tag"] and not any(m.startswith("#") for _, m in got["tag"])
    assert got["recipe_slot"] == [
        ("minecraft:piston", "minecraft:piston", 0, "minecraft:stick"),
        ("minecraft:piston", "minecraft:piston", 1, "minecraft:iron"),
        ("minecraft:stick", "minecraft:stick", 0, "minecraft:plank"),
        ("minecraft:stick", "minecraft:stick", 1, "#minecraft:logs"),
        ("minecraft:stick", "minecraft:stick", 1, "minecraft:plank"),
    ]
    assert got["recipe"] == [("minecraft:piston", "minecraft:iron"), ("minecraft:piston", "minecraft:stick"), ("minecraft:stick", "#minecraft:logs"), ("minecraft:stick", "minecraft:plank")]
    assert got["ore_depth"] == [(b, "minecraft:ore_iron_low", "trapezoid", -64, 72, 2) for b in ("minecraft:deep_iron_ore", "minecraft:iron_ore")]
    assert got["enchantment"] == [("minecraft:sharpness", 5, ["hand"])] and got["jukebox_song"] == [("minecraft:13", 178.0)]
    truth = oracle.truth_view(tables)
    hops = oracle.multihop_traces(tables["recipe"], truth)
    assert oracle.training_set([hops], truth).count() == 1
    tampered = hops.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.replace(m["content"], F.lit("minecraft:iron"), F.lit("x")).alias("content"))))
    with pytest.raises(ValueError, match="verify"):
        oracle.training_set([tampered], truth)


def test_deep_entries_and_filters_are_followed_to_the_end(spark):
    entry, rule = {"type": "minecraft:item", "name": "i:deep"}, {"test": "has_biome_tag", "value": "deep"}
    for i in range(11):
        entry = {"type": "minecraft:group", "children": [{"type": "minecraft:item", "name": f"i:{i:02}"}, entry]}
        rule = {"any_of" if i % 2 else "all_of": [{"test": "has_biome_tag", "value": f"{i:02}"}, rule]}
    bodies = {"pools": [{"entries": [entry]}]}, {"minecraft:spawn_rules": {"conditions": [{"minecraft:biome_filter": rule}]}}
    docs = [spark.createDataFrame([("x", json.dumps(b))], "id string, body string") for b in bodies]
    numbers = [f"{i:02}" for i in range(11)]
    assert adapters.loot_drops(docs[0]).first().drops == [*(f"i:{n}" for n in numbers), "i:deep"]
    assert adapters_alt.spawn_rules(docs[1]).first().biome_tags == [*numbers, "deep"]


def test_long_chains_have_depths_and_levels(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 3)
    chain = spark.createDataFrame([(f"{i:02}", f"{i - 1:02}") for i in range(1, 7)], "item string, ingredient string")
    want = {f"{i:02}": i for i in range(7)}
    assert {r["item"]: r.depth for r in graph.depths(chain, spark.createDataFrame([], "tag string, member string")).collect()} == want
    got = graph.reachable(chain.withColumn("recipe", F.col("item")), spark.createDataFrame([("00",)], "item string"))
    assert {r["item"]: r.level for r in got.collect()} == want


def test_paired_arms_and_placements_are_taken_whole(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    b, c = (sum((r.quality, r.toxic) == kind for r in labels) for kind in ((1, 1), (0, 0)))
    p = min(Fraction(1), Fraction(2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))
    got = QUERIES["mcnemar_whole"](spark, small).first()
    assert (got.b, got.c) == (b, c) and got.p == pytest.approx(float(p), abs=2e-9)
    customers = {r.c_custkey for r in spark.read.parquet(f"{small}/customer.parquet").collect()}
    lines = {r.l_orderkey for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{small}/orders.parquet").collect() if r.o_orderkey in lines and r.o_custkey in customers}
    assert sorted(r.placement for r in QUERIES["placement_join_whole"](spark, small).collect()) == sorted(2 * list(orders))


def test_closures_are_of_all_parts(spark, tmp_path):
    rows = [(i, f"b{i}", i % 50) for i in range(1, 451)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))

    def below(refs):
        for i in refs:
            seen, todo = {i}, [i]
            while todo:
                new = refs.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            yield i, seen

    tags = {i: {i // 2} - {0} for i, _, _ in rows}
    tags[7], tags[1] = {3, 30}, {5}
    want = {(i, f"b{j}") for i, seen in below(tags) for j in seen}
    assert {tuple(r) for r in QUERIES["tag_closure_whole"](spark, str(tmp_path)).collect()} == want
    loot = {i: {i // 3} - {0} for i, _, _ in rows}
    loot[1], loot[2] = {7}, set()
    want = {(f"minecraft:p{i}", ",".join(sorted({f"i{j % 50}" for j in seen}))) for i, seen in below(loot)}
    assert {tuple(r) for r in QUERIES["loot_reference_whole"](spark, str(tmp_path)).collect()} == want
