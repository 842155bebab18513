"""Document adapters on JSON made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import adapters, adapters_alt
from factloom.plans.base import query, spread, table
from factloom.sources import reports
from factloom.sources.scratch import written


def _docs(spark, sf, expression: str):
    """Documents with ids and bodies from the parts."""
    part = spread(table(spark, sf, "part"), "p_partkey")
    # written, because adapters name the body many times and each would make it anew
    return written(part.selectExpr("concat('minecraft:p', p_partkey) AS id", f"{expression} AS body", "p_partkey", "p_size"), "documents")


@query("""
SELECT 'minecraft:p' || p_partkey AS method, 'minecraft:r' || p_size AS result_item, CAST(s AS INTEGER) AS slot, i AS ingredient FROM (
  SELECT p_partkey, p_size, 0 AS s, unnest(['#t:x', 'a:' || p_size]) AS i FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_size, 1, 'a:b' FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, p_size, 0, 'c:d' FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey, p_size, 1, 'e:f' FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey, p_size, 0, 'g:h' FROM part WHERE p_partkey % 4 = 2)
""")
def adapter_recipe(spark, sf):
    """Shaped (object and list slots), shapeless, single; an unknown type gives nothing."""
    result = """'"result": {"id": "minecraft:r', p_size, '"}}'"""
    body = f"""CASE p_partkey % 4
      WHEN 0 THEN concat('{{"type": "minecraft:crafting_shaped", "key": {{"z": [{{"item": "a:', p_size, '"}}, {{"tag": "t:x"}}, "a:', p_size, '"], "a": "a:b"}}, ', {result})
      WHEN 1 THEN concat('{{"type": "minecraft:crafting_shapeless", "ingredients": ["c:d", {{}}, {{"item": "e:f"}}], ', {result})
      WHEN 2 THEN concat('{{"type": "minecraft:stonecutting", "ingredient": "g:h", ', {result})
      ELSE concat('{{"type": "other:kind", "ingredient": "g:h", ', {result}) END"""
    return adapters.recipe_slots(adapters.recipes(_docs(spark, sf, body)))


@query("""
SELECT 'minecraft:p' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '#t:' || p_size || ',i:a,i:b' ELSE 'i:' || p_size END AS drops FROM part
""")
def adapter_loot(spark, sf):
    body = """if(p_partkey % 2 = 0,
      concat('{"pools": [{"entries": [{"type": "minecraft:item", "name": "i:b"}, {"type": "minecraft:alternatives", "children": [{"type": "minecraft:tag", "name": "t:', p_size, '"}, {"type": "minecraft:group", "children": [{"type": "minecraft:item", "name": "i:a"}]}]}]}]}'),
      concat('{"pools": [{"entries": [{"type": "minecraft:item", "name": "i:', p_size, '"}, {"type": "minecraft:empty"}]}, {}]}'))"""
    return adapters.loot_drops(_docs(spark, sf, body)).select("id", F.array_join("drops", ",").alias("drops"))


@query("""
SELECT 'minecraft:p' || p_partkey AS tag, 'm:' || p_size AS value, CAST(0 AS INTEGER) AS pos FROM part UNION ALL SELECT 'minecraft:p' || p_partkey, '#m:a', 1 FROM part
""")
def adapter_tag(spark, sf):
    return adapters.tags(_docs(spark, sf, """concat('{"values": ["m:', p_size, '", {"id": "#m:a", "required": false}]}')"""))


@query("""
SELECT 'minecraft:p' || p_partkey AS id, p_size AS max_level, CAST(p_partkey % 10 AS INTEGER) AS weight, CASE WHEN p_partkey % 2 = 0 THEN 'chest,feet' ELSE 'any' END AS slots
FROM part WHERE p_partkey % 5 <> 0
""")
def adapter_enchantment(spark, sf):
    body = """concat('{"max_level": ', if(p_partkey % 5 = 0, '"x"', string(p_size)), ', "weight": ', p_partkey % 10, ', "slots": ', if(p_partkey % 2 = 0, '["feet", "chest"]', '"any"'), '}')"""
    return adapters.enchantments(_docs(spark, sf, body)).select("id", "max_level", "weight", F.array_join("slots", ",").alias("slots"))


@query("""
SELECT 'minecraft:p' || p_partkey AS trade, 'w:' || p_size AS wants_item, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END AS wants_count, 'g:x' AS gives_item, 1 AS gives_count, 16 AS max_uses
FROM part WHERE p_partkey % 7 <> 0
""")
def adapter_trade(spark, sf):
    body = """concat('{"wants": {"id": "w:', p_size, '"', if(p_partkey % 2 = 0, concat(', "count": ', p_size, '.0'), ''), '}, ', if(p_partkey % 7 = 0, '"gives": "x"', '"gives": {"id": "g:x"}'), ', "max_uses": 16.0}')"""
    return adapters.trades(_docs(spark, sf, body)).drop("xp")


@query("""
SELECT 'minecraft:p' || p_partkey AS id, 'a' || p_size || ',b' AS criteria, 'kind' AS structure_type, 2.5 * p_size AS length_seconds, p_size AS width FROM part
""")
def adapter_projections(spark, sf):
    """C4: advancement, structure, song and painting."""
    d = _docs(spark, sf, """concat('{"criteria": {"b": {}, "a', p_size, '": {}}, "type": "minecraft:kind", "length_in_seconds": ', 2.5 * p_size, ', "sound_event": "s", "width": ', p_size, ', "height": 1}')""")
    a = adapters.advancements(d).select("id", F.array_join("criteria_ids", ",").alias("criteria"))
    s = adapters.structures(d).select("id", "structure_type")
    j = adapters.songs(d).select(F.col("song").alias("id"), "length_seconds")
    p = adapters.paintings(d).select(F.col("painting").alias("id"), "width")
    return a.join(s, "id").join(j, "id").join(p, "id")


@query("""
SELECT 'minecraft:p' || p_partkey AS item, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS nutrition, CASE WHEN p_partkey % 3 = 1 THEN 25 END AS max_damage,
  CASE WHEN p_partkey % 3 = 1 THEN 1.5 * p_size END AS attack_damage FROM part WHERE p_partkey % 3 <> 2
""")
def adapter_item_use(spark, sf):
    """The first attack modifier counts; items without a use are left out."""
    body = """CASE p_partkey % 3 WHEN 0 THEN concat('{"components": {"minecraft:food": {"nutrition": ', p_size, '}}}')
      WHEN 1 THEN concat('{"components": {"minecraft:max_damage": 25, "minecraft:attribute_modifiers": [{"type": "minecraft:armor", "amount": 9}, {"type": "minecraft:attack_damage", "amount": ', 1.5 * p_size, '}, {"type": "minecraft:attack_damage", "amount": 0}]}}')
      ELSE '{"components": {}}' END"""
    return adapters.item_uses(_docs(spark, sf, body)).select("item", "nutrition", "max_damage", "attack_damage")


@query("""
SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN round_even((1 + p_size) / 2.0, 0)
  WHEN 3 THEN round_even((2.0 * 3 + p_size) / 4, 0) ELSE 1 END AS INTEGER) AS n FROM part
""")
def count_resolve(spark, sf):
    """A number, a constant inside a clamp, a range, a weighted list, something unknown."""
    body = """CASE p_partkey % 5 WHEN 0 THEN string(p_size)
      WHEN 1 THEN concat('{"type": "minecraft:clamped", "source": {"type": "minecraft:constant", "value": ', p_size, '}}')
      WHEN 2 THEN concat('{"type": "minecraft:uniform", "min_inclusive": 1, "max_inclusive": ', p_size, '}')
      WHEN 3 THEN concat('{"type": "minecraft:weighted_list", "distribution": [{"data": 2, "weight": 3}, {"data": ', p_size, ', "weight": 1}]}')
      ELSE '{"type": "minecraft:other"}' END"""
    return _docs(spark, sf, body).select("p_partkey", adapters.resolve_count(F.col("body")).alias("n"))


_PATHS = ["data/minecraft/recipe/a/b", "data/minecraft/loot_table/blocks/x", "data/minecraft/tags/item/y", "data/minecraft/worldgen/structure/z", "data/minecraft/datapacks/q/data/minecraft/recipe/a", "data/minecraft/other/w"]


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'recipe' WHEN 1 THEN 'loot_table' WHEN 2 THEN 'tag' WHEN 3 THEN 'worldgen_structure' END AS category,
  'minecraft:' || CASE p_partkey % 6 WHEN 0 THEN 'a/b' WHEN 1 THEN 'blocks/x' WHEN 2 THEN 'item/y' WHEN 3 THEN 'z' WHEN 4 THEN 'q/data/minecraft/recipe/a' ELSE 'w' END || p_size AS id FROM part
""")
def path_category(spark, sf):
    """A3, A4."""
    path = F.concat(F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_size").cast("string"), F.lit(".json"))
    return table(spark, sf, "part").select("p_partkey", adapters.category_of(path).alias("category"), adapters.subject_of(path).alias("id"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 2 THEN 'u://' || p_size END AS v, p_partkey % 3 <> 2 AS parsed FROM part
""")
def comments_tolerated(spark, sf):
    """A2: a comment goes, slashes in strings stay, what doesn't parse is reported."""
    body = r"""concat('{"v": "u://', p_size, '"', if(p_partkey % 3 = 0, ' // note "x"', ''), '\n', if(p_partkey % 3 = 2, '', '}'))"""
    good, bad = reports.tolerant(_docs(spark, sf, body))
    return good.select("p_partkey", F.get_json_object("body", "$.v").alias("v"), F.lit(True).alias("parsed")).unionByName(
        bad.select("p_partkey", F.lit(None).cast("string").alias("v"), F.lit(False).alias("parsed"))
    )


@query("SELECT 'item' AS registry, 'p' || p_partkey AS id FROM part UNION ALL SELECT 'block', 'b' || p_size FROM part")
def registry_ids(spark, sf):
    """A6."""
    body = """concat('{"minecraft:item": {"entries": {"p', p_partkey, '": {"protocol_id": 1}}}, "minecraft:block": {"entries": {"b', p_size, '": {}}}}')"""
    return reports.registry_ids(_docs(spark, sf, body))


@query("""
SELECT 'minecraft:p' || p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'shaped' WHEN 1 THEN 'furnace' WHEN 2 THEN 'smithing_trim' ELSE 'brewing_mix' END AS recipe_type,
  CASE p_partkey % 4 WHEN 0 THEN 'r:' || p_size WHEN 1 THEN 'o:x' WHEN 2 THEN 'trim:base' ELSE 'o:y' END AS result_item,
  CASE p_partkey % 4 WHEN 0 THEN 'i:a,t:b' WHEN 1 THEN 'i:' || p_size WHEN 2 THEN 'add:x,tmpl:x,trim:base' ELSE 'i:in,i:re' END AS ingredients FROM part
""")
def alt_recipe(spark, sf):
    """C5."""
    body = """CASE p_partkey % 4
      WHEN 0 THEN concat('{"minecraft:recipe_shaped": {"key": {"x": {"tag": "t:b"}, "y": {"item": "i:a"}}, "result": [{"item": "r:', p_size, '"}, {"item": "bucket"}]}}')
      WHEN 1 THEN concat('{"minecraft:recipe_furnace": {"input": "i:', p_size, '", "output": "o:x"}}')
      WHEN 2 THEN '{"minecraft:recipe_smithing_trim": {"template": "tmpl:x", "base": {"tag": "trim:base"}, "addition": "add:x"}}'
      ELSE '{"minecraft:recipe_brewing_mix": {"input": "i:in", "reagent": "i:re", "output": "o:y"}}' END"""
    return adapters_alt.recipes(_docs(spark, sf, body)).select("id", "recipe_type", "result_item", F.array_join("ingredients", ",").alias("ingredients"))


@query("SELECT 'minecraft:p' || p_partkey AS id, 'a,b' || p_size AS biome_tags FROM part WHERE p_partkey % 3 <> 0")
def alt_spawn_rule(spark, sf):
    """Positive tags alone."""
    leaf = lambda v, op="==": f'{{"test": "has_biome_tag", "operator": "{op}", "value": "{v}"}}'
    good = f"""concat('[{leaf("a")}, {{"any_of": [{{"all_of": [{{"test": "has_biome_tag", "value": "b', p_size, '"}}]}}, {leaf("n", "!=")}]}}, {{"none_of": [{leaf("z")}]}}]')"""
    body = f"""concat('{{"minecraft:spawn_rules": {{"conditions": [{{"minecraft:biome_filter": ', if(p_partkey % 3 = 0, '{leaf("q", "not")}', {good}), '}}]}}}}')"""
    return adapters_alt.spawn_rules(_docs(spark, sf, body)).select("id", F.array_join("biome_tags", ",").alias("biome_tags"))


@query("SELECT 'minecraft:p' || p_partkey || '/tier1/trade1' AS trade, 'a,w' || p_size AS wants, 'g' AS gives FROM part")
def alt_trading(spark, sf):
    """Positions stay although an earlier trade is malformed."""
    body = """concat('{"tiers": [{}, {"trades": [{"wants": [{"item": "x"}]}, {"wants": [{"item": "w', p_size, '"}, {"item": "a"}, {}], "gives": [{"item": "g"}]}]}]}')"""
    rows = adapters_alt.tradings(_docs(spark, sf, body))
    return rows.select("trade", F.array_join("wants", ",").alias("wants"), F.array_join("gives", ",").alias("gives"))


@query("""
SELECT 'minecraft:p' || p_partkey AS id, 'monster' AS spawn_category, p_partkey % 2 = 0 AS is_spawnable, false AS is_summonable, 0.5 * p_size AS temperature, 'x,y' AS tags FROM part
""")
def alt_entity_biome(spark, sf):
    """C8."""
    d = _docs(spark, sf, """concat('{"minecraft:entity": {"description": {"identifier": "i", "spawn_category": "monster"', if(p_partkey % 2 = 0, ', "is_spawnable": true', ''), '}}, "minecraft:biome": {"components": {"minecraft:climate": {"temperature": ', 0.5 * p_size, '}, "minecraft:tags": {"tags": ["x", "y"]}}}}')""")
    return adapters_alt.entities(d).join(adapters_alt.biomes(d).select("id", "temperature", F.array_join("tags", ",").alias("tags")), "id")


_REFERENCES = """
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey >= 3 UNION ALL SELECT 1, 7),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT p_partkey AS k, 'i' || p_size AS d FROM part)
SELECT 'minecraft:p' || k AS id, string_agg(d, ',' ORDER BY d) AS drops FROM (SELECT k, d FROM m UNION SELECT r.a, m.d FROM r JOIN m ON r.b = m.k) GROUP BY k
"""


@query(_REFERENCES)
def loot_reference_closure(spark, sf):
    """Tables of all parts that refer to tables, with a cycle."""
    ref = """CASE WHEN p_partkey >= 3 THEN concat(', {"type": "loot_table", "name": "minecraft:p', p_partkey div 3, '"}') WHEN p_partkey = 1 THEN ', {"type": "loot_table", "name": "minecraft:p7"}' ELSE '' END"""
    body = f"""concat('{{"pools": [{{"entries": [{{"type": "item", "name": "i', p_size, '"}}', {ref}, ']}}]}}')"""
    rows = adapters_alt.loot_drops(_docs(spark, sf, body))
    return rows.select("id", F.array_join("drops", ",").alias("drops"))


@query(_REFERENCES)
def loot_reference_whole(spark, sf):
    """The same under its earlier name."""
    return loot_reference_closure(spark, sf)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS instruction, CASE WHEN toxic = 0 THEN 'static_oracle' ELSE 'adversarial_judge' END AS method FROM labels WHERE quality = 1
""")
def admitted_lines(spark, sf):
    """B2: admitted results as lines, read back."""
    from factloom.sources.sinks import admitted_lines as lines

    rows = table(spark, sf, "labels").select(
        F.struct(F.col("doc_id").cast("string").alias("instruction"), F.lit("a").alias("answer")).alias("sample"),
        F.when(F.col("toxic") == 0, "fact_seeded").otherwise("free_recall").alias("lane"),
        F.struct((F.col("quality") == 1).alias("success")).alias("verification"),
    )
    return lines(rows).select(F.get_json_object("value", "$.instruction").alias("instruction"), F.get_json_object("value", "$.verification.method").alias("method"))
