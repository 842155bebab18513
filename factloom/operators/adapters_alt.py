"""Adapters of the second dialect of documents (C5-C8, E11, F2): ``id`` and JSON ``body`` to fact rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import nested
from factloom.operators.graph import closure

# The keys that hold a recipe's body, and the directories of the categories.
BODY_KEYS = ("shaped", "shapeless", "furnace", "brewing_mix", "brewing_container", "smithing_transform", "smithing_trim")
DIRECTORIES = {
    "recipes": "recipe",
    "loot_tables": "loot_table",
    "entities": "entity",
    "spawn_rules": "spawn_rule",
    "trading": "trading",
    "biomes": "biome",
}


def category_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, category in reversed(DIRECTORIES.items()):
        out = F.when(F.contains(path, F.lit(f"/behavior_pack/{name}/")), F.lit(category)).otherwise(out)
    return out


def _items(text: Column) -> Column:
    """Ids of a string, ``{item}``, ``{tag}`` (as it is) or a list of these."""

    def one(t: Column) -> Column:
        found = F.coalesce(F.get_json_object(t, "$.item"), F.get_json_object(t, "$.tag"))
        return F.when(F.ltrim(t).startswith("{"), found).otherwise(F.regexp_replace(t, '^"|"$', ""))

    many = F.from_json(text, "array<string>")
    out = F.when(F.ltrim(text).startswith("["), F.transform(many, one)).otherwise(F.array(one(text)))
    return F.array_compact(F.coalesce(out, F.array().cast("array<string>")))


def recipe_of(body: Column) -> Column:
    """``struct(recipe_type, result_item, ingredients)``, ingredients sorted and distinct, without slots."""
    path = lambda k: f"$['minecraft:recipe_{k}']"
    kind = F.coalesce(*(F.when(F.get_json_object(body, path(k)).isNotNull(), F.lit(k)) for k in BODY_KEYS))
    inner = F.coalesce(*(F.get_json_object(body, path(k)) for k in BODY_KEYS))
    get = lambda p: F.get_json_object(inner, p)
    result = get("$.result")
    first = F.get(F.from_json(result, "array<string>"), F.lit(0))
    result_item = (
        F.when(get("$.output").isNotNull(), F.when(~get("$.output").rlike(r"^[\[{]"), get("$.output")))
        .when(F.ltrim(result).startswith("{"), get("$.result.item"))
        .when(F.ltrim(result).startswith("["), F.get_json_object(first, "$.item"))
        .when(result.isNotNull(), result)
        .otherwise(F.get(_items(get("$.base")), F.lit(0)))
    )
    each = lambda *names: F.flatten(F.array(*(F.coalesce(_items(get(f"$.{n}")), F.array().cast("array<string>")) for n in names)))
    keyed = F.flatten(F.transform(F.map_values(F.from_json(get("$.key"), "map<string,string>")), _items))
    ingredients = (
        F.when(get("$.key").isNotNull(), keyed)
        .when(get("$.ingredients").isNotNull(), _items(get("$.ingredients")))
        .when(get("$.template").isNotNull(), each("template", "base", "addition"))
        .when(get("$.reagent").isNotNull(), each("input", "reagent"))
        .otherwise(_items(get("$.input")))
    )
    return F.struct(kind.alias("recipe_type"), result_item.alias("result_item"), F.array_sort(F.array_distinct(ingredients)).alias("ingredients"))


def recipes(docs: DataFrame) -> DataFrame:
    """``id`` and the columns of ``recipe_of``; documents without a kind, a result or an ingredient give no row."""
    found = docs.select("id", recipe_of(F.col("body")).alias("r")).select("id", "r.*")
    return found.where("recipe_type is not null and result_item is not null and size(ingredients) > 0")


def loot_drops(docs: DataFrame) -> DataFrame:
    """``id, drops``: items of a table and of all tables that it refers to, cycles included."""
    pools = docs.select("id", F.explode(F.from_json(F.get_json_object("body", "$.pools"), "array<string>")).alias("pool"))
    entries = pools.select("id", F.explode(F.from_json(F.get_json_object("pool", "$.entries"), "array<string>")).alias("e")).select(
        "id", F.get_json_object("e", "$.type").alias("type"), F.get_json_object("e", "$.name").alias("name")
    ).where("name is not null")
    edges = entries.where("type = 'loot_table'").select(F.col("id").alias("tag"), F.col("name").alias("ref"))
    members = entries.where("type = 'item'").select(F.col("id").alias("tag"), F.col("name").alias("member"))
    return closure(edges, members).groupBy(F.col("tag").alias("id")).agg(F.array_sort(F.collect_set("member")).alias("drops"))


def spawn_rules(docs: DataFrame) -> DataFrame:
    """``id, biome_tags``: tags that some condition asks for; what is under ``none_of`` or negated doesn't count."""
    return docs.select("id", nested.biome_tags(F.col("body")).alias("biome_tags")).where("size(biome_tags) > 0")


def tradings(docs: DataFrame) -> DataFrame:
    """``trade, wants, gives`` with ids by position; malformed trades are left out but keep their place."""
    profession = F.regexp_replace(F.regexp_replace("id", "^[^:]*:", ""), "_trades$", "")
    tiers = docs.select(profession.alias("p"), F.posexplode(F.from_json(F.get_json_object("body", "$.tiers"), "array<string>")).alias("t", "tier"))
    each = tiers.select("p", "t", F.posexplode(F.from_json(F.get_json_object("tier", "$.trades"), "array<string>")).alias("k", "trade"))

    def items(name: str) -> Column:
        rows = F.from_json(F.get_json_object("trade", f"$.{name}"), "array<string>")
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(rows, lambda r: F.get_json_object(r, "$.item")))))

    name = F.format_string("minecraft:%s/tier%d/trade%d", "p", "t", "k")
    return each.select(name.alias("trade"), items("wants").alias("wants"), items("gives").alias("gives")).where("size(wants) > 0 and size(gives) > 0")


def entities(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", f"$['minecraft:entity'].description.{p}")
    flag = lambda p: F.coalesce(get(p).try_cast("boolean"), F.lit(False))
    return docs.where(get("identifier").isNotNull()).select(
        "id", get("spawn_category").alias("spawn_category"), flag("is_spawnable").alias("is_spawnable"), flag("is_summonable").alias("is_summonable")
    )


def biomes(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", f"$['minecraft:biome'].components{p}")
    out = docs.select(
        "id",
        get("['minecraft:climate'].temperature").try_cast("double").alias("temperature"),
        get("['minecraft:climate'].downfall").try_cast("double").alias("downfall"),
        F.from_json(get("['minecraft:tags'].tags"), "array<string>").alias("tags"),
    )
    return out.where("temperature is not null or downfall is not null or tags is not null")
