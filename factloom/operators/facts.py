"""Fact records: one stream ``category, subject_id, fields`` of documents of mixed categories, in one scan.

A registry holds an adapter for each category: a function of a document's body that
gives its fields as VARIANT, null where the document makes no record. The stream is
a projection that picks the adapter by category, so documents are read and parsed
once, whatever their categories; nothing is joined, and only references between loot
tables of the second dialect are looked up among documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import nested
from factloom.operators import adapters, adapters_alt
from factloom.operators.graph import closure
from factloom.sources.reports import leniently, strict, without_comments
from factloom.sources.scratch import written

Adapter = Callable[[Column], Column]


def _get(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _raw(body: Column, path: str) -> Column:
    """A value as it stands, as VARIANT; null if absent."""
    return F.try_variant_get(F.try_parse_json(body), path, "variant")


def _record(valid: Column, **fields: Column) -> Column:
    return F.when(F.coalesce(valid, F.lit(False)), F.to_variant_object(F.struct(*(c.alias(k) for k, c in fields.items()))))


def _whole(number: Column) -> Column:
    """A count as a whole number, cut towards zero."""
    return number.try_cast("double").cast("long")


def _recipe(r: Column) -> Column:
    return _record(
        r["result_item"].isNotNull() & (F.size(r["groups"]) > 0),
        recipe_type=r["recipe_type"],
        result_item=r["result_item"],
        result_count=r["result_count"],
        ingredients=F.array_sort(F.array_distinct(F.flatten(r["groups"]))),
        ingredient_groups=r["groups"],
    )


def _advancement(body: Column) -> Column:
    keys = F.array_sort(F.json_object_keys(_get(body, "$.criteria")))
    return _record(F.size(keys) > 0, criteria_ids=keys)


def _text(value: Column) -> Column:
    """A VARIANT that is a string; null of any other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _integer(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "long"))


def _tag(body: Column) -> Column:
    listed = F.try_variant_get(F.try_parse_json(body), "$.values", "array<variant>")
    own = lambda v: F.coalesce(_text(v), _text(F.try_variant_get(v, "$.id", "variant")))
    members = F.filter(F.transform(listed, own), lambda m: m.isNotNull() & (m != ""))
    return _record(F.size(members) > 0, members=members)


def _structure(body: Column) -> Column:
    kind = _get(body, "$.type")
    return _record(kind != "", structure_type=F.regexp_replace(kind, "^[^:]*:", ""), biomes=_raw(body, "$.biomes"), step=_raw(body, "$.step"))


def _enchantment(body: Column) -> Column:
    level, slots = _integer(_raw(body, "$.max_level")), _get(body, "$.slots")
    listed = F.to_variant_object(F.array_sort(F.from_json(slots, "array<string>")))
    return _record(
        level.isNotNull(),
        max_level=level,
        weight=_raw(body, "$.weight"),
        anvil_cost=_raw(body, "$.anvil_cost"),
        slots=F.when(F.ltrim(slots).startswith("["), listed).otherwise(_raw(body, "$.slots")),
    )


def _trade(body: Column) -> Column:
    wants, gives = _get(body, "$.wants.id"), _get(body, "$.gives.id")
    count = lambda p: F.coalesce(_whole(_get(body, p)), F.lit(1).cast("long"))
    return _record(
        (wants != "") & (gives != ""),
        wants_item=wants,
        wants_count=count("$.wants.count"),
        gives_item=gives,
        gives_count=count("$.gives.count"),
        max_uses=_whole(_get(body, "$.max_uses")),
        xp=_whole(_get(body, "$.xp")),
    )


def _song(body: Column) -> Column:
    length, sound = _get(body, "$.length_in_seconds").try_cast("double"), _get(body, "$.sound_event")
    stated = F.when(length == F.floor(length), F.to_variant_object(F.array(length.cast("long")))).otherwise(F.to_variant_object(F.array(length)))
    return _record(
        length.isNotNull() & (sound != ""),
        length_in_seconds=F.variant_get(stated, "$[0]", "variant"),
        comparator_output=_raw(body, "$.comparator_output"),
        sound_event=_raw(body, "$.sound_event"),
    )


def _painting(body: Column) -> Column:
    width, height = (_integer(_raw(body, f"$.{n}")) for n in ("width", "height"))
    return _record(width.isNotNull() & height.isNotNull(), width=width, height=height)


def _drops(found: Column) -> Column:
    return _record(F.size(found) > 0, drops=found)


#: Categories of the first dialect that are columns of the body alone; loot tables and spawn rules are walked.
ADAPTERS: dict[str, Adapter] = {
    "advancement": _advancement,
    "tag": _tag,
    "worldgen_structure": _structure,
    "enchantment": _enchantment,
    "villager_trade": _trade,
    "jukebox_song": _song,
    "painting_variant": _painting,
}


def _alt_recipe(r: Column) -> Column:
    valid = r["recipe_type"].isNotNull() & (r["result_item"] != "") & (F.size(r["ingredients"]) > 0)
    return _record(valid, recipe_type=r["recipe_type"], result_item=r["result_item"], ingredients=r["ingredients"])


def _entity(body: Column) -> Column:
    path = lambda p: f"$['minecraft:entity'].description.{p}"
    flag = lambda p: F.coalesce(_get(body, path(p)).try_cast("boolean"), F.lit(False))
    return _record(
        _get(body, path("identifier")).isNotNull(),
        spawn_category=_get(body, path("spawn_category")),
        is_spawnable=flag("is_spawnable"),
        is_summonable=flag("is_summonable"),
    )


def _biome(body: Column) -> Column:
    """Only what the document has becomes a field, so that the variant is cut from the document's own parts."""
    at = "$['minecraft:biome'].components"
    climate = lambda n: _get(body, f"{at}['minecraft:climate'].{n}")
    tags = _get(body, f"{at}['minecraft:tags'].tags")
    parts = F.array_compact(
        F.array(
            *(F.when(climate(n).isNotNull(), F.concat(F.lit(f'"{n}":'), climate(n))) for n in ("temperature", "downfall")),
            F.when(F.ltrim(tags).startswith("["), F.concat(F.lit('"tags":'), tags)),
        )
    )
    return F.when(F.size(parts) > 0, F.try_parse_json(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))))


ADAPTERS_ALT: dict[str, Adapter] = {"entity": _entity, "biome": _biome}


def _records(docs: DataFrame, registry: dict[str, Adapter], **more: Column) -> DataFrame:
    """``category, subject_id, fields`` of documents by the adapter of their category; ``more`` has those that need more than the body."""
    made = [F.when(F.col("category") == name, f(F.col("body"))) for name, f in registry.items()]
    fields = F.coalesce(*made, *(F.when(F.col("category") == name, c) for name, c in more.items()))
    # a condition on the fields would be pushed below and make them twice
    return docs.select("category", "subject_id", F.explode(F.array_compact(F.array(fields))).alias("fields"))


def fact_records(docs: DataFrame) -> DataFrame:
    """``category, subject_id, fields`` of ``path, body`` documents of the first dialect; a body that isn't JSON is an error."""
    placed = docs.select("path", "body", adapters.category_of(F.col("path")).alias("category"), adapters.subject_of(F.col("path")).alias("subject_id"))
    placed = strict(placed.where("category is not null"))
    walked = nested.loot_items(F.when(F.col("category") == "loot_table", F.col("body")))
    recipe = F.when(F.col("category") == "recipe", adapters.recipe_of(F.col("body")))
    placed = placed.select("category", "subject_id", "body", walked.alias("drops"), recipe.alias("recipe"))
    return _records(placed, ADAPTERS, recipe=_recipe(F.col("recipe")), loot_table=_drops(F.col("drops")))


def subject_of_alt(path: Column) -> Column:
    """``minecraft:`` and the path below its category's directory, without endings."""
    inside = F.regexp_replace(path, rf"^.*?/behavior_pack/(?:{'|'.join(adapters_alt.DIRECTORIES)})/", "")
    return F.concat(F.lit("minecraft:"), F.regexp_replace(F.regexp_replace(inside, r"\.json$", ""), r"\.biome$", ""))


def fact_records_alt(docs: DataFrame) -> DataFrame:
    """The same of the second dialect: comments are tolerated, bodies that still aren't JSON are left out.

    A trading document gives a record for each trade, in its place. A loot table has
    the drops of all tables that it refers to by path, cycles included.
    """
    slashed = F.concat(F.lit("/"), F.col("path"))
    placed = docs.select(
        slashed.alias("path"), without_comments(F.col("body")).alias("body"), adapters_alt.category_of(slashed).alias("category"), subject_of_alt(slashed).alias("subject_id")
    )
    placed = written(leniently(placed.where("category is not null")), "pack")  # cleaned once, read by each kind below
    walked = nested.biome_tags(F.when(F.col("category") == "spawn_rule", F.col("body")))
    recipe = F.when(F.col("category") == "recipe", adapters_alt.recipe_of(F.col("body")))
    single = placed.where("category not in ('loot_table', 'trading')").select("category", "subject_id", "body", walked.alias("tags"), recipe.alias("recipe"))
    out = _records(single, ADAPTERS_ALT, recipe=_alt_recipe(F.col("recipe")), spawn_rule=_record(F.size("tags") > 0, biome_tags=F.col("tags")))

    trades = adapters_alt.tradings(placed.where("category = 'trading'").select(F.col("subject_id").alias("id"), "body"))
    out = out.unionByName(
        trades.select(F.lit("trading").alias("category"), F.col("trade").alias("subject_id"), _record(F.lit(True), wants=F.col("wants"), gives=F.col("gives")).alias("fields"))
    )

    loot = placed.where("category = 'loot_table'")
    own = F.regexp_replace("path", "^.*?/behavior_pack/", "")
    pools = F.from_json(_get(F.col("body"), "$.pools"), "array<struct<entries:array<struct<type:string,name:string>>>>")
    entries = F.flatten(F.transform(pools, lambda p: F.coalesce(p["entries"], F.array().cast("array<struct<type:string,name:string>>"))))
    each = loot.select(own.alias("tag"), F.inline(entries)).where("name <> ''")
    refers = each.where("type = 'loot_table'").select("tag", F.col("name").alias("ref"))
    members = each.where("type = 'item'").select("tag", F.col("name").alias("member"))
    drops = closure(refers, members).groupBy("tag").agg(F.array_sort(F.collect_set("member")).alias("drops"))
    named = loot.select(own.alias("tag"), "subject_id").join(drops, "tag")
    return out.unionByName(named.select(F.lit("loot_table").alias("category"), "subject_id", _drops(F.col("drops")).alias("fields")))


def level_facts(records: DataFrame) -> DataFrame:
    """``name, max_level`` of the enchantments among records, as claims name them."""
    bare = F.replace(F.regexp_replace("subject_id", "^[^:]*:", ""), F.lit("_"), F.lit(" "))
    return records.where("category = 'enchantment'").select(bare.alias("name"), F.try_variant_get("fields", "$.max_level", "long").alias("max_level"))
