"""Adapters: polymorphic JSON documents to typed fact rows.

Each takes a frame with a document's ``id`` and JSON text ``body`` and stays in
JSON functions. Shapes that may be a string, an object or a list are told apart
by their first character; nested lists are followed to the depth that the
documents have (two), nested entries to any depth in the same pass. Keys of JSON objects keep the document's order through
``from_json`` to a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import nested

# What a path must contain to be of a category, in order of precedence.
CATEGORIES = (
    ("recipe", "/recipe/"),
    ("recipe", "/recipes/"),
    ("loot_table", "/loot_table"),
    ("advancement", "/advancement"),
    ("tag", "/tags/"),
    ("worldgen_structure", "/worldgen/structure/"),
    ("enchantment", "/enchantment/"),
    ("villager_trade", "/villager_trade/"),
    ("jukebox_song", "/jukebox_song/"),
    ("painting_variant", "/painting_variant/"),
)
EXCLUDED = "/datapacks/"


def category_of(path: Column) -> Column:
    """The category of a path below the report's root; null if excluded or of none."""
    slashed = F.concat(F.lit("/"), path)
    out = F.lit(None).cast("string")
    for name, part in reversed(CATEGORIES):
        out = F.when(F.contains(slashed, F.lit(part)), F.lit(name)).otherwise(out)
    return F.when(~F.contains(slashed, F.lit(EXCLUDED)), out)


def subject_of(path: Column) -> Column:
    """``namespace:rest`` of ``data/namespace/registry/rest.json``; worldgen registries have two parts."""
    parts = F.split(F.regexp_replace(path, r"\.json$", ""), "/")
    skip = F.when(F.get(parts, F.lit(2)) == "worldgen", 4).otherwise(3)
    rest = F.array_join(F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0))), "/")
    return F.when((F.get(parts, F.lit(0)) == "data") & (F.size(parts) > skip), F.concat(F.get(parts, F.lit(1)), F.lit(":"), rest)).otherwise(
        F.array_join(parts, "/")
    )


def _one_ingredient(text: Column) -> Column:
    """A string, ``{item}`` or ``{tag}`` as a list of at most one id."""
    item, tag = F.get_json_object(text, "$.item"), F.get_json_object(text, "$.tag")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>"))
        .when(~F.ltrim(text).startswith("{"), F.array(F.regexp_replace(text, '^"|"$', "")))
        .when(item.isNotNull(), F.array(item))
        .when(tag.isNotNull(), F.array(F.concat(F.lit("#"), tag)))
        .otherwise(F.array().cast("array<string>"))
    )


def ingredient_items(text: Column) -> Column:
    """Ids of an ingredient: a string, an object or a list of these (JSON text)."""
    listed = F.from_json(text, "array<string>")
    return F.when(F.ltrim(text).startswith("["), F.flatten(F.transform(listed, _one_ingredient))).otherwise(_one_ingredient(text))


def recipe_of(body: Column) -> Column:
    """``struct(recipe_type, result_item, result_count, groups)``: slots in document order, each sorted and distinct.

    Shaped recipes take their key's values, shapeless ones their ingredients,
    cooking and cutting one ingredient, smithing and transmuting their named
    slots; a trim has no result and gives its base. Others have no groups.
    """
    get = lambda p: F.get_json_object(body, p)
    # types of any other namespace fit none of the families
    kind = F.regexp_extract(get("$.type"), "^minecraft:(.*)$", 1)
    keyed = F.map_values(F.from_json(get("$.key"), "map<string,string>"))
    listed = F.from_json(get("$.ingredients"), "array<string>")
    named = lambda *names: F.array_compact(F.array(*(get(f"$.{n}") for n in names)))
    slots = (
        F.when(kind == "crafting_shaped", keyed)
        .when(kind == "crafting_shapeless", listed)
        .when(kind.isin("smelting", "blasting", "smoking", "campfire_cooking", "stonecutting"), named("ingredient"))
        .when(kind.isin("smithing_transform", "smithing_trim"), named("template", "base", "addition"))
        .when(kind == "crafting_transmute", named("input", "material"))
    )
    groups = F.filter(F.transform(slots, lambda s: F.array_sort(F.array_distinct(ingredient_items(s)))), lambda g: F.size(g) > 0)
    raw = get("$.result")
    given = F.when(F.ltrim(raw).startswith("{"), get("$.result.id"))
    base = F.when(kind.isin("smithing_transform", "smithing_trim"), F.get(ingredient_items(get("$.base")), F.lit(0)))
    result = F.coalesce(F.nullif(given, F.lit("")), base)
    return F.struct(
        kind.alias("recipe_type"),
        result.alias("result_item"),
        F.coalesce(get("$.result.count").try_cast("int"), F.lit(1)).alias("result_count"),
        groups.alias("groups"),
    )


def recipes(docs: DataFrame) -> DataFrame:
    """``id`` and the columns of ``recipe_of``; documents without a result or a slot give no row."""
    return docs.select("id", recipe_of(F.col("body")).alias("r")).select("id", "r.*").where("result_item is not null and size(groups) > 0")


def recipe_slots(found: DataFrame) -> DataFrame:
    """``result_item, method, slot, ingredient`` of adapted recipes (a bag)."""
    slots = found.select("result_item", F.col("id").alias("method"), F.posexplode("groups").alias("slot", "group"))
    return slots.select("result_item", "method", "slot", F.explode("group").alias("ingredient"))


def loot_drops(docs: DataFrame) -> DataFrame:
    """``id, drops``: items, ``#`` tags and the children of composite entries at any depth, sorted and distinct."""
    return docs.select("id", nested.loot_items(F.col("body")).alias("drops")).where("size(drops) > 0")


def tags(docs: DataFrame) -> DataFrame:
    """``tag, value, pos``: a tag's values in document order, ``{id}`` unwrapped."""
    values = F.from_json(F.get_json_object("body", "$.values"), "array<string>")
    raw = docs.select(F.col("id").alias("tag"), F.posexplode(values).alias("pos", "v"))
    return raw.select("tag", F.when(F.ltrim("v").startswith("{"), F.get_json_object("v", "$.id")).otherwise(F.col("v")).alias("value"), "pos")


def advancements(docs: DataFrame) -> DataFrame:
    keys = F.array_sort(F.json_object_keys(F.get_json_object("body", "$.criteria")))
    return docs.select("id", keys.alias("criteria_ids")).where("size(criteria_ids) > 0")


def structures(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", p)
    return docs.select("id", F.regexp_replace(get("$.type"), "^.*:", "").alias("structure_type"), get("$.biomes").alias("biomes"), get("$.step").alias("step")).where(
        "structure_type is not null"
    )


def enchantments(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", p)
    whole = F.when(get("$.max_level").rlike("^-?[0-9]+$"), get("$.max_level").try_cast("int"))
    slots = F.when(F.ltrim(get("$.slots")).startswith("["), F.array_sort(F.from_json(get("$.slots"), "array<string>"))).when(
        get("$.slots").isNotNull(), F.array(get("$.slots"))
    )
    return docs.select(
        "id",
        whole.alias("max_level"),
        get("$.weight").try_cast("int").alias("weight"),
        get("$.anvil_cost").try_cast("int").alias("anvil_cost"),
        F.coalesce(slots, F.array().cast("array<string>")).alias("slots"),
    ).where("max_level is not null")


def trades(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", p)
    count = lambda p: F.coalesce(get(p).try_cast("double").cast("int"), F.lit(1))
    return docs.select(
        F.col("id").alias("trade"),
        get("$.wants.id").alias("wants_item"),
        count("$.wants.count").alias("wants_count"),
        get("$.gives.id").alias("gives_item"),
        count("$.gives.count").alias("gives_count"),
        get("$.max_uses").try_cast("double").cast("int").alias("max_uses"),
        get("$.xp").try_cast("double").cast("int").alias("xp"),
    ).where("wants_item is not null and gives_item is not null")


def songs(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", p)
    sound = F.coalesce(get("$.sound_event.sound_id"), get("$.sound_event"))
    return docs.select(
        F.col("id").alias("song"), get("$.length_in_seconds").try_cast("double").alias("length_seconds"),
        get("$.comparator_output").try_cast("int").alias("comparator_output"), sound.alias("sound_event"),
    ).where("length_seconds is not null and sound_event is not null")


def paintings(docs: DataFrame) -> DataFrame:
    get = lambda p: F.get_json_object("body", p)
    return docs.select(
        F.col("id").alias("painting"), get("$.width").try_cast("int").alias("width"), get("$.height").try_cast("int").alias("height")
    ).where("width is not null and height is not null")


def item_uses(docs: DataFrame) -> DataFrame:
    """Components of items (A7): the first attack modifier counts; items without any use give no row."""
    c = lambda p: F.get_json_object("body", f"$.components['minecraft:{p}']")
    modifiers = F.from_json(c("attribute_modifiers"), "array<struct<type:string,amount:double>>")
    attack = F.get(F.filter(modifiers, lambda m: F.regexp_replace(m["type"], "^.*:", "").endswith("attack_damage")), F.lit(0))["amount"]
    out = docs.select(
        F.col("id").alias("item"),
        F.get_json_object(c("food"), "$.nutrition").try_cast("int").alias("nutrition"),
        F.get_json_object(c("food"), "$.saturation").try_cast("double").alias("saturation"),
        c("max_damage").try_cast("int").alias("max_damage"),
        attack.alias("attack_damage"),
        F.get_json_object(c("equippable"), "$.slot").alias("equip_slot"),
    )
    return out.where("coalesce(cast(nutrition as string), cast(saturation as string), cast(max_damage as string), cast(attack_damage as string), equip_slot) is not null")


def resolve_height(absolute: Column, above_bottom: Column, below_top: Column, low: Column, high: Column) -> Column:
    return F.coalesce(absolute, low + above_bottom, high - below_top)


def clamp_height(y: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(y, low), high)


def weighted_mean(pairs: Column) -> Column:
    """Mean of ``struct(value, weight)``; null of nothing."""
    top = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["value"] * x["weight"])
    return F.try_divide(top, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["weight"]))


#: Clamps inside clamps that are followed; deeper ones are an error.
MOST_CLAMPS = 16


def resolve_count(text: Column) -> Column:
    """A count given as a number, a constant, a range (its middle) or a weighted list; 1 if unknown. Half-even.

    A clamp without a range counts as its source, which may be a clamp again.
    """
    levels = [text, *(F.get_json_object(text, "$" + ".source" * i) for i in range(1, MOST_CLAMPS + 1))]

    def passes(t: Column) -> Column:
        get = lambda p: F.get_json_object(t, p)
        ranged = get("$.min_inclusive").isNotNull() & get("$.max_inclusive").isNotNull()
        return F.coalesce((get("$.type") == "minecraft:clamped") & ~ranged & get("$.source").isNotNull(), F.lit(False))

    inner = F.when(passes(levels[-1]), F.raise_error(F.lit("a count has too many clamps")).cast("string")).otherwise(levels[-1])
    for t in reversed(levels[:-1]):
        inner = F.when(~passes(t), t).otherwise(inner)
    sub = lambda p: F.get_json_object(inner, p)
    entries = F.from_json(sub("$.distribution"), "array<struct<data:double,weight:double>>")
    pairs = F.transform(
        entries,
        lambda e: F.struct(F.coalesce(e["data"], F.lit(0.0)).alias("value"), F.coalesce(e["weight"], F.lit(1.0)).alias("weight")),
    )
    low, high = sub("$.min_inclusive").try_cast("double"), sub("$.max_inclusive").try_cast("double")
    value = (
        F.when(inner.rlike(r"^-?[0-9]+$"), inner.try_cast("double"))
        .when(sub("$.type") == "minecraft:constant", F.coalesce(sub("$.value").try_cast("double"), F.lit(1.0)))
        .when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
        .when(sub("$.type") == "minecraft:weighted_list", weighted_mean(pairs))
    )
    return F.coalesce(F.bround(value).cast("int"), F.lit(1))
