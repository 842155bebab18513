"""The whole build: a report tree to the flat fact tables and what lookups of them answer (P2, A5, C11, E1, B1, D10), and training sets (K3, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import depth_token, use_tokens
from factloom.operators import adapters, evaluation, generation, graph, lookup, relations, traces
from factloom.sources import reports
from factloom.sources.scratch import written


def dimension_bounds(docs: DataFrame) -> DataFrame:
    """One row ``low, high`` of the overworld; none if the report doesn't say."""
    rows = docs.where("path = 'data/minecraft/dimension_type/overworld.json'")
    get = lambda p: F.get_json_object("body", p).try_cast("int")
    return rows.select(get("$.min_y").alias("low"), (get("$.min_y") + get("$.height") - 1).alias("high")).where("low is not null and high is not null")


def ore_depths(docs: DataFrame) -> DataFrame:
    """``block, placement, dist_type, min_y, max_y, count`` of placed ore features; none without bounds."""
    name = F.concat(F.lit("minecraft:"), F.regexp_extract("path", r"/([^/]*)\.json$", 1))
    kept = docs.withColumn("name", name)
    features = kept.where("path like 'data/minecraft/worldgen/configured_feature/%'").where(F.get_json_object("body", "$.type") == "minecraft:ore")
    targets = F.from_json(F.get_json_object("body", "$.config.targets"), "array<struct<state:struct<Name:string>>>")
    features = features.select(F.col("name").alias("feature"), F.array_compact(F.transform(targets, lambda t: t["state"]["Name"])).alias("blocks"))
    raw = F.from_json(F.get_json_object("body", "$.placement"), "array<string>")
    modifiers = F.transform(
        raw,
        lambda m: F.struct(
            F.when(F.get_json_object(m, "$.type") == "minecraft:height_range", "height")
            .when(F.get_json_object(m, "$.type") == "minecraft:count", "count")
            .alias("kind"),
            F.coalesce(F.get_json_object(m, "$.height"), F.get_json_object(m, "$.count")).alias("value"),
        ),
    )
    placed = kept.where("path like 'data/minecraft/worldgen/placed_feature/%'").select(
        F.col("name").alias("placement"), F.get_json_object("body", "$.feature").alias("feature"), modifiers.alias("modifiers")
    )
    rows = relations.place_features(placed, features).where("height is not null")
    rows = rows.crossJoin(F.broadcast(dimension_bounds(docs)))  # one row at most

    def end(which: str):
        get = lambda p: F.get_json_object("height", f"$.{which}.{p}").try_cast("int")
        y = adapters.resolve_height(get("absolute"), get("above_bottom"), get("below_top"), F.col("low"), F.col("high"))
        return adapters.clamp_height(y, F.col("low"), F.col("high"))

    kind = F.regexp_replace(F.get_json_object("height", "$.type"), "^.*:", "")
    return rows.select(
        "block", "placement", kind.alias("dist_type"), end("min_inclusive").alias("min_y"), end("max_inclusive").alias("max_y"),
        F.coalesce(adapters.resolve_count(F.col("count")), F.lit(1)).alias("count"),
    ).where("min_y is not null and max_y is not null")


#: Files of these places that aren't JSON are passed over in a build; elsewhere they are an error.
LENIENT = (
    "data/minecraft/tags/%", "data/minecraft/worldgen/configured_feature/%", "data/minecraft/worldgen/placed_feature/%",
    "data/minecraft/dimension_type/%", "%components/item/%",
)


def build_oracle(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The eleven fact tables of a report tree."""
    return oracle_tables(reports.documents(spark, root))


def oracle_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """The eleven fact tables of a report's documents (``path, body, category, id``), of a tree or of a table that packs them."""
    lenient = F.lit(False)
    for place in LENIENT:
        lenient = lenient | F.col("path").like(place)
    # documents are read once: what isn't JSON is passed over in some places and an error in others
    broken = F.try_parse_json("body").isNull()
    refused = F.raise_error(F.concat(F.lit("not JSON: "), "path")).cast("string")
    docs = written(docs.where(~(broken & lenient)).withColumn("body", F.when(broken, refused).otherwise(F.col("body"))), "report")
    of = lambda category: docs.where(F.col("category") == category)
    values = adapters.tags(of("tag"))
    item = values.where("tag like 'minecraft:item/%'").select(F.regexp_replace("tag", "^minecraft:item/", "minecraft:").alias("tag"), "value")
    refs = item.where("value like '#%'").select("tag", F.substr("value", F.lit(2)).alias("ref"))
    tag = graph.closure(refs, item.where("value not like '#%'").withColumnRenamed("value", "member"))
    tag = written(tag, "tag")
    food = tag.where("tag like '%\\_food'")
    recipes = adapters.recipes(of("recipe"))
    item_docs = docs.where("path like '%components/item/%'").withColumn("id", F.concat(F.lit("minecraft:"), F.regexp_extract("path", r"/([^/]*)\.json$", 1)))
    return {
        "tag": tag,
        "breeding_food": food.select(F.regexp_extract("tag", "^minecraft:(.*)_food$", 1).alias("animal"), F.col("member").alias("food_item")),
        "recipe": recipes.select("result_item", F.explode(F.array_distinct(F.flatten("groups"))).alias("ingredient")),
        "recipe_slot": adapters.recipe_slots(recipes),
        "enchantment": adapters.enchantments(of("enchantment")).select(F.col("id").alias("name"), "max_level", "slots"),
        "villager_trade": adapters.trades(of("villager_trade")).drop("max_uses", "xp"),
        "loot": adapters.loot_drops(of("loot_table")).select(F.col("id").alias("source"), F.explode("drops").alias("drop_item")),
        "jukebox_song": adapters.songs(of("jukebox_song")).select("song", "length_seconds"),
        "painting": adapters.paintings(of("painting_variant")),
        "item_use": adapters.item_uses(item_docs),
        "ore_depth": ore_depths(docs),
    }


def _listed(df: DataFrame, tbl: str, key: str, value: str) -> DataFrame:
    tokens = F.array_join(F.array_sort(F.collect_list(value)), ", ")
    return df.groupBy(F.col(key).alias("key")).agg(tokens.alias("result")).select(F.lit(tbl).alias("tbl"), "key", "result")


def _joined(df: DataFrame, tbl: str, key: str, *tokens) -> DataFrame:
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("key"), F.array_join(F.array_compact(F.array(*tokens)), ", ").alias("result"))


def truth_view(tables: dict[str, DataFrame]) -> DataFrame:
    """``tbl, key, result``: what a lookup of a key answers, in all eleven tables that a call may name.

    A recipe answers the slots of one of its methods, alternatives joined by ``/``;
    a result without slots its ingredients. Keys without rows aren't in it. Tables
    that aren't given answer nothing.
    """
    token = lambda name, c: F.concat(F.lit(name + "="), F.col(c).cast("string"))
    parts = []
    for tbl, key, value in (("breeding_food", "animal", "food_item"), ("loot", "source", "drop_item"), ("tag", "tag", "member")):
        if tbl in tables:
            parts.append(_listed(tables[tbl], tbl, key, value))
    if "recipe" in tables:
        flat = tables["recipe"]
        if "recipe_slot" in tables:
            slots = evaluation.slot_groups(tables["recipe_slot"], "result_item", "method", "slot", "ingredient")
            parts.append(slots.select(F.lit("recipe").alias("tbl"), F.col("result_item").alias("key"), F.col("slots").alias("result")))
            flat = flat.join(slots, "result_item", "left_anti")
        parts.append(_listed(flat, "recipe", "result_item", "ingredient"))
    if "loot" in tables:
        drops = tables["loot"].where("source like 'minecraft:%'")
        parts.append(_listed(lookup.reverse_sources(drops, "source", "drop_item", ("blocks", "entities")), "loot_source", "drop_item", "source"))
    if "ore_depth" in tables:
        depth = tables["ore_depth"].withColumn("t", depth_token(F.col("dist_type"), F.col("min_y"), F.col("max_y"), F.col("count")))
        by_count = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "placement", "t")))
        bands = depth.groupBy(F.col("block").alias("key")).agg(F.array_join(F.transform(by_count, lambda b: b["t"]), ", ").alias("result"))
        parts.append(bands.select(F.lit("ore_depth").alias("tbl"), "key", "result"))
    if "enchantment" in tables:
        parts.append(_joined(tables["enchantment"].where("max_level is not null"), "enchantment", "name", token("max_level", "max_level")))
    if "villager_trade" in tables:
        sides = (F.concat_ws(" ", F.concat(F.lit(f"{s}="), F.coalesce(F.col(f"{s}_count"), F.lit(1)).cast("string")), f"{s}_item") for s in ("wants", "gives"))
        parts.append(_joined(tables["villager_trade"], "villager_trade", "trade", *sides))
    if "jukebox_song" in tables:
        seconds = F.col("length_seconds").cast("double")
        # whole seconds are told without a fraction
        text = F.when(seconds == F.floor(seconds), F.floor(seconds).cast("string")).otherwise(seconds.cast("string"))
        parts.append(_joined(tables["jukebox_song"].where("length_seconds is not null"), "jukebox_song", "song", F.concat(F.lit("length="), text)))
    if "painting" in tables:
        parts.append(_joined(tables["painting"], "painting", "painting", token("width", "width"), token("height", "height")))
    if "item_use" in tables:
        facts = use_tokens(*(F.col(c) for c in ("nutrition", "saturation", "max_damage", "attack_damage", "equip_slot")))
        uses = tables["item_use"].select(F.lit("item_use").alias("tbl"), F.col("item").alias("key"), F.array_join(facts, ", ").alias("result"))
        parts.append(uses.where("result <> ''"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def multihop_traces(recipe: DataFrame, truth: DataFrame, most: int = 6) -> DataFrame:
    """Six messages: an item's ingredients, then those of one craftable ingredient (K3); results of ``recipe`` alone are crafted."""
    made = recipe.select(F.col("result_item").alias("key")).distinct()
    known = truth.where("tbl <> 'recipe'").unionByName(truth.join(made, "key", "left_semi").where("tbl = 'recipe'").select("tbl", "key", "result"))
    return generation.multihop_traces(known, most).select(F.xxhash64("key").alias("trace_id"), "messages")


def training_set(families: list[DataFrame], truth: DataFrame) -> DataFrame:
    """All traces, or an error if any fails verification (K6)."""
    rows = families[0]
    for f in families[1:]:
        rows = rows.unionByName(f)
    rows = written(rows, "traces")
    bad = traces.verify(rows, truth).where("not ok").limit(1).count()
    if bad:
        raise ValueError("a trace does not verify")
    return rows
