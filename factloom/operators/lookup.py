"""Batch lookups: a frame of keys against fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import ascii_fold, names_of, namespaced

NO_ROWS = "(no rows)"


def lookup_folded(keys: DataFrame, facts: DataFrame, fact_key: str) -> DataFrame:
    """Rows of ``facts`` whose key equals ``keys.key`` but for the case of A-Z."""
    folded = keys.select("key").distinct().withColumn("__k", ascii_fold(F.col("key")))
    return folded.join(facts.withColumn("__k", ascii_fold(F.col(fact_key))), "__k").drop("__k")


def lookup_ranked(keys: DataFrame, facts: DataFrame, fact_key: str, value: str, suffixes: tuple[str, str]) -> DataFrame:
    """First hit among the key, the key with each suffix, and the key without its suffix."""
    short, long = suffixes
    plain = F.regexp_replace("key", f"({long}|{short})$", "")
    forms = F.array(F.col("key"), F.concat("key", F.lit(short)), F.concat("key", F.lit(long)), plain)
    tried = keys.select("key").distinct().select("key", F.posexplode(forms).alias("rank", "__k"))
    hits = tried.join(facts.select(F.col(fact_key).alias("__k"), F.col(value).alias("value")), "__k")
    best = hits.groupBy("key").agg(F.min(F.struct("rank", "value")).alias("b"))
    return keys.select("key").distinct().join(best, "key", "left").select("key", F.col("b.value").alias("value"))


def lookup_scalar(keys: DataFrame, facts: DataFrame, fact_key: str) -> DataFrame:
    """One row for each key, with nulls where there is no fact."""
    return keys.select("key").distinct().join(facts.withColumnRenamed(fact_key, "key"), "key", "left")


def top_rows(facts: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in a total order, with their ranks."""
    w = Window.partitionBy(key).orderBy(*order)
    return facts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def reverse_sources(drops: DataFrame, source: str, item: str, kinds: tuple[str, ...]) -> DataFrame:
    """Distinct sources of each item, of the given kinds, without the item's own source."""
    path = F.regexp_replace(F.col(source), "^[^:]*:", "")
    own = F.element_at(F.split(path, "/"), -1) == F.regexp_replace(F.col(item), "^[^:]*:", "")
    wanted = F.lit(False)
    for kind in kinds:
        wanted = wanted | path.startswith(kind + "/")
    return drops.where(wanted & ~own).select(item, source).distinct()


def rows_union(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """One view ``tbl, key, pos, token`` over tables of any shape: a row's tokens by position."""
    parts = []
    for name, (df, key, columns) in tables.items():
        tokens = F.array(*(F.col(c).cast("string") for c in columns))
        parts.append(df.select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("key"), F.posexplode(tokens).alias("pos", "token")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_string(rows: DataFrame, keys: list[str], token: str, order: list[str] | None = None) -> DataFrame:
    """Tokens of each key joined in order; keys without tokens render as no rows."""
    picked = F.sort_array(F.collect_list(F.struct(*(order or [token]), F.col(token).alias("__t"))))
    text = F.array_join(F.filter(F.transform(picked, lambda s: s["__t"]), lambda x: x.isNotNull()), ", ")
    return rows.groupBy(*keys).agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_ROWS)).alias("result"))


def resolve_nouns(nouns: DataFrame, registry: DataFrame) -> DataFrame:
    """Plain names to ids, blanks around them and case aside: by an id's last part, underscores or spaces; of several the least."""
    asked = nouns.select("noun").distinct().withColumn("__name", F.lower(F.trim("noun")))
    return asked.join(names_of(registry).withColumnRenamed("noun", "__name"), "__name", "left").select("noun", "id")


def existing(ids: DataFrame, registry: DataFrame, scoped: bool = False) -> DataFrame:
    """Rows of ``ids`` (``id``, and ``registry`` if scoped) that the registry (``registry, id``) has."""
    keys = ["registry", "id"] if scoped else ["id"]
    return ids.join(registry.select(*keys).distinct(), keys, "left_semi")


def placed(ids: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of ``ids`` (``registry, id``) with ``anywhere``, whether any registry has the id, and ``there``, whether the row's own has.

    The registry is the hashed side: rows of ``ids`` pass it unsorted, so no task holds them.
    """
    homes = registry.groupBy("id").agg(F.collect_set("registry").alias("__homes"))
    found = ids.join(homes.hint("shuffle_hash"), "id", "left")
    there = F.coalesce(F.array_contains("__homes", F.col("registry")), F.lit(False))
    return found.select(*ids.columns, F.col("__homes").isNotNull().alias("anywhere"), there.alias("there"))


# Tables whose keys are ids, and what may be left off or put behind an enchantment's name.
NAMESPACED = ("recipe", "loot_source", "ore_depth", "tag", "enchantment", "villager_trade", "jukebox_song", "painting", "item_use")
SUFFIXES = ("_enchant", "_enchantment")


def lookup_key(tbl: Column, key: Column) -> Column:
    """What a key is compared by: with its namespace if its table has ids, without regard to the case of A-Z."""
    return ascii_fold(F.when(tbl.isin(*NAMESPACED), namespaced(key)).otherwise(key))


def execute(called: DataFrame, truth: DataFrame) -> DataFrame:
    """``tbl, key, result`` of each distinct call (``tbl, key``) against ``truth`` (``tbl, key, result``).

    An enchantment is also looked up with its suffixes and without; the first hit
    counts. Calls without rows have the result ``NO_ROWS``.
    """
    short, long = SUFFIXES
    asked = called.select("tbl", "key").where("tbl is not null and key is not null").distinct()
    k = lookup_key(F.col("tbl"), F.col("key"))
    forms = F.when(
        F.col("tbl") == "enchantment",
        F.array(k, F.concat(k, F.lit(short)), F.concat(k, F.lit(long)), F.replace(F.replace(k, F.lit(long), F.lit("")), F.lit(short), F.lit(""))),
    ).otherwise(F.array(k))
    tried = asked.select("tbl", "key", F.posexplode(forms).alias("rank", "__k"))
    rows = truth.select("tbl", lookup_key(F.col("tbl"), F.col("key")).alias("__k"), "result")
    hits = tried.join(rows, ["tbl", "__k"]).groupBy("tbl", "key").agg(F.min(F.struct("rank", "result")).alias("hit"))
    return asked.join(hits, ["tbl", "key"], "left").select("tbl", "key", F.coalesce("hit.result", F.lit(NO_ROWS)).alias("result"))


def tokens_of(result: Column) -> Column:
    """The tokens of a rendered result; none of ``NO_ROWS``."""
    return F.when(result == NO_ROWS, F.array().cast("array<string>")).otherwise(F.split(result, ", "))
