"""Reshaping of samples and small checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.calls import ARGUMENTS, ID_TOKEN
from factloom.functions.names import names_of

MARKER = "</thought>\n"
# Gear that is kept.
DIAMOND_GEAR = ("sword", "pickaxe", "axe", "shovel", "hoe", "helmet", "chestplate", "leggings", "boots")
ENCHANTED = ("minecraft:enchantments", "minecraft:stored_enchantments")
# Words that may be captured but name nothing, and the places in which a noun is said to be an object.
STOP = (
    "them", "it", "the", "a", "an", "with", "and", "or", "to", "your", "their", "this", "that", "some", "any", "using",
    "from", "these", "those", "each", "food", "items", "item", "block", "blocks", "player", "players",
)
OBJECT_TYPE = r"(?i)\b([a-z][a-z]+(?:[ _][a-z]+)?)\s+(ore|ingot|nugget)\b"
FEED_WITH = r"(?i)\b(?:feed(?:ing)?|breed(?:ing)?)\b[^.]*?\bwith\s+([a-z][a-z]+(?:\s+[a-z]+)?)\b"
FEED_DIRECT = r"(?i)\bfeed(?:ing)?\s+(?:them|it|the\s+\w+|a\s+\w+|your\s+\w+)?\s*([a-z][a-z]+(?:\s+[a-z]+)?)\b"
# The version that a manifest states and the form of its signatures.
MANIFEST_VERSION = "minecraft-lookup-manifest-v1"
VERSION_LINE = r"(?m)^Manifest-Version:\s*(\S+)\s*$"
SIGNATURE = r"(?m)^lookup\(([a-z_]+),\s*([a-z_]+)='KEY'\)\s*$"


def thought_and_answer(response: Column) -> Column:
    """``struct(thought, answer)``; null without the marker or with an empty answer."""
    parts = F.split(response, MARKER, 2)
    answer = F.trim(F.get(parts, F.lit(1)))
    thought = F.trim(F.replace(F.get(parts, F.lit(0)), F.lit("<thought>"), F.lit("")))
    return F.when((F.size(parts) == 2) & (answer != ""), F.struct(thought.alias("thought"), answer.alias("answer")))


def chat_messages(question: Column, thought: Column, answer: Column) -> Column:
    text = F.concat(F.lit("<think>"), thought, F.lit("</think>\n"), answer)
    return F.array(
        F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), text.alias("content"))
    )


def protected_gear(name: Column, components: Column) -> Column:
    return (
        name.startswith("netherite_")
        | name.isin(*(f"diamond_{g}" for g in DIAMOND_GEAR))
        | F.exists(components, lambda c: c.isin(*ENCHANTED))
    )


def rendered_calls(made: Column, answer: Column) -> Column:
    """Numbered calls and the answer, with placeholders where there are none."""
    # fixed values: the form of a line and the placeholders
    lines = F.transform(
        made, lambda c, i: F.concat(F.lit("  → lookup "), (i + 1).cast("string"), F.lit(": "), c["tbl"], F.lit("("), c["key"], F.lit(")"))
    )
    shown = F.when(F.size(made) > 0, F.array_join(lines, "\n")).otherwise(F.lit("  → (no lookup emitted)"))
    return F.concat(shown, F.lit("\n"), F.coalesce(F.nullif(answer, F.lit("")), F.lit("(no answer)")))


def manifest_problems(text: Column) -> Column:
    """Signatures too many and too few, as counts; empty if the manifest is right."""
    found = F.regexp_extract_all(text, F.lit(r"lookup\([a-z_]+, [a-z_]+='KEY'\)"), F.lit(0))
    wanted = F.array(*(F.lit(f"lookup({t}, {a}='KEY')") for t, a in ARGUMENTS.items()))
    extra, missing = F.size(F.array_except(found, wanted)), F.size(F.array_except(wanted, found))
    twice = F.size(found) - F.size(F.array_distinct(found))
    part = lambda name, n: F.when(n > 0, F.concat(F.lit(name + ":"), n.cast("string")))
    return F.concat_ws(",", part("extra", extra + twice), part("missing", missing))


def manifest_faults(text: Column) -> Column:
    """``empty``, ``version`` and ``signatures``, comma-joined; empty if a manifest states its version and exactly the lookups."""
    found = F.transform(
        F.arrays_zip(
            F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(2)).alias("a")
        ),
        lambda r: F.concat_ws(" ", r["t"], r["a"]),
    )
    wanted = F.array_sort(F.array(*(F.lit(f"{t} {a}") for t, a in ARGUMENTS.items())))
    blank = text.isNull() | (F.trim(text) == "")
    return F.when(blank, F.lit("empty")).otherwise(
        F.concat_ws(
            ",",
            F.when(F.regexp_extract(text, VERSION_LINE, 1) != MANIFEST_VERSION, F.lit("version")),
            F.when(~F.array_sort(found).eqNullSafe(wanted), F.lit("signatures")),
        )
    )


def _named_nouns(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda n: F.lower(F.trim(n))))


def fabricated_objects(texts: DataFrame, key: str, text: str, registry: DataFrame) -> DataFrame:
    """``key, label``: ids that ``registry`` (``id``) hasn't, and nouns in object-defining places that resolve to none.

    All three places count; a noun is real if it or its last word is the name of an
    id, with underscores or spaces.
    """
    body = F.col(text)
    ids = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(ID_TOKEN), F.lit(0)))).alias("id"))
    missing = ids.join(registry.select("id").distinct(), "id", "left_anti").select(key, F.col("id").alias("label"))
    found = F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (OBJECT_TYPE, FEED_WITH, FEED_DIRECT)))
    nouns = texts.select(key, F.explode(_named_nouns(found)).alias("said"))
    nouns = nouns.where(~F.col("said").isin(*STOP) & (F.length("said") >= 3)).select(
        key, "said", F.element_at(F.split("said", r"\s+"), -1).alias("last")
    )
    names = names_of(registry).select("noun").distinct()
    bad = nouns.join(names.select(F.col("noun").alias("said")), "said", "left_anti").join(
        names.select(F.col("noun").alias("last")), "last", "left_anti"
    )
    return missing.unionByName(bad.select(key, F.concat(F.lit("(prose) "), "said").alias("label"))).distinct()


def fabricated_nouns(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """``key, noun``: nouns in object-defining places of which neither they nor their last words are known."""
    found = F.concat(
        F.regexp_extract_all(F.col(text), F.lit(OBJECT_TYPE), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(FEED_WITH), F.lit(1))
    )
    # of two captured words the first may be a verb, so the last decides as well
    nouns = texts.select(key, F.explode(F.array_distinct(F.transform(found, lambda n: F.lower(F.trim(n))))).alias("said"))
    nouns = nouns.where(~F.col("said").isin(*STOP) & (F.length("said") >= 3)).select(
        key, "said", F.element_at(F.split("said", r"\s+"), -1).alias("noun")
    )
    named = known.select("noun").distinct()
    bad = nouns.join(named, "noun", "left_anti").join(named.select(F.col("noun").alias("said")), "said", "left_anti")
    return bad.select(key, "noun").distinct()


def isolation_breaches(files: DataFrame, pattern: str, allowed: DataFrame) -> DataFrame:
    """Files (``path, body``) outside an allow-list that match a pattern."""
    return files.where(F.col("body").rlike(pattern)).join(allowed, "path", "left_anti").select("path")


def content_hashes(files: DataFrame) -> DataFrame:
    """SHA-256 of each file's content."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("sha256"))


def messages_only(traces: DataFrame) -> DataFrame:
    """Traces without what is known about them besides their messages."""
    return traces.select("messages")
