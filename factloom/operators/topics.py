"""Questions about fact records: by category, with negatives for membership (J30), and evaluation items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import closure
from factloom.operators.runs import question_seed, ranked, seeded_hash
from factloom.sources.scratch import written

#: Questions of each category, ``{s}`` being the subject; a category of several forms has about as many of each.
QUESTIONS: dict[str, tuple[str, ...]] = {
    "recipe": ("Which items go into {s}?",),
    "loot_table": ("What may drop from {s}?",),
    "advancement": ("Which criteria does the advancement {s} ask for?",),
    "worldgen_structure": ("In which biomes is the structure {s} found?",),
    "enchantment": ("Up to which level does the enchantment {s} go?", "In which slots does the enchantment {s} work?"),
    "villager_trade": ("What does the villager ask for in the trade {s}, and how many?", "What is given in the trade {s}?"),
    "jukebox_song": ("For how many seconds does the disc {s} play?",),
    "painting_variant": ("How wide and how high is the painting {s}?",),
}
MEMBER = "Does the tag {s} have the member {m}?"


def _seed(seed: str, key: Column) -> Column:
    return question_seed(F.lit(seed), key)


def _filled(template: Column, **marks: Column) -> Column:
    for mark, value in marks.items():
        template = F.replace(template, F.lit("{" + mark + "}"), value)
    return template


def tag_members(records: DataFrame) -> DataFrame:
    """``tag, member`` of tag records, whole: members of tags that a tag refers to with ``#`` are its members too."""
    tags = records.where("category = 'tag'").select(F.col("subject_id").alias("tag"), F.explode(F.try_variant_get("fields", "$.members", "array<string>")).alias("member"))
    refers = tags.where("member like '#%'").select("tag", F.substr("member", F.lit(2)).alias("ref"))
    return closure(refers, tags.where("member not like '#%'"))


def non_members(members: DataFrame, seed: str) -> DataFrame:
    """``tag, member``: an item of the pool of all members that is none of the tag's; no row for tags that have all.

    Items lie on a ring in the order of their hashes. A tag begins at a place of its
    own and takes the first item that it doesn't have: members' distances from that
    place are joined with their successors, so neither items and tags nor the
    members of one tag ever meet as a group.
    """
    pool = members.select("member").distinct().withColumn("h", seeded_hash(seed, F.col("member")))
    ring = written(ranked(pool, ["h", "member"], "place").select("member", "place"), "ring")
    n = ring.count()
    if not n:
        return members.limit(0)
    start = F.pmod(_seed(seed, F.col("tag")), F.lit(n))
    held = written(members.join(ring, "member").select("tag", F.pmod(F.col("place") - start, F.lit(n)).alias("d")), "held")
    follows = held.select("tag", (F.col("d") + 1).alias("d")).where(F.col("d") < n).join(held, ["tag", "d"], "left_anti")
    at_once = members.select("tag").distinct().join(held.where("d = 0").select("tag"), "tag", "left_anti").select("tag", F.lit(0).cast("long").alias("d"))
    gap = at_once.unionByName(follows.join(at_once.select("tag"), "tag", "left_anti").groupBy("tag").agg(F.min("d").alias("d")))
    place = F.pmod(F.col("d") + start, F.lit(n)).alias("place")
    return gap.select("tag", place).join(ring, "place").select("tag", "member")


def questions(records: DataFrame, seed: str = "questions") -> DataFrame:
    """``category, subject_id, question, expected`` of each record; ``expected`` is yes or no for tags, else null.

    A tag is asked about with one of its own members or, in about half of all cases,
    with an item that it has neither itself nor through another tag.
    """
    of = F.create_map(*(x for k, v in QUESTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    forms = F.try_element_at(of, F.col("category"))
    pick = F.get(forms, F.pmod(_seed(seed, F.col("subject_id")), F.size(forms)).cast("int"))
    plain = records.where("category <> 'tag'").select(
        "category", "subject_id", _filled(pick, s=F.col("subject_id")).alias("question"), F.lit(None).cast("string").alias("expected")
    )
    members = written(tag_members(records), "members")
    # one member by hash: the least of a seeded order, so no tag's members are gathered
    own = members.groupBy("tag").agg(F.min_by("member", seeded_hash(seed, F.concat_ws("|", "tag", "member"))).alias("own"))
    other = non_members(members, seed).withColumnRenamed("member", "other")
    asked = own.join(other, "tag", "left")
    negative = (F.pmod(_seed(seed + "form", F.col("tag")), F.lit(2)) == 1) & F.col("other").isNotNull()
    text = _filled(F.lit(MEMBER), s=F.col("tag"), m=F.when(negative, F.col("other")).otherwise(F.col("own")))
    tags = asked.select(
        F.lit("tag").alias("category"), F.col("tag").alias("subject_id"), text.alias("question"), F.when(negative, "no").otherwise("yes").alias("expected")
    )
    return plain.where("question is not null").unionByName(tags)


#: What evaluation asks of each category: the question, the fields that are expected, how an answer is scored.
EVALUATED: dict[str, tuple[str, tuple[str, ...], str]] = {
    "recipe": ("Which items go into {s}? Name them all.", ("ingredients",), "contains_all"),
    "enchantment": ("Up to which level does the enchantment {s} go?", ("max_level",), "int_equals"),
    "villager_trade": ("What does the villager of the trade {s} ask for, and what is given?", ("wants_item", "gives_item"), "contains_all_pair"),
    "loot_table": ("What may drop from {s}?", ("drops",), "contains_any"),
    "jukebox_song": ("For how many seconds does the disc {s} play?", ("length_in_seconds",), "int_equals"),
    "painting_variant": ("How wide and how high is the painting {s}?", ("width", "height"), "contains_all_pair"),
}


def evaluation_facts(records: DataFrame) -> DataFrame:
    """``category, subject, question, expected, score_kind`` of records of the evaluated categories (K17); the input of ``fact_items``.

    ``expected`` holds the values as text; records that lack one of the fields are left out.
    """
    value = lambda p: F.try_variant_get("fields", f"$.{p}", "string")
    out = None
    for category, (template, fields, kind) in EVALUATED.items():
        listed = F.try_variant_get("fields", f"$.{fields[0]}", "array<string>") if len(fields) == 1 else None
        single = F.array(*map(value, fields))
        expected = single if listed is None else F.coalesce(listed, single)
        made = F.struct(
            _filled(F.lit(template), s=F.col("subject_id")).alias("question"), expected.alias("expected"), F.lit(kind).alias("score_kind")
        )
        out = F.when(F.col("category") == category, made) if out is None else out.when(F.col("category") == category, made)
    rows = records.select("category", F.col("subject_id").alias("subject"), F.explode(F.array_compact(F.array(out))).alias("q"))
    return rows.select("category", "subject", "q.*").where(~F.exists("expected", F.isnull) & (F.size("expected") > 0))
