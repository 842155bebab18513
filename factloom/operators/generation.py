"""Generation of traces and of evaluation items from fact tables (K1, K3-K5, K11, K17, K19; E2-E9, H3, H7, H8, H13, J30, J31).

Every choice is a hash of a seed and a key, so it doesn't depend on the order of
rows or on partitions; limits are features of the families and take the first rows
in that order. ``truth`` is ``tbl, key, result`` of all lookups (``plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.names import (
    article, bare_name, capitalized, depth_rows, depths_phrase, or_list, recipe_phrase, source_label, sources_phrase, use_sentence,
)
from factloom.operators import traces
from factloom.operators.lookup import NO_ROWS, execute, tokens_of
from factloom.operators.runs import question_seed, seeded_hash

#: Ways to ask, by family; ``{n}`` is the subject, ``{y}`` the second one of a chain.
PHRASINGS = {
    "breeding_food": ("What do {n}s eat?", "I have a {n} here, what can I feed it?", "Which items are food for a {n}?"),
    "recipe": ("How is {n} crafted?", "I need {n}, what goes into it?", "Which ingredients make {n}?"),
    "enchantment": ("How high does {n} go?", "What is the top level of {n}?", "Up to which level can I get {n}?"),
    "ore_depth": ("At which height is {n} found?", "How deep do I dig for {n}?", "Where does {n} generate?"),
    "loot": ("What does {n} drop?", "What do I get from {n}?", "Tell me the drops of {n}."),
    "loot_source": ("Where do I get {n}?", "What gives me {n}?", "How can I find {n}?"),
    "villager_trade": ("What is exchanged in the trade {n}?", "What does the villager take and give in {n}?"),
    "jukebox_song": ("How long does the disc {n} play?", "How many seconds has the song {n}?"),
    "painting": ("How large is the painting {n}?", "How wide and high is {n} on the wall?"),
    "tag": ("What is in the tag {n}?", "Which members has the tag {n}?"),
    "large_tag": ("How many members has the tag {n}, and which for example?", "Give me an idea of what the tag {n} holds."),
    "item_use": ("What is {n} good for?", "Of what use is {n}?"),
    "multihop": ("How is {n} made from scratch, with its {y}?", "I want {n} but have no {y}; what do both take?"),
    "cross": ("What do {n}s eat, and how do I make {y} for them?", "How do I craft {y}, which {n}s like, and what else do they eat?"),
    "source_depth": ("Where do I find {n}, and how deep?", "What gives me {n}, and at which height?"),
}
#: Subjects that no report has, by table; those that a report does have are left out.
FAKES = {
    "recipe": ("minecraft:star_forge", "minecraft:time_lamp", "minecraft:thunder_staff", "minecraft:ghost_cloak"),
    "breeding_food": ("pegasus", "sphinx", "hydra"),
    "enchantment": ("minecraft:worldbreaker", "minecraft:eternity"),
    "loot": ("minecraft:entities/storm_giant", "minecraft:entities/dream_eater"),
    "loot_source": ("minecraft:moon_dust", "minecraft:void_pearl"),
    "ore_depth": ("minecraft:moonstone_ore", "minecraft:sunstone_ore"),
}
#: Loose wordings and the key that each means, by table.
LOOSE_WORDINGS = (
    ("What goes into one pair of shears?", "recipe", "minecraft:shears"),
    ("Which parts has a set of iron leggings?", "recipe", "minecraft:iron_leggings"),
    ("What is needed for a whole stack of torches?", "recipe", "minecraft:torch"),
    ("My cows are hungry, what will they take?", "breeding_food", "cow"),
    ("What will my sheep take from my hand?", "breeding_food", "sheep"),
    ("A creeper died here, what may lie on the ground?", "loot", "minecraft:entities/creeper"),
    ("What comes off a zombie in the end?", "loot", "minecraft:entities/zombie"),
)
#: Questions whose first clause is a goal and whose second names the subject.
GOALS = (
    ("My ore takes ages to smelt. How is a blast furnace built?", "recipe", "minecraft:blast_furnace"),
    ("I never find my way home. What does a compass take?", "recipe", "minecraft:compass"),
    ("My chests are full. How is a shulker box made?", "recipe", "minecraft:shulker_box"),
    ("I would like to see far. What goes into a spyglass?", "recipe", "minecraft:spyglass"),
)
#: What a plain word for a resource means.
ALIASES = (
    ("Where does one find iron?", "minecraft:raw_iron"),
    ("I am out of iron, where is some?", "minecraft:raw_iron"),
    ("Where does one find gold?", "minecraft:raw_gold"),
    ("Where does one find copper?", "minecraft:raw_copper"),
    ("Where are diamonds?", "minecraft:diamond"),
)
#: Crafted items without a recorded use that are asked about.
UNUSED = 14
#: Limits of the families: traces of recipes, loot, sources and tags, members of a small and of a large tag.
LIMITS = {"recipe": 1200, "loot": 500, "loot_source": 400, "tag": 150, "small": 12, "large": 40}
#: Ways to ask about a mob's drops, so that each is met several times.
MOB_WAYS = 3


def pick(seed: str, key: Column, choices: Column) -> Column:
    """One of the choices, by a hash of seed and key."""
    return F.element_at(choices, (F.pmod(question_seed(F.lit(seed), key), F.size(choices)) + 1).cast("int"))


def ask(family: str, seed: str, key: Column, n: Column, y: Column | None = None, way: Column | None = None) -> Column:
    """A question of a family about ``n`` (and ``y``): its wording by hash, or the one numbered ``way`` after that."""
    words = F.array(*map(F.lit, PHRASINGS[family]))
    place = question_seed(F.lit(seed + family), key) + (F.lit(0) if way is None else way)
    text = F.replace(F.element_at(words, (F.pmod(place, F.lit(len(PHRASINGS[family]))) + 1).cast("int")), F.lit("{n}"), n)
    return text if y is None else F.replace(text, F.lit("{y}"), y)


def _rows(truth: DataFrame, tbl: str) -> DataFrame:
    """``key, result, r``: a table's rows and their tokens."""
    return truth.where((F.col("tbl") == tbl) & (F.col("result") != NO_ROWS)).select("key", "result", tokens_of(F.col("result")).alias("r"))


def first_by_hash(rows: DataFrame, seed: str, key: str, n: int | None) -> DataFrame:
    """The first ``n`` rows in an order by hash; ``n`` is the family's limit, all rows if it is None."""
    if n is None:
        return rows
    return rows.orderBy(seeded_hash(seed, F.col(key)), key).limit(n)


def _family(rows: DataFrame, family: str, tbl: str, question: Column, answer: Column, thought: Column) -> DataFrame:
    made = F.array(traces.message("user", question), traces.asking(thought, tbl, F.col("key")), traces.told(F.col("result")), traces.message("assistant", answer))
    return rows.select(F.lit(family).alias("family"), "key", made.alias("messages"))


def answer_of(tbl: str) -> Column:
    """An answer that says what the tokens ``r`` of ``key`` say, so that verification and scoring accept it."""
    key, r = F.col("key"), F.col("r")
    name, value = bare_name(key), lambda i: F.element_at(F.split(F.get(r, F.lit(i)), "="), -1)
    label = F.replace(F.element_at(F.split(key, "/"), -1), F.lit("_"), F.lit(" "))
    plain = F.transform(r, bare_name)
    c = F.concat
    return {
        "breeding_food": lambda: c(capitalized(key), F.lit("s eat "), or_list(plain), F.lit(".")),
        "recipe": lambda: c(F.lit("To craft "), name, F.lit(" you need "), recipe_phrase(r), F.lit(".")),
        "enchantment": lambda: c(capitalized(name), F.lit(" goes up to level "), value(0), F.lit(".")),
        "ore_depth": lambda: c(capitalized(name), F.lit(" generates "), depths_phrase(depth_rows(r)), F.lit(".")),
        "loot": lambda: c(capitalized(label), F.lit(" drops "), or_list(plain), F.lit(".")),
        "loot_source": lambda: c(F.lit("You get "), name, F.lit(" by "), sources_phrase(r), F.lit(".")),
        "villager_trade": lambda: c(
            F.lit("The villager takes "), traces.value_of(F.get(r, F.lit(0))), F.lit(" and gives "), traces.value_of(F.get(r, F.lit(1))), F.lit(".")
        ),
        "jukebox_song": lambda: c(F.lit("The disc "), name, F.lit(" plays for "), value(0), F.lit(" seconds.")),
        "painting": lambda: c(F.lit("The painting "), name, F.lit(" is "), value(0), F.lit(" wide and "), value(1), F.lit(" high.")),
        "tag": lambda: c(F.lit("The tag "), key, F.lit(" has "), or_list(plain), F.lit(".")),
        "large_tag": lambda: c(
            F.lit("The tag "), key, F.lit(" has "), F.size(r).cast("string"), F.lit(" members, such as "), or_list(F.slice(plain, 1, 5)), F.lit(".")
        ),
        "item_use": lambda: use_sentence(name, r),
    }[tbl]()


def single_hop_traces(truth: DataFrame, seed: str = "traces", limits: dict[str, int | None] | None = None) -> DataFrame:
    """``family, key, messages`` of one lookup each, over all eleven tables, with large tags (K1).

    ``limits`` stand in for those of ``LIMITS``; recipes, loot, sources and tags have none where it is None.
    """
    most = LIMITS | (limits or {})
    size = F.size("r")

    def chosen(family: str) -> DataFrame:
        rows = _rows(truth, "tag" if family in ("tag", "large_tag") else family)
        if family == "recipe":
            return first_by_hash(rows.where("not contains(key, '_from_')"), seed, "key", most["recipe"])
        if family == "tag":
            return first_by_hash(rows.where(size.between(2, most["small"])), seed, "key", most["tag"])
        if family == "large_tag":
            return rows.where((size > most["small"]) & (size <= most["large"]))
        if family == "loot":
            # all sources but blocks, and blocks up to the budget (H7)
            block = F.col("key").startswith("minecraft:blocks/")
            others = rows.where(~block)
            budget = None if most["loot"] is None else max(0, most["loot"] - others.count())
            rest = first_by_hash(rows.where(block), seed, "key", budget)
            return others.unionByName(rest)
        if family == "loot_source":
            # what comes from a block with depths is asked for in two hops instead
            return first_by_hash(rows.join(deep_sources(truth).select("key"), "key", "left_anti"), seed, "key", most["loot_source"])
        return rows

    out = None
    for family in ("breeding_food", "recipe", "enchantment", "ore_depth", "loot", "loot_source", "villager_trade", "jukebox_song", "painting", "tag", "large_tag", "item_use"):
        tbl = "tag" if family == "large_tag" else family
        rows = chosen(family)
        key = F.col("key")
        n = key if family in ("breeding_food", "villager_trade", "tag", "large_tag") else bare_name(key)
        way = None
        if family == "loot":
            n = F.replace(F.element_at(F.split(key, "/"), -1), F.lit("_"), F.lit(" "))
            # mobs in several wordings
            ways = F.when(key.startswith("minecraft:entities/"), F.sequence(F.lit(0), F.lit(MOB_WAYS - 1))).otherwise(F.array(F.lit(0)))
            rows = rows.select("*", F.explode(ways).alias("way"))
            way = F.col("way")
        thought = F.concat(F.lit(f"This is about {family.replace('_', ' ')}: "), n, F.lit(" can be looked up."))
        one = _family(rows, family, tbl, ask(family, seed, key, n, way=way), answer_of(family), thought)
        out = one if out is None else out.unionByName(one)
    return out


def deep_sources(truth: DataFrame) -> DataFrame:
    """``key, block``: dropped items with the first of their block sources that has depths (E5)."""
    sources = _rows(truth, "loot_source").select("key", F.posexplode("r").alias("pos", "source"))
    blocks = sources.where(F.col("source").startswith("minecraft:blocks/")).select(
        "key", "pos", F.regexp_replace("source", "^minecraft:blocks/", "minecraft:").alias("block")
    )
    deep = _rows(truth, "ore_depth").select(F.col("key").alias("block"))
    return blocks.join(deep, "block").groupBy("key").agg(F.min(F.struct("pos", "block")).alias("b")).select("key", F.col("b.block").alias("block"))


def decline_traces(truth: DataFrame, seed: str = "traces", fakes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Lookups of subjects without rows, and answers that decline; subjects that have rows are left out."""
    spark, out = truth.sparkSession, None
    for tbl, names in (FAKES if fakes is None else fakes).items():
        asked = spark.createDataFrame([(tbl, n) for n in names], "tbl string, key string")
        rows = execute(asked, truth).where(F.col("result") == NO_ROWS)
        key = F.col("key")
        n = F.replace(F.element_at(F.split(bare_name(key), "/"), -1), F.lit("_"), F.lit(" "))
        answer = F.concat(F.lit("I don't have anything on "), n, F.lit(f": it isn't in the {tbl.replace('_', ' ')} table and is not a real one."))
        thought = F.concat(F.lit(f"This is about {tbl.replace('_', ' ')}: "), n, F.lit(" can be looked up."))
        one = _family(rows, "decline", tbl, ask(tbl, seed, key, n), answer, thought)
        out = one if out is None else out.unionByName(one)
    return out


def worded_traces(truth: DataFrame, cases: tuple = LOOSE_WORDINGS, family: str = "wording") -> DataFrame:
    """Given questions with the key that each means; keys without rows are left out (K1)."""
    spark, out = truth.sparkSession, None
    for tbl in sorted({t for _, t, _ in cases}):
        rows = spark.createDataFrame([(q, tbl, k) for q, t, k in cases if t == tbl], "question string, tbl string, key string")
        found = rows.join(execute(rows, truth).where(F.col("result") != NO_ROWS), ["tbl", "key"])
        found = found.withColumn("r", tokens_of(F.col("result")))
        thought = F.concat(F.lit("What is meant here is "), bare_name(F.col("key")), F.lit("; that is the key."))
        one = _family(found, family, tbl, F.col("question"), answer_of(tbl), thought)
        out = one if out is None else out.unionByName(one)
    return out


def _chain(rows: DataFrame, family: str, question: Column, first: str, second: str, think: tuple[Column, Column], answer: Column) -> DataFrame:
    """Six messages over ``k1, result1, k2, result2``."""
    made = F.array(
        traces.message("user", question),
        traces.asking(think[0], first, F.col("k1")),
        traces.told(F.col("result1")),
        traces.asking(think[1], second, F.col("k2")),
        traces.told(F.col("result2")),
        traces.message("assistant", answer),
    )
    return rows.select(F.lit(family).alias("family"), F.col("k1").alias("key"), made.alias("messages"))


def _hop(truth: DataFrame, tbl: str, i: int) -> DataFrame:
    return _rows(truth, tbl).select(F.col("key").alias(f"k{i}"), F.col("result").alias(f"result{i}"), F.col("r").alias(f"r{i}"))


def multihop_traces(truth: DataFrame, most: int = 6, limit: int = 250, seed: str = "traces") -> DataFrame:
    """An item's recipe, then that of one of its ingredients that is crafted itself.

    An ingredient is used by at most ``most`` items, the least used first (H3).
    """
    from factloom.operators.runs import balanced_use

    first = _hop(truth, "recipe", 1).where("not contains(k1, '_from_')")
    second = _hop(truth, "recipe", 2).where("not contains(k2, '_from_')")
    parts = first.select("k1", F.explode(F.array_distinct(F.flatten(F.transform("r1", lambda t: F.split(t, "/"))))).alias("k2"))
    pairs = parts.where("k1 <> k2 and k2 not like '#%'").join(second.select("k2"), "k2", "left_semi")
    rows = first_by_hash(balanced_use(pairs, "k1", "k2", most), seed, "k1", limit).join(first, "k1").join(second, "k2")
    n, y = bare_name(F.col("k1")), bare_name(F.col("k2"))
    answer = F.concat(
        F.lit("To craft "), n, F.lit(" you need "), recipe_phrase(F.col("r1")), F.lit(". For "), y, F.lit(" you need "), recipe_phrase(F.col("r2")), F.lit(".")
    )
    think = F.concat(F.lit("First what goes into "), n, F.lit(".")), F.concat(F.lit("Now what goes into "), y, F.lit("."))
    return _chain(rows, "multihop", ask("multihop", seed, F.col("k1"), n, y), "recipe", "recipe", think, answer)


def cross_traces(truth: DataFrame, limit: int = 60, seed: str = "traces") -> DataFrame:
    """An animal's food, then the recipe of the first food that is crafted."""
    foods = _hop(truth, "breeding_food", 1)
    second = _hop(truth, "recipe", 2).where("not contains(k2, '_from_')")
    each = foods.select("k1", F.explode("r1").alias("k2")).join(second.select("k2"), "k2", "left_semi")
    chosen = first_by_hash(each.groupBy("k1").agg(F.min("k2").alias("k2")), seed, "k1", limit)
    rows = chosen.join(foods, "k1").join(second, "k2")
    n, y = F.col("k1"), bare_name(F.col("k2"))
    answer = F.concat(
        capitalized(n), F.lit("s eat "), or_list(F.transform("r1", bare_name)), F.lit(". To craft "), y, F.lit(" you need "), recipe_phrase(F.col("r2")), F.lit(".")
    )
    think = F.concat(F.lit("First what "), n, F.lit("s eat.")), F.concat(y, F.lit(" can be crafted; now from what."))
    return _chain(rows, "cross", ask("cross", seed, n, n, y), "breeding_food", "recipe", think, answer)


def _depth_chain(truth: DataFrame, asked: DataFrame, family: str) -> DataFrame:
    rows = asked.join(deep_sources(truth).select(F.col("key").alias("k1"), F.col("block").alias("k2")), "k1")
    rows = rows.join(_hop(truth, "loot_source", 1), "k1").join(_hop(truth, "ore_depth", 2), "k2")
    n = bare_name(F.col("k1"))
    block = source_label(F.concat(F.lit("minecraft:blocks/"), F.regexp_replace("k2", "^[^:]*:", "")))
    answer = F.concat(
        F.lit("You get "), n, F.lit(" by "), sources_phrase(F.col("r1")), F.lit(". "), capitalized(block), F.lit(" generates "), depths_phrase(depth_rows(F.col("r2"))), F.lit(".")
    )
    think = F.concat(F.lit("First what gives "), n, F.lit(".")), F.concat(block, F.lit(" is an ore; now how deep it lies."))
    return _chain(rows, family, F.col("question"), "loot_source", "ore_depth", think, answer)


def source_depth_traces(truth: DataFrame, limit: int = 100, seed: str = "traces") -> DataFrame:
    """What drops an item, then at which heights the first such ore block lies (K4, E5)."""
    asked = first_by_hash(deep_sources(truth).select(F.col("key").alias("k1")), seed, "k1", limit)
    asked = asked.withColumn("question", ask("source_depth", seed, F.col("k1"), bare_name(F.col("k1"))))
    return _depth_chain(truth, asked, "source_depth")


def alias_traces(truth: DataFrame, cases: tuple = ALIASES) -> DataFrame:
    """Plain words for resources, chained as source and depth (K4); those without a deep source are left out."""
    return _depth_chain(truth, truth.sparkSession.createDataFrame(list(cases), "question string, k1 string"), "alias")


def usage_declines(truth: DataFrame, items: DataFrame, seed: str = "traces") -> DataFrame:
    """Questions for the use of real ``items`` (``key``) that have none recorded: declined without a call."""
    asked = items.select(F.lit("item_use").alias("tbl"), "key")
    none = execute(asked, truth).where(F.col("result") == NO_ROWS)
    n = bare_name(F.col("key"))
    answer = F.concat(
        F.lit("<think>What "), article(n), F.lit(" "), n, F.lit(" is for is in no table, so no lookup helps.</think>\n"),
        F.lit("I don't have that: there is no information on the use of "), n, F.lit("."),
    )
    made = F.array(traces.message("user", ask("item_use", seed, F.col("key"), n)), traces.message("assistant", answer))
    return none.select(F.lit("usage_decline").alias("family"), "key", made.alias("messages"))


def all_traces(truth: DataFrame, seed: str = "traces", limits: dict[str, int | None] | None = None) -> DataFrame:
    """``trace_id, family, key, messages`` of every family (K1, K3-K5; I1); ``limits`` are those of ``single_hop_traces``."""
    spark = truth.sparkSession
    recorded = truth.where("tbl = 'item_use'").select("key")
    unused = truth.where("tbl = 'recipe'").select("key").join(recorded, "key", "left_anti")
    used = first_by_hash(unused, seed, "key", UNUSED)
    families = (
        single_hop_traces(truth, seed, limits), decline_traces(truth, seed), worded_traces(truth), worded_traces(truth, GOALS, "goal"),
        multihop_traces(truth, seed=seed), cross_traces(truth, seed=seed), source_depth_traces(truth, seed=seed), alias_traces(truth),
        usage_declines(truth, used, seed),
    )
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    question = F.get("messages", F.lit(0))["content"]
    return out.select(F.xxhash64("family", "key", question).alias("trace_id"), "family", "key", "messages")


#: Tables that are asked for in an evaluation, with the question's wording.
EVALUATED = ("breeding_food", "recipe", "enchantment", "loot", "villager_trade", "jukebox_song", "painting", "item_use")


def trained_keys(turns: DataFrame, text: str) -> DataFrame:
    """``key``: keys of the calls in training texts."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"lookup\(\w+,\s*\w+='([^']*)'\)"), F.lit(1))
    return turns.select(F.explode(found).alias("key")).distinct()


def evaluation_items(truth: DataFrame, trained: DataFrame, n: int, seed: str = "items") -> DataFrame:
    """At most ``n`` items of each table whose keys weren't trained on.

    ``category, tbl, key, question, expected, kind``.
    """
    rows = truth.where(F.col("tbl").isin(*EVALUATED) & (F.col("result") != NO_ROWS)).join(trained.select("key").distinct(), "key", "left_anti")
    w = Window.partitionBy("tbl").orderBy(seeded_hash(seed, F.col("key")), "key")
    kept = rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n)
    question = F.lit(None).cast("string")
    for tbl in EVALUATED:
        question = F.when(F.col("tbl") == tbl, ask(tbl, seed, F.col("key"), bare_name(F.col("key")))).otherwise(question)
    return kept.select(
        F.col("tbl").alias("category"), "tbl", "key", question.alias("question"), tokens_of(F.col("result")).alias("expected"), F.lit("known").alias("kind")
    )


def probe_items(probes: DataFrame, truth: DataFrame) -> DataFrame:
    """Probes (``question, tbl, key, kind, second_tbl, second_key``) with what is expected of each.

    Known ones expect their own rows, two hops the rows of the second lookup (of
    recipes unless another table is named), unknown subjects and uses nothing.
    """
    kind = F.coalesce("kind", F.lit("known"))
    hops = kind == "multihop"
    named = probes.withColumn("kind", kind).withColumn("__t", F.when(hops, F.coalesce("second_tbl", F.lit("recipe"))).when(kind == "known", F.col("tbl")))
    named = named.withColumn("__k", F.when(hops, F.col("second_key")).when(kind == "known", F.col("key")))
    found = execute(named.select(F.col("__t").alias("tbl"), F.col("__k").alias("key")), truth)
    found = found.select(F.col("tbl").alias("__t"), F.col("key").alias("__k"), tokens_of(F.col("result")).alias("expected"))
    return named.join(found, ["__t", "__k"], "left").select(
        F.coalesce("tbl", F.lit("usage")).alias("category"), "tbl", "key", "question",
        F.coalesce("expected", F.array().cast("array<string>")).alias("expected"), "kind", "second_tbl", "second_key",
    )


#: Anchors of a held-out set: what is asked, what must be named, how it is scored.
ANCHORS = (
    ("pig_feed", "What may a pig be fed?", ("carrot", "potato", "beetroot"), "contains_any"),
    ("piston_recipe", "What goes into a piston?", ("planks", "cobblestone", "iron", "redstone"), "contains_all"),
)


def fact_items(facts: DataFrame, trained: DataFrame, n: int, held_out: bool = True, seed: str = "facts") -> DataFrame:
    """A set of fact questions, of subjects that weren't trained on or of those that were.

    ``facts`` is ``category, subject, question, expected, score_kind``; the quota of
    each category is ``n`` divided by their number, at least one. Facts without an
    expected value are left out; a held-out set begins with the fixed anchors.
    """
    categories = max(1, facts.select("category").distinct().count())
    quota = max(1, n // categories)
    pool = facts.join(trained.select("subject").distinct(), "subject", "left_anti" if held_out else "left_semi")
    pool = pool.where(F.col("expected").isNotNull() & ~F.exists("expected", F.isnull) & (F.size("expected") > 0))
    w = Window.partitionBy("category").orderBy(seeded_hash(seed, F.col("subject")), "subject")
    columns = ("category", "subject", "question", "expected", "score_kind")
    picked = pool.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= quota).select(*columns)
    if not held_out:
        return picked
    anchors = [("anchor", s, q, list(e), k) for s, q, e, k in ANCHORS]
    return facts.sparkSession.createDataFrame(anchors, "category string, subject string, question string, expected array<string>, score_kind string").unionByName(picked)


#: Files, settings, functions and folders of the scenarios.
SCENARIO_FILES = ("app.yaml", "limits.json", "paths.yaml", "reader.py", "merge.py", "notes.md")
SETTINGS = ("retries", "port", "workers", "limit")
FUNCTIONS = ("read_rows", "merge_rows", "check_row")
FOLDERS = ("src", "tests", "docs")
SCENARIOS = ("setting", "function", "lines", "tests", "folder")


def scenarios(ids: DataFrame, key: str, seed: str = "scenarios") -> DataFrame:
    """Two rows for each id: a task with the call it asks for, and the task with the call's result and the answer.

    ``key, scenario, step, instruction, response``; five kinds, chosen by hash.
    """
    k = F.col(key).cast("string")
    h = lambda name: question_seed(F.lit(seed + name), k)
    of = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(h(name), F.lit(len(values))) + 1).cast("int"))
    number = lambda name, low, high: (F.pmod(h(name), F.lit(high - low + 1)) + low).cast("string")
    kind, c, q = of("kind", SCENARIOS), F.concat, F.lit
    config = of("file", tuple(f for f in SCENARIO_FILES if f.endswith((".yaml", ".json"))))
    code = of("file", tuple(f for f in SCENARIO_FILES if f.endswith(".py")))
    some, setting, function, folder = of("file", SCENARIO_FILES), of("setting", SETTINGS), of("function", FUNCTIONS), of("folder", FOLDERS)
    value, lines, passed, failed = number("value", 1, 200), number("lines", 10, 500), number("passed", 1, 40), number("failed", 0, 3)
    parts = {
        "setting": (c(q("What is "), setting, q(" in "), config, q("?")), c(q('read_file(path="'), config, q('")')), c(setting, q(": "), value), c(setting, q(" is "), value, q("."))),
        "function": (c(q("What does "), function, q(" in "), code, q(" do?")), c(q('read_file(path="'), code, q('")')), c(q("def "), function, q("(rows): return sorted(rows)")), c(function, q(" sorts its rows."))),
        "lines": (c(q("How many lines has "), some, q("?")), c(q('run_command(cmd="wc -l '), some, q('")')), c(lines, q(" "), some), c(some, q(" has "), lines, q(" lines."))),
        "tests": (
            q("Do the tests pass?"), q('run_command(cmd="pytest -q")'), c(passed, q(" passed"), F.when(failed != "0", c(q(", "), failed, q(" failed"))).otherwise(q(""))),
            F.when(failed == "0", c(q("Yes, all "), passed, q(" pass."))).otherwise(c(q("No, "), failed, q(" fail."))),
        ),
        "folder": (c(q("What is in "), folder, q("?")), c(q('run_command(cmd="ls '), folder, q('/")')), some, c(folder, q(" holds "), some, q("."))),
    }

    def by_kind(i: int) -> Column:
        out = F.lit(None).cast("string")
        for name, columns in parts.items():
            out = F.when(kind == name, columns[i]).otherwise(out)
        return out

    think = lambda text: c(q("<thought>\n"), text, q("\n</thought>\n"))
    task = c(q("Task: "), by_kind(0))
    first = F.struct(F.lit(1).alias("step"), task.alias("instruction"), c(think(q("A tool can tell.")), q("TOOL_CALL: "), by_kind(1)).alias("response"))
    second = F.struct(
        F.lit(2).alias("step"),
        c(task, q("\nTool result: "), by_kind(2)).alias("instruction"),
        c(think(c(q("The tool says: "), by_kind(2))), q("FINAL: "), by_kind(3)).alias("response"),
    )
    return ids.select(key, kind.alias("scenario"), F.inline(F.array(first, second)))
