"""Closure, depth, reachability and prerequisites by iteration.

A closure doubles the length of its paths each round, and writes what is new alone. Depths and levels peel: a
round joins the frontier, what the round before has found, to the edges that are
still open, takes these edges away and finds the items that have none left. Only
open edges are kept, so a round never touches what is known, and what it writes
shrinks. Once at most ``LOCAL_EDGES`` edges are open, one task peels them to the
end, so that long chains don't cost a round for each link. Lineage and plans stay
one round long and nothing is collected. Counts decide when to stop.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import appended, scratch_path, written

#: Rounds after which a closure that still finds rows is an error (paths double each round).
MOST_ROUNDS = 64
#: Open edges that one task peels to the end.
LOCAL_EDGES = 100_000


def closure(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``tag, member``: members of each tag itself or of any tag that it references, cycles included.

    ``edges`` is ``tag, ref`` and ``members`` is ``tag, member``. Every tag of a
    cycle gets the full closure.
    """
    below = paths(edges).join(members.withColumnRenamed("tag", "ref").hint("merge"), "ref").select("tag", "member")
    return members.select("tag", "member").unionByName(below).distinct()


def paths(edges: DataFrame) -> DataFrame:
    """``tag, ref``: every tag with all tags that it references, directly or through others.

    ``step`` holds the pairs whose shortest path has exactly 2^k edges, ``reach`` those
    of shorter ones. Put before what is reached, a step gives the pairs of up to twice
    the length, each once where paths are unique; put before itself, the next step.
    Without steps of a length there are no longer ones.
    """
    step = written(edges.select("tag", "ref").distinct(), "step")
    path = scratch_path(edges.sparkSession, "reach")
    reach = appended(step.limit(0), path)
    # merged, because broadcasts of every round would pass through the driver
    after = lambda first, then: first.alias("f").join(then.hint("merge").alias("e"), F.col("f.ref") == F.col("e.tag")).select(F.col("f.tag").alias("tag"), F.col("e.ref").alias("ref"))
    for _ in range(MOST_ROUNDS):
        if step.isEmpty():
            return reach
        found = step.unionByName(after(step, reach)).distinct()
        reach = appended(written(found.join(reach.hint("merge"), ["tag", "ref"], "left_anti"), "found"), path)
        step = written(after(step, step).distinct().join(reach.hint("merge"), ["tag", "ref"], "left_anti"), "step")
    raise RuntimeError("closure has not ended")


def depths(recipes: DataFrame, tags: DataFrame) -> DataFrame:
    """``item, depth``: raw items 0, others 1 + the greatest over their ingredients.

    ``recipes`` is ``item, ingredient``; an ingredient that is a key of ``tags``
    (``tag, member``) counts as its shallowest member once all are known, an
    unresolved ``#`` tag is ignored. Items on or behind a cycle get null.
    """
    spark, kind = recipes.sparkSession, recipes.schema["item"].dataType
    recipes = _as_text(recipes, "item", "ingredient").distinct()
    tags = _as_text(tags, "tag", "member").distinct()
    made = recipes.select("item").distinct()
    used = recipes.select(F.col("ingredient").alias("item")).union(tags.select(F.col("member").alias("item")))
    raw = used.where("item not like '#%'").distinct().join(made, "item", "left_anti")
    keys = tags.select(F.col("tag").alias("ingredient")).distinct()
    of_tags = recipes.join(keys, "ingredient", "left_semi").select("item", F.concat(F.lit("t:"), "ingredient").alias("input"))
    plain = recipes.where("ingredient not like '#%'").join(keys, "ingredient", "left_anti")
    plain = plain.select("item", F.concat(F.lit("i:"), "ingredient").alias("input"))
    of_items = of_tags.unionByName(plain).select(F.concat(F.lit("i:"), "item").alias("node"), "input")
    of_members = tags.select(F.concat(F.lit("t:"), "tag").alias("node"), F.concat(F.lit("i:"), "member").alias("input"))
    edges = written(of_items.unionByName(of_members), "open")
    path = scratch_path(spark, "depths")
    # items whose ingredients are all unresolved tags are as shallow as if made of raw ones
    ignored = made.join(edges.select(F.substr("node", F.lit(3)).alias("item")), "item", "left_anti").select("item", F.lit(1).alias("depth"))
    known = appended(raw.select("item", F.lit(0).alias("depth")).unionByName(ignored), path)
    frontier = known.select(F.concat(F.lit("i:"), "item").alias("input"), "depth")
    state = None  # of nodes with open edges: the least and the greatest depth among those that were closed
    while True:
        if edges.count() <= LOCAL_EDGES:
            found = _peeled(edges, frontier, state)
            break
        met = edges.join(frontier, "input").select("node", F.col("depth").alias("low"), F.col("depth").alias("high"))
        left = written(edges.join(frontier.select("input"), "input", "left_anti"), "open")
        so_far = (met if state is None else met.unionByName(state)).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        waiting = left.select("node").distinct().withColumn("waits", F.lit(True))
        judged = written(so_far.join(waiting, "node", "left"), "judged")
        state, edges = judged.where("waits").drop("waits"), left
        depth = F.when(F.col("node").startswith("t:"), F.col("low")).otherwise(F.col("high") + 1).cast("int")
        found = judged.where("waits is null").select("node", depth.alias("depth"))
        if found.isEmpty():
            break
        _keep(found, path)
        frontier = found.select(F.col("node").alias("input"), "depth")
    known = _keep(found, path)
    whole = known.unionByName(made.join(known, "item", "left_anti").select("item", F.lit(None).cast("int").alias("depth")))
    return whole.select(F.col("item").cast(kind).alias("item"), "depth")


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(n).cast("string").alias(n) for n in names))


def _keep(found: DataFrame, path: str) -> DataFrame:
    items = found.where("node like 'i:%'").select(F.substr("node", F.lit(3)).alias("item"), "depth")
    return appended(items, path)


def _peeled(edges: DataFrame, frontier: DataFrame, state: DataFrame | None) -> DataFrame:
    """``node, depth`` of all that a bounded number of open edges leads to, in one task."""
    null = F.lit(None).cast("string")
    number = F.lit(None).cast("int")
    rows = edges.select("node", "input", number.alias("low"), number.alias("high"))
    needed = edges.select("input").distinct()
    rows = rows.unionByName(frontier.join(needed, "input", "left_semi").select(null.alias("node"), "input", F.col("depth").alias("low"), number.alias("high")))
    if state is not None:
        rows = rows.unionByName(state.select("node", null.alias("input"), F.col("low").cast("int"), F.col("high").cast("int")))

    def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, users, span, ready = Counter(), defaultdict(list), {}, []
        for b in batches:
            for node, given, low, high in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if node is None:
                    ready.append((given, low))
                elif given is None:
                    span[node] = (low, high)
                else:
                    open_[node] += 1
                    users[given].append(node)
        out = []
        while ready:
            name, depth = ready.pop()
            for node in users.pop(name, ()):
                low, high = span.get(node, (depth, depth))
                span[node] = (min(low, depth), max(high, depth))
                open_[node] -= 1
                if not open_[node]:
                    out.append((node, span[node][0] if node.startswith("t:") else span[node][1] + 1))
                    ready.append(out[-1])
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([d for _, d in out], pa.int32())], names=["node", "depth"])

    return rows.coalesce(1).mapInArrow(peel, "node string, depth int")


def reachable(recipes: DataFrame, raw: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """``item, level``: what can be made from ``raw`` items, all ingredients of some recipe being at hand.

    ``recipes`` is ``recipe, item, ingredient``. The level is the round in which
    an item is first made, so ordering by (level, item) lists prerequisites first.
    An ingredient that is a key of ``tags`` (``tag, member``) is at hand with any member.
    """
    spark, kind = recipes.sparkSession, recipes.schema["item"].dataType
    recipes = _as_text(recipes, "recipe", "item", "ingredient")
    path = scratch_path(spark, "reachable")
    known = appended(_as_text(raw, "item").distinct().withColumn("level", F.lit(0)), path)
    goals = recipes.select("recipe", "item").distinct().join(known.select("item"), "item", "left_anti")
    goals = written(goals, "goals")  # recipes of items that aren't made yet
    edges = written(recipes.select("recipe", "ingredient").distinct().join(goals.select("recipe").distinct(), "recipe", "left_semi"), "open")
    if tags is None:
        tags = spark.createDataFrame([], "tag string, member string")
    tags = written(_as_text(tags, "tag", "member").distinct(), "tags")
    whole = lambda df: df.select(F.col("item").cast(kind).alias("item"), "level")
    frontier = known.select("item")
    for level in itertools.count(1):
        if edges.count() + tags.count() <= LOCAL_EDGES:
            return whole(appended(_levels(edges, goals, tags, frontier, level), path))
        # what is newly at hand: items of the round before and tags with one of them as their first
        frontier = frontier.hint("merge")  # broadcasts of every round would pass through the driver
        hand = frontier.unionByName(tags.join(frontier, tags["member"] == frontier["item"], "left_semi").select(F.col("tag").alias("item"))).distinct()
        hand = written(hand.withColumnRenamed("item", "ingredient"), "hand").hint("merge")
        touched = edges.join(hand, "ingredient", "left_semi").select("recipe").distinct()
        left = written(edges.join(hand, "ingredient", "left_anti"), "open")
        ready = touched.join(left.select("recipe").distinct().hint("merge"), "recipe", "left_anti")
        found = written(goals.join(ready.hint("merge"), "recipe", "left_semi").select("item").distinct(), "found")
        if found.isEmpty():
            return whole(known)
        known = appended(found.withColumn("level", F.lit(level)), path)
        goals = written(goals.join(found.hint("merge"), "item", "left_anti"), "goals")
        edges = left.join(goals.select("recipe").distinct().hint("merge"), "recipe", "left_semi")
        tags = written(tags.join(hand.withColumnRenamed("ingredient", "tag").hint("merge"), "tag", "left_anti"), "tags")
        frontier = found


def _levels(edges: DataFrame, goals: DataFrame, tags: DataFrame, frontier: DataFrame, level: int) -> DataFrame:
    """``item, level`` from ``level`` on, of a bounded number of open edges, in one task."""
    parts = (
        edges.select(F.lit("edge").alias("kind"), F.col("recipe").alias("a"), F.col("ingredient").alias("b")),
        goals.join(edges.select("recipe").distinct(), "recipe", "left_semi").select(F.lit("goal").alias("kind"), F.col("recipe").alias("a"), F.col("item").alias("b")),
        tags.select(F.lit("tag").alias("kind"), F.col("tag").alias("a"), F.col("member").alias("b")),
        frontier.join(edges.select(F.col("ingredient").alias("item")).union(tags.select("member")).distinct(), "item", "left_semi").select(
            F.lit("hand").alias("kind"), F.lit("").alias("a"), F.col("item").alias("b")
        ),
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, users, holders, made, now = Counter(), defaultdict(list), defaultdict(list), defaultdict(list), []
        for b in batches:
            for kind, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == "edge":
                    open_[x] += 1
                    users[y].append(x)
                elif kind == "goal":
                    made[x].append(y)
                elif kind == "tag":
                    holders[y].append(x)
                else:
                    now.append(y)
        out: dict[str, int] = {}
        at = level
        while now:
            names, then = [n for item in now for n in (item, *holders.pop(item, ()))], []
            for name in names:
                for recipe in users.pop(name, ()):  # a name is at hand once
                    open_[recipe] -= 1
                    if not open_[recipe]:
                        then += made[recipe]
            now = [item for item in dict.fromkeys(then) if item not in out]
            out.update(dict.fromkeys(now, at))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int32())], names=["item", "level"])

    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.coalesce(1).mapInArrow(fold, "item string, level int")


def resolved_tags(recipes: DataFrame, members: DataFrame) -> DataFrame:
    """``tag, member`` of the ``#`` ingredients of ``recipes`` (``item, ingredient``), looked up without their ``#``.

    Tags keep the ``#`` in the result, as the ingredients have it; tags without
    members give no row.
    """
    used = recipes.where("ingredient like '#%'").select(F.col("ingredient").alias("tag")).distinct()
    return used.join(members.select(F.concat(F.lit("#"), "tag").alias("tag"), "member").distinct(), "tag")


def concrete_recipes(rows: DataFrame) -> DataFrame:
    """``item, ingredient`` of recipes for real items (results with ``#`` are patterns), once each."""
    return rows.where("item not like '#%'").select("item", "ingredient").distinct()


def prerequisites(recipes: DataFrame, raw: DataFrame, tags: DataFrame) -> DataFrame:
    """``item, level, steps``: what must be crafted before each reachable item, in an order that can be followed.

    ``recipes`` is ``item, ingredient`` with all ingredients required; ``tags`` is
    ``tag, member``. A tag counts as its member of the least level, then the least
    name. Steps are distinct, without raw items and without the item itself.
    """
    levels = written(reachable(recipes.withColumn("recipe", F.col("item")), raw, tags), "levels")
    made = levels.join(raw.select("item").distinct(), "item", "left_anti")
    member = tags.join(levels.withColumnRenamed("item", "member"), "member").groupBy("tag").agg(F.min(F.struct("level", "member")).alias("m"))
    needs = recipes.join(made.select("item"), "item", "left_semi").join(member, F.col("ingredient") == F.col("tag"), "left")
    edges = needs.select(F.col("item").alias("tag"), F.coalesce("m.member", "ingredient").alias("ref"))
    edges = edges.join(made.select(F.col("item").alias("ref")), "ref", "left_semi")
    steps = paths(edges).where("tag <> ref").join(made.select(F.col("item").alias("ref"), F.col("level").alias("at")), "ref")
    ordered = F.array_sort(F.collect_list(F.struct("at", "ref")))
    listed = steps.groupBy(F.col("tag").alias("item")).agg(F.transform(ordered, lambda s: s["ref"]).alias("steps"))
    return made.join(listed, "item", "left").select("item", "level", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))
