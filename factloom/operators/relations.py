"""Joins and set operations with the semantics of the fact pipeline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.scratch import written


def place_features(placed: DataFrame, features: DataFrame) -> DataFrame:
    """Placed features with their configured feature's blocks, a row for each; the last modifier of a kind wins."""
    last = F.try_element_at(F.filter("modifiers", lambda m: m["kind"] == "height"), F.lit(-1))
    count = F.try_element_at(F.filter("modifiers", lambda m: m["kind"] == "count"), F.lit(-1))
    return (
        placed.select("placement", "feature", last["value"].alias("height"), count["value"].alias("count"))
        .join(features, "feature")
        .select("placement", F.explode("blocks").alias("block"), "height", "count")
    )


def two_hop(first: DataFrame, second: DataFrame, on: Column, key: str, choice: Column) -> DataFrame:
    """The best second hop of each key, by ``choice`` (the least struct)."""
    return first.join(second, on).groupBy(key).agg(F.min(choice).alias("hop"))


def zip_validate(left: DataFrame, right: DataFrame, index: str, fields: list[str]) -> DataFrame:
    """Two arms side by side by position; mismatches and missing partners counted for each field."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{index}") == F.col(f"b.{index}"), "full_outer")
    missing = F.col(f"a.{index}").isNull() | F.col(f"b.{index}").isNull()
    return both.agg(
        F.count_if(missing).alias("unpaired"),
        *(F.count_if(~missing & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"differ_{f}") for f in fields),
    )


def field_diff(expected: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    """Fields whose claimed values differ from the expected (arrays as multisets), with both sides."""
    joined = expected.join(claimed.withColumnRenamed("value", "claim"), [key, "field"], "left")
    return joined.where(~F.sort_array("value").eqNullSafe(F.sort_array("claim")))


def containment_pairs(sets: DataFrame, group: str, key: str) -> DataFrame:
    """Pairs of a group's items of which one's values are a proper part of the other's.

    A set that holds another holds that one's rarest value as well, so each item
    meets those alone that have its rarest value of the group; the whole sets then
    decide. Items with equal sets must be given once.
    """
    values = sets.select(group, key, "vals", F.explode("vals").alias("v"))
    counted = values.groupBy(group, "v").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group, key).orderBy("n", "v"))
    rarest = values.join(counted, [group, "v"]).withColumn("k", rank).where("k = 1")
    a = rarest.select(group, F.col(key).alias("part"), F.col("vals").alias("few"), "v")
    b = values.select(group, F.col(key).alias("whole"), F.col("vals").alias("many"), "v")
    held = (F.size("few") < F.size("many")) & (F.size(F.array_except("few", "many")) == 0)
    return a.join(b, [group, "v"]).where(held).select(group, "part", "whole")


def within_radius(points: DataFrame, centre: list[float], radius: float, column: str) -> DataFrame:
    """Points no farther than ``radius`` from a fixed centre, with the distance."""
    here = F.array(*(F.lit(float(x)) for x in centre))
    squares = F.aggregate(
        F.zip_with(F.transform(column, lambda x: x.cast("double")), here, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )
    return points.withColumn("distance", F.sqrt(squares)).where(F.col("distance") <= radius)


#: Points of either side that are joined together.
CELL_POINTS = 10_000
#: Pairs of points that are compared together, and in a task.
TASK_PAIRS = 50_000_000


def _places(points: DataFrame, most: int) -> DataFrame:
    """``x, y, z, part, ids``: points of the same position in a row, in several of about ``most`` where they are more."""
    at = points.select("id", *(F.col(c).cast("double").alias(c) for c in "xyz")).dropna(subset=list("xyz"))
    crowded = written(at.groupBy(*"xyz").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    parts = F.coalesce(F.ceil(F.col("n") / most), F.lit(1).cast("long"))
    unnamed = F.array_repeat(F.lit(None).cast(at.schema["id"].dataType), F.count_if(F.col("id").isNull()).cast("int"))
    at = at.join(crowded, list("xyz"), "left").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    return written(at.groupBy(*"xyz", "part").agg(F.concat(F.collect_list("id"), unnamed).alias("ids")), "places")


def near_pairs(a: DataFrame, b: DataFrame, radius: float, digits: int | None = None) -> DataFrame:
    """``a_id, b_id, distance`` of points (``id, x, y, z``) of two frames that are no farther apart than ``radius``.

    With ``digits`` the distances given are rounded, those compared with the radius aren't.

    Points of the same position are one row, so the distance of two positions is
    taken once and its pairs come out side by side, where a writer needs few bytes
    for them. Positions meet through the cells of a grid as wide as the radius: each
    of ``b`` is put into its own and the 26 cells around it. Cells of many points are
    cut into blocks of a slice of ``a`` and one of ``b``, of at most about
    ``CELL_POINTS`` points each and ``TASK_PAIRS`` pairs; a slice goes to all blocks
    of the other side, so what is shuffled grows with the pairs and not faster. Tasks
    are as many as the pairs ask for, because few bytes of points make many pairs.
    """
    side = min(CELL_POINTS, math.isqrt(TASK_PAIRS))
    cell = lambda c, d: (F.floor(F.col(c) / radius) + d).cast("long")
    here, there = (_places(points, max(1, side // 4)) for points in (a, b))
    here = here.select(F.col("ids").alias("a_ids"), *(F.col(c).alias(f"a{c}") for c in "xyz"), F.xxhash64(*"xyz", "part").alias("a_hash"), *(cell(c, F.lit(0)).alias(f"c{c}") for c in "xyz"))
    steps = F.array(*(F.struct(*(F.lit(d).alias(n) for n, d in zip("ijk", (i, j, k), strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    there = there.select(F.col("ids").alias("b_ids"), *"xyz", F.xxhash64(*"xyz", "part").alias("b_hash"), F.explode(steps).alias("d"))
    there = there.select("b_ids", "x", "y", "z", "b_hash", *(cell(c, F.col(f"d.{n}")).alias(f"c{c}") for c, n in zip("xyz", "ijk", strict=True)))
    squares = sum(((F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in "xyz"), F.lit(0.0))
    cells = ["cx", "cy", "cz"]
    sizes = here.groupBy(*cells).agg(F.sum(F.size("a_ids")).alias("n")).join(there.groupBy(*cells).agg(F.sum(F.size("b_ids")).alias("m")), cells)
    sizes = written(sizes.select(*cells, F.ceil(F.col("n") / side).alias("p"), F.ceil(F.col("m") / side).alias("q"), (F.col("n") * F.col("m")).alias("pairs")), "sizes")
    dense = sizes.where("p > 1 OR q > 1").drop("pairs")
    slices = lambda c: F.coalesce(c, F.lit(1).cast("long"))
    slice_of = lambda key, c: F.pmod(key, slices(c)).alias(c)
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), slices(c) - 1)).alias(c)
    here = here.join(dense, cells, "left").select("a_ids", "ax", "ay", "az", *cells, slice_of("a_hash", "p"), each("q"))
    there = there.join(dense, cells, "left").select("b_ids", "x", "y", "z", *cells, each("p"), slice_of("b_hash", "q"))
    # one column, because a constant coordinate would drop out of the join's keys and undo the partitions; text, because
    # structs of the two sides differ in what may be null and would be shuffled again
    here, there = (df.withColumn("block", F.concat_ws(",", *cells, "p", "q")).drop(*cells, "p", "q") for df in (here, there))
    n = -(-(sizes.agg(F.sum("pairs")).first()[0] or 0) // TASK_PAIRS)
    if n > 1:
        n = max(n, int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        here, there = (df.repartition(n, "block") for df in (here, there.hint("shuffle_hash")))
    distance = F.col("distance")
    pairs = here.join(there, "block").withColumn("distance", F.sqrt(squares)).where(distance <= radius)
    pairs = pairs.select("a_ids", "b_ids", (distance if digits is None else F.round(distance, digits)).alias("distance"))
    return pairs.withColumn("a_id", F.explode("a_ids")).select("a_id", F.explode("b_ids").alias("b_id"), "distance")


def _seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def confirmed_requests(requests: DataFrame, confirms: DataFrame, seconds: int) -> DataFrame:
    """Each request with its first confirmation by the same user, strictly later and within the time to live.

    Both are walked backwards in time, so each request sees the next confirmation
    without meeting the others.
    """
    asked = requests.select("user_id", "nonce", "ts", F.lit(0).alias("kind"), F.col("request_id").alias("id"))
    said = confirms.select("user_id", "nonce", "ts", F.lit(1).alias("kind"), F.col("confirm_id").alias("id"))
    both = asked.unionByName(said).withColumn("at", _seconds(F.col("ts")))
    w = Window.partitionBy("user_id", "nonce").orderBy(F.desc("ts"), "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.last(F.when(F.col("kind") == 1, F.struct("at", "id")), ignorenulls=True).over(w)
    found = both.withColumn("next", following).where((F.col("kind") == 0) & (F.col("next.at") - F.col("at") <= seconds))
    return found.select(F.col("id").alias("request_id"), F.col("next.id").alias("confirm_id"), "user_id")


# The tier of each action that needs a confirmation, and the seconds for which one may come.
TIERS = {"mine": 2, "place": 2, "chest_deposit": 2, "chest_withdraw": 2, "attack": 3}
TIME_TO_LIVE = 30


def dispatch(requests: DataFrame, confirms: DataFrame, enabled: tuple[int, ...], seconds: int = TIME_TO_LIVE) -> DataFrame:
    """``id, kind, outcome, partner`` of requests and confirmations.

    ``requests`` is ``request_id, user_id, tool, nonce, ts``, ``confirms`` is
    ``confirm_id, user_id, nonce, ts``. Actions without a tier are ``unknown``, of a
    tier that isn't enabled ``disabled``; others wait under their nonce, in the place
    of an earlier one with the same. A confirmation must come strictly later
    (``none``), within the time to live (``expired``) and from the same user
    (``other_user``); the first such one executes, and the nonce is used up
    (``used``). Requests are ``executed`` or ``unconfirmed``.
    """
    tier = F.try_element_at(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair)), F.col("tool"))
    asked = requests.withColumn("state", F.when(tier.isNull(), "unknown").when(~tier.isin(*enabled), "disabled").otherwise("waits"))
    rows = asked.where("state = 'waits'").select("nonce", "user_id", "ts", F.lit(1).alias("kind"), F.col("request_id").alias("id")).unionByName(
        # at the same moment a confirmation stands before a request, so it isn't later
        confirms.select("nonce", "user_id", "ts", F.lit(0).alias("kind"), F.col("confirm_id").alias("id"))
    )
    rows = rows.withColumn("at", _seconds(F.col("ts")))
    w = Window.partitionBy("nonce").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    waiting = F.last(F.when(F.col("kind") == 1, F.struct("id", "user_id", "at")), ignorenulls=True).over(w)
    said = rows.withColumn("r", waiting).where("kind = 0")
    good = F.col("r").isNotNull() & (F.col("at") - F.col("r.at") <= seconds) & (F.col("user_id") == F.col("r.user_id"))
    said = said.withColumn("good", F.coalesce(good, F.lit(False)))
    turn = Window.partitionBy("r.id", "good").orderBy("ts", "id")
    said = said.withColumn("k", F.row_number().over(turn))
    outcome = (
        F.when(F.col("r").isNull(), "none")
        .when(F.col("at") - F.col("r.at") > seconds, "expired")
        .when(~F.col("good"), "other_user")
        .when(F.col("k") == 1, "executed")
        .otherwise("used")
    )
    said = said.select("id", F.lit("confirm").alias("kind"), outcome.alias("outcome"), F.col("r.id").alias("partner"))
    done = said.where("outcome = 'executed'").select(F.col("partner").alias("request_id"), F.col("id").alias("by"))
    return said.unionByName(
        asked.join(done, "request_id", "left").select(
            F.col("request_id").alias("id"),
            F.lit("request").alias("kind"),
            F.when(F.col("state") != "waits", F.col("state")).when(F.col("by").isNotNull(), "executed").otherwise("unconfirmed").alias("outcome"),
            F.col("by").alias("partner"),
        )
    )


def multiset_equal(a: Column, b: Column) -> Column:
    return F.sort_array(a).eqNullSafe(F.sort_array(b))


def set_equal(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)).eqNullSafe(F.sort_array(F.array_distinct(b)))
