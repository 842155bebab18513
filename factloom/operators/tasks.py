"""Batch runs, live tasks, snapshots and the shapes of craft traces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.functions import calls
from factloom.operators import gates, traces
from factloom.operators.runs import guarded_calls
from factloom.sources.scratch import written

#: Timeouts in a row after which the rest of a batch isn't tried.
BREAKER = 3
#: How many of an intermediate are crafted at once.
BATCH = 8


def broken_circuits(items: DataFrame, batch: list[str], order: str, timed_out: Column) -> DataFrame:
    """``items`` with ``open``: whether ``BREAKER`` timeouts in a row came before in the same batch; it stays open."""
    w = Window.partitionBy(*batch).orderBy(order)
    rows = items.withColumn("__t", timed_out).withColumn("__g", F.sum((~F.col("__t")).cast("int")).over(w))
    run = Window.partitionBy(*batch, "__g").orderBy(order)
    rows = rows.withColumn("__n", F.sum(F.col("__t").cast("int")).over(run))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("open", F.coalesce(F.max("__n").over(before) >= BREAKER, F.lit(False))).drop("__t", "__g", "__n")


def batch_loop(batches: DataFrame, run: str, order: str, size: str, admitted: str, target: int, ratio: float, empty: int) -> DataFrame:
    """The batches of each run that are made until ``target`` results are admitted or ``empty`` batches in a row admit none.

    ``first_lane`` is a batch's share of the first lane (H9), ``total`` what is
    admitted so far, ``state`` ``complete``, ``aborted`` or ``running``.
    """
    w = Window.partitionBy(run).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = batches.withColumn("total", F.sum(admitted).over(w))
    rows = rows.withColumn("__g", F.sum((F.col(admitted) > 0).cast("int")).over(w))
    rows = rows.withColumn("__e", F.sum((F.col(admitted) == 0).cast("int")).over(Window.partitionBy(run, "__g").orderBy(order)))
    ended = (F.col("total") >= target) | (F.col("__e") >= empty)
    made = rows.withColumn("__end", ended).withColumn("__before", F.coalesce(F.max(F.col("__end")).over(before), F.lit(False))).where("not __before")
    asked = F.sum(size).over(w)
    goal = lambda total: F.bround((total * ratio).cast("decimal(38,6)"), 0).cast("long")
    lane = F.least(F.greatest(goal(asked) - goal(asked - F.col(size)), F.lit(0)), F.col(size)).cast("long")
    state = F.when(F.col("total") >= target, "complete").when(F.col("__e") >= empty, "aborted").otherwise("running")
    return made.select(run, order, size, admitted, lane.alias("first_lane"), "total", state.alias("state"))


def closed_run(attempts: DataFrame, run: str, target: int, ratio: float, concurrency: int, empty: int) -> tuple[DataFrame, DataFrame]:
    """The batches of each run and the attempts that they admit, from the attempts' own verdicts.

    ``attempts`` is ``run, lane, pos, success`` and anything else; ``lane`` is
    ``fact_seeded`` or ``free_recall``, each counted from 0 by ``pos``. A batch has as
    many attempts as are still missing, ``concurrency`` at most, and of all that were
    made so far the share ``ratio`` from the first lane, rounded half-even (H9). A run
    ends once ``target`` are admitted (``complete``), after ``empty`` batches in a row
    without any (``aborted``), or with its attempts (``exhausted``).

    The share fixes which attempt comes when, whatever the batches: that place is a
    function of lane and position. Runs are then folded in this order as a stream;
    a task holds a few numbers of one run. Returns ``run, batch, size, first_lane,
    admitted, total, state`` and the admitted rows with their ``batch``.
    """
    goal = lambda n: F.bround((n * F.lit(ratio)).cast("decimal(38,9)"), 0).cast("long")
    taken = lambda n, first: F.when(first, goal(n)).otherwise(n - goal(n))
    is_first, wanted = F.col("lane") == "fact_seeded", F.col("pos") + 1
    share = F.when(is_first, F.lit(float(ratio))).otherwise(1.0 - ratio)
    guess = F.greatest(F.floor(F.col("pos") / F.nullif(share, F.lit(0.0))).cast("long") - 1, F.lit(0))
    # the least number of attempts that this one is among: rounding moves it by less than one item of its lane
    reach = F.sequence(F.lit(0), F.lit(4 + int(1 / min(ratio, 1 - ratio)) if 0 < ratio < 1 else 4))
    place = F.get(F.filter(F.transform(reach, lambda i: guess + i), lambda n: taken(n, is_first) >= wanted), F.lit(0))
    rows = attempts.withColumn("__place", place).where("__place is not null")
    rows = rows.withColumns({"__run": F.col(run).cast("string"), "__first": is_first, "__ok": F.coalesce(F.col("success"), F.lit(False))})
    width = len(attempts.columns)
    ordered = rows.repartition(run).sortWithinPartitions(run, "__place")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, new = None, True
        for b in batches:
            where, ends = [], []
            for at, name, first, ok in zip(*(b.column(width + i).to_pylist() for i in range(4)), strict=True):
                if new or name != now:
                    now, new, made, total, misses, over, number = name, False, 0, 0, 0, False, 0
                    size, left, lane, got = min(target, concurrency), min(target, concurrency), 0, 0
                if over or at != made + 1:  # a gap: this lane has run out
                    over = True
                    where.append(None)
                    ends.append(None)
                    continue
                made += 1
                left, lane, got = left - 1, lane + first, got + ok
                where.append(number)
                state = "exhausted"
                if not left:
                    total += got
                    misses = 0 if got else misses + 1
                    state = "complete" if total >= target else "aborted" if misses >= empty else "running"
                ends.append((size, lane, got, total if not left else total + got, state))
                if not left:
                    over, number = state != "running", number + 1
                    size = left = min(max(target - total, 1), concurrency)
                    lane = got = 0
            told = pa.array([None if e is None else dict(zip(("made", "first_lane", "admitted", "total", "state"), e, strict=True)) for e in ends], _END)
            yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], pa.array(where, pa.int64()), told], names=[*b.schema.names[: width + 1], "batch", "__end"])

    schema = StructType(
        [*attempts.schema.fields, StructField("__place", LongType()), StructField("batch", LongType()), StructField("__end", _END_TYPE)]
    )
    folded = written(ordered.select(*attempts.columns, "__place", "__run", "__first", "__ok").mapInArrow(fold, schema), "run").where("batch is not null")
    last = folded.groupBy(run, "batch").agg(F.count("*").alias("size"), F.max_by("__end", "__place").alias("e"))
    final = F.col("batch") == F.max("batch").over(Window.partitionBy(run))
    state = F.when(final & (F.col("e.state") == "running"), "exhausted").otherwise(F.col("e.state")).alias("state")
    ended = last.select(run, "batch", "size", "e.first_lane", "e.admitted", "e.total", state)
    return ended, folded.where("success").drop("__place", "__end")


_END_TYPE = StructType([*(StructField(n, LongType()) for n in ("made", "first_lane", "admitted", "total")), StructField("state", StringType())])
_END = pa.struct([*((n, pa.int64()) for n in ("made", "first_lane", "admitted", "total")), ("state", pa.string())])


def verified_run(candidates: DataFrame, run: str, target: int, ratio: float, concurrency: int, empty: int) -> tuple[DataFrame, DataFrame]:
    """``closed_run`` of candidates that are verified here (K10): fact candidates against their facts (K7), others by the judge (K8).

    ``candidates`` is ``run, lane, pos, candidate, fields, unknown_ids`` and for the judge
    ``consistent, rejects, votes, mechanism, capability, comparative``; the admitted
    rows have their ``verification`` and a ``sample``, as ``admitted_lines`` takes them.
    """
    answer = F.try_variant_get("candidate", "$.answer", "string")
    judged = gates.judge(answer, F.col("consistent"), F.col("rejects"), F.col("votes"), {k: F.col(k) for k in calls.CLAIMS})
    fact = gates.fact_check(F.col("candidate"), F.col("fields"), F.col("unknown_ids"))
    sample = F.struct(F.try_variant_get("candidate", "$.instruction", "string").alias("instruction"), answer.alias("answer"))
    verdict = F.when(F.col("lane") == "fact_seeded", fact).otherwise(judged)
    rows = candidates.select(run, "lane", "pos", verdict.alias("verification"), sample.alias("sample"))
    return closed_run(rows.withColumn("success", F.col("verification.success")), run, target, ratio, concurrency, empty)


def task_outcomes(turns: DataFrame, tasks: DataFrame, hops: int) -> DataFrame:
    """What became of each live task.

    ``turns`` is ``task, hop, text, result`` and ``tasks`` is ``task, bucket, before,
    after, error``. A task has the hops up to its first turn without any call, at
    most ``hops``; calls that were made and failed, calls that the guard keeps from
    repeating a failed one (H15), and calls of no known function are counted. It is verified
    if there is more than before; a task that crashed stays, with its error.
    """
    text = F.col("text")
    action = calls.parse_action(text)
    looked = text.rlike(r"lookup\(")
    kind = F.when(looked, "lookup").when(action.isNotNull(), "action").when(F.contains(text, F.lit("<tool_call>")), "unknown").otherwise("end")
    signature = F.when(kind == "action", F.concat_ws("|", action["tool"], F.to_json(action["args"])))
    failed = (kind == "action") & F.coalesce(calls.failed_result(F.col("result")), F.lit(False))
    rows = turns.where(F.col("hop") < hops).select(
        "task", "hop", kind.alias("kind"), action["tool"].alias("tool"), signature.alias("signature"), failed.alias("failed")
    )
    ends = Window.partitionBy("task").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.coalesce(F.max(F.col("kind") == "end").over(ends), F.lit(False))).where("not over")
    guarded = guarded_calls(rows, "task", ["hop"], F.col("tool"), F.col("signature"), F.col("failed"))
    counted = guarded.groupBy("task").agg(
        F.count_if(F.col("kind") != "end").alias("hops"),
        F.count_if(F.col("failed") & ~F.col("guarded")).alias("failed"),
        F.count_if("guarded").alias("repeats"),
        F.count_if(F.col("kind") == "unknown").alias("unknown"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = tasks.join(counted, "task", "left")
    verified = F.col("error").isNull() & F.coalesce(F.col("after") > F.col("before"), F.lit(False))
    return out.select("task", "bucket", *map(zero, ("hops", "failed", "repeats", "unknown")), verified.alias("verified"), F.col("error").isNotNull().alias("crashed"))


# The places of armour in an inventory.
ARMOUR = {"helmet": 5, "chestplate": 6, "leggings": 7, "boots": 8}


def snapshots(states: DataFrame, biomes: DataFrame) -> DataFrame:
    """``id, inventory, position, vitals, equipped, biome`` of recorded states.

    ``states`` is ``id, slots (slot, name, count), held (name, count), x, y, z,
    health, food, biome_id``; a biome's name is looked up by its number and may be null.
    """
    own = F.filter("slots", lambda s: s["name"].isNotNull())
    worn = lambda place: F.get(F.transform(F.filter(own, lambda s: s["slot"] == place), lambda s: F.struct(s["name"], s["count"])), F.lit(0))
    named = states.join(biomes.select("biome_id", F.col("name").alias("__biome")), "biome_id", "left")
    return named.select(
        "id",
        F.array_sort(own).alias("inventory"),
        F.struct("x", "y", "z").alias("position"),
        F.struct("health", "food").alias("vitals"),
        F.struct(F.col("held").alias("mainhand"), *(worn(p).alias(n) for n, p in ARMOUR.items())).alias("equipped"),
        F.struct(F.col("__biome").alias("name"), F.col("biome_id").alias("id")).alias("biome"),
    )


def _bare(item: Column) -> Column:
    return F.regexp_replace(item, "^minecraft:", "")


def craft_traces(tasks: DataFrame) -> DataFrame:
    """``task, messages, completed`` of recorded craft chains in their four shapes.

    ``tasks`` is ``task, shape, target, prereqs, missing, recipes (map of item to
    ingredients), results (of the calls in order), before, after``. ``full`` crafts
    all prerequisites and then the target, ``partial`` stops before the target,
    ``recovery`` crafts the first prerequisite alone, fails, crafts what was missing
    and tries again, ``failure`` tries once. What a trace tells are the recorded
    results, and the answer what the counts before and after show.
    """
    step = lambda kind, item, n: F.struct(F.lit(kind).alias("kind"), item.alias("item"), F.lit(n).alias("n"))
    prepared = lambda items: F.flatten(F.transform(items, lambda i: F.array(step("lookup", i, 0), step("craft", i, BATCH))))
    target = F.col("target")
    table = F.array(step("goto", target, 0))
    look, make = step("lookup", target, 0), step("craft", target, 1)
    missing = F.transform("missing", lambda m: F.concat(F.lit("minecraft:"), m))
    steps = (
        F.when(F.col("shape") == "full", F.concat(table, prepared(F.col("prereqs")), F.array(look, make)))
        .when(F.col("shape") == "partial", F.concat(table, prepared(F.col("prereqs"))))
        .when(
            F.col("shape") == "recovery",
            F.concat(table, prepared(F.slice("prereqs", 1, 1)), F.array(look, make), F.when(F.size("missing") > 0, F.concat(prepared(missing), F.array(make))).otherwise(F.array().cast("array<struct<kind:string,item:string,n:int>>"))),
        )
        .otherwise(F.array(make))
    )
    name = _bare(target)

    def call(s: Column) -> Column:
        looked = F.concat(F.lit("lookup(recipe, result_item='"), s["item"], F.lit("')"))
        crafted = F.concat(F.lit("action(craft, item='"), _bare(s["item"]), F.lit("', count="), s["n"].cast("string"), F.lit(")"))
        return F.when(s["kind"] == "goto", "action(goto_block, block='crafting_table', radius=16, range=1)").when(s["kind"] == "lookup", looked).otherwise(crafted)

    def thought(s: Column) -> Column:
        looked = F.concat(F.lit("What goes into "), _bare(s["item"]), F.lit("?"))
        crafted = F.concat(F.lit("Now "), _bare(s["item"]), F.lit("."))
        return F.when(s["kind"] == "goto", "A crafting table is needed.").when(s["kind"] == "lookup", looked).otherwise(crafted)

    # results are those of the calls that act; a lookup tells the recipe
    told = lambda s, i: F.when(
        s["kind"] == "lookup", F.coalesce(F.try_element_at(F.col("recipes"), s["item"]), F.lit(""))
    ).otherwise(F.coalesce(F.get("results", F.size(F.filter(F.slice("steps", F.lit(1), i), lambda p: p["kind"] != "lookup"))), F.lit("")))
    turns = F.flatten(
        F.transform(
            "steps",
            lambda s, i: F.array(
                traces.message("assistant", F.concat(F.lit("<think>"), thought(s), F.lit("</think>\n<tool_call>"), call(s), F.lit("</tool_call>"))),
                traces.told(told(s, i)),
            ),
        )
    )
    counts = F.concat(F.lit(" (before "), F.col("before").cast("string"), F.lit(", now "), F.col("after").cast("string"), F.lit(")"))
    done = (F.col("shape") != "partial") & (F.col("after") > F.col("before"))
    answer = (
        F.when(F.col("shape") == "partial", F.concat(F.lit("Crafted "), F.array_join(F.transform("prereqs", _bare), ", "), F.lit(" for "), name, F.lit(", which is not made yet"), counts, F.lit(".")))
        .when(done & (F.col("shape") == "recovery") & (F.size("missing") > 0), F.concat(F.lit("The first try failed for want of "), F.array_join("missing", ", "), F.lit("; now "), name, F.lit(" is made"), counts, F.lit(".")))
        .when(done, F.concat(F.lit("Made "), name, counts, F.lit(".")))
        .otherwise(F.concat(F.lit("Could not make "), name, counts, F.lit(": "), F.coalesce(F.try_element_at("results", F.lit(-1)), F.lit("")), F.lit(".")))
    )
    first = traces.message("user", F.concat(F.lit("Craft "), F.replace(name, F.lit("_"), F.lit(" ")), F.lit(".")))
    rows = tasks.withColumn("steps", steps)
    return rows.select("task", F.concat(F.array(first), turns, F.array(traces.message("assistant", answer))).alias("messages"), done.alias("completed"))
