"""Aggregations and statistics of runs and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot_groups(slots: DataFrame, result: str, method: str, slot: str, ingredient: str) -> DataFrame:
    """Each result's slots as ``a/b, c``: the method named like the result, else the least; slots in order.

    The method is picked by a partial aggregate and joined back, so no result's
    rows meet in one place before they are grouped by slot.
    """
    rank = F.struct((F.col(method).cast("string") != F.col(result).cast("string")).alias("other"), F.col(method).alias("m"))
    chosen = slots.groupBy(result).agg(F.min(rank).alias("c")).select(result, F.col("c.m").alias(method))
    tokens = F.array_join(F.array_sort(F.collect_set(F.col(ingredient).cast("string"))), "/")
    groups = slots.join(chosen, [result, method]).groupBy(result, slot).agg(tokens.alias("alternatives"))
    ordered = F.array_sort(F.collect_list(F.struct(slot, "alternatives")))
    return groups.groupBy(result).agg(F.array_join(F.transform(ordered, lambda s: s["alternatives"]), ", ").alias("slots"))


def histogram(results: DataFrame, kind: str) -> DataFrame:
    return results.groupBy(kind).agg(F.count("*").alias("n"))


def floor_percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; null of nothing."""
    return F.when(whole > 0, F.floor(100 * part / whole)).cast("long")


def summary_rollup(results: DataFrame, kind: str, passed: Column) -> DataFrame:
    """Totals overall and by kind in one pass."""
    out = results.rollup(kind).agg(F.count("*").alias("total"), F.count_if(passed).alias("passed"))
    return out.withColumn("percent", floor_percent(F.col("passed"), F.col("total"))).withColumn(kind, F.coalesce(kind, F.lit("(all)")))


def coverage(expected: Column, answer: Column) -> tuple[Column, Column]:
    """Hits over expected, and what is missing (joined)."""
    folded = F.lower(answer)
    hits = F.filter(expected, lambda e: F.contains(folded, F.lower(e)))
    return F.try_divide(F.size(hits), F.size(expected)), F.array_join(F.array_except(expected, hits), ",")


def majority(votes: DataFrame, item: str, passed: Column) -> DataFrame:
    """Rejected if more than half of an item's votes reject it."""
    return votes.groupBy(item).agg(F.count_if(~passed).alias("rejects"), F.count("*").alias("votes")).withColumn(
        "admitted", ~(F.col("rejects") * 2 > F.col("votes"))
    )


def rejecting_issues(votes: DataFrame, item: str, order: str, passed: Column, issues: str) -> DataFrame:
    """As ``majority``, with the issues of the rejecting votes in the votes' order, each once; none of admitted items."""
    found = F.transform(F.array_sort(F.collect_list(F.when(~passed, F.struct(order, issues)))), lambda v: v[issues])
    out = votes.groupBy(item).agg(F.count_if(~passed).alias("rejects"), F.count("*").alias("votes"), F.array_distinct(F.flatten(found)).alias("issues"))
    admitted = ~(F.col("rejects") * 2 > F.col("votes"))
    return out.withColumn("admitted", admitted).withColumn("issues", F.when(admitted, F.array().cast("array<string>")).otherwise(F.col("issues")))


def finish_reasons(results: DataFrame, side: str, reason: str) -> DataFrame:
    """How often each reason ended an answer, by side; a missing one counts as unobserved."""
    return results.groupBy(side, F.coalesce(reason, F.lit("unobserved")).alias("reason")).agg(F.count("*").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over the rows that have both numbers; null where one of them doesn't vary."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two paired arms and the exact two-sided p of their binomial.

    The tail is summed by log-gamma terms of the discordant counts, so that no
    factorial overflows.
    """
    counts = pairs.agg(
        F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("b"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("c")
    )
    n, k = F.col("b") + F.col("c"), F.least("b", "c")
    step = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum")),
        # terms relative to the first: C(n, i) = C(n, i - 1) (n - i + 1) / i
        lambda acc, i: F.struct(
            (acc["log"] + F.log((n - i + 1) / i)).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.log((n - i + 1) / i) - n * F.log(F.lit(2.0)))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    tail = step - 1 + F.exp(-n * F.log(F.lit(2.0)))
    return counts.withColumn("p", F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail)))


def signature_groups(items: DataFrame, key: str, values: str) -> DataFrame:
    """Groups of keys that expect the same values, by the digest of the sorted values."""
    signed = items.withColumn("signature", F.sha2(F.array_join(F.array_sort(values), "\u0000"), 256))
    return signed.groupBy("signature").agg(F.countDistinct(key).alias("keys")).where("keys > 1")


def exposed_share(items: DataFrame, key: str, values: str) -> DataFrame:
    """``items, exposed, share``: keys that share their expected values with another key."""
    signed = items.withColumn("signature", F.sha2(F.array_join(F.array_sort(values), "\u0000"), 256))
    keys = signed.groupBy("signature").agg(F.countDistinct(key).alias("keys"))
    out = keys.agg(F.sum("keys").alias("items"), F.sum(F.when(F.col("keys") > 1, F.col("keys")).otherwise(0)).alias("exposed"))
    return out.select("items", "exposed", F.try_divide("exposed", "items").alias("share"))


def share_with_interval(hits: DataFrame, total: DataFrame) -> DataFrame:
    """Share of distinct hits with its normal interval."""
    p = F.col("hits") / F.col("n")
    half = 1.96 * F.sqrt(p * (1 - p) / F.col("n"))
    counts = hits.agg(F.count("*").alias("hits")).crossJoin(total.agg(F.count("*").alias("n")))  # one row each
    return counts.select("hits", "n", p.alias("share"), (p - half).alias("low"), (p + half).alias("high"))


def changed(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Items of two runs whose fields differ."""
    a, b = first.alias("a"), second.alias("b")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    return a.join(b, key).where(differs).select(key)


def shuffled_control(items: DataFrame, group: str, order: str, expected: str) -> DataFrame:
    """Each item with the expectation of the next of its group, as a control of a scorer."""
    w = Window.partitionBy(group).orderBy(order)
    return items.withColumn("other", F.lead(expected).over(w))
