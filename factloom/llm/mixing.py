"""Mixing sources to target weights, with DataFrame functions only.

The leaves of a tree domain -> language -> source have token counts. A budget
goes down the tree: a node's budget is shared among its children by weight, and
no child gets more than its capacity, which is its tokens times ``max_epochs``.
What a short child can't take is shared among its siblings by weight; only if a
whole node is short does its parent's level share the rest. A leaf's budget is
met by whole epochs and a prefix of one more, whose order is seeded by leaf
epoch and document id: the prefix has the documents whose running token sum
stays within what is left.

A node's children are shared out in the order of capacity to weight; where they
are many, ranges of that order are summed apart. Only leaf sums and one small part
of a leaf are ever ordered: the prefix's end is
found from token sums of ``BUCKETS`` equal parts of the order, the part in which
it lies is parted again, and so on until it has at most ``PART_ROWS`` documents;
these alone are ordered one by one. Texts are not shuffled.

Defined results: null texts have no tokens, very long ones are counted whole; null domains, languages and sources
count as empty strings; null ids order as empty strings; equal order keys (rows
that repeat an id in a leaf) are taken together or not at all; documents without
tokens cost nothing and come with their epochs; leaves of weight 0 are left out;
a leaf's budget is rounded down; an empty table gives an empty result; extra
columns pass through and may have any names, but for ``mix_domain``,
``mix_tokens`` and ``copies`` (in any case), whose place the result's own take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import column_of, discard, materialize

#: Share of all tokens that a mix has unless a caller says otherwise; the most epochs; the seed.
SHARE, MAX_EPOCHS, SEED = 0.5, 4, "mix"
#: Hex digits of the order key by which a part is parted, and the most documents that are ordered one by one.
DIGITS = 2
BUCKETS = 16**DIGITS
PART_ROWS = 10_000
#: Hex digits of the order key; documents that share all of them have equal keys.
KEY_DIGITS = 32
#: The columns that the result adds.
ADDED = ("mix_domain", "mix_tokens", "copies")
#: Leaves up to which their table is broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 50_000
#: Children of a node that are put in order together; more are summed in ranges of the order.
NODE_ROWS = 10_000
#: Weights by level; values not named weigh 1.
WEIGHTS = {"domain": {}, "lang": {"en": 2.0}, "source": {}}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """Four domains by the first hex digit of the source's MD5."""
    return F.concat(F.lit("d"), F.translate(F.left(F.md5(source.cast("binary")), F.lit(1)), "0123456789abcdef", "0000111122223333"))


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    named = weights.get(level) or {}
    value = F.lit(1.0)
    for name, w in named.items():
        value = F.when(F.col(level) == name, F.lit(float(w))).otherwise(value)
    return value


def _share(nodes: DataFrame, parent: list[str], level: str, weights: dict) -> DataFrame:
    """Each child's part of its parent's ``budget``: by weight, at most ``capacity``, the rest to siblings.

    In the order of capacity to weight the children up to some place take their
    capacity and the others share what is left; a child takes its capacity if
    that ratio is at most the share of those not before it.
    """
    nodes = nodes.withColumn("w", _weight(level, weights)).where("w > 0").withColumn("ratio", F.col("capacity") / F.col("w"))
    nodes = materialize(nodes, "nodes")
    most = nodes.groupBy(*parent).count().agg(F.max("count").alias("m")).first()["m"] or 0
    sums = _sums_in_ranges if most > NODE_ROWS else _sums_in_a_window
    nodes = sums(nodes, parent, level).withColumn("rate", (F.col("budget") - F.col("before")) / F.col("after"))
    nodes = nodes.withColumn("full", F.col("ratio") <= F.col("rate"))
    # a row for each parent
    rates = materialize(nodes.where("not full").groupBy(*parent).agg(F.max("rate").alias("shared")), "rates")
    nodes = nodes.join(rates, parent, "left") if parent else nodes.join(F.broadcast(rates), how="left")
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("w") * F.col("shared"))
    return nodes.withColumn("budget", budget).drop("w", "ratio", "rate", "full", "before", "after", "shared")


def _sums_in_a_window(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Capacities ``before`` each child and weights from it on (``after``), of few children."""
    order = Window.partitionBy(*parent).orderBy("ratio", level)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    return nodes.withColumn("before", F.coalesce(F.sum("capacity").over(before), F.lit(0.0))).withColumn("after", F.sum("w").over(after))


def _sums_in_ranges(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """The same of any number of children: ranges of the order are summed by themselves, then the ranges of a parent."""
    keys = [*parent, "ratio", level]
    spread = nodes.repartitionByRange(*keys).withColumn("range", F.spark_partition_id())
    spread = materialize(spread, "ranges")
    inside = Window.partitionBy("range", *parent).orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    here = spread.withColumn("cap_here", earlier("capacity", inside)).withColumn("w_here", earlier("w", inside))
    # a row for each range of a parent
    ranges = spread.groupBy("range", *parent).agg(F.sum("capacity").alias("c"), F.sum("w").alias("v"))
    whole = Window.partitionBy(*parent)
    upto = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        "range", *parent, earlier("c", upto).alias("cap_before"), (F.sum("v").over(whole) - earlier("v", upto)).alias("w_after")
    )
    found = here.join(materialize(ranges, "range-sums"), ["range", *parent])
    found = found.withColumn("before", F.col("cap_before") + F.col("cap_here")).withColumn("after", F.col("w_after") - F.col("w_here"))
    return found.drop("range", "cap_here", "w_here", "cap_before", "w_after")


def plan(leaves: DataFrame, share: float, max_epochs: int, weights: dict) -> DataFrame:
    """Budgets of ``domain, lang, source, tokens``: whole epochs and what is left for a prefix."""
    leaves = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    total = leaves.agg((F.floor(F.sum("tokens").cast("double") * share)).cast("double").alias("budget"))
    nodes = None
    for depth, level in enumerate(LEVELS):
        names = list(LEVELS[: depth + 1])
        caps = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"))
        # one row, or the level above: a child meets its parent's budget
        caps = caps.crossJoin(F.broadcast(total)) if nodes is None else caps.join(nodes, names[:-1])
        nodes = _share(caps, names[:-1], level, weights).select(*names, "budget")
    quota = F.floor("budget").cast("long")
    return (
        leaves.join(nodes, list(LEVELS))
        .where("tokens > 0")
        .select(*LEVELS, "tokens", quota.alias("quota"))
        .withColumn("epochs", F.least(F.floor(F.col("quota") / F.col("tokens")), F.lit(max_epochs)).cast("long"))
        .withColumn(
            "rest",
            F.when(F.col("epochs") < max_epochs, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("long"),
        )
    )


def _bounded(leaves: DataFrame) -> DataFrame:
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def order_key(epoch: Column, doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    weights: dict[str, dict[str, float]] | None = None,
    domain: Column | None = None,
    id_col: str = "doc_id",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) of the mix, with ``mix_domain, mix_tokens`` and the ``copies`` of each."""
    weights = WEIGHTS if weights is None else weights
    leaf = {
        "domain": F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("")),
        "lang": F.coalesce(F.col("lang"), F.lit("")),
        "source": F.coalesce(F.col("source"), F.lit("")),
    }
    rows = docs.select(
        F.col(id_col).alias("id"), *(c.alias(k) for k, c in leaf.items()), tokens_of(F.col("text")).alias("n")
    )
    rows = materialize(rows, "token-counts")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    planned = materialize(plan(leaves, share, max_epochs, weights), "leaves")
    names = list(LEVELS)

    # the part of the order in which each prefix ends, made smaller until it can be ordered
    ends = planned.where("rest > 0").select(*names, "epochs", F.lit("").alias("part"), F.col("rest").alias("left"))
    written, digits = None, 0

    def inside() -> DataFrame:
        return rows.join(_bounded(ends), names).withColumn("key", order_key(F.col("epochs"), F.col("id"))).where(
            F.col("key").startswith(F.col("part"))
        )

    while digits < KEY_DIGITS:
        digits += DIGITS
        upto = Window.partitionBy(*names).orderBy("part")
        sums = (
            inside()
            .groupBy(*names, "epochs", "left", F.left("key", F.lit(digits)).alias("part"))
            .agg(F.sum("n").alias("n"), F.count("*").alias("size"))
            .withColumn("upto", F.sum("n").over(upto))
        )
        last = F.min(F.struct("part", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "size")).alias("e")
        ends = materialize(sums.where("upto > left").groupBy(*names, "epochs").agg(last).select(*names, "epochs", "e.*"), "ends")
        if written is not None:
            discard(written)
        written = ends
        if (ends.agg(F.max("size").alias("m")).first()["m"] or 0) <= PART_ROWS:
            break
    # the documents of that part alone are ordered one by one, equal keys as one
    running = Window.partitionBy(*names).orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        inside()
        .groupBy(*names, "left", "key")
        .agg(F.sum("n").alias("n"))
        .withColumn("running", F.sum("n").over(running))
        .where(F.col("running") <= F.col("left"))
        .groupBy(*names)
        .agg(F.max("key").alias("last"))
    )
    cuts = planned.join(ends.select(*names, "part"), names, "left").join(last, names, "left").select(
        *names,
        "epochs",
        # without a prefix nothing is below the cut; a part of which nothing fits ends before its first key
        F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("last", "part", F.lit("g"))).alias("cut"),
    )
    cuts = materialize(cuts, "cuts")
    if written is not None:
        discard(written)
    discard(planned)
    discard(rows)
    columns = [c for c in (keep or docs.columns) if c.lower() not in ADDED]
    # the row's own columns are held in a struct, so that no name of theirs meets one of the mix
    out = docs.select(
        F.struct(*(column_of(c) for c in columns)).alias("row"),
        *(c.alias(k) for k, c in leaf.items()),
        tokens_of(F.col("text")).alias("n"),
        column_of(id_col).alias("id"),
    )
    copies = (F.col("epochs") + (order_key(F.col("epochs"), F.col("id")) <= F.col("cut")).cast("long")).cast("long")
    return (
        out.join(_bounded(cuts), names)
        .withColumn("copies", copies)
        .where("copies > 0")
        .select(*(F.col("row").getField(c).alias(c) for c in columns), F.col("domain").alias("mix_domain"), F.col("n").alias("mix_tokens"), "copies")
    )
