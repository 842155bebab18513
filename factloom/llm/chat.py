"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and the others as named users; only the assistant's own
words are learned from, the mask leaves out everything else. ``system`` turns are
context: they open no perspective and keep their role in each.

A turn's place in its conversation is counted in two steps, so that a long
conversation is never gathered: the turns are range-partitioned and sorted by
(conversation, turn, role, text) and written with their places inside their
partition; the numbers of turns in the conversation's earlier partitions, a row
for each, are then added. ``segments`` has each dialogue whole, turn by turn, in the
same shape at any length; nothing gathers a dialogue, so it may have any number of
turns and participants, and texts of any length. ``windows`` renders
training windows of at most ``TURNS`` turns from it, one row each.

Defined results: a null role is the speaker ``unknown``, a null text is empty,
null turns come first, and rows without conversation id take no part; turns with
equal numbers are ordered by role and text; repeated rows are turns of their
own; a conversation of system turns alone has no perspective; control marks that
a text or role itself holds are escaped with one backslash more than they have,
so that no two texts are written alike; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialize

#: Turns of a window.
TURNS = 1024
OPEN, SHUT, CLOSE = "<|turn ", "|>", "<|end|>\n"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, speaker, body, place``: every turn with its place in its conversation."""

    def clean(name: str, default: str):
        text = F.coalesce(F.col(name).cast("string"), F.lit(default))
        return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")

    def clean_name(name: str, default: str):
        # a name stands inside a mark, so what shuts a mark is escaped too
        return F.regexp_replace(clean(name, default), r"\|(\\*)>", r"|\\$1>")

    keys = ("conv_id", "turn", "speaker", "body")
    rows = (
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            clean_name("role", "unknown").alias("speaker"),
            clean("text", "").alias("body"),
        )
        .where("conv_id is not null")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "speaker", "body", F.spark_partition_id().alias("part"))
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = None, 0
        for b in batches:
            local = []
            for c in b.column(0).to_pylist():
                if c != now:
                    now, n = c, 0
                local.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "local"])

    rows = materialize(
        rows.mapInArrow(number, "conv_id long, speaker string, body string, part int, local long"), "turns"
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        rows.groupBy("conv_id", "part")
        .agg(F.count("*").alias("n"))
        .select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        .where("before > 0")  # conversations that cross partitions alone need it
    )
    return rows.join(parts, ["conv_id", "part"], "left").select(
        "conv_id", "speaker", "body", (F.col("local") + F.coalesce("before", F.lit(0))).alias("place")
    )


def segments(conversations: DataFrame) -> DataFrame:
    """A row for each conversation, perspective and turn: ``role, name, segment``, and ``learn`` with its range.

    A dialogue is the concatenation of its segments by ``place``; ``learn_start``
    and ``learn_end`` are code points inside the segment.
    """
    rows = ordered_turns(conversations)
    system = F.lit("system")
    people = rows.where(F.col("speaker") != system).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, system).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    head = F.concat(
        F.lit(OPEN), F.col("r"), F.when(F.col("r") == "user", F.concat(F.lit(" name="), "speaker")).otherwise(F.lit("")), F.lit(SHUT)
    )
    return (
        rows.join(people, "conv_id")
        .select("*", role.alias("r"))
        .select("*", head.alias("h"))
        .select(
            "conv_id",
            "perspective",
            "place",
            F.col("r").alias("role"),
            F.col("speaker").alias("name"),
            F.concat("h", "body", F.lit(CLOSE)).alias("segment"),
            own.alias("learn"),
            F.char_length("h").cast("long").alias("learn_start"),
            # the closing mark is learned too, the line feed isn't
            (F.char_length("h") + F.when(own, F.char_length("body") + len(CLOSE) - 1).otherwise(0)).cast("long").alias("learn_end"),
        )
    )


def windows(conversations: DataFrame, turns: int = TURNS) -> DataFrame:
    """Rendered dialogues in windows of at most ``turns`` turns, which join to the whole.

    ``conv_id, perspective, part, n_turns, text, learn`` where ``learn`` lists the
    ranges to learn from as ``start:end`` in code points of ``text``, comma-joined.
    """
    grouped = (
        segments(conversations)
        .groupBy("conv_id", "perspective", F.floor(F.col("place") / turns).cast("long").alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "segment", "learn", "learn_start", "learn_end"))).alias("s"))
    )
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("ranges"))
    walked = F.aggregate(
        "s",
        empty,
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["segment"])).alias("at"),
            F.when(
                x["learn"],
                F.concat(
                    acc["ranges"],
                    F.array(F.concat_ws(":", acc["at"] + x["learn_start"], acc["at"] + x["learn_end"])),
                ),
            )
            .otherwise(acc["ranges"])
            .alias("ranges"),
        ),
        lambda acc: F.array_join(acc["ranges"], ","),
    )
    return grouped.select(
        "conv_id",
        "perspective",
        "part",
        F.size("s").cast("long").alias("n_turns"),
        F.array_join("s.segment", "").alias("text"),
        walked.alias("learn"),
    )
