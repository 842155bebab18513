"""The corpus pipeline: documents go through the stages in order, each written and read again.

Stages work on whole texts, however long, and on columns of any names beside their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, mixing, neardup, pii, toxicity
from factloom.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; weights are learned from the labelled rows among ``docs``.

    A null or empty text has the score of the bias alone; without a labelled row all
    scores are 0.5 and everything stays. Repeated rows are judged each for itself,
    columns stay as they are, and an empty table stays empty.
    """
    return toxicity.remove(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) stays: that of the smallest id.

    Texts that are null or without words are linked with nothing and stay, as do rows
    without id; of rows that share the id that stays and the set of shingles one stays,
    unlike ones stay. Columns stay as they
    are, and an empty table stays empty.
    """
    return neardup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go, if these are at least a twentieth of their words.

    Texts that are null or without words are clean; repeated rows are judged each for
    itself; without benchmark items everything stays, and an empty table stays empty.
    """
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds; of overlapping spans the first stands.

    All rows stay, repeated ones too; null texts stay null, empty ones empty.
    """
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with ``mix_domain``, ``mix_tokens`` and the number of ``copies``.

    Null texts have no tokens and come with their leaf's whole epochs; null languages
    and sources count as empty; rows that repeat an id in a leaf come together or not
    at all; an empty table gives an empty mix.
    """
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: Learned weights aren't SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
