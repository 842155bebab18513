"""Readers of report trees, line files and dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.calls import STRING
from factloom.operators.adapters import category_of, subject_of


def documents(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below the root, ``body``, ``category`` and ``id`` of every JSON file of a tree."""
    root = root.rstrip("/")
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    )
    bare = root.split("://", 1)[-1].removeprefix("file:")
    path = F.regexp_replace(F.substring_index(F.url_decode("file"), bare + "/", -1), "^/+", "")
    return placed(files.select(path.alias("path"), "body"))


def placed(docs: DataFrame) -> DataFrame:
    """``path, body`` documents with their ``category`` and ``id``."""
    return docs.withColumn("category", category_of(F.col("path"))).withColumn("id", subject_of(F.col("path")))


def strict(docs: DataFrame) -> DataFrame:
    """Raises at the first document that isn't JSON."""
    bad = F.try_parse_json("body").isNull()
    return docs.withColumn("body", F.when(bad, F.raise_error(F.concat(F.lit("not JSON: "), "path")).cast("string")).otherwise(F.col("body")))


def without_comments(body: Column) -> Column:
    """``//`` comments outside strings removed; one pass without recursion, however long the strings."""
    return F.regexp_replace(body, rf"({STRING})|//[^\r\n]*+", "$1")


def tolerant(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that parse once comments are gone, and those that don't."""
    clean = docs.withColumn("body", without_comments(F.col("body")))
    good = F.try_parse_json("body").isNotNull()
    return clean.where(good), clean.where(~good)


def registry_ids(docs: DataFrame) -> DataFrame:
    """``registry, id`` of a registry document."""
    entries = F.from_json("body", "map<string,struct<entries:map<string,string>>>")
    return docs.select(F.explode(entries).alias("registry", "r")).select(
        F.regexp_replace("registry", "^[^:]*:", "").alias("registry"), F.explode(F.map_keys("r.entries")).alias("id")
    )


def json_lines(spark: SparkSession, path: str, schema: str, comments: bool = False) -> DataFrame:
    """Rows of a line file; blank lines (and ``//`` lines, if asked for) are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comments:
        lines = lines.where(~F.ltrim("value").startswith("//"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def dump_rows(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """One array of a dump of several."""
    return spark.read.schema(f"{table} array<struct<{schema}>>").json(path, multiLine=True).select(F.inline(table))


def rows_of_source(spark: SparkSession, path: str, table: str, schema: str, source: str) -> DataFrame:
    """A dump's rows of one source."""
    return dump_rows(spark, path, table, schema).where(F.col("source") == source)


def leniently(docs: DataFrame) -> DataFrame:
    """Documents that are JSON; others are left out (A5)."""
    return docs.where(F.try_parse_json("body").isNotNull())


def pinned_version(manifest: DataFrame, version: str) -> DataFrame:
    """The entry of a version in a manifest's ``versions`` (no row if absent)."""
    versions = F.from_json(F.get_json_object("body", "$.versions"), "array<struct<id:string,url:string,sha1:string>>")
    return manifest.select(F.get(F.filter(versions, lambda v: v["id"] == version), F.lit(0)).alias("v")).where("v is not null").select("v.*")
