"""Lookup queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.names import ascii_fold, namespaced
from factloom.operators import lookup
from factloom.plans.base import query, table


@query("""
SELECT 'minecraft:' || upper(r_name) AS key, string_agg(n_name, ', ' ORDER BY n_name) AS result
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name
""")
def lookup_exact_ci(spark, sf):
    facts = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    facts = facts.select(namespaced(ascii_fold(F.col("r_name"))).alias("name"), "n_name")
    keys = table(spark, sf, "region").select(namespaced(F.upper("r_name")).alias("key"))
    return lookup.token_string(lookup.lookup_folded(keys, facts, "name"), ["key"], "n_name")


_RANKED = """
SELECT lower(p_brand) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_enchant' ELSE '_enchantment' END AS name,
  max(p_size) AS level FROM part WHERE p_size > 40 GROUP BY 1
"""


@query(f"""
WITH t AS ({_RANKED}), k AS (
  SELECT DISTINCT lower(p_brand) AS key FROM part UNION SELECT DISTINCT lower(p_brand) || '_enchant' FROM part UNION SELECT 'none'
)
SELECT key, CAST(coalesce((SELECT level FROM t WHERE name = key), (SELECT level FROM t WHERE name = key || '_enchant'),
  (SELECT level FROM t WHERE name = key || '_enchantment'),
  (SELECT level FROM t WHERE name = regexp_replace(key, '(_enchantment|_enchant)$', ''))) AS INTEGER) AS value FROM k
""")
def lookup_candidates_ranked(spark, sf):
    part = table(spark, sf, "part")
    ending = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "_enchant").otherwise("_enchantment")
    facts = part.where("p_size > 40").groupBy(F.concat(F.lower("p_brand"), ending).alias("name")).agg(F.max("p_size").alias("level"))
    brand = part.select(F.lower("p_brand").alias("key")).distinct()
    keys = brand.union(brand.select(F.concat("key", F.lit("_enchant")))).union(spark.sql("SELECT 'none' AS key"))
    return lookup.lookup_ranked(keys, facts, "name", "level", ("_enchant", "_enchantment"))


@query("""
SELECT k.key, p.p_size, p.p_retailprice FROM (SELECT DISTINCT l_partkey + 100 AS key FROM lineitem) k
LEFT JOIN part p ON p.p_partkey = k.key
""")
def lookup_scalar_batch(spark, sf):
    keys = table(spark, sf, "lineitem").select((F.col("l_partkey") + 100).alias("key"))
    return lookup.lookup_scalar(keys, table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


@query("""
SELECT l_partkey, l_suppkey, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS rank FROM (
    SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 3
""")
def lookup_topn_by_count(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return lookup.top_rows(counts, "l_partkey", [F.desc("n"), F.asc("l_suppkey")], 3)


_DROPS = """
SELECT 'minecraft:' || (CASE l_linenumber % 3 WHEN 0 THEN 'blocks/' WHEN 1 THEN 'entities/' ELSE 'chests/' END) || (l_suppkey % 50) AS source,
  'minecraft:' || (l_partkey % 50) AS item FROM lineitem
"""


@query(f"""
SELECT DISTINCT item, source FROM ({_DROPS})
WHERE (source LIKE 'minecraft:blocks/%' OR source LIKE 'minecraft:entities/%')
  AND split_part(source, '/', 2) <> replace(item, 'minecraft:', '')
""")
def reverse_lookup_excluding_self(spark, sf):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "blocks/").when(F.col("l_linenumber") % 3 == 1, "entities/").otherwise("chests/")
    drops = table(spark, sf, "lineitem").select(
        namespaced(F.concat(kind, (F.col("l_suppkey") % 50).cast("string"))).alias("source"),
        namespaced((F.col("l_partkey") % 50).cast("string")).alias("item"),
    )
    return lookup.reverse_sources(drops, "source", "item", ("blocks", "entities"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def membership_semi(spark, sf):
    facts = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def membership_anti(spark, sf):
    facts = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(facts, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
WITH r AS (SELECT DISTINCT lower(p_brand) || ':' || lower(split_part(p_name, ' ', 1)) AS id FROM part),
n AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS noun FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 2)) FROM part)
SELECT n.noun, min(r.id) AS id FROM n LEFT JOIN r ON split_part(r.id, ':', 2) = n.noun GROUP BY n.noun
""")
def noun_resolution(spark, sf):
    words = table(spark, sf, "part").select("p_brand", F.split(F.lower("p_name"), " ").alias("w"))
    first, second = F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.coalesce(F.get("w", F.lit(1)), F.lit(""))
    registry = words.select(F.concat(F.lower("p_brand"), F.lit(":"), first).alias("id")).distinct()
    return lookup.resolve_nouns(words.select(first.alias("noun")).union(words.select(second.alias("noun"))), registry)


_UNION = """
SELECT 'nation' AS tbl, CAST(n_nationkey AS VARCHAR) AS key, pos, token FROM (
  SELECT n_nationkey, 0 AS pos, n_name AS token FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation)
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 0, s_name FROM supplier
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), pos, token FROM (
  SELECT c_custkey, 0 AS pos, c_name AS token FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer)
"""


def _rows(spark, sf):
    return lookup.rows_union(
        {
            "nation": (table(spark, sf, "nation"), "n_nationkey", ["n_name", "n_regionkey"]),
            "supplier": (table(spark, sf, "supplier"), "s_suppkey", ["s_name"]),
            "customer": (table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        }
    )


@query(f"SELECT tbl, key, CAST(pos AS INTEGER) AS pos, token FROM ({_UNION})")
def oracle_rows_union(spark, sf):
    return _rows(spark, sf)


@query(f"""
SELECT k.key, k.tbl, coalesce(string_agg(token, ', ' ORDER BY pos), '(no rows)') AS result
FROM (SELECT DISTINCT 'customer' AS tbl, CAST(o_custkey + 1000 AS VARCHAR) AS key FROM orders) k
LEFT JOIN ({_UNION}) r ON r.tbl = k.tbl AND r.key = k.key GROUP BY ALL
""")
def result_token_string(spark, sf):
    keys = table(spark, sf, "orders").select(F.lit("customer").alias("tbl"), (F.col("o_custkey") + 1000).cast("string").alias("key")).distinct()
    return lookup.token_string(keys.join(_rows(spark, sf), ["tbl", "key"], "left"), ["tbl", "key"], "token", ["pos"])


@query("""
SELECT k.key, count(l_suppkey) > 0 AS found, coalesce(string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)), '') AS ingredients
FROM (SELECT p_partkey * 3 AS key FROM part) k LEFT JOIN lineitem ON l_partkey = k.key GROUP BY k.key
""")
def lookup_found_flag(spark, sf):
    """Ingredients of a key and whether there are any."""
    keys = table(spark, sf, "part").select((F.col("p_partkey") * 3).alias("key"))
    facts = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").cast("string").alias("s")).distinct()
    names = F.sort_array(F.collect_set("s"))
    return keys.join(facts, "key", "left").groupBy("key").agg((F.size(names) > 0).alias("found"), F.array_join(names, ", ").alias("ingredients"))
