"""Join, graph and set queries on the driver's tables (E, F, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import graph, relations
from factloom.plans.base import query, table


_PLACEMENTS = """
WITH placed AS (
  SELECT o_orderkey AS placement, o_custkey AS feature,
    max_by(l_quantity, l_linenumber * 100 + l_quantity) FILTER (WHERE l_linenumber % 2 = 1) AS height,
    max_by(l_quantity, l_linenumber * 100 + l_quantity) FILTER (WHERE l_linenumber % 2 = 0) AS cnt
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT placement, block, height, cnt AS count FROM placed
JOIN (SELECT c_custkey, unnest([c_name, c_mktsegment]) AS block FROM customer) ON feature = c_custkey
"""


@query(_PLACEMENTS)
def placement_join_explode(spark, sf):
    """All orders with all customers."""
    kind = F.when(F.col("l_linenumber") % 2 == 1, "height").otherwise("count")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", kind.alias("kind"), F.col("l_quantity").alias("value")))).alias("modifiers")
    )
    placed = table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    placed = placed.select(F.col("o_orderkey").alias("placement"), F.col("o_custkey").alias("feature"), "modifiers")
    features = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature"), F.array("c_name", "c_mktsegment").alias("blocks"))
    return relations.place_features(placed, features)


@query(_PLACEMENTS)
def placement_join_whole(spark, sf):
    """The same under its earlier name."""
    return placement_join_explode(spark, sf)


@query("""
WITH r AS (SELECT DISTINCT l_partkey AS item, l_suppkey * 7 AS ing FROM lineitem)
SELECT a.item, min(a.ing) AS hop FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.item = a.ing) AND a.ing <> a.item GROUP BY a.item
""")
def craftable_semi(spark, sf):
    """Sub-ingredients that are made themselves, without the item itself."""
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") * 7).alias("ing")).distinct()
    made = r.select(F.col("item").alias("ing")).distinct()
    return r.join(made, "ing", "left_semi").where("ing <> item").groupBy("item").agg(F.min("ing").alias("hop"))


@query("""
WITH r AS (SELECT DISTINCT l_partkey AS item, l_suppkey * 7 AS ing FROM lineitem)
SELECT a.item, min(a.ing * 1000000 + b.ing) AS hop FROM r a JOIN r b ON a.ing = b.item AND a.ing <> a.item GROUP BY a.item
""")
def two_hop_self(spark, sf):
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_suppkey") * 7).alias("ing")).distinct()
    # the best second hop of each item first, so that no pair is made in vain
    a, b = r.where("ing <> item").alias("a"), r.groupBy("item").agg(F.min("ing").alias("ing")).alias("b")
    return relations.two_hop(a, b, F.col("a.ing") == F.col("b.item"), "a.item", F.col("a.ing") * 1000000 + F.col("b.ing"))


@query("""
SELECT n_nationkey AS nation, min(o_orderkey) AS hop FROM nation JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey
""")
def two_hop_cross(spark, sf):
    first = table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    first = first.select(F.col("n_nationkey").alias("nation"), "c_custkey")
    second = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return relations.two_hop(first, second, F.col("c_custkey") == F.col("o_custkey"), "nation", F.col("o_orderkey"))


@query("""
SELECT s_suppkey, min(p_partkey) AS hop FROM supplier JOIN part ON replace('src/' || s_suppkey, 'src/', 'Brand#') = p_brand
GROUP BY s_suppkey
""")
def two_hop_rewritten_key(spark, sf):
    sources = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("src/"), F.col("s_suppkey").cast("string")).alias("source"))
    key = F.regexp_replace("source", "^src/", "Brand#")
    second = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    return relations.two_hop(sources, second, key == F.col("p_brand"), "s_suppkey", F.col("p_partkey"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def heldout_anti(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def indist_semi(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("""
SELECT CAST(count(*) FILTER (WHERE a.doc_id IS NULL OR b.doc_id IS NULL) AS BIGINT) AS unpaired,
  CAST(count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.verdict IS DISTINCT FROM b.verdict) AS BIGINT) AS differ_verdict
FROM (SELECT doc_id, quality AS verdict FROM labels) a
FULL JOIN (SELECT CASE WHEN doc_id % 10 = 3 THEN -1 - doc_id ELSE doc_id END AS doc_id, 1 - toxic AS verdict FROM labels) b ON a.doc_id = b.doc_id
""")
def paired_zip_validate(spark, sf):
    labels = table(spark, sf, "labels")
    left = labels.select("doc_id", F.col("quality").alias("verdict"))
    key = F.col("doc_id")  # a tenth of the rows has ids without a partner
    right = labels.select(F.when(key % 10 == 3, -1 - key).otherwise(key).alias("doc_id"), (1 - F.col("toxic")).alias("verdict"))
    return relations.zip_validate(left, right, "doc_id", ["verdict"])


@query("""
WITH e AS (SELECT l_orderkey, list_sort(list(l_linestatus)) AS a, list_sort(list(CASE WHEN l_linenumber = 3 THEN 'X' ELSE l_linestatus END)) AS b
  FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(a, '') AS want, array_to_string(b, '') AS got FROM e WHERE a <> b
""")
def field_diff(spark, sf):
    lines = table(spark, sf, "lineitem")
    want = lines.groupBy("l_orderkey").agg(F.collect_list("l_linestatus").alias("value")).withColumn("field", F.lit("status"))
    altered = F.when(F.col("l_linenumber") == 3, "X").otherwise(F.col("l_linestatus"))
    got = lines.groupBy("l_orderkey").agg(F.collect_list(altered).alias("value")).withColumn("field", F.lit("status"))
    d = relations.field_diff(want, got, "l_orderkey")
    return d.select("l_orderkey", F.array_join(F.sort_array("value"), "").alias("want"), F.array_join(F.sort_array("claim"), "").alias("got"))


_SETS = """
SELECT DISTINCT ON (o_custkey, vals) o_custkey, okey, vals FROM (
  SELECT o_custkey, o_orderkey AS okey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS vals
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) ORDER BY o_custkey, vals, okey
"""


@query(f"""
WITH s AS ({_SETS})
SELECT a.o_custkey, a.okey AS part, b.okey AS whole FROM s a JOIN s b ON a.o_custkey = b.o_custkey
WHERE len(a.vals) < len(b.vals) AND list_has_all(b.vals, a.vals)
""")
def containment_pairs(spark, sf):
    lines = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    sets = lines.groupBy("o_custkey", "o_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("vals"))
    sets = sets.groupBy("o_custkey", "vals").agg(F.min("o_orderkey").alias("okey"))
    return relations.containment_pairs(sets, "o_custkey", "okey")


@query("""
SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM lineitem i WHERE i.l_suppkey = l.l_suppkey AND i.l_partkey = l.l_partkey AND i.l_returnflag = 'R')
""")
def missing_inventory(spark, sf):
    lines = table(spark, sf, "lineitem")
    have = lines.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey")
    return lines.join(have, ["l_suppkey", "l_partkey"], "left_anti").select("l_orderkey", "l_partkey").distinct()


@query("""
SELECT vec_id, round(d, 6) AS distance FROM (
  SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.05) * (CAST(x AS DOUBLE) - 0.05)))) AS d FROM embeddings)
WHERE d <= 1.05
""")
def nearest_within_radius(spark, sf):
    found = relations.within_radius(table(spark, sf, "embeddings"), [0.05] * 64, 1.05, "embedding")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


_CLOSURE = """
WITH RECURSIVE e AS (
  SELECT p_partkey AS tag, p_partkey // 2 AS ref FROM part WHERE p_partkey > 1 UNION ALL SELECT 7, 30 UNION ALL SELECT 1, 5),
r AS (SELECT tag, ref FROM e UNION SELECT r.tag, e.ref FROM r JOIN e ON r.ref = e.tag),
m AS (SELECT p_partkey AS tag, p_brand AS member FROM part)
SELECT tag, member FROM m UNION SELECT r.tag, m.member FROM r JOIN m ON r.ref = m.tag
"""


@query(_CLOSURE)
def tag_closure(spark, sf):
    """All parts, with two cycles."""
    part = table(spark, sf, "part")
    edges = part.where("p_partkey > 1").selectExpr("p_partkey AS tag", "p_partkey div 2 AS ref")
    edges = edges.union(spark.sql("SELECT 7L, 30L UNION ALL SELECT 1L, 5L"))
    return graph.closure(edges, part.select(F.col("p_partkey").alias("tag"), F.col("p_brand").alias("member")))


@query(_CLOSURE)
def tag_closure_whole(spark, sf):
    """The same under its earlier name."""
    return tag_closure(spark, sf)


@query("""
WITH RECURSIVE d AS (
  SELECT p_partkey AS k, 0 AS depth FROM part WHERE p_partkey = 1 UNION ALL
  SELECT p_partkey, depth + 1 FROM part JOIN d ON p_partkey // 2 = k AND p_partkey > 1)
SELECT CAST(k AS VARCHAR) AS item, CAST(depth AS INTEGER) AS depth FROM d
UNION ALL SELECT x, CASE WHEN x = 'z' THEN 1 END FROM (SELECT unnest(['x', 'y', 'z']) AS x)
""")
def dag_depth(spark, sf):
    """Depth by parents, with a two-cycle (null) and an item whose only ingredient is an unresolved tag."""
    part = table(spark, sf, "part").where("p_partkey > 1")
    recipes = part.selectExpr("CAST(p_partkey AS STRING) AS item", "CAST(p_partkey div 2 AS STRING) AS ingredient")
    recipes = recipes.union(spark.sql("SELECT 'x', 'y' UNION ALL SELECT 'y', 'x' UNION ALL SELECT 'z', '#none'"))
    return graph.depths(recipes, spark.createDataFrame([], "tag string, member string"))


@query("""
WITH RECURSIVE l AS (
  SELECT p_partkey AS k, 0 AS level FROM part WHERE p_partkey <= 3 UNION ALL
  SELECT p_partkey, greatest(a.level, 0) + 1 FROM part JOIN l a ON p_partkey // 2 = a.k AND p_partkey > 3 AND p_partkey % 7 <> 0)
SELECT k AS item, CAST(level AS INTEGER) AS level FROM l
""")
def reachability_division(spark, sf):
    """Each part needs its half and its quarter; every seventh needs something that nobody has."""
    part = table(spark, sf, "part").where("p_partkey > 3")
    recipes = part.selectExpr("p_partkey AS recipe", "p_partkey AS item", "explode(array(p_partkey div 2, greatest(p_partkey div 4, 1L), if(p_partkey % 7 = 0, -1L, p_partkey div 2))) AS ingredient")
    return graph.reachable(recipes, table(spark, sf, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("item")))


@query("SELECT 'c' AS family, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier UNION ALL SELECT 'n', n_name FROM nation")
def union_all_families(spark, sf):
    parts = [("c", "customer", "c_name"), ("s", "supplier", "s_name"), ("n", "nation", "n_name")]
    frames = [table(spark, sf, t).select(F.lit(k).alias("family"), F.col(c).alias("name")) for k, t, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT n_name AS id FROM nation UNION SELECT r_name FROM region")
def registry_union(spark, sf):
    """Ids of all registries, once."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("id")).union(table(spark, sf, "region").select("r_name")).distinct()


_PAIRS = "SELECT l_orderkey, list(l_returnflag) AS a, list(CASE WHEN l_linenumber = 2 THEN 'N' ELSE l_returnflag END) AS b FROM lineitem GROUP BY l_orderkey"


def _pairs(spark, sf):
    changed = F.when(F.col("l_linenumber") == 2, "N").otherwise(F.col("l_returnflag"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(changed).alias("b"))


@query(f"SELECT l_orderkey, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same FROM ({_PAIRS})")
def set_equality(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", relations.set_equal(F.col("a"), F.col("b")).alias("same"))


@query(f"SELECT l_orderkey, list_sort(a) = list_sort(b) AS same FROM ({_PAIRS})")
def multiset_equality(spark, sf):
    return _pairs(spark, sf).select("l_orderkey", relations.multiset_equal(F.col("a"), F.col("b")).alias("same"))


@query("""
SELECT l_orderkey, string_agg(f, '' ORDER BY k, f) AS flags FROM (
  SELECT l_orderkey, l_returnflag AS f, min(l_linenumber) AS k FROM lineitem GROUP BY ALL) GROUP BY l_orderkey
""")
def ordered_dedup(spark, sf):
    lines = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.array_distinct(F.transform(lines, lambda x: x["l_returnflag"])), "").alias("flags")
    )


@query("SELECT DISTINCT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, sf):
    return table(spark, sf, "part").select("p_partkey").subtract(table(spark, sf, "lineitem").where("l_quantity > 45").select("l_partkey"))


@query("SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def scan_intersection(spark, sf):
    return table(spark, sf, "labels").where("quality = 0").select("doc_id").intersect(table(spark, sf, "documents").where("n_chars > 500").select("doc_id"))


@query("""
SELECT request_id, confirm_id, user_id FROM (
  SELECT r.event_id AS request_id, c.event_id AS confirm_id, r.user_id, row_number() OVER (PARTITION BY r.event_id ORDER BY c.ts, c.event_id) AS k
  FROM events r JOIN events c ON r.user_id = c.user_id AND r.event_id % 3 = c.event_id % 3 AND c.ts > r.ts AND epoch(c.ts) - epoch(r.ts) <= 86400
  WHERE r.event_type = 'click' AND c.event_type = 'purchase') WHERE k = 1
""")
def confirm_window_join(spark, sf):
    e = table(spark, sf, "events").withColumn("nonce", F.col("event_id") % 3)
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", "nonce", "ts")
    said = e.where("event_type = 'purchase'").select(F.col("event_id").alias("confirm_id"), "user_id", "nonce", "ts")
    return relations.confirmed_requests(asked, said, 86400)
