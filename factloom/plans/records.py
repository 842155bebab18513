"""Fact records of both dialects, over documents of mixed categories made from the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import facts, gates, tasks, topics
from factloom.plans.base import query, spread, table
from factloom.sources import tree
from factloom.sources.scratch import scratch_path, written
from factloom.sources.sinks import admitted_lines

_DATA = "data/minecraft"


def _cases(rows: DataFrame, key: str, cases: list[tuple[str, str]]) -> DataFrame:
    """``path, body`` of each row by the case that its key falls into; ``{n}`` and ``{s}`` are its key and size."""

    def fill(text: str):
        out = F.lit(text)
        for mark, column in (("{n}", F.col(key)), ("{s}", F.col("p_size"))):
            out = F.replace(out, F.lit(mark), column.cast("string"))
        return out

    pick = F.lit(None).cast("struct<path:string,body:string>")
    for i, (p, b) in enumerate(cases):  # a row fills its own case alone
        pick = F.when(F.col(key) % len(cases) == i, F.struct(fill(p).alias("path"), fill(b).alias("body"))).otherwise(pick)
    return rows.select(pick.alias("d")).select("d.*")


def report_documents(spark, sf) -> DataFrame:
    """A document of the first dialect for each part; one in ten lies where it doesn't count."""
    item = lambda n: f'{{"type": "minecraft:item", "name": "{n}"}}'
    cases = [
        (f"{_DATA}/recipe/r{{n}}.json", '{"type": "minecraft:crafting_shaped", "key": {"z": [{"item": "a:{s}"}, {"tag": "t:x"}, "a:{s}"], "a": "a:b"}, "result": {"id": "o:{s}", "count": 2}}'),
        (f"{_DATA}/loot_table/blocks/l{{n}}.json", f'{{"pools": [{{"entries": [{item("i:b")}, {{"type": "minecraft:group", "children": [{{"children": [{{"type": "minecraft:tag", "name": "t:{{s}}"}}, {item("i:b")}], "type": "minecraft:sequence"}}, {{"type": "minecraft:empty", "children": [{item("i:no")}]}}]}}]}}, {{}}]}}'),
        (f"{_DATA}/advancement/a/d{{n}}.json", '{"criteria": {"b": {}, "a{s}": {"x": 1}}}'),
        (f"{_DATA}/tags/item/t{{n}}.json", '{"values": ["m:{s}", {"id": "#m:a", "required": false}, "", {"no": 1}]}'),
        (f"{_DATA}/worldgen/structure/w{{n}}.json", '{"type": "minecraft:kind:of", "biomes": ["b:{s}", "b:x"], "step": "s"}'),
        (f"{_DATA}/enchantment/e{{n}}.json", '{"max_level": {s}, "weight": 5, "slots": ["feet", "chest"], "effects": {}}'),
        (f"{_DATA}/villager_trade/t/v{{n}}.json", '{"wants": {"id": "w:{s}"}, "gives": {"id": "g:x", "count": 3.0}, "max_uses": 16.0}'),
        (f"{_DATA}/jukebox_song/j{{n}}.json", '{"length_in_seconds": {s}.0, "comparator_output": 3, "sound_event": {"sound_id": "s"}}'),
        (f"{_DATA}/painting_variant/p{{n}}.json", '{"width": {s}, "height": 2}'),
        (f"{_DATA}/datapacks/d/{_DATA}/recipe/x{{n}}.json", '{"type": "minecraft:stonecutting", "ingredient": "x", "result": {"id": "y"}}'),
    ]
    # written, because conditions on the path would be pushed below and make every document once for each of their terms
    return written(_cases(spread(table(spark, sf, "part"), "p_partkey"), "p_partkey", cases), "documents")


@query("""
SELECT category, 'minecraft:' || name AS subject_id, fields FROM (
  SELECT 'recipe' AS category, 'r' || p_partkey AS name, '{"ingredient_groups":[["#t:x","a:' || p_size || '"],["a:b"]],"ingredients":["#t:x","a:' || p_size || '","a:b"],"recipe_type":"crafting_shaped","result_count":2,"result_item":"o:' || p_size || '"}' AS fields FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT 'loot_table', 'blocks/l' || p_partkey, '{"drops":["#t:' || p_size || '","i:b"]}' FROM part WHERE p_partkey % 10 = 1
  UNION ALL SELECT 'advancement', 'a/d' || p_partkey, '{"criteria_ids":["a' || p_size || '","b"]}' FROM part WHERE p_partkey % 10 = 2
  UNION ALL SELECT 'tag', 'item/t' || p_partkey, '{"members":["m:' || p_size || '","#m:a"]}' FROM part WHERE p_partkey % 10 = 3
  UNION ALL SELECT 'worldgen_structure', 'w' || p_partkey, '{"biomes":["b:' || p_size || '","b:x"],"step":"s","structure_type":"kind:of"}' FROM part WHERE p_partkey % 10 = 4
  UNION ALL SELECT 'enchantment', 'e' || p_partkey, '{"anvil_cost":null,"max_level":' || p_size || ',"slots":["chest","feet"],"weight":5}' FROM part WHERE p_partkey % 10 = 5
  UNION ALL SELECT 'villager_trade', 't/v' || p_partkey, '{"gives_count":3,"gives_item":"g:x","max_uses":16,"wants_count":1,"wants_item":"w:' || p_size || '","xp":null}' FROM part WHERE p_partkey % 10 = 6
  UNION ALL SELECT 'jukebox_song', 'j' || p_partkey, '{"comparator_output":3,"length_in_seconds":' || p_size || ',"sound_event":{"sound_id":"s"}}' FROM part WHERE p_partkey % 10 = 7
  UNION ALL SELECT 'painting_variant', 'p' || p_partkey, '{"height":2,"width":' || p_size || '}' FROM part WHERE p_partkey % 10 = 8)
""")
def fact_records(spark, sf):
    """One stream of the records of nine categories, fields as they are."""
    return facts.fact_records(report_documents(spark, sf)).select("category", "subject_id", F.to_json("fields").alias("fields"))


@query("""
SELECT category, count(*) AS files, CAST(sum(length(p) + 5) AS BIGINT) AS path_chars FROM (
  SELECT 'recipe' AS category, 'data/minecraft/recipe/r' || p_partkey AS p FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT 'worldgen_structure', 'data/minecraft/worldgen/structure/w' || p_partkey FROM part WHERE p_partkey % 10 = 4) GROUP BY category
""")
def report_tree(spark, sf):
    """A1, A3, B1: a tree with a file for each part, written whole and read by category; folders of others aren't walked."""
    root = scratch_path(spark, "tree")
    tree.write_tree(report_documents(spark, sf), root)
    read = tree.read_tree(spark, root).where("category in ('recipe', 'worldgen_structure')")
    return read.groupBy("category").agg(F.count("*").alias("files"), F.sum(F.char_length("path")).alias("path_chars"))


@query("""
SELECT category, count(*) AS records, CAST(sum(n) AS BIGINT) AS fields FROM (
  SELECT CASE p_partkey % 10 WHEN 0 THEN 'recipe' WHEN 1 THEN 'loot_table' WHEN 2 THEN 'advancement' WHEN 3 THEN 'tag' WHEN 4 THEN 'worldgen_structure'
    WHEN 5 THEN 'enchantment' WHEN 6 THEN 'villager_trade' WHEN 7 THEN 'jukebox_song' WHEN 8 THEN 'painting_variant' END AS category,
    CASE p_partkey % 10 WHEN 0 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 6 WHEN 7 THEN 3 WHEN 8 THEN 2 ELSE 1 END AS n FROM part)
WHERE category IS NOT NULL GROUP BY category
""")
def fact_record_counts(spark, sf):
    """Records and fields of each category."""
    names = F.size(F.json_object_keys(F.to_json("fields")))
    records = facts.fact_records(report_documents(spark, sf)).select("category", names.alias("n"))
    return records.groupBy("category").agg(F.count("*").alias("records"), F.sum("n").alias("fields"))


def pack_documents(spark, sf) -> DataFrame:
    """A document of the second dialect for each part, some with comments, some broken."""
    top = "pack/behavior_pack"
    leaf = lambda v, op="==": f'{{"test": "has_biome_tag", "operator": "{op}", "value": "{v}"}}'
    cases = [
        (f"{top}/recipes/r{{n}}.json", '{ // "shaped"\n"minecraft:recipe_shaped": {"key": {"x": {"tag": "t:b"}, "y": [{"item": "i:{s}"}]}, "result": [{"item": "r:{s}"}, {"item": "bucket"}]}}'),
        (f"{top}/entities/e{{n}}.json", '{"minecraft:entity": {"description": {"identifier": "i", "spawn_category": "c{s}", "is_spawnable": true}} // "end"}\n}'),
        (f"{top}/spawn_rules/s{{n}}.json", f'{{"minecraft:spawn_rules": {{"conditions": [{{"minecraft:biome_filter": [{leaf("a{s}")}, {{"any_of": [{{"all_of": {{"test": "has_biome_tag", "value": "b"}}}}, {leaf("n", "!=")}]}}, {{"none_of": {leaf("z")}}}]}}, {{}}]}}}}'),
        (f"{top}/trading/t{{n}}_trades.json", '{"tiers": [{"trades": [{"wants": [{"item": "x"}]}]}, {"trades": [{"wants": [{"item": "w{s}"}, {"item": "a"}, {}], "gives": [{"item": "g"}]}, {"wants": [{"item": "w"}], "gives": [{"item": "h{s}"}]}]}]}'),
        (f"{top}/biomes/b{{n}}.biome.json", '{"minecraft:biome": {"components": {"minecraft:climate": {"temperature": 0.5}, "minecraft:tags": {"tags": ["x", "y{s}"]}}}}'),
        (f"{top}/entities/broken{{n}}.json", '{"minecraft:entity": {"description": {"identifier": "i{s}"'),
    ]
    part = spread(table(spark, sf, "part"), "p_partkey")
    single = _cases(part, "p_partkey", cases)
    loot = part.select(
        F.concat(F.lit(f"{top}/loot_tables/l"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"),
        F.concat(
            F.lit('{"pools": [{"entries": [{"type": "item", "name": "i:'), F.col("p_size").cast("string"), F.lit('"}, {"type": "loot_table", "name": "loot_tables/l'),
            F.when(F.col("p_partkey") == 0, 2).otherwise(F.floor(F.col("p_partkey") / 4)).cast("string"), F.lit('.json"}]}]}'),
        ).alias("body"),
    )
    return written(single.unionByName(loot), "documents")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS a, CASE WHEN p_partkey = 0 THEN 2 ELSE p_partkey // 4 END AS b FROM part),
r AS (SELECT p_partkey AS a, p_partkey AS b FROM part UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
drops AS (SELECT r.a, list_sort(list(DISTINCT 'i:' || p_size)) AS d FROM r JOIN part ON r.b = p_partkey GROUP BY r.a)
SELECT category, 'minecraft:' || name AS subject_id, fields FROM (
  SELECT 'recipe' AS category, 'r' || p_partkey AS name, '{"ingredients":["i:' || p_size || '","t:b"],"recipe_type":"shaped","result_item":"r:' || p_size || '"}' AS fields FROM part WHERE p_partkey % 6 = 0
  UNION ALL SELECT 'entity', 'e' || p_partkey, '{"is_spawnable":true,"is_summonable":false,"spawn_category":"c' || p_size || '"}' FROM part WHERE p_partkey % 6 = 1
  UNION ALL SELECT 'spawn_rule', 's' || p_partkey, '{"biome_tags":["a' || p_size || '","b"]}' FROM part WHERE p_partkey % 6 = 2
  UNION ALL SELECT 'trading', 't' || p_partkey || '/tier1/trade0', '{"gives":["g"],"wants":["a","w' || p_size || '"]}' FROM part WHERE p_partkey % 6 = 3
  UNION ALL SELECT 'trading', 't' || p_partkey || '/tier1/trade1', '{"gives":["h' || p_size || '"],"wants":["w"]}' FROM part WHERE p_partkey % 6 = 3
  UNION ALL SELECT 'biome', 'b' || p_partkey, '{"tags":["x","y' || p_size || '"],"temperature":0.5}' FROM part WHERE p_partkey % 6 = 4
  UNION ALL SELECT 'loot_table', 'l' || a, '{"drops":["' || array_to_string(d, '","') || '"]}' FROM drops)
""")
def fact_records_alt(spark, sf):
    """The second dialect: comments, broken documents, several records of one document, references between tables in a cycle."""
    return facts.fact_records_alt(pack_documents(spark, sf)).select("category", "subject_id", F.to_json("fields").alias("fields"))


_PICK = "CAST('0x' || substr(sha256('{seed}' || chr(0) || {key}), 1, 8) AS BIGINT)"
_MEMBERS = """
p AS (SELECT s_suppkey AS k, s_nationkey AS g FROM supplier),
own AS (SELECT 'minecraft:g' || g AS tag, 'i' || k AS member FROM p UNION SELECT 'minecraft:g' || g, 'i' || (k % 7) FROM p),
m AS (SELECT tag, member FROM own UNION SELECT 'minecraft:all', member FROM own UNION SELECT 'minecraft:two', member FROM own WHERE tag IN ('minecraft:g1', 'minecraft:g2'))
"""


def tag_documents(spark, sf) -> DataFrame:
    """A tag for each nation with its suppliers, one of two of these, and one of all."""
    s = table(spark, sf, "supplier")
    items = lambda k: F.concat(F.lit('"i'), k.cast("string"), F.lit('"'))
    rows = s.select("s_nationkey", F.explode(F.array(items(F.col("s_suppkey")), items(F.col("s_suppkey") % 7))).alias("m"))
    # a nation's suppliers are one document of the report
    one = rows.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("l"))
    path = lambda n: F.concat(F.lit(f"{_DATA}/tags/"), n, F.lit(".json")).alias("path")
    body = lambda l: F.concat(F.lit('{"values": ['), l, F.lit("]}")).alias("body")  # noqa: E731, E741
    named = F.concat(F.lit("g"), F.col("s_nationkey").cast("string"))
    refs = one.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"#minecraft:g'), F.col("s_nationkey").cast("string"), F.lit('"')))), ", ").alias("l"))
    two = spark.range(1).select(F.lit('{"id": "#minecraft:g1"}, "#minecraft:g2"').alias("l"))
    return one.select(path(named), body(F.col("l"))).unionByName(refs.select(path(F.lit("all")), body(F.col("l")))).unionByName(two.select(path(F.lit("two")), body(F.col("l"))))


@query(f"""
WITH {_MEMBERS},
ring AS (SELECT member, row_number() OVER (ORDER BY sha256('questions' || chr(0) || member), member) - 1 AS place FROM (SELECT DISTINCT member FROM m)),
t AS (SELECT tag, {_PICK.format(seed="questions", key="tag")} % (SELECT count(*) FROM ring) AS start, {_PICK.format(seed="questionsform", key="tag")} % 2 = 1 AS negative FROM (SELECT DISTINCT tag FROM m)),
other AS (SELECT tag, arg_min(member, (place - start + (SELECT count(*) FROM ring)) % (SELECT count(*) FROM ring)) AS member FROM t CROSS JOIN ring
  WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.tag = t.tag AND m.member = ring.member) GROUP BY tag),
own1 AS (SELECT tag, arg_min(member, sha256('questions' || chr(0) || tag || '|' || member)) AS member FROM m GROUP BY tag)
SELECT t.tag AS subject_id, 'Does the tag ' || t.tag || ' have the member ' || CASE WHEN negative AND other.member IS NOT NULL THEN other.member ELSE own1.member END || '?' AS question,
  CASE WHEN negative AND other.member IS NOT NULL THEN 'no' ELSE 'yes' END AS expected
FROM t JOIN own1 USING (tag) LEFT JOIN other USING (tag)
""")
def membership_questions(spark, sf):
    """Members and, for about half of the tags, items that they have neither themselves nor through another tag."""
    records = facts.fact_records(tag_documents(spark, sf))
    return topics.questions(records).select("subject_id", "question", "expected")


@query(f"""
WITH d AS (SELECT p_partkey, p_partkey % 10 AS k, 'minecraft:' || CASE p_partkey % 10 WHEN 0 THEN 'r' WHEN 1 THEN 'blocks/l' WHEN 2 THEN 'a/d' WHEN 4 THEN 'w' WHEN 5 THEN 'e' WHEN 6 THEN 't/v' WHEN 7 THEN 'j' WHEN 8 THEN 'p' END || p_partkey AS s FROM part WHERE p_partkey % 10 NOT IN (3, 9))
SELECT s AS subject_id, CASE k WHEN 0 THEN 'Which items go into ' || s || '?' WHEN 1 THEN 'What may drop from ' || s || '?' WHEN 2 THEN 'Which criteria does the advancement ' || s || ' ask for?'
  WHEN 4 THEN 'In which biomes is the structure ' || s || ' found?' WHEN 7 THEN 'For how many seconds does the disc ' || s || ' play?' WHEN 8 THEN 'How wide and how high is the painting ' || s || '?'
  WHEN 5 THEN CASE WHEN f = 0 THEN 'Up to which level does the enchantment ' || s || ' go?' ELSE 'In which slots does the enchantment ' || s || ' work?' END
  ELSE CASE WHEN f = 0 THEN 'What does the villager ask for in the trade ' || s || ', and how many?' ELSE 'What is given in the trade ' || s || '?' END END AS question
FROM (SELECT *, {_PICK.format(seed="questions", key="s")} % 2 AS f FROM d)
""")
def category_questions(spark, sf):
    """A question for each record of the other eight categories."""
    records = facts.fact_records(report_documents(spark, sf)).where("category <> 'tag'")
    return topics.questions(records).select("subject_id", "question")


def _candidates(spark, sf) -> DataFrame:
    """Records with a candidate each: exact, reordered, changed, without claim, with a list for an answer, blank, refusing, of another type."""
    records = facts.fact_records(report_documents(spark, sf)).where("category in ('recipe', 'painting_variant', 'villager_trade')")
    rows = written(records.select("category", "subject_id", "fields", F.to_json("fields").alias("f")), "records")
    n = F.regexp_extract("subject_id", "([0-9]+)$", 1).cast("long")
    k = F.floor(n / 10) % 8
    turned = F.regexp_replace("f", r'"ingredients":\[("[^"]*"),("[^"]*"),("[^"]*")\]', '"ingredients":[$3,$1,$2]')
    turned = F.replace(F.replace(turned, F.lit('"height":2'), F.lit('"more":{},"height":2.0')), F.lit('"gives_count":3'), F.lit('"gives_count":3.00'))
    changed = F.regexp_replace("f", r'"(a:b|g:x)"', '"zz"')
    changed = F.replace(changed, F.lit('"height":2'), F.lit('"height":3'))
    typed = F.regexp_replace("f", r'("height"|"gives_count"|"result_count"):([0-9]+)', '$1:"$2"')
    claim = F.when(k == 1, turned).when(k == 2, changed).when(k == 3, "[]").when(k == 7, typed).otherwise(F.col("f"))
    answer = F.when(k == 4, '["x"]').when(k == 5, '"  "').when(k == 6, '"The fact does not provide any information about it."').otherwise('"These are its parts."')
    text = F.concat(F.lit('{"instruction": "q'), n.cast("string"), F.lit('", "answer": '), answer, F.lit(', "structured_claim": '), claim, F.lit("}"))
    return rows.select("category", "subject_id", "fields", n.alias("n"), F.parse_json(text).alias("candidate"))


_VERDICTS = """
SELECT p_partkey AS n, (p_partkey // 10) % 8 IN (0, 1) AS success, CASE (p_partkey // 10) % 8 WHEN 2 THEN 'fact_mismatch' WHEN 3 THEN 'malformed_claim' WHEN 4 THEN 'malformed_answer'
  WHEN 5 THEN 'malformed_answer' WHEN 6 THEN 'refusal_answer' WHEN 7 THEN 'fact_mismatch' END AS failure_kind FROM part WHERE p_partkey % 10 IN (0, 6, 8)
"""


@query(_VERDICTS)
def fact_verdicts(spark, sf):
    """Every field of a claim against its fact."""
    v = gates.fact_check(F.col("candidate"), F.col("fields"))
    return _candidates(spark, sf).select("n", v["success"].alias("success"), v["failure_kind"].alias("failure_kind"))


@query("""
SELECT p_partkey AS n, CASE WHEN k = 2 THEN CASE c WHEN 0 THEN 'ingredient_groups,ingredients' WHEN 6 THEN 'gives_item' ELSE 'height' END
  WHEN k = 3 THEN CASE c WHEN 0 THEN 'ingredient_groups,ingredients,recipe_type,result_count,result_item' WHEN 6 THEN 'gives_count,gives_item,max_uses,wants_count,wants_item' ELSE 'height,width' END
  WHEN k = 7 THEN CASE c WHEN 0 THEN 'result_count' WHEN 6 THEN 'gives_count' ELSE 'height' END ELSE '' END AS wrong
FROM (SELECT p_partkey, (p_partkey // 10) % 8 AS k, p_partkey % 10 AS c FROM part WHERE p_partkey % 10 IN (0, 6, 8))
""")
def differing_fields(spark, sf):
    """The fields that differ: lists as multisets, numbers by value, types apart; null where nothing is claimed is no difference."""
    claim = F.try_variant_get("candidate", "$.structured_claim", "variant")
    return _candidates(spark, sf).select("n", F.array_join(gates.differing_fields(F.col("fields"), claim), ",").alias("wrong"))


_TARGET, _RATIO, _AT_ONCE, _EMPTY = 40, 0.8, 6, 3
_RUNS = f"""
WITH RECURSIVE v AS ({_VERDICTS}),
a AS (SELECT n % 5 AS run, 'fact_seeded' AS lane, row_number() OVER (PARTITION BY n % 5 ORDER BY n) - 1 AS pos, n, success AND n % 5 <> 4 AS ok FROM v
  UNION ALL SELECT o_orderkey % 5, 'free_recall', row_number() OVER (PARTITION BY o_orderkey % 5 ORDER BY o_orderkey) - 1, o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 4 FROM orders),
s AS (SELECT x AS i, CASE WHEN round_even(x * {_RATIO}, 0) > round_even((x - 1) * {_RATIO}, 0) THEN 'fact_seeded' ELSE 'free_recall' END AS lane FROM (SELECT unnest(generate_series(1, (SELECT count(*) FROM a))) AS x)),
q AS (SELECT i, lane, row_number() OVER (PARTITION BY lane ORDER BY i) - 1 AS pos FROM s),
l AS (SELECT run, i, lane, n, ok FROM a JOIN q USING (lane, pos)),
g AS (SELECT *, i = row_number() OVER (PARTITION BY run ORDER BY i) AS dense FROM l),
r AS (SELECT DISTINCT run, CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS made, CAST(0 AS BIGINT) AS upto, CAST(0 AS BIGINT) AS admitted, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS misses FROM a
UNION ALL
SELECT run, batch + 1, upto, least(upto + size, have), got, total + got, CASE WHEN got = 0 THEN misses + 1 ELSE 0 END FROM (
  SELECT r.run, r.batch, r.upto, r.total, r.misses, least(greatest({_TARGET} - r.total, 1), {_AT_ONCE}) AS size,
    (SELECT count(*) FROM g WHERE g.run = r.run AND dense) AS have,
    (SELECT count(*) FROM g WHERE g.run = r.run AND dense AND ok AND g.i > r.upto AND g.i <= r.upto + least(greatest({_TARGET} - r.total, 1), {_AT_ONCE})) AS got
  FROM r) WHERE upto < have AND total < {_TARGET} AND misses < {_EMPTY}),
e AS (SELECT run, batch, upto - made AS size, made, upto, admitted, total, misses, row_number() OVER (PARTITION BY run ORDER BY batch DESC) = 1 AS last,
  (SELECT count(*) FROM g WHERE g.run = r.run AND g.i > r.made AND g.i <= r.upto AND g.lane = 'fact_seeded') AS first_lane, least(greatest({_TARGET} - (total - admitted), 1), {_AT_ONCE}) AS wanted FROM r WHERE batch >= 0)
"""


def _runs(spark, sf):
    candidates = _candidates(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    fact = candidates.select((F.col("n") % 5).alias("run"), F.lit("fact_seeded").alias("lane"), "n", "candidate", "fields", F.when(F.col("n") % 5 == 4, 1).otherwise(0).alias("unknown_ids"), F.lit(True).alias("consistent"), F.lit(0).alias("rejects"))
    o = table(spark, sf, "orders")
    said = F.concat(F.lit('{"instruction": "f'), F.col("o_orderkey").cast("string"), F.lit('", "answer": "Dig down and take what you find."}'))
    free = o.select(
        (F.col("o_orderkey") % 5).alias("run"), F.lit("free_recall").alias("lane"), F.col("o_orderkey").alias("n"), F.parse_json(said).alias("candidate"), none("variant").alias("fields"), F.lit(0).alias("unknown_ids"),
        (F.col("o_orderkey") % 3 == 0).alias("consistent"), F.when(F.col("o_orderkey") % 5 == 4, 2).otherwise(1).alias("rejects"),
    )
    rows = written(fact.unionByName(free).withColumn("pos", (F.row_number().over(Window.partitionBy("run", "lane").orderBy("n")) - 1).cast("long")), "candidates")
    rows = spread(rows, "n", 50_000).withColumns({"votes": F.lit(3), **dict.fromkeys(("mechanism", "capability", "comparative"), F.lit("unverified"))})
    return tasks.verified_run(rows, "run", _TARGET, _RATIO, _AT_ONCE, _EMPTY)


@query(_RUNS + f"""
SELECT run, batch, size, first_lane, admitted, total,
  CASE WHEN size < wanted THEN 'exhausted' WHEN total >= {_TARGET} THEN 'complete' WHEN misses >= {_EMPTY} THEN 'aborted' WHEN last THEN 'exhausted' ELSE 'running' END AS state FROM e
""")
def verified_batches(spark, sf):
    """Batches, lanes and the state of runs whose candidates are verified inside."""
    return _runs(spark, sf)[0]


@query(_RUNS + """
SELECT CASE lane WHEN 'fact_seeded' THEN 'q' ELSE 'f' END || n AS instruction, CASE lane WHEN 'fact_seeded' THEN 'static_oracle' ELSE 'adversarial_judge' END AS method
FROM g JOIN e ON e.run = g.run AND g.i > e.made AND g.i <= e.upto WHERE ok
""")
def verified_lines(spark, sf):
    """The lines that the runs admit."""
    lines = admitted_lines(_runs(spark, sf)[1])
    return lines.select(F.get_json_object("value", "$.instruction").alias("instruction"), F.get_json_object("value", "$.verification.method").alias("method"))


@query("""
SELECT CASE k WHEN 0 THEN 'recipe' WHEN 1 THEN 'loot_table' WHEN 5 THEN 'enchantment' WHEN 6 THEN 'villager_trade' WHEN 7 THEN 'jukebox_song' ELSE 'painting_variant' END AS category,
  CASE k WHEN 0 THEN 'Which items go into ' || s || '? Name them all.' WHEN 1 THEN 'What may drop from ' || s || '?' WHEN 5 THEN 'Up to which level does the enchantment ' || s || ' go?'
    WHEN 6 THEN 'What does the villager of the trade ' || s || ' ask for, and what is given?' WHEN 7 THEN 'For how many seconds does the disc ' || s || ' play?' ELSE 'How wide and how high is the painting ' || s || '?' END AS question,
  CASE k WHEN 0 THEN '#t:x,a:' || p_size || ',a:b' WHEN 1 THEN '#t:' || p_size || ',i:b' WHEN 6 THEN 'w:' || p_size || ',g:x' WHEN 8 THEN p_size || ',2' ELSE CAST(p_size AS VARCHAR) END AS expected,
  CASE k WHEN 0 THEN 'contains_all' WHEN 1 THEN 'contains_any' WHEN 6 THEN 'contains_all_pair' WHEN 8 THEN 'contains_all_pair' ELSE 'int_equals' END AS score_kind
FROM (SELECT *, p_partkey % 10 AS k, 'minecraft:' || CASE p_partkey % 10 WHEN 0 THEN 'r' WHEN 1 THEN 'blocks/l' WHEN 5 THEN 'e' WHEN 6 THEN 't/v' WHEN 7 THEN 'j' ELSE 'p' END || p_partkey AS s FROM part WHERE p_partkey % 10 IN (0, 1, 5, 6, 7, 8))
""")
def evaluation_facts(spark, sf):
    """Questions, expected values and the way of scoring from the records of six categories."""
    made = topics.evaluation_facts(facts.fact_records(report_documents(spark, sf)))
    return made.select("category", "question", F.array_join("expected", ",").alias("expected"), "score_kind")
