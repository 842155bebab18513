"""Composite queries on the driver's tables (K, C12, B2, B5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import gates, lookup, traces
from factloom.plans.base import query, table
from factloom.sources.scratch import written


@query("""
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id
""")
def messages_json(spark, sf):
    rows = traces.conversation_messages(table(spark, sf, "conversations"), "conv_id", "turn")
    text = F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"]))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join(text, "\n").alias("dialogue"))


_TRUTH = """
SELECT 'recipe' AS tbl, CAST(l_partkey AS VARCHAR) AS key, string_agg(DISTINCT 's' || l_suppkey, ', ' ORDER BY 's' || l_suppkey) AS result FROM lineitem GROUP BY l_partkey
"""


def _truth(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.lit("recipe").alias("tbl"), F.col("l_partkey").cast("string").alias("key"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("t"))
    return lookup.token_string(rows.distinct(), ["tbl", "key"], "t")


def _made(spark, sf, truth):
    keys = table(spark, sf, "part").select((F.col("p_partkey") + 50).alias("p"), F.lit("recipe").alias("tbl"), (F.col("p_partkey") + 50).cast("string").alias("key"))
    facts = keys.join(truth, ["tbl", "key"], "left").withColumn("result", F.coalesce("result", F.lit(lookup.NO_ROWS)))
    answer = F.when(F.col("result") == lookup.NO_ROWS, "There is no data on it.").otherwise(F.concat(F.lit("You need "), F.col("result")))
    out = traces.single_hop(facts.select("p", "key", "result"), F.concat(F.lit("What makes "), F.col("key"), F.lit("?")), "recipe", F.col("key"), F.col("result"), answer)
    return out.withColumn("trace_id", F.col("key").cast("long"))


@query(f"""
WITH f AS (SELECT p_partkey + 50 AS trace_id, coalesce(t.result, '(no rows)') AS r FROM part LEFT JOIN ({_TRUTH}) t ON t.key = CAST(p_partkey + 50 AS VARCHAR))
SELECT trace_id, CAST(4 AS BIGINT) AS n_messages, 'user|What makes ' || trace_id || '?'
  || chr(10) || 'assistant|<think>The recipe table has this.</think>' || chr(10) || '<tool_call>lookup(recipe, result_item=' || chr(39) || trace_id || chr(39) || ')</tool_call>'
  || chr(10) || 'user|<result>' || r || '</result>' || chr(10) || 'assistant|' || CASE WHEN r = '(no rows)' THEN 'There is no data on it.' ELSE 'You need ' || r END AS dialogue FROM f
""")
def trace_generate(spark, sf):
    """K1: one trace for each key, with the truth's result, message by message."""
    text = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])), "\n")
    made = _made(spark, sf, written(_truth(spark, sf), "truth"))
    return made.select("trace_id", F.size("messages").cast("long").alias("n_messages"), text.alias("dialogue"))


@query("SELECT p_partkey + 50 AS trace_id, (p_partkey + 50) % 5 <> 0 AS ok FROM part")
def trace_verify(spark, sf):
    """K2: generated traces verify; every fifth has been tampered with and doesn't."""
    truth = written(_truth(spark, sf), "truth")
    bad = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 2, "<result>s0, s999999</result>").otherwise(m["content"]).alias("content")))
    rows = _made(spark, sf, truth).withColumn("messages", F.when(F.col("trace_id") % 5 == 0, bad).otherwise(F.col("messages")))
    return traces.verify(rows, truth)


@query("SELECT p_partkey + 50 AS trace_id, (p_partkey + 50) % 3 <> 0 AS intact FROM part")
def trace_integrity(spark, sf):
    truth = written(_truth(spark, sf), "truth")
    rows = _made(spark, sf, truth).join(truth.select("key", "result"), "key", "left")
    recorded = F.array(F.when(F.col("trace_id") % 3 == 0, F.lit("other")).otherwise(F.coalesce("result", F.lit(lookup.NO_ROWS))))
    return traces.integrity(rows, recorded).select("trace_id", "intact")


_ANSWER = """
SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey, l_partkey, l_quantity, CASE l_partkey % 5 WHEN 0 THEN 'I cannot say which it is' WHEN 1 THEN ''
 WHEN 2 THEN 'It is used to make s' || l_suppkey WHEN 3 THEN 'It works because s' || l_suppkey || ' takes 10 ticks (3 seconds)' ELSE 'There is no data on s' || l_suppkey END AS answer FROM lineitem
"""


def _answers(spark, sf):
    s, m = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.col("l_partkey") % 5
    answer = (
        F.when(m == 0, "I cannot say which it is").when(m == 1, "").when(m == 2, F.concat(F.lit("It is used to make "), s))
        .when(m == 3, F.concat(F.lit("It works because "), s, F.lit(" takes 10 ticks (3 seconds)"))).otherwise(F.concat(F.lit("There is no data on "), s))
    )
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_suppkey", "l_partkey", "l_quantity", answer.alias("answer"))


@query(f"""
SELECT k, CASE WHEN l_suppkey % 11 = 0 THEN 'registry' WHEN answer = '' THEN 'answer_shape' WHEN l_partkey % 5 = 0 THEN 'refusal'
  WHEN l_suppkey % 7 = 0 THEN 'claim_shape' WHEN l_quantity > 40 THEN 'mismatch' END AS failure_kind FROM ({_ANSWER})
""")
def layered_verdict(spark, sf):
    claim = F.when(F.col("l_suppkey") % 7 != 0, F.when(F.col("l_quantity") > 40, F.lit(0.0)).otherwise(F.col("l_quantity")))
    v = gates.layered_fact_check(F.col("answer"), F.when(F.col("l_suppkey") % 11 == 0, 1).otherwise(0), claim, F.col("l_quantity"))
    return _answers(spark, sf).select("k", v["failure_kind"].alias("failure_kind"))


@query(f"""
SELECT k, CASE WHEN answer = '' THEN 'quality' WHEN l_partkey % 5 = 3 THEN 'numeric' WHEN l_suppkey % 13 = 0 THEN 'consistency'
  WHEN l_suppkey % 3 = 2 THEN 'vote' WHEN l_partkey % 5 = 2 AND l_suppkey % 4 = 0 THEN 'capability' END AS failure_kind FROM ({_ANSWER})
""")
def judge_order(spark, sf):
    told = F.when(F.col("l_suppkey") % 4 == 0, "contradicted: no").otherwise("unverified: lookup failed")
    v = gates.judge(F.col("answer"), F.col("l_suppkey") % 13 != 0, F.col("l_suppkey") % 3, F.lit(3), dict.fromkeys(("mechanism", "capability", "comparative"), told))
    return _answers(spark, sf).select("k", v["failure_kind"].alias("failure_kind"))


@query(f"""
SELECT k, CASE WHEN l_partkey % 2 = 0 THEN l_partkey % 5 = 4 WHEN l_partkey % 5 = 4 THEN false
  ELSE l_partkey % 5 IN (2, 3) AND (l_suppkey % 2 = 0 OR l_partkey % 5 = 2) END AS passed FROM ({_ANSWER})
""")
def scorer_by_category(spark, sf):
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    kind = F.when(F.col("l_partkey") % 2 == 0, "unknown").otherwise("known")
    category = F.when(F.col("l_suppkey") % 2 == 0, "scalar").otherwise("recipe")
    return _answers(spark, sf).select("k", traces.score(category, kind, F.col("answer"), F.array(s), s).alias("passed"))


@query("""
SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN v[1:2] = [1, 2] ELSE v[1] = 1 END AS good
FROM (SELECT l_orderkey, list_sort(list(l_linenumber)) AS v FROM lineitem GROUP BY 1)
""")
def call_contract(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    kind = F.when(F.col("l_orderkey") % 3 == 0, "usage_none").when(F.col("l_orderkey") % 3 == 1, "multihop").otherwise("known")
    return rows.select("l_orderkey", traces.contract(kind, F.col("v"), F.array(F.lit(1), F.lit(2))).alias("good"))


@query("""
WITH t AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS place, l_returnflag FROM lineitem),
h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS hop FROM t),
e AS (SELECT *, min(CASE WHEN l_returnflag <> 'R' THEN place END) OVER (PARTITION BY l_orderkey) AS answered_at FROM h WHERE hop <= 4)
SELECT l_orderkey, max(answered_at) AS answered_at, count(*) FILTER (WHERE answered_at IS NULL OR place < answered_at) AS n_calls,
  CASE WHEN max(answered_at) IS NULL THEN 'hop_limit' ELSE 'answered' END AS finish FROM e GROUP BY l_orderkey
""")
def hop_replay(spark, sf):
    """Calls up to the first turn that makes none; what comes behind it doesn't count."""
    text = F.when(F.col("l_returnflag") == "R", "<tool_call>lookup(tag, tag='x')</tool_call>").otherwise("answer")
    place = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    found = traces.replay(table(spark, sf, "lineitem").withColumn("place", place), "l_orderkey", "place", text, 4)
    return found.select("l_orderkey", "answered_at", "n_calls", "finish")


@query("""
SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS base, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END) AS tuned FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1 GROUP BY 1
""")
def side_by_side(spark, sf):
    """The answers of two sides beside each other."""
    rows = table(spark, sf, "orders").withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("tuned"))
    last = rows.groupBy("o_custkey", "side").agg(F.max("o_orderkey").alias("answer"))
    return traces.side_by_side(last, "o_custkey", "side", "answer", ["base", "tuned"])


@query("""
SELECT user_id, arg_max(event_type, ts * 1) AS event_type, max(event_id) AS event_id FROM (
  SELECT user_id, event_type, event_id, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY user_id
""")
def latest_state(spark, sf):
    """The last snapshot of each user."""
    return traces.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ' > ' ORDER BY o_orderdate, o_orderkey) AS steps FROM orders GROUP BY o_custkey
""")
def craft_steps(spark, sf):
    """The ordered steps of each task."""
    rows = table(spark, sf, "orders").withColumn("s", F.col("o_orderkey").cast("string"))
    return traces.craft_steps(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "s")


@query("""
SELECT lang, source, count(*) AS population, count(*) FILTER (WHERE n_chars > 200) AS attempted, count(*) FILTER (WHERE n_chars > 2000) AS actual FROM documents GROUP BY ALL
""")
def corpus_manifest(spark, sf):
    """Counts by bucket."""
    return table(spark, sf, "documents").groupBy("lang", "source").agg(
        F.count("*").alias("population"), F.count_if(F.col("n_chars") > 200).alias("attempted"), F.count_if(F.col("n_chars") > 2000).alias("actual")
    )


@query("""
SELECT p_partkey, least(greatest(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN -64 + p_size ELSE 319 - p_size * 8 END, -64), 200) AS y FROM part
""")
def height_clamp(spark, sf):
    from factloom.operators.adapters import clamp_height, resolve_height

    k, s = F.col("p_partkey") % 3, F.col("p_size")
    y = resolve_height(F.when(k == 0, s), F.when(k == 1, s), F.when(k == 2, s * 8), F.lit(-64), F.lit(319))
    return table(spark, sf, "part").select("p_partkey", clamp_height(y, F.lit(-64), F.lit(200)).alias("y"))


@query("""
SELECT l_orderkey, CAST(round_even(sum(l_linenumber * l_quantity) / sum(l_quantity), 0) AS INTEGER) AS count FROM lineitem GROUP BY l_orderkey
""")
def weighted_count_round(spark, sf):
    from factloom.operators.adapters import weighted_mean

    pairs = F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("value"), F.col("l_quantity").alias("weight")))
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(pairs.alias("v"))
    return rows.select("l_orderkey", F.bround(weighted_mean(F.col("v"))).cast("int").alias("count"))
