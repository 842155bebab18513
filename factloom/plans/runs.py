"""Queries on runs: batches, evidence, scenarios, dispatch, live tasks, craft traces, prerequisites, files (A8-A10, B3-B6, C10, E10, E15, F3-F5, G, H, J27, J34, K10, K15-K26)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from factloom.functions import reshaping
from factloom.operators import adapters, evaluation, evidence, generation, graph, relations, runs, tasks, traces
from factloom.plans.base import ORACLES, query, table
from factloom.sources import reports, sinks, tree
from factloom.sources.scratch import put_text, scratch_path, written

_BATCHES = "SELECT user_id % 7 AS run, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS admitted FROM events GROUP BY ALL"


def _batches(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 7).alias("run"), F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("admitted")
    )


@query(f"""
WITH b AS (SELECT *, sum(admitted) OVER w AS total, sum(n) OVER w AS asked, sum((admitted > 0)::INT) OVER w AS g FROM ({_BATCHES}) WINDOW w AS (PARTITION BY run ORDER BY day)),
e AS (SELECT *, count(*) FILTER (WHERE admitted = 0) OVER (PARTITION BY run, g ORDER BY day) AS empty FROM b),
d AS (SELECT *, coalesce(bool_or(total >= 12 OR empty >= 3) OVER (PARTITION BY run ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM e)
SELECT run, day, n, admitted, CAST(total AS BIGINT) AS total, CASE WHEN total >= 12 THEN 'complete' WHEN empty >= 3 THEN 'aborted' ELSE 'running' END AS state,
  CAST(least(greatest(round_even(CAST(asked * 0.8 AS DECIMAL(38, 6)), 0) - round_even(CAST((asked - n) * 0.8 AS DECIMAL(38, 6)), 0), 0), n) AS BIGINT) AS first_lane FROM d WHERE NOT over
""")
def batch_loop(spark, sf):
    """Batches with their lanes until the target is met or three in a row admit nothing."""
    return tasks.batch_loop(_batches(spark, sf), "run", "day", "n", "admitted", 12, 0.8, 3)


@query("""
WITH i AS (SELECT event_id, user_id, event_type IN ('error', 'click') AS t, sum((event_type NOT IN ('error', 'click'))::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
r AS (SELECT *, sum(t::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM i)
SELECT event_id, coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3, false) AS open FROM r
""")
def circuit_states(spark, sf):
    """After three timeouts in a row a batch's breaker stays open."""
    return tasks.broken_circuits(table(spark, sf, "events"), ["user_id"], "event_id", F.col("event_type").isin("error", "click")).select("event_id", "open")


@query("""
WITH a AS (SELECT doc_id AS k, quality AS q, doc_id % 97 AS seed, 'p' || doc_id AS prompt FROM labels),
b AS (SELECT CASE WHEN doc_id % 19 = 0 THEN -1 - doc_id ELSE doc_id END AS k, CASE WHEN doc_id % 11 = 0 THEN 7 ELSE quality END AS q, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 97 END AS seed,
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'p' || doc_id END AS prompt FROM labels)
SELECT count(*) AS rows, count(*) FILTER (WHERE a.k IS NULL OR b.k IS NULL) AS unpaired, count(*) FILTER (WHERE a.q <> b.q) AS identity,
  count(*) FILTER (WHERE a.seed <> b.seed) AS seed, count(*) FILTER (WHERE a.prompt <> b.prompt) AS prompt FROM a FULL JOIN b USING (k)
""")
def paired_evidence(spark, sf):
    """Two arms by position: partners, identity, seeds and first prompts."""
    k = F.col("doc_id")
    rows = table(spark, sf, "labels").select(k.alias("k"), F.col("quality").alias("q"), (k % 97).alias("seed"), F.concat(F.lit("p"), k.cast("string")).alias("prompt"))
    other = rows.withColumns(
        {"k": F.when(F.col("k") % 19 == 0, -1 - F.col("k")).otherwise(F.col("k")), "q": F.when(F.col("k") % 11 == 0, 7).otherwise(F.col("q")), "seed": F.when(F.col("k") % 13 == 0, -1).otherwise(F.col("seed")), "prompt": F.when(F.col("k") % 17 == 0, "").otherwise(F.col("prompt"))}
    )
    return evidence.pairing(rows, other, "k", ["q"], "seed", "prompt")


@query("""
SELECT c_name AS name, CASE WHEN c_custkey % 5 <> 1 THEN sha256(c_name) END AS was, CASE c_custkey % 5 WHEN 2 THEN NULL WHEN 3 THEN sha256('x') ELSE sha256(c_name) END AS "is"
FROM customer WHERE c_custkey % 5 IN (1, 2, 3)
""")
def input_drift(spark, sf):
    """Inputs that appeared, vanished or changed between two bindings."""
    digest = F.sha2("c_name", 256)
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("name"), (F.col("c_custkey") % 5).alias("m"), digest.alias("sha256"))
    after = rows.where("m <> 2").withColumn("sha256", F.when(F.col("m") == 3, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return evidence.drifted(rows.where("m <> 1"), after)


_FACT_ROWS = """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'recipe' WHEN 1 THEN 'enchantment' ELSE 'song' END AS category, 'minecraft:p' || p_partkey AS subject, 'What of ' || p_partkey || '?' AS question,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS expected, 'int_equals' AS score_kind, p_size <= 25 AS trained FROM part
"""


def _fact_rows(spark, sf, held_out: bool):
    k = F.col("p_partkey")
    facts = table(spark, sf, "part").select(
        F.when(k % 3 == 0, "recipe").when(k % 3 == 1, "enchantment").otherwise("song").alias("category"),
        F.concat(F.lit("minecraft:p"), k.cast("string")).alias("subject"),
        F.concat(F.lit("What of "), k.cast("string"), F.lit("?")).alias("question"),
        F.when(k % 7 != 0, F.array(F.col("p_size").cast("string"))).alias("expected"),
        F.lit("int_equals").alias("score_kind"),
    )
    trained = table(spark, sf, "part").where("p_size <= 25").select(F.concat(F.lit("minecraft:p"), F.col("p_partkey").cast("string")).alias("subject"))
    found = generation.fact_items(facts, trained, 40, held_out)
    return found.withColumn("expected", F.array_join("expected", ","))


_PICKED = """
SELECT category, subject, question, expected, score_kind FROM (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('facts' || chr(0) || subject), subject) AS k FROM ({}) WHERE {} AND expected IS NOT NULL) WHERE k <= 13
"""


@query(_PICKED.format(_FACT_ROWS, "NOT trained") + " UNION ALL " + " UNION ALL ".join(f"SELECT 'anchor', '{s}', '{q}', '{','.join(e)}', '{k}'" for s, q, e, k in generation.ANCHORS))
def heldout_fact_items(spark, sf):
    """Facts that weren't trained on, a quota for each category, and the anchors."""
    return _fact_rows(spark, sf, True)


@query(_PICKED.format(_FACT_ROWS, "trained"))
def trained_fact_items(spark, sf):
    """Facts that were trained on."""
    return _fact_rows(spark, sf, False)


def _pick(name: str, values: tuple) -> str:
    listed = ", ".join("'" + v + "'" for v in values)
    return f"[{listed}][CAST('0x' || substr(sha256('scenarios{name}' || chr(0) || s_suppkey), 1, 8) AS BIGINT) % {len(values)} + 1]"


def _number(name: str, low: int, high: int) -> str:
    return f"CAST('0x' || substr(sha256('scenarios{name}' || chr(0) || s_suppkey), 1, 8) AS BIGINT) % {high - low + 1} + {low}"


_FILES = generation.SCENARIO_FILES


@query(f"""
WITH h AS (SELECT s_suppkey, {_pick("kind", generation.SCENARIOS)} AS scenario, {_pick("file", tuple(f for f in _FILES if f.endswith((".yaml", ".json"))))} AS config,
  {_pick("file", tuple(f for f in _FILES if f.endswith(".py")))} AS code, {_pick("file", _FILES)} AS f, {_pick("setting", generation.SETTINGS)} AS setting,
  {_pick("function", generation.FUNCTIONS)} AS fn, {_pick("folder", generation.FOLDERS)} AS folder, {_number("value", 1, 200)} AS value, {_number("lines", 10, 500)} AS lines,
  {_number("passed", 1, 40)} AS passed, {_number("failed", 0, 3)} AS failed FROM supplier),
p AS (SELECT s_suppkey, scenario,
  CASE scenario WHEN 'setting' THEN 'What is ' || setting || ' in ' || config || '?' WHEN 'function' THEN 'What does ' || fn || ' in ' || code || ' do?'
    WHEN 'lines' THEN 'How many lines has ' || f || '?' WHEN 'tests' THEN 'Do the tests pass?' ELSE 'What is in ' || folder || '?' END AS task,
  CASE scenario WHEN 'setting' THEN 'read_file(path="' || config || '")' WHEN 'function' THEN 'read_file(path="' || code || '")' WHEN 'lines' THEN 'run_command(cmd="wc -l ' || f || '")'
    WHEN 'tests' THEN 'run_command(cmd="pytest -q")' ELSE 'run_command(cmd="ls ' || folder || '/")' END AS call,
  CASE scenario WHEN 'setting' THEN setting || ': ' || value WHEN 'function' THEN 'def ' || fn || '(rows): return sorted(rows)' WHEN 'lines' THEN lines || ' ' || f
    WHEN 'tests' THEN passed || ' passed' || CASE WHEN failed > 0 THEN ', ' || failed || ' failed' ELSE '' END ELSE f END AS result,
  CASE scenario WHEN 'setting' THEN setting || ' is ' || value || '.' WHEN 'function' THEN fn || ' sorts its rows.' WHEN 'lines' THEN f || ' has ' || lines || ' lines.'
    WHEN 'tests' THEN CASE WHEN failed = 0 THEN 'Yes, all ' || passed || ' pass.' ELSE 'No, ' || failed || ' fail.' END ELSE folder || ' holds ' || f || '.' END AS answer FROM h)
SELECT s_suppkey, scenario, 1 AS step, 'Task: ' || task AS instruction, '<thought>' || chr(10) || 'A tool can tell.' || chr(10) || '</thought>' || chr(10) || 'TOOL_CALL: ' || call AS response FROM p
UNION ALL SELECT s_suppkey, scenario, 2, 'Task: ' || task || chr(10) || 'Tool result: ' || result,
  '<thought>' || chr(10) || 'The tool says: ' || result || chr(10) || '</thought>' || chr(10) || 'FINAL: ' || answer FROM p
""")
def tool_scenarios(spark, sf):
    """Two rows for each scenario, five kinds."""
    return generation.scenarios(table(spark, sf, "supplier"), "s_suppkey")


_TOOL = "CASE user_id % 4 WHEN 0 THEN 'mine' WHEN 1 THEN 'attack' WHEN 2 THEN 'fly' ELSE 'place' END"


@query(f"""
WITH e AS (SELECT event_id AS id, user_id, {_TOOL} AS tool, user_id % 5 AS nonce, ts, event_type = 'click' AS asks FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT *, CASE WHEN tool = 'fly' THEN 'unknown' WHEN tool = 'attack' THEN 'disabled' ELSE 'waits' END AS state FROM e),
u AS (SELECT id, user_id, nonce, ts, asks, last_value(CASE WHEN asks THEN id END IGNORE NULLS) OVER w AS rid, last_value(CASE WHEN asks THEN user_id END IGNORE NULLS) OVER w AS ruser,
  last_value(CASE WHEN asks THEN ts END IGNORE NULLS) OVER w AS rts FROM s WHERE NOT asks OR state = 'waits'
  WINDOW w AS (PARTITION BY nonce ORDER BY ts, asks, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (SELECT *, rid IS NOT NULL AND epoch(ts) - epoch(rts) <= 7200 AND user_id = ruser AS good FROM u WHERE NOT asks),
k AS (SELECT *, row_number() OVER (PARTITION BY rid, good ORDER BY ts, id) AS k FROM c),
o AS (SELECT id, rid, CASE WHEN rid IS NULL THEN 'none' WHEN epoch(ts) - epoch(rts) > 7200 THEN 'expired' WHEN NOT good THEN 'other_user' WHEN k = 1 THEN 'executed' ELSE 'used' END AS outcome FROM k)
SELECT id, 'confirm' AS kind, outcome, rid AS partner FROM o
UNION ALL SELECT s.id, 'request', CASE WHEN state <> 'waits' THEN state WHEN o.id IS NOT NULL THEN 'executed' ELSE 'unconfirmed' END, o.id
FROM s LEFT JOIN o ON o.rid = s.id AND o.outcome = 'executed' WHERE asks
""")
def dispatcher_outcomes(spark, sf):
    """Tiers, times to live, users and nonces that serve once."""
    u = F.col("user_id")
    tool = F.when(u % 4 == 0, "mine").when(u % 4 == 1, "attack").when(u % 4 == 2, "fly").otherwise("place")
    e = table(spark, sf, "events").withColumns({"tool": tool, "nonce": u % 5})
    asked = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "user_id", "tool", "nonce", "ts")
    said = e.where("event_type = 'purchase'").select(F.col("event_id").alias("confirm_id"), "user_id", "nonce", "ts")
    return relations.dispatch(asked, said, (2,), 7200)


def _dispatched_events(spark, sf, events):
    u = F.col("user_id")
    tool = F.when(u % 4 == 0, "mine").when(u % 4 == 1, "attack").when(u % 4 == 2, "fly").otherwise("place")
    return events.where("event_type in ('click', 'purchase')").select(
        F.col("event_id").alias("id"), (F.col("event_type") == "click").alias("asks"), u.alias("user"), tool.alias("tool"), (u % 5).alias("nonce"), "ts"
    )


@query(ORACLES["dispatcher_outcomes"])
def dispatcher_stream(spark, sf):
    """The same as a stream, one-shot nonces with timers in event time; a last row moves the watermark past all others."""
    from factloom.streaming import confirmations

    events = table(spark, sf, "events")
    folder = scratch_path(spark, "events")
    rows = _dispatched_events(spark, sf, events)
    rows.write.parquet(folder)
    last = F.lit("2200-01-01 00:00:00").cast("timestamp").cast(dict(rows.dtypes)["ts"])
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(True).alias("asks"), F.lit(-1).cast("long").alias("user"), F.lit("mine").alias("tool"), F.lit(-1).cast("long").alias("nonce"), last.alias("ts"))
    end.write.mode("append").parquet(folder)
    was = spark.conf.get(confirmations.STATE_STORE[0], None)
    spark.conf.set(*confirmations.STATE_STORE)
    try:
        stream = confirmations.dispatch_stream(spark.readStream.schema(rows.schema).parquet(folder), (2,), "1 minute", 7200)
        out, state = scratch_path(spark, "outcomes"), scratch_path(spark, "state")
        stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.unset(confirmations.STATE_STORE[0]) if was is None else spark.conf.set(confirmations.STATE_STORE[0], was)
    found = spark.read.parquet(out).where("id <> '-1'")
    return found.select(F.col("id").cast("long").alias("id"), "kind", "outcome", F.col("partner").cast("long").alias("partner"))


@query("""
SELECT c_custkey AS id, 'stick x' || (c_custkey % 9) || ', iron_helmet x1' AS inventory, CASE WHEN c_custkey % 2 = 0 THEN 'iron_helmet' END AS helmet, NULL AS boots,
  CASE WHEN c_custkey % 3 = 0 THEN 'stick' END AS mainhand, c_acctbal AS x, n_name AS biome
FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END
""".replace("NULL AS boots", "CAST(NULL AS VARCHAR) AS boots"))
def state_snapshots(spark, sf):
    """Inventory, place, armour by slot and the biome's name."""
    k = F.col("c_custkey")
    slot = lambda n, name, c: F.struct(n.cast("int").alias("slot"), name.alias("name"), c.cast("int").alias("count"))
    empty = slot(F.lit(8), F.lit(None).cast("string"), F.lit(0))
    slots = F.array(slot(F.when(k % 2 == 0, 5).otherwise(40), F.lit("iron_helmet"), F.lit(1)), empty, slot(F.lit(1), F.lit("stick"), k % 9))
    held = F.when(k % 3 == 0, F.struct(F.lit("stick").alias("name"), F.lit(1).alias("count")))
    states = table(spark, sf, "customer").select(
        k.alias("id"), slots.alias("slots"), held.alias("held"), F.col("c_acctbal").alias("x"), F.lit(64.0).alias("y"), F.lit(0.0).alias("z"), F.lit(20).alias("health"), F.lit(18).alias("food"),
        F.when(k % 10 == 0, 99).otherwise(F.col("c_nationkey")).alias("biome_id"),
    )
    biomes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("biome_id"), F.col("n_name").alias("name"))
    s = tasks.snapshots(states, biomes)
    listed = F.array_join(F.transform("inventory", lambda i: F.concat(i["name"], F.lit(" x"), i["count"].cast("string"))), ", ")
    return s.select(
        "id", listed.alias("inventory"), F.col("equipped.helmet.name").alias("helmet"), F.col("equipped.boots.name").alias("boots"),
        F.col("equipped.mainhand.name").alias("mainhand"), F.col("position.x").alias("x"), F.col("biome.name").alias("biome"),
    )


@query("""
WITH RECURSIVE t AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS hop FROM events),
k AS (SELECT *, CASE event_type WHEN 'click' THEN 'action' WHEN 'error' THEN 'action' WHEN 'view' THEN 'lookup' WHEN 'signup' THEN 'unknown' ELSE 'end' END AS kind,
  event_type || CASE WHEN event_type = 'click' THEN event_id % 2 ELSE 0 END AS call, event_type = 'error' OR (event_type = 'click' AND value < 30) AS failed FROM t WHERE hop < 8),
o AS (SELECT * FROM (SELECT *, coalesce(bool_or(kind = 'end') OVER (PARTITION BY user_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM k) WHERE NOT over),
f AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS hop, '' AS kind, false AS guarded, false AS counts, CAST([] AS VARCHAR[]) AS bad FROM o
UNION ALL
SELECT o.user_id, o.hop, o.kind, o.kind = 'action' AND list_contains(bad, call), o.kind = 'action' AND failed AND NOT list_contains(bad, call),
  CASE WHEN o.kind <> 'action' OR list_contains(bad, call) THEN bad WHEN failed THEN list_append(bad, call) WHEN event_type = 'click' THEN list_filter(bad, lambda x: x NOT LIKE 'click%') ELSE bad END
FROM f JOIN o ON o.user_id = f.user_id AND o.hop = f.hop + 1),
c AS (SELECT user_id, count(*) FILTER (WHERE kind NOT IN ('end', '')) AS hops, count(*) FILTER (WHERE counts) AS failed, count(*) FILTER (WHERE guarded) AS repeats,
  count(*) FILTER (WHERE kind = 'unknown') AS unknown FROM f GROUP BY user_id)
SELECT c_custkey AS task, c_nationkey AS bucket, coalesce(hops, 0) AS hops, coalesce(failed, 0) AS failed, coalesce(repeats, 0) AS repeats, coalesce(unknown, 0) AS unknown,
  c_custkey % 13 <> 0 AND c_acctbal > 5000 AS verified, c_custkey % 13 = 0 AS crashed FROM customer LEFT JOIN c ON user_id = c_custkey
""")
def live_tasks(spark, sf):
    """Hops, failures, pointless repeats and calls of nothing, by task; crashed ones stay."""
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind == "click", F.concat(F.lit("<tool_call>action(craft, item='stick', count="), (F.col("event_id") % 2).cast("string"), F.lit(")</tool_call>")))
        .when(kind == "error", "<tool_call>action(goto_block, block='x', radius=16)</tool_call>")
        .when(kind == "view", "<tool_call>lookup(recipe, result_item='x')</tool_call>")
        .when(kind == "signup", "<tool_call>prompt(help)</tool_call>")
        .otherwise("Done.")
    )
    result = F.when((kind == "error") | ((kind == "click") & (value < 30)), '{"reason": "no"}').otherwise('{"crafted": 1}')
    from pyspark.sql import Window

    hop = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    turns = table(spark, sf, "events").select(F.col("user_id").alias("task"), hop.alias("hop"), text.alias("text"), result.alias("result"))
    listed = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("bucket"), F.lit(5000.0).alias("before"), F.col("c_acctbal").alias("after"), F.when(F.col("c_custkey") % 13 == 0, "lost").alias("error")
    )
    return tasks.task_outcomes(turns, listed, 8)


@query("""
WITH t AS (SELECT p_partkey AS task, p_partkey % 4 AS m, 'item_' || p_size AS b, p_partkey % 2 AS won FROM part)
SELECT task, CASE m WHEN 0 THEN 12 WHEN 1 THEN 8 WHEN 2 THEN CASE WHEN won = 1 THEN 0 ELSE 14 END ELSE 2 END + 2 AS n_messages,
  CASE m WHEN 0 THEN 'goto_block|lookup base|craft base 8|lookup ' || b || '|craft ' || b || ' 1' WHEN 1 THEN 'goto_block|lookup base|craft base 8|lookup rod|craft rod 8'
    WHEN 2 THEN 'goto_block|lookup base|craft base 8|lookup ' || b || '|craft ' || b || ' 1|lookup rod|craft rod 8|craft ' || b || ' 1' ELSE 'craft ' || b || ' 1' END AS calls,
  CASE m WHEN 1 THEN 'Crafted base, rod for ' || b || ', which is not made yet (before 0, now ' || won || ').'
    WHEN 2 THEN CASE WHEN won = 1 THEN 'The first try failed for want of rod; now ' || b || ' is made (before 0, now 1).' ELSE 'Could not make ' || b || ' (before 0, now 0): r9.' END
    ELSE CASE WHEN won = 1 THEN 'Made ' || b || ' (before 0, now 1).' ELSE 'Could not make ' || b || ' (before 0, now 0): r9.' END END AS answer,
  m <> 1 AND won = 1 AS completed FROM t
""".replace("CASE m WHEN 0 THEN 12 WHEN 1 THEN 8 WHEN 2 THEN CASE WHEN won = 1 THEN 0 ELSE 14 END ELSE 2 END + 2", "2 * CASE m WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 1 END + 2"))
def craft_shapes(spark, sf):
    """Full, partial, recovered and failed chains, turn by turn."""
    m = F.col("p_partkey") % 4
    item = lambda *names: F.array(*(F.lit(f"minecraft:{n}") for n in names))
    rows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("task"),
        F.element_at(F.array(*map(F.lit, ("full", "partial", "recovery", "failure"))), (m + 1).cast("int")).alias("shape"),
        F.concat(F.lit("minecraft:item_"), F.col("p_size").cast("string")).alias("target"),
        F.when(m == 0, item("base")).otherwise(item("base", "rod")).alias("prereqs"),
        F.array(F.lit("rod")).alias("missing"),
        F.create_map(F.lit("minecraft:base"), F.lit("log")).alias("recipes"),
        F.array(F.lit("r1"), F.lit("r9")).alias("results"),
        F.lit(0).alias("before"),
        (F.col("p_partkey") % 2).alias("after"),
    )
    made = tasks.craft_traces(rows)
    turns = F.filter("messages", lambda x: (x["role"] == "assistant") & F.contains(x["content"], F.lit("<tool_call>")))

    def short(x):
        c = x["content"]
        looked = F.concat(F.lit("lookup "), F.regexp_extract(c, r"result_item='minecraft:(\w+)'", 1))
        crafted = F.concat(F.lit("craft "), F.regexp_extract(c, r"item='(\w+)'", 1), F.lit(" "), F.regexp_extract(c, r"count=(\d+)", 1))
        return F.when(F.contains(c, F.lit("goto_block")), "goto_block").when(F.contains(c, F.lit("lookup(")), looked).otherwise(crafted)

    return made.select(
        "task", F.size("messages").alias("n_messages"), F.array_join(F.transform(turns, short), "|").alias("calls"),
        F.element_at("messages", -1)["content"].alias("answer"), "completed",
    )


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS k, p_partkey AS v, 0 AS d FROM part UNION ALL SELECT k, v // 3, d + 1 FROM a WHERE v >= 2)
SELECT CAST(k AS VARCHAR) AS item, CAST(max(d) AS INTEGER) AS depth FROM a GROUP BY k
""")
def dag_depth_tags(spark, sf):
    """an ingredient that is a tag is as deep as its shallowest member, here a part's third and not its half."""
    part = table(spark, sf, "part").where("p_partkey > 1")
    recipes = part.selectExpr("CAST(p_partkey AS STRING) AS item", "concat('#', p_partkey) AS ingredient")
    tags = part.selectExpr("concat('#', p_partkey) AS tag", "explode(array(CAST(p_partkey div 2 AS STRING), CAST(p_partkey div 3 AS STRING))) AS member")
    return graph.depths(recipes, tags)


@query("""
WITH RECURSIVE a AS (SELECT p_partkey AS k, p_partkey // 2 AS up FROM part WHERE p_partkey > 1 UNION ALL SELECT k, up // 2 FROM a WHERE up > 1)
SELECT CAST(k AS VARCHAR) AS item, CAST(length(bin(k)) - 1 AS INTEGER) AS level, coalesce(string_agg(CAST(up AS VARCHAR), ',' ORDER BY up) FILTER (WHERE up > 1), '') AS steps FROM a GROUP BY k
""")
def prerequisite_steps(spark, sf):
    """what must be crafted first, in order; tags stand for their shallowest member, patterns aren't recipes."""
    part = table(spark, sf, "part").where("p_partkey > 1")
    rows = part.selectExpr("CAST(p_partkey AS STRING) AS item", "IF(p_partkey % 2 = 1, concat('#t', p_partkey), CAST(p_partkey div 2 AS STRING)) AS ingredient")
    rows = rows.unionByName(part.selectExpr("concat('#pattern', p_partkey) AS item", "'1' AS ingredient")).unionByName(rows)
    members = part.where("p_partkey % 2 = 1").selectExpr("concat('t', p_partkey) AS tag", "explode(array(CAST(p_partkey div 2 AS STRING), 'nowhere')) AS member")
    recipes = graph.concrete_recipes(rows)
    found = graph.prerequisites(recipes, spark.sql("SELECT '1' AS item"), graph.resolved_tags(recipes, members))
    return found.select("item", "level", F.array_join("steps", ",").alias("steps"))


@query("SELECT 'reference' AS side, count(*) AS turns, count(*) FILTER (WHERE l_partkey % 3 = l_suppkey % 3) AS matched, count(*) FILTER (WHERE l_suppkey % 3 = 0) AS crafts, count(*) FILTER (WHERE l_suppkey % 3 = 0 AND l_partkey % 3 = 0) AS matched_crafts FROM lineitem")
def turn_alignment(spark, sf):
    """Teacher-forced turns beside the references."""
    said = lambda c: F.when(F.col(c) % 3 == 0, "action(craft, item='a', count=1)").when(F.col(c) % 3 == 1, "action(equip, item='b')").otherwise("Done.")
    # ids that are written, so that both sides read the same
    lines = written(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").withColumn("id", F.monotonically_increasing_id()), "turns")
    rows = lines.select("id", said("l_partkey").alias("told"), said("l_suppkey").alias("gold"))
    both = traces.turn_alignment(rows.select("id", F.col("told").alias("text")), rows.select("id", F.col("gold").alias("text")), ["id"])
    return both.agg(
        F.first(F.lit("reference")).alias("side"), F.count("*").alias("turns"), F.count_if("match").alias("matched"), F.count_if("craft").alias("crafts"), F.count_if(F.col("craft") & F.col("match")).alias("matched_crafts")
    )


_CRC = """
xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)
"""


@query(f"SELECT p_partkey, ['oak', 'birch', 'cherry', 'bamboo', 'mangrove'][{_CRC.format('p_brand')} % 5 + 1] AS distractor FROM part")
def distractor_choice(spark, sf):
    """A distractor by the checksum of the subject."""
    return table(spark, sf, "part").select("p_partkey", runs.distractor(F.array(*map(F.lit, ("oak", "birch", "cherry", "bamboo", "mangrove"))), F.col("p_brand")).alias("distractor"))


@query("SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 10")
def distinct_first(spark, sf):
    """The first of the distinct values, in an order that is said."""
    return runs.distinct_first(table(spark, sf, "part"), "p_brand", 10)


@query("""
SELECT c_custkey AS a_id, s_suppkey AS b_id, round(sqrt((c_acctbal / 100 - s_acctbal / 100) ** 2 + (c_nationkey - s_nationkey) ** 2), 9) AS distance FROM customer, supplier
WHERE sqrt((c_acctbal / 100 - s_acctbal / 100) ** 2 + (c_nationkey - s_nationkey) ** 2) <= 4
""")
def near_pairs(spark, sf):
    """Points of two frames within a radius, met through a grid."""
    at = lambda p, key: table(spark, sf, p[1]).select(F.col(key).alias("id"), (F.col(f"{p[0]}_acctbal") / 100).alias("x"), F.col(f"{p[0]}_nationkey").alias("y"), F.lit(0).alias("z"))
    return relations.near_pairs(at(("c", "customer"), "c_custkey"), at(("s", "supplier"), "s_suppkey"), 4.0, 9)


@query("""
WITH i AS (SELECT l_orderkey AS k, array_to_string(list_sort(list(l_returnflag || l_linestatus)), chr(0)) AS v FROM lineitem GROUP BY 1), g AS (SELECT v, count(*) AS n FROM i GROUP BY v)
SELECT CAST(sum(n) AS BIGINT) AS items, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS exposed, round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n), 9) AS share FROM g
""")
def exposed_share(spark, sf):
    """How many items share their expected values with others."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("v"))
    out = evaluation.exposed_share(items, "l_orderkey", "v")
    return out.select("items", "exposed", F.round("share", 9).alias("share"))


@query("""
WITH v AS (SELECT l_orderkey, l_returnflag = 'R' AS bad, l_linenumber * 1000000000 + l_partkey * 10000 + l_suppkey AS place, ['b' || l_linenumber, l_shipmode] AS issues FROM lineitem),
x AS (SELECT l_orderkey, count(*) FILTER (WHERE bad) AS rejects, count(*) AS votes, list(issues ORDER BY place) FILTER (WHERE bad) AS found FROM v GROUP BY 1)
SELECT l_orderkey, rejects, votes, NOT 2 * rejects > votes AS admitted, CASE WHEN 2 * rejects > votes THEN len(list_distinct(flatten(found))) ELSE 0 END AS n_issues,
  CASE WHEN 2 * rejects > votes THEN found[1][1] ELSE '' END AS first FROM x
""".replace("l_shipmode", "l_linestatus").replace("l_linenumber * 1000000000", "CAST(l_linenumber AS BIGINT) * 1000000000"))
def rejecting_issues(spark, sf):
    """The issues of the votes that reject, in their order and once each."""
    place = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    issues = F.array(F.concat(F.lit("b"), F.col("l_linenumber").cast("string")), "l_linestatus")
    votes = table(spark, sf, "lineitem").select("l_orderkey", place.alias("place"), "l_returnflag", issues.alias("issues"))
    out = evaluation.rejecting_issues(votes, "l_orderkey", "place", F.col("l_returnflag") != "R", "issues")
    return out.select("l_orderkey", "rejects", "votes", "admitted", F.size("issues").cast("long").alias("n_issues"), F.coalesce(F.get("issues", F.lit(0)), F.lit("")).alias("first"))


@query("SELECT o_orderstatus AS side, CASE WHEN o_custkey % 4 = 0 THEN 'unobserved' ELSE o_orderpriority END AS reason, count(*) AS n FROM orders GROUP BY ALL")
def finish_reasons(spark, sf):
    """Why answers ended, by side."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("side"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).alias("why"))
    return evaluation.finish_reasons(rows, "side", "why")


@query("SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN round_even((2 + p_size) / 2.0, 0) ELSE 1 END AS INTEGER) AS n FROM part")
def clamped_counts(spark, sf):
    """Clamps inside clamps, to a constant, to a range, to nothing known."""
    inner = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"type": "minecraft:constant", "value": '), F.col("p_size").cast("string"), F.lit("}"))).when(
        F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"type": "minecraft:clamped", "min_inclusive": 2, "max_inclusive": '), F.col("p_size").cast("string"), F.lit(', "source": 9}'))
    ).otherwise(F.lit('{"type": "minecraft:biased"}'))
    body = inner
    for _ in range(4):
        body = F.concat(F.lit('{"type": "minecraft:clamped", "min_inclusive": 0, "source": '), body, F.lit("}"))
    return table(spark, sf, "part").select("p_partkey", adapters.resolve_count(body).alias("n"))


@query("SELECT l_orderkey AS k, sum(l_linenumber) AS v FROM lineitem GROUP BY 1".replace("sum(l_linenumber)", "CAST(sum(l_linenumber) AS BIGINT)"))
def line_files(spark, sf):
    """Lines written, with blank and comment lines between, and read back."""
    path = scratch_path(spark, "lines")
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_linenumber").alias("v"))
    odd = F.array(F.to_json(F.struct("k", "v")), F.lit(""), F.lit("  // a note"))
    sinks.write_lines(sums.select(F.explode(odd).alias("value")), path)
    return reports.json_lines(spark, path, "k long, v long", comments=True)


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'valid' ELSE 'train' END AS split FROM orders")
def split_lines(spark, sf):
    """A folder of lines for each split, read back with its name."""
    path = scratch_path(spark, "splits")
    split = F.when(F.col("o_orderkey") % 10 == 0, "valid").otherwise("train")
    sinks.write_splits(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), split.alias("split")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.k").cast("long").alias("k"), "split")


@query("SELECT 'customer' AS tbl, count(*) AS n, (SELECT 'customer=' || count(*) FROM customer) || ', ' || (SELECT 'nation=' || count(*) FROM nation) AS summary FROM customer")
def dump_lines(spark, sf):
    """Tables dumped as lines, counted and summed up; a small one also as one document."""
    path = scratch_path(spark, "dump")
    counts = sinks.write_dump({t: table(spark, sf, t) for t in ("customer", "nation")}, path)
    whole = sinks.dump_document({"nation": table(spark, sf, "nation")}).where(F.size(F.from_json("rows", "array<string>")) > 0)
    summary = sinks.dump_summary(counts).first()["summary"]
    return counts.where("tbl = 'customer'").select("tbl", "n", F.lit(summary).alias("summary")).where(F.lit(whole.count()) == 1)


@query("SELECT c_name AS source, c_nationkey AS region FROM customer WHERE c_nationkey = 1")
def dump_source_rows(spark, sf):
    """The rows of one source of dumps, a file for each fifty customers."""
    row = F.struct(F.col("c_nationkey").cast("string").alias("source"), F.col("c_name").alias("name"))
    fifty = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("g")).agg(F.array_sort(F.collect_list(row)).alias("loot"))
    body = F.to_json(F.struct("loot", F.array().cast("array<string>").alias("other")))
    root = scratch_path(spark, "dumps")
    tree.write_tree(fifty.select(F.format_string("d%d.json", "g").alias("path"), body.alias("body")), root)
    found = reports.rows_of_source(spark, root, "loot", "source string, name string", "1")
    return found.select(F.col("name").alias("source"), F.col("source").cast("long").alias("region"))


@query("SELECT 'v7' AS id, 'u' || p_partkey AS url, CAST(NULL AS VARCHAR) AS sha1 FROM part WHERE p_partkey % 40 = 7")
def version_pin(spark, sf):
    """A10: the entry of one version in each manifest of forty; a version that isn't there gives no row."""
    k = F.col("p_partkey")
    entry = F.struct(F.format_string("v%d", k % 40).alias("id"), F.format_string("u%d", k).alias("url"))
    forty = table(spark, sf, "part").groupBy(F.floor(k / 40).alias("g")).agg(F.array_sort(F.collect_list(entry)).alias("versions"))
    manifests = forty.select(F.to_json(F.struct("versions")).alias("body"))
    return reports.pinned_version(manifests, "v7").unionByName(reports.pinned_version(manifests, "v77"))


_TREE = {"a.js": b"run()\n", "b/c.js": b"makeDispatcher({mode: 'ungated'})\n", "b/d.js": b"ungated\n"}
_DIGEST = hashlib.sha256(b"".join(k.encode() + b"\0" + v + b"\0" for k, v in sorted(_TREE.items()))).hexdigest()


def _tree(spark):
    root = scratch_path(spark, "tree")
    for path, content in _TREE.items():
        put_text(spark, f"{root}/{path}", content.decode())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = root.rpartition("/")[2] + "/"
    return files.select(F.substring_index("path", name, -1).alias("path"), "content")


@query("SELECT r_regionkey, v.* FROM region, (VALUES " + ", ".join(f"('{k}', '{hashlib.sha256(v).hexdigest()}', '{_DIGEST}')" for k, v in _TREE.items()) + ") AS v(path, sha256, tree)")
def file_digests(spark, sf):
    """Digests of files, and one of their tree."""
    files = _tree(spark)
    hashed = reshaping.content_hashes(files).withColumn("tree", F.lit(evidence.tree_sha256(files)))
    regions = F.array_sort(F.collect_set("r_regionkey"))
    keys = table(spark, sf, "region").agg(regions.alias("keys")).first()["keys"]  # a handful
    return hashed.select(F.explode(F.lit(keys)).alias("r_regionkey"), "path", "sha256", "tree")


@query("SELECT 'b/c.js' AS path, count(*) AS regions FROM region")
def isolation_breaches(spark, sf):
    """Files outside an allow-list that hold a pattern."""
    files = _tree(spark).select("path", F.col("content").cast("string").alias("body"))
    found = reshaping.isolation_breaches(files, "ungated", spark.sql("SELECT 'b/d.js' AS path"))
    return found.withColumn("regions", F.lit(table(spark, sf, "region").count()).cast("long"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def stripped_traces(spark, sf):
    """Traces without what is known besides their messages."""
    rows = traces.conversation_messages(table(spark, sf, "conversations").withColumn("text", F.col("conv_id").cast("string")), "conv_id", "turn")
    bare = reshaping.messages_only(rows)
    return bare.select(F.get("messages", F.lit(0))["content"].cast("long").alias("conv_id"), F.size("messages").cast("long").alias("n"))


@query("""
SELECT page_id % 20 AS tree, count(*) AS files, sha256(string_agg(url || '#' || page_id || chr(0) || html || chr(0), '' ORDER BY url || '#' || page_id)) AS digest
FROM pages WHERE html IS NOT NULL GROUP BY page_id % 20
""")
def tree_digests(spark, sf):
    """One digest for each of twenty trees of pages, names and contents in the names' order."""
    pages = table(spark, sf, "pages").where("html is not null")
    name = F.concat_ws("#", "url", F.col("page_id").cast("string"))
    return evidence.tree_digests(pages.select((F.col("page_id") % 20).alias("tree"), name.alias("path"), F.col("html").cast("binary").alias("content")), "tree")
