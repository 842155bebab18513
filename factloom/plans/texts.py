"""Text queries on the driver's tables (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import calls, names
from factloom.operators import lookup
from factloom.operators.runs import question_seed
from factloom.plans.base import ORACLES, QUERIES, query, table
from factloom.sources import reports

_PART = "SELECT p_partkey, 'minecraft:' || replace(lower(p_name), ' ', '_') AS id FROM part"


def _ids(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.namespaced(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))).alias("id"))


@query(f"SELECT p_partkey, replace(replace(id, 'minecraft:', ''), '_', ' ') AS bare FROM ({_PART})")
def bare_name(spark, sf):
    return _ids(spark, sf).select("p_partkey", names.bare_name(F.col("id")).alias("bare"))


@query("""
SELECT l_orderkey, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[1:len(v) - 1], ', ') || ', or ' || v[-1] END AS phrase
FROM (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS v FROM lineitem GROUP BY 1)
""")
def english_or_list(spark, sf):
    v = F.sort_array(F.collect_set(F.col("l_partkey").cast("string")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(v.alias("v")).select("l_orderkey", names.or_list(F.col("v")).alias("phrase"))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR))) AS a FROM lineitem GROUP BY ALL),
s AS (SELECT l_orderkey, list(CASE len(a) WHEN 1 THEN a[1] WHEN 2 THEN '(' || a[1] || ' or ' || a[2] || ')' ELSE '(' || array_to_string(a[1:len(a) - 1], ', ') || ', or ' || a[-1] || ')' END ORDER BY l_linenumber) AS v FROM g GROUP BY 1)
SELECT l_orderkey, CASE len(v) WHEN 1 THEN v[1] WHEN 2 THEN v[1] || ' and ' || v[2] ELSE array_to_string(v[1:len(v) - 1], ', ') || ', and ' || v[-1] END AS phrase FROM s
""")
def english_and_or(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))).alias("a"))
    s = g.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "a"))).alias("s"))
    return s.select("l_orderkey", names.and_or_list(F.transform("s", lambda x: x["a"])).alias("phrase"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || ' ' || 'sheep' ELSE lower(p_brand) END AS label FROM part
""")
def source_label(spark, sf):
    brand = F.lower("p_brand")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("minecraft:entities/sheep/"), brand)).otherwise(F.concat(F.lit("minecraft:blocks/"), brand))
    return table(spark, sf, "part").select("p_partkey", names.source_label(path).alias("label"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0
  THEN 'at heights of ' || -p_size || ' up to ' || (p_partkey % 64) || ', densest at ' || CAST(round_even((p_partkey % 64 - p_size) / 2.0, 0) AS INTEGER)
  ELSE 'at heights of ' || -p_size || ' up to ' || (p_partkey % 64) || ', as often at each' END AS phrase FROM part
""")
def depth_phrase(spark, sf):
    low, high = -F.col("p_size"), (F.col("p_partkey") % 64).cast("int")
    kind = F.when(F.col("p_size") % 2 == 0, "trapezoid").otherwise("uniform")
    return table(spark, sf, "part").select("p_partkey", names.depth_phrase(kind, low, high).alias("phrase"))


@query("""
SELECT p_partkey, concat_ws(', ', 'size=' || p_size, CASE WHEN p_partkey % 3 <> 0 THEN 'price=' || rtrim(rtrim(CAST(CAST(round_even(CAST(p_retailprice AS DECIMAL(20, 6)), 2) AS DECIMAL(20, 2)) AS VARCHAR), '0'), '.') END,
  CASE WHEN p_size > 25 THEN 'brand=' || p_brand END) AS facts FROM part
""")
def key_value_facts(spark, sf):
    price = names.number_text(F.col("p_retailprice").cast("decimal(20,6)"))
    pairs = [
        ("size", F.col("p_size").cast("string")),
        ("price", F.when(F.col("p_partkey") % 3 != 0, price)),
        ("brand", F.when(F.col("p_size") > 25, F.col("p_brand"))),
    ]
    return table(spark, sf, "part").select("p_partkey", names.key_value_facts(pairs).alias("facts"))


@query("""
SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS title, CASE WHEN regexp_matches(p_name, '^[aeiouAEIOU]') THEN 'an' ELSE 'a' END AS article FROM part
""")
def capitalized_with_article(spark, sf):
    """J8, J9."""
    n = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", names.capitalized(n).alias("title"), names.article(n).alias("article"))


_TURNS = """
SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_partkey % 6
  WHEN 0 THEN '<tool_call>lookup(recipe, result_item=''x' || l_suppkey || ''')</tool_call>'
  WHEN 1 THEN '<think>hm</think> <tool_call>lookup(tag, tag=''t' || l_suppkey || ''')</tool_call>'
  WHEN 2 THEN 'say lookup(recipe, result_item=''y' || l_suppkey || ''') now'
  WHEN 3 THEN '<tool_call>lookup(tag, item=''z'')</tool_call>'
  WHEN 4 THEN '<think>a</think>It opens and is used to craft item' || l_suppkey || ' faster than 40 ticks (2 seconds).<|im_end|>tail'
  ELSE 'I cannot say whether. There is no data, not a real minecraft:thing' || l_suppkey || ' or minecraft:a/b, 10 ticks (3 seconds), yes' END AS text, l_suppkey, l_partkey % 6 AS m FROM lineitem
"""


def _turns(spark, sf):
    c, s, m = F.concat, F.col("l_suppkey").cast("string"), F.col("l_partkey") % 6
    text = (
        F.when(m == 0, c(F.lit("<tool_call>lookup(recipe, result_item='x"), s, F.lit("')</tool_call>")))
        .when(m == 1, c(F.lit("<think>hm</think> <tool_call>lookup(tag, tag='t"), s, F.lit("')</tool_call>")))
        .when(m == 2, c(F.lit("say lookup(recipe, result_item='y"), s, F.lit("') now")))
        .when(m == 3, F.lit("<tool_call>lookup(tag, item='z')</tool_call>"))
        .when(m == 4, c(F.lit("<think>a</think>It opens and is used to craft item"), s, F.lit(" faster than 40 ticks (2 seconds).<|im_end|>tail")))
        .otherwise(c(F.lit("I cannot say whether. There is no data, not a real minecraft:thing"), s, F.lit(" or minecraft:a/b, 10 ticks (3 seconds), yes")))
    )
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), text.alias("text"), "l_suppkey")


# The oracles of the parsers say by form of text what each must find.
@query(f"""
SELECT k, CASE WHEN m IN (0, 2) THEN 'recipe' ELSE 'tag' END AS tbl, CASE m WHEN 0 THEN 'x' || l_suppkey WHEN 1 THEN 't' || l_suppkey WHEN 2 THEN 'y' || l_suppkey ELSE 'z' END AS key
FROM ({_TURNS}) WHERE m <= 3
""")
def parse_loose_call(spark, sf):
    return _turns(spark, sf).select("k", calls.parse_loose(F.col("text")).alias("c")).where("c is not null").select("k", "c.tbl", "c.key")


@query(f"SELECT k, CASE m WHEN 0 THEN 'recipe' ELSE 'tag' END AS tbl, CASE m WHEN 0 THEN 'x' ELSE 't' END || l_suppkey AS key FROM ({_TURNS}) WHERE m <= 1")
def parse_strict_call(spark, sf):
    return _turns(spark, sf).select("k", calls.parse_strict(F.col("text")).alias("c")).where("c is not null").select("k", "c.tbl", "c.key")


@query(f"SELECT k, m <= 3 AS attempted FROM ({_TURNS})")
def call_attempted(spark, sf):
    return _turns(spark, sf).select("k", calls.call_attempted(F.col("text")).alias("attempted"))


@query(f"""
SELECT k, CASE m WHEN 2 THEN text WHEN 4 THEN 'It opens and is used to craft item' || l_suppkey || ' faster than 40 ticks (2 seconds).' WHEN 5 THEN text END AS answer FROM ({_TURNS})
""")
def final_answer_span(spark, sf):
    return _turns(spark, sf).select("k", calls.final_answer(F.col("text")).alias("answer"))


@query(f"SELECT k, m = 4 AS found FROM ({_TURNS})")
def phrase_boundary(spark, sf):
    phrase = F.concat(F.lit("Item"), F.col("l_suppkey").cast("string"))
    return _turns(spark, sf).select("k", calls.contains_phrase(F.col("text"), phrase).alias("found"))


@query(f"SELECT k, m = 4 AS bound FROM ({_TURNS})")
def subject_bound(spark, sf):
    key = F.concat(F.lit("minecraft:item"), F.col("l_suppkey").cast("string"))
    return _turns(spark, sf).select("k", calls.subject_bound(F.lit("recipe"), key, F.col("text")).alias("bound"))


def _named(name: str, sql: str, column) -> None:
    def run(spark, sf):
        return _turns(spark, sf).select("k", column(F.col("text")).alias("flag"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT k, {sql} AS flag FROM ({_TURNS})"


_named("refusal_flag", "m = 5", calls.refused)
_named("decline_flag", "m = 5", calls.declined)
_named("tick_time_errors", "CAST(m = 5 AS BIGINT)", calls.tick_errors)
_named("degenerate_flag", "false", calls.degenerate)
_named("claim_shape_flags", "m = 4",
       lambda t: calls.claim_shape(t, "mechanism") | calls.claim_shape(t, "capability") | calls.claim_shape(t, "comparative"))
_named("yes_no_score", "CASE WHEN regexp_matches(lower(text), '\\byes\\b') AND NOT regexp_matches(lower(text), '\\bno\\b') THEN 'yes' WHEN regexp_matches(lower(text), '\\bno\\b') AND NOT regexp_matches(lower(text), '\\byes\\b') THEN 'no' END", calls.yes_no)
_named("action_calls", "array_to_string(list_transform(regexp_extract_all(text, 'lookup\\(([a-z_]+)=''', 1), lambda x: x), ',')",
       lambda t: F.array_join(F.transform(calls.calls_in(t, "lookup"), lambda x: F.substring_index(x, "=", 1)), ","))


@query(f"""
WITH t AS (SELECT k, unnest(['minecraft:thing' || l_suppkey, 'minecraft:a/b']) AS id FROM ({_TURNS}) WHERE m = 5)
SELECT t.k, t.id FROM t WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE 'minecraft:thing' || (s_suppkey - s_suppkey % 2) = t.id)
""")
def unknown_ids(spark, sf):
    """Ids in texts that the registry doesn't have."""
    ids = _turns(spark, sf).select("k", F.explode(calls.id_tokens(F.col("text"))).alias("id"))
    known = table(spark, sf, "supplier").select(F.concat(F.lit("minecraft:thing"), (F.col("s_suppkey") - F.col("s_suppkey") % 2).cast("string")).alias("id"))
    return ids.join(known, "id", "left_anti").select("k", "id")


@query(f"SELECT k, list_contains(regexp_extract_all(text, '[0-9]+'), CAST(l_suppkey AS VARCHAR)) AS found FROM ({_TURNS})")
def number_in_text(spark, sf):
    return _turns(spark, sf).select("k", calls.number_in_text(F.col("text"), F.col("l_suppkey")).alias("found"))


@query("""
SELECT l_orderkey, CASE WHEN last(l_linenumber ORDER BY l_linenumber) IN (3, 5) THEN 'eos' WHEN count(*) >= 6 THEN 'max_tokens' ELSE 'stopped' END AS kind
FROM lineitem GROUP BY l_orderkey
""")
def completion_class(spark, sf):
    ids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ids"))
    return ids.select("l_orderkey", calls.completion_class(F.col("ids"), 6, [3, 5]).alias("kind"))


@query("""
WITH f AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, length(split_part(p_name, ' ', 1)) AS top FROM part),
c AS (SELECT p_partkey, p_partkey % 6 AS form, split_part(p_name, ' ', 1) AS name, p_size % 9 AS said FROM part)
SELECT p_partkey, name, CAST(said AS BIGINT) AS stated, CAST(top AS BIGINT) AS max_level FROM c JOIN f USING (name) WHERE form IN (0, 2, 4) AND said <> top
""")
def level_claim_errors(spark, sf):
    """What is claimed to be a greatest level, above or below the fact; bare levels and other names are left alone."""
    said, name = (F.col("p_size") % 9).cast("string"), F.initcap(F.substring_index("p_name", " ", 1))
    forms = (
        F.concat(name, F.lit(" has a maximum level of "), said),
        F.concat(F.lit("The maximum level of "), name, F.lit(" is "), said),  # the name must stand in front
        F.concat(name, F.lit("  goes up to level "), said, F.lit(", I think")),
        F.concat(name, F.lit(" "), said),
        F.concat(F.lit("Luck caps at level 7. "), F.upper(name), F.lit(" caps at level "), said, F.lit(".")),
        F.concat(F.lit("Bogus goes up to level "), said, F.lit(". And "), name, F.lit(" "), said),
    )
    part = table(spark, sf, "part")
    texts = part.select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int")).alias("text"))
    word = F.substring_index("p_name", " ", 1)
    facts = part.select(word.alias("name"), F.char_length(word).cast("long").alias("max_level")).distinct()
    found = calls.level_errors(texts, "p_partkey", "text", facts)
    return found.withColumn("stated", F.col("stated").cast("long"))


@query("""
SELECT doc_id, doc_id % 3 <> 2 AS clean, CASE WHEN doc_id % 3 <> 2 THEN sha256(text) END AS said,
  CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS first_said FROM documents
""")
def long_json_texts(spark, sf):
    """Whole texts as JSON strings with comments around them, and the object in front of a tail."""
    string = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":|\}$', "")
    body = F.concat(F.lit('{ // a "note"\n "//": "\\\\", "t": '), string, F.when(F.col("doc_id") % 3 == 2, "").otherwise("} // end\n"))
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit('}} and {"more": "}')).otherwise(F.lit(", nothing: }"))
    first = calls.json_prefix(F.concat(F.lit(' {"o": {"{": 1, "t": '), string, F.lit("}"), tail))
    docs = table(spark, sf, "documents").select("doc_id", reports.without_comments(body).alias("c"), first.alias("first"))
    return docs.select(
        "doc_id",
        F.json_object_keys("c").isNotNull().alias("clean"),
        F.when(F.json_object_keys("c").isNotNull(), F.sha2(F.get_json_object("c", "$.t"), 256)).alias("said"),
        F.sha2(F.get_json_object("first", "$.o.t"), 256).alias("first_said"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, event_id % 3 <> 2 AS failed, props AS object FROM events")
def json_scalars(spark, sf):
    """Scalars of small JSON texts and the first object of a text with a tail."""
    p = F.col("props")
    return table(spark, sf, "events").select(
        "event_id",
        F.get_json_object(p, "$.k").isNotNull().alias("has_k"),
        calls.failed_result(F.when(F.col("event_id") % 3 == 0, '{"error": {"at": 1}}').when(F.col("event_id") % 3 == 1, '{"reason": "", "x": 2}').otherwise(p)).alias("failed"),
        calls.json_prefix(F.concat(p, F.lit(' and {"more": 1}'))).alias("object"),
    )


@query("""
SELECT e.event_id, t.phrase || ' ' || e.event_type AS question FROM events e JOIN
(SELECT unnest(['What is', 'Tell me about', 'Describe']) AS phrase, unnest([0, 1, 2]) AS i) t ON t.i = CAST('0x' || substr(sha256('t' || chr(0) || e.event_id), 1, 8) AS BIGINT) % 3
""")
def question_templates(spark, sf):
    """A phrasing is chosen for each row by a seeded hash."""
    phrases = F.array(F.lit("What is"), F.lit("Tell me about"), F.lit("Describe"))
    pick = F.element_at(phrases, (question_seed(F.lit("t"), F.col("event_id").cast("string")) % 3).cast("int") + 1)
    return table(spark, sf, "events").select("event_id", F.concat_ws(" ", pick, "event_type").alias("question"))


@query("""
SELECT o_custkey, concat_ws('; or ', CASE WHEN len(b) > 0 THEN 'mining ' || CASE len(b) WHEN 1 THEN b[1] ELSE array_to_string(b[1:len(b) - 1], ', ') || ', or ' || b[-1] END END,
  CASE WHEN len(e) > 0 THEN 'killing ' || CASE len(e) WHEN 1 THEN e[1] ELSE array_to_string(e[1:len(e) - 1], ', ') || ', or ' || e[-1] END END) AS phrase FROM (
  SELECT o_custkey, list_sort(coalesce(list(DISTINCT 'ore ' || o_orderstatus) FILTER (WHERE o_orderkey % 2 = 0), [])) AS b,
    list_sort(coalesce(list(DISTINCT o_orderstatus || ' sheep') FILTER (WHERE o_orderkey % 2 = 1), [])) AS e FROM orders GROUP BY o_custkey)
""")
def sources_phrase(spark, sf):
    """J5."""
    s = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("minecraft:blocks/ore_"), "o_orderstatus")).otherwise(F.concat(F.lit("minecraft:entities/sheep/"), "o_orderstatus"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list(s).alias("s"))
    return rows.select("o_custkey", names.sources_phrase(F.col("s")).alias("phrase"))


@query("""
SELECT doc_id, toxic = 1 AS malformed, CASE WHEN toxic = 0 THEN 'why ' || doc_id END AS thought, CASE WHEN toxic = 0 THEN 'answer' END AS answer FROM labels
""")
def thought_reshape(spark, sf):
    """A thought and its answer; rows without the marker are counted as malformed."""
    from factloom.functions import reshaping

    good = F.concat(F.lit("<thought> why "), F.col("doc_id").cast("string"), F.lit("</thought>\n answer "))
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 0, good).otherwise("no marker").alias("r"))
    t = reshaping.thought_and_answer(F.col("r"))
    return rows.select("doc_id", t.isNull().alias("malformed"), t["thought"].alias("thought"), t["answer"].alias("answer"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1, 3, 4) AS protected FROM part")
def protected_gear(spark, sf):
    """J33."""
    from factloom.functions import reshaping

    k = F.col("p_partkey") % 6
    name = F.element_at(F.array(*map(F.lit, ("netherite_hoe", "diamond_axe", "diamond", "stick", "book", "stone_axe"))), (k + 1).cast("int"))
    worked = F.when(k == 3, F.array(F.lit("minecraft:lore"), F.lit("minecraft:enchantments"))).when(k == 4, F.array(F.lit("minecraft:stored_enchantments")))
    components = F.coalesce(worked, F.when(k == 5, F.array(F.lit("minecraft:lore"))), F.array().cast("array<string>"))
    return table(spark, sf, "part").select("p_partkey", reshaping.protected_gear(name, components).alias("protected"))


@query("""
SELECT l_orderkey, string_agg('  → lookup ' || l_linenumber || ': recipe(' || l_partkey || ')', chr(10) ORDER BY l_linenumber, l_partkey) || chr(10) || '(no answer)' AS shown
FROM (SELECT DISTINCT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS l_linenumber, l_partkey FROM lineitem) GROUP BY 1
""")
def calls_rendered(spark, sf):
    """Numbered lookups and placeholders."""
    from factloom.functions import reshaping

    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    made = F.transform("c", lambda x: F.struct(F.lit("recipe").alias("tbl"), x["l_partkey"].cast("string").alias("key")))
    return rows.select("l_orderkey", reshaping.rendered_calls(made, F.lit(None).cast("string")).alias("shown"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'extra:1' ELSE 'missing:1' END AS problems FROM part
""")
def manifest_check(spark, sf):
    """The signatures of a manifest are exactly the expected ones."""
    from factloom.functions import reshaping

    lines = [f"lookup({t}, {a}='KEY')" for t, a in calls.ARGUMENTS.items()]
    whole, more, less = "\n".join(lines), "\n".join([*lines, "lookup(other, x='KEY')"]), "\n".join(lines[1:])
    text = F.element_at(F.array(*map(F.lit, (whole, more, less))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", reshaping.manifest_problems(text).alias("problems"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'mithril' END AS noun FROM part WHERE p_partkey % 2 = 0
""")
def fabricated_nouns(spark, sf):
    """Nouns said to be real objects that no registry name matches."""
    from factloom.functions import reshaping

    text = F.when(F.col("p_partkey") % 2 == 0, "Smelt mithril ore, or feed them with raw beef.").otherwise("Use an iron ingot.")
    known = spark.sql("SELECT explode(array('iron', 'beef')) AS noun")
    return reshaping.fabricated_nouns(table(spark, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text", known)


@query("""
SELECT o_orderkey, o_orderpriority AS tool, 'item=' || o_custkey || ',count=' || (o_orderkey % 50) || ',note=' || o_orderstatus AS args FROM
(SELECT o_orderkey, o_custkey, o_orderstatus, 'tool_' || (o_orderkey % 7) AS o_orderpriority FROM orders WHERE o_orderkey % 3 <> 2)
""")
def action_arguments(spark, sf):
    """The tool and the arguments of an action, texts and numbers in their order; turns without an action have none."""
    k = F.col("o_orderkey")
    call = F.concat(
        F.lit("<think>x=1</think>\n<tool_call>action(tool_"), (k % 7).cast("string"), F.lit(", item='"), F.col("o_custkey").cast("string"), F.lit("', count="), (k % 50).cast("string"),
        F.lit(",  note = '"), "o_orderstatus", F.lit("')</tool_call>"),
    )
    a = calls.parse_action(F.when(k % 3 != 2, call).otherwise(F.lit("No action, only words (count=3).")))
    value = lambda x: F.coalesce(x["text"], x["number"].cast("long").cast("string"))
    args = F.array_join(F.transform(F.col("a.args"), lambda x: F.concat_ws("=", x["name"], value(x))), ",")
    return table(spark, sf, "orders").select("o_orderkey", a.alias("a")).where("a is not null").select("o_orderkey", "a.tool", args.alias("args"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_size % 2 = 0 ELSE true END AS right_ FROM part
""")
def fact_scores(spark, sf):
    """All of the expected names, any of them, or the expected number."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    kind = F.when(k <= 1, "contains_all").when(k == 2, "int_equals").otherwise("contains_any")
    expected = F.when(k == 2, F.array(F.concat(size, F.lit(".0")))).otherwise(F.array(F.lit("minecraft:iron_ingot"), F.concat(F.lit("#minecraft:x/gear_"), size)))
    answer = (
        F.when(k == 0, F.concat(F.lit("Take an Iron ingot and the gear "), size, F.lit(".")))
        .when(k == 1, F.lit("Take an iron_ingot."))
        .when(k == 2, F.concat(F.lit("It is "), (F.col("p_size") + F.col("p_size") % 2).cast("string"), F.lit("."))).otherwise(F.concat(F.lit("Some GEAR_"), size))
    )
    return table(spark, sf, "part").select("p_partkey", calls.fact_score(kind, expected, answer).alias("right_"))


@query("""
SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey % 3 <> 0 AS anywhere, l_partkey % 3 = 1 AS there FROM lineitem
""")
def registry_scope(spark, sf):
    """Whether an id exists at all, and in the registry that is meant: items of every third part, blocks of the one after it."""
    part = table(spark, sf, "part")
    registry = part.where("p_partkey % 3 > 0").select(
        F.when(F.col("p_partkey") % 3 == 1, "item").otherwise("block").alias("registry"), F.concat(F.lit("minecraft:p"), F.col("p_partkey").cast("string")).alias("id")
    )
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")
    rows = table(spark, sf, "lineitem").select(k, F.lit("item").alias("registry"), F.concat(F.lit("minecraft:p"), F.col("l_partkey").cast("string")).alias("id"))
    return lookup.placed(rows, registry).select("k", "anywhere", "there")
