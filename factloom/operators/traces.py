"""Traces: verification by repeating the lookups, replay of hop loops, scoring, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import calls
from factloom.functions.names import DEPTH_TOKEN, bare_name, source_label
from factloom.operators.lookup import NO_ROWS, execute, tokens_of
from factloom.sources.scratch import written

#: Tokens of a tag beyond which an answer may give their number and three examples.
LARGE_TAG, EXAMPLES = 12, 3
# Tables whose rows are numbers and ids in ``key=value`` form.
SCALAR = ("enchantment", "jukebox_song", "painting", "villager_trade", "item_use")
#: How a result stands in a trace.
RESULT = r"(?s)<result>(.*?)</result>"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def call_text(tbl: Column, argument: Column, key: Column) -> Column:
    return F.concat(F.lit("<tool_call>lookup("), tbl, F.lit(", "), argument, F.lit("='"), key, F.lit("')</tool_call>"))


def asking(thought: Column, tbl: str, key: Column) -> Column:
    """A turn that thinks and calls."""
    call = call_text(F.lit(tbl), F.lit(calls.ARGUMENTS[tbl]), key)
    return message("assistant", F.concat(F.lit("<think>"), thought, F.lit("</think>\n"), call))


def told(result: Column) -> Column:
    """A turn that gives a call's result back."""
    return message("user", F.concat(F.lit("<result>"), result, F.lit("</result>")))


def single_hop(
    facts: DataFrame, question: Column, tbl: str, key: Column, result: Column, answer: Column, thought: Column | None = None
) -> DataFrame:
    """Four messages: question, call, result, answer."""
    thought = F.lit(f"The {tbl.replace('_', ' ')} table has this.") if thought is None else thought
    return facts.select(
        key.alias("key"),
        F.array(message("user", question), asking(thought, tbl, key), told(result), message("assistant", answer)).alias("messages"),
    )


def _says(answer: Column, tokens: Column) -> Column:
    """Whether a folded answer names every token, and every alternative of a token."""
    return F.forall(F.flatten(F.transform(tokens, lambda t: F.split(t, "/"))), lambda t: F.contains(answer, bare_name(t)))


def _says_first_band(answer: Column, tokens: Column) -> Column:
    first = F.get(tokens, F.lit(0))
    return F.contains(answer, F.regexp_extract(first, DEPTH_TOKEN, 1)) & F.contains(answer, F.regexp_extract(first, DEPTH_TOKEN, 2))


def value_of(token: Column) -> Column:
    """What stands behind the last ``=``, without namespace, underscores as spaces."""
    return F.replace(F.replace(F.element_at(F.split(token, "="), -1), F.lit("minecraft:"), F.lit("")), F.lit("_"), F.lit(" "))


def cited(answer: Column, tokens: Column) -> Column:
    """The number of tokens that a folded answer names."""
    return F.size(F.filter(tokens, lambda t: F.contains(answer, bare_name(t))))


def _large(answer: Column, tokens: Column) -> Column:
    return F.contains(answer, F.size(tokens).cast("string")) & (cited(answer, tokens) >= EXAMPLES)


def covers(tbl: Column, tokens: Column, answer: Column) -> Column:
    """Whether a folded answer says what the rows of a table say, by the table's rule (K2)."""
    any_word = lambda t: F.exists(F.split(value_of(t), r"\s+"), lambda w: F.contains(answer, w))
    return (
        F.when(tbl.isin(*SCALAR), F.forall(tokens, any_word))
        .when((tbl == "tag") & (F.size(tokens) > LARGE_TAG), _large(answer, tokens))
        .when(tbl == "loot_source", F.forall(tokens, lambda t: F.contains(answer, source_label(t))))
        .when(tbl == "ore_depth", _says_first_band(answer, tokens))
        .otherwise(_says(answer, tokens))
    )


def _same(stated: Column, tokens: Column) -> Column:
    """Whether a stated result has the tokens, in any order."""
    return F.sort_array(F.array_distinct(F.split(stated, ", "))).eqNullSafe(F.sort_array(F.array_distinct(tokens)))


def verify(traces: DataFrame, truth: DataFrame) -> DataFrame:
    """``trace_id, ok``: every call of a trace repeated against ``truth`` (``tbl, key, result``), by the trace's shape.

    Two messages: no call, and the answer declines. Four: the stated result is the
    truth's and the answer covers it by the table's rule, or both say that there is
    nothing. Six: the second call's key is among the first result's items (a recipe),
    or the block behind one of its sources (depths); both results are the truth's
    and the answer covers the second. Traces of other shapes aren't good.
    """
    text = lambda i: F.get("messages", F.lit(i))["content"]
    n = F.size("messages")
    result = lambda i: F.when(text(i).rlike(RESULT), F.regexp_extract(text(i), RESULT, 1))
    rows = traces.select(
        "trace_id",
        n.alias("n"),
        text(1).alias("turn"),
        F.lower(F.try_element_at("messages", F.lit(-1))["content"]).alias("answer"),
        F.when(n >= 4, calls.parse_loose(text(1))).alias("c1"),
        F.when(n == 6, calls.parse_loose(text(3))).alias("c2"),
        result(2).alias("s1"),
        result(4).alias("s2"),
    )
    rows = written(rows, "parsed")  # texts are parsed once
    found = execute(rows.select(F.explode(F.array("c1", "c2")).alias("c")).select("c.tbl", "c.key"), truth)
    for i in (1, 2):
        one = found.select(F.col("tbl").alias(f"t{i}"), F.col("key").alias(f"k{i}"), tokens_of(F.col("result")).alias(f"r{i}"))
        # traces without this call would all meet in one task: their place is their own id, of no table
        made = F.col(f"c{i}.tbl").isNotNull() & F.col(f"c{i}.key").isNotNull()
        tbl, key = F.when(made, F.col(f"c{i}.tbl")).otherwise(""), F.when(made, F.col(f"c{i}.key")).otherwise(F.xxhash64("trace_id").cast("string"))
        rows = rows.join(one, (tbl == F.col(f"t{i}")) & (key == F.col(f"k{i}")), "left")
    answer, r1, r2 = F.col("answer"), F.col("r1"), F.col("r2")
    declines = calls.declined(answer)
    known = F.col("t1").isin(*calls.ARGUMENTS)
    nothing = (F.col("s1") == NO_ROWS) & declines
    single = known & F.when(F.size(r1) == 0, nothing).otherwise(_same(F.col("s1"), r1) & covers(F.col("t1"), r1, answer))
    both = _same(F.col("s1"), r1) & _same(F.col("s2"), r2) & (F.size(r2) > 0)
    items = F.when(F.col("t1") == "recipe", F.flatten(F.transform(r1, lambda t: F.split(t, "/")))).otherwise(r1)
    chain = F.col("t1").isin("recipe", "breeding_food") & both & F.array_contains(items, F.col("k2")) & _says(answer, r2)
    block = F.concat(F.lit("minecraft:blocks/"), F.regexp_replace("k2", "^[^:]*:", ""))
    depth = (
        (F.col("t1") == "loot_source")
        & both
        & F.array_contains(r1, block)
        & F.forall(r1, lambda t: F.contains(answer, source_label(t)))
        & _says_first_band(answer, r2)
    )
    ok = (
        F.when(F.col("n") == 2, ~F.contains("turn", F.lit("<tool_call>")) & declines)
        .when(F.col("n") == 4, single)
        .when((F.col("n") == 6) & (F.col("t2") == "recipe"), chain)
        .when((F.col("n") == 6) & (F.col("t2") == "ore_depth"), depth)
    )
    return rows.select("trace_id", F.coalesce(ok, F.lit(False)).alias("ok"))


def conversation_messages(turns: DataFrame, group: str, order: str) -> DataFrame:
    """A conversation's messages in order (conversations of bounded length)."""
    packed = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    return turns.groupBy(group).agg(
        F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")
    )


def integrity(traces: DataFrame, recorded: Column) -> DataFrame:
    """Whether the results that a trace states are exactly the recorded ones, one for one."""
    results = F.filter("messages", lambda m: (m["role"] == "user") & m["content"].startswith("<result>"))
    stated = F.transform(results, lambda m: F.regexp_replace(m["content"], r"(?s)^<result>|</result>$", ""))
    return traces.withColumn("intact", stated.eqNullSafe(recorded))


def replay(turns: DataFrame, item: str, hop: str, text: Column, budget: int) -> DataFrame:
    """The hop loop over recorded turns: what is called until a turn makes no complete call or ``budget`` hops are over.

    ``answered_at`` is that turn's hop (null if the budget runs out), ``made`` the
    calls before it, ``n_calls`` their number, ``attempted`` whether any turn up to
    it had a sign of a call, ``answer`` its answer (null if it isn't one), and
    ``finish`` is ``answered``, ``no_answer`` or ``hop_limit``.
    """
    step = F.struct(F.col(hop).alias("hop"), calls.parse_strict(text).alias("call"), calls.call_attempted(text).alias("sign"), text.alias("text"))
    # at most ``budget`` turns of an item are put together
    first = turns.select(item, step.alias("s")).withColumn("__k", F.row_number().over(Window.partitionBy(item).orderBy("s.hop"))).where(F.col("__k") <= budget)
    packed = first.groupBy(item).agg(F.array_sort(F.collect_list("s")).alias("s"))
    end = F.array_position(F.transform("s", lambda x: x["call"].isNull()), F.lit(True))
    packed = packed.withColumn("end", F.when(end > 0, end).cast("int"))
    last = F.get("s", F.col("end") - 1)
    before = F.slice("s", F.lit(1), F.coalesce(F.col("end") - 1, F.size("s")))
    seen = F.slice("s", F.lit(1), F.coalesce(F.col("end"), F.size("s")))
    answer = calls.final_answer(last["text"])
    return packed.select(
        item,
        last["hop"].alias("answered_at"),
        F.transform(before, lambda x: x["call"]).alias("made"),
        F.size(before).cast("long").alias("n_calls"),
        F.exists(seen, lambda x: x["sign"]).alias("attempted"),
        answer.alias("answer"),
        F.when(F.col("end").isNull(), "hop_limit").when(answer.isNull(), "no_answer").otherwise("answered").alias("finish"),
    )


def answered_calls(replayed: DataFrame, item: str, truth: DataFrame) -> DataFrame:
    """``item, pos, tbl, key, result``: what the calls of a replay get back."""
    each = replayed.select(item, F.posexplode("made").alias("pos", "c")).select(item, "pos", "c.tbl", "c.key")
    return each.join(execute(each, truth), ["tbl", "key"]).select(item, "pos", "tbl", "key", "result")


def score(category: Column, kind: Column, answer: Column, expected: Column, key: Column) -> Column:
    """Pass or fail of an answer.

    Unknown subjects and uses pass by declining; of two hops the second's items must
    be named. A known item fails if it is declined although there are rows. Then by
    category: values of scalar tables must stand as whole phrases, and with them the
    subject of a simple key; large tags need their size and three members; recipes
    and loot their subject; and all rows must be named. Other categories than the
    tables' need each expected value as a whole phrase.
    """
    low = F.lower(answer)
    refused = calls.declined(answer, calls.NO_DATA)
    simple = F.contains(key, F.lit(":")) & ~F.contains(F.regexp_replace(key, "^[^:]*:", ""), F.lit("/"))
    scalar = F.forall(expected, lambda e: calls.contains_phrase(answer, value_of(e))) & (
        ~F.coalesce(simple, F.lit(False)) | calls.contains_phrase(answer, bare_name(key))
    )
    every = F.forall(expected, lambda e: F.contains(low, bare_name(e)))
    phrases = F.forall(expected, lambda e: calls.contains_phrase(answer, e))
    verdict = (
        F.when(answer.isNull(), F.lit(False))
        .when(kind.isin("unknown", "usage"), refused)
        .when(kind == "multihop", every)
        .when((F.size(expected) > 0) & refused, F.lit(False))
        .when(category.isin(*SCALAR, "scalar"), scalar)
        .when((category == "large_tag") | ((category == "tag") & (F.size(expected) > LARGE_TAG)), _large(low, expected))
        .when(category.isin("recipe", "loot"), calls.subject_bound(category, key, answer) & every)
        .when(category.isin(*calls.ARGUMENTS), every)
        .otherwise(phrases)
    )
    return F.coalesce(verdict, F.lit(False))


def contract(kind: Column, made: Column, expected: Column, attempted: Column | None = None) -> Column:
    """Whether the calls of an item are what its kind asks for.

    Questions about uses must not even attempt a call; two hops need exactly the
    expected first two calls, all else the expected first call.
    """
    tried = F.lit(False) if attempted is None else attempted
    return (
        F.when(kind.isin("usage", "usage_none"), (F.size(made) == 0) & ~tried)
        .when(F.size(made) == 0, F.lit(False))
        .when(kind == "multihop", F.slice(made, 1, 2).eqNullSafe(expected))
        .otherwise(F.get(made, F.lit(0)).eqNullSafe(F.get(expected, F.lit(0))))
    )


def side_by_side(answers: DataFrame, item: str, side: str, value: str, sides: list[str]) -> DataFrame:
    """One row for each item with a column for each side; missing answers are null."""
    return answers.groupBy(item).pivot(side, sides).agg(F.first(value, ignorenulls=True))


def turn_alignment(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Teacher-forced turns ``a`` beside the references ``b``: whether their actions match, and whether it is a craft."""
    both = a.alias("a").join(b.alias("b"), keys)
    craft = F.coalesce(calls.parse_action(F.col("b.text"))["tool"] == "craft", F.lit(False))
    return both.select(
        *keys,
        calls.parse_loose(F.col("a.text")).eqNullSafe(calls.parse_loose(F.col("b.text"))).alias("same_call"),
        calls.action_matches(F.col("a.text"), F.col("b.text")).alias("match"),
        craft.alias("craft"),
    )


def craft_steps(plan: DataFrame, task: str, order: list[str], step: str) -> DataFrame:
    """A task's steps as one message list in order."""
    w = F.sort_array(F.collect_list(F.struct(*order, F.col(step).alias("s"))))
    return plan.groupBy(task).agg(F.array_join(F.transform(w, lambda x: x["s"]), " > ").alias("steps"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last state of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
