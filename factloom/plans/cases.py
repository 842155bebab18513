"""Parsers and scorers on literal cases: every form that is taken or refused, with what the rules give for it by hand.

A case is met once for each supplier. The oracles hold the expected values alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import calls, reshaping
from factloom.operators import evidence, lookup, traces
from factloom.plans.base import ORACLES, QUERIES, query, table


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"


def _rows(spark, sf, rows: list[dict], schema: str):
    """``s_suppkey``, the case's number ``n`` and its columns."""
    listed = [{"n": i, **r} for i, r in enumerate(rows)]
    each = F.from_json(F.lit(json.dumps(listed)), f"array<struct<n:int,{schema}>>")
    return table(spark, sf, "supplier").select("s_suppkey", F.inline(each))


def _oracle(names: str, expected: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(_literal(v) for v in (i, *e)) + ")" for i, e in enumerate(expected))
    return f"SELECT s_suppkey, c.* FROM supplier, (VALUES {values}) AS c(n, {names})"


def _texts(name: str, cases: list[tuple[str, object]], column, result: str = "found") -> None:
    """A query that applies a column to each text."""

    def run(spark, sf):
        rows = _rows(spark, sf, [{"text": t} for t, _ in cases], "text:string")
        return rows.select("s_suppkey", "n", column(F.col("text")).alias(result))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = _oracle(result, [(e,) for _, e in cases])


def _call(c: Column) -> Column:
    return F.concat_ws("|", c["tbl"], c["key"])


_LOOSE = [
    ("lookup(recipe, result_item='a')", "recipe|a"),
    ("so lookup(tag,tag='b') or lookup(tag, tag='c')", "tag|b"),
    ("lookup(loot,   source='x/y z')", "loot|x/y z"),
    ("lookup(other, thing='q')", "other|q"),
    ("lookup(tag, tag='')", "tag|"),
    ("lookup(tag, tag='open", ""),
    ("lookup (tag, tag='x')", ""),
    ("lookup(tag , tag='x')", ""),
    ("no call", ""),
]
_texts("loose_call_cases", _LOOSE, lambda t: F.coalesce(_call(calls.parse_loose(t)), F.lit("")))

_GOOD = "<tool_call>lookup(recipe, result_item='minecraft:shears')</tool_call>"
_STRICT = [
    (_GOOD, "recipe|minecraft:shears"),
    ("<think>Look it up.</think>\n" + _GOOD, "recipe|minecraft:shears"),
    ("<think>a < b,\nthen <c></think>" + _GOOD, "recipe|minecraft:shears"),
    (" \n" + _GOOD + " <|im_end|>\n", "recipe|minecraft:shears"),
    ("<tool_call> lookup( recipe , result_item = 'x' ) </tool_call>", "recipe|x"),
    ("<tool_call>lookup(recipe, result_item='')</tool_call>", "recipe|"),
    ("<tool_call>\nlookup(tag,\n tag='t')\n</tool_call>", "tag|t"),
    ("<tool_call>lookup(loot_source, drop_item='x')</tool_call>", "loot_source|x"),
    ("lookup(recipe, result_item='x')", ""),
    ("<tool_call>lookup(recipe, result_item='x')", ""),
    (_GOOD + _GOOD, ""),
    (_GOOD + "<tool_call>lookup(recipe, result_item='y')", ""),
    ("prefix " + _GOOD, ""),
    (_GOOD + " and more", ""),
    ("<think>open " + _GOOD, ""),
    ("<think>a</think><think>b</think>" + _GOOD, ""),
    ("<tool_call>lookup(recipe, wrong='x')</tool_call>", ""),
    ("<tool_call>lookup(nothing, key='x')</tool_call>", ""),
    ("<tool_call>lookup(recipe, result_item=\"x\")</tool_call>", ""),
    ("<tool_call></tool_call>", ""),
    (_GOOD + "<|im_end|><|im_end|>", ""),
] + [(f"<tool_call>lookup({t}, {a}='k')</tool_call>", f"{t}|k") for t, a in calls.ARGUMENTS.items()]
_texts("strict_call_cases", _STRICT, lambda t: F.coalesce(_call(calls.parse_strict(t)), F.lit("")))

_texts(
    "attempt_cases",
    [
        ("lookup(recipe, wrong='x')", True), ("lookup(recipe", True), ("lookup (recipe)", True), ("x</tool_call", True), ("<tool_call", True),
        ("I cannot look up that information.", False), ("xlookup(recipe)", False), ("a lookup table", False), ("tool_call", False),
    ],
    calls.call_attempted,
)

_texts(
    "final_answer_cases",
    [
        ("It needs iron.", "It needs iron."),
        (" It needs iron. <|im_end|>rest", "It needs iron."),
        ("<think>let me see</think>\nIron.", "Iron."),
        ("<think>a\nb</think> Iron. <|im_start|>user", "Iron."),
        ("<think>never closed, iron", None),
        ("closed only</think> iron", None),
        ("<think>a</think><think>b</think>iron", None),
        ("first <think>a</think> iron", None),
        ("<think>a</think>  ", None),
        ("", None),
        ("<tool_call>x</tool_call>", None),
        ("iron <tool_call", None),
        ("iron <|im_end|><tool_call>", "iron"),
    ],
    calls.final_answer,
    "answer",
)

_PHRASES = [
    ("you need oak planks here", "oak planks", True), ("OAK  planks", "oak planks", True), ("oak\nplanks", "Oak Planks", True),
    ("oak-planks", "oak planks", False), ("oaken planks", "oak planks", False), ("oak planksx", "oak planks", False), ("2oak planks", "oak planks", False),
    ("(oak planks)", "oak planks", True), ("level 15", "1", False), ("level 1.", "1", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("9.5 (ok)", "9.5 (ok", True),
]


@query(_oracle("found", [(e,) for *_, e in _PHRASES]))
def phrase_cases(spark, sf):
    """Whole phrases, any blanks for a blank, no letter or digit beside them."""
    rows = _rows(spark, sf, [{"text": t, "phrase": p} for t, p, _ in _PHRASES], "text:string,phrase:string")
    return rows.select("s_suppkey", "n", calls.contains_phrase(F.col("text"), F.col("phrase")).alias("found"))


_BOUND = [
    ("recipe", "minecraft:piston", "To craft piston you need this", True), ("recipe", "minecraft:piston", "craft a piston so", True),
    ("recipe", "minecraft:piston", "You make the  Piston", True), ("recipe", "minecraft:piston", "craft pistons", False),
    ("recipe", "minecraft:piston", "crafts piston", False), ("recipe", "minecraft:oak_planks", "make an oak planks", True),
    ("recipe", "minecraft:piston", "piston is made", False), ("loot", "minecraft:entities/cave_spider", "A cave spider drops string", True),
    ("loot", "minecraft:entities/cave_spider", "cave spider can drop string", True), ("loot", "minecraft:entities/cave_spider", "cave spider will  drop it", True),
    ("loot", "minecraft:entities/spider", "cavespider drops", False), ("loot", "minecraft:blocks/bamboo_sapling", "Bamboo pressure plate drops: x", False),
    ("loot", "minecraft:entities/spider", "spider dropped", False), ("recipe", "minecraft:entities/spider", "spider drops", False), ("tag", "minecraft:x", "craft x", False),
]


@query(_oracle("bound", [(e,) for *_, e in _BOUND]))
def subject_cases(spark, sf):
    """An answer is about its subject, by category."""
    rows = _rows(spark, sf, [{"category": c, "k": k, "a": a} for c, k, a, _ in _BOUND], "category:string,k:string,a:string")
    return rows.select("s_suppkey", "n", calls.subject_bound(F.col("category"), F.col("k"), F.col("a")).alias("bound"))


_texts(
    "refusal_cases",
    [
        ("The fact does not provide any information about it.", True), ("I can't tell you which it is", True), ("Unable to determine the answer", True),
        ("There is no information on it", True), ("The given fact, sadly, doesn't mention it", True), ("It cannot say whether", True),
        ("Wolves do not provide these benefits.", False), ("It does not contain iron", False), ("The fact is well known", False), ("no, information is there", False),
    ],
    calls.refused,
)

_CLAIMS = [
    ("A lever opens the door", True, False, False), ("It OPENED", True, False, False), ("reopening it", False, False, False), ("locked", True, False, False),
    ("It can be used to sort items", False, True, False), ("It lets you find ores", False, True, False), ("a storage", False, False, False),
    ("Diamond is rarer", False, False, True), ("It is faster than iron", False, False, True), ("deals more attack damage than a sword", False, False, True),
    ("contains more ore", False, False, True), ("more of it", False, False, False), ("compared to gold it powers and stores", True, True, True),
]


@query(_oracle("mechanism, capability, comparative", [e for _, *e in _CLAIMS]))
def claim_cases(spark, sf):
    """The three shapes of claims."""
    rows = _rows(spark, sf, [{"text": t} for t, *_ in _CLAIMS], "text:string")
    return rows.select("s_suppkey", "n", *(calls.claim_shape(F.col("text"), k).alias(k) for k in ("mechanism", "capability", "comparative")))


_texts("degenerate_cases", [("ab c", False), ("ab", True), ("abc", True), ("a 1 2", True), ("abc 1", True), ("ab 12 c", False), ("", True), ("é ü ö", False), ("...", True)], calls.degenerate)

_ACTIONS = [
    ("<tool_call>action(craft, item='oak_planks', count=4)</tool_call>", "craft", "item=oak_planks,count=4.0"),
    ("action( goto_block , block='crafting_table', radius=-1.5 )", "goto_block", "block=crafting_table,radius=-1.5"),
    ("action(sleep)", "sleep", ""),
    ("action(equip, item='', slot=x)", "equip", "item="),
    ("lookup(recipe, result_item='x')", None, None),
]


@query(_oracle("tool, args", [e for _, *e in _ACTIONS]))
def action_cases(spark, sf):
    """An action's tool and its arguments with their types."""
    rows = _rows(spark, sf, [{"text": t} for t, *_ in _ACTIONS], "text:string")
    a = calls.parse_action(F.col("text"))
    args = F.array_join(F.transform(a["args"], lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["text"], x["number"].cast("string")))), ",")
    return rows.select("s_suppkey", "n", a["tool"].alias("tool"), args.alias("args"))


_SCORES = [
    ("enchantment", "known", "minecraft:mending", ["max_level=1"], "Mending has a maximum level of 1.", True),
    ("enchantment", "known", "minecraft:channeling", ["max_level=1"], "Mending has a maximum level of 1.", False),
    ("enchantment", "known", "minecraft:mending", ["max_level=1"], "Unmending has a maximum level of 1.", False),
    ("enchantment", "known", "minecraft:mending", ["max_level=1"], "Mending has a maximum level of 15.", False),
    ("recipe", "known", "minecraft:shears", ["minecraft:iron_ingot"], "To craft shears you need: iron ingot.", True),
    ("recipe", "known", "minecraft:shears", ["minecraft:iron_ingot"], "To craft piston you need: cobblestone, redstone, planks, and iron ingot.", False),
    ("recipe", "known", "minecraft:piston", ["minecraft:oak_planks", "minecraft:iron_ingot"], "you need oak planks and an iron ingot", False),
    ("recipe", "known", "minecraft:piston", ["minecraft:oak_planks", "minecraft:iron_ingot"], "To make a piston take oak planks", False),
    ("loot", "known", "minecraft:blocks/bamboo_sapling", ["minecraft:bamboo"], "Bamboo sapling drops: bamboo.", True),
    ("loot", "known", "minecraft:blocks/bamboo_sapling", ["minecraft:bamboo"], "Bamboo pressure plate drops: bamboo pressure plate.", False),
    ("villager_trade", "known", "minecraft:mason/4/x", ["wants=1 minecraft:emerald", "gives=1 minecraft:white_terracotta"], "The villager wants 1 emerald and gives 1 white terracotta.", True),
    ("villager_trade", "known", "minecraft:mason/4/x", ["wants=1 minecraft:emerald", "gives=1 minecraft:white_terracotta"], "The villager wants 1 emerald and gives 1 white glazed terracotta.", False),
    ("villager_trade", "known", "minecraft:cleric/4/x", ["wants=4 minecraft:turtle_scute", "gives=1 minecraft:emerald"], "The Cleric/4/Turtle Scute Emerald trade is of level 4; what is wanted and given?", False),
    ("painting", "known", "minecraft:skeleton", ["width=4", "height=3"], "The skeleton painting is 4 wide and 3 tall.", True),
    ("painting", "known", "minecraft:skeleton", ["width=4", "height=3"], "The skeleton painting is 3 wide.", False),
    ("tag", "known", "minecraft:planks", ["minecraft:oak_planks", "minecraft:birch_planks"], "It has oak planks and birch planks.", True),
    ("tag", "known", "minecraft:big", [f"minecraft:m{i:02}" for i in range(13)], "It has 13 members, such as m00, m05 and m12.", True),
    ("tag", "known", "minecraft:big", [f"minecraft:m{i:02}" for i in range(13)], "It has 13 members, such as m00 and m05.", False),
    ("tag", "known", "minecraft:big", [f"minecraft:m{i:02}" for i in range(13)], "It has m00, m05 and m09.", False),
    ("breeding_food", "known", "pig", ["minecraft:carrot"], "Pigs eat carrots.", True),
    ("breeding_food", "known", "pig", ["minecraft:carrot"], "I don't have data on a pig's carrot.", False),
    ("recipe", "unknown", "minecraft:dragon_sword", [], "I couldn't find a recipe for that item.", True),
    ("recipe", "unknown", "minecraft:dragon_sword", [], "To craft a dragon sword you need fire.", False),
    ("usage", "usage", None, [], "There is no information on that.", True),
    ("recipe", "multihop", "minecraft:piston", ["minecraft:oak_log"], "First planks; these take an oak log.", True),
    ("recipe", "multihop", "minecraft:piston", ["minecraft:oak_log"], "First planks.", False),
    ("tag", "known", "minecraft:planks", ["minecraft:oak_planks"], None, False),
]


@query(_oracle("passed", [(e,) for *_, e in _SCORES]))
def scorer_cases(spark, sf):
    """The scorer by category, on answers that differ in one thing."""
    rows = [{"category": c, "kind": d, "k": k, "expected": e, "answer": a} for c, d, k, e, a, _ in _SCORES]
    rows = _rows(spark, sf, rows, "category:string,kind:string,k:string,expected:array<string>,answer:string")
    return rows.select("s_suppkey", "n", traces.score(*(F.col(c) for c in ("category", "kind", "answer", "expected", "k"))).alias("passed"))


_CONTRACTS = [
    ("usage", [], [], False, True), ("usage", [], [], True, False), ("usage", ["tag|x"], [], True, False),
    ("unknown", ["recipe|dragon"], ["recipe|saber"], True, False), ("unknown", ["recipe|saber"], ["recipe|saber"], True, True),
    ("known", ["recipe|a", "tag|b"], ["recipe|a"], True, True), ("known", [], ["recipe|a"], True, False),
    ("multihop", ["recipe|a", "recipe|b"], ["recipe|a", "recipe|b"], True, True), ("multihop", ["recipe|a", "recipe|c"], ["recipe|a", "recipe|b"], True, False),
    ("multihop", ["recipe|a"], ["recipe|a", "recipe|b"], True, False), ("multihop", ["recipe|a", "recipe|b", "tag|c"], ["recipe|a", "recipe|b"], True, True),
]


@query(_oracle("good", [(e,) for *_, e in _CONTRACTS]))
def contract_cases(spark, sf):
    """What calls an item of a kind asks for; an attempt is a call for questions about uses."""
    rows = [{"kind": k, "made": m, "expected": e, "attempted": a} for k, m, e, a, _ in _CONTRACTS]
    rows = _rows(spark, sf, rows, "kind:string,made:array<string>,expected:array<string>,attempted:boolean")
    return rows.select("s_suppkey", "n", traces.contract(*(F.col(c) for c in ("kind", "made", "expected", "attempted"))).alias("good"))


_FACTS = [
    ("int_equals", ["5"], "Level 5 it is", True), ("int_equals", ["5"], "Level 15", False), ("int_equals", ["178.0"], "178 seconds", True),
    ("contains_any", ["minecraft:iron_ingot", "minecraft:stick"], "an Iron Ingot", True), ("contains_any", ["#minecraft:planks"], "iron", False),
    ("contains_all", ["minecraft:iron_ingot", "minecraft:stick"], "iron_ingot and stick", True), ("contains_all", ["minecraft:iron_ingot", "minecraft:stick"], "a stick", False),
    ("contains_all_pair", ["minecraft:blocks/oak_log"], "oak log", True),
]


@query(_oracle("passed", [(e,) for *_, e in _FACTS]))
def fact_score_cases(spark, sf):
    """Numbers as whole numbers, ids with underscores or spaces, any or all."""
    rows = _rows(spark, sf, [{"kind": k, "expected": e, "a": a} for k, e, a, _ in _FACTS], "kind:string,expected:array<string>,a:string")
    return rows.select("s_suppkey", "n", calls.fact_score(F.col("kind"), F.col("expected"), F.col("a")).alias("passed"))


_REGISTRY = [("item", "minecraft:carrot"), ("item", "minecraft:iron_ingot"), ("item", "minecraft:oak_planks"), ("block", "minecraft:piston"), ("entity_type", "minecraft:pig")]


def _registry(spark):
    return spark.createDataFrame(_REGISTRY, "registry string, id string")


_OBJECTS = [
    ("feed the pig minecraft:corn and minecraft:kelp", ["minecraft:corn", "minecraft:kelp", "(prose) minecraft"]),
    ("Smelt mithril ore", ["(prose) smelt mithril"]),
    ("breed them with golden corn", ["(prose) golden corn"]),
    ("feed them carrot", []),
    ("breed it with a carrot.", []),
    ("an iron ingot and oak planks", []),
    ("feed your pig corn", ["(prose) corn"]),
]


@query("SELECT s_suppkey, c.* FROM supplier, (VALUES " + ", ".join(f"({i}, {_literal(x)})" for i, (_, e) in enumerate(_OBJECTS) for x in e) + ") AS c(n, label)")
def fabricated_object_cases(spark, sf):
    """Ids that no registry has, and nouns in three places that resolve to none."""
    rows = _rows(spark, sf, [{"text": t} for t, _ in _OBJECTS], "text:string").withColumn("key", F.struct("s_suppkey", "n"))
    found = reshaping.fabricated_objects(rows.select("key", "text"), "key", "text", _registry(spark).unionByName(spark.sql("SELECT 'item' AS registry, 'minecraft:iron' AS id")))
    return found.select("key.s_suppkey", "key.n", "label")


_NOUNS = [("carrot", "minecraft:carrot"), (" Iron Ingot ", "minecraft:iron_ingot"), ("iron_ingot", "minecraft:iron_ingot"), ("corn", None), ("PIG", "minecraft:pig")]


@query(_oracle("id", [(e,) for _, e in _NOUNS]))
def noun_cases(spark, sf):
    """Plain names in any case, with spaces or underscores."""
    rows = _rows(spark, sf, [{"noun": t} for t, _ in _NOUNS], "noun:string")
    found = lookup.resolve_nouns(rows, _registry(spark))
    return rows.join(found, "noun").select("s_suppkey", "n", "id")


_SCOPED = [("minecraft:carrot", "item", True, True), ("minecraft:carrot", "block", True, False), ("minecraft:corn", "item", False, False), ("minecraft:pig", "entity_type", True, True)]


@query(_oracle("anywhere, there", [(a, b) for _, _, a, b in _SCOPED]))
def registry_scope_cases(spark, sf):
    """Whether an id exists at all, and in a given registry."""
    rows = _rows(spark, sf, [{"id": i, "registry": r} for i, r, _, _ in _SCOPED], "id:string,registry:string")
    any_where = lookup.existing(rows, _registry(spark)).select("s_suppkey", "n", F.lit(True).alias("anywhere"))
    there = lookup.existing(rows, _registry(spark), scoped=True).select("s_suppkey", "n", F.lit(True).alias("there"))
    out = rows.join(any_where, ["s_suppkey", "n"], "left").join(there, ["s_suppkey", "n"], "left")
    return out.select("s_suppkey", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("anywhere", "there")))


_LINES = [f"lookup({t}, {a}='KEY')" for t, a in calls.ARGUMENTS.items()]
_WHOLE = "Manifest-Version: minecraft-lookup-manifest-v1\nText.\n" + "\n".join(_LINES)
_texts(
    "manifest_cases",
    [
        (_WHOLE, ""), (_WHOLE.replace("-v1", "-v2"), "version"), ("\n".join(_LINES), "version"), (_WHOLE.replace("\n" + _LINES[3], ""), "signatures"),
        (_WHOLE + "\n" + _LINES[0], "signatures"), (_WHOLE.replace("tag='KEY'", "name='KEY'"), "signatures"), (_WHOLE.replace(_LINES[1], " " + _LINES[1]), "signatures"),
        ("", "empty"), ("\n".join([_LINES[0]]), "version,signatures"), ("Manifest-Version:   minecraft-lookup-manifest-v1  \n" + "\n".join(reversed(_LINES)), ""),
    ],
    reshaping.manifest_faults,
    "faults",
)

_MATCHES = [
    ("action(craft, item='a', count=1)", "action(craft, item='a', count=4)", True), ("action(craft, item='b')", "action(craft, item='a')", False),
    ("action(equip, item='a')", "action(craft, item='a')", False), ("done", "action(craft, item='a')", False), ("done", "Made it.", True),
    ("action(craft, item='a')", "Made it.", False), ("action(goto_block, block='x')", "action(goto_block, block='crafting_table')", True),
]


@query(_oracle("match", [(e,) for *_, e in _MATCHES]))
def action_match_cases(spark, sf):
    """A turn against the reference's: the tool, and the item where that names one."""
    rows = _rows(spark, sf, [{"a": a, "b": b} for a, b, _ in _MATCHES], "a:string,b:string")
    return rows.select("s_suppkey", "n", calls.action_matches(F.col("a"), F.col("b")).alias("match"))


_KEYS = ["minecraft:a", "a", "#minecraft:t", "other:x", ""]


@query(_oracle("id", [("minecraft:a",), ("minecraft:a",), ("#minecraft:t",), ("minecraft:other:x",), ("minecraft:",)]))
def namespace_cases(spark, sf):
    """Ids and references stay, all else gets the namespace."""
    from factloom.functions.names import namespaced

    rows = _rows(spark, sf, [{"k": k} for k in _KEYS], "k:string")
    return rows.select("s_suppkey", "n", namespaced(F.col("k")).alias("id"))


_DOCUMENTS = [{"b": 1, "a": [1, "é"]}, {"a": [1, "é"], "b": 1}, {"a": None}]


@query(
    "SELECT s_suppkey, n, sha256(t) AS sha FROM supplier, (VALUES "
    + ", ".join(f"({i}, {_literal(t)})" for i, t in enumerate(('{"a":[1,"é"],"b":1}', '{"a":[1,"é"],"b":1}', '{"a":null}')))
    + ") AS c(n, t)"
)
def canonical_digests(spark, sf):
    """A document's digest doesn't depend on the order of its keys or on blanks."""
    return _rows(spark, sf, [{"sha": evidence.canonical_sha256(d)} for d in _DOCUMENTS], "sha:string").select("s_suppkey", "n", "sha")
