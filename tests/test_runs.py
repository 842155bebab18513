"""Evidence, dispatch, craft traces, builds with broken files, and what must be an error."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import adapters, evidence, generation, graph, lookup, relations, tasks, traces
from factloom.sources import scratch, sinks


def test_arms_that_are_no_pair_are_refused(spark):
    rows = [(i, f"q{i}", 7, "p") for i in range(5)]
    arm = lambda r: spark.createDataFrame(r, "i int, question string, seed int, prompt string")
    check = lambda b: evidence.check_pairing(arm(rows), arm(b), "i", ["question"], "seed", "prompt")
    assert check(rows) == 5
    for changed, name in ((rows[:4], "unpaired"), ([(0, "other", 7, "p"), *rows[1:]], "identity"), ([(0, "q0", 8, "p"), *rows[1:]], "seed"), ([(0, "q0", 7, None), *rows[1:]], "prompt")):
        with pytest.raises(ValueError, match=name):
            check(changed)
    with pytest.raises(ValueError, match="no rows"):
        evidence.check_pairing(arm([]), arm([]), "i", ["question"], "seed", "prompt")


def test_inputs_that_change_and_outputs_onto_inputs_are_refused(tmp_path):
    before = evidence.bind({"db": "a", "probe": "b"}, {"seed": 1})
    assert evidence.finalize(before, evidence.bind({"db": "a", "probe": "b"}, {}))["complete"]
    with pytest.raises(RuntimeError, match="probe"):
        evidence.finalize(before, evidence.bind({"db": "a", "probe": "c"}, {}))
    (tmp_path / "model").mkdir()
    (tmp_path / "db").write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "db")
    inputs = {"model": str(tmp_path / "model"), "db": str(tmp_path / "db"), "none": None}
    evidence.refuse_aliases(str(tmp_path / "out.json"), inputs)
    for target in ("db", "link", "model/out.json", "model"):
        with pytest.raises(ValueError, match="onto or into"):
            evidence.refuse_aliases(str(tmp_path / target), inputs)


def test_a_nonce_serves_once_and_for_its_user(spark):
    asked = [("r1", "ann", "mine", "n1", 100), ("r2", "ann", "fly", "n2", 100), ("r3", "bob", "attack", "n3", 100), ("r4", "ann", "place", "n4", 100)]
    said = [("c0", "ann", "n1", 100), ("c1", "bob", "n1", 101), ("c2", "ann", "n1", 130), ("c3", "ann", "n1", 130), ("c4", "ann", "n4", 131), ("c5", "ann", "n9", 101), ("c6", "bob", "n3", 101)]
    ts = F.timestamp_seconds("at").alias("ts")
    r = spark.createDataFrame(asked, "request_id string, user_id string, tool string, nonce string, at long").select("request_id", "user_id", "tool", "nonce", ts)
    c = spark.createDataFrame(said, "confirm_id string, user_id string, nonce string, at long").select("confirm_id", "user_id", "nonce", ts)
    got = {x.id: (x.outcome, x.partner) for x in relations.dispatch(r, c, (2,)).collect()}
    assert got == {
        "r1": ("executed", "c2"), "r2": ("unknown", None), "r3": ("disabled", None), "r4": ("unconfirmed", None),
        "c0": ("none", None), "c1": ("other_user", "r1"), "c2": ("executed", "r1"), "c3": ("used", "r1"), "c4": ("expired", "r4"), "c5": ("none", None), "c6": ("none", None),
    }


def test_a_breaker_opens_after_three_and_for_its_batch(spark):
    rows = [("a", i, i in (1, 2, 3, 5)) for i in range(7)] + [("b", i, i % 2 == 0) for i in range(7)]
    got = tasks.broken_circuits(spark.createDataFrame(rows, "batch string, i int, t boolean"), ["batch"], "i", F.col("t"))
    assert sorted((r.batch, r.i) for r in got.where("open").collect()) == [("a", 4), ("a", 5), ("a", 6)]


def test_craft_traces_tell_recorded_results(spark):
    rows = [(1, "full", "minecraft:sword", ["minecraft:stick"], [], {"minecraft:stick": "plank"}, ["at table", "8 sticks", "1 sword"], 0, 1)]
    schema = "task int, shape string, target string, prereqs array<string>, missing array<string>, recipes map<string,string>, results array<string>, before int, after int"
    (r,) = tasks.craft_traces(spark.createDataFrame(rows, schema)).collect()
    said = [m.content for m in r.messages if m.content.startswith("<result>")]
    assert said == [f"<result>{x}</result>" for x in ("at table", "plank", "8 sticks", "", "1 sword")]
    assert r.completed and r.messages[0].content == "Craft sword." and r.messages[-1].content == "Made sword (before 0, now 1)."


def test_broken_files_are_passed_over_in_tags_alone(spark, tmp_path):
    from factloom.plans import oracle

    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("data/minecraft/tags/item/pig_food.json", json.dumps({"values": ["minecraft:carrot"]}))
    put("data/minecraft/tags/item/bad.json", "{")
    put("data/minecraft/recipe/a.json", json.dumps({"type": "minecraft:stonecutting", "ingredient": "minecraft:b", "result": {"id": "minecraft:a"}}))
    tables = oracle.build_oracle(spark, str(tmp_path))
    assert [tuple(r) for r in tables["breeding_food"].collect()] == [("pig", "minecraft:carrot")]
    assert tables["ore_depth"].count() == 0
    put("data/minecraft/recipe/bad.json", "{")
    with pytest.raises(Exception, match="not JSON"):
        oracle.build_oracle(spark, str(tmp_path))["recipe"].collect()


def test_a_recipe_answers_one_method(spark):
    from factloom.plans import oracle

    slots = [("minecraft:torch", "minecraft:torch", 0, "minecraft:coal"), ("minecraft:torch", "minecraft:torch", 0, "minecraft:charcoal"), ("minecraft:torch", "minecraft:torch", 1, "minecraft:stick"), ("minecraft:torch", "minecraft:alt", 0, "minecraft:lava")]
    slots = spark.createDataFrame(slots, "result_item string, method string, slot int, ingredient string")
    flat = spark.createDataFrame([("minecraft:torch", "minecraft:coal"), ("minecraft:old", "minecraft:b"), ("minecraft:old", "minecraft:a")], "result_item string, ingredient string")
    truth = oracle.truth_view({"recipe": flat, "recipe_slot": slots})
    assert {r.key: r.result for r in truth.collect()} == {"minecraft:torch": "minecraft:charcoal/minecraft:coal, minecraft:stick", "minecraft:old": "minecraft:a, minecraft:b"}
    called = spark.createDataFrame([("recipe", "TORCH"), ("recipe", "minecraft:none")], "tbl string, key string")
    assert {r.key: r.result for r in lookup.execute(called, truth).collect()} == {"TORCH": "minecraft:charcoal/minecraft:coal, minecraft:stick", "minecraft:none": lookup.NO_ROWS}


def test_traces_of_other_shapes_are_not_good(spark):
    truth = spark.createDataFrame([("tag", "minecraft:t", "minecraft:a")], "tbl string, key string, result string")
    call = "<tool_call>lookup(tag, tag='t')</tool_call>"
    shapes = [
        ["q", call, "<result>minecraft:a</result>", "It has a."],
        ["q", call, "minecraft:a", "It has a."],
        ["q", "no call", "<result>minecraft:a</result>", "It has a."],
        ["q", call.replace("tag,", "other,"), "<result>(no rows)</result>", "There is no data."],
        ["q", call, "<result>minecraft:a</result>"],
        ["q"],
        [],
    ]
    rows = spark.createDataFrame([(i, [("user", c) for c in s]) for i, s in enumerate(shapes)], "trace_id int, messages array<struct<role:string,content:string>>")
    assert [r.trace_id for r in traces.verify(rows, truth).collect() if r.ok] == [0]
    assert traces.verify(rows, truth).count() == len(shapes)


def test_too_many_clamps_and_too_large_documents_are_errors(spark, monkeypatch):
    body = "7"
    for _ in range(adapters.MOST_CLAMPS + 1):
        body = '{"type": "minecraft:clamped", "source": ' + body + "}"
    with pytest.raises(Exception, match="too many clamps"):
        spark.range(1).select(adapters.resolve_count(F.lit(body))).collect()
    monkeypatch.setattr(sinks, "MOST_DOCUMENT_ROWS", 5)
    assert sinks.dump_document({"x": spark.range(5)}).count() == 1
    with pytest.raises(ValueError, match="too large"):
        sinks.dump_document({"x": spark.range(6)})


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return default

        class sparkContext:
            master = "local-cluster[2,1,1024]"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)


def test_closure_doubles_its_paths(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "tag string, ref string")
    assert graph.paths(chain).count() == 40 * 41 // 2


def test_scenarios_come_in_pairs(spark):
    rows = generation.scenarios(spark.range(200).select(F.col("id").alias("k")), "k").collect()
    assert len(rows) == 400 and {r.scenario for r in rows} == set(generation.SCENARIOS)
    assert all(("TOOL_CALL: " in r.response) == (r.step == 1) and ("Tool result: " in r.instruction) == (r.step == 2) for r in rows)


def test_dense_cells_are_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(relations, "CELL_POINTS", 3)
    points = [(i, float(i % 4) / 8, 0.0, float(i // 40)) for i in range(80)]
    a, b = (spark.createDataFrame(rows, "id long, x double, y double, z double") for rows in (points, points[::7]))
    got = sorted((r.a_id, r.b_id) for r in relations.near_pairs(a, b, 0.2).collect())
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p[1:], q[1:], strict=True)) ** 0.5
    assert got == sorted((p[0], q[0]) for p in points for q in points[::7] if far(p, q) <= 0.2)


def test_digests_of_trees(spark):
    import hashlib

    rows = [(t, f"f{k}", bytes([k]) * k) for t in ("a", "b") for k in range(5)] + [("b", "empty", None)]
    files = spark.createDataFrame(rows, "tree string, path string, content binary")
    plain = lambda t: hashlib.sha256(b"".join(p.encode() + b"\0" + (c or b"") + b"\0" for n, p, c in sorted(rows, key=lambda r: r[1]) if n == t)).hexdigest()
    assert {r.tree: (r.files, r.digest) for r in evidence.tree_digests(files, "tree").collect()} == {"a": (5, plain("a")), "b": (6, plain("b"))}
    assert evidence.tree_sha256(files.where("tree = 'a'").drop("tree")) == plain("a")
    assert evidence.tree_sha256(files.limit(0).drop("tree")) == hashlib.sha256().hexdigest()
