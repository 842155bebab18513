"""The pipeline's stages against brute force on their own inputs."""

import pytest

import corpus_pipeline
from factloom.llm import decontaminate, mixing, neardup, pii, toxicity
from factloom.llm.common import ascii_words


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]


def test_every_stage_does_its_work(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    from test_decontaminate import plain as plain_hits
    from test_neardup import plain_clusters

    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        after_df = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in after_df.collect()}
        if name != "mixing":
            assert after_df.columns == docs.columns and after_df.count() == len(after)
        if name == "toxicity":
            w, h = toxicity.train(docs, labels), toxicity.Hasher()
            want = {i for i, r in before.items() if w.score(h.features(ascii_words((r.text or "").encode()))) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            want = {i for i, _, _, kept in plain_clusters([(i, r.text) for i, r in before.items()], 5) if kept}
        elif name == "decontamination":
            want = {r[0] for r in plain_hits([(i, r.text) for i, r in before.items()], benchmark) if not r[-1]}
        elif name == "personal_data":
            want = set(before)
            assert not any(k in pii.BASE for r in after.values() for k, _, _ in pii.find_spans(r.text))
            assert all(r.text == before[i].text for i, r in after.items() if not pii.find_spans(before[i].text))
        else:
            want = {r.doc_id for r in mixing.mix(docs).collect()}
            assert 0 < len(want) < len(before)
        assert set(after) == want, name
        docs = after_df


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "", None, "s", 0)]])
def test_odd_inputs(spark, small, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component string")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert "copies" in docs.columns


def test_stages_take_any_names_and_very_long_texts(spark, small, tmp_path):
    """Each stage gets columns named as its own, dotted ones and texts of a megabyte."""
    names = ["gone", "again", "found_ranges", "row", "id", "n", "key", "part", "a.b", "score", "spans", "rep", "component_id", "mix_cut"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    long = " ".join(f"w{i * 31 % 9973}x{i % 89}" for i in range(120_000))
    rows = [(1, long, "en", "s", 1), (2, long + " end", "en", "s", 2), (3, "a@b.org wrote", "de", "t", 3), (4, None, None, None, None)]
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {1, 2} & {r.doc_id for r in docs.select("doc_id").collect()} or name == "mixing"
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 4]
        if name != "mixing":
            assert docs.columns == [f.split("`")[1] if "`" in f else f.split()[0] for f in schema.split(", ")]
    assert docs.columns[-3:] == ["mix_domain", "mix_tokens", "copies"] and set(names) <= set(docs.columns)
