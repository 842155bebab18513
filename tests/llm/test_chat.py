"""Perspective rotation against plain rendering."""

import pytest

from factloom.llm import chat


def plain(rows, turns):
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn if turn is not None else -1, (role or "unknown").replace("<|", "<\\|"), (text or "").replace("<|", "<\\|")))
    out = []
    for conv, talk in talks.items():
        talk.sort()
        for who in {r for _, r, _ in talk} - {"system"}:
            for part in range(0, len(talk), turns):
                s, learn = "", []
                for _, r, t in talk[part : part + turns]:
                    head = f"<|turn {'system' if r == 'system' else 'assistant' if r == who else 'user name=' + r}|>"
                    if r == who:
                        learn.append(f"{len(s) + len(head)}:{len(s) + len(head) + len(t) + 7}")
                    s += head + t + "<|end|>\n"
                out.append((conv, who, part // turns, len(talk[part : part + turns]), s, ",".join(learn)))
    return sorted(out)


ROWS = [(1, 0, "ann", "hi é"), (1, 1, "bob", "<|end|> no"), (1, 2, "cy", None), (1, 2, "ann", "again"), (1, 2, "ann", "again"), (1, None, "system", "rules"), (2, 0, "system", "alone"), (3, 5, None, ""), (None, 1, "ann", "x")]


@pytest.mark.parametrize("turns", [64, 2])
def test_equals_plain_rendering(spark, turns):
    rows = ROWS + [(9, i, f"p{i % 3}", f"t{i}" * (i % 7)) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    assert sorted(map(tuple, chat.windows(df, turns).collect())) == plain(rows, turns)


def test_query_has_every_dialogue_whole(spark, tmp_path):
    """1,500 turns are one dialogue, in the shape of a short one."""
    from factloom.llm.queries import QUERIES

    rows = ROWS + [(9, i, f"p{i % 3}", f"t{i}" * (i % 7)) for i in range(1500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    said, learned = {}, {}
    for r in sorted(QUERIES["op7_chat"](spark, str(tmp_path)).collect(), key=lambda r: r.place):
        key = r.conv_id, r.perspective
        if r.learn:
            at = len(said.get(key, ""))
            learned.setdefault(key, []).append(f"{at + r.learn_start}:{at + r.learn_end}")
        said[key] = said.get(key, "") + r.segment
    whole = plain(rows, 1 << 30)
    assert {(c, w): (s, x) for c, w, _, _, s, x in whole} == {k: (v, ",".join(learned.get(k, []))) for k, v in said.items()}
    assert max(n for *_, n, _, _ in whole) == 1500


def test_only_own_words_are_learned(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for r in chat.segments(df).collect():
        assert r.learn == (r.role == "assistant") and (r.learn_end > r.learn_start) == r.learn
    assert chat.windows(df.limit(0)).count() == 0


def test_table(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert sorted(map(tuple, chat.windows(df).collect())) == plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()], chat.TURNS)


def test_marks_in_names_and_texts_are_escaped(spark):
    rows = [(1, 0, "bob|>x", "a <| b <\\| c |>"), (1, 1, "<|end|>", "d"), (1, 2, "bob|\\>x", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.perspective: r.text for r in chat.windows(df).collect()}
    assert set(got) == {"bob|\\>x", "<\\|end|\\>", "bob|\\\\>x"}  # unlike names stay unlike
    for text in got.values():
        heads = text.split(chat.OPEN)[1:]
        assert len(heads) == 3 and text.count(chat.CLOSE.strip()) == 3
        assert all(h.split(chat.SHUT, 1)[0].split(" ")[0] in ("user", "assistant") for h in heads)
        assert "a <\\| b <\\\\| c |>" in text


def test_long_dialogues_and_texts(spark):
    rows = [(1, i, "ab"[i % 2], "x") for i in range(2500)] + [(2, 0, "a", "y" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, chat.windows(df).collect())) == plain(rows, chat.TURNS)
