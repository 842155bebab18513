"""Token counts against the library itself."""

import random

import pytest

from factloom.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokens.default_tokenizer())


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    random.seed(5)
    letters = "ab cd'stre  \n\t\r.,!?é ñ日本語1234567890  \x1c-—ſ​😀ǅⅫ٣　\x85\xa0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 80))) for _ in range(1500)]
    return texts + ["", " ", "  ", " " * 301, "a" * 5000, "the" * 3000, "-" * 500, "ab " * 9000, "x<|endoftext|> y<|endoftext|>", "don't I'll 's 'sx"]


@pytest.mark.parametrize("chunk", [1 << 14, 5, 33])
def test_equals_the_library_for_any_chunks(library, monkeypatch, chunk):
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    count = tokens.load(tokens.default_tokenizer())
    texts = odd_texts()
    assert [count(t) for t in texts] == counts(library, texts)


def test_composition_is_associative():
    count = tokens.load(tokens.default_tokenizer())
    random.seed(7)
    for _ in range(300):
        maps = [count.chunk_map("".join(random.choice("ab \n'.") for _ in range(random.randint(1, 7)))) for _ in range(3)]
        a, b, c = maps

        def total(m):
            return count.between(m) if isinstance(m, str) else count.between(m[0]) + m[1] + count.between(m[2])

        assert total(count.compose(count.compose(a, b), c)) == total(count.compose(a, count.compose(b, c)))


def test_states_can_be_dropped(monkeypatch):
    count = tokens.load(tokens.default_tokenizer())
    before = count("some words and numbers 12345")
    monkeypatch.setattr(tokens, "MOST_STATES", 1)
    count.seen.clear()
    count.words.clear()
    assert count("some words and numbers 12345") == before


def test_table(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = dict(zip(texts, counts(library, list(texts.values())), strict=True))
    rows = tokens.count_tokens(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), want[r.doc_id])
        assert r.over_limit == (r.n_tokens > 512)
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_tokens) for r in tokens.count_tokens(odd).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_empty_table_and_a_very_long_text(spark, library):
    text = "some words, 12 times é\n" * 60_000 + "x" * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = tokens.count_tokens(docs).collect()
    assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), counts(library, [text])[0], True)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_other_columns_may_have_the_names_of_the_result(spark, library):
    names = ["n_bytes", "n_tokens", "over_limit", "a.b", "`q`"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    docs = spark.createDataFrame([(1, "some words", *names), (1, "some words", *names)], schema)
    assert [(r.doc_id, r.n_tokens) for r in tokens.count_tokens(docs).collect()] == [(1, counts(library, ["some words"])[0])] * 2
