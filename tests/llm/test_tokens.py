"""Encoding against the public libraries, the prefix table's edits, and whole tables."""

import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from driftline.llm import tokens  # noqa: E402

ALPHABET = ["a", "b", "the", " the", "  ", "\n", "\t", "\r\n", "é", "日本", "ʼ", "'s", "'re", "12", "½", "²", "_", "==", "😀", "\x1c", "\x85", "​", "नम", "ß", "<|endoftext|>", "\\u6e96", "....", "A" * 40]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder.load()


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{tokens.DEFAULT_FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def text_of(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_equals_the_library(encoder, reference, seed):
    text = text_of(random.Random(seed), 200)
    assert encoder.encode(text) == reference(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n\n", "a" * 5000, "ab" * 3000, " " * 3000, "é" * 1000, "1" * 999])
def test_long_and_blank_texts(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


def test_null(encoder):
    assert encoder.encode(None) == []


def test_every_prefix_is_encoded(encoder):
    table = tokens.PrefixTable(encoder.vocabulary, b"internationalisation of thethethe")
    for n in range(len(table.data) + 1):
        assert table.ids(n) == tokens.PrefixTable(encoder.vocabulary, table.data[:n]).ids()


@pytest.mark.parametrize("seed", range(10))
def test_prefix_table_appends_and_edits(encoder, seed):
    rnd = random.Random(seed)
    make = lambda n: bytes(rnd.choice(b"abcdehinorst ,.e") for _ in range(n))
    table = tokens.PrefixTable(encoder.vocabulary, make(600))
    for _ in range(12):
        if rnd.random() < 0.3:
            table.append(make(rnd.randrange(20)))
        else:
            a = rnd.randrange(len(table.data))
            b = min(len(table.data), a + rnd.randrange(10))
            table.edit(a, b, make(rnd.randrange(10)))
        assert table.ids() == tokens.PrefixTable(encoder.vocabulary, table.data).ids()


def test_an_edit_does_not_run_to_the_end(encoder):
    rnd = random.Random(1)
    table = tokens.PrefixTable(encoder.vocabulary, bytes(rnd.choice(b"abcdehinorst ,.e") for _ in range(20_000)))
    assert table.edit(100, 103, b"xyz!") < 2_000


@pytest.mark.parametrize("seed", range(10))
def test_tape_follows_appends_and_edits(encoder, seed):
    rnd = random.Random(seed)
    tape = tokens.TokenTape(encoder, text_of(rnd, 100))
    for _ in range(10):
        text = tape.text
        new = text_of(rnd, rnd.randrange(4))
        if rnd.random() < 0.4:
            tape.append(new)
            text += new
        else:
            a = rnd.randrange(len(text) + 1)
            b = min(len(text), a + rnd.randrange(12))
            tape.edit(a, b, new)
            text = text[:a] + new + text[b:]
        assert tape.text == text
        assert tape.ids() == encoder.encode(text)


def test_documents(spark, encoder):
    rows = [(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (4, "hello world"), (5, "x" * 20_000)]
    df = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id bigint, text string, ids string, tokens int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_documents(df).collect())
    assert got == sorted((i, encoder.encode(t)) for i, t in rows)
    counts = tokens.count_tokens(df, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.tokens) for r in counts) == sorted((i, len(encoder.encode(t))) for i, t in rows)
    assert tokens.encode_documents(df.limit(0)).collect() == []
    assert tokens.encode_documents(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_another_vocabulary(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = tokens.Encoder.load("byte_bpe_multi_50k")
    ref = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=enc.vocabulary.ranks, special_tokens={})
    rnd = random.Random(5)
    for _ in range(200):
        data = "".join(rnd.choice("abdeinorst 日本語नमस्те") for _ in range(30))
        assert enc.vocabulary.encode(data.encode()) == ref.encode_ordinary(data)
