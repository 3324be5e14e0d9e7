"""Token counts and segmentations against the libraries that define them."""

import random

import numpy as np
import pytest
import sentencepiece
import tokenizers

from lattice.llm import dropout, tokencount
from lattice.llm.queries import tokenizer_path

BYTES, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'ll", "'l", "é", "日本", "1", "²", "٣", "!", "...", "_", "　", "\t", "<|endoftext|>", "hello", "World", "\x1c", "́", "😀", "don't", "'", "t", "\x85", "re", "ve"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(BYTES)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_every_prefix_has_the_library_s_count(library):
    count, rnd = tokencount.counter(BYTES), random.Random(1)
    for _ in range(300):
        s = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 12)))
        steps = count(s)
        assert np.cumsum(steps).tolist() == [library(s[:i]) for i in range(1, len(s) + 1)], s
        for budget in (0, 2, 5):
            n = tokencount.fits(steps.tobytes(), budget)
            assert library(s[:n]) <= budget and all(library(s[:i]) > budget for i in range(n + 1, len(s) + 1))


def test_prefix_counts_of_a_table(spark, library):
    texts = ["hello world", None, "", "a" * 3000, "x <|endoftext|> y", " " * 2000]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in enumerate(texts)] + [(None, "tie", 9, "z")], "doc_id long, text string, n_bytes long, steps string")
    got = tokencount.prefix_counts(spark, df, BYTES).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), library(t or "")) for i, t in enumerate([*texts])} | {None: (3, library("tie"))}
    assert all(tokencount.tokens_in(bytes(r.steps), 5) == library((texts[r.doc_id] or "")[:5]) for r in got if r.doc_id is not None)
    assert tokencount.prefix_counts(spark, df.limit(0), BYTES).count() == 0


def _texts(n):
    rnd = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "the", "ing", "é", "日本語", "1", "²", "!", "...", "　", "\t", "hello", "World", "\x00", "́", "😀", "don't", "Ⅳ"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(n)] + ["aaaa" * 100, "日本" * 200, "", " " * 500, "ababab" * 60]


def test_without_dropout_ids_are_the_library_s():
    sp, e, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), dropout.encoder(PIECES), _texts(400)
    assert [x.tolist() for x in e.encode(texts)] == [sp.encode(t) for t in texts]


def test_dropout_is_lossless_and_the_same_by_heap(monkeypatch):
    e, texts = dropout.encoder(PIECES), [*_texts(200), "▁ a▁", "x▁"]
    keys = list(range(len(texts)))
    ids = e.encode(texts, 0.3, keys)
    assert [e.decode(x.tolist()) for x in ids] == texts
    assert any(len(x) != len(y) for x, y in zip(ids, e.encode(texts, 0.3, [k + 1 for k in keys]), strict=True))
    monkeypatch.setattr(dropout, "_LONG", 0)
    assert all(a.tolist() == b.tolist() for a, b in zip(ids, e.encode(texts, 0.3, keys), strict=True))


def test_encode_and_decode_a_table(spark):
    rows = [(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (1, "hello world", "a"), (4, "x" * 20_000, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    encoded = dropout.encode(spark, df, PIECES, 0.2)
    got = sorted((r.doc_id, r.text) for r in dropout.decode(spark, encoded, PIECES).collect())
    assert got == sorted((i, t or "") for i, t, _ in rows)
    assert encoded.where("doc_id = 1").select("ids").distinct().count() == 1
    out = dropout.round_trip(spark, df, PIECES, 0.2).collect()
    assert all(r.lossless for r in out) and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    assert dropout.round_trip(spark, df.limit(0), PIECES).count() == 0
