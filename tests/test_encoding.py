"""Encoding, char ids, padding and chunk streams (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from textlm.operators import encoding as enc
from textlm.operators import sequences as sq

KEYS = ("doc_id", "line")


@pytest.fixture(scope="module")
def vocab(spark):
    lines = spark.createDataFrame([(i, w) for i, w in enumerate(["<S>", "</S>", "<UNK>", "!!!MAXTERMID", "a", "b"])],
                                  "ln long, value string")
    return enc.vocab_from_lines(lines)


def test_vocab_file_semantics(vocab):
    v, sp = vocab
    ids = {r.word: r.id for r in v.collect()}
    assert ids == {"<S>": 0, "</S>": 1, "<UNK>": 2, "a": 3, "b": 4}
    assert tuple(sp.first()) == (0, 1, 2)


def test_missing_markers_fail(spark):
    lines = spark.createDataFrame([(0, "a"), (1, "b")], "ln long, value string")
    _, sp = enc.vocab_from_lines(lines)
    with pytest.raises(Exception):
        sp.collect()


def test_encode_forward_reverse_and_padding(spark, vocab):
    v, sp = vocab
    s = spark.createDataFrame([(1, 0, ["a", "z", "b"]), (2, 0, ["a"])], "doc_id long, line long, tokens array<string>")
    fwd = {r.doc_id: r.ids for r in enc.encode(s, v, sp, KEYS).collect()}
    assert fwd[1] == [0, 3, 2, 4, 1]
    rev = s.withColumn("tokens", F.reverse("tokens"))
    assert {r.doc_id: r.ids for r in enc.encode(rev, v, sp, KEYS, reverse=True).collect()}[1] == [1, 4, 2, 3, 0]
    batched = enc.encode(s, v, sp, KEYS).withColumn("batch", F.lit(0))
    pad = {r.doc_id: r.padded for r in enc.pad_token_batch(batched).collect()}
    assert pad[1] == [1, 4, 3, 5, 2] and pad[2] == [1, 4, 2, 0, 0]
    _, length, wo = enc.mask_lengths(F.col("padded"))
    got = {r.doc_id: (r.l, r.w) for r in enc.pad_token_batch(batched).select("doc_id", length.alias("l"), wo.alias("w")).collect()}
    assert got == {1: (5, 3), 2: (3, 1)}
    dec = {r.doc_id: r.text for r in enc.decode(enc.encode(s, v, sp, KEYS), v, KEYS).collect()}
    assert dec[2] == "<S> a </S>" and dec[1] == "<S> a <UNK> b </S>"


def test_char_ids(spark):
    df = spark.createDataFrame([("ab",), ("é",), ("abcdef",), ("<S>",)], "w string")
    got = {r.w: r.c for r in df.select("w", enc.char_ids(F.col("w"), 6).alias("c")).collect()}
    assert got["ab"] == [258, 97, 98, 259, 260, 260]
    assert got["é"] == [258, 195, 169, 259, 260, 260]
    assert got["abcdef"] == [258, 97, 98, 99, 100, 259]
    assert got["<S>"] == [258, 256, 259, 260, 260, 260]


def test_next_token_chunks(spark):
    enc_df = spark.createDataFrame([(1, 0, [0, 3, 4, 1]), (1, 1, [0, 4, 1])], "doc_id long, line long, ids array<bigint>")
    got = sorted((r.chunk, r.inputs, r.targets) for r in sq.next_token_chunks(enc_df, list(KEYS), 1, 2).collect())
    assert got == [(0, [0, 3], [3, 4]), (1, [4, 0], [1, 4])]
