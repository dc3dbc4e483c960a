"""Encoding, batching and sequence queries.

The encoding queries run over the whole ``benchmark`` table (the second test
corpus, whitespace tokens as in the bidirectional path) with a special
vocabulary built from the training documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.functions.text import reverse_tokens, ws_tokens
from textlm.operators import bidirectional as bi
from textlm.operators import encoding as enc
from textlm.operators import ngram, sequences as sq, vocab as vc
from textlm.plans.registry import PPL_DIGITS, query, r
from textlm.sources import tables

CHAR_MAXLEN = 50
BATCH = 8
CHUNK_ROWS, CHUNK_STEPS = 4, 5
MIN_COUNT = 10
VAL_FRAC = 0.05
MINIBATCH = 128
KEYS = ("doc_id", "line")


def joined(c: str | Column, sep: str = ",") -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


def flat_joined(c: str) -> Column:
    return joined(F.flatten(F.col(c)))


def svocab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = tables.lines_of(tables.training_docs(spark, sf))
    words = lines.select(F.explode(ws_tokens(F.col("value"))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n"))
    v = enc.special_vocab(words, 2)
    return v, enc.specials_of(v)


def bench_lines(spark: SparkSession, sf: str) -> DataFrame:
    b = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tables.lines_of(b)


def bench_ws(spark: SparkSession, sf: str) -> DataFrame:
    return bench_lines(spark, sf).select(*KEYS, ws_tokens(F.col("value")).alias("tokens"))


def _line(df: DataFrame) -> Column:
    return F.col("line").cast("bigint").alias("line")


# ---------------------------------------------------------------- B3 / B4
@query("ws_tokens")
def q_ws_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.lines_of(tables.table(spark, sf, "documents").select("doc_id", "text"))
    t = lines.select("doc_id", "line", ws_tokens(F.col("value")).alias("t"))
    return t.select("doc_id", _line(t), F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("reversed_sentences")
def q_reversed_sentences(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.lines_of(tables.table(spark, sf, "documents").select("doc_id", "text"))
    t = lines.select("doc_id", "line", reverse_tokens(ws_tokens(F.col("value"))).alias("t"))
    return t.select("doc_id", _line(t), F.array_join("t", " ").alias("tokens"))


# ----------------------------------------------------------------- C7 - C13
@query("special_vocab")
def q_special_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return svocab(spark, sf)[0]


def _encoded(spark: SparkSession, sf: str, reverse: bool) -> DataFrame:
    v, sp = svocab(spark, sf)
    s = bench_ws(spark, sf)
    if reverse:
        s = s.withColumn("tokens", F.reverse("tokens"))
    return enc.encode(s, v, sp, KEYS, reverse=reverse)


@query("encoded_sentences")
def q_encoded_sentences(spark: SparkSession, sf: str) -> DataFrame:
    e = _encoded(spark, sf, False)
    return e.select("doc_id", _line(e), joined("ids").alias("ids"))


@query("encoded_reversed")
def q_encoded_reversed(spark: SparkSession, sf: str) -> DataFrame:
    e = _encoded(spark, sf, True)
    return e.select("doc_id", _line(e), joined("ids").alias("ids"))


@query("decoded_sentences")
def q_decoded_sentences(spark: SparkSession, sf: str) -> DataFrame:
    v, _ = svocab(spark, sf)
    d = enc.decode(_encoded(spark, sf, False), v, KEYS)
    return d.select("doc_id", _line(d), "text")


@query("word_char_ids")
def q_word_char_ids(spark: SparkSession, sf: str) -> DataFrame:
    words = bench_ws(spark, sf).select(F.explode("tokens").alias("word")).distinct()
    return words.select("word", joined(enc.char_ids(F.col("word"), CHAR_MAXLEN)).alias("char_ids"))


@query("encoded_chars")
def q_encoded_chars(spark: SparkSession, sf: str) -> DataFrame:
    e = enc.encode_chars(bench_ws(spark, sf), KEYS, CHAR_MAXLEN)
    return e.select("doc_id", _line(e), F.size("chars").cast("bigint").alias("n_rows"), flat_joined("chars").alias("chars"))


@query("padded_batches")
def q_padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = enc.batch_numbers(_encoded(spark, sf, False), list(KEYS), BATCH)
    p = enc.pad_token_batch(e)
    return p.select("doc_id", _line(p), "batch", joined("padded").alias("padded"))


def _char_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = enc.batch_numbers(enc.encode_chars(bench_ws(spark, sf), KEYS, CHAR_MAXLEN), list(KEYS), BATCH)
    return enc.pad_char_batch(e, CHAR_MAXLEN)


@query("padded_char_batches")
def q_padded_char_batches(spark: SparkSession, sf: str) -> DataFrame:
    p = _char_batches(spark, sf)
    return p.select("doc_id", _line(p), "batch", F.size("padded").cast("bigint").alias("n_rows"),
                    flat_joined("padded").alias("padded"))


@query("masks_lengths")
def q_masks_lengths(spark: SparkSession, sf: str) -> DataFrame:
    tok = enc.pad_token_batch(enc.batch_numbers(_encoded(spark, sf, False), list(KEYS), BATCH))
    ch = _char_batches(spark, sf)
    _, tl, tw = enc.mask_lengths(F.col("padded"))
    _, cl, _ = enc.mask_lengths(F.col("padded"), chars=True)
    a = tok.select(*KEYS, tl.alias("length"), tw.alias("length_wo_markers"))
    b = ch.select(*KEYS, cl.alias("char_length"))
    j = a.join(b, list(KEYS))
    return j.select("doc_id", _line(j), F.col("length").cast("bigint").alias("length"),
                    F.col("length_wo_markers").cast("bigint").alias("length_wo_markers"),
                    F.col("char_length").cast("bigint").alias("char_length"))


# ----------------------------------------------------------------- D9 - D14
def windex(spark: SparkSession, sf: str) -> DataFrame:
    return vc.word_index(vc.min_count(ngram.vocab_counts(tables.training_sentences(spark, sf)), MIN_COUNT))


def _seq(spark: SparkSession, sf: str) -> DataFrame:
    return sq.training_sequences(tables.training_sentences(spark, sf), windex(spark, sf))


def _seq_cols(df: DataFrame) -> list:
    return ["doc_id", _line(df), F.col("pos").cast("bigint").alias("pos"),
            F.col("c1").cast("bigint").alias("c1"), F.col("c2").cast("bigint").alias("c2"),
            F.col("y").cast("bigint").alias("y")]


@query("training_sequences")
def q_training_sequences(spark: SparkSession, sf: str) -> DataFrame:
    s = _seq(spark, sf)
    return s.select(*_seq_cols(s))


@query("training_sequences_ext")
def q_training_sequences_ext(spark: SparkSession, sf: str) -> DataFrame:
    from textlm.plans.q_vectors import word_vectors

    emb_index = word_vectors(spark, sf).select("word", "id")
    s = sq.training_sequences_ext(tables.training_sentences(spark, sf), emb_index, windex(spark, sf))
    return s.select(*_seq_cols(s))


@query("tail_split")
def q_tail_split(spark: SparkSession, sf: str) -> DataFrame:
    t = sq.tail_split(_seq(spark, sf), ["doc_id", "line", "pos"], VAL_FRAC)
    return t.select("doc_id", _line(t), F.col("pos").cast("bigint").alias("pos"), "rn", "split")


@query("minibatches")
def q_minibatches(spark: SparkSession, sf: str) -> DataFrame:
    t = sq.tail_split(_seq(spark, sf), ["doc_id", "line", "pos"], VAL_FRAC)
    b = sq.minibatches(t.where(F.col("split") == "train"), MINIBATCH)
    return b.select("doc_id", _line(b), F.col("pos").cast("bigint").alias("pos"), "batch")


def _chunks(spark: SparkSession, sf: str, reverse: bool) -> DataFrame:
    return sq.next_token_chunks(_encoded(spark, sf, reverse), list(KEYS), CHUNK_ROWS, CHUNK_STEPS)


@query("next_token_chunks")
def q_next_token_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf, False)
    return c.select(F.col("row").cast("bigint").alias("row"), "chunk", joined("inputs").alias("inputs"),
                    joined("targets").alias("targets"))


@query("bidirectional_pairs")
def q_bidirectional_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = sq.bidirectional_pairs(_chunks(spark, sf, False), _chunks(spark, sf, True))
    return p.select(F.col("row").cast("bigint").alias("row"), "chunk", joined("inputs").alias("inputs"),
                    joined("targets").alias("targets"), joined("inputs_rev").alias("inputs_rev"),
                    joined("targets_rev").alias("targets_rev"))


# ---------------------------------------------------------------------- F11
def _bilm(spark: SparkSession, sf: str) -> tuple:
    """Both directions' models of the training lines, and the lines of the test corpus."""
    models = bi.fit(tables.lines_of(tables.training_docs(spark, sf)), KEYS)
    return models, tables.posexploded(tables.labelled_docs(spark, sf), ("doc_id", "label"))


@query("bidirectional_perplexity")
def q_bidirectional_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    models, lines = _bilm(spark, sf)
    return bi.text_perplexity(lines, models, KEYS, carry=("label",)).select(
        "doc_id", "label", "n_steps", r("bidirectional", PPL_DIGITS, "perplexity"))


@query("unidirectional_perplexity")
def q_unidirectional_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    models, lines = _bilm(spark, sf)
    return bi.forward_perplexity(lines, models[0], KEYS, carry=("label",)).select(
        "doc_id", "label", "n_steps", r("unidirectional", PPL_DIGITS, "perplexity"))
