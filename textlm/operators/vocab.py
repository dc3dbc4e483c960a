"""Vocabulary tables: pruning, dense ids, membership.

Ids are dense and deterministic: frequency descending, then word ascending,
numbered by range-partitioned global row numbers (never one partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.operators.rownum import global_row_number


def min_count(vocab: DataFrame, m: int) -> DataFrame:
    """Keep words seen at least ``m`` times (C4)."""
    return vocab.where(F.col("n") >= m)


def word_index(vocab: DataFrame) -> DataFrame:
    """``(word, n, id)`` with 0-based ids by frequency desc, word asc."""
    return global_row_number(vocab.select("word", "n"), [F.col("n").desc(), F.col("word").asc()], "id")


def index_order(windex: DataFrame) -> DataFrame:
    """Words back in id order."""
    return windex.orderBy("id")


def vocab_size(vocab: DataFrame) -> DataFrame:
    """One row ``vocab_size`` (C14)."""
    return vocab.agg(F.count("*").alias("vocab_size"))


def in_vocab(words: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """``words`` plus a boolean ``in_vocab`` (C14): a left join on the distinct vocabulary."""
    v = vocab.select(F.col("word").alias(word_col)).distinct().withColumn("_hit", F.lit(True))
    return words.join(v, word_col, "left").withColumn("in_vocab", F.coalesce("_hit", F.lit(False))).drop("_hit")
