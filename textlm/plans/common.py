"""Shared building blocks of the registered queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators import ngram
from textlm.sources import tables


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round float columns so results hash the same in Spark and DuckDB."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def r(c: str | Column, d: int, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, d).alias(name or (c if isinstance(c, str) else None))


@dataclass
class TrigramRun:
    docs: DataFrame  # (doc_id, label) of the test corpus
    train: DataFrame  # training sentences (doc_id, line, tokens)
    test: DataFrame  # test sentences (doc_id, label, line, tokens)
    model: ngram.TrigramModel
    scored: DataFrame  # (doc_id, label, line, pos, w1, w2, w3, p, oov, in_vocab)


def trigram_run(spark: SparkSession, sf_dir: str) -> TrigramRun:
    """Fit on the unlabelled documents, score the labelled ones (the §3.1 flow)."""
    train = tables.training_sentences(spark, sf_dir)
    test = tables.test_sentences(spark, sf_dir)
    model = ngram.fit_trigram(train)
    scored = ngram.score_tokens(test, model, keep=("doc_id", "label", "line"))
    docs = tables.labelled_docs(spark, sf_dir).select(
        "doc_id", "label", F.coalesce(F.size(tables.split_lines(F.col("text"))), F.lit(0)).alias("n_sentences"))
    return TrigramRun(docs=docs, train=train, test=test, model=model, scored=scored)
