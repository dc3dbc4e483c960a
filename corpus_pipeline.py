"""A training-data pipeline over ``documents``: five stages of the operators in ``textlm.llm``.

Each stage works on what the one before kept and, but for the last, returns the
columns of its documents.  The last writes the mixed corpus as a table (see
``mixing.write_mix``) and returns what it holds of each kept document.  Trained and seeded steps cannot be expressed in SQL; tests/llm holds
the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.llm import chunks, decontaminate, mixing, ngramjoin, toxicity
from textlm.llm.common import fresh, stored
from textlm.llm.queries import read


def _with_length(docs: DataFrame) -> DataFrame:
    """Texts were cut: their length is taken anew."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    (score,) = fresh(docs, "score")
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return model.score(docs, out=score).where(f"`{score}` < 0.5").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 stays: that of the smallest doc_id."""
    return ngramjoin.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut; documents without anything else go."""
    return _with_length(chunks.remove_passages(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut; documents without anything else go."""
    return _with_length(decontaminate.remove_benchmark(docs, read(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is written; what it holds of each document."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, what each returns written once before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
