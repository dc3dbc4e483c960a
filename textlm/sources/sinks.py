"""Sinks (A6-A11): vectors, model tables, score and pair TSVs, one folder per document.

Writers emit one part file per partition (no single-task funnel); formats
whose readers need a header get one per part file.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators.ngram import TrigramModel
from textlm.session import ensure_checkpoint_dir

# Plain tab-joined fields: a quote is an ordinary character of a token.
PLAIN_TSV = {"sep": "\t", "quote": "", "escape": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}


def write_vectors(df: DataFrame, path: str) -> None:
    """word2vec text (A6): each part file starts with one ``rows dim`` header of its own.

    The partitions are fixed by a checkpoint and counted first, since a header
    precedes its rows and a partition is never held whole.
    """
    ensure_checkpoint_dir(df.sparkSession)
    tagged = df.select("word", "vec").checkpoint(eager=True).withColumn("_pid", F.spark_partition_id())
    sizes = df.sparkSession.createDataFrame(
        [tuple(r) for r in tagged.groupBy("_pid").count().collect()], "_pid int, _n bigint")

    def fmt(batches):
        first = True
        for pdf in batches:
            if pdf.empty:
                continue
            lines = [f"{pdf['_n'].iloc[0]} {len(pdf['vec'].iloc[0])}"] if first else []
            first = False
            lines += [w + " " + " ".join(repr(float(x)) for x in v) for w, v in zip(pdf["word"], pdf["vec"])]
            yield pd.DataFrame({"value": lines})

    tagged.join(F.broadcast(sizes), "_pid").select("word", "vec", "_n").mapInPandas(fmt, "value string") \
        .write.mode("overwrite").text(path)


def write_vectors_parquet(df: DataFrame, path: str) -> None:
    """Native vector format: parquet ``(word, vec)``."""
    df.select("word", "vec").write.mode("overwrite").parquet(path)


def save_trigram(model: TrigramModel, path: str, buckets: int | None = None) -> None:
    """Three parquet tables (A7); ``tri`` is clustered by context so a reader
    joining on (w1, w2, w3) finds each context in one file group."""
    model.uni.write.mode("overwrite").parquet(f"{path}/uni")
    tri = model.tri
    if buckets:
        tri = tri.repartition(buckets, "w1", "w2")
    tri.sortWithinPartitions("w1", "w2", "w3").write.mode("overwrite").parquet(f"{path}/tri")
    model.meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_trigram(spark: SparkSession, path: str) -> TrigramModel:
    return TrigramModel(uni=spark.read.parquet(f"{path}/uni"), tri=spark.read.parquet(f"{path}/tri"),
                        meta=spark.read.parquet(f"{path}/meta"))


def save_neural(model, windex: DataFrame, corpus_size: DataFrame, path: str, options: dict | None = None) -> None:
    """Network + word index + corpus size + options."""
    model.write().overwrite().save(f"{path}/network")
    windex.select("word", "id").write.mode("overwrite").parquet(f"{path}/windex")
    corpus_size.write.mode("overwrite").parquet(f"{path}/meta")
    spark = windex.sparkSession
    spark.createDataFrame([(json.dumps(options or {}),)], "options string").write.mode("overwrite").json(
        f"{path}/options")


def load_neural(spark: SparkSession, path: str):
    """``(model, windex ordered by id, meta)``; the index is rebuilt in id order."""
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    model = MultilayerPerceptronClassificationModel.load(f"{path}/network")
    windex = spark.read.parquet(f"{path}/windex").orderBy("id")
    return model, windex, spark.read.parquet(f"{path}/meta")


def write_scores(df: DataFrame, path: str, header: bool = True) -> None:
    """``files label perpl`` TSV (A9), with or without a header line."""
    (df.select("files", "label", "perpl").write.mode("overwrite").options(**PLAIN_TSV)
     .option("header", str(header).lower()).csv(path))


def append_scores(df: DataFrame, path: str) -> None:
    """Append rows as documents finish (A9, streaming use)."""
    df.select("files", "label", "perpl").write.mode("append").options(**PLAIN_TSV).csv(path)


def write_pairs(df: DataFrame, path: str, a: str = "src_lempos", b: str = "tgt_lempos") -> None:
    """Two-column TSV of pairs (A10)."""
    df.select(a, b).write.mode("overwrite").options(**PLAIN_TSV).csv(path)


def write_per_document(df: DataFrame, path: str) -> None:
    """One folder per document under its label (A11): ``label=../doc_id=../part-*.txt``.

    The file count equals the document count, so this is for small sets.
    """
    (df.select("label", F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("value"))
     .repartition("label", "doc_id").write.mode("overwrite").partitionBy("label", "doc_id").text(path))
