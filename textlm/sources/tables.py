"""Corpora as DataFrames over the parquet tables (table forms of A1 / A2).

*sentences* = one row per line of ``documents.text``; the *training corpus*
is every document without a ``labels`` row, the *test corpus* every labelled
document (``quality = 1`` -> ``good``, ``0`` -> ``bad``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.functions.text import line_pieces, line_tokens, split_lines, whole_lines

GOOD, BAD, TRAIN = "good", "bad", "train"


TEXT_TABLES = ("documents", "benchmark", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Give a text scan at least one partition per core.

    Tokenising is CPU-bound per row, and a table stored in a few large row
    groups scans into fewer tasks than cores.  Only then the raw rows (their
    most compact form) are spread once by a round-robin exchange; on a
    cluster the file splits already outnumber the cores and nothing changes.
    Call it on plain scans only: counting the partitions of a plan that holds
    an exchange would make adaptive execution run that exchange.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without the RDD API keep the scan as is
        return df
    return df.repartition(cores) if n < cores else df


BROADCAST_MAX_ROWS = 2_000_000  # (doc_id, label) rows: well under 100 MB


def sized_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast a scanned side only behind a check of its size.

    The count of a parquet scan reads footers only; beyond ``max_rows`` the
    side stays a plain frame and the join shuffles both sides.
    """
    return F.broadcast(small) if small.count() <= max_rows else small


def lines_of(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, line, value)``: posexplode of the text's lines (A1, table form).

    Narrow: no shuffle, a document's lines stay in its scan partition.
    """
    return posexploded(df, (key,), text_col)


def posexploded(df: DataFrame, keys: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``(*keys, line, value)``: a row a line; each text is split once."""
    pieces = df.select(*keys, line_pieces(F.col(text_col)).alias("_pieces"))
    return pieces.select(*keys, F.posexplode(whole_lines(F.col("_pieces"))).alias("line", "value"))


def sentences(lines: DataFrame) -> DataFrame:
    """``(..., line, tokens)``: tokenised lines with the end-of-line word."""
    cols = [c for c in lines.columns if c != "value"]
    return lines.select(*cols, line_tokens(F.col("value")).alias("tokens"))


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, text)`` of the test corpus (A2, table form)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.lit(GOOD)).otherwise(F.lit(BAD)).alias("label")
    )
    return docs.join(sized_broadcast(labels), "doc_id", "inner")


def training_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` of documents without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(sized_broadcast(labels), "doc_id", "left_anti")


def classed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, text)`` of both corpora in one scan, ``train`` as label of the documents without one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, F.lit(GOOD)).otherwise(F.lit(BAD)).alias("label"))
    return docs.join(sized_broadcast(labels), "doc_id", "left").select(
        "doc_id", F.coalesce("label", F.lit(TRAIN)).alias("label"), "text")


def training_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(lines_of(training_docs(spark, sf_dir)))


def test_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, line, tokens)``."""
    return sentences(posexploded(labelled_docs(spark, sf_dir), ("doc_id", "label")))
