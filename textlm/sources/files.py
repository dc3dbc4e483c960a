"""File sources (A1-A6, A12): sentence files, labelled folder trees, TSV lists,
vocabulary files, word2vec text vectors, shuffled shard passes.

All readers declare their schema; nothing is inferred.  Where line order is part
of the semantics, lines are ordered by (file path, start of the split, place in
it), since Spark packs splits of several files by size, and numbered densely
with range-partitioned row numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.functions.text import line_tokens
from textlm.operators.encoding import vocab_from_lines
from textlm.operators.rownum import global_row_number
from textlm.sources.tables import spread


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, at)``: lines of the file or files under ``path``; ``at`` orders them by file and place."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("at"))


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line, plain or ``.gz`` (A1): ``(file, line, value, tokens)``.

    ``.gz`` files are not splittable, so an under-partitioned read is spread
    once right after the scan.  ``line`` is unique and ordered within a file.
    """
    df = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")
    df = spread(df)
    return df.select("file", "line", "value", line_tokens(F.col("value")).alias("tokens"))


def read_labelled_tree(spark: SparkSession, path: str, layout: str = "flat") -> DataFrame:
    """Walk a folder tree, one document per file (A2): ``(doc_id, label, text)``.

    ``flat``: the label is the file's folder (``good/x.txt``); ``wrapped``:
    one folder per document, the label is one level higher (``good/x/x.txt``).
    """
    if layout not in ("flat", "wrapped"):
        raise ValueError("layout must be 'flat' or 'wrapped'")
    df = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    up = 2 if layout == "flat" else 3
    # folders written by ``sinks.write_per_document`` are named ``label=..`` and ``doc_id=..``
    folder = F.element_at(parts, -2)
    df = df.select(F.when(folder.startswith("doc_id="), F.substr(folder, F.lit(len("doc_id=") + 1)))
                   .otherwise(F.element_at(parts, -1)).alias("doc_id"),
                   F.regexp_replace(F.element_at(parts, -up), "^label=", "").alias("label"), F.col("value").alias("text"))
    return spread(df)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Three-column TSV word-pair list, ``#`` lines skipped (A3): ``(w1, w2, score)``."""
    f = F.split(F.col("value"), "\t")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 3)).select(
        f[0].alias("w1"), f[1].alias("w2"), F.trim(f[2]).cast("double").alias("score"))


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace file of source/target words (A4): ``(idx, src, tgt)`` in file order; lines of fewer than two words are skipped."""
    f = F.split(F.trim(F.col("value")), r"\s+")
    rows = ordered_lines(spark, path).where(F.size(f) >= 2).select("at", F.get(f, F.lit(0)).alias("src"), F.get(f, F.lit(1)).alias("tgt"))
    return global_row_number(rows, ["at"], "idx").select("idx", "src", "tgt")


def read_vocab(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vocabulary file, id = line order (A5): ``(svocab(word, id), specials(bos, eos, unk))``."""
    lines = ordered_lines(spark, path).select(F.col("at").alias("ln"), "value")
    return vocab_from_lines(lines, validate)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word2vec text vectors (A6): ``(word, vec array<float>, ln)``; a header ``V D`` that begins a file is dropped.

    ``ln`` grows in file order, so the word index and ``restrict_vocab`` can be built from it.

    A directory of part files each with its own header (as written by
    ``sinks.write_vectors``) reads the same way.  Undecodable bytes are
    replaced by the text reader.
    """
    raw = ordered_lines(spark, path)
    firsts = raw.groupBy("file").agg(F.min("at").alias("first"))  # one row per file
    p = F.split(F.trim(F.col("value")), r"\s+")
    header = (F.col("at") == F.col("first")) & (F.size(p) == 2) & p[0].rlike(r"^\d+$") & F.get(p, F.lit(1)).rlike(r"^\d+$")
    body = raw.join(firsts, "file").where(~header & (F.trim("value") != ""))
    vectors = body.select(p[0].alias("word"), F.slice(p, 2, F.size(p) - 1).cast("array<float>").alias("vec"), "at")
    return global_row_number(vectors, ["at"], "ln").select("word", "vec", "ln")


def read_shards(spark: SparkSession, path: str, seed: int, passes: int, shuffle_lines: bool = False) -> DataFrame:
    """Sentences of the shard files that ``path`` (a folder or a pattern) names, in seeded passes.

    ``(file, line, value, tokens, pass, order_key)``: each pass permutes the files; sorted by ``(pass, order_key,
    line)`` it is the order of training.  With ``shuffle_lines`` there is a ``line_key`` for the lines of a file.
    """
    return shuffled_passes(read_sentences(spark, path), seed, passes, key="file", shuffle_lines=shuffle_lines)


def shuffled_passes(sents: DataFrame, seed: int, passes: int, key: str = "doc_id",
                    shuffle_lines: bool = False) -> DataFrame:
    """Training passes over shards (A12): every pass re-orders the files by a
    seeded md5 key; lines keep their order unless ``shuffle_lines``.

    Passes are an ``explode`` of the pass numbers (no join); the order key is
    a column, so a consumer sorts by ``(pass, order_key, line)`` with a range
    partitioned sort.
    """
    p = sents.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    doc_key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.col(key).cast("string")))
    p = p.withColumn("order_key", doc_key)
    if shuffle_lines:
        p = p.withColumn("line_key", F.md5(F.concat_ws(":", F.col("order_key"), F.col("line").cast("string"))))
    return p
