"""Exact token counts from a histogram of encoded lengths.

Documents are encoded where they lie and aggregated by encoded length at once,
so what is shuffled is one row per length and task.  Prefix and suffix sums
over the histogram then answer totals, quantiles and truncated totals for
every context limit: with a limit L, ``sum(min(length, L))`` is the tokens of
the documents up to L plus L for each longer one.  The sums are taken in two
levels (ranges of ``RANGE`` lengths, then within each), so that no task holds
the whole histogram.

The vocabulary file is a parameter; it is read where the query is built and
shipped to the tasks (a vocabulary's size is fixed and does not grow with the
data).  Null and empty texts have length 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlm.llm.common import each, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary (its own rule for words, numbers, signs, blanks).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANGE = 4096


def _vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in f if line.strip())}


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY,
                    pattern: str = PATTERN) -> DataFrame:
    """``docs``' other named columns are dropped: ``(n_tokens)`` of each text, special strings read as text."""
    ranks = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        code = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            sizes = [len(code.encode_ordinary(t)) if t else 0 for t in each(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``(n_tokens, n_docs)``: documents by encoded length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def length_answers(histogram: DataFrame) -> DataFrame:
    """One row per length L: what every limit up to the next length needs.

    ``docs_up_to`` / ``tokens_up_to`` (lengths <= L), ``docs_over`` /
    ``tokens_over`` (longer ones), ``total_docs`` / ``total_tokens``,
    ``truncated_tokens`` (``sum(min(length, L))``) and ``quantile``, the share
    of documents no longer than L.  A limit between two lengths L < M < next
    has ``tokens_up_to + M * docs_over``.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                         F.floor(F.col("n_tokens") / RANGE).alias("part"))
    whole = h.groupBy("part").agg(F.sum("n_docs").alias("pd"), F.sum("tokens").alias("pt"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = whole.select("part", (F.sum("pd").over(later) - F.col("pd")).alias("docs_later"),
                        (F.sum("pt").over(later) - F.col("pt")).alias("tokens_later"))
    total = whole.agg(F.sum("pd").alias("total_docs"), F.sum("pt").alias("total_tokens"))
    here = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(ends, "part").crossJoin(F.broadcast(total))
    docs_from = F.sum("n_docs").over(here) + F.col("docs_later")
    tokens_from = F.sum("tokens").over(here) + F.col("tokens_later")
    s = s.select("n_tokens", "n_docs", (docs_from - F.col("n_docs")).alias("docs_over"),
                 (tokens_from - F.col("tokens")).alias("tokens_over"), "total_docs", "total_tokens")
    up, tokens_up = F.col("total_docs") - F.col("docs_over"), F.col("total_tokens") - F.col("tokens_over")
    return s.select("n_tokens", "n_docs", up.alias("docs_up_to"), tokens_up.alias("tokens_up_to"), "docs_over",
                    "tokens_over", (tokens_up + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"),
                    (up / F.col("total_docs")).alias("quantile"), "total_docs", "total_tokens")


def token_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    # written once: several sums read it, and encoding is the costly part
    return length_answers(stored(length_histogram(encoded_lengths(docs, vocabulary=vocabulary))))
