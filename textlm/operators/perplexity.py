"""Perplexity folds: token -> sentence -> text -> class.

Per sentence (S9, S10):
  ppl0 = mean(2 ** -log2 p)    ppl1 = 2 ** mean(-log2 p)    ppl2 = 2 ** mean(-p log2 p)

A line with fewer than three tokens scores nothing and its values are NaN.
Two policies fold sentences into a text (F5):

* ``propagate`` (S11): one NaN sentence makes the whole text NaN.
* ``skip`` (S12): non-finite sentence values are dropped.

NaN is emitted as a null value plus an ``is_nan`` flag, so results hash the
same in every engine.

Plan shape: scored tokens are shuffled once by their text and aggregated per
(doc_id, line) there, and the sentence rows are unioned with one row per short
sentence and one row per document before a single ``groupBy(doc_id)`` -- no
join back to the sentence table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.functions.maths import finite, nan_to_null, weighted_entropy, word_entropy, word_perplexity
from textlm.operators.ngram import K

PROPAGATE, SKIP = "propagate", "skip"
MEASURES = ("ppl0", "ppl1", "ppl2")


def sentence_perplexity(scored: DataFrame, keys: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """``(*keys, n_scored, ppl0, ppl1, ppl2, oov, in_vocab)`` per sentence.

    The tokens come from joins on their words, so a task rarely holds two of a sentence
    and sums before the exchange would only be wider rows: the bare tokens go to their
    text's task (a text is one row of the corpus), which holds its sentences whole.
    """
    p = F.col("p")
    of_text = [k for k in keys if k != "line"] or list(keys)
    tokens = scored.select(*keys, "p", "oov", "in_vocab").repartition(*of_text)
    sums = tokens.groupBy(*keys).agg(  # one count for all means
        F.count("*").alias("n_scored"),
        F.sum(word_perplexity(p)).alias("s0"),
        F.sum(word_entropy(p)).alias("s1"),
        F.sum(weighted_entropy(p)).alias("s2"),
        F.sum("oov").cast("bigint").alias("oov"),
        F.sum("in_vocab").cast("bigint").alias("in_vocab"),
    )
    mean = [F.col(f"s{i}") / F.col("n_scored") for i in range(3)]
    return sums.select(*keys, "n_scored", mean[0].alias("ppl0"), F.pow(F.lit(2.0), mean[1]).alias("ppl1"),
                       F.pow(F.lit(2.0), mean[2]).alias("ppl2"), "oov", "in_vocab")


def _rows(doc: DataFrame | None, short: DataFrame | None, sent: DataFrame | None) -> DataFrame:
    """Union of document, short-sentence and scored-sentence rows in one schema."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    none_d = F.lit(None).cast("double")
    none_l = F.lit(None).cast("bigint")
    parts = []
    if doc is not None:
        parts.append(doc.select("doc_id", "label", zero.alias("n_sentences"), zero.alias("n_short"),
                                none_l.alias("n_tokens"), none_l.alias("oov"), none_l.alias("in_vocab"),
                                *[none_d.alias(m) for m in MEASURES]))
    if short is not None:
        parts.append(short.select("doc_id", F.lit(None).cast("string").alias("label"), one.alias("n_sentences"),
                                  one.alias("n_short"), none_l.alias("n_tokens"), none_l.alias("oov"),
                                  none_l.alias("in_vocab"), *[none_d.alias(m) for m in MEASURES]))
    if sent is not None:
        parts.append(sent.select("doc_id", F.lit(None).cast("string").alias("label"), one.alias("n_sentences"),
                                 zero.alias("n_short"), F.col("n_scored").alias("n_tokens"), "oov", "in_vocab",
                                 *MEASURES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def text_perplexity(docs: DataFrame, sents: DataFrame, scored: DataFrame, policy: str = PROPAGATE) -> DataFrame:
    """Text-level perplexities.

    ``docs(doc_id, label)``, ``sents(doc_id, line, tokens)`` and the scored
    tokens of those sentences.  Output: ``doc_id, label, n_sentences,
    n_scored_sentences, n_tokens, oov, in_vocab, ppl0, ppl1, ppl2, is_nan``.
    """
    if policy not in (PROPAGATE, SKIP):
        raise ValueError(f"policy must be {PROPAGATE!r} or {SKIP!r}")
    sent = sentence_perplexity(scored)
    if "n_sentences" in docs.columns:
        # the documents know their line count, and a short line is one that
        # scored nothing: no second tokenisation of the sentence table
        none_l, none_d = F.lit(None).cast("bigint"), F.lit(None).cast("double")
        lines = F.col("n_sentences").cast("bigint")
        doc_rows = docs.select("doc_id", "label", lines.alias("n_sentences"), lines.alias("n_short"),
                               none_l.alias("n_tokens"), none_l.alias("oov"), none_l.alias("in_vocab"),
                               *[none_d.alias(m) for m in MEASURES])
        sent_rows = sent.select("doc_id", F.lit(None).cast("string").alias("label"),
                                F.lit(0).cast("bigint").alias("n_sentences"), F.lit(-1).cast("bigint").alias("n_short"),
                                F.col("n_scored").alias("n_tokens"), "oov", "in_vocab", *MEASURES)
        base = doc_rows.unionByName(sent_rows)
    else:
        short = sents.where(F.size("tokens") <= K).select("doc_id")
        base = _rows(docs.select("doc_id", "label"), short, sent)
    agg = base.groupBy("doc_id").agg(
        F.max("label").alias("label"),
        F.sum("n_sentences").alias("n_sentences"),
        F.sum("n_short").alias("n_short"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.sum("oov"), F.lit(0)).cast("bigint").alias("oov"),
        F.coalesce(F.sum("in_vocab"), F.lit(0)).cast("bigint").alias("in_vocab"),
        *[F.avg(m).alias(m) for m in MEASURES],
    )
    if policy == PROPAGATE:
        ok = (F.col("n_short") == 0) & (F.col("n_sentences") > 0)
    else:
        ok = F.col("ppl0").isNotNull()
    return agg.select(
        "doc_id",
        "label",
        "n_sentences",
        (F.col("n_sentences") - F.col("n_short")).alias("n_scored_sentences"),
        "n_tokens",
        "oov",
        "in_vocab",
        *[F.when(ok, nan_to_null(F.col(m))).alias(m) for m in MEASURES],
        (~ok).alias("is_nan"),
    )


def corpus_perplexity(sents: DataFrame, scored: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """Corpus means over sentences with non-finite values dropped.

    ``sents`` and ``scored`` both carry the ``group`` columns (scored via the
    ``keep`` columns of the scorer), so no sentence-level join is needed.
    Output per group: ``n_sentences, n_scored_sentences, n_tokens, oov,
    in_vocab, ppl0, ppl1, ppl2``.
    """
    sent = sentence_perplexity(scored, (*group, "doc_id", "line"))
    counts = sents.groupBy(*group).agg(F.count("*").alias("n_sentences"))
    means = sent.groupBy(*group).agg(
        F.count("*").alias("n_scored_sentences"),
        F.sum("n_scored").alias("n_tokens"),
        F.sum("oov").alias("oov"),
        F.sum("in_vocab").alias("in_vocab"),
        *[F.avg(nan_to_null(F.col(m))).alias(m) for m in MEASURES],
    )
    # both sides hold one row per group
    if group:
        return counts.join(means, list(group), "left")
    return counts.crossJoin(means)


def class_perplexity(texts: DataFrame) -> DataFrame:
    """Mean text-level perplexity per label over finite texts (F8)."""
    return texts.where(~F.col("is_nan")).groupBy("label").agg(
        F.count("*").alias("n_texts"),
        *[F.avg(m).alias(m) for m in MEASURES],
    )


def corpus_stats(sents: DataFrame) -> DataFrame:
    """Words (tokens without the end-of-line word) and texts per label."""
    per_doc = sents.groupBy("label", "doc_id").agg(F.sum(F.size("tokens") - 1).alias("w"))
    return per_doc.groupBy("label").agg(
        F.sum("w").cast("bigint").alias("n_words"), F.count("*").alias("n_texts")
    )


def extremes(scores: DataFrame, value: str = "perpl", key: str = "files", n: int = 5) -> DataFrame:
    """Top ``n`` and bottom ``n`` rows by ``value`` (F10); NaN rows are left out.

    Each side is a TakeOrderedAndProject: a per-partition top-n, then n rows
    merged on the driver.
    """
    finite_rows = scores.where(finite(F.col(value)))
    top = finite_rows.orderBy(F.col(value).desc(), F.col(key).asc()).limit(n)
    bottom = finite_rows.orderBy(F.col(value).asc(), F.col(key).desc()).limit(n)
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))


def score_table(texts: DataFrame, measure: str = "ppl2") -> DataFrame:
    """``files, label, perpl`` rows as written by the classification run."""
    return texts.select(
        F.col("doc_id").cast("string").alias("files"), "label", F.col(measure).alias("perpl"), "is_nan"
    )
