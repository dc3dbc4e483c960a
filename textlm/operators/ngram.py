"""Trigram language model as tables.

A model is three DataFrames, never a driver-side dict:

* ``uni(word, n, p)``           -- vocabulary with ``p = n / corpus_size``
* ``tri(w1, w2, w3, c, p)``     -- trigram counts with ``p = c / sum(c) per (w1, w2)``
* ``meta(corpus_size, vocab_size, n_contexts, n_trigrams)`` -- one row

Everything stays lazy so Catalyst plans fit and scoring as one job; the
one-row ``meta`` is joined with a broadcast nested-loop join of proven size 1.

A model fitted here also has ``keyed(ctx, word, c)``: one row for each distinct
context and word, the context as its 64-bit hash (``context_key``), the words as
they are.  Scoring reads ``places``, a row an occurrence with the word as a 64-bit hash
too, and their counts ``hashed``: rows of numbers are sorted, joined and shuffled without a string in them.
Two contexts, or two words, of the corpus would have to share 64 bits to be mixed up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlm.functions.maths import OOV_MASS
from textlm.session import ensure_partial_keys

K = 2  # context length of the trigram model


@dataclass
class TrigramModel:
    uni: DataFrame
    tri: DataFrame
    meta: DataFrame
    size: DataFrame | None = None  # one row ``corpus_size`` (what scoring needs)
    keyed: DataFrame | None = None  # (ctx, word, c), if fitted here
    places: DataFrame | None = None  # (ctx, word) of ``hashed_places``, if fitted here: what scoring reads

    @property
    def hashed(self) -> DataFrame:
        """``(ctx, word, c)`` of ``places``, the rows of a context in one task."""
        return self.places.groupBy("ctx", "word").agg(F.count("*").alias("c"))

    def corpus_size(self) -> DataFrame:
        return self.size if self.size is not None else self.meta.select("corpus_size")


def kgrams(sents: DataFrame, k: int = K, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, pos, w1, w2, w3)`` for every position ``pos >= k``.

    The context is always the two previous tokens whatever ``k`` is (S4).
    Narrow: the places are exploded beside the tokens inside the scan stage, no window.
    """
    if k < 2:
        raise ValueError("k must be >= 2: the context is the two previous tokens")
    t, pos = F.col("_tokens"), F.col("pos")
    size = F.size(t)
    places = sents.select(*keep, F.col("tokens").alias("_tokens")).select(
        *keep, "_tokens", F.explode(F.when(size > k, F.sequence(F.lit(k), size - 1))).alias("pos"))
    return places.select(*keep, "pos", F.get(t, pos - 2).alias("w1"), F.get(t, pos - 1).alias("w2"), F.get(t, pos).alias("w3"))


def vocab_counts(sents: DataFrame) -> DataFrame:
    """``(word, n)`` (C1): partial + final hash aggregation."""
    return sents.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def corpus_size(sents: DataFrame) -> DataFrame:
    """One row ``corpus_size``: every token counted, EOLs included."""
    return sents.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("bigint").alias("corpus_size"))


def unigram_probs(vocab: DataFrame, size: DataFrame) -> DataFrame:
    """``(word, n, p)`` with ``p = n / corpus_size``."""
    return vocab.crossJoin(F.broadcast(size)).select(
        "word", "n", (F.col("n") / F.col("corpus_size")).alias("p")
    )


def trigram_counts(sents: DataFrame, k: int = K) -> DataFrame:
    """``(w1, w2, w3, c)``."""
    return kgrams(sents, k).groupBy("w1", "w2", "w3").agg(F.count("*").alias("c"))


def context_totals(counts: DataFrame) -> DataFrame:
    """``(w1, w2, total, n_cont)``: count and number of distinct continuations of every context."""
    return counts.groupBy("w1", "w2").agg(F.sum("c").alias("total"), F.count("*").alias("n_cont"))


def trigram_probs(counts: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``(w1, w2, w3, c, p)`` with ``p = c / sum(c)`` over the context (D3).

    Totals are aggregated partially and joined back, so a hot context is never
    one group: the join's skewed partitions can be split, a window's cannot.
    """
    totals = (context_totals(counts) if totals is None else totals).select("w1", "w2", "total")
    return counts.join(totals, ["w1", "w2"]).select("w1", "w2", "w3", "c", (F.col("c") / F.col("total")).alias("p"))


def gram_counts(sents: DataFrame, k: int = K) -> DataFrame:
    """``(w1, w2, w3, c)``: unigram rows ``(null, null, w)`` and trigram rows in one aggregation.

    One scan and one tokenisation feed every model table; the partial
    aggregation runs before the single exchange on (w1, w2, w3), and the
    consumers below share that exchange.
    """
    t = F.col("tokens")
    uni = F.transform(t, lambda w: F.struct(F.lit(None).cast("string").alias("w1"),
                                            F.lit(None).cast("string").alias("w2"), w.alias("w3")))
    idx = F.when(F.size(t) > k, F.sequence(F.lit(k), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    tri = F.transform(idx, lambda i: F.struct(F.element_at(t, i - 1).alias("w1"), F.element_at(t, i).alias("w2"),
                                              F.element_at(t, i + 1).alias("w3")))
    grams = sents.select(F.inline(F.concat(uni, tri)))
    return grams.groupBy("w1", "w2", "w3").agg(F.count("*").alias("c"))


def context_key(w1: Column, w2: Column) -> Column:
    """The 64-bit hash of a context, never 0: that stands for the places without a context."""
    h = F.xxhash64(w1, w2)
    return F.when(h == 0, F.lit(1).cast("bigint")).otherwise(h)


def word_key(w: Column) -> Column:
    """The 64-bit hash of a word."""
    return F.xxhash64(w)


def keyed_counts(sents: DataFrame, k: int = K) -> DataFrame:
    """``(ctx, word, c)``: how often each word follows each context; ``ctx`` is 0 at the first ``k`` positions.

    Every token is in one row, so that words, contexts and corpus size all come from
    this table.  No column that is grouped or joined can be null: its users then
    hold the same plan down to the scan, and Spark shuffles the grams once for all.
    """
    return _counts(sents, k, lambda w: w)


def hashed_places(sents: DataFrame, k: int = K) -> DataFrame:
    """``(ctx, word)`` of every token, shuffled by context: both as 64-bit hashes; at the first ``k`` positions the word stands for its context.

    The occurrences are not summed up before: most trigrams of a scan task are its only ones, and
    a context's rows are to meet in one task whatever their words.  All that scoring counts comes from this
    exchange, so its users must not filter it (Spark would filter below it and shuffle once for each of them).
    """
    own = _contexts(sents, k, word_key)
    return own.select(F.when(F.col("ctx") == 0, F.col("word")).otherwise(F.col("ctx")).alias("ctx"), "word").repartition("ctx")


def _counts(sents: DataFrame, k: int, word: Callable[[Column], Column]) -> DataFrame:
    return _contexts(sents, k, word).groupBy("ctx", "word").agg(F.count("*").alias("c"))


def _contexts(sents: DataFrame, k: int, word: Callable[[Column], Column]) -> DataFrame:
    t, pos = F.col("tokens"), F.col("_pos")
    # no filter on the tokens: Spark would find them anew for it
    places = sents.select("tokens", F.explode(F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1))).alias("_pos"))
    # a missing word counts as no context, as the first places do
    ctx = F.when((pos < k) | F.get(t, pos - 1).isNull(), F.lit(0).cast("bigint")).otherwise(
        context_key(F.get(t, pos - 2), F.get(t, pos - 1)))
    return places.where(F.get(t, pos).isNotNull()).select(ctx.alias("ctx"), word(F.get(t, pos)).alias("word"))


def fit_trigram(sents: DataFrame, k: int = K) -> TrigramModel:
    """C1 + C2 + C3 + D2 + D3."""
    return model_of(gram_counts(sents, k), keyed_counts(sents, k), hashed_places(sents, k))


def model_of(counts: DataFrame, keyed: DataFrame | None = None, places: DataFrame | None = None) -> TrigramModel:
    """The model of ``(w1, w2, w3, c)``: words where ``w1`` is null, trigrams elsewhere.

    ``keyed`` and ``places``: ``keyed_counts`` and ``hashed_places`` of the same sentences, both or neither.
    """
    vocab = counts.where(F.col("w1").isNull()).select(F.col("w3").alias("word"), F.col("c").alias("n"))
    size = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("corpus_size"))
    uni = unigram_probs(vocab, size)
    grams = counts.where(F.col("w1").isNotNull())
    totals = context_totals(grams)
    tri = trigram_probs(grams, totals)
    stats = totals.agg(F.coalesce(F.sum("n_cont"), F.lit(0)).cast("bigint").alias("n_trigrams"),
                       F.count("*").alias("n_contexts"))
    meta = size.crossJoin(vocab.agg(F.count("*").alias("vocab_size"))).crossJoin(stats)
    return TrigramModel(uni=uni, tri=tri, meta=meta, size=size, keyed=keyed, places=places)


def score_tokens(test: DataFrame, model: TrigramModel, keep: tuple[str, ...], k: int = K) -> DataFrame:
    """``(*keep, pos, w1, w2, w3, p, oov, in_vocab)``.

    Back-off: seen trigram -> ``c / sum(c)``; else known word -> unigram;
    else ``0.99 / corpus_size``.  A trigram hit raises neither counter.
    """
    return score_grams(kgrams(test, k, keep), model, keep)


def score_grams(grams: DataFrame, model: TrigramModel, keep: tuple[str, ...]) -> DataFrame:
    """``score_tokens`` of ``(*keep, pos, w1, w2, w3)``."""
    if model.keyed is not None and model.places is not None:
        return _score_hashed(grams, model, keep)
    found = grams.join(model.tri.select("w1", "w2", "w3", F.col("p").alias("p_tri")), ["w1", "w2", "w3"], "left")
    uni = model.uni.select(F.col("word").alias("w3"), F.col("p").alias("p_uni"))
    meta = F.broadcast(model.corpus_size())
    scored = found.join(uni, ["w3"], "left").crossJoin(meta)
    return _scored(scored, keep, F.col("p_tri"), F.col("p_uni"))


def _score_hashed(grams: DataFrame, model: TrigramModel, keep: tuple[str, ...]) -> DataFrame:
    """The same by a model fitted here.

    An occurrence meets its context's rows and their total in the context's task; the window there
    holds a context's different continuations and may spill.  What was not found lacks its
    word's count and goes to the words; what was found takes the same way by the last bits of its
    context, as no word is asked for it.
    """
    ensure_partial_keys(grams.sparkSession)
    words = model.places.groupBy("word").agg(F.count("*").alias("n"))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("corpus_size"))
    whole = Window.partitionBy("ctx").orderBy("word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = F.when(F.col("ctx") != F.col("word"), F.col("c"))  # null at the first places, which are no context's
    counts = model.hashed.select("ctx", "word", (seen / F.sum(seen).over(whole)).alias("_tri"))
    found = grams.where(F.col("w3").isNotNull()).withColumn("ctx", context_key(F.col("w1"), F.col("w2"))).withColumn(
        "word", word_key(F.col("w3"))).repartition("ctx").join(counts, ["ctx", "word"], "left")
    asked = F.when(F.col("_tri").isNull(), F.col("word")).otherwise(F.pmod(F.col("ctx"), F.lit(1 << 16)))
    found = found.withColumn("_key", asked).join(words.withColumnRenamed("word", "_key"), "_key", "left")
    scored = found.crossJoin(F.broadcast(size))
    return _scored(scored, keep, F.col("_tri"), F.col("n") / F.col("corpus_size"))


def _scored(found: DataFrame, keep: tuple[str, ...], p_tri: Column, p_uni: Column) -> DataFrame:
    hit, known = p_tri.isNotNull(), p_uni.isNotNull()
    return found.select(
        *keep,
        "pos",
        "w1",
        "w2",
        "w3",
        F.coalesce(p_tri, p_uni, F.lit(OOV_MASS) / F.col("corpus_size")).alias("p"),
        (~hit & ~known).cast("int").alias("oov"),
        (~hit & known).cast("int").alias("in_vocab"),
    )
