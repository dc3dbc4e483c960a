"""Training word vectors (H1-H4).

* skip-gram with negative sampling: ``operators/skipgram.py``;
* CBOW, re-aimed: context windows -> co-occurrence counts -> PPMI
  (Levy and Goldberg 2014) -> truncated SVD of the word x context matrix;
* subword: the same training, a word being the mean of its own vector and
  those of the hash buckets of its character 3..6-grams; an unseen word is the
  mean of its buckets.

Windows are built with array functions inside each sentence row (no self
join); co-occurrences are aggregated with partial aggregation.  The SVD
(``operators/svd.py``) keeps both sides of the matrix distributed and uses
every context.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.operators.skipgram import train_negative_sampling
from textlm.operators.svd import svd
from textlm.session import ensure_checkpoint_dir
from textlm.sources.tables import BROADCAST_MAX_ROWS

BUCKETS = 2_000_000  # of n-grams; two n-grams of one bucket share its vector


SEPARATOR = "\x1f"  # between the words of a place; both tokenisers split there, so no token holds it
HOT_SHARE = 1000  # a word with more than one token in so many is hot: fewer than 1,000 words


def word_counts(sents: DataFrame) -> DataFrame:
    return sents.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def hot_words(counts: DataFrame) -> list[str]:
    """The words of ``(word, n)`` with more than one token in ``HOT_SHARE``; what a pair is grouped by hangs on them, never its count."""
    total = counts.agg(F.sum("n").alias("total"))
    found = counts.where("word is not null").crossJoin(F.broadcast(total)).where(F.col("n") * HOT_SHARE > F.col("total")).select("word").collect()
    return sorted(r.word for r in found)


def paired_places(sents: DataFrame, window: int, hot: list[str], only: DataFrame | None = None) -> list[DataFrame]:
    """``(word, context)`` of each two places within ``window`` positions once, whichever word comes first; no pair of words is
    in two of the tables.  ``only``: the words (``word``) whose pairs are kept, all if none.

    A place travels as one row with the words it is paired with, not as a row a pair, and is
    grouped by its word.  Of two words the smaller one takes the pair, or the one that is not
    hot: so no hot word's places gather in one task.  Pairs of two hot words are few and are
    summed before they are shuffled.  A token that holds ``SEPARATOR`` is an error.
    """
    t, h = F.col("tokens"), F.col("hot")
    sents = sents.select(F.when(F.instr(F.array_join(t, ""), SEPARATOR) > 0, F.raise_error(F.lit("a token holds the separator U+001F")))
                         .otherwise(t).alias("tokens"))
    marked = sents.where(F.size("tokens") > 1).select("tokens", F.transform("tokens", lambda x: x.isin(hot) if hot else F.lit(False)).alias("hot"))
    n = F.size(t)

    def others(i: Column, first: Column, keep) -> Column:
        near = F.sequence(first, F.least(n - 1, i + window))
        return F.transform(F.filter(near, lambda j: (j != i) & keep(j)), lambda j: F.get(t, j))

    def taken(i: Column) -> Column:
        w = F.get(t, i)
        return others(i, F.greatest(F.lit(0), i - window), lambda j: F.get(h, j) | (F.get(t, j) > w) | ((F.get(t, j) == w) & (j > i)))

    def places(of_hot: bool):
        return F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(h, i) == F.lit(of_hot))

    rare = marked.select(F.inline(F.transform(places(False), lambda i: F.struct(F.get(t, i).alias("word"), taken(i).alias("others"))))) \
        .where(F.size("others") > 0).select("word", F.array_join("others", SEPARATOR).alias("others"))
    if only is not None:
        rare = rare.join(only, "word", "left_semi")
    found = [rare.repartition("word").select("word", F.explode(F.split("others", SEPARATOR)).alias("context"))]
    if hot:
        both = marked.select(F.explode(F.flatten(F.transform(places(True), lambda i: F.transform(
            others(i, F.least(i + 1, n - 1), lambda j: F.get(h, j)),
            lambda c: F.struct(F.least(F.get(t, i), c).alias("word"), F.greatest(F.get(t, i), c).alias("context")))))).alias("p"))
        found.append(both.select("p.word", "p.context"))
    return found


def _summed(places: list[DataFrame]) -> DataFrame:
    """``(word, context, n)``: each pair once; a word beside itself is met from both sides, so its places count twice."""
    sums = [x.groupBy("word", "context").agg(F.count("*").alias("n")) for x in places]
    twice = F.when(F.col("word") == F.col("context"), 2 * F.col("n")).otherwise(F.col("n"))
    return reduce(DataFrame.unionByName, sums).withColumn("n", twice)


def unordered_pairs(sents: DataFrame, window: int = 5) -> DataFrame:
    """``(word, context, n)``: every pair within ``window`` positions in one of its two orders."""
    return _summed(paired_places(sents, window, hot_words(word_counts(sents))))


def both_ways(pairs: DataFrame, value: str = "n") -> DataFrame:
    """``(word, context, value)`` in both orders, from pairs held in one."""
    w, c, v = F.col("word"), F.col("context"), F.col(value)
    one = F.struct(w.alias("word"), c.alias("context"), v.alias(value))
    back = F.struct(c.alias("word"), w.alias("context"), v.alias(value))
    return pairs.select(F.inline(F.when(w == c, F.array(one)).otherwise(F.array(one, back))))


def context_pairs(sents: DataFrame, window: int = 5) -> DataFrame:
    """``(word, context, n)``: every pair within ``window`` positions, both sides (H4)."""
    return both_ways(unordered_pairs(sents, window))


def cbow_examples(sents: DataFrame, keys: tuple[str, ...], window: int = 5) -> DataFrame:
    """``(*keys, pos, target, context array<string>)``: the context bag of every position (H2)."""
    t = F.col("tokens")
    n = F.size(t)
    ex = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            i.alias("pos"), F.element_at(t, i + 1).alias("target"),
            F.transform(F.filter(F.sequence(F.greatest(F.lit(0), i - window), F.least(n - 1, i + window)),
                                 lambda j: j != i), lambda j: F.element_at(t, j + 1)).alias("context")))
    return sents.select(*keys, F.inline(ex))


def ppmi(pairs: DataFrame, min_count: int = 1) -> DataFrame:
    """``(word, context, ppmi)`` with ``max(0, ln(n N / (n_w n_c)))`` over kept pairs (H2)."""
    kept = pairs.where(F.col("n") >= min_count)
    w = kept.groupBy("word").agg(F.sum("n").alias("n_w"))
    c = kept.groupBy("context").agg(F.sum("n").alias("n_c"))
    tot = kept.agg(F.sum("n").alias("n_all"))
    j = kept.join(w, "word").join(c, "context").crossJoin(F.broadcast(tot))
    v = F.log(F.col("n") * F.col("n_all") / (F.col("n_w") * F.col("n_c")))
    return j.select("word", "context", F.greatest(F.lit(0.0), v).alias("ppmi")).where(F.col("ppmi") > 0)


def char_ngrams(words: DataFrame, lo: int = 3, hi: int = 6, word_col: str = "word") -> DataFrame:
    """``(word, ngram)``: character n-grams of ``<word>`` for n in [lo, hi] (H3)."""
    b = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    L = F.length(b)
    grams = F.flatten(F.transform(
        F.sequence(F.lit(lo), F.lit(hi)),
        lambda k: F.transform(
            F.when(L >= k, F.sequence(F.lit(1), L - k + 1)).otherwise(F.array().cast("array<int>")),
            lambda s: F.substring(b, s, k))))
    return words.select(F.col(word_col).alias("word")).withColumn("ngram", F.explode(grams.alias("g")))


# ---------------------------------------------------------------- trained models
def fit_skipgram(sents: DataFrame, dim: int = 100, window: int = 5, min_count: int = 10, iters: int = 5,
                 seed: int = 42, negatives: int = 5) -> DataFrame:
    """``(word, vec array<double>)`` of the words that occur ``min_count`` times or more, by negative sampling (H1)."""
    ensure_checkpoint_dir(sents.sparkSession)
    counts = frequent_counts(sents, min_count).checkpoint()
    pairs = frequent_pairs(sents, window, counts)
    return train_negative_sampling(pairs, counts, dim, iters, negatives, seed=seed, mirrored=True).select("word", "vec")


def frequent_pairs(sents: DataFrame, window: int, counts: DataFrame) -> DataFrame:
    """``(word, context, n)`` as ``unordered_pairs``, of the words of ``counts`` (``word, n``) alone: others are left out before the shuffle."""
    few = counts.count() <= BROADCAST_MAX_ROWS
    sent = F.broadcast if few else (lambda x: x)
    words = counts.where("word is not null").select("word")
    return _summed(paired_places(sents, window, hot_words(counts), sent(words))).join(
        sent(words.withColumnRenamed("word", "context")), "context", "left_semi").select("word", "context", "n")


def frequent_counts(sents: DataFrame, min_count: int) -> DataFrame:
    """``(word, n)`` of the words that occur ``min_count`` times or more."""
    return word_counts(sents).where(F.col("n") >= min_count)


def fit_ppmi_svd(sents: DataFrame, dim: int = 100, window: int = 5, min_count: int = 10) -> DataFrame:
    """CBOW re-aimed: ``(word, vec)`` from the PPMI matrix of frequent words, all contexts of theirs (H2)."""
    ensure_checkpoint_dir(sents.sparkSession)
    counts = frequent_counts(sents, min_count).checkpoint()
    return svd(ppmi_cells(sents, window, min_count, counts), "word", dim, keys=counts).rows


def ppmi_cells(sents: DataFrame, window: int = 5, min_count: int = 10, counts: DataFrame | None = None) -> DataFrame:
    """``(word, context, value)``: PPMI between the words that occur ``min_count`` times or more.

    Pairs are counted in one order, and a word's total is the same as word and as context; it
    is summed from the places before these are paired up.  While the frequent words
    number ``BROADCAST_MAX_ROWS`` at most, they and their totals go to the tasks, so that only places are
    shuffled, and of frequent words alone; beyond, the pairs are joined with them.  ``counts``: ``frequent_counts`` if stored.
    """
    ensure_checkpoint_dir(sents.sparkSession)
    counts = frequent_counts(sents, min_count).checkpoint() if counts is None else counts
    few = counts.count() <= BROADCAST_MAX_ROWS
    sent = F.broadcast if few else (lambda x: x)
    words = counts.select("word")
    places = paired_places(sents, window, hot_words(counts), sent(words))
    other = sent(words.withColumnRenamed("word", "context"))
    if few:
        places = [x.join(other, "context", "left_semi").select("word", "context") for x in places]
        held = _summed(places)
        ends = [x.select(F.explode(F.array("word", "context")).alias("word")).groupBy("word").agg(F.count("*").alias("m")) for x in places]
    else:
        held = _summed(places).join(other, "context", "left_semi").select("word", "context", "n")
        own = F.when(F.col("word") == F.col("context"), F.array("word")).otherwise(F.array("word", "context"))
        ends = [held.select(F.explode(own).alias("word"), F.col("n").alias("m"))]
    total_of = reduce(DataFrame.unionByName, ends).groupBy("word").agg(F.sum("m").alias("n_w")).checkpoint()  # a row a word, read three times
    of_context = total_of.select(F.col("word").alias("context"), F.col("n_w").alias("n_c"))
    j = held.join(sent(total_of), "word").join(sent(of_context), "context").crossJoin(
        F.broadcast(total_of.agg(F.sum("n_w").alias("n_all"))))
    v = F.log(F.col("n") * F.col("n_all") / (F.col("n_w") * F.col("n_c")))
    return both_ways(j.select("word", "context", F.greatest(F.lit(0.0), v).alias("value")).where(F.col("value") > 0), "value")


def ngram_buckets(words: DataFrame, lo: int = 3, hi: int = 6, buckets: int = BUCKETS) -> DataFrame:
    """``(word, ngram, bucket)``: each character n-gram's bucket, by md5 (H3)."""
    return char_ngrams(words, lo, hi).withColumn("bucket", bucket_of(F.col("ngram"), buckets))


def bucket_of(ngram: Column, buckets: int = BUCKETS) -> Column:
    return F.conv(F.substring(F.md5(ngram), 1, 12), 16, 10).cast("bigint") % F.lit(buckets)


def fit_subword(sents: DataFrame, dim: int = 100, window: int = 5, min_count: int = 10, lo: int = 3, hi: int = 6,
                iters: int = 5, seed: int = 42, negatives: int = 5, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """``(bucket_vectors(bucket, vec), word_vectors(word, vec))`` by negative sampling (H3).

    A listed word's vector is the mean of its own and its n-grams' buckets'; ``subword_vectors`` reads the buckets
    of others.  The table of buckets holds those that some listed word has.
    """
    counts = frequent_counts(sents, min_count).checkpoint()
    parts = ngram_buckets(counts, lo, hi, buckets).select("word", F.col("bucket").cast("string").alias("part")).distinct().checkpoint()
    units = train_negative_sampling(frequent_pairs(sents, window, counts), counts, dim, iters, negatives, seed=seed, parts=parts, mirrored=True)
    own = units.where("side = 0").select("word", "vec")
    of_bucket = units.where("side <> 0").select(F.col("word").alias("part"), "vec")
    held = own.union(parts.join(of_bucket, "part").select("word", "vec"))
    return of_bucket.select(F.col("part").cast("bigint").alias("bucket"), "vec"), _mean_vectors(held)


def subword_vectors(words: DataFrame, ngram_vectors: DataFrame, lo: int = 3, hi: int = 6, buckets: int = BUCKETS) -> DataFrame:
    """A word (seen or not) = mean of its n-grams' vectors, by n-gram or by bucket: ``(word, vec)``.

    A group holds the n-grams of one word (bounded by its length); a word without any known n-gram gives no row.
    """
    words = words.select("word").distinct()
    if "bucket" in ngram_vectors.columns:
        held = ngram_buckets(words, lo, hi, buckets).select("word", "bucket").distinct().join(ngram_vectors, "bucket")
    else:
        held = char_ngrams(words, lo, hi).join(ngram_vectors, "ngram")
    return _mean_vectors(held)


def _mean_vectors(held: DataFrame) -> DataFrame:
    per = held.groupBy("word").agg(F.array_sort(F.collect_list("vec")).alias("vs"))  # sorted: the sum hangs on the order
    first = F.element_at("vs", 1)
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate("vs", zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return per.select("word", F.transform(total, lambda x: x / F.size("vs")).alias("vec"))
