"""Next-word generation from the trigram tables.

Sampling is an inverse-CDF draw on integer counts: a context with total
count T lays its continuations (ordered by word) on ``[0, T)``, and a seed
with uniform ``u`` picks the continuation whose interval holds ``floor(u T)``.
An unknown context draws from the unigram counts on ``[0, corpus_size)``.

The interval lookup is a range join done by bucketing: every interval is
exploded over the fixed-width buckets it covers (width = mean count per
interval, so at most about twice the table's rows), and a seed meets only
the intervals of its own bucket -- a hot context never pairs every seed
with every continuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.operators.ngram import TrigramModel, context_key
from textlm.operators.rownum import global_cumsum, global_row_number
from textlm.sources.tables import BROADCAST_MAX_ROWS


def seed_contexts(sents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(*keys, w1, w2)``: the first two tokens of every sentence that has them."""
    t = F.col("tokens")
    return sents.where(F.size(t) >= 2).select(*keys, F.element_at(t, 1).alias("w1"), F.element_at(t, 2).alias("w2"))


def _key(keys: tuple[str, ...]) -> Column:
    return F.concat_ws(":", *[F.col(k).cast("string") for k in keys])


def _buckets(lo: Column, hi: Column, width: Column) -> Column:
    return F.sequence(F.floor(lo / width).cast("bigint"), F.floor((hi - 1) / width).cast("bigint"))


def generate_sample(seeds: DataFrame, model: TrigramModel, keys: tuple[str, ...], seed: int = 42) -> DataFrame:
    """``(*keys, w1, w2, next_word, from_context)``."""
    s = seeds.withColumn("u", _u(seed, keys))
    if model.keyed is not None:  # a model fitted here: a context is one number
        s, on = s.withColumn("ctx", context_key(F.col("w1"), F.col("w2"))), ["ctx"]
        tri = model.keyed.where(F.col("ctx") != 0).select("ctx", F.col("word").alias("w3"), "c")
    else:
        on, tri = ["w1", "w2"], model.tri.select("w1", "w2", "w3", "c")
    asked = s.select(*on).distinct()
    few = asked.count() <= BROADCAST_MAX_ROWS
    # the counts of contexts that a seed has; while these go to the tasks, others are left out before the counts are shuffled
    tri = tri.join(F.broadcast(asked) if few else asked, on, "left_semi")
    # prefix sums over all continuations, less what lies before the context: a hot context spreads over partitions
    cum = global_cumsum(tri, [*on, "w3"], "c", "before")
    ctx_tot = cum.groupBy(*on).agg(
        F.sum("c").alias("total"), F.min("before").alias("start"),
        F.greatest(F.lit(1), F.ceil(F.sum("c") / F.count("*"))).cast("bigint").alias("width"))
    tri = cum.join(ctx_tot, on).withColumn("lo", F.col("before") - F.col("start")).withColumn(
        "hi", F.col("lo") + F.col("c"))
    ctx_tot = ctx_tot.drop("start")

    known = s.join(ctx_tot, on, "inner")
    known = known.withColumn("t", F.floor(F.col("u") * F.col("total")).cast("bigint")).withColumn(
        "bucket", F.floor(F.col("t") / F.col("width")).cast("bigint"))
    cells = tri.select(*on, "w3", "lo", "hi",
                       F.explode(_buckets(F.col("lo"), F.col("hi"), F.col("width"))).alias("bucket"))
    hit = known.join(cells, [*on, "bucket"]).where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    from_ctx = hit.select(*keys, "w1", "w2", F.col("w3").alias("next_word"), F.lit(True).alias("from_context"))

    unknown = s.join(ctx_tot.select(*on), on, "left_anti")
    return from_ctx.unionByName(_unigram_draw(unknown, model, keys))


def _u(seed: int, keys: tuple[str, ...]) -> Column:
    h = F.md5(F.concat(F.lit(f"{seed}:"), _key(keys)))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def _unigram_draw(unknown: DataFrame, model: TrigramModel, keys: tuple[str, ...]) -> DataFrame:
    vocab = model.uni.select("word", "n")
    cum = global_cumsum(vocab, ["word"], "n", "lo")
    meta = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("corpus_size"), F.count("*").alias("vocab_size"))
    cum = cum.crossJoin(F.broadcast(meta)).withColumn("hi", F.col("lo") + F.col("n")).withColumn(
        "width", F.greatest(F.lit(1), F.ceil(F.col("corpus_size") / F.col("vocab_size"))).cast("bigint"))
    cells = cum.select("word", "lo", "hi", F.explode(_buckets(F.col("lo"), F.col("hi"), F.col("width"))).alias("bucket"))
    u = unknown.crossJoin(F.broadcast(meta)).withColumn(
        "t", F.floor(F.col("u") * F.col("corpus_size")).cast("bigint")).withColumn(
        "bucket", F.floor(F.col("t") / F.greatest(F.lit(1), F.ceil(F.col("corpus_size") / F.col("vocab_size")))).cast("bigint"))
    hit = u.join(cells, "bucket").where((F.col("t") >= F.col("lo")) & (F.col("t") < F.col("hi")))
    return hit.select(*keys, "w1", "w2", F.col("word").alias("next_word"), F.lit(False).alias("from_context"))


def generate_argmax(seeds: DataFrame, model: TrigramModel, keys: tuple[str, ...], seed: int = 42) -> DataFrame:
    """Most frequent continuation (ties: smaller word); unknown context -> word at a
    seeded uniform position of the word index (D8)."""
    smallest = F.min(F.struct((-F.col("c")).alias("neg"), "next_word")).alias("b")
    s = seeds.withColumn("u", _u(seed, keys))
    if model.keyed is not None:  # a model fitted here: no probabilities, a context as one number
        best = model.keyed.where(F.col("ctx") != 0).select("ctx", "c", F.col("word").alias("next_word")).groupBy("ctx").agg(smallest)
        s, on = s.withColumn("ctx", context_key(F.col("w1"), F.col("w2"))), ["ctx"]
        vocab = model.keyed.groupBy("word").agg(F.sum("c").alias("n"))
    else:
        best = model.tri.select("w1", "w2", "c", F.col("w3").alias("next_word")).groupBy("w1", "w2").agg(smallest)
        on, vocab = ["w1", "w2"], model.uni.select("word", "n")
    best = best.select(*on, F.col("b.next_word").alias("next_word"))
    known = s.join(best, on, "inner").select(*keys, "w1", "w2", "next_word", F.lit(True).alias("from_context"))
    unknown = s.join(best.select(*on), on, "left_anti")
    windex = global_row_number(vocab, [F.col("n").desc(), F.col("word").asc()], "id")
    v = windex.agg(F.count("*").alias("vocab_size"))
    pick = unknown.crossJoin(F.broadcast(v)).withColumn("id", F.floor(F.col("u") * F.col("vocab_size")).cast("bigint"))
    fallback = pick.join(windex.select("id", F.col("word").alias("next_word")), "id").select(
        *keys, "w1", "w2", "next_word", F.lit(False).alias("from_context"))
    return known.unionByName(fallback)
