"""Word-vector queries over ``embeddings`` (H5-H18) and vocabulary ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators import ngram, stats, vectors as vx, vocab as vc
from textlm.plans.registry import X_DIGITS, query, r
from textlm.sources import tables

N_NEIGHBORS = 10
N_RESTRICT = 100
N_LAYERS = 4  # the 64-wide embedding read as 4 layers of 16
MIX_W = [0.0, 0.5, 1.0, 1.5]
MIX_GAMMA = 0.5


def vec_table(spark: SparkSession, sf: str) -> DataFrame:
    return vx.vector_table(tables.table(spark, sf, "embeddings"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return vx.derived_pairs(vec_table(spark, sf))


def _stats_cols(c: str, prefix: str) -> list:
    return [
        r(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x), X_DIGITS, f"{prefix}_sum"),
        r(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * x), X_DIGITS, f"{prefix}_sq"),
        r(F.element_at(c, 1), X_DIGITS, f"{prefix}_first"),
        r(F.element_at(c, -1), X_DIGITS, f"{prefix}_last"),
    ]


# ------------------------------------------------------------------ vocabulary
@query("vocab_min10")
def q_vocab_min10(spark: SparkSession, sf: str) -> DataFrame:
    return vc.min_count(ngram.vocab_counts(tables.training_sentences(spark, sf)), 10)


@query("word_index")
def q_word_index(spark: SparkSession, sf: str) -> DataFrame:
    return vc.word_index(ngram.vocab_counts(tables.training_sentences(spark, sf))).select("word", "n", "id")


@query("vocab_size")
def q_vocab_size(spark: SparkSession, sf: str) -> DataFrame:
    return vc.vocab_size(ngram.vocab_counts(tables.training_sentences(spark, sf)))


@query("test_words_in_vocab")
def q_test_words_in_vocab(spark: SparkSession, sf: str) -> DataFrame:
    test = ngram.vocab_counts(tables.test_sentences(spark, sf))
    train = ngram.vocab_counts(tables.training_sentences(spark, sf))
    return vc.in_vocab(test, train).select("word", "n", "in_vocab")


# ---------------------------------------------------------------- vector basics
@query("unit_vectors")
def q_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = vec_table(spark, sf)
    u = v.select("word", vx.norm(F.col("vec")).alias("norm"), vx.normalize(F.col("vec")).alias("u"))
    return u.select("word", r("norm", X_DIGITS), *_stats_cols("u", "u"))


@query("pair_similarity")
def q_pair_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return vx.pair_scores(pairs(spark, sf), vec_table(spark, sf)).select("w1", "w2", r("sim", X_DIGITS))


@query("most_similar")
def q_most_similar(spark: SparkSession, sf: str) -> DataFrame:
    v = vec_table(spark, sf)
    out = vx.most_similar(v, v, N_NEIGHBORS)
    return out.select("query", "neighbor", F.col("rank").cast("bigint").alias("rank"), r("similarity", X_DIGITS))


@query("missing_pairs")
def q_missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return vx.missing_pairs(pairs(spark, sf), vec_table(spark, sf))


@query("restricted_vectors")
def q_restricted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = vx.restrict_vocab(vec_table(spark, sf), N_RESTRICT)
    return v.select("word", "vec_id", r(vx.norm(F.col("vec")), X_DIGITS, "norm"))


@query("pair_scores")
def q_pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    return vx.pair_scores(pairs(spark, sf), vec_table(spark, sf)).select("w1", "w2", "score", r("sim", X_DIGITS))


@query("pair_scores_zero")
def q_pair_scores_zero(spark: SparkSession, sf: str) -> DataFrame:
    z = vx.pair_scores_zero(pairs(spark, sf), vec_table(spark, sf))
    return z.select("w1", "w2", "score", r("sim", X_DIGITS), "missing")


@query("unknown_ratio")
def q_unknown_ratio(spark: SparkSession, sf: str) -> DataFrame:
    z = vx.pair_scores_zero(pairs(spark, sf), vec_table(spark, sf))
    return z.agg(F.count("*").alias("n_pairs"), F.sum(F.col("missing").cast("int")).cast("bigint").alias("n_missing"),
                 r(F.avg(F.col("missing").cast("double")), X_DIGITS, "unknown_ratio"))


@query("pearson")
def q_pearson(spark: SparkSession, sf: str) -> DataFrame:
    p = stats.pearson(vx.pair_scores(pairs(spark, sf), vec_table(spark, sf)), "score", "sim")
    return p.select("n", r("r", X_DIGITS), r("t", 6))


@query("spearman")
def q_spearman(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.spearman(vx.pair_scores(pairs(spark, sf), vec_table(spark, sf)), "score", "sim")
    return s.select("n", r("rho", X_DIGITS), r("t", 6))


@query("correlation_pvalues")
def q_correlation_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    ps = vx.pair_scores(pairs(spark, sf), vec_table(spark, sf))
    p = stats.with_pvalue(stats.pearson(ps, "score", "sim")).select(F.lit("pearson").alias("test"), "n", "r", "t", "p")
    s = stats.with_pvalue(stats.spearman(ps, "score", "sim").withColumnRenamed("rho", "r")).select(
        F.lit("spearman").alias("test"), "n", "r", "t", "p")
    return p.unionByName(s).select("test", "n", r("r", X_DIGITS), r("t", 6), r("p", X_DIGITS), r(F.log10("p"), 5, "log10_p"))


# ---------------------------------------------------------------- layer mixing
def _layers(spark: SparkSession, sf: str) -> DataFrame:
    v = vec_table(spark, sf)
    width = 64 // N_LAYERS
    return v.select("word", *[F.slice("vec", i * width + 1, width).alias(f"layer{i}") for i in range(N_LAYERS)])


@query("mixed_layers")
def q_mixed_layers(spark: SparkSession, sf: str) -> DataFrame:
    lay = _layers(spark, sf)
    m = vx.mix_layers([F.col(f"layer{i}") for i in range(N_LAYERS)], MIX_W, MIX_GAMMA)
    return lay.select("word", m.alias("mixed")).select("word", *_stats_cols("mixed", "mixed"))


@query("mixed_layers_top")
def q_mixed_layers_top(spark: SparkSession, sf: str) -> DataFrame:
    lay = _layers(spark, sf)
    m = vx.mix_layers([F.col(f"layer{i}") for i in range(N_LAYERS)], MIX_W, MIX_GAMMA, top_only=True)
    return lay.select("word", m.alias("mixed")).select("word", *_stats_cols("mixed", "mixed"))


@query("layer_norm")
def q_layer_norm(spark: SparkSession, sf: str) -> DataFrame:
    lay = vx.layer_norm(_layers(spark, sf), [f"layer{i}" for i in range(N_LAYERS)])
    m = vx.mix_layers([F.col(f"layer{i}") for i in range(N_LAYERS)])
    return lay.select("word", m.alias("mixed")).select("word", *_stats_cols("mixed", "mixed"))


# ------------------------------------------------------- token / sentence vectors
def word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary words with a vector: word id (frequency rank) = ``vec_id``."""
    widx = vc.word_index(ngram.vocab_counts(tables.training_sentences(spark, sf)))
    emb = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vx.as_double(F.col("embedding")).alias("vec"))
    return widx.join(emb, "id", "inner").select("word", "id", "vec")


@query("token_vectors")
def q_token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    words = ngram.vocab_counts(tables.test_sentences(spark, sf))
    tv = vx.token_vectors(words, word_vectors(spark, sf))
    return tv.select("word", r(vx.norm(F.col("vec")), X_DIGITS, "norm"))


@query("sentence_layers")
def q_sentence_layers(spark: SparkSession, sf: str) -> DataFrame:
    bench = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    sents = tables.sentences(tables.lines_of(bench))
    wv = word_vectors(spark, sf)
    out = vx.sentence_layers(sents, wv)
    return out.select(
        "doc_id", F.col("line").cast("bigint").alias("line"), F.col("pos").cast("bigint").alias("pos"), "word",
        r(F.aggregate("layer1", F.lit(0.0), lambda a, x: a + x), X_DIGITS, "l1_sum"),
        r(F.aggregate("layer2", F.lit(0.0), lambda a, x: a + x), X_DIGITS, "l2_sum"),
    )
