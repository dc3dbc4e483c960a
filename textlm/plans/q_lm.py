"""Language-model queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query runs one operator of the inventory over the whole driver tables
(``REGISTRY`` holds every module's queries once the package is imported).
Float outputs are rounded (the same way in ``oracle.py``) so that Spark and
DuckDB results hash equal; arrays are joined to strings for the same reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators import ngram, perplexity as ppl
from textlm.plans.common import trigram_run
from textlm.plans.registry import P_DIGITS, PPL2_DIGITS, PPL_DIGITS, REGISTRY, query, r
from textlm.sources import tables


def _ppl_cols() -> list:
    return [r("ppl0", PPL_DIGITS), r("ppl1", PPL_DIGITS), r("ppl2", PPL2_DIGITS)]


# --------------------------------------------------------------------- sources
@query("sentences")
def q_sentences(spark: SparkSession, sf: str) -> DataFrame:
    lines = tables.lines_of(tables.table(spark, sf, "documents").select("doc_id", "text"))
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line"), "value")


@query("labelled_docs")
def q_labelled_docs(spark: SparkSession, sf: str) -> DataFrame:
    return tables.labelled_docs(spark, sf).select(
        "doc_id", "label", F.length("text").cast("bigint").alias("n_chars")
    )


# ---------------------------------------------------------------------- tokens
@query("tokens")
def q_tokens(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.sentences(tables.lines_of(tables.table(spark, sf, "documents").select("doc_id", "text")))
    return s.select(
        "doc_id",
        F.col("line").cast("bigint").alias("line"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


# ------------------------------------------------------------------ vocabulary
@query("vocab_counts")
def q_vocab_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.vocab_counts(tables.training_sentences(spark, sf))


@query("corpus_size")
def q_corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.corpus_size(tables.training_sentences(spark, sf))


@query("unigram_probs")
def q_unigram_probs(spark: SparkSession, sf: str) -> DataFrame:
    m = ngram.fit_trigram(tables.training_sentences(spark, sf))
    return m.uni.select("word", "n", r("p", P_DIGITS))


# --------------------------------------------------------------------- trigram
@query("trigrams")
def q_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    g = ngram.kgrams(tables.training_sentences(spark, sf), keep=("doc_id", "line"))
    return g.select("doc_id", F.col("line").cast("bigint").alias("line"),
                    F.col("pos").cast("bigint").alias("pos"), "w1", "w2", "w3")


@query("trigram_counts")
def q_trigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.trigram_counts(tables.training_sentences(spark, sf))


@query("trigram_probs")
def q_trigram_probs(spark: SparkSession, sf: str) -> DataFrame:
    m = ngram.fit_trigram(tables.training_sentences(spark, sf))
    return m.tri.select("w1", "w2", "w3", "c", r("p", P_DIGITS))


@query("trigram_model_stats")
def q_trigram_model_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ngram.fit_trigram(tables.training_sentences(spark, sf)).meta


@query("scored_tokens")
def q_scored_tokens(spark: SparkSession, sf: str) -> DataFrame:
    run = trigram_run(spark, sf)
    return run.scored.select(
        "doc_id", "label", F.col("line").cast("bigint").alias("line"), F.col("pos").cast("bigint").alias("pos"),
        "w3", r("p", P_DIGITS), "oov", "in_vocab",
    )


@query("oov_counts")
def q_oov_counts(spark: SparkSession, sf: str) -> DataFrame:
    run = trigram_run(spark, sf)
    return run.scored.groupBy("label").agg(
        F.count("*").alias("n_scored"),
        F.sum("oov").cast("bigint").alias("oov"),
        F.sum("in_vocab").cast("bigint").alias("in_vocab"),
        F.sum(1 - F.col("oov") - F.col("in_vocab")).cast("bigint").alias("trigram_hits"),
    )


# ------------------------------------------------------------------ perplexity
@query("word_entropy")
def q_word_entropy(spark: SparkSession, sf: str) -> DataFrame:
    run = trigram_run(spark, sf)
    return run.scored.select(
        "doc_id", F.col("line").cast("bigint").alias("line"), F.col("pos").cast("bigint").alias("pos"),
        r(-F.log2("p"), 9, "entropy"),
    )


@query("sentence_perplexity")
def q_sentence_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    run = trigram_run(spark, sf)
    s = ppl.sentence_perplexity(run.scored)
    return s.select("doc_id", F.col("line").cast("bigint").alias("line"),
                    F.col("n_scored").cast("bigint").alias("n_scored"), *_ppl_cols(), "oov", "in_vocab")


def _texts(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    run = trigram_run(spark, sf)
    return ppl.text_perplexity(run.docs, run.test.select("doc_id", "line", "tokens"), run.scored, policy)


def _text_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "label", "n_sentences", "n_scored_sentences", "n_tokens", "oov", "in_vocab",
                     *_ppl_cols(), "is_nan")


@query("text_perplexity")
def q_text_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: per-text perplexities of the labelled corpus, NaN propagated."""
    return _text_out(_texts(spark, sf, ppl.PROPAGATE))


@query("text_perplexity_propagate")
def q_text_perplexity_propagate(spark: SparkSession, sf: str) -> DataFrame:
    return _text_out(_texts(spark, sf, ppl.PROPAGATE))


@query("text_perplexity_skip")
def q_text_perplexity_skip(spark: SparkSession, sf: str) -> DataFrame:
    return _text_out(_texts(spark, sf, ppl.SKIP))


@query("corpus_perplexity")
def q_corpus_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    run = trigram_run(spark, sf)
    c = ppl.corpus_perplexity(run.test, run.scored)
    return c.select(
        F.col("n_sentences").cast("bigint").alias("n_sentences"),
        F.col("n_scored_sentences").cast("bigint").alias("n_scored_sentences"),
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.col("oov").cast("bigint").alias("oov"),
        F.col("in_vocab").cast("bigint").alias("in_vocab"),
        *_ppl_cols(),
    )


@query("class_perplexity")
def q_class_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    """Both corpora scored in one pass, the training texts (class ``train``) by their own model."""
    docs = tables.classed_docs(spark, sf)
    sents = tables.sentences(tables.lines_of(docs))
    model = ngram.fit_trigram(tables.training_sentences(spark, sf))
    scored = ngram.score_tokens(sents, model, keep=("doc_id", "line"))
    counted = docs.select("doc_id", "label", F.coalesce(F.size(tables.split_lines(F.col("text"))), F.lit(0)).alias("n_sentences"))
    texts = ppl.text_perplexity(counted, sents, scored, ppl.SKIP)
    return ppl.class_perplexity(texts).select("label", "n_texts", *_ppl_cols())


@query("corpus_stats")
def q_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    test = tables.test_sentences(spark, sf).select("label", "doc_id", "tokens")
    train = tables.training_sentences(spark, sf).select(F.lit("train").alias("label"), "doc_id", "tokens")
    return ppl.corpus_stats(test.unionByName(train))


@query("score_table")
def q_score_table(spark: SparkSession, sf: str) -> DataFrame:
    t = ppl.score_table(_texts(spark, sf, ppl.PROPAGATE))
    return t.select("files", "label", r("perpl", PPL2_DIGITS), "is_nan")


@query("extreme_texts")
def q_extreme_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = ppl.score_table(_texts(spark, sf, ppl.PROPAGATE))
    return ppl.extremes(t).select("side", "files", "label", r("perpl", PPL2_DIGITS))


# ------------------------------------------------------------------ generation
def _seeds(run):
    from textlm.operators.generate import seed_contexts

    return seed_contexts(run.test, ("doc_id", "line"))


@query("generated_sample")
def q_generated_sample(spark: SparkSession, sf: str) -> DataFrame:
    from textlm.operators.generate import generate_sample

    run = trigram_run(spark, sf)
    g = generate_sample(_seeds(run), run.model, ("doc_id", "line"), seed=42)
    return g.select("doc_id", F.col("line").cast("bigint").alias("line"), "w1", "w2", "next_word", "from_context")


@query("generated_argmax")
def q_generated_argmax(spark: SparkSession, sf: str) -> DataFrame:
    from textlm.operators.generate import generate_argmax

    run = trigram_run(spark, sf)
    g = generate_argmax(_seeds(run), run.model, ("doc_id", "line"), seed=42)
    return g.select("doc_id", F.col("line").cast("bigint").alias("line"), "w1", "w2", "next_word", "from_context")


@query("shuffled_sentences")
def q_shuffled_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Two seeded passes over the document shards, numbered in pass order."""
    from textlm.operators.rownum import global_row_number
    from textlm.sources.files import shuffled_passes

    lines = tables.lines_of(tables.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "line")
    p = shuffled_passes(lines, seed=42, passes=2)
    ranked = global_row_number(p, ["pass", "order_key", "line"], "rank")
    return ranked.select(F.col("pass").cast("bigint").alias("pass"), "doc_id",
                         F.col("line").cast("bigint").alias("line"), "rank")
