"""Trained-model queries (rows-only checks): classifiers, PCA, neural LM.

Their SQL-checkable arithmetic is covered by ``validation_loss`` (trigram
probabilities on the validation tail) and the nearest-centroid CV queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators import classify as cl
from textlm.operators import evaluate as ev
from textlm.operators import ngram, neural as nn
from textlm.operators import perplexity as ppl
from textlm.operators import sequences as sq
from textlm.operators.generate import generate_argmax
from textlm.plans.common import trigram_run
from textlm.plans.q_eval import N_SPLITS, feature_rows
from textlm.plans.registry import X_DIGITS, query, r
from textlm.sources import tables

N_CLASSES = 100  # classes of about equal mass; every word of the vocabulary is in one
HIDDEN = 32
DIM = 32
VAL_FRAC = 0.05
KEYS = ("doc_id", "line")


def _folded_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = feature_rows(spark, sf)
    return ev.stratified_folds(rows, N_SPLITS)


def _cv(algo: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cl.cross_val_predict(_folded_features(spark, sf), algo, seed=42)

    return run


for _name, _algo in (("cv_lr", "LR"), ("cv_svm", "SVM"), ("cv_rf", "RF"), ("cv_gbt", "GBT")):
    query(_name)(_cv(_algo))


@query("pca_2d")
def q_pca_2d(spark: SparkSession, sf: str) -> DataFrame:
    return cl.pca_2d(tables.table(spark, sf, "embeddings"), "embedding", keep=("vec_id", "label"))


# ------------------------------------------------------------------ neural LM
def _neural_inputs(spark: SparkSession, sf: str, external: bool):
    from textlm.operators.embeddings import fit_skipgram
    from textlm.plans.q_vectors import word_vectors

    train = tables.training_sentences(spark, sf)
    windex = nn.word_classes(ngram.vocab_counts(train), N_CLASSES)
    if external:
        vectors = word_vectors(spark, sf).select("word", "vec")
        dim = 64
    else:
        vectors = fit_skipgram(train, dim=DIM, window=2, min_count=1, iters=1, seed=42).checkpoint()
        dim = DIM
    windex = windex.checkpoint()
    vectors = nn.word_vectors(vectors, windex)
    rows = nn.training_words(train, windex, vectors, N_CLASSES)
    split = sq.tail_split(rows, ["doc_id", "line", "pos"], VAL_FRAC, numbered=False)
    tops = nn.class_tops(windex)
    tr = nn.packed_rows(split.where(F.col("split") == "train"), vectors)
    return train, windex, vectors, dim, tr, split.where(F.col("split") == "val"), tops


def _train_summary(spark: SparkSession, sf: str, external: bool) -> DataFrame:
    _, _, vectors, dim, tr, va, tops = _neural_inputs(spark, sf, external)
    model = nn.fit_neural(tr, 2 * dim, HIDDEN, len(tops), iters=30, seed=42)
    m = nn.validation_metrics(model, nn.packed_rows(va, vectors, tops), tops)
    n = spark.createDataFrame([(nn.row_count(tr),)], "n_train bigint")
    return n.crossJoin(m.select(F.col("n").alias("n_val"), r("loss", 6, "val_loss"), r("accuracy", 6, "val_accuracy")))


@query("neural_lm_train")
def q_neural_lm_train(spark: SparkSession, sf: str) -> DataFrame:
    return _train_summary(spark, sf, external=False)


@query("neural_lm_ext")
def q_neural_lm_ext(spark: SparkSession, sf: str) -> DataFrame:
    return _train_summary(spark, sf, external=True)


@query("neural_scored_tokens")
def q_neural_scored_tokens(spark: SparkSession, sf: str) -> DataFrame:
    train, windex, vectors, dim, tr, _, tops = _neural_inputs(spark, sf, external=False)
    model = nn.fit_neural(tr, 2 * dim, HIDDEN, len(tops), iters=30, seed=42)
    size = ngram.corpus_size(train)
    test = tables.test_sentences(spark, sf)
    scored = nn.score_neural(test, model, windex, vectors, size, len(tops), ("doc_id", "label", "line"))
    docs = tables.labelled_docs(spark, sf).select("doc_id", "label")
    texts = ppl.text_perplexity(docs, test.select("doc_id", "line", "tokens"), scored, ppl.SKIP)
    return texts.select("doc_id", "label", "n_sentences", "n_scored_sentences", "n_tokens", "oov", "in_vocab",
                        r("ppl0", 4), r("ppl1", 4), r("ppl2", 6), "is_nan")


@query("neural_lm_epochs")
def q_neural_lm_epochs(spark: SparkSession, sf: str) -> DataFrame:
    _, _, vectors, dim, tr, va, tops = _neural_inputs(spark, sf, external=False)
    _, rows = nn.fit_with_early_stop(tr, nn.packed_rows(va, vectors, tops), 2 * dim, HIDDEN, len(tops), iters_per_epoch=5, tops=tops)
    return spark.createDataFrame(rows, "epoch int, val_loss double, val_accuracy double, stopped boolean")


@query("word_classes")
def q_word_classes(spark: SparkSession, sf: str) -> DataFrame:
    classes = nn.word_classes(ngram.vocab_counts(tables.training_sentences(spark, sf)), N_CLASSES)
    return classes.select("word", F.col("n").cast("bigint").alias("n"), F.col("cls").cast("bigint").alias("cls"), r("share", 9))


@query("neural_next_words")
def q_neural_next_words(spark: SparkSession, sf: str) -> DataFrame:
    """The neural model's likeliest word after each context of the test corpus."""
    _, _, vectors, dim, tr, _, tops = _neural_inputs(spark, sf, external=False)
    model = nn.fit_neural(tr, 2 * dim, HIDDEN, len(tops), iters=30, seed=42)
    contexts = ngram.kgrams(tables.test_sentences(spark, sf), keep=KEYS)
    return nn.next_words(contexts, model, vectors, tops).select("w1", "w2", "next_word", r("p", 9))


@query("validation_loss")
def q_validation_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy and accuracy of the trigram model on the validation tail (E4 arithmetic)."""
    run = trigram_run(spark, sf)
    from textlm.plans.q_encode import windex as windex10

    index = windex10(spark, sf).select("word", "id").checkpoint()
    seq = sq.training_sequences(run.train, index, words=True)
    split = sq.tail_split(seq, ["doc_id", "line", "pos"], VAL_FRAC, numbered=False)
    words = split.where(F.col("split") == "val").select(*KEYS, "pos", "w1", "w2", "w3")
    scored = ngram.score_grams(words, run.model, (*KEYS,))  # the model's own corpus: every trigram is found
    seeds = words.select(*KEYS, "pos", "w1", "w2")
    best = generate_argmax(seeds, run.model, (*KEYS, "pos")).select(*KEYS, "pos", "next_word")
    j = scored.join(best, [*KEYS, "pos"], "left")
    return j.agg(F.count("*").alias("n"), r(F.avg(-F.log("p")), X_DIGITS, "loss"),
                 r(F.avg((F.col("next_word") == F.col("w3")).cast("double")), X_DIGITS, "accuracy"))
