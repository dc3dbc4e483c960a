"""Classification and evaluation queries over the text-level perplexities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.operators import evaluate as ev
from textlm.operators import perplexity as ppl
from textlm.plans.common import trigram_run
from textlm.plans.registry import X_DIGITS, query, r

N_SPLITS = 10  # folds for the ppl2 feature
MINORITY = "bad"


def feature_rows(spark: SparkSession, sf: str, measure: str = "ppl2") -> DataFrame:
    run = trigram_run(spark, sf)
    texts = ppl.text_perplexity(run.docs, run.test.select("doc_id", "line", "tokens"), run.scored, ppl.PROPAGATE)
    return ev.feature_rows(texts, measure)


def folded(spark: SparkSession, sf: str) -> DataFrame:
    return ev.stratified_folds(feature_rows(spark, sf), N_SPLITS)


def centroid_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cv_centroid(folded(spark, sf))


@query("balanced_weights")
def q_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ev.balanced_weights(feature_rows(spark, sf)).select("label", "n", r("weight", X_DIGITS))


@query("stratified_folds")
def q_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return folded(spark, sf).select("doc_id", "label", "fold")


@query("cv_centroid")
def q_cv_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_predictions(spark, sf).select("doc_id", "label", "fold", "prediction")


@query("cv_dummy")
def q_cv_dummy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cv_dummy(folded(spark, sf), seed=42).select("doc_id", "label", "fold", "prediction")


@query("confusion_matrix")
def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(centroid_predictions(spark, sf))


def _report_out(df: DataFrame) -> DataFrame:
    return df.select("row", r("precision", X_DIGITS), r("recall", X_DIGITS), r("f1", X_DIGITS), "support")


@query("classification_report")
def q_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report_out(ev.classification_report(centroid_predictions(spark, sf)))


@query("minority_f1")
def q_minority_f1(spark: SparkSession, sf: str) -> DataFrame:
    return ev.minority_f1(ev.classification_report(centroid_predictions(spark, sf)), MINORITY)


@query("cv_fold_scores")
def q_cv_fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.cv_fold_scores(centroid_predictions(spark, sf))
    return s.select("fold", *[r(c, X_DIGITS) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")])


@query("cv_scores")
def q_cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.cv_scores(ev.cv_fold_scores(centroid_predictions(spark, sf)))
    return s.select("n_folds", *[r(c, X_DIGITS) for c in ("accuracy_mean", "accuracy_sd2", "f1_mean", "f1_sd2")])


@query("dummy_report")
def q_dummy_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report_out(ev.classification_report(ev.cv_dummy(folded(spark, sf), seed=42)))


def _cv_scores_for(measure: str, n_splits: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = ev.stratified_folds(feature_rows(spark, sf, measure), n_splits)
        s = ev.cv_scores(ev.cv_fold_scores(ev.cv_centroid(f)))
        return s.select("n_folds", *[r(c, X_DIGITS) for c in ("accuracy_mean", "accuracy_sd2", "f1_mean", "f1_sd2")])

    return run


# the reference classifies ppl0 and ppl1 with 5 folds (ppl2 with 10)
query("cv_scores_ppl0")(_cv_scores_for("ppl0", 5))
query("cv_scores_ppl1")(_cv_scores_for("ppl1", 5))
