"""Evaluation operators: folds, report, weights, global row numbers (FIXTURES.md §3)."""

import pytest
from pyspark.sql import functions as F

from textlm.operators import evaluate as ev
from textlm.operators.rownum import global_row_number


def _stratified_reference(labels, n_splits):
    """Plain-Python statement of unshuffled stratified k-fold allocation
    (classes numbered by first appearance)."""
    classes = sorted(set(labels), key=labels.index)
    code = {c: i for i, c in enumerate(classes)}
    y_sorted = sorted(code[lab] for lab in labels)
    alloc = [[y_sorted[i::n_splits].count(code[c]) for c in classes] for i in range(n_splits)]
    folds = [None] * len(labels)
    for k, c in enumerate(classes):
        seq = [i for i in range(n_splits) for _ in range(alloc[i][k])]
        idx = [j for j, lab in enumerate(labels) if lab == c]
        for j, f in zip(idx, seq):
            folds[j] = f
    return folds


@pytest.mark.parametrize("n_splits", [3, 5, 10])
def test_stratified_folds_match_rule(spark, n_splits):
    labels = ["good"] * 23 + ["bad"] * 7 + ["mid"] * 11
    order = sorted(range(len(labels)), key=lambda i: (i * 7919) % 41)  # shuffled ids
    labels = [labels[i] for i in order]
    rows = spark.createDataFrame([(i, lab, 0.0) for i, lab in enumerate(labels)], "doc_id long, label string, x double")
    got = {r.doc_id: r.fold for r in ev.stratified_folds(rows, n_splits).collect()}
    assert [got[i] for i in range(len(labels))] == _stratified_reference(labels, n_splits)


def test_report_and_confusion(spark):
    pred = spark.createDataFrame(
        [(1, "g", "g"), (2, "g", "g"), (3, "g", "b"), (4, "b", "b"), (5, "b", "g")],
        "doc_id long, label string, prediction string",
    )
    rep = {r.row: r for r in ev.classification_report(pred).collect()}
    assert rep["g"].precision == pytest.approx(2 / 3) and rep["g"].f1 == pytest.approx(2 / 3)
    assert rep["b"].recall == pytest.approx(0.5) and rep["b"].support == 2
    assert rep["accuracy"].f1 == pytest.approx(0.6)
    assert rep["macro avg"].f1 == pytest.approx(0.583333, abs=1e-6)
    assert rep["weighted avg"].f1 == pytest.approx(0.6)
    cm = {(r.label, r.prediction): r.n for r in ev.confusion_matrix(pred).collect()}
    assert cm == {("g", "g"): 2, ("g", "b"): 1, ("b", "g"): 1, ("b", "b"): 1}


def test_balanced_weights(spark):
    rows = spark.createDataFrame([("g",)] * 3 + [("b",)] * 2, "label string")
    w = {r.label: r.weight for r in ev.balanced_weights(rows).collect()}
    assert w["g"] == pytest.approx(5 / 6) and w["b"] == pytest.approx(5 / 4)


def test_global_row_number_dense(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    out = global_row_number(df, ["k"], "rn", partitions=7).collect()
    assert sorted((r.k, r.rn) for r in out) == [(i, i) for i in range(5000)]


def test_centroid_every_row_in_one_fold(spark):
    rows = spark.createDataFrame([(i, "g" if i % 3 else "b", float(i % 5)) for i in range(60)],
                                 "doc_id long, label string, x double")
    pred = ev.cv_centroid(ev.stratified_folds(rows, 5))
    assert pred.count() == 60 and pred.select("doc_id").distinct().count() == 60


def test_missing_rows_enter_no_centroid(spark):
    rows = [(i, "g", 10.0, False, i % 2) for i in range(6)] + [(10 + i, "b", 2.0, False, i % 2) for i in range(4)]
    rows += [(20 + i, "b", 0.0, True, i % 2) for i in range(6)] + [(30, "g", 0.0, True, 0), (31, "b", 4.0, False, 1)]
    folded = spark.createDataFrame(rows, "doc_id long, label string, x double, is_missing boolean, fold long")
    pred = {r.doc_id: r.prediction for r in ev.cv_centroid(folded).collect()}
    assert all(pred[i] == "g" for i in range(6)) and all(pred[10 + i] == "b" for i in range(4))
    # with missing rows as 0 the centroid of b would be near 1, not 2 or more
    assert pred[31] == "b" and all(pred[20 + i] == "b" for i in range(6)) and pred[30] == "b"
    # nothing but missing rows in the other fold
    only = spark.createDataFrame([(1, "g", 1.0, False, 0), (2, "b", 0.0, True, 1), (3, "b", 0.0, True, 1)],
                                 "doc_id long, label string, x double, is_missing boolean, fold long")
    assert {r.doc_id: r.prediction for r in ev.cv_centroid(only).collect()} == {1: "b", 2: "g", 3: "g"}


def test_row_numbers_split_a_hot_key(spark):
    # one value holds half of all rows: its run must spread over several partitions
    df = spark.range(0, 4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    out = global_row_number(df, ["k"], "rn", partitions=8)
    per = out.where(F.col("k") == 7).select(F.spark_partition_id().alias("p")).distinct().count()
    assert per > 1
    assert sorted(r.rn for r in out.collect()) == list(range(4000))
