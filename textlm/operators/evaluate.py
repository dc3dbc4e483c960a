"""Cross-validated classification on one feature, and its reports.

Rows are ``(doc_id, label, x)``.  Folds follow stratified, unshuffled k-fold:
classes are numbered by first appearance (in ``doc_id`` order), fold sizes per
class come from dealing the class-sorted label sequence round-robin over the
folds, and inside a class the rows (in ``doc_id`` order) fill fold 0 first,
then fold 1, ...

Every per-class / per-fold table here has ``classes x folds`` rows, so it is
broadcast with a proven bound; row-level work never leaves its partition
except through ``global_row_number`` (range partitioned).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlm.operators.rownum import global_row_number

MISSING_X = 0.0  # feature value for texts whose perplexity is NaN (outside [1, inf))


def feature_rows(texts: DataFrame, measure: str = "ppl2") -> DataFrame:
    """``(doc_id, label, x, is_missing)``: the single feature column (G1); NaN -> constant + flag."""
    return texts.select(
        "doc_id", "label",
        F.coalesce(F.col(measure), F.lit(MISSING_X)).alias("x"),
        F.col(measure).isNull().alias("is_missing"),
    )


def class_counts(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """``(label, n, sort_start, start)`` per class (tiny).

    ``sort_start``: first position of the class when rows are sorted by label;
    ``start``: first position in the fold allocation, where classes are
    encoded by order of first appearance (smallest ``order`` value first).
    """
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    # one row per class: windows over the aggregated table are bounded
    before = Window.unboundedPreceding
    by_label = Window.orderBy("label").rowsBetween(before, -1)
    by_first = Window.orderBy("_first", "label").rowsBetween(before, -1)
    return counts.select(
        "label", "n",
        F.coalesce(F.sum("n").over(by_label), F.lit(0)).cast("bigint").alias("sort_start"),
        F.coalesce(F.sum("n").over(by_first), F.lit(0)).cast("bigint").alias("start"),
    )


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``(label, n, weight)`` with ``weight = N / (classes * n)``."""
    c = rows.groupBy("label").agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return c.crossJoin(F.broadcast(tot)).select(
        "label", "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight")
    )


def _fold_bounds(classes: DataFrame, n_splits: int) -> DataFrame:
    """``(label, fold, lo, hi)``: within-class rank range of each fold."""
    def upto(x):  # how many positions q in [0, x) have q mod n == fold
        return F.floor((x - F.col("fold") + F.lit(n_splits - 1)) / F.lit(n_splits))

    per_fold = classes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)).cast("array<bigint>")).alias("fold"))
    sizes = per_fold.select(
        "label", "fold",
        (upto(F.col("start") + F.col("n")) - upto(F.col("start"))).cast("bigint").alias("size"),
    )
    w = Window.partitionBy("label").orderBy("fold")
    hi = F.sum("size").over(w)
    return sizes.select("label", "fold", (hi - F.col("size")).alias("lo"), hi.alias("hi"))


def stratified_folds(rows: DataFrame, n_splits: int) -> DataFrame:
    """``rows`` plus ``fold``."""
    ranked = global_row_number(rows, ["label", "doc_id"], "pos")
    classes = class_counts(ranked)
    b = _fold_bounds(classes, n_splits).select(F.col("label").alias("b_label"), "fold", "lo", "hi")
    r = ranked.join(F.broadcast(classes.select("label", "sort_start")), "label")
    r = r.withColumn("rank", F.col("pos") - F.col("sort_start"))
    cond = (F.col("label") == F.col("b_label")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return r.join(F.broadcast(b), cond).drop("b_label", "lo", "hi", "pos", "sort_start", "rank")


def cv_centroid(folded: DataFrame) -> DataFrame:
    """Out-of-fold nearest-centroid predictions (G9 with a deterministic classifier).

    The centroid of class k for fold i is the mean ``x`` of class k over the
    other folds; ties go to the smaller label.  Rows marked ``is_missing`` (if
    there is such a column) enter no centroid; they are predicted by the mark,
    as a tree's branch for missing values would be: the class with most missing
    rows in the other folds, then with most rows, then the smaller label.  The
    same holds for all rows where the other folds have no centroid.
    """
    missing = F.col("is_missing") if "is_missing" in folded.columns else F.lit(False)
    rows = folded.withColumn("_x", F.when(~missing, F.col("x")))
    per = rows.groupBy("fold", "label").agg(
        F.coalesce(F.sum("_x"), F.lit(0.0)).alias("s"), F.count("_x").alias("c"), F.count("*").alias("n"))
    tot = per.groupBy("label").agg(*[F.sum(k).alias(f"{k}_all") for k in ("s", "c", "n")])
    folds = per.select("fold").distinct()

    def rest(k: str) -> F.Column:
        return F.col(f"{k}_all") - F.coalesce(F.col(k), F.lit(0))

    grid = folds.crossJoin(tot).join(per, ["fold", "label"], "left").select(
        "fold", "label", F.when(rest("c") > 0, rest("s") / rest("c")).alias("centroid"),
        (rest("c") - rest("n")).alias("neg_missing"), (-rest("n")).alias("neg_n"))
    cents = grid.groupBy("fold").agg(
        F.collect_list(F.when(F.col("centroid").isNotNull(), F.struct("label", "centroid"))).alias("cents"),
        F.min(F.struct("neg_missing", "neg_n", "label"))["label"].alias("by_mark"))
    j = rows.join(F.broadcast(cents), "fold")
    best = F.array_min(F.transform(
        "cents", lambda c: F.struct(F.abs(F.col("_x") - c["centroid"]).alias("d"), c["label"].alias("label"))
    ))
    return j.select("doc_id", "label", "fold", "x", F.when(F.col("_x").isNull(), F.col("by_mark")).otherwise(
        F.coalesce(best["label"], F.col("by_mark"))).alias("prediction"))


def uniform(seed: int, key: str) -> F.Column:
    """Deterministic U[0,1) from md5 of ``seed:key`` (48 bits); same in DuckDB."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def cv_dummy(folded: DataFrame, seed: int = 42) -> DataFrame:
    """Stratified dummy (G4): draw a class from the other folds' class priors."""
    per = folded.groupBy("fold", "label").agg(F.count("*").alias("c_fold"))
    tot = per.groupBy("label").agg(F.sum("c_fold").alias("c_all"))
    folds = per.select("fold").distinct()
    grid = folds.crossJoin(tot).join(per, ["fold", "label"], "left").select(
        "fold", "label", (F.col("c_all") - F.coalesce("c_fold", F.lit(0))).alias("m")
    )
    w = Window.partitionBy("fold").orderBy("label")
    cum = grid.select(
        "fold", "label",
        (F.sum("m").over(w) / F.sum("m").over(Window.partitionBy("fold"))).alias("hi"),
    )
    cdf = cum.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("hi", "label"))).alias("cdf"))
    j = folded.withColumn("u", uniform(seed, "doc_id")).join(F.broadcast(cdf), "fold")
    pick = F.filter("cdf", lambda e: e["hi"] > F.col("u"))
    return j.select("doc_id", "label", "fold", "x",
                    F.coalesce(F.element_at(pick, 1)["label"], F.element_at("cdf", -1)["label"]).alias("prediction"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """``(label, prediction, n)`` with zero cells present."""
    cells = pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    classes = pred.select(F.col("label").alias("c")).union(pred.select("prediction")).distinct()
    grid = classes.select(F.col("c").alias("label")).crossJoin(classes.select(F.col("c").alias("prediction")))
    return grid.join(cells, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def _per_class(pred: DataFrame, group: tuple[str, ...] = ()) -> DataFrame:
    """``(*group, class, tp, n_pred, n_true)``; classes = labels and predictions seen."""
    t = pred.select(*group, F.col("label").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("pp"),
                    (F.col("label") == F.col("prediction")).cast("int").alias("tp"))
    p = pred.select(*group, F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("pp"),
                    F.lit(0).alias("tp"))
    return t.unionByName(p).groupBy(*group, "class").agg(
        F.sum("tp").alias("tp"), F.sum("pp").alias("n_pred"), F.sum("t").alias("n_true")
    )


def _prf(df: DataFrame) -> DataFrame:
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    df = df.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(F.lit(0.0))
    return df.withColumn("f1", f1)


def classification_report(pred: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted rows.

    0/0 is reported as 0.  Output ``(row, precision, recall, f1, support)``.
    """
    pc = _prf(_per_class(pred))
    per_class = pc.select(F.col("class").alias("row"), "precision", "recall", "f1",
                          F.col("n_true").cast("bigint").alias("support"))
    agg = pc.agg(
        F.sum("n_true").alias("N"), F.sum("tp").alias("TP"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("n_true")).alias("wp"),
        F.sum(F.col("recall") * F.col("n_true")).alias("wr"),
        F.sum(F.col("f1") * F.col("n_true")).alias("wf"),
    )
    acc = agg.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("TP") / F.col("N")).alias("f1"),
                     F.col("N").cast("bigint").alias("support"))
    macro = agg.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("N").cast("bigint").alias("support"))
    weighted = agg.select(F.lit("weighted avg").alias("row"), (F.col("wp") / F.col("N")).alias("precision"),
                          (F.col("wr") / F.col("N")).alias("recall"), (F.col("wf") / F.col("N")).alias("f1"),
                          F.col("N").cast("bigint").alias("support"))
    return per_class.unionByName(acc).unionByName(macro).unionByName(weighted)


def minority_f1(report: DataFrame, label: str) -> DataFrame:
    """F1 of one class rounded to 3."""
    return report.where(F.col("row") == label).select(F.col("row").alias("label"), F.round("f1", 3).alias("f1"))


def cv_fold_scores(pred: DataFrame) -> DataFrame:
    """Per test fold: accuracy and macro precision / recall / F1."""
    pc = _prf(_per_class(pred, ("fold",)))
    return pc.groupBy("fold").agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def cv_scores(fold_scores: DataFrame) -> DataFrame:
    """Mean and 2 x population sd of accuracy and macro F1 over folds."""
    return fold_scores.agg(
        F.count("*").alias("n_folds"),
        F.avg("accuracy").alias("accuracy_mean"), (2 * F.stddev_pop("accuracy")).alias("accuracy_sd2"),
        F.avg("f1_macro").alias("f1_mean"), (2 * F.stddev_pop("f1_macro")).alias("f1_sd2"),
    )
