"""DuckDB twins of the evaluation queries."""

from __future__ import annotations

from textlm.plans.sql_lm import LINES, MODEL, SQL, _score, _sent, _texts, with_

N = 10

def folds_sql(measure: str = "ppl2", n: int = N) -> str:
    return f"""
rows AS (SELECT doc_id, label, coalesce({measure}, 0.0) AS x, {measure} IS NULL AS is_missing FROM texts),
class_n AS (SELECT label, count(*) AS n, min(doc_id) AS first_id FROM rows GROUP BY label),
classes AS (
  SELECT label, n,
         coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sort_start,
         coalesce(sum(n) OVER (ORDER BY first_id, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM class_n
),
fold_sizes AS (
  SELECT c.label, f.fold,
         ((c.start + c.n - f.fold + {n - 1}) // {n}) - ((c.start - f.fold + {n - 1}) // {n}) AS size
  FROM classes c CROSS JOIN (SELECT range AS fold FROM range({n})) f
),
fold_bounds AS (
  SELECT label, fold, sum(size) OVER (PARTITION BY label ORDER BY fold) - size AS lo,
         sum(size) OVER (PARTITION BY label ORDER BY fold) AS hi
  FROM fold_sizes
),
ranked AS (
  SELECT r.doc_id, r.label, r.x, r.is_missing, row_number() OVER (ORDER BY r.label, r.doc_id) - 1 - c.sort_start AS rk
  FROM rows r JOIN classes c ON c.label = r.label
),
folded AS (
  SELECT r.doc_id, r.label, r.x, r.is_missing, b.fold
  FROM ranked r JOIN fold_bounds b ON b.label = r.label AND r.rk >= b.lo AND r.rk < b.hi
)
"""


FOLDS = folds_sql()

CENTROID = """
per AS (
  SELECT fold, label, coalesce(sum(x) FILTER (NOT is_missing), 0.0) AS s_fold,
         count(*) FILTER (NOT is_missing) AS c_fold, count(*) AS n_fold
  FROM folded GROUP BY fold, label
),
tot AS (SELECT label, sum(s_fold) AS s_all, sum(c_fold) AS c_all, sum(n_fold) AS n_all FROM per GROUP BY label),
grid AS (
  SELECT f.fold, t.label,
         CASE WHEN t.c_all - coalesce(p.c_fold, 0) > 0
              THEN (t.s_all - coalesce(p.s_fold, 0)) / (t.c_all - coalesce(p.c_fold, 0)) END AS centroid,
         t.n_all - coalesce(p.n_fold, 0) AS n,
         t.n_all - coalesce(p.n_fold, 0) - t.c_all + coalesce(p.c_fold, 0) AS n_missing
  FROM (SELECT DISTINCT fold FROM per) f CROSS JOIN tot t
  LEFT JOIN per p ON p.fold = f.fold AND p.label = t.label
),
by_mark AS (
  SELECT fold, label FROM (
    SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY n_missing DESC, n DESC, label) AS k FROM grid)
  WHERE k = 1
),
nearest AS (
  SELECT doc_id, prediction FROM (
    SELECT fo.doc_id, g.label AS prediction,
           row_number() OVER (PARTITION BY fo.doc_id ORDER BY abs(fo.x - g.centroid), g.label) AS k
    FROM folded fo JOIN grid g ON g.fold = fo.fold AND g.centroid IS NOT NULL
    WHERE NOT fo.is_missing)
  WHERE k = 1
),
pred AS (
  SELECT fo.doc_id, fo.label, fo.fold, fo.x, coalesce(m.prediction, b.label) AS prediction
  FROM folded fo JOIN by_mark b ON b.fold = fo.fold LEFT JOIN nearest m ON m.doc_id = fo.doc_id
)
"""

DUMMY = """
dper AS (SELECT fold, label, count(*) AS c_fold FROM folded GROUP BY fold, label),
dtot AS (SELECT label, sum(c_fold) AS c_all FROM dper GROUP BY label),
dgrid AS (
  SELECT f.fold, t.label, t.c_all - coalesce(p.c_fold, 0) AS m
  FROM (SELECT DISTINCT fold FROM dper) f CROSS JOIN dtot t
  LEFT JOIN dper p ON p.fold = f.fold AND p.label = t.label
),
dcum AS (
  SELECT fold, label, sum(m) OVER (PARTITION BY fold ORDER BY label) / sum(m) OVER (PARTITION BY fold) AS hi
  FROM dgrid
),
pred AS (
  SELECT fo.doc_id, fo.label, fo.fold, fo.x,
         min(c.label) AS prediction
  FROM (SELECT *, ('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
        FROM folded) fo
  JOIN dcum c ON c.fold = fo.fold AND c.hi > fo.u
  GROUP BY fo.doc_id, fo.label, fo.fold, fo.x
)
"""

REPORT = """
pc AS (
  SELECT class, sum(tp) AS tp, sum(pp) AS n_pred, sum(t) AS n_true FROM (
    SELECT label AS class, 1 AS t, 0 AS pp, CAST(label = prediction AS INTEGER) AS tp FROM pred
    UNION ALL SELECT prediction AS class, 0, 1, 0 FROM pred)
  GROUP BY class
),
prf0 AS (
  SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
            CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM pc
),
prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM prf0
),
report AS (
  SELECT class AS row, precision, recall, f1, n_true::BIGINT AS support FROM prf
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(n_true), sum(n_true)::BIGINT FROM prf
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(n_true)::BIGINT FROM prf
  UNION ALL SELECT 'weighted avg', sum(precision * n_true) / sum(n_true), sum(recall * n_true) / sum(n_true),
                   sum(f1 * n_true) / sum(n_true), sum(n_true)::BIGINT FROM prf
)
"""

FOLD_SCORES = """
fpc AS (
  SELECT fold, class, sum(tp) AS tp, sum(pp) AS n_pred, sum(t) AS n_true FROM (
    SELECT fold, label AS class, 1 AS t, 0 AS pp, CAST(label = prediction AS INTEGER) AS tp FROM pred
    UNION ALL SELECT fold, prediction AS class, 0, 1, 0 FROM pred)
  GROUP BY fold, class
),
fprf0 AS (
  SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
            CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS recall FROM fpc
),
fprf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM fprf0
),
fold_scores AS (
  SELECT fold, sum(tp) / sum(n_true) AS accuracy, avg(precision) AS precision_macro,
         avg(recall) AS recall_macro, avg(f1) AS f1_macro
  FROM fprf GROUP BY fold
)
"""

BASE = (LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl"),
        _texts("test_docs", "test_sent", "sent_ppl", "texts", "propagate"), FOLDS)
R9 = "round({c}, 9) AS {c}"
REPORT_OUT = "SELECT row, " + ", ".join(R9.format(c=c) for c in ("precision", "recall", "f1")) + ", support FROM report"

SQL["balanced_weights"] = with_(*BASE) + """
SELECT label, n::BIGINT AS n, round((SELECT count(*) FROM rows) / ((SELECT count(*) FROM class_n) * n), 9) AS weight
FROM class_n
"""
SQL["stratified_folds"] = with_(*BASE) + "SELECT doc_id, label, fold::BIGINT AS fold FROM folded"
SQL["cv_centroid"] = with_(*BASE, CENTROID) + "SELECT doc_id, label, fold::BIGINT AS fold, prediction FROM pred"
SQL["cv_dummy"] = with_(*BASE, DUMMY) + "SELECT doc_id, label, fold::BIGINT AS fold, prediction FROM pred"
SQL["confusion_matrix"] = with_(*BASE, CENTROID) + """
SELECT a.c AS label, b.c AS prediction, coalesce(n, 0)::BIGINT AS n
FROM (SELECT label AS c FROM pred UNION SELECT prediction FROM pred) a
CROSS JOIN (SELECT label AS c FROM pred UNION SELECT prediction FROM pred) b
LEFT JOIN (SELECT label, prediction, count(*) AS n FROM pred GROUP BY ALL) x
  ON x.label = a.c AND x.prediction = b.c
"""
SQL["classification_report"] = with_(*BASE, CENTROID, REPORT) + REPORT_OUT
SQL["dummy_report"] = with_(*BASE, DUMMY, REPORT) + REPORT_OUT
SQL["minority_f1"] = with_(*BASE, CENTROID, REPORT) + "SELECT row AS label, round(f1, 3) AS f1 FROM report WHERE row = 'bad'"
SQL["cv_fold_scores"] = with_(*BASE, CENTROID, FOLD_SCORES) + (
    "SELECT fold::BIGINT AS fold, "
    + ", ".join(R9.format(c=c) for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro"))
    + " FROM fold_scores"
)
SQL["cv_scores"] = with_(*BASE, CENTROID, FOLD_SCORES) + """
SELECT count(*)::BIGINT AS n_folds, round(avg(accuracy), 9) AS accuracy_mean,
       round(2 * stddev_pop(accuracy), 9) AS accuracy_sd2, round(avg(f1_macro), 9) AS f1_mean,
       round(2 * stddev_pop(f1_macro), 9) AS f1_sd2
FROM fold_scores
"""


# the reference classifies ppl0 and ppl1 with 5 folds (ppl2 with 10)
for _m in ("ppl0", "ppl1"):
    SQL[f"cv_scores_{_m}"] = with_(LINES, MODEL, _score("test_sent", "scored"), _sent("scored", "sent_ppl"),
                                   _texts("test_docs", "test_sent", "sent_ppl", "texts", "propagate"),
                                   folds_sql(_m, 5), CENTROID, FOLD_SCORES) + """
SELECT count(*)::BIGINT AS n_folds, round(avg(accuracy), 9) AS accuracy_mean,
       round(2 * stddev_pop(accuracy), 9) AS accuracy_sd2, round(avg(f1_macro), 9) AS f1_mean,
       round(2 * stddev_pop(f1_macro), 9) AS f1_sd2
FROM fold_scores
"""
