"""Correlation statistics.

Pearson is Spark's ``corr``.  Spearman is Pearson over average ranks; ranks
come from range-partitioned global row numbers (no single-partition window),
and tied values share the mean of their first and last position.  P-values
use Student's t with n - 2 degrees of freedom and the regularised incomplete
beta function, whose continued fraction is a fold of fixed length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.operators.rownum import global_row_number


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, r, t)`` with ``t = r sqrt((n-2)/(1-r^2))``."""
    a = df.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("r") * F.col("r")))
    return a.select("n", "r", F.when(F.col("n") > 2, t).alias("t"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` plus ``out`` = 1-based rank of ``col`` with ties averaged."""
    numbered = global_row_number(df, [col], "_rn")
    spans = numbered.groupBy(col).agg(F.min("_rn").alias("_lo"), F.max("_rn").alias("_hi"))
    return numbered.join(spans, col).withColumn(out, (F.col("_lo") + F.col("_hi")) / 2.0 + 1.0).drop(
        "_rn", "_lo", "_hi"
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, rho, t)``."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    p = pearson(ranked, "_rx", "_ry")
    return p.select("n", F.col("r").alias("rho"), "t")


# ----------------------------------------------------------------- p-values
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, dof: float) -> float | None:
    """Two-sided p-value of Student's t."""
    if t is None or dof <= 0 or (isinstance(t, float) and math.isnan(t)):
        return None
    if math.isinf(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


STEPS = 500  # steps of the continued fraction; it settles after about the square root of n


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series ten units further on."""
    y = x + 10.0
    shift = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))
    series = 1.0 / (12 * y) - 1.0 / (360 * y**3) + 1.0 / (1260 * y**5) - 1.0 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _log_beta_term(a: Column, b: Column, x: Column) -> Column:
    """ln of the leading factor of the continued fraction, and of the fraction itself, for small x."""
    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        def turned(acc: Column, term: Column) -> Column:  # one step of Lentz's method
            return _let(1.0 + term * acc["d"], lambda d: _let(1.0 + term / acc["c"], lambda c: F.struct(
                c.alias("c"), (1.0 / d).alias("d"), (acc["h"] * c / d).alias("h"))))
        return _let(turned(acc, even), lambda half: turned(half, odd))

    first = 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    h = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["h"])
    return log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x) + F.log(h) - F.log(a)


def t_pvalue(t: Column, n: Column) -> Column:
    """Two-sided p-value of Student's t with n - 2 degrees of freedom, as an expression (null for n < 3 or no t)."""
    dof = n.cast("double") - 2.0
    x = dof / (dof + t * t)
    a, b = dof / 2.0, F.lit(0.5)
    low = x < (a + 1.0) / (a + b + 2.0)  # else the other tail's fraction settles sooner
    small = _let(F.struct(F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b"),
                          F.when(low, x).otherwise(t * t / (dof + t * t)).alias("x")),
                 lambda s: F.exp(_log_beta_term(s["a"], s["b"], s["x"])))
    p = _let(small, lambda v: F.when(low, v).otherwise(1.0 - v))
    infinite = F.abs(t) == float("inf")
    return F.when((dof > 0) & t.isNotNull() & ~F.isnan(t),
                  F.when(infinite, F.lit(0.0)).when(t == 0, F.lit(1.0)).otherwise(p))


def with_pvalue(corr_row: DataFrame) -> DataFrame:
    return corr_row.withColumn("p", t_pvalue(F.col("t"), F.col("n")))
