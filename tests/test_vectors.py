"""Vector operators and statistics (FIXTURES.md §3 plus brute-force checks)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlm.operators import stats, vectors as vx


def test_layer_mix_example(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "l0 array<double>, l1 array<double>")
    row = df.select(vx.mix_layers([F.col("l0"), F.col("l1")], [0.0, 0.0], 1.0).alias("m"),
                    vx.mix_layers([F.col("l0"), F.col("l1")], top_only=True).alias("t")).first()
    assert row.m == pytest.approx([2.0, 3.0]) and row.t == pytest.approx([3.0, 4.0])


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "v double")
    got = sorted((r.v, r.rk) for r in stats.average_ranks(df, "v", "rk").collect())
    assert got == [(10.0, 1.0), (20.0, 2.5), (20.0, 2.5), (30.0, 4.0)]


@pytest.mark.parametrize("t,dof,p", [(2.228138852, 10, 0.05), (1.959963985, 1e7, 0.05), (0.0, 5, 1.0),
                                     (3.169272667, 10, 0.01)])
def test_t_pvalues(t, dof, p):
    assert stats.t_two_sided_p(t, dof) == pytest.approx(p, rel=1e-6)


def test_t_pvalues_as_an_expression(spark):
    rows = [(t, n) for n in (3, 4, 12, 50, 967, 20_000) for t in (0.0, 1e-6, 0.5, -2.2, 10.5, 40.0, float("inf"))]
    rows += [(None, 10), (1.0, 2), (float("nan"), 10)]
    df = spark.createDataFrame(rows, "t double, n long").select("t", "n", stats.t_pvalue(F.col("t"), F.col("n")).alias("p"))
    for r in df.collect():
        want = stats.t_two_sided_p(r.t, r.n - 2)
        assert r.p is None if want is None else r.p == pytest.approx(want, rel=1e-6)
    plan = stats.with_pvalue(df.drop("p"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_sentence_layers_by_hand(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 2.0])], "word string, vec array<double>")
    sents = spark.createDataFrame([(1, 0, ["a", "zz", "b", "a"]), (1, 1, []), (2, 0, ["zz"])], "doc_id long, line int, tokens array<string>")
    out = vx.sentence_layers(sents, vecs)
    got = {r.pos: (r.word, r.layer0, r.layer1, r.layer2) for r in out.collect()}
    assert got == {0: ("a", [1, 0], [1, 0], [5 / 3, 2 / 3]), 2: ("b", [3, 2], [2, 1], [2, 1]), 3: ("a", [1, 0], [5 / 3, 2 / 3], [1, 0])}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_spearman_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, 200).astype(float)
    y = x + rng.normal(0, 3, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    rho = stats.spearman(df, "x", "y").first().rho

    def ranks(v):
        order = np.argsort(v, kind="stable")
        rk = np.empty(len(v))
        rk[order] = np.arange(1, len(v) + 1)
        for val in np.unique(v):
            m = v == val
            rk[m] = rk[m].mean()
        return rk

    assert rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], rel=1e-9)


def test_most_similar_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(f"w{i}", [float(x) for x in v]) for i, v in enumerate(vecs)],
                               "word string, vec array<double>").repartition(5)
    monkeypatch.setattr(vx, "SCORE_CELLS", 300)  # force several chunks per batch
    got = {(r.query, r.rank): r.neighbor for r in vx.most_similar(df.limit(30), df, 4).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = u @ u.T
    for qi in range(120):
        if (f"w{qi}", 1) not in got:
            continue
        s = sims[qi].copy()
        s[qi] = -np.inf
        best = [f"w{j}" for j in np.argsort(-s)[:4]]
        assert [got[(f"w{qi}", k)] for k in range(1, 5)] == best
    assert len(got) == 30 * 4


def test_cosine_bounds(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-2.0, 0.0]), ([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    vals = [r.c for r in df.select(vx.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert vals[0] == pytest.approx(-1.0) and vals[1] == pytest.approx(1.0)
    assert all(-1 - 1e-12 <= v <= 1 + 1e-12 for v in vals)
    assert math.isfinite(vals[0])


def test_token_vectors_subword_fallback(spark):
    vectors = spark.createDataFrame([("cat", [1.0, 1.0])], "word string, vec array<double>")
    grams = spark.createDataFrame([("<do", [2.0, 0.0]), ("og>", [0.0, 4.0])], "ngram string, vec array<double>")
    words = spark.createDataFrame([("cat",), ("dog",), ("zzz",)], "word string")
    got = {r.word: list(r.vec) for r in vx.token_vectors(words, vectors, grams).collect()}
    assert got == {"cat": [1.0, 1.0], "dog": [1.0, 2.0]}  # zzz has no known n-gram


def test_top_rows_are_found_among_numbers(monkeypatch):
    """in small pieces, with ties, doubled words and vectors without length, the rows of a full sort; a row is compared as numbers alone."""
    import numpy as np
    import pandas as pd

    from textlm.operators import vectors as vx

    r = np.random.default_rng(5)
    v = r.integers(-2, 3, (90, 3)).astype(float)
    words = [f"w{i % 80:02d}" for i in r.permutation(90)]
    df = pd.DataFrame({"word": words, "vec": list(v), "_rank": np.argsort(np.argsort(words, kind="stable"), kind="stable")})
    queries = sorted(set(words))[:30]
    q = np.array([v[words.index(w)] for w in queries])
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    s = unit(q) @ unit(v).T
    want = {w: [(words[j], round(s[i, j], 9)) for j in sorted(range(90), key=lambda j: (-round(s[i, j], 9), words[j])) if words[j] != w][:5]
            for i, w in enumerate(queries)}
    for cells, size in ((60, 7), (4_000_000, 90), (30 * 7, 40)):
        monkeypatch.setattr(vx, "SCORE_CELLS", cells)
        monkeypatch.setattr(vx, "_cut", None)  # no table of words is cut
        batches = (df.iloc[lo:lo + size] for lo in range(0, 90, size))
        out = pd.concat(vx._partition_topn(queries, unit(q), 5)(batches))
        got = {w: [(x.neighbor, round(x.similarity, 9)) for x in out[out["query"] == w].itertuples()] for w in queries}
        assert {w: [x[1] for x in rows] for w, rows in got.items()} == {w: [x[1] for x in rows] for w, rows in want.items()}
        assert all(len(rows) == 5 for rows in got.values()) and not any(w == x for w, rows in got.items() for x, _ in rows)
    assert list(vx._partition_topn(queries, unit(q), 5)(iter([]))) == []
