"""Randomised SVD against numpy; vectors without a limit on contexts."""

import numpy as np
import pytest

from textlm.operators.embeddings import fit_subword, ppmi_cells
from textlm.operators.svd import svd


def _table(spark, m):
    rows, cols = np.nonzero(m)
    return spark.createDataFrame([(f"r{i:04d}", f"c{j:04d}", float(m[i, j])) for i, j in zip(rows, cols, strict=True)],
                                 "word string, context string, value double").repartition(5)


@pytest.mark.parametrize("shape", [(300, 90), (60, 400)])
def test_leading_values_and_vectors(spark, shape):
    r = np.random.default_rng(1)
    m = r.random(shape) * (r.random(shape) < 0.15)
    found = svd(_table(spark, m), "word", 8, rounds=6, oversample=20)  # a flat spectrum: the hard case
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(found.values, s[:8], rtol=0.01)
    assert abs(found.energy - (m * m).sum()) < 1e-6
    rows = {x.word: np.array(x.vec) for x in found.rows.collect()}
    held = np.array([rows.get(f"r{i:04d}", np.zeros(8)) for i in range(shape[0])])
    assert np.allclose(held.T @ held, np.diag(s[:8]), atol=0.05 * s[0])  # U sqrt(S)
    leading = held[:, :2] @ held[:, :2].T  # does not hang on signs
    assert np.abs(leading - (u[:, :2] * s[:2]) @ u[:, :2].T).max() < 0.05 * np.abs(leading).max()


def test_small_rank_and_no_cells(spark):
    m = np.outer(np.arange(1, 7), np.arange(1, 5)).astype(float)  # rank 1, fewer columns than asked for
    found = svd(_table(spark, m), "word", 6)
    assert len(found.values) == 1 and abs(found.values[0] - np.linalg.norm(m)) < 1e-8
    none = svd(_table(spark, m).limit(0), "word", 3)
    assert none.values == [] and none.rows.count() == 0 and none.rows.columns == ["word", "vec"]


def test_every_context_counts(spark):
    """Words that meet rare contexts alone have vectors, too."""
    sents = [[f"w{i}", f"x{i}"] * 3 for i in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "doc_id long, tokens array<string>")
    cells = ppmi_cells(df, window=2, min_count=1)
    found = svd(cells, "word", 4)
    assert found.rows.count() == 800
    grams, words = fit_subword(df.limit(20), dim=3, window=2, min_count=1)
    assert words.count() == 40 and grams.count() > 40


def test_products_shuffle_no_cell(spark, monkeypatch):
    """cells are packed and stored once, whatever the grid; a product shuffles thin matrices alone; known keys without cells are no rows."""
    from textlm.operators import svd as sv

    r = np.random.default_rng(2)
    m = r.random((70, 70)) * (r.random((70, 70)) < 0.2)
    m[[3, 9]] = 0.0
    rows, cols = np.nonzero(m)
    cells = spark.createDataFrame([(f"k{i:02d}", f"k{j:02d}", float(m[i, j])) for i, j in zip(rows, cols, strict=True)], "word string, context string, value double")
    keys = spark.createDataFrame([(f"k{i:02d}",) for i in range(72)], "word string")
    monkeypatch.setattr(sv, "PACKED_CELLS", 40)
    monkeypatch.setattr(sv, "CHUNK", 3)
    monkeypatch.setattr(sv, "AT_ONCE", 7)
    plans, product = [], sv._product
    monkeypatch.setattr(sv, "_product", lambda grid, *a: plans.append((grid, product(grid, *a))) or plans[-1][1])
    found = sv.svd(cells, "word", 5, rounds=8, oversample=20, keys=keys)
    assert np.allclose(found.values, np.linalg.svd(m)[1][:5], rtol=0.01)
    assert {x.word for x in found.rows.collect()} == {f"k{i:02d}" for i in range(70)} - {"k03", "k09"}
    assert plans[0][0].side > 1 and len(plans) == 18
    plan = plans[1][1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    shuffled = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(shuffled) == 2 and not any("(i#" in x for x in shuffled)  # the thin matrix, and the parts of its product
