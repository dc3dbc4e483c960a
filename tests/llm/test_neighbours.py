"""Recall of the neighbour search's shard index against brute force, away from the tables' shape."""

from __future__ import annotations

import numpy as np
import pytest

from textlm.llm import ann


@pytest.mark.parametrize("dim", [16, 64, 768])
@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_recall_holds_whatever_the_dimension(dim, lengths):
    rnd = np.random.Generator(np.random.PCG64(dim))
    vectors = rnd.standard_normal((4096, dim))
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    if lengths == "unequal":
        vectors *= rnd.lognormal(0.0, 0.8, 4096)[:, None]
    queries, k = vectors[::34], 20
    index = ann.ShardIndex(vectors, float(np.sqrt((vectors * vectors).sum(1)).max()))
    lo, hi = index.windows(queries)
    wanted = ann.enough_candidates(index, queries, lo, hi, k, ann.SHARE)
    best = np.argsort(-(queries @ vectors.T), axis=1, kind="stable")[:, :k]
    verified = [index.candidates(lo[:, :, i], hi[:, :, i], wanted) for i in range(len(queries))]
    recall = np.mean([np.isin(b, v).mean() for b, v in zip(best, verified, strict=True)])
    print(f"{dim} dimensions, {lengths} lengths: recall {recall:.3f}, verified {np.mean([len(v) for v in verified]) / 4096:.2f}")
    assert recall >= 0.9


def test_few_vectors_are_all_candidates():
    vectors = np.eye(4)
    index = ann.ShardIndex(vectors, 1.0)
    lo, hi = index.windows(vectors)
    assert ann.enough_candidates(index, vectors, lo, hi, 20, ann.SHARE) >= 4
