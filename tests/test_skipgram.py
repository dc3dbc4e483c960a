"""Skip-gram by negative sampling: the alias table exactly, draws, planted synonyms, reruns, odd inputs."""

from collections import Counter
from math import floor, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlm.operators import embeddings as em
from textlm.operators import skipgram as sg


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "word string, n long")


def weight(n):
    return floor(1000 * sqrt(n) * sqrt(sqrt(n)))


@pytest.mark.parametrize("ns", [[7], [5, 5, 5, 5], [1, 1, 1, 1000], [10_000, 1, 2, 3, 500, 500, 1, 9, 80, 81],
                                [i * i % 97 + 1 for i in range(200)]])
def test_alias_table_gives_each_word_its_weight(spark, ns):
    words = {f"w{i:03d}": weight(n) for i, n in enumerate(ns)}
    rows = sg.alias_table(counts_of(spark, [(f"w{i:03d}", n) for i, n in enumerate(ns)])).collect()
    total = sum(words.values())
    held = Counter()
    for r in rows:
        assert r.total == total and 0 < r.threshold <= total and (r.alias is None) == (r.threshold == total)
        held[r.word] += r.threshold
        if r.alias:
            held[r.alias] += total - r.threshold
    assert sorted(r.bucket for r in rows) == list(range(len(ns)))
    assert held == {w: len(ns) * x for w, x in words.items()}  # exact, not just near


def test_alias_table_of_no_words(spark):
    assert sg.alias_table(counts_of(spark, [])).count() == 0
    assert sg.alias_table(counts_of(spark, [("a", 0)])).count() == 0


def test_draws_follow_the_weights_and_repeat(spark):
    ns = [400, 100, 100, 20, 1]
    table = sg.alias_table(counts_of(spark, [(f"w{i}", n) for i, n in enumerate(ns)]))
    keys = spark.range(8000).withColumnRenamed("id", "k")
    got = [Counter({r.drawn: r["count"] for r in sg.draws(keys, table, 5, seed).groupBy("drawn").count().collect()})
           for seed in (1, 1, 2)]
    assert got[0] == got[1] != got[2] and sum(got[0].values()) == 40_000
    whole = sum(map(weight, ns))
    for i, n in enumerate(ns):
        p = weight(n) / whole
        assert abs(got[0][f"w{i}"] - 40_000 * p) < 5 * sqrt(40_000 * p * (1 - p)) + 1


def planted(spark):
    """Two topics; ``cat`` and ``feline``, ``car`` and ``auto`` never meet, yet stand among the same words."""
    rng = np.random.default_rng(3)
    topics = [(["cat", "feline"], ["purr", "milk", "mouse", "tail", "paw", "fur"]),
              (["car", "auto"], ["road", "wheel", "motor", "brake", "petrol", "seat"])]
    rows = []
    for i in range(600):
        names, others = topics[i % 2]
        rows.append((list(rng.choice(others, 3)) + [str(rng.choice(names))] + list(rng.choice(others, 3)),))
    return spark.createDataFrame([([str(w) for w in r[0]],) for r in rows], "tokens array<string>")


@pytest.mark.parametrize("cell_pairs", [sg.CELL_PAIRS, 20])
def test_planted_synonyms_lie_near_and_reruns_agree(spark, monkeypatch, cell_pairs):
    monkeypatch.setattr(sg, "CELL_PAIRS", cell_pairs)  # one cell, and a grid of cells merged by word
    sents = planted(spark)
    fit = lambda: {r.word: np.array(r.vec) for r in em.fit_skipgram(sents, dim=8, window=3, min_count=5, iters=4).collect()}
    a = fit()
    unit = {w: v / np.linalg.norm(v) for w, v in a.items()}
    for one, other, far in (("cat", "feline", "car"), ("car", "auto", "cat"), ("auto", "car", "feline")):
        assert unit[one] @ unit[other] > unit[one] @ unit[far] + 0.3
    if cell_pairs == 20:
        b = fit()
        assert a.keys() == b.keys() and all((a[w] == b[w]).all() for w in a)


def test_odd_inputs(spark):
    empty = spark.createDataFrame([], "tokens array<string>")
    assert em.fit_skipgram(empty, dim=4, min_count=1, iters=1).count() == 0
    lone = spark.createDataFrame([(["only"],), ([],), (None,), ([None, "x", "x"],)], "tokens array<string>")
    got = {r.word: r.vec for r in em.fit_skipgram(lone, dim=4, min_count=1, iters=2).collect()}
    assert got.keys() == {"only", "x"} and all(len(v) == 4 and np.isfinite(v).all() for v in got.values())
    extra = lone.select("tokens", F.lit(1).alias("n"), F.lit("a").alias("word"))
    assert em.fit_skipgram(extra, dim=4, min_count=1, iters=1).count() == 2


def test_unseen_forms_of_a_planted_stem(spark):
    """``falkon``, ``falkons``, ``falkoner`` stand among one topic's words, ``brumitz`` and its forms among another's."""
    rng = np.random.default_rng(5)
    topics = [(["falkon", "falkons", "falkoner"], ["wing", "nest", "claw", "beak"]),
              (["brumitz", "brumitzen", "brumitzer"], ["rust", "bolt", "gear", "oil"])]
    rows = []
    for i in range(400):
        names, others = topics[i % 2]
        rows.append(([str(w) for w in (*rng.choice(others, 2), rng.choice(names), *rng.choice(others, 2))],))
    sents = spark.createDataFrame(rows, "tokens array<string>")
    buckets, words = em.fit_subword(sents, dim=8, window=2, min_count=5, iters=3)
    known = {r.word: np.array(r.vec) for r in words.collect()}
    assert len(known) == 14
    unseen = spark.createDataFrame([("falkonry",), ("brumitzung",), ("q",)], "word string")
    got = {r.word: np.array(r.vec) for r in em.subword_vectors(unseen, buckets).collect()}
    assert got.keys() == {"falkonry", "brumitzung"}  # "<q>" is an n-gram that no known word has

    def near(a, b):
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    assert near(got["falkonry"], known["falkon"]) > near(got["falkonry"], known["brumitz"]) + 0.3
    assert near(got["brumitzung"], known["brumitz"]) > near(got["brumitzung"], known["falkon"]) + 0.3


def test_alias_tables_of_blocks(spark):
    """a table for each block of numbered words, exact by itself, no alias across."""
    ns = [i * i % 97 + 1 for i in range(200)] + [5000, 1, 1]
    rows = sg.alias_table(spark.createDataFrame(list(enumerate(ns)), "word long, n long"), 3).collect()
    held, total, size = Counter(), Counter(), Counter()
    for i, n in enumerate(ns):
        total[i % 3] += weight(n)
        size[i % 3] += 1
    for r in rows:
        assert r.total == total[r.word % 3] and (r.alias is None) == (r.threshold == r.total)
        held[r.word] += r.threshold
        if r.alias is not None:
            assert r.alias % 3 == r.word % 3
            held[r.alias] += r.total - r.threshold
    assert held == {i: size[i % 3] * weight(n) for i, n in enumerate(ns)}


def test_training_shuffles_no_row_a_draw(spark, monkeypatch):
    """cells draw from the alias table themselves; pairs held once train both of their words."""
    monkeypatch.setattr(sg, "draws", lambda *x: pytest.fail("a row a draw"))
    monkeypatch.setattr(sg, "CELL_PAIRS", 2)
    pairs = spark.createDataFrame([("a", "b", 9), ("c", "b", 2), ("c", "c", 4)], "word string, context string, n long")
    counts = counts_of(spark, [("a", 9), ("b", 11), ("c", 6), ("d", 1)])
    first, then = ({r.word: r.vec for r in sg.train_negative_sampling(pairs, counts, 4, n, mirrored=True).collect()} for n in (0, 1))
    assert first.keys() == then.keys() == set("abcd")
    assert first["d"] == then["d"] and all(first[w] != then[w] for w in "abc")


def test_a_step_moves_by_the_mean_gradient_and_meets_a_word_once(monkeypatch):
    """a batch's step against one pair by pair, with parts and without; a word's units are put together once a batch."""
    import numpy as np

    from textlm.operators import skipgram as sg

    rng = np.random.default_rng(3)
    w, c = np.array([0, 1, 0, 2, 0, 1]), np.array([1, 0, 2, 2, 1, 3])
    weight, negatives = rng.random(6).astype(np.float32) + np.float32(0.5), rng.integers(0, 4, (6, 3))
    for lists in ([[], [], []], [[0, 1], [1], [0, 2, 3]]):
        words, parts, outer = (rng.normal(size=(n, 5)).astype(np.float32) for n in (3, 4, 4))
        n_parts = np.array([len(x) for x in lists])
        inner = sg.Units(words.copy(), parts.copy() if n_parts.any() else np.zeros((0, 5), np.float32), n_parts, np.array(sum(lists, []), np.int64))
        units = [[i, *(3 + p for p in x)] for i, x in enumerate(lists)]
        up, of, asked = {}, {}, []
        for i in range(6):
            v = inner.vecs[units[w[i]]].astype(float).mean(axis=0)
            back = np.zeros(5)
            for k, t in enumerate([c[i], *negatives[i]]):
                gap = (k == 0) - 1 / (1 + np.exp(-v @ outer[t]))
                gap = 0.0 if k and t == c[i] else gap
                back += gap * outer[t]
                of.setdefault(t, []).append((weight[i], gap * v))
            for u in units[w[i]]:
                up.setdefault(u, []).append((weight[i], back))
        want = [x.astype(float).copy() for x in (inner.vecs, outer)]
        for vecs, moves in zip(want, (up, of)):
            for at, grads in moves.items():
                vecs[at] += 0.3 * sum(a * g for a, g in grads) / sum(a for a, _ in grads)
        plain = sg.Units.of
        monkeypatch.setattr(sg.Units, "of", lambda self, x: asked.append(len(x)) or plain(self, x))
        sg._step(w, c, weight, negatives, inner, outer, 0.3)
        monkeypatch.setattr(sg.Units, "of", plain)
        assert np.allclose(inner.vecs, want[0], atol=1e-5) and np.allclose(outer, want[1], atol=1e-5) and asked == [3]
