"""Brute-force checks on small fixtures: generation, windows, PPMI, splits, neural fallback."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textlm.operators import embeddings as em
from textlm.operators import generate as gen
from textlm.operators import ngram
from textlm.operators import sequences as sq
from textlm.sources.tables import lines_of, sentences

TRAIN = "a b c\na b d\na b c\nb c a\nx y z"


def _u(seed, key):
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / float(1 << 48)


@pytest.fixture(scope="module")
def model(spark):
    return ngram.fit_trigram(sentences(lines_of(spark.createDataFrame([(0, TRAIN)], "doc_id long, text string"))))


def test_generation_matches_brute_force(spark, model):
    tri = Counter()
    uni = Counter()
    for line in TRAIN.split("\n"):
        t = line.split() + ["endofline"]
        uni.update(t)
        for i in range(2, len(t)):
            tri[(t[i - 2], t[i - 1], t[i])] += 1
    seeds = spark.createDataFrame([(i, w1, w2) for i, (w1, w2) in enumerate(
        [("a", "b"), ("b", "c"), ("q", "r"), ("a", "b"), ("x", "y"), ("zz", "a")])], "k long, w1 string, w2 string")
    got = {r.k: r.next_word for r in gen.generate_sample(seeds, model, ("k",), seed=7).collect()}
    best = {r.k: r.next_word for r in gen.generate_argmax(seeds, model, ("k",), seed=7).collect()}
    vocab = sorted(uni)
    for r in seeds.collect():
        cont = sorted((w3, c) for (a, b, w3), c in tri.items() if (a, b) == (r.w1, r.w2))
        u = _u(7, r.k)
        if cont:
            t = math.floor(u * sum(c for _, c in cont))
            acc = 0
            for w3, c in cont:
                if acc <= t < acc + c:
                    assert got[r.k] == w3
                acc += c
            top = sorted(cont, key=lambda wc: (-wc[1], wc[0]))[0][0]
            assert best[r.k] == top
        else:
            t = math.floor(u * sum(uni.values()))
            acc = 0
            for w in vocab:
                if acc <= t < acc + uni[w]:
                    assert got[r.k] == w
                acc += uni[w]
            ranked = sorted(uni, key=lambda w: (-uni[w], w))
            assert best[r.k] == ranked[math.floor(u * len(uni))]


def test_context_pairs_and_ppmi(spark):
    s = spark.createDataFrame([(["a", "b", "a", "c"],), (["b", "c"],)], "tokens array<string>")
    got = {(r.word, r.context): r.n for r in em.context_pairs(s, 1).collect()}
    want = Counter()
    for t in (["a", "b", "a", "c"], ["b", "c"]):
        for i in range(len(t)):
            for j in range(max(0, i - 1), min(len(t), i + 2)):
                if j != i:
                    want[(t[i], t[j])] += 1
    assert got == dict(want)
    pm = {(r.word, r.context): r.ppmi for r in em.ppmi(em.context_pairs(s, 1)).collect()}
    n = sum(want.values())
    nw, nc = Counter(), Counter()
    for (w, c), k in want.items():
        nw[w] += k
        nc[c] += k
    for (w, c), k in want.items():
        v = max(0.0, math.log(k * n / (nw[w] * nc[c])))
        assert pm.get((w, c), 0.0) == pytest.approx(v)


def test_char_ngrams(spark):
    df = spark.createDataFrame([("ab",)], "word string")
    got = sorted(r.ngram for r in em.char_ngrams(df).collect())
    assert got == sorted(["<ab", "ab>", "<ab>"])


def test_tail_split_and_minibatches(spark):
    seq = spark.range(0, 103).select(F.col("id").alias("pos"))
    t = sq.tail_split(seq, ["pos"], 0.1)
    parts = {r.split: r.c for r in t.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert parts == {"train": 92, "val": 10}  # int(103 * 0.9) and int(103 * 0.1); one row in neither
    assert sq.tail_split(seq, ["pos"], 0.0).where(F.col("split") == "val").count() == 0
    b = sq.minibatches(t.where(F.col("split") == "train"), 10)
    assert b.count() == 90 and b.select("batch").distinct().count() == 9


def test_neural_fallback_rule(spark):
    from pyspark.ml.functions import array_to_vector

    from textlm.operators import neural as nn

    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    windex = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, id long")
    rows = spark.createDataFrame([([1.0, 0.0, 0.0, 1.0], 0.0), ([0.0, 1.0, 1.0, 0.0], 1.0)] * 10,
                                 "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    model = nn.fit_neural(rows, 4, 3, 2, iters=10)
    test = spark.createDataFrame([(0, 0, ["a", "b", "a", "c", "z"])], "doc_id long, line long, tokens array<string>")
    size = spark.createDataFrame([(50,)], "corpus_size long")
    out = {r.pos: r for r in nn.score_neural(test, model, windex, vectors, size, 2, ("doc_id", "line")).collect()}
    assert out[2].oov == 0 and 0 < out[2].p < 1        # context (a, b), target a: known
    assert out[3].oov == 1 and out[3].p == pytest.approx(1 / 50)  # target c outside the classes
    assert out[4].oov == 1 and out[4].p == pytest.approx(1 / 50)  # context word c has no vector


def test_every_word_has_a_class_and_probabilities_sum_to_one(spark):
    from pyspark.ml.functions import array_to_vector

    from textlm.operators import neural as nn

    counts = {"the": 40, **{f"w{i:02d}": 12 - i // 3 for i in range(30)}}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    classes = nn.word_classes(vocab, 6)
    rows = classes.collect()
    assert {r.word for r in rows} == set(counts) and {r.cls for r in rows} == set(range(max(r.cls for r in rows) + 1))
    mass = {}
    for r in rows:
        mass[r.cls] = mass.get(r.cls, 0) + r.share
    assert all(abs(m - 1) < 1e-9 for m in mass.values()) and next(r.cls for r in rows if r.word == "the") == 0
    tops = nn.class_tops(classes)
    data = spark.createDataFrame([([float(i % 2), 1.0], float(i % len(tops))) for i in range(60)], "f array<double>, label double") \
        .select(array_to_vector("f").alias("features"), "label")
    model = nn.fit_neural(data, 2, 3, len(tops), iters=5)
    vectors = spark.createDataFrame([(w, [0.1 * (i % 7)]) for i, w in enumerate(counts)], "word string, vec array<double>")
    sents = spark.createDataFrame([(i, 0, ["the", "w03", w]) for i, w in enumerate(counts)], "doc_id long, line long, tokens array<string>")
    size = spark.createDataFrame([(1000,)], "corpus_size long")
    out = nn.score_neural(sents, model, classes, vectors, size, len(tops), ("doc_id", "line")).collect()
    assert len(out) == len(counts) and abs(sum(r.p for r in out) - 1) < 1e-9 and not any(r.oov for r in out)
    (best,) = nn.next_words(sents.limit(1).selectExpr("tokens[0] as w1", "tokens[1] as w2"), model, vectors, tops).collect()
    top = max(out, key=lambda r: r.p)
    assert best.p == pytest.approx(top.p) and counts[best.next_word] > 0


def test_one_table_of_counts_for_both_directions(spark):
    """Mirrored counts are those of the reversed sentences, markers and empty lines included."""
    from textlm.operators import bidirectional as bi
    from textlm.operators import ngram

    lines = spark.createDataFrame([(1, 0, "a b a b c"), (1, 1, ""), (1, 2, "<S> a <S> <S> b"), (2, 0, "c")], "doc_id long, line int, value string")
    fwd, bwd = bi.streams(lines, ("doc_id", "line"))
    models = bi.fit(lines, ("doc_id", "line"))
    for stream, model in ((fwd, models[0]), (bwd, models[1])):
        want = ngram.fit_trigram(stream)
        for a, b in ((want.tri, model.tri), (want.uni, model.uni), (want.meta, model.meta)):
            assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_pairs_travel_by_place(spark):
    """brute-force counts with and without hot words; no row a pair before the shuffle."""
    rows = [["the", "cat", "the", "dog"], ["a", "a", "b", ""], ["x"], [], ["b", "the", "the", "the", "c", "a"]]
    df = spark.createDataFrame([(x,) for x in rows], "tokens array<string>")
    want = {}
    for x in rows:
        for i, w in enumerate(x):
            for j in range(max(0, i - 2), min(len(x), i + 3)):
                if i != j:
                    want[w, x[j]] = want.get((w, x[j]), 0) + 1
    for share in (2, 3, 5, 100):
        kept, em.HOT_SHARE = em.HOT_SHARE, share
        try:
            pairs = em.context_pairs(df, 2)
        finally:
            em.HOT_SHARE = kept
        assert {(r.word, r.context): r.n for r in pairs.collect()} == want
    held = em.unordered_pairs(df, 2).collect()
    assert len({frozenset((r.word, r.context)) for r in held}) == len(held)
    with pytest.raises(Exception, match="separator"):
        em.context_pairs(spark.createDataFrame([(["a", "b\x1fc"],)], "tokens array<string>"), 2).collect()


@pytest.mark.parametrize("few", [True, False])
def test_ppmi_cells_equal_those_of_all_pairs(spark, few, monkeypatch):
    """the cells by places and broadcast totals, and by joins, are those of PPMI over the kept pairs; no pair is joined by a shuffle."""
    rows = ["a b a c", "b a a d a", "c c b e", "a e b d c a", "f a b"] * 3 + ["g a g b"]
    df = spark.createDataFrame([(x.split(),) for x in rows], "tokens array<string>")
    monkeypatch.setattr(em, "BROADCAST_MAX_ROWS", 100 if few else 0)
    kept = [w for w, n in Counter(w for x in rows for w in x.split()).items() if n >= 3]
    pairs = em.context_pairs(df, 2).where(F.col("word").isin(kept) & F.col("context").isin(kept))
    want = {(r.word, r.context): r.ppmi for r in em.ppmi(pairs).collect()}
    for share in (2, 5, 100):
        monkeypatch.setattr(em, "HOT_SHARE", share)
        cells = em.ppmi_cells(df, 2, 3)
        got = {(r.word, r.context): r.value for r in cells.collect()}
        assert got == want and len(want) > 10
    assert not few or "SortMergeJoin" not in cells._jdf.queryExecution().executedPlan().toString()


def test_forward_perplexity_reads_one_direction(spark):
    """the forward perplexities without the backward stream, equal to those beside it, with half the shuffles."""
    from textlm.operators import bidirectional as bi

    train = spark.createDataFrame([(0, i, x) for i, x in enumerate(["a b c", "a b d", "", "c a b"])], "doc_id long, line int, value string")
    test = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "zz a"), (2, 0, "")], train.schema)
    models = bi.fit(train, ("doc_id", "line"))
    both, one = bi.text_perplexity(test, models), bi.forward_perplexity(test, models[0])
    assert sorted(one.collect()) == sorted(both.select("doc_id", "n_steps", "unidirectional").collect())
    shuffles = [x._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") for x in (one, both)]
    assert shuffles[1] == 2 * shuffles[0] > 0


def test_neural_rows_are_stored_without_features(spark):
    """What is ordered and checkpointed holds words and class alone; neither vectors nor probabilities are shuffled."""
    from textlm.operators import neural as nn

    sents = spark.createDataFrame([(d, 0, x.split()) for d, x in enumerate(["a b c a", "b c zz a", "c a b b", "a"])],
                                  "doc_id long, line long, tokens array<string>")
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate("abc")], "word string, vec array<double>")
    windex = spark.createDataFrame([("a", 0, 0.5), ("b", 0, 0.5), ("c", 1, 1.0), ("zz", 2, 1.0)], "word string, cls int, share double")
    words = nn.training_words(sents, windex, vectors, 3)
    assert "features" not in words.columns
    got = {(r.doc_id, r.pos, r.w1, r.w2, r.w3, r.label, r.share): list(r.features) for r in nn.with_features(sq.tail_split(words, ["doc_id", "pos"], 0.2), vectors).collect()}
    at = {w: [float(i), 1.0] for i, w in enumerate("abc")}
    of = {"a": (0.0, 0.5), "b": (0.0, 0.5), "c": (1.0, 1.0), "zz": (2.0, 1.0)}
    want = {}
    for r in sents.collect():
        for i in range(2, len(r.tokens)):
            x, y, z = r.tokens[i - 2:i + 1]
            if x in at and y in at:
                want[r.doc_id, i, x, y, z, *of[z]] = at[x] + at[y]
    assert got == want and len(want) == 5  # "c zz a" has no vectors
    model = nn.fit_neural(nn.training_rows(sents, windex, vectors, 3), 4, 3, 3, iters=2)
    size = spark.createDataFrame([(50,)], "corpus_size long")
    scored = nn.score_neural(sents, model, windex, vectors, size, 3, ("doc_id", "line"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    moved = [x for x in plan.splitlines() if "Join" in x and "Inner" in x and "probs" in x]
    assert not moved and scored.count() == 6


def test_argmax_and_scores_by_keyed_counts(spark):
    """the same by the keyed counts as by the tables of words, without the probabilities' joins."""
    from dataclasses import replace

    from textlm.operators import ngram
    from textlm.operators.generate import generate_argmax

    rows = ["a b c", "a b d", "a b d a b c", "b c", "c", ""]
    sents = spark.createDataFrame([(i, 0, x.split()) for i, x in enumerate(rows)], "doc_id long, line long, tokens array<string>")
    fitted = ngram.fit_trigram(sents)
    seeds = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "d", "a"), (3, "x", "y")], "k long, w1 string, w2 string")
    keyed = generate_argmax(seeds, fitted, ("k",))
    tables = generate_argmax(seeds, replace(fitted, keyed=None), ("k",))
    assert sorted(keyed.collect()) == sorted(tables.collect()) and keyed.count() == 4
    assert {r.k: r.next_word for r in keyed.collect()}[0] == "c"  # of c and d, twice each, the smaller
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (keyed, tables)]
    assert "xxhash64" in plans[0] and "w3" not in plans[0] and "w3" in plans[1]
    grams = ngram.kgrams(sents, keep=("doc_id",))
    a, b = (ngram.score_grams(grams, m, ("doc_id",)) for m in (fitted, replace(fitted, keyed=None)))
    assert sorted(a.collect()) == sorted(b.collect()) and a.where("oov = 1 or in_vocab = 1").count() == 0
