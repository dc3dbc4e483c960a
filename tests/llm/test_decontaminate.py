import random

import numpy as np

from textlm.llm import decontaminate as dc
from textlm.llm.common import alnum_words


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w = alnum_words(text)
        hit, found = set(), set()
        for item, t in items:
            iw = alnum_words(t)
            if item is None or not iw:
                continue
            n = min(window, len(iw))
            wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def fixture(words):
    rnd = random.Random(4)
    v = words[:12]  # few words: many repeats and ties
    items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.choice([3, 9, 10, 14, 30])))) for i in range(25)]
    items += [(25, items[0][1]), (26, ""), (27, None), (None, "ba ba ba"), (3, items[3][1])]
    docs = [(i, " ".join(rnd.choice(v) for _ in range(rnd.choice([0, 5, 40, 300])))) for i in range(40)]
    docs += [(100 + i, f"{words[50]}, {items[i][1].upper()}! {words[51]}") for i in range(25)]
    docs += [(7, docs[7][1]), (200, None), (201, ""), (None, items[2][1]), (202, (items[4][1] + " ") * 2000)]
    return docs, items


def test_against_brute_force(spark, make_docs, words):
    docs, items = fixture(words)
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS items", "'y' AS n_hit")
    want = brute(docs, items)
    for block in (dc.BLOCK_WORDS, 60):  # one block, and several merged by document
        got = dc.scan_benchmark(make_docs(docs), bench, block_words=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=repr) == want
        assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_hit for r in got)


def test_removal_leaves_no_window_and_clean_texts_alone(spark, make_docs, words):
    docs, items = fixture(words)
    long = [x for x in items if x[0] is not None and x[1] and len(x[1].split()) >= 10]
    bench = spark.createDataFrame(long, "item_id bigint, text string")
    clean = (500, "Quite, another text; left as it is.")
    df = make_docs([*docs, clean])
    out = dc.remove_benchmark(df, bench)
    assert out.columns == df.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[500] == clean[1] and left[201] == "" and left[200] is None
    first = next(i for i in range(25) if (i, items[i][1]) in long)
    assert left[100 + first] == f"{words[50]}, ! {words[51]}"
    assert None not in left or items[2] not in long  # a document that is all benchmark goes


def test_removal_by_blocks_is_that_of_the_whole_benchmark(spark, make_docs, words):
    docs, items = fixture(words)
    v = words[100:140]
    items += [(50, " ".join(v[:10])), (51, " ".join(v[5:15])), (52, " ".join(v[20:30]))]
    docs += [(600, " ".join(["own", *v[:15], "text"])),  # windows of two items overlap
             (601, " ".join([*v[20:25], *v[:10], *v[25:30]]))]  # what a cut joins was never there
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    good = [(i, t) for i, t in items if i is not None and t]
    want = []
    for d, t in docs:
        w = alnum_words(t)
        hit = set()
        for _, x in good:
            iw = alnum_words(x)
            n = min(10, len(iw))
            wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)}
            hit |= {p for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in wins for p in range(i, i + n)}
        if not w or len(hit) < len(w):
            want.append((d, [x for i, x in enumerate(w) if i not in hit]))
    for block in (dc.BLOCK_WORDS, 60, 1):
        df = make_docs(docs)
        out = dc.remove_benchmark(df, bench, block_words=block)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, alnum_words(r.text)) for r in out.collect()), key=repr) == sorted(want, key=repr), block


def test_no_benchmark_and_no_documents(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = dc.contamination_report(make_docs([(1, "a b c")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
    assert dc.contamination_report(make_docs([]), none).count() == 0


def test_index_against_scans():
    rnd = np.random.default_rng(1)
    text = np.concatenate((rnd.integers(1, 6, 400), np.tile([2, 3, 4], 50), [0]))
    index = dc.FMIndex(text, 6)
    for n in (1, 2, 5, 9):
        patterns = np.stack([text[i:i + n] for i in rnd.integers(0, len(text) - 10, 40)])
        lo, hi = index.search(patterns, np.full(len(patterns), n))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            where = [i for i in range(len(text) - n + 1) if (text[i:i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == where
