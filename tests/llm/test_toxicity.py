import random
import zlib

import numpy as np
import pytest

from textlm.llm import toxicity


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 8)


def test_held_out_accuracy_and_cases(spark, make_docs, words):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 4 == 0)
        t = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                t.insert(rnd.randrange(len(t)), rnd.choice(["idiot", "blarg" + rnd.choice(words), "Moron!!"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, toxic))
    rows += [(5000, None), (5001, ""), (None, "you idiot"), (8, rows[8][1]), (5002, "x" * 300_000)]
    labels += [(8, 1, 0), (9, None, None), (None, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_report(make_docs(rows), marks).collect()
    assert len(got) == len(rows) and all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert not by_id[None].held_out
    held = [(by_id[i].score, int(i % 4 == 0)) for i in range(900) if by_id[i].held_out]
    s, y = np.array(held).T
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
    assert auc > 0.95 and ((s >= 0.5) == (y == 1)).mean() > 0.9


def test_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity_report(make_docs([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity_report(make_docs([]), none).count() == 0
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(make_docs([(i, f"t{i}") for i in range(5)]), one).collect()} == {1.0}
