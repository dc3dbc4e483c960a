import random

import corpus_pipeline
import __spark_entry__ as entry
import pytest

from textlm.llm import toxicity


@pytest.fixture(autouse=True)
def few_trees(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 8)


def test_stages_catch_what_is_planted(spark, make_docs, words, tmp_path):
    rnd = random.Random(12)
    said = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    bench = [said(30) for _ in range(5)]
    passage = said(70)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        docs.append((i, said(60) + (" idiot moron scum" if toxic else ""), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    docs.append((1000, docs[1][1] + " x", "s0"))  # near copy
    docs.append((1001, said(50) + " " + bench[0] + " " + said(50), "s1"))
    docs += [(1002, said(40) + " " + passage + " " + said(40), "s1"), (1003, said(40) + " " + passage + " " + said(40), "s2")]
    docs += [(1004, None, "s1"), (1005, "", None)]
    make_docs(docs, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, texts = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        frame.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        frame = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        texts[name] = {r.doc_id: r.text for r in frame.collect()}
    kept = texts["toxicity"]
    assert not any(i in kept for i in range(0, 400, 5)) and sum(i in kept for i in range(400) if i % 5) >= 318
    assert 1000 not in texts["n-gram jaccard join"] and 1 in texts["n-gram jaccard join"]
    sub = texts["substring dedup"]
    assert passage in sub[1002] and passage not in sub[1003] and 1004 in sub and 1005 in sub
    last = texts["benchmark decontamination"]
    assert bench[0] not in last[1001] and len(last[1001].split()) == 100
    out = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(last) and all(r.taken <= 3 * r["size"] for r in out)


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
