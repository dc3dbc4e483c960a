"""File sources and sinks: round trips on small scratch files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textlm.operators import ngram
from textlm.sources import files, sinks
from textlm.sources.tables import lines_of, sentences


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="textlm-test-", dir="/tmp")


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_sentences_and_tree(spark, tmp):
    _write(f"{tmp}/corpus/a.txt", "a b c\na b d\n")
    s = files.read_sentences(spark, f"{tmp}/corpus").orderBy("line").collect()
    assert [r.tokens for r in s] == [["a", "b", "c", "endofline"], ["a", "b", "d", "endofline"]]
    _write(f"{tmp}/flat/good/t1.txt", "x y\n")
    _write(f"{tmp}/flat/bad/t2.txt", "z\n")
    flat = {r.doc_id: r.label for r in files.read_labelled_tree(spark, f"{tmp}/flat").collect()}
    assert flat == {"t1.txt": "good", "t2.txt": "bad"}
    _write(f"{tmp}/wrap/good/t1/t1.txt", "x y\n")
    wrapped = {r.doc_id: r.label for r in files.read_labelled_tree(spark, f"{tmp}/wrap", "wrapped").collect()}
    assert wrapped == {"t1.txt": "good"}


def test_pairs_bilingual_vocab(spark, tmp):
    _write(f"{tmp}/pairs.tsv", "# word1\tword2\tscore\nold\tnew\t1.58\nsmart\tintelligent\t9.2\n")
    assert [tuple(r) for r in files.read_pairs(spark, f"{tmp}/pairs.tsv").collect()] == [
        ("old", "new", 1.58), ("smart", "intelligent", 9.2)]
    _write(f"{tmp}/bi.txt", "house  дом\n  cat кот extra\n")
    assert [tuple(r) for r in files.read_bilingual(spark, f"{tmp}/bi.txt").orderBy("idx").collect()] == [
        (0, "house", "дом"), (1, "cat", "кот")]
    _write(f"{tmp}/vocab.txt", "<S>\n</S>\n<UNK>\n!!!MAXTERMID\na\nb\na\n")
    v, sp = files.read_vocab(spark, f"{tmp}/vocab.txt")
    assert {r.word: r.id for r in v.collect()} == {"<S>": 0, "</S>": 1, "<UNK>": 2, "a": 5, "b": 4}


def test_vectors_round_trip(spark, tmp):
    df = spark.createDataFrame([("a", [1.0, 2.5]), ("b", [-0.5, 0.25])], "word string, vec array<double>").repartition(2)
    sinks.write_vectors(df, f"{tmp}/vec")
    back = {r.word: list(r.vec) for r in files.read_vectors(spark, f"{tmp}/vec").collect()}
    assert back == {"a": [1.0, 2.5], "b": [-0.5, 0.25]}


def test_trigram_save_load(spark, tmp):
    s = sentences(lines_of(spark.createDataFrame([(0, "a b c\na b d")], "doc_id long, text string")))
    m = ngram.fit_trigram(s)
    sinks.save_trigram(m, f"{tmp}/model", buckets=2)
    m2 = sinks.load_trigram(spark, f"{tmp}/model")
    assert sorted(map(tuple, m2.tri.select("w1", "w2", "w3", "c").collect())) == sorted(
        map(tuple, m.tri.select("w1", "w2", "w3", "c").collect()))
    assert m2.meta.first().corpus_size == 8


def test_scores_pairs_per_document(spark, tmp):
    sc = spark.createDataFrame([("d1", "good", 1.5)], "files string, label string, perpl double")
    sinks.write_scores(sc, f"{tmp}/scores", header=True)
    back = spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp}/scores").collect()
    assert [tuple(r) for r in back] == [("d1", "good", "1.5")]
    docs = spark.createDataFrame([(1, "good", "x y"), (2, "bad", "z")], "doc_id long, label string, text string")
    sinks.write_per_document(docs, f"{tmp}/perdoc")
    assert os.path.isdir(f"{tmp}/perdoc/label=good/doc_id=1")
    tree = files.read_labelled_tree(spark, f"{tmp}/perdoc", "wrapped").select("label", "text").collect()
    assert sorted((a, b.rstrip("\n")) for a, b in tree) == [("bad", "z"), ("good", "x y")]


def test_shuffled_passes(spark):
    s = spark.createDataFrame([(d, l) for d in range(5) for l in range(3)], "doc_id long, line long")
    p = files.shuffled_passes(s, seed=1, passes=3)
    assert p.count() == 45
    per = p.groupBy("pass", "doc_id").agg(F.countDistinct("order_key").alias("k")).collect()
    assert all(r.k == 1 for r in per)


def test_neural_save_load(spark, tmp):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from textlm.operators import neural as nn

    rows = spark.createDataFrame([([float(i % 3), float(i % 5)], float(i % 2)) for i in range(40)],
                                 "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    model = nn.fit_neural(rows, 2, 4, 2, iters=5)
    windex = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    size = spark.createDataFrame([(10,)], "corpus_size long")
    sinks.save_neural(model, windex, size, f"{tmp}/nn", {"k": 2})
    m2, w2, meta = sinks.load_neural(spark, f"{tmp}/nn")
    assert [r.word for r in w2.collect()] == ["a", "b"] and meta.first().corpus_size == 10
    a = [r.prediction for r in model.transform(rows).collect()]
    b = [r.prediction for r in m2.transform(rows).collect()]
    assert a == b
    assert F is not None


def _part(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def test_order_over_files_of_unequal_size(spark, tmp_path):
    """Later, larger files are read first by Spark; lines are ordered by file all the same."""
    from textlm.sources import files

    v = tmp_path / "v"
    _part(v, "part-0.txt", ["2 1", "first0 0.0", "first1 1.0"])
    _part(v, "part-1.txt", ["500 1", *(f"later{i} {float(i)}" for i in range(500))])
    got = [r.word for r in files.read_vectors(spark, str(v)).orderBy("ln").collect()]
    assert got == ["first0", "first1", *(f"later{i}" for i in range(500))]
    b = tmp_path / "b"
    _part(b, "a.txt", ["one eins", "alone", "", "two zwei more"])
    _part(b, "b.txt", [f"w{i} v{i}" for i in range(400)])
    rows = files.read_bilingual(spark, str(b)).orderBy("idx").collect()
    assert [(r.idx, r.src, r.tgt) for r in rows[:3]] == [(0, "one", "eins"), (1, "two", "zwei"), (2, "w0", "v0")]
    assert len(rows) == 402 and rows[-1].src == "w399"


def test_shard_passes(spark, tmp_path):
    from textlm.sources import files

    for i in range(4):
        _part(tmp_path / "shards", f"news-{i}.txt", [f"s{i} l{k}" for k in range(30 * (4 - i))])
    (tmp_path / "shards" / "other.md").write_text("not read\n")
    got = files.read_shards(spark, str(tmp_path / "shards" / "news-*.txt"), seed=3, passes=3)
    order = [(r["pass"], r.value) for r in got.orderBy("pass", "order_key", "line").collect()]
    assert len(order) == 3 * 300 and not any("not" in v for _, v in order)
    firsts = set()
    for p in range(3):
        mine = [v for q, v in order if q == p]
        files_seen = list(dict.fromkeys(v.split()[0] for v in mine))
        assert len(files_seen) == 4 and mine == [f"{s} l{k}" for s in files_seen for k in range(30 * (4 - int(s[1:])))]
        firsts.add(tuple(files_seen))
    assert len(firsts) > 1
    again = [(r["pass"], r.value) for r in files.read_shards(spark, str(tmp_path / "shards" / "news-*.txt"), 3, 3)
             .orderBy("pass", "order_key", "line").collect()]
    assert again == order
