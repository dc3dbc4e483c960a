"""Cases that once gave wrong results."""

import glob
import math
import tempfile

import pytest
from pyspark.sql import functions as F

from textlm.operators import neural as nn
from textlm.operators.perplexity import sentence_perplexity
from textlm.operators.rownum import global_cumsum, global_row_number
from textlm.sources import files, sinks


def test_prefix_sums_hold_after_partitions_are_merged(spark):
    df = spark.range(1000).select("id", F.lit(1).alias("v"))
    out = global_cumsum(df, ["id"], "v", "before", partitions=8).coalesce(1).collect()
    assert all(r.before == r.id for r in out) and len(out) == 1000
    rows = global_row_number(df, [F.desc("id")], "rn", partitions=8).coalesce(1).collect()
    assert all(r.rn == 999 - r.id for r in rows)


def test_row_numbers_over_many_partitions(spark):
    rows = global_row_number(spark.range(5000), ["id"], "rn", partitions=2100).collect()
    assert len(rows) == 5000 and all(r.rn == r.id for r in rows)


def test_probability_zero_is_not_left_out(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0, 0), (1, 0, 0.5, 0, 0), (2, 0, 0.5, 0, 0)],
                               "doc_id long, line int, p double, oov int, in_vocab int")
    got = {r.doc_id: r for r in sentence_perplexity(df).collect()}
    assert math.isinf(got[1].ppl0) and math.isinf(got[1].ppl1) and math.isnan(got[1].ppl2)
    assert got[2].ppl0 == 2.0


def test_one_header_per_vector_file(spark):
    d = tempfile.mkdtemp(prefix="textlm-test-", dir="/tmp")
    n = 25_000
    df = spark.range(n).select(F.concat(F.lit("w"), "id").alias("word"),
                               F.array(F.col("id").cast("float")).alias("vec")).coalesce(1)
    sinks.write_vectors(df, f"{d}/vec")
    lines = [x for f in glob.glob(f"{d}/vec/part-*") for x in open(f, encoding="utf-8").read().splitlines()]
    assert sum(x == f"{n} 1" for x in lines) == 1 and lines[0] == f"{n} 1" and len(lines) == n + 1
    back = files.read_vectors(spark, f"{d}/vec").orderBy("ln").collect()
    assert [r.word for r in back[:3]] == ["w0", "w1", "w2"] and len(back) == n


def test_numeric_words_of_one_dimension_are_kept(spark):
    d = tempfile.mkdtemp(prefix="textlm-test-", dir="/tmp")
    sinks.write_vectors(spark.createDataFrame([("7", [3.0]), ("a", [1.0])], "word string, vec array<float>").coalesce(1),
                        f"{d}/vec")
    assert {r.word for r in files.read_vectors(spark, f"{d}/vec").collect()} == {"7", "a"}


def test_quotes_in_tokens_survive_the_tab_files(spark):
    d = tempfile.mkdtemp(prefix="textlm-test-", dir="/tmp")
    with open(f"{d}/pairs.tsv", "w", encoding="utf-8") as f:
        f.write('# head\n"a\tb\t1.0\nc\t"d"\t2.5\n')
    assert [tuple(r) for r in files.read_pairs(spark, f"{d}/pairs.tsv").collect()] == [('"a', "b", 1.0), ("c", '"d"', 2.5)]
    sinks.write_pairs(spark.createDataFrame([('"_PUNCT', 'x"y')], "src_lempos string, tgt_lempos string").coalesce(1), f"{d}/out")
    (name,) = glob.glob(f"{d}/out/part-*.csv")
    assert open(name, encoding="utf-8").read() == '"_PUNCT\tx"y\n'


def test_folders_per_document_read_back(spark):
    d = tempfile.mkdtemp(prefix="textlm-test-", dir="/tmp")
    sinks.write_per_document(spark.createDataFrame([(1, "good", "x")], "doc_id long, label string, text string"), f"{d}/t")
    (r,) = files.read_labelled_tree(spark, f"{d}/t", "wrapped").collect()
    assert (r.doc_id, r.label) == ("1", "good")


def test_neural_hits_count_as_in_vocabulary(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([([float(i % 2)] * 2, float(i % 2)) for i in range(20)], "f array<double>, label double") \
        .select(array_to_vector("f").alias("features"), "label")
    model = nn.fit_neural(rows, 2, 4, 2, iters=3)
    sents = spark.createDataFrame([(1, 0, ["a", "b", "a", "zz"])], "doc_id long, line int, tokens array<string>")
    windex = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    vectors = spark.createDataFrame([("a", [0.0]), ("b", [1.0])], "word string, vec array<double>")
    size = spark.createDataFrame([(10,)], "corpus_size long")
    out = nn.score_neural(sents, model, windex, vectors, size, 2, keep=("doc_id", "line")).collect()
    assert out and all(r.in_vocab == 1 - r.oov for r in out) and {r.in_vocab for r in out} == {0, 1}


def test_no_local_checkpoint_folder_on_a_cluster():
    from textlm.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_ties_at_the_cut_are_bounded():
    import numpy as np

    from textlm.operators.vectors import _cut

    words = np.array([[f"w{i:03d}" for i in range(50)][::-1]] * 2, dtype=object)
    scores = np.ones((2, 50))
    scores[1, 40] = 2.0
    s, w = _cut(scores, words, 5)
    assert s.shape == (2, 5) and w[0].tolist() == [f"w{i:03d}" for i in range(5)]
    assert w[1].tolist() == ["w009", *[f"w{i:03d}" for i in range(4)]]
