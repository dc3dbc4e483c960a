"""Word-list operators (FIXTURES.md §3 Latin filter; last analysed token wins)."""

from pyspark.sql import functions as F

from textlm.operators import lexicon as lx


def test_latin_filter_example(spark):
    df = spark.createDataFrame([("дом",), ("house",), ("123",), ("тv",)], "tgt_lemma string")
    kept = {r.tgt_lemma for r in lx.non_latin(df).collect()}
    assert kept == {"дом", "тv"}


def test_tag_lookup_last_token_wins(spark):
    lex = spark.createDataFrame([("New", "new", "ADJ"), ("York", "york", "PROPN")], "word string, lemma string, pos string")
    words = spark.createDataFrame([("New York",), ("New",), ("zzz",)], "word string")
    got = {r.word: (r.lemma, r.pos) for r in lx.tag_lookup(words, lex).collect()}
    assert got == {"New York": ("york", "PROPN"), "New": ("new", "ADJ"), "zzz": (None, None)}


def test_ud_pos_and_lempos(spark):
    df = spark.createDataFrame([("dog", "N"), ("run", "V"), ("red", "A"), ("x", "X")], "w string, s string")
    got = [r.l for r in df.select(lx.lempos(F.col("w"), lx.ud_pos(F.col("s"))).alias("l")).collect()]
    assert got == ["dog_NOUN", "run_VERB", "red_ADJ", "x_X"]


def test_conll_filter(spark):
    rows = spark.createDataFrame([("# sent",), ("",), ("1\ta\ta\tDET\t_\t_\t_\t_\t_\t_",), ("2\tb\tb\tX",)], "value string")
    out = lx.parse_conll(rows).collect()
    assert [(r.form, r.upos) for r in out] == [("a", "DET")]


def test_pair_by_position_needs_equal_lengths(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "idx long, s string")
    b = spark.createDataFrame([(0, "u")], "idx long, t string")
    assert lx.pair_by_position(a, b).count() == 0
    assert lx.pair_by_position(a, a.withColumnRenamed("s", "t")).count() == 2
