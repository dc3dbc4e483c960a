"""Hand-computed examples (FIXTURES.md §3) for tokens, the trigram model and perplexities."""

import math
import re

import pytest
from pyspark.sql import functions as F

from textlm.functions.text import line_tokens, tokenize
from textlm.operators import ngram
from textlm.operators import perplexity as ppl
from textlm.sources.tables import lines_of, sentences


def _sents(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sentences(lines_of(df))


def test_tokenizer_class(spark):
    s = "a²b x½y т-о «q» a—b a–b i<j k=l m@n 3:4 it's #1 $5"
    got = spark.createDataFrame([(s,)], "t string").select(tokenize(F.col("t")).alias("x")).first().x
    assert got == ["a²b", "x½y", "т-о", "q", "a", "b", "a–b", "i", "j", "k", "l", "m", "n", "3:4", "it's", "#1", "$5"]


def test_eol_and_lines(spark):
    df = spark.createDataFrame([(1, "a b\r\nc\n")], "doc_id long, text string")
    rows = sentences(lines_of(df)).orderBy("line").collect()
    assert [r.tokens for r in rows] == [["a", "b", "endofline"], ["c", "endofline"]]
    one = spark.createDataFrame([("  x  ",)], "v string").select(line_tokens(F.col("v")).alias("t")).first().t
    assert one == ["x", "endofline"]


@pytest.fixture(scope="module")
def model(spark):
    train = _sents(spark, [(0, "a b c\na b d\na b c")])
    return ngram.fit_trigram(train)


def test_trigram_model(model):
    meta = model.meta.first()
    assert meta.corpus_size == 12 and meta.vocab_size == 5 and meta.n_contexts == 3
    uni = {r.word: r.n for r in model.uni.collect()}
    assert uni == {"a": 3, "b": 3, "c": 2, "d": 1, "endofline": 3}
    tri = {(r.w1, r.w2, r.w3): (r.c, r.p) for r in model.tri.collect()}
    assert tri[("a", "b", "c")] == (2, pytest.approx(2 / 3))
    assert tri[("b", "c", "endofline")] == (2, 1.0)
    # every seen context's continuations sum to one
    sums = model.tri.groupBy("w1", "w2").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_scores_and_text_policies(spark, model):
    test = _sents(spark, [(1, "a b c\na b x"), (2, "a b a"), (3, "a b c\na")])
    docs = spark.createDataFrame([(1, "g"), (2, "g"), (3, "b")], "doc_id long, label string")
    scored = ngram.score_tokens(test, model, keep=("doc_id", "line"))
    s = {(r.doc_id, r.line): r for r in ppl.sentence_perplexity(scored).collect()}
    assert s[(1, 0)].ppl0 == pytest.approx(1.25)
    assert s[(1, 0)].ppl1 == pytest.approx(1.224744871)
    assert s[(1, 0)].ppl2 == pytest.approx(1.144714243)
    assert s[(1, 1)].ppl0 == pytest.approx(8.060606061)
    assert s[(1, 1)].ppl1 == pytest.approx(6.963106238)
    assert s[(1, 1)].ppl2 == pytest.approx(1.318116430)
    assert (s[(1, 1)].oov, s[(1, 1)].in_vocab) == (1, 1)
    assert (s[(2, 0)].ppl0, s[(2, 0)].in_vocab) == (pytest.approx(4.0), 2)
    sents = test.select("doc_id", "line", "tokens")
    prop = {r.doc_id: r for r in ppl.text_perplexity(docs, sents, scored, ppl.PROPAGATE).collect()}
    skip = {r.doc_id: r for r in ppl.text_perplexity(docs, sents, scored, ppl.SKIP).collect()}
    assert prop[1].ppl0 == pytest.approx(4.655303030)
    assert prop[1].ppl1 == pytest.approx(4.093925555)
    assert prop[1].ppl2 == pytest.approx(1.231415336)
    assert prop[2].ppl1 == pytest.approx(4.0)
    assert prop[3].is_nan and prop[3].ppl0 is None
    assert not skip[3].is_nan and skip[3].ppl1 == pytest.approx(1.224744871)
    for r in prop.values():
        if not r.is_nan:
            assert r.ppl1 <= r.ppl0 + 1e-9  # Jensen
            assert 1.0 <= r.ppl2 <= 2 ** (math.log2(math.e) / math.e) + 1e-9


def test_k_below_two_rejected(spark):
    with pytest.raises(ValueError):
        ngram.kgrams(_sents(spark, [(0, "a b c")]), k=1)


def test_scoring_shuffles_the_training_grams_once(spark):
    """Counts, context totals, words and corpus size come from one exchange of the training grams."""
    df = spark.createDataFrame([(0, 0, "a b c d a b c e".split()), (1, 0, ["a", "b"]), (2, 0, [])], "doc_id long, line int, tokens array<string>")
    scored = ngram.score_tokens(df, ngram.fit_trigram(df), keep=("doc_id", "line"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scored.select("doc_id", "line", "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(shuffles) == 4, plan  # training grams, test grams, numbers by key, found grams by key


def test_keyed_scores_equal_those_of_the_model_tables(spark):
    rows = [(0, i, x) for i, x in enumerate([["a", "b", "a", "b", "c"], ["a", "b"], ["x"], [], ["b", "a", "b", "a", ""]])]
    df = spark.createDataFrame(rows, "doc_id long, line int, tokens array<string>")
    test = spark.createDataFrame([(9, 0, ["a", "b", "a", "zz", "c", "b"]), (9, 1, ["a", "b", "c"]), (9, 2, ["ab", "", "c"])], df.schema)
    for k, firsts in ((2, 3), (3, 4)):
        m = ngram.fit_trigram(df, k)
        assert {r.c for r in m.keyed.where("ctx = 0 and word = 'b'").collect()} == {firsts}
        plain = ngram.TrigramModel(uni=m.uni, tri=m.tri, meta=m.meta)
        got, want = (sorted(ngram.score_tokens(test, x, keep=("line",), k=k).collect()) for x in (m, plain))
        assert got == want


def test_scoring_shuffles_numbers_and_bare_tokens(spark):
    """No word is joined or shuffled as a string, and a token goes to its text without six sums."""
    df = spark.createDataFrame([(0, 0, "a b c d a b c e".split()), (1, 0, ["a", "b"])], "doc_id long, line int, tokens array<string>")
    model = ngram.fit_trigram(df)
    assert [t for _, t in model.hashed.dtypes] == ["bigint"] * 3
    sent = ppl.sentence_perplexity(ngram.score_tokens(df, model, keep=("doc_id", "line")))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        qe = sent._jdf.queryExecution()
        nodes, todo = [], [qe.executedPlan()]
        while todo:
            node = todo.pop()
            nodes.append(node)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    sent_to = {n.outputPartitioning().toString(): n.schema() for n in nodes if n.nodeName() == "Exchange"}
    assert not any("string" in x.catalogString() for x in sent_to.values()), sent_to
    by_text = [x for p, x in sent_to.items() if p.startswith("hashpartitioning(doc_id")]
    assert len(by_text) == 1 and by_text[0].size() == 5, sent_to  # doc_id, line, p, oov, in_vocab


def test_sentences_of_one_text_and_of_equal_lines(spark):
    """A sentence's tokens meet whatever text and line they are of."""
    train = _sents(spark, [(0, "a b c\na b d\na b c")])
    test = _sents(spark, [(i, "a b c\na b x\na b c") for i in range(40)])
    scored = ngram.score_tokens(test, ngram.fit_trigram(train), keep=("doc_id", "line"))
    rows = ppl.sentence_perplexity(scored).collect()
    assert len(rows) == 120 and {r.n_scored for r in rows} == {2}
    assert {round(r.ppl0, 9) for r in rows if r.line != 1} == {1.25}


def test_class_perplexity_scores_both_corpora_in_one_pass(spark):
    """one lookup of test and training tokens in the counts, not one for each corpus."""
    from data_dirs import SF001
    from textlm.plans.catalog import REGISTRY

    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = REGISTRY["class_perplexity"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    joins = [x for x in plan.splitlines() if "SortMergeJoin [ctx" in x]
    assert len(joins) == 1, plan


def test_scoring_shuffles_test_and_training_grams_by_context_alone(spark):
    """A context's total lies beside its counts; the words alone are asked for after that."""
    df = spark.createDataFrame([(0, 0, "a b c d a b c e".split()), (1, 0, ["a", "b"]), (2, 0, [])], "doc_id long, line int, tokens array<string>")
    scored = ngram.score_tokens(df, ngram.fit_trigram(df), keep=("doc_id", "line"))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scored.select("doc_id", "line", "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    keys = [re.findall(r"(\w+)#", x.split("hashpartitioning(")[1].split(")")[0])
            for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert sorted(keys) == [["_key"], ["ctx"], ["ctx"], ["word"]], plan


def test_first_words_of_a_line_are_no_context(spark):
    """The places without a context count for their words alone, also where a word is its own neighbour."""
    df = spark.createDataFrame([(0, i, x.split()) for i, x in enumerate(["a a", "a a a", "b"])], "doc_id long, line int, tokens array<string>")
    test = spark.createDataFrame([(9, 0, "a a a b".split()), (9, 1, "b b c".split()), (9, 2, "c c a".split())], df.schema)
    got = {(r.line, r.pos): (r.p, r.oov, r.in_vocab) for r in ngram.score_tokens(test, ngram.fit_trigram(df), keep=("line",)).collect()}
    assert got == {(0, 2): (1.0, 0, 0), (0, 3): (1 / 6, 0, 1), (1, 2): (0.99 / 6, 1, 0), (2, 2): (5 / 6, 0, 1)}


def test_training_tokens_are_found_once(spark):
    """A filter on the tokens would be evaluated below them, so that the pattern runs twice over each line."""
    places = ngram.hashed_places(_sents(spark, [(0, "a b c\n\nd")]))
    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan
    assert places.count() == 7  # a b c endofline, endofline, d endofline


def test_lines_are_cut_without_a_pattern(spark):
    """All three breaks, also beside each other and at both ends, cut as the pattern does."""
    from pyspark.sql import functions as F
    from textlm.functions.text import LINE_BREAK, line_pieces

    texts = ["a\r\nb\rc\n\nd\r\n", "\r\r\n\n\r", "", "a", "\n", "a\n\rb", "é\r\r\r\n–", None]
    pieces = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", line_pieces(F.col("t")).alias("p"))
    assert {r.i: r.p for r in pieces.collect()} == {i: None if t is None else re.split(LINE_BREAK, t) for i, t in enumerate(texts)}
    assert "\\r\\n|" not in pieces._jdf.queryExecution().optimizedPlan().toString()
