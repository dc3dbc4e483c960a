"""Word-list preparation queries.

No driver table holds a lexicon, a bilingual list or tagger output, so they
are derived from the documents by fixed rules:

* lexicon: every token of ``documents``; lemma = the token lower-cased with
  trailing non-alphanumerics removed; POS = NOUN / VERB / ADJ by token length
  mod 3 (0 / 1 / 2);
* bilingual list: the i-th most frequent English token beside the i-th most
  frequent token of the other languages, for i below the shorter list;
* CoNLL-U text: per ``benchmark`` line a comment row, then one 10-field row
  per token (a 9-field row for tokens with a digit, to be skipped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlm.functions.text import tokenize
from textlm.operators import lexicon as lx
from textlm.operators import vectors as vx
from textlm.plans.registry import query
from textlm.sources import tables

POS3 = ["NOUN", "VERB", "ADJ"]
SHORT3 = ["N", "V", "A"]


def by_length(word: Column, tags: list[str]) -> Column:
    m = F.length(word) % 3
    return F.when(m == 0, F.lit(tags[0])).when(m == 1, F.lit(tags[1])).otherwise(F.lit(tags[2]))


def rule_lemma(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}]+$", ""))


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.table(spark, sf, "documents").select("lang", "text")
    lines = d.select("lang", F.explode(tables.split_lines(F.col("text"))).alias("value"))
    return lines.select("lang", F.explode(tokenize(F.col("value"))).alias("word"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    words = doc_tokens(spark, sf).select("word").distinct()
    return words.select("word", rule_lemma(F.col("word")).alias("lemma"), by_length(F.col("word"), POS3).alias("pos"))


def bilingual(spark: SparkSession, sf: str) -> DataFrame:
    t = doc_tokens(spark, sf)
    en = lx.ranked_words(t.where(F.col("lang") == "en").groupBy("word").agg(F.count("*").alias("n")), "src")
    ot = lx.ranked_words(t.where(F.col("lang") != "en").groupBy("word").agg(F.count("*").alias("n")), "tgt")
    n = en.agg(F.count("*").alias("a")).crossJoin(ot.agg(F.count("*").alias("b"))).select(F.least("a", "b").alias("m"))
    return en.join(ot, "idx").crossJoin(F.broadcast(n)).where(F.col("idx") < F.col("m")).drop("m")


def tagged_pairs(spark: SparkSession, sf: str) -> DataFrame:
    bl = bilingual(spark, sf)
    lex = lexicon(spark, sf)
    s = lx.tag_lookup(bl.select("idx", F.col("src").alias("word")), lex, keys=("idx",)).select(
        "idx", F.col("word").alias("src"), F.col("lemma").alias("src_lemma"), F.col("pos").alias("src_pos"))
    t = lx.tag_lookup(bl.select("idx", F.col("tgt").alias("word")), lex, keys=("idx",)).select(
        "idx", F.col("word").alias("tgt"), F.col("lemma").alias("tgt_lemma"), F.col("pos").alias("tgt_pos"))
    return lx.pair_by_position(s, t)


def _lempos(df: DataFrame) -> DataFrame:
    return df.select(lx.lempos(F.col("src_lemma"), F.col("src_pos")).alias("src_lempos"),
                     lx.lempos(F.col("tgt_lemma"), F.col("tgt_pos")).alias("tgt_lempos"))


@query("lexicon")
def q_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon(spark, sf)


@query("bilingual_list")
def q_bilingual_list(spark: SparkSession, sf: str) -> DataFrame:
    return bilingual(spark, sf).select("idx", "src", "tgt")


@query("tagged_words")
def q_tagged_words(spark: SparkSession, sf: str) -> DataFrame:
    bl = bilingual(spark, sf)
    return lx.tag_lookup(bl.select("idx", F.col("src").alias("word")), lexicon(spark, sf), keys=("idx",))


@query("positional_pairs")
def q_positional_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tagged_pairs(spark, sf)


@query("same_pos_pairs")
def q_same_pos_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return lx.same_pos(tagged_pairs(spark, sf))


@query("latin_flags")
def q_latin_flags(spark: SparkSession, sf: str) -> DataFrame:
    p = lx.same_pos(tagged_pairs(spark, sf))
    return p.select("idx", "tgt_lemma", lx.all_latin(F.col("tgt_lemma")).alias("all_latin"))


@query("non_latin_pairs")
def q_non_latin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _lempos(lx.non_latin(lx.same_pos(tagged_pairs(spark, sf)))).distinct()


@query("lempos_pairs")
def q_lempos_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _lempos(lx.same_pos(tagged_pairs(spark, sf)))


@query("distinct_pairs")
def q_distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _lempos(lx.same_pos(tagged_pairs(spark, sf))).distinct()


@query("pair_counts")
def q_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = _lempos(lx.same_pos(tagged_pairs(spark, sf)))
    return p.agg(F.count("*").alias("n_pairs"),
                 F.count_distinct("src_lempos", "tgt_lempos").alias("n_distinct"))


@query("pos_counts")
def q_pos_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = tagged_pairs(spark, sf)
    both = p.select(F.col("src_pos").alias("pos")).unionByName(p.select(F.col("tgt_pos").alias("pos")))
    return lx.pos_counts(both)


@query("lempos_similarity_list")
def q_lempos_similarity_list(spark: SparkSession, sf: str) -> DataFrame:
    pairs = vx.derived_pairs(vx.vector_table(tables.table(spark, sf, "embeddings")))
    pos = lx.ud_pos(by_length(F.col("w1"), SHORT3))
    return pairs.select(lx.lempos(F.col("w1"), pos).alias("lempos1"), lx.lempos(F.col("w2"), pos).alias("lempos2"),
                        "score")


@query("conll_rows")
def q_conll_rows(spark: SparkSession, sf: str) -> DataFrame:
    b = tables.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    lines = tables.lines_of(b)
    toks = lines.select("doc_id", "line", "value", F.posexplode(tokenize(F.col("value"))).alias("i", "tok"))
    fields = F.concat_ws("\t", (F.col("i") + 1).cast("string"), "tok", rule_lemma(F.col("tok")),
                         by_length(F.col("tok"), POS3), *([F.lit("_")] * 6))
    short = F.concat_ws("\t", (F.col("i") + 1).cast("string"), "tok", rule_lemma(F.col("tok")),
                        by_length(F.col("tok"), POS3), *([F.lit("_")] * 5))
    rows = toks.select("doc_id", "line", F.when(F.col("tok").rlike(r"\d"), short).otherwise(fields).alias("value"))
    comments = lines.select("doc_id", "line", F.concat(F.lit("# text = "), F.col("value")).alias("value"))
    parsed = lx.parse_conll(rows.unionByName(comments), keep=("doc_id", "line"))
    return parsed.select("doc_id", F.col("line").cast("bigint").alias("line"), "token_id", "form", "lemma", "upos")
