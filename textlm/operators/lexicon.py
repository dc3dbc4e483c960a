"""Tagged word lists: lemma_POS forms, lexicon lookup, CoNLL-U rows, bilingual pairs.

The per-word tagger of the reference is re-aimed as a join against a
lexicon table ``(word, lemma, pos)``; everything else is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.functions.text import tokenize
from textlm.operators.rownum import global_row_number

# Short tags of a tagged similarity list and their UD names.
SHORT_POS = {"A": "ADJ", "V": "VERB", "N": "NOUN"}
CONLL_FIELDS = 10


def ud_pos(short: Column) -> Column:
    """A -> ADJ, V -> VERB, N -> NOUN, anything else unchanged."""
    out = F.when(F.lit(False), short)
    for k, v in SHORT_POS.items():
        out = out.when(short == F.lit(k), F.lit(v))
    return out.otherwise(short)


def lempos(lemma: Column, pos: Column) -> Column:
    """``lemma_POS``."""
    return F.concat_ws("_", lemma, pos)


def letters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}]", "")


def all_latin(c: Column) -> Column:
    """True when every letter is Latin script -- also when there is no letter."""
    return ~letters(c).rlike(r"[^\p{IsLatin}]")


def parse_conll(rows: DataFrame, col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """CoNLL-U rows: ``#`` comments, blank rows and rows without 10 fields are skipped."""
    f = F.split(F.col(col), "\t")
    ok = ~F.col(col).startswith("#") & (F.col(col) != "") & (F.size(f) == CONLL_FIELDS)
    return rows.where(ok).select(*keep, f[0].alias("token_id"), f[1].alias("form"), f[2].alias("lemma"),
                                 f[3].alias("upos"))


def tag_lookup(words: DataFrame, lexicon: DataFrame, word_col: str = "word", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, word, lemma, pos)``: the last analysed token of each word wins.

    The word is tokenised, each token looked up in the lexicon, and the
    analysis of the highest token position kept -- an aggregate per word, not
    a per-word tagger call.
    """
    toks = words.select(*keys, word_col, F.posexplode(tokenize(F.col(word_col))).alias("tpos", "tok"))
    lex = lexicon.select(F.col("word").alias("tok"), "lemma", "pos")
    hit = toks.join(lex, "tok", "inner")
    best = hit.groupBy(*keys, word_col).agg(F.max_by(F.struct("lemma", "pos"), F.col("tpos")).alias("a"))
    return words.select(*keys, word_col).join(best, [*keys, word_col], "left").select(
        *keys, word_col, F.col("a.lemma").alias("lemma"), F.col("a.pos").alias("pos"))


def ranked_words(vocab: DataFrame, name: str) -> DataFrame:
    """``(idx, name)``: words by frequency desc, word asc."""
    r = global_row_number(vocab.select("word", "n"), [F.col("n").desc(), F.col("word").asc()], "idx")
    return r.select("idx", F.col("word").alias(name))


def pair_by_position(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Zip two indexed lists on ``idx`` -- only when they are equally long."""
    ns = src.agg(F.count("*").alias("_ns"))
    nt = tgt.agg(F.count("*").alias("_nt"))
    same = ns.crossJoin(nt).where(F.col("_ns") == F.col("_nt"))
    return src.join(tgt, "idx").crossJoin(F.broadcast(same)).drop("_ns", "_nt")


def same_pos(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose two POS tags are equal."""
    return pairs.where(F.col("src_pos") == F.col("tgt_pos"))


def non_latin(pairs: DataFrame) -> DataFrame:
    """Drop pairs whose target lemma has only Latin letters or none."""
    return pairs.where(~all_latin(F.col("tgt_lemma")))


def pos_counts(tagged: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Frequency of POS labels (I4)."""
    return tagged.groupBy(F.col(pos_col).alias("pos")).agg(F.count("*").alias("n"))
