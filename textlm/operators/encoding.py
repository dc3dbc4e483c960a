"""Id and character encodings, padding and masks (A5 table form, C7-C13).

A special vocabulary ``svocab(word, id)`` has ids by line order, with the
sentence markers and the unknown word among its words; ``specials`` is its
one-row ``(bos, eos, unk)``.  Sentences are ``(..., tokens array<string>)``.

Encoding explodes tokens, joins the vocabulary, and regroups per sentence;
a regroup holds one sentence, so no group grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.operators.rownum import global_row_number

# Fixed values of the sentence-marker vocabulary and character ids.
BOS_WORD, EOS_WORD, UNK_WORD = "<S>", "</S>", "<UNK>"
SKIP_WORD = "!!!MAXTERMID"
BOS_CHAR, EOS_CHAR, BOW_CHAR, EOW_CHAR, PAD_CHAR = 256, 257, 258, 259, 260


def special_vocab(words: DataFrame, min_n: int = 2) -> DataFrame:
    """``(word, id)``: the three markers (ids 0, 1, 2), then words seen ``min_n``+ times
    by frequency desc, word asc."""
    spark = words.sparkSession
    marks = spark.createDataFrame([(BOS_WORD, 0), (EOS_WORD, 1), (UNK_WORD, 2)], "word string, id bigint")
    kept = words.where((F.col("n") >= min_n) & ~F.col("word").isin(BOS_WORD, EOS_WORD, UNK_WORD))
    ranked = global_row_number(kept.select("word", "n"), [F.col("n").desc(), F.col("word").asc()], "rk")
    return marks.unionByName(ranked.select("word", (F.col("rk") + 3).alias("id")))


def vocab_from_lines(lines: DataFrame, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vocabulary file semantics over ``(ln bigint, value string)`` line rows (A5).

    Ids count lines in order, skipping ``!!!MAXTERMID`` lines; words are
    stripped; a repeated word keeps its last id.  Returns ``(svocab, specials)``.
    """
    kept = lines.select("ln", F.regexp_replace("value", r"^\s+|\s+$", "").alias("word")).where(
        F.col("word") != F.lit(SKIP_WORD))
    numbered = global_row_number(kept, ["ln"], "id")
    svocab = numbered.groupBy("word").agg(F.max("id").alias("id"))
    specials = specials_of(numbered, validate)
    return svocab, specials


def specials_of(svocab: DataFrame, validate: bool = True) -> DataFrame:
    """One row ``(bos, eos, unk)`` (last id of each marker); missing markers fail when ``validate``."""
    sp = svocab.agg(
        F.max(F.when(F.col("word") == BOS_WORD, F.col("id"))).alias("bos"),
        F.max(F.when(F.col("word") == EOS_WORD, F.col("id"))).alias("eos"),
        F.max(F.when(F.col("word") == UNK_WORD, F.col("id"))).alias("unk"),
    )
    if validate:
        ok = F.col("bos").isNotNull() & F.col("eos").isNotNull() & F.col("unk").isNotNull()
        # tied to a kept value so column pruning cannot drop the check
        sp = sp.select(F.when(ok, F.col("bos")).otherwise(
            F.raise_error(F.lit("vocabulary needs <S>, </S> and <UNK>"))).cast("bigint").alias("bos"), "eos", "unk")
    return sp


def encode(sents: DataFrame, svocab: DataFrame, specials: DataFrame, keys: tuple[str, ...],
           reverse: bool = False, out: str = "ids") -> DataFrame:
    """``(*keys, ids array<bigint>)``: word ids with markers.

    Unknown words get the unknown id; ``reverse`` swaps the two markers (the
    tokens are taken as already reversed).
    """
    toks = sents.select(*keys, F.posexplode("tokens").alias("pos", "word"))
    j = toks.join(svocab.select("word", F.col("id").alias("wid")), "word", "left").crossJoin(
        F.broadcast(specials))
    per = j.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("wid", "unk").alias("id")))).alias("cells"),
        F.first("bos").alias("bos"), F.first("eos").alias("eos"),
    )
    ids = F.transform("cells", lambda c: c["id"])
    head, tail = (F.col("eos"), F.col("bos")) if reverse else (F.col("bos"), F.col("eos"))
    body = per.select(*keys, F.concat(F.array(head), ids, F.array(tail)).alias(out))
    # sentences without tokens still get their two markers
    empty = sents.where(F.size("tokens") == 0).select(*keys).crossJoin(F.broadcast(specials)).select(
        *keys, F.array(head, tail).alias(out))
    return body.unionByName(empty)


def decode(encoded: DataFrame, svocab: DataFrame, keys: tuple[str, ...], col: str = "ids") -> DataFrame:
    """``(*keys, text)``: ids back to space-joined words."""
    e = encoded.select(*keys, F.posexplode(col).alias("pos", "id"))
    j = e.join(svocab.select("id", "word"), "id", "left")
    return j.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda c: c["word"]), " "
                     ).alias("text"))


def char_ids(word: Column, maxlen: int) -> Column:
    """``[258] + utf8 bytes[:maxlen-2] + [259]`` padded with 260.

    Byte arithmetic only: a character cut by the length limit stays cut.
    The sentence markers map to ``[258, 256|257, 259, 260, ...]``.
    """
    hexs = F.hex(F.encode(word, "UTF-8"))
    nbytes = F.least(F.length(hexs) / 2, F.lit(maxlen - 2)).cast("int")
    body = F.transform(
        F.when(nbytes > 0, F.sequence(F.lit(0), nbytes - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(hexs, i * 2 + 1, 2), 16, 10).cast("int"),
    )
    plain = F.concat(F.array(F.lit(BOW_CHAR)), body, F.array(F.lit(EOW_CHAR)),
                     F.array_repeat(F.lit(PAD_CHAR), F.lit(maxlen - 2) - nbytes))

    def marker(c: int) -> Column:
        return F.concat(F.array(F.lit(BOW_CHAR), F.lit(c), F.lit(EOW_CHAR)),
                        F.array_repeat(F.lit(PAD_CHAR), F.lit(maxlen - 3)))

    return (F.when(word == F.lit(BOS_WORD), marker(BOS_CHAR))
            .when(word == F.lit(EOS_WORD), marker(EOS_CHAR)).otherwise(plain))


def marker_chars(which: int, maxlen: int) -> Column:
    return F.concat(F.array(F.lit(BOW_CHAR), F.lit(which), F.lit(EOW_CHAR)),
                    F.array_repeat(F.lit(PAD_CHAR), F.lit(maxlen - 3)))


def encode_chars(sents: DataFrame, keys: tuple[str, ...], maxlen: int, reverse: bool = False,
                 out: str = "chars") -> DataFrame:
    """``(*keys, chars array<array<int>>)`` with marker rows first and last.

    Character ids are computed once per distinct word and joined back.
    """
    toks = sents.select(*keys, F.posexplode("tokens").alias("pos", "word"))
    words = toks.select("word").distinct().select("word", char_ids(F.col("word"), maxlen).alias("cid"))
    j = toks.join(words, "word", "left")
    per = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "cid"))).alias("cells"))
    rows = F.transform("cells", lambda c: c["cid"])
    head, tail = (EOS_CHAR, BOS_CHAR) if reverse else (BOS_CHAR, EOS_CHAR)
    body = per.select(*keys, F.concat(F.array(marker_chars(head, maxlen)), rows,
                                      F.array(marker_chars(tail, maxlen))).alias(out))
    empty = sents.where(F.size("tokens") == 0).select(
        *keys, F.array(marker_chars(head, maxlen), marker_chars(tail, maxlen)).alias(out))
    return body.unionByName(empty)


def batch_numbers(df: DataFrame, order: list[str], batch_size: int) -> DataFrame:
    """``df`` plus ``batch = row_number div batch_size`` over ``order``."""
    numbered = global_row_number(df, order, "_sn")
    return numbered.withColumn("batch", F.floor(F.col("_sn") / batch_size).cast("bigint")).drop("_sn")


def pad_token_batch(encoded: DataFrame, col: str = "ids", out: str = "padded") -> DataFrame:
    """+1 to every id (0 = mask), padded to the longest row of the batch (C11).

    The batch width comes from a per-batch max joined back; a batch holds
    ``batch_size`` rows, so its group is bounded.
    """
    width = encoded.groupBy("batch").agg(F.max(F.size(col)).alias("_w"))
    j = encoded.join(width, "batch")
    return j.withColumn(out, F.concat(F.transform(col, lambda x: x + 1),
                                      F.array_repeat(F.lit(0).cast("bigint"), F.col("_w") - F.size(col)))).drop("_w")


def pad_char_batch(encoded: DataFrame, maxlen: int, col: str = "chars", out: str = "padded") -> DataFrame:
    """Same for character matrices: ids +1, padding rows all 0."""
    width = encoded.groupBy("batch").agg(F.max(F.size(col)).alias("_w"))
    j = encoded.join(width, "batch")
    zero_row = F.array_repeat(F.lit(0), maxlen)
    return j.withColumn(out, F.concat(
        F.transform(col, lambda row: F.transform(row, lambda x: x + 1)),
        F.array_repeat(zero_row, F.col("_w") - F.size(col)))).drop("_w")


def mask_lengths(padded: Column, chars: bool = False) -> tuple[Column, Column, Column]:
    """``(mask, length, length_without_markers)`` of a padded row."""
    if chars:
        mask = F.transform(padded, lambda row: F.exists(row, lambda x: x > 0))
    else:
        mask = F.transform(padded, lambda x: x > 0)
    length = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    return mask, length, length - 2
