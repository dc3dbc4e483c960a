"""Word vectors: normalisation, similarity, neighbours, pair scores, layer mixing.

A vector table is ``(word string, vec array<double>)`` (float32 inputs are
widened first so every engine sums in double).  All vector arithmetic is
array higher-order functions inside whole-stage codegen, except the
neighbour search, which scores a broadcast, size-checked query block against
each partition with numpy and ships only a running top-n per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_QUERY_BLOCK = 20_000  # query rows broadcast per neighbour pass (x dim x 8 bytes)
SCORE_CELLS = 4_000_000  # query x row similarities held at once in a task


def as_double(vec: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a: Column) -> Column:
    """Unit length (H5); a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors (H6)."""
    return dot(normalize(a), normalize(b))


def vector_table(embeddings: DataFrame, key: str = "vec_id", prefix: str = "w") -> DataFrame:
    """``(word, vec_id, vec)`` from an id-keyed embedding table; word = prefix + id."""
    return embeddings.select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("word"),
        F.col(key).alias("vec_id"),
        as_double(F.col("embedding")).alias("vec"),
    )


# ------------------------------------------------------------------ neighbours
def _topn_schema() -> T.StructType:
    return T.StructType([
        T.StructField("query", T.StringType()),
        T.StructField("neighbor", T.StringType()),
        T.StructField("similarity", T.DoubleType()),
    ])


def _partition_topn(q_words: list[str], q_unit: np.ndarray, n: int):
    """Per-partition running top-n per query, ties by ``rank``; at most ``n`` are held beside those that wait to be compared.

    Rows are held as numbers: a similarity is looked at again only if it reaches the ``n``-th best that its query holds so far.
    """

    chunk = max(1, SCORE_CELLS // max(1, len(q_words)))  # rows scored at once
    of_word: dict[str, list[int]] = {}
    for i, word in enumerate(q_words):
        of_word.setdefault(word, []).append(i)

    def run(batches):
        words, ranks, seen = [], [], 0
        held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]  # query, similarity, row
        floor, waiting = np.full(len(q_words), -np.inf), 0

        def best() -> None:
            nonlocal held, waiting
            q, s, at = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((np.concatenate(ranks)[at] if ranks else at, -s, q))
            q, s, at = q[order], s[order], at[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
            floor[q[place == n - 1]] = s[place == n - 1]
            keep = place < n
            held, waiting = [(q[keep], s[keep], at[keep])], 0

        for pdf in batches:
            words.append(pdf["word"].to_numpy(dtype=object))
            ranks.append(pdf["_rank"].to_numpy(np.int64))
            for lo in range(0, len(pdf), chunk):
                part = pdf.iloc[lo:lo + chunk]
                v = np.stack(part["vec"].to_numpy()).astype(np.float64)
                nv = np.linalg.norm(v, axis=1, keepdims=True)
                u = np.divide(v, nv, out=np.zeros_like(v), where=nv > 0)
                s = q_unit @ u.T  # (queries, rows)
                for j, word in enumerate(words[-1][lo:lo + chunk]):
                    for i in of_word.get(word, ()):
                        s[i, j] = np.nan  # self excluded
                if not seen and s.shape[1] > n:  # no query's n-th best lies below its n-th best of the first rows
                    np.maximum(floor, np.partition(np.nan_to_num(s, nan=-np.inf), s.shape[1] - n, axis=1)[:, s.shape[1] - n], out=floor)
                q, j = np.nonzero(s >= floor[:, None])
                found = s[q, j]
                if not np.isfinite(found).all():
                    q, j, found = (x[np.isfinite(found)] for x in (q, j, found))
                held.append((q, found, seen + j))
                seen += s.shape[1]
                waiting += len(q)
                if waiting > max(SCORE_CELLS // 8, len(q_words) * n):
                    best()
        best()
        (q, s, at), every = held[0], np.concatenate(words) if words else np.zeros(0, object)
        if len(q):
            yield pd.DataFrame({"query": np.asarray(q_words, dtype=object)[q], "neighbor": every[at], "similarity": s})

    return run


def _cut(s: np.ndarray, w: np.ndarray, n: int):
    if s.shape[1] <= n:
        return s, w
    kth = -np.partition(-s, n - 1, axis=1)[:, n - 1:n]  # n-th largest per row
    keep = s >= kth
    width = int(keep.sum(axis=1).max())
    order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
    s2 = np.take_along_axis(s, order, axis=1)
    w2 = np.take_along_axis(w, order, axis=1)
    s2[~np.take_along_axis(keep, order, axis=1)] = -np.inf
    if width > n:  # ties at the cut: the smaller words stay
        order = np.lexsort((w2.astype(str), -s2), axis=1)[:, :n]
        s2, w2 = np.take_along_axis(s2, order, axis=1), np.take_along_axis(w2, order, axis=1)
    return s2, w2


def most_similar(queries: DataFrame, vectors: DataFrame, n: int = 10) -> DataFrame:
    """Top-``n`` neighbours by cosine for each query word, self excluded (H7).

    ``queries(word, vec)`` is read in blocks of at most ``MAX_QUERY_BLOCK``
    rows (its size is counted first); each block is broadcast and scanned
    against every partition of ``vectors`` in one ``mapInPandas`` pass.  The
    final merge ranks at most ``n x partitions`` candidates per query.
    Output ``(query, neighbor, similarity, rank)``; ties by neighbour word.
    """
    from textlm.operators.rownum import global_row_number

    spark = vectors.sparkSession
    total = queries.count()
    parts = []
    vectors = global_row_number(vectors.select("word", "vec"), ["word"], "_rank",
                                partitions=spark.sparkContext.defaultParallelism)  # stored; a block's scan is a task a core, and finds its best once in each
    if total <= MAX_QUERY_BLOCK:
        blocks = [queries]
    else:
        numbered = global_row_number(queries.select("word", "vec"), ["word"], "qi")
        blocks = [numbered.where((F.col("qi") >= lo) & (F.col("qi") < lo + MAX_QUERY_BLOCK))
                  for lo in range(0, total, MAX_QUERY_BLOCK)]
    for block in blocks:
        rows = block.select("word", "vec").collect()  # bounded by MAX_QUERY_BLOCK
        if not rows:
            continue
        q_words = [r.word for r in rows]
        q = np.asarray([r.vec for r in rows], dtype=np.float64)
        nq = np.linalg.norm(q, axis=1, keepdims=True)
        q_unit = np.divide(q, nq, out=np.zeros_like(q), where=nq > 0)
        fn = _partition_topn(q_words, q_unit, n)
        parts.append(vectors.select("word", "vec", "_rank").mapInPandas(fn, _topn_schema()))
    if not parts:
        return spark.createDataFrame([], _topn_schema()).withColumn("rank", F.lit(0))
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), F.col("neighbor").asc())
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# ------------------------------------------------------------------ word pairs
def derived_pairs(vectors: DataFrame, prefix: str = "w") -> DataFrame:
    """A word-pair list with human-like scores derived from the vector ids.

    Fixed rule (the driver tables hold no similarity list): for id ``i`` of
    ``m`` vectors, the partner id is ``(7 i + 3) mod (m + m div 10)`` -- about
    one partner in eleven has no vector -- and the score is
    ``((31 i + 17 j) mod 100) / 10``.  Self pairs are left out.
    """
    m = vectors.agg(F.count("*").alias("m"))
    v = vectors.select("vec_id").crossJoin(F.broadcast(m))
    j = (F.col("vec_id") * 7 + 3) % (F.col("m") + F.floor(F.col("m") / 10).cast("bigint"))
    out = v.select(F.col("vec_id").alias("i"), j.alias("j")).where(F.col("i") != F.col("j"))
    return out.select(
        F.concat(F.lit(prefix), F.col("i").cast("string")).alias("w1"),
        F.concat(F.lit(prefix), F.col("j").cast("string")).alias("w2"),
        (((F.col("i") * 31 + F.col("j") * 17) % 100) / 10.0).alias("score"),
    )


def _with_vectors(pairs: DataFrame, vectors: DataFrame, how: str) -> DataFrame:
    v1 = vectors.select(F.col("word").alias("w1"), F.col("vec").alias("v1"))
    v2 = vectors.select(F.col("word").alias("w2"), F.col("vec").alias("v2"))
    return pairs.join(v1, "w1", how).join(v2, "w2", how)


def pair_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with both vectors known: ``(w1, w2, score, sim)`` (H10, drop policy)."""
    j = _with_vectors(pairs, vectors, "inner")
    return j.select("w1", "w2", "score", cosine(F.col("v1"), F.col("v2")).alias("sim"))


def pair_scores_zero(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every pair; a missing vector gives similarity 0 (H11).  Adds ``missing``."""
    j = _with_vectors(pairs, vectors, "left")
    missing = F.col("v1").isNull() | F.col("v2").isNull()
    return j.select("w1", "w2", "score",
                    F.when(missing, F.lit(0.0)).otherwise(cosine(F.col("v1"), F.col("v2"))).alias("sim"),
                    missing.alias("missing"))


def missing_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with at least one word without a vector (H8): two anti joins."""
    words = vectors.select(F.col("word"))
    a = pairs.join(words.withColumnRenamed("word", "w1"), "w1", "left_anti")
    b = pairs.join(words.withColumnRenamed("word", "w2"), "w2", "left_anti")
    return a.unionByName(b).distinct()


def restrict_vocab(vectors: DataFrame, n: int, order: str = "vec_id") -> DataFrame:
    """The first ``n`` vectors in file order (H9), by distributed row numbers: ``n`` may be large."""
    from textlm.operators.rownum import global_row_number

    return global_row_number(vectors, [order], "_at").where(F.col("_at") < n).drop("_at")


# ---------------------------------------------------------------- layer mixing
def softmax_weights(w: list[float]) -> list[float]:
    x = np.asarray(w, dtype=np.float64) + 1.0 / len(w)
    e = np.exp(x - x.max())
    return list(e / e.sum())


def mix_layers(layers: list[Column], w: list[float] | None = None, gamma: float = 1.0,
               top_only: bool = False) -> Column:
    """``gamma * sum_l softmax(w + 1/L)_l * layer_l`` (H15); ``top_only`` takes the last layer."""
    if top_only:
        return F.transform(layers[-1], lambda x: x * F.lit(gamma))
    s = softmax_weights(w or [0.0] * len(layers))
    acc = F.transform(layers[0], lambda x: x * F.lit(float(s[0])))
    def add(sw: float):
        return lambda a, b: a + b * F.lit(sw)

    for lay, sw in zip(layers[1:], s[1:]):
        acc = F.zip_with(acc, lay, add(float(sw)))
    return F.transform(acc, lambda x: x * F.lit(gamma))


def mix_l2(w: list[float], lam: float) -> float:
    """The l2 penalty ``lam * sum w^2`` of the mixing weights."""
    return float(lam * np.sum(np.square(w)))


def layer_norm(df: DataFrame, layer_cols: list[str], eps: float = 1e-12) -> DataFrame:
    """Normalise each layer by its global mean / variance over all entries.

    One global aggregate (one row) is joined back with a broadcast of size 1.
    """
    parts = []
    for c in layer_cols:
        e = df.select(F.explode(F.col(c)).alias("x"))
        parts.append(e.agg(F.avg("x").alias(f"{c}__m"), F.var_pop("x").alias(f"{c}__v")))
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)
    j = df.crossJoin(F.broadcast(one))
    out = j
    def scale(m: Column, v: Column):
        return lambda x: (x - m) / F.sqrt(v + F.lit(eps))

    for c in layer_cols:
        out = out.withColumn(c, F.transform(F.col(c), scale(F.col(f"{c}__m"), F.col(f"{c}__v"))))
    return out.drop(*[f"{c}__m" for c in layer_cols], *[f"{c}__v" for c in layer_cols])


# --------------------------------------------------------- token / sentence vectors
def token_vectors(words: DataFrame, vectors: DataFrame, ngram_vectors: DataFrame | None = None) -> DataFrame:
    """One vector per vocabulary word (H17): ``(word, vec)``.

    With ``ngram_vectors(ngram, vec)``, a word without a vector gets the mean
    of its character n-gram vectors (the subword model of H3).
    """
    distinct = words.select("word").distinct()
    known = distinct.join(vectors.select("word", "vec"), "word", "inner")
    if ngram_vectors is None:
        return known
    from textlm.operators.embeddings import subword_vectors

    unseen = distinct.join(vectors.select("word"), "word", "left_anti")
    return known.unionByName(subword_vectors(unseen, ngram_vectors))


def vector_dim(vectors: DataFrame, col: str = "vec") -> int:
    """Dimension of a vector table, read from one row."""
    row = vectors.select(F.size(col).alias("d")).first()
    return int(row.d) if row else 0


def sentence_layers(sents: DataFrame, vectors: DataFrame, keys: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """Per token of each sentence: three layers (H18, re-aimed).

    layer 0 = the token vector; layer 1 = running mean from the left; layer 2 =
    running mean from the right.  Tokens without a vector are left out.  A
    sentence's vectors are gathered into one array, and a fold over it, each
    way, makes the running sums; their width is that of the data.
    """
    toks = sents.select(*keys, F.posexplode("tokens").alias("pos", "word"))
    j = toks.join(vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word", "inner")
    per = j.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "word", "vec"))).alias("ts"))

    def sums(ts):
        start = F.array(F.transform(ts[0]["vec"], lambda x: F.lit(0.0)))
        held = F.aggregate(ts, start, lambda acc, t: F.concat(acc, F.array(
            F.zip_with(F.element_at(acc, -1), t["vec"], lambda a, b: a + b))))
        return F.slice(held, 2, F.size(ts))

    n = F.size("ts")
    left = F.transform(sums(F.col("ts")), lambda v, i: F.transform(v, lambda x: x / (i + 1)))
    right = F.transform(F.reverse(sums(F.reverse("ts"))), lambda v, i: F.transform(v, lambda x: x / (n - i)))
    layers = per.select(*keys, "ts", left.alias("l"), right.alias("r")).select(
        *keys, F.inline(F.arrays_zip(F.col("ts"), F.col("l").alias("layer1"), F.col("r").alias("layer2"))).alias("t", "layer1", "layer2"))
    return layers.select(*keys, F.col("t.pos").alias("pos"), F.col("t.word").alias("word"), F.col("t.vec").alias("layer0"),
                         "layer1", "layer2")
