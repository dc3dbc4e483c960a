"""Truncated SVD of a sparse table by a randomised block method (Halko, Martinsson and Tropp 2011).

The matrix is a table ``(row, column, value)``.  Its keys are numbered and dealt to ``side`` blocks, its cells to a
square grid by the blocks of both, packed and stored once; a thin matrix, ``width`` numbers a key, is packed rows of
``CHUNK`` keys of a block.

* *Product.*  A square of the grid gets the thin matrix's block of the side that is summed over and gives its part of
  the other side's; these are added up in the order of the squares.  So a product shuffles thin matrices, ``side``
  times each, and never a cell.
* *Orthonormal columns.*  Each task takes the QR factor of its rows; the
  factors are merged in two levels, and only the last one, ``width`` squared
  numbers, reaches the driver.  Dividing by it makes the columns orthonormal,
  whatever the partitioning; directions without weight are dropped.
* *Range.*  A random block of signs, multiplied by the matrix and its transpose
  ``rounds`` times, spans the leading directions; the small factor of its last
  product gives the singular values.

All cells take part; nothing is limited by the number of rows or columns.
Equal seeds give equal results up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.operators.rownum import global_row_number
from textlm.session import ensure_checkpoint_dir
from textlm.sources.tables import BROADCAST_MAX_ROWS

OVERSAMPLE = 10
ROUNDS = 3
MERGED = 32  # factors that one task merges
SQUARE_CELLS = 8_000_000  # cells of a square of the grid on average, 16 bytes each; fewer while there are fewer squares than cores
PACKED_CELLS = 500_000  # cells of one row
CHUNK = 16_384  # keys of one row of a thin matrix
AT_ONCE = 32_768  # cells that are multiplied at once


class Svd(NamedTuple):
    rows: DataFrame  # (row key, vec): U sqrt(S)
    values: list[float]  # singular values, largest first
    energy: float  # the sum of all squared cells


def _names(width: int) -> list[str]:
    return [f"y{i}" for i in range(width)]


def _stored(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Grid(NamedTuple):
    squares: DataFrame  # (i, j, a, b, v): packed cells, the squares' rows in one task
    side: int
    rows: int
    columns: int


def _packed(cells: DataFrame, side: int, rows: int, columns: int) -> Grid:
    """The grid of ``(r, c, value)``, the numbers of row and column."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def told() -> pd.DataFrame:
            a, b, v = (np.concatenate([x[n] for x in held]) for n in range(3))
            return pd.DataFrame([(at // side, at % side, a.tobytes(), b.tobytes(), v.tobytes())], columns=["i", "j", "a", "b", "v"])

        for pdf in batches:
            square = pdf.i.to_numpy(np.int64) * side + pdf.j.to_numpy()
            arrays = pdf.a.to_numpy(np.int32), pdf.b.to_numpy(np.int32), pdf.value.to_numpy(np.float64)
            ends = np.flatnonzero(np.append(square[1:] != square[:-1], True)) + 1 if len(square) else []
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                if held and (square[lo] != at or sum(len(x[0]) for x in held) >= PACKED_CELLS):
                    yield told()
                    held = []
                at = int(square[lo])
                held.append([x[lo:hi] for x in arrays])
        if held:
            yield told()

    dealt = cells.select((F.col("r") % side).cast("int").alias("i"), (F.col("c") % side).cast("int").alias("j"),
                         F.floor(F.col("r") / side).cast("int").alias("a"), F.floor(F.col("c") / side).cast("int").alias("b"), "value")
    tasks = 4 * side * side  # a number of its own: a square is much work and few rows
    packed = dealt.repartition(tasks, "i", "j").sortWithinPartitions("i", "j", "a", "b").mapInPandas(run, "i int, j int, a binary, b binary, v binary")
    return Grid(_dealt(packed.repartition(tasks, "i", "j")), side, rows, columns)


def _dealt(df: DataFrame) -> DataFrame:
    """``df`` stored, its last exchange remembered: a stored table forgets how it lies under adaptive execution, and would be shuffled by
    each of its users."""
    key, conf = "spark.sql.adaptive.enabled", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return _stored(df)
    finally:
        conf.set(key, before)


def _thin_rows(b: int, made: np.ndarray) -> list[tuple]:
    return [(b, k, made[lo:lo + CHUNK].tobytes()) for k, lo in enumerate(range(0, len(made), CHUNK))]


def _product(grid: Grid, transposed: bool, thin: DataFrame, width: int) -> DataFrame:
    """The matrix, or its transpose, times a thin one ``(b, k, vec)``: ``(b, k, vec)``."""
    g, n = grid.side, grid.columns if transposed else grid.rows

    def run(key: tuple, squares: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        if not len(squares) or not len(held):
            return pd.DataFrame(columns=["b", "k", "vec", "square"])
        x = np.frombuffer(b"".join(held.sort_values("k").vec)).reshape(-1, width)
        to = j if transposed else i
        made = np.zeros((-(-(n - to) // g), width))
        for row in squares.sort_values(["a", "b"]).itertuples():  # a fixed order: sums hang on it
            a, b, v = np.frombuffer(row.a, np.int32), np.frombuffer(row.b, np.int32), np.frombuffer(row.v)
            if transposed:
                order = np.argsort(b, kind="stable")
                a, b, v = b[order], a[order], v[order]
            for lo in range(0, len(a), AT_ONCE):
                at = a[lo:lo + AT_ONCE]
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                made[at[first]] += np.add.reduceat(x.take(b[lo:lo + AT_ONCE], axis=0) * v[lo:lo + AT_ONCE, None], first, axis=0)
        return pd.DataFrame(_thin_rows(to, made), columns=["b", "k", "vec"]).assign(square=i * g + j)

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("square")
        return parts.head(1)[["b", "k"]].assign(vec=[sum(np.frombuffer(x) for x in parts.vec).tobytes()])

    other = F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("other")
    sent = thin.select("b", "k", "vec", other).select(
        F.col("b" if transposed else "other").alias("ti"), F.col("other" if transposed else "b").alias("tj"), "k", "vec")
    parts = grid.squares.groupBy("i", "j").cogroup(sent.repartition(4 * g * g, "ti", "tj").groupBy("ti", "tj")).applyInPandas(
        run, "b int, k int, vec binary, square int")
    return parts.groupBy("b", "k").applyInPandas(added, "b int, k int, vec binary")


def _matrix(vec: bytes, width: int) -> np.ndarray:
    return np.frombuffer(vec).reshape(-1, width)


def _factor(thin: DataFrame, width: int) -> np.ndarray:
    """The triangular factor of a thin matrix's QR decomposition, merged in two levels."""
    names = _names(width)

    def reduced(rows: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(rows), mode="r")

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = reduced([held, *(_matrix(x, width) for x in batch.column("vec").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(width)], names=names)

    def merged(key: tuple, rows: pa.Table) -> pa.Table:
        out = reduced([np.column_stack([rows[y].to_numpy() for y in names])])
        return pa.table({y: out[:, i] for i, y in enumerate(names)})

    schema = ", ".join(f"{y} double" for y in names)
    parts = thin.select("vec").mapInArrow(by_task, schema)
    groups = parts.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    held = groups.groupBy("part").applyInArrow(merged, schema).toPandas().to_numpy()
    return reduced([np.zeros((0, width)), held]) if len(held) else np.zeros((0, width))


def _times(thin: DataFrame, width: int, by: np.ndarray) -> DataFrame:
    """The thin matrix times a small one."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vec=[(_matrix(x, width) @ by).tobytes() for x in pdf.vec])

    return thin.select("b", "k", "vec").mapInPandas(run, "b int, k int, vec binary")


def _orthonormal(thin: DataFrame, width: int) -> tuple[DataFrame, int]:
    """A thin matrix of the same span with orthonormal columns, and their number."""
    _, s, v = np.linalg.svd(_factor(thin, width))
    rank = int((s > (s[0] if len(s) else 0) * 1e-10).sum())
    if not rank:
        return thin, 0
    return _times(thin, width, v[:rank].T / s[:rank]), rank


def _signs(keys: DataFrame, key: str, side: int, width: int, seed: int) -> DataFrame:
    """The random block of signs, by the keys of ``(key, id)``: ``(b, k, vec)``."""
    words = range(-(-width // 64))
    placed = keys.select((F.col("id") % side).cast("int").alias("b"), F.floor(F.col("id") / side).alias("at"),
                         *[F.xxhash64(F.lit(seed + n), F.col(key)).alias(f"h{n}") for n in words])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bits = pdf.sort_values("at")[[f"h{n}" for n in words]].to_numpy(np.int64)
        signs = [1.0 - 2.0 * ((bits[:, i // 64] >> (i % 64)) & 1) for i in range(width)]
        return pd.DataFrame([(key[0], key[1], np.column_stack(signs).tobytes())], columns=["b", "k", "vec"])

    return placed.withColumn("k", F.floor(F.col("at") / CHUNK).cast("int")).groupBy("b", "k").applyInPandas(run, "b int, k int, vec binary")


def _numbers(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``(key, id)`` of the distinct keys, and their number."""
    ids = global_row_number(keys.select(key).distinct(), [key], "id").checkpoint()
    return ids, ids.count()


def svd(cells: DataFrame, row: str = "word", dim: int = 100, column: str = "context", rounds: int = ROUNDS,
        oversample: int = OVERSAMPLE, seed: int = 42, keys: DataFrame | None = None) -> Svd:
    """The ``dim`` leading directions of the table ``(row, column, value)``; no cells, no rows.

    ``keys``: a table with a column ``row`` that holds all keys of both sides (and maybe others), if they are known; then
    the cells are read once and never stored by their keys.
    """
    cells = cells.select(row, column, F.col("value").cast("double").alias("value"))
    empty = cells.select(row, F.array().cast("array<double>").alias("vec")).limit(0)
    if keys is None:
        cells = _stored(cells)
        of_row, n_rows = _numbers(cells, row)
        of_column, n_columns = _numbers(cells, column)
    else:
        of_row, n_rows = _numbers(keys, row)
        of_column, n_columns = of_row.withColumnRenamed(row, column), n_rows
    sent = F.broadcast if max(n_rows, n_columns) <= BROADCAST_MAX_ROWS else (lambda x: x)
    cells = _stored(cells.join(sent(of_row.withColumnRenamed("id", "r")), row).join(sent(of_column.withColumnRenamed("id", "c")), column)
                    .select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "value"))
    told = cells.agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("*").alias("n")).first()
    energy, n = told.energy or 0.0, told.n
    if not n:
        return Svd(empty, [], energy)
    cores = cells.sparkSession.sparkContext.defaultParallelism
    side = max(-(-n // SQUARE_CELLS), min(2 * cores, -(-n // PACKED_CELLS)))
    side = int(np.ceil(np.sqrt(side)))
    grid = _packed(cells, side, n_rows, n_columns)
    width = dim + oversample
    thin, width = _orthonormal(_stored(_product(grid, False, _signs(of_column, column, side, width, seed), width)), width)
    if not width:
        return Svd(empty, [], energy)
    for _ in range(rounds):
        other, width = _orthonormal(_stored(_product(grid, True, thin, width)), width)
        thin, width = _orthonormal(_stored(_product(grid, False, other, width)), width)
    thin = _stored(thin)
    last = _factor(_product(grid, True, thin, width), width)  # of the transposed matrix times the orthonormal rows
    turn, s, _ = np.linalg.svd(last.T)
    s, turn = s[:dim], turn[:, :dim]
    turn = turn * np.where(turn[np.abs(turn).argmax(axis=0), range(turn.shape[1])] < 0, -1.0, 1.0)
    found = _times(thin, width, turn[:, :len(s)] * np.sqrt(s))

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                vec = _matrix(r.vec, len(s))
                yield pd.DataFrame({"id": ((np.arange(len(vec), dtype=np.int64) + r.k * CHUNK) * side + r.b), "vec": list(vec)})

    met = cells.select(F.col("r").cast("bigint").alias("id")).distinct()  # keys without a cell are no rows
    vecs = found.mapInPandas(single, "id bigint, vec array<double>").join(met, "id", "left_semi").join(of_row, "id")
    return Svd(vecs.select(row, "vec"), s.tolist(), float(energy))
