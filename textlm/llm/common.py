"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# bytes.translate table: A-Z lower-cased, every other ASCII byte but 0-9 and
# a-z a blank, bytes of non-ASCII characters kept; then split() gives words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased text, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def each(column, step: int = 512) -> Iterator:
    """The values of an Arrow column, few of them at a time as Python objects."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` bound as a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_key(doc_id: str, text: str) -> list[Column]:
    """A document's identity as two longs: the same for rows equal in both columns, else different."""
    return [F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))
            for seed in (1, 2)]


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back (lineage cut, survives executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table in the shared checkpoint folder and read back.

    Smaller than ``stored`` for texts and long tables; the files stay until that folder is emptied.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Marks:
    """A bit map of hashes, of ``2 ** bits`` bits whatever the number of rows: ``column`` is true for each hash of
    ``hashes`` and for some others (for all, once the map is full), so that rows can be left out before a join."""

    def __init__(self, hashes: DataFrame, bits: int) -> None:
        self.bits, page_bits = bits, min(bits, 16)

        def fill(key: tuple, rows: pa.Table) -> pa.Table:
            held = np.zeros(1 << page_bits, bool)
            held[rows["at"].to_numpy()] = True
            return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "map": pa.array([np.packbits(held).tobytes()], pa.binary())})

        (name,) = hashes.columns
        place = F.shiftrightunsigned(F.col(name), 64 - bits).cast("bigint")
        pages = hashes.select(F.shiftright(place, page_bits).cast("int").alias("page"),
                              place.bitwiseAND((1 << page_bits) - 1).cast("int").alias("at")).distinct() \
            .groupBy("page").applyInArrow(fill, "page int, map binary").collect()  # 2 ** bits / 8 bytes at most
        whole = np.zeros((1 << (bits - page_bits), 1 << max(page_bits - 3, 0)), np.uint8)
        for row in pages:
            whole[row["page"]] = np.frombuffer(row["map"], np.uint8)
        self.held = hashes.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.held.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0

    def column(self, hashed: Column) -> Column:
        held, bits = self.held, self.bits

        def run(h: pa.Array) -> pa.Array:
            at = h.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)
            return pa.array((held.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0)

        run.__annotations__ = {"h": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "boolean")(hashed)


def groups(batches: Iterator, key: str) -> Iterator:
    """Pandas frames of one key each, from key-sorted pandas batches; one group is held at a time."""
    import pandas as pd

    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = pdf.iloc[a:b]
            if held and held[-1][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)
