"""N-gram Jaccard join in size-banded tiles, with bitmap bounds before exact intersections.

A document's set holds the hashes of its distinct word n-grams.  Documents of
equal sets form a class, and one member stands for it.

*Which classes can meet.*  Linked sets differ in few elements: with sizes a
and b and similarity p/q, in at most (a + b)(q - p)/(q + p).  Sizes fall into
bands such that linked ones lie in the same or in neighbouring bands.  For
each band, and the next larger, a set's hashes are cut by value into parts, and
of these as many are looked up by digest as linked sets may differ in, and one
more: those with the most rare hashes.  Linked sets have one of them in common:
each difference spoils one part, so each set has an unspoilt part among its
own, and the heavier of the two is among the other's, too, since a part weighs
the same in both.  Classes with a common part are of one family.  This finds
every link, whatever hashes count as rare; it proves none.  Hashes are frequent
if ``FREQUENT`` of the documents some task reads have them (all documents are
counted); passages that many documents share then found no families.

*Which do.*  A family is compared in tiles: blocks of its members by size
band, each against itself and against the blocks of its own and the next band.
In a tile, 1024-bit parity bitmaps give a lower bound of the difference, hence
an upper bound of the overlap; pairs that pass it and are not yet connected in
the tile are decided by intersecting the sorted arrays.  A tile returns at
most one link fewer than it has members.

Skew: equal texts collapse in the task that reads them and again by class;
equal digests collapse in the task, so that one held by a third of all sets is
a few rows for each task; large families are cut into tiles.  No cap or
sample anywhere: the work in a family grows with the pairs of similar size.

Defined cases: texts without words and null texts have empty sets and link
with nothing; fewer words than n form one n-gram; a null doc_id is a document,
but no component is named after it while another member has an id.  Sets are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlm.llm.common import blank_words, each, groups, stored
from textlm.llm.components import components

BLOCK = 256  # members of a family's block
BLOCK_SHINGLES = 500_000  # and their hashes at most, about
BITS = 1024
FREQUENT = 0.001  # of the documents of a batch, but 4 of them at least
MOST_FREQUENT = 200_000  # hashes shipped to the tasks; which ones changes the work, not the links
_BATCH = 1 << 20  # digests collapsed at once in a task
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    """Word hashes met so far; thrown away when they grow many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, n: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text; fewer words than ``n`` are one n-gram."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)  # a short text's n-gram is unlike any of n words
    for i in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def set_class(shingles: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))


def band_edges(p: int, q: int, most: int = 1 << 40) -> np.ndarray:
    """Smallest size of each band: a set links with none that lies more than one band off."""
    edges = [1]
    while edges[-1] < most:
        edges.append(q * edges[-1] // p + 1)
    return np.array(edges)


def part_digests(shingles: np.ndarray, frequent: np.ndarray, edges: np.ndarray, p: int, q: int) -> np.ndarray:
    """Digests of the heaviest parts of a set, for its own band and the next."""
    band = int(np.searchsorted(edges, len(shingles), "right")) - 1
    high, out = shingles >> _U(32), []
    mixed = np.concatenate((_mix(shingles + _U(1)), np.zeros(1, np.uint64)))
    rare = np.ones(len(shingles), np.int64)
    if len(frequent):
        rare[frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles] = 0
    rare = np.concatenate(([0], np.cumsum(rare)))
    for tile in (band, band + 1):
        need = 2 * (int(edges[tile + 1]) - 1) * (q - p) // (q + p) + 1
        parts = need * 3 // 2
        cut = np.searchsorted((high * _U(parts)) >> _U(32), np.arange(parts + 1))
        sums = np.add.reduceat(mixed, cut[:-1])
        size = np.diff(cut)
        sums[size == 0] = 0  # an empty part is a part, too
        heaviest = np.lexsort((np.arange(parts), -size, -(rare[cut[1:]] - rare[cut[:-1]])))[:need]
        out.append(_mix(sums[heaviest] + _mix(heaviest.astype(np.uint64) + _U(tile << 40))))
    return np.concatenate(out)


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that many of the sets hold, and how many."""
    found, n = np.unique(np.concatenate(sets), return_counts=True)
    many = n >= max(4, FREQUENT * len(sets))
    return found[many], n[many]


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, n_shingles, class, frequent, df)`` from ``(doc_id, text)``.

    One row per document, its class null without words, and rows of frequent
    hashes (and of how many documents) with ``df`` not null.
    """

    def rows(ids, sizes, classes, frequent, df) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (sizes, classes, frequent, df))],
                                          names=["doc_id", "n_shingles", "class", "frequent", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, total = _Hashes(), [], 0

        def counted() -> pa.RecordBatch:
            found, many = _frequent(held)
            none = [None] * len(found)
            return rows(pa.array(none, pa.int64()), none, none, found.view(np.int64), many)

        for batch in batches:
            sizes, classes = [], []
            for t in each(batch.column(1)):
                s = shingle_set(t, n, hashes)
                sizes.append(len(s))
                classes.append(set_class(s) if len(s) else None)
                held.append(s)
                total += len(s)
                if total >= _BATCH:
                    yield counted()
                    held, total = [], 0
            none = [None] * len(sizes)
            yield rows(batch.column(0), sizes, classes, none, none)
        if held:
            yield counted()

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint, frequent bigint, df bigint")


def _collapsed(digests: list[np.ndarray], classes: list[int]) -> pa.RecordBatch:
    """One row per digest; every further class of it is tied to its first by a digest of their own."""
    d = np.concatenate(digests)
    c = np.repeat(np.array(classes, np.int64), [len(x) for x in digests])
    order = np.lexsort((c, d))
    d, c = d[order], c[order]
    first = np.concatenate(([True], d[1:] != d[:-1]))
    head = c[first][np.cumsum(first) - 1]
    tie = ~first & (c != head)
    pairs = np.unique(np.stack((head[tie], c[tie]), axis=1), axis=0) if tie.any() else np.empty((0, 2), np.int64)
    own = _mix(_mix(pairs[:, 0].view(np.uint64) + _U(3)) + pairs[:, 1].view(np.uint64))
    d = np.concatenate((d[first], own, own)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(np.concatenate((c[first], pairs[:, 0], pairs[:, 1])))],
                                      names=["digest", "class"])


def _part_rows(docs: DataFrame, frequent: np.ndarray, n: int, p: int, q: int) -> DataFrame:
    """``(digest, class)``: the parts of each text's set, collapsed within a task."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, edges, seen = _Hashes(), band_edges(p, q), set()
        digests, classes, held = [], [], 0
        for batch in batches:
            for t in each(batch.column(0)):
                s = shingle_set(t, n, hashes)
                if not len(s):
                    continue
                c = set_class(s)
                if c in seen:
                    continue
                if len(seen) > 150_000:
                    seen.clear()
                seen.add(c)
                digests.append(part_digests(s, sent.value, edges, p, q))
                classes.append(c)
                held += len(digests[-1])
                if held >= _BATCH:
                    yield _collapsed(digests, classes)
                    digests, classes, held = [], [], 0
        if digests:
            yield _collapsed(digests, classes)

    return docs.select("text").mapInArrow(run, "digest bigint, class bigint")


def _families(parts: DataFrame) -> DataFrame:
    """``(class, family)`` of the classes that have a part in common with another one."""
    first = F.first("class").over(Window.partitionBy("digest").orderBy("class")
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = parts.withColumn("first", first).where(F.col("class") != F.col("first"))
    return components(met, "class", "first").select(F.col("node").alias("class"), F.col("component").alias("family"))


def _tiles(members: DataFrame, p: int, q: int) -> DataFrame:
    """Adds ``tiles`` to ``(class, family, n_shingles, ...)``: (tile, side) pairs, sides 0 and 1 are compared.

    Side 2 is compared with all of its tile.
    """
    edges = [int(e) for e in band_edges(p, q, 1 << 31)]
    band = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("n_shingles"))) - 1
    m = members.withColumn("band", band)
    # members and hashes by band first: a family's total is a sum over few rows
    bands = stored(m.groupBy("family", "band").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("hashes")))
    blocks = lambda rows, hashes: F.greatest(F.ceil(rows / BLOCK), F.ceil(hashes / BLOCK_SHINGLES)).cast("int")
    large = bands.groupBy("family").agg(blocks(F.sum("rows"), F.sum("hashes")).alias("whole")).where("whole > 1")
    cut = stored(bands.join(large, "family").select("family", "band", blocks(F.col("rows"), F.col("hashes")).alias("nb")))
    shifted = lambda by, name: cut.select("family", (F.col("band") + by).alias("band"), F.col("nb").alias(name))
    for by, name in ((0, "own"), (-1, "up"), (1, "down")):
        m = m.join(shifted(by, name), ["family", "band"], "left")
    i = F.pmod(F.xxhash64(F.lit(17), "class"), F.greatest(F.coalesce("own", F.lit(1)), F.lit(1))).cast("int")
    m = m.withColumn("i", i)
    upto = lambda c: F.when(F.coalesce(c, F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda kind, b, x, y, side: F.struct(
        F.concat_ws("/", "family", F.lit(kind), b, x, y).alias("tile"), side.cast("int").alias("side"))
    here = F.col("band")
    own = F.transform(upto("own"), lambda j: tile("o", here, F.least(j, "i"), F.greatest(j, "i"),
                                                  F.when(j == F.col("i"), 2).when(j < F.col("i"), 1).otherwise(0)))
    up = F.transform(upto("up"), lambda j: tile("x", here, F.col("i"), j, F.lit(0)))
    down = F.transform(upto("down"), lambda j: tile("x", here - 1, j, F.col("i"), F.lit(1)))
    alone = F.array(tile("f", F.lit(""), F.lit(""), F.lit(""), F.lit(2)))
    return m.withColumn("tiles", F.when(F.col("own").isNull(), alone).otherwise(F.concat(own, up, down))) \
        .drop("band", "own", "up", "down", "i")


def tile_links(classes: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
    """Links that connect what similarity ``p/q`` connects among a tile's members."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    classes, sides, sets, sizes = classes[order], sides[order], [sets[i] for i in order], sizes[order]
    flips = np.zeros((len(sets), BITS), np.uint8)
    for r, s in enumerate(sets):
        flips[r] = np.bincount((s & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    maps = np.packbits(flips, axis=1).view(np.uint64)
    label, links = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        # partners are no smaller; the largest that still links
        end = int(np.searchsorted(sizes, q * sizes[i] // p, "right"))
        j = np.arange(i + 1, end)
        j = j[(label[j] != label[i]) & ((sides[j] != sides[i]) | (sides[i] == 2))]
        if not len(j):
            continue
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1, dtype=np.int64)  # at most the true difference
        for k in j[apart * (p + q) <= (sizes[j] + sizes[i]) * (q - p)].tolist():
            if label[k] == label[i]:
                continue
            small, large = sets[i], sets[k]
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if q * both >= p * (len(small) + len(large) - both):
                links.append((int(classes[i]), int(classes[k])))
                label[label == label[k]] = label[i]
    return links


def _tile_rows(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``(tile, side, class, shingles)``: the members' sets, once for each of their tiles."""
    d, m = docs.alias("d"), members.alias("m")
    texts = d.join(m, F.col("d.doc_id").eqNullSafe(F.col("m.doc_id"))).select("m.class", "m.tiles", "d.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            out: list = []
            for c, tiles, t in zip(*map(each, batch.columns), strict=True):
                s = shingle_set(t, n, hashes)
                if set_class(s) != c:  # another text under the same doc_id
                    continue
                out += [(x["tile"], x["side"], c, s.tobytes()) for x in tiles]
                if sum(len(x[3]) for x in out[-len(tiles):]) > 1 << 22 or len(out) > 4096:
                    yield _as_rows(out)
                    out = []
            if out:
                yield _as_rows(out)

    return texts.mapInArrow(run, "tile string, side int, class bigint, shingles binary")


def _as_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["tile", "side", "class", "shingles"])


def _compared(tiles: DataFrame, p: int, q: int) -> DataFrame:
    """``(a, b)``: links found in the tiles."""

    def run(batches):
        import pandas as pd

        for g in groups(batches, "tile"):
            g = g.drop_duplicates(["class", "side"])
            found = tile_links(g["class"].to_numpy(), g["side"].to_numpy(),
                               [np.frombuffer(x, np.uint64) for x in g["shingles"]], p, q)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInPandas(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3,
                       similarity: tuple[int, int] = (90, 100)) -> DataFrame:
    """``(doc_id, n_shingles, class, component_id)``: one row per document; a null class without words."""
    p, q = similarity
    d = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(_sets(d, n))
    sets = rows.where("df IS NULL").select("doc_id", "n_shingles", "class")
    most = rows.where("df IS NOT NULL").groupBy("frequent").agg(F.sum("df").alias("df")) \
        .orderBy(F.desc("df"), "frequent").limit(MOST_FREQUENT).select("frequent").toArrow()
    frequent = np.sort(most.column(0).to_numpy().view(np.uint64))
    classes = stored(sets.where("class IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")))
    families = stored(_families(_part_rows(d, frequent, n, p, q)))
    members = _tiles(families.join(classes, "class"), p, q)
    links = stored(_compared(_tile_rows(d, members, n), p, q))
    joined = components(links).select(F.col("node").alias("class"), "component")
    # classes of more than one member or with links; the others are their own component
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("class", "component_id")
    return sets.join(named, "class", "left").select(
        "doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5,
             similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group of near duplicates.

    Documents without words link with nothing and stay; rows that share a kept
    doc_id stay together.
    """
    c = jaccard_components(docs, doc_id, text, n, similarity)
    kept = c.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct().alias("kept")
    return docs.alias("d").join(kept, F.col(f"d.{doc_id}").eqNullSafe(F.col("kept.doc_id")), "left_semi")
