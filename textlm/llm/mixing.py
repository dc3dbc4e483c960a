"""Mixing sources to target weights by multinomial draws over packed blocks.

1. *Targets.*  Sources in code point order, null last, take weights in turn;
   a target is the source's share of all words by weight, but at most
   ``MAX_EPOCHS`` times the source, the excess reshared among the others.
2. *Packing.*  A source's words, its documents in a pseudorandom order, form
   blocks of ``BLOCK`` words (the last may be shorter).  Positions are prefix
   sums over range partitions, so a source with a third of all rows is spread
   over many tasks.
3. *Draws.*  The mix is ``SHARDS`` output shards of equally many slots.  Each
   draws its slots per source: the whole part of the expected counts, and the
   rest by a multinomial draw over the fractions (seeded by the shard).
4. *Indices.*  The j-th slot of a source reads block j of a pseudorandom
   permutation of its blocks (a Feistel network, keyed by source and epoch), so
   that each block is read once an epoch.
5. *Rows.*  Slots are joined by (source, block index) with the blocks' words
   and written as the table of the mix; what the mix takes of each document is
   counted from that table.

Equal seeds and rows give equal mixes, however the rows are split into files.
Sources are a catalogue: one row each, and a few numbers of each go to the
driver and the tasks; beyond ``MAX_SOURCES`` the operator refuses to run.

Defined cases: null text has no words; sizes of 0 take nothing; repeated rows
are packed each; with no words at all every target is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlm.llm.common import stored, tabled
from textlm.session import ensure_checkpoint_dir

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
BLOCK = 32
SHARD_SLOTS = 4096  # slots of an output shard, more where MAX_SHARDS would be passed
MAX_SHARDS = 65_536
TASK_SLOTS = 1 << 24  # slots that one task maps to blocks, about
SEED = 20_240_602
MAX_SOURCES = 100_000
MIX_DIR = "textlm.mix.dir"  # session setting: the folder under which mixes are written
_ROWS = 1 << 16
_U = np.uint64


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``(sid, source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Resharing the excess ends where every source has ``min(cap, weight * level)``;
    sorted by cap / weight, the capped sources come first, which gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name) - 1)
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("w", table[F.col("sid") % len(weights)]).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        .withColumn("level", F.col("left") / F.sum("w").over(after))
    capped = F.col("cap") <= F.col("w") * F.col("level")
    # the level of the first source that is not capped holds for all that follow
    level = F.min(F.when(~capped, F.struct((F.col("cap") / F.col("w")).alias("r"), "sid", "level"))).over(Window.partitionBy())
    return s.select("sid", "source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("w") * level["level"]).alias("target"))


def pack(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, size, part, rid, within, text)`` and ``(source, part, words, base)``.

    ``rid`` is a row's place in the packing order, ``within`` the words of its source before it in its partition.

    The pseudorandom order is that of a hash of (doc_id, text); rows equal in
    both are alike, and which comes first does not matter.  ``base``: words of
    the source in earlier partitions; one row per partition and source in it.
    """
    d = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
                    .cast("bigint").alias("size"), "text", F.xxhash64("doc_id", "text").alias("h"),
                    F.monotonically_increasing_id().alias("tie"))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["source", "h", "doc_id", "size", "tie"]
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rid, within in _numbered(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rid), pa.array(within), batch.column("text")],
                                             names=["doc_id", "source", "size", "part", "rid", "within", "text"])

    # written with its places, so that it may be read in any order
    d = tabled(d.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "size", F.spark_partition_id().alias("part"), "text").mapInArrow(
        run, "doc_id bigint, source string, size bigint, part int, rid bigint, within bigint, text string"))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return d, stored(parts.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of one partition with each row's number and the words of its source before it there."""
    last, total, row = None, 0, 0
    for batch in batches:
        names, sizes = batch.column("source").to_pylist(), batch.column("size").to_numpy(zero_copy_only=False)
        within = np.empty(len(sizes), np.int64)
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if last is None or last[0] != names[a]:
                total = 0
            last = (names[a],)
            up = np.cumsum(sizes[a:b])
            within[a:b] = total + up - sizes[a:b]
            total += int(up[-1])
        part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        yield batch, (part << 33) + row + np.arange(len(sizes)), within
        row += len(sizes)


def cut_pieces(texts: pa.Array, begin: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Texts that each have words, cut where a block ends: row, place of its first word, words and first byte of each piece.

    ``begin``: the place of a text's first word in its source.  The pieces lie
    side by side in the bytes returned and are the texts, each ended by a line
    break: blanks go with the word before them.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.insert(np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets[1:] - offsets[0], 10)
    offsets = offsets - offsets[0] + np.arange(n + 1)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    at = np.flatnonzero(starts)
    first = np.searchsorted(at, offsets)
    row = np.repeat(np.arange(n), np.diff(first))
    place = begin[row] + np.arange(len(at)) - first[row]
    cut = place % block == 0
    cut[first[:-1]] = True
    heads = np.flatnonzero(cut)
    of, edge = row[heads], at[heads]
    whole = np.concatenate(([True], of[1:] != of[:-1]))  # a text's first piece has the blanks before its first word
    edge[whole] = offsets[of[whole]]
    return of, place[heads], np.diff(np.append(heads, len(at))), edge, data.tobytes()


def packed_blocks(packed: DataFrame, parts: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``(sid, block, pieces)``: each block of each source, its pieces in order, as (at, text, rid, doc_id, words)."""
    base = parts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))) \
        .select("b.source", "b.part", "b.base", "t.sid")
    # a row per source and a row per partition at most: MAX_SOURCES bounds what is broadcast, and the order stays
    p, b = packed.alias("p"), F.broadcast(base).alias("b")
    placed = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.part") == F.col("b.part"))) \
        .where("p.size > 0").select("p.doc_id", "p.rid", (F.col("p.within") + F.col("b.base")).cast("bigint").alias("begin"), "p.text", "b.sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = batch.column("begin").to_numpy(zero_copy_only=False)
            row, place, words, edge, data = cut_pieces(batch.column("text"), begin, block)
            number, at = np.divmod(place, block)
            sid = batch.column("sid").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            text = pa.LargeStringArray.from_buffers(
                len(row), pa.py_buffer(np.append(edge, len(data)).astype(np.int64)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid), pa.array(number), pa.array(at), text.cast(pa.string()), batch.column("rid").take(pa.array(row)),
                 batch.column("doc_id").take(pa.array(row)), pa.array(words.astype(np.int64))],
                names=["sid", "block", "at", "text", "rid", "doc_id", "words"])

    pieces = placed.mapInArrow(run, "sid bigint, block bigint, at bigint, text string, rid bigint, doc_id bigint, words bigint")
    # flat rows are shuffled and gathered after that: lists of one or two pieces take more room than the pieces
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "sid", "block").groupBy("sid", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "text", "rid", "doc_id", "words"))).alias("pieces"))


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + _U(key)) * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at ``index``: Feistel rounds, walked until inside."""
    half = _U(max((max(n - 1, 1).bit_length() + 1) // 2, 1))
    low = (_U(1) << half) - _U(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(4):
            left, right = right, left ^ (_mixed(right, key * 4 + r) & low)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _draw(shard: int, slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source in one shard: whole expected counts, fractions by a multinomial draw."""
    expected = slots / shards
    whole = np.floor(expected).astype(np.int64)
    rest = expected - whole
    # as many draws as the fractions sum to, rounded so that all shards together make it up
    upto = lambda k: int(np.floor(rest.sum() * k + 0.5))
    more = upto(shard + 1) - upto(shard)
    if more and rest.sum() > 0:
        whole += np.random.Generator(np.random.PCG64([seed, shard])).multinomial(more, rest / rest.sum())
    return whole


def draw_counts(spark, sources: list[dict], shards: int, seed: int) -> DataFrame:
    """``(shard, sid, slots, first, before, filled)``: slots of a source in a shard, and how many earlier shards hold.

    ``before``: slots of earlier sources in the shard; ``filled``: of all.

    A source's slots end at ``MAX_EPOCHS`` epochs of its blocks, in the last shards if need be.
    """
    slots = np.array([s["slots"] for s in sources], float)
    caps = [s["cap_slots"] for s in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, int(c)) for k in batch.column(0).to_pylist()
                    for i, c in enumerate(_draw(k, slots, shards, seed)) if c]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 names=["shard", "sid", "slots"])

    drawn = spark.range(shards).mapInArrow(run, "shard bigint, sid bigint, slots bigint")
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
    in_shard = Window.partitionBy("shard")
    before = F.sum("slots").over(in_shard.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1))
    placed = {"before": F.coalesce(before, F.lit(0)), "filled": F.sum("slots").over(in_shard)}
    if not caps:
        return drawn.withColumns(placed)
    cap = F.array(*[F.lit(int(c)) for c in caps]) if len(caps) <= 64 else F.from_json(F.lit(str(caps)), "array<bigint>")
    room = F.greatest(cap[F.col("sid").cast("int")] - F.col("first"), F.lit(0))
    return drawn.withColumn("slots", F.least("slots", room).cast("bigint")).where("slots > 0") \
        .withColumns(placed)


def read_slots(counts: DataFrame, sources: list[dict], seed: int) -> DataFrame:
    """``(shard, slot, sid, block)``: the block that each slot reads; slots of a shard are in a pseudorandom order."""
    blocks = [s["blocks"] for s in sources]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sid, n, first, before, filled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, n, _ROWS):
                    here = np.arange(at, min(at + _ROWS, n))
                    epoch, index = np.divmod(first + here, blocks[sid])
                    out = np.empty(len(here), np.int64)
                    for e in np.unique(epoch).tolist():
                        one = epoch == e
                        out[one] = permuted(index[one], blocks[sid], (seed * 1_000_003 + sid) * 64 + e)
                    slot = permuted(before + here, filled, seed * 7_000_003 + shard)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(here), shard)), pa.array(slot), pa.array(np.full(len(here), sid)),
                         pa.array(out)], names=["shard", "slot", "sid", "block"])

    # a slot's index hangs on (source, slot number) alone: long runs are cut, and the pieces dealt to a fixed number
    # of tasks, since their rows are small and adaptive execution would put them all into one
    piece = 8 * _ROWS
    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                int(sum(s["slots"] for s in sources) // TASK_SLOTS) + 1)
    cut = counts.select("*", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / piece).cast("bigint"))).alias("i")).select(
        "shard", "sid", F.least(F.lit(piece), F.col("slots") - F.col("i") * piece).cast("bigint").alias("slots"),
        *[(F.col(c) + F.col("i") * piece).cast("bigint").alias(c) for c in ("first", "before")],
        F.col("filled").cast("bigint").alias("filled")).repartition(tasks, "sid", "first")
    return cut.mapInArrow(run, "shard bigint, slot bigint, sid bigint, block bigint")


def write_mix(docs: DataFrame, path: str | None = None, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS,
              block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``(doc_id, text, source)``, written as a parquet table, and ``(doc_id, source, size, rid, source_size, target)``.

    The table ``(shard, slot, sid, source, block, text, parts, words)`` has one
    row per slot, in no order; ``text`` is the block's pieces of documents, a
    line break after the end of each, ``parts`` are their (rid, doc_id, words).
    It is written to ``path``, else to a new folder under ``MIX_DIR`` of the
    session, else under the shared checkpoint folder, and nothing removes it.
    """
    spark = docs.sparkSession
    packed, parts = pack(docs)
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_epochs))
    listed = targets.orderBy("sid").limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix groups of them")
    sources = []
    for r in listed:
        n = -(-r["source_size"] // block)
        mean = r["source_size"] / n if n else 1.0  # words of a block; the last may be short
        sources.append({"blocks": n, "cap_slots": max_epochs * n, "slots": min(r["target"] / mean, max_epochs * n)})
    shards = min(max(int(np.ceil(sum(s["slots"] for s in sources) / shard_slots)), 1), MAX_SHARDS)
    slots = read_slots(draw_counts(spark, sources, shards, seed), sources, seed)
    names = F.broadcast(targets.select(F.col("sid").cast("bigint").alias("sid"), "source"))  # MAX_SOURCES rows at most
    # what a row of draws stands for is no part of an estimate: unhinted, all blocks would be broadcast
    rows = packed_blocks(packed, parts, targets, block).join(slots.hint("merge"), ["sid", "block"]).join(names, "sid").select(
        "shard", "slot", "sid", "source", "block", F.array_join("pieces.text", "").alias("text"),
        F.transform("pieces", lambda p: F.struct(p["rid"].alias("rid"), p["doc_id"].alias("doc_id"), p["words"].alias("words")))
        .alias("parts")).withColumn(
        "words", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["words"]))
    path = path or f"{spark.conf.get(MIX_DIR, None) or ensure_checkpoint_dir(spark)}/mix-{uuid.uuid4()}"
    rows.write.option("compression", "zstd").parquet(path)
    d, t = packed.select("doc_id", "source", "size", "rid").alias("d"), F.broadcast(targets).alias("t")
    documents = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target")
    return spark.read.schema(rows.schema).parquet(path), documents


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK,
        shard_slots: int = SHARD_SLOTS, seed: int = SEED, path: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, mix_digest)``: what the written mix holds of each document.

    ``taken`` counts its words in the mixed rows; ``mix_digest`` sums a hash of
    (shard, slot, text) over the rows that have some of it.
    """
    mixed, documents = write_mix(docs, path, weights, max_epochs, block, shard_slots, seed)
    row = F.pmod(F.xxhash64("shard", "slot", "text"), F.lit(1 << 31)).alias("row")
    read = mixed.select(row, F.explode("parts").alias("p")).groupBy(F.col("p.rid").alias("rid")).agg(
        F.sum("p.words").alias("taken"), F.sum("row").alias("mix_digest"))
    return documents.join(read.hint("merge"), "rid", "left").select(
        "doc_id", "source", "size", "source_size", "target",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("taken", "mix_digest")])


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "mix_digest")
