"""Substring dedup by content-defined chunks under a gear rolling hash.

A gear hash over the last ``WINDOW`` bytes runs over each text.  A chunk ends
after a blank where the hash falls under a threshold (one word in
``CHUNK_WORDS`` on average), or, far more rarely, after any character, so that
texts without blanks are cut too; a stretch without such a place is cut every
``MAX_CHUNK`` bytes.  Boundaries hang on the bytes just before them alone:
after an insertion the chunks fall into step again.

Chunks are deduplicated by digest: the documents with the smallest doc_id keep
a chunk, all others repeat it, and so does a later place of it in one text.
Runs of neighbouring repeated chunks of ``ANCHOR_WORDS`` words or more are
anchors: each is extended word by word, in both directions, by the hashes of
the words beside the same chunks of each earlier holder: as many as can lie
between the anchor and the place where the next shared chunk would begin
(``_needs``), ``BESIDE`` at most.  What then
has ``MIN_WORDS`` words or more (or ``MIN_CHARS`` characters) is a repeated
passage and is removed; the rest stays (chance and set phrases).

Digests are aggregated on the map side before they are shuffled, and a digest
that a third of all documents hold is one row for each task there.  A bit map of
fixed size then leaves most unshared chunks out of the join back, which adaptive
execution can split.  What is asked of an earlier text is asked once, however
many texts repeat it, so a text is no hot key; only texts that are asked, or
that hold runs, are shuffled, again by bit maps of fixed size.

Defined cases: null and empty texts have no chunks; a null doc_id counts as
the smallest; rows with one doc_id own chunks together (which of their texts
is asked is not said) and do not take them from each other; equal rows get equal results; other columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import Marks, each, fresh, tabled

WINDOW = 32  # bytes under the hash (a power of two)
CHUNK_WORDS = 6
ANY_BYTES = 1024  # a cut after any character, once in so many bytes
MAX_CHUNK = 2048
MIN_WORDS = 12
MIN_CHARS = 20 * MIN_WORDS  # a passage of so many characters counts whatever its words (texts without blanks)
ANCHOR_WORDS = 3  # a run of fewer words is not extended: single words repeat everywhere
ANCHOR_CHARS = 2 * MAX_CHUNK
BESIDE = 64  # words beside a run that are compared; a chunk is seldom longer
BESIDE_CHARS = 4096
SLACK = 8  # of them, words beyond what equal bytes can reach: words count as equal whatever blanks lie between them
DIGEST_BITS = 26  # bits that mark shared digests (8 MB), and texts that a join needs (1 MB)
TEXT_BITS = 23
BLANKS = " \t\n\r\x0b\x0c"
_WORD = re.compile(f"[^{BLANKS}]+")
GEAR_SEED = 20_240_601
_BUFFER = 1 << 20  # bytes hashed at once
_SMALLEST = -(1 << 63)


def gear_table(seed: int = GEAR_SEED) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=np.uint64)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """For each byte the sum of its and its ``WINDOW - 1`` predecessors' gear numbers, shifted by distance."""
    h, step = gear[data], 1
    while step < WINDOW:  # hashes over 2, 4, 8, ... bytes
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    return h


def _needs(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, forced: np.ndarray, words: np.ndarray,
           text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk, how many words left and right of it an earlier text can share without an anchor of its own there.

    Cuts hang on the ``WINDOW`` bytes before them.  Left: were all from ``WINDOW`` bytes before the chunk beside it shared,
    that chunk would be, too.  Right: after a chunk as long as the window, the cuts of what is shared are the same, so the
    next chunk ends it; after a shorter one they are so from ``WINDOW`` bytes on, and a chunk of ``CHUNK_WORDS`` words
    after that is an anchor.  Cuts by ``MAX_CHUNK`` hang on more: beside them the answer is ``BESIDE``.
    """
    a, b = edges[:-1], edges[1:]
    last = np.searchsorted(edges, ends)[text]  # place of the text's end among the edges
    before = np.maximum(np.arange(len(a)) - 1, np.searchsorted(edges, starts)[text])
    low = np.maximum(edges[before] - WINDOW, starts[text])
    left = words[a] - words[low] + SLACK
    left[forced[before]] = BESIDE
    at = np.minimum(np.arange(len(a)) + 2, last)  # the next edge
    short = b - a < WINDOW - 1
    far = np.minimum(np.searchsorted(edges, a + WINDOW), last)
    long = np.where(words[b] - words[a] >= CHUNK_WORDS, np.arange(len(a)), len(a))
    long = np.append(np.minimum.accumulate(long[::-1])[::-1], len(a))
    at = np.where(short, np.maximum(at, np.minimum(long[far] + 1, last)), at)
    right = words[edges[at]] - words[b] + SLACK
    turns = np.concatenate(([0], np.cumsum(forced)))
    right[turns[at + 1] > turns[np.minimum(np.arange(len(a)) + 1, len(turns) - 1)]] = BESIDE  # a forced edge up to there
    return np.minimum(left, BESIDE), np.minimum(right, BESIDE)


def chunk_buffer(data: np.ndarray, starts: np.ndarray, gear: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chunks of the texts that begin at ``starts`` of a buffer: text number, first and last byte, characters, words."""
    return _chunk_buffer(data, starts, gear)[:6]


def _chunk_buffer(data: np.ndarray, starts: np.ndarray, gear: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``chunk_buffer``, and what ``_needs`` takes."""
    n = len(data)
    ends = np.append(starts[1:], n)
    high = gear_hashes(data, gear) >> np.uint64(40)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    lead = (data & 0xC0) != 0x80
    cut = (blank & (high < np.uint64((1 << 24) // CHUNK_WORDS))) | (high < np.uint64((1 << 24) // ANY_BYTES))
    cut &= np.append(lead[1:], True)
    text_of = np.repeat(np.arange(len(starts)), ends - starts)
    cut &= np.arange(n) - starts[text_of] >= WINDOW - 1  # only where the window lies in the text
    edges = np.unique(np.concatenate((np.flatnonzero(cut) + 1, starts, ends)))
    wide, more = np.flatnonzero(np.diff(edges) > MAX_CHUNK), np.empty(0, np.int64)
    if len(wide):
        more = np.concatenate([np.arange(edges[i] + MAX_CHUNK, edges[i + 1], MAX_CHUNK) for i in wide])
        for _ in range(3):  # to the start of a character
            more = np.where((more < n) & ~lead[np.minimum(more, n - 1)], more + 1, more)
        edges = np.unique(np.concatenate((edges, more)))
    a, b = edges[:-1], edges[1:]
    words = np.concatenate(([0], np.cumsum(_word_starts(blank, starts))))
    chars = np.concatenate(([0], np.cumsum(lead)))
    text = text_of[a]
    begin = chars[a] - chars[starts[text]]
    return text, a, b, begin, chars[b] - chars[a], words[b] - words[a], (starts, ends, edges, np.isin(edges, more), words, text)


def _word_starts(blank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a word starts at a byte of texts that begin at ``starts``."""
    fresh_word = ~blank
    fresh_word[1:] &= blank[:-1]
    at_start = starts[starts < len(blank)]
    fresh_word[at_start] = ~blank[at_start]
    return fresh_word


def _texts(column: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows and UTF-8 of a column's non-empty texts, about ``_BUFFER`` bytes at a time."""
    rows, held, n = [], [], 0
    for i, t in enumerate(each(column)):
        if t:
            rows.append(i)
            held.append(t.encode("utf-8", "surrogatepass"))
            n += len(held[-1])
        if n >= _BUFFER:
            yield rows, held
            rows, held, n = [], [], 0
    if rows:
        yield rows, held


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a batch ``(id, key, text)``, a buffer of texts at a time: each chunk's id, key, digest, start, characters,
    words, where the first chunk of the text with its digest starts, and a function that gives ``_needs``."""
    gear, digest = gear_table(), xxhash.xxh3_64_intdigest
    ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    for rows, texts in _texts(batch.column(2)):
        joined = b"".join(texts)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        text, a, b, begin, chars, words, edges = _chunk_buffer(np.frombuffer(joined, np.uint8), starts, gear)
        digests = np.fromiter((digest(joined[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)),
                              np.uint64, len(a)).view(np.int64)
        order = np.lexsort((a, digests, text))
        new = np.ones(len(a), bool)
        new[1:] = (digests[order[1:]] != digests[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        first = np.empty(len(a), np.int64)
        first[order] = begin[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        at = np.asarray(rows)[text]
        yield ids[at], keys[at], digests, begin, chars, words, first, lambda e=edges: _needs(*e)


def chunk_marks(keyed: DataFrame) -> Marks:
    """Marks of the digests that more than one row has; the count goes by half a digest, so a few others are marked, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, digests, begin, _, _, first, _ in _chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array((digests[begin == first] >> 32).astype(np.int32))], names=["half"])

    halves = keyed.mapInArrow(run, "half int").groupBy("half").count().where("count > 1")
    return Marks(halves.select(F.shiftleft(F.col("half").cast("bigint"), 32).alias("h")), DIGEST_BITS)


def marked_places(keyed: DataFrame, marks: Marks) -> DataFrame:
    """``(id, key, start, chars, words, digest, left, right, again)``: the chunks that are marked or that their text holds before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, digests, begin, chars, words, first, needs in _chunks(batch):
                again = first < begin
                some = marks.has(digests) | again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[some].astype(t)) for x, t in zip(
                        (ids, keys, begin, chars, words, digests, *needs(), again),
                        (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int8, np.int8, bool), strict=True)],
                    names=["id", "key", "start", "chars", "words", "digest", "left", "right", "again"])

    return keyed.mapInArrow(run, "id bigint, key bigint, start int, chars int, words int, digest bigint, left tinyint, "
                                 "right tinyint, again boolean")


def repeated_places(keyed: DataFrame) -> DataFrame:
    """``(id, key, start, chars, words, digest, left, right, oid, okey)``: chunks that text (oid, okey) holds earlier.

    That is a text of the smallest id that holds the digest, or the text itself, where it holds it before.
    """
    places = tabled(marked_places(keyed, chunk_marks(keyed)))
    shared = places.where("not again").groupBy("digest").agg(
        F.min("id").alias("oid"), F.max("id").alias("most"), F.min_by("key", "id").alias("okey")).where("oid < most").drop("most")
    found = places.join(shared, "digest", "left")
    other = F.col("oid") != F.col("id")
    return found.where(other | F.col("again")).select(
        "id", "key", "start", "chars", "words", "digest", "left", "right",
        F.when(other, F.col("oid")).otherwise(F.col("id")).alias("oid"),
        F.when(other, F.col("okey")).otherwise(F.col("key")).alias("okey"))


_LEFT, _RIGHT = 0, 1


def _listed(rows: np.ndarray, n: int, **columns: np.ndarray) -> pa.ListArray:
    """Lists of structs for rows 0 to n - 1; ``rows`` says, in order, whose each struct is."""
    flat = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), flat)


def _runs_of(places: pa.ListArray) -> tuple[pa.Array, pa.ListArray, pa.ListArray]:
    """Of each row's places: how many they are, the runs, and the asks."""
    n, sizes = len(places), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start, chars, words, digest, left, right, oid, okey = (
        c.to_numpy(zero_copy_only=False) for c in places.flatten().flatten())
    row = np.repeat(np.arange(n), sizes)
    order = np.lexsort((start, row))
    row, end = row[order], (start + chars)[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[order][1:] != end[:-1])
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(row))[:len(heads)] - 1
    total = np.add.reduceat(words[order], heads) if len(heads) else heads
    begin, stop = start[order][heads], end[tails]
    kept = (total >= ANCHOR_WORDS) | (stop - begin > ANCHOR_CHARS)
    runs = _listed(row[heads][kept], n, start=begin[kept].astype(np.int32), end=stop[kept].astype(np.int32))
    run_of = np.cumsum(first) - 1
    # an owner may hold a part of a run: what it shares can go on to the run's ends and as far beside them as the ends say
    upto = np.concatenate(([0], np.cumsum(words[order], dtype=np.int64)))
    need_left, need_right = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    need_left[order] = left[order][heads][run_of] + upto[:-1] - upto[heads][run_of]
    need_right[order] = right[order][tails][run_of] + upto[tails + 1][run_of] - upto[1:]
    held = np.flatnonzero(kept[run_of])
    place, run_of = order[held], run_of[held]
    by_owner = np.lexsort((start[place], okey[place], oid[place], run_of))
    place, run_of = place[by_owner], run_of[by_owner]
    new = np.ones(len(place), bool)
    new[1:] = (run_of[1:] != run_of[:-1]) | (oid[place][1:] != oid[place][:-1]) | (okey[place][1:] != okey[place][:-1])
    lows = place[new]
    highs = place[np.append(np.flatnonzero(new)[1:], len(place))[:len(lows)] - 1]
    both = np.concatenate((lows, highs))
    side = np.repeat(np.array([_LEFT, _RIGHT], np.int32), len(lows))
    whose = np.repeat(np.arange(n), sizes)[both]
    by_row = np.argsort(whose, kind="stable")
    both, side = both[by_row], side[by_row]
    asks = _listed(whose[by_row], n, digest=digest[both], oid=oid[both], okey=okey[both], side=side,
                   at=(start[both] + np.where(side == _LEFT, 0, chars[both])).astype(np.int32),
                   need=np.minimum(np.where(side == _LEFT, need_left[both], need_right[both]), BESIDE).astype(np.int32))
    return pa.array(sizes.astype(np.int32)), runs, asks


def _runs(places: DataFrame) -> DataFrame:
    """``(id, key, n_repeated, runs, asks)``: runs of neighbouring places, and whose words beside them are asked for.

    Of each earlier text in a run, the words left of its first chunk and right of its last one, ``need`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                ids, keys, places = (c.slice(first, 256) for c in batch.columns)
                yield pa.RecordBatch.from_arrays([ids, keys, *_runs_of(places)], names=["id", "key", "n_repeated", "runs", "asks"])

    place = F.struct("start", "chars", "words", "digest", "left", "right", "oid", "okey")
    # equal rows give equal places: the set holds each once
    return places.groupBy("id", "key").agg(F.collect_set(place).alias("places")).mapInArrow(
        run, "id bigint, key bigint, n_repeated int, runs array<struct<start:int,end:int>>, "
             "asks array<struct<digest:bigint,oid:bigint,okey:bigint,side:int,at:int,need:int>>")


def _beside(text: str, at: int, side: int, need: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` left or right of ``at``, the second, where the first may not have ``need`` words, the longest."""
    for reach in (min(12 * need + 16, BESIDE_CHARS), BESIDE_CHARS):  # most often the nearer words are enough
        yield (max(0, at - reach), at) if side == _LEFT else (at, min(len(text), at + reach))


def words_beside(text: str, at: int, side: int, need: int = BESIDE) -> list[int]:
    """Hashes of up to ``need`` words of ``text`` left or right of ``at``, nearest first.

    The first number says whether a word goes on over ``at``.
    """
    for low, high in _beside(text, at, side, need):
        found = text[low:high].encode("utf-8", "surrogatepass").split()
        if side == _LEFT and low > 0 and found and text[low] not in BLANKS:
            del found[0]  # may be cut off
        if side == _RIGHT and high < len(text) and found and text[high - 1] not in BLANKS:
            del found[-1]
        if len(found) >= need or (low == 0 if side == _LEFT else high == len(text)):
            break
    found = found[::-1][:need] if side == _LEFT else found[:need]
    over = 0 < at < len(text) and text[at - 1] not in BLANKS and text[at] not in BLANKS
    return [int(over), *(zlib.crc32(w) - (1 << 31) for w in found)]


def place_beside(text: str, at: int, side: int, n: int) -> int:
    """Where the ``n``-th word left or right of ``at`` ends, away from it."""
    for low, high in _beside(text, at, side, n):
        found = [m.span() for m in _WORD.finditer(text, low, high)]
        if len(found) > n or (low == 0 if side == _LEFT else high == len(text)):
            break
    return found[-n][0] if side == _LEFT else found[n - 1][1]


def _asked_places(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of a batch ``(.., .., text, asked)``: row, digest, side, need and place of each ask whose digest the row's text has."""
    # the number of a row stands for its id: each row answers for itself
    numbers = pa.array(np.arange(batch.num_rows, dtype=np.int64))
    asked = batch.column(3)
    digest, side, need = (c.to_numpy(zero_copy_only=False) for c in asked.flatten().flatten())
    row = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
    out: list = [(row[:0], digest[:0], side[:0], need[:0], row[:0])]
    for at, _, digests, begin, chars, _, first, _ in _chunks(pa.RecordBatch.from_arrays(
            [numbers, numbers, batch.column(2)], names=["id", "key", "text"])):
        low, high = np.searchsorted(row, [at.min(), at.max() + 1])
        once = np.flatnonzero(begin == first)
        names, code = np.unique(np.concatenate((digests[once], digest[low:high])), return_inverse=True)
        has = at[once] * len(names) + code[:len(once)]
        wanted = row[low:high] * len(names) + code[len(once):]
        by = np.argsort(has)
        found = np.minimum(np.searchsorted(has[by], wanted), len(by) - 1)
        there = np.flatnonzero(has[by][found] == wanted)
        chunk, ask = once[by[found[there]]], low + there
        place = begin[chunk] + np.where(side[ask] == _LEFT, 0, chars[chunk])
        out.append((row[ask], digest[ask], side[ask], need[ask], place))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _answers(keyed: DataFrame, asks: DataFrame) -> DataFrame:
    """``(digest, oid, okey, side, words)``: the words beside the first place of ``digest`` in text (oid, okey)."""
    wanted = asks.groupBy("digest", "oid", "okey", "side").agg(F.max("need").alias("need"))
    asked = tabled(wanted.groupBy("oid", "okey").agg(F.collect_list(F.struct("digest", "side", "need")).alias("asked")))
    marks = Marks(asked.select(F.xxhash64("oid", "okey").alias("h")), TEXT_BITS)
    holders = keyed.where(marks.column(F.xxhash64("id", "key"))).select(F.col("id").alias("oid"), F.col("key").alias("okey"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, digest, side, need, place = _asked_places(batch)
            cuts, held = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist(), []
            for i, text in enumerate(each(batch.column(2))):
                a, b = cuts[i], cuts[i + 1]
                held += [words_beside(text, p, s, n) for p, s, n in zip(
                    place[a:b].tolist(), side[a:b].tolist(), need[a:b].tolist(), strict=True)]
                if held and (len(held) >= 1 << 15 or i + 1 == batch.num_rows):
                    some = slice(b - len(held), b)
                    whose = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[some]), batch.column(0).take(whose), batch.column(1).take(whose), pa.array(side[some]),
                         pa.array(held, pa.list_(pa.int32()))], names=["digest", "oid", "okey", "side", "words"])
                    held = []

    found = holders.join(asked, ["oid", "okey"]).select("oid", "okey", "text", "asked")
    return found.mapInArrow(run, "digest bigint, oid bigint, okey bigint, side int, words array<int>").distinct()


def extended(text: str, runs: list[tuple], ways: list[tuple], min_words: int) -> list[dict]:
    """Runs (start, end) extended by whole words that an earlier text has, too, and merged.

    ``ways``: places (at, side), how many words beside them count, and the earlier text's, as ``words_beside`` gives them.
    """
    spans, own = list(runs), {}
    for at, side, need, words in ways:
        mine = own.get((at, side))
        if mine is None or mine[0] < need:
            mine = own[at, side] = need, words_beside(text, at, side, need)
        same = 0
        for x, y in zip(mine[1], words, strict=False):
            if x != y:
                break
            same += 1
        if same > 1:
            place = place_beside(text, at, side, same - 1)
            spans.append((place, at) if side == _LEFT else (at, place))
    out: list[list[int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1]:
            out[-1][1] = max(q, out[-1][1])
        else:
            out.append([p, q])
    found = []
    for p, q in out:
        words = len(text[p:q].encode("utf-8", "surrogatepass").split())
        words -= p > 0 and text[p - 1] not in BLANKS and text[p] not in BLANKS  # a word that starts before
        if words >= min_words or q - p >= MIN_CHARS:
            found.append({"start": p, "chars": q - p, "words": words})
    return found


def _lists(column: pa.ListArray) -> Iterator[list | None]:
    """The values of a column of lists: of structs as tuples, of numbers as they are."""
    flat = column.flatten()
    if pa.types.is_struct(flat.type):
        fields = [list(_lists(f)) if pa.types.is_list(f.type) else f.to_numpy(zero_copy_only=False).tolist() for f in flat.flatten()]
        values: list = list(zip(*fields, strict=True))
    else:
        values = flat.to_numpy(zero_copy_only=False).tolist()
    at = 0
    for n in column.value_lengths().to_pylist():
        yield None if n is None else values[at:at + n]
        at += n or 0


_PASSAGES = "array<struct<start:int,chars:int,words:int>>"


def _passages(text: Column, runs: Column, ways: Column, min_words: int) -> Column:
    """The passages to remove, as (start, chars, words) in characters (null runs: null)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("chars", pa.int32()), ("words", pa.int32())]))

    def run(texts: pa.Array, held: pa.Array, beside: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 256):
            rows = zip(texts.slice(at, 256).to_pylist(), _lists(held.slice(at, 256)), _lists(beside.slice(at, 256)), strict=True)
            out += [None if r is None else extended(t, r, w or [], min_words) for t, r, w in rows]
        return pa.array(out, kind)

    run.__annotations__ = {"texts": pa.Array, "held": pa.Array, "beside": pa.Array, "return": pa.Array}
    f = F.arrow_udf(run, _PASSAGES).asNondeterministic()  # run once, not per use
    return f(F.when(runs.isNotNull(), text), runs, ways)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_SMALLEST)).alias("id"),
                       F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"))


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, key, n_repeated, runs, ways)`` of documents with repeated chunks; ``runs`` and ``ways`` as ``extended`` takes them."""
    keyed = _keyed(docs, doc_id, text)
    found = tabled(_runs(repeated_places(keyed)))
    asks = found.select("id", "key", F.explode("asks").alias("a")).select("id", "key", "a.*")
    names = ["digest", "oid", "okey", "side"]
    answers = _answers(keyed, asks.select(*names, "need"))
    words = F.slice("words", 1, F.col("need") + 1).alias("words")
    ways = asks.join(answers, names).groupBy("id", "key").agg(F.collect_set(F.struct("at", "side", "need", words)).alias("ways"))
    return tabled(found.drop("asks").join(ways, ["id", "key"], "left"))


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns, the repeated passages cut from the texts; emptied documents go."""
    i, k, r, w, p = fresh(docs, "id_", "key_", "runs_", "ways_", "passages_")
    found = repeated_runs(docs, doc_id, text).where(F.size("runs") > 0)
    marks = Marks(found.select(F.xxhash64("id", "key").alias("h")), TEXT_BITS)
    named = found.select(*[F.col(a).alias(b) for a, b in (("id", i), ("key", k), ("runs", r), ("ways", w))])
    keyed = docs.withColumn(i, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_SMALLEST))).withColumn(k, F.xxhash64(F.col(text)))
    marked = marks.column(F.xxhash64(i, k))
    own = keyed.where(marked).join(named, [i, k], "left").withColumn(p, _passages(F.col(text), F.col(r), F.col(w), min_words))
    uncut = F.coalesce(F.size(p), F.lit(0)) <= 0
    left = F.when(uncut, F.col(text)).otherwise(_cut(F.col(text), F.col(p)))
    cut = own.withColumn(text, left).where(uncut | (F.trim(F.col(text)) != ""))
    return cut.select(*docs.columns).union(keyed.where(~marked).select(*docs.columns))  # unmarked texts have no runs and stay where they are


def _cut(text: Column, passages: Column) -> Column:
    """The text without its passages: what lies between them, joined."""
    ends = F.concat(F.array(F.lit(0)), F.transform(passages, lambda s: s["start"] + s["chars"]))
    starts = F.concat(F.transform(passages, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a + 1, b - a)), "")


def _n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        for rows, held in _texts(texts):
            data, starts = np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held[:-1])])
            blank = (data == 32) | ((data >= 9) & (data <= 13))
            out[rows] = np.add.reduceat(_word_starts(blank, starts), starts, dtype=np.int64)
        return pa.array(out)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(text)


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: its words, repeated chunks, and what is removed."""
    d = _keyed(docs, "doc_id", "text")
    found = repeated_runs(docs)
    with_runs = found.where(F.size("runs") > 0).select("id", "key", "runs", "ways")
    marks = Marks(with_runs.select(F.xxhash64("id", "key").alias("h")), TEXT_BITS)
    cut = d.where(marks.column(F.xxhash64("id", "key"))).join(with_runs, ["id", "key"]).select(
        "id", "key", _passages(F.col("text"), F.col("runs"), F.col("ways"), MIN_WORDS).alias("passages"))
    total = lambda f: F.aggregate("passages", F.lit(0).cast("bigint"), lambda a, s: a + s[f])
    removed = cut.select("id", "key", F.size("passages").cast("bigint").alias("n_passages"),
                         total("words").alias("removed_words"), total("chars").alias("removed_chars")).distinct()
    zero = ["n_repeated_chunks", "n_passages", "removed_words", "removed_chars"]
    j = d.select("id", "key", _n_words(F.col("text")).alias("n_words")) \
        .join(found.select("id", "key", F.col("n_repeated").cast("bigint").alias("n_repeated_chunks")), ["id", "key"], "left") \
        .join(removed, ["id", "key"], "left").fillna(0, zero)
    return j.select(F.when(F.col("id") != _SMALLEST, F.col("id")).alias("doc_id"), "n_words", *zero,
                    (F.col("n_passages") > 0).alias("has_repeats"))
