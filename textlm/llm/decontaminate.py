"""Benchmark decontamination with one FM-index per shard of training documents.

A *window* is ten consecutive words of a benchmark text (a text of fewer words
is one window).  Each task cuts its documents into shards of about
``SHARD_WORDS`` words (a document is never cut) and builds for each an
FM-index over words: suffix array, Burrows-Wheeler transform, wavelet matrix
for ranks, and every ``SAMPLE``-th suffix position.  All windows are searched
backwards at once, occurrences located by LF steps to a sampled position, and
their spans merged per document.

Words that no window holds cannot lie in an occurrence.  They end a run of
words that some window holds; runs shorter than the shortest window are left
out of the index, the others are kept whole.

Windows reach the tasks in blocks of at most ``BLOCK_WORDS`` benchmark words,
so what is shipped is bounded; with more than one block each block scans all
documents and the spans are merged by document.  A word or item shared by many
documents meets no shuffle key: with one block there is no shuffle at all.

Defined cases: null text has no words; benchmark rows with a null item_id or
no words take no part; repeated item_ids count once; repeated documents each
get their result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import alnum_words, each, fresh, text_key

WINDOW = 10
SHARD_WORDS = 500_000
SAMPLE = 16
BLOCK_WORDS = 2_000_000
_RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SCAN = "n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<first:int,last:int>>"


class FMIndex:
    """Backward search and locate over an array of symbols; 0 ends the text, 1 separates runs."""

    def __init__(self, text: np.ndarray, symbols: int):
        sa = _suffix_array(text)
        bwt = text[sa - 1]
        self.levels, self.zeros, cur = [], [], bwt
        bits = (symbols - 1).bit_length()
        for b in range(bits - 1, -1, -1):  # wavelet matrix: zero counts before each place, by bit
            one = (cur >> b) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(one == 0))))
            self.zeros.append(int(self.levels[-1][-1]))
            cur = np.concatenate((cur[one == 0], cur[one == 1]))
        self.bits = bits
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << bits))))
        self.first = self._down(np.arange(1 << bits), np.zeros(1 << bits, dtype=np.int64))
        self.sampled = sa % SAMPLE == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]
        self.n = len(text)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1
            low = self.levels[k][at]
            at = np.where(one == 1, self.zeros[k] + at - low, low)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``at`` places of the transform."""
        return self._down(symbol, at) - self.first[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one place further left."""
        at, symbol = row, np.zeros_like(row)
        for k in range(self.bits):
            low = self.levels[k][at]
            one = (self.levels[k][at + 1] == low).astype(np.int64)
            symbol = symbol * 2 + one
            at = np.where(one == 1, self.zeros[k] + at - low, low)
        return self.before[symbol] + at - self.first[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (right-aligned rows), all at once, last word first."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            s = patterns[live, width - 1 - step]
            lo[live] = self.before[s] + self.rank(s, lo[live])
            hi[live] = self.before[s] + self.rank(s, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        while len(go := np.flatnonzero(~self.sampled[row])):
            row[go] = self.back(row[go])
            steps[go] += 1
        return self.samples[self.slot[row]] + steps


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Rows sorted by prefix doubling, with work only where a tie is left."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    k = 1
    while not starts.all():
        alone = starts & np.concatenate((starts[1:], [True]))
        open_at = np.flatnonzero(~alone)
        rows = order[open_at]
        after = np.where(rows + k < n, rank[np.minimum(rows + k, n - 1)], -1)
        by = np.lexsort((after, rank[rows]))
        rows, after, old = rows[by], after[by], rank[rows][by]
        order[open_at] = rows
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (after[1:] != after[:-1])))
        starts[open_at] = new
        rank[rows] = np.maximum.accumulate(np.where(new, open_at, 0))
        k *= 2
    return order


class _Windows:
    """The windows of one block of benchmark items, as symbols from 2 on."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.symbol: dict[bytes, int] = {}
        of: dict[tuple, set] = {}
        for item, words in items:
            ids = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                of.setdefault(tuple(ids[i:i + size]), set()).add(item)
        self.lengths = np.array([len(k) for k in of] or [0], np.int64)
        self.shortest = int(self.lengths.min())
        self.patterns = np.zeros((len(of), int(self.lengths.max())), np.int64)
        for r, k in enumerate(of):
            self.patterns[r, -len(k):] = k
        self.items = [sorted(v) for v in of.values()]

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """For each document its items and merged spans of word positions (last exclusive)."""
        get, text, doc_at, word_at = self.symbol.get, [], [], []
        for d, words in enumerate(docs):
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= self.shortest:
                    text += [ids[a:b], [1]]
                    doc_at += [np.full(b - a, d), [d]]
                    word_at += [np.arange(a, b), [b]]
        out: list = [([], []) for _ in docs]
        if not text or not self.items:
            return out
        index = FMIndex(np.concatenate([*text, [0]]).astype(np.int64), len(self.symbol) + 2)
        doc_at, word_at = np.concatenate(doc_at), np.concatenate(word_at)
        lo, hi = index.search(self.patterns, self.lengths)
        many = hi - lo
        if not many.any():
            return out
        which = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = index.locate(rows)
        found: dict[int, tuple[set, list]] = {}
        for d, w, start in zip(doc_at[at].tolist(), which.tolist(), word_at[at].tolist(), strict=True):
            items, spans = found.setdefault(d, (set(), []))
            items.update(self.items[w])
            spans.append((start, start + int(self.lengths[w])))
        for d, (items, spans) in found.items():
            out[d] = (sorted(items), merge_spans(spans))
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list]:
    """Benchmark items in blocks of about ``block_words`` words, read row by row (never all at once)."""
    block, n = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for r in rows.toLocalIterator():
        words = alnum_words(r["t"])
        if words:
            block.append((r["i"], words))
            n += len(words)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _shards(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of the batches of about SHARD_WORDS words, with their texts and words."""
    for batch in batches:
        texts, words, n, at = [], [], 0, 0
        for i, t in enumerate(each(batch.column(column))):
            texts.append(t)
            words.append(alnum_words(t))
            n += len(words[-1])
            if n >= SHARD_WORDS or i == len(batch) - 1:
                yield batch.slice(at, i + 1 - at), texts, words
                texts, words, n, at = [], [], 0, i + 1


def _scan(docs: DataFrame, block: list, window: int) -> DataFrame:
    """``docs`` (its last column the text, which is dropped) with the figures of one block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kept, text = docs.columns[:-1], docs.columns[-1]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(sent.value, window)
        for part, _, words in _shards(batches, text):
            found = windows.scan(words)
            yield pa.RecordBatch.from_arrays([
                *[part.column(c) for c in kept],
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([sum(b - a for a, b in s) for _, s in found], pa.int64()),
                pa.array([i for i, _ in found], pa.list_(pa.int64())),
                pa.array([[{"first": a, "last": b} for a, b in s] for _, s in found], span),
            ], names=[*kept, "n_words", "n_hit", "items", "spans"])

    head = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes[:-1])
    return docs.mapInArrow(run, f"{head}, {_SCAN}")


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans)``: one row per document; spans are merged word positions."""
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    first = next(blocks, [])
    second = next(blocks, None)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if second is None:
        return _scan(d, first, window)
    # several blocks: the figures of each, merged by document (equal rows are told apart by their count)
    d = d.select("doc_id", *[k.alias(f"k{i}") for i, k in enumerate(text_key("doc_id", "text"))], "text")
    parts = [_scan(d, b, window).withColumn("copy", F.lit(n)) for n, b in enumerate(_chain([first, second], blocks))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = every.groupBy("doc_id", "k0", "k1").agg(
        F.max("n_words").alias("n_words"), F.sum((F.col("copy") == 0).cast("int")).alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))

    def joined(acc, s):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (s["first"] <= last["last"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))) \
            .otherwise(F.concat(acc, F.array(s)))

    spans = F.aggregate("spans", F.array().cast("array<struct<first:int,last:int>>"), joined)
    out = merged.withColumn("spans", spans).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"]))
    return out.select("doc_id", "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), "rows")).alias("r")) \
        .drop("r")


def _chain(first: list, rest: Iterator) -> Iterator:
    yield from first
    yield from rest


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                     item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with its columns, the spans of benchmark words cut from the texts.

    A text is cut from the first to the last character of a span's words;
    texts without a hit stay as they are, and a document of which no word is
    left goes.  Each block of windows is one pass over the whole texts; the
    spans of all are merged and cut after the last.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    block = next(blocks, None)
    if block is None:
        return docs
    out, held = docs, fresh(docs, "spans")[0]
    while (after := next(blocks, None)) is not None:
        out, block = _mark(out, block, text, window, held), after
    return _cut(out, block, text, window, held)


def _found(part: pa.RecordBatch, words: list, windows: _Windows, held: str) -> list[list[tuple[int, int]]]:
    """Spans of one block in each text, merged with those that earlier blocks left in column ``held``, if it is there."""
    spans = [s for _, s in windows.scan(words)]
    if held not in part.schema.names:
        return spans
    return [merge_spans([*s, *((x["first"], x["last"]) for x in h)])
            for s, h in zip(spans, each(part.column(held)), strict=True)]


def _mark(docs: DataFrame, block: list, text: str, window: int, held: str) -> DataFrame:
    """``docs`` with the spans of this and earlier blocks in column ``held``."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in docs.columns if c != held]
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(sent.value, window)
        for part, _, words in _shards(batches, text):
            spans = [[{"first": a, "last": b} for a, b in s] for s in _found(part, words, windows, held)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(spans, span)], names=[*kept, held])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != held)
    return docs.mapInArrow(run, f"{schema}, `{held}` array<struct<first:int,last:int>>")


def _cut(docs: DataFrame, block: list, text: str, window: int, held: str) -> DataFrame:
    """``docs`` without column ``held``, its spans and those of the last block cut from the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    (gone,) = fresh(docs, "gone")
    kept = [c for c in docs.columns if c != held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(sent.value, window)
        for part, texts, words in _shards(batches, text):
            found = _found(part, words, windows, held)
            new = [cut_text(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            empty = [bool(s) and sum(b - a for a, b in s) == len(w) for w, s in zip(words, found, strict=True)]
            arrays = [pa.array(new, part.column(c).type) if c == text else part.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(empty)], names=[*kept, gone])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != held) + f", `{gone}` boolean"
    return docs.mapInArrow(run, schema).where(~F.col(gone)).drop(gone)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its words ``[first, last)`` of each span."""
    places = [m.span() for m in _RAW_WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: hit words, and the digest of the items whose windows occur in it."""
    s = scan_benchmark(docs, benchmark)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return s.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text,''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i+l-1],' ') AS k FROM
    (SELECT item_id, w, least(len(w),{WINDOW}) AS l, unnest(range(1, len(w)-least(len(w),{WINDOW})+2)) AS i
     FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, l, i, array_to_string(w[i:i+l-1],' ') AS k FROM
    (SELECT rid, w, l, unnest(range(1, len(w)-l+2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
h AS (SELECT rid, i, l, item_id FROM dw JOIN win USING (l, k)),
hw AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i+l)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
    FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n,0)::BIGINT AS n_hit, coalesce(n_items,0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n,0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)"""
