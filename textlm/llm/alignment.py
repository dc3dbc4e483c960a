"""Alignment of two tokenizers over the bytes of each text, with Arrow tables.

1. *Words.*  A blank and the text are cut before each run of blanks that stands
   between signs: both vocabularies cut there too (checked when they are read;
   else a text stays whole).  The words of a buffer of texts are dictionary
   encoded, so that each different one is encoded and aligned once.
2. *Ends.*  Token lists are flattened with their parents' numbers, token lengths
   taken from a table and summed per parent: (word, end) is a token's key.
3. *Join.*  An outer hash join on those keys gives every place where some token
   ends; sorted, and with gaps filled from behind, each is a link: the pair of
   tokens that share the bytes before it.  Keys on both sides end a group.
4. *Counts.*  Links are counted by id pair in each buffer; Spark merges the counts.
5. *Back.*  Documents are written once in blocks of about ``BLOCK_BYTES``; the
   pairs of a block are joined with their counts and travel ahead of its
   documents to the task that sums them up, so that no task holds more than the
   pairs of one block and no table of all pairs is broadcast.

The vocabulary files are parameters, read where the query is built and shipped
to the tasks (their size is fixed).

Defined cases: texts null, empty, or not given back by one of the tokenizers
have no tokens, zeros, and '' for the groups; repeated rows count each; other
columns are not read.  A very long text is cut into words as any other.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import each, tabled
from textlm.llm.pieces import fields
from textlm.llm.tokencounts import PATTERN

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 64 << 20
_BUFFER = 4 << 20  # characters of text aligned at once
_FLUSH = 1 << 20  # pairs that a task gathers before it sends them on
_SIGN = "▁"  # fixed value: the sign for a blank in B
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Coders:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, vocabulary_a: bytes, model_b: bytes, pattern: str = PATTERN) -> None:
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        model = json.loads(vocabulary_a)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        # the vocabulary is in the order of its merges, so that ids are ranks
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        held = [b""] * (max(ranks.values()) + 1)
        for w, i in ranks.items():
            held[i] = w
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelled = re.compile("<0x([0-9A-F]{2})>")
        of_b = [bytes.fromhex(m[1]) if self.b.is_byte(i) and (m := spelled.fullmatch(p)) else p.replace(_SIGN, " ").encode()
                for i, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(held, pa.binary()), pa.array(of_b, pa.binary())
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in side], np.int64) for side in (held, of_b))
        # no token of B has a blank after another sign, and B merges as it stands (A's pattern cuts before a word's blank)
        plain = not any(value for name, spec in fields(model_b) if name == 3 for k, value in fields(spec) if k in (2, 4))
        self.cut = re.compile(r"(?<=\S)(?= +[^ ])") if plain and not any(_SIGN in p.lstrip(_SIGN) for p in pieces) else None

    def words(self, text: str) -> list[str]:
        return self.cut.split(" " + text) if self.cut else [" " + text]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.a.encode_ordinary(w) for w in words], self.b.encode([w[1:] for w in words], num_threads=1)


def _tokens(lists: list[list[int]], sizes: np.ndarray, table: pa.Array, words: pa.Array) -> tuple[pa.Table, np.ndarray]:
    """``(key, token)`` of one side's tokens, and which words its tokens give back."""
    held = pa.array(lists, pa.list_(pa.int32()))
    flat, parent = pc.list_flatten(held), pc.list_parent_indices(held).to_numpy()
    ends = np.cumsum(sizes[flat.to_numpy()])
    counts = pc.list_value_length(held).to_numpy()
    last = np.concatenate(([0], ends))[np.cumsum(counts)]
    ends -= np.concatenate(([0], last[:-1]))[parent]  # summed per word
    joined = pc.binary_join(pa.ListArray.from_arrays(held.offsets, pc.take(table, flat)), pa.scalar(b"", pa.binary()))
    whole = pc.equal(joined, words.cast(pa.binary())).to_numpy(zero_copy_only=False)
    return pa.table({"key": (parent.astype(np.int64) << 32) | ends, "token": flat}), whole


class Aligned:
    """A buffer of texts: their words, and the links and groups of each different word."""

    def __init__(self, coders: Coders, texts: list[str | None]) -> None:
        cut = pa.array([coders.words(t) if t else [] for t in texts], pa.list_(pa.string()))
        flat = pc.list_flatten(cut).dictionary_encode()
        self.n, self.parent = len(texts), pc.list_parent_indices(cut).to_numpy()
        self.word, words = flat.indices.to_numpy(), flat.dictionary
        self.n_words = len(words)
        lists = coders.encode(words.to_pylist())
        a, whole_a = _tokens(lists[0], coders.sizes_a, coders.bytes_a, words)
        b, whole_b = _tokens(lists[1], coders.sizes_b, coders.bytes_b, words)
        self.whole = np.ones(self.n, bool)
        self.whole[self.parent[~(whole_a & whole_b)[self.word]]] = False  # a text goes with one word
        a, b = (t.filter(pa.array((whole_a & whole_b)[t["key"].to_numpy() >> 32])) for t in (a, b))
        live = self.whole[self.parent]
        self.word, self.parent = self.word[live], self.parent[live]
        self.times = np.bincount(self.word, minlength=self.n_words)  # of each word in these texts
        a = a.append_column("ia", pa.array(np.arange(len(a), dtype=np.int32)))
        b = b.append_column("ib", pa.array(np.arange(len(b), dtype=np.int32)))
        ends = a.drop_columns("token").join(b.drop_columns("token"), "key", join_type="full outer", use_threads=False)
        ends = ends.take(pc.sort_indices(ends["key"])).combine_chunks()
        self.both = pc.and_(pc.is_valid(ends["ia"]), pc.is_valid(ends["ib"])).to_numpy()
        # the token over the bytes before an end is the next one that ends there or later
        self.a = pc.take(a["token"], pc.fill_null_backward(ends["ia"])).to_numpy().astype(np.int64)
        self.b = pc.take(b["token"], pc.fill_null_backward(ends["ib"])).to_numpy().astype(np.int64)
        self.key = ends["key"].to_numpy()
        self.link_word = self.key >> 32
        self.sides = a, b

    def pair_counts(self) -> pa.Table:
        """``(a, b, n_sum)``: links of the texts by id pair."""
        links = pa.table({"a": self.a, "b": self.b, "n": self.times[self.link_word]})
        return links.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")])

    def look_up(self, pair: np.ndarray, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each link's count, and whether it is its B id's highest, from sorted pairs (0 in words of dropped texts alone)."""
        used = np.flatnonzero(self.times[self.link_word])
        at = np.searchsorted(pair, (self.a[used] << 32) | self.b[used])
        out = np.zeros((2, len(self.link_word)), np.int64)
        out[0, used], out[1, used] = count[at], best[at]
        return out[0], out[1]

    def _by_text(self, per_word: np.ndarray) -> np.ndarray:
        t = pa.table({"text": self.parent, "x": per_word[self.word]}).group_by("text", use_threads=False).aggregate([("x", "sum")])
        out = np.zeros(self.n, np.int64)
        out[t["text"].to_numpy()] = t["x_sum"].to_numpy()
        return out

    def totals(self, count: np.ndarray, best: np.ndarray) -> list[np.ndarray]:
        """The columns ``_COUNTS`` of each text, from each link's count and whether that is its B id's highest."""
        n_a, n_b = (np.bincount(s["key"].to_numpy() >> 32, minlength=self.n_words) for s in self.sides)
        by_word = pa.table({"w": self.link_word, "g": self.both.astype(np.int64), "best": best.astype(np.int64), "c": count}) \
            .group_by("w", use_threads=False).aggregate([("g", "sum"), ("g", "count"), ("best", "sum"), ("c", "sum")])
        columns = []
        for name in ("g_sum", "g_count", "best_sum", "c_sum"):
            x = np.zeros(self.n_words, np.int64)
            x[by_word["w"].to_numpy()] = by_word[name].to_numpy()
            columns.append(x)
        return [self._by_text(x) for x in (n_a, n_b, *columns)]

    def groups(self) -> list[str]:
        """The groups of each text, as ``a1,a2|b1;a3|b2,b3``."""
        ends = np.flatnonzero(self.both)
        end_keys = self.key[ends]
        sides = []
        for side in self.sides:
            upto = np.searchsorted(side["key"].to_numpy(), end_keys, side="right")
            ids = side["token"].combine_chunks().cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), ids)
            sides.append(pc.binary_join(lists, ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        upto = np.searchsorted(self.link_word[ends], np.arange(self.n_words), side="right")
        of_word = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), groups), ";")
        first = np.searchsorted(self.parent, np.arange(self.n + 1))
        words = pc.take(of_word, pa.array(self.word))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), words), ";").to_pylist()


def _buffers(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """First rows and texts of a batch, about ``_BUFFER`` characters at a time."""
    first, held, n = 0, [], 0
    for i, t in enumerate(each(batch.column(column))):
        held.append(t)
        n += len(t or "")
        if n >= _BUFFER:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _blocks(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """``(block, doc_id, text)``, written once: a block is a stretch of one partition."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            up = before + np.cumsum(batch.column(3).to_numpy())
            before = int(up[-1]) if len(up) else before
            block = (batch.column(0).to_numpy().astype(np.int64) << 32) | (up // block_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(1), batch.column(2)], names=["block", "doc_id", "text"])

    d = docs.select(F.spark_partition_id().alias("part"), F.col(doc_id).cast("bigint").alias("doc_id"),
                    F.col(text).alias("text"), size.cast("bigint").alias("size"))
    return tabled(d.mapInArrow(run, "block bigint, doc_id bigint, text string"))


def _pair_counts(blocks: DataFrame, files: tuple) -> DataFrame:
    """``(block, a, b, n)``: links of each block by id pair, in one or a few rows a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, held, at = Coders(*files[0].value), [], None

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("n_sum", "sum")])
                held.clear()
                for part in t.append_column("block", pa.array(np.full(len(t), at, np.int64))).select(
                        ["block", "a", "b", "n_sum_sum"]).rename_columns(["block", "a", "b", "n"]).to_batches():
                    yield part

        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if at != keys[x]:
                    yield from sent()
                    at = int(keys[x])
                for _, texts in _buffers(batch.slice(x, y - x), 1):
                    held.append(Aligned(coders, texts).pair_counts())
                    if sum(map(len, held)) > _FLUSH:
                        yield from sent()
        yield from sent()

    return blocks.select("block", "text").mapInArrow(run, "block bigint, a bigint, b bigint, n bigint")


_OUT = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", groups string"


def _sums(rows: DataFrame, files: tuple, digest: bool) -> DataFrame:
    """Results of documents, from rows ``(block, a, b, count, best, doc_id, text)`` sorted by block, its pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, held, at, ready = Coders(*files[0].value), [], None, None
        for batch in batches:
            keys, is_pair = batch.column(0).to_numpy(), pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(is_pair.astype(np.int8)) != 0)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                part = batch.slice(x, y - x)
                if at != keys[x]:
                    at, held, ready = int(keys[x]), [], None
                if is_pair[x]:
                    held.append([part.column(c).to_numpy() for c in range(1, 5)])
                    continue
                if ready is None:
                    a, b, n, best = (np.concatenate(c) for c in zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 4
                    pair = (a << 32) | b
                    order = np.argsort(pair)
                    ready, held = (pair[order], n[order], best[order]), []
                for first, texts in _buffers(part, 6):
                    found = Aligned(coders, texts)
                    count, best = found.look_up(*ready)
                    groups = found.groups()
                    if digest:
                        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(5).slice(first, len(texts)), *map(pa.array, found.totals(count, best)),
                         pa.array(groups, pa.string())], names=["doc_id", *_COUNTS, "groups"])

    return rows.mapInArrow(run, _OUT)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_a: str = VOCABULARY_A,
          model_b: str = MODEL_B, block_bytes: int = BLOCK_BYTES, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: per document ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``, and
    per id pair ``(a, b, count, best)`` over all documents.

    ``digest``: the SHA-256 of the groups in place of their text.
    """
    spark = docs.sparkSession
    with open(vocabulary_a, "rb") as fa, open(model_b, "rb") as fb:
        files = (spark.sparkContext.broadcast((fa.read(), fb.read())),)
    blocks = _blocks(docs, doc_id, text, block_bytes)
    partial = tabled(_pair_counts(blocks, files))
    total = tabled(partial.groupBy("a", "b").agg(F.sum("n").alias("count")))
    top = total.groupBy("b").agg(F.max("count").alias("top"))
    pairs = total.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).cast("bigint").alias("best"))
    mine = partial.select("block", "a", "b").join(pairs, ["a", "b"]).select("block", "a", "b", "count", "best")
    rows = mine.withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")}).unionByName(
        blocks.withColumns({c: F.lit(None).cast("bigint") for c in ("a", "b", "count", "best")}))
    sent = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block") \
        .sortWithinPartitions("block", F.col("a").isNull())
    return _sums(sent.select("block", "a", "b", "count", "best", "doc_id", "text"), files, digest), pairs


def alignment_report(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """One row per document, its groups as a digest."""
    found, _ = align(docs, vocabulary_a=vocabulary_a, model_b=model_b, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
