"""SentencePiece encoding with byte spans, and decoding.

1. *Normalisation.*  At each place the longest key of the model's compiled
   character map (a double-array trie) that the text begins with is replaced
   by its value; without one a character stands for itself.  Each byte made
   remembers the byte of the text that it came from.  Blanks become U+2581, one
   is set before the text, and repeated ones go, as the model's flags say.
2. *Segmentation.*  The model, its own normalisation switched off, merges the
   normalised text into pieces.
3. *Projection.*  Piece ends are running sums of piece lengths in the normalised
   text; the remembered places turn them into spans of the original bytes.  A
   character that is spelled in byte pieces belongs to the last of them.

The model file is a parameter, read where the query is built and shipped to the
tasks (its size is fixed).  A task holds one buffer of texts.

Defined cases: null and empty texts have the begin and end ids alone; very long
texts are encoded whole; repeated rows give repeated rows; other columns are
not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlm.llm.common import each

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN = "▁"  # fixed value: the sign for a blank
# Field numbers of the model file, and the types of its pieces.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_MAP, _PREFIX, _SQUEEZE, _ESCAPE, _SUFFIX = 2, 3, 4, 5, 24
_USER, _BYTE = 4, 6


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of an encoded message (numbers as they stand, all else as bytes)."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = blob[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(blob):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, blob[at:at + size]
            at += size


class CharacterMap:
    """A compiled map from byte strings to byte strings: a double-array trie and the values it points into."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size:]
        root = self._base(0) if self.units else 0
        self.starts = [b for b in range(1, 256) if self.units and self._is(root ^ b, b)]

    def _base(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _is(self, at: int, byte: int) -> bool:
        return at < len(self.units) and self.units[at] & 0x800000FF == byte

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and value of the longest key that ``data`` has at ``at`` (0: none)."""
        found, value, node = 0, b"", self._base(0)
        for n in range(at, len(data)):
            node ^= data[n]
            if not data[n] or not self._is(node, data[n]):
                break
            leaf, node = self.units[node] & 256, self._base(node)
            if leaf:
                begin = self.units[node] & 0x7FFFFFFF
                found, value = n + 1 - at, self.values[begin:self.values.index(b"\0", begin)]
        return found, value


class Normalizer:
    """Normalised bytes of a text, and for each of them (and their end) the text's byte it came from."""

    def __init__(self, spec: bytes, symbols: list[bytes] = (), suffix: bool = False) -> None:
        held = dict(fields(spec))
        self.map = CharacterMap(held.get(_MAP, b""))
        self.prefix, self.squeeze, self.escape = (bool(held.get(k, 1)) for k in (_PREFIX, _SQUEEZE, _ESCAPE))
        self.suffix = suffix
        self.blank = SIGN.encode() if self.escape else b" "
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        live = {*self.map.starts, *(s[0] for s in symbols), *(b" " if self.squeeze else b"")}
        some = b"".join(re.escape(bytes([b])) for b in sorted(live))
        self.rest = re.compile(b"[^" + some + b"]+" if some else b"(?s:.+)")  # bytes that stand for themselves

    def _stretch(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length and value of what is replaced at ``at``."""
        m = self.symbols.match(data, at) if self.symbols else None
        if m:
            return len(m[0]), m[0]
        n, value = self.map.longest(data, at) if self.map.units else (0, b"")
        if not n:
            lead = data[at]
            n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            value = data[at:at + n]
        return n, value

    def _plain(self, run: bytes, at: int) -> tuple[bytes, np.ndarray]:
        data = np.frombuffer(run, np.uint8)
        first = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(at, at + len(run)), at))
        if not self.escape or 32 not in run:
            return run, first
        return run.replace(b" ", self.blank), np.repeat(first, np.where(data == 32, len(self.blank), 1))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, places, at, n = [], [], 0, len(data)
        if self.squeeze:  # blanks at the start
            while at < n:
                size, value = self._stretch(data, at)
                if value != b" ":
                    break
                at += size
        if at == n:
            return b"", np.zeros(1, np.int64)

        def put(made: bytes, begin: int) -> None:
            out.append(made)
            places.append(np.full(len(made), begin, np.int64))

        if self.prefix and not self.suffix:
            put(self.blank, at)
        after_blank = self.squeeze
        while at < n:
            m = self.rest.match(data, at)
            if m:
                made, where = self._plain(m[0], at)
                out.append(made)
                places.append(where)
                after_blank, at = False, m.end()
                continue
            size, value = self._stretch(data, at)
            if after_blank:
                value = value.lstrip(b" ")
            if value:
                put(value.replace(b" ", self.blank), at)
                after_blank = self.squeeze and value.endswith(b" ")
            at += size
        made, end = b"".join(out), n
        where = np.concatenate(places) if places else np.zeros(0, np.int64)
        if self.squeeze:  # blanks at the end
            while made.endswith(self.blank):
                made = made[:-len(self.blank)]
                end = int(where[len(made)])
            where = where[:len(made)]
        if self.prefix and self.suffix:
            made, where = made + self.blank, np.append(where, [end] * len(self.blank))
        return made, np.append(where, end)


class PieceEncoder:
    """Ids and byte spans of texts under a model; ``blob``: the model file."""

    def __init__(self, blob: bytes) -> None:
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.edges = self.whole.bos_id(), self.whole.eos_id()
        spec, suffix, pieces, kinds = b"", False, [], []
        for name, value in fields(blob):
            if name == _PIECES:
                piece = dict(fields(value))
                pieces.append(piece[1])
                kinds.append(piece.get(3, 1))
            elif name == _NORMALIZER:
                spec += value
            elif name == _TRAINER:
                suffix = bool(dict(fields(value)).get(_SUFFIX, 0))
        self.normalize = Normalizer(spec, [p for p, k in zip(pieces, kinds, strict=True) if k == _USER], suffix)
        # a later field of one number stands in for an earlier one: the model without its normalisation
        off = bytes([_MAP << 3 | 2, 0, _PREFIX << 3, 0, _SQUEEZE << 3, 0, _ESCAPE << 3, 0])
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=blob + bytes([_NORMALIZER << 3 | 2, len(off)]) + off)
        kinds = np.asarray(kinds)
        self.is_byte = kinds == _BYTE
        # without byte pieces an unknown piece has no length of its own: the ends come from the pieces' texts
        self.sizes = np.where(self.is_byte, 1, [len(p) for p in pieces])
        self.spelled = bool(self.is_byte.any())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(ids, begin, end)`` of each text, begin and end ids at its ends."""
        normal = [self.normalize(t.encode("utf-8", "surrogatepass")) for t in texts]
        coded = self.bare.encode([made.decode() for made, _ in normal], num_threads=1)
        return [self._spans(np.asarray(ids, np.int64), made, where) for ids, (made, where) in zip(coded, normal, strict=True)]

    def _spans(self, ids: np.ndarray, made: bytes, where: np.ndarray) -> tuple[np.ndarray, ...]:
        if self.spelled:
            ends = np.cumsum(self.sizes[ids])
        else:
            ends = np.asarray(self._ends(made), np.int64)
        starts = np.append(0, ends[:-1])[:len(ends)]
        begin, end = where[starts], where[ends]
        # bytes of one spelled character: its span is the last one's, the others lie empty at its start
        spelled = self.is_byte[ids]
        if spelled.any():
            data = np.frombuffer(made, np.uint8)
            last = np.append((data[ends[:-1]] & 0xC0) != 0x80, True)
            lead = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
            begin = np.where(spelled, where[lead[starts]], begin)
            end = np.where(spelled & ~last, begin, end)
        return (np.concatenate((self.edges[:1], ids, self.edges[1:])).astype("<u4"),
                np.concatenate(([0], begin, where[-1:])), np.concatenate(([0], end, where[-1:])))

    def _ends(self, made: bytes) -> list[int]:
        ends, at = [], 0
        for piece in self.bare.encode(made.decode(), out_type=str):
            at += len(piece.encode())
            ends.append(at)
        return ends

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode([i.tolist() for i in ids])


_BUFFER = 1 << 20  # bytes of text encoded at once


def _buffers(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First rows and texts (null: empty) of a column, about ``_BUFFER`` characters at a time."""
    first, held, n = 0, [], 0
    for i, t in enumerate(each(column)):
        held.append(t or "")
        n += len(held[-1])
        if n >= _BUFFER:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def _model(model: str) -> bytes:
    with open(model, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``(doc_id, ids, begins, ends, decoded)``: piece ids with their spans in the text's UTF-8, and the ids decoded."""
    blob = docs.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = PieceEncoder(blob.value)
        for batch in batches:
            for first, texts in _buffers(batch.column(1)):
                found = code.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(3)),
                     pa.array(code.decode([f[0] for f in found]), pa.string())],
                    names=["doc_id", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<bigint>, begins array<bigint>, ends array<bigint>, decoded string")


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: number and digest of its ids, digest of the decoded text, digest of the spans.

    ``spans_sha256``: begins, then ends, as little-endian unsigned 64-bit integers; ``n_covered``: bytes under some span.
    """
    blob = docs.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sha = PieceEncoder(blob.value), hashlib.sha256
        for batch in batches:
            for first, texts in _buffers(batch.column(1)):
                found = code.encode(texts)
                decoded = code.decode([f[0] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     pa.array([len(f[0]) for f in found], pa.int64()),
                     pa.array([sha(f[0].tobytes()).hexdigest() for f in found]),
                     pa.array([sha(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]),
                     pa.array([sha(np.concatenate(f[1:]).astype("<u8").tobytes()).hexdigest() for f in found]),
                     pa.array([int((f[2] - f[1]).sum()) for f in found], pa.int64())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_covered"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, n_covered bigint")
