"""Chat formatting by event-sourced reconstruction.

A log holds, per conversation and sequence number, events on messages:

- ``open``: a message begins, with a role and its first text;
- ``delta``: text streamed to the end of the message;
- ``edit``: the text so far is replaced by the event's text;
- ``regenerate``: the text so far is thrown away (and streamed anew).

The log is partitioned by (conversation, message) and sorted by sequence
number, and each message is folded as its events stream by; what an edit or a
regeneration supersedes is dropped at once, so a task holds one message.  A
conversation with a third of all events is thereby spread over as many tasks
as it has messages.  Rendering is per message: the formatted conversation is
the concatenation of its messages' segments in order.

Template of a segment: ``<s>[role]`` text ``</s>``.  Every control string
begins with ``<`` or ``[``; inside roles and texts ``\\``, ``<``, ``[`` and ``]``
are written ``\\\\``, ``\\l``, ``\\b`` and ``\\c``, so that no control string is left
and the escape can be undone.  The loss mask covers the escaped assistant text.

Defined cases: null text, role, kind or part are read as empty (an unknown
kind is a delta); a null conv_id is a conversation of its own; events of one
sequence number are ordered by kind (open, edit, regenerate, delta), then text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 400  # characters of a streamed part
_ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\c": "]"}
_SEGMENT = re.compile(r"<s>\[([^\]]*)\](.*)</s>", re.S)


def turn_events(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", part: int = PART) -> DataFrame:
    """The log ``(conv_id, turn, msg, seq, kind, role, text)`` that streaming the turns leaves behind.

    An assistant turn is opened, streams a draft of its first part, is
    regenerated and streams its text in parts; any other turn is opened with
    its first part and edited to its text.  ``msg`` is the row's number.
    """
    t = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                     F.monotonically_increasing_id().alias("msg"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                     F.coalesce(F.col(text), F.lit("")).alias("all"))

    def event(kind: str, seq: Column, said: Column) -> Column:
        return F.struct(seq.cast("bigint").alias("seq"), F.lit(kind).alias("kind"), said.alias("text"))

    n = F.ceil(F.length("all") / part).cast("int")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
                        lambda i: event("delta", i + 3, F.substr("all", i * part + 1, F.lit(part))))
    draft = F.substr("all", F.lit(1), F.lit(part))
    streamed = F.concat(F.array(event("open", F.lit(0), F.lit("")), event("delta", F.lit(1), draft),
                                event("regenerate", F.lit(2), F.lit(""))), parts)
    typed = F.array(event("open", F.lit(0), draft), event("edit", F.lit(1), F.col("all")))
    return t.select("conv_id", "turn", "msg", "role",
                    F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)).alias("e")) \
        .select("conv_id", "turn", "msg", "e.seq", "e.kind", "role", "e.text")


def fold_events(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, msg, role, text)``: the final messages of a log.

    The role is that of the message's last ``open``, the turn the one of its
    first event.  A message without ``open`` has an empty role.
    """
    rank = F.when(F.col("kind") == "open", 0).when(F.col("kind") == "edit", 1) \
        .when(F.col("kind") == "regenerate", 2).otherwise(3)
    log = events.select("conv_id", "turn", "msg", "seq", rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    by = ["conv_id", "msg"]
    log = log.repartition(*by).sortWithinPartitions(*by, "seq", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, said, head = None, [], None
        for batch in batches:
            done = []
            for conv, turn, msg, _, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, msg) != at:
                    if at is not None:
                        done.append((*head, "".join(said)))
                    at, said, head = (conv, msg), [], [conv, turn, msg, ""]
                if kind == 0:
                    head[3] = role
                if kind < 3:
                    said = []
                said.append(text)
            if done:
                yield _rows(done)
        if at is not None:
            yield _rows([(*head, "".join(said))])

    return log.mapInArrow(run, "conv_id bigint, turn bigint, msg bigint, role string, text string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["conv_id", "turn", "msg", "role", "text"])


def _escape(c: Column) -> Column:
    for plain, written in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], s, flags=re.S) if "\\" in s else s


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, msg, role, segment, loss_start, loss_chars)``; null loss without a loss mask.

    ``loss_start`` counts code points of the segment, ``loss_chars`` those under the mask (as written).
    A conversation's segments stand in the order of (turn, role, text, msg).
    """
    role, text = _escape(F.col("role")), _escape(F.col("text"))
    loss = F.col("role") == "assistant"
    m = messages.select("conv_id", "turn", "msg", "role", "text", role.alias("r"), text.alias("t"), loss.alias("loss"))
    return m.select("conv_id", "turn", "msg", "role", "text",
                    F.concat(F.lit("<s>["), "r", F.lit("]"), "t", F.lit("</s>")).alias("segment"),
                    F.when(F.col("loss"), F.length("r") + 5).alias("loss_start"),
                    F.when(F.col("loss"), F.length("t")).alias("loss_chars"))


def format_chats(events: DataFrame) -> DataFrame:
    """Log to segments: fold, then render."""
    return render(fold_events(events))


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from its segments alone: turns, digests of all and of the masked text.

    Segments stream by in order; a task holds one of them and two running digests.
    """
    s = segments.select("conv_id", "turn", "role", "text", "msg", "segment", "loss_start", "loss_chars") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "msg") \
        .select("conv_id", "segment", "loss_start", "loss_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            done = []
            for c, segment, start, chars in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or c != conv:
                    if now is not None:
                        done.append(_digested(conv, now))
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                m = _SEGMENT.fullmatch(segment)
                role, text = unescape(m[1]), unescape(m[2])
                now[0] += 1
                now[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    masked = unescape(segment[start:start + chars])
                    now[2] += len(masked)
                    now[3].update(masked.encode("utf-8", "surrogatepass"))
                now[4] += len(segment)
            if done:
                yield _chats(done)
        if now is not None:
            yield _chats([_digested(conv, now)])

    return s.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                             "loss_sha256 string, formatted_chars bigint")


def _digested(conv: int | None, now: list) -> tuple:
    return conv, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]


def _chats(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=names)


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(9 + 2 * length(role) - length(regexp_replace(role, '[\\<\[\]]', '', 'g'))
      + 2 * length(text) - length(regexp_replace(text, '[\\<\[\]]', '', 'g')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
