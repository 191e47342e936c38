"""Chat formatting by columnar byte assembly.

A conversation is the concatenation of its turns, and a turn is

    <s>[INST] role [/INST] text</s>

Inside roles and texts a backslash is put after the first character of each control string and each backslash is doubled, so no control
string occurs in them and unescaping (drop the backslash before a character, keep the second of two) gives back every byte.
The loss mask covers the text of assistant turns, nothing else.

Rows are dealt by conversation and sorted by (turn, role, text), nulls first; batches then stream. For a batch, numpy computes the lengths of
all segments (headers, escaped roles and texts, trailers), their offsets in one preallocated Arrow buffer by a cumulative sum, and the scatter
indices of every content byte; headers are copied at their offsets. Conversations that lie whole in a batch are that buffer, cut by offsets; one that goes on in the next batch is
carried over as finished bytes. The formatted conversation is the operator's output value; that value is the most that a task holds of one
conversation besides a batch, however many turns it has. A conversation is one value, so the format's own limit for one is 2 GB.

Results by case. A null text or role is empty; empty texts are turns. Very long texts are escaped whole. A null conv_id is a conversation of its own (all such rows). Turns with equal
numbers are ordered by role and text. Repeated rows are repeated turns. An empty table gives no rows. Columns beyond the four are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.llm.text import blobs, joined, pieces

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = b"<s>[INST] ", b" [/INST] ", b"</s>"
CONTROLS = (b"<s>", b"</s>", b"[INST]", b"[/INST]")
ESCAPE = 0x5C
TRAINED = b"assistant"
SCHEMA = "conv_id long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def escape_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of bytes to double, and of first bytes of control strings (within one text), in joined texts."""
    owner_end = lambda at: bounds[np.searchsorted(bounds, at, "right")]
    found = []
    for c in CONTROLS:
        at = np.flatnonzero(data[: len(data) - len(c) + 1] == c[0]) if len(data) >= len(c) else np.zeros(0, np.int64)
        for i, byte in enumerate(c[1:], 1):
            at = at[data[at + i] == byte]
        found.append(at[at + len(c) <= owner_end(at)])
    return np.flatnonzero(data == ESCAPE), np.sort(np.concatenate(found))


def escaped(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Escaped texts, joined, and their bounds: an escape byte goes after each place, and content moves by the escapes before it."""
    data, bounds = joined(texts)
    places = np.sort(np.concatenate(escape_places(data, bounds)))
    before = np.searchsorted(places, np.arange(len(data)), "left") if len(places) else np.zeros(len(data), np.int64)
    out = np.full(len(data) + len(places), ESCAPE, np.uint8)
    out[np.arange(len(data)) + before] = data
    return out, bounds + np.searchsorted(places, bounds, "left")


def unescape(data: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\\" if m[1] == b"\\" else m[1], data, flags=re.S) if b"\\" in data else data


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns' bytes in one buffer, the n + 1 bounds of the turns, and where each turn's text starts and ends."""
    (rd, rb), (td, tb) = escaped(roles), escaped(texts)
    n, r_len, t_len = len(texts), np.diff(rb), np.diff(tb)
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(r_len + t_len + len(OPEN) + len(MIDDLE) + len(CLOSE), out=bounds[1:])
    out = np.frombuffer(pa.allocate_buffer(int(bounds[-1])), np.uint8)
    role_at = bounds[:-1] + len(OPEN)
    text_at = role_at + r_len + len(MIDDLE)
    for data, lens, own, at in ((rd, r_len, rb, role_at), (td, t_len, tb, text_at)):
        out[np.arange(len(data)) + np.repeat(at - own[:-1], lens)] = data
    for fixed, at in ((OPEN, bounds[:-1]), (MIDDLE, role_at + r_len), (CLOSE, text_at + t_len)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    return out, bounds, text_at, text_at + t_len


_NAMES = ["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"]


def _one(conv, turns: int, parts: list[bytes], starts: list[int], ends: list[int]) -> pa.RecordBatch:
    """A conversation that went on over several pieces."""
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([turns], pa.int64()), pa.array([b"".join(parts)], pa.binary()), *lists], names=_NAMES)


def _whole(conv: pa.Array, out: np.ndarray, bounds: np.ndarray, heads: np.ndarray, start: np.ndarray, end: np.ndarray, trained: np.ndarray) -> pa.RecordBatch:
    """Conversations that lie whole in a piece, turns heads[i] to heads[i + 1] each: their bytes are the piece's buffer itself, cut by offsets."""
    at = bounds[heads]
    data = pa.BinaryArray.from_buffers(pa.binary(), len(heads) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)])
    mine = np.flatnonzero(trained[heads[0] : heads[-1]]) + heads[0]
    cuts = pa.array(np.searchsorted(mine, heads), pa.int32())
    own = at[np.searchsorted(heads, mine, "right") - 1]
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x[mine] - own, pa.int64())) for x in (start, end)]
    return pa.RecordBatch.from_arrays([conv.take(pa.array(heads[:-1])), pa.array(np.diff(heads)), data, *lists], names=_NAMES)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, role, text) to conversations. The last of a piece may go on in the next one, so it is held back."""
    held = None  # conv_id, turns, parts of bytes, loss starts, loss ends, length so far

    for batch in batches:
        for piece in pieces(batch, 2):
            conv, roles = piece.column(0).to_pylist(), blobs(piece.column(1))
            out, bounds, start, end = assemble(roles, blobs(piece.column(2)))
            heads = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
            trained, first = np.array([r == TRAINED for r in roles]), 0
            if held is not None and held[0] != conv[0]:
                yield _one(*held[:5])
                held = None
            if held is not None:
                first = 1
                _extend(held, out, bounds, 0, heads[1], start, end, trained)
                if len(heads) > 2:
                    yield _one(*held[:5])
                    held = None
            if len(heads) - 2 > first:
                yield _whole(piece.column(0), out, bounds, np.array(heads[first:-1]), start, end, trained)
            if held is None:
                held = [conv[-1], 0, [], [], [], 0]
                _extend(held, out, bounds, heads[-2], heads[-1], start, end, trained)
    if held is not None:
        yield _one(*held[:5])


def _extend(held: list, out: np.ndarray, bounds: np.ndarray, a: int, b: int, start: np.ndarray, end: np.ndarray, trained: np.ndarray) -> None:
    shift, mine = held[5] - int(bounds[a]), np.flatnonzero(trained[a:b]) + a
    held[1] += b - a
    held[2].append(out[int(bounds[a]) : int(bounds[b])].tobytes())
    held[3] += (start[mine] + shift).tolist()
    held[4] += (end[mine] + shift).tolist()
    held[5] += int(bounds[b] - bounds[a])


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted UTF-8, byte spans of the loss mask) for each conversation of (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_stream, SCHEMA)


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(data):
        if not data.startswith(OPEN, at):
            raise ValueError(f"no turn starts at byte {at}")
        middle = data.index(MIDDLE, at + len(OPEN))
        close = data.index(CLOSE, middle + len(MIDDLE))
        out.append((unescape(data[at + len(OPEN) : middle]), unescape(data[middle + len(MIDDLE) : close])))
        at = close + len(CLOSE)
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, data, starts, ends in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            turns, loss = parse(data), [unescape(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
            all_turns, masked = hashlib.sha256(), hashlib.sha256()
            for role, text in turns:
                all_turns.update(role + b"\n" + text + b"\n")
            for t in loss:
                masked.update(t.encode())
            rows.append((conv, len(turns), all_turns.hexdigest(), sum(map(len, loss)), masked.hexdigest(), len(data.decode())))
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), r, strict=True)) for r in rows], schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, and the text under the loss mask, as digests."""
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
