"""Queries on encoded segments. A payload's planes are read from the most significant one, and only as far as the answer needs them; sparse planes answer from
their majority byte and their outliers, without being spread out.

All functions take segment rows (``codecs.encode``) and work on a segment at a time, so what a task holds is one segment. Empty input gives no rows, or a
null sum and extreme with a count of 0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.functions.bounded import decode, fraction_bits, literal
from decafix.operators.codecs import PARTED, positions_of, prune, unpack


@dataclass(frozen=True)
class Plane:
    """Bits of all offsets from ``shift`` on. Dense: ``values`` of all rows. Sparse: ``major`` but for the rows in ``other``, which have ``values``."""

    shift: int
    bits: int
    values: np.ndarray
    major: int | None = None
    other: np.ndarray | None = None

    def at(self, rows: np.ndarray) -> np.ndarray:
        if self.other is None:
            return self.values[rows].astype(np.int64)
        out, mine = np.full(len(rows), self.major, np.int64), self.other[rows]
        out[mine] = self.values[np.cumsum(self.other)[rows[mine]] - 1]
        return out

    def where(self, test) -> np.ndarray:
        """``test`` of every row, asked once of the majority and once of each outlier."""
        if self.other is None:
            return test(self.values)
        out = np.full(len(self.other), bool(test(self.major)))
        out[self.other] = test(self.values)
        return out

    def total(self, n: int, drop: int = 0) -> int:
        low = max(0, drop - self.shift)
        cut = lambda v: (int(v) >> low) << low
        one = (self.values.astype(np.int64) >> low) << low
        rest = 0 if self.other is None else cut(self.major) * (n - len(self.values))
        return (int(one.sum()) + rest) << self.shift


def planes(data: bytes, n: int, width: int, dlen: int, layout: str) -> Iterator[Plane]:
    """The planes of a payload, one after the other; a plane that isn't asked for isn't read."""
    if layout in PARTED:
        ints = max(0, width - dlen)
        cut = -(-n * ints // 8)
        yield Plane(dlen, ints, unpack(data[:cut], ints, n))
        yield Plane(0, min(dlen, width), unpack(data[cut:], dlen, n))
        return
    whole, rest = divmod(width, 8)
    flip, at = 0x80 if layout in ("flipped", "slice") else 0, 0
    for k in range(whole):
        shift, sparse = width - 8 * (k + 1), False
        if layout in ("majority", "residue"):
            sparse, at = bool(data[at]), at + 1
        if sparse:
            major, count = struct.unpack_from("<BI", data, at)
            mask = at + 5
            at = mask + -(-n // 8) + count
            yield Plane(shift, 8, np.frombuffer(data, np.uint8, count, at - count), major, np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), mask), count=n).astype(bool))
        else:
            at += n
            dense = np.frombuffer(data, np.uint8, n, at - n)
            yield Plane(shift, 8, dense ^ flip if flip else dense)
    if rest:
        yield Plane(0, rest, (np.frombuffer(data, np.uint8, n, at) ^ 0x80) >> (8 - rest) if layout == "slice" else unpack(data[at:], rest, n))


def _body(s) -> Iterator[Plane]:
    (k,) = struct.unpack_from("<I", s.payload)
    return planes(s.payload[4 + k :], s.n, _width(s), s.dlen, s.layout)


def _width(s) -> int:
    return (int(s.top) - int(s.base)).bit_length()


def offsets(body: Iterator[Plane], n: int, drop: int = 0) -> np.ndarray:
    """Offsets with their ``drop`` low bits zero, from the planes above those alone."""
    out = np.zeros(n, np.int64)
    for p in body:
        if p.shift + p.bits <= drop:
            break
        out |= p.at(np.arange(n)) << p.shift
        if p.shift <= drop:
            break
    return (out >> drop) << drop


def matches(body: Iterator[Plane], n: int, width: int, op: str, target: int, among: np.ndarray | None = None) -> np.ndarray:
    """Rows whose offset is ``op`` target; a later plane is read only while rows still tie."""
    tie = np.ones(n, bool) if among is None else among.copy()
    if target < 0 or target >= 1 << width:
        return tie if op == (">" if target < 0 else "<") else np.zeros(n, bool)
    found = np.zeros(n, bool)
    for p in body:
        t = (target >> p.shift) & ((1 << p.bits) - 1)
        if op != "=":
            found |= tie & p.where((lambda v, t=t: v > t) if op == ">" else (lambda v, t=t: v < t))
        tie &= p.where(lambda v, t=t: v == t)
        if not tie.any():
            break
    return tie if op == "=" else found


def largest(body: Iterator[Plane], n: int) -> tuple[int, np.ndarray]:
    """(the greatest offset, the rows that have it): each plane is read at the rows that lead so far."""
    top, rows = 0, np.arange(n)
    for p in body:
        v = p.at(rows)
        best = int(v.max())
        top, rows = top | (best << p.shift), rows[v == best]
    return top, rows


def dropped_bits(width: int, dlen: int, asked: int) -> int:
    """Low bits that an answer at ``asked`` digits leaves out (``functions.kept_bits`` on numbers)."""
    whole = lambda b: -(-b // 8) * 8
    ints = max(0, width - dlen)
    need = ints + (fraction_bits(asked) if asked else 0)
    return width - min(whole(need) if not asked or need // 8 < width // 8 else need, width)


def _rows(segments: DataFrame, work, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for s in b.itertuples(index=False):
                yield work(s)

    return segments.mapInPandas(run, schema)


def decode_reduced(segments: DataFrame, precision: int, asked: int) -> DataFrame:
    """(pos, value) at ``asked`` of ``precision`` digits, from the first planes alone."""

    def work(s):
        fx = int(s.base) + offsets(_body(s), s.n, dropped_bits(_width(s), s.dlen, asked))
        return pd.DataFrame({"pos": positions_of(s), "value": fx / float(2**s.dlen)})

    fraction_bits(precision)
    return _rows(segments, work, "pos long, value double")


def sum_segments(segments: DataFrame, precision: int, asked: int | None = None) -> DataFrame:
    """The exact sum, at fewer digits if ``asked``: plane by plane, a sparse plane by its majority times the rest and its outliers."""

    def work(s):
        drop = 0 if asked is None else dropped_bits(_width(s), s.dlen, asked)
        total = int(s.base) * s.n
        for p in _body(s):
            if p.shift + p.bits <= drop:
                break
            total += p.total(s.n, drop)
            if p.shift <= drop:
                break
        return pd.DataFrame({"total": [str(total)], "n": [s.n]})

    parts = _rows(segments, work, "total string, n long")
    return parts.agg(decode(F.sum(F.col("total").cast("decimal(38,0)")), precision).alias("sum_value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def max_segments(segments: DataFrame, precision: int) -> DataFrame:
    """The greatest value and how many rows attain it: one row a segment, then one small aggregate."""

    def work(s):
        top, rows = largest(_body(s), s.n)
        return pd.DataFrame({"fx": [int(s.base) + top], "n": [len(rows)]})

    parts = _rows(segments, work, "fx long, n long").groupBy("fx").agg(F.sum("n").alias("n"))
    return parts.agg(decode(F.max("fx"), precision).alias("value"), F.coalesce(F.max_by("n", "fx"), F.lit(0)).alias("n_attained"))


def argmax_segments(segments: DataFrame, precision: int) -> DataFrame:
    """(pos, value) of the rows that attain the greatest value; the greatest of the segments is one row, sent to all tasks."""

    def work(s):
        top, rows = largest(_body(s), s.n)
        return pd.DataFrame({"fx": int(s.base) + top, "pos": positions_of(s)[rows]})

    parts = _rows(segments, work, "fx long, pos long")
    top = parts.agg(F.max("fx").alias("top"))
    return parts.join(F.broadcast(top), F.col("fx") == F.col("top")).select("pos", decode(F.col("fx"), precision).alias("value"))


def windowed_max_segments(segments: DataFrame, precision: int, start: int, window: int, end: int | None = None) -> DataFrame:
    """A maximum for each ``window`` positions from ``start`` on (below ``end``, if given). Segments outside are dropped unread, a segment sends one row a bucket."""
    if window <= 0:
        raise ValueError("window must be positive")

    def work(s):
        at = positions_of(s)
        inside = (at >= start) & (at < (end if end is not None else np.iinfo(np.int64).max))
        fx = int(s.base) + offsets(_body(s), s.n)[inside]
        return pd.DataFrame({"bucket": (at[inside] - start) // window, "fx": fx}).groupby("bucket", as_index=False).agg(fx=("fx", "max"), n=("fx", "size"))

    rows = segments.where(F.col("first_pos") < end) if end is not None else segments
    parts = _rows(rows, work, "bucket long, fx long, n long")
    return parts.groupBy("bucket").agg(decode(F.max("fx"), precision).alias("max_value"), F.sum("n").alias("n"))


def _beside(segments: DataFrame, positions: DataFrame, rows: int, pos: str) -> DataFrame:
    """Segments with the sorted list of wanted positions in them, at most ``rows`` a segment."""
    wanted = positions.where(F.col(pos).isNotNull()).groupBy(F.expr(f"`{pos}` div {int(rows)}L").alias("segment")).agg(F.sort_array(F.collect_set(F.col(pos).cast("long"))).alias("wanted"))
    return segments.join(wanted, "segment")


def gather_segments(segments: DataFrame, positions: DataFrame, rows: int, pos: str = "pos") -> DataFrame:
    """(pos, value) at the listed positions. Positions meet their segments (of ``rows`` positions), not rows; of a payload, only the wanted rows are put together."""

    def work(s):
        at = positions_of(s)
        pick = np.flatnonzero(np.isin(at, np.asarray(s.wanted, np.int64)))
        fx = np.full(len(pick), int(s.base), np.int64)
        for p in _body(s):
            fx += p.at(pick) << p.shift
        return pd.DataFrame({"pos": at[pick], "value": fx / float(2**s.dlen)})

    return _rows(_beside(segments, positions, rows, pos), work, "pos long, value double")


def filter_segments(segments: DataFrame, op: str, value: float, precision: int, selection: DataFrame | None = None, rows: int | None = None, pos: str = "pos") -> DataFrame:
    """Positions whose value satisfies ``op``, of a ``selection`` of positions if given (then ``rows`` is the segments' length). Segments are dropped by base and top
    first; of the others, planes are compared in turn, at rows that still tie."""
    c = literal(value, precision)
    kept = prune(segments, op, value, precision)
    chosen = selection is not None
    if chosen:
        kept = _beside(kept, selection, rows, pos)

    def work(s):
        at = positions_of(s)
        among = np.isin(at, np.asarray(s.wanted, np.int64)) if chosen else None
        return pd.DataFrame({"pos": at[matches(_body(s), s.n, _width(s), op, c - int(s.base), among)]})

    return _rows(kept, work, "pos long")
