"""The segment store: encoded chunks as rows, and decoding, filters and ratios over them.

``encode`` cuts a series into segments of ``rows`` positions (so a task holds one segment, whatever the series' length)
and stores each as base, top, count, widths and a payload. ``prune`` drops whole segments by base and top before any
payload is read. Layouts differ only in bytes, never in answers.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.functions.bounded import error_bound, fraction_bits, literal
from decafix.operators.profile import MAJORITY_SHARE, OUTLIER_SHARE, SAMPLE_ROWS
from decafix.operators.scan import bounded

SEGMENT_ROWS = 65_536
LAYOUTS = ("plain", "flipped", "slice", "majority", "residue", "offset", "split")
#: Layouts of whole parts, then fractions; "split" holds values as they are where none is negative, "offset" their distance from the least.
PARTED = ("offset", "split")
_SCHEMA = "segment long, first_pos long, n int, base long, top long, ilen int, dlen int, layout string, org_size long, payload binary"


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned values of ``width`` bits, lowest bit first."""
    if not width or not len(values):
        return b""
    bits = (values.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def pack_fields(fields: list[tuple[int, int]]) -> bytes:
    """(value, width) pairs one after the other, lowest bit first."""
    total, at = 0, 0
    for v, w in fields:
        total |= (v & ((1 << w) - 1)) << at
        at += w
    return total.to_bytes(-(-at // 8), "little")


class BitWriter:
    """Fields written one after the other, lowest bit first."""

    def __init__(self) -> None:
        self.total, self.bits = 0, 0

    def write(self, value: int, bits: int) -> BitWriter:
        self.total |= (value & ((1 << bits) - 1)) << self.bits
        self.bits += bits
        return self

    def align(self) -> BitWriter:
        self.bits += -self.bits % 8
        return self

    def write_bytes(self, data: bytes) -> BitWriter:
        return self.write(int.from_bytes(data, "little"), 8 * len(data))

    def to_bytes(self) -> bytes:
        return self.total.to_bytes(-(-self.bits // 8), "little")


class BitReader:
    """Reads fields back from bytes or from a binary stream, a byte at a time as they are needed."""

    def __init__(self, source) -> None:
        self.source, self.held, self.bits = io.BytesIO(source) if isinstance(source, (bytes, bytearray, memoryview)) else source, 0, 0

    def read(self, bits: int) -> int:
        while self.bits < bits:
            more = self.source.read(-(-(bits - self.bits) // 8))
            if not more:
                raise EOFError(f"{bits} bits wanted, {self.bits} left")
            self.held |= int.from_bytes(more, "little") << self.bits
            self.bits += 8 * len(more)
        value = self.held & ((1 << bits) - 1)
        self.held >>= bits
        self.bits -= bits
        return value

    def skip(self, bits: int) -> BitReader:
        self.read(bits)
        return self

    def align(self) -> BitReader:
        return self.skip(self.bits % 8)

    def read_bytes(self, n: int) -> bytes:
        return self.read(8 * n).to_bytes(n, "little")


def _sparse(plane: np.ndarray, zero: bool) -> int | None:
    """The majority byte of a plane that is worth holding sparsely, from its first rows."""
    head = plane[:SAMPLE_ROWS]
    counts = np.bincount(head, minlength=256)
    if zero:
        return 0 if len(head) and counts[0] >= (1 - OUTLIER_SHARE) * len(head) else None
    major = int(counts.argmax())
    return major if len(head) and 2 * counts[major] - len(head) > MAJORITY_SHARE * len(head) else None


def encode_offsets(off: np.ndarray, width: int, dlen: int, layout: str, forced: int | None = None) -> bytes:
    """``forced`` holds the first plane sparsely about that byte, however frequent it is (layouts with sparse planes)."""
    if layout in PARTED:
        return pack(off >> dlen, max(0, width - dlen)) + pack(off & ((1 << dlen) - 1), dlen)
    whole, rest = divmod(width, 8)
    out, sparse_ends = [], False
    for k in range(whole):
        plane = ((off >> (width - 8 * (k + 1))) & 255).astype(np.uint8)
        major = None if layout not in ("majority", "residue") or sparse_ends else forced if forced is not None and not k else _sparse(plane, layout == "residue")
        sparse_ends = major is None
        if layout in ("majority", "residue"):
            out.append(bytes([major is not None]))
        if major is not None:
            other = plane != major
            out.append(struct.pack("<BI", major, int(other.sum())) + np.packbits(other).tobytes() + plane[other].tobytes())
        else:
            out.append((plane ^ (0x80 if layout in ("flipped", "slice") else 0)).astype(np.uint8).tobytes())
    if rest:
        low = off & ((1 << rest) - 1)
        out.append(((low << (8 - rest)) ^ 0x80).astype(np.uint8).tobytes() if layout == "slice" else pack(low, rest))
    return b"".join(out)


def decode_offsets(data: bytes, n: int, width: int, dlen: int, layout: str) -> np.ndarray:
    if layout in PARTED:
        ints = max(0, width - dlen)
        cut = -(-n * ints // 8)
        return (unpack(data[:cut], ints, n) << dlen) | unpack(data[cut:], dlen, n)
    whole, rest = divmod(width, 8)
    off, at = np.zeros(n, np.int64), 0
    for k in range(whole):
        sparse = False
        if layout in ("majority", "residue"):
            sparse, at = bool(data[at]), at + 1
        if sparse:
            major, n_other = struct.unpack_from("<BI", data, at)
            at += 5
            other = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
            at += -(-n // 8)
            plane = np.full(n, major, np.int64)
            plane[other] = np.frombuffer(data, np.uint8, n_other, at)
            at += n_other
        else:
            plane = np.frombuffer(data, np.uint8, n, at).astype(np.int64) ^ (0x80 if layout in ("flipped", "slice") else 0)
            at += n
        off |= plane << (width - 8 * (k + 1))
    if rest:
        off |= ((np.frombuffer(data, np.uint8, n, at).astype(np.int64) ^ 0x80) >> (8 - rest)) if layout == "slice" else unpack(data[at:], rest, n)
    return off


def encode(df: DataFrame, x: str, precision: int, layout: str = "plain", pos: str = "pos", rows: int = SEGMENT_ROWS, known: tuple[int, int] | None = None, forced: int | None = None) -> DataFrame:
    """Segments of ``df``. ``known`` (least and greatest fixed value) gives all segments one base, as a single pass over
    a file with known statistics does; a segment with values beyond them has its own. ``forced`` is the byte of a first plane that is held sparsely in any case."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    dlen = fraction_bits(precision)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        fx = pdf["fx"].to_numpy(np.int64)
        base, top = int(fx.min()), int(fx.max())
        if known:
            base, top = min(base, known[0]), max(top, known[1])
        if layout == "split":
            base = min(base, 0)
        width = (top - base).bit_length()
        gaps = np.diff(pdf["pos"].to_numpy(np.int64), prepend=pdf["pos"].iloc[0] - 1)
        index = b"" if (gaps == 1).all() else zlib.compress(gaps.astype("<i8").tobytes(), 1)
        payload = struct.pack("<I", len(index)) + index + encode_offsets(fx - base, width, dlen, layout, forced)
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "first_pos": [int(pdf["pos"].iloc[0])], "n": [len(fx)], "base": [base], "top": [top], "ilen": [max(0, width - dlen)], "dlen": [dlen], "layout": [layout], "org_size": [8 * len(fx) + 40], "payload": [payload]})

    rows_ = bounded(df, x, precision).select(F.expr(f"`{pos}` div {int(rows)}L").alias("segment"), F.col(pos).cast("long").alias("pos"), "fx")
    return rows_.groupBy("segment").applyInPandas(run, _SCHEMA)


def positions_of(s) -> np.ndarray:
    (k,) = struct.unpack_from("<I", s.payload)
    gaps = np.frombuffer(zlib.decompress(s.payload[4 : 4 + k]), "<i8").copy() if k else np.ones(s.n, np.int64)
    gaps[:1] = 0
    return s.first_pos + np.cumsum(gaps)


def read_segment(s) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fixed values) of one segment row."""
    (k,) = struct.unpack_from("<I", s.payload)
    width = (int(s.top) - int(s.base)).bit_length()
    return positions_of(s), int(s.base) + decode_offsets(s.payload[4 + k :], s.n, width, s.dlen, s.layout)


def decode_segments(segments: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for s in b.itertuples(index=False):
                at, fx = read_segment(s)
                yield pd.DataFrame({"pos": at, "value": fx / float(2**s.dlen)})

    return segments.mapInPandas(run, "pos long, value double")


def prune(segments: DataFrame, op: str, value: float, precision: int) -> DataFrame:
    """Segments that may hold a match, by base and top alone: stored columns, so this reaches the Parquet scan."""
    c = literal(value, precision)
    return segments.where({">": F.col("top") > c, "<": F.col("base") < c, "=": (F.col("base") <= c) & (F.col("top") >= c)}[op])


def ratio(segments: DataFrame) -> DataFrame:
    """Encoded over original bytes by layout; the original is 8 bytes a value and a header."""
    return segments.groupBy("layout").agg((F.sum(F.length("payload") + 36) / F.sum("org_size")).alias("ratio"), F.sum("n").cast("bigint").alias("n"))


def precision_bounds(x: np.ndarray, precision: int) -> np.ndarray:
    """Doubles with few mantissa bits within the bound of ``x``: bits below a place go and the bit at that place is set, at the highest place up to which all places stay
    within the bound. Values that aren't finite stay."""
    x = np.ascontiguousarray(x, np.float64)
    bits, out, live = x.view(np.uint64), x.copy(), np.isfinite(x)
    for place in range(53):
        if not live.any():
            break
        y = (((bits >> np.uint64(place)) | np.uint64(1)) << np.uint64(place)).view(np.float64)
        live &= np.abs(x - y) < error_bound(precision)
        out[live] = y[live]
    return out


def precision_bound(x: float, precision: int) -> float:
    return float(precision_bounds(np.array([x]), precision)[0])


def bound_mantissa(df: DataFrame, x: str, precision: int, keep: list[str]) -> DataFrame:
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(precision_bounds(s.to_numpy(float, na_value=np.nan), precision)).where(s.notna().to_numpy(), None)

    return df.select(*keep, run(F.col(x).cast("double")).alias("value"))


#: Digits of a binary expansion at most.
EXPANDED = 64


def expand(df: DataFrame, x: str, precision: int, keep: list[str]) -> DataFrame:
    """Binary digits of |x| below 1, as many as bring the rest within the bound; null for null and for what isn't finite. The number of digits follows from the
    rest after each of them, so this is one expression: the digits of trunc(fraction * 2^64) as two halves."""
    size = F.abs(F.col(x).cast("double"))
    fraction = F.when(size < F.lit(2.0**53), size - F.floor(size)).otherwise(F.lit(0.0))
    at = lambda k: F.col("__f") * F.lit(2.0**k) - F.floor(F.col("__f") * F.lit(2.0**k))  # noqa: E731  the rest after k digits, scaled by 2^k
    depth = F.coalesce(*[F.when(at(k) * F.lit(2.0**-k) < error_bound(precision), F.lit(k)) for k in range(EXPANDED)], F.lit(EXPANDED))
    half = lambda v: F.lpad(F.bin(F.floor(v).cast("long")), 32, "0")
    digits = F.concat(half(F.col("__f") * F.lit(2.0**32)), half(at(32) * F.lit(2.0**32)))
    rows = df.withColumn("__f", F.when(size < F.lit(float("inf")), fraction))
    return rows.select(*keep, F.when(F.col("__f").isNotNull(), F.substring(digits, F.lit(1), depth)).alias("bits"))


def lengths(df: DataFrame, x: str, precision: int) -> DataFrame:
    """The bits that the integer parts and the fractions of a bounded column take: those of the greatest magnitude, and of the last place in use."""
    fx = F.abs(F.col("fx"))
    low = fx.bitwiseAND(-fx)
    d = fraction_bits(precision)
    whole = F.when(F.shiftright(fx, d) == 0, 0).otherwise(F.length(F.bin(F.shiftright(fx, d))))
    used = F.when((fx == 0) | (low >= F.lit(1 << d)), 0).otherwise(F.lit(d + 1) - F.length(F.bin(low)))
    return bounded(df, x, precision).agg(F.max(whole).cast("int").alias("integer_bits"), F.max(used).cast("int").alias("fraction_bits"))
