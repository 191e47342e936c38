"""Logical forms of the integer baseline codecs: frame of reference, deltas, zigzag, splits, differentials.

``lag`` needs an order. Instead of one global window (a single task), positions are cut into stripes: each stripe is
a window partition, and the value before a stripe comes from joining the stripes' last rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decafix.functions.planes import bit_length

STRIPE = 1 << 16


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def with_previous(df: DataFrame, x: str, pos: str = "pos", stripe: int = STRIPE, out: str = "prev") -> DataFrame:
    """``x`` of the row before by ``pos`` (dense positions aren't needed), null for the first."""
    rows = df.withColumn("__s", F.expr(f"`{pos}` div {int(stripe)}L"))
    ends = rows.groupBy("__s").agg(F.max_by(x, pos).alias("__end"))
    before = ends.select(F.lead("__s").over(Window.orderBy("__s")).alias("__s"), "__end")  # a row a stripe
    own = F.lag(x).over(Window.partitionBy("__s").orderBy(pos))
    first = F.row_number().over(Window.partitionBy("__s").orderBy(pos)) == 1
    return rows.withColumn(out, own).withColumn("__f", first).join(before, "__s", "left").withColumn(out, F.when(F.col("__f"), F.col("__end")).otherwise(F.col(out))).drop("__s", "__f", "__end")


def delta_zigzag(df: DataFrame, x: str, pos: str = "pos") -> DataFrame:
    """zigzag(x - previous); the first delta is 0."""
    d = F.col(x).cast("bigint") - F.coalesce(F.col("prev"), F.col(x)).cast("bigint")
    return with_previous(df, x, pos).select(pos, zigzag(d).alias("zz"))


def differential(df: DataFrame, x: str, pos: str = "pos") -> DataFrame:
    """x - previous; the first value is kept."""
    return with_previous(df, x, pos).select(pos, (F.col(x).cast("bigint") - F.coalesce(F.col("prev"), F.lit(0)).cast("bigint")).alias("diff"))


def frame_of_reference(df: DataFrame, x: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Base and bit width of each group."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.min(F.col(x).cast("bigint")).alias("base"), F.max(F.col(x).cast("bigint")).alias("top"))
    return g.select(*keys, "base", bit_length(F.col("top") - F.col("base")).alias("width"))


def zigzag_width(df: DataFrame, x: str, pos: str = "pos") -> DataFrame:
    return delta_zigzag(df, x, pos).agg(bit_length(F.max("zz")).alias("width"))


def split_int_frac(df: DataFrame, x: str, scale: int, keep: list[str]) -> DataFrame:
    """The offset from the least value as quotient and remainder of ``scale``."""
    low = df.agg(F.min(F.col(x).cast("bigint")).alias("__base"))
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(low)).select(*keep, F.expr(f"(cast(`{x}` as bigint) - __base) div {int(scale)}L").alias("whole"), F.expr(f"(cast(`{x}` as bigint) - __base) % {int(scale)}L").alias("part"))


def delta_offset(df: DataFrame, x: str, keep: list[str]) -> DataFrame:
    """x - min(0, least x), so that nothing is negative and a column without negatives stays."""
    low = df.agg(F.least(F.lit(0).cast("bigint"), F.min(F.col(x).cast("bigint"))).alias("__base"))
    return df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(low)).select(*keep, (F.col(x).cast("bigint") - F.col("__base")).alias("offset"))


def scaled_ceil(df: DataFrame, x: str, scale: int, keep: list[str], signed: bool = True) -> DataFrame:
    """ceil(x * scale) as an integer, its magnitude if unsigned."""
    c = F.ceil(F.col(x) * F.lit(float(scale)))
    return df.where(F.col(x).isNotNull()).select(*keep, (c if signed else F.abs(c)).cast("bigint").alias("scaled"))


def bitpack(df: DataFrame, x: str, pos: str = "pos", rows: int = STRIPE, delta: bool = False) -> DataFrame:
    """Integers as bit-packed segments (segment, first_pos, n, base, width, delta, at, payload): offsets from the segment's least value at the fewest bits that hold them; with ``delta``,
    zigzag differences within the segment. ``at`` are positions' offsets where they aren't dense."""
    from decafix.operators.codecs import pack

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        at, v = pdf["pos"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)
        d = np.diff(v, prepend=v[0])
        base, off = (int(v[0]), (d << 1) ^ (d >> 63)) if delta else (int(v.min()), v - v.min())
        width = int(off.max()).bit_length()
        dense = (np.diff(at) == 1).all()
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "first_pos": [int(at[0])], "n": [len(v)], "base": [base], "width": [width], "delta": [delta], "at": [None if dense else (at - at[0]).tolist()], "payload": [pack(off, width)]})

    slim = df.where(F.col(x).isNotNull()).select(F.expr(f"`{pos}` div {int(rows)}L").alias("segment"), F.col(pos).cast("long").alias("pos"), F.col(x).cast("long").alias("v"))
    return slim.groupBy("segment").applyInPandas(run, "segment long, first_pos long, n int, base long, width int, delta boolean, at array<long>, payload binary")


def bitunpack(segments: DataFrame) -> DataFrame:
    """(pos, x) of bit-packed segments."""
    from decafix.operators.codecs import unpack

    def run(batches):
        for b in batches:
            for s in b.itertuples(index=False):
                off = unpack(s.payload, s.width, s.n)
                v = s.base + (np.cumsum((off >> 1) ^ -(off & 1)) if s.delta else off)
                yield pd.DataFrame({"pos": s.first_pos + (np.arange(s.n) if s.at is None else np.asarray(s.at, np.int64)), "x": v})

    return segments.mapInPandas(run, "pos long, x long")
