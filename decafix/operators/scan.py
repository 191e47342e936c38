"""Materialisation and selection over (pos, x): full and reduced decode, filters, positional gather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.functions import decode, fixed, reduced
from decafix.functions.planes import bit_length


def bounded(df: DataFrame, x: str, precision: int, out: str = "fx") -> DataFrame:
    """``df`` with the fixed-point column; rows without a fixed form are left out."""
    return df.withColumn(out, fixed(x, precision)).where(F.col(out).isNotNull())


def segment_stats(df: DataFrame, fx: str = "fx") -> DataFrame:
    """One row: n, base, top, width. Pass the row's numbers to the codecs to save this pass."""
    return df.agg(F.count(fx).alias("n"), F.min(fx).alias("base"), F.max(fx).alias("top")).withColumn("width", bit_length(F.col("top") - F.col("base")))


def with_stats(df: DataFrame, fx: str = "fx", known: tuple[int, int] | None = None) -> DataFrame:
    """Every row beside base and width: of ``known`` least and greatest fixed values, or else of the single row of ``segment_stats`` (a pass of its own; that side is one row, so it
    is sent, not shuffled)."""
    if known:
        return df.withColumns({"base": F.lit(known[0]).cast("long"), "width": F.lit((known[1] - known[0]).bit_length())})
    return df.crossJoin(F.broadcast(segment_stats(df, fx).select("base", "width")))


def decode_all(df: DataFrame, x: str, precision: int, keep: list[str]) -> DataFrame:
    return bounded(df, x, precision).select(*keep, decode(F.col("fx"), precision).alias("value"))


def decode_reduced(df: DataFrame, x: str, precision: int, asked: int, keep: list[str], known: tuple[int, int] | None = None) -> DataFrame:
    rows = with_stats(bounded(df, x, precision), known=known)
    return rows.select(*keep, decode(reduced(F.col("fx"), F.col("base"), F.col("width"), precision, asked), precision).alias("value"))


def select_where(df: DataFrame, *predicates: Column) -> DataFrame:
    """A chain of filters; Catalyst evaluates them as one conjunction, in order."""
    for p in predicates:
        df = df.where(p)
    return df


def gather(df: DataFrame, positions: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows at the listed positions (each once, however often it is listed). Whether the list is sent or shuffled is left to its size at run time."""
    return df.join(positions.select(pos), pos, "left_semi")
