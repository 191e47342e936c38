"""Sums, extremes with their positions, and tumbling windows by row count, all on fixed-point integers.

Sums run over DECIMAL(38,0), so neither the size of the data nor the order of tasks changes a result; the division
by 2^d happens once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.functions import decode, reduced
from decafix.operators.scan import bounded, with_stats


def exact_sum(fx: Column) -> Column:
    return F.sum(fx.cast("decimal(28,0)"))


def sum_bounded(df: DataFrame, x: str, precision: int, *keys: str) -> DataFrame:
    return bounded(df, x, precision).groupBy(*keys).agg(decode(exact_sum(F.col("fx")), precision).alias("sum_value"), F.count("fx").alias("n"))


def sum_reduced(df: DataFrame, x: str, precision: int, asked: int, known: tuple[int, int] | None = None) -> DataFrame:
    rows = with_stats(bounded(df, x, precision), known=known)
    return rows.agg(decode(exact_sum(reduced(F.col("fx"), F.col("base"), F.col("width"), precision, asked)), precision).alias("sum_value"), F.count("fx").alias("n"))


def extreme(df: DataFrame, x: str, precision: int, largest: bool = True) -> DataFrame:
    """The extreme value and how many rows attain it (null and 0 of no rows): an extreme by partial aggregates, then one counting pass beside that one row."""
    rows = bounded(df, x, precision).select("fx")
    top = rows.agg((F.max if largest else F.min)("fx").alias("__top"))
    counted = rows.join(F.broadcast(top), F.col("fx") == F.col("__top"))
    return counted.agg(decode(F.max("fx"), precision).alias("value"), F.count("fx").alias("n_attained"))


def arg_extreme(df: DataFrame, x: str, precision: int, keep: list[str], largest: bool = True) -> DataFrame:
    """The rows that attain the extreme: the extreme is one row, sent to all tasks."""
    rows = bounded(df, x, precision)
    top = rows.agg((F.max if largest else F.min)("fx").alias("__top"))
    return rows.join(F.broadcast(top), F.col("fx") == F.col("__top")).select(*keep, decode(F.col("fx"), precision).alias("value"))


def average(df: DataFrame, x: str, precision: int, *keys: str) -> DataFrame:
    s = decode(exact_sum(F.col("fx")), precision)
    return bounded(df, x, precision).groupBy(*keys).agg((s / F.count("fx")).alias("avg_value"), decode(F.min("fx"), precision).alias("min_value"))


def bucket(pos: str, start: int, window: int) -> Column:
    return F.expr(f"(`{pos}` - {int(start)}L) div {int(window)}L")


def _between(rows: DataFrame, pos: str, start: int, end: int | None) -> DataFrame:
    rows = rows.where(F.col(pos) >= start)
    return rows if end is None else rows.where(F.col(pos) < end)


def windowed_max(df: DataFrame, x: str, precision: int, start: int, end: int | None, window: int, pos: str = "pos") -> DataFrame:
    """A maximum for each ``window`` rows of [start, end), to the end of the series if that is None; the last bucket may be short."""
    if window <= 0:
        raise ValueError("window must be positive")
    rows = _between(bounded(df, x, precision), pos, start, end)
    return rows.groupBy(bucket(pos, start, window).alias("bucket")).agg(decode(F.max("fx"), precision).alias("max_value"), F.count("fx").alias("n"))


def windowed_argmax(df: DataFrame, x: str, precision: int, start: int, end: int | None, window: int, pos: str = "pos") -> DataFrame:
    """All positions that attain their bucket's maximum. Bucket maxima come from partial aggregates and are joined back,
    so no bucket is sorted or gathered in one task."""
    rows = _between(bounded(df, x, precision), pos, start, end).withColumn("bucket", bucket(pos, start, window))
    tops = rows.groupBy("bucket").agg(F.max("fx").alias("fx"))
    return rows.join(tops, ["bucket", "fx"]).select("bucket", pos, decode(F.col("fx"), precision).alias("max_value"))
