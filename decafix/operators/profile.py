"""Profiles of byte planes: value shares and which planes are worth holding sparsely."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2000
MAJORITY_SHARE = 0.6
OUTLIER_SHARE = 0.1


def plane_profile(df: DataFrame, plane: Column) -> DataFrame:
    """Each value of a plane with its count and share of all rows, rarest first in meaning; order by ``n`` to print."""
    counts = df.groupBy(plane.cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select("byte", "n", (F.col("n") / F.col("__all")).alias("share"))


def majority(df: DataFrame, plane: Column, pos: str = "pos", sample: int = SAMPLE_ROWS) -> DataFrame:
    """The most frequent byte of the first ``sample`` positions (ties: the least), and whether it is frequent enough for
    a sparse plane. The sample is the feature: it only decides on a layout, never on an answer."""
    head = df.where(F.col(pos) < sample).groupBy(plane.cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))
    best = head.agg(F.max(F.struct(F.col("n"), (-F.col("byte")).alias("neg"))).alias("m"), F.sum("n").alias("n_sample"))
    return best.select((-F.col("m.neg")).alias("major"), F.col("m.n").alias("n_major"), "n_sample", ((2 * F.col("m.n") - F.col("n_sample")) > MAJORITY_SHARE * F.col("n_sample")).alias("sparse"))


def outliers(df: DataFrame, plane: Column, major: int, keep: list[str]) -> DataFrame:
    return df.where(plane != F.lit(major)).select(*keep, plane.cast("int").alias("byte"))


def sparse_sum(df: DataFrame, plane: Column, major: int) -> DataFrame:
    """A sparse plane's sum: the outliers, and the majority byte for the rest."""
    out = plane != F.lit(major)
    n_out, s_out = F.count(F.when(out, 1)), F.coalesce(F.sum(F.when(out, plane)), F.lit(0))
    return df.agg(n_out.alias("n_outliers"), (s_out + F.lit(major) * (F.count(plane) - n_out)).cast("bigint").alias("sum_value"))
