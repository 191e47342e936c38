"""Raw byte columns: filters, progressive filters, sums and histograms of a plane that is stored by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_filter(df: DataFrame, b: str, target: int) -> DataFrame:
    """Rows whose unsigned byte is above the target."""
    return df.where(F.col(b) > target)


def equal_filter(df: DataFrame, b: str, target: int) -> DataFrame:
    return df.where(F.col(b) == target)


def progressive(df: DataFrame, selection: Column, b: str, target: int, equal: bool = False) -> DataFrame:
    """The same, only at rows that are selected already: one conjunction, whose second part runs where the first holds."""
    return df.where(selection).where(F.col(b) == target if equal else F.col(b) > target)


def tie_share(df: DataFrame, b: str, target: int) -> DataFrame:
    """The share of rows that tie with the target, on which an engine could choose between scanning a plane and walking its ties."""
    return df.agg((F.count(F.when(F.col(b) == target, 1)) / F.count(F.lit(1))).alias("tie_share"))


def byte_sum(df: DataFrame, b: str) -> DataFrame:
    """A true sum, not one that wraps by lane."""
    return df.agg(F.sum(F.col(b).cast("bigint")).alias("sum_value"))


def sparse_plane(df: DataFrame, b: str, major: int, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """A byte column as (one row: major and count) and (positions and values of all others), whatever the share of the majority."""
    return df.agg(F.count(b).alias("n")).withColumn("major", F.lit(major)), df.where(F.col(b) != major).select(pos, b)


def dense_plane(head: DataFrame, others: DataFrame, b: str = "b", pos: str = "pos") -> DataFrame:
    """The inverse over positions 0..n-1."""
    n, major = head.select("n", "major").collect()[0]
    return head.sparkSession.range(n).withColumnRenamed("id", pos).join(others, pos, "left").select(pos, F.coalesce(b, F.lit(major)).cast("int").alias(b))
