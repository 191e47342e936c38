"""Seeded generators of series; every one is a range with random columns, so it scales by partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAJOR_BYTE = 69


def uniform(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(low) + F.rand(seed) * F.lit(high - low)).alias("x"))


def normal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    """Normal samples of single precision."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.lit(mean) + F.lit(std) * F.randn(seed)).cast("float").cast("double").alias("x"))


#: Inverse distribution functions by name, of a uniform u in [0, 1) and two parameters.
DISTRIBUTIONS = {
    "uniform": lambda u, a, b: a + u * (b - a),
    "exponential": lambda u, a, b: -F.log1p(-u) / a,
    "pareto": lambda u, a, b: a / F.pow(1 - u, F.lit(1.0) / b),
    "weibull": lambda u, a, b: a * F.pow(-F.log1p(-u), F.lit(1.0) / b),
    "logistic": lambda u, a, b: a + b * F.log((u + 2.0**-54) / (1 - u)),
    "bernoulli": lambda u, a, b: (u < a).cast("double"),
}


def distribution(spark: SparkSession, n: int, kind: str, a: float = 0.0, b: float = 1.0, seed: int = 0) -> DataFrame:
    """Samples of a named distribution; also normal and lognormal (mean a, deviation b)."""
    if kind in ("normal", "lognormal"):
        x = F.lit(a) + F.lit(b) * F.randn(seed)
        x = F.exp(x) if kind == "lognormal" else x
    else:
        x = DISTRIBUTIONS[kind](F.rand(seed), F.lit(a), F.lit(b))
    return spark.range(n).select(F.col("id").alias("pos"), x.alias("x"))


def outlier_bytes(spark: SparkSession, n: int, ratio: float, seed: int = 0) -> DataFrame:
    """Bytes that are ``MAJOR_BYTE`` with probability ``ratio`` (in whole hundredths) and uniform otherwise; two chosen
    positions hold 0 and 255."""
    low, high = (seed * 7919 + 1) % max(n, 1), (seed * 104_729 + n // 2) % max(n, 1)
    high = (high + 1) % max(n, 1) if high == low else high
    b = F.when(F.rand(seed) * 100 >= int(ratio * 100), F.floor(F.rand(seed + 1) * 256)).otherwise(MAJOR_BYTE)
    b = F.when(F.col("id") == high, 255).when(F.col("id") == low, 0).otherwise(b)
    return spark.range(n).select(F.col("id").alias("pos"), b.cast("int").alias("b"))


def random_bytes(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.floor(F.rand(seed) * 256).cast("int").alias("b"))


def complex_signal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 10.0, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), (mean + std * F.randn(seed)).alias("re"), (mean + std * F.randn(seed + 1)).alias("im"))
