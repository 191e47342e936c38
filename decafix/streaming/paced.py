"""Paced sources, bounded runs and encoding by micro-batch, on Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from decafix.functions import decode, fixed
from decafix.operators import codecs


def rate_source(spark: SparkSession, per_second: int = 10, mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Generated rows at a steady pace: pos counts up, x is a normal sample derived from pos."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    u = lambda salt: (F.pmod(F.xxhash64("value", F.lit(salt)), F.lit(2**53)) + 1) / float(2**53 + 1)
    z = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return rows.select(F.col("timestamp").alias("ts"), F.col("value").alias("pos"), (mean + std * z).alias("x"))


def text_source(spark: SparkSession, path: str, skip: int = 0, delim: str = ",", files_per_trigger: int = 1) -> DataFrame:
    """Numbers of arriving text files, flattened as the batch scan does."""
    from decafix.sources.scans import _cells, _number

    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    rows = _cells(lines, skip, delim).select(F.col("__c").alias("cell_at"), _number(F.col("cell"), "double").alias("x"))
    return rows.where(F.col("x").isNotNull())


def binary_source(spark: SparkSession, path: str, delim: int, fmt: str = "<d") -> DataFrame:
    """Records of arriving binary files, as the batch scan decodes them."""
    from decafix.sources.scans import records

    files = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(path).schema).load(path)
    return records(files, delim, fmt)


def parquet_source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, only: str = "*") -> DataFrame:
    """Arriving files of a folder, those whose names match ``only``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", only).parquet(path)


def windowed_max_stream(stream: DataFrame, ts: str, x: str, precision: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """A maximum by event-time window; rows later than the watermark are left out."""
    rows = stream.withColumn("fx", fixed(x, precision)).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, window)).agg(decode(F.max("fx"), precision).alias("max_value"), F.count("fx").alias("n"))


def encode_stream(stream: DataFrame, x: str, precision: int, out: str, checkpoint: str, layout: str = "plain", pos: str = "pos", interval: str = "0 seconds") -> StreamingQuery:
    """Each micro-batch encoded to segments under ``out``, a folder a batch, so that a batch run twice replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        codecs.encode(batch, x, precision, layout, pos).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def run_bounded(query: StreamingQuery, amount: int | None = None, seconds: float | None = None) -> int:
    """Lets a query run until it took ``amount`` rows or ``seconds`` passed, then stops it; returns the rows taken."""
    began, taken, seen = time.time(), 0, -1
    while query.isActive:
        p = query.lastProgress
        if p and p["batchId"] > seen:
            seen = p["batchId"]
            taken = sum(q["numInputRows"] for q in query.recentProgress)
        if (amount is not None and taken >= amount) or (seconds is not None and time.time() - began >= seconds):
            query.stop()
        else:
            query.awaitTermination(0.2)
    return taken
