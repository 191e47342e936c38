"""Files of numbers: delimited text flattened row by row, and delimited binary records."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def _cells(lines: DataFrame, skip: int, delim: str) -> DataFrame:
    parts = F.split(F.col("value"), "\\Q" + delim + "\\E", -1)
    return lines.select(*[c for c in lines.columns if c != "value"], F.posexplode(parts).alias("__c", "cell")).where(F.col("__c") >= skip)


def _number(cell: Column, kind: str) -> Column:
    """Unparsable cells (blanks around a number included) and values without a fixed form are null."""
    return F.when(cell.rlike(PLAIN_NUMBER), cell.try_cast(kind))


def csv_floats(spark: SparkSession, path: str, skip: int = 0, delim: str = ",") -> DataFrame:
    """Parsable cells of all lines but the first ``skip`` of each, as (file, line_at, cell_at, x). The order of a file is
    (file, line_at, cell_at); ``with_positions`` makes it dense."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_at"), "value")
    rows = _cells(lines, skip, delim).select("file", "line_at", F.col("__c").alias("cell_at"), _number(F.col("cell"), "double").alias("x"))
    return rows.where(F.col("x").isNotNull())


def csv_ints(spark: SparkSession, path: str, scale: float, skip: int = 0, delim: str = ",", signed: bool = True) -> DataFrame:
    """ceil(x * scale) of single-precision cells; its magnitude if not ``signed``."""
    rows = csv_floats(spark, path, skip, delim)
    c = F.ceil(F.col("x").cast("float") * F.lit(scale).cast("float"))
    return rows.withColumn("x", (c if signed else F.abs(c)).cast("bigint"))


def with_positions(rows: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Dense positions 0..n-1 in ``order``. Range partitioning sorts, each partition counts its rows, and the counts'
    running sum (a row a partition) gives each partition its start; no window runs over all rows. The partitions are cut
    by checkpoint, since a second pass over them must see the same ones."""
    ranged = rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    from decafix.plans.lineage import cut

    ranged = cut(ranged)
    from pyspark.sql import Window

    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__start", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__l", local).join(starts, "__p").withColumn(out, (F.col("__start") + F.col("__l")).cast("bigint")).drop("__p", "__l", "__start")


def records(files: DataFrame, delim: int, fmt: str = "<d") -> DataFrame:
    """(file, at, x) of files (path, content), batch or stream, split on a byte; pieces of the format's size are decoded, others dropped. ``at`` counts pieces."""
    size = struct.calcsize(fmt)

    def run(batches):
        import pandas as pd

        for b in batches:
            for file, data in zip(b["path"], b["content"], strict=True):
                got = [(i, struct.unpack(fmt, piece)[0]) for i, piece in enumerate(bytes(data).split(bytes([delim]))) if len(piece) == size]
                yield pd.DataFrame({"file": file, "at": [g[0] for g in got], "x": [float(g[1]) for g in got]})

    return files.select("path", "content").mapInPandas(run, "file string, at long, x double")


def binary_records(spark: SparkSession, path: str, delim: int, fmt: str = "<d") -> DataFrame:
    """``records`` of the files at a path. A file is one value of its scan."""
    return records(spark.read.format("binaryFile").load(path), delim, fmt)
