"""Chunks of series with their chain: each segment knows how long before it the previous one began."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Span of time within which a series is ordered by one task.
STRIPE = "1 day"


def link(segments: DataFrame, ties: tuple[str, ...] = (), stripe: str = STRIPE) -> DataFrame:
    """(signal, timestamp, …) rows with the previous segment's timestamp and offset; null for a series' head. Equal timestamps are ordered by ``ties``. A series is cut
    into stripes of time: within one, a window; the timestamp before a stripe comes from the stripes' last ones (a row a stripe), so a busy series is many tasks."""
    rows = segments.withColumn("__s", F.window(F.col("timestamp").cast("timestamp"), stripe)["start"])
    ends = rows.groupBy(F.col("signal").alias("__g"), F.col("__s").alias("__at")).agg(F.max("timestamp").alias("__end"))
    before = ends.select("__g", "__at", F.lag("__end").over(Window.partitionBy("__g").orderBy("__at")).alias("__before"))
    own = F.lag("timestamp").over(Window.partitionBy("signal", "__s").orderBy("timestamp", *ties))
    out = rows.withColumn("prev_timestamp", own).join(before, F.col("signal").eqNullSafe(F.col("__g")) & (F.col("__s") == F.col("__at")), "left")
    out = out.withColumn("prev_timestamp", F.coalesce("prev_timestamp", "__before")).drop("__s", "__g", "__at", "__before")
    return out.withColumn("prev_seg_offset", F.col("timestamp") - F.col("prev_timestamp"))


def previous(segments: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of the segments before the given keys, by the stored offset."""
    rows = segments.join(keys, ["signal", "timestamp"])
    return rows.where(F.col("prev_seg_offset").isNotNull()).select("signal", (F.col("timestamp") - F.col("prev_seg_offset")).alias("timestamp"))


def chunk(df: DataFrame, signal: str, ts: str, x: str, rows: int, pos: str) -> DataFrame:
    """Segments of ``rows`` positions of each signal as ARRAY<DOUBLE>, ordered by position; a segment is bounded by
    ``rows``, so a busy signal is many groups."""
    g = df.groupBy(F.col(signal).alias("signal"), F.expr(f"`{pos}` div {int(rows)}L").alias("segment"))
    data = F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos), F.col(x)))), lambda s: s[x])
    return g.agg(F.min(ts).alias("timestamp"), data.alias("data"))
