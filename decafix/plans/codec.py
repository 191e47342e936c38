"""The extension point for codecs, and the built-in ones by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.operators import codecs, transforms


class Codec(Protocol):
    """A codec takes rows (pos, x) to encoded rows and back; both ways are lazy DataFrames."""

    def encode(self, series: DataFrame) -> DataFrame: ...

    def decode(self, encoded: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Segments:
    """Bounded values in one of the segment layouts."""

    precision: int
    layout: str = "plain"
    rows: int = codecs.SEGMENT_ROWS

    def encode(self, series: DataFrame) -> DataFrame:
        return codecs.encode(series, "x", self.precision, self.layout, rows=self.rows)

    def decode(self, encoded: DataFrame) -> DataFrame:
        return codecs.decode_segments(encoded)


@dataclass(frozen=True)
class Piecewise:
    """Means of runs of ``chunk`` positions; decoding repeats them over the positions that were there."""

    precision: int
    chunk: int

    def encode(self, series: DataFrame) -> DataFrame:
        means = transforms.paa(series, "x", self.chunk, self.precision)
        return means.join(series.groupBy(F.expr(f"pos div {self.chunk}L").alias("chunk")).agg(F.max("pos").alias("last")), "chunk")

    def decode(self, encoded: DataFrame) -> DataFrame:
        at = F.explode(F.sequence(F.col("chunk") * self.chunk, F.col("last")))
        return encoded.select(at.alias("pos"), F.col("mean_value").alias("value"))


@dataclass(frozen=True)
class Fourier:
    """The largest coefficients of segments of ``rows`` positions."""

    keep: float = 1.0
    rows: int = 4096

    def encode(self, series: DataFrame) -> DataFrame:
        data = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"])
        segments = series.groupBy(F.expr(f"pos div {self.rows}L").alias("segment")).agg(data.alias("data"))
        return transforms.fft(segments, self.keep, key="segment")

    def decode(self, encoded: DataFrame) -> DataFrame:
        back = transforms.ifft(encoded, key="segment", normalised=True)
        return back.select("segment", F.posexplode("data").alias("i", "value")).select((F.col("segment") * self.rows + F.col("i")).alias("pos"), "value")


CODECS: dict[str, Callable[..., Codec]] = {"paa": Piecewise, "fourier": Fourier} | {layout: (lambda precision, rows=codecs.SEGMENT_ROWS, layout=layout: Segments(precision, layout, rows)) for layout in codecs.LAYOUTS}


def predict_ratio(series: DataFrame, precision: int, layout: str, fraction: float, rows: int = 4096, seed: int = 0) -> DataFrame:
    """The compression ratio as a share of the segments, picked by a hash of their number, tells it. Sampling is the feature."""
    part = series.where(F.pmod(F.xxhash64(F.expr(f"pos div {rows}L"), F.lit(seed)), F.lit(10_000)) < int(fraction * 10_000))
    return codecs.ratio(codecs.encode(part, "x", precision, layout, rows=rows)).withColumn("fraction", F.lit(fraction))
