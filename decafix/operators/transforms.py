"""Piecewise means and Fourier transforms, the two lossy summaries of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.functions import decode, fraction_bits
from decafix.operators.aggregates import exact_sum
from decafix.operators.scan import bounded


def paa(df: DataFrame, x: str, chunk: int, precision: int, pos: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean of each run of ``chunk`` positions, of fixed-point values; the last run may be short."""
    rows = bounded(df, x, precision)
    return rows.groupBy(*keys, F.expr(f"`{pos}` div {int(chunk)}L").alias("chunk")).agg((decode(exact_sum(F.col("fx")), precision) / F.count("fx")).alias("mean_value"))


def paa_int(df: DataFrame, x: str, chunk: int, pos: str = "pos", keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``paa`` over integers, whose division truncates toward zero."""
    rows = df.where(F.col(x).isNotNull())
    return rows.groupBy(*keys, F.expr(f"`{pos}` div {int(chunk)}L").alias("chunk")).agg(F.expr(f"sum(cast(`{x}` as bigint)) div count(`{x}`)").alias("mean_value"))


def paa_expand(means: DataFrame, chunk: int, n_rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Decompression of ``paa``: every position of ``n_rows`` with its chunk's mean."""
    return n_rows.withColumn("chunk", F.expr(f"`{pos}` div {int(chunk)}L")).join(means, "chunk").select(pos, F.col("mean_value").alias("value"))


def fft(series: DataFrame, keep: float = 1.0, key: str = "signal", values: str = "data") -> DataFrame:
    """The full complex transform of each series (rows of key and ARRAY<DOUBLE>); with ``keep`` below 1, all but that
    share of the coefficients, the largest, are zero. A null or empty series gives an empty array."""

    def run(batches):
        for b in batches:
            re, im = [], []
            for v in b[values]:
                f = np.fft.fft(np.asarray(v, float)) if v is not None and len(v) else np.zeros(0, complex)
                if keep < 1 and len(f):
                    f[np.argsort(-np.abs(f), kind="stable")[max(1, int(len(f) * keep)) :]] = 0
                re.append(f.real)
                im.append(f.imag)
            yield pd.DataFrame({key: b[key], "re": re, "im": im})

    return series.select(key, values).mapInPandas(run, f"{key} {dict(series.dtypes)[key]}, re array<double>, im array<double>")


def ifft(spectra: DataFrame, key: str = "signal", normalised: bool = False) -> DataFrame:
    """Real parts of the inverse transform; not divided by n unless ``normalised``."""

    def run(batches):
        for b in batches:
            out = []
            for re, im in zip(b["re"], b["im"], strict=True):
                z = np.asarray(re, float) + 1j * np.asarray(im, float)
                out.append(np.fft.ifft(z).real * (1 if normalised else len(z)) if len(z) else np.zeros(0))
            yield pd.DataFrame({key: b[key], "data": out})

    return spectra.mapInPandas(run, f"{key} {dict(spectra.dtypes)[key]}, data array<double>")


#: Rows of a block of either side of the nearest-neighbour search.
KNN_BLOCK = 4096


def nearest_neighbour(train: DataFrame, test: DataFrame, precision: int, key: str = "vec_id", values: str = "embedding", label: str = "label", block: int = KNN_BLOCK) -> DataFrame:
    """1-NN at reduced precision: each test row with the label of the training row at the least squared distance of fixed-point values (ties: the least key; a row
    isn't its own neighbour). A stated query set against all rows, in blocks: both sides are dealt to blocks by a hash of the key, and each pair of blocks is a group of its own, so no
    side is collected or sent whole. Null vectors have no neighbours and are none."""
    scale = float(2 ** fraction_bits(precision))
    one = train.select(F.col(key).alias("k"), F.col(values).alias("v"), F.col(label).alias("l")).where("v IS NOT NULL")
    two = test.select(F.col(key).alias("k"), F.col(values).alias("v")).where("v IS NOT NULL")
    i, j = (max(1, -(-df.count() // block)) for df in (one, two))
    own = lambda n: F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one, two = one.withColumn("i", own(i)).withColumn("j", every(j)), two.withColumn("j", own(j)).withColumn("i", every(i))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a.sort_values("k", kind="stable")
            t, q = (np.trunc(np.stack(x["v"].to_numpy()).astype(float) * scale) for x in (a, b))
            tid, qid, lab = a["k"].to_numpy(), b["k"].to_numpy(), a["l"].to_numpy()
            for at in range(0, len(q), 512):
                p = q[at : at + 512]
                d = (p * p).sum(1)[:, None] - 2 * p @ t.T + (t * t).sum(1)[None, :]
                d[qid[at : at + 512, None] == tid[None, :]] = np.inf
                best = d.argmin(1)
                out += [(int(qid[at + r]), float(d[r, c]), int(tid[c]), int(lab[c])) for r, c in enumerate(best) if np.isfinite(d[r, c])]
        return pd.DataFrame(out, columns=["query_id", "distance", "near_id", "near_label"])

    near = one.groupBy("i", "j").cogroup(two.groupBy("i", "j")).applyInPandas(run, "query_id long, distance double, near_id long, near_label int")
    return near.groupBy("query_id").agg(F.min(F.struct("distance", "near_id", "near_label")).alias("m")).select("query_id", "m.near_id", "m.near_label", (F.col("m.distance") / (scale * scale)).alias("distance"))
