"""Compression classifier for text quality.

Two zstandard dictionaries are built from good and from bad labelled texts. A whole text is compressed, piece by piece, with each;
the difference of the two sizes over the text's size says which kind it resembles. A logistic curve fitted on labelled
texts (each measured with dictionaries that it took no part in) turns the difference into a probability of good quality.

Only a bounded number of labelled texts is learnt from (``Sample``); scoring reads every byte of every text, however long, piece by piece.

Results by case. Null and empty texts have no sizes to compare and get the share of good labels as score. Rows with repeated ids, and rows without one, are scored each
by its own text; equal rows get equal scores. A label counts if its id has one distinct quality, 0 or 1; of an id's several texts the least is learnt from. Without labels of both
kinds (or with an empty table of either sort) nothing can be learnt: every score is the share of good labels, or 0.5 if there are none; no documents give no rows. A score at the
threshold is kept. Extra columns are kept by ``keep_good`` and not read by ``score``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.llm.text import blobs, pieces


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from: labelled texts of each kind, and bytes of the longest that counts."""

    rows: int = 2000
    longest: int = 32_768
    dictionary_bytes: int = 400_000
    seed: int = 42


#: A text is compressed in pieces of this size, so that the dictionary, not the text's own start, is what helps.
PIECE = 512
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]
    prior: float

    def scorer(self):
        if not self.good or not self.bad:
            return lambda texts: np.full(len(texts), self.prior)
        tools = _tools([self.good, self.bad])

        def run(texts: list[bytes]) -> np.ndarray:
            return self.probability(np.array([difference(t, *tools) for t in texts]).reshape(-1, 2))

        return run

    def probability(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x[:, 0] + w[2] * x[:, 1], -50, 50)))
        return np.where(np.isnan(x[:, 0]), self.prior, p)


def _prepared(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def difference(text: bytes, good, bad) -> tuple[float, float]:
    """((size under bad - size under good), the mean of both), over the size itself; NaN for an empty text."""
    if not text:
        return np.nan, np.nan
    g = b = 0
    for at in range(0, len(text), PIECE):
        piece = text[at : at + PIECE]
        g += len(good.compress(piece))
        b += len(bad.compress(piece))
    return (b - g) / len(text), (b + g) / (2 * len(text))


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; too little material to train on is taken as raw content."""
    samples = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] if sum(map(len, samples)) >= 8 else b""


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights by Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    scale = np.maximum(np.abs(a).max(0), 1e-9)
    a, w = a / scale, np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        grad = a.T @ (y - p) - 1e-3 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3), grad)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w / scale)


def labelled(docs: DataFrame, labels: DataFrame, sample: Sample, learn: Column) -> tuple[list[bytes], list[bytes], float]:
    """Texts of each kind (good, bad) and the share of good labels. Chosen by a hash of the id: the same rows at every run."""
    ok = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("q")).where("id IS NOT NULL AND q IN (0, 1)")
    ok = ok.groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("__top")).where("q = __top").select("id", "q").where(learn)
    share = ok.agg(F.avg("q")).collect()[0][0]
    first = lambda q: ok.where(F.col("q") == q).orderBy(F.xxhash64("id", F.lit(sample.seed)), "id").limit(sample.rows)
    ids = first(1).unionByName(first(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("t")).where(F.length("t").between(1, sample.longest))
    got = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("q").alias("q"), F.min("t").alias("t")).toPandas().sort_values("id")
    good, bad = ([bytes(t) for t in got["t"][got["q"] == q]] for q in (1, 0))
    return good, bad, 0.5 if share is None else float(share)


def _tools(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries]


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), learn: Column | None = None) -> Model:
    """``learn`` says by ``id`` which labels may be learnt from. The curve is set on two halves, each measured with dictionaries
    of the other, with both kinds weighted as they are among all labels; the model's dictionaries are of both halves."""
    good, bad, prior = labelled(docs, labels, sample, F.lit(True) if learn is None else learn)
    none = Model(b"", b"", (0.0, 0.0, 0.0), prior)
    if len(good) < 2 or len(bad) < 2:
        return none
    x, y = [], []
    for half in (0, 1):
        d = [build_dictionary(k[half::2], sample.dictionary_bytes) for k in (good, bad)]
        if not all(d):
            return none
        tools = _tools(d)
        for kind, k in ((1.0, good), (0.0, bad)):
            x += [difference(t, *tools) for t in k[1 - half :: 2]]
            y += [kind] * len(k[1 - half :: 2])
    w = list(calibrate(np.array(x), np.array(y)))
    shown = float(np.mean(y))
    w[0] += np.log(prior / (1 - prior)) - np.log(shown / (1 - shown))
    return Model(*[build_dictionary(k, sample.dictionary_bytes) for k in (good, bad)], tuple(w), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score. The model is a broadcast of two dictionaries of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for piece in pieces(batch, len(keep)):
                s = scorer(blobs(piece.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(s)], names=[*keep, "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def crc_mod(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % m


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: Sample = Sample()) -> DataFrame:
    """Documents whose score reaches the threshold, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.value.scorer()
        for s in batches:
            yield pd.Series(scorer([t.encode() if isinstance(t, str) else b"" for t in s]))

    return docs.where(run(F.col("text")) >= threshold)
