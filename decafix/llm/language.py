"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to 4 code points of the lower-cased text, hashed to ``BUCKETS``) by language come from a bounded number of labelled
texts of each language; every language that has labelled texts is learnt. Their smoothed logarithms are matrices of ``TOGETHER`` languages at most, each a broadcast of fixed size; more
languages are more matrices, scored one after the other, and the best language and the sum of all posteriors are carried from one to the next. A batch of texts is scored in
numpy: codes of all n-grams of the batch, one gather of matrix rows, sums by text. Every n-gram of every text counts, however long the text.

Results by case. Null and empty texts, and texts without a letter, are ``und`` with score 0. Rows without an id are predicted like any other and are never learnt from. Rows that
repeat an id, and equal rows, are predicted each by its own text. With no labelled text at all, every prediction is ``und``; an empty table gives no rows. Ties go to the language
that sorts first. Columns beyond those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decafix.llm.text import pieces
from decafix.plans.lineage import cut

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16
_PIECE = 1 << 18


#: Languages whose logarithms are one broadcast (64 MiB).
TOGETHER = 256


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learnt from: labelled texts of each language, and characters of the longest text that counts."""

    rows: int = 500
    longest: int = 32_768
    seed: int = 42


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    prior: np.ndarray

    def parts(self, together: int | None = None) -> list[Model]:
        k = together or TOGETHER
        return [Model(self.languages[i : i + k], np.ascontiguousarray(self.log_p[:, i : i + k]), self.prior[i : i + k]) for i in range(0, max(1, len(self.languages)), k)]


def codes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each code point (those that end in the array)."""
    x = points.astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            return
        h = (h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield (h >> np.uint64(48)).astype(np.int64)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each with a space on either side, and the texts' bounds."""
    low = [f" {t.lower()} " for t in texts]
    bounds = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=bounds[1:])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4"), bounds


def sums(texts: list[str], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods by language, n-grams) of each text. A text's n-grams never reach into the next one's."""
    total, n = np.zeros((len(texts), log_p.shape[1])), np.zeros(len(texts), np.int64)
    if not texts:
        return total, n
    x, bounds = points(texts)
    for at in range(0, len(x), _PIECE):  # starts of n-grams; n-grams end past the piece where they have to
        part = x[at : at + _PIECE + max(ORDERS) - 1]
        owner = np.searchsorted(bounds, np.arange(at, min(at + _PIECE, len(x))), "right") - 1
        first = owner[0]
        for order, code in zip(range(1, max(ORDERS) + 1), codes(part), strict=False):
            code = code[: len(owner)]
            own = owner[: len(code)]
            inside = np.arange(at, at + len(code)) + order <= bounds[own + 1]
            own, code = own[inside], code[inside]
            counts = np.bincount(own - first)
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            if len(code):
                total[own[starts]] += np.add.reduceat(log_p[code], starts, axis=0, dtype=np.float64)
                n[first : first + len(counts)] += counts
    return total, n


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of n-grams of a language's sample."""
    counts = np.zeros(BUCKETS, np.int64)
    for text in pdf["text"]:
        for code in codes(points([text])[0]):
            counts += np.bincount(code, minlength=BUCKETS)
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "counts": [counts.tobytes()]})


def fit(docs: DataFrame, sample: Sample = Sample(), learn: Column | None = None) -> Model:
    """The sample of a language is the rows first by a hash of the id, those of a length between 1 and ``longest``. Ranking reads ids alone; then one scan takes the chosen texts."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ok = ok.where(learn) if learn is not None else ok
    ids = ok.select(F.col("doc_id").alias("id"), "lang", F.xxhash64("doc_id", F.lit(sample.seed)).alias("h"))
    langs = cut(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    few = ids.join(F.broadcast(langs), "lang").where(F.pmod("h", F.lit(1 << 30)) <= F.lit(4.0 * sample.rows * (1 << 30)) / F.col("n"))
    best = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("r") <= sample.rows).select("id", F.col("lang").alias("l"))
    rows = ok.join(F.broadcast(best.distinct()), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).where(F.length("text").between(1, sample.longest))
    got = rows.select("lang", "text").groupBy("lang").applyInPandas(_counted, "lang string, counts binary").join(langs, "lang").collect()
    got.sort(key=lambda r: r["lang"])
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in got], axis=1).astype(float) if got else np.zeros((BUCKETS, 0))
    log_p = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    prior = np.array([float(r["n"]) for r in got])
    return Model([r["lang"] for r in got], log_p, np.log(prior / prior.sum()) if got else prior)


def decide(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(best language, its log-likelihood with the prior, the logarithm of all languages' sum) of each text; ``und`` and minus infinity where there is none."""
    has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
    if not model.languages or not has.any():
        none = np.full(len(texts), -np.inf)
        return ["und"] * len(texts), none, none
    total, _ = sums([t if h else "" for t, h in zip(texts, has, strict=True)], model.log_p)
    total = total + model.prior
    best, top = total.argmax(1), total.max(1)
    every = top + np.log(np.exp(total - top[:, None]).sum(1))
    return [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, top, -np.inf), np.where(has, every, -np.inf)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), together: int | None = None) -> DataFrame:
    """``keep``, lang_pred and score (the posterior of the prediction)."""
    kinds = dict(docs.dtypes)
    out, kept = docs.select(*keep, text), ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    parts = model.parts(together)
    for i, part in enumerate(parts):
        out = out.mapInArrow(_scoring(docs.sparkSession.sparkContext.broadcast(part), len(keep), i > 0, i + 1 < len(parts)), kept + (f", `{text}` {kinds[text]}" if i + 1 < len(parts) else "") + ", lang_pred string, top double, whole double")
    return out.select(*keep, "lang_pred", F.when(F.col("top") == F.lit(float("-inf")), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("top") - F.col("whole")))).alias("score"))


def _scoring(shared, n: int, later: bool, goes_on: bool):
    """A part of the model for rows (n kept columns, text, and after the first part lang_pred, top, whole); a later part's language must be better, not as good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, n):
                lang, top, whole = decide(piece.column(n).to_pylist(), shared.value)
                if later:
                    was, above, sum_ = piece.column(n + 1).to_pylist(), piece.column(n + 2).to_numpy(), piece.column(n + 3).to_numpy()
                    lang = [x if new > old else w for x, w, new, old in zip(lang, was, top, above, strict=True)]
                    top, whole = np.maximum(top, above), np.logaddexp(whole, sum_)
                held = piece.columns[: n + goes_on]
                yield pa.RecordBatch.from_arrays([*held, pa.array(lang, pa.string()), pa.array(top), pa.array(whole)], names=[*piece.schema.names[: n + goes_on], "lang_pred", "top", "whole"])

    return run
