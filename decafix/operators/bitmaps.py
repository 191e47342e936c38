"""Selections and id sets as relations: algebra, comparisons, buckets and the portable compressed form.

A set is a DataFrame with one BIGINT column of ids (``pos`` by default), distinct by construction of these functions.
All of it is shuffle-partitioned on the id; nothing gathers a set in one place, and the portable form gathers containers
(at most 65,536 of up to 8 KB), not ids.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 32
BUCKET = 65_536
_ARRAY_MAX = 4096
_COOKIE = 12_346


def of(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.select(F.col(pos).cast("bigint").alias(pos)).where(F.col(pos).isNotNull()).distinct()


def from_range(spark, a: int, b: int, pos: str = "pos") -> DataFrame:
    return spark.range(a, max(a, b)).withColumnRenamed("id", pos)


def from_bytes(df: DataFrame, at: str, data: str, pos: str = "pos") -> DataFrame:
    """Positions of ones of BINARY chunks that start at position ``at``; the first bit of a byte is its highest."""
    bits = F.explode(F.sequence(F.lit(0), F.length(data) * 8 - 1)).alias("__i")
    rows = df.where(F.length(data) > 0).select(F.col(at).alias("__at"), F.col(data).alias("__d"), bits)
    byte = F.conv(F.hex(F.expr("substring(__d, cast(__i div 8 as int) + 1, 1)")), 16, 10).cast("int")
    one = F.call_function("shiftright", byte, (7 - F.col("__i") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.where(one).select((F.col("__at") + F.col("__i")).cast("bigint").alias(pos))


def insert_words(base: DataFrame, words: DataFrame, at: str = "at", word: str = "word", pos: str = "pos") -> DataFrame:
    """ORs 32-bit words, lowest bit first, into a set at bit position ``at``."""
    bits = words.select(F.col(at).alias("__at"), F.col(word).cast("bigint").alias("__w"), F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("__i"))
    ones = bits.where(F.call_function("shiftright", F.col("__w"), F.col("__i")).bitwiseAND(F.lit(1)) == 1)
    return union(base, ones.select((F.col("__at") + F.col("__i")).cast("bigint").alias(pos)))


def insert_range(a: DataFrame, start: int, end: int, pos: str = "pos") -> DataFrame:
    return union(a, from_range(a.sparkSession, start, end, pos))


def remove_range(a: DataFrame, start: int, end: int, pos: str = "pos") -> DataFrame:
    return a.where(~((F.col(pos) >= start) & (F.col(pos) < end)))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in exactly one set: a count by id, in one shuffle."""
    return a.unionByName(b).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")


def negate(a: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return difference(from_range(a.sparkSession, 0, n, pos), a)


def contains(a: DataFrame, i: int, pos: str = "pos") -> bool:
    return not a.where(F.col(pos) == i).isEmpty()


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return difference(a, b).isEmpty()


def is_disjoint(a: DataFrame, b: DataFrame) -> bool:
    return a.join(b, a.columns, "left_semi").isEmpty()


def summary(a: DataFrame, pos: str = "pos") -> DataFrame:
    return a.agg(F.count(pos).alias("n"), F.min(pos).alias("min_id"), F.max(pos).alias("max_id"))


def boolean_algebra(a: Column, b: Column) -> dict[str, Column]:
    """Every operation of two selections as booleans over the rows they select from; this is the form to prefer."""
    return {"and": a & b, "or": a | b, "xor": a != b, "andnot": a & ~b, "nand": ~(a & b), "nor": ~(a | b), "xnor": a == b, "not": ~a}


def flags(df: DataFrame, bit: Column) -> DataFrame:
    """all, none, any of a selection; an empty one has all and none."""
    yes = F.count(F.when(bit, 1))
    return df.agg((yes == F.count(F.lit(1))).alias("all_set"), (yes == 0).alias("none_set"), (yes > 0).alias("any_set"))


def packed(a: DataFrame, pos: str = "pos") -> DataFrame:
    """Bitmap values by bucket of 32,768 positions, built by partial aggregates."""
    p = F.col(pos) + 1
    return a.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))


def packed_count(p: DataFrame) -> DataFrame:
    return p.agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("n"))


def packed_combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """``or`` or ``and`` of packed sets. ``and`` keeps only buckets that both have, as a missing bucket is empty."""
    both = a.unionByName(b).groupBy("bucket")
    if op == "or":
        return both.agg(F.bitmap_or_agg("bits").alias("bits"))
    return both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("__n")).where("__n = 2").drop("__n")


def containers(a: DataFrame, pos: str = "pos") -> DataFrame:
    """Cardinality of each 65,536-id container."""
    return a.groupBy(F.shiftright(F.col(pos), 16).alias("key")).agg(F.count(F.lit(1)).alias("cardinality"))


def portable_size(a: DataFrame, pos: str = "pos") -> DataFrame:
    """Bytes of the portable form of ids (repeats allowed): 8, and for each container 8 and 2 a value or 8,192. Ids become bits on the map side, so only bitmap values are shuffled."""
    halves = packed(a.where(F.col(pos).isNotNull()), pos).select(F.expr("(bucket - 1) div 2").alias("key"), F.bitmap_count("bits").alias("c"))
    sizes = halves.groupBy("key").agg(F.sum("c").alias("cardinality"))
    return sizes.agg((F.lit(8) + F.coalesce(F.sum(F.lit(8) + F.least(2 * F.col("cardinality"), F.lit(8192))), F.lit(0))).cast("bigint").alias("n_bytes"))


def _container(pdf: pd.DataFrame) -> pd.DataFrame:
    low = np.sort(pdf["low"].to_numpy(np.int64)).astype(np.uint16)
    if len(low) <= _ARRAY_MAX:
        body = low.astype("<u2").tobytes()
    else:
        bits = np.zeros(BUCKET, np.uint8)
        bits[low] = 1
        body = np.packbits(bits, bitorder="little").tobytes()
    return pd.DataFrame({"hi": [int(pdf["hi"].iloc[0])], "key": [int(pdf["key"].iloc[0])], "cardinality": [len(low)], "body": [body]})


def container_rows(a: DataFrame, pos: str = "pos") -> DataFrame:
    """(hi, key, cardinality, body): the portable form's containers as rows, the form to store and to pass on; a group is at most 65,536 ids."""
    parts = a.select(F.shiftright(F.col(pos), 32).alias("hi"), F.shiftright(F.col(pos), 16).bitwiseAND(F.lit(65_535)).alias("key"), F.col(pos).bitwiseAND(F.lit(65_535)).alias("low"))
    return parts.groupBy("hi", "key").applyInPandas(_container, "hi long, key long, cardinality long, body binary")


def container_ids(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """The ids of container rows."""

    def run(batches):
        for b in batches:
            for hi, key, n, body in zip(b["hi"], b["key"], b["cardinality"], b["body"], strict=True):
                yield pd.DataFrame({pos: _low(bytes(body), 0, int(n))[0] + (int(hi) << 32) + (int(key) << 16)})

    return rows.select("hi", "key", "cardinality", "body").mapInPandas(run, f"{pos} long")


def serialize(a: DataFrame, pos: str = "pos") -> DataFrame:
    """For export: a row (hi, data) for each upper 32 bits of the ids, the portable serialisation of the lower 32 (up to 512 MB, as the format is one value). Otherwise use
    ``container_rows``."""
    return container_rows(a, pos).groupBy("hi").applyInPandas(lambda pdf: pd.DataFrame({"hi": [int(pdf["hi"].iloc[0])], "data": [_assemble(pdf)]}), "hi long, data binary")


def _assemble(pdf: pd.DataFrame) -> bytes:
    pdf = pdf.sort_values("key")
    n = len(pdf)
    head = struct.pack("<II", _COOKIE, n) + b"".join(struct.pack("<HH", k, c - 1) for k, c in zip(pdf["key"], pdf["cardinality"], strict=True))
    at = len(head) + 4 * n + np.concatenate([[0], np.cumsum([len(b) for b in pdf["body"]])[:-1]]).astype(np.int64)
    return head + at.astype("<u4").tobytes() + b"".join(pdf["body"])


def _low(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(lower 16 bits of a container's ids, its bytes) from its body at ``at``."""
    if n <= _ARRAY_MAX:
        return np.frombuffer(data, "<u2", n, at).astype(np.int64), 2 * n
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little")).astype(np.int64), 8192


def parse(data: bytes) -> np.ndarray:
    """Ids of a portable serialisation without run containers."""
    cookie, n = struct.unpack_from("<II", data)
    if cookie != _COOKIE:
        raise ValueError("not a portable bitmap without runs")
    at, out = 8 + 8 * n, []
    for i in range(n):
        key, c = struct.unpack_from("<HH", data, 8 + 4 * i)
        low, size = _low(data, at, c + 1)
        out.append(low + (key << 16))
        at += size
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def deserialize(df: DataFrame, pos: str = "pos") -> DataFrame:
    def run(batches):
        for b in batches:
            for hi, data in zip(b["hi"], b["data"], strict=True):
                yield pd.DataFrame({pos: parse(bytes(data)) + (int(hi) << 32)})

    return df.select("hi", "data").mapInPandas(run, f"{pos} long")


def append(a: DataFrame, n: int, b: DataFrame, pos: str = "pos") -> DataFrame:
    """The bits of ``b`` after the ``n`` bits of ``a``."""
    return a.unionByName(b.select((F.col(pos) + n).alias(pos)))


def split_off(a: DataFrame, at: int, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Bits before ``at``, and those from it on counted from zero."""
    return a.where(F.col(pos) < at), a.where(F.col(pos) >= at).select((F.col(pos) - at).alias(pos))


def truncate(a: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    return a.where(F.col(pos) < n)


def first_difference(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """One row that orders two bit vectors of one length: the first bit in exactly one of them (null: equal), and whether ``a`` has it, which makes
    ``a`` the greater."""
    both = a.withColumn("__a", F.lit(True)).unionByName(b.withColumn("__a", F.lit(False))).groupBy(pos).agg(F.count(F.lit(1)).alias("__n"), F.max("__a").alias("__a"))
    return both.where("__n = 1").agg(F.min(pos).alias("first"), F.min_by("__a", pos).alias("a_is_greater"))


def to_binary(a: DataFrame, n: int, pos: str = "pos", rows: int = 1 << 20) -> DataFrame:
    """A bit vector of ``n`` bits as BINARY chunks (at, bits, data) of ``rows`` bits: the number of bits as a 64-bit word, then 32-bit words, low
    bits first, so that a chunk is a whole serialisation by itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["chunk"].iloc[0]) * rows
        size = min(rows, n - at)
        bits = np.zeros(-(-size // WORD) * WORD, np.uint8)
        own = pdf["p"].dropna().to_numpy(np.int64) - at
        bits[own[(own >= 0) & (own < size)]] = 1
        return pd.DataFrame({"at": [at], "bits": [size], "data": [struct.pack("<Q", size) + np.packbits(bits, bitorder="little").tobytes()]})

    every = a.sparkSession.range(0, -(-n // rows)).select(F.col("id").alias("chunk"), F.lit(None).cast("long").alias("p"))
    own = a.where((F.col(pos) >= 0) & (F.col(pos) < n)).select(F.expr(f"`{pos}` div {rows}L").alias("chunk"), F.col(pos).alias("p"))
    return own.unionByName(every).groupBy("chunk").applyInPandas(run, "at long, bits long, data binary")


def from_binary(df: DataFrame, pos: str = "pos") -> DataFrame:
    def run(batches):
        for b in batches:
            for at, data in zip(b["at"], b["data"], strict=True):
                (size,) = struct.unpack_from("<Q", data)
                yield pd.DataFrame({pos: np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8), bitorder="little")[:size]) + int(at)})

    return df.select("at", "data").mapInPandas(run, f"{pos} long")
