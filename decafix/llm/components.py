"""Connected components of a graph of ids by alternating large and small stars, each round one checkpoint.

Nothing is gathered: a round is two grouped minima and two joins over the edges, which Spark can split where a node has
very many neighbours, and the number of edges never grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.plans.lineage import cut

#: Edges that a task reduces at once to a spanning forest before the first round.
LOCAL_EDGES = 500_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of the edges, without the roots themselves; minima hop until they settle."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not (new[new] == new).all():
            new = new[new]
        if (new == root).all():
            break
        root = new
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        a, b = (np.concatenate([h.column(i).to_numpy(zero_copy_only=False) for h in held]) for i in (0, 1))
        u, v = spanning(a, b)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.withColumnRenamed("m", "v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its least node. Self-loops,
    repeated edges and edges with nulls count for nothing."""
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"), F.col(a).isNull().alias("an"), F.col(b).isNull().alias("bn")).where("u > v AND NOT an AND NOT bn").select("u", "v")
    e = cut(e.mapInArrow(_local, "u long, v long").distinct())  # tasks that saw the same group mostly found the same root
    said = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if now == said or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        said, e = now, cut(_small(_large(e)))
