"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p^x / sum p^x. The exponent x in [0, 1] is found by bisection: the largest that still has the
target entropy (as a share of that of equal weights), raised where needed so that no source is repeated more than ``max_epochs`` times. x = 1
where the shares have that entropy already. Each source then gets floor(weight * budget) tokens: whole passes over its documents, and a part of one more.

Documents are dealt to ``blocks`` blocks by a hash of the id. Each pass of a source is a permutation of its blocks, keyed by (seed, source, epoch); the
last, partial pass takes blocks in that order while they fit, then documents of the next block in a hashed order while they fit. So totals by (source, block) decide almost everything, and only
one block of a source is ever ordered by document: a source with a third of all rows is no large group.

Tokens are runs of other than white space, of whole texts of any length.

Results by case. Rows without tokens (null, empty, white space) are no part of a mixture. A null source is a source of its own. Rows
without an id, or that repeat one, are told apart by their text; equal rows go together. Equal hashes are ordered by the row's key. An empty table gives an empty mixture.
Extra columns are kept by ``mix``, but for ``epoch`` and ``block_rank``, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decafix.llm.words import row_key
from decafix.plans.lineage import cut


@dataclass(frozen=True)
class Target:
    entropy: float = 0.95
    max_epochs: float = 4.0
    budget: int | None = None  # tokens; None: as many as there are
    blocks: int | None = None  # None: one for each BLOCK_ROWS rows, LEAST_BLOCKS at least
    seed: int = 42


#: Hex digits of the hash that deals documents to blocks.
DIGITS = 8
#: Rows that one block has on average where the number of blocks follows from the table, and the least number of blocks.
BLOCK_ROWS, LEAST_BLOCKS = 65_536, 128


#: Bisection: ROUNDS jobs, each halving the interval BITS times by looking at all points that those halvings could reach.
ROUNDS, BITS = 4, 5


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, target: Target) -> tuple[float, int]:
    """(exponent, budget) for rows of (source, t). Only sums over sources reach the driver, however many sources there are."""
    total, low, n = sources.agg(F.sum("t"), F.min("t"), F.count(F.lit(1))).collect()[0]
    if not n:
        return 1.0, 0
    budget = min(total if target.budget is None else target.budget, int(target.max_epochs * total))
    shares = sources.select((F.col("t") / F.lit(float(total))).alias("p"))
    a, width, least = 0.0, 1.0, low / total
    for _ in range(ROUNDS):
        step = width / (1 << BITS)
        points = [a + step * i for i in range(1, 1 << BITS)]
        sums = shares.agg(*[F.sum(f(F.pow("p", F.lit(x)))) for x in points for f in (lambda v: v, lambda v: v * F.log("p"))]).collect()[0]
        i, size = 0, 1 << BITS
        while size > 1:  # halve towards the smallest point that meets both limits
            mid = i + size // 2
            x, z, s = points[mid - 1], sums[2 * (mid - 1)], sums[2 * (mid - 1) + 1]
            enough = math.log(z) - x * s / z <= target.entropy * math.log(n) and budget / total * least ** (x - 1) / z <= target.max_epochs
            i, size = (i if enough else mid), size // 2
        a, width = a + step * i, step
    return a + width, budget


def plan(slim: DataFrame, target: Target) -> DataFrame:
    """(source, block, epoch, block_rank, remain): which blocks each pass of a source takes, in which order; ``remain`` is null for a whole block,
    else the tokens left for it. Rows of (source, block, t)."""
    totals = cut(slim.groupBy("source", "block").agg(F.sum("t").alias("t")))
    sources = totals.groupBy("source").agg(F.sum("t").alias("t"))
    x, budget = exponent(sources, target)
    z = sources.agg(F.sum("t").alias("all")).select("all")
    weighted = sources.crossJoin(F.broadcast(z)).withColumn("q", F.pow(F.col("t") / F.col("all"), F.lit(x)))
    weighted = weighted.crossJoin(F.broadcast(weighted.agg(F.sum("q").alias("z"))))
    shares = weighted.select("source", "t", F.floor(F.round(F.col("q") / F.col("z"), 12) * budget).cast("long").alias("b"))
    shares = shares.select(F.col("source").alias("s"), F.expr("b div t").cast("int").alias("full"), (F.col("b") % F.col("t")).alias("rest"))
    each = totals.join(shares, F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    order = Window.partitionBy("source", "epoch").orderBy(F.md5(F.concat_ws(":", F.lit(target.seed), F.coalesce("source", F.lit("")), "epoch", "block").cast("binary")), "block")
    each = each.withColumns({"block_rank": F.row_number().over(order), "end": F.sum("t").over(order)})
    each = each.withColumn("remain", F.when((F.col("epoch") == F.col("full")) & (F.col("end") > F.col("rest")), F.col("rest") - F.col("end") + F.col("t")))
    return each.where("remain IS NULL OR remain > 0").select("source", "block", "epoch", "block_rank", "remain")


def choose(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """(key, doc_id, source, epoch, block_rank, tokens) of every place of a document in the mixture; ``key`` names the row."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("k"), "key"))
    blocks = target.blocks or max(LEAST_BLOCKS, docs.count() // BLOCK_ROWS)
    slim = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("t")).where("t > 0")
    slim = cut(slim.withColumn("block", F.conv(F.substring(F.md5(F.concat(F.lit("b"), name).cast("binary")), 1, DIGITS), 16, 10).cast("long") % blocks))
    p = cut(plan(slim, target)).withColumnRenamed("source", "s").withColumnRenamed("block", "k")
    met = slim.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    out = ["key", "doc_id", "source", "epoch", "block_rank", F.col("t").alias("tokens")]
    order = Window.partitionBy("source", "epoch").orderBy(F.md5(F.concat_ws(":", F.lit(target.seed), name, "epoch").cast("binary")), "key")
    part = met.where("remain IS NOT NULL").withColumn("end", F.sum("t").over(order)).where("end <= remain")
    return met.where("remain IS NULL").select(*out).unionByName(part.select(*out))


def mix(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """``docs`` repeated as the mixture says, with epoch and block_rank: to read a source's pass in order, sort by them."""
    chosen = choose(docs, target).select(F.col("key").alias("__key"), "epoch", "block_rank").distinct()
    rows = docs.drop("epoch", "block_rank")
    return rows.join(chosen, row_key(rows["doc_id"], rows["text"]) == chosen["__key"]).drop("__key")
