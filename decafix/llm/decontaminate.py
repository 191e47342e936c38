"""Benchmark decontamination by spaced-seed hashing, with SQL functions only.

A text leaks a benchmark item if, along one alignment of the two, some ``WINDOW`` = 13 consecutive places hold at least ``NEEDED`` = 11 equal
words (so two substituted words are tolerated, wherever they fall). Of an item of ``ONE_OFF`` = 7 to 12 words all but one must be equal; of one of 4 to 6 words, all.
Fewer than ``PHRASE`` = 4 words are no evidence inside a longer text: such an item leaks only into a text that holds its words and no others.

Every start of each mask in items and texts is hashed over the mask's kept positions; the ignored ones may differ. The masks of a length of item are lossless for
that definition: whichever places differ, one mask fits between (a test tries all of them). Masks of lengths that no item has aren't hashed. Item hashes are joined with text hashes, hits are
reduced to alignments (text, item, diagonal), and each alignment is verified over the whole item.

Item hashes are sent to all tasks while there are at most ``BROADCAST_HASHES``; beyond that the join is shuffled. Rows with a null or empty text
leak nothing. Rows without an id, repeated rows and repeated ids are each judged by their own text.

Further cases. Very long texts are read whole; a text's hits are reduced to alignments before they meet its words. Repeated items count once. Ties don't matter: the greatest
count of equal words is reported. Empty tables of either sort and items without words give no leaks. ``clean`` keeps extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.llm.words import row_key, words
from decafix.plans.lineage import cut

WINDOW, NEEDED, LONG, ONE_OFF, PHRASE = 13, 11, 11, 7, 4
#: Kept positions, and the least and greatest length of the items they serve (LONG: and any longer).
MASKS = (
    ((0, 1, 2, 3, 4, 6), LONG, LONG),
    ((0, 2, 3, 7, 8, 9), LONG, LONG),
    ((0, 1, 2, 3), ONE_OFF, LONG - 1),
    ((0, 1, 2, 4), ONE_OFF, LONG - 1),
    *[(tuple(range(n)), n, n) for n in range(1, ONE_OFF)],
)
BROADCAST_HASHES = 2_000_000


def tokens(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], masks: list[int], items: bool = False) -> DataFrame:
    """``keep``, the place and the hash of each of ``masks`` (by number) at each place of the token array ``t``. The hash runs after the explode, inside
    generated code, on the array that all rows of a text share."""
    at = rows.select(*keep, "t", F.posexplode("t").alias("place", "__w")).drop("__w")
    n, h = F.size("t"), []
    for i in masks:
        m, low, high = MASKS[i]
        fits = F.col("place") + m[-1] < n
        if items:
            fits &= F.least(n, F.lit(LONG)).between(low, high)
        elif high < PHRASE:
            fits &= n == high
        h.append(F.when(fits, F.xxhash64(F.lit(i), *[F.get("t", F.col("place") + o) for o in m])))
    return at.select(*keep, "t", "place", F.explode(F.array(*h)).alias("h")).where("h IS NOT NULL")


def needed(n: Column) -> Column:
    """Equal words within a window that make a leak of an item of ``n`` words."""
    return F.when(n >= ONE_OFF, F.least(F.lit(NEEDED), n - 1)).otherwise(n)


def _part(diagonal: Column) -> Column:
    """The words of ``t`` that lie along an item of ``n`` words."""
    return F.slice("t", F.greatest(diagonal, F.lit(0)) + 1, F.least(F.col("n"), F.col("n") + diagonal, F.size("t") - diagonal))


def alignments(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Verified (key, item, diagonal, matched, longest) of the texts, ``key`` naming the row."""
    it = items.select(F.col(item_id).alias("item"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0).distinct()
    it = cut(it.withColumn("i", F.xxhash64("item", "t")))
    sizes = [r[0] for r in it.select(F.least(F.size("t"), F.lit(LONG))).distinct().collect()]  # LONG rows at most
    masks = [i for i, (_, low, high) in enumerate(MASKS) if any(low <= n <= high for n in sizes or [LONG])]
    keys = seeds(it.select("i", "t").distinct(), ["i"], masks, items=True).select("h", "i", F.col("place").alias("ip"), F.size("t").alias("n")).distinct()
    few = keys.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    d = docs.select(row_key(F.col(doc_id), F.col(text)).alias("key"), tokens(F.col(text)).alias("t")).where(F.size("t") > min(MASKS[i][0][-1] for i in masks))
    diagonal = F.col("place") - F.col("ip")
    if few:  # a hit takes its part of the text's words along at once, as no text moves before the join
        hits = seeds(d, ["key"], masks).join(F.broadcast(keys), "h")
        lines = hits.select("key", "i", diagonal.alias("diagonal"), _part(diagonal).alias("part")).groupBy("key", "i", "diagonal").agg(F.any_value("part").alias("part"))
    else:  # hashes alone are shuffled; alignments then meet the words of the texts that have any
        hits = seeds(d, ["key"], masks).drop("t").join(keys, "h").select("key", "i", "n", diagonal.alias("diagonal")).distinct()
        lines = hits.join(d.distinct(), "key").select("key", "i", "diagonal", _part(F.col("diagonal")).alias("part"))
    lines = lines.join(it, "i")
    own = F.slice("t", F.greatest(-F.col("diagonal"), F.lit(0)) + 1, F.size("part"))
    same = F.zip_with("part", own, lambda a, b: F.when(a == b, 1).otherwise(0))
    lines = lines.select("key", "item", "diagonal", same.alias("same"), F.size("t").alias("n"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("same")), lambda s: F.aggregate(F.slice("same", s, F.lit(WINDOW)), F.lit(0), lambda x, y: x + y)))
    lines = lines.withColumn("best", best).where(F.col("best") >= needed(F.col("n")))
    return lines.select("key", "item", "diagonal", F.aggregate("same", F.lit(0), lambda x, y: x + y).alias("matched"))


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, contaminated, n_items (leaked items), matched (most equal words along one alignment)."""
    by = alignments(docs, items, doc_id, text).groupBy("key").agg(F.count_distinct("item").alias("n_items"), F.max("matched").alias("matched"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(by, "key", "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), zero("n_items"), zero("matched"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    bad = alignments(docs, items).select(F.col("key").alias("__bad")).distinct()
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == bad["__bad"], "left_anti")
