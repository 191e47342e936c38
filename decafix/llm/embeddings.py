"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors have cosine c exactly where their squared distance is 2 - 2c. Vectors are scaled to length 1, rotated by a fixed random rotation and cut
into ``BLOCKS`` low-dimensional blocks; the blocks' squared distances add up, so a pair within the whole budget is within the block's share of it
(the budget times the block's share of the dimensions) in at least one block. Each block is range-joined by ``near_pairs``: homes are halved at the median of
their widest coordinate and visitors go on to the halves that lie within the block's radius, until few are left. A pair counts in the first block in which it is within the
share, and is verified there by its cosine in double precision.

How vectors meet depends on the size of their label, in tiles of ``TILE`` rows. A label of one tile is one task's work and each vector is sent once. One of up to ``DIRECT``
tiles is joined tile by tile, all blocks at once. A larger label is distributed by block: some coordinates of the block, more for larger labels, are laid on a grid of cells twice as wide as
the block's radius; a vector is at home in one cell and visits those that its box of that radius meets. Cells beyond a tile are cut into tiles of homes and of visitors, so no cell
or label is held whole. Results don't depend on any of these sizes.

Pairs aren't listed. Where homes and visitors meet, each home's verified neighbours are counted, and of the links a spanning forest goes on; so a dense cluster of
different vectors sends a number of rows that is linear in its size. Identical vectors of a label are one class with a count, so copies cost one row.

A vector that is null, empty, zero or holds a null or a non-finite component links with nothing, nor does one with a null label. Vectors of different
lengths don't link. Rows without a vec_id count as neighbours and connect others, but have no component; rows that repeat a vec_id with different
vectors are one node of the graph, each row with its own links. Long vectors are worked on whole. A cosine of exactly the threshold links. Equal vectors of a label link with each other
(ties in order go to the least vec_id). An empty table gives no rows. Columns beyond the three are not read, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decafix.llm.components import components, spanning
from decafix.plans.lineage import cut

COSINE = 0.98
BLOCKS = 8
#: Rows of 64 values in a tile; tiles up to which a label is joined tile by tile; crowded labels or cells up to which their list is sent to all tasks.
TILE, DIRECT, CROWDED = 16384, 64, 100_000
#: Grid coordinates of larger labels: (tiles up to, coordinates). A cell's coordinates are packed modulo 64, 6 bits each; cells that then share a place only compare more.
GRID = ((512, 4), (4096, 6), (None, 8))
#: The place of rows that meet in all blocks at once; else the lowest byte is the block.
ALL = 255
#: Room for rounding in the block search; verification decides.
SLACK = 1e-6
#: Homes that are not halved any more; candidate pairs verified at once.
_LEAF = 32
_PAIRS = 1 << 16


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[tuple[int, int]]:
    n = min(BLOCKS, dim)
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors of usable rows; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x.astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def share_of(cosine: float, width: int, dim: int) -> float:
    """The squared distance that a block of a pair of candidates has at most."""
    return (2 - 2 * cosine + SLACK) * width / dim


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, which rows, their vectors) of an Arrow list column without nulls."""
    lens = np.asarray(pc.list_value_length(vectors), np.int64)
    flat, ends = np.asarray(vectors.flatten()), np.cumsum(lens)
    for dim in np.unique(lens):
        pick = np.flatnonzero(lens == dim)
        yield int(dim), pick, flat[(ends[pick] - dim)[:, None] + np.arange(dim)]


def _meeting(cosine: float, whole: bool):
    """Rows (label, cls, copies, embedding, grid) to where each class is at home and visits: (label, place, home, cls, copies, embedding) if ``whole``, else
    (label, place, home, room), ``room`` being the vector's length. ``grid`` is the number of gridded coordinates, 0 for labels that meet at ``ALL``."""

    def out(batch: pa.RecordBatch, rows: np.ndarray, place: np.ndarray, home: np.ndarray, dim: int) -> pa.RecordBatch:
        at = pa.array(rows)
        cols = [batch.column(0).take(at), pa.array(place), pa.array(home)]
        if whole:
            return pa.RecordBatch.from_arrays([*cols, *[batch.column(i).take(at) for i in (1, 2, 3)]], names=["label", "place", "home", "cls", "copies", "embedding"])
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(rows), dim, np.int64))], names=["label", "place", "home", "room"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = batch.column(4).to_numpy(zero_copy_only=False)
            for dim, pick, x in by_length(batch.column(3)):
                for grid in np.unique(grids[pick]):
                    of = np.flatnonzero(grids[pick] == grid)
                    if not grid:
                        yield out(batch, pick[of], np.full(len(of), ALL, np.int64), np.ones(len(of), bool), dim)
                        continue
                    turned = units(x[of]) @ rotation(dim)
                    for b, (lo, hi) in enumerate(blocks_of(dim)):
                        radius, g = radius_of(share_of(cosine, hi - lo, dim)), min(int(grid), hi - lo)
                        part = turned[:, lo : lo + g]
                        low, high = (np.floor((part + s * radius) / (2 * radius)).astype(np.int64) for s in (-1, 1))
                        home = np.floor(part / (2 * radius)).astype(np.int64)
                        for corner in range(1 << g):
                            up = (corner >> np.arange(g)) & 1
                            rows = np.flatnonzero(~((up == 1) & (high == low)).any(1))  # each cell once
                            if len(rows):
                                cell = np.where(up, high, low)[rows]
                                place = ((cell & 63) << (6 * np.arange(g))).sum(1) << 8 | b
                                yield out(batch, pick[of][rows], place, (cell == home[rows]).all(1), dim)

    return run


def radius_of(share: float) -> float:
    return np.sqrt(share) * (1 + 1e-9) + 1e-9


def near_pairs(x: np.ndarray, y: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of rows of ``x`` and ``y`` within the squared distance ``share`` (a little more at most), each pair once."""
    radius, sy, room = radius_of(share), (y * y).sum(1), _PAIRS * 16
    todo = [(np.arange(len(x)), np.arange(len(y)))]
    while todo:
        a, b = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) > _LEAF and len(b) > _LEAF:
            spread = np.ptp(x[a], axis=0)
            c = int(spread.argmax())
            v, w = x[a, c], y[b, c]
            middle = np.partition(v, len(v) // 2)[len(v) // 2]
            less, below, above = v < middle, w < middle + radius, w >= middle - radius
            # a split that sends nearly all visitors both ways saves nothing
            if less.any() and below.sum() + above.sum() < 1.9 * len(b):
                todo += [(a[less], b[below]), (a[~less], b[above])]
                continue
        step = max(1, room // len(b))
        for at in range(0, len(a), step):
            p = x[a[at : at + step]]
            i, j = np.nonzero((p * p).sum(1)[:, None] + sy[b] - 2 * p @ y[b].T <= share + SLACK)
            yield a[i + at], b[j]


def tile_links(cosine: float, x: np.ndarray, y: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, visitor) numbers of verified pairs of unit vectors whose first candidate block this is, or all verified pairs if ``block`` is ``ALL``."""
    dim = x.shape[1]
    cuts, turn = blocks_of(dim), rotation(dim)
    rx, ry = x @ turn, y @ turn
    share = [share_of(cosine, hi - lo, dim) for lo, hi in cuts]
    for n, (lo, hi) in enumerate(cuts):
        if block not in (n, ALL):
            continue
        for i, j in near_pairs(np.ascontiguousarray(rx[:, lo:hi]), np.ascontiguousarray(ry[:, lo:hi]), share[n]):
            for k in range(0, len(i), _PAIRS):
                a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
                d = rx[a] - ry[b]
                d *= d
                inside = [d[:, lo:hi].sum(1) <= s for (lo, hi), s in zip(cuts[: n + 1], share, strict=False)]
                ok = inside[n]
                for earlier in inside[:n]:
                    ok &= ~earlier
                a, b = a[ok], b[ok]
                ok = (x[a] * y[b]).sum(1) >= cosine
                yield a[ok], b[ok]


def _tiles(cosine: float):
    """Sorted meeting rows to (cls, other, copies): a home's count of neighbours (other null), and links of a spanning forest (copies null)."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        home, cls, copies, side = (rows[c].to_numpy() for c in ("home", "cls", "copies", "side"))
        block = int(rows["place"][0].as_py()) & 0xFF
        count, left, right = np.zeros(len(cls)), [], []
        for _, pick, x in by_length(rows["embedding"].combine_chunks()):
            mine, theirs = np.flatnonzero(home[pick] & (side[pick] != 1)), np.flatnonzero(side[pick] != 0)
            if not len(mine) or not len(theirs):
                continue
            u = units(x)
            for a, b in tile_links(cosine, u[mine], u[theirs], block):
                a, b = pick[mine[a]], pick[theirs[b]]
                other = cls[a] != cls[b]
                a, b = a[other], b[other]
                if len(a):
                    count += np.bincount(a, weights=copies[b], minlength=len(cls))
                    s, t = spanning(cls[a], cls[b])
                    left.append(s)
                    right.append(t)
        got = np.flatnonzero(count)
        if len(got):
            s, t = spanning(np.concatenate(left), np.concatenate(right))
            none = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(cls[got]), pa.array(s)]), pa.concat_arrays([none(len(got)), pa.array(t)]), pa.concat_arrays([pa.array(count[got].astype(np.int64)), none(len(s))])], names=["cls", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))
            heads = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                if held and keys[a] != key:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                key = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of a list of crowded keys, which is sent to all tasks while it has at most ``CROWDED`` rows."""
    return rows.join(F.broadcast(few) if few.limit(CROWDED + 1).count() <= CROWDED else few, on, "left")


def links(classes: DataFrame, cosine: float = COSINE, tile: int | None = None) -> DataFrame:
    """(cls, other, n) for classes of (cls, label, copies, embedding): rows with a null ``other`` add n, the vectors of other classes that link with one of cls; the others are
    links that connect whatever is connected."""
    room = F.lit((tile or TILE) * 64)
    kinds = dict(classes.dtypes)
    tiles = F.col("room") / room
    grid = functools.reduce(lambda w, step: w.when(tiles <= step[0], step[1]) if step[0] else w.otherwise(step[1]), GRID, F.when(tiles <= DIRECT, 0))
    large = classes.groupBy("label").agg(F.sum(F.size("embedding")).alias("room")).select("label", grid.alias("grid")).where("grid > 0")
    slim = _with(classes.select("label", "cls", "copies", "embedding"), cut(large), ["label"]).withColumn("grid", F.coalesce("grid", F.lit(0)))
    rooms = slim.mapInArrow(_meeting(cosine, False), f"label {kinds['label']}, place long, home boolean, room long").groupBy("label", "place")
    rooms = rooms.agg(F.sum("room").alias("all"), F.sum(F.when(F.col("home"), F.col("room"))).alias("homes")).where(F.col("all") > room)
    crowded = cut(rooms.select("label", "place", F.ceil(F.coalesce("homes", F.lit(1)) / room).cast("int").alias("hs"), F.ceil(F.col("all") / room).cast("int").alias("vs")))
    rows = slim.mapInArrow(_meeting(cosine, True), f"label {kinds['label']}, place long, home boolean, cls long, copies long, embedding {kinds['embedding']}")
    rows = _with(rows, crowded, ["label", "place"])
    # in a crowded cell, tile (i, j) has the homes of cut i and the visitors of cut j; a row of an uncut cell serves as both at once
    mine = lambda cuts: F.pmod(F.xxhash64("cls"), F.col(cuts)).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("vs") - 1), lambda k: F.struct(mine("hs").alias("i"), k.alias("j"), F.lit(0).alias("side")))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda k: F.struct(k.alias("i"), mine("vs").alias("j"), F.lit(1).alias("side")))
    tiles = F.when(F.col("hs").isNull(), whole).when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)
    rows = rows.withColumn("t", F.explode(tiles)).select("label", "place", "t.i", "t.j", "t.side", "home", "cls", "copies", "embedding")
    dealt = rows.repartition("label", "place", "i", "j").sortWithinPartitions("label", "place", "i", "j")
    return dealt.mapInArrow(_tiles(cosine), "cls long, other long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding, label)."""
    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = cut(rows.withColumn("ok", usable).withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "embedding"))))
    classes = cut(rows.where("ok").groupBy("label", "embedding", "h").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("id")).withColumnRenamed("h", "cls"))
    found = cut(links(classes, cosine))
    counts = found.where("other IS NULL").groupBy("cls").agg(F.sum("n").alias("others")).withColumnRenamed("cls", "a")
    # groups of linked classes, each known by the least vec_id in it; rows that repeat an id tie groups together
    linked_classes = components(found.where("other IS NOT NULL"), "cls", "other").withColumnRenamed("node", "c")
    node = classes.join(linked_classes, classes["cls"] == linked_classes["c"], "left").select("cls", "id", F.coalesce("component", "cls").alias("group"))
    first = node.where("id IS NOT NULL").groupBy("group").agg(F.min("id").alias("least"))
    ids = cut(node.join(first, "group").select(F.col("cls").alias("h"), "least"))
    own = rows.where("ok AND vec_id IS NOT NULL").join(ids, "h").where("vec_id <> least").select(F.col("vec_id").alias("x"), F.col("least").alias("y"))
    linked = components(own, "x", "y")
    per = classes.join(counts, F.col("cls") == F.col("a"), "left").select(F.col("cls").alias("h"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "h").join(per, "h", "left").join(linked, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
