"""SimHash near-dedup with pivot distance tables.

1. A fingerprint of each text: 64 majority votes of the XXH64 hashes of its three-word shingles, copies counted.
2. Texts with equal fingerprints become one class; only classes go on.
3. A pivot distance table: the Hamming distances of each class's fingerprint to ``PIVOTS`` reference fingerprints, computed once and carried packed, a byte each.
4. Classes meet by the pigeonhole rule: two differing bits touch at most two of the four 16-bit lanes, so fingerprints within ``RADIUS`` = 2 bits have two
   whole lanes in common, and an equi-join on each of the six pairs of lanes loses none. Of those that meet, pairs whose largest coordinate difference exceeds the radius are
   discarded (by the triangle inequality they are too far apart); survivors are verified by their bits.
5. A set of fingerprints that share such a key with more than ``DENSE`` others is a dense cluster: its pairs aren't listed. There, references are local: each member's own fingerprint
   and its one-bit neighbours. Members at distance 1 or less from the same local reference are within 2 of each other (triangle inequality), and any two within 2 share one; so
   each reference links its members to the least of them. That is exact and linear in the cluster's size.
6. Components of the links, by stars.

Results by case. Null and empty texts, or texts of white space, have fingerprint zero, linked like any other. Very long texts are read whole, in runs of shingles. Rows without a doc_id
get a fingerprint and a null component, and link nothing. A repeated doc_id is one node: each row has its own fingerprint, and what any of its rows links is tied
together. Equal rows are returned as often as they occur. Ties don't arise (a bit is set by more than half). An empty table gives an empty result. Columns beyond the id and
the text are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.llm.components import components
from decafix.llm.text import blobs, pieces
from decafix.plans.lineage import cut

RADIUS = 2
LANES, LANE_BITS = 4, 16
#: Reference fingerprints of the pivot distance table, drawn from a fixed seed.
PIVOTS = 16
#: Classes that share a key up to which their pairs are listed.
DENSE = 32
_SHINGLES = 1 << 18


def count_bits(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of bytes, lowest bit first; sums of at most 255 rows fit in bytes."""
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    votes = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):
        votes += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return votes


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints of UTF-8 texts as uint64. Shingles of a long text are voted on in runs of bounded length."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        width = min(shingle, len(words))
        first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
        votes = np.zeros(64, np.int64)
        for at in range(0, len(first), _SHINGLES):
            h = np.array([digest(flat[a:b], seed) for a, b in zip(first[at : at + _SHINGLES], last[at : at + _SHINGLES], strict=True)], "<u8")
            votes += count_bits(h.view(np.uint8).reshape(-1, 8))
        out[i] = (weights[votes * 2 > len(first)]).sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and fp BIGINT (the fingerprint's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, len(keep)):
                fp = fingerprints_of(blobs(piece.column(len(keep)))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(fp)], names=[*keep, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fp long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def references() -> list[int]:
    return np.random.default_rng(64).integers(-(1 << 63), 1 << 63, PIVOTS).tolist()


def coordinates(fps: DataFrame) -> DataFrame:
    """The pivot distance table: distances to the references in BIGINTs p0, p1, ..., eight to each."""
    far = [F.shiftleft(hamming(F.col("fp"), F.lit(r)).cast("long"), 8 * (i % 8)) for i, r in enumerate(references())]
    return fps.withColumns({f"p{i // 8}": reduce(lambda x, y: x.bitwiseOR(y), far[i : i + 8]) for i in range(0, PIVOTS, 8)})


def within(p: str, q: str) -> Column:
    """No coordinate of two packed words differs by more than the radius."""
    at = lambda c, i: F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    return F.greatest(*[F.abs(at(p, i) - at(q, i)) for i in range(8)]) <= RADIUS


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between classes, rows of (fp, id): enough of them to connect every two within the radius."""
    lane = [F.shiftrightunsigned("fp", n * LANE_BITS).bitwiseAND(F.lit((1 << LANE_BITS) - 1)) for n in range(LANES)]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("lanes"), (F.shiftleft(lane[x], LANE_BITS) + lane[y]).alias("key")) for i, (x, y) in enumerate(combinations(range(LANES), 2))])
    rows = fps.select("fp", "id", F.explode(keys).alias("f")).select("fp", "id", "f.lanes", "f.key")
    sizes = rows.groupBy("lanes", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = cut(rows.join(sizes, ["lanes", "key"]))
    few = coordinates(rows.where(F.col("size") <= DENSE)).drop("size")
    words = [f"p{i}" for i in range(PIVOTS // 8)]
    other = few.select("lanes", "key", *[F.col(c).alias(f"{c}_2") for c in ("fp", "id", *words)])
    survive = few.join(other, ["lanes", "key"]).where("id < id_2")
    for w in words:
        survive = survive.where(within(w, f"{w}_2"))
    sparse = survive.where(hamming(F.col("fp"), F.col("fp_2")) <= RADIUS).select(F.col("id").alias("a"), F.col("id_2").alias("b"))
    return sparse.unionByName(_dense(rows.where(F.col("size") > DENSE).select("fp", "id").distinct()))


def _dense(fps: DataFrame) -> DataFrame:
    """Links of members of dense clusters through local references. The references' members are counted by partial
    minima, so a popular reference is no large group."""
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    local = fps.select("id", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    least = local.groupBy("z").agg(F.min("id").alias("a"), F.max("id").alias("top")).where("a < top").select("z", "a")
    return local.join(least, "z").where("id > a").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for every row of ``docs``."""
    fp = cut(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))))
    classes = cut(fp.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")))
    # ids with several fingerprints tie their classes together
    known = fp.where("doc_id IS NOT NULL")
    again = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    ties = known.join(again, "doc_id", "left_semi").join(classes, "fp").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    linked = components(links(classes).unionByName(ties))
    least = classes.join(linked, classes["id"] == linked["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = fp.join(least, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# ---- near-duplicate texts: wide fingerprints link most of a group, an exact join of shingle sets finds the rest ----

#: Five-word shingles, compared as sets. Fingerprints of 256 bits of those sets only link in advance; what they miss, the join of shingle sets finds.
SHINGLE, SIMILARITY = 5, 0.8
WIDE, FAMILIES, FAMILY_BITS = 4, 24, 57
#: In the search that links in advance: rows before a class in a family's order that are looked at, the nearest of them that are candidates within WIDE_RADIUS bits, and the nearest
#: candidates of a class that are verified. None of them bounds what is found in the end.
BESIDE, NEAREST, WIDE_RADIUS, TRIED = 8, 2, 56, 4
#: Classes of a shingle's run beyond which it is cut into tiles.
TILE = 4096
#: Shingles of at least FREQUENT documents of one task, the most frequent LISTED of all, are sent to all tasks; a task counts its documents' shingles in a table of HELD at most, of which
#: the rarest go when it is full. They only set the order in which shingles are taken as keys; any order finds every pair.
FREQUENT, LISTED, HELD = 2, 65_536, 1 << 19
#: Words of 64 bits in the bitmap of the ids that a join asks for.
WORDS = 1 << 18
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def wide_of(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of 256 bits as rows of 4 uint64, of sets of shingle hashes: each hash is mixed four ways and votes once."""
    out = np.zeros((len(sets), 32), np.uint8)
    for i, hashes in enumerate(sets):
        votes = np.zeros(64 * WIDE, np.int64)
        for at in range(0, len(hashes), _SHINGLES // WIDE):
            h = hashes[at : at + _SHINGLES // WIDE]
            x = h[:, None] * np.array(_MIX)
            x ^= x >> np.uint64(32)
            x *= _MIX[0]
            x ^= x >> np.uint64(29)
            votes += count_bits(x.view(np.uint8).reshape(len(h), 32))
        out[i] = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return out.view("<u8")


def family_bits() -> np.ndarray:
    """The bits of each family in order, drawn from a fixed seed: its references are zero and those single bits, whose distances relative to zero's are the bits."""
    g = np.random.default_rng(20_240)
    return np.stack([g.permutation(64 * WIDE)[:FAMILY_BITS] for _ in range(FAMILIES)])


def _family_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, fingerprint): for each family its number and its bits, the first of them highest, so that fingerprints that agree in many of the first bits are sorted side by side."""
    places, weights = family_bits(), 1 << np.arange(FAMILY_BITS, dtype=np.int64)[::-1]
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            wide = np.stack([part.column(i).to_numpy() for i in range(1, WIDE + 1)], axis=1).astype("<i8")
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
            for f, p in enumerate(places):
                yield pa.RecordBatch.from_arrays([pa.array((bits[:, p] @ weights) | (f << FAMILY_BITS)), *part.columns], names=["key", "id", *[f"f{i}" for i in range(WIDE)]])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, bits, other) of rows sorted by key: each with the nearest ``NEAREST`` of the ``BESIDE`` rows before it, as far as they differ in at most ``WIDE_RADIUS`` bits. No run is held."""
    ids, fps = np.zeros(0, np.int64), np.zeros((0, WIDE), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        first = min(len(ids), BESIDE)
        ids = np.concatenate([ids[-BESIDE:], batch.column(1).to_numpy()])
        fps = np.concatenate([fps[-BESIDE:], np.stack([batch.column(2 + i).to_numpy() for i in range(WIDE)], axis=1)])
        own = np.arange(first, len(ids))
        far = np.full((len(own), BESIDE), 64 * WIDE + 1)
        for step in range(1, min(BESIDE, len(ids) - 1) + 1):
            i = own[own >= step]
            far[i - first, step - 1] = np.bitwise_count((fps[i] ^ fps[i - step]).view(np.uint64)).sum(1)
        best = np.argsort(far, axis=1, kind="stable")[:, :NEAREST]
        row, col = np.nonzero(np.take_along_axis(far, best, 1) <= WIDE_RADIUS)
        step = best[row, col] + 1
        yield pa.RecordBatch.from_arrays([pa.array(ids[own[row]]), pa.array(far[row, step - 1]), pa.array(ids[own[row] - step])], names=["id", "bits", "other"])


def shingle_hashes(text: bytes, seed: int = 42) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's five-word shingles (fewer words: of the whole sequence)."""
    digest, words = xxhash.xxh64_intdigest, text.lower().split()
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words] or [1]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(ends))
    first, last = starts[: len(ends) - width + 1].tolist(), ends[width - 1 :].tolist()
    runs = [np.unique(np.array([digest(flat[a:b], seed) for a, b in zip(first[at : at + _SHINGLES], last[at : at + _SHINGLES], strict=True)], np.uint64)) for at in range(0, len(first), _SHINGLES)]
    return runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))


def prefix_of(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order (frequent ones last), so many that two sets ``SIMILARITY`` alike share one: such sets have SIMILARITY * n of this one's n in common."""
    n = len(hashes)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(np.where(frequent[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[: n - math.ceil(SIMILARITY * n * (1 - 1e-12)) + 1]


def sketch_of(hashes: np.ndarray) -> bytes:
    """A set's parities in buckets of its hashes, a power of two of at least twice its size. Two sets' sketches differ in no more bits than the sets in members."""
    b = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Differing bits, the longer sketch folded to the shorter's buckets."""
    if len(x) > len(y):
        x, y = y, x
    a, b, n = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while n > 8 * len(x):
        n >>= 1
        b = (b ^ (b >> n)) & ((1 << n) - 1)
    return (a ^ b).bit_count()


def pivots_of(hashes: np.ndarray) -> bytes:
    """A set's row of the pivot distance table. Hashes fall into cells by their low bits, a power of two of at least an eighth of the set's size; a cell's reference is the half of
    its hashes with the highest bit set. A coordinate is the set's distance to that reference within the cell (how many hashes are in one of them only), less the reference's size, a signed
    byte. Empty if one doesn't fit a byte; such a row discards nothing."""
    b = 1 << max(4, (len(hashes) - 1).bit_length() - 3)
    cells = (hashes & np.uint64(b - 1)).astype(np.int64)
    far = np.bincount(cells, minlength=b) - 2 * np.bincount(cells[hashes >> np.uint64(63) == 1], minlength=b)
    return far.astype(np.int8).tobytes() if np.abs(far).max() < 128 else b""


def pivot_bounds(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each two rows of the pivot distance table, in how many members their sets differ at least: by the triangle inequality that many in each cell as the distances to its reference
    differ by, and cells have no hash in common. The longer row's cells are first added up to the shorter's."""
    out, alike = np.zeros(len(x), np.int64), {}
    for i, (u, v) in enumerate(zip(x, y, strict=True)):
        if u and v:
            alike.setdefault((len(u), len(v)), []).append(i)
    for (m, n), at in alike.items():
        u, v = (np.frombuffer(b"".join([c[i] for i in at]), np.int8).reshape(len(at), -1, min(m, n)).sum(1, dtype=np.int64) for c in (x, y))
        out[at] = np.abs(u - v).sum(1)
    return out


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the pairs (a, b, na, nb, pa, pb, sa, sb) that neither the pivot distance table nor, of those left, the bits of the sketches tell apart."""
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * (1 + 1e-12)
    for batch in batches:
        sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        near = pivot_bounds(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= most * sizes
        batch, sizes = batch.filter(pa.array(near)), sizes[near].tolist()
        ok = [sketch_distance(u, v) <= most * n for n, u, v in zip(sizes, batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _meet(span: np.ndarray, at: np.ndarray, group: np.ndarray, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) numbers of rows of one run, of different groups, that can be ``SIMILARITY`` alike if this is the first shingle that they share; ``at`` numbers the runs, rows of a run being
    side by side. A pair that is alike passes at its first shingle, so none is lost."""
    size, left = span >> 32, (span >> 32) - (span & 0xFFFFFFFF)
    ends = np.searchsorted(at, at, "right")
    i, step = np.arange(len(at)), 0
    while True:
        step += 1
        i = i[i + step < ends[i]]
        if not len(i):
            return
        j = i + step
        ok = (group[i] != group[j]) & (np.minimum(left[i], left[j]) * (1 + SIMILARITY) * (1 + 1e-12) >= SIMILARITY * (size[i] + size[j]))
        if side is not None:
            ok &= (side[i] != side[j]) | (side[i] < 0)
        if ok.any():
            yield i[ok], j[ok]


def _shingle_pairs(tiled: bool, tile: int):
    """Rows sorted by key, of (key, id, span, group), to candidate pairs (a, b). Rows of longer runs than ``tile`` pass on instead, as (id, null, key, span, group); of tiles, with the side
    of a row as fifth column, none do."""
    names = ["a", "b", "key", "span", "group"]

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, ids, span, group = rows[:4]
        if not len(key):
            return
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        mixed = np.minimum.reduceat(group, heads) != np.maximum.reduceat(group, heads)
        keep = np.repeat(mixed, np.diff(np.append(heads, len(key))))
        number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))[keep]
        ids, side = ids[keep], rows[4][keep] if tiled else None
        held, n = [], 0
        for i, j in _meet(span[keep], number, group[keep], side):
            held.append((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])))
            n += len(i)
            if n >= 1 << 17:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    def out(held) -> pa.RecordBatch:
        a, b = (pa.array(np.concatenate([h[k] for h in held])) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b, *[pa.nulls(len(a), pa.int64())] * 3], names=names)

    def passed(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, ids, span, group = (pa.array(x) for x in rows)
        return pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), key, span, group], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long = None, None  # the last run so far; the key of a run that passes on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if long is not None:
                n = int(np.searchsorted(rows[0], long, "right"))
                if n:
                    yield passed([x[:n] for x in rows])
                if n == len(rows[0]):
                    continue
                rows, long = [x[n:] for x in rows], None
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            yield from pairs([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if not tiled and len(held[0]) > tile:
                yield passed(held)
                held, long = None, int(held[0][0])
        if held is not None:
            yield from pairs(held)

    return run


def _most(h: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their counts added up, sorted by hash; if more than ``most``, as many of the greatest counts as fit without cutting equal counts apart."""
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    h, n = h[heads], np.add.reduceat(n, heads) if len(h) else n
    if len(h) > most:
        keep = n > np.partition(n, len(n) - most - 1)[len(n) - most - 1]
        h, n = h[keep], n[keep]
    return h, n


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that most documents hold. Each task counts all its documents in a table of bounded size, and tables are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for piece in pieces(batch, 0):
                new = np.concatenate([shingle_hashes(t) for t in blobs(piece.column(0))])
                held.append(new)
                size += len(new)
                if size > HELD:
                    h, n = _most(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]), HELD // 2)
                    held, size = [], 0
        h, n = _most(np.concatenate([h, *held]), np.concatenate([n, np.ones(size, np.int64)]), HELD)
        h, n = _most(h[n >= FREQUENT], n[n >= FREQUENT], LISTED)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = cut(counts.orderBy(F.desc("n"), "h").limit(LISTED)).collect()  # collected as it is, each partition's list would go to the driver
    h, n = np.array([x["h"] for x in top], np.int64).view(np.uint64), np.array([x["n"] for x in top], np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def alike(sets: DataFrame, tile: int | None = None) -> DataFrame:
    """Candidate pairs (a, b), a < b and each once, of rows of (id, n, prefix, group): of different groups and among them every pair whose sets are ``SIMILARITY`` alike."""
    tile = tile or TILE
    rows = sets.select("id", "n", "group", F.posexplode("prefix").alias("pos", "key"))
    rows = rows.select("key", "id", F.expr("shiftleft(n, 32) + pos").alias("span"), "group").repartition("key").sortWithinPartitions("key")
    kinds = "a long, b long, key long, span long, group long"
    met = cut(rows.mapInArrow(_shingle_pairs(False, tile), kinds).distinct())
    crowded = met.where("b IS NULL").select("key", F.col("a").alias("id"), "span", "group")
    pairs = met.where("b IS NOT NULL").select("a", "b")
    if crowded.isEmpty():
        return pairs
    sizes = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("cuts"))
    dealt = crowded.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    place = F.xxhash64("key", F.least("own", "k"), F.greatest("own", "k"))
    side = F.when(F.col("own") == F.col("k"), -1).otherwise(F.col("own")).cast("long")
    # tile (i, i) pairs the rows of cut i with each other, tile (i, j) those of i with those of j
    dealt = dealt.select(place.alias("place"), "id", "span", "group", side.alias("side")).repartition("place").sortWithinPartitions("place")
    return cut(pairs.unionByName(dealt.mapInArrow(_shingle_pairs(True, tile), kinds).select("a", "b")).distinct())


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def shingles(text: bytes) -> set[bytes]:
        w = text.lower().split()
        return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}

    for batch in batches:
        for piece in pieces(batch, 2):
            ok = []
            for x, y in zip(blobs(piece.column(2)), blobs(piece.column(3)), strict=True):
                s, t = shingles(x), shingles(y)
                common = len(s & t)
                ok.append(common >= SIMILARITY * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def marked(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` and a boolean __marked: true where ``column`` is among ``ids`` (one column) and for few others. So the rest need not be sent to a join on it. The ids are marked in a bitmap
    of ``WORDS`` words at most, two bits of a word each, that all tasks get; with very many ids it only marks more of the others."""
    one = lambda h, n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int"))
    h, k = F.xxhash64(F.col(ids.columns[0]).cast("long")), F.xxhash64(F.col(f"`{column}`").cast("long"))
    words = ids.select(F.pmod(h, F.lit(WORDS)).alias("__word"), one(h, 32).bitwiseOR(one(h, 40)).alias("bits")).groupBy("__word").agg(F.bit_or("bits").alias("__bits"))
    mask = one(k, 32).bitwiseOR(one(k, 40))
    met = rows.withColumn("__word", F.pmod(k, F.lit(WORDS))).join(F.broadcast(words), "__word", "left")
    return met.withColumn("__marked", F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False))).drop("__word", "__bits")


def verified(docs: DataFrame, tables: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of ids whose texts' sets of shingles are ``SIMILARITY`` alike. ``tables`` (id, n, pivots, sketch) first discard pairs whose sets differ in too many members for
    that, so that few texts are fetched: by their distances to the pivots, and of the rest by the bits of their sketches."""
    both = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    tables = marked(tables, both).where("__marked")
    one, two = (tables.select(F.col("id").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in ("n", "pivots", "sketch")]) for x in "ab")
    pairs = cut(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb", "sa", "sb").mapInArrow(_possible, "a long, b long"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = cut(marked(docs.select("id", "text"), wanted).where("__marked").select("id", "text").join(wanted, "id", "left_semi"))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"))


def similar_texts(docs: DataFrame) -> DataFrame:
    """(id, component) of documents that share a group of near-duplicate texts with another: rows of (id, text), ids distinct and not null.

    Texts with equal word sequences are one class. Two searches find candidates, and both verify them by the similarity of their sets of five-word shingles (fewer words: the whole
    sequence). First, nearest neighbours by fingerprint: classes are sorted by the bits of each family (bit sampling), looked at beside the rows before them, and the nearest few of all
    families verified. That links most of a large group at a few pairs a member, and may miss links. Then all that is left: classes of different groups that share a shingle of their
    prefixes (``prefix_of``), every one with every other. So groups are exact, and pairs within what the first search has linked aren't listed.

    Candidates of both searches go through a pivot distance table, computed once for every text: a set's distances, cell by cell, to reference sets of shingles (``pivots_of``). Sets that
    are ``SIMILARITY`` alike differ in a bounded number of members, so pairs whose coordinates differ by more in all are discarded by the triangle inequality. Survivors are verified by the bits
    of a sketch, then by their texts. (Over whole fingerprints it would discard next to nothing: sets that are 0.8 alike differ in some 37 of 256 bits, and the distances of unrelated ones to
    a pivot by 11 bits or so. Hence a reference for each cell, whose differences add up.)"""
    kinds = ", ".join(f"f{i} long" for i in range(WIDE))
    frequent, counts = frequent_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                texts = blobs(piece.column(1))
                sets = [shingle_hashes(t) for t in texts]
                prefix = pa.array([prefix_of(h, frequent, counts).view(np.int64) for h in sets], pa.list_(pa.int64()))
                wide = wide_of(sets).view(np.int64)
                same = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.lower().split())) for t in texts], np.uint64).view(np.int64)
                size = pa.array([len(t.split()) for t in texts], pa.int64())
                n, pivots, sketch = pa.array([len(h) for h in sets], pa.int64()), *[pa.array([of(h) for h in sets], pa.binary()) for of in (pivots_of, sketch_of)]
                names = ["id", "same", "size", *[f"f{i}" for i in range(WIDE)], "n", "prefix", "pivots", "sketch"]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(same), size, *[pa.array(wide[:, i]) for i in range(WIDE)], n, prefix, pivots, sketch], names=names)

    table = cut(docs.select("id", "text").mapInArrow(run, f"id long, same long, size long, {kinds}, n long, prefix array<long>, pivots binary, sketch binary"))
    classes = cut(table.groupBy("same", "size", *[f"f{i}" for i in range(WIDE)]).agg(F.min("id").alias("id")))
    fps = classes.select("id", *[f"f{i}" for i in range(WIDE)])
    keys = fps.mapInArrow(_family_keys, f"key long, id long, {kinds}").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    best = keys.mapInArrow(_neighbours, "id long, bits long, other long").groupBy("id").agg(F.slice(F.sort_array(F.collect_set(F.struct("bits", "other"))), 1, TRIED).alias("best"))
    tried = best.select("id", F.explode("best.other").alias("other"))
    near = cut(tried.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())
    tables = table.select("id", "n", "pivots", "sketch")
    groups = components(verified(docs, tables, near))
    sets = table.select("id", "n", "prefix").join(classes.select("id"), "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    rest = alike(sets.select("id", "n", "prefix", F.coalesce("component", "id").alias("group")))
    linked = verified(docs, tables, rest).unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b")))
    own = table.drop("n", "prefix", "pivots", "sketch").join(classes.withColumnRenamed("id", "least"), ["same", "size", *[f"f{i}" for i in range(WIDE)]]).where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = components(linked.unionByName(own))
    return found.select(F.col("node").alias("id"), "component")


def _without(docs: DataFrame, drop: DataFrame, doc_id: str, text: str | None = None) -> DataFrame:
    """``docs`` but the rows of the ids (and texts) of ``drop``. Only rows that the bitmap of those ids marks are sent to the join."""
    all_ = marked(docs, drop.select("__drop"), doc_id)
    some = all_.where("__marked").drop("__marked")
    same = some[doc_id].cast("long") == drop["__drop"]
    left = some.join(drop, same & (some[text].cast("string") == drop["__text"]) if text else same, "left_anti")
    return all_.where("NOT __marked").drop("__marked").unionByName(left)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with only the least doc_id of each group of near-duplicate texts (``similar_texts``). Rows without an id stay; documents without words are no one's copies and stay. Rows
    that repeat an id with different texts are compared and dropped each by its own text, and of a group's least id one text is kept; rows equal in id and text are one document and all
    stay or go."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        drop = similar_texts(rows).where("id <> component").select(F.col("id").alias("__drop"))
        return _without(docs, drop, doc_id)
    own = cut(rows.distinct().withColumn("key", F.monotonically_increasing_id()))
    groups = cut(similar_texts(own.select(F.col("key").alias("id"), "text")).withColumnRenamed("id", "key"))
    groups = groups.unionByName(groups.select(F.col("component").alias("key"), "component").distinct())
    members = groups.join(own.select("key", "id", F.struct("id", F.xxhash64("text").alias("h"), "key").alias("order")), "key")
    least = members.groupBy("component").agg(F.min("order").alias("least"))
    out = members.join(least, "component").where("key <> least.key").select("key")
    drop = own.join(out, "key").select(F.col("id").alias("__drop"), F.col("text").alias("__text"))
    return _without(docs, cut(drop), doc_id, text)
