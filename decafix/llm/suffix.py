"""Exact removal of repeated 100-byte strings, by run-length indexes over small buckets of places that can match.

A byte goes if a 100-byte string that covers it starts earlier too: in a smaller document, or in the same one before. Documents are ordered by doc_id,
rows with a null id after all others by their content; rows that repeat an id are ordered by content; equal rows are one document.

1. Anchors. Of each 100-byte window the least of its 69 hashed 32-byte strings (the first of ties) is its anchor; that depends on the window's bytes alone, so equal windows
   have equal anchors at equal offsets. Consecutive windows with one anchor are one entry: (anchor, hash of all their bytes, document, start, windows).
2. Entries are dealt by anchor, after a first reduction within each task: of entries that are equal throughout, only the earliest goes on, the others are
   repeats already; an anchor with very many different entries in a task sends one notice, and its entries go straight to step 3. So a passage that a third of
   all documents share sends a bounded number of entries a task. Of the entries of an anchor with equal hashes all but the earliest are repeats. An anchor with
   one entry is settled. Where entries differ, the earliest of each hash is compared by its bytes:
3. Their bytes are fetched from the documents, and windows are dealt once more by 64 bytes, the anchor's and the 32 on that side of it on which the
   window reaches further, which all equal windows share. A key that occurs once is settled.
4. The rest are matched exactly, in batches of keys. A batch's strings are put in a ``RunIndex`` (run-length Burrows-Wheeler transform with sampled run ends) and their
   matching statistics are streamed against it; a window whose match reaches 100 bytes is a repeat if the index's interval of that match holds an earlier string.
5. Repeats come back to their documents; runs of covered bytes are removed.

Entries travel in packed columns, many to a row. Entries with equal anchors are told apart by 64 bits of content and 64 of the anchor; strings of step 4 are compared by their bytes.

Results by case. Texts are whole, as UTF-8, however long; a null is empty, and it and texts under 100 bytes have nothing to remove. Ties in id are ordered by content. Equal rows (id and text)
are one document and have one result each. An empty table gives no rows. ``remove`` keeps extra columns, whatever their names (but for names that start with two underscores), and
counts ``n_chars`` anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decafix.llm.runindex import RunIndex
from decafix.llm.text import blobs, joined, pieces
from decafix.plans.lineage import cut

MATCH, KMER = 100, 32
SPAN = MATCH - KMER + 1  # windows of 32-byte strings in a window
SIDE = (SPAN - 1) // 2  # a window with more bytes than these left of its anchor is keyed by that side
#: Entries that a task reduces at once, different entries of an anchor in a task that make it frequent, bytes of a batch of an index.
TASK_ENTRIES, FREQUENT, INDEX_BYTES = 1 << 20, 16, 1 << 20
BUCKETS_PER_PARTITION, BUCKET_BYTES = 4, 1 << 25
_CHUNK = 1 << 15
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_LOW = np.uint64((1 << 24) - 1)

ENTRY = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("d", "<i8"), ("h", "<u4"), ("start", "<u4"), ("n", "u1"), ("rel", "u1")])
PLACE = np.dtype([("d", "<i8"), ("h", "<u4"), ("start", "<u4"), ("n", "u1"), ("rel", "u1"), ("kind", "u1")])
STRING = np.dtype([("key", "<u8"), ("d", "<i8"), ("h", "<u4"), ("start", "<u4"), ("n", "u1")])
REPEAT, FETCH = 0, 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M2
    x += b
    x ^= x >> np.uint64(32)
    x *= _M1
    return x


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 32-byte and of all 64-byte strings, by doubling."""
    x = data.astype(np.uint64) * _M1
    x ^= x >> np.uint64(31)
    k = 1
    while k < KMER:
        x = _pair(x[:-k], x[k:]) if len(x) > k else x[:0]
        k *= 2
    return x, _pair(x[:-KMER], x[KMER:]) if len(x) > KMER else x[:0]


def entries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, document, start in it, windows, anchor's offset from the start) of joined texts, in order."""
    out, ends = [], bounds[1:]
    for at in range(0, max(0, len(data) - MATCH + 1), _CHUNK):
        part = data[at : at + _CHUNK + MATCH - 1]
        k32, k64 = hashes(part)
        low = (k32 & ~_LOW) | np.arange(len(k32), dtype=np.uint64)
        span = 1
        while span * 2 <= SPAN:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - span)], low[SPAN - span :])
        owner = np.searchsorted(ends, np.arange(at, at + len(low)), "right")
        inside = np.flatnonzero(np.arange(at, at + len(low)) + MATCH <= ends[owner])
        if not len(inside):
            continue
        place = (low[inside] & _LOW).astype(np.int64)
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(inside, prepend=-2) != 1) | (np.diff(owner[inside], prepend=-1) != 0))
        start, anchor = inside[new], place[new]
        n = np.diff(np.append(new, len(inside)))
        length = n + MATCH - 1
        middle = start + np.minimum(length - 64, 52)
        content = _pair(_pair(k64[start], k64[middle]), _pair(k64[start + length - 64], ((n << 8) | (anchor - start)).astype(np.uint64)))
        doc = owner[start]
        out.append((k32[anchor], content, doc, start + at - bounds[doc], n, anchor - start))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _before(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort keys of the order of documents and places, least significant first. The top bit of h says that the id is null."""
    return rows["start"], rows["h"], rows["d"], rows["h"] >> 31


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _places(rows: np.ndarray, kind: int) -> np.ndarray:
    out = np.zeros(len(rows), PLACE)
    for c in ("d", "h", "start", "n", "rel"):
        out[c] = rows[c]
    out["kind"] = kind
    return out


def settle(rows: np.ndarray, frequent: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(entries that go on, places that are decided). With ``frequent``, a task's own reduction: the earliest of equal entries go on. Without, the last
    word: places to fetch are the earliest of an anchor's different entries."""
    a = np.ascontiguousarray(rows["anchor"])
    order = np.argsort(a)
    a = a[order]
    new = _changes(a)
    size = np.diff(np.append(np.flatnonzero(new), len(a)))
    many = np.repeat(size > 1, size)
    alone, rows = rows[order[~many]], rows[order[many]]
    rows = rows[np.lexsort([np.ascontiguousarray(k) for k in (*_before(rows), rows["content"], rows["anchor"])])]
    notice = rows["n"] == 0
    group, kind = _changes(rows["anchor"]), _changes(rows["anchor"], rows["content"])
    g = np.cumsum(group) - 1
    kinds = np.bincount(g, weights=kind).astype(np.int64)[g] if len(rows) else np.zeros(0, np.int64)
    done = [_places(rows[_later(kind, rows) & ~notice], REPEAT)]
    first = kind & ~notice
    if frequent is None:
        done.append(_places(rows[first & (kinds > 1)], FETCH))
        return rows[:0], np.concatenate(done)
    often = kinds > frequent
    done.append(_places(rows[first & often], FETCH))
    notices = np.zeros(int((group & often).sum()), ENTRY)
    notices["anchor"] = rows["anchor"][group & often]
    return np.concatenate([alone, rows[(first & ~often) | (kind & notice)], notices]), np.concatenate(done)


def _later(kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of a run of equal entries that lie after its first place (rows at that very place are the same document's)."""
    head = np.flatnonzero(kind)[np.cumsum(kind) - 1] if len(rows) else np.zeros(0, np.int64)
    return (rows["d"] != rows["d"][head]) | (rows["h"] != rows["h"][head]) | (rows["start"] != rows["start"][head])


def _packed(key: np.ndarray, rows: np.ndarray, buckets: int, extra: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, number, bytes) of rows and the bytes that belong to each."""
    b = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    if not len(b):
        return
    at = np.flatnonzero(_changes(b))
    for s, e in zip(at, np.append(at[1:], len(b)), strict=True):
        pick = order[s:e]
        body = rows[pick].tobytes()
        if extra is not None:
            data, bounds = extra
            lens = bounds[pick + 1] - bounds[pick]
            body += data[np.repeat(bounds[pick] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))].tobytes()
        yield int(b[s]), int(e - s), body


_BLOB = "bucket int, kind int, n int, body binary"


def _blob(items: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*items, strict=True)) if items else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["bucket", "kind", "n", "body"])


def _scatter(places: np.ndarray, buckets: int, size: int = 8192) -> list[tuple[int, int, int, bytes]]:
    """Decided places pass through the next exchange in even shares."""
    return [((int(places["d"][i]) * 7919 + int(places["h"][i])) % buckets, 1, len(places[i : i + size]), places[i : i + size].tobytes()) for i in range(0, len(places), size)]


def _find(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            on, done = settle(np.concatenate(held), FREQUENT)
            items = [(b, 0, count, body) for b, count, body in _packed(on["anchor"], on, buckets)]
            return _blob(items + _scatter(done, buckets))

        for batch in batches:
            for piece in pieces(batch, 2):
                d, h = piece.column(0).to_numpy(), piece.column(1).to_numpy().astype(np.uint32)
                data, bounds = joined(blobs(piece.column(2)))
                anchor, content, doc, start, count, rel = entries(data, bounds)
                rows = np.zeros(len(anchor), ENTRY)
                for c, v in (("anchor", anchor), ("content", content), ("d", d[doc]), ("h", h[doc]), ("start", start), ("n", count), ("rel", rel)):
                    rows[c] = v
                held.append(rows)
                n += len(rows)
                if n >= TASK_ENTRIES:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return run


#: ``place`` holds start, windows, the anchor's offset and the kind in 32, 8, 8 and 1 bits.
_PLACE = "d long, h long, place long"


def _place_batch(p: np.ndarray) -> pa.RecordBatch:
    place = (p["start"].astype(np.int64) << 17) | (p["n"].astype(np.int64) << 9) | (p["rel"].astype(np.int64) << 1) | p["kind"]
    return pa.RecordBatch.from_arrays([pa.array(p["d"]), pa.array(p["h"].astype(np.int64)), pa.array(place)], names=["d", "h", "place"])


def _unplace(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor's offset)."""
    return place >> 17, (place >> 9) & 255, (place >> 1) & 255


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], list[bytes]]]:
    """(packed rows, decided places) of each bucket of rows sorted by bucket."""
    now, rows, decided = None, [], []
    for batch in batches:
        for bucket, kind, n, body in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if bucket != now and now is not None:
                yield rows, decided
                rows, decided = [], []
            now = bucket
            (decided.append(body) if kind else rows.append((n, body)))
    if now is not None:
        yield rows, decided


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, decided in _by_bucket(batches):
        out = [np.frombuffer(x, PLACE) for x in decided]
        if rows:
            out.append(settle(np.concatenate([np.frombuffer(b, ENTRY) for _, b in rows]), None)[1])
        if p := sum(map(len, out)):
            both = np.concatenate(out)
            for at in range(0, p, 1 << 16):
                yield _place_batch(both[at : at + (1 << 16)])


def _fetch(buckets: int, text: str):
    """Documents with their places (null: none) to the windows' bytes by the second key, each side of the anchor apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            slim = pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in ("__kd", "__kh", text, "__places")], names=["d", "h", "text", "places"])
            for piece in pieces(slim.filter(slim.column(3).is_valid()), 2):
                d, h = piece.column(0).to_numpy(), piece.column(1).to_numpy().astype(np.uint32)
                data, bounds = joined(blobs(piece.column(2)))
                count = np.asarray(pc.list_value_length(piece.column(3)), np.int64)
                doc = np.repeat(np.arange(len(count)), count)
                start, n, rel = _unplace(np.asarray(piece.column(3).flatten(), np.int64))
                middle = np.clip(rel - SIDE, 0, n)  # windows before it have more than SIDE bytes left of the anchor
                parts, keys = [], []
                for left, lo, hi in ((True, np.zeros(len(n), np.int64), middle), (False, middle, n)):
                    pick = np.flatnonzero(hi > lo)
                    place = bounds[doc[pick]] + start[pick] + rel[pick]
                    words = data[(place - KMER * left)[:, None] + np.arange(2 * KMER)].view("<u8")
                    key = np.full(len(pick), 2 * left + 1, np.uint64)
                    for k in range(words.shape[1]):
                        key = _pair(key, words[:, k])
                    keys.append(key ^ (key >> np.uint64(29)))
                    r = np.zeros(len(pick), STRING)
                    r["d"], r["h"], r["start"], r["n"] = d[doc[pick]], h[doc[pick]], start[pick] + lo[pick], hi[pick] - lo[pick]
                    parts.append((r, bounds[doc[pick]] + start[pick] + lo[pick]))
                rows, at, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(keys)
                rows["key"] = key
                lens = rows["n"].astype(np.int64) + MATCH - 1
                cuts = np.zeros(len(rows) + 1, np.int64)
                np.cumsum(lens, out=cuts[1:])
                strings = data[np.repeat(at - cuts[:-1], lens) + np.arange(int(cuts[-1]))]
                yield _blob([(b, 0, count, body) for b, count, body in _packed(rows["key"], rows, buckets, (strings, cuts))])

    return run


def match(rows: np.ndarray, strings: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(row, which of its windows are repeats) for the strings of one or more keys, in order within each key. The strings, much alike, are put in one run-length index, and each is
    streamed against it: where its matching statistics reach ``MATCH``, the index's interval of that window says in which string the window comes first. Equal windows have equal
    keys, so that string is of the same key, and the window is a repeat if it isn't this string itself."""
    data, bounds = joined(strings)
    index = RunIndex(data, bounds, MATCH)
    length, at = index.matching_statistics(data, bounds)
    own = np.repeat(np.arange(len(strings)), np.diff(bounds))
    hit = (length >= MATCH) & (index.first_string(at) < own)
    found = ((i, hit[bounds[i] : bounds[i] + int(n)]) for i, n in enumerate(rows["n"]))
    return [(i, f) for i, f in found if f.any()]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for packed, _ in _by_bucket(batches):
        rows, strings = [], []
        for n, body in packed:
            r = np.frombuffer(body, STRING, n)
            rows.append(r)
            at = n * STRING.itemsize
            for length in (r["n"].astype(np.int64) + (MATCH - 1)).tolist():
                strings.append(body[at : at + length])
                at += length
        if not rows:
            continue
        rows = np.concatenate(rows)
        order = np.lexsort((*_before(rows), rows["key"]))
        rows, strings = rows[order], [strings[i] for i in order]
        for done in _resolve(rows, strings):
            if len(done):
                yield _place_batch(done)


def _resolve(rows: np.ndarray, strings: list[bytes]) -> Iterator[np.ndarray]:
    """Repeats among rows sorted by key and order: equal strings at once, different ones through indexes, some keys at a time."""
    new = np.flatnonzero(_changes(rows["key"]))
    pick, held, repeats = [], 0, []
    for a, b in zip(new, np.append(new[1:], len(rows)), strict=True):
        if b - a == 1:
            continue
        seen, own = {}, []
        for i in range(a, b):
            j = seen.setdefault(strings[i], i)
            if j == i:
                own.append(i)
            elif rows[i][["d", "h", "start"]] != rows[j][["d", "h", "start"]]:
                repeats.append(i)
        if len(own) > 1:
            pick += own
            held += sum(len(strings[i]) for i in own)
        if held >= INDEX_BYTES:
            yield _windows(rows, strings, pick)
            pick, held = [], 0
    if pick:
        yield _windows(rows, strings, pick)
    p = np.zeros(len(repeats), PLACE)
    for c in ("d", "h", "start", "n"):
        p[c] = rows[c][repeats]
    yield p


def _windows(rows: np.ndarray, strings: list[bytes], pick: list[int]) -> np.ndarray:
    """Runs of windows that ``match`` finds."""
    sub, out = rows[pick], []
    for i, found in match(sub, [strings[j] for j in pick]):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], found.astype(np.int8), [0]])))
        out += [(sub["d"][i], sub["h"][i], sub["start"][i] + s, e - s, 0, REPEAT) for s, e in zip(edges[::2], edges[1::2], strict=True)]
    return np.array(out, PLACE) if out else np.zeros(0, PLACE)


def covered(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (from, to) of the bytes that windows cover."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + counts + MATCH - 1)[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[np.append(new[1:], len(a)) - 1] if len(a) else b


def _identity(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(d, h): the id, or a content hash where it is null; and 31 bits of content with that case on top."""
    content = F.xxhash64(text, F.length(text))
    d = F.coalesce(doc_id.cast("long"), content)
    return d, F.shiftrightunsigned(content, 33) + F.when(doc_id.isNull(), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")


def bucket_count(rows: DataFrame) -> int:
    """Buckets that entries are dealt to: at least ``BUCKETS_PER_PARTITION`` a partition, and so many more for a large input that a bucket stays about ``BUCKET_BYTES`` of it (by
    the planner's estimate, where it has one)."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 1 << 60 else max(least, min(size // BUCKET_BYTES, 1 << 20))


def repeats(rows: DataFrame, text: str, buckets: int | None = None) -> DataFrame:
    """(__d, __h, __places): windows that are repeats, by document of ``rows`` (which hold __kd, __kh and the text).

    The texts are joined with the places whose bytes are wanted by the same keys, in the same columns and the same way (outer) as the caller joins them with the result: so Spark
    shuffles them once and reuses that exchange."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.select("__kd", "__kh", text)
    buckets = buckets or bucket_count(slim)
    dealt = lambda blobs_: blobs_.repartition(n, "bucket").sortWithinPartitions("bucket")
    places = cut(dealt(slim.mapInArrow(_find(buckets), _BLOB)).mapInArrow(_decide, _PLACE))
    kind = F.col("place").bitwiseAND(F.lit(1))
    lists = lambda df, to: df.groupBy(F.col("d").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list("place").alias(to))  # noqa: E731  at most a text's windows
    wanted = _beside(rows, lists(places.where(kind == FETCH), "__places"))
    found = dealt(wanted.mapInArrow(_fetch(buckets, text), _BLOB)).mapInArrow(_match, _PLACE)
    return lists(places.where(kind == REPEAT).unionByName(found), "__places")


def _beside(rows: DataFrame, places: DataFrame) -> DataFrame:
    return rows.join(places, (F.col("__kd") == F.col("__d")) & (F.col("__kh") == F.col("__h")), "left")


def _with_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d, h = _identity(F.col(doc_id), F.col(text))
    rows = docs.withColumns({"__kd": d, "__kh": h})
    return _beside(rows, repeats(rows, text)).drop("__kd", "__kh", "__d", "__h")


def _spans(places: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    start, n, _ = _unplace(np.array(places[i].as_py() or [], np.int64))
    return covered(start, n)


def _kept(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return text
    cuts = [0, *[x for pair in zip(a.tolist(), b.tolist(), strict=True) for x in pair], len(text)]
    return b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t in enumerate(blobs(batch.column(1))):
                a, b = _spans(batch.column(2), i)
                out.append((len(t), int((b - a).sum()), len(a), hashlib.sha256(_kept(t, a, b)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_repeats(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "text")
    return rows.select("doc_id", "text", "__places").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, drop_empty: bool = True) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (a character cut by a run's edge goes as a whole) and ``n_chars``, if there, counted anew;
    documents that were not blank and have nothing but white space left go, if ``drop_empty``."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            texts, stay = [], []
            for i, t in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                a, b = _spans(batch.column(len(columns)), i)
                kept = t if t is None or not len(a) else _kept(t, a, b).decode("utf-8", "ignore")
                texts.append(kept.decode() if isinstance(kept, bytes) else kept)
                stay.append(not (drop_empty and len(a) and not texts[-1].strip()))
            cols = [pa.array(texts, pa.string()) if c == "text" else pa.array([None if x is None else len(x) for x in texts], pa.int64()) if c == "n_chars" else batch.column(k) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(stay, pa.bool_()))

    kinds = dict(docs.dtypes) | {"text": "string"} | ({"n_chars": "long"} if "n_chars" in columns else {})
    rows = _with_repeats(docs, "doc_id", "text").select(*columns, "__places")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
