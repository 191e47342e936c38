import hashlib
import random

import duckdb
import numpy as np
import pytest

from decafix.llm import catalogue, suffix
from decafix.llm.text import joined


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) with a set of all 100-byte strings so far."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                hit[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((str(i), len(b), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def texts(seed):
    r = random.Random(seed)
    rand = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    base = [rand(700) for _ in range(5)]
    out = [None, "", "short", "a" * 450, "ab" * 300, "a" * 99, "a" * 100]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            b = r.choice(base)
            lo = r.randrange(600)
            parts.append(r.choice([rand(r.randrange(120)), b[lo : lo + r.randrange(40, 400)], b]))
        out.append("".join(parts))
    line = rand(90)
    out += [line + rand(150) for _ in range(30)] + [rand(130) + base[0][:95] + rand(50) for _ in range(10)]
    p = rand(170)
    return out + [p + rand(120) for _ in range(60)] + [rand(100) + p for _ in range(40)]


@pytest.mark.parametrize("seed,frequent", [(1, 16), (2, 1), (3, 4)])
def test_against_brute_force(spark, seed, frequent, monkeypatch):
    rows = list(enumerate(texts(seed)))
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 20_000)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(5)
    assert rows_of(suffix.digests(df)) == brute(rows)


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    assert rows_of(catalogue.QUERIES["op5_suffix"](spark, sf)) == brute(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def test_anchors_depend_on_the_window_alone(monkeypatch):
    monkeypatch.setattr(suffix, "_CHUNK", 257)
    r = random.Random(7)
    body = bytes(r.choice(b"abcd") for _ in range(1500))
    data, bounds = joined([body, b"x" * 37 + body[300:] + b"y" * 50, b"", body[:99], body[:100]])
    anchor, _, doc, start, n, rel = suffix.entries(data, bounds)
    by = {}
    for a, d, s, k, m in zip(anchor, doc, start, n, rel, strict=True):
        for j in range(k):
            w = data[bounds[d] + s + j : bounds[d] + s + j + 100].tobytes()
            assert by.setdefault(w, (a, m - j)) == (a, m - j)
    assert n.sum() == sum(max(0, x - 99) for x in np.diff(bounds)) and n.max() <= suffix.SPAN


def test_nulls_ties_and_clashing_columns(spark):
    r = random.Random(1)
    t = "".join(r.choice("abcdef") for _ in range(300))
    e = "".join(r.choice("€éß") for _ in range(60))
    rows = [(5, t), (5, t), (7, "x" + t), (None, t), (None, t + "z"), (8, None), (9, e), (10, "a" + e)]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, d string, n_chars long")
    got = rows_of(suffix.digests(df))
    assert [x[:4] for x in got if x[0] == "5"] == [("5", 300, 0, 0)] * 2 and [x[:4] for x in got if x[0] == "7"] == [("7", 301, 300, 1)]
    assert sorted(x[2] for x in got if x[0] == "None") == [300, 300]
    kept = suffix.remove(df)
    assert kept.columns == df.columns
    by = {(r["doc_id"], r["text"]): r["n_chars"] for r in kept.collect()}
    assert (5, t) in by and by[7, "x"] == 1 and (8, None) in by and by[None, "z"] == 1 and (None, "") not in by and kept.count() == 7
    assert suffix.digests(df.limit(0)).count() == 0 and suffix.remove(df.limit(0)).count() == 0


def test_a_task_without_any_entry():
    none = np.zeros(0, suffix.ENTRY)
    assert list(suffix._packed(none["anchor"], none, 8)) == []
