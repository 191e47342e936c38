import math

import duckdb
import numpy as np

from decafix.llm import catalogue
from decafix.llm.embeddings import near_duplicates


def brute(rows, cosine=0.98):
    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v) if label is not None else None for _, v, label in rows]
    n, root = len(rows), {r[0]: r[0] for r in rows if r[0] is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
                links[i] += 1
                links[j] += 1
                if rows[i][0] is not None and rows[j][0] is not None:
                    a, b = find(rows[i][0]), find(rows[j][0])
                    root[max(a, b)] = min(a, b)
    return sorted((str(r[0]), links[i], None if r[0] is None else find(r[0])) for i, r in enumerate(rows))


def test_against_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    rows = []
    for i in range(500):
        v = centres[r.integers(12)] * r.uniform(0.1, 9) + r.normal(size=24) * r.choice([0, 0.02, 0.1, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(2))))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [1.0, None] + [0.0] * 22, 1), (2003, [float("nan")] + [1.0] * 23, 1), (2004, [float("inf")] + [1.0] * 23, 1), (2005, rows[5][1], None), (2006, rows[5][1][:3], rows[5][2]), (2007, rows[5][1][:3], rows[5][2]), (2008, [], 1), (2009, [1e-42, 0.0], 1), (2010, [3e38, 0.0], 1), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = near_duplicates(df).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], x["component_id"]) for x in got) == brute(rows)
    assert all(x["kept"] == (x["vec_id"] is not None and x["vec_id"] == x["component_id"]) for x in got)


def test_dense_cluster_in_tiles(spark, monkeypatch):
    from decafix.llm import embeddings

    r = np.random.default_rng(8)
    centre = r.normal(size=16)
    rows = [(i, (centre + r.normal(size=16) * r.choice([0.05, 0.13])).tolist(), 1) for i in range(300)] + [(400 + i, r.normal(size=16).tolist(), 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    for tile, pairs in ((7, 1 << 16), (64, 50), (4096, 1 << 16)):
        monkeypatch.setattr(embeddings, "TILE", tile)
        monkeypatch.setattr(embeddings, "_PAIRS", pairs)
        assert sorted((str(x["vec_id"]), x["n_links"], x["component_id"]) for x in near_duplicates(df).collect()) == want
    found = embeddings.links(df.withColumnRenamed("vec_id", "cls").withColumn("copies", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1).cast("long")))
    assert found.count() < 300 * 8 * 4 * 3


def test_table_and_empty(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select vec_id, embedding, label from '{sf}/embeddings.parquet'").fetchall()
    got = catalogue.QUERIES["op9_embeddings"](spark, sf).collect()
    assert sorted((str(x["vec_id"]), x["n_links"], x["component_id"]) for x in got) == brute(rows)
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_same_as_sql(spark):
    from compare import compare, duck

    sf = "/root/testdata/sf0.01"
    assert compare(spark, duck(sf), catalogue.QUERIES["op9_embeddings"], catalogue.SQL["op9_embeddings"], sf) == ""


def test_ties_and_repeated_ids(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [1.0, 0.001], 1), (9, [0.001, 1.0], 1), (7, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in near_duplicates(df).collect())
    assert got == [(7, 1, 7), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 1, 7)]


def test_large_labels_by_grids(spark, monkeypatch):
    from decafix.llm import embeddings

    r = np.random.default_rng(9)
    centres = r.normal(size=(5, 32))
    rows = [(i, (centres[r.integers(5)] + r.normal(size=32) * r.choice([0.03, 0.1, 0.14, 0.3])).tolist(), int(r.integers(2))) for i in range(240)]
    rows += [(1000 + i, r.normal(size=3).tolist(), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    monkeypatch.setattr(embeddings, "DIRECT", 0)
    monkeypatch.setattr(embeddings, "_LEAF", 4)
    for grid, tile in ((2, 16384), (4, 16384), (2, 20)):
        monkeypatch.setattr(embeddings, "GRID", ((None, grid),))
        monkeypatch.setattr(embeddings, "TILE", tile)
        assert sorted((str(x["vec_id"]), x["n_links"], x["component_id"]) for x in near_duplicates(df).collect()) == want


def test_near_pairs_against_all_pairs():
    from decafix.llm.embeddings import near_pairs

    r = np.random.default_rng(10)
    for n, m, scale in ((700, 900, 1.0), (700, 900, 0.02), (1, 50, 1.0), (300, 300, 0.0)):
        x, y = r.normal(size=(n, 6)) * scale, r.normal(size=(m, 6)) * scale
        far = ((x[:, None] - y[None]) ** 2).sum(2)
        got = [p for i, j in near_pairs(x, y, 0.3) for p in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(got) == len(set(got)) and {tuple(p) for p in np.argwhere(far <= 0.3).tolist()} <= set(got)
        assert all(far[p] <= 0.3 + 1e-5 for p in got)
