import random
import struct

import pytest

from decafix.operators import baselines, bitmaps
from decafix.sources import clients, generators, scans


def ids(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "pos long")


def out(df):
    return {r[0] for r in df.collect()}


def test_algebra_against_sets(spark):
    r = random.Random(3)
    a, b = ({r.randrange(2000) for _ in range(500)} for _ in range(2))
    x, y = ids(spark, a), ids(spark, b)
    assert out(bitmaps.union(x, y)) == a | b and out(bitmaps.intersect(x, y)) == a & b
    assert out(bitmaps.difference(x, y)) == a - b and out(bitmaps.symmetric_difference(x, y)) == a ^ b
    assert out(bitmaps.insert_range(x, 70_000, 70_010)) == a | set(range(70_000, 70_010)) and out(bitmaps.remove_range(x, 5, 900)) == {i for i in a if not 5 <= i < 900}
    assert out(bitmaps.negate(x, 2000)) == set(range(2000)) - a
    assert bitmaps.is_subset(ids(spark, a & b), x) and bitmaps.is_disjoint(ids(spark, a - b), y) and bitmaps.contains(x, min(a)) and not bitmaps.contains(x, 5000)
    for op, want in (("and", a & b), ("or", a | b)):
        assert bitmaps.packed_count(bitmaps.packed_combine(bitmaps.packed(x), bitmaps.packed(y), op)).collect()[0][0] == len(want)


@pytest.mark.parametrize("xs", [set(), {0}, set(range(4096)), set(range(4097)), set(range(0, 100_000, 1000)) | {3 * i for i in range(100_000, 110_000)}, {5, 1 << 33, (1 << 33) + 70_000}])
def test_portable_form(spark, xs):
    s = bitmaps.serialize(ids(spark, xs))
    assert out(bitmaps.deserialize(s)) == xs
    if xs and max(xs) < 1 << 32:
        data = s.collect()[0]["data"]
        assert len(data) == bitmaps.portable_size(ids(spark, xs)).collect()[0][0] and struct.unpack_from("<I", data)[0] == 12_346


def test_previous_crosses_stripes(spark):
    df = ids(spark, range(0, 50, 3)).selectExpr("pos", "pos * pos as x")
    got = {r["pos"]: r["prev"] for r in baselines.with_previous(df, "x", stripe=7).collect()}
    assert got == {p: ((p - 3) ** 2 if p else None) for p in range(0, 50, 3)}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("7,1.5,x, 2.0,-3\n8,,4e1\n9\n")
    rows = scans.csv_floats(spark, str(tmp_path), skip=1)
    assert sorted(r["x"] for r in rows.collect()) == [-3.0, 1.5, 40.0]
    assert [(r["pos"], r["x"]) for r in scans.with_positions(rows, ["file", "line_at", "cell_at"]).orderBy("pos").collect()] == [(0, 1.5), (1, -3.0), (2, 40.0)]
    assert sorted(r["x"] for r in scans.csv_ints(spark, str(tmp_path), 10, skip=1, signed=False).collect()) == [15, 30, 400]


def test_binary(spark, tmp_path):
    (tmp_path / "b.bin").write_bytes(b"\xff".join([struct.pack("<d", 1.0), b"bad", struct.pack("<d", 2.0)]))
    assert [r["x"] for r in scans.binary_records(spark, str(tmp_path), 255).orderBy("at").collect()] == [1.0, 2.0]


def test_generators(spark):
    b = [r["b"] for r in generators.outlier_bytes(spark, 5000, 0.9, 1).collect()]
    assert {0, 255} <= set(b) and 0.85 < sum(x == 69 for x in b) / 5000 < 0.95
    assert generators.normal(spark, 1000, 5, 2).count() == 1000 and generators.random_bytes(spark, 10).count() == 10
    assert clients.Client("uniform", amount=20).batch(spark).count() == 20


def test_clients_from_toml(tmp_path, spark):
    (tmp_path / "c.toml").write_text('[clients.a]\nkind = "normal"\namount = 12\nmean = 3.0\n')
    assert clients.load(str(tmp_path / "c.toml"))["a"].batch(spark).count() == 12


def test_described_clients_run(tmp_path, spark):
    (tmp_path / "c.toml").write_text('[clients.g]\ntype = "gen"\ngen_type = "normal"\namount = 200\n[clients.g.params]\nmean = 3.0\nstd_dev = 0.5\n[clients.g.run_period]\nsec = 20\n[clients.g.frequency]\nnano_sec = 1000\n')
    g = clients.load(str(tmp_path / "c.toml"))["g"]
    assert (g.kind, g.amount, g.mean, g.std, g.run_s, g.interval_s) == ("normal", 200, 3.0, 0.5, 20, 1e-6)
    assert clients.Client("normal", amount=200, run_s=30).run(spark, str(tmp_path / "out"), str(tmp_path / "log")) >= 200
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 200


def test_binary_stream(spark, tmp_path):
    from decafix.streaming import paced

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.bin").write_bytes(b"\xff".join([struct.pack("<d", 1.0), b"bad", struct.pack("<d", 2.0)]))
    q = paced.binary_source(spark, str(tmp_path / "in"), 255).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["x"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()] == [1.0, 2.0]


@pytest.mark.parametrize("kind,a,b,mean", [("exponential", 2.0, 1.0, 0.5), ("uniform", 1.0, 3.0, 2.0), ("bernoulli", 0.25, 0.0, 0.25), ("logistic", 5.0, 1.0, 5.0), ("weibull", 1.0, 1.0, 1.0), ("pareto", 1.0, 5.0, 1.25), ("lognormal", 0.0, 0.1, 1.005)])
def test_distributions(spark, kind, a, b, mean):
    from pyspark.sql import functions as F

    assert abs(generators.distribution(spark, 20_000, kind, a, b, 1).agg(F.avg("x")).collect()[0][0] - mean) < 0.06


def test_link_crosses_stripes_and_breaks_ties(spark):
    rows = [(s, f"2024-01-0{d} 0{h}:00:00", e) for s in (1, None) for e, (d, h) in enumerate([(1, 1), (1, 1), (1, 5), (4, 2), (4, 2), (9, 9)])]
    from decafix.operators import segments

    df = spark.createDataFrame(rows, "signal int, t string, e int").selectExpr("signal", "cast(t as timestamp) as timestamp", "e")
    got = {(r["signal"], r["e"]): str(r["prev_timestamp"])[:16] for r in segments.link(df, ("e",)).collect()}
    want = ["None", "2024-01-01 01:00", "2024-01-01 01:00", "2024-01-01 05:00", "2024-01-04 02:00", "2024-01-04 02:00"]
    assert got == {(s, i): w for s in (1, None) for i, w in enumerate(want)}
