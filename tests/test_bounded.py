import math
import random

import pytest
from pyspark.sql import functions as F

from decafix.functions import decode, eq, error_bound, fixed, fraction_bits, gt, literal, lt, precision_of
from decafix.operators import aggregates, codecs, encoded, scan
from decafix.operators.codecs import decode_offsets, encode_offsets, pack_fields, precision_bound


def test_fraction_bits():
    assert [fraction_bits(p) for p in range(12)] == [0, 5, 8, 11, 15, 18, 21, 25, 28, 31, 35, 38]
    with pytest.raises(ValueError):
        fraction_bits(12)
    assert [precision_of(s) for s in (0, 1, 10, 10000)] == [0, 0, 1, 4]


@pytest.mark.parametrize("precision", [0, 1, 2, 5, 8, 11])
def test_fixed_is_truncation(spark, precision):
    r = random.Random(precision)
    xs = [r.uniform(-500, 500) for _ in range(300)] + [0.0, -0.0, 1e-12, -1e-12, 1.0, -1.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(fixed("x", precision)).collect()
    assert [g[0] for g in got] == [math.trunc(x * 2 ** fraction_bits(precision)) for x in xs] == [literal(x, precision) for x in xs]


def test_no_fixed_form(spark):
    rows = spark.createDataFrame([(x,) for x in (None, math.nan, math.inf, -math.inf, 1e300, 2.5)], "x double")
    assert [r[0] for r in rows.select(fixed("x", 2)).collect()] == [None] * 5 + [640]
    assert scan.bounded(rows, "x", 2).count() == 1


def test_rounding_restores_digits():
    r = random.Random(1)
    for p in range(1, 9):
        for _ in range(50):
            x = round(r.uniform(-500, 500), p)
            assert round(literal(x, p) / 2 ** fraction_bits(p), p) == x or abs(literal(x, p) / 2 ** fraction_bits(p) - x) < 2.0 ** -fraction_bits(p)


def test_filters_partition_rows(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(round(r.uniform(-3, 3), 2),) for _ in range(400)], "x double")
    for c in (-10.0, -1.5, 0.0, 2.25, 10.0):
        assert sum(df.where(p).count() for p in (gt("x", c, 2), lt("x", c, 2), eq("x", c, 2))) == 400


@pytest.mark.parametrize("layout", codecs.LAYOUTS)
@pytest.mark.parametrize("width,n", [(0, 3), (1, 1), (7, 31), (8, 32), (9, 33), (16, 1999), (21, 2000), (24, 2001), (40, 100)])
def test_layouts_round_trip(layout, width, n):
    import numpy as np

    r = np.random.default_rng(width * n)
    off = r.integers(0, 1 << width, n) if width else np.zeros(n, np.int64)
    off[: n // 2] = off[:1]  # a majority
    if width > 16:
        off[: int(n * 0.97)] &= (1 << (width - 9)) - 1
    for d in (0, 8):
        assert (decode_offsets(encode_offsets(off, width, d, layout), n, width, d, layout) == off).all()


@pytest.mark.parametrize("xs", [[5.0] * 40, [9.5 - i for i in range(50)], [0.0, 256.0], [0.1, 0.2, 0.9], [-3.25, 1e6, 2.0], [0.0, 65535.99]])
def test_segments_on_edges(spark, xs):
    df = spark.createDataFrame([(i * 2, x) for i, x in enumerate(xs)], "pos long, x double")
    want = {(i * 2, math.trunc(x * 256) / 256) for i, x in enumerate(xs)}
    for layout in codecs.LAYOUTS:
        seg = codecs.encode(df, "x", 2, layout, rows=16)
        assert {tuple(r) for r in codecs.decode_segments(seg).collect()} == want
    seg = codecs.encode(df, "x", 2, "plain", rows=16)
    for c in (min(xs) - 1, min(xs), xs[0], max(xs), max(xs) + 1):
        for op, test in ((">", lambda v, k: v > k), ("<", lambda v, k: v < k), ("=", lambda v, k: v == k)):
            assert {r[0] for r in encoded.filter_segments(seg, op, c, 2).collect()} == {p for p, v in want if test(v, math.trunc(c * 256) / 256)}


def test_empty(spark):
    df = spark.createDataFrame([], "pos long, x double")
    assert codecs.decode_segments(codecs.encode(df, "x", 2)).count() == 0
    assert aggregates.extreme(df, "x", 2).collect()[0][0] is None
    assert aggregates.windowed_max(df, "x", 2, 0, 10, 5).count() == 0
    assert scan.decode_reduced(df, "x", 2, 1, ["pos"]).count() == 0


def test_bit_order_and_bound():
    assert list(pack_fields([(10, 4), (1021, 10), (3, 2)])) == [218, 255]
    for x in (0.1, 33.3, -36.7, 242.8, 2.9):
        assert abs(precision_bound(x, 1) - x) < error_bound(1)


def test_sum_with_whole_byte_width(spark):
    df = spark.createDataFrame([(i, 10.0 + i) for i in range(256)], "pos long, x double")
    assert aggregates.sum_bounded(df, "x", 2).collect()[0][0] == sum(10.0 + i for i in range(256))
    assert aggregates.extreme(df, "x", 2).collect()[0].asDict() == {"value": 265.0, "n_attained": 1}
    assert df.select(decode(fixed("x", 2), 2)).count() == 256 and df.where(eq("x", 12.0, 2)).select(F.col("pos")).collect()[0][0] == 2


def test_expansion_and_forced_planes(spark):
    import numpy as np

    xs = [0.3, -0.7, 5.125, 0.0, 0.999, 2.0**60, 1e-12, None, math.inf, math.nan]
    for x, bits in codecs.expand(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 3, ["x"]).collect():
        if x is None or not math.isfinite(x):
            assert bits is None
        else:
            rest = [abs(x) % 1 - sum(2.0 ** -(i + 1) for i, b in enumerate(bits[:k]) if b == "1") for k in range(len(bits) + 1)]
            assert 0 <= rest[-1] < error_bound(3) and all(r >= error_bound(3) for r in rest[:-1])
    off = np.arange(500) * 251
    assert (decode_offsets(encode_offsets(off, 24, 8, "majority", 69), 500, 24, 8, "majority") == off).all()


@pytest.mark.parametrize("precision", [0, 2, 11])
def test_predicates_agree_with_fixed(spark, precision):
    d = fraction_bits(precision)
    r = random.Random(precision)
    xs = [k / 2**d + e for k in range(-4, 5) for e in (0.0, 0.3 / 2**d, -0.3 / 2**d)] + [r.uniform(-9, 9) for _ in range(60)]
    xs += [2.0 ** (62 - d), -(2.0 ** (62 - d)), 2.0 ** (63 - d), -(2.0 ** (63 - d)), math.nextafter(2.0 ** (63 - d), 0), 1e300, -1e300, 5e-324, -0.0, math.nan, math.inf, -math.inf, None]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("fx", fixed("x", precision))
    for v in [*xs[:40:3], 0.0, 2.0 ** (62 - d), -(2.0 ** (63 - d)), 1e300, -1e300, math.inf, -math.inf]:
        c = literal(v, precision)
        for pred, test in ((gt, F.col("fx") > c), (lt, F.col("fx") < c), (eq, F.col("fx") == c)):
            if abs(v) < 2.0 ** (63 - d) or pred is not eq:
                assert df.where(pred("x", v, precision)).count() == df.where(test).count(), (v, pred)


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) as x", "id").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(gt("x", 50.25, 2)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,50." in plan and "LessThanOrEqual(x," in plan


def test_bits_are_written_and_read_back():
    import io

    w = codecs.BitWriter().write(10, 4).write(1021, 10).write(3, 2)
    assert list(w.to_bytes()) == [218, 255]
    data = codecs.BitWriter().write(5, 3).align().write_bytes(b"ab").write(1, 1).to_bytes()
    for source in (data, io.BytesIO(data)):
        r = codecs.BitReader(source)
        assert r.read(3) == 5 and r.align().read_bytes(2) == b"ab" and r.read(1) == 1
        with pytest.raises(EOFError):
            r.read(9)
    assert codecs.BitReader(data).skip(8).read_bytes(1) == b"a"


@pytest.mark.parametrize("layout", codecs.LAYOUTS)
def test_encoded_queries_against_values(layout):
    import numpy as np
    from decafix.operators import encoded as e

    r = np.random.default_rng(3)
    for width, n in ((0, 5), (5, 40), (8, 33), (16, 2100), (21, 700), (24, 65)):
        off = r.integers(0, 1 << width, n) if width else np.zeros(n, np.int64)
        for o in (off, np.where(r.random(n) < 0.97, off[0], off), np.where(r.random(n) < 0.97, off & 255, off)):
            body = codecs.encode_offsets(o, width, 8, layout)
            planes = lambda: e.planes(body, n, width, 8, layout)  # noqa: B023, E731
            assert (e.offsets(planes(), n) == o).all() and sum(p.total(n) for p in planes()) == o.sum()
            top, rows = e.largest(planes(), n)
            assert top == o.max() and (rows == np.flatnonzero(o == o.max())).all()
            for q in (0, 1, 2):
                drop = e.dropped_bits(width, 8, q)
                assert (e.offsets(planes(), n, drop) == (o >> drop) << drop).all()
            among = r.random(n) < 0.5
            for t in (-1, 0, int(o[0]), int(o.max()), 1 << width):
                for op, test in ((">", o > t), ("<", o < t), ("=", o == t)):
                    assert (e.matches(planes(), n, width, op, t) == test).all() and (e.matches(planes(), n, width, op, t, among) == (test & among)).all()


def test_empty_segments(spark):
    from decafix.operators import encoded as e

    s = codecs.encode(spark.createDataFrame([], "pos long, x double"), "x", 2)
    assert e.sum_segments(s, 2).collect()[0].asDict() == {"sum_value": None, "n": 0} and e.max_segments(s, 2).collect()[0]["n_attained"] == 0
    assert e.windowed_max_segments(s, 2, 0, 5).count() == e.filter_segments(s, ">", 1.0, 2).count() == 0


def test_neighbours_by_block(spark):
    import numpy as np
    from decafix.operators import transforms

    r = np.random.default_rng(1)
    rows = [(i, r.integers(0, 4, 3).astype(float).tolist() if i % 17 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["query_id"]: (x["near_id"], x["near_label"], x["distance"]) for x in transforms.nearest_neighbour(df, df.where("vec_id % 5 = 0"), 2, block=32).collect()}
    want = {}
    for i, v, _ in rows:
        if i % 5 == 0 and v is not None:
            want[i] = min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j, lab) for j, w, lab in rows if j != i and w is not None)
    assert got == {i: (j, lab, d) for i, (d, j, lab) in want.items()}
