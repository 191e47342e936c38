"""The query catalogue: each query beside the SQL that must give the same rows.

SQL engines disagree on CAST of a fraction (one truncates, one rounds), hence ``trunc`` in the SQL. Sums are of integers
and are divided once, so results don't depend on the order of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decafix.functions import between, components, decode, eq, eq_by_planes, fixed, gt, gt_by_planes, is_bounded, kept_bits, lt, plane
from decafix.operators import aggregates, baselines, bitmaps, bytes as planes_, codecs, encoded, profile, scan, segments, transforms
from decafix.plans import codec
from decafix.plans.lineage import scratch
from decafix.sources import clients, generators, scans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FX = "CAST(trunc({} * 256) AS BIGINT)"
PRICE, TOTAL, BAL, VAL = (FX.format(c) for c in ("l_extendedprice", "o_totalprice", "c_acctbal", "value"))
EV = f"(SELECT event_id AS pos, {VAL} AS fx FROM events)"


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("x"))


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """Two selections of events as boolean columns."""
    return events(spark, sf).select("pos", gt("x", 60.5, 2).alias("a"), lt("x", 90.25, 2).alias("b"))


# ---- scans and filters ----


@query("filtered_price_summary", f"SELECT count(*) AS n, CAST(sum({PRICE}) AS DOUBLE) / 256 AS sum_value, CAST(max({PRICE}) AS DOUBLE) / 256 AS max_value FROM lineitem WHERE {PRICE} > 12800064")
def _(spark, sf):
    rows = scan.bounded(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", 2).where(F.col("fx") > F.lit(12800064))
    return rows.agg(F.count("fx").alias("n"), decode(aggregates.exact_sum(F.col("fx")), 2).alias("sum_value"), decode(F.max("fx"), 2).alias("max_value"))


@query("decode_bounded", f"SELECT pos, fx / 256.0 AS value FROM {EV}".replace("fx / 256.0", "CAST(fx AS DOUBLE) / 256"))
def _(spark, sf):
    return scan.decode_all(events(spark, sf), "x", 2, ["pos"])


def _filter(name: str, op: str, c: int, pred) -> None:
    sql = f"SELECT o_orderkey, CAST({TOTAL} AS DOUBLE) / 256 AS value FROM orders WHERE {TOTAL} {op} {c}"
    query(name, sql)(lambda spark, sf: table(spark, sf, "orders").where(pred()).select("o_orderkey", decode(fixed("o_totalprice", 2), 2).alias("value")))


_filter("filter_gt", ">", 250000 * 256 + 64, lambda: gt("o_totalprice", 250000.25, 2))
_filter("filter_lt", "<", 40000 * 256, lambda: lt("o_totalprice", 40000.0, 2))


@query("filter_eq", f"SELECT pos FROM {EV} WHERE fx = (SELECT fx FROM {EV} WHERE pos = 17)".replace("(SELECT fx", "(SELECT max(fx)"))
def _(spark, sf):
    """Rows equal to the bounded value at position 17: the constant is one row, sent to all tasks."""
    rows = scan.bounded(events(spark, sf), "x", 2)
    c = rows.where("pos = 17").agg(F.max("fx").alias("c"))
    return rows.join(F.broadcast(c), F.col("fx") == F.col("c")).select("pos")


@query("filter_eq_literal", f"SELECT c_custkey FROM customer WHERE {BAL} = CAST(trunc(711.56 * 256) AS BIGINT)")
def _(spark, sf):
    return table(spark, sf, "customer").where(eq("c_acctbal", 711.56, 2)).select("c_custkey")


@query("filter_between", f"SELECT c_custkey, CAST({BAL} AS DOUBLE) / 256 AS value FROM customer WHERE {BAL} > -51200 AND {BAL} < 25664")
def _(spark, sf):
    return table(spark, sf, "customer").where(between("c_acctbal", -200.0, 100.25, 2)).select("c_custkey", decode(fixed("c_acctbal", 2), 2).alias("value"))


@query("filter_chain", f"SELECT event_id AS pos FROM (SELECT *, {VAL} AS fx FROM events) WHERE fx > 5120 AND fx < 20480 AND event_type = 'click'")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("x"), "event_type")
    return scan.select_where(rows, gt("x", 20.0, 2), lt("x", 80.0, 2), F.col("event_type") == "click").select("pos")


@query("filter_out_of_range", f"SELECT count(*) FILTER (fx > 256000000000) AS n_gt, count(*) FILTER (fx < 256000000000) AS n_lt, count(*) FILTER (fx > -256) AS n_all, count(*) FILTER (fx = -256) AS n_eq FROM {EV}")
def _(spark, sf):
    e = events(spark, sf)
    n = lambda p, name: F.count(F.when(p, 1)).alias(name)
    return e.agg(n(gt("x", 1e9, 2), "n_gt"), n(lt("x", 1e9, 2), "n_lt"), n(gt("x", -1.0, 2), "n_all"), n(eq("x", -1.0, 2), "n_eq"))


@query("gather_positions", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV} WHERE pos IN (SELECT user_id FROM events)")
def _(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("pos"))
    return scan.decode_all(scan.gather(events(spark, sf), wanted), "x", 2, ["pos"])


@query("bound_check", "SELECT count(*) FILTER (abs(value - CAST(trunc(value * 256) AS BIGINT) / 256.0) < 0.49 * 0.01) AS n_bounded, count(*) AS n FROM events".replace("CAST(trunc(value * 256) AS BIGINT) / 256.0", "CAST(CAST(trunc(value * 256) AS BIGINT) AS DOUBLE) / 256"))
def _(spark, sf):
    e = events(spark, sf)
    return e.agg(F.count(F.when(is_bounded(F.col("x"), decode(fixed("x", 2), 2), 2), 1)).alias("n_bounded"), F.count(F.lit(1)).alias("n"))


# ---- planes ----

BALOFF = f"(SELECT c_custkey, {BAL} - (SELECT min({BAL}) FROM customer) AS off FROM customer)"
EVOFF = f"(SELECT pos, fx - (SELECT min(fx) FROM {EV}) AS off, (SELECT min(fx) FROM {EV}) AS base, (SELECT length(bin(max(fx) - min(fx))) FROM {EV}) AS w FROM {EV})"


def _offsets(df: DataFrame, x: str) -> DataFrame:
    return scan.with_stats(scan.bounded(df, x, 2)).withColumn("off", F.col("fx") - F.col("base"))


@query("planes", f"SELECT c_custkey, CAST((off >> 16) & 255 AS BIGINT) AS p0, CAST((off >> 8) & 255 AS BIGINT) AS p1, CAST(off & 255 AS BIGINT) AS p2 FROM {BALOFF}")
def _(spark, sf):
    rows = _offsets(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return rows.select("c_custkey", *[plane(F.col("off"), 24, k).alias(f"p{k}") for k in range(3)])


@query("filter_gt_planes", f"SELECT c_custkey FROM {BALOFF} WHERE off > 2500000")
def _(spark, sf):
    rows = _offsets(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return rows.where(gt_by_planes([plane(F.col("off"), 24, k) for k in range(3)], 2_500_000, 24)).select("c_custkey")


@query("filter_eq_planes", f"SELECT c_custkey FROM {BALOFF} WHERE off = 2000000 OR off = 0")
def _(spark, sf):
    rows = _offsets(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    p = [plane(F.col("off"), 24, k) for k in range(3)]
    return rows.where(eq_by_planes(p, 2_000_000, 24) | eq_by_planes(p, 0, 24)).select("c_custkey")


@query("plane_profile", f"SELECT byte, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM events) AS share FROM (SELECT CAST((fx >> 8) & 255 AS INTEGER) AS byte, count(*) AS n FROM {EV} GROUP BY 1)")
def _(spark, sf):
    return profile.plane_profile(scan.bounded(events(spark, sf), "x", 2), plane(F.col("fx"), 16, 0))


@query("majority_sparse", f"WITH h AS (SELECT CAST((fx >> 8) & 255 AS INTEGER) AS byte, count(*) AS n FROM {EV} WHERE pos < 2000 GROUP BY 1) SELECT byte AS major, n AS n_major, CAST((SELECT sum(n) FROM h) AS BIGINT) AS n_sample, (2 * n - (SELECT sum(n) FROM h)) > 0.6 * (SELECT sum(n) FROM h) AS sparse FROM h ORDER BY n DESC, byte LIMIT 1")
def _(spark, sf):
    return profile.majority(scan.bounded(events(spark, sf), "x", 2), plane(F.col("fx"), 16, 0))


@query("sparse_plane_sum", f"SELECT count(*) FILTER ((fx >> 8) & 255 <> 0) AS n_outliers, CAST(sum((fx >> 8) & 255) AS BIGINT) AS sum_value FROM {EV}")
def _(spark, sf):
    return profile.sparse_sum(scan.bounded(events(spark, sf), "x", 2), plane(F.col("fx"), 16, 0), 0)


@query("plane_outliers", f"SELECT pos, CAST((fx >> 8) & 255 AS INTEGER) AS byte FROM {EV} WHERE (fx >> 8) & 255 <> 0")
def _(spark, sf):
    return profile.outliers(scan.bounded(events(spark, sf), "x", 2), plane(F.col("fx"), 16, 0), 0, ["pos"])


# ---- aggregates and windows ----


@query("sum_bounded", f"SELECT CAST(sum(fx) AS DOUBLE) / 256 AS sum_value, count(*) AS n FROM {EV}")
def _(spark, sf):
    return aggregates.sum_bounded(events(spark, sf), "x", 2)


@query("max_argmax", f"SELECT CAST(max(fx) AS DOUBLE) / 256 AS value, count(*) FILTER (fx = (SELECT max(fx) FROM {EV})) AS n_attained FROM {EV}")
def _(spark, sf):
    return aggregates.extreme(events(spark, sf), "x", 2)


@query("min_argmin", f"SELECT CAST(min({BAL}) AS DOUBLE) / 256 AS value, count(*) FILTER ({BAL} = (SELECT min({BAL}) FROM customer)) AS n_attained FROM customer")
def _(spark, sf):
    return aggregates.extreme(table(spark, sf, "customer"), "c_acctbal", 2, largest=False)


@query("argmax_rows", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV} WHERE fx = (SELECT max(fx) FROM {EV})")
def _(spark, sf):
    return aggregates.arg_extreme(events(spark, sf), "x", 2, ["pos"])


@query("avg_bounded", f"SELECT l_returnflag, CAST(sum({PRICE}) AS DOUBLE) / 256 / count(*) AS avg_value, CAST(min({PRICE}) AS DOUBLE) / 256 AS min_value FROM lineitem GROUP BY 1")
def _(spark, sf):
    return aggregates.average(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", 2, "l_returnflag")


@query("max_groupby", f"SELECT user_id, CAST(max({VAL}) AS DOUBLE) / 256 AS max_value FROM events GROUP BY 1")
def _(spark, sf):
    return scan.bounded(table(spark, sf, "events").select("user_id", "value"), "value", 2).groupBy("user_id").agg(decode(F.max("fx"), 2).alias("max_value"))


@query("count_selection", f"SELECT count(*) AS n FROM {EV} WHERE fx > 15488")
def _(spark, sf):
    return events(spark, sf).where(gt("x", 60.5, 2)).agg(F.count(F.lit(1)).alias("n"))


@query("max_window", f"SELECT (pos - 100) // 450 AS bucket, CAST(max(fx) AS DOUBLE) / 256 AS max_value, count(*) AS n FROM {EV} WHERE pos >= 100 GROUP BY 1")
def _(spark, sf):
    return aggregates.windowed_max(events(spark, sf), "x", 2, 100, None, 450)


@query("argmax_window", f"SELECT bucket, pos, CAST(fx AS DOUBLE) / 256 AS max_value FROM (SELECT *, pos // 500 AS bucket, max(fx) OVER (PARTITION BY pos // 500) AS top FROM {EV}) WHERE fx = top")
def _(spark, sf):
    return aggregates.windowed_argmax(events(spark, sf), "x", 2, 0, None, 500)


@query("paa_mean", f"SELECT pos // 50 AS chunk, CAST(sum(fx) AS DOUBLE) / 256 / count(*) AS mean_value FROM {EV} GROUP BY 1")
def _(spark, sf):
    return transforms.paa(events(spark, sf), "x", 50, 2)


@query("paa_int", "SELECT (p_partkey - 1) // 30 AS chunk, CAST(sum(p_size) // count(*) AS BIGINT) AS mean_value FROM part GROUP BY 1")
def _(spark, sf):
    return transforms.paa_int(table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("pos"), "p_size"), "p_size", 30)


@query("range_scan", f"SELECT event_id, CAST({VAL} AS DOUBLE) / 256 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03'")
def _(spark, sf):
    day = F.col("ts").between(F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-03").cast("timestamp"))
    return table(spark, sf, "events").where(day).select("event_id", decode(fixed("value", 2), 2).alias("value"))


@query("single_series", f"SELECT event_id, CAST({VAL} AS DOUBLE) / 256 AS value FROM events WHERE user_id = 42")
def _(spark, sf):
    return table(spark, sf, "events").where("user_id = 42").select("event_id", decode(fixed("value", 2), 2).alias("value"))


# ---- integer baselines ----


@query("delta_zigzag", f"SELECT pos, (d << 1) # 0 AS zz FROM (SELECT pos, fx - coalesce(lag(fx) OVER (ORDER BY pos), fx) AS d FROM {EV})".replace("(d << 1) # 0", "CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END"))
def _(spark, sf):
    return baselines.delta_zigzag(scan.bounded(events(spark, sf), "x", 2), "fx")


@query("zigzag_width", f"SELECT length(bin(max(CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END))) AS width FROM (SELECT fx - coalesce(lag(fx) OVER (ORDER BY pos), fx) AS d FROM {EV})".replace("length(", "CAST(length(").replace(" AS width", " AS INTEGER) AS width"))
def _(spark, sf):
    return baselines.zigzag_width(scan.bounded(events(spark, sf), "x", 2), "fx")


@query("differential", f"SELECT pos, fx - coalesce(lag(fx) OVER (ORDER BY pos), 0) AS diff FROM {EV}")
def _(spark, sf):
    return baselines.differential(scan.bounded(events(spark, sf), "x", 2), "fx")


@query("for_bitwidth", "SELECT p_brand, CAST(min(p_size) AS BIGINT) AS base, CAST(CASE WHEN max(p_size) = min(p_size) THEN 0 ELSE length(bin(max(p_size) - min(p_size))) END AS INTEGER) AS width FROM part GROUP BY 1")
def _(spark, sf):
    return baselines.frame_of_reference(table(spark, sf, "part"), "p_size", ("p_brand",))


@query("split_int_frac", "SELECT p_partkey, CAST((p_size - (SELECT min(p_size) FROM part)) // 7 AS BIGINT) AS whole, CAST((p_size - (SELECT min(p_size) FROM part)) % 7 AS BIGINT) AS part FROM part")
def _(spark, sf):
    return baselines.split_int_frac(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", 7, ["p_partkey"])


@query("delta_offset", f"SELECT c_custkey, {BAL} - least(0, (SELECT min({BAL}) FROM customer)) AS offset FROM customer".replace(" AS offset", ' AS "offset"'))
def _(spark, sf):
    rows = scan.bounded(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 2)
    return baselines.delta_offset(rows, "fx", ["c_custkey"])


@query("scaled_ceil", "SELECT event_id, CAST(ceil(value * 10) AS BIGINT) AS scaled FROM events")
def _(spark, sf):
    return baselines.scaled_ceil(table(spark, sf, "events"), "value", 10, ["event_id"])


@query("zigzag_roundtrip", f"SELECT c_custkey, CASE WHEN {BAL} >= 0 THEN 2 * {BAL} ELSE -2 * {BAL} - 1 END AS zz, {BAL} AS back FROM customer")
def _(spark, sf):
    zz = baselines.zigzag(fixed("c_acctbal", 2))
    return table(spark, sf, "customer").select("c_custkey", zz.alias("zz"), baselines.unzigzag(zz).alias("back"))


query("roundtrip_bitpack", f"SELECT pos, fx AS x FROM {EV}")(lambda s, d: baselines.bitunpack(baselines.bitpack(scan.bounded(events(s, d), "x", 2), "fx", rows=4096)))
query("roundtrip_bitpack_delta", f"SELECT pos, fx AS x FROM {EV}")(lambda s, d: baselines.bitunpack(baselines.bitpack(scan.bounded(events(s, d), "x", 2), "fx", rows=4096, delta=True)))
query("roundtrip_bitpack_scaled", "SELECT event_id AS pos, CAST(ceil(value * 10) AS BIGINT) AS x FROM events")(lambda s, d: baselines.bitunpack(baselines.bitpack(baselines.scaled_ceil(table(s, d, "events"), "value", 10, ["event_id"]), "scaled", pos="event_id", rows=4096)))


# ---- bitmaps ----

A, B = "(fx > 15488)", "(fx < 23104)"
for _name, _sql in {"and": f"{A} AND {B}", "or": f"{A} OR {B}", "xor": f"{A} <> {B}", "andnot": f"{A} AND NOT {B}", "nand": f"NOT ({A} AND {B})", "nor": f"NOT ({A} OR {B})", "xnor": f"{A} = {B}", "not": f"NOT {A}"}.items():
    query(f"bitmap_{_name}", f"SELECT pos FROM {EV} WHERE {_sql}")(lambda spark, sf, n=_name: selections(spark, sf).where(bitmaps.boolean_algebra(F.col("a"), F.col("b"))[n]).select("pos"))


def _sets(spark, sf):
    e = table(spark, sf, "events")
    return bitmaps.of(e.where("event_type = 'click'").select(F.col("user_id").alias("pos"))), bitmaps.of(e.where("value > 150").select(F.col("user_id").alias("pos")))


SA, SB = "(SELECT DISTINCT user_id AS pos FROM events WHERE event_type = 'click')", "(SELECT DISTINCT user_id AS pos FROM events WHERE value > 150)"
query("set_union", f"SELECT pos FROM {SA} UNION SELECT pos FROM {SB}")(lambda s, d: bitmaps.union(*_sets(s, d)))
query("set_intersect", f"SELECT pos FROM {SA} INTERSECT SELECT pos FROM {SB}")(lambda s, d: bitmaps.intersect(*_sets(s, d)))
query("set_difference", f"SELECT pos FROM {SA} EXCEPT SELECT pos FROM {SB}")(lambda s, d: bitmaps.difference(*_sets(s, d)))
query("set_symmetric_difference", f"(SELECT pos FROM {SA} EXCEPT SELECT pos FROM {SB}) UNION (SELECT pos FROM {SB} EXCEPT SELECT pos FROM {SA})")(lambda s, d: bitmaps.symmetric_difference(*_sets(s, d)))
query("set_summary", f"SELECT count(*) AS n, min(pos) AS min_id, max(pos) AS max_id FROM {SA}")(lambda s, d: bitmaps.summary(_sets(s, d)[0]))
query("set_remove_range", f"SELECT pos FROM {SA} WHERE NOT (pos >= 10 AND pos < 50)")(lambda s, d: bitmaps.remove_range(_sets(s, d)[0], 10, 50))
query("set_insert_range", f"SELECT pos FROM {SA} UNION SELECT range FROM range(100000, 170000)")(lambda s, d: bitmaps.insert_range(_sets(s, d)[0], 100_000, 170_000))
query("set_negate", f"SELECT range AS pos FROM range(0, 500) EXCEPT SELECT pos FROM {SA}")(lambda s, d: bitmaps.negate(_sets(s, d)[0], 500))


@query("set_subset_disjoint", f"SELECT (SELECT count(*) FROM (SELECT pos FROM {SB} EXCEPT SELECT pos FROM {SA})) AS n_only_b, (SELECT count(*) FROM (SELECT pos FROM {SB} INTERSECT SELECT pos FROM {SA})) AS n_both")
def _(spark, sf):
    a, b = _sets(spark, sf)
    mark = b.join(a.withColumn("__in", F.lit(1)), "pos", "left")
    return mark.agg(F.count(F.when(F.col("__in").isNull(), 1)).alias("n_only_b"), F.count("__in").alias("n_both"))


@query("bitmap_flags", f"SELECT bool_and({A}) AS all_set, NOT bool_or({A}) AS none_set, bool_or({A}) AS any_set FROM {EV}")
def _(spark, sf):
    return bitmaps.flags(selections(spark, sf), F.col("a"))


@query("bitmap_count", f"SELECT count(*) AS n FROM {EV} WHERE {A}")
def _(spark, sf):
    return bitmaps.packed_count(bitmaps.packed(selections(spark, sf).where("a").select("pos")))


@query("bitmap_packed_and", f"SELECT count(*) AS n FROM {EV} WHERE {A} AND {B}")
def _(spark, sf):
    rows = selections(spark, sf)
    return bitmaps.packed_count(bitmaps.packed_combine(bitmaps.packed(rows.where("a")), bitmaps.packed(rows.where("b")), "and"))


@query("bitmap_packed_or", f"SELECT count(*) AS n FROM {EV} WHERE {A} OR {B}")
def _(spark, sf):
    rows = selections(spark, sf)
    return bitmaps.packed_count(bitmaps.packed_combine(bitmaps.packed(rows.where("a")), bitmaps.packed(rows.where("b")), "or"))


@query("bitmap_words", "SELECT * FROM (VALUES (7), (64), (65), (66), (67), (68), (69), (70), (64000), (64001), (64002), (64003), (64004), (64005), (64006)) t(pos)".replace("SELECT *", "SELECT CAST(pos AS BIGINT) AS pos"))
def _(spark, sf):
    words = spark.createDataFrame([(0, 128), (64, 127), (64000, 127)], "at long, word long")
    return bitmaps.insert_words(spark.range(0).withColumnRenamed("id", "pos"), words)


@query("bitmap_from_bytes", "SELECT CAST(pos AS BIGINT) AS pos FROM (VALUES (0), (2), (11), (14)) t(pos)")
def _(spark, sf):
    return bitmaps.from_bytes(spark.createDataFrame([(0, bytearray([0b10100000, 0b00010010]))], "at long, data binary"), "at", "data")


@query("roaring_size", "SELECT CAST(8 + sum(8 + least(2 * c, 8192)) AS BIGINT) AS n_bytes FROM (SELECT pos // 65536 AS k, count(*) AS c FROM (SELECT DISTINCT l_orderkey AS pos FROM lineitem) GROUP BY 1)")
def _(spark, sf):
    return bitmaps.portable_size(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pos")))


@query("roaring_roundtrip", "SELECT DISTINCT l_orderkey AS pos FROM lineitem")
def _(spark, sf):
    return bitmaps.container_ids(bitmaps.container_rows(bitmaps.of(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pos")))))


query("roaring_export", "SELECT DISTINCT l_orderkey AS pos FROM lineitem")(lambda s, d: bitmaps.deserialize(bitmaps.serialize(bitmaps.of(table(s, d, "lineitem").select(F.col("l_orderkey").alias("pos"))))))


@query("roaring_buckets", "SELECT pos // 4294967296 AS hi, count(*) AS n FROM (SELECT DISTINCT l_orderkey * 3000000 AS pos FROM lineitem) GROUP BY 1")
def _(spark, sf):
    ids = bitmaps.of(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 3_000_000).alias("pos")))
    return ids.groupBy(F.shiftright("pos", 32).alias("hi")).agg(F.count(F.lit(1)).alias("n"))


# ---- codecs, segments and transforms ----

for _layout in codecs.LAYOUTS:
    query(f"roundtrip_{_layout}", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV}")(lambda spark, sf, n=_layout: codecs.decode_segments(codecs.encode(events(spark, sf), "x", 2, n, rows=4096)))

KNOWN = (-(1 << 20), 1 << 22)
SOFF = f"(SELECT pos, fx - {KNOWN[0]} AS off, {KNOWN[0]} AS base, {(KNOWN[1] - KNOWN[0]).bit_length()} AS w FROM {EV})"
CLICKS = "(SELECT event_id FROM events WHERE event_type = 'click')"


def _segments(spark, sf, layout: str, known: bool = False) -> DataFrame:
    return codecs.encode(events(spark, sf), "x", 2, layout, rows=4096, known=KNOWN if known else None)


def _clicks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("pos"))


for _layout in codecs.LAYOUTS:
    for _op, _word in ((">", "gt"), ("<", "lt"), ("=", "eq")):
        query(f"segment_filter_{_word}_{_layout}", f"SELECT pos FROM {EV} WHERE fx {_op} 15488")(lambda spark, sf, n=_layout, o=_op: encoded.filter_segments(_segments(spark, sf, n), o, 60.5, 2))
    for _op, _word in ((">", "gt"), ("<", "lt")):
        query(f"segment_select_{_word}_{_layout}", f"SELECT pos FROM {EV} WHERE fx {_op} 15488 AND pos IN {CLICKS}")(lambda spark, sf, n=_layout, o=_op: encoded.filter_segments(_segments(spark, sf, n), o, 60.5, 2, _clicks(spark, sf), 4096))
    query(f"segment_sum_{_layout}", f"SELECT CAST(sum(fx) AS DOUBLE) / 256 AS sum_value, count(*) AS n FROM {EV}")(lambda spark, sf, n=_layout: encoded.sum_segments(_segments(spark, sf, n), 2))
    query(f"segment_max_{_layout}", f"SELECT CAST(max(fx) AS DOUBLE) / 256 AS value, count(*) FILTER (fx = (SELECT max(fx) FROM {EV})) AS n_attained FROM {EV}")(lambda spark, sf, n=_layout: encoded.max_segments(_segments(spark, sf, n), 2))
    query(f"segment_argmax_{_layout}", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV} WHERE fx = (SELECT max(fx) FROM {EV})")(lambda spark, sf, n=_layout: encoded.argmax_segments(_segments(spark, sf, n), 2))
    query(f"segment_max_window_{_layout}", f"SELECT (pos - 100) // 450 AS bucket, CAST(max(fx) AS DOUBLE) / 256 AS max_value, count(*) AS n FROM {EV} WHERE pos >= 100 GROUP BY 1")(lambda spark, sf, n=_layout: encoded.windowed_max_segments(_segments(spark, sf, n), 2, 100, 450))
    query(f"segment_gather_{_layout}", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV} WHERE pos IN {CLICKS}")(lambda spark, sf, n=_layout: encoded.gather_segments(_segments(spark, sf, n), _clicks(spark, sf), 4096))


def _kept_sql(q: int) -> str:
    """The kept-bits rule at precision 2 (8 fraction bits), in SQL."""
    whole = "CAST(ceil({0} / 8.0) * 8 AS INTEGER)"
    i = "greatest(w - 8, 0)"
    if q == 0:
        return f"least({whole.format(i)}, w)"
    need = f"({i} + {5 if q == 1 else 8})"
    return f"least(CASE WHEN {need} // 8 < w // 8 THEN {whole.format(need)} ELSE {need} END, w)"


for _q in (0, 1, 2):
    _drop = f"CAST(w - {_kept_sql(_q)} AS INTEGER)"
    _low = f"base + ((off >> {_drop}) << {_drop})"
    query(f"decode_reduced_{_q}", f"SELECT pos, CAST({_low} AS DOUBLE) / 256 AS value FROM {EVOFF}")(lambda spark, sf, q=_q: scan.decode_reduced(events(spark, sf), "x", 2, q, ["pos"]))
    query(f"sum_reduced_{_q}", f"SELECT CAST(sum({_low}) AS DOUBLE) / 256 AS sum_value, count(*) AS n FROM {EVOFF}")(lambda spark, sf, q=_q: aggregates.sum_reduced(events(spark, sf), "x", 2, q))
    query(f"decode_reduced_{_q}_known", f"SELECT pos, CAST({_low} AS DOUBLE) / 256 AS value FROM {SOFF}")(lambda spark, sf, q=_q: scan.decode_reduced(events(spark, sf), "x", 2, q, ["pos"], KNOWN))
    query(f"sum_reduced_{_q}_known", f"SELECT CAST(sum({_low}) AS DOUBLE) / 256 AS sum_value, count(*) AS n FROM {SOFF}")(lambda spark, sf, q=_q: aggregates.sum_reduced(events(spark, sf), "x", 2, q, KNOWN))
    for _layout in ("plain", "slice", "majority", "residue"):
        query(f"segment_reduced_{_q}_{_layout}", f"SELECT pos, CAST({_low} AS DOUBLE) / 256 AS value FROM {SOFF}")(lambda spark, sf, q=_q, n=_layout: encoded.decode_reduced(_segments(spark, sf, n, True), 2, q))
        query(f"segment_sum_reduced_{_q}_{_layout}", f"SELECT CAST(sum({_low}) AS DOUBLE) / 256 AS sum_value, count(*) AS n FROM {SOFF}")(lambda spark, sf, q=_q, n=_layout: encoded.sum_segments(_segments(spark, sf, n, True), 2, q))


@query("encode_known_stats", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV}")
def _(spark, sf):
    return codecs.decode_segments(codecs.encode(events(spark, sf), "x", 2, "plain", rows=4096, known=(-(1 << 20), 1 << 22)))


def _ratios(spark, sf, layouts) -> DataFrame:
    parts = [codecs.ratio(codecs.encode(events(spark, sf), "x", 2, layout)) for layout in layouts]
    return functools.reduce(DataFrame.unionByName, parts)


query("compression_ratio", f"""WITH s AS (SELECT count(*) AS n, length(bin(max(fx) - min(fx))) AS w FROM {EV} GROUP BY pos // 65536)
SELECT layout, sum(CASE layout WHEN 'offset' THEN (n * greatest(0, w - 8) + 7) // 8 + n ELSE n * (w // 8) + CASE WHEN layout = 'slice' AND w % 8 > 0 THEN n ELSE (n * (w % 8) + 7) // 8 END END + 40) / CAST(sum(8 * n + 40) AS DOUBLE) AS ratio, CAST(sum(n) AS BIGINT) AS n
FROM s, (VALUES ('plain'), ('flipped'), ('slice'), ('offset')) l(layout) GROUP BY layout""")(lambda s, d: _ratios(s, d, ("plain", "flipped", "slice", "offset")))
query("compression_ratio_sparse")(lambda s, d: _ratios(s, d, ("majority", "residue")))


_MANTISSA = "(floor(abs(value) / pow(2.0, e - 51 + p)) * 2 + 1) * pow(2.0, e - 52 + p)"
_TOP = "CASE WHEN (e + 1023) % 2 = 1 THEN pow(2.0, e) ELSE pow(2.0, e + 1) END"


@query("bound_mantissa", f"""WITH v AS (SELECT event_id AS pos, value, CASE WHEN value = 0 THEN NULL ELSE CAST(floor(log2(abs(value))) AS INTEGER) END AS e FROM events),
t AS (SELECT pos, value, p, sign(value) * CASE WHEN p < 52 THEN {_MANTISSA} ELSE {_TOP} END AS y FROM v, (SELECT unnest(range(53)) AS p) WHERE e IS NOT NULL),
f AS (SELECT pos, coalesce(min(p) FILTER (NOT abs(value - y) < 0.49 * 0.01), 53) AS stop FROM t GROUP BY pos)
SELECT pos, y AS value FROM t JOIN f USING (pos) WHERE p = stop - 1 UNION ALL SELECT pos, pow(2.0, -1022) FROM v WHERE e IS NULL""")
def _(spark, sf):
    return codecs.bound_mantissa(events(spark, sf), "x", 2, ["pos"])


@query("segment_chain", "SELECT user_id AS signal, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_timestamp FROM events")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("signal"), F.col("ts").alias("timestamp"), "event_id")
    return segments.link(rows, ("event_id",)).select("signal", "event_id", "prev_timestamp")


def _series(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", F.lit(0).alias("signal"))
    return segments.chunk(e, "signal", "ts", "value", 1000, "event_id")


@query("fft_roundtrip", "SELECT CAST(event_id // 1000 AS BIGINT) AS signal, CAST(event_id % 1000 AS INTEGER) AS i, round(value, 6) AS value FROM events")
def _(spark, sf):
    back = transforms.ifft(transforms.fft(_series(spark, sf), key="segment"), key="segment", normalised=True)
    return back.select(F.col("segment").alias("signal"), F.posexplode("data").alias("i", "v")).select("signal", "i", F.round("v", 6).alias("value"))


@query("fft_reduced", """WITH x AS (SELECT event_id // 1000 AS segment, event_id % 1000 AS t, value, count(*) OVER (PARTITION BY event_id // 1000) AS n FROM events),
f AS (SELECT segment, k, max(n) AS n, sum(value * cos(2 * pi() * ((k * t) % n) / n)) AS re, sum(value * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM x, (SELECT unnest(range(1000)) AS k) WHERE k < n GROUP BY segment, k),
p AS (SELECT segment, n, re * re + im * im AS power, row_number() OVER (PARTITION BY segment ORDER BY re * re + im * im DESC) AS place FROM f)
SELECT segment, count(*) FILTER (place <= greatest(1, n // 20)) AS n_kept, round(sum(power) FILTER (place <= greatest(1, n // 20)) / sum(power), 5) AS kept_share FROM p GROUP BY segment""")
def _(spark, sf):
    """Coefficients kept of each segment and their share of the power (a pair of equal ones counts the same whichever is kept)."""
    series = _series(spark, sf)
    power = lambda c: F.aggregate(F.zip_with("re", "im", lambda x, y: x * x + y * y), F.lit(0.0), lambda a, v: a + v).alias(c)
    kept = transforms.fft(series, 0.05, key="segment").select("segment", F.size(F.filter(F.zip_with("re", "im", lambda x, y: (x != 0) | (y != 0)), lambda v: v)).cast("long").alias("n_kept"), power("kept"))
    return kept.join(transforms.fft(series, key="segment").select("segment", power("all")), "segment").select("segment", "n_kept", F.round(F.col("kept") / F.col("all"), 5).alias("kept_share"))


@query("knn_reduced", "WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda v: trunc(CAST(v AS DOUBLE) * 32768)) AS q FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS near_id, b.label AS near_label, list_sum(list_transform(list_zip(a.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM t a JOIN t b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, near_id, near_label, d / 1073741824.0 AS distance FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, near_id) = 1".replace("d / 1073741824.0", "d / CAST(1073741824 AS DOUBLE)"))
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    return transforms.nearest_neighbour(e, e.where("vec_id % 100 = 0"), 4)


@query("kept_bits_rule", "SELECT * FROM (VALUES (16, 0, 8), (16, 1, 16), (16, 2, 16), (21, 0, 16), (21, 1, 18), (24, 1, 24), (5, 0, 0), (5, 1, 5)) t(w, q, kept)")
def _(spark, sf):
    rows = spark.createDataFrame([(w, q) for w in (16, 21, 24, 5) for q in (0, 1, 2)], "w int, q int").where("NOT (q = 2 AND w <> 16) AND NOT (w = 24 AND q = 0)")
    kept = F.when(F.col("q") == 0, kept_bits(F.col("w"), 2, 0)).when(F.col("q") == 1, kept_bits(F.col("w"), 2, 1)).otherwise(kept_bits(F.col("w"), 2, 2))
    return rows.select("w", "q", kept.alias("kept"))


# ---- byte columns, bit vectors, codecs by name, sources ----

BYTE = f"(SELECT pos, CAST((fx >> 8) & 255 AS INTEGER) AS b FROM {EV})"


def _bytes(spark, sf):
    return scan.bounded(events(spark, sf), "x", 2).select("pos", plane(F.col("fx"), 16, 0).cast("int").alias("b"))


query("byte_filter_gt", f"SELECT pos FROM {BYTE} WHERE b > 60")(lambda s, d: planes_.range_filter(_bytes(s, d), "b", 60).select("pos"))
query("byte_filter_eq", f"SELECT pos FROM {BYTE} WHERE b = 60")(lambda s, d: planes_.equal_filter(_bytes(s, d), "b", 60).select("pos"))
query("byte_filter_progressive", f"SELECT pos FROM {BYTE} WHERE b % 2 = 0 AND b > 60")(lambda s, d: planes_.progressive(_bytes(s, d), F.col("b") % 2 == 0, "b", 60).select("pos"))
query("byte_filter_progressive_eq", f"SELECT pos FROM {BYTE} WHERE b % 2 = 0 AND b = 60")(lambda s, d: planes_.progressive(_bytes(s, d), F.col("b") % 2 == 0, "b", 60, equal=True).select("pos"))
query("byte_tie_share", f"SELECT count(*) FILTER (b = 60) / CAST(count(*) AS DOUBLE) AS tie_share FROM {BYTE}")(lambda s, d: planes_.tie_share(_bytes(s, d), "b", 60))
query("byte_sum", f"SELECT CAST(sum(b) AS BIGINT) AS sum_value FROM {BYTE}")(lambda s, d: planes_.byte_sum(_bytes(s, d), "b"))
query("sparse_plane_roundtrip", f"SELECT pos, b FROM {BYTE}")(lambda s, d: planes_.dense_plane(*planes_.sparse_plane(_bytes(s, d), "b", 69)))
query("components", "SELECT c_custkey, CAST(trunc(c_acctbal * 256) AS BIGINT) >> 8 AS whole, CAST(trunc(c_acctbal * 256) AS BIGINT) & 255 AS fraction FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", *[c.alias(n) for n, c in components("c_acctbal", 2).items()]))
query("bitmap_append", f"SELECT pos FROM {SA} UNION ALL SELECT pos + 100000 FROM {SB}")(lambda s, d: bitmaps.append(_sets(s, d)[0], 100_000, _sets(s, d)[1]))
query("bitmap_split_off", f"SELECT pos - 20 AS pos FROM {SA} WHERE pos >= 20")(lambda s, d: bitmaps.split_off(_sets(s, d)[0], 20)[1])
query("bitmap_truncate", f"SELECT pos FROM {SA} WHERE pos < 20")(lambda s, d: bitmaps.truncate(_sets(s, d)[0], 20))
_FIRST = "SELECT min(pos) AS {q}first{q}, arg_min(in_a, pos) AS a_is_greater FROM (SELECT pos, true AS in_a FROM {a} EXCEPT SELECT pos, true FROM {b} UNION ALL (SELECT pos, false FROM {b} EXCEPT SELECT pos, false FROM {a}))"
query("bitmap_compare", _FIRST.format(q='"', a=SA, b=SB))(lambda s, d: bitmaps.first_difference(*_sets(s, d)))
query("bitmap_compare_equal", _FIRST.format(q='"', a=SA, b=SA))(lambda s, d: bitmaps.first_difference(_sets(s, d)[0], _sets(s, d)[0]))
query("bitmap_binary_roundtrip", f"SELECT pos FROM {SA}")(lambda s, d: bitmaps.from_binary(bitmaps.to_binary(_sets(s, d)[0], 100_000, rows=64)))
query("codec_paa", f"SELECT pos, avg_value AS value FROM {EV} JOIN (SELECT pos // 25 AS c, CAST(sum(fx) AS DOUBLE) / 256 / count(*) AS avg_value FROM {EV} GROUP BY 1) ON pos // 25 = c")(lambda s, d: (lambda c: c.decode(c.encode(events(s, d))))(codec.CODECS["paa"](2, 25)))
query("codec_fourier", "SELECT event_id AS pos, round(value, 6) AS value FROM events")(lambda s, d: (lambda c: c.decode(c.encode(events(s, d))).withColumn("value", F.round("value", 6)))(codec.CODECS["fourier"]()))
query("codec_majority", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV}")(lambda s, d: (lambda c: c.decode(c.encode(events(s, d))))(codec.CODECS["majority"](2)))
query("predicted_ratio")(lambda s, d: codec.predict_ratio(events(s, d), 2, "plain", 0.5, rows=256))
query("generated_outlier_bytes", "SELECT CAST(5000 AS BIGINT) AS n, true AS has_ends, true AS near_share")(lambda s, d: generators.outlier_bytes(s, 5000, 0.9, 1).agg(F.count("b").alias("n"), ((F.min("b") == 0) & (F.max("b") == 255)).alias("has_ends"), (F.count(F.when(F.col("b") == 69, 1)).between(4400, 4600)).alias("near_share")))
query("generated_normal")(lambda s, d: generators.normal(s, 1000, 5.0, 2.0, 7))

query("encode_forced_majority", f"SELECT pos, CAST(fx AS DOUBLE) / 256 AS value FROM {EV}")(lambda s, d: codecs.decode_segments(codecs.encode(events(s, d), "x", 2, "majority", rows=4096, known=(0, 1 << 20), forced=69)))
query("component_lengths", f"SELECT CAST(max(CASE WHEN a >> 8 = 0 THEN 0 ELSE length(bin(a >> 8)) END) AS INTEGER) AS integer_bits, CAST(max(CASE WHEN a % 256 = 0 THEN 0 ELSE 9 - length(bin(a & -a)) END) AS INTEGER) AS fraction_bits FROM (SELECT abs({BAL}) AS a FROM customer)")(lambda s, d: codecs.lengths(table(s, d, "customer"), "c_acctbal", 2))
query("binary_expansion", """WITH v AS (SELECT event_id AS pos, abs(value) - floor(abs(value)) AS f FROM events),
k AS (SELECT pos, f, k, f * pow(2.0, k) - floor(f * pow(2.0, k)) AS r FROM v, (SELECT unnest(range(65)) AS k)),
n AS (SELECT pos, min(k) AS n FROM k WHERE r * pow(2.0, -k) < 0.49 * 0.01 GROUP BY pos)
SELECT pos, coalesce(string_agg(CASE WHEN floor(f * pow(2.0, k)) % 2 = 1 THEN '1' ELSE '0' END, '' ORDER BY k) FILTER (k BETWEEN 1 AND n), '') AS bits FROM k JOIN n USING (pos) GROUP BY pos""")(lambda s, d: codecs.expand(events(s, d), "x", 2, ["pos"]))


@query("stream_max_window", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(max({VAL}) AS DOUBLE) / 256 AS max_value, count(*) AS n FROM events GROUP BY 1".replace("AS start", 'AS "start"'))
def _(spark, sf):
    """Event-time windows over a file stream, run to its end into a table of this session."""
    from decafix.streaming import paced

    schema = table(spark, sf, "events").select("ts", "value").schema
    out = scratch(spark, "stream")
    stream = paced.windowed_max_stream(paced.parquet_source(spark, sf, schema, only="events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", 2, "1 hour")
    write = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/rows")  # noqa: E731  a complete result replaces the one before
    q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "max_value", "n")


# ---- sources: tables written as text or bytes to the shared folder, and read back by the scans ----


def _text(spark, sf, table_: str, key: str, x: str) -> str:
    """A folder of lines: a label, then some of the column's numbers and a cell that is none."""
    path = scratch(spark, "text")
    cells = F.concat_ws(",", F.lit("label"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, x))), lambda s: s[x].cast("string")), ","), F.lit("no number"))
    table(spark, sf, table_).groupBy(F.expr(f"{key} div 10")).agg(cells.alias("value")).select("value").write.text(path)
    return path


query("csv_floats", "SELECT value AS x FROM events")(lambda s, d: scans.csv_floats(s, _text(s, d, "events", "event_id", "value"), skip=1).select("x"))
query("csv_positions", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS low, CAST(count(*) - 1 AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS n_pos FROM events")(lambda s, d: scans.with_positions(scans.csv_floats(s, _text(s, d, "events", "event_id", "value"), skip=1), ["file", "line_at", "cell_at"]).agg(F.count("x").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("pos").alias("n_pos")))
for _signed in (True, False):
    _c = "CAST(ceil(CAST(c_acctbal AS FLOAT) * CAST(10 AS FLOAT)) AS BIGINT)"
    query("csv_ints" if _signed else "csv_unsigned_ints", f"SELECT {_c if _signed else f'abs({_c})'} AS x FROM customer")(lambda s, d, g=_signed: scans.csv_ints(s, _text(s, d, "customer", "c_custkey", "c_acctbal"), 10, skip=1, signed=g).select("x"))


@query("binary_records", "SELECT CAST(c_nationkey AS VARCHAR) AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS at, CAST(c_custkey % 100 AS DOUBLE) AS x FROM customer".replace("AS at", 'AS "at"'))
def _(spark, sf):
    """Four-byte integers, one file's bytes for each nation, split on 0xFF."""
    piece = lambda k: F.concat(F.lpad(F.hex(k % 100), 2, "0"), F.lit("000000FF"))
    files = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), piece), "")).alias("content"))
    return scans.records(files, 255, "<i")


@query("client_file_stream", "SELECT value AS x FROM events")
def _(spark, sf):
    """A described file client, streamed to its end."""
    out = scratch(spark, "client")
    clients.described({"type": "file", "params": {"file": _text(spark, sf, "events", "event_id", "value"), "skip_val": 1}}).run(spark, f"{out}/rows", f"{out}/log")
    return spark.read.parquet(f"{out}/rows").select("x")


@query("client_batch_amount", "SELECT CAST(100 AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_unknown")
def _(spark, sf):
    """A file client's first ``amount`` numbers: how many, and how many of them aren't in the table (the limit is the feature)."""
    rows = clients.Client("file", amount=100, path=_text(spark, sf, "events", "event_id", "value"), skip=1).batch(spark)
    known = table(spark, sf, "events").select(F.col("value").alias("x"), F.lit(1).alias("known")).distinct()
    return rows.select("x").join(known, "x", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("n_unknown"))
