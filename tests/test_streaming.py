from decafix.operators import codecs
from decafix.streaming import paced


def test_encode_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(300).selectExpr("id as pos", "id * 0.5D as x").repartition(3).write.parquet(str(src))
    stream = paced.parquet_source(spark, str(src), "pos long, x double")
    q = paced.encode_stream(stream, "x", 2, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = codecs.decode_segments(spark.read.parquet(str(tmp_path / "out")).drop("epoch"))
    assert {tuple(r) for r in got.collect()} == {(i, i * 0.5) for i in range(300)}


def test_bounded_rate(spark):
    q = paced.rate_source(spark, 500).writeStream.format("noop").start()
    assert paced.run_bounded(q, amount=200, seconds=20) >= 200 and not q.isActive


def test_windowed_max(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0,0,0,id) as ts, cast(id as double) as x from range(180)").write.parquet(str(tmp_path / "in"))
    stream = paced.windowed_max_stream(paced.parquet_source(spark, str(tmp_path / "in"), "ts timestamp, x double"), "ts", "x", 2)
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["max_value"], r["n"]) for r in spark.table("w").collect()) == [(59.0, 60), (119.0, 60), (179.0, 60)]
