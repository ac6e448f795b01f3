"""Streams give what batches give."""

from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.streaming import live
from tests.conftest import rows


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, df, path, files=3, order="t"):
    n = df.count()
    for i in range(files):
        lo, hi = i / files, (i + 1) / files
        df.where((F.col(order) >= int(lo * n)) & (F.col(order) < int(hi * n))).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_delta(spark, tmp_path):
    n = 12
    data = spark.createDataFrame([(1, t, [float(t * t % 7), float(t)], t == n - 1) for t in range(n)], "stream int, t long, vec array<double>, end boolean")
    out = run(spark, live.stateful(source(spark, data, f"{tmp_path}/in"), live.Delta(2), "stream int, t long, delta array<double>"), "delta_live", tmp_path)
    batch = S.delta(data)
    assert {r.t: [round(x, 9) for x in r.delta] for r in out.collect()} == {r.t: [round(x, 9) for x in r.delta] for r in batch.collect()}


def test_map_mean(spark, tmp_path):
    data = spark.createDataFrame([(1, t, float(t % 5), False) for t in range(9)], "stream int, t long, x double, end boolean")
    out = run(spark, live.stateful(source(spark, data, f"{tmp_path}/in"), live.MapMean(), "stream int, t long, x double"), "mean_live", tmp_path)
    batch = S.map_cmn(data)
    assert [round(r[0], 9) for r in rows(out.select("x", "t"), "t")] == [round(r[0], 9) for r in rows(batch.select("x", "t"), "t")]


def test_endpointer(spark, tmp_path):
    active = [0, 1, 1, 0, 1, 0, 0, 0, 1, 0]
    data = spark.createDataFrame([(1, c, bool(a), c == len(active) - 1) for c, a in enumerate(active)], "stream int, chunk long, active boolean, end boolean")
    out = run(spark, live.stateful(source(spark, data, f"{tmp_path}/in", order="chunk"), live.Endpointer(1), "stream int, first_chunk long, last_chunk long, active long"), "ends_live", tmp_path)
    from cadenza.operators.segment import endpoints

    batch = endpoints(data.select("stream", "chunk", "active"), 1)
    assert rows(out.select("first_chunk", "last_chunk", "active")) == rows(batch.select("first_chunk", "last_chunk", "active"))


def test_control_and_batches(spark, tmp_path):
    data = spark.createDataFrame([(1, t) for t in range(6)], "stream int, t long")
    c, seen, fired = live.Control(), [], []
    c.bind("paused", lambda: fired.append("pause"))
    assert c.command("STATUS") == "running"
    c.command("ADDGRAM", "g", ([], {}, []))
    c.command("ADDPROCESS", "p")

    def consume(batch, number):
        seen.append(batch.count())
        if number == 0:
            c.command("PAUSE")

    live.run_batches(source(spark, data, f"{tmp_path}/in"), c, consume, f"{tmp_path}/cp").awaitTermination(120)
    assert seen == [2] and fired == ["pause"] and c.grammars.active() == [0] and c.processes == {"p": True}


def test_event_time_windows(spark):
    df = spark.sql("select 1 as stream, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, cast(id as double) as value from range(10)")
    w = live.sliding(live.with_event_time(df, "ts", "5 minutes"), "ts", "5 minutes")
    assert [r.n for r in w.orderBy("start").collect()] == [5, 5]


def test_live_source(spark, tmp_path):
    from cadenza.sources.readers import SampleBlocks, open_source

    spark.dataSource.register(SampleBlocks)
    df = spark.readStream.format("sample_blocks").options(samples=100, block=40).load()
    q = df.writeStream.format("memory").queryName("live_blocks").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        import time

        until = time.time() + 60
        while spark.table("live_blocks").count() < 200 and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert rows(spark.table("live_blocks")) == rows(open_source(spark, "sample_blocks", samples=100, block=40))


def test_energy_norm(spark, tmp_path):
    data = spark.createDataFrame([(1, 0, 4.0, False), (1, 1, 2.0, True), (1, 2, 6.0, False), (1, 3, 1.0, False)], "stream int, t long, x double, end boolean")
    out = run(spark, live.stateful(source(spark, data, f"{tmp_path}/in", 2), live.EnergyNorm(2.5), "stream int, t long, x double"), "energy_live", tmp_path)
    assert [r[0] for r in rows(out.select("x", "t"), "t")] == [1.0, -1.0, 1.0, -1.5]
