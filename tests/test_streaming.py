import datetime as dt

from pyspark.sql import functions as F

from gridloom.streaming import feeds, runs

SCHEMA = "region string, at timestamp, without int"
T = lambda h: dt.datetime(2026, 1, 1, h)


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def drain(df, folder, sink=None, mode="append"):
    w = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).outputMode(mode)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{folder}/out")).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_latest_state_and_history(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [("a", T(1), 5), ("b", T(1), 7)])
    for name, sink in (("latest", runs.latest_state(f"{tmp_path}/latest", ["region"], F.col("at").desc())), ("history", runs.history(f"{tmp_path}/history", ["region", "at"]))):
        drain(feeds.read_feed(spark, src, SCHEMA), f"{tmp_path}/{name}-q", sink)
    put(spark, src, [("a", T(2), 6), ("a", T(1), 5)])
    for name, sink in (("latest", runs.latest_state(f"{tmp_path}/latest", ["region"], F.col("at").desc())), ("history", runs.history(f"{tmp_path}/history", ["region", "at"]))):
        drain(feeds.read_feed(spark, src, SCHEMA), f"{tmp_path}/{name}-q", sink)
    state = lambda n: sorted((r["region"], r["at"].hour, r["without"]) for r in runs.read_state(spark, f"{tmp_path}/{n}").collect())
    assert state("latest") == [("a", 2, 6), ("b", 1, 7)]
    assert state("history") == [("a", 1, 5), ("a", 2, 6), ("b", 1, 7)]
    # a batch that runs again changes nothing
    again = runs.latest_state(f"{tmp_path}/latest", ["region"], F.col("at").desc())
    again(spark.createDataFrame([("a", T(2), 6), ("a", T(1), 5)], SCHEMA), 1)
    assert state("latest") == [("a", 2, 6), ("b", 1, 7)]


def folders(path):
    import os

    return {(int(r[4:]), int(b[7:])) for r in os.listdir(path) if r.startswith("run=") for b in os.listdir(f"{path}/{r}") if b.startswith("bucket=")}


def test_a_batch_writes_its_own_buckets_and_runs_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "MOST_RUNS", 3)
    state, past = f"{tmp_path}/state", f"{tmp_path}/past"
    newest, oldest = {}, {}
    for number in range(9):
        rows = [(f"k{k}", T(number), number) for k in (range(40) if number == 0 else (number, number + 1, 100 + number, None)) if k is not None] + [(None, T(1), number)]
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2 if number in (0, 4, 8) else 1):  # some run again
            before = folders(state) if number else set()
            runs.latest_state(state, ["region"], F.col("at").desc(), buckets=64)(batch, number)
            runs.history(past, ["region"], buckets=4)(batch, number)
        assert len({b for r, b in folders(state) - before if r == 2 * number + 1}) <= len(rows)
        newest |= {r[0]: r[2] for r in rows}
        oldest |= {r[0]: r[2] for r in rows if r[0] not in oldest}
        assert {r["region"]: r["without"] for r in runs.read_state(spark, state).collect()} == newest
        assert {r["region"]: r["without"] for r in runs.read_state(spark, past).collect()} == oldest
    assert any(r % 2 == 0 for r, _ in folders(past))
    assert max(sum(1 for r, b in folders(past) if b == bucket) for bucket in range(4)) <= 2 * (runs.MOST_RUNS + 2)


def test_windows_drop_what_is_too_late(spark, tmp_path):
    src = f"{tmp_path}/in"
    put(spark, src, [("a", T(1), 1), ("a", T(1), 2), ("a", T(5), 1)])
    stream = lambda: feeds.windowed(feeds.read_feed(spark, src, SCHEMA), "at", "1 hour", None, "1 hour", ("region",))
    drain(stream(), f"{tmp_path}/q")
    put(spark, src, [("a", T(1), 3), ("a", T(9), 1)])  # the first is late
    drain(stream(), f"{tmp_path}/q")
    got = sorted((r["start"].hour, r["n"]) for r in spark.read.parquet(f"{tmp_path}/q/out").collect())
    assert got == [(1, 2), (5, 1)]


def test_change_only_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = f"{tmp_path}/in"
    put(spark, src, [("a", T(1), 5), ("a", T(2), 5), ("a", T(3), 6), ("b", T(1), 5)])
    stream = lambda: feeds.change_only(feeds.read_feed(spark, src, SCHEMA), "region", "at", ["without"])
    drain(stream(), f"{tmp_path}/q")
    put(spark, src, [("a", T(4), 6), ("b", T(2), 4)])
    drain(stream(), f"{tmp_path}/q")
    got = sorted((r["region"], r["at"].hour, r["without"]) for r in spark.read.parquet(f"{tmp_path}/q/out").collect())
    assert got == [("a", 1, 5), ("a", 3, 6), ("b", 1, 5), ("b", 2, 4)]


def test_change_only_takes_null_for_a_value(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, schema = f"{tmp_path}/in", "region string, at timestamp, without int, share double, note string"
    batches = [[("k", T(1), None, None, None), ("m", T(1), 5, None, "x")], [("k", T(2), None, None, None), ("m", T(2), 5, None, "x")], [("k", T(3), None, 0.5, None), ("m", T(3), None, None, "x"), ("m", T(4), None, None, None)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        drain(feeds.change_only(feeds.read_feed(spark, src, schema), "region", "at", ["without", "share", "note"]), f"{tmp_path}/q")
    got = sorted((r["region"], r["at"].hour) for r in spark.read.parquet(f"{tmp_path}/q/out").collect())
    assert got == [("k", 1), ("k", 3), ("m", 1), ("m", 3), ("m", 4)]


def test_quiet_alerts_of_a_stream_are_those_of_a_table(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, schema = f"{tmp_path}/in", "key string, at timestamp"
    at = lambda d, h: dt.datetime(2026, 1, d, h)
    batches = [[("k", at(1, 0)), ("k", at(1, 20)), ("m", at(1, 1))], [("k", at(2, 19)), ("m", at(3, 0))], [("k", at(4, 0)), ("k", at(4, 1)), ("n", at(4, 2))], [("m", at(4, 3)), ("k", at(8, 0))]]
    for rows in batches:  # each a restart
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        drain(feeds.quiet_alerts(feeds.read_feed(spark, src, schema), ["key"], "at"), f"{tmp_path}/q")
    order = ["key", "at"]
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/q/out").select("key", "at", "sent").orderBy(*order).collect()]
    want = feeds.alert_dedup(spark.createDataFrame([r for rows in batches for r in rows], schema), ["key"], "at")
    assert got == [tuple(r) for r in want.select("key", "at", "sent").orderBy(*order).collect()]


def test_feeds_never_fetched_do_not_alert(spark):
    known = spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 0), 10), ("b", None, 10), ("c", dt.datetime(2026, 1, 1, 0), 60)], "feed string, fetched_at timestamp, interval_minutes int")
    assert [r["feed"] for r in feeds.stale_alerts(known, F.lit("2026-01-01 00:20:00").cast("timestamp")).collect()] == ["a"]


def test_alerts_and_freshness(spark):
    rows = [("k", dt.datetime(2026, 1, 1, 0)), ("k", dt.datetime(2026, 1, 1, 20)), ("k", dt.datetime(2026, 1, 2, 19)), ("k", dt.datetime(2026, 1, 4))]
    got = feeds.alert_dedup(spark.createDataFrame(rows, "key string, at timestamp"), ["key"], "at").orderBy("at").collect()
    assert [r["sent"] for r in got] == [True, False, False, True]
    known = spark.createDataFrame([("a", dt.datetime(2026, 1, 1, 0), 10), ("b", None, 10), ("c", dt.datetime(2026, 1, 1, 0), 60)], "feed string, fetched_at timestamp, interval_minutes int")
    fresh = feeds.freshness(known, F.lit("2026-01-01 00:20:00").cast("timestamp"))
    assert {r["feed"]: r["stale"] for r in fresh.collect()} == {"a": True, "b": True, "c": False}
