import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import folds
from millrace.streaming import stateful

SF = "/root/testdata/sf0.001"


def events(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    for i in range(2):  # two files, so that state outlives a batch
        e.where(F.col("event_id") % 1000 < 500 if i == 0 else F.col("event_id") % 1000 >= 500).coalesce(1).write.mode("append").parquet(path)
    return e, path


def test_once_only_and_windows(spark, tmp_path):
    e, path = events(spark, tmp_path)
    stream = stateful.read_events(spark, path, files_per_trigger=10)
    stateful.run_available(stateful.once_only(stream.union(stateful.read_events(spark, path, files_per_trigger=10)), "event_id", "ts", "400 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == e.count()
    stateful.run_available(stateful.window_counts(stream, ["event_type"], "ts", "1 day", "1 hour"), str(tmp_path / "w"), str(tmp_path / "cw"))
    got = {(r.event_type, r.start): r.n for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    twin = {(r.event_type, r.start): r.n for r in e.groupBy("event_type", F.window("ts", "1 day")).agg(F.count("*").alias("n")).select("event_type", "window.start", "n").collect()}
    last = max(s for _, s in twin)
    assert got and all(twin[k] == n for k, n in got.items()) and {k for k in twin if k[1] < last} <= set(got)


def test_watcher_state_equals_its_batch_twin(spark, tmp_path):
    e, path = events(spark, tmp_path)
    shape = lambda d: d.select(F.col("user_id").alias("watcher_id"), F.col("event_id").alias("check_id"), "ts", (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "view", F.floor("value").cast("string")).alias("content_hash"))
    stateful.run_available(stateful.processed(shape(stateful.read_events(spark, path)), "watcher_id", stateful.Watcher()), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.check_id: (r.changed, r.failures, r.paused) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    state, twin = {}, {}
    for r in sorted(shape(e).collect(), key=lambda r: (r.check_id % 1000 >= 500, r.ts, r.check_id)):
        s = state.setdefault(r.watcher_id, {"hash": None, "failures": 0, "paused": False})
        _, *twin[r.check_id] = stateful.Watcher().step(s, r)
    assert got == {k: tuple(v) for k, v in twin.items()}


def test_watcher_does_not_compare_what_is_blocked_or_poor():
    from types import SimpleNamespace as Row

    w = stateful.Watcher()
    s = w.start()
    told = [w.step(s, Row(check_id=i, ok=True, content_hash=h, render_quality=q, is_blocked=b)) for i, (h, q, b) in enumerate([("a", 1.0, False), ("b", 0.39, False), ("b", 1.0, True), ("a", 0.4, False), ("c", None, False)])]
    assert [t[1] for t in told] == [False, False, False, False, True] and s["hash"] == "c"


def test_limiter_and_breaker_streams(spark, tmp_path):
    e, _ = events(spark, tmp_path)
    one = str(tmp_path / "one")
    e.coalesce(1).write.parquet(one)
    requests = lambda d: d.select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts")
    stateful.run_available(stateful.processed(requests(stateful.read_events(spark, one)), "key", stateful.Limiter({3600: 1, 86400: 4})), str(tmp_path / "o"), str(tmp_path / "c"))
    got = {r.request_id: r.allowed for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    twin = {r.request_id: r.allowed for r in folds.rate_limit(requests(e), "key", "ts", {3600: 1, 86400: 4}).collect()}
    assert got == twin
    calls = lambda d: d.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") != "error").alias("ok"))
    stateful.run_available(stateful.processed(calls(stateful.read_events(spark, one)), "key", stateful.Calls()), str(tmp_path / "o2"), str(tmp_path / "c2"))
    got = {r.call_id: r.admitted for r in spark.read.parquet(str(tmp_path / "o2")).collect()}
    assert got == {r.call_id: r.admitted for r in folds.circuit_breaker(calls(e), "key", "ts", "ok").collect()}


def test_due_watchers(spark):
    now = dt.datetime(2024, 1, 2)
    rows = spark.createDataFrame([(1, "active", now - dt.timedelta(hours=2), 5), (2, "active", now + dt.timedelta(hours=1), 5), (3, "paused", now, 5), (4, "active", now - dt.timedelta(hours=3), 600)], "watcher_id long, status string, next_check_at timestamp, frequency_minutes int")
    got = stateful.due(rows, now, 100).collect()
    assert [r.watcher_id for r in got] == [4, 1] and got[1].next_check_at == now + dt.timedelta(hours=1)
