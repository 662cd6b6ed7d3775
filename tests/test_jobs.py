import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import geometry, tokens
from millrace.operators import jobs


def day(m, d):
    return dt.datetime(2024, m, d)


def test_ingest(spark):
    rows = [(1, 1, "u1", "h1", 2, "x"), (1, 2, "u1", "h2", 3, "y"), (1, 3, "u3", None, 1, " "), (1, 4, "u4", "h4", 5, "z")]
    df = spark.createDataFrame(rows, "job_id long, pos long, final_url string, content_hash string, n_chunks int, markdown string")
    got = jobs.ingest(df).orderBy("pos").collect()
    assert [(r.status, r.note, r.chunk_count, r.billed_key is None) for r in got] == [("completed", None, 2, False), ("completed", "DUPLICATE", 0, True), ("skipped", "no extractable content", 0, True), ("completed", None, 5, False)]
    assert jobs.resumable(df, spark.createDataFrame([(1, 1, "completed"), (1, 2, "processing")], "job_id long, pos long, status string"), ["job_id", "pos"]).count() == 3
    assert [r.allowed for r in jobs.quota_stop(df.withColumn("room", F.lit(2)), "job_id", "pos", "room").orderBy("pos").collect()] == [True, True, False, False]


def test_rotation(spark):
    subs = spark.createDataFrame([(1, "active", 7, 9, day(1, 31)), (2, "active", 7, None, day(6, 1)), (3, "canceled", 7, None, day(1, 1))], "project_id long, status string, plan_id long, pending_plan_id long, current_period_end timestamp")
    got = jobs.rotation(subs, F.lit(day(4, 1))).orderBy("n").collect()
    assert [(r.project_id, r.period_start, r.period_end, r.plan_id) for r in got] == [(1, day(1, 31), day(2, 29), 9), (1, day(2, 29), day(3, 29), 9), (1, day(3, 29), day(4, 29), 9)]


def test_retention_and_claims(spark):
    d = spark.createDataFrame([("a", day(1, 2), None, 4), ("b", day(1, 1), None, None), ("c", day(3, 1), None, 0), ("d", day(1, 1), day(1, 1), 1)], "object_key string, delete_at timestamp, deleted_at timestamp, attempts int")
    due = jobs.retention_due(d, F.lit(day(2, 1)))
    assert [r.object_key for r in due.collect()] == ["b", "a"]
    out = {r.object_key: (r.deleted_at is not None, r.attempts) for r in jobs.retention_outcome(due, F.lit(False), F.lit(day(2, 1))).collect()}
    assert out == {"b": (False, 1), "a": (True, 5)}
    log = spark.createDataFrame([("k1",)], "email_key string")
    assert [r.email_key for r in jobs.claims(spark.createDataFrame([("k1",), ("k2",), ("k2",)], "email_key string"), log).collect()] == ["k2"]
    sends = spark.createDataFrame([(1, False, day(1, 2), 0), (2, False, dt.datetime(2024, 1, 2, 11, 50), 0), (3, True, day(1, 2), 0), (4, False, day(1, 2), 3), (5, False, dt.datetime(2023, 12, 30), 0)], "id long, sent_ok boolean, created_at timestamp, attempts int")
    assert [r.id for r in jobs.retryable(sends, F.lit(dt.datetime(2024, 1, 2, 12))).collect()] == [1]


def test_cached_operation_looks_at_the_fingerprint_after_the_limit(spark):
    ops = [(1, "u", "f" if i in (2, 24) else "g", dt.datetime(2024, 1, 1, 0, 0, i), f"op{i:02d}", "completed", False) for i in range(25)]
    o = spark.createDataFrame(ops, "project_id long, url string, fingerprint string, created_at timestamp, operation_id string, status string, cache_hit boolean")
    r = spark.createDataFrame([(1, 1, "u", "f", dt.datetime(2024, 1, 1, 0, 0, 30)), (2, 1, "u", "f", dt.datetime(2024, 1, 1, 0, 0, 23)), (3, 1, "u", "f", dt.datetime(2024, 1, 1, 2))], "request_id long, project_id long, url string, fingerprint string, at timestamp")
    assert [x.operation_id for x in jobs.cached_operation(o, r).orderBy("request_id").collect()] == ["op24", None, None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_cached_operation_makes_no_pairs(spark, kind):
    """Against brute force, over many terms, with ties of time, null fingerprints and URLs, failed operations and hits; no join, whose pairs would fill the disk."""
    rng, t0 = random.Random(5), dt.datetime(2024, 3, 31)
    at = lambda: t0 + dt.timedelta(seconds=rng.randrange(-40, 120), microseconds=rng.choice([0, 0, 500_000]))
    ops = [(rng.randrange(2), rng.choice(["u", "v", None]), rng.choice(["f", "g", "h", None]), at(), i, rng.choice(["completed"] * 4 + ["failed"]), rng.random() < 0.1) for i in range(400)]
    asked = [(i, rng.choice([0, 1, None]), rng.choice(["u", "v", None]), rng.choice(["f", "g", "h", None]), at()) for i in range(300)]
    o = spark.createDataFrame(ops, f"project_id long, url string, fingerprint string, created_at {kind}, operation_id long, status string, cache_hit boolean")
    r = spark.createDataFrame(asked, f"request_id long, project_id long, url string, fingerprint string, at {kind}")
    want = {}
    for i, p, u, f, t in asked:
        near = sorted((x for x in ops if x[5] == "completed" and not x[6] and None not in (p, u) and x[:2] == (p, u) and t - dt.timedelta(seconds=7) <= x[3] <= t), key=lambda x: (x[3], x[4]), reverse=True)[:3]
        want[i] = next((x[4] for x in near if f is not None and x[2] == f), None)
    got = jobs.cached_operation(o, r, seconds=7, most=3)
    assert got.columns == ["request_id", "project_id", "url", "fingerprint", "at", "operation_id"]
    assert {x.request_id: x.operation_id for x in got.collect()} == want and 20 < sum(x is not None for x in want.values()) < 280
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_policy(spark):
    df = spark.createDataFrame([("https://a.bad.com/x",), ("https://x.zip",), ("https://foo-phish.org",), ("https://ok.com",), ("nonsense",)], "u string")
    got = [r.v and tuple(r.v) for r in df.select(jobs.policy_verdict(F.col("u"), [".bad.com"], ["zip"], ["PHISH", "("]).alias("v")).collect()]
    assert got == [("domain", "bad.com"), ("tld", "zip"), ("pattern", "PHISH"), None, None]


@pytest.mark.parametrize("options", [
    {"auth": {"username": "u"}}, {"cookies": [{"name": "a", "value": "b"}]}, {"cookies": [{"name": "a", "value": "b", "url": "u"}] * 51}, {"headers": {"Host": "x"}}, {"headers": {"x": 1}},
    {"auth": {"username": "u", "password": "p"}, "headers": {"Authorization": "x"}}, {"wait_for_selector_timeout": True}, {"wait_for_selector_timeout": 60001}, {"wait_for_selector": "x" * 1001}, {"block_ads": "yes"},
])
def test_bad_requests(options):
    with pytest.raises(ValueError):
        jobs.check_request(options)


def test_good_request():
    assert jobs.check_request({"cookies": [{"name": "a", "value": "b", "domain": "d"}], "wait_for_selector_timeout": 1})["cookies"][0]["path"] == "/"


def test_costs(spark):
    df = spark.createDataFrame([("b", "completed", 0.06), ("b", "failed", None)], "batch string, status string, cost_cents double")
    r = jobs.cost_totals(df, ["batch"]).first()
    assert (r.completed, r.failed, float(r.cost_cents)) == (1, 1, 0.06)


def test_geometry(spark):
    df = spark.createDataFrame([("a4", None, None, "landscape"), ("Ledger", None, None, "portrait"), ("zz", 10.0, 20.0, "landscape"), ("zz", None, None, "portrait")], "s string, w double, h double, o string")
    got = [r.d and tuple(r.d) for r in df.select(geometry.page_dimensions(F.col("s"), F.col("w"), F.col("h"), F.col("o")).alias("d")).collect()]
    assert got == [(297.0, 210.0), (279.0, 432.0), (20.0, 10.0), None]
    svgs = ['<svg width="1in" height="48px">', "<svg viewBox='0 0 10,20'>", "<svg width='50%' height='1'>", '<svg width="100000" height="100000">']
    rows = spark.createDataFrame([(s,) for s in svgs], "s string").select(geometry.svg_size(F.col("s")).alias("z"), geometry.svg_render_size(geometry.svg_size(F.col("s"))).alias("r")).collect()
    assert [r.z and tuple(r.z) for r in rows] == [(96.0, 48.0), (10.0, 20.0), None, (100000.0, 100000.0)]
    assert [tuple(r.r) for r in rows] == [(None, None), (None, None), (2048, None), (6324, 6324)]
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (3).to_bytes(4, "big") + (2).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x07" + b"\0" * 9
    assert geometry.raster_size(png) == (3, 2) and geometry.raster_size(jpeg) == (7, 5) and geometry.raster_size(b"x") is None
    out = [r[0] for r in spark.createDataFrame([(bytearray(png),), (bytearray(b"x"),)], "b binary").select(geometry.wrapped_svg("b")).collect()]
    assert 'width="3"' in out[0] and out[1] is None
    assert geometry.unsupported_geometry({"scale": 1, "grayscale": True}, False) == ["scale"] and geometry.unsupported_geometry({"scale": 1}, True) == []
    rule = geometry.page_rule(210, 297, (1, 2, 3, 4), 2.0, header='<b>"{{page}}</b>')
    assert "size: 105.0mm 148.5mm; margin: 0.5mm 1.0mm 1.5mm 2.0mm;" in rule and '\\"" counter(page) "' in rule


def test_tokens():
    t = tokens.make_token(42, "s")
    assert tokens.read_token(t, "s") == 42 and tokens.read_token(t, "other") is None and tokens.read_token(t[:-3], "s") is None and tokens.read_token("é", "s") is None and tokens.read_token(None, "s") is None
    with pytest.raises(ValueError):
        tokens.make_token(1, " ")
