"""Queries over orders, customers and events: joins, windows, ledgers, status, caches and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import geometry
from millrace.operators import extract, folds, jobs, joins, ledger, status, windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def status_rollup(spark, sf_dir):
    items = _events(spark, sf_dir).withColumn("key", F.when(F.col("event_type") == "view", F.concat(F.lit("k"), F.col("user_id"), F.lit(".zip"))))
    return status.rollup(items, "user_id", "event_type", ["click"], ["view", "purchase"], "key")


def batch_verdict(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("good"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") == "click").alias("pending"), F.count(F.lit(1)).alias("total"))
    return e.select("user_id", status.final_verdict(F.col("good"), F.col("failed")).alias("final"), status.view_verdict(F.col("total"), F.col("pending"), F.col("good"), F.col("failed"), F.col("user_id") % 7 == 0).alias("shown"))


def failure_classes(spark, sf_dir):
    msgs = F.array(*[F.lit(m) for m in ("Timeout 30000ms exceeded", "net::ERR_NAME_NOT_RESOLVED", "blank page", "getaddrinfo failed")])
    f = status.failure(F.element_at(msgs, (F.col("event_id") % 4 + 1).cast("int")))
    return _events(spark, sf_dir).select(f["code"].cast("long").alias("code"), f["kind"].alias("kind")).groupBy("code", "kind").agg(F.count(F.lit(1)).alias("n"))


def suppression_list(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in ("hard_bounce", "Spam", "complaint", "opened", "delivered")])
    e = _events(spark, sf_dir).select(F.concat(F.lit("User"), F.col("user_id"), F.lit("@Example.com")).alias("email"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("event"), "ts")
    return status.suppressions(e, "email", "event", "ts")


def mode_first_tie(spark, sf_dir):
    return windows.mode_first(_events(spark, sf_dir), ["user_id"], "event_type", F.struct("ts", "event_id"))


def interval_period_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    periods = e.select("user_id", F.date_trunc("month", "ts").alias("start")).distinct().withColumn("end", F.col("start") + F.expr("interval 1 month"))
    return joins.in_period(e.select("event_id", "user_id", "ts"), periods, "user_id", "ts", "start", "end").select("event_id", "user_id", "start", "end")


def interval_bucket_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    shifts = spark.range(0, 60).select(F.col("id").alias("shift"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.col("id").cast("int"), hours=F.lit(8))).alias("start")).withColumn("end", F.col("start") + F.expr("interval 10 hours"))
    return joins.in_period_bucketed(e.select("event_id", "ts"), shifts, "ts", "start", "end", 86400).select("event_id", "shift")


def tolerance_join(spark, sf_dir):
    e = _events(spark, sf_dir)
    markers = e.where("event_type = 'purchase'").select("user_id", F.date_trunc("second", "ts").alias("marked"), F.col("event_id").alias("marker"))
    starts = e.select("user_id", F.col("ts").alias("start"), "event_id")
    return joins.within_second(markers, starts, "user_id", "marked", "start").select("marker", "event_id")


def asof_previous(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("start"), "o_totalprice")
    periods = o.groupBy("o_custkey", "start").agg(F.min("o_orderkey").alias("o_orderkey"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("price")).withColumn("end", F.col("start") + F.expr("interval 30 days"))
    return windows.previous_closed(periods, "o_custkey", "start", "end", (F.lit(200000) - F.col("price")).cast("decimal(20,2)")).select("o_custkey", "o_orderkey", "rollover")


def baseline_change(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("hash", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 10).cast("string")))
    return windows.baseline_change(e, "user_id", ["ts", "event_id"], "hash").select("event_id", "baseline", "changed")


def failure_streak_pause(spark, sf_dir):
    return windows.streaks(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "failures", "paused")


def first_use_stamp(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("first_used_at"), F.max("ts").alias("last_used_at"), F.min_by("event_type", F.struct("ts", "event_id")).alias("surface"))


def distinct_on_topk(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_of_best(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


def latest_per_key(spark, sf_dir):
    return windows.best_per_key(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


def first_n_per_key(spark, sf_dir):
    return windows.first_n(_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], 3)


def lateral_top1(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer").select("c_custkey", "c_name"), _table(spark, sf_dir, "orders")
    return joins.with_first(c, o, "c_custkey", "o_custkey", [F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


def lateral_agg(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer").select("c_custkey"), _table(spark, sf_dir, "orders")
    return joins.with_aggregate(c, o, "c_custkey", "o_custkey", first_order=F.min("o_orderdate"), failed=F.count_if(F.col("o_orderstatus") == "F"))


def exists_recent(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return joins.exists(c, o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment")


def not_exists_orders(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return joins.not_exists(c, o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_mktsegment")


def subscription_joins(spark, sf_dir):
    """Supplier with its nation and region (inner), and the optional part it sells dearest (left): dimensions are read, then joined."""
    s, n, r = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    li = _table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("discounted"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).join(li, s.s_suppkey == li.l_suppkey, "left").select("s_suppkey", "n_name", "r_name", F.coalesce("discounted", F.lit(0)).alias("discounted"))


def cast_join(spark, sf_dir):
    text_keys = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"), "o_orderkey")
    c = _table(spark, sf_dir, "customer")
    return text_keys.join(c, F.expr("try_cast(k as bigint)") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


def known_or_default(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("zone"), F.col("c_nationkey")).alias("zone"))
    known = _table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.concat(F.lit("zone"), F.col("n_nationkey")).alias("name"))
    return joins.known_or(c, known, "zone", "name", "UTC")


def upsert_owned(spark, sf_dir):
    t = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").alias("owner"), F.lit("old").alias("state"))
    rows = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("owner"), F.lit("new").alias("state"))
    return joins.upserted(t, rows, "c_custkey", "owner")[0]


def oldest_until_freed(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("long").alias("size"))
    return windows.until_freed(o, ["o_orderdate", "o_orderkey"], "size", 300_000, ["o_custkey"]).select("o_orderkey", "freed_before")


def idempotent_ledger(spark, sf_dir):
    e = _events(spark, sf_dir)
    twice = e.unionByName(e.where("event_id % 3 = 0")).select(F.concat(F.lit("op:"), F.col("event_id")).alias("key"), "user_id", F.date_trunc("month", "ts").alias("period"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("delta"), "event_type")
    r = ledger.rollup(twice, "key", ["user_id", "period"], "delta", "event_type", F.lit(40))
    return r.select("user_id", "period", "total", "entries", "overage", F.coalesce(F.col("by_endpoint")["click"], F.lit(0)).alias("clicks"))


def quota_gates(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").withColumn("over", F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 3 * 100)).withColumn("eff", F.col("c_custkey") % 2 * 200)
    cap = ledger.effective_cap("over", "eff", "c_nationkey")
    used = F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey") % 500)
    return c.select("c_custkey", cap.cast("long").alias("cap"), ledger.quota_gate(cap, F.lit(50), used, F.lit(1), F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 5 == 0).alias("gate"))


def credit_rollover(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,4)")).alias("spent"))
    return ledger.credit_rollover(o, "o_custkey", "month", "spent", F.lit("150000").cast("decimal(18,4)")).select("o_custkey", "month", "granted")


def month_walk(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("start"))
    return o.select("o_custkey", F.posexplode(ledger.month_walk(F.col("start"), 12)).alias("n", "boundary")).select("o_custkey", F.col("n").cast("long").alias("n"), "boundary")


def overage_amounts(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", ledger.overage_amount(F.col("c_custkey") % 100, F.lit("0.1250").cast("decimal(12,4)")).cast("double").alias("amount"))


def high_water(spark, sf_dir):
    return ledger.high_water(_events(spark, sf_dir).withColumn("units", (F.col("value") * 100).cast("long")), "user_id", ["ts", "event_id"], "units").select("event_id", "peak", "running")


def fixed_window_rate(spark, sf_dir):
    return windows.window_counts(_events(spark, sf_dir), ["user_id"], "ts", 3600)


def rate_limit_fold(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return folds.rate_limit(e, "user_id", "ts", {3600: 1, 86400: 4}).select("event_id", "allowed")


def throttle_24h(spark, sf_dir):
    return folds.throttle(_events(spark, sf_dir).select("event_id", "user_id", "ts"), "user_id", "ts", 86400).select("event_id", "passes")


def money_ledger(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        "user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, "reserve").otherwise("settle").alias("kind"), (F.col("value") * 100).cast("long").alias("cents"),
        F.floor(F.col("event_id") / 4).cast("string").alias("operation_id"), F.lit(20000).alias("granted"),
    )
    return folds.money_ledger(e, project="user_id").select("pos", "accepted", "spent")


def breaker_states(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ok", F.col("event_type") != "error").select("event_id", "user_id", "ts", "ok")
    return folds.circuit_breaker(e, "user_id", "ts", "ok", failures=2, seconds=86400, successes=2).select("event_id", "admitted", "breaker")


def cache_hit_asof(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return windows.cached_hits(e, ["user_id", "event_type"], "ts", "event_id", 86400).select("event_id", "is_hit")


def cooldown_offers(spark, sf_dir):
    e = _events(spark, sf_dir)
    offers = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return windows.cooled_down(offers, e.where("event_type = 'error'").select("user_id", "ts"), "user_id", "ts", 5, 4).select("event_id")


def due_topk(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= F.lit("1997-01-01").cast("timestamp_ntz")))
    return o.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


def page_has_more(spark, sf_dir):
    """Newest first, rows 21-40 and whether there are more: one row over the page is read."""
    page = _table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(20).limit(21).select("o_orderkey", "o_orderdate")
    place = F.row_number().over(Window.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))  # over 21 rows
    return page.select("o_orderkey", place.alias("place"), (F.count(F.lit(1)).over(Window.partitionBy()) > 20).alias("has_more")).where("place <= 20").drop("place")


def weekly_activity(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.date_trunc("week", "ts").alias("week")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(F.col("event_type") == "error").alias("errors"))


def send_window(spark, sf_dir):
    local = F.from_utc_timestamp("ts", "America/New_York")
    open_ = F.extract(F.lit("dayofweek_iso"), local).between(1, 5) & F.hour(local).between(9, 16)
    return _events(spark, sf_dir).select("event_id", open_.alias("open"))


def props_json(spark, sf_dir):
    f = extract.json_fields("props", {"k": "bigint", "missing": "string"})
    return _events(spark, sf_dir).select("event_id", f["k"].alias("k"), f["missing"].alias("missing"))


def search_results(spark, sf_dir):
    p = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("query"), F.concat(F.lit('{"organic":[{"title":"t'), F.col("event_id"), F.lit('","link":"https://x/'), F.col("user_id"), F.lit('","position":1,"sitelinks":"s"}]}')).alias("payload"))
    return extract.search_results(p, "query", "payload", "search").select("query", "title", "url", "position", F.col("extra")["sitelinks"].alias("sitelinks"))


def heading_stack(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 4).cast("int").alias("level"), F.concat(F.lit("h"), F.col("event_id")).alias("text"))
    return windows.heading_paths(e, "user_id", "event_id", "level", "text").select("user_id", "event_id", F.array_join("path", ">").alias("path"))


def period_rotation(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.max("o_orderdate").cast("timestamp").alias("current_period_end"))
    subs = o.withColumn("status", F.when(F.col("project_id") % 7 == 0, "canceled").otherwise("active")).withColumn("plan_id", F.lit(1)).withColumn("pending_plan_id", F.when(F.col("project_id") % 3 == 0, 2))
    return jobs.rotation(subs, F.lit("1999-01-01").cast("timestamp"), 60).withColumn("n", F.col("n").cast("long"))


def retention_queue(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_key"), F.col("o_orderdate").cast("timestamp").alias("delete_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp")).alias("deleted_at"))
    return jobs.retention_due(d, F.lit("1997-06-01").cast("timestamp"), 2000).select("object_key", "delete_at")


def policy_hosts(spark, sf_dir):
    v = jobs.policy_verdict(F.col("url"), ["example.org"], ["net"], [r"^m\."])
    return _table(spark, sf_dir, "pages").select("page_id", v["rule"].alias("rule"), v["detail"].alias("detail"))


def page_dimensions(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("a4", "Letter", "LEDGER", "none")])
    p = _table(spark, sf_dir, "part").withColumn("paper", F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")))
    custom = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size"))
    d = geometry.page_dimensions(F.col("paper"), custom, F.lit(25), F.when(F.col("p_partkey") % 2 == 0, "landscape").otherwise("portrait"))
    return p.select("p_partkey", d["width"].alias("width"), d["height"].alias("height"))


def ingest_pages(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).cast("long").alias("job_id"), F.col("doc_id").alias("pos"), F.concat(F.lit("u"), F.col("doc_id")).alias("final_url"), F.sha2("text", 256).alias("content_hash"), F.lit(1).alias("n_chunks"), F.col("text").alias("markdown"))
    return jobs.ingest(d).select("job_id", "pos", "status", "note", "billed_key", "chunk_count")


def activity_billing(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("state", F.when(F.col("event_type") == "purchase", "Success").otherwise(F.col("event_type")))
    return status.first_success(e, "user_id", "state", "ts")


SQL = {
    "status_rollup": """with r as (select user_id, count(*) total, count(*) filter (event_type = 'click') running, count(*) filter (event_type in ('view', 'purchase')) good, count(distinct case when event_type = 'view' then 1 end) = 1 zip_mode from events group by 1)
        select *, total - running - good as failed, case when running > 0 then 'processing' when good = total then 'completed' when good = 0 then 'failed' else 'partial' end as status from r""",
    "batch_verdict": """with e as (select user_id, count(*) filter (event_type = 'view') g, count(*) filter (event_type = 'error') f, count(*) filter (event_type = 'click') p, count(*) t from events group by 1)
        select user_id, case when f > 0 and g = 0 then 'failed' when f > 0 then 'partial' else 'completed' end as final,
        case when user_id % 7 = 0 then 'canceled' when p = t then 'queued' when p > 0 then 'processing' when f > 0 and g = 0 then 'failed' when f > 0 then 'partial' else 'completed' end as shown from e""",
    "failure_classes": "select case event_id % 4 when 0 then 504 else 502 end::bigint as code, case event_id % 4 when 0 then 'timeout' when 2 then 'empty_render' else 'unreachable' end as kind, count(*) as n from events group by 1, 2",
    "suppression_list": """with e as (select 'user' || user_id || '@example.com' email, case event_id % 5 when 0 then 'hard_bounce' when 1 then 'spam' when 2 then 'spam' end r, ts from events)
        select email, min(ts) as since, arg_min(r, ts) as reason, min(ts) filter (r = 'spam') as opted_out from e where r is not null group by 1""",
    "mode_first_tie": """with c as (select user_id, event_type, count(*) n, min({'t': ts, 'e': event_id}) f from events group by 1, 2)
        select user_id, event_type as mode, n from c qualify row_number() over (partition by user_id order by n desc, f) = 1""",
    "interval_period_join": """with p as (select distinct user_id, date_trunc('month', ts) "start" from events)
        select event_id, e.user_id, p."start", p."start" + interval 1 month as "end" from events e join p on e.user_id = p.user_id and ts >= p."start" and ts < p."start" + interval 1 month""",
    "interval_bucket_join": """with s as (select i as shift, timestamp '2024-01-01 08:00:00' + i * interval 1 day a from range(0, 60) t(i))
        select event_id, shift from events join s on ts >= a and ts < a + interval 10 hours""",
    "tolerance_join": """with m as (select user_id, date_trunc('second', ts) marked, event_id marker from events where event_type = 'purchase')
        select marker, e.event_id from m left join events e on e.user_id = m.user_id and e.ts >= marked and e.ts < marked + interval 1 second""",
    "asof_previous": """with p as (select o_custkey, o_orderdate s, min(o_orderkey) o_orderkey, sum(o_totalprice::decimal(18,2)) price from orders group by 1, 2)
        select o_custkey, o_orderkey, case when lag(s) over w + interval 30 days <= s then greatest(200000 - lag(price) over w, 0) else 0 end as rollover from p window w as (partition by o_custkey order by s)""",
    "baseline_change": """with h as (select event_id, user_id, ts, case when event_type <> 'error' then floor(value / 10)::bigint::varchar end h from events),
        b as (select *, last_value(h ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) b from h)
        select event_id, b as baseline, coalesce(h <> b, false) as changed from b""",
    "failure_streak_pause": """with i as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) g from events),
        s as (select event_id, user_id, ts, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint f from i),
        p as (select *, min(case when f >= 3 then {'t': ts, 'e': event_id} end) over (partition by user_id) began from s)
        select event_id, case when {'t': ts, 'e': event_id} > began then 3 else f end as failures, coalesce({'t': ts, 'e': event_id} >= began, false) as paused from p""",
    "first_use_stamp": "select user_id, min(ts) as first_used_at, max(ts) as last_used_at, arg_min(event_type, {'t': ts, 'e': event_id}) as surface from events group by 1",
    "distinct_on_topk": "with b as (select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1) select * from b order by o_totalprice desc, o_orderkey limit 25",
    "latest_per_key": "select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "first_n_per_key": "select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) <= 3",
    "lateral_top1": "select c_custkey, c_name, o.o_orderkey, o.o_orderstatus from customer left join lateral (select o_orderkey, o_orderstatus from orders where o_custkey = c_custkey order by o_orderkey limit 1) o on true",
    "lateral_agg": "select c_custkey, min(o_orderdate) as first_order, case when count(o_orderkey) > 0 then count(*) filter (o_orderstatus = 'F') end as failed from customer left join orders on o_custkey = c_custkey group by 1",
    "exists_recent": "select c_custkey, c_mktsegment from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')",
    "not_exists_orders": "select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
    "subscription_joins": """select s_suppkey, n_name, r_name, coalesce(d.n, 0) as discounted from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        left join (select l_suppkey, count(*) n from lineitem where l_discount > 0.08 group by 1) d on l_suppkey = s_suppkey""",
    "cast_join": "select c_mktsegment, count(*) as orders from orders join customer on c_custkey = o_custkey group by 1",
    "known_or_default": "select c_custkey, case when n_nationkey is null then 'UTC' else 'zone' || c_nationkey end as zone from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3",
    "upsert_owned": """with t as (select c_custkey k, c_nationkey o from customer where c_custkey % 2 = 0), r as (select c_custkey k, case when c_custkey % 5 = 0 then -1 else c_nationkey end o from customer where c_custkey % 3 = 0),
        g as (select r.* from r left join t using (k) where t.k is null or t.o = r.o)
        select k as c_custkey, o as owner, 'new' as state from g union all select k, o, 'old' from t where k not in (select k from g)""",
    "oldest_until_freed": """with z as (select o_custkey, o_orderkey, o_orderdate, trunc(o_totalprice)::bigint size from orders), f as (select *, coalesce(sum(size) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint freed_before from z where size > 0)
        select o_orderkey, freed_before from f where freed_before < 300000""",
    "idempotent_ledger": """with e as (select user_id, date_trunc('month', ts) period, case when event_type = 'error' then 0 else 1 end d, event_type from events)
        select user_id, period, sum(d)::bigint as total, count(*) as entries, greatest(sum(d) - 40, 0)::bigint as overage, coalesce(sum(d) filter (event_type = 'click'), 0)::bigint as clicks from e group by 1, 2""",
    "quota_gates": """with c as (select c_custkey, coalesce(case when c_custkey % 4 = 0 then c_custkey % 3 * 100 end, nullif(c_custkey % 2 * 200, 0), c_nationkey)::bigint cap, case when c_custkey % 11 > 0 then c_custkey % 500 end u from customer)
        select c_custkey, cap, case when cap = 0 then 'ok' when u is null then 'denied' when u + 1 <= cap + 50 then 'ok' when c_custkey % 10 = 0 then 'overage' else 'denied' end as gate from c""",
    "credit_rollover": """with recursive m as (select o_custkey, date_trunc('month', o_orderdate)::timestamp as month, sum(o_totalprice::decimal(18,4))::decimal(18,4) spent from orders group by 1, 2), n as (select *, row_number() over (partition by o_custkey order by month) i from m),
        r as (select o_custkey, month, spent, i, 150000::decimal(18,4) granted from n where i = 1 union all
          select n.o_custkey, n.month, n.spent, n.i, (150000 + greatest(r.granted - r.spent, 0))::decimal(18,4) from r join n on n.o_custkey = r.o_custkey and n.i = r.i + 1)
        select o_custkey, month, granted from r""",
    "month_walk": """with recursive s as (select o_custkey, min(o_orderdate)::date d, 0::bigint n from orders group by 1), w as (select * from s union all select o_custkey, (d + interval 1 month)::date, n + 1 from w where n < 12)
        select o_custkey, n, d as boundary from w""",
    "overage_amounts": "with a as (select c_custkey, round((c_custkey % 100)::decimal(18,4) * 0.1250::decimal(12,4) / 100, 2) a from customer) select c_custkey, case when a >= 0.01 then a end::double as amount from a",
    "high_water": """with e as (select event_id, user_id, ts, trunc(value * 100)::bigint u from events)
        select event_id, max(u) over w as peak, (sum(u) over w)::bigint as running from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "fixed_window_rate": "select user_id, (floor(floor(epoch(ts)) / 3600) * 3600)::bigint as window_start, count(*) as n from events group by 1, 2",
    "cooldown_offers": """select o.event_id from events o left join events h on h.user_id = o.user_id and h.event_type = 'error' and h.ts < o.ts where o.event_type = 'purchase' group by o.event_id, o.ts
        having count(h.ts) < 4 and (max(h.ts) is null or max(h.ts) <= o.ts - interval 5 days)""",
    "due_topk": "select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1997-01-01' order by o_orderdate, o_orderkey limit 50",
    "page_has_more": "select o_orderkey, true as has_more from (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 20)",
    "weekly_activity": "select date_trunc('week', ts)::timestamp as week, count(*) as events, count(distinct ts::date) as days, count(*) filter (event_type = 'error') as errors from events group by 1",
    "props_json": "select event_id, json_extract(props, '$.k')::bigint as k, json_extract_string(props, '$.missing') as missing from events",
    "search_results": "select event_id::varchar as query, 't' || event_id as title, 'https://x/' || user_id as url, 1 as position, 's' as sitelinks from events",
    "heading_stack": """with e as (select user_id, event_id, (event_id % 4)::int l, 'h' || event_id t from events),
        p as (select *, last_value(case when l = 1 then event_id end ignore nulls) over w p1, last_value(case when l = 2 then event_id end ignore nulls) over w p2, last_value(case when l = 3 then event_id end ignore nulls) over w p3 from e
          window w as (partition by user_id order by event_id rows unbounded preceding))
        select user_id, event_id, array_to_string(list_filter(['h' || p1, case when p1 is null or p2 > p1 then 'h' || p2 end, case when p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) then 'h' || p3 end], lambda x: x is not null), '>') as path from p""",
    "throttle_24h": """with recursive e as (select event_id, user_id, epoch(ts) t, row_number() over (partition by user_id order by ts) n from events),
        r as (select event_id, user_id, n, true passes, t last from e where n = 1 union all
          select e.event_id, e.user_id, e.n, e.t - r.last >= 86400, case when e.t - r.last >= 86400 then e.t else r.last end from r join e on e.user_id = r.user_id and e.n = r.n + 1)
        select event_id, passes from r""",
    "cache_hit_asof": """with recursive e as (select event_id, user_id, event_type, epoch(ts) t, row_number() over (partition by user_id, event_type order by ts, event_id) n from events),
        r as (select event_id, user_id, event_type, n, false is_hit, t made from e where n = 1 union all
          select e.event_id, e.user_id, e.event_type, e.n, e.t - r.made <= 86400, case when e.t - r.made <= 86400 then r.made else e.t end from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.n = r.n + 1)
        select event_id, is_hit from r""",
    "rate_limit_fold": """with recursive e as (select event_id, user_id, floor(epoch(ts) / 3600)::bigint h, floor(epoch(ts) / 86400)::bigint d, row_number() over (partition by user_id order by ts) n from events),
        r as (select event_id, user_id, n, true allowed, h, 1 ch, d, 1 cd from e where n = 1 union all
          select event_id, user_id, n, ok, case when ok then eh else h end, case when ok then case when eh = h then ch else 0 end + 1 else ch end, case when ok then ed else d end, case when ok then case when ed = d then cd else 0 end + 1 else cd end
          from (select e.event_id, e.user_id, e.n, e.h eh, e.d ed, r.h, r.ch, r.d, r.cd, (e.h <> r.h or r.ch < 1) and (e.d <> r.d or r.cd < 4) ok from r join e on e.user_id = r.user_id and e.n = r.n + 1))
        select event_id, allowed from r""",
    "breaker_states": """with recursive e as (select event_id, user_id, epoch(ts) t, event_type <> 'error' ok, row_number() over (partition by user_id order by ts) n from events),
        r as (select null::bigint event_id, user_id, 0::bigint n, null::boolean admitted, 'closed' s, 0 c, 0.0::double since from (select distinct user_id from events) union all
          select event_id, user_id, n, s1 <> 'open', case when s1 = 'open' then 'open' when s1 = 'half_open' then case when not ok then 'open' when c1 + 1 >= 2 then 'closed' else 'half_open' end when ok then 'closed' when c1 + 1 >= 2 then 'open' else 'closed' end,
            case when s1 = 'open' then c1 when s1 = 'half_open' then case when not ok then c1 when c1 + 1 >= 2 then 0 else c1 + 1 end when ok then 0 else c1 + 1 end,
            case when (s1 = 'half_open' and not ok) or (s1 = 'closed' and not ok and c1 + 1 >= 2) then t else since end
          from (select e.event_id, e.user_id, e.n, e.t, e.ok, r.since, case when r.s = 'open' and e.t - r.since >= 86400 then 'half_open' else r.s end s1, case when r.s = 'open' and e.t - r.since >= 86400 then 0 else r.c end c1 from r join e on e.user_id = r.user_id and e.n = r.n + 1))
        select event_id, admitted, s as breaker from r where n > 0""",
    "period_rotation": """with recursive s as (select o_custkey project_id, max(o_orderdate)::timestamp e, case when o_custkey % 3 = 0 then 2 else 1 end::int plan_id from orders where o_custkey % 7 <> 0 group by 1),
        w as (select project_id, plan_id, 0::bigint n, e period_start, e + interval 1 month period_end from s where e <= timestamp '1999-01-01' union all
          select project_id, plan_id, n + 1, period_end, period_end + interval 1 month from w where period_end <= timestamp '1999-01-01' and n < 59)
        select project_id, n, period_start, period_end, plan_id from w""",
    "retention_queue": "select o_orderkey as object_key, o_orderdate::timestamp as delete_at from orders where o_orderstatus <> 'F' and o_orderdate <= timestamp '1997-06-01' order by o_orderdate, o_orderkey limit 2000",
    "policy_hosts": """with h as (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) h from pages)
        select page_id, case when h = 'example.org' or ends_with(h, '.example.org') then 'domain' when ends_with(h, '.net') then 'tld' when starts_with(h, 'm.') then 'pattern' end as rule,
          case when h = 'example.org' or ends_with(h, '.example.org') then 'example.org' when ends_with(h, '.net') then 'net' when starts_with(h, 'm.') then '^m\\.' end as detail from h""",
    "page_dimensions": """with d as (select p_partkey, case when p_partkey % 5 = 0 then p_size else case p_partkey % 4 when 0 then 210 when 1 then 216 when 2 then 432 end end::double w,
          case when p_partkey % 5 = 0 then 25 else case p_partkey % 4 when 0 then 297 when 1 then 279 when 2 then 279 end end::double h from part)
        select p_partkey, case when w is null then null when p_partkey % 2 = 0 then greatest(w, h) else least(w, h) end as width, case when w is null then null when p_partkey % 2 = 0 then least(w, h) else greatest(w, h) end as height from d""",
    "ingest_pages": """with d as (select floor(doc_id / 50)::bigint job_id, doc_id pos, 'u' || doc_id u, text, row_number() over (partition by floor(doc_id / 50), text order by doc_id) r from documents)
        select job_id, pos, case when trim(text) = '' then 'skipped' else 'completed' end as status, case when trim(text) = '' then 'no extractable content' when r > 1 then 'DUPLICATE' end as note,
          case when trim(text) <> '' and r = 1 then 'ingest:' || job_id || ':' || substr(md5(u), 1, 16) end as billed_key, case when trim(text) <> '' and r = 1 then 1 else 0 end as chunk_count from d""",
    "activity_billing": """select user_id, min(ts) filter (event_type = 'purchase') as billed_at, arg_max(case when event_type = 'purchase' then 'Success' else event_type end, ts) as last_state,
        case when arg_max(event_type, ts) <> 'purchase' then arg_max(event_type, ts) end as error from events group by 1""",
    "send_window": """with d as (select *, make_date(year(ts)::bigint, 3, 1) m, make_date(year(ts)::bigint, 11, 1) n from events),
        s as (select *, m + (7 - dayofweek(m)::int) % 7 + 7 + interval 7 hour spring, n + (7 - dayofweek(n)::int) % 7 + interval 6 hour autumn from d),
        l as (select event_id, ts - case when ts >= spring and ts < autumn then interval 4 hour else interval 5 hour end t from s)
        select event_id, isodow(t) between 1 and 5 and hour(t) between 9 and 16 as open from l""",
    "money_ledger": """with recursive e as (select user_id, event_id pos, event_id % 2 = 0 as takes, trunc(value * 100)::bigint c, (event_id // 4)::varchar op, row_number() over (partition by user_id order by event_id) n from events),
        r as (select user_id, 0::bigint n, null::bigint pos, null::boolean ok, 0::bigint spent, []::varchar[] held, []::bigint[] amounts, []::varchar[] done from (select distinct user_id from events) union all
          select user_id, n, pos, ok, case when not ok then spent when takes then spent + c else spent + c - amounts[i] end, case when not ok then held when takes then list_append(held, op) else list_concat(held[1:i - 1], held[i + 1:]) end,
            case when not ok then amounts when takes then list_append(amounts, c) else list_concat(amounts[1:i - 1], amounts[i + 1:]) end, case when ok and not takes then list_append(done, op) else done end
          from (select e.*, r.spent, held, amounts, done, list_position(held, op) i, case when takes then not list_contains(held, op) and not list_contains(done, op) and r.spent + c <= 20000 else list_contains(held, op) end ok
            from r join e on e.user_id = r.user_id and e.n = r.n + 1))
        select pos, ok as accepted, spent from r where n > 0""",
}

QUERIES = {f.__name__: f for f in (
    status_rollup, batch_verdict, failure_classes, suppression_list, mode_first_tie, interval_period_join, interval_bucket_join, tolerance_join, asof_previous, baseline_change,
    failure_streak_pause, first_use_stamp, distinct_on_topk, latest_per_key, first_n_per_key, lateral_top1, lateral_agg, exists_recent, not_exists_orders, subscription_joins, cast_join,
    known_or_default, upsert_owned, oldest_until_freed, idempotent_ledger, quota_gates, credit_rollover, month_walk, overage_amounts, high_water, fixed_window_rate, rate_limit_fold, throttle_24h,
    money_ledger, breaker_states, cache_hit_asof, cooldown_offers, due_topk, page_has_more, weekly_activity, send_window, props_json, search_results, heading_stack, period_rotation, retention_queue, policy_hosts, page_dimensions, ingest_pages, activity_billing,
)}
