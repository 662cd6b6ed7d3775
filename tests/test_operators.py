import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import extract, folds, joins, layout, ledger, pages, status, url_list, windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_content_dedup_duplicates_register_nothing(spark):
    df = frame(spark, [(1, 1, "u1", "h1"), (1, 2, "u2", "h1"), (1, 3, "u2", "h3"), (2, 1, "u1", "h1"), (1, 4, None, None)], "job_id long, pos long, final_url string, content_hash string")
    got = {(r.job_id, r.pos): r.is_duplicate for r in folds.content_dedup(df).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (1, 4): False, (2, 1): False}


def seconds(*offsets):
    return [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate(offsets)]


def test_limiter_throttle_cache(spark):
    df = frame(spark, seconds(0, 10, 20, 59, 60, 70, 130), "k long, i long, ts timestamp")
    got = [r.allowed for r in folds.rate_limit(df, "k", "ts", {60: 2, 3600: 4}).orderBy("i").collect()]
    assert got == [True, True, False, False, True, True, False]
    assert [r.passes for r in folds.throttle(df, "k", "ts", 60).orderBy("i").collect()] == [True, False, False, False, True, False, True]
    assert [r.is_hit for r in windows.cached_hits(df, ["k"], "ts", "i", 60).orderBy("i").collect()] == [False, True, True, True, True, False, True]


def test_breaker(spark):
    calls = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), ok) for i, (s, ok) in enumerate([(0, False), (1, False), (2, True), (70, True), (71, True), (72, False), (200, True)])]
    got = [(r.admitted, r.breaker) for r in folds.circuit_breaker(frame(spark, calls, "k long, i long, ts timestamp, ok boolean"), "k", "ts", "ok", failures=2, successes=2).orderBy("i").collect()]
    assert got == [(True, "closed"), (True, "open"), (False, "open"), (True, "half_open"), (True, "closed"), (True, "closed"), (True, "closed")]


def test_money_ledger(spark):
    rows = [(1, 1, "reserve", 60, "a", 100), (1, 2, "reserve", 60, "b", 100), (1, 3, "settle", 20, "a", 100), (1, 4, "settle", 20, "a", 100), (1, 5, "reserve", 60, "b", 100), (1, 6, "reserve", 1, "b", 100)]
    got = [(r.accepted, r.spent) for r in folds.money_ledger(frame(spark, rows, "project_id long, pos long, kind string, cents long, operation_id string, granted long")).orderBy("pos").collect()]
    assert got == [(True, 60), (False, 60), (True, 20), (False, 20), (True, 80), (False, 80)]


def test_caps_and_gates(spark):
    df = frame(spark, [(None, 0, 500, 400), (0, 7, 500, 400), (None, 9, 500, 0)], "o int, e int, p int, b int")
    cap = ledger.effective_cap("o", "e", "p")
    got = [tuple(r) for r in df.select(cap, ledger.quota_gate(cap, F.col("b"), F.lit(899), F.lit(1), F.lit(True), F.lit(False))).collect()]
    assert got == [(500, "ok"), (0, "ok"), (9, "denied")]
    one = df.limit(1).select(ledger.quota_gate(F.lit(5), F.lit(0), F.lit(None).cast("int"), F.lit(1), F.lit(True), F.lit(True)), ledger.quota_gate(F.lit(5), F.lit(0), F.lit(5), F.lit(1), F.lit(True), F.lit(True)), ledger.batch_gate(F.lit(0), F.lit(1)), ledger.count_gate(F.lit(0), F.lit(9)), ledger.crawl_gate(F.lit("sitemap"), F.lit("full"))).first()
    assert tuple(one) == ("denied", "overage", False, True, False)


def test_month_walk_and_rollover(spark):
    got = frame(spark, [("2024-01-31",)], "d string").select(ledger.month_walk(F.col("d").cast("date"), 3)).first()[0]
    assert [str(d) for d in got] == ["2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29"]
    rows = frame(spark, [(1, 1, 450), (1, 2, 700), (1, 3, 0), (1, 4, 0)], "p long, m int, spent int")
    out = ledger.credit_rollover(rows, "p", "m", "spent", F.lit(500)).orderBy("m").collect()
    assert [float(r.granted) for r in out] == [500, 550, 500, 1000]


def test_ledger_rollup(spark):
    rows = [("k1", 1, 1, "a"), ("k1", 1, 1, "a"), ("k2", 1, 2, "b"), ("k3", 1, -1, "b")]
    r = ledger.rollup(frame(spark, rows, "key string, p int, d int, e string"), "key", ["p"], "d", "e", F.lit(1)).first()
    assert (r.total, r.entries, r.by_endpoint, r.overage) == (2, 3, {"a": 1, "b": 1}, 1)


def test_streak_and_baseline(spark):
    rows = [(1, i, ok, h) for i, (ok, h) in enumerate([(False, None), (False, None), (True, "h1"), (False, None), (False, None), (False, None)])]
    got = windows.streaks(frame(spark, rows, "k long, i long, ok boolean, h string"), "k", ["i"], ~F.col("ok")).orderBy("i").collect()
    assert [r.failures for r in got] == [1, 2, 0, 1, 2, 3] and [r.paused for r in got] == [False] * 5 + [True]
    later = frame(spark, [(1, i, i in (3, 5)) for i in range(8)], "k long, i long, ok boolean")  # a pause lasts
    assert [(r.failures, r.paused) for r in windows.streaks(later, "k", ["i"], ~F.col("ok")).orderBy("i").collect()] == [(1, False), (2, False)] + [(3, True)] * 6
    hashes = frame(spark, [(1, i, h) for i, h in enumerate(["h1", None, "h1", "h2"])], "k long, i long, h string")
    assert [r.changed for r in windows.baseline_change(hashes, "k", ["i"], "h").orderBy("i").collect()] == [False, False, False, True]


def test_mode_status_failure(spark):
    reasons = frame(spark, [(1, i, r) for i, r in enumerate("baab")], "j long, i long, r string")
    assert windows.mode_first(reasons, ["j"], "r", F.col("i")).first().mode == "b"
    items = frame(spark, [("x", "Success", "a.zip"), ("x", "Success", "a.zip"), ("y", "Failed", None), ("z", "Success", "k"), ("z", "Failed", None), ("w", "New", None)], "b string, s string, k string")
    got = {r.b: (r.status, r.zip_mode) for r in status.rollup(items, "b", "s", ["New"], ["Success"], "k").collect()}
    assert got == {"x": ("completed", True), "y": ("failed", False), "z": ("partial", False), "w": ("processing", False)}
    zero = frame(spark, [(0,)], "n int").select(status.final_verdict(F.lit(0), F.lit(0)), status.view_verdict(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False))).first()
    assert tuple(zero) == ("completed", "queued")
    msgs = frame(spark, [("Timeout 1s",), ("net::ERR_CONNECTION_RESET",), (None,)], "m string").select(status.failure(F.col("m")).alias("f")).collect()
    assert [(r.f.code, r.f.kind) for r in msgs] == [(504, "timeout"), (502, "unreachable"), (502, "empty_render")]


def test_status_moves(spark):
    rows = frame(spark, [("queued", None), ("completed", None), ("processing", "b1")], "s string, batch_id string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    assert [r.s for r in status.transitions(rows, "s", "canceled", ["queued", "processing"]).collect()] == ["canceled", "completed", "canceled"]
    assert [r.s for r in status.swept(rows, "s", ["completed", "failed"], "at", F.lit("2024-01-02").cast("timestamp")).collect()] == ["failed", "completed", "processing"]


def test_url_frontier(spark):
    raw = frame(spark, [(1, "https://x.com/b"), (2, "https://x.com/a?utm_id=1"), (3, "https://x.com/a"), (4, "https://y.com/"), (5, "https://x.com/f.pdf"), (6, "mailto:x"), (7, None), (8, "https://s.x.com/c"), (9, "https://x.com/skip")], "pos long, url string")
    got = url_list.frontier(raw, "x.com", exclude=["skip"], most=2, exact=True).orderBy("rank").collect()
    assert [(r.canonical, r.pos, r.truncated) for r in got] == [("https://x.com/b", 1, True), ("https://x.com/a", 2, True)]
    assert not url_list.frontier(raw, "x.com", exclude=["skip"], most=3).first().truncated
    assert url_list.frontier(raw, "x.com", include=["/a$", "/b"]).count() == 2
    pair = frame(spark, [(1, "https://x.com/"), (2, "http://www.x.com")], "pos long, url string")
    assert [r.pos for r in url_list.folded(pair, "url", ["pos"]).collect()] == [1]
    links = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "s string, t string")
    assert {(r.url, r.depth) for r in url_list.breadth_first(links, frame(spark, [("a",)], "url string"), "s", "t", 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    robots, probes = frame(spark, [("s1", "u1")], "site string, sitemap string"), frame(spark, [("s1", "m", 0, False), ("s1", "c", 2, True), ("s2", "c1", 1, False), ("s2", "c2", 2, True), ("s2", "c3", 3, True)], "site string, url string, rank int, found boolean")
    assert {tuple(r) for r in url_list.seeds(robots, probes).collect()} == {("s1", "u1"), ("s2", "c2")}


def test_joins(spark):
    t = frame(spark, [(1, 10, "a"), (2, 20, "b")], "k long, o long, v string")
    table, bad = joins.upserted(t, frame(spark, [(1, 10, "A"), (2, 99, "B"), (3, 30, "C")], "k long, o long, v string"), "k", "o")
    assert {(r.k, r.v) for r in table.collect()} == {(1, "A"), (2, "b"), (3, "C")} and [r.k for r in bad.collect()] == [2]
    assert joins.missing_rows(t, frame(spark, [(1,), (5,), (5,)], "k long"), ["k"]).count() == 1
    e = frame(spark, [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 2, 1))], "k long, ts timestamp")
    p = frame(spark, [(1, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))], "k long, s timestamp, e timestamp")
    assert joins.in_period(e, p, "k", "ts", "s", "e").count() == 1 == joins.in_period_bucketed(e, p.drop("k"), "ts", "s", "e", 3600).count()


def test_page_facts(spark):
    html = '<title> A &amp; B </title><script>"<h1>no</h1>"</script><h1>X <b>y</b></h1><h2></h2><link rel=x type="application/rss+xml" href="/f.xml"><link href="g.xml" type="application/atom+xml"><script type="application/ld+json">[{"a":1},{"a":2}]</script><script type="application/ld+json">{bad</script>'
    df = frame(spark, [(1, html, "https://x.com/")], "page_id long, html string, url string")
    r = df.select(pages.title("html").alias("t"), pages.headings("html").alias("h"), pages.feed_links("html", F.lit("https://x.com")).alias("f")).first()
    assert r.t == "A &amp; B" and [(h.level, h.text) for h in r.h] == [(1, "X y")] and r.f == ["https://x.com/f.xml", "https://x.com/g.xml"]
    assert [json.loads(x.o)["a"] for x in pages.json_ld(df, "page_id", "html").select(F.to_json("object").alias("o")).collect()] == [1, 2]
    own = F.array(F.lit("https://x.com/p"), F.lit("https://x.com/p/q"))
    fp = lambda s: frame(spark, [(s,)], "m string").select(pages.fingerprint("m", own)).first()[0]
    assert fp("see https://x.com/p here") == fp("see https://x.com/p/q here") != fp("see https://x.com/px here")


CSS = {"baseSelector": ".item", "fields": [
    {"name": "t", "selector": "h2", "type": "text", "transform": "uppercase"}, {"name": "u", "selector": "a", "type": "attribute", "attribute": "href"}, {"name": "p", "type": "regex", "pattern": r"\$(\d+)"},
    {"name": "d", "selector": ".none", "type": "text", "default": "x"}, {"name": "n", "selector": ".n", "type": "nested", "fields": [{"name": "v", "type": "text"}]}, {"name": "l", "selector": "li", "type": "list", "fields": [{"name": "v", "type": "text"}]},
]}


def test_css_extraction(spark):
    html = '<div class=item><h2>a</h2><a href=/1>x</a> $12 <i class=n>q</i><ul><li>1<li>2</ul></div><div class=item><h2>b</h2></div>'
    got = extract.records(html, CSS)
    assert got[0] == {"t": "A", "u": "/1", "p": "12", "d": "x", "n": {"v": "q"}, "l": [{"v": "1"}, {"v": "2"}]} and got[1] == {"t": "B", "d": "x", "l": []}
    assert extract.records(html, {"baseSelector": "::bad"}) == [] and extract.records(None, CSS) == []
    rows = extract.extract_css(frame(spark, [(1, html), (2, None)], "page_id long, html string"), "page_id", "html", CSS).collect()
    assert [(r.page_id, r.pos) for r in rows] == [(1, 0), (1, 1)]


@pytest.mark.parametrize("field", [
    {"name": "a", "type": "computed"}, {"name": "a", "type": "attribute"}, {"name": "a", "type": "regex", "pattern": "(a+)+"}, {"name": "a", "type": "regex", "pattern": "("}, {"name": "a", "type": "nested", "selector": "x"},
    {"name": "a", "type": "text", "transform": "rot13"}, {"type": "text"},
])
def test_bad_schemas(field):
    with pytest.raises(ValueError):
        extract.check_schema({"baseSelector": "x", "fields": [field]})


def test_schema_projection(spark):
    props = extract.properties({"a": "first", "b": "second"})
    assert extract.mapped(props, [{"a": 0, "b": ""}]) == ({"a": 0}, 1) and extract.missing(props, {"a": 0, "b": []}) == ["b"]
    arr = {"items": {"type": "array", "items": {"properties": {"x": {}}}}, "n": {"type": "number"}}
    assert extract.mapped(arr, [{"x": 1}, {"x": 2}]) == ({"items": [{"x": 1}, {"x": 2}]}, 1) and extract.mapped(arr, [{"x": 1}], "n") == ({"n": {"x": 1}}, 1)
    assert extract.missing(arr, {"items": [{"x": None}], "n": False}) == ["items"] and extract.shaped(arr, {}) == {"items": [], "n": None}
    assert extract.merged({"a": 1}, {"a": None, "b": 2}, ["a", "b", "c"]) == ({"a": None, "b": 2}, 1) and extract.tier(1, 0) == "css" and extract.tier(1, 1) == "mixed"
    df = frame(spark, [(1, "<h1>T</h1>"), (2, "")], "page_id long, html string")
    rows = extract.distill(df, "page_id", "html", {"baseSelector": "h1", "fields": [{"name": "title", "type": "text"}]}, {"title": "t", "price": "p"}).orderBy("page_id").collect()
    assert json.loads(rows[0].data) == {"title": "T", "price": None} and rows[0].missing == ["price"] and rows[1].tier == "none"
    sel = frame(spark, [(["all", "x"],)], "a array<string>").select(extract.selected_extracts(F.col("a"), ["k", "l"]).alias("s")).first().s
    assert sel.kinds == ["k", "l"] and sel.unsupported == ["x"]


def test_search_results(spark):
    news = '{"news":[{"title":"t","link":"u","imageUrl":"i","x":1}]}'
    r = extract.search_results(frame(spark, [("q", news), ("z", "{}")], "q string, p string"), "q", "p", "news").collect()
    assert len(r) == 1 and (r[0].title, r[0].image_url, r[0].extra) == ("t", "i", {"x": "1"})


def test_layout(spark):
    words = [("d", p, x * 50.0, x * 50.0 + 40, t, t + 10, s, True, w) for p in (1, 2, 3) for t, s, row in [(0.0, 9.0, "Running head"), (30.0, 18.0, f"Chapter {'one' * p}"), (60.0, 10.0, f"alpha{p} beta gamma delta"), (72.0, 10.0, f"# more text here{p}"), (120.0, 10.0, f"next part of it all {p}")] for x, w in enumerate(row.split())]
    df = frame(spark, words, "doc string, page long, x0 double, x1 double, top double, bottom double, size double, upright boolean, text string")
    lines = layout.lines(df)
    assert lines.where("page = 1").orderBy("top").collect()[1].text == "Chapter one"
    got = layout.blocks(layout.classified(lines, df)).where("page = 1").orderBy("block").collect()
    assert [r.markdown for r in got] == ["# Chapter one", "alpha1 beta gamma delta\n\\# more text here1", "next part of it all 1"]
    boxes = frame(spark, [("d", 1, 1, 0.0, 0.0, 500.0, 200.0, 10), ("d", 1, 2, 0.0, 0.0, 500.0, 200.0, 5000)], "doc string, page long, box long, x0 double, top double, x1 double, bottom double, edges int")
    assert [r.box for r in layout.upright_tables(boxes, df).collect()] == [1]
    up = frame(spark, [("d", 1, 10.0, 13.0, t, t + 8, 10.0, False, c) for t, c in ((0.0, "c"), (9.0, "b"), (30.0, "a"))], df.schema)
    assert layout.rotated_lines(up, 270).first().text == "a bc" and layout.rotated_lines(up, 90).first().text == "cb a"


def test_until_freed_and_cooldown(spark):
    files = frame(spark, [(1, 5), (2, None), (3, 0), (4, 5), (5, 5)], "i long, size long")
    assert [r.i for r in windows.until_freed(files, ["i"], "size", 6).collect()] == [1, 4]
    day = lambda n: dt.datetime(2024, 1, n)
    offers, old = frame(spark, [(1, day(20)), (2, day(20)), (3, day(20))], "u long, ts timestamp"), frame(spark, [(1, day(19)), (2, day(1))], "u long, ts timestamp")
    assert {r.u for r in windows.cooled_down(offers, old, "u", "ts", 5, 3).collect()} == {2, 3}
