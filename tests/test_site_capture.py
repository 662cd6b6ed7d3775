import io
import zipfile

from pyspark.sql import functions as F

from millrace.operators import site_capture


def test_website_is_found_gated_converted_and_bundled(spark):
    page = lambda t: f"<main><h1>{t}</h1><p>{'word ' * 40}</p></main>"
    links = [("https://a.com/", "https://a.com/x"), ("https://a.com/x", "https://a.com/y"), ("https://a.com/", "https://other.org/"), ("https://a.com/y", "https://a.com/logo.png"), ("https://a.com/y", "https://a.com/z"), ("https://b.com/", "https://b.com/1")]
    links = spark.createDataFrame(links, "src string, dst string")
    sites = spark.createDataFrame([(1, "https://a.com/"), (2, "https://b.com/"), (3, "https://c.com/")], "site long, url string")
    plans = spark.createDataFrame([(1, "full", 10), (2, "none", 10), (3, "full", 10)], "site long, crawl_level string, batch_limit long")
    pages = spark.createDataFrame([("https://a.com/", page("Home")), ("https://a.com/x", page("X")), ("https://a.com/x", page("X")), ("https://a.com/z", "<p>")], "url string, html string")
    done, jobs = site_capture.website(links, sites, plans, pages, most=4)
    got = {(r.site, r.url): (r.place, r.error, r.markdown is not None) for r in done.collect()}
    assert got == {
        (1, "https://a.com/"): (1, None, True), (1, "https://a.com/x"): (2, None, True), (1, "https://a.com/y"): (3, "the page could not be fetched", False),
        (1, "https://a.com/z"): (4, None, True) if got[1, "https://a.com/z"][2] else (4, "no extractable content", False), (3, "https://c.com/"): (1, "the page could not be fetched", False),
    }
    told = {r.site: (r.status, r.pages, r.failed, r.reason) for r in jobs.collect()}
    assert told[1][:2] == ("completed", sum(v[2] for k, v in got.items() if k[0] == 1)) and told[2] == ("denied", 0, 0, "crawling is not in the plan") and told[3] == ("failed", 0, 1, "the page could not be fetched")
    for body, want in (("markdown", "# Home"), ("html", "<h1>Home</h1>")):
        bundle = site_capture.site_bundles(done.where("site = 1"), body).first()
        with zipfile.ZipFile(io.BytesIO(bytes(bundle.content))) as z:
            assert z.namelist()[:2] == ["001_a.com_markdown.md", "002_a.com-x_markdown.md"] and want in z.read(z.namelist()[0]).decode()


def test_discovery_is_cut_and_says_so(spark):
    links = spark.range(20).select(F.concat(F.lit("https://a.com/"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("src"), F.concat(F.lit("https://a.com/"), F.col("id") + 1).alias("dst"))
    sites = spark.createDataFrame([(1, "https://a.com/")], "site long, url string")
    found = site_capture.discovered(links, sites, depth=9, most=5).orderBy("place").collect()
    assert [(r.depth, r.truncated) for r in found] == [(i, True) for i in range(5)]
    assert not any(r.truncated for r in site_capture.discovered(links, sites, depth=3, most=5).collect())
