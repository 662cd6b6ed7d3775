import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import extract
from millrace.sources import site, tables


def test_schemas(spark):
    for name, (keys, _) in tables.TABLES.items():
        assert set(keys) <= set(tables.schema(name).names)


def test_scans_filter_in_the_reader(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("subscriptions", "plans", "storage_plans", "project_members", "users"):
        spark.createDataFrame([], tables.schema(name)).write.parquet(f"{folder}/{name}")
    spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "id long, project_id long, plan_id long").withColumn("override_ops_month", F.lit(None).cast("int")).withColumn("effective_ops_month", F.lit(0)).write.mode("append").parquet(f"{folder}/subscriptions")
    spark.createDataFrame([(1, "pro", 500)], "id long, slug string, ops_month int").write.mode("append").parquet(f"{folder}/plans")
    spark.createDataFrame([(1, 5, 9, "owner"), (2, 5, 3, "owner"), (3, 5, 1, "viewer")], "id long, project_id long, user_id long, role string").write.mode("append").parquet(f"{folder}/project_members")
    one = tables.scan(spark, folder, "subscriptions", 5)
    assert one.count() == 1 and "PushedFilters: [IsNotNull(project_id), EqualTo(project_id,5)]" in one._jdf.queryExecution().toString()
    assert [(r.project_id, r.ops_cap) for r in tables.entitlements(spark, folder).orderBy("project_id").collect()] == [(5, 500), (6, 500)]
    assert [tuple(r) for r in tables.owners(spark, folder).collect()] == [(5, 3)]
    assert [r.id for r in tables.newest(tables.scan(spark, folder, "subscriptions"), "id", "project_id", 0, 1).collect()] == [2, 1]
    with pytest.raises(ValueError):
        tables.scan(spark, folder, "users", 5)


def test_crawl():
    graph = {"http://x.com/": ["a", "/a/", "http://y.com/", "mailto:z", "/login", "sub/1", "sub/2"], "http://x.com/a": ["/b", "http://s.x.com/c"], "http://x.com/b": ["/deep"]}
    links = lambda u: graph.get(u, [])
    assert site.crawl(links, "http://x.com/", 100, depth=2) == ["http://x.com/", "http://x.com/a", "http://x.com/sub/1", "http://x.com/sub/2", "http://x.com/b", "http://s.x.com/c"]
    assert len(site.crawl(links, "http://x.com/", 2)) == 2
    assert len(site.crawl(lambda u: [f"/p/{i}" for i in range(50)], "http://x.com/", 100)) == 21
    assert site.crawl(lambda u: [u + "/a/b"], "http://x.com/a/b/c", 10) == ["http://x.com/a/b/c"]


def test_table_function_and_documents(spark):
    spark.udtf.register("extract_css", extract.ExtractCss)
    spark.createDataFrame([(1, "<p class=a>x</p><p class=a>y</p>")], "id long, html string").createOrReplaceTempView("css_pages")
    rows = spark.sql("""select id, r.pos, r.record from css_pages, lateral extract_css(html, '{"baseSelector": ".a", "fields": [{"name": "t", "type": "text"}]}') r order by pos""").collect()
    assert [(r.pos, r.record) for r in rows] == [(0, '{"t": "x"}'), (1, '{"t": "y"}')]
    df = spark.createDataFrame([("{}", "http://x/", "application/json; charset=utf-8")], "b string, u string, c string")
    assert df.select(text.fenced_document("b", "json", "u", "c")).first()[0] == "---\nurl: http://x/\ncontent_type: application/json\n---\n\n```json\n{}\n```\n"
    ends = spark.createDataFrame([("a  \nb   \nc \n   \nd\t",)], "t string").select(text.strip_line_ends("t"), text.flow_quality("t")).first()
    assert ends[0] == "a  \nb   \nc\n   \nd" and ends[1] == 0.5
