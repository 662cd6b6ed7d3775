import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.sources import connectors, documents, sinks, site


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="w" xmlns:r="r"'
DOCX = archive(**{"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t xml:space="preserve"> text</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = archive(**{
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<x><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></x>',
    "xl/sharedStrings.xml": "<sst><si><t>head</t></si><si><r><t>va</t></r><r><t>l</t></r></si></sst>", "xl/worksheets/b.xml": "<worksheet><sheetData/></worksheet>",
    "xl/worksheets/a.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>',
})
PPTX = archive(**{
    "ppt/presentation.xml": '<p xmlns:r="r"><sldIdLst><sldId id="1" r:id="r1"/></sldIdLst></p>', "ppt/_rels/presentation.xml.rels": '<x><Relationship Id="r1" Target="slides/slide1.xml"/></x>',
    "ppt/slides/slide1.xml": '<s><spTree><sp><nvPr><ph type="title"/></nvPr><txBody><p><r><t>Hi</t></r></p></txBody></sp><sp><off x="5" y="20"/><txBody><p><r><t>second</t></r></p></txBody></sp><sp><off x="5" y="10"/><txBody><p><r><t>first</t></r></p><p><pPr lvl="1"/><r><t>deep</t></r></p></txBody></sp></spTree></s>',
    "ppt/slides/_rels/slide1.xml.rels": '<x><Relationship Id="n" Type="t/notesSlide" Target="../notesSlides/n1.xml"/></x>', "ppt/notesSlides/n1.xml": '<s><sp><nvPr><ph type="body"/></nvPr><txBody><p><r><t>say this</t></r></p></txBody></sp></s>',
})
EPUB = archive(**{
    "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p><item id="n" href="nav.xhtml" properties="nav"/><item id="b" href="b.xhtml"/><item id="a" href="a%20x.xhtml"/><itemref idref="n"/><itemref idref="a"/><itemref idref="b"/><itemref idref="zz"/></p>',
    "o/nav.xhtml": "<p>nav</p>", "o/a x.xhtml": "<h1>A</h1>", "o/b.xhtml": "<p>b</p>",
})


@pytest.mark.parametrize("name,raw,expected", [
    ("x.DOCX", DOCX, "## Title\n\n**bold** text\n\n- item\n\n| a | b |\n| --- | --- |\n"), ("x.xlsx", XLSX, "## One\n\n| head |     | x |\n|------|-----|---|\n| val  | 2.5 |   |\n\n## Two\n\n_(empty sheet)_\n"),
    ("x.pptx", PPTX, "## Slide 1: Hi\n\n- first\n  - deep\n\n- second\n\n### Notes\n\nsay this\n"), ("x.epub", EPUB, "# A\n\nb\n"), ("x.csv", b"a,b\n1,2\n", "| a | b |\n|---|---|\n| 1 | 2 |\n"),
    ("x.txt", b"a\r\nb\n\n\n\nc", "a\nb\n\nc\n"), ("x.json", b'{"a":1}', '```json\n{"a":1}\n```\n'), ("a/x.html", b"<h1>T</h1>", "# T\n"),
])
def test_readers(name, raw, expected):
    assert documents.to_text(raw, name) == expected


@pytest.mark.parametrize("name,raw", [("x.png", b""), ("x.pdf", b""), ("noext", b""), ("x.zzz", b""), ("x.docx", b"no zip"), ("x.csv", b"a,b\n"), ("x.epub", archive(a="b"))])
def test_unreadable(name, raw):
    with pytest.raises(ValueError):
        documents.to_text(raw, name)


def test_dtd_is_refused():
    with pytest.raises(ValueError, match="DTD"):
        documents.to_text(archive(**{"word/document.xml": "<!DOCTYPE x><x/>"}), "x.docx")


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a\n1\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.csv"].markdown.startswith("| a |") and rows["b.docx"].markdown is None and "valid archive" in rows["b.docx"].error


def test_types(spark):
    df = spark.createDataFrame([(bytearray(b"%PDF-1.4 xxxxx"), "pdf"), (bytearray(b"\x89PNG\r\n\x1a\n0000"), "jpg"), (bytearray(b"plain text..."), "md")], "c binary, e string")
    got = df.select(documents.magic("c").alias("k"), documents.type_gate(F.col("e"), documents.magic("c"), ["pdf", "jpg", "md"]).alias("ok")).collect()
    assert [(r.k, r.ok) for r in got] == [("pdf", True), ("png", False), (None, True)]
    assert documents.repaired_name("x", "png") == "x.png" and documents.repaired_name("x.md", "png") == "x.md" and documents.repaired_name("x.bin", "jpeg") == "x.bin.jpg"


SET = '<?xml version="1.0"?><urlset xmlns="u"><url><loc> https://x/{0} </loc></url><url><loc>https://x/{0}?a&amp;b</loc></url></urlset>'
INDEX = "<sitemapindex>" + "".join("<sitemap><loc>{}</loc></sitemap>" for _ in range(2)) + "</sitemapindex>"


def test_sitemaps(spark):
    import gzip

    bodies = {"i": INDEX.format("s1", "s2"), "s1": SET.format(1), "s2": SET.format(2), "bad": INDEX.format("s1", "gone"), "loop": INDEX.format("loop", "s2"), "html": "<html/>"}
    fetch = lambda u: gzip.compress(bodies[u].encode()) if u == "s2" else bodies.get(u, "").encode() or None
    assert site.parse_sitemap(fetch, "i") == ["https://x/1", "https://x/1?a&b", "https://x/2", "https://x/2?a&b"]
    assert site.parse_sitemap(fetch, "bad") == [] == site.parse_sitemap(fetch, "html") and len(site.parse_sitemap(fetch, "loop")) == 2
    table, roots = spark.createDataFrame(list(bodies.items()), "url string, body string"), spark.createDataFrame([("i",), ("bad",), ("loop",), ("s1",), ("html",)], "url string")
    got = {}
    for r in site.sitemap_urls(table, roots).orderBy("root", "pos_path").collect():
        got.setdefault(r.root, []).append(r.url)
    assert got == {"i": site.parse_sitemap(fetch, "i"), "loop": site.parse_sitemap(fetch, "loop"), "s1": site.parse_sitemap(fetch, "s1")}


def test_robots_and_feeds(spark):
    body = "User-agent: a\nUser-agent: *\nDisallow: /private\nCrawl-delay: 3\nSITEMAP: https://x/s.xml\nUser-agent: millrace\nCrawl-delay: 1\nCrawl-delay: x\n"
    r = site.robots(body)
    assert r["sitemaps"] == ["https://x/s.xml"] and r["crawl_delay"] == 1.0 and site.robots(None)["can_fetch"]("https://x/private")
    df = spark.createDataFrame([("User-agent: *\nDisallow: /p", "https://x/p/1"), ("User-agent: *\nDisallow: /p", "https://x/q"), (None, "https://x/p")], "b string, u string")
    assert [x.ok for x in df.select(site.robots_allow("b", "u").alias("ok")).collect()] == [False, True, True]
    feed = '<rss><item><link> https://x/1 </link></item><item><title/></item></rss><feed><entry><link href="https://x/self" rel="self"/><link rel="alternate" href="https://x/2"/></entry><entry><link href="https://x/3"/></entry></feed>'
    assert spark.createDataFrame([(feed,)], "f string").select(site.feed_urls("f")).first()[0] == ["https://x/1", "https://x/2", "https://x/3"]


def test_connectors(spark):
    class Fake(connectors.Renderer):
        def render(self, url):
            if "bad" in url:
                raise OSError("unreachable")
            return connectors.Rendered(f"<p>{url}</p>", url, 1.0, False)

    rows = connectors.rendered(spark.createDataFrame([("https://x/a",), ("https://bad/",)], "url string"), Fake()).orderBy("url").collect()
    assert rows[0].error == "unreachable" and rows[1].html == "<p>https://x/a</p>"
    with pytest.raises(LookupError):
        connectors.connector("png-to-webp")
    tries, naps = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError(503)
        return "ok"

    assert connectors.with_retries(call, lambda e: e.args[0], naps.append) == "ok" and naps == [0.5, 1.0]
    with pytest.raises(OSError):
        connectors.with_retries(lambda: (_ for _ in ()).throw(OSError(404)), lambda e: 404, naps.append)
    spark.dataSource.register(connectors.PageSource)
    got = spark.read.format("millrace_pages").option("urls", "a b").load().collect()
    assert [r.url for r in got] == ["a", "b"] and got[0].error


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "é", "x")], "i long, t string, n string")
    sinks.write_json_lines(df, str(tmp_path / "out"), ["i"], 2)
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"i":1,"t":"é","n":"x"}', '{"i":2,"t":"b","n":null}']
    zipped = sinks.bundles(df.withColumn("job", F.lit(1)), "job", "i", "t", "t").first()
    assert zipfile.ZipFile(io.BytesIO(bytes(zipped.content))).namelist() == ["001__markdown.md", "002_b_markdown.md"]
    naps, answers = [], iter([500, 503, 204])
    assert sinks.deliver(lambda u, b, h: next(answers), "u", b"", {}, naps.append) == (True, 3) and naps == [0, 1, 4]
    assert sinks.deliver(lambda u, b, h: 500, "u", b"", {}, naps.append) == (False, 4)
    pages = spark.createDataFrame([(1, 1, "completed", None, True), (1, 2, "completed", None, False), (2, 1, "skipped", "b", False), (2, 2, "skipped", "a", False), (2, 3, "failed", "a", False), (2, 4, "failed", "b", False)], "job long, page long, status string, note string, staged boolean")
    got = {r.job: (r.status, r.reason) for r in sinks.job_verdict(pages, "job", "status", "note", "page", "staged").collect()}
    assert got == {1: ("completed", None), 2: ("failed", "b")}
    records = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0)], "job long, page long, chunk_index long")
    assert sinks.assembled(records, pages, "job", "page", "status", "page").count() == 3
