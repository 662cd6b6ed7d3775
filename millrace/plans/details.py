"""Queries over names, bodies, gates, files, sites and jobs: rows of the library that need inputs made from the tables."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import formats, geometry, text, tokens, urls
from millrace.html import capture, election
from millrace.operators import extract, jobs, ledger, site_capture, status, url_list, windows
from millrace.operators import pages as facts
from millrace.sources import documents, sinks, site
from millrace.streaming import stateful


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# names


def url_names(spark, sf_dir):
    u = F.col("url")
    return _read(spark, sf_dir, "pages").select(
        "page_id", text.object_key(u).alias("object_key"), text.object_path("prod", "page_id", "/v1/convert/url/markdown", u).alias("object_path"), text.source_label(u).alias("label"),
        text.host_name(u).alias("host_name"), text.member_name("page_id", u).alias("member"), text.page_slug(u, "page_id").alias("slug"),
    )


def title_names(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("t", F.concat(F.lit("a|b\r\n"), "text"))
    return d.select("doc_id", text.title_slug("text").alias("slug"), text.clean_cell("t").alias("cell"), text.capped("text", 300).alias("capped"))


def normal_texts(spark, sf_dir):
    """Texts with line ends of three kinds, controls and separators planted, put in order."""
    noisy = F.concat(F.lit("x\x07y\r\n\r\n\r\n\r\nz\u2028w  \n v \n"), "text", F.lit("\r \n"))
    d = _read(spark, sf_dir, "documents").withColumn("t", noisy)
    return d.select("doc_id", F.sha2(text.sanitize_content("t"), 256).alias("content"), F.sha2(text.normalize_markdown("t"), 256).alias("normal"), F.sha2(text.strip_line_ends("t"), 256).alias("line_ends"))


def human_sizes(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    n = (F.col("o_orderkey") * 2 + 1) * F.pow(F.lit(1000.0), F.col("o_orderkey") % 4).cast("long") + F.lit(1) * (F.col("o_orderkey") % 2 == 5).cast("long")
    marker = text.overage_marker("o_custkey", "o_orderdate")
    return o.select("o_orderkey", text.human_bytes(n).alias("size"), marker.alias("marker"), (text.overage_time(marker) == F.col("o_orderdate").cast("timestamp")).alias("same_time"))


def request_fingerprints(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", text.fingerprint(F.struct("event_type", F.lit(None).cast("string").alias("selector"), "user_id")).alias("fingerprint"))


SECRET = "k3y-of-the-hook"


def signed_bodies(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1_700_000_000).alias("stamp"), F.concat(F.lit('{"user":'), "user_id", F.lit("}")).alias("body"))
    return e.select("event_id", text.signed(SECRET)("stamp", "body").alias("signature"))


def decoded_bytes(spark, sf_dir):
    """UTF-8, UTF-8 with its mark, and Latin-1 bytes of the same texts."""
    d = _read(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7e\xa0-\xff]"))
    utf8 = F.encode("text", "UTF-8")
    raw = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode("text", "ISO-8859-1"))
    return d.select("doc_id", F.sha2(text.decoded(raw), 256).alias("text_sha256"))


# gates


def fetch_guard(spark, sf_dir):
    """Hosts that a fetch may and may not reach, made from the ids of events."""
    i = F.col("event_id")
    part = (i % 256).cast("string")
    host = F.element_at(F.array(
        F.concat(F.lit("10.0.0."), part), F.concat(F.lit("172."), part, F.lit(".0.9")), F.concat(F.lit("192.168.7."), part), F.concat(F.lit("8.8.4."), part), F.concat(F.lit("h"), part, F.lit(".example.com")),
        F.lit("localhost"), F.concat(F.lit("printer"), part, F.lit(".local")), F.lit("[::1]"), F.concat(F.lit("user@h"), part, F.lit(".org")), F.concat(F.lit("100.64."), part, F.lit(".1")),
    ), (i % 10 + 1).cast("int"))
    url = F.concat(F.when(i % 7 == 0, "ftp").when(i % 2 == 0, "http").otherwise("https"), F.lit("://"), host, F.lit("/x"))
    return _read(spark, sf_dir, "events").select("event_id", urls.safe_url(url).alias("safe"))


def origin_gates(spark, sf_dir):
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", urls.origin_allowed("url", ["*.example.com", "localhost"]).alias("wild"), urls.origin_allowed(F.upper(urls.host("url")), ["m.example.org", "*.example.net"]).alias("bare"))


def plan_gates(spark, sf_dir):
    level = lambda c: F.element_at(F.array(F.lit("none"), F.lit("sitemap"), F.lit("full")), (c % 3 + 1).cast("int"))
    limit, n = (F.col("user_id") % 4) * 10, F.col("event_id") % 40
    return _read(spark, sf_dir, "events").select("event_id", ledger.crawl_gate(level(F.col("user_id")), level(F.col("event_id"))).alias("crawl"), ledger.batch_gate(limit, n).alias("batch"), ledger.count_gate(limit, n).alias("count"))


def file_kinds(spark, sf_dir):
    """First bytes and extensions that agree, disagree, or say nothing."""
    i = F.col("event_id")
    heads = ("255044462D312E34", "89504E470D0A1A0A00", "FFD8FFE000", "474946383961", "504B030414", "D0CF11E0A1B11AE1", "1F8B08", "524946460000000057454250", "0000001866747970686569630000", "68656C6C6F")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "png", "jpg", "docx", "txt", "xls", "webp")]), (i % 7 + 1).cast("int"))
    shown = documents.magic(F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (i % 10 + 1).cast("int"))))
    e = _read(spark, sf_dir, "events").select("event_id", ext.alias("ext"), shown.alias("shown"))

    @F.pandas_udf("string")
    def repaired(names: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([documents.repaired_name(n, k) for n, k in zip(names, kinds, strict=True)])

    named = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f."), "ext")).otherwise(F.lit("f"))
    return e.select("event_id", "shown", documents.type_gate(F.col("ext"), F.col("shown"), None).alias("open"), documents.type_gate(F.col("ext"), F.col("shown"), ["pdf", "png"]).alias("listed"), repaired(named, "shown").alias("name"))


def extract_choices(spark, sf_dir):
    """Kinds asked for by name and by 'all', and what a finished job's keys make known."""
    i = F.col("event_id")
    asked = F.filter(F.array(F.when(i % 3 == 0, "all"), F.lit("links"), F.when(i % 2 == 0, "title"), F.when(i % 5 == 0, "nonsense")), lambda x: x.isNotNull())
    kinds = extract.selected_extracts(asked, ["title", "headings", "links"])
    keys = F.create_map(F.lit("markdown"), F.concat(F.lit("k/"), i.cast("string")), F.lit("_internal"), F.lit("x"), F.lit("html"), F.when(i % 2 == 0, F.lit("h")))
    made = F.transform(extract.artifacts(keys), lambda a: F.concat(a["kind"], F.lit("="), a["key"]))
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(kinds["kinds"], ",").alias("kinds"), F.array_join(kinds["unsupported"], ",").alias("unsupported"), F.array_join(made, ",").alias("artifacts"))


def quality_scores(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.flow_quality("html").alias("whole"), text.flow_quality(F.substring("html", 1, 500)).alias("head"))


def svg_sizes(spark, sf_dir):
    i = F.col("page_id")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "px", "pt", "mm", "in", "%")]), (i % 6 + 1).cast("int"))
    svg = F.concat(F.lit('<svg viewBox="0 0 '), i + 1, F.lit(" 50\" width='"), i + 2, unit, F.lit("' height='"), i * 3 + 1, unit, F.lit("'><path/></svg>"))
    size = geometry.svg_size(svg)
    drawn = geometry.svg_render_size(size, 10_000)
    return _read(spark, sf_dir, "pages").select("page_id", F.round(size["width"], 6).alias("width"), F.round(size["height"], 6).alias("height"), drawn["width"].cast("long").alias("render_width"), drawn["height"].cast("long").alias("render_height"))


# sites


def sitemap_pages(spark, sf_dir):
    """A root index of four sitemaps that hold all pages, read over a table of bodies."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("s"), F.col("page_id") % 4).alias("at"), "url")
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc></url>"))
    bodies = p.groupBy(F.col("at").alias("url")).agg(F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="x">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("l")))), lambda x: x["l"]), "\n"), F.lit("</urlset>")).alias("body"))
    root = spark.createDataFrame([("root", "<sitemapindex>" + "".join(f"<sitemap><loc>s{i}</loc></sitemap>" for i in range(4)) + "<sitemap><loc>root</loc></sitemap></sitemapindex>")], "url string, body string")
    found = site.sitemap_urls(bodies.union(root), spark.createDataFrame([("root",)], "url string"))
    return found.select("pos_path", "url")


def robots_rules(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").withColumn("body", F.when(F.col("page_id") % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("User-agent: *\nDisallow: /fr/\nCrawl-delay: 3\nSitemap: https://x/a.xml\nsitemap: https://x/b.xml")))
    f = site.robots_facts("body")
    return p.withColumn("f", f).select("page_id", site.robots_allow("body", "url").alias("allowed"), F.col("f.crawl_delay").alias("crawl_delay"), F.array_join("f.sitemaps", " ").alias("sitemaps"))


def feed_items(spark, sf_dir):
    """Items of RSS and entries of Atom with a page's URL each, and the links to feeds that a page's head names."""
    u = F.col("url")
    rss = F.concat(F.lit("<rss><channel><link>home</link><item><title>t</title><link><![CDATA["), u, F.lit("]]></link></item><item><link>  "), u, F.lit("/2 </link></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><entry><link rel="self" href="no"/><link rel="alternate" href="'), u, F.lit('"/></entry><entry><link href="'), u, F.lit('/3"/></entry></feed>'))
    head = F.concat(F.lit('<link rel=alternate type="application/rss+xml" href="/feed/'), F.col("page_id"), F.lit('"><link href="https://x/atom" type="application/atom+xml">'), F.col("html"))
    found = F.concat(site.feed_urls(rss), site.feed_urls(atom))
    return _read(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("items"), F.array_join(facts.feed_links(head, F.lit("https://b")), " ").alias("feeds"))


def seed_sitemaps(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"))
    robots = n.where("site % 3 = 0").select("site", F.concat(F.lit("r"), "site").alias("sitemap"))
    probes = n.select("site", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")).select("site", F.concat(F.lit("p"), "rank").alias("url"), "rank", ((F.col("site") * 7 + F.col("rank") * 3) % 4 < 2).alias("found"))
    return url_list.seeds(robots, probes)


def _graph(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 400).cast("string").alias("src"), ((F.col("o_orderkey") * 7) % 400).cast("string").alias("dst"))


def link_depths(spark, sf_dir):
    start = spark.createDataFrame([("1",), ("2",)], "url string")
    return url_list.breadth_first(_graph(spark, sf_dir), start, "src", "dst", 3).select("url", F.col("depth").cast("long").alias("depth"))


def website_capture(spark, sf_dir):
    """Sites of ten pages, each page linked from the one before: found, gated by plan, converted one by one."""
    p = _read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://s"), F.floor(F.col("page_id") / 10), F.lit(".example.com/p"), F.col("page_id") % 10).alias("url"), "html")
    links = p.alias("a").join(p.alias("b"), F.expr("b.page_id = a.page_id + 1 and floor(a.page_id / 10) = floor(b.page_id / 10)")).select(F.col("a.url").alias("src"), F.col("b.url").alias("dst"))
    sites = p.where("page_id % 10 = 0").select(F.floor(F.col("page_id") / 10).alias("site"), "url")
    projects = sites.select("site", F.when(F.col("site") % 4 == 3, "sitemap").otherwise("full").alias("crawl_level"), F.when(F.col("site") % 5 == 4, 3).otherwise(20).alias("batch_limit"))
    fetched = p.withColumn("html", F.when(F.col("page_id") % 10 == 3, F.lit(None)).when(F.col("page_id") % 10 == 5, "<html></html>").otherwise(F.col("html"))).select("url", "html").where("html is not null")
    done, told = site_capture.website(links, sites, projects, fetched, depth=6, most=5)
    pages = done.select("site", "url", F.col("place").cast("long").alias("place"), "truncated", "error", "member")
    states = told.select("site", F.col("status").alias("url"), F.col("pages").alias("place"), "truncated", F.col("reason").alias("error"), F.col("failed").cast("string").alias("member"))
    return pages.union(states)


def rendered_captures(spark, sf_dir):
    p = _read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7).alias("project"), F.when(F.col("page_id") % 11 == 0, "").otherwise(F.col("html")).alias("html"), (F.col("page_id") % 6 == 0).alias("skip"))
    return site_capture.rendered_captures(p, "prod", "project", "page_id", "html", "skip", F.lit("2024-01-31").cast("timestamp_ntz"))


# files


def json_lines(spark, sf_dir):
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.lit("x")).alias("note"))
    return sinks.json_lines(n)


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def _office(name: str, key: int, kind: str) -> bytes:
    """A small file of each kind that says a nation's name and key."""
    r, o = 'xmlns:r="r"', '<?xml version="1.0"?>'
    match kind:
        case "csv":
            return f"key,name\n{key},{name}\n".encode()
        case "txt":
            return f"{name}\r\n\r\n\r\n\r\n{key}".encode("utf-8-sig")
        case "docx":
            body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{key}</w:t></w:r><w:r><w:t xml:space="preserve"> and more</w:t></w:r></w:p>'
            return _zipped({"word/document.xml": f'{o}<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
        case "xlsx":
            cells = f'<row><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="inlineStr"><is><t>name</t></is></c></row><row><c r="A2"><v>{key}</v></c><c r="B2" t="s"><v>0</v></c></row>'
            return _zipped({
                "xl/workbook.xml": f'{o}<workbook {r}><sheets><sheet name="One" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'{o}<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>',
                "xl/sharedStrings.xml": f"{o}<sst><si><t>{name}</t></si></sst>", "xl/worksheets/s.xml": f"{o}<worksheet><sheetData>{cells}</sheetData></worksheet>",
            })
        case "pptx":
            shape = lambda ph, t: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
            slide = f'{o}<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{shape("<p:ph type=" + chr(34) + "title" + chr(34) + "/>", name)}{shape("", key)}</p:spTree></p:cSld></p:sld>'
            return _zipped({
                "ppt/presentation.xml": f'{o}<p:presentation xmlns:p="p" {r}><p:sldIdLst><p:sldId id="1" r:id="a"/></p:sldIdLst></p:presentation>',
                "ppt/_rels/presentation.xml.rels": f'{o}<Relationships><Relationship Id="a" Target="slides/s1.xml"/></Relationships>', "ppt/slides/s1.xml": slide,
            })
        case _:
            return _zipped({
                "META-INF/container.xml": f'{o}<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
                "O/p.opf": f'{o}<package><manifest><item id="n" href="n.xhtml" properties="nav"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="c"/></spine></package>',
                "O/n.xhtml": "<nav>menu</nav>", "O/c.xhtml": f"<html><body><h1>{name}</h1><p>{key}</p></body></html>",
            })


def office_files(spark, sf_dir):
    """A file of each kind for each nation, read by its extension; those that no reader knows are errors of their own."""
    kinds = F.array(*[F.lit(k) for k in ("csv", "txt", "docx", "xlsx", "pptx", "epub", "png", "odd")])
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.explode(kinds).alias("kind"))

    @F.pandas_udf("binary")
    def made(names: pd.Series, keys: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([_office(*row) for row in zip(names, keys, kind, strict=True)])

    files = n.select(F.concat("n_name", F.lit("."), "kind").alias("path"), made("n_name", "n_nationkey", "kind").alias("content"))
    return documents.converted(files).select("path", "markdown", F.col("error").isNotNull().alias("failed"))


def batch_archives(spark, sf_dir):
    """A ZIP a region of its nations' files, opened again."""
    n = _read(spark, sf_dir, "nation").select("n_regionkey", F.format_string("%03d", "n_nationkey").alias("at"), F.concat(F.lit("https://x.org/"), "n_name", F.lit("/?a")).alias("url"), F.concat(F.lit("# "), "n_name").alias("body"))

    @F.pandas_udf("array<string>")
    def opened(content: pd.Series) -> pd.Series:
        out = []
        for raw in content:
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                out.append([f"{name}: {z.read(name).decode()}" for name in z.namelist()])
        return pd.Series(out)

    rows = sinks.bundles(n, "n_regionkey", "at", "url", "body").select("n_regionkey", F.posexplode(opened("content")).alias("pos", "member"))
    return rows.select("n_regionkey", F.col("pos").cast("long").alias("pos"), "member")


def assembled_jobs(spark, sf_dir):
    """Records of completed pages in their job's order."""
    d = _read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("job_id"), F.col("doc_id").alias("page_id"), (-F.col("doc_id") % 13).alias("pos"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("completed").alias("status"))
    records = d.select("job_id", "page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int"))).alias("chunk_index"))
    out = sinks.assembled(records, d, "job_id", "page_id", "status", "pos")
    return out.select("job_id", "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("line").cast("long").alias("line"))


def job_verdicts(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 3).alias("job_id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 1, "failed").otherwise("completed").alias("status"),
        F.element_at(F.array(F.lit("DUPLICATE"), F.lit("timed out"), F.lit(None).cast("string"), F.lit("blocked")), (F.col("doc_id") % 4 + 1).cast("int")).alias("note"), (F.col("doc_id") % 5 < 2).alias("staged"),
    )
    return sinks.job_verdict(d, "job_id", "status", "note", "pos", "staged").select("job_id", "completed", "duplicates", "status", "reason")


def markdown_as_html(spark, sf_dir):
    r = _read(spark, sf_dir, "region")
    md = F.concat(F.lit("# "), "r_name", F.lit("\n\nSome **bold** & `code`\n\n- a\n- b\n\n```sql\nselect "), "r_regionkey", F.lit(" < 9\n```\n"))
    return r.select("r_regionkey", formats.converted(md, "markdown_to_html")["output"].alias("html"))


def csv_xml_records(spark, sf_dir):
    r = _read(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("key,name\n"), "r_regionkey", F.lit(",\"<"), "r_name", F.lit(", & co>\"\n")).alias("csv"))
    r = r.withColumn("xml", formats.converted("csv", "csv_to_xml")["output"])
    return r.withColumn("back", formats.converted("xml", "xml_to_csv")["output"]).select("r_regionkey", F.replace("back", F.lit("\r\n"), F.lit("\n")).alias("back"), F.col("xml").contains("&lt;").alias("is_escaped"))


# jobs


def state_changes(spark, sf_dir):
    """Conditional transitions, and the sweep of what has stood too long."""
    e = _read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("state"), "ts", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("batch_id"))
    moved = status.transitions(e, "state", "done", ["click", "view"])
    old = status.swept(e, "state", ["purchase", "error"], "ts", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", F.col("state").alias("swept"))
    return moved.select("event_id", "state", "applied").join(old, "event_id")


def mail_claims(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    log = e.where("event_type = 'error'").select(F.concat("user_id", F.lit(":"), F.col("event_id") % 5).alias("email_key")).distinct()
    return jobs.claims(e.select(F.concat("user_id", F.lit(":"), F.col("event_id") % 5).alias("email_key")), log)


def mail_retries(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3 == 0).alias("sent_ok"), F.col("ts").alias("created_at"), (F.col("event_id") % 4).alias("attempts"))
    return jobs.retryable(e, F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


def cached_operations(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    rows = e.select("event_id", (F.col("user_id") % 20).alias("project_id"), F.col("event_type").alias("url"), (F.col("event_id") % 6).alias("fingerprint"), "ts")
    done = rows.select("project_id", "url", "fingerprint", F.col("ts").alias("created_at"), F.col("event_id").alias("operation_id"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("completed").alias("status"), (F.col("event_id") % 9 == 0).alias("cache_hit"))
    asked = rows.where("event_id % 10 = 7").select(F.col("event_id").alias("request_id"), "project_id", "url", "fingerprint", F.col("ts").alias("at"))
    return jobs.cached_operation(done, asked, seconds=400_000, most=3).select("request_id", "operation_id")


def cost_totals(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 5 == 0, "failed").otherwise("completed").alias("status"), F.round(F.col("value"), 2).alias("cost_cents"))
    t = jobs.cost_totals(e, ["user_id"])
    return t.withColumn("cost_cents", F.col("cost_cents").cast("double"))


def next_checks(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("watcher_id"), F.when(F.col("event_id") % 4 == 0, "paused").otherwise("active").alias("status"), F.col("ts").cast("timestamp").alias("next_check_at"), (F.col("event_id") % 200).alias("frequency_minutes"))
    import datetime

    out = stateful.due(e, datetime.datetime(2024, 1, 20), 50)
    return out.select("watcher_id", F.col("next_check_at").cast("timestamp_ntz").alias("next_check_at"))


def watch_checks(spark, sf_dir):
    """Checks of watchers: what counts as a capture, whether it differs from the last one, failures in a row and the pause."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.floor(F.col("value") / 40).cast("string")).alias("raw"), ((F.col("event_id") % 10) / 10).alias("quality"), (F.col("event_id") % 7 == 0).alias("blocked"), (F.col("event_type") == "error").alias("failed"))
    e = e.withColumn("digest", windows.comparable_hash(F.col("raw"), F.col("quality"), F.col("blocked")))
    rows = windows.baseline_change(e, "user_id", ["ts", "event_id"], "digest")
    return windows.streaks(rows, "user_id", ["ts", "event_id"], F.col("failed")).select("event_id", "digest", "baseline", "changed", "failures", "paused")


def batch_resumes(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("batch_id"), F.element_at(F.array(*[F.lit(x) for x in ("queued", "processing", "completed", "failed")]), (F.col("event_id") % 4 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 6 > 0, F.col("event_type")).alias("request"))
    batches = e.select("batch_id").distinct().withColumn("redacted", F.col("batch_id") % 3 == 0)
    return jobs.resumed(e, batches).select("event_id", "status", "error")


def lookup_reports(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    q = e.select("event_id", F.element_at(F.array(F.lit(None).cast("string"), F.lit("config"), F.lit("unavailable"), F.lit("upstream"), F.lit(None).cast("string")), (F.col("event_id") % 5 + 1).cast("int")).alias("fault"), F.lit(3).alias("cost"))
    results = e.where("event_id % 3 > 0").select("event_id", F.explode(F.sequence(F.lit(1), (F.col("event_id") % 4 + 1).cast("int"))).alias("n"))
    out = status.lookups(q, results, "event_id", "fault", "cost")
    return out.select("event_id", F.col("status").cast("long").alias("status"), "detail", F.col("total").cast("long").alias("total"), F.col("operations").cast("long").alias("operations"), F.col("cost_cents").cast("long").alias("cost_cents"))


def content_diffs(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("a"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit("!")), 256)).alias("b"))
    x = capture.diff("a", "b")
    return d.select("doc_id", x["has_changes"].alias("has_changes"), x["similarity"].alias("similarity"), F.size(x["changes"]).cast("long").alias("n"), F.try_element_at(x["changes"], F.lit(1))["after"].alias("after"))


def planted_jsonld(spark, sf_dir):
    """Structured data planted in every page: an object, an array, and a script that does not parse."""
    script = lambda body: F.concat(F.lit("<script type='application/ld+json'>"), body, F.lit("</script>"))
    one = F.concat(F.lit('{"@type": "Page", "id": '), "page_id", F.lit("}"))
    html = F.concat(script(one), script(F.lit("{bad")), script(F.concat(F.lit('[{"a": 1}, '), one, F.lit("]"))), "html")
    p = _read(spark, sf_dir, "pages").withColumn("html", html)
    rows = facts.json_ld(p, "page_id", "html")
    return rows.select("page_id", F.col("script").cast("long").alias("script"), F.col("pos").cast("long").alias("pos"), F.to_json("object").alias("object"))


def access_tokens(spark, sf_dir):
    """Tokens that name a user, read with the right and (for odd ones) the wrong secret."""
    n = _read(spark, sf_dir, "nation")

    @F.pandas_udf("token string, user long")
    def made(keys: pd.Series) -> pd.DataFrame:
        out = [tokens.make_token(int(k), SECRET) for k in keys]
        return pd.DataFrame({"token": out, "user": pd.array([tokens.read_token(t, SECRET if k % 2 == 0 else "other") for t, k in zip(out, keys, strict=True)], dtype="Int64")})

    return n.select("n_nationkey", made("n_nationkey").alias("m")).select("n_nationkey", "m.*")


def line_profiles(spark, sf_dir):
    """What the election weighs of a rendition: documents with a navigation line, a bare heading and a section planted."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("- [Home](/h) |\n#\n# A title here\n\n"), F.substring("text", 1, 3000)).alias("markdown"))

    @F.pandas_udf("n long, nav long, junk long, prose long, sections long, nav_ratio double")
    def told(markdown: pd.Series) -> pd.DataFrame:
        found = [election.profile(election.lines_of(m)) for m in markdown]
        return pd.DataFrame([(p.n, p.nav, p.junk, len(p.prose), len(p.sections), p.nav_ratio) for p in found], columns=["n", "nav", "junk", "prose", "sections", "nav_ratio"])

    return d.withColumn("p", told("markdown")).select("doc_id", "p.*")


def _hmac(message: str) -> str:
    """DuckDB's HMAC-SHA-256 of a text expression under SECRET."""
    key = SECRET.encode().ljust(64, b"\0")
    inner, outer = (bytes(k ^ pad for k in key).hex().upper() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_NOISY = "'x' || chr(7) || 'y' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || 'z' || chr(8232) || 'w  ' || chr(10) || ' v ' || chr(10) || text || chr(13) || ' ' || chr(10)"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SLUG = "substr(regexp_replace(regexp_replace(regexp_replace({u}, 'https?://', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"

SQL = {
    "url_names": f"""with k as (select page_id, url, replace(replace(regexp_replace(replace(list_extract(string_split(url, '/'), -1), '..', ''), '[<>:"|?*]', '', 'g'), ' ', '_'), chr(127), '') k from pages),
        h as (select *, case when k in ('', '.') then 'output.bin' else k end key, string_split(regexp_replace({_HOST}, '^www\\.', ''), '.')[1] h from k)
        select page_id, key as object_key, 'prod/files/' || page_id || '/url-markdown/' || key as object_path, list_extract(string_split(url, '/'), -1) as label, case when h = '' then 'output' else h end as host_name,
        format('{{:03d}}', page_id + 1) || '_' || {_SLUG.format(u="url")} || '_markdown.md' as member, substr(md5(url), 1, 12) || '-' || format('{{:04d}}', page_id) as slug from h""",
    "title_names": f"""with c as (select doc_id, text, trim(replace(regexp_replace('a|b' || chr(13) || chr(10) || text, '[\\r\\n]', ' ', 'g'), '|', '\\|'), {_BLANK}) c from documents)
        select doc_id, case when text = '' then 'capture' else substr(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}} _-]', '', 'g'), {_BLANK}), 1, 50) end as slug,
        case when length(c) > 500 then substr(c, 1, 500) || '…' else c end as cell, case when length(text) > 300 then substr(text, 1, 300) || '…' else text end as capped from c""",
    "normal_texts": f"""with n as (select doc_id, {_NOISY} t from documents)
        select doc_id, sha256(replace(t, chr(8232), chr(10))) as content, sha256(trim(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), chr(7), ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_BLANK}) || chr(10)) as normal,
        sha256(array_to_string(list_transform(string_split(t, chr(10)), lambda x: case when ends_with(x, '  ') then x else rtrim(x, {_BLANK}) end), chr(10))) as line_ends from n""",
    "human_sizes": """with n as (select *, (o_orderkey * 2 + 1) * pow(1000, o_orderkey % 4)::bigint n from orders)
        select o_orderkey, case when n >= 1099511627776 then printf('%.1f TB', n / 1099511627776.0) when n >= 1073741824 then printf('%.1f GB', n / 1073741824.0) when n >= 1048576 then printf('%.1f MB', n / 1048576.0)
          when n >= 1024 then printf('%.1f KB', n / 1024.0) else n || ' B' end as size, 'overage:' || o_custkey || ':' || strftime(o_orderdate, '%Y%m%d%H%M%S') as marker, true as same_time from n""",
    "request_fingerprints": """select event_id, sha256('{"event_type":"' || event_type || '","selector":null,"user_id":' || user_id || '}') as fingerprint from events""",
    "signed_bodies": "select event_id, " + _hmac("""(event_id + 1700000000)::varchar || '.{"user":' || user_id || '}'""") + " as signature from events",
    "decoded_bytes": r"select doc_id, sha256(text) as text_sha256 from documents where not regexp_matches(text, '[^\x00-\x7e\x{a0}-\x{ff}]')",
    "fetch_guard": "select event_id, event_id % 7 <> 0 and case event_id % 10 when 1 then not event_id % 256 between 16 and 31 when 3 then true when 4 then true else false end as safe from events",
    "origin_gates": f"with h as (select page_id, {_HOST} h from pages) select page_id, h = 'example.com' or ends_with(h, '.example.com') or h = 'localhost' as wild, h = 'm.example.org' or h = 'example.net' or ends_with(h, '.example.net') as bare from h",
    "plan_gates": "with g as (select event_id, user_id % 3 l, event_id % 3 m, user_id % 4 * 10 cap, event_id % 40 n from events) select event_id, l >= m as crawl, cap > 0 and n <= cap as batch, cap = 0 or n < cap as count from g",
    "file_kinds": """with k as (select event_id, list_extract(['pdf', 'png', 'jpg', 'docx', 'txt', 'xls', 'webp'], (event_id % 7 + 1)::int) x, list_extract(['pdf', 'png', 'jpeg', 'gif', 'zip', 'ole', 'gzip', 'webp', 'heic', null], (event_id % 10 + 1)::int) s from events),
        m as (select *, case x when 'jpg' then 'jpeg' when 'docx' then 'zip' when 'xls' then 'ole' when 'txt' then null else x end n from k), o as (select *, coalesce(n = s, true) ok from m)
        select event_id, s as shown, ok as open, ok and x in ('pdf', 'png') as listed, case when event_id % 2 = 0 then 'f.' || x when s is null or s in ('zip', 'ole') then 'f' else 'f.' || case s when 'jpeg' then 'jpg' when 'gzip' then 'gz' else s end end as name from o""",
    "extract_choices": """select event_id, case when event_id % 3 = 0 then 'title,headings,links' when event_id % 2 = 0 then 'links,title' else 'links' end as kinds, case when event_id % 5 = 0 then 'nonsense' else '' end as unsupported,
        case when event_id % 2 = 0 then 'html=h,' else '' end || 'markdown=k/' || event_id as artifacts from events""",
    "quality_scores": "select page_id, case when length(html) > 500 then 1.0 else 0.5 end::double as whole, 0.5::double as head from pages",
    "svg_sizes": """with u as (select page_id, list_extract([1.0, 1.0, 96.0 / 72, 96.0 / 25.4, 96.0, null]::double[], (page_id % 6 + 1)::int) f from pages), s as (select page_id, coalesce((page_id + 2) * f, page_id + 1) w, coalesce((page_id * 3 + 1) * f, 50) h from u)
        select page_id, round(w, 6) as width, round(h, 6) as height, case when w * h > 10000 then greatest(1, floor(w * sqrt(10000 / (w * h))))::bigint end as render_width, case when w * h > 10000 then greatest(1, floor(h * sqrt(10000 / (w * h))))::bigint end as render_height from s""",
    "sitemap_pages": "with r as (select page_id % 4 s, url, row_number() over (partition by page_id % 4 order by page_id) - 1 i from pages) select format('/{:06d}/{:06d}', s, i) as pos_path, url from r",
    "robots_rules": f"""select page_id, page_id % 5 = 0 or not starts_with({_PATH}, '/fr/') as allowed, case when page_id % 5 > 0 then 3.0 end::double as crawl_delay, case when page_id % 5 > 0 then 'https://x/a.xml https://x/b.xml' else '' end as sitemaps from pages""",
    "feed_items": "select page_id, url || ' ' || url || '/2 ' || url || ' ' || url || '/3' as items, 'https://b/feed/' || page_id || ' https://x/atom' as feeds from pages",
    "seed_sitemaps": """with p as (select n_nationkey site, r, (n_nationkey * 7 + r * 3) % 4 < 2 found from nation, range(4) t(r)), a as (select n_nationkey site, -1 r, 'r' || n_nationkey url from nation where n_nationkey % 3 = 0 union all select site, r, 'p' || r from p where found),
        b as (select *, bool_or(r <= 0) over (partition by site) prime, min(r) over (partition by site) low from a) select distinct site, url from b where (prime and r <= 0) or (not prime and r = low)""",
    "link_depths": """with recursive g as (select distinct (o_custkey % 400)::varchar s, ((o_orderkey * 7) % 400)::varchar d from orders), r as (select url, 0 depth from (values ('1'), ('2')) t(url) union select g.d, r.depth + 1 from r join g on g.s = r.url where r.depth < 3)
        select url, min(depth)::bigint as depth from r group by 1""",
    "website_capture": f"""with p as (select page_id, page_id // 10 site, page_id % 10 i, 'https://s' || page_id // 10 || '.example.com/p' || page_id % 10 url, count(*) over (partition by page_id // 10) n from pages), f as (select *, least(n, 5) found, n > 5 truncated from p where i < 5),
        g as (select *, case when site % 4 = 3 then 'crawling is not in the plan' when site % 5 = 4 and found > 3 then 'more pages than the plan allows' end reason, case when i = 3 then 'the page could not be fetched' end error from f)
        select site, url, i + 1 as place, truncated, error, format('{{:03d}}', i + 1) || '_' || {_SLUG.format(u="url")} || '_markdown.md' as member from g where reason is null
        union all select site, case when reason is null then 'completed' else 'denied' end, case when reason is null then count(*) filter (error is null) else 0 end, case when reason is null then bool_or(truncated) else false end, reason,
          (case when reason is null then count(*) filter (error is not null) else 0 end)::varchar from g group by site, reason""",
    "rendered_captures": "select page_id % 7 as project, page_id, 'prod/rendered/' || page_id % 7 || '/' || page_id || '.html' as rendered_html_key, sha256(html) as content_hash, timestamp '2024-04-30' as delete_at from pages where page_id % 11 <> 0 and page_id % 6 <> 0",
    "json_lines": """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","note":' || case when n_nationkey % 2 = 0 then '"x"' else 'null' end || '}' as value from nation""",
    "office_files": """with t as (select *, unnest(['csv', 'txt', 'docx', 'xlsx', 'pptx', 'epub', 'png', 'odd']) kind, greatest(length(n_name), 4) w, greatest(length(n_nationkey::varchar), 3) v from nation),
        m as (select *, '| ' || rpad('key', v::int, ' ') || ' | ' || rpad('name', w::int, ' ') || ' |' || chr(10) || '|' || repeat('-', (v + 2)::int) || '|' || repeat('-', (w + 2)::int) || '|' || chr(10) || '| ' || rpad(n_nationkey::varchar, v::int, ' ') || ' | ' || rpad(n_name, w::int, ' ') || ' |' g from t)
        select n_name || '.' || kind as path, case kind when 'csv' then g || chr(10) when 'txt' then n_name || chr(10) || chr(10) || n_nationkey || chr(10) when 'docx' then '# ' || replace(n_name, '_', '\\_') || chr(10) || chr(10) || '**' || n_nationkey || '** and more' || chr(10)
          when 'xlsx' then '## One' || chr(10) || chr(10) || g || chr(10) when 'pptx' then '## Slide 1: ' || n_name || chr(10) || chr(10) || '- ' || n_nationkey || chr(10) when 'epub' then '# ' || replace(n_name, '_', '\\_') || chr(10) || chr(10) || n_nationkey || chr(10) end as markdown, kind in ('png', 'odd') as failed from m""",
    "batch_archives": f"""select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pos, format('{{:03d}}', row_number() over (partition by n_regionkey order by n_nationkey)) || '_' || {_SLUG.format(u="'https://x.org/' || n_name || '/?a'")} || '_markdown.md: # ' || n_name as member from nation""",
    "assembled_jobs": """with d as (select doc_id // 50 job_id, doc_id page_id, (-doc_id) % 13 pos from documents where doc_id % 4 <> 0), r as (select *, unnest(range(0, page_id % 3 + 1)) c from d)
        select job_id, page_id, c as chunk_index, row_number() over (partition by job_id order by pos, page_id, c) as line from r""",
    "job_verdicts": """with d as (select doc_id // 3 job_id, doc_id pos, doc_id % 3 <> 1 done, list_extract(['DUPLICATE', 'timed out', null, 'blocked'], (doc_id % 4 + 1)::int) note, doc_id % 5 < 2 staged from documents),
        w as (select job_id, note, count(*) n, min(pos) f from d where not (done and staged) and note is not null group by job_id, note qualify row_number() over (partition by job_id order by count(*) desc, min(pos)) = 1),
        j as (select job_id, count(*) filter (done and staged) completed, count(*) filter (done and note = 'DUPLICATE') duplicates from d group by 1)
        select job_id, completed, duplicates, case when completed > 0 then 'completed' else 'failed' end as status, case when completed = 0 then w.note end as reason from j left join w using (job_id)""",
    "markdown_as_html": """select r_regionkey, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>Document</title></head>' || chr(10) || '<body>' || chr(10) || '<h1 id="' || lower(replace(r_name, ' ', '-')) || '">' || r_name || '</h1>' || chr(10)
        || '<p>Some <strong>bold</strong> &amp; <code>code</code></p>' || chr(10) || '<ul>' || chr(10) || '<li>a</li>' || chr(10) || '<li>b</li>' || chr(10) || '</ul>' || chr(10) || '<pre><code class="language-sql">select ' || r_regionkey || ' &lt; 9' || chr(10) || '</code></pre>' || chr(10) || '</body></html>' as html from region""",
    "csv_xml_records": """select r_regionkey, 'key,name' || chr(10) || r_regionkey || ',"<' || r_name || ', & co>"' || chr(10) as back, true as is_escaped from region""",
    "state_changes": """select event_id, case when event_type in ('click', 'view') then 'done' else event_type end as state, event_type in ('click', 'view') as applied,
        case when event_type not in ('purchase', 'error') and ts < timestamp '2024-01-20' and event_id % 3 <> 0 then 'failed' else event_type end as swept from events""",
    "mail_claims": "select distinct user_id || ':' || event_id % 5 as email_key from events where user_id || ':' || event_id % 5 not in (select user_id || ':' || event_id % 5 from events where event_type = 'error')",
    "mail_retries": "select event_id from events where event_id % 3 <> 0 and ts > timestamp '2024-01-13' and ts < timestamp '2024-01-14 23:45:00' and event_id % 4 < 3",
    "cached_operations": """with r as (select event_id, user_id % 20 p, event_type u, event_id % 6 f, ts from events), o as (select * from r where event_id % 4 <> 0 and event_id % 9 <> 0), q as (select * from r where event_id % 10 = 7),
        n as (select q.event_id request_id, q.f, o.f g, o.event_id op, row_number() over (partition by q.event_id order by o.ts desc, o.event_id desc) k from q join o on q.p = o.p and q.u = o.u and o.ts <= q.ts and o.ts >= q.ts - interval 400000 second)
        select q.event_id as request_id, (select arg_min(op, k) from n where n.request_id = q.event_id and k <= 3 and f = g) as operation_id from q""",
    "cost_totals": "select user_id, count(*) filter (event_id % 5 <> 0) as completed, count(*) filter (event_id % 5 = 0) as failed, sum(round(value, 2)::decimal(12, 4))::double as cost_cents from events group by 1",
    "next_checks": """select event_id as watcher_id, timestamp '2024-01-20' + to_minutes(greatest(event_id % 200, 60)) as next_check_at from events where event_id % 4 <> 0 and ts <= timestamp '2024-01-20' order by ts, event_id limit 50""",
    "watch_checks": """with e as (select *, case when event_type <> 'error' and event_id % 7 <> 0 and event_id % 10 >= 4 then floor(value / 40)::bigint::varchar end as digest from events),
        b as (select *, last_value(digest ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as baseline, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) g from e),
        f as (select *, sum((event_type = 'error')::int) over (partition by user_id, g order by ts, event_id rows unbounded preceding)::bigint f from b), p as (select *, bool_or(f >= 3) over (partition by user_id order by ts, event_id rows unbounded preceding) p from f)
        select event_id, digest, baseline, coalesce(digest <> baseline, false) as changed, case when p then 3 else f end as failures, p as paused from p""",
    "batch_resumes": """with e as (select event_id, user_id % 3 = 0 r, list_extract(['queued', 'processing', 'completed', 'failed'], (event_id % 4 + 1)::int) s, event_id % 6 > 0 known from events),
        f as (select *, case when event_id % 4 < 2 and r then 'the batch used credentials that are not stored: submit it again' when event_id % 4 < 2 and not known then 'the request could not be rebuilt' end as error from e)
        select event_id, case when error is not null then 'failed' when event_id % 4 < 2 then 'queued' else s end as status, error from f""",
    "lookup_reports": """with e as (select event_id, event_id % 5 in (0, 4) ok, event_id % 5 k, case when event_id % 3 > 0 then event_id % 4 + 1 else 0 end n from events)
        select event_id, (case when ok then 200 when k = 3 then 502 else 503 end)::bigint as status, case when ok then null when k = 3 then 'The search provider returned an error. Please try again.' else 'Search is temporarily unavailable. Please try again later.' end as detail,
        case when ok then n else 0 end as total, ok::bigint as operations, (case when ok then 3 else 0 end)::bigint as cost_cents from e""",
    "content_diffs": """with d as (select doc_id, sha256(text) a, case doc_id % 3 when 0 then sha256(text) when 1 then sha256(text || '!') end b from documents)
        select doc_id, a is distinct from b as has_changes, case when a is distinct from b then 0.0 else 1.0 end::double as similarity, (a is distinct from b)::bigint as n, case when a is distinct from b then b end as after from d""",
    "planted_jsonld": """select page_id, s::bigint as script, pos::bigint as pos, case when s = 2 and pos = 0 then '{"a":1}' else '{"@type":"Page","id":' || page_id || '}' end as object from pages, (values (0, 0), (2, 0), (2, 1)) t(s, pos)""",
    "access_tokens": "select n_nationkey, rtrim(replace(replace(base64(encode(n_nationkey || '.' || " + _hmac("n_nationkey::varchar") + ")), '+', '-'), '/', '_'), '=') as token, case when n_nationkey % 2 = 0 then n_nationkey::bigint end as \"user\" from nation",
    "line_profiles": r"""with l as (select doc_id, list_filter(list_transform(string_split(substr(text, 1, 3000), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') l from documents),
        w as (select doc_id, l, list_distinct(flatten(list_transform(list_filter(list_concat(['# A title here'], l), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda t: t <> '')) >= 3),
          lambda x: list_filter(list_transform(regexp_split_to_array(x, '\s+'), lambda t: lower(trim(t, '.,;:!?()[]{}`''"*'))), lambda t: length(t) >= 4 and not contains(t, 'http'))))) p from l)
        select doc_id, len(l) + 3 as n, 1::bigint as nav, 2::bigint as junk, len(p) as prose, (len(list_filter(list_transform(l[1:6], lambda x: len(list_filter(string_split(regexp_replace(x, '[`*_#>|~\[\]]', ' ', 'g'), ' '), lambda t: trim(t) <> ''))), lambda k: k >= 5)) > 0)::bigint as sections, 1.0::double / (len(l) + 3) as nav_ratio from w""",
}

QUERIES = {f.__name__: f for f in (
    url_names, title_names, normal_texts, human_sizes, request_fingerprints, signed_bodies, decoded_bytes, fetch_guard, origin_gates, plan_gates, file_kinds, extract_choices, quality_scores, svg_sizes,
    sitemap_pages, robots_rules, feed_items, seed_sitemaps, link_depths, website_capture, rendered_captures, json_lines, office_files, batch_archives, assembled_jobs, job_verdicts, markdown_as_html, csv_xml_records,
    state_changes, mail_claims, mail_retries, cached_operations, cost_totals, next_checks, watch_checks, batch_resumes, lookup_reports, content_diffs, planted_jsonld, access_tokens, line_profiles,
)}
