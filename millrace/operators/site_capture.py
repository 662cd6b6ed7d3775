"""Capture of whole websites over tables: discover, gate, convert each URL by itself, bundle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import member_name
from millrace.html.pages import to_markdown
from millrace.operators.ledger import batch_gate, crawl_gate
from millrace.operators.url_list import breadth_first
from millrace.sources.sinks import bundles


def discovered(links: DataFrame, sites: DataFrame, depth: int, most: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(site, url, depth, place, truncated): pages of each site (site, url: where it starts) within depth steps of links, nearest first, then by URL; at most most of them.

    Only pages of the site's own domain that no trap leads to. A link table that lacks the start gives the start alone.
    """
    start = sites.select("site", F.col("url").alias("root"), urls.host("url").alias("home"))
    own = links.join(start.select("home").distinct(), urls.host(dst) == F.col("home")).select(src, dst).where(urls.is_page(dst) & ~urls.is_trap(dst)).distinct()
    reached = breadth_first(own, sites.select("url"), src, dst, depth)
    rows = reached.join(start, urls.host("url") == F.col("home")).select("site", "url", "depth")
    place = Window.partitionBy("site").orderBy("depth", "url")
    rows = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most + 1)
    over = F.max("place").over(Window.partitionBy("site")) > most
    return rows.withColumn("truncated", over).where(F.col("place") <= most)


def gated(found: DataFrame, projects: DataFrame, mode: str) -> DataFrame:
    """found (site, ...) of the sites whose project (site, crawl_level, batch_limit) may crawl in that mode and take so many pages; the others as (site, reason)."""
    n = found.groupBy(F.col("site").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    told = projects.join(n, F.col("site") == F.col("s"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(~crawl_gate(F.col("crawl_level"), F.lit(mode)), "crawling is not in the plan").when(~batch_gate(F.col("batch_limit"), F.col("n")), "more pages than the plan allows")
    told = told.select(F.col("site").alias("s"), reason.alias("reason"))
    return found.join(told, F.col("site") == F.col("s")).drop("s")


def captured(found: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """found with member, markdown, html and error: each URL stands or falls by itself. Pages that were not fetched, or give no text, are errors."""
    body = pages.select(F.col(url).alias("u"), F.col(html).alias("html")).dropDuplicates(["u"])
    rows = found.join(body, F.col("url") == F.col("u"), "left").drop("u").withColumn("kept_html", F.col("html"))
    rows = to_markdown(rows)
    empty = F.length(F.trim(F.coalesce("markdown", F.lit("")))) == 0
    error = F.when(F.col("kept_html").isNull(), "the page could not be fetched").when(empty, "no extractable content")
    return rows.withColumn("error", error).withColumn("markdown", F.when(error.isNull(), F.col("markdown"))).withColumnRenamed("kept_html", "html").withColumn("member", member_name(F.col("place") - 1, "url"))


def website(links: DataFrame, sites: DataFrame, projects: DataFrame, pages: DataFrame, mode: str = "full", depth: int = 10, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Pages of the sites that may be captured, each with its Markdown, HTML or error; and a job's row a site: status, reason, pages, failed, truncated.

    A job without a page converted has failed; one with some has completed.
    """
    found = gated(discovered(links, sites, depth, most), projects, mode)
    done = captured(found.where("reason is null").drop("reason"), pages)
    ok = F.col("error").isNull()
    jobs = done.groupBy("site").agg(F.count_if(ok).alias("pages"), F.count_if(~ok).alias("failed"), F.bool_or("truncated").alias("truncated"), F.min_by("error", F.when(~ok, F.col("place"))).alias("reason"))
    jobs = jobs.withColumn("status", F.when(F.col("pages") > 0, "completed").otherwise("failed")).withColumn("reason", F.when(F.col("pages") == 0, F.col("reason")))
    denied = found.where("reason is not null").groupBy("site").agg(F.first("reason").alias("reason")).select("site", F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("failed"), F.lit(False).alias("truncated"), "reason", F.lit("denied").alias("status"))
    return done, jobs.unionByName(denied)


def site_bundles(captured_: DataFrame, body: str = "markdown") -> DataFrame:
    """site, content: a ZIP of a site's pages, as Markdown or (body='html') as they were rendered."""
    rows = captured_.where("error is null").select("site", "place", "url", F.col(body).alias("body"))
    return bundles(rows, "site", "place", "url", "body")


def rendered_key(env: str, project: Column, job: Column) -> Column:
    """Where a job's rendered HTML is kept."""
    return F.concat(F.lit(f"{env}/rendered/"), project.cast("string"), F.lit("/"), job.cast("string"), F.lit(".html"))


def rendered_captures(pages: DataFrame, env: str, project: str, job: str, html: str, skip: str, at: Column, days: int = 90) -> DataFrame:
    """project, job, rendered_html_key, content_hash and delete_at of rendered pages; none where capture was declined or there is no HTML. Observability: nothing fails for it."""
    rows = pages.where(~F.coalesce(F.col(skip), F.lit(False)) & (F.length(F.coalesce(F.col(html), F.lit(""))) > 0))
    return rows.select(project, job, rendered_key(env, F.col(project), F.col(job)).alias("rendered_html_key"), F.sha2(html, 256).alias("content_hash"), (at + F.make_dt_interval(days=F.lit(days))).alias("delete_at"))
