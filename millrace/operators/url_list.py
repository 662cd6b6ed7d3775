"""From raw URLs of many sources to the pages worth fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.windows import first_n
from millrace.session import cut


def frontier(
    raw: DataFrame, base_host: str | Column, url: str = "url", order: str = "pos", by: list[str] | None = None, same_domain: bool = True, assets: bool = False,
    include: list[str] | None = None, exclude: list[str] | None = None, allowed: Column | None = None, most: int | None = None, exact: bool = False,
) -> DataFrame:
    """URLs in canonical form, filtered, first of each, at most most of them (by group), with their rank and truncated.

    truncated: one more distinct URL had passed every filter. exact: canonical form by the Arrow UDF (percent escapes), else by expressions.
    The cap is a feature of a request; leave it out and nothing is cut.
    """
    by = by or []
    rows = raw.where(F.col(url).isNotNull()).withColumn("url_raw", F.trim(F.col(url))).where(urls.scheme_guard("url_raw"))
    rows = rows.withColumn("canonical", urls.canonical_url("url_raw") if exact else urls.canonical_expr("url_raw")).where(F.col("canonical").isNotNull())
    if same_domain:
        rows = rows.where(urls.same_domain("canonical", base_host))
    if not assets:
        rows = rows.where(urls.is_page("canonical"))
    if include:
        rows = rows.where(F.col("canonical").rlike("|".join(f"(?:{p})" for p in include)))
    if exclude:
        rows = rows.where(~F.col("canonical").rlike("|".join(f"(?:{p})" for p in exclude)))
    if allowed is not None:
        rows = rows.where(allowed)
    once = rows.groupBy(*by, "canonical").agg(F.min(order).alias(order))
    if most is None:
        return once
    if not by:  # a plain top-k first: no task orders the whole list
        once = once.orderBy(order, "canonical").limit(most + 1)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "canonical")))
    ranked = ranked.where(F.col("rank") <= most + 1)
    over = F.max(F.col("rank")).over(Window.partitionBy(*by)) > most
    return ranked.withColumn("truncated", over).where(F.col("rank") <= most)


def folded(pages: DataFrame, url: str, order: list) -> DataFrame:
    """The first of URLs that differ in scheme, www, port, trailing slash or fragment alone."""
    w = Window.partitionBy(urls.fold_key(url)).orderBy(*order)
    return pages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_traps(pages: DataFrame, url: str, order: list, per_pattern: int = 20, by: list[str] | None = None) -> DataFrame:
    """No paths that repeat a segment, and of each pattern of path the first twenty."""
    rows = pages.where(~urls.is_trap(url)).withColumn("pattern", urls.pattern_of(url))
    return first_n(rows, [*(by or []), "pattern"], order, per_pattern)


def provenance(raw: DataFrame, source: str = "source", by: list[str] | None = None) -> DataFrame:
    """How many URLs each source gave, before any is dropped."""
    return raw.groupBy(*(by or []), source).agg(F.count(F.lit(1)).alias("n"))


def seeds(robots: DataFrame, probes: DataFrame, site: str = "site") -> DataFrame:
    """Sitemaps of a site: those its robots.txt names and /sitemap.xml if it is there; else the first common path that is.

    robots: (site, sitemap). probes: (site, url, rank, found); rank 0 is /sitemap.xml.
    """
    named = robots.select(site, F.col("sitemap").alias("url"), F.lit(-1).alias("rank"))
    hits = probes.where("found").select(site, "url", "rank")
    every = named.union(hits)
    primary = F.max((F.col("rank") <= 0).cast("int")).over(Window.partitionBy(site)) == 1
    low = F.min("rank").over(Window.partitionBy(site))
    return every.withColumn("__p", primary).withColumn("__l", low).where((F.col("__p") & (F.col("rank") <= 0)) | (~F.col("__p") & (F.col("rank") == F.col("__l")))).select(site, "url").distinct()


def breadth_first(links: DataFrame, start: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """(url, depth) reached from start (url) in at most depth steps over a table of links; each round is one join against what is new, and the last one finds nothing."""
    reached = cut(start.select("url").distinct().withColumn("depth", F.lit(0)))
    edge = reached
    for d in range(1, depth + 1):
        found = edge.join(links, F.col("url") == F.col(src)).select(F.col(dst).alias("url")).distinct()
        edge = cut(found.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if not edge.take(1):
            break
        reached = reached.union(edge)
    return reached
