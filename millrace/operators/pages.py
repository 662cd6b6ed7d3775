"""Facts of pages by expressions: titles, headings, links, JSON-LD, link farms. Scripts and styles are taken out first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import SPACE, stripped, words


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_scripts(html: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"(?is)<script\b[^>]*>.*?</script\s*>", " "), r"(?is)<style\b[^>]*>.*?</style\s*>", " ")


def untagged(html: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), f"{SPACE}+", " "))


def title(html: Column | str, limit: int = 512) -> Column:
    """The title, else the first h1, cut; entities stay as they are."""
    c = without_scripts(html)
    named, first = (untagged(F.regexp_extract(c, rf"(?is)<{t}\b[^>]*>(.*?)</{t}\s*>", 1)) for t in ("title", "h1"))
    return F.substring(F.when(named != "", named).otherwise(first), 1, limit)


def headings(html: Column | str) -> Column:
    """array<struct<level, text>> of non-empty headings, in order."""
    c = without_scripts(html)
    pattern = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"
    levels, texts = (F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2))
    both = F.zip_with(levels, texts, lambda a, b: F.struct(a.cast("int").alias("level"), untagged(b).alias("text")))
    return F.filter(both, lambda h: h["text"] != "")


def hrefs(html: Column | str) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(without_scripts(html), F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))


def links(pages: DataFrame, page: str, html: str, base: str) -> DataFrame:
    """A row a link: page, pos, href and kind (internal to the base's registered domain, external, other)."""
    rows = pages.select(page, F.col(base).alias("__base"), F.posexplode(hrefs(html)).alias("pos", "href"))
    absolute = F.lower("href").rlike("^https?://")
    own = urls.registered_domain(urls.host("href")) == urls.registered_domain(urls.host("__base"))
    kind = F.when(absolute & own, "internal").when(absolute, "external").when(F.col("href").rlike("^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)"), "other").otherwise("internal")
    return rows.select(page, "pos", "href", kind.alias("kind"))


def json_ld(pages: DataFrame, page: str, html: str) -> DataFrame:
    """A row an object of each ld+json script, arrays flattened; what does not parse is skipped."""
    scripts = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"), F.lit(1))
    rows = pages.select(page, F.posexplode(scripts).alias("script", "raw")).withColumn("v", F.try_parse_json(F.trim("raw"))).where("v is not null")
    many = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return rows.select(page, "script", F.posexplode(many).alias("pos", "object"))


def farm_stats(html: Column | str) -> Column:
    """struct<links, words, domains> of a block of HTML: what decides whether it is a link farm."""
    targets = F.filter(hrefs(html), lambda h: F.lower(h).rlike("^https?://"))
    domains = F.array_distinct(F.transform(targets, lambda h: urls.registered_domain(urls.host(h))))
    return F.struct(F.size(hrefs(html)).alias("links"), F.size(words(untagged(without_scripts(html)))).alias("words"), F.size(domains).alias("domains"))


def is_farm(stats: Column, total: Column) -> Column:
    return (
        (stats["links"] >= 6) & (stats["words"] > 0) & (stats["words"] <= 4 * stats["links"]) & (stats["domains"] >= 4)
        & ((total == 0) | (stats["words"] <= 0.25 * total))
    )


def feed_links(html: Column | str, base: Column | str) -> Column:
    """RSS and Atom links in the first 50,000 characters, absolute; the other order of attributes adds what is new."""
    head = F.substring(F.coalesce(_col(html), F.lit("")), 1, 50_000)
    one = F.regexp_extract_all(head, F.lit(r"(?i)<link[^>]+type=[\"']application/(?:rss|atom)\+xml[\"'][^>]+href=[\"']([^\"']+)[\"']"), F.lit(1))
    two = F.regexp_extract_all(head, F.lit(r"(?i)<link[^>]+href=[\"']([^\"']+)[\"'][^>]+type=[\"']application/(?:rss|atom)\+xml[\"']"), F.lit(1))
    b = _col(base)
    full = lambda a: F.transform(a, lambda h: F.when(h.startswith("/"), F.concat(b, h)).when(h.startswith("http"), h).otherwise(F.concat(b, F.lit("/"), h)))
    first = full(one)
    return F.concat(first, F.array_distinct(F.filter(full(two), lambda h: ~F.array_contains(first, h))))


def fingerprint(markdown: Column | str, own: Column) -> Column:
    """SHA-256 of the content with its own URLs (array, the longest first, where they stand whole) folded; null and empty ones are none."""
    urls = F.filter(own, lambda u: u != "")
    folded = F.aggregate(
        F.array_sort(F.array_distinct(urls), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)),
        _col(markdown),
        lambda acc, u: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\w/.-])\Q"), F.replace(u, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\w/?#=&%~.-]*[\w/#=&%~-])")), F.lit("\x00self\x00")),
    )
    return F.sha2(folded, 256)
