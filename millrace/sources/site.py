"""What a site says of its pages: sitemaps, robots.txt, feeds. Bodies come from a table; fetching is a connector's."""

from __future__ import annotations

import gzip
from collections.abc import Callable
from typing import Any
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut

AGENT = "millrace"


def sitemap_locations(xml: Column | str) -> Column:
    """struct<is_index, locs> of a sitemap's text, JVM-side; names with or without a namespace. Null for what is neither."""
    c = F.col(xml) if isinstance(xml, str) else xml
    root = F.regexp_extract(c, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:\w+:)?(urlset|sitemapindex)\b", 1)
    locs = F.regexp_extract_all(c, F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>.*?<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    clean = F.transform(F.filter(locs, lambda x: x != ""), lambda x: F.replace(F.replace(F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))
    return F.when(root != "", F.struct((root == "sitemapindex").alias("is_index"), clean.alias("locs")))


def sitemap_urls(sitemaps: DataFrame, start: DataFrame, url: str = "url", body: str = "body", rounds: int = 50) -> DataFrame:
    """(root, pos_path, url) of all pages below the root sitemaps in start (url), over a table of sitemap bodies.

    Fail-soft: a root of which any part is missing or unreadable gives nothing. Indexes are followed breadth first, each sitemap
    once a root, so a cycle ends.
    """
    table = sitemaps.select(F.col(url).alias("at"), sitemap_locations(body).alias("s"))
    edge = start.select(F.col(url).alias("root"), F.col(url).alias("at"), F.lit("").alias("pos_path")).distinct()
    seen, pages, broken = edge.select("root", "at"), None, None
    for _ in range(rounds):
        read = edge.join(table, "at", "left")
        bad = read.where("s is null").select("root")
        broken = bad if broken is None else broken.union(bad)
        deeper = read.where("s is not null").select("root", "pos_path", "s.is_index", F.posexplode("s.locs").alias("i", "loc")).withColumn("pos_path", F.concat("pos_path", F.format_string("/%06d", "i")))
        found = deeper.where("not is_index").select("root", "pos_path", F.col("loc").alias("url"))
        pages = found if pages is None else pages.union(found)
        edge = cut(deeper.where("is_index").groupBy("root", F.col("loc").alias("at")).agg(F.min("pos_path").alias("pos_path")).join(seen, ["root", "at"], "left_anti").select("root", "at", "pos_path"))
        if not edge.take(1):
            break
        seen = seen.union(edge.select("root", "at"))
    return pages.join(broken.distinct(), "root", "left_anti")


def parse_sitemap(fetch: Callable[[str], bytes | None], url: str) -> list[str]:
    """The same for one root and a fetch function, depth first in order."""

    def read(at: str, above: tuple[str, ...]) -> list[str]:
        raw = fetch(at)
        if raw is None:
            raise ValueError(f"{at} cannot be fetched")
        raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        try:
            root = ElementTree.fromstring(raw)
        except ElementTree.ParseError as e:
            raise ValueError(f"{at} is no XML") from e
        kind = root.tag.rpartition("}")[2]
        if kind not in ("urlset", "sitemapindex"):
            raise ValueError(f"{at} is a {kind}")
        locs = [t for e in root if e.tag.rpartition("}")[2] in ("url", "sitemap") for x in e if x.tag.rpartition("}")[2] == "loc" and (t := (x.text or "").strip())]
        return locs if kind == "urlset" else [u for x in locs if x not in above for u in read(x, (*above, x))]

    try:
        return read(url, (url,))
    except (ValueError, OSError, EOFError):
        return []


def robots(body: str | None, agent: str = AGENT) -> dict[str, Any]:
    """sitemaps, crawl_delay and can_fetch of a robots.txt; none (null) allows all.

    A User-agent line replaces the one before it for the delay; our own beats *.
    """
    lines = [x.strip() for x in (body or "").splitlines()]
    field = lambda x: (x.partition(":")[0].strip().lower(), x.partition(":")[2].strip())
    maps, delays, at = [], {}, None
    for k, v in map(field, lines):
        if k == "sitemap" and v:
            maps.append(v)
        elif k == "user-agent":
            at = v.lower()
        elif k == "crawl-delay":
            try:
                delays[at] = float(v)
            except ValueError:
                continue
    parser = RobotFileParser()
    parser.parse(lines)
    return {"sitemaps": maps, "crawl_delay": delays.get(agent.lower(), delays.get("*")), "can_fetch": lambda u: body is None or parser.can_fetch(agent, u)}


_ROBOTS = T.StructType().add("sitemaps", T.ArrayType(T.StringType())).add("crawl_delay", "double")


@F.pandas_udf(_ROBOTS)
def robots_facts(body: pd.Series) -> pd.DataFrame:
    found = [robots(b) for b in body]
    return pd.DataFrame({"sitemaps": [f["sitemaps"] for f in found], "crawl_delay": [f["crawl_delay"] for f in found]})


@F.pandas_udf(T.BooleanType())
def robots_allow(body: pd.Series, url: pd.Series) -> pd.Series:
    """Whether the robots.txt beside a URL (null: none) lets it be fetched; each distinct body is parsed once a batch."""
    parsed = {b: robots(b) for b in set(body)}
    return pd.Series([u is not None and parsed[b]["can_fetch"](u) for b, u in zip(body, url, strict=True)])


def feed_urls(xml: Column | str) -> Column:
    """RSS items' links, then Atom entries' (alternate, else the first)."""
    c = F.col(xml) if isinstance(xml, str) else xml
    items = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1)), lambda i: F.trim(F.regexp_extract(i, r"(?s)<link>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</link>", 1)))

    def entry(e: Column) -> Column:
        all_ = F.regexp_extract_all(e, F.lit(r"(<link\b[^>]*>)"), F.lit(1))
        chosen = F.coalesce(F.try_element_at(F.filter(all_, lambda x: x.rlike("rel\\s*=\\s*[\"']alternate[\"']")), F.lit(1)), F.try_element_at(all_, F.lit(1)))
        return F.trim(F.coalesce(F.regexp_extract(chosen, "href\\s*=\\s*[\"']([^\"']*)[\"']", 1), F.lit("")))

    entries = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1)), entry)
    return F.filter(F.concat(items, entries), lambda x: x != "")


#: Paths a crawl of a whole site leaves out unless told otherwise.
CRAWL_EXCLUDES = (r"/(login|logout|signin|signup|register|cart|checkout|account)(/|$)", r"[?&](replytocom|share|print)=")


def crawl(links_of: Callable[[str], list[str]], start: str, most: int, depth: int = 10, same_domain: bool = True, exclude: tuple[str, ...] = CRAWL_EXCLUDES, per_pattern: int = 20) -> list[str]:
    """URLs fetched from start, first found first: at most most fetches and depth steps, each page once (a trailing slash tells none apart).

    The frontier holds at most five times most; repeated segments and the twenty-first page of a path's pattern are left out. A page that
    cannot be fetched has no links.
    """
    import re
    from collections import Counter, deque
    from urllib.parse import urljoin, urlsplit

    from millrace.functions.urls import canonical

    def pattern(u: str) -> str:
        return "/".join("{N}" if p.isdigit() else "{DATE}" if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", p) else p for p in urlsplit(u).path.split("/"))

    def is_trap(u: str) -> bool:
        parts = [p for p in urlsplit(u).path.split("/") if p]
        return len(parts) > 4 and len(set(parts)) < len(parts)

    home, out, seen, patterns = (urlsplit(start).hostname or "").lower(), [], set(), Counter()
    frontier = deque([(start, 0)])
    while frontier and len(out) < most:
        url, at = frontier.popleft()
        key = canonical(url).rstrip("/")
        if key in seen or is_trap(url) or any(re.search(e, url) for e in exclude) or patterns[pattern(url)] >= per_pattern:
            continue
        seen.add(key)
        patterns[pattern(url)] += 1
        out.append(url)
        if at == depth:
            continue
        try:
            found = links_of(url)
        except OSError:
            continue
        for href in found:
            try:
                full = urljoin(url, href)
                host = (urlsplit(full).hostname or "").lower()
            except ValueError:
                continue
            if urlsplit(full).scheme in ("http", "https") and (not same_domain or host == home or host.endswith(f".{home}")) and len(frontier) < 5 * most:
                frontier.append((full, at + 1))
    return out
