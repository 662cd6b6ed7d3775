"""Captures of pages and what changes between them."""

from __future__ import annotations

import hashlib
import json
from typing import Any
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.html.content import registrable
from millrace.html.pages import main_markdown
from millrace.html.tree import HEADINGS, Node, parse
from millrace.session import spread

TEXT_CHARS, VALUE_CHARS, TABLE_ROWS = 200_000, 2_000, 2


def metadata(root: Node) -> dict[str, str]:
    """Title, description, language, canonical URL and named metas of a page."""
    out: dict[str, str] = {}
    title = root.first("title")
    if title is not None and title.text():
        out["title"] = title.text()
    html = root.first("html")
    if html is not None and html.get("lang"):
        out["language"] = html.get("lang")
    for m in root.all("meta"):
        name, value = (m.get("name") or m.get("property") or "").lower(), (m.get("content") or "").strip()
        if name and value:
            out.setdefault(name, value)
    for link in root.select("link[rel=canonical]"):
        out.setdefault("canonical", link.get("href") or "")
    return out


def page_links(root: Node, url: str) -> dict[str, list[dict]]:
    """href, text, title and base_domain, each href once: of the page's registered domain, and others."""
    out: dict[str, list[dict]] = {"internal": [], "external": []}
    seen, own = set(), registrable(urlsplit(url).hostname or "")
    for a in root.all("a"):
        try:
            href = urljoin(url, (a.get("href") or "").strip())
            host = urlsplit(href).hostname or ""
        except ValueError:
            continue
        if urlsplit(href).scheme in ("http", "https") and host and href not in seen:
            seen.add(href)
            out["internal" if registrable(host) == own else "external"].append({"href": href, "text": a.text(), "title": a.get("title") or "", "base_domain": registrable(host)})
    return out


def images(root: Node, url: str) -> list[dict]:
    """src, alt, desc (the caption of its figure), width and format of images that have a source."""
    out = []
    for i in root.all("img"):
        src = (i.get("data-src") or i.get("src") or "").strip()
        if src:
            figure = next((a for a in i.above() if a.name == "figure"), None)
            caption = figure.first("figcaption") if figure is not None else None
            ending = src.split("?")[0].rpartition(".")[2].lower()
            out.append({"src": urljoin(url, src), "alt": i.get("alt") or "", "desc": caption.text() if caption is not None else "", "width": i.get("width"), "format": ending if len(ending) <= 4 else None})
    return out


def table_score(t: Node) -> int:
    """Signs of data: a head, header cells, a caption or summary, even rows, few nested tables; layout loses."""
    rows = [[c for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in t.all("tr")]
    rows = [r for r in rows if r]
    if len(rows) < TABLE_ROWS:
        return 0
    widths = {len(r) for r in rows}
    score = 3 * (t.first("thead") is not None) + 3 * (t.first("th") is not None) + 2 * (t.first("caption") is not None or "summary" in t.attrs)
    score += 2 * (len(widths) == 1) + 2 * (max(widths) > 1) + (len(rows) > 3) + 2 * (t.n_words() >= 2 * len(rows))
    return score - 3 * (t.first("table") is not None) - 8 * (t.get("role") in ("presentation", "none"))


def tables(root: Node, threshold: int = 7) -> list[dict]:
    """headers, rows and caption of tables that score as data."""
    out = []
    for t in root.all("table"):
        if table_score(t) < threshold:
            continue
        grid = [[c.text() for c in r.children if isinstance(c, Node) and c.name in ("td", "th")] for r in t.all("tr")]
        grid = [g for g in grid if g]
        caption = t.first("caption")
        out.append({"headers": grid[0] if t.first("th") is not None else [], "rows": grid[1:] if t.first("th") is not None else grid, "caption": caption.text() if caption is not None else ""})
    return out


def json_ld(root: Node) -> list[dict]:
    out: list[dict] = []
    for s in root.all("script"):
        if (s.get("type") or "").lower() == "application/ld+json":
            try:
                data = json.loads(s.raw_text())
            except ValueError:
                continue
            out += [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]
    return out


def headings(root: Node) -> list[dict]:
    return [{"level": int(h.name[1]), "text": t} for h in root.all(*HEADINGS) if (t := h.text())]


def capture(body: str, url: str, category: str | None = None, most: int | None = TEXT_CHARS) -> dict[str, Any]:
    """text (main content, at most so many characters; None: all) and structured: metadata, tables, links, structured_data. Bodies of another kind are text alone."""
    if category is not None:
        return {"text": body[:most], "structured": {"metadata": {}, "tables": [], "links": {"internal": [], "external": []}, "structured_data": []}}
    root = parse(body)
    text = main_markdown(body, url)[0]
    return {"text": text[:most], "structured": {"metadata": metadata(root), "tables": tables(root), "links": page_links(root, url), "structured_data": json_ld(root)}}


def capture_hash(c: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps({"text": c["text"], "structured": c["structured"]}, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def bundle(body: str, url: str, outputs: list[str], most: int = 50_000) -> dict[str, Any]:
    """The structured outputs asked for of a page: title, headings, links, images, tables, metadata, structured_data, main_content, cleaned_html."""
    root = parse(body)
    made = {
        "title": lambda: (metadata(root).get("title") or next((h["text"] for h in headings(root) if h["level"] == 1), ""))[:512],
        "headings": lambda: headings(root), "links": lambda: page_links(root, url), "images": lambda: images(root, url), "tables": lambda: tables(root),
        "metadata": lambda: metadata(root), "structured_data": lambda: json_ld(root), "main_content": lambda: main_markdown(body, url)[0][:most], "cleaned_html": lambda: cleaned(body),
    }
    return {k: made[k]() for k in outputs if k in made}


def cleaned(body: str) -> str:
    """The page without scripts, styles, comments and most attributes."""
    root = parse(body)
    for n in root.all("script", "style", "noscript", "template", "iframe", "svg", "canvas"):
        if not n.gone:
            n.remove()
    for n in root.walk():
        n.attrs = {k: v for k, v in n.attrs.items() if k in ("href", "src", "alt", "title", "colspan", "rowspan", "lang")}
    return root.html()


_CAPTURE = T.StructType().add("text", "string").add("structured", "string").add("content_hash", "string")


def captures(pages: DataFrame, html: str = "html", url: str = "url", most: int | None = TEXT_CHARS) -> DataFrame:
    """pages with capture_text, structured (JSON) and content_hash in place of html."""

    @F.pandas_udf(_CAPTURE)
    def run(bodies: pd.Series, urls: pd.Series) -> pd.DataFrame:
        made = [capture(b or "", u or "", most=most) for b, u in zip(bodies, urls, strict=True)]
        return pd.DataFrame([(c["text"], json.dumps(c["structured"], ensure_ascii=False, sort_keys=True), capture_hash(c)) for c in made], columns=["text", "structured", "content_hash"])

    kept = [c for c in pages.columns if c != html]
    return spread(pages).select(*kept, run(html, url).alias("c")).select(*kept, F.col("c.text").alias("capture_text"), "c.structured", "c.content_hash")


_CHANGE = "array<struct<section:string,kind:string,key:string,field:string,before:string,after:string>>"


def diff(before: str, after: str):
    """struct<has_changes, similarity, changes> of two hash columns: equal or not, all or nothing."""
    from millrace.functions.text import capped

    a, b = F.col(before), F.col(after)
    change = F.array(F.struct(F.lit("text").alias("section"), F.lit("modified").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit("content_hash").alias("field"), capped(a, VALUE_CHARS).alias("before"), capped(b, VALUE_CHARS).alias("after")))
    differs = ~a.eqNullSafe(b)
    return F.struct(differs.alias("has_changes"), F.when(differs, 0.0).otherwise(1.0).alias("similarity"), F.when(differs, change).otherwise(F.array().cast(_CHANGE)).alias("changes"))


def tracked_terms(terms: Any) -> list[str] | None:
    """A list's terms, or a map's keys and those of its values that are lists."""
    found: list = []
    if isinstance(terms, list):
        found = terms
    elif isinstance(terms, dict):
        for k, v in terms.items():
            found += [k, *(v if isinstance(v, list) else [])]
    return [t for t in (str(x).strip() for x in found) if t] or None
