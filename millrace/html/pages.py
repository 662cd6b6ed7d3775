"""Pages to Markdown: one Arrow pass a batch of pages, no shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tidy import tidy_markdown
from millrace.html.content import guard_baseline, main_content, main_region
from millrace.html.election import Selected, elect
from millrace.html.markdown import html_to_markdown, markdown
from millrace.html.prepare import prepared
from millrace.html.tree import Node
from millrace.session import spread

#: A body of another kind is cut at so many characters, with a note.
RAW_CAP = 8 << 20
FELL_BACK = "main content could not be told apart: the full page was kept"
TRUNCATED = "long numeric arrays were truncated"


def renditions(page: Node, url: str, images_to_alt: bool = True) -> tuple[list[tuple[str, str]], str, str]:
    """Candidates (source, markdown), the full page and the baseline, of a prepared page, which is left as it is."""
    write = lambda root: markdown(root, url, images_to_alt)
    found, out = main_content(page), []
    if found.aborted:
        stripped = write(found.stripped)
    else:
        out.append(("structural", write(found.root)))
    out.append(("readability", html_to_markdown(page, url, article_only=True)))
    region = main_region(page)
    if region is not None:
        out.append(("main_region", write(main_content(_rooted(region)).root)))
    if found.aborted:
        out.append(("structural_unguarded", stripped))
    return [c for c in out if c[1].strip()], write(page.copy()), write(guard_baseline(page))


def _rooted(n: Node) -> Node:
    """The element as the only one of a page."""
    root = Node("#root")
    root.append(n.copy())
    return root


def main_markdown(html: str, url: str, truncate_arrays: bool = True, images_to_alt: bool = True) -> tuple[str, Selected, list[str]]:
    """The elected rendition, tidied; what was elected; warnings."""
    candidates, full, baseline = renditions(prepared(html), url, images_to_alt)
    chosen = elect(candidates, full, baseline)
    text = tidy_markdown(chosen.markdown, truncate_arrays) or ""
    warnings = [FELL_BACK] * chosen.fell_back
    # repeated blocks that stand once make a text shorter too: only arrays that were cut are worth the note
    if truncate_arrays and len(text) < 0.5 * len(chosen.markdown) and text != (tidy_markdown(chosen.markdown) or ""):
        warnings.append(TRUNCATED)
    return text, chosen, warnings


def full_markdown(html: str, url: str, truncate_arrays: bool = False) -> str:
    """The page with its furniture."""
    return tidy_markdown(markdown(prepared(html, chrome=False), url), truncate_arrays) or ""


def body_markdown(body: str, category: str | None, url: str) -> tuple[str, str, list[str]]:
    """Markdown, its source and warnings of a body of any kind: JSON is fenced, text stands as it is, HTML is converted (main, else full, else raw)."""
    if category in ("json", "text"):
        cut = body[:RAW_CAP] + "\n[truncated]" if len(body) > RAW_CAP else body
        if category == "text":
            return cut, "text", []
        try:
            cut = json.dumps(json.loads(cut), indent=2, ensure_ascii=False)
        except ValueError:
            pass
        ticks = "`" * max(3, 1 + max((len(x) for x in cut.split("\n") if x and set(x) == {"`"}), default=0))
        return f"{ticks}json\n{cut}\n{ticks}\n", "json", []
    try:
        text, chosen, warnings = main_markdown(body, url)
        if text.strip():
            return text, chosen.source, warnings
        text = full_markdown(body, url)
        return (text, "full_page", [FELL_BACK]) if text.strip() else (body, "raw", [FELL_BACK])
    except RecursionError:  # a tree deeper than the interpreter goes
        return body, "raw", [FELL_BACK]


def to_markdown(pages: DataFrame, html: str = "html", url: str = "url", category: Column | None = None) -> DataFrame:
    """pages without html, with markdown, markdown_source, retention, nav_ratio and warnings. category: json, text or null."""
    kept = [c for c in pages.columns if c != html]
    rows = pages.select(F.struct(*kept).alias("row"), F.col(html).alias("body"), F.col(url).alias("at"), (category if category is not None else F.lit(None).cast("string")).alias("category"))

    @F.pandas_udf("markdown string, markdown_source string, warnings array<string>")
    def convert(body: pd.Series, at: pd.Series, kind: pd.Series) -> pd.DataFrame:
        done = [body_markdown(b or "", k, u or "") for b, u, k in zip(body, at, kind, strict=True)]
        return pd.DataFrame(done, columns=["markdown", "markdown_source", "warnings"])

    return spread(rows).withColumn("m", convert("body", "at", "category")).select("row.*", "m.*")


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page, html, url in zip(pdf["page"], pdf["html"], pdf["url"], strict=True):
            found, full, baseline = renditions(prepared(html), url or "")
            rows.append((page, [{"source": s, "markdown": m} for s, m in found], full, baseline))
        yield pd.DataFrame(rows, columns=["page", "candidates", "full_page", "baseline"])


def candidates(pages: DataFrame, page: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page, candidates (array of source and markdown), full_page, baseline: what the election is held over."""
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(html).alias("html"), F.col(url).alias("url"))
    return spread(rows).mapInPandas(_candidates, "page long, candidates array<struct<source:string,markdown:string>>, full_page string, baseline string")
