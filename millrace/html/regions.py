"""Questions that preparation and stripping both ask of an element."""

from __future__ import annotations

import re

from millrace.html.sieve import REGION, kind
from millrace.html.tree import Node

#: Inline styles, without blanks, that hide an element.
HIDING_STYLES = ("display:none", "visibility:hidden", "opacity:0;", "opacity:0}", "left:-999", "left:-9999", "top:-999", "top:-9999", "text-indent:-999")
_STREAMED = re.compile(r"[A-Za-z]:\d+")


def hides(style: str | None) -> bool:
    compact = (style or "").replace(" ", "").lower()
    return any(h in compact for h in HIDING_STYLES)


def in_region(n: Node) -> bool:
    return any(kind(a) & REGION for a in n.above())


def controlled(root: Node) -> set[str]:
    """Ids that some control shows and hides."""
    return {i for n in root.walk() for i in (n.get("aria-controls") or "").split()}


def is_deferred(n: Node, ids: set[str]) -> bool:
    """A panel of the content that is merely not shown yet: a tab's or a controlled one, in the main region."""
    panel = (n.get("role") or "").strip().lower() in ("tabpanel", "region") or n.get("id") in ids
    return panel and in_region(n)


def is_streamed(n: Node) -> bool:
    """Hidden, with an id like S:1: content that a script puts in its place."""
    return n.get("hidden") is not None and bool(_STREAMED.fullmatch(n.get("id") or ""))
