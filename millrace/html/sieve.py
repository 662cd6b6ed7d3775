"""Facts of every element from one pass, and one way to take elements out: what the cleaning steps are made of.

A step looks each element's facts up (how many words stand below, what kinds of elements) and gives a verdict; no step searches a subtree
of its own, so a page costs the same however deep it nests.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from typing import NamedTuple

from millrace.html.tree import HEADINGS, Node

HEADING, PRE, CODE, TABLE, IMAGE, LINK, LIST, MEDIA, FIELD, REGION = (1 << i for i in range(10))
#: What kind of thing an element is, by its name.
KINDS = dict.fromkeys(HEADINGS, HEADING) | dict.fromkeys(("ul", "ol"), LIST) | dict.fromkeys(("video", "audio", "iframe"), MEDIA) | dict.fromkeys(("input", "select", "textarea"), FIELD) | {
    "pre": PRE, "code": CODE, "table": TABLE, "img": IMAGE, "a": LINK, "main": REGION, "article": REGION,
}


class Facts(NamedTuple):
    """Of what stands below an element: its words, its kinds of elements, its links, and whether its text ends in a question mark."""

    words: int
    kinds: int
    links: int
    asks: bool


class Verdict(Enum):
    KEEP, DROP, OPEN = range(3)  # OPEN: the children take the element's place


def kind(n: Node) -> int:
    return KINDS.get(n.name, 0) | (REGION if n.get("role") == "main" else 0)


def facts_of(root: Node) -> dict[int, Facts]:
    """By id() of an element, root included."""
    found: dict[int, Facts] = {}
    for n in reversed([root, *root.walk()]):  # what stands below comes first
        words = kinds = links = 0
        asks: bool | None = None
        for c in reversed(n.children):
            if isinstance(c, str):
                own = c.split()
                words += len(own)
                if asks is None and own:
                    asks = own[-1].endswith("?")
            else:
                below = found[id(c)]
                words, kinds, links = words + below.words, kinds | below.kinds | kind(c), links + below.links + (c.name == "a")
                if asks is None and below.words:
                    asks = below.asks
        found[id(n)] = Facts(words, kinds, links, bool(asks))
    return found


def sift(root: Node, verdict: Callable[[Node], Verdict]) -> list[tuple[Node, Node]]:
    """Judges every element, parents first, and what is dropped or opened goes. Gives the dropped ones, each with the element it stood in last."""
    lost: list[tuple[Node, Node]] = []
    todo = [root]
    while todo:
        parent = todo.pop()
        queue, parent.children = parent.children[::-1], []
        while queue:
            c = queue.pop()
            if isinstance(c, str):
                parent.children.append(c)
                continue
            c.parent = parent
            match verdict(c):
                case Verdict.KEEP:
                    parent.children.append(c)
                case Verdict.OPEN:
                    queue += c.children[::-1]
                    c.parent, c.children, c.gone = None, [], True
                case Verdict.DROP:
                    c.parent, c.gone = None, True
                    lost.append((c, parent))
        todo += [c for c in reversed(parent.children) if isinstance(c, Node)]
    return lost


def drop(root: Node, candidates: list[Node], judge: Callable[[Node, Facts], bool] | None = None) -> None:
    """Drops the candidates, or those of which judge is true by their facts."""
    if judge and candidates:
        facts = facts_of(root)
        candidates = [n for n in candidates if judge(n, facts[id(n)])]
    if candidates:
        doomed = {id(n) for n in candidates}
        sift(root, lambda n: Verdict.DROP if id(n) in doomed else Verdict.KEEP)
