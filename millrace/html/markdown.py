"""Markdown from a tree: ATX headings, - bullets, fenced code with its language, padded-free tables."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from millrace.html.prepare import code_language
from millrace.html.sieve import drop
from millrace.html.tree import HEADINGS, Node, tree

#: What article and faithful conversion drop.
ARTICLE_DROPS = ("script", "style", "noscript", "iframe", "form", "nav", "footer", "aside", "button", "svg", "canvas", "template")
FAITHFUL_DROPS = ("script", "style", "noscript", "iframe", "svg", "canvas", "template")
_SPECIAL = re.compile(r"([\[\]`*_])")
#: A line break among inline text until blanks are settled: half a surrogate pair, which no decoded text holds.
_BREAK = "\ud800"
#: What HTML collapses, and ends of lines of other kinds. Other blanks (no-break, ideographic) are text.
_BLANK = " \t-\r\x1c-\x1f\x85\u2028\u2029"
_BLANKS, _SETTLED = re.compile(f"[{_BLANK}]+"), re.compile(f"[{_BLANK}{_BREAK}]+")
_EDGES = _BREAK + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BLOCKY = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form header html li main nav ol p section summary table ul".split())


def _is_data(value: str) -> bool:
    return value.lstrip()[:5].lower() == "data:"


def escaped(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


class Writer:
    """Blocks separated by blank lines; inline runs with blanks collapsed."""

    def __init__(self, base: str = "", images_to_alt: bool = False):
        self.base, self.images_to_alt = base, images_to_alt

    def link(self, n: Node, label: str) -> str:
        href, label = (n.get("href") or "").strip(), label.strip()
        if not href or href.startswith("#") or href.lower().startswith("javascript:") or _is_data(href):
            return label
        if not href.startswith(("mailto:", "tel:")):
            href = self._joined(href)
        title = (n.get("title") or "").strip()
        return f"[{label}]({href}" + (f' "{title}"' if title else "") + ")" if label else f"<{href}>"

    def _joined(self, url: str) -> str:
        try:
            return urljoin(self.base, url)
        except ValueError:
            return url

    def image(self, n: Node) -> str:
        src, alt = (n.get("data-src") or n.get("src") or "").strip(), (n.get("alt") or "").strip()
        if not src:
            return ""
        if _is_data(src) or self.images_to_alt:
            return escaped(alt)
        title = (n.get("title") or "").strip()
        return f"![{alt}]({self._joined(src)}" + (f' "{title}"' if title else "") + ")"

    def inline(self, n: Node | str) -> str:
        if isinstance(n, str):
            return escaped(_BLANKS.sub(" ", n))
        if n.name == "br":
            return _BREAK
        if n.name == "img":
            return self.image(n)
        if n.name in ("code", "kbd", "samp", "tt"):
            body = _BLANKS.sub(" ", n.raw_text()).strip()
            tick = "`" * (max(map(len, re.findall("`+", body)), default=0) + 1)
            pad = " " if body[:1] == "`" or body[-1:] == "`" else ""
            return f"{tick}{pad}{body}{pad}{tick}" if body else ""
        body = "".join(map(self.inline, n.children))
        if n.name == "a":
            return self._around(body, lambda x: self.link(n, x), empty=True)
        for names, mark in ((("strong", "b"), "**"), (("em", "i"), "*"), (("del", "s", "strike"), "~~")):
            if n.name in names:
                return self._around(body, lambda x, m=mark: f"{m}{x}{m}")
        return f" {body} " if n.name in _BLOCKY else body

    @staticmethod
    def _around(body: str, mark, empty: bool = False) -> str:
        """The mark inside the body's outer blanks."""
        core = body.strip()
        if not core:
            return mark("") if empty else body
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        return f"{lead}{mark(core)}{tail}"

    def flow(self, children: list) -> list[str]:
        """Blocks of a run of children: inline ones gather into paragraphs."""
        out: list[str] = []
        run: list = []

        def close() -> None:
            text = _BLANKS.sub(" ", "".join(map(self.inline, run))).strip(_EDGES)
            text = re.sub(rf"\s*{_BREAK}\s*", "  \n", text)
            text = re.sub(r"(?m)^(\s*)([#>+=-]|\d+[.)])(?=[ \n])", r"\1\\\2", text)
            if text:
                out.append(text)
            run.clear()

        for c in children:
            if isinstance(c, Node) and self._is_block(c):
                close()
                out += self.block(c)
            else:
                run.append(c)
        close()
        return out

    @staticmethod
    def _is_block(n: Node) -> bool:
        return n.name in _BLOCKY or n.name in HEADINGS or n.name in ("pre", "hr") or (n.name in ("a", "span", "b", "strong", "em", "i", "center", "font") and n.first("pre", "table", "ul", "ol", "p", "div", "hr", *HEADINGS) is not None)

    def block(self, n: Node) -> list[str]:
        if n.name in HEADINGS:
            text = _SETTLED.sub(" ", "".join(map(self.inline, self._unstressed(n.children)))).strip()
            return [f"{'#' * int(n.name[1])} {text}"] if text else []
        if n.name == "hr":
            return ["---"]
        if n.name == "pre":
            body = n.raw_text().strip("\n")
            fence = "`" * max(3, max(map(len, re.findall("`+", body)), default=0) + 1)
            return [f"{fence}{code_language(n) or ''}\n{body}\n{fence}"] if body.strip() else []
        if n.name in ("ul", "ol"):
            return self.items(n)
        if n.name == "table":
            return self.table(n)
        if n.name == "blockquote":
            inner = "\n\n".join(self.flow(n.children))
            return ["\n".join(f"> {x}".rstrip() for x in inner.split("\n"))] if inner else []
        return self.flow(n.children)

    @staticmethod
    def _unstressed(children: list) -> list:
        """A heading's children, without emphasis that covers the whole of them: it says nothing."""
        only = [c for c in children if (c if isinstance(c, str) else c.raw_text()).strip()]
        match only:
            case [Node(name="strong" | "b" | "em" | "i") as stress]:
                return Writer._unstressed(stress.children)
        return children

    def items(self, n: Node) -> list[str]:
        out, number = [], int(n.get("start") or 1) if (n.get("start") or "1").isdigit() else 1
        for c in n.children:
            if isinstance(c, str) or c.name not in ("li", "ul", "ol"):
                continue
            blocks = self.flow(c.children) if c.name == "li" else ["\n".join(self.items(c))]
            if not blocks:
                continue
            mark = f"{number}. " if n.name == "ol" else "- "
            number += c.name == "li"
            nested = [isinstance(x, Node) and x.name in ("ul", "ol") for x in c.children]
            body = ("\n" if any(nested) or len(blocks) == 1 else "\n\n").join(blocks)
            pad = " " * len(mark)
            out.append(mark + "\n".join(x if i == 0 else (pad + x if x else x) for i, x in enumerate(body.split("\n"))))
        return ["\n".join(out)] if out else []

    def table(self, n: Node) -> list[str]:
        rows = []
        for tr in n.all("tr"):
            if next((a for a in tr.above() if a.name == "table"), None) is not n:
                continue
            rows.append([_SETTLED.sub(" ", "".join(map(self.inline, c.children))).strip().replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.name in ("td", "th")])
        rows = [r for r in rows if any(r)]
        if not rows:
            return []
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        lines = [f"| {' | '.join(r)} |" for r in rows]
        return ["\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])]


def markdown(root: Node, base: str = "", images_to_alt: bool = False, drops: tuple[str, ...] = FAITHFUL_DROPS) -> str:
    """The tree as Markdown; elements named in drops are left out, the tree loses them."""
    drop(root, root.all(*drops, "head"))
    lines = [x if x.endswith("  ") and not x.endswith("   ") else x.rstrip() for x in "\n\n".join(Writer(base, images_to_alt).flow(root.children)).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return f"{text}\n" if text else ""


def html_to_markdown(html: Node | str | None, base: str = "", article_only: bool = False) -> str:
    """Faithful conversion of a document, or of its reader view."""
    from millrace.html.content import article

    if not html or (isinstance(html, str) and not html.strip()):
        return ""
    if article_only:
        found = article(html)
        return markdown(found, base, drops=ARTICLE_DROPS) if found is not None else ""
    return markdown(tree(html), base)
