"""Which rendition of a page is its main content.

A rendition is read once, line by line, into a Profile; all that is weighed afterwards are profiles. Of the candidates that keep enough of the
baseline's prose, code and sections, the one with fewest junk lines wins, then the shorter, then the earlier. The full page always stands, last.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

FLOOR, BASELINE_WORDS, CODE_WORDS, CODE_KEPT, BLOCK_KEPT, AHEAD, BODY_WORDS, MAX_ORPHANS = 0.70, 25, 3, 0.6, 0.5, 6, 5, 2

_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_HEADING = re.compile(r"(#{1,6})(?:\s+(.+?))?\s*")
_MARKS = str.maketrans("`*_#>|~[]", " " * 9)


class Selected(NamedTuple):
    markdown: str
    source: str
    retention: float
    nav_ratio: float
    fell_back: bool


class Section(NamedTuple):
    """A heading and the first line of some length below it: where that line stands without the heading, a section has lost its title."""

    weight: int
    title: str
    opening: str


def lines_of(markdown: str) -> list[str]:
    return [x for x in map(str.strip, markdown.split("\n")) if x]


def is_nav(line: str) -> bool:
    """Links and next to nothing else."""
    rest, links = _LINK.subn("", line)
    return links > 0 and len(rest.strip(" *-|>#\t")) <= 3


def nav_ratio(lines: list[str]) -> float:
    return profile(lines).nav_ratio


def flat(line: str) -> str:
    return " ".join(_LINK.sub(r"\1", line).translate(_MARKS).split()).lower()


def _words(texts: Iterable[str], strip: str, least: int) -> set[str]:
    return {w for t in texts if len(w := t.strip(strip).lower()) >= least}


@dataclass
class Profile:
    """What one pass over the lines of a rendition gathers."""

    n: int = 0
    nav: int = 0
    junk: int = 0
    prose: set[str] = field(default_factory=set)  # words of four letters, of lines of three words that are not mere links
    code: list[set[str]] = field(default_factory=list)  # words of each fenced block that has three
    sections: list[Section] = field(default_factory=list)
    text: str = ""  # all lines without marks, in lower case

    @property
    def nav_ratio(self) -> float:
        return self.nav / self.n if self.n else 0.0

    def prose_of(self, base: Profile) -> float:
        """Share of the baseline's prose words that stand here."""
        return len(self.prose & base.prose) / len(base.prose) if base.prose else 1.0

    def code_of(self, base: Profile) -> float:
        """Share of the baseline's code blocks of which half the words or more are in code here."""
        own = set().union(*self.code)
        kept = [len(block & own) >= BLOCK_KEPT * len(block) for block in base.code]
        return sum(kept) / len(kept) if kept else 1.0

    def lost_of(self, base: Profile) -> int:
        """Weight of the baseline's sections that stand here without their title."""
        return sum(s.weight for s in base.sections if s.opening in self.text and s.title not in self.text)


def profile(lines: list[str]) -> Profile:
    """Of stripped lines without empty ones. A block of code that the end cuts off counts."""
    p, flats = Profile(n=len(lines)), []
    fenced: set[str] | None = None
    open_: tuple[int, str, int] | None = None  # level, title and line of a heading whose opening is still to come
    for at, line in enumerate(lines):
        plain = flat(line)
        flats.append(plain)
        nav, heading = is_nav(line), _HEADING.fullmatch(line)
        p.nav += nav
        p.junk += nav or bool(heading and not heading[2])
        if line.startswith("```"):
            if fenced is not None and len(fenced) >= CODE_WORDS:
                p.code.append(fenced)
            fenced = set() if fenced is None else None
        elif fenced is not None:
            fenced |= _words(line.split(), ".,;:!?()[]{}'\"", 3)
        shown = _LINK.sub(r"\1", line).split()
        if not nav and len(shown) >= 3:
            p.prose |= {w for w in _words(shown, ".,;:!?()[]{}`'\"*", 4) if "http" not in w}
        if heading and heading[2]:
            title = flat(heading[2])
            open_ = (len(heading[1]), title, at) if len(title) >= 3 else None
        elif open_ and at - open_[2] <= AHEAD and len(plain.split()) >= BODY_WORDS:
            p.sections.append(Section(2 if open_[0] == 1 else 1, open_[1], plain))
            open_ = None
    if fenced is not None and len(fenced) >= CODE_WORDS:
        p.code.append(fenced)
    p.text = " ".join(flats)
    return p


def elect(candidates: list[tuple[str, str]], full_page: str, baseline: str | None = None) -> Selected:
    """Of (source, markdown) candidates, the main content."""
    full, base = profile(lines_of(full_page)), profile(lines_of(baseline or full_page))
    fallback = Selected(full_page, "full_page", 1.0, full.nav_ratio, True)
    standing = [(fallback, (full.junk, len(full_page), len(candidates)))]
    for place, (source, text) in enumerate(candidates):
        p = profile(lines_of(text))
        if not p.n or p.code_of(base) < CODE_KEPT or p.lost_of(base) >= MAX_ORPHANS:
            continue
        found = Selected(text, source, p.prose_of(base), p.nav_ratio, False)
        if len(base.prose) < BASELINE_WORDS:  # too little to measure against: only the structural strip is trusted
            if source == "structural":
                return found
        elif found.retention >= FLOOR:
            standing.append((found, (p.junk, len(text), place)))
    return min(standing, key=lambda x: x[1])[0]
