"""What a converted page's Markdown is cleaned of: residue of structure, repeated blocks, numeric dumps."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import PUA, array_run

PROBE_WORDS, REPEAT_LINES, ARRAY_VALUES, ARRAY_HEAD = 30, 12, 64, 16

_BARE_HEADING = re.compile(r"\s{0,3}#{1,6}\s*")
_BARE_LINK = re.compile(r"(?<!!)\[\s*\]\([^)]*\)")
_RULE = re.compile(r"\s{0,3}([-*_])\s*(?:\1\s*){2,}")
_RUN = re.compile(array_run(ARRAY_VALUES))


def is_rule(line: str) -> bool:
    return bool(_RULE.fullmatch(line))


def truncate_arrays(text: str) -> str:
    """Runs of 64 and more comma-separated numbers keep their first 16 and a count."""

    def shorter(m: re.Match) -> str:
        values = m[0].split(",")
        head = ", ".join(v.strip() for v in values[:ARRAY_HEAD])
        return f"{head}, ... [truncated {len(values) - ARRAY_HEAD} of {len(values)} values]"

    return _RUN.sub(shorter, text)


def fenced(lines: list[str]) -> list[bool]:
    """Which lines belong to a ``` block, its fences included."""
    inside, out = False, []
    for line in lines:
        mark = line.strip().startswith("```")
        out.append(inside or mark)
        inside ^= mark
    return out


def without_residue(lines: list[str]) -> list[str]:
    """Outside code: no bare headings, bare links or metric probes, one rule for a run of them and none at either end."""
    out: list[str] = []
    last = ""  # the last line kept that is not blank
    for line, code in zip(lines, fenced(lines), strict=True):
        if not code:
            tokens = line.split()
            if _BARE_HEADING.fullmatch(line) or (len(tokens) >= PROBE_WORDS and len(set(tokens)) == 1):
                continue
            bare = _BARE_LINK.sub("", line)
            if bare != line and not bare.strip():
                continue
            line = bare
            if is_rule(line) and (not last or is_rule(last)):
                continue
        out.append(line)
        last = line if line.strip() else last
    while out and (not out[-1].strip() or is_rule(out[-1])):
        out.pop()
    return out


def without_repeats(lines: list[str]) -> list[str]:
    """Blocks of up to twelve lines that repeat at once stand once, the longest first.

    Not in code; blank blocks and single table rows stay. A block of one line over and over is that line.
    """
    code, out, at = fenced(lines), [], 0

    def repeats(size: int) -> int:
        """How often the block of that size stands here in a row, or 0."""
        block = lines[at : at + size]
        if not any(x.strip() for x in block) or any(code[at : at + size]) or (size == 1 and block[0].lstrip().startswith("|")):
            return 0
        n = 1
        while lines[at + n * size : at + (n + 1) * size] == block and not any(code[at + n * size : at + (n + 1) * size]):
            n += 1
        return n

    while at < len(lines):
        best = next(((s, n) for s in range(min(REPEAT_LINES, (len(lines) - at) // 2), 0, -1) if (n := repeats(s)) > 1), None)
        size, n = best or (1, 1)
        block = lines[at : at + size]
        out += block[:1] if len(set(block)) == 1 else block
        at += size * n
    return out


def tidy_markdown(text: str | None, arrays: bool = False) -> str | None:
    """All of it, and no more than one blank line at a time. Blank texts pass as they are."""
    if not text or not text.strip():
        return text
    lines = without_repeats(without_residue(PUA.sub("", text).split("\n")))
    done = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return (truncate_arrays(done) if arrays else done).strip() + "\n"


@F.pandas_udf(T.StringType())
def tidied(text: pd.Series) -> pd.Series:
    return text.map(tidy_markdown)


@F.pandas_udf(T.ArrayType(T.StringType()))
def repeats_collapsed(text: pd.Series) -> pd.Series:
    """Lines of a text without repeated blocks."""
    return text.map(lambda t: without_repeats((t or "").split("\n")))


@F.pandas_udf(T.StringType())
def arrays_truncated(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else truncate_arrays(t))
