"""Heading-aware chunks of Markdown, for retrieval.

A scanner turns lines into blocks, sections gather blocks under their h1-h3 path, and a packer fills chunks with
atoms (sentences, whole code blocks, tables, list items) up to a word limit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

MAX_WORDS, OVERLAP = 512, 1
#: Bounds of what a request may ask for.
WORD_BOUNDS, OVERLAP_BOUNDS = (32, 4000), (0, 10)
#: A longer "heading" is prose that begins with #.
HEADING_WORDS = 32

_HEADING = re.compile(r"(#{1,6})\s+(.*\S)\s*")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")
_RULE_CELL = re.compile(r":?-+:?")
_STOP = re.compile(r"(?<=[.!?])\s+")


class Block(NamedTuple):
    kind: str
    text: str
    level: int = 0


class Atom(NamedTuple):
    kind: str
    text: str
    block: int


class Chunk(NamedTuple):
    text: str
    headings_path: tuple[str, ...]
    section: str
    word_count: int


def n_words(text: str) -> int:
    return len(text.split())


def sentences(text: str) -> list[str]:
    return [s for s in map(str.strip, _STOP.split(text.strip())) if s]


def _separates(line: str) -> bool:
    """A table's second row: cells of dashes, with a bar somewhere."""
    if "|" not in line:
        return False
    cells = line.strip().removeprefix("|").removesuffix("|").split("|")
    return all(_RULE_CELL.fullmatch(c.strip()) for c in cells)


def _closers(lines: list[str]) -> dict[int, int]:
    """For every line that opens a fence, the first later line that closes it.

    Walked from the end: a stack for each mark holds fences that no earlier-standing longer one hides.
    """
    found: dict[int, int] = {}
    stacks: dict[str, list[tuple[int, int]]] = {"`": [], "~": []}
    for at in range(len(lines) - 1, -1, -1):
        if m := _FENCE.match(lines[at]):
            run, stack = len(m[1]), stacks[m[1][0]]
            # the nearest later fence with at least this run
            while stack and stack[-1][0] < run:
                stack.pop()
            if stack:
                found[at] = stack[-1][1]
            stack.append((run, at))
    return found


def parse_blocks(markdown: str) -> list[Block]:
    """Headings, code, tables, lists and paragraphs, in order. A fence that nothing closes is text."""
    lines = re.sub(r"\r\n?", "\n", markdown).split("\n")
    closers, out, prose, at = _closers(lines), [], [], 0

    def close() -> None:
        if text := "\n".join(prose).strip():
            out.append(Block("paragraph", text))
        prose.clear()

    def take(kind: str, end: int) -> int:
        close()
        out.append(Block(kind, "\n".join(lines[at:end]).strip()))
        return end

    def while_(end: int, good) -> int:
        while end < len(lines) and lines[end].strip() and good(lines[end]):
            end += 1
        return end

    while at < len(lines):
        line = lines[at]
        heading = _HEADING.fullmatch(line)
        if not line.strip():
            close()
            at += 1
        elif _FENCE.match(line):
            if at in closers:
                at = take("code", closers[at] + 1)
            else:
                prose.append(line)
                at += 1
        elif heading and n_words(heading[2]) <= HEADING_WORDS:
            close()
            out.append(Block("heading", heading[2].strip(), len(heading[1])))
            at += 1
        elif "|" in line and at + 1 < len(lines) and _separates(lines[at + 1]):
            at = take("table", while_(at + 2, lambda x: "|" in x))
        elif _ITEM.match(line):
            at = take("list", while_(at + 1, lambda x: x[0] in " \t" or _ITEM.match(x)))
        else:
            prose.append(line)
            at += 1
    close()
    return out


def list_items(text: str) -> list[str]:
    """Items as deep as the first; what is indented further belongs to the item above."""
    lines = text.split("\n")
    marked = [(at, len(line) - len(line.lstrip())) for at, line in enumerate(lines) if _ITEM.match(line)]
    starts = [at for at, indent in marked if indent <= marked[0][1]]
    bounds = sorted({0, *starts, len(lines)})
    return [item for a, b in pairwise(bounds) if (item := "\n".join(lines[a:b])).strip()]


def atoms(blocks: list[Block]) -> Iterator[Atom]:
    for i, b in enumerate(blocks):
        if b.kind in ("code", "table"):
            yield Atom("atomic", b.text, i)
        elif b.kind == "heading":
            yield Atom("line", b.text, i)
        else:
            whole = b.kind == "list"
            for text in list_items(b.text) if whole else sentences(b.text):
                yield Atom("list_item" if whole else "sentence", text, i)


def _joined(run: list[Atom]) -> str:
    out = run[0].text if run else ""
    for a, b in zip(run, run[1:], strict=False):
        flows = a.kind == b.kind == "sentence" and a.block == b.block
        out += (" " if flows else "\n\n") + b.text
    return out.strip()


def pack(run: list[Atom], max_words: int, overlap: int) -> list[str]:
    """Greedy chunks. An atom over the limit stands alone; after any other cut, up to overlap closing sentences are said again, even if the next chunk then exceeds the limit."""
    done: list[list[Atom]] = []
    held: list[Atom] = []
    size = 0
    for atom in run:
        n = n_words(atom.text)
        if n > max_words:
            done += [held, [atom]]
            held, size = [], 0
            continue
        if held and size + n > max_words:
            done.append(held)
            back = 0
            while back < min(overlap, len(held)) and held[-1 - back].kind == "sentence":
                back += 1
            held = held[len(held) - back :]
            size = sum(n_words(a.text) for a in held)
        held = [*held, atom]
        size += n
    return [text for text in map(_joined, [*done, held]) if text]


def chunk_markdown(markdown: str | None, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks in order. A document of headings alone is one section of its headings' texts."""
    max_words, overlap = max(1, max_words), max(0, overlap)
    blocks = parse_blocks(markdown or "")
    sections: list[tuple[tuple[str, ...], list[Block]]] = [((), [])]
    path: list[Block] = []
    for b in blocks:
        if b.kind == "heading" and b.level <= 3:
            path = [p for p in path if p.level < b.level] + [b]
            sections.append((tuple(p.text for p in path), []))
        else:
            sections[-1][1].append(b)
    if not any(body for _, body in sections):
        sections = [((), blocks)]
    return [Chunk(text, names, names[-1] if names else "", n_words(text)) for names, body in sections for text in pack(list(atoms(body)), max_words, overlap)]


CHUNKS = "array<struct<text:string,headings_path:array<string>,section:string,word_count:int>>"


def chunks_of(markdown: Column | str, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> Column:
    """All chunks of a document, as an array; explode it for rows."""

    @F.pandas_udf(CHUNKS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [c._asdict() | {"headings_path": list(c.headings_path)} for c in chunk_markdown(t, max_words, overlap)])

    return run(F.col(markdown) if isinstance(markdown, str) else markdown)


@udtf(returnType=T.StructType().add("chunk_index", "integer").add("text", "string").add("headings_path", T.ArrayType(T.StringType())).add("section", "string").add("word_count", "integer"))
class ChunkMarkdown:
    """SQL table function: SELECT ... FROM docs, LATERAL chunk_markdown(markdown, max_words, overlap)."""

    def eval(self, markdown: str, max_words: int, overlap: int):
        for i, c in enumerate(chunk_markdown(markdown, max_words, overlap)):
            yield i, c.text, list(c.headings_path), c.section, c.word_count


def records(pages: DataFrame, markdown: str = "markdown", url: str = "url", title: str = "title", max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Retrieval records (id, content, metadata), one a chunk; other columns of pages stay. Ids come from the URL alone."""
    rows = pages.select("*", F.posexplode(chunks_of(markdown, max_words, overlap)).alias("chunk_index", "chunk"))
    from millrace.functions.text import nfc, page_slug, sanitize_content, sanitize_label

    source = sanitize_label(nfc(F.col(url)), 2048)

    return rows.select(
        *[c for c in pages.columns if c != markdown],
        page_slug(source, "chunk_index").alias("id"),
        sanitize_content("chunk.text").alias("content"),
        F.struct(
            source.alias("source_url"), sanitize_label(nfc(F.col(title))).alias("title"),
            F.col("chunk.headings_path").alias("headings_path"), F.col("chunk.section").alias("section"),
            F.col("chunk.word_count").alias("word_count"), F.col("chunk_index").alias("chunk_index"),
        ).alias("metadata"),
    )


def record_id(seed: str, index: int) -> str:
    """What page_slug gives, for one record."""
    return f"{hashlib.md5(seed.encode()).hexdigest()[:12]}-{index:04d}"


def packed_sentences(text: Column | str, max_words: int) -> Column:
    """Word counts of greedy chunks of a prose text without overlap, as a fold that stays in the JVM.

    Sentences over the limit are chunks of their own.
    """
    from millrace.functions.text import count_words, split_sentences

    counts = F.transform(split_sentences(text), lambda s: count_words(s).cast("int"))
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("held"))

    def step(acc: Column, n: Column) -> Column:
        push = lambda *x: F.concat(acc["done"], F.when(acc["held"] > 0, F.array(acc["held"])).otherwise(F.array().cast("array<int>")), *x)
        return (
            F.when(n > max_words, F.struct(push(F.array(n)).alias("done"), F.lit(0).alias("held")))
            .when(acc["held"] + n > max_words, F.struct(push().alias("done"), n.alias("held")))
            .otherwise(F.struct(acc["done"].alias("done"), (acc["held"] + n).alias("held")))
        )

    return F.aggregate(counts, start, step, lambda acc: F.concat(acc["done"], F.when(acc["held"] > 0, F.array(acc["held"])).otherwise(F.array().cast("array<int>"))))
