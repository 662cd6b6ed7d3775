"""Any file to text: binaryFile rows routed by extension to one reader each, in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import formats
from millrace.functions.text import decode_bytes
from millrace.html.markdown import html_to_markdown

#: Limits on archives: entries, declared bytes, bytes of metadata and of chapters.
ENTRIES, DECLARED, META, CHAPTERS = 10_000, 400 << 20, 10 << 20, 100 << 20


def guard_archive(raw: bytes) -> zipfile.ZipFile:
    """The archive, if it does not declare too much."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise ValueError("not a valid archive") from e
    infos = z.infolist()
    if len(infos) > ENTRIES or sum(i.file_size for i in infos) > DECLARED:
        raise ValueError("archive rejected: too many entries or bytes")
    return z


def _xml(z: zipfile.ZipFile, name: str, cap: int = DECLARED) -> ElementTree.Element:
    try:
        if z.getinfo(name).file_size > cap:
            raise ValueError(f"{name} is too large")
    except KeyError as e:
        raise ValueError(f"{name} is missing") from e
    raw = z.read(name)
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("XML with a DTD is not read")
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError as e:
        raise ValueError(f"unreadable XML: {e}") from e


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [x for x in e.iter() if _name(x) in names]


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def csv_text(raw: bytes) -> str:
    import csv

    rows = list(csv.reader(io.StringIO(decode_bytes(raw))))
    if len(rows) < 2:
        raise ValueError("the CSV has no rows")
    return formats.markdown_table(rows)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_text(raw: bytes) -> str:
    """Every sheet under its name; cells as text, dates as their numbers."""
    z = guard_archive(raw)
    shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in _all(_xml(z, "xl/_rels/workbook.xml.rels"), "Relationship")}
    out = []
    for sheet in _all(_xml(z, "xl/workbook.xml"), "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        root = _xml(z, target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}"))
        grid = []
        for row in _all(root, "row"):
            cells: dict[int, str] = {}
            for c in _all(row, "c"):
                v = next(iter(_all(c, "v")), None)
                text = "".join(t.text or "" for t in _all(c, "t")) if _attr(c, "t") == "inlineStr" else (v.text or "" if v is not None else "")
                if _attr(c, "t") == "s" and text:
                    text = shared[int(text)]
                cells[_column(_attr(c, "r")) if _attr(c, "r") else len(cells)] = text
            grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        out += [f"## {_attr(sheet, 'name')}", (formats.markdown_table(grid) if len([r for r in grid if any(r)]) > 1 else "") or "_(empty sheet)_"]
    if not out:
        raise ValueError("the workbook has no sheets")
    return "\n\n".join(out) + "\n"


def _one_line(text: str) -> str:
    return " ".join(text.split())


def _paragraphs(body: ElementTree.Element) -> list[tuple[int, str]]:
    out = []
    for p in _all(body, "p"):
        text = _one_line("".join((t.text or "") if _name(t) == "t" else " " for t in _all(p, "t", "br")))
        props = next((x for x in p if _name(x) == "pPr"), None)
        if text:
            out.append((min(int((_attr(props, "lvl") if props is not None else None) or 0), 4), text))
    return out


def _slide(root: ElementTree.Element) -> tuple[str, list[str]]:
    """Title and blocks of a slide, shapes from top to bottom, left to right."""
    tree = next(iter(_all(root, "spTree")), root)
    title, placed = "", []
    for shape in tree:
        if _name(shape) not in ("sp", "graphicFrame", "grpSp"):
            continue
        off = next(iter(_all(shape, "off")), None)
        at = (int(_attr(off, "y") or 0), int(_attr(off, "x") or 0)) if off is not None else (0, 0)
        kind = next((_attr(x, "type") for x in _all(shape, "ph")), None)
        table = next(iter(_all(shape, "tbl")), None)
        if table is not None:
            text = formats.markdown_table([[" ".join(t for _, t in _paragraphs(c)) for c in _all(r, "tc")] for r in _all(table, "tr")])
        elif kind in ("title", "ctrTitle") and not title:
            title = " ".join(t for _, t in _paragraphs(shape))
            continue
        else:
            text = "\n".join(f"{'  ' * level}- {t}" for level, t in _paragraphs(shape))
        if text:
            placed.append((at, len(placed), text))
    return title, [t for *_, t in sorted(placed)]


def pptx_text(raw: bytes) -> str:
    z = guard_archive(raw)
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in _all(_xml(z, "ppt/_rels/presentation.xml.rels"), "Relationship")}
    ids = [next(v for k, v in s.attrib.items() if k.endswith("}id")) for s in _all(_xml(z, "ppt/presentation.xml"), "sldId")]
    out, some = [], False
    for i, rid in enumerate(ids, 1):
        path = posixpath.normpath(posixpath.join("ppt", rels[rid]))
        title, blocks = _slide(_xml(z, path))
        some |= bool(title or blocks)
        out += [f"## Slide {i}" + (f": {title}" if title else ""), *blocks]
        own = f"{posixpath.dirname(path)}/_rels/{posixpath.basename(path)}.rels"
        if own in z.namelist():
            for r in _all(_xml(z, own), "Relationship"):
                if (_attr(r, "Type") or "").endswith("/notesSlide"):
                    notes = _xml(z, posixpath.normpath(posixpath.join(posixpath.dirname(path), _attr(r, "Target"))))
                    bodies = [s for s in _all(notes, "sp") if any(_attr(x, "type") == "body" for x in _all(s, "ph"))]
                    text = "\n".join(t for b in bodies for _, t in _paragraphs(b))
                    out += [f"### Notes\n\n{text}"] if text else []
    if not some:
        raise ValueError("the presentation has no text")
    return "\n\n".join(out) + "\n"


def docx_text(raw: bytes) -> str:
    """Headings by style, lists by numbering, bold and italic runs, tables, links."""
    z = guard_archive(raw)
    body = next(iter(_all(_xml(z, "word/document.xml"), "body")))
    rels = {_attr(r, "Id"): _attr(r, "Target") for r in _all(_xml(z, "word/_rels/document.xml.rels"), "Relationship")} if "word/_rels/document.xml.rels" in z.namelist() else {}
    from html import escape

    def run(r: ElementTree.Element) -> str:
        text = "".join(escape(t.text or "") if _name(t) == "t" else "<br>" if _name(t) == "br" else " " for t in r if _name(t) in ("t", "br", "tab"))
        on = {_name(x) for p in r if _name(p) == "rPr" for x in p if _attr(x, "val") not in ("0", "false")}
        for mark, tag in (("b", "strong"), ("i", "em")):
            text = f"<{tag}>{text}</{tag}>" if mark in on and text.strip() else text
        return text

    def inline(p: ElementTree.Element) -> str:
        out = ""
        for x in p:
            if _name(x) == "r":
                out += run(x)
            elif _name(x) == "hyperlink":
                rid = next((v for k, v in x.attrib.items() if k.endswith("}id")), None)
                out += f'<a href="{escape(rels.get(rid) or "")}">{"".join(map(run, _all(x, "r")))}</a>'
        return out

    def block(e: ElementTree.Element) -> str:
        if _name(e) == "tbl":
            rows = ["".join(f"<td>{' '.join(inline(p) for p in _all(c, 'p'))}</td>" for c in _all(r, "tc")) for r in _all(e, "tr")]
            return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
        if _name(e) != "p":
            return ""
        style = next((_attr(x, "val") or "" for x in _all(e, "pStyle")), "")
        text = inline(e)
        if m := re.fullmatch(r"[Hh]eading\s?([1-6])|([Tt]itle)", style):
            return f"<h{m[1] or 1}>{text}</h{m[1] or 1}>"
        return f"<ul><li>{text}</li></ul>" if next(iter(_all(e, "numPr")), None) is not None else f"<p>{text}</p>"

    text = html_to_markdown(re.sub("</ul><ul>", "", "".join(map(block, body))))
    if not text.strip():
        raise ValueError("the document has no text")
    return text


def epub_text(raw: bytes) -> str:
    """Chapters in the order of the spine, without the navigation."""
    z = guard_archive(raw)
    package = next((unquote(_attr(r, "full-path")) for r in _all(_xml(z, "META-INF/container.xml", META), "rootfile") if _attr(r, "full-path")), None)
    if package is None:
        raise ValueError("the container names no package")
    opf = _xml(z, package, META)
    items = {_attr(i, "id"): i for i in _all(opf, "item") if _attr(i, "id") and _attr(i, "href")}
    out, room = [], CHAPTERS
    for ref in _all(opf, "itemref"):
        item = items.get(_attr(ref, "idref"))
        if item is None or "nav" in (_attr(item, "properties") or "").split():
            continue
        path = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(_attr(item, "href"))))
        if not path.lower().endswith((".xhtml", ".html", ".htm")) or path not in z.namelist():
            continue
        room -= z.getinfo(path).file_size
        if room < 0:
            break
        if text := html_to_markdown(z.read(path).decode("utf-8", "replace")).strip():
            out.append(text)
    if not out:
        raise ValueError("the book has no text")
    return "\n\n".join(out) + "\n"


def fenced(language: str) -> Callable[[bytes], str]:
    def run(raw: bytes) -> str:
        body = decode_bytes(raw).rstrip("\n")
        ticks = "`" * max(3, 1 + max(map(len, re.findall("`+", body)), default=0))
        return f"{ticks}{language}\n{body}\n{ticks}\n"

    return run


#: Reader by extension.
READERS: dict[str, Callable[[bytes], str]] = (
    {e: decode_bytes for e in ("txt", "text", "md", "markdown", "log", "rst")}
    | {e: lambda raw: html_to_markdown(decode_bytes(raw)) for e in ("html", "htm", "xhtml")}
    | {e: fenced(e) for e in ("json", "xml", "yaml", "toml")} | {"yml": fenced("yaml")}
    | {"csv": csv_text, "xlsx": xlsx_text, "pptx": pptx_text, "docx": docx_text, "epub": epub_text}
)
#: Kinds that need a converter of the deployment's own: see connectors.
EXTERNAL = ("pdf", "doc", "xls", "ppt", "odt", "ods", "odp", "rtf")
IMAGES = ("jpg", "jpeg", "png", "webp", "heic", "gif", "bmp", "tiff", "svg")


def to_text(raw: bytes, name: str, extra: dict[str, Callable[[bytes], str]] | None = None) -> str:
    """Markdown of a file by its name's extension; ValueError where there is none to make."""
    kind = posixpath.basename(name).rpartition(".")[2].lower() if "." in posixpath.basename(name) else ""
    reader = (extra or {}).get(kind) or READERS.get(kind)
    if reader is None:
        why = "an image holds no text" if kind in IMAGES else "it needs a connector" if kind in EXTERNAL else "its kind is unknown"
        raise ValueError(f"{name} cannot be read: {why}")

    text = re.sub(r"\r\n?", "\n", reader(raw))
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


def read_documents(spark: SparkSession, path: str, glob: str | None = None, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """path, modificationTime, length, markdown, error of the files below path: a fault of one file is its own."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return converted(reader.option("pathGlobFilter", glob).load(path) if glob else reader.load(path), extra)


def converted(files: DataFrame, extra: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    kind = T.StructType().add("markdown", "string").add("error", "string")

    @F.pandas_udf(kind)
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for p, c in zip(paths, contents, strict=True):
            try:
                out.append((to_text(bytes(c), p, extra), None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{e}"[:2000]))
        return pd.DataFrame(out, columns=["markdown", "error"])

    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, run("path", "content").alias("r")).select(*kept, "r.*")


def magic(content: str):
    """The kind that a file's first bytes show, null where they show none."""
    head = F.hex(F.substring(content, 1, 12))
    starts = (("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("1F8B", "gzip"))
    out = F.when(head.rlike("^52494646.{8}57454250"), "webp").when(head.rlike("^.{8}66747970(68656963|68656978|6D696631)"), "heic")
    for prefix, kind in starts:
        out = out.when(head.startswith(prefix), kind)
    return out


def type_gate(extension, shown, allowed: list[str] | None):
    """An allow-list (none: open), and no file whose bytes and name both tell, and tell differently."""
    named = F.when(extension.isin("jpg", "jpeg"), "jpeg").when(extension.isin("docx", "xlsx", "pptx", "epub", "zip"), "zip").when(extension.isin("doc", "xls", "ppt"), "ole").when(extension.isin("pdf", "png", "gif", "webp", "heic"), extension)
    listed = extension.isin(*allowed) if allowed is not None else F.lit(True)
    return listed & (named.isNull() | shown.isNull() | (named == shown))


def repaired_name(name: str, shown: str | None) -> str:
    """A name with the extension its bytes show, where it had none that is known."""
    known = {*READERS, *EXTERNAL, *IMAGES, "zip", "gz"}
    kind = name.rpartition(".")[2].lower() if "." in name else ""
    ending = {"jpeg": "jpg", "gzip": "gz"}.get(shown, shown)
    return name if kind in known or shown in (None, "zip", "ole") else f"{name}.{ending}"
