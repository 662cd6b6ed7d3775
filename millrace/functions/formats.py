"""Record-tree formats: CSV, JSON, XML, YAML and TOML, and Markdown tables."""

from __future__ import annotations

import csv
import datetime
import io
import json
import re
import tomllib
from collections.abc import Callable, Iterable, Sequence
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import clean_cell

CELL, ROWS = 500, 5000
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


def cell(value: object) -> str:
    text = "" if value is None else str(value)
    text = _CONTROL.sub(" ", text.replace("\n", " ").replace("\r", " ")).replace("|", "\\|").strip()
    return text if len(text) <= CELL else text[:CELL] + "…"


def markdown_table(rows: Iterable[Sequence[object]]) -> str:
    """A GitHub table, columns padded; empty rows dropped, short ones filled; at most 5000 body rows and a note."""
    full = [r for r in ([cell(c) for c in row] for row in rows) if any(r)]
    if not full:
        return ""
    width = max(map(len, full))
    full = [r + [""] * (width - len(r)) for r in full]
    head, body = full[0], full[1 : ROWS + 1]
    wide = [max(len(r[i]) for r in [head, *body]) for i in range(width)]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |"
    text = "\n".join([line(head), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, body)])
    return text + (f"\n\n_(table truncated to {ROWS} rows)_" if len(full) - 1 > ROWS else "")


def table_lines(grid: Column) -> Column:
    """The same table from array<array<string>>, JVM-side; rows over the cap are for the caller to cut."""
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: clean_cell(c)))
    full = F.filter(clean, lambda row: F.exists(row, lambda c: c != ""))
    width = F.array_max(F.transform(full, F.size))
    even = F.transform(full, lambda row: F.concat(row, F.array_repeat(F.lit(""), width - F.size(row))))
    places = F.sequence(F.lit(1), width)
    wide = F.transform(places, lambda i: F.array_max(F.transform(even, lambda row: F.length(F.element_at(row, i)))))
    line = lambda row: F.concat(F.lit("| "), F.array_join(F.zip_with(row, wide, lambda c, w: F.rpad(c, w, " ")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(wide, lambda w: F.repeat(F.lit("-"), w + 2)), "|"), F.lit("|"))
    lines = F.concat(F.array(line(F.element_at(even, 1))), F.array(rule), F.transform(F.slice(even, F.lit(2), F.greatest(F.size(even) - 1, F.lit(0))), line))
    return F.when(F.size(full) > 0, F.array_join(lines, "\n")).otherwise("")


def _dump(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _rows(text: str) -> list[dict]:
    rows = list(csv.DictReader(io.StringIO(text)))
    if not rows:
        raise ValueError("the CSV has no rows")
    return rows


def csv_to_json(text: str) -> str:
    """Strings all; missing cells null, cells beyond the header under "null"."""
    return _dump(_rows(text))


def json_to_csv(text: str) -> str:
    """The first object's keys are the header; a later object may lack some but bring no other."""
    return _csv(json.loads(text))


def _csv(data: Any) -> str:
    if not isinstance(data, list) or not data or not isinstance(data[0], dict):
        raise ValueError("CSV needs a list of objects, one at least")
    out = io.StringIO()
    writer = csv.DictWriter(out, fieldnames=list(data[0]))
    writer.writeheader()
    writer.writerows(data)
    return out.getvalue()


def xml_name(key: object) -> str:
    """A name XML allows; what is none becomes field."""
    name = re.sub(r"[^\w.-]", "_", ("" if key is None else str(key)).strip()) or "field"
    return name if re.match(r"[^\W\d]", name) else f"_{name}"


def _xml(name: str, value: Any, pad: str, step: str) -> str:
    if isinstance(value, list):
        return "".join(_xml(name, v, pad, step) for v in value)
    if isinstance(value, dict):
        named: dict[str, Any] = {xml_name(k): v for k, v in value.items()}
        inner = "".join(_xml(k, v, pad + step, step) for k, v in named.items())
        return f"{pad}<{name}>\n{inner}{pad}</{name}>\n" if inner else f"{pad}<{name}></{name}>\n"
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return f"{pad}<{name}>{escape(text)}</{name}>\n"


def to_xml(data: Any, step: str = " ") -> str:
    """<root>: an object's fields, a list's items, or a value."""
    inner = {"item": data} if isinstance(data, list) else data if isinstance(data, dict) else {"value": data}
    return '<?xml version="1.0" encoding="utf-8"?>\n' + _xml("root", inner, "", step).rstrip("\n")


def _tree(e: ElementTree.Element) -> Any:
    """Attributes under @name, text beside others under #text, repeated elements a list, an empty element null."""
    out: dict[str, Any] = {f"@{k}": v for k, v in e.attrib.items()}
    for c in e:
        v = _tree(c)
        if c.tag in out:
            out[c.tag] = [*(out[c.tag] if isinstance(out[c.tag], list) else [out[c.tag]]), v]
        else:
            out[c.tag] = v
    text = (e.text or "").strip()
    if not out:
        return text or None
    return out | ({"#text": text} if text else {})


def from_xml(text: str) -> dict:
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("XML with a DTD is not read")
    root = ElementTree.fromstring(text)
    return {root.tag: _tree(root)}


def csv_to_xml(text: str) -> str:
    return to_xml(_rows(text), "  ")


def xml_to_csv(text: str) -> str:
    """Rows are the items below a lone root, or the root itself."""
    data: Any = next(iter(from_xml(text).values()))
    if isinstance(data, dict) and list(data) == ["item"]:
        data = data["item"]
    return _csv([data] if isinstance(data, dict) else data)


def json_to_xml(text: str) -> str:
    return to_xml(json.loads(text))


def xml_to_json(text: str) -> str:
    """Values stay strings; only a root named root, and in it a lone item, are taken off."""
    data: Any = from_xml(text)
    if list(data) == ["root"]:
        data = data["root"]
        if isinstance(data, dict) and list(data) == ["item"]:
            data = data["item"]
    return _dump(data)


def json_to_yaml(text: str) -> str:
    import yaml

    return yaml.safe_dump(json.loads(text), sort_keys=False, allow_unicode=True, default_flow_style=False)


def yaml_to_json(text: str) -> str:
    import yaml

    return json.dumps(yaml.safe_load(text), indent=2, ensure_ascii=False, default=str)


def _toml_value(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return "[" + ", ".join(_toml_value(x) for x in v if x is not None) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items() if x is not None) + "}"
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)


def _toml_key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k, ensure_ascii=False)


def _toml(data: dict, path: tuple[str, ...] = ()) -> str:
    """Nulls have no place in TOML and are left out."""
    tables = {k: v for k, v in data.items() if isinstance(v, dict) or (isinstance(v, list) and v and all(isinstance(x, dict) for x in v))}
    out = "".join(f"{_toml_key(k)} = {_toml_value(v)}\n" for k, v in data.items() if k not in tables and v is not None)
    for k, v in tables.items():
        name = ".".join(map(_toml_key, (*path, k)))
        for x in v if isinstance(v, list) else [v]:
            out += ("\n" if out else "") + (f"[[{name}]]\n" if isinstance(v, list) else f"[{name}]\n") + _toml(x, (*path, k))
    return out


def json_to_toml(text: str) -> str:
    """A list is kept under items, a lone value under value."""
    data = json.loads(text)
    return _toml(data if isinstance(data, dict) else {"items" if isinstance(data, list) else "value": data})


def toml_to_json(text: str) -> str:
    return json.dumps(tomllib.loads(text), indent=2, ensure_ascii=False, default=lambda v: v.isoformat())


_INLINE = (
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)"), lambda m: f"<img src={quoteattr(m[2])} alt={quoteattr(m[1])}>"),
    (re.compile(r"\[([^\]]*)\]\(([^)\s]+)\)"), lambda m: f"<a href={quoteattr(m[2])}>{m[1]}</a>"),
    (re.compile(r"\*\*(.+?)\*\*"), lambda m: f"<strong>{m[1]}</strong>"),
    (re.compile(r"(?<!\*)\*([^*]+)\*(?!\*)"), lambda m: f"<em>{m[1]}</em>"),
)


def _inline(text: str) -> str:
    parts = re.split(r"(`[^`]+`)", text)
    for i, p in enumerate(parts):
        if i % 2:
            parts[i] = f"<code>{escape(p[1:-1])}</code>"
            continue
        p = escape(p)
        for pattern, made in _INLINE:
            p = pattern.sub(made, p)
        parts[i] = p
    return "".join(parts)


def markdown_to_html(text: str, title: str = "Document") -> str:
    """Headings with ids, fenced code, tables, lists, quotes and paragraphs, in a page."""
    from millrace.functions.chunking import list_items, parse_blocks

    out = []
    for b in parse_blocks(text):
        if b.kind == "heading":
            slug = re.sub(r"[^\w]+", "-", b.text.lower()).strip("-")
            out.append(f'<h{b.level} id="{slug}">{_inline(b.text)}</h{b.level}>')
        elif b.kind == "code":
            first, *body = b.text.split("\n")
            lang = first.strip("`~ ")
            out.append(f"<pre><code{f' class={quoteattr(f"language-{lang}")}' if lang else ''}>{escape(chr(10).join(body[:-1]))}\n</code></pre>")
        elif b.kind == "table":
            rows = [[c.strip() for c in re.split(r"(?<!\\)\|", r.strip().removeprefix("|").removesuffix("|"))] for r in b.text.split("\n")]
            line = lambda r, t: "<tr>" + "".join(f"<{t}>{_inline(c)}</{t}>" for c in r) + "</tr>"
            out.append("<table>\n<thead>\n" + line(rows[0], "th") + "\n</thead>\n<tbody>\n" + "\n".join(line(r, "td") for r in rows[2:]) + "\n</tbody>\n</table>")
        elif b.kind == "list":
            tag = "ol" if re.match(r"\s*\d", b.text) else "ul"
            items = (re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+", "", i) for i in list_items(b.text))
            out.append(f"<{tag}>\n" + "\n".join(f"<li>{_inline(i)}</li>" for i in items) + f"\n</{tag}>")
        elif b.text.startswith(">"):
            out.append("<blockquote><p>" + _inline(re.sub(r"(?m)^>\s?", "", b.text)) + "</p></blockquote>")
        else:
            out.append(f"<p>{_inline(b.text)}</p>")
    return f"<!DOCTYPE html>\n<html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head>\n<body>\n" + "\n".join(out) + "\n</body></html>"


CONVERTERS: dict[str, Callable[[str], str]] = {
    f.__name__: f for f in (csv_to_json, json_to_csv, csv_to_xml, xml_to_csv, json_to_xml, xml_to_json, json_to_yaml, yaml_to_json, json_to_toml, toml_to_json, markdown_to_html)
}


def converted(text: Column | str, route: str) -> Column:
    """struct<output, error> of a conversion, one text a row; an error is a value, not a failed task."""
    run = CONVERTERS[route]
    kind = T.StructType().add("output", "string").add("error", "string")

    @F.pandas_udf(kind)
    def go(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                out.append((None if t is None else run(t), None))
            except Exception as e:  # noqa: BLE001  any fault of a record is its own
                out.append((None, f"{type(e).__name__}: {e}"[:2000]))
        return pd.DataFrame(out, columns=["output", "error"])

    return go(F.col(text) if isinstance(text, str) else text)


def records_as_table(df: DataFrame, order: list, by: list[str] | None = None) -> DataFrame:
    """Rows of small groups as Markdown tables (table): a report, so a group must fit a row."""
    names = [c for c in df.columns if c not in (by or [])]
    row = F.struct(*order, F.array(*[F.col(c).cast("string") for c in names]).alias("__cells"))
    grids = df.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    grid = F.concat(F.array(F.array(*[F.lit(n) for n in names])), F.transform("rows", lambda r: r["__cells"]))
    return grids.select(*(by or []), table_lines(grid).alias("table"))
