"""Sizes of pages and vector images, and the page rule that a print converter gets."""

from __future__ import annotations

import base64
import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paper sizes in millimetres, width and height in portrait.
PAPER = {
    "A0": (841, 1189), "A1": (594, 841), "A2": (420, 594), "A3": (297, 420), "A4": (210, 297), "A5": (148, 210), "A6": (105, 148),
    "B0": (1000, 1414), "B1": (707, 1000), "B2": (500, 707), "B3": (353, 500), "B4": (250, 353), "B5": (176, 250),
    "Letter": (216, 279), "Legal": (216, 356), "Tabloid": (279, 432), "Ledger": (432, 279),
}
#: Pixels of a unit.
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "pc": 16.0, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96.0, "q": 96 / 101.6}
GEOMETRY = ("footer", "header", "margins", "orientation", "page_height", "page_size", "page_width", "scale")
MOST_PIXELS, FALLBACK_WIDTH = 40_000_000, 2048


def page_dimensions(size: Column, width: Column, height: Column, orientation: Column) -> Column:
    """struct<width, height> in millimetres: the custom size if both are given, else the paper's (names in any case), turned as asked. Null for unknown paper."""
    names = F.lower(F.trim(size))
    w0, h0 = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (w, h) in PAPER.items():
        w0, h0 = F.when(names == k.lower(), float(w)).otherwise(w0), F.when(names == k.lower(), float(h)).otherwise(h0)
    custom = width.isNotNull() & height.isNotNull()
    w, h = F.when(custom, width.cast("double")).otherwise(w0), F.when(custom, height.cast("double")).otherwise(h0)
    short, long = F.least(w, h), F.greatest(w, h)
    wide = F.lower(F.trim(orientation)) == "landscape"
    return F.when(w.isNotNull(), F.struct(F.when(wide, long).otherwise(short).alias("width"), F.when(wide, short).otherwise(long).alias("height")))


def unsupported_geometry(given: dict, supported: bool) -> list[str]:
    """Options that were set and cannot be applied: only what is set counts."""
    return [] if supported else [k for k in GEOMETRY if k in given]


#: What stands between braces in a running header or footer: a counter, or a value of the page.
_COUNTERS = {"page": "page", "total_pages": "pages"}


def css_string(text: str) -> str:
    """A CSS string literal's inside."""
    return re.sub(r'(["\\])', r"\\\1", text)


def running_text(template: str, values: dict[str, str]) -> str:
    """A template's CSS content value: literals and counters side by side. Tags go; unknown placeholders stay as they are."""
    literal, out = "", []
    for part in re.split(r"(\{\{\w+\}\})", re.sub(r"<[^>]+>", "", template).strip()):
        name = part.strip("{}")
        if part.startswith("{{") and name in _COUNTERS:
            out += [f'"{literal}"', f"counter({_COUNTERS[name]})"]
            literal = ""
        else:
            literal += css_string(values.get(name, part) if part.startswith("{{") else part)
    return " ".join([*out, f'"{literal}"'])


def page_rule(width: float, height: float, margins: tuple[float, float, float, float], scale: float = 1.0, header: str = "", footer: str = "", title: str = "", url: str = "", date: str = "") -> str:
    """CSS @page of a size in millimetres, with running header and footer; a scale above 1 is a smaller page."""
    values = {"date": date, "title": title, "url": url}
    mm = lambda *lengths: " ".join(f"{x / scale}mm" for x in lengths)
    rules = {"size": mm(width, height), "margin": mm(*margins)}
    boxes = {f"@{at}": running_text(text, values) for at, text in (("top-center", header), ("bottom-center", footer)) if text}
    return "@page { " + " ".join([f"{k}: {v};" for k, v in rules.items()] + [f"{k} {{ content: {v}; font-size: 10px; }}" for k, v in boxes.items()]) + " }"


def svg_length(value: Column) -> Column:
    """Pixels of a length; null for none, and for percentages."""
    number = F.regexp_extract(value, r"^\s*\+?(\d*\.?\d+(?:[eE][-+]?\d+)?)\s*(px|pt|pc|mm|cm|in|q|Q)?\s*$", 1)
    unit = F.lower(F.regexp_extract(value, r"(px|pt|pc|mm|cm|in|q|Q)\s*$", 1))
    factor = F.lit(1.0)
    for u, px in UNITS.items():
        factor = F.when(unit == u, px).otherwise(factor)
    px = number.try_cast("double") * factor
    return F.when(px > 0, px)


def svg_size(svg: Column) -> Column:
    """struct<width, height> of an SVG's root: its lengths, else its viewBox; null without."""
    root = F.regexp_extract(F.substring(svg, 1, 65536), r"(?s)<svg\b([^>]*)>", 1)
    attr = lambda name: F.regexp_extract(root, rf"(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    w, h = svg_length(attr("width")), svg_length(attr("height"))
    box = F.transform(F.filter(F.split(F.trim(attr("view[Bb]ox")), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))
    bw, bh = F.try_element_at(box, F.lit(3)), F.try_element_at(box, F.lit(4))
    lengths = F.struct(w.alias("width"), h.alias("height"))
    boxed = F.struct(bw.alias("width"), bh.alias("height"))
    return F.when(w.isNotNull() & h.isNotNull(), lengths).when((F.size(box) == 4) & (bw > 0) & (bh > 0), boxed)


def svg_render_size(size: Column, most: int = MOST_PIXELS) -> Column:
    """struct<width, height> to render at: null sizes as they are, scaled to the limit, or a fallback width."""
    scale = F.sqrt(F.lit(float(most)) / (size["width"] * size["height"]))
    cap = lambda c: F.greatest(F.lit(1), F.floor(c * scale).cast("int"))
    none = F.lit(None).cast("int")
    return F.when(size.isNull(), F.struct(F.lit(FALLBACK_WIDTH).alias("width"), none.alias("height"))).when(size["width"] * size["height"] <= most, F.struct(none.alias("width"), none.alias("height"))).otherwise(F.struct(cap(size["width"]).alias("width"), cap(size["height"]).alias("height")))


def raster_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG's, GIF's or JPEG's header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 0xFF:
            kind, size = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return struct.unpack(">HH", raw[at + 5 : at + 9])[::-1]
            at += 2 + size
    return None


def svg_wrapper(raw: bytes) -> str:
    """A raster image inside an SVG of its size, as a data URI."""
    size = raster_size(raw)
    if size is None:
        raise ValueError("not a PNG, GIF or JPEG image")
    if size[0] * size[1] > MOST_PIXELS:
        raise ValueError("the image is too large")
    kind = "png" if raw[:1] == b"\x89" else "gif" if raw[:1] == b"G" else "jpeg"
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" viewBox="0 0 {size[0]} {size[1]}"><image width="{size[0]}" height="{size[1]}" href="data:image/{kind};base64,{base64.b64encode(raw).decode()}"/></svg>'


@F.pandas_udf(T.StringType())
def wrapped_svg(raw: pd.Series) -> pd.Series:
    """svg_wrapper(), null for what is no raster image."""

    def one(b):
        try:
            return None if b is None else svg_wrapper(bytes(b))
        except ValueError:
            return None

    return raw.map(one)
