"""What this library leaves to a deployment: fetching, rendering, search, mail, office, image and PDF converters.

Register an implementation under a name; operators that need one say so when it is missing.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Rendered(NamedTuple):
    html: str
    final_url: str
    render_quality: float
    is_blocked: bool
    warnings: tuple[str, ...] = ()
    content_category: str | None = None


class Renderer(ABC):
    """Fetches and renders a page; raises for an empty one."""

    @abstractmethod
    def render(self, url: str) -> Rendered: ...


class SearchProvider(ABC):
    """Answers a query with a provider's JSON payload."""

    @abstractmethod
    def search(self, query: str, category: str = "search", time_filter: str | None = None) -> str: ...


class Converter(ABC):
    """Turns a file's bytes into another kind's."""

    @abstractmethod
    def convert(self, raw: bytes) -> bytes: ...


#: Routes of which only the interface is here.
ROUTES = (
    *[f"{a}-to-{b}" for a in ("jpeg", "png", "webp", "heic", "svg") for b in ("jpeg", "png", "webp", "heic", "svg") if a != b],
    "compress-image", "pdf-to-jpeg", "doc-to-pdf", "docx-to-pdf", "xls-to-pdf", "xlsx-to-pdf", "ppt-to-pdf", "pptx-to-pdf", "odt-to-pdf", "ods-to-pdf", "odp-to-pdf",
    "html-to-pdf", "markdown-to-pdf", "epub-to-pdf", "image-to-pdf", "url-to-pdf", "url-to-screenshot",
)
#: Time filters a search takes, by what providers call them.
TIME_FILTERS = {"hour": "qdr:h", "day": "qdr:d", "week": "qdr:w", "month": "qdr:m", "year": "qdr:y"}

_registered: dict[str, object] = {}


def register(name: str, implementation: object) -> None:
    _registered[name] = implementation


def connector(name: str) -> object:
    if name not in _registered:
        raise LookupError(f"no connector is registered for {name}")
    return _registered[name]


def with_retries(call: Callable[[], str], status: Callable[[Exception], int | None], sleep: Callable[[float], None], delays: tuple[float, ...] = (0.5, 1.0)) -> str:
    """Up to three attempts; only 429 and 5xx are worth another."""
    for pause in (*delays, None):
        try:
            return call()
        except Exception as e:
            code = status(e)
            if pause is None or not (code is None or code == 429 or code >= 500):
                raise
            sleep(pause)
    raise AssertionError


def rendered(urls: DataFrame, renderer: Renderer, url: str = "url") -> DataFrame:
    """urls with html, final_url, render_quality, is_blocked, warnings and error, each page apart."""
    from pyspark.sql import types as T

    schema = T.StructType(list(urls.schema.fields))
    for name, kind in (("html", "string"), ("final_url", "string"), ("render_quality", "double"), ("is_blocked", "boolean"), ("warnings", T.ArrayType(T.StringType())), ("error", "string")):
        schema = schema.add(name, kind)

    def one(u: str) -> tuple:
        try:
            r = renderer.render(u)
            return r.html, r.final_url, r.render_quality, r.is_blocked, list(r.warnings), None
        except Exception as e:  # noqa: BLE001
            return None, u, None, None, [], str(e)[:2000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = pd.DataFrame([one(u) for u in pdf[url]], columns=["html", "final_url", "render_quality", "is_blocked", "warnings", "error"], index=pdf.index)
            yield pd.concat([pdf, found], axis=1)

    return urls.mapInPandas(run, schema)


class PageSource(DataSource):
    """spark.read.format("millrace_pages").option("urls", "a b c").load(): pages by a fetch function given as module:name."""

    @classmethod
    def name(cls) -> str:
        return "millrace_pages"

    def schema(self) -> str:
        return "url string, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = options.get("urls", "").split()
        self.fetch = options.get("fetch", "")
        self.per = int(options.get("pages_per_task", "16"))

    def partitions(self):
        return [_Urls(self.urls[i : i + self.per]) for i in range(0, len(self.urls), self.per)] or [_Urls([])]

    def read(self, partition):
        import importlib

        module, _, name = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), name) if module else None
        for u in partition.urls:
            try:
                if fetch is None:
                    raise LookupError("no fetch function is named")
                yield u, fetch(u), None
            except Exception as e:  # noqa: BLE001
                yield u, None, str(e)[:2000]
