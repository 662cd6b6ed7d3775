"""All registered queries of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import accounts, details, texts, web


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**web.QUERIES, **texts.QUERIES, **accounts.QUERIES, **details.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**web.SQL, **texts.SQL, **accounts.SQL, **details.SQL}
