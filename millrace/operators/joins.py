"""Joins beyond a plain equality. Catalyst picks the strategy; only sides of a checked size are ever broadcast, and by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_period(events: DataFrame, periods: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Events with the periods [start, end) of their key that hold them."""
    p = periods.withColumnRenamed(key, "__k")
    return events.join(p, (F.col(key) == F.col("__k")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__k")


def in_period_bucketed(events: DataFrame, periods: DataFrame, at: str, start: str, end: str, seconds: int) -> DataFrame:
    """The same without a key: time is cut into buckets of seconds, a period stands in each it touches, so the join is an equality."""
    e = events.withColumn("__b", F.floor(F.unix_timestamp(at) / seconds))
    first, last = F.floor(F.unix_timestamp(start) / seconds), F.floor((F.unix_timestamp(end) - 1) / seconds)
    p = periods.where(F.col(start) < F.col(end)).withColumn("__c", F.explode(F.sequence(first, F.greatest(first, last))))
    return e.join(p, (F.col("__b") == F.col("__c")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b", "__c")


def within_second(markers: DataFrame, periods: DataFrame, key: str, marked: str, start: str) -> DataFrame:
    """Markers of whole-second precision with the period that starts in [marked, marked + 1 s)."""
    p = periods.withColumnRenamed(key, "__k")
    return markers.join(p, (F.col(key) == F.col("__k")) & (F.date_trunc("second", F.col(start)) == F.col(marked)), "left").drop("__k")


def with_first(left: DataFrame, right: DataFrame, key: str, right_key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """LEFT JOIN LATERAL (... ORDER BY ... LIMIT 1): one pre-aggregated minimum instead of a loop."""
    best = right.groupBy(right_key).agg(F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("b"))
    best = best.select(F.col(right_key).alias("__k"), *[F.col(f"b.c{i}").alias(c) for i, c in enumerate(columns)])
    return left.join(best, F.col(key) == F.col("__k"), "left").drop("__k")


def with_aggregate(left: DataFrame, right: DataFrame, key: str, right_key: str, **aggregates: Column) -> DataFrame:
    """LEFT JOIN LATERAL (SELECT aggregates): aggregated once, then joined."""
    per = right.groupBy(F.col(right_key).alias("__k")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return left.join(per, F.col(key) == F.col("__k"), "left").drop("__k")


def exists(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def known_or(left: DataFrame, dimension: DataFrame, value: str, known: str, default: str) -> DataFrame:
    """left with value replaced by default where the dimension does not know it."""
    d = dimension.select(F.col(known).alias("__known")).distinct()
    return left.join(d, F.col(value) == F.col("__known"), "left").withColumn(value, F.coalesce("__known", F.lit(default))).drop("__known")


def upserted(table: DataFrame, rows: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """(the table after INSERT ... ON CONFLICT(key) DO UPDATE where the owner is the same, the rows in conflict)."""
    owners = table.select(F.col(key).alias("__k"), F.col(owner).alias("__o"))
    seen = rows.join(owners, F.col(key) == F.col("__k"), "left")
    ok = F.col("__k").isNull() | F.col(owner).eqNullSafe(F.col("__o"))
    good, bad = seen.where(ok).drop("__k", "__o"), seen.where(~ok).drop("__k", "__o")
    kept = table.join(good.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return kept.unionByName(good), bad


def missing_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the table lacks, once each: an idempotent insert."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
