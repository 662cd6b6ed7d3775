"""Caps, gates and period accounts. 0 means unlimited, tested on the base cap before any bonus; money is decimal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective_cap(override: str, effective: str, plan: str) -> Column:
    """The override, else the effective cap where it isn't zero, else the plan's."""
    return F.coalesce(F.col(override), F.nullif(F.col(effective), F.lit(0)), F.col(plan), F.lit(0))


def quota_gate(cap: Column, bonus: Column, used: Column, units: Column, overage_allowed: Column, overage_enabled: Column) -> Column:
    """ok, overage or denied. No cap is ok whatever was used; else a null used (no period) is denied."""
    limit = cap + F.coalesce(bonus, F.lit(0))
    return (
        F.when(cap == 0, "ok").when(used.isNull(), "denied").when(used + units <= limit, "ok")
        .when(F.coalesce(overage_allowed & overage_enabled, F.lit(False)), "overage").otherwise("denied")
    )


def crawl_gate(level: Column, mode: Column) -> Column:
    """none < sitemap < full."""
    rank = lambda c: F.when(c == "full", 2).when(c == "sitemap", 1).otherwise(0)
    return rank(level) >= rank(mode)


def batch_gate(limit: Column, n: Column) -> Column:
    """A limit of 0 is no batch at all."""
    return (limit > 0) & (n <= limit)


def count_gate(limit: Column, n: Column) -> Column:
    """A limit of 0 is no limit."""
    return (limit == 0) | (n < limit)


def rollup(entries: DataFrame, key: str, period: list[str], delta: str, endpoint: str, cap: Column | None = None) -> DataFrame:
    """Sums by period of entries, one for each idempotency key: total, entries, a map by endpoint, and what exceeds cap.

    Entries of one key are alike; which stays does not matter.
    """
    once = entries.dropDuplicates([key])
    by = once.groupBy(*period, endpoint).agg(F.sum(delta).alias("n"), F.count(F.lit(1)).alias("k"))
    out = by.groupBy(*period).agg(
        F.sum("n").alias("total"), F.sum("k").alias("entries"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(endpoint), F.col("n"))))).alias("by_endpoint"),
    )
    return out if cap is None else out.withColumn("overage", F.when(cap == 0, 0).otherwise(F.greatest(F.col("total") - cap, F.lit(0))))


def month_walk(start: Column, months: int = 36) -> Column:
    """Period boundaries, each a month after the one before: 31 January, 29 February, 29 March."""
    first = F.array(start.cast("date"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(months)), first, lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), 1))))


def credit_rollover(periods: DataFrame, project: str, order: str, spent: str, grant: Column) -> DataFrame:
    """granted of each period: the grant and what the one before left unspent.

    A project's periods (months, so few) are folded in order; amounts are decimal(18,4).
    """
    money = "decimal(18,4)"
    rows = periods.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(spent).cast(money).alias("spent"), grant.cast(money).alias("grant")))).alias("__periods"))
    kind = f"array<struct<at:{periods.schema[order].dataType.simpleString()},spent:{money},granted:{money}>>"
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["granted"] - F.try_element_at(acc, F.lit(-1))["spent"], F.lit(0).cast(money))
    walked = F.aggregate("__periods", F.array().cast(kind), lambda acc, x: F.concat(acc, F.array(F.struct(x["at"].alias("at"), x["spent"].alias("spent"), (x["grant"] + F.greatest(last(acc), F.lit(0).cast(money))).cast(money).alias("granted")))))
    return rows.select(project, F.explode(walked).alias("__x")).select(project, F.col("__x.at").alias(order), "__x.spent", "__x.granted")


def overage_amount(ops: Column, rate: Column) -> Column:
    """Dollars for operations at a rate in cents; less than a cent is nothing."""
    amount = F.round(ops.cast("decimal(18,4)") * rate.cast("decimal(12,4)") / 100, 2)
    return F.when(amount >= F.lit("0.01").cast("decimal(4,2)"), amount)


def high_water(events: DataFrame, key: str, at: list, value: str) -> DataFrame:
    """peak: the largest value so far; running: the sum so far."""
    w = Window.partitionBy(key).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("peak", F.max(value).over(w)).withColumn("running", F.sum(value).over(w))
