"""Rankings, as-of values, streaks and fixed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: DISTINCT ON."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_of_best(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n best of each key's best."""
    return best_per_key(df, keys, order).orderBy(*order).limit(n)


def first_n(df: DataFrame, keys: list, order: list, n: int) -> DataFrame:
    """At most n rows a key, in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def mode_first(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Each key's most common value; of equally common ones the first seen. Two pre-aggregated steps, no window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("first").alias("at"), F.col(value).alias("value"))).alias("b"))
    return best.select(*keys, F.col("b.value").alias("mode"), (-F.col("b.n")).alias("n"))


def streaks(checks: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """failures: failed checks in a row up to this one; paused from the first time they reach the limit on, and later checks change nothing."""
    seq = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = checks.withColumn("__island", F.sum(F.when(failed, 0).otherwise(1)).over(seq))
    run = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.when(failed, 1).otherwise(0)).over(run)).withColumn("paused", F.max(F.col("__run") >= limit).over(seq))
    return rows.withColumn("failures", F.when(F.col("paused"), F.lit(limit)).otherwise(F.col("__run")).cast("long")).drop("__island", "__run")


#: A render of lower quality is recorded and not compared.
QUALITY_FLOOR = 0.4


def comparable_hash(digest: Column, quality: Column, blocked: Column) -> Column:
    """The digest of a check that really captured its page, null for the others: blocked pages, and renders below the floor."""
    return F.when(~F.coalesce(blocked, F.lit(False)) & (F.coalesce(quality, F.lit(1.0)) >= QUALITY_FLOOR), digest)


def baseline_change(snapshots: DataFrame, key: str, order: list[str], digest: str) -> DataFrame:
    """baseline: the latest non-null digest before; changed: there is one and it differs. A null digest is an audit row and changes nothing."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = snapshots.withColumn("baseline", F.last(digest, ignorenulls=True).over(w))
    return rows.withColumn("changed", F.coalesce(F.col(digest).isNotNull() & F.col("baseline").isNotNull() & (F.col(digest) != F.col("baseline")), F.lit(False)))


def previous_closed(periods: DataFrame, key: str, start: str, end: str, left: Column) -> DataFrame:
    """rollover: what the latest period that ended by this one's start left, at least 0; periods of a key do not overlap."""
    w = Window.partitionBy(key).orderBy(start)
    rows = periods.withColumn("__end", F.lag(end).over(w)).withColumn("__left", F.lag(left).over(w))
    zero = F.lit(0).cast(rows.schema["__left"].dataType)
    return rows.withColumn("rollover", F.when(F.col("__end") <= F.col(start), F.greatest("__left", zero)).otherwise(zero)).drop("__end", "__left")


def until_freed(files: DataFrame, order: list, size: str, need: int | Column, by: list[str] | None = None) -> DataFrame:
    """The oldest files whose sizes so far fall short of what is needed; files without a size are skipped. by: the owner's columns."""
    need = F.lit(need) if isinstance(need, int) else need
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sized = files.where(F.col(size) > 0)
    return sized.withColumn("freed_before", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("freed_before") < need)


def window_counts(events: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Requests of a key by fixed window, aligned to the epoch."""
    start = (F.floor(F.unix_timestamp(at) / seconds) * seconds).cast("long")
    return events.groupBy(*keys, start.alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


def cached_hits(requests: DataFrame, keys: list[str], at: str, order: str, seconds: int = 3600) -> DataFrame:
    """is_hit: a request of the same key that was no hit itself lies at most seconds back. Hits do not renew.

    Needs a sequence: the first request opens a term, the first one after it the next.
    """
    from millrace.operators.folds import fold

    rows = requests.withColumn("__key", F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]))

    def step(state: dict, row) -> dict:
        import pandas as pd

        t = pd.Timestamp(getattr(row, at)).timestamp()
        hit = "made" in state and t - state["made"] <= seconds
        if not hit:
            state["made"] = t
        return {"is_hit": hit}

    rows = rows.withColumnRenamed("__key", "cache_key")
    return fold(rows, "cache_key", [at, order], dict, step, "is_hit boolean").drop("cache_key")


def heading_paths(blocks: DataFrame, doc: str, pos: str, level: str, text: str) -> DataFrame:
    """path: the h1-h3 a block stands under, by the last heading of each level since a higher one."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks
    for k in (1, 2, 3):
        seen = F.last(F.when(F.col(level) == k, F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))), ignorenulls=True).over(w)
        reset = F.max(F.when((F.col(level) >= 1) & (F.col(level) < k), F.col(pos))).over(w)
        rows = rows.withColumn(f"__h{k}", F.when(reset.isNull() | (seen["pos"] > reset), seen["text"]))
    return rows.withColumn("path", F.array_compact(F.array("__h1", "__h2", "__h3"))).drop("__h1", "__h2", "__h3")


def cooled_down(offers: DataFrame, history: DataFrame, key: str, at: str, days: int = 30, lifetime: int = 3) -> DataFrame:
    """Offers whose key had none in the days before and fewer than lifetime ever before."""
    names = offers.columns
    # one sorted pass over both; at one time offers stand first, so that only earlier history counts
    both = offers.withColumn("__offer", F.lit(1)).unionByName(history.select(key, at).withColumn("__offer", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy(key).orderBy(at, F.desc("__offer")).rowsBetween(Window.unboundedPreceding, -1)
    old = F.when(F.col("__offer") == 0, F.col(at))
    seen = both.withColumn("__n", F.count(old).over(before)).withColumn("__last", F.max(old).over(before)).where("__offer = 1")
    fresh = F.col("__last").isNull() | (F.col("__last") <= F.col(at) - F.expr(f"interval {days} days"))
    return seen.where((F.col("__n") < lifetime) & fresh).select(*names)
