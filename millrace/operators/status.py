"""Verdicts over the states of a batch's parts, and classification of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(items: DataFrame, batch: str, state: str, running: list[str], good: list[str], object_key: str | None = None) -> DataFrame:
    """Counts and status: any running, processing; all good, completed; none good, failed; else partial. zip_mode: the one object is a ZIP."""
    s = F.col(state)
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(s.isin(*running)).alias("running"), F.count_if(s.isin(*good)).alias("good")]
    if object_key:
        aggs += [F.count_distinct(object_key).alias("__keys"), F.min(object_key).alias("__key")]
    out = items.groupBy(batch).agg(*aggs).withColumn("failed", F.col("total") - F.col("running") - F.col("good"))
    verdict = F.when(F.col("running") > 0, "processing").when(F.col("good") == F.col("total"), "completed").when(F.col("good") == 0, "failed").otherwise("partial")
    out = out.withColumn("status", verdict)
    if object_key:
        out = out.withColumn("zip_mode", F.coalesce((F.col("__keys") == 1) & F.col("__key").endswith(".zip"), F.lit(False))).drop("__keys", "__key")
    return out


def final_verdict(good: Column, failed: Column) -> Column:
    """Of a batch that has run: an empty one is completed."""
    return F.when((failed > 0) & (good == 0), "failed").when(failed > 0, "partial").otherwise("completed")


def view_verdict(total: Column, pending: Column, good: Column, failed: Column, canceled: Column) -> Column:
    """Of a batch as it stands: an empty one is queued."""
    return (
        F.when(canceled, "canceled").when(pending == total, "queued").when(pending > 0, "processing")
        .when((failed > 0) & (good == 0), "failed").when(failed > 0, "partial").otherwise("completed")
    )


#: Parts of messages that tell failures apart, in this order.
FAILURES = (
    (504, "timeout", ("timeout", "timed out", "exceeded")),
    (502, "unreachable", ("err_name_not_resolved", "err_connection", "err_address_unreachable", "err_internet_disconnected", "getaddrinfo", "name or service not known", "connection refused", "econnrefused", "dns")),
)


def failure(message: Column) -> Column:
    """struct(code, kind); what nothing matches has rendered empty, 502."""
    m, out = F.lower(F.coalesce(message, F.lit(""))), None
    for code, kind, marks in FAILURES:
        hit = F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"))
        test = m.rlike("|".join(marks))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out.otherwise(F.struct(F.lit(502).alias("code"), F.lit("empty_render").alias("kind")))


def event_name(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(""))


def suppressions(events: DataFrame, email: str, name: str, at: str) -> DataFrame:
    """E-mail addresses that may not be written to, in lower case: since and reason of the first hard bounce or complaint, and opted_out, the first complaint."""
    n = event_name(F.col(name))
    reason = F.when(n == "hardbounce", "hard_bounce").when(n.isin("spam", "complaint"), "spam")
    rows = events.withColumn("__r", reason).where(F.col("__r").isNotNull()).withColumn("__e", F.lower(F.col(email)))
    return rows.groupBy(F.col("__e").alias("email")).agg(F.min(at).alias("since"), F.min_by("__r", at).alias("reason"), F.min(F.when(F.col("__r") == "spam", F.col(at))).alias("opted_out"))


def first_success(activities: DataFrame, key: str, state: str, at: str, message: str | None = None) -> DataFrame:
    """billed_at: the first time an activity succeeded; last_state; error: the last state's message (message: its column, else the state itself), none after a success."""
    s = F.col(state) == "Success"
    error = F.when(~s, F.col(message if message else state))
    return activities.groupBy(key).agg(F.min(F.when(s, F.col(at))).alias("billed_at"), F.max_by(F.col(state), at).alias("last_state"), F.max_by(error, at).alias("error"))


def transitions(rows: DataFrame, state: str, wanted: str, active: list[str]) -> DataFrame:
    """New states where the old one is active; terminal rows stay as they are."""
    return rows.withColumn("applied", F.col(state).isin(*active)).withColumn(state, F.when(F.col("applied"), F.lit(wanted)).otherwise(F.col(state)))


def swept(operations: DataFrame, state: str, terminal: list[str], at: str, before: Column) -> DataFrame:
    """Operations outside a batch that have stood too long fail."""
    stale = ~F.col(state).isin(*terminal) & (F.col(at) < before) & F.col("batch_id").isNull()
    return operations.withColumn(state, F.when(stale, "failed").otherwise(F.col(state)))


#: HTTP status and message of a search that failed, by kind of fault.
SEARCH_FAULTS = (
    ("config", 503, "Search is temporarily unavailable. Please try again later."),
    ("unavailable", 503, "Search is temporarily unavailable. Please try again later."),
    ("upstream", 502, "The search provider returned an error. Please try again."),
)


def lookups(queries: DataFrame, results: DataFrame, query: str, fault: str, cost: str) -> DataFrame:
    """A row a query: status (200, or a fault's) and detail, total results, the operations charged (one for a search that succeeded) and its cost."""
    code, detail = F.lit(200), F.lit(None).cast("string")
    for kind, status, text in SEARCH_FAULTS:
        code, detail = F.when(F.col(fault) == kind, status).otherwise(code), F.when(F.col(fault) == kind, text).otherwise(detail)
    n = results.groupBy(F.col(query).alias("__q")).agg(F.count(F.lit(1)).alias("total"))
    rows = queries.withColumn("status", code).withColumn("detail", detail).join(n, F.col(query) == F.col("__q"), "left").drop("__q")
    ok = F.col("status") == 200
    return rows.withColumn("total", F.when(ok, F.coalesce("total", F.lit(0))).otherwise(0)).withColumn("operations", ok.cast("int")).withColumn("cost_cents", F.when(ok, F.col(cost)).otherwise(0))
