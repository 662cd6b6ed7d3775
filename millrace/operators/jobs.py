"""Jobs over many rows: ingestion of a site's pages, period rotation, retention, claimed mail, policies and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators.folds import content_dedup, fold

DUPLICATE = "DUPLICATE"
#: Headers a caller may not set.
BLOCKED_HEADERS = ("connection", "content-length", "cookie", "host", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")


def ingest(pages: DataFrame, job: str = "job_id", order: str = "pos", url: str = "final_url", digest: str = "content_hash", chunks: str = "n_chunks", text: str = "markdown") -> DataFrame:
    """Pages with status, note, is_duplicate, billed_key and chunk_count.

    Pages without text are skipped; a page whose URL or content its job has kept is completed as a duplicate with no chunks, and not billed.
    """
    full = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0
    done = content_dedup(pages.where(full), job, order, url, digest)
    empty = pages.where(~full).withColumn("is_duplicate", F.lit(False))
    rows = done.unionByName(empty)
    key = F.concat(F.lit("ingest:"), F.col(job).cast("string"), F.lit(":"), F.substring(F.md5(F.col(url)), 1, 16))
    return (
        rows.withColumn("status", F.when(full, "completed").otherwise("skipped"))
        .withColumn("note", F.when(F.col("is_duplicate"), DUPLICATE).when(~full, "no extractable content"))
        .withColumn("billed_key", F.when(full & ~F.col("is_duplicate"), key))
        .withColumn("chunk_count", F.when(full & ~F.col("is_duplicate"), F.col(chunks)).otherwise(0))
    )


def resumable(pages: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that no earlier run completed."""
    return pages.join(done.where("status in ('completed', 'failed', 'skipped')").select(*keys), keys, "left_anti")


def resumed(operations: DataFrame, batches: DataFrame, batch: str = "batch_id", status: str = "status", redacted: str = "redacted", request: str = "request") -> DataFrame:
    """operations of interrupted batches with their status and error after a restart.

    What was queued or running is queued again, each URL by itself; but those of a batch whose credentials were not stored fail, and those whose request cannot
    be rebuilt (null) do. What is done stays done.
    """
    b = batches.select(F.col(batch).alias("__b"), F.coalesce(F.col(redacted), F.lit(False)).alias("__redacted"))
    rows = operations.join(b, F.col(batch) == F.col("__b"), "left")
    open_ = F.col(status).isin("queued", "processing")
    error = F.when(open_ & F.col("__redacted"), "the batch used credentials that are not stored: submit it again").when(open_ & F.col(request).isNull(), "the request could not be rebuilt")
    return rows.withColumn("error", error).withColumn(status, F.when(error.isNotNull(), "failed").when(open_, "queued").otherwise(F.col(status))).drop("__b", "__redacted")


def quota_stop(pages: DataFrame, job: str, order: str, room: str) -> DataFrame:
    """allowed: the job's quota still has room; after the first denial all the rest is denied."""

    def step(state: dict, row) -> dict:
        state["used"] = state.get("used", 0) + 1
        return {"allowed": state["used"] <= int(getattr(row, room))}

    return fold(pages, job, [order], dict, step, "allowed boolean")


def rotation(subscriptions: DataFrame, now: Column, months: int = 36) -> DataFrame:
    """A row a boundary that an active subscription has passed: project_id, n, period_start, period_end, plan_id.

    Each period begins where the last ended and is a calendar month; a pending plan holds from the first boundary on.
    """
    start = F.col("current_period_end")
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(months)), F.array(start), lambda acc, _: F.concat(acc, F.array(F.element_at(acc, -1) + F.make_ym_interval(F.lit(0), F.lit(1)))))
    active = subscriptions.where((F.col("status") == "active") & (start <= now))
    rows = active.select("project_id", F.coalesce("pending_plan_id", "plan_id").alias("plan_id"), ends.alias("__ends")).select("project_id", "plan_id", "__ends", F.posexplode(F.slice("__ends", 1, months)).alias("n", "period_start"))
    return rows.where(F.col("period_start") <= now).select("project_id", "n", "period_start", F.element_at("__ends", F.col("n") + 2).alias("period_end"), "plan_id")


def retention_due(deletions: DataFrame, now: Column, most: int = 2000) -> DataFrame:
    """The most overdue deletions that are not done, at most a tick's worth."""
    return deletions.where(F.col("deleted_at").isNull() & (F.col("delete_at") <= now)).orderBy("delete_at", "object_key").limit(most)


def retention_outcome(claimed: DataFrame, ok: Column, now: Column, attempts: int = 5) -> DataFrame:
    """Claimed rows with an attempt more: deleted if ok, given up after the last."""
    n = F.coalesce("attempts", F.lit(0)) + 1
    return claimed.withColumn("deleted_at", F.when(ok | (n >= attempts), now)).withColumn("attempts", n)


def claims(candidates: DataFrame, log: DataFrame, key: str = "email_key") -> DataFrame:
    """Candidates whose key nobody has claimed, once each: what may be sent now."""
    return candidates.dropDuplicates([key]).join(log.select(key), key, "left_anti")


def retryable(log: DataFrame, now: Column, hours: int = 48, minutes: int = 15, cap: int = 3) -> DataFrame:
    """Failed sends old enough and not too old, with attempts left, the oldest first."""
    young, old = now - F.make_dt_interval(mins=F.lit(minutes)), now - F.make_dt_interval(hours=F.lit(hours))
    return log.where(~F.col("sent_ok") & (F.col("created_at") > old) & (F.col("created_at") < young) & (F.col("attempts") < cap)).orderBy("created_at")


def cached_operation(operations: DataFrame, requests: DataFrame, seconds: int = 3600, most: int = 20) -> DataFrame:
    """requests with operation_id: the newest of the twenty latest operations of its project and URL within the time that has its fingerprint. The fingerprint is looked at after the limit, so an older match is a miss.

    No pairs are made: both stand in one order of time, where the newest operation with the fingerprint is a hit if fewer than twenty came since. Time is cut into
    terms of seconds, and the twenty latest operations of a term also stand in the next, so a busy URL is many groups.
    """
    names = requests.columns
    key = [F.col("project_id").alias("__p"), F.col("url").alias("__u"), F.col("fingerprint").alias("__f")]
    done = operations.where((F.col("status") == "completed") & ~F.col("cache_hit") & F.col("project_id").isNotNull() & F.col("url").isNotNull() & F.col("created_at").isNotNull())
    o = _in_terms(done.select(*key, F.col("created_at").alias("__at"), F.struct("operation_id").alias("__o")), seconds)
    latest = Window.partitionBy("__p", "__u", "__term").orderBy(F.desc("__at"), F.desc("__o"))
    carried = o.withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= most).withColumn("__term", F.col("__term") + 1).drop("__n")
    r = _in_terms(requests.select("*", *key, F.col("at").alias("__at")), seconds)
    both = r.unionByName(o.unionByName(carried), allowMissingColumns=True)
    # at one time operations stand first: a request sees them
    order = ["__at", F.col("__o").isNull(), "__o"]
    upto = lambda *by: Window.partitionBy("__p", "__u", "__term", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__n", F.count("__o").over(upto()))
    last = F.last(F.when(F.col("__o").isNotNull(), F.struct("__n", "__at", "__o")), ignorenulls=True).over(upto("__f"))
    rows = both.withColumn("__last", last).where(F.col("__o").isNull())
    hit = F.col("__f").isNotNull() & (F.col("__n") - F.col("__last.__n") < most) & (F.col("__last.__at") >= F.col("__at") - F.make_dt_interval(secs=F.lit(seconds)))
    return rows.select("request_id", *[c for c in names if c != "request_id"], F.when(hit, F.col("__last.__o.operation_id")).alias("operation_id"))


def _in_terms(rows: DataFrame, seconds: int) -> DataFrame:
    """rows with __term: the whole terms of seconds before __at. Times without a zone are counted as they read, whatever the session's zone."""
    at = F.col("__at")
    if rows.schema["__at"].dataType.typeName() == "timestamp_ntz":
        whole = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    else:
        whole = F.unix_seconds(at.cast("timestamp"))
    return rows.withColumn("__term", F.floor(whole / max(seconds, 1)))


def policy_verdict(url: Column, domains: list[str], tlds: list[str], patterns: list[str]) -> Column:
    """struct<rule, detail> of the first rule a URL's host breaks (domain or one above it, top level, pattern), else null. Patterns that do not compile are left out."""
    h = F.regexp_replace(urls.host(url), r"\.+$", "")
    plain = lambda xs: [x.strip().lower().lstrip(".") for x in xs if x.strip()]
    out = F.lit(None).cast("struct<rule:string,detail:string>")
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    hit = lambda rule, detail: F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))
    for p in reversed(good):
        out = F.when(h.rlike(f"(?i){p}"), hit("pattern", F.lit(p))).otherwise(out)
    last = F.element_at(F.split(h, r"\."), -1)
    if plain(tlds):
        out = F.when(last.isin(*plain(tlds)), hit("tld", last)).otherwise(out)
    for d in reversed(plain(domains)):
        out = F.when((h == d) | h.endswith(f".{d}"), hit("domain", F.lit(d))).otherwise(out)
    return F.when(h != "", out)


def check_request(options: dict) -> dict:
    """Render options of a request, a cookie's path filled in; ValueError for what may not be."""
    auth, cookies, headers = (options.get(k) for k in ("auth", "cookies", "headers"))
    if auth and not (isinstance(auth, dict) and auth.get("username") and auth.get("password")):
        raise ValueError("auth needs a username and a password")
    if cookies:
        if not isinstance(cookies, list) or len(cookies) > 50:
            raise ValueError("cookies are a list of at most 50")
        if not all(isinstance(c, dict) and c.get("name") and c.get("value") and (c.get("domain") or c.get("url")) for c in cookies):
            raise ValueError("a cookie needs a name, a value, and a domain or URL")
        cookies = [c | ({"path": "/"} if c.get("domain") and not c.get("path") else {}) for c in cookies]
    if headers:
        if not isinstance(headers, dict) or len(headers) > 20:
            raise ValueError("headers are a map of at most 20")
        if any(k.lower() in BLOCKED_HEADERS or not isinstance(v, str) for k, v in headers.items()):
            raise ValueError("a header is a text, and some may not be set")
        if auth and any(k.lower() == "authorization" for k in headers):
            raise ValueError("either auth or an Authorization header")
    selector, wait = options.get("wait_for_selector"), options.get("wait_for_selector_timeout")
    if selector is not None and not (isinstance(selector, str) and len(selector) <= 1000):
        raise ValueError("a selector is a text of at most 1000 characters")
    if wait is not None and (isinstance(wait, bool) or not isinstance(wait, int) or not 0 < wait <= 60_000):
        raise ValueError("a wait is 1 to 60000 milliseconds")
    if any(not isinstance(options.get(k, False), (bool, type(None))) for k in ("block_ads", "block_media")):
        raise ValueError("block_ads and block_media are true or false")
    return options | ({"cookies": cookies} if cookies else {})


def cost_totals(items: DataFrame, by: list[str], status: str = "status", cost: str = "cost_cents") -> DataFrame:
    """completed, failed and total cost, to four places."""
    return items.groupBy(*by).agg(F.count_if(F.col(status) == "completed").alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.sum(F.col(cost).cast("decimal(12,4)")).alias("cost_cents"))
