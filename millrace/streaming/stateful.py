"""Watchers, limiters and breakers as keyed state over streams, and the stateless twins they are tested against.

State is a few numbers a key. Time is event time; timestamps without a zone are read as UTC first (withWatermark rejects them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import windows
from millrace.operators.folds import Breaker

DAYS = 86400


def read_events(spark: SparkSession, path: str, at: str = "ts", files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files, its time a timestamp."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def once_only(events: DataFrame, key: str, at: str, lateness: str) -> DataFrame:
    """The first event of each key, kept in state as long as late copies may come."""
    return events.withWatermark(at, lateness).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, keys: list[str], at: str, width: str, lateness: str) -> DataFrame:
    """Events of each key by tumbling window; a window is given out once the watermark passes it."""
    return events.withWatermark(at, lateness).groupBy(*keys, F.window(at, width)).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


class _Ordered(StatefulProcessor):
    """Runs each batch's rows of a key in time order through a step over the key's state (JSON)."""

    schema = T.StructType().add("state", "string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", self.schema)

    def start(self) -> dict:
        raise NotImplementedError

    def step(self, state: dict, row) -> tuple:
        raise NotImplementedError

    columns: list[str] = []
    order: list[str] = []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import json

        state = json.loads(self.held.get()[0]) if self.held.exists() else self.start()
        pdf = pd.concat(list(rows)).sort_values(self.order)
        out = [(*key, *self.step(state, r)) for r in pdf.itertuples(index=False)]
        self.held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Watcher(_Ordered):
    """Check results (watcher_id, check_id, ts, ok, content_hash; render_quality and is_blocked where there are such) to status: first capture, change, failures in a row, pause at three.

    A failed check leaves the baseline; a null hash, a blocked page and one of poor quality are audit rows; a paused watcher is checked no more.
    """

    columns, order = ["watcher_id", "check_id", "changed", "failures", "paused"], ["ts", "check_id"]

    def start(self) -> dict:
        return {"hash": None, "failures": 0, "paused": False}

    def step(self, s: dict, row) -> tuple:
        if s["paused"]:
            return int(row.check_id), False, s["failures"], True
        changed = False
        if row.ok:
            s["failures"] = 0
            quality = getattr(row, "render_quality", None)
            poor = quality is not None and quality < windows.QUALITY_FLOOR
            if isinstance(row.content_hash, str) and not poor and not getattr(row, "is_blocked", False):
                changed = s["hash"] is not None and s["hash"] != row.content_hash
                s["hash"] = row.content_hash
        else:
            s["failures"] += 1
            s["paused"] = s["failures"] >= 3
        return int(row.check_id), changed, s["failures"], s["paused"]


class Limiter(_Ordered):
    """Requests (key, request_id, ts) to allowed, by per-minute, per-hour and per-day limits; a rejected one uses up none."""

    columns, order = ["key", "request_id", "allowed"], ["ts", "request_id"]

    def __init__(self, limits: dict[int, int]):
        self.limits = limits

    def start(self) -> dict:
        return {}

    def step(self, s: dict, row) -> tuple:
        t = int(pd.Timestamp(row.ts).timestamp())
        used = {w: s[str(w)][1] if str(w) in s and s[str(w)][0] == t // w else 0 for w in self.limits}
        ok = all(used[w] < most for w, most in self.limits.items())
        if ok:
            s.update({str(w): [t // w, used[w] + 1] for w in self.limits})
        return int(row.request_id), ok


class Calls(_Ordered):
    """Calls (key, call_id, ts, ok) to admitted and the breaker's state."""

    columns, order = ["key", "call_id", "admitted", "breaker"], ["ts", "call_id"]

    def start(self) -> dict:
        return {"state": "closed", "count": 0, "since": 0.0}

    def step(self, s: dict, row) -> tuple:
        b = Breaker()
        b.state, b.count, b.since = s["state"], s["count"], s["since"]
        t = pd.Timestamp(row.ts).timestamp()
        admitted = b.admits(t)
        if admitted:
            b.record(bool(row.ok), t)
        s.update(state=b.state, count=b.count, since=b.since)
        return int(row.call_id), admitted, b.state


_SCHEMAS = {
    Watcher: "watcher_id long, check_id long, changed boolean, failures long, paused boolean",
    Limiter: "key long, request_id long, allowed boolean",
    Calls: "key long, call_id long, admitted boolean, breaker string",
}


def processed(rows: DataFrame, key: str, processor: _Ordered) -> DataFrame:
    """rows by key through a processor, streaming or batch. Needs the RocksDB state store on streams."""
    return rows.groupBy(key).transformWithStateInPandas(processor, _SCHEMAS[type(processor)], "Append", "None")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs what is there to Parquet and ends; a later run goes on where this one stopped."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def poll_due(watchers: Callable[[], DataFrame], check: Callable[[DataFrame], None], most: int = 25):
    """foreachBatch body of a poll loop: claims the most overdue active watchers, at most 50, and advances them before checking."""

    def tick(batch: DataFrame, epoch: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is not None:
            check(due(watchers(), now, most))

    return tick


def due(watchers: DataFrame, now, most: int = 25) -> DataFrame:
    """Active watchers whose time has come, the most overdue first, with the next time (an hour at least from now)."""
    n = max(1, min(50, most))
    rows = watchers.where((F.col("status") == "active") & (F.col("next_check_at") <= F.lit(now))).orderBy("next_check_at", "watcher_id").limit(n)
    return rows.withColumn("next_check_at", F.lit(now).cast("timestamp") + F.make_dt_interval(mins=F.greatest("frequency_minutes", F.lit(60)).cast("int")))
