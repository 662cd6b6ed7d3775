"""Order-dependent operators as one sorted pass: state a key, rows streamed, nothing collected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold(df: DataFrame, key: str, order: list, start: Callable[[], object], step: Callable[[object, object], dict], adds: str) -> DataFrame:
    """df with the columns of adds (a DDL list), which step gives for each row from the key's state, in order.

    A key's rows meet in one task, as a sequence must, and pass through it with the state alone held.
    """
    names = [x.strip().split(" ")[0] for x in adds.split(",")]
    schema = T.StructType(list(df.schema.fields))
    for field in adds.split(","):
        name, kind = field.strip().split(" ", 1)
        schema = schema.add(name, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = object()
        at, state = missing, None
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                k = None if pd.isna(k) else k
                if at is missing or k != at:
                    at, state = k, start()
                found.append(step(state, row))
            yield pdf.assign(**{n: [f[n] for f in found] for n in names})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def content_dedup(pages: DataFrame, job: str = "job_id", order: str = "pos", url: str = "final_url", digest: str = "content_hash") -> DataFrame:
    """is_duplicate: the page's URL or content has been kept before in its job. A duplicate registers neither."""

    def step(seen: set, row) -> dict:
        keys = {(i, v) for i, v in enumerate((getattr(row, url), getattr(row, digest))) if v is not None}
        again = bool(keys & seen)
        if not again:
            seen |= keys
        return {"is_duplicate": again}

    return fold(pages, job, [order], set, step, "is_duplicate boolean")


def throttle(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """passes: no event of the key has passed in the seconds before."""

    def step(state: dict, row) -> dict:
        t = pd.Timestamp(getattr(row, at)).timestamp()
        ok = "last" not in state or t - state["last"] >= seconds
        if ok:
            state["last"] = t
        return {"passes": ok}

    return fold(events, key, [at], dict, step, "passes boolean")


def rate_limit(events: DataFrame, key: str, at: str, limits: dict[int, int]) -> DataFrame:
    """allowed: every window (seconds to most requests, aligned to the epoch) has room. A rejected request uses up none of them."""

    def step(state: dict, row) -> dict:
        t = int(pd.Timestamp(getattr(row, at)).timestamp())
        windows = [(s, t // s) for s in limits]
        counts = [state.get(s, (None, 0)) for s in limits]
        used = [n if w == own[1] else 0 for own, (w, n) in zip(windows, counts, strict=True)]
        ok = all(n < limits[s] for n, (s, _) in zip(used, windows, strict=True))
        if ok:
            state.update({s: (w, n + 1) for (s, w), n in zip(windows, used, strict=True)})
        return {"allowed": ok}

    return fold(events, key, [at], dict, step, "allowed boolean")


def money_ledger(entries: DataFrame, project: str = "project_id", order: str = "pos", kind: str = "kind", amount: str = "cents", key: str = "operation_id", granted: str = "granted") -> DataFrame:
    """Reserve and settle: a reservation needs spent + amount <= granted and a new operation; settling corrects it to what was used, once.

    Amounts are whole numbers (hundredths of a cent, say). accepted, and spent after the row.
    """

    def start() -> dict:
        return {"spent": 0, "open": {}, "done": set()}

    def step(s: dict, row) -> dict:
        what, n, op = getattr(row, kind), int(getattr(row, amount)), getattr(row, key)
        if what == "reserve":
            ok = op not in s["open"] and op not in s["done"] and s["spent"] + n <= int(getattr(row, granted))
            if ok:
                s["open"][op] = n
                s["spent"] += n
        else:
            ok = op in s["open"]
            if ok:
                s["spent"] += n - s["open"].pop(op)
                s["done"].add(op)
        return {"accepted": ok, "spent": s["spent"]}

    return fold(entries, project, [order], start, step, "accepted boolean, spent long")


class Breaker:
    """Closed until failures in a row reach a limit, then open for a time, then half open until enough successes close it or one failure opens it."""

    def __init__(self, failures: int = 5, seconds: float = 60, successes: int = 3):
        self.most, self.seconds, self.needed = failures, seconds, successes
        self.state, self.count, self.since = "closed", 0, 0.0

    def admits(self, t: float) -> bool:
        if self.state == "open" and t - self.since >= self.seconds:
            self.state, self.count = "half_open", 0
        return self.state != "open"

    def record(self, ok: bool, t: float) -> None:
        if self.state == "half_open":
            self.count += ok
            if not ok:
                self.state, self.since = "open", t
            elif self.count >= self.needed:
                self.state, self.count = "closed", 0
        elif self.state == "closed":
            self.count = 0 if ok else self.count + 1
            if self.count >= self.most:
                self.state, self.since = "open", t


def circuit_breaker(calls: DataFrame, key: str, at: str, ok: str, failures: int = 5, seconds: float = 60, successes: int = 3) -> DataFrame:
    """admitted and breaker (its state after the call) for each call."""

    def step(b: Breaker, row) -> dict:
        t = pd.Timestamp(getattr(row, at)).timestamp()
        admitted = b.admits(t)
        if admitted:
            b.record(bool(getattr(row, ok)), t)
        return {"admitted": admitted, "breaker": b.state}

    return fold(calls, key, [at], lambda: Breaker(failures, seconds, successes), step, "admitted boolean, breaker string")
