"""Where results go: JSON lines, bundles, signed webhooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import member_name

DELAYS = (0, 1, 4, 16)


def json_lines(df: DataFrame) -> DataFrame:
    """value: one compact JSON object a row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, order: list, partitions: int | None = None) -> None:
    """Ordered over all files by name, sorted by range: no task holds more than its share."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    json_lines(df.repartitionByRange(n, *order).sortWithinPartitions(*order)).write.mode("overwrite").text(path)


def job_verdict(pages: DataFrame, job: str, status: str, note: str, order: str, staged: str) -> DataFrame:
    """job, completed, status, reason: a completed page whose staged object is missing has failed; a job without pages completed fails for its most common reason (the first seen of equals)."""
    ok = (F.col(status) == "completed") & F.col(staged)
    counts = pages.groupBy(job).agg(F.count_if(ok).alias("completed"), F.count_if((F.col(status) == "completed") & (F.col(note) == "DUPLICATE")).alias("duplicates"))
    why = pages.where(~F.coalesce(ok, F.lit(False)) & F.col(note).isNotNull()).groupBy(job, note).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    why = why.groupBy(job).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(note).alias("note")))["note"].alias("reason"))
    out = counts.join(why, job, "left")
    return out.withColumn("status", F.when(F.col("completed") > 0, "completed").otherwise("failed")).withColumn("reason", F.when(F.col("completed") == 0, F.col("reason")))


def assembled(records: DataFrame, pages: DataFrame, job: str, page: str, status: str, order: str) -> DataFrame:
    """Records of completed pages with line, their place in the job's file."""
    done = pages.where(F.col(status) == "completed").select(job, page, F.col(order).alias("__o"))
    w = Window.partitionBy(job).orderBy("__o", page, "chunk_index")
    return records.join(done, [job, page]).withColumn("line", F.row_number().over(w)).drop("__o")


def bundles(files: DataFrame, key: str, order: str, name: str, body: str) -> DataFrame:
    """key, content: a ZIP of a batch's files (its members are capped by the batch's limit), named by place and slug."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in pdf.sort_values("__i")[["__m", body]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(member), text)
        return pd.DataFrame({key: [pdf[key].iat[0]], "content": [out.getvalue()]})

    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = files.withColumn("__i", place).withColumn("__m", member_name(F.col("__i") - 1, name))
    return rows.select(key, "__i", "__m", body).groupBy(key).applyInPandas(pack, f"{key} {files.schema[key].dataType.simpleString()}, content binary")


def deliver(post: Callable[[str, bytes, dict], int], url: str, body: bytes, headers: dict, sleep: Callable[[float], None], delays: tuple[int, ...] = DELAYS) -> tuple[bool, int]:
    """Posts until a 2xx comes, waiting 0, 1, 4 and 16 seconds before the attempts. (delivered, attempts)"""
    for n, pause in enumerate(delays, 1):
        sleep(pause)
        try:
            if 200 <= post(url, body, headers) < 300:
                return True, n
        except OSError:
            continue
    return False, len(delays)


def deliver_all(df: DataFrame, send: Callable[[str, str], bool]) -> DataFrame:
    """url, body, delivered for a table of webhooks, a task's own share each; send must be safe to repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(delivered=[bool(send(u, b)) for u, b in zip(pdf["url"], pdf["body"], strict=True)])

    return df.select("url", "body").mapInPandas(run, "url string, body string, delivered boolean")
