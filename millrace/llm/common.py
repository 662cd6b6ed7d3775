"""Shared-folder tables, and word and hash helpers that several operators use.

Words are the runs of `[^\\x20\\x09-\\x0D]`, which is what bytes.split() without
arguments yields on UTF-8; bytes.lower() lowers A-Z alone.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space, in SQL and Python alike: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for a local master without it one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Narrow rows that are worth a task and a file of their own.
ROWS_A_FILE = 25_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and survives lost executors.

    rows: a bound on its number of narrow rows, where one is known: no more files are written than these are worth.
    The table goes when it is discarded, or when the driver ends, since later lazy results read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing lazy still reads."""
    for df in tables:
        _delete(df.sparkSession, df.staged_at)


def lean(run: Callable, *forget: Callable[[], None]) -> Callable:
    """run, a function over batches, which at its end forgets what is named and gives freed memory back to the system: workers outlive their tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


#: Rows of a narrow table (ids, hashes) that are broadcast at most: some 50 MB.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """df, a staged table of narrow rows, for a join against whole texts: broadcast if it is counted to be small enough, else
    hashed partition by partition. Either way the texts' side streams past it and is not sorted."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, marks: DataFrame, id_col: str, mark: Column, rows: int | None = None) -> DataFrame:
    """docs, with all their columns, less the rows of which marks speak.

    marks: (id, mark, stays), one row for each id and mark it speaks of; mark is a hash of a row's text. Where stays holds, one of the rows with
    that id and mark is left, else none. Ids may be null. rows: a bound on the number of marks.
    """
    marks = staged(marks, "marks", rows)
    own, i, m, s = unused(docs, "own", "id", "mark", "stays")
    side = small_side(marks.toDF(i, m, s))
    found = docs.withColumn(own, mark).join(side, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(own) == F.col(m)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = found.where(F.col(s).isNull()).select(columns)
    if marks.where("stays").take(1):
        out = out.union(found.where(F.col(s)).dropDuplicates([i, m]).select(columns))
    return out


def pieces(batch: pa.RecordBatch, text: str, rows: int = 1000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes of the binary column text, one row at least."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right"))))
        yield batch.slice(a, b - a)
        a = b


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of each run of rows with equal keys (integers), of batches that are sorted by them. Only one run is held."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1), len(pdf)]
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        for a, b in zip(starts[:-2], starts[1:-1], strict=True):
            yield {c: v[a:b] for c, v in columns.items()}
        held = pdf.iloc[starts[-2] :]
    if held is not None:
        yield {c: held[c].to_numpy() for c in held.columns}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id falls in the fold of the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def word_count(text: str | Column) -> Column:
    """Number of words of a text, JVM-side; null and empty texts have none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lowered, in order. bytes are UTF-8."""
    if not text:
        return np.empty(0, np.uint64)
    words = (text if isinstance(text, bytes) else text.encode("utf-8", "replace")).lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums of hashes are again uniform."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
