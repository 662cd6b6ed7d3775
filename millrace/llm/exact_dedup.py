"""Exact deduplication with a heavy-hitter split.

1. One pass makes a narrow table: id, hash of the text, SHA-256 of the normalised text, code points.
2. Misra-Gries summaries (k counters a partition) are summed by digest. A digest held by more
   than 2N/k rows is surely among the k largest sums; only its exact, verified count decides.
3. The winners of those few digests (at most k) are broadcast and decide their copies map-side,
   so the largest groups never meet in one task.
4. Every other digest goes through ordinary shuffles of that narrow table, pre-aggregated; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BLANKS, staged, without


def normalised(text: str) -> F.Column:
    """The text without white space (space, \\t \\n \\v \\f \\r); null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def trimmed(counts: dict, k: int) -> dict:
    """A Misra-Gries summary of at most k counters: the (k+1)th largest count is taken from all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def _summaries(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        for pdf in batches:
            for d, c in pdf["digest"].value_counts().items():
                counts[d] = counts.get(d, 0) + int(c)
            counts = trimmed(counts, k)
        if counts:
            yield pd.DataFrame({"digest": list(counts), "n": list(counts.values())})

    return run


def frequent(digests: DataFrame, k: int = 1024) -> DataFrame:
    """At most k candidate digests, every one with more than 2N/k rows among them."""
    parts = digests.select("digest").mapInPandas(_summaries(k), "digest string, n long")
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def _decided(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, mark (a hash of the original text), digest, group_size, keep_id and keep_mark of every row."""
    narrow = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("mark"),
            F.sha2(normalised(text_col), 256).alias("digest"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"),
        ),
        "digests",
    )
    total = narrow.count()
    best = F.struct((-F.col("n")).alias("minus_n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "mark")
    decided = lambda rows: rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = decided(narrow.join(F.broadcast(frequent(narrow, k)), "digest")).where(F.col("group_size") * F.lit(k) > F.lit(2 * total))
    winners = F.broadcast(staged(winners, "winners", k))  # at most k rows
    hot = narrow.join(winners, "digest")
    cold = narrow.join(winners.select("digest"), "digest", "left_anti")
    cold = cold.join(decided(cold), "digest")
    columns = ["doc_id", "mark", "digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.mark").alias("keep_mark")]
    return hot.select(*columns).unionByName(cold.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with most code points in the original, then the smallest id, stays
    (null ids last). Null and blank texts are equal to one another. Rows of a group that share the id that stays are all marked as kept.
    An empty table gives an empty result; other columns are not read.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return _decided(docs, id_col, text_col, k).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns.

    Rows are judged one by one: of rows that repeat an id each goes or stays by its own text, and of wholly equal rows,
    or rows of a null id with equal texts, one stays. Texts are neither shuffled nor sorted while the rows that go are few enough
    to be broadcast, and then only hashed past them. Any column names may stand in docs. An empty table stays empty.
    """
    rows = _decided(docs, id_col, text_col, k).where("group_size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    marks = rows.groupBy("doc_id", "mark").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1")
    return without(docs, marks.select("doc_id", "mark", "stays"), id_col, F.xxhash64(text_col))
