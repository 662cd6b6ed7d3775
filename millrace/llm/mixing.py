"""Mixing sources to target weights by Pareto order sampling.

A document is expected in the mix rate * weight times, never more than most times; the rate of a source is the one at which the expected
words make up its target. Every document gets the whole part of that for certain; what remains of the target is filled by a Pareto
sample of unequal probabilities: documents are ranked by [u / (1 - u)] / [p / (1 - p)], u a hash of the id, p the fraction that is left, and
taken in that order while their words fit (the last one if that comes nearer). The sample's size is fixed in
words, so a source misses its target by half a document at most.

No source is sorted in one task: weights come in LEVELS steps, whose sizes are summed map-side to find the rate, and ranks are cut into
bins, whose sizes are summed map-side to find the bin in which the sample ends; only that bin's documents are ordered.
What decides is then a few numbers a source, which whole documents meet map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import small_side, staged, word_count

#: No document appears more often than this, and no source gets more than this times its size.
MOST = 3
#: Steps in which a document's weight is counted, of the largest in its source.
LEVELS = 256


def uniform(id_col: str | Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the MD5 of seed and id: the same for every run and engine."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: list[float] | None = None, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code point order, null last, weigh 1, 2, 3, repeating (or as weights repeats), and share the total size.
    Targets stop at most times the size and the excess is shared again by weight: in order of
    cap / weight, a prefix of the sources is capped and one level serves the rest.
    """
    weights = weights or [1.0, 2.0, 3.0]
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    levels = ranked.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # From the first source that stays below its cap the levels only fall, so the highest that fits is the one.
    levels = levels.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def _rates(rows: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(source, source_size, target, rate) by source: at the rate, expected words make up the target. Null where every document is taken most times.

    In order of falling level a prefix of the levels is at most times; past the first level at which that is so the
    rates only fall, so the highest that fits is the one.
    """
    levels = rows.where("level > 0").groupBy(F.col("source").alias("s"), "level").agg(F.sum("size").alias("size"))
    falling = Window.partitionBy("s").orderBy(F.desc("level"))
    before, rest = falling.rowsBetween(Window.unboundedPreceding, -1), falling.rowsBetween(0, Window.unboundedFollowing)
    t = targets.select(F.col("source").alias("t"), "target")
    levels = levels.join(t, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    left = F.col("target") - most * F.coalesce(F.sum("size").over(before), F.lit(0))
    levels = levels.withColumn("rate", F.try_divide(left, F.sum(F.col("size") * F.col("level")).over(rest)))
    rates = levels.groupBy("s").agg(F.max(F.when(F.col("rate") * F.col("level") <= most, F.col("rate"))).alias("rate"))
    return targets.join(rates, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _narrow(docs: DataFrame, id_col: str, source_col: str, text_col: str, weight_col: str | None, *more: Column) -> DataFrame:
    w = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), w.alias("w"), F.xxhash64(text_col).alias("mark"), *more)


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source, of which there is one row in the staged table sources."""
    return rows.join(small_side(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _levelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("level", F.when(F.col("size") > 0, F.coalesce(F.ceil(F.try_divide("w", "top") * LEVELS), F.lit(0))).otherwise(0))


def _ranked(rows: DataFrame, most: int, bins: int, seed: str) -> DataFrame:
    """rows, levelled and beside their rate, with the copies they get for certain, their rank for one more, and its bin."""
    expected = F.when(F.col("level") > 0, F.coalesce(F.least(F.col("rate") * F.col("level"), F.lit(float(most))), F.lit(float(most)))).otherwise(0.0)
    out = rows.withColumn("whole", F.floor(expected).cast("long")).withColumn("p", expected - F.col("whole"))
    u = uniform("doc_id", seed)
    out = out.withColumn("rank", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    # rank / (1 + rank) lies in (0, 1) and keeps the order
    return out.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * bins), F.lit(bins - 1)).cast("int"))


#: Order of a sample; rows equal in all of these differ in nothing that matters here.
_ORDER = ["rank", "doc_id", "size", "mark"]


def _decided(docs: DataFrame, columns: tuple, weights: list[float] | None, most: int, bins: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Narrow rows, ranked; a row a source (source_size, top, target, rate, and of its sample the last bin, what comes before it and the size); the
    rows of last bins, with whether each is taken once more."""
    rows = staged(_narrow(docs, *columns), "sizes")
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("w").alias("top")), "source-sizes")
    rows = _levelled(_beside(rows, sizes.select("source", "top")))
    rates = staged(_rates(rows.drop("top"), source_targets(sizes.select("source", "source_size"), weights, most), most), "rates")
    ranked = _ranked(_beside(rows, rates), most, bins, seed)
    certain = ranked.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("residual"))
    # one sum per source and bin: bins rows a source, however many documents
    sums = ranked.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sums = sums.join(certain, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_size").over(run), F.lit(0)))
    last = sums.where("before <= residual").groupBy(F.col("source").alias("s")).agg(F.max("bin").alias("last_bin"), F.max_by("before", "bin").alias("before"), F.first("residual").alias("residual"))
    ends = rates.join(sizes.select(F.col("source").alias("s2"), "top"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    ends = staged(ends.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "ends")
    edge = _beside(ranked, ends.select("source", "last_bin", "before", "residual")).where("bin = last_bin")
    order = Window.partitionBy("source").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("extra", (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2 <= F.col("residual")).cast("long"))
    return ranked, ends, edge


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: list[float] | None = None, most: int = MOST, bins: int = 4096, seed: str = "mix", weight_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    size counts words; null and empty texts have size 0 and are never taken. A null source is a source of its own,
    the last. A null id hashes like the text "null". Rows that repeat an id keep their own size and copies.
    weight_col: how often a document is expected against the others of its source, up to most times (null and less than 0: 0; counted in LEVELS
    steps of the source's largest; by default all alike). A source whose documents with weight don't reach its target at most copies each stays
    below it. An empty table gives an empty result.
    """
    ranked, ends, edge = _decided(docs, (id_col, source_col, text_col, weight_col), weights, most, bins, seed)
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    rest = _beside(ranked, ends.select("source", "last_bin")).where("bin is null or last_bin is null or bin <> last_bin")
    rest = rest.withColumn("extra", F.coalesce((F.col("bin") < F.col("last_bin")).cast("long"), F.lit(0)))
    out = rest.select(*columns).unionByName(edge.select(*columns)).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: list[float] | None = None, most: int = MOST, bins: int = 4096, seed: str = "mix",
    weight_col: str | None = None,
) -> DataFrame:
    """docs as the mix takes them: a row stands as often as it is taken, with all its columns, whatever their names.

    Texts stay where they are: a few numbers a source say of each row how often it is taken. Where a sample ends among rows that are equal in id, source
    and text, one of them stands for those that are taken once more. An empty table stays empty.
    """
    columns = (id_col, source_col, text_col, weight_col)
    _, ends, edge = _decided(docs, columns, weights, most, bins, seed)
    # the last rows that a sample takes: what they are, how many are equal, and how many of these it takes
    cut = edge.groupBy(F.col("source").alias("s"), F.struct(*_ORDER).alias("cut")).agg(F.sum("extra").alias("taken"), F.count(F.lit(1)).alias("equal")).where("taken > 0")
    cut = cut.groupBy("s").agg(F.max(F.struct("cut", "taken", "equal")).alias("c")).select("s", "c.cut", F.col("c.taken").alias("torn"), (F.col("c.taken") < F.col("c.equal")).alias("is_torn"))
    ends = staged(ends.select("source", "top", "rate", "last_bin").join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "cuts")
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _ranked(_levelled(_beside(_narrow(docs, *columns, whole_row), ends)), most, bins, seed)
    own = F.struct(*_ORDER)
    last = own.eqNullSafe(F.col("cut"))
    inside = (F.col("bin") < F.col("last_bin")) | ((F.col("bin") == F.col("last_bin")) & ((last & ~F.col("is_torn")) | (~last & (own < F.col("cut")))))
    found = rows.withColumn("copies", (F.col("whole") + F.coalesce(inside, F.lit(False)).cast("int")).cast("int"))
    out = found.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
    if ends.where("is_torn").take(1):
        torn = found.where(last & F.col("is_torn")).dropDuplicates(["source", "doc_id", "mark"])
        out = out.union(torn.select("row", F.explode(F.sequence(F.lit(1), F.col("torn").cast("int")))).select("row.*"))
    return out
