"""Near-duplicate embeddings by sorted projection passes.

Each pass gives every vector a key of concatenated random-hyperplane bits, taken from the mean of its
group, sorts all vectors by (group, key) and compares each with its next neighbours in that order. The
number of passes grows with the group, so that a pair at the threshold is missed by all with a stated
probability. Verified pairs of all passes are joined into components. A window is bounded, so inside the components found, all members are
then compared block by block: no partner is lost to the window in a dense group, and no pair is
ever written out for it.

Equal vectors stand as one row (with a count) from the start, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, partitions, staged
from millrace.llm.graph import connected_components, forest

PASSES, BITS, WINDOW, BLOCK = 12, 48, 32, 1024
#: Probability that a pair at the threshold meets in no pass. Prefixes are taken SLACK bits longer than even buckets need.
MISS, SLACK = 1e-4, 2


def _unit(vecs: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and sum of unit vectors by group."""
    held: dict = {}

    def flush() -> pd.DataFrame:
        rows = [(g, d, n, x) for (g, d), (n, x) in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["grp", "dim", "n", "total"])

    for pdf in batches:
        for key, part in pdf.groupby(["grp", "dim"]):
            n, x = held.get(key, (0, 0.0))
            held[key] = n + len(part), x + _unit(part["vec"]).sum(axis=0)
        if len(held) > 10_000:
            yield flush()
    if held:
        yield flush()


def _passes(n: int, spread: float, threshold: float, window: int, least: int) -> int:
    """So many that a pair at the threshold shares the prefix of a window in one of them but for MISS. spread: root mean square distance from the mean."""
    chord = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    differs = min(0.25, 2 * float(np.arcsin(min(1.0, chord / 2 / max(spread, 1e-9)))) / np.pi)
    meets = (1 - differs) ** max(0.0, np.log2(n / window) + SLACK)
    return max(least, int(np.ceil(np.log(MISS) / np.log1p(-min(meets, 1 - MISS)))))


def _centres(threshold: float, window: int, least: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        mean = np.sum(np.stack(list(pdf["total"])), axis=0) / n
        passes = _passes(n, float(np.sqrt(max(0.0, 1 - mean @ mean))), threshold, window, least)
        return pd.DataFrame({"grp": [pdf["grp"].iat[0]], "dim": [pdf["dim"].iat[0]], "passes": [passes], "mean": [mean]})

    return run


def _keys(bits: int, seed: int):
    weights = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict = {}
        for pdf in batches:
            for (dim, passes), part in pdf.groupby(["dim", "passes"]):
                dim = int(dim)
                x = _unit(part["vec"]) - np.stack(list(part["mean"]))
                raw = [np.asarray(v, dtype=np.float64).tobytes() for v in part["vec"]]
                for p in range(int(passes)):
                    if (dim, p) not in planes:
                        planes[dim, p] = np.random.default_rng([seed, dim, p]).standard_normal((dim, bits))
                    key = ((x @ planes[dim, p] >= 0).astype(np.uint64) * weights).sum(axis=1)
                    yield pd.DataFrame({"pass": p, "grp": part["grp"].values, "dim": dim, "key": key.astype(np.int64), "rep": part["rep"].values, "raw": raw})

    return run


def _windows(threshold: float, window: int):
    """Pairs among neighbours of a sorted partition, and its first and last rows, which neighbours of other partitions meet later."""

    def rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(pdf["raw"]), np.float64).reshape(len(pdf), -1)
        return x / np.linalg.norm(x, axis=1, keepdims=True), pdf["rep"].to_numpy()

    def pairs(pdf: pd.DataFrame, fresh: int) -> pd.DataFrame:
        """Links that join what is similar here, a forest of them. fresh: index of the first row not compared with its predecessors before."""
        found_a, found_b = [], []
        for _, part in pdf.reset_index(drop=True).groupby(["pass", "grp", "dim"], sort=False):
            x, rep = rows(part)
            new = part.index.to_numpy() >= fresh
            root = np.arange(len(part))
            for k in range(1, min(window, len(part) - 1) + 1):
                apart = np.flatnonzero(new[k:] & (root[:-k] != root[k:]))
                hit = apart[np.einsum("ij,ij->i", x[apart], x[apart + k]) >= threshold]
                found_a.append(rep[hit])
                found_b.append(rep[hit + k])
                np.minimum.at(root, root[hit], root[hit + k])
                np.minimum.at(root, root[hit + k], root[hit])
                while (root != root[root]).any():
                    root = root[root]
        if not found_a:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def edge(pdf: pd.DataFrame, seam: int, side: int) -> pd.DataFrame:
        return pdf.assign(a=None, b=None, seam=seam, side=side, pos=range(len(pdf)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, tail = TaskContext.get().partitionId(), None
        head: list = []
        held = 0
        for pdf in batches:
            if held < window and len(pdf):
                head.append(pdf.head(window - held))
                held += len(head[-1])
            both = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            found = pairs(both, 0 if tail is None else len(tail))
            if len(found):
                yield found.assign(**{"pass": None, "grp": None, "dim": None, "rep": None, "raw": None, "seam": None, "side": None, "pos": None})
            tail = both.tail(window)
        if tail is not None and len(tail):
            yield edge(pd.concat(head, ignore_index=True), pid - 1, 1)
            yield edge(tail, pid, 0)

    def seam(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "pos"]).reset_index(drop=True)
        return pairs(pdf, int((pdf["side"] == 0).sum()))

    return run, seam


def _block_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iat[0]), int(pdf["q"].iat[0])
        x = np.frombuffer(b"".join(pdf["raw"]), np.float64).reshape(len(pdf), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        copies, bucket, rep = pdf["copies"].to_numpy(), pdf["bucket"].to_numpy(), pdf["rep"].to_numpy()
        if p == q:
            hit = x @ x.T >= threshold
            np.fill_diagonal(hit, False)
            return pd.DataFrame({"rep": rep, "linked": hit @ copies})
        one, two = np.flatnonzero(bucket == p), np.flatnonzero(bucket == q)
        hit = x[one] @ x[two].T >= threshold
        return pd.DataFrame({"rep": np.concatenate([rep[one], rep[two]]), "linked": np.concatenate([hit @ copies[two], hit.T @ copies[one]])})

    return run


def _block_forest(threshold: float):
    """What _block_links counts, as edges that join it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf["p"].iat[0]), int(pdf["q"].iat[0])
        x = np.frombuffer(b"".join(pdf["raw"]), np.float64).reshape(len(pdf), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        bucket, rep = pdf["bucket"].to_numpy(), pdf["rep"].to_numpy()
        one, two = (np.arange(len(rep)),) * 2 if p == q else (np.flatnonzero(bucket == p), np.flatnonzero(bucket == q))
        hit = x[one] @ x[two].T >= threshold
        if p == q:
            np.fill_diagonal(hit, False)
        return forest(hit, rep[one], rep[two], p == q)

    return run


def _in_blocks(members: DataFrame, by: str, block: int) -> DataFrame:
    """Vectors (rep, copies, vec and by) dealt to all pairs of buckets of their value of by, about block of them a bucket."""
    blocks = members.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = members.join(blocks, by).withColumn("bucket", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select(F.col(by).cast("long").alias("component"), "rep", "copies", "bucket", F.least("bucket", "other").alias("p"), F.greatest("bucket", "other").alias("q"), "vec")
    return members.mapInPandas(_packed, "component long, rep long, copies long, bucket int, p int, q int, raw binary")


def _by_passes(classes: DataFrame, threshold: float, passes: int, bits: int, window: int, seed: int) -> DataFrame:
    """(node, component) of vectors that sorted projection passes join."""
    n = partitions(classes.sparkSession)
    kind = classes.schema["grp"].dataType.simpleString()
    centres = classes.select("grp", "dim", "vec").mapInPandas(_sums, f"grp {kind}, dim int, n long, total array<double>")
    centres = staged(centres.groupBy("grp", "dim").applyInPandas(_centres(threshold, window, passes), f"grp {kind}, dim int, passes int, mean array<double>"), "centres")
    centred = classes.select("grp", "dim", "vec", "rep").join(centres, ["grp", "dim"])
    keyed = centred.mapInPandas(_keys(bits, seed), f"pass int, grp {kind}, dim int, key long, rep long, raw binary")
    order = ["pass", "grp", "dim", "key", "rep"]
    run, seam = _windows(threshold, window)
    schema = keyed.select("pass", "grp", "dim", "rep", "raw").schema
    found = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("key")
    extra = "a long, b long, seam int, side int, pos int"
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", " + extra
    names = [f.strip().split(" ")[0] for f in out_schema.split(",")]
    found = staged(found.mapInPandas(lambda it: (x[names] for x in run(it)), out_schema), "pairs")
    seams = found.where("seam >= 0").groupBy("seam").applyInPandas(seam, "a long, b long")
    links = staged(found.where("a is not null").select("a", "b").union(seams).distinct(), "links")
    parts = staged(connected_components(links, rows=links.count()), "parts", classes.count())
    discard(found, centres, links)
    return parts


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", threshold: float = 0.98,
    passes: int = PASSES, bits: int = BITS, window: int = WINDOW, block: int = BLOCK, seed: int = 7, exact: bool = False,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of equal, non-null group and equal length link at a cosine (double precision) of threshold or more. Vectors
    that are null, empty, zero or hold null or non-finite components, and those of a null group, link with nothing.
    Rows that repeat an id count as vectors of their own; a null id never names a component that has another. An empty
    table gives an empty result. Other columns are not read. Passes are the least; larger groups get more. exact: no passes, but every vector is
    compared with all others of its group, block by block: nothing is missed, and the work is quadratic in a group.
    """
    v = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.coalesce(F.col("grp").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("k1", F.when(F.col("sound"), F.xxhash64("vec"))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(seed), "vec")))
    classes = (
        rows.where("sound").groupBy("grp", "k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
        .withColumn("rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))
    )
    classes = staged(classes, "vectors")
    if exact:
        dealt = staged(_in_blocks(classes.withColumn("place", F.xxhash64("grp", "dim")), "place", block), "blocks")
        links = staged(dealt.groupBy("component", "p", "q").applyInPandas(_block_forest(threshold), "a long, b long"), "links")
        parts = staged(connected_components(links, rows=links.count()), "parts", classes.count())
        discard(links)
    else:
        parts = _by_passes(classes, threshold, passes, bits, window, seed)
        members = classes.join(parts, classes["rep"] == parts["node"]).select("rep", "component", "copies", "vec")
        dealt = _in_blocks(members, "component", block)
    counted = dealt.groupBy("component", "p", "q").applyInPandas(_block_links(threshold), "rep long, linked long")
    linked = counted.groupBy("rep").agg(F.sum("linked").alias("linked"))
    # a component's name is its smallest id, whatever the numbers of its vectors
    named = classes.join(parts, F.col("rep") == F.col("node")).groupBy("component").agg(F.min("id").alias("name"))
    named = parts.join(named, "component").select("node", "name")
    verdict = classes.select("grp", "k1", "k2", "rep", "id", "copies").join(named, F.col("rep") == F.col("node"), "left").join(linked, "rep", "left")
    verdict = verdict.select("grp", "k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "id").alias("component_id"))
    sure = rows.where("sound").select("id", "grp", "k1", "k2").join(verdict, ["grp", "k1", "k2"]).select("id", "n_links", "component_id")
    rest = rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return sure.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="vec").assign(raw=[np.asarray(v, dtype=np.float64).tobytes() for v in pdf["vec"]])
