"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document is the set of its word shingles. Its signature is K minima of b bits each. Signatures that differ in at most
2 m - 1 places agree, in one of the m chunks they are split into, in all places but one (pigeonhole), so each chunk
is indexed under every key that leaves out one place: all pairs within that distance meet under some key.

Within a key nobody is paired with everybody. First each member meets the key's smallest one; candidates are verified
on full shingle sets and joined to components. Keys that still hold several components are gathered into
clusters, and in these every document outside the cluster's main component meets every other in blocks: first by signature, which leaves
the documents that may be similar to one of another component, then these on full sets, whose
intersection sizes are matrix products. No pair is written out but a spanning forest of links. That
work (not its rows) is quadratic in what the first step leaves open of one cluster; it is spread over tasks of bounded size.
Documents of equal sets stand as one from the start, a node with a number of its own.

Texts are read twice, in bounded slices, and never sorted or dealt out: once for signatures, and once, where a document shares a key,
for its sorted shingle hashes, which are what is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, lean, mixed, partitions, pieces, runs, small_side, staged, without, word_hashes
from millrace.llm.graph import connected_components, forest

SHINGLE, CHUNKS, PLACES = 5, 8, 6
K = CHUNKS * PLACES
#: Signature places that may differ for a candidate to be verified: four deviations above the mean at 0.85; five above that at 0.80 in blocks.
SLACK, BLOCK_SLACK = 20, 24

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, K, dtype=np.uint64)
_POW = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, one without words has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    w = min(width, len(h))
    total = h[: len(h) - w + 1] * _POW[0]
    for i in range(1, w):
        total = total + h[i : len(h) - w + 1 + i] * _POW[i]
    return np.unique(mixed(total + np.uint64(w)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K minima of each non-empty set, the lowest 16 bits of each."""
    out = np.empty((len(sets), K), np.uint16)
    at = 0
    while at < len(sets):  # a few hundred thousand shingles at a time stay in the CPU's cache
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= 200_000):
            n += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for k in range(K):
            out[at:end, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], starts) & np.uint64(0xFFFF)
        at = end
    return out


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """The lowest 4 bits of each place, 16 places a long: their distance is never above the signature's."""
    low = (sig & 0xF).astype(np.uint64).reshape(len(sig), 3, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2).astype(np.int64)


def _signed(width: int):
    """Of every row its id and mark, the size and digest of its set, and its signature; a text without words has size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pieces(batch, "text")):
            sets = [shingles(t.as_py(), width) for t in part.column("text")]
            n = np.array([len(s) for s in sets], np.int64)
            has = np.flatnonzero(n)
            sig = signatures([sets[i] for i in has]) if len(has) else np.empty((0, K), np.uint16)
            digests = np.zeros((len(n), 2), np.int64)
            nib = np.zeros((len(n), 3), np.int64)
            raw: list[bytes | None] = [None] * len(n)
            nib[has] = _nibbles(sig)
            for i, own in zip(has, sig, strict=True):
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(sets[i].tobytes()), ">i8")
                raw[i] = own.tobytes()
            columns = [part.column("id"), part.column("mark"), *map(pa.array, (n, digests[:, 0], digests[:, 1])), pa.array(raw, pa.binary()), *(pa.array(nib[:, j]) for j in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "n", "d1", "d2", "sig", "s1", "s2", "s3"])

    return run


def _sets(width: int):
    """Sorted shingle hashes of a node's text, once a task however often the text stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in (p for batch in batches for p in pieces(batch, "text")):
            new = [i for i, x in enumerate(part.column("node").to_pylist()) if not (x in done or done.add(x))]
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(new, pa.int64())), pa.array([shingles(part.column("text")[i].as_py(), width).tobytes() for i in new], pa.binary())], names=["node", "shingles"])

    return run


def _set(raw: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(raw if isinstance(raw, bytes) else raw.as_buffer(), np.uint64)


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each chunk and left-out place: CHUNKS * PLACES keys a signature."""
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), CHUNKS, PLACES).astype(np.uint64)
        rep = pdf["rep"].to_numpy()
        keys = []
        for c in range(CHUNKS):
            terms = mixed(sig[:, c, :] + (np.arange(PLACES, dtype=np.uint64) + np.uint64(1 + c * PLACES)) * np.uint64(1 << 20))
            whole = terms.sum(axis=1, dtype=np.uint64)
            keys += [mixed(whole - terms[:, j] + np.uint64(c * PLACES + j + 1)) for j in range(PLACES)]
        yield pd.DataFrame({"key": np.concatenate(keys).astype(np.int64), "rep": np.tile(rep, len(keys))})


def _nibble_distance(a: str, b: str) -> Column:
    total = F.lit(0)
    for s in ("s1", "s2", "s3"):
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        spread = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(spread.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes and signatures allow the similarity."""
    size = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return size & (_nibble_distance(a, b) <= SLACK)


def _verified(percent: int):
    """Streams rows sorted by (hub, salt, role): a hub's own set, then its candidates'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            a, b = [], []
            hubs, salts, roles, nodes = (batch.column(c).to_pylist() for c in ("hub", "salt", "role", "node"))
            raw = batch.column("shingles")
            for i, (hub, salt, role, node) in enumerate(zip(hubs, salts, roles, nodes, strict=True)):
                if role == 0:
                    if at != (hub, salt):
                        at, own = (hub, salt), _set(raw[i]).copy()
                    continue
                other = _set(raw[i])
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(hub)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int, rows: int, share: int = 500) -> DataFrame:
    """(a, b) of the pairs (hub, node) whose full shingle sets are similar enough.

    A hub's set goes out once for each share of its candidates, not once a pair. rows: the number of pairs.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(1 << 20)))
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / share).alias("shares"))
    pairs = pairs.join(many, "hub").withColumn("salt", (F.col("salt") % F.col("shares")).cast("int"))
    ask = pairs.select("hub", "salt", F.lit(1).alias("role"), "node")
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("node"))
    met = sets.join(small_side(staged(ask.union(hubs), "asked", 2 * rows)), "node")
    met = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").select("hub", "salt", "role", "node", "shingles")
    return met.mapInArrow(lean(_verified(percent)), "a long, b long")


_BLOCK = ["cluster", "p", "q"]


def _sides(p: int, q: int, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (np.arange(len(bucket)),) * 2 if p == q else (np.flatnonzero(bucket == p), np.flatnonzero(bucket == q))


def _promising(percent: int):
    """Of two buckets (or one), the nodes whose signature and size allow a link to one of another part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, _BLOCK):
            part, n, sig = rows["part"], rows["n"], np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, K)
            one, two = _sides(rows["p"][0], rows["q"][0], rows["bucket"])
            differ = np.zeros((len(one), len(two)), np.uint8)
            if differ.size < 2000:
                differ += (sig[one][:, None] != sig[two][None]).sum(axis=2, dtype=np.uint8)
            else:
                for k in range(K):
                    differ += sig[one, k][:, None] != sig[two, k][None, :]
            small, large = np.minimum(n[one][:, None], n[two][None, :]), np.maximum(n[one][:, None], n[two][None, :])
            hit = (differ <= BLOCK_SLACK) & (part[one][:, None] != part[two][None, :]) & (100 * small >= percent * large)
            use = np.unique(np.concatenate([one[hit.any(axis=1)], two[hit.any(axis=0)]]))
            if len(use):
                yield pd.DataFrame({c: rows[c][use] for c in (*_BLOCK, "bucket", "node")})

    return run


def _blocks(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, _BLOCK):
            _, at = np.unique(rows["node"], return_index=True)
            sets = [_set(x) for x in rows["shingles"][at]]
            yield _block(rows["node"][at], sets, *_sides(rows["p"][0], rows["q"][0], rows["bucket"][at]), percent)

    return run


def _block(ids: np.ndarray, sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, percent: int, columns: int = 4096) -> pd.DataFrame:
    """Links between the documents at one and at two (the same, for all within), as a spanning forest."""
    if not len(one) or not len(two):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    n = np.array([len(x) for x in sets], np.int64)
    doc = np.repeat(np.arange(len(ids)), n)
    _, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held >= 2  # others meet nobody
    number = np.cumsum(common) - 1
    use = common[inverse]
    doc, column = doc[use], number[inverse[use]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((len(one), len(two)), np.float32)
    for first in range(0, int(common.sum()), columns):
        lo, hi = np.searchsorted(column, [first, first + columns])
        part = np.zeros((len(ids), min(columns, int(common.sum()) - first)), np.float32)
        part[doc[lo:hi], column[lo:hi] - first] = 1
        both += part[one] @ part[two].T
    union = n[one][:, None] + n[two][None, :] - both
    hit = 100.0 * both >= float(percent) * union
    same = one is two
    if same:
        np.fill_diagonal(hit, False)
    return forest(hit, ids[one], ids[two], same)


def across(shared: DataFrame, parts: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, rows_: int, documents: int = 384, shingles_: int = 300_000) -> DataFrame | None:
    """Links (a, b) between components that some key holds together; None where no key holds two.

    A bucket has about documents members and shingles_ shingles, so a task's memory does not depend on the cluster.
    """
    member = shared.select("key", "hub", "node").join(parts.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("key", "hub", "node", F.coalesce("component", "node").alias("part"))
    split = member.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    open_ = staged(member.join(split, "key").select("hub", "node", "part").distinct(), "open", rows_)
    if not open_.take(1):
        discard(open_)
        return None
    clusters = staged(connected_components(open_.where("hub <> node"), "hub", "node", rows_), "clusters", rows_).select("node", F.col("component").alias("cluster"))
    rows = open_.select("node", "part").distinct().join(clusters, "node").join(classes.select("node", "n"), "node")
    per = staged(rows.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")), "open-parts", rows_)
    main = per.groupBy("cluster").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.max(F.struct("m", "part", "n")).alias("x"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    buckets = lambda m, n: F.ceil(F.greatest(m / documents, n / shingles_)).cast("int")
    main = main.select("cluster", "main", buckets(F.col("x.m"), F.col("x.n")).alias("of_main"), buckets(F.col("m") - F.col("x.m"), F.col("n") - F.col("x.n")).alias("of_rest"))
    rows = rows.join(main, "cluster").withColumn("is_main", F.col("part") == F.col("main"))
    h = F.xxhash64("node")
    rows = rows.withColumn("bucket", F.when(F.col("is_main"), F.pmod(h, F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(h, F.col("of_rest"))).cast("int"))
    rows = rows.select("node", "cluster", "part", "bucket", "is_main", "of_main", "of_rest").join(classes.select("node", "n", "sig"), "node")
    first = F.when(F.col("is_main"), F.col("of_main")).otherwise(F.lit(0))
    rows = rows.withColumn("other", F.explode(F.sequence(first, F.col("of_main") + F.col("of_rest") - 1)))
    rows = rows.select("cluster", "node", "part", "bucket", F.least("bucket", "other").alias("p"), F.greatest("bucket", "other").alias("q"), "n", "sig")
    deal = lambda df: df.repartition(partitions(df.sparkSession), *_BLOCK).sortWithinPartitions(*_BLOCK)
    met = staged(deal(rows).mapInPandas(_promising(percent), "cluster long, p int, q int, bucket int, node long"), "promising")
    discard(open_)
    return deal(sets.join(small_side(met), "node")).mapInPandas(lean(_blocks(percent)), "a long, b long")


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, nulls: bool) -> DataFrame:
    """id, mark (a hash of the text), n, and of the row's component keep (no_id, id, mark) of its smallest row; null where the row takes part in none."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    signed = staged(rows.mapInArrow(lean(_signed(width)), "id long, mark long, n long, d1 long, d2 long, sig binary, s1 long, s2 long, s3 long"), "signatures")
    some = signed.where("n > 0") if nulls else signed.where("n > 0 and id is not null")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("least")
    classes = some.groupBy("d1", "d2").agg(least, F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("sig", "s1", "s2", "s3")])
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, as it is written
    many = classes.count()
    keys = classes.select(F.col("node").alias("rep"), "sig").mapInPandas(lean(_indexed), "key long, rep long").withColumnRenamed("rep", "node")
    # members of keys with company, with the key's smallest one: the rest of the index is read no more
    lowest = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    shared = staged(keys.join(lowest.hint("shuffle_hash"), "key"), "index")
    sizes = classes.select("node", "n", "s1", "s2", "s3")
    stars = shared.where("node <> hub").select("hub", "node").distinct().alias("p")
    stars = stars.join(sizes.alias("x"), F.col("p.node") == F.col("x.node")).join(sizes.alias("y"), F.col("hub") == F.col("y.node"))
    stars = staged(stars.where(_alike("x", "y", percent)).select("hub", "p.node"), "stars", many)
    n_stars = stars.count()
    wanted = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("least.id").alias("wanted_id"), F.col("least.mark").alias("wanted_mark"))
    wanted = small_side(staged(wanted, "wanted", many))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark"))).select("node", "text")
    sets = staged(found.mapInArrow(lean(_sets(width)), "node long, shingles binary"), "sets")
    first = staged(verify(stars, sets, percent, n_stars), "links", n_stars)
    parts = staged(connected_components(first, rows=n_stars), "parts", many)
    more = across(shared, parts, classes, sets, percent, many)
    if more is not None:
        more = staged(more, "links", many)
        last, parts = parts, staged(connected_components(first.union(more), rows=n_stars + many), "parts", many)
        discard(more, last)
    discard(shared, stars, sets, first)
    linked = classes.join(parts, "node").select("d1", "d2", "component", "least")
    keep = linked.groupBy("component").agg(F.min("least").alias("keep"))
    linked = linked.join(keep, "component").select("d1", "d2", "keep")
    named = classes.select("d1", "d2", "least").join(linked, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("keep", "least").alias("keep"))
    rest = signed.where("n = 0") if nulls else signed.where("n = 0 or id is null")
    return some.select("id", "mark", "n", "d1", "d2").join(named, ["d1", "d2"]).select("id", "mark", "n", "keep").union(rest.select("id", "mark", "n", F.lit(None).cast(named.schema["keep"].dataType)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Links: 100 * intersection >= percent * union, on full sets of shingles of width words, A-Z lowered. Documents without
    words have no shingles and link with nothing, not even with one another. Ids are integers; rows of a null id
    link with nothing; rows that repeat an id are documents of their own, each linked by its own text. An empty table
    gives an empty result. Other columns are not read.
    """
    component = F.coalesce("keep.id", "id")
    return _judged(docs, id_col, text_col, percent, width, nulls=False).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay, one a component, with all their columns.

    The row with the smallest id stays (null ids last). Rows are judged one by one, those of a null id too: of rows that repeat an id each
    goes or stays by its own text, and of wholly equal rows with words one stays. Rows without words all stay. Any column names may stand in
    docs. An empty table stays empty.
    """
    rows = _judged(docs, id_col, text_col, percent, width, nulls=True).where("keep is not null")
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("mark") == F.col("keep.mark"))
    marks = rows.groupBy("id", "mark").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("rows")).where("not stays or rows > 1")
    return without(docs, marks.select("id", "mark", "stays"), id_col, F.xxhash64(text_col))
