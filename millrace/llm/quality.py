"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are documents labelled of quality 1; the unlabelled side is every training document as it comes. With the squared loss the risk
    prior * E_p[(1 - g)^2] + max(0, E_u[(1 + g)^2] - prior * E_p[(1 + g)^2])
of a linear g depends on the documents by the first and second moments of their features alone. These are summed over the
partitions, so the unlabelled side is whole at any size, and the risk is minimised exactly: where the second part would fall below
zero, its multiplier (between 0 and 1) is found at which it is zero. Labels of quality 0 are never used.

The class prior is estimated from positives and unlabelled documents too: a first g, fitted on one half of the training folds, scores the
other half, and the other way round; of all thresholds the one is taken above which unlabelled documents are fewest in proportion to
positives (with a margin for chance), and the mean of these proportions is the prior.

Features are shares of characters, of hashed words and word pairs, and how words and lines repeat. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, fold_of, lean, mixed, pieces, staged, word_hashes

#: Single characters whose share of a text is an input.
MARKS = "|!?.,;:%#$&*+-_=/\\<>()[]{}@\"'`~^"
#: Places that hashed words and word pairs share.
HASHED = 64
N_FEATURES = 16 + len(MARKS) + HASHED

_CLASS = np.zeros(256, np.uint8)
for _i, _b in enumerate(MARKS.encode()):
    _CLASS[_b] = _i + 1
for _first, _last, _k in ((65, 90, 40), (97, 122, 41), (48, 57, 42), (128, 255, 43), (9, 13, 44), (32, 32, 45)):
    _CLASS[_first : _last + 1] = _k


def features(text: str | bytes | None) -> np.ndarray:
    """Shares of character classes and hashed words, and how words and lines repeat. Empty texts give zeros and a mark of their own."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        out[-1] = 1
        return out
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
    counts = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=48).astype(np.float32)
    n = len(raw)
    out[: len(MARKS)] = np.sqrt(counts[1 : len(MARKS) + 1] / n)
    k = len(MARKS)
    out[k : k + 6] = counts[40:46] / n
    words = raw.split()
    m = len(words)
    if m:
        distinct = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:]))
        upper = counts[40] / max(1.0, counts[40] + counts[41])
        out[k + 6 : k + 12] = (distinct / m, same / m, upper, np.log1p(n / m), np.log1p(m) / 10, distinct / m**0.8)
        lines = raw.split(b"\n")
        out[k + 12 : k + 15] = (len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, max(map(len, lines)) / n)
        h = word_hashes(raw)
        pairs = mixed(h[:-1] * np.uint64(3) + h[1:])
        places = np.concatenate([mixed(h), pairs]) % np.uint64(HASHED)
        out[k + 15 : k + 15 + HASHED] = np.sqrt(np.bincount(places.astype(np.int64), minlength=HASHED) / len(places))
    else:
        out[-1] = 1
    return out


@dataclass
class Moments:
    """Number of documents, sum of their features and of the products of these, a leading 1 among them."""

    n: float
    sums: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
        return cls(float(len(x)), x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums)


#: Standardised features are cut here, so that rare marks do not outweigh the rest; weight of |w|^2. Both by validation within the training folds.
CLIP, RIDGE = 3.0, 3e-2


@dataclass
class Network:
    """g(x) = z(x) * w + bias, z the standardised features, cut at CLIP; the score is (1 + g) / 2, within 0 and 1."""

    shift: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return standardised(x, self.shift, self.scale) @ self.w + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip((1 + self.logits(x)) / 2, 0.0, 1.0)


def risk(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk, the second before it is cut at zero, from mean products of features with a leading 1."""
    plus, minus = np.eye(len(w))[0] - w, np.eye(len(w))[0] + w
    return float(prior * plus @ positive @ plus), float(minus @ unlabelled @ minus - prior * minus @ positive @ minus)


def minimiser(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = 1e-2) -> np.ndarray:
    """The w of least non-negative risk (and ridge * |w|^2).

    With multiplier m of the second part the gradient is zero where w solves one linear system; m is 1 if that part is not negative
    there, and otherwise the largest at which it is not.
    """
    one = np.eye(len(positive))[0]

    def at(m: float) -> np.ndarray:
        left = prior * (1 - m) * positive + m * unlabelled + ridge * np.eye(len(one))
        return np.linalg.solve(left, prior * (1 + m) * positive @ one - m * unlabelled @ one)

    if risk(positive, unlabelled, at(1.0), prior)[1] >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(50):
        m = (low + high) / 2
        low, high = (m, high) if risk(positive, unlabelled, at(m), prior)[1] >= 0 else (low, m)
    return at(low)


def scaling(n: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of features, this kept from zero; that of hashed words, which are many and say little each, counts ten times."""
    mean = sums / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0.0)) + 1e-3
    if len(mean) == N_FEATURES:
        scale[-1 - HASHED : -1] *= 10
    return mean, scale


def standardised(x: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - shift) / scale, -CLIP, CLIP)


def _fitted(positive: Moments, unlabelled: Moments, shift: np.ndarray, scale: np.ndarray, prior: float, ridge: float) -> Network:
    w = minimiser(positive.sums / positive.n, unlabelled.sums / unlabelled.n, prior, ridge)
    return Network(shift, scale, w[1:], float(w[0]), prior)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE) -> Network:
    """The network of features in memory, standardised by the unlabelled side."""
    p, u = np.asarray(positive, np.float64), np.asarray(unlabelled, np.float64)
    shift, scale = scaling(len(u), u.sum(axis=0), (u * u).sum(axis=0))
    return _fitted(Moments.of(standardised(p, shift, scale)), Moments.of(standardised(u, shift, scale)), shift, scale, prior, ridge)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from histograms of scores that were not fitted, lowest bin first.

    Above any threshold, the unlabelled share is at least the prior times the positive share. The threshold with the smallest quotient, allowing for
    chance by both sizes, gives the closest bound.
    """
    n, m = positive.sum(), unlabelled.sum()
    if not n or not m:
        return 0.5
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / h.sum() for h in (positive, unlabelled))
    use = above_p > 0
    chance = np.sqrt(np.log(40) / (2 * n)) + np.sqrt(np.log(40) / (2 * m))
    best = int(np.argmin((above_u[use] + 1.01 * chance) / above_p[use]))
    return float(np.clip(above_u[use][best] / above_p[use][best], 0.02, 0.98))


BINS = 4096


def histogram(g: np.ndarray) -> np.ndarray:
    """Of values of g between -3 and 3, those beyond in the outer bins."""
    return np.bincount(np.clip((g + 3) / 6 * BINS, 0, BINS - 1).astype(np.int64), minlength=BINS)


def _estimated_prior(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    """The prior of features in memory: halves are dealt by seed."""
    rng = np.random.default_rng(seed)
    (fit_p, back_p), (fit_u, back_u) = (np.array_split(rng.permutation(x), 2) for x in (p, u))
    net = fit_nnpu(fit_p, fit_u, 0.5)
    return prior_of(histogram(net.logits(back_p)), histogram(net.logits(back_u)))


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (p for batch in batches for p in pieces(batch, "text")):
        x = pa.array([features(t.as_py()).tobytes() for t in part.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("half"), part.column("positive"), x], names=["half", "positive", "x"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(half, positive, features): every document as unlabelled, trusted positives once more as such."""
    for batch in batches:
        half, positive = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "positive"))
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
        for h in (0, 1):
            yield h, False, x[half == h]
            yield h, True, x[(half == h) & positive]


def _summed(batches: Iterator[pa.RecordBatch], key: list[str], value: str) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for batch in batches:
        for *k, raw in zip(*(batch.column(c).to_pylist() for c in (*key, value)), strict=True):
            total[tuple(k)] = total.get(tuple(k), 0.0) + np.frombuffer(raw)
    if total:
        yield pa.RecordBatch.from_pydict({c: [k[i] for k in total] for i, c in enumerate(key)} | {value: [v.tobytes() for v in total.values()]}, schema=_SUMS_ARROW)


_SUMS = "half int, positive boolean, sums binary"
_SUMS_ARROW = pa.schema([("half", pa.int32()), ("positive", pa.bool_()), ("sums", pa.binary())])
FAN = 16


def _totals(rows: DataFrame, measure) -> dict[tuple[int, bool], np.ndarray]:
    """measure of the features of each half's unlabelled documents and positives, summed: partition by partition, then FAN sums into one until few are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for h, positive, x in _groups(batches):
            if len(x):
                total[h, positive] = total.get((h, positive), 0.0) + measure(x)
        if total:
            yield pa.RecordBatch.from_pydict({"half": [h for h, _ in total], "positive": [p for _, p in total], "sums": [v.astype(np.float64).tobytes() for v in total.values()]}, schema=_SUMS_ARROW)

    again = lambda batches: _summed(batches, ["half", "positive"], "sums")
    sums, parts = rows.mapInArrow(lean(run), _SUMS), rows.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(again, _SUMS)
    out: dict = {}
    for r in sums.collect():  # at most 4 * FAN rows
        out[r["half"], r["positive"]] = out.get((r["half"], r["positive"]), 0.0) + np.frombuffer(bytes(r["sums"]))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out: int = 1, sample: int = 20_000, prior: float | None = None, seed: int = 11, ridge: float = RIDGE) -> Network | None:
    """A network from the training folds, or None if these hold no positive.

    sample bounds the trusted positives, chosen by hash; the unlabelled side is all training documents. A label that is neither 0 nor 1 is none; a document
    labelled both ways counts by its mean. Rows of a null id are not learnt from, rows that repeat an id each are. Without a prior it is estimated.
    """
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.col("id").isNotNull() & (fold_of("id", folds) != held_out))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("mark")).where("id is not null and mark in (0, 1)").where(fold_of("id", folds) != held_out)
    marks = marks.groupBy("id").agg(F.avg("mark").alias("mark")).where("mark >= 0.5").select("id")
    n = marks.count()
    if not n:
        return None
    rank = F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit((1 << 62) - 1))
    # about 1.2 * sample ids, the lowest by hash: that bounds what is broadcast
    chosen = marks.where(rank < int(min(1.0, 1.2 * sample / n) * (1 << 62))).orderBy(rank).limit(sample)
    chosen = F.broadcast(staged(chosen.withColumn("yes", F.lit(True)), "positives"))
    rows = train.join(chosen, "id", "left").select((F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2))).cast("int").alias("half"), F.coalesce("yes", F.lit(False)).alias("positive"), "text")
    table = staged(rows.mapInArrow(lean(_featurised), "half int, positive boolean, x binary"), "features")
    size = N_FEATURES + 1
    plain = _totals(table, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    whole = sum((v for (_, positive), v in plain.items() if not positive), np.zeros(2 * N_FEATURES + 1))
    shift, scale = scaling(max(1.0, whole[0]), whole[1 : N_FEATURES + 1], whole[N_FEATURES + 1 :])
    sums = _totals(table, lambda x: np.concatenate([[len(x)], Moments.of(standardised(x, shift, scale)).sums.ravel()]))
    nothing = np.zeros(1 + size * size)
    moments = {(h, p): Moments(float(v[0]), v[1:].reshape(size, size)) for h in (0, 1) for p in (False, True) for v in [sums.get((h, p), nothing)]}
    both = {p: moments[0, p] + moments[1, p] for p in (False, True)}
    if not both[True].n:
        discard(table)
        return None
    if prior is None:
        found = []
        for h in (0, 1):  # each half scores the other
            if moments[h, True].n and moments[1 - h, True].n:
                first = _fitted(moments[h, True], moments[h, False], shift, scale, 0.5, ridge)
                told = _totals(table.where(F.col("half") == 1 - h), lambda x, first=first: histogram(first.logits(x)))
                found.append(prior_of(told[1 - h, True], told[1 - h, False]))
        prior = float(np.mean(found)) if found else 0.5
    discard(table)
    return _fitted(both[True], both[False], shift, scale, prior, ridge)


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held_out: int = 1) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts get the score of an empty text. Without a network (no trusted positive) every score is 0.5 and
    every row is kept. Rows that repeat an id are scored each by its own text. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in pieces(batch, "text")):
            s = _scores(net, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold_of(id_col, folds) == held_out).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def _scores(net: Network | None, texts: pa.Array) -> np.ndarray:
    if net is None:
        return np.full(len(texts), 0.5)
    return net.scores(np.array([features(t.as_py()) for t in texts], np.float64).reshape(len(texts), N_FEATURES))


def keep_good(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the network does not reject, with all their columns."""
    if net is None:
        return docs

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([_scores(net, pa.array(texts.iloc[i : i + 500])) for i in range(0, len(texts), 500)]) if len(texts) else np.empty(0))

    return docs.where(scored(F.col(text_col).cast("binary")) >= 0.5)
