"""A Katz backoff bigram model of a corpus and the log probability of every text under it.

Every word seen has n-gram counts of its own; words never seen share one class. The frequent words (those of count T or more, T
the least that keeps them within the bound on what is broadcast) go by places in a table that is broadcast, all others by hash: their
counts stay in a table of words and are joined to the pairs that need them, so the model does not depend on the bound. With a
vocabulary, all words beyond it share one class, whose members split its probability by their exact discounted counts. Good-Turing discounts lower counts up to 5; what they free goes, by
backoff weights that make each history sum to one exactly, to the words not seen after it.

Texts are read twice: for word counts, and to deal the pairs (history, word) of each block of texts, with their
positions, to partitions by history. A partition sums a pair's count over all blocks and is written once; since it holds all pairs of a
history it can weigh them when the corpus-wide counts of counts are known, and adds up each text's share.
Pairs of frequent histories are spread by pair, pairs of two frequent words by block, and their sums
(a bounded number) are broadcast, so no word, however common, fills a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, fold_of, lean, mixed, staged, word_hashes

#: Counts up to LOW are discounted. A word is frequent from a HOT-th part of all tokens.
LOW, HOT = 5, 1000
FREQUENT, BLOCK, PART, HELD = 1 << 18, 500_000, 1_500_000, 700_000
#: Ids of words that are not broadcast have this bit, the others are places.
TAIL = np.uint64(1 << 63)


def packed(a: np.ndarray, delta: bool = False) -> bytes:
    """Non-negative integers in as few bytes as their largest needs (of their steps, if they ascend), first all lowest bytes, then the next, compressed."""
    a = a.astype(np.uint64)
    if delta and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    top = int(a.max()) if len(a) else 0
    kind = "B" if top < 1 << 8 else "H" if top < 1 << 16 else "I" if top < 1 << 32 else "Q"
    return kind.encode() + _planes(a.astype(f"<{kind}"))


def _planes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(plain.T).view(kind).ravel()


def unpacked(raw: bytes, delta: bool = False) -> np.ndarray:
    a = _unplaned(raw[1:], f"<{raw[:1].decode()}").astype(np.uint64)
    return np.cumsum(a, dtype=np.uint64) if delta else a


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids of words: places, which are small where words are frequent, apart from the hashes of words that have none."""
    other = ids >= TAIL
    places = _planes(np.where(other, np.uint64(0xFFFFFFFF), ids).astype("<I"))
    return len(places).to_bytes(4, "little") + places + zstandard.ZstdCompressor(level=1).compress(ids[other].tobytes())


def unpacked_ids(raw: bytes) -> np.ndarray:
    end = 4 + int.from_bytes(raw[:4], "little")
    ids = _unplaned(raw[4:end], "<I").astype(np.uint64)
    ids[ids == np.uint64(0xFFFFFFFF)] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[end:]), np.uint64)
    return ids


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d_0..d_LOW from counts of counts n_0..n_(LOW+1); where Good-Turing gives nothing usable, (r - 1/2) / r."""
    d = np.ones(LOW + 1)
    common = (LOW + 1) * n[LOW + 1] / n[1] if n[1] else 1.0
    for r in range(1, LOW + 1):
        x = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


@dataclass
class Lexicon:
    """The words broadcast and the unigram model. Places: the words, the most frequent first, then end, rare class, start. Pooled: all other words are of the class."""

    hashes: np.ndarray  # ascending
    ranks: np.ndarray  # their places
    counts: np.ndarray  # by place; of start and end the number of texts
    p1: np.ndarray  # by place; 0 for start
    total: int
    types: int
    down: np.ndarray  # unigram discounts
    rare_weight: float  # of all rare words seen
    unseen_share: float  # of the rare class that goes to words never seen
    pooled: bool = False
    whole: float = 1.0  # what weights are divided by

    @property
    def end(self) -> int:
        return len(self.hashes)

    @property
    def rare(self) -> int:
        return len(self.hashes) + 1

    @property
    def start(self) -> int:
        return len(self.hashes) + 2

    @property
    def base(self) -> int:
        return len(self.hashes) + 3

    def hot(self) -> np.ndarray:
        return self.counts * HOT >= max(1, self.total)

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return (ids < self.base) & self.hot()[np.minimum(ids, self.base - 1).astype(np.int64)]

    def chance(self, ids: np.ndarray, tail_ids: np.ndarray, tail_counts: np.ndarray) -> np.ndarray:
        """Unigram probabilities; tail_ids (ascending) are the words seen that are not broadcast."""
        p = self.p1[np.minimum(ids, self.rare).astype(np.int64)]  # a word never seen has that of the class
        if len(tail_ids):
            at = np.minimum(np.searchsorted(tail_ids, ids), len(tail_ids) - 1)
            p = np.where(tail_ids[at] == ids, self.weight(tail_counts)[at] / self.whole, p)
        return p

    def weight(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return c * np.where(c <= LOW, self.down[np.minimum(c, LOW)], 1.0)

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def rare_log(self, c: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class; 0 where each word stands for itself."""
        if not self.pooled:
            return np.zeros(len(c))
        seen = (1 - self.unseen_share) * self.weight(c) / max(self.rare_weight, 1e-300)
        return np.log10(np.where(c > 0, seen, self.unseen_share))


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"h": h.astype(np.int64), "c": c})

    for pdf in batches:
        for text in pdf["text"]:
            held.append(word_hashes(text))
            n += len(held[-1])
            if n >= 2 * BLOCK:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


def lexicon(train: DataFrame, bound: int, pooled: bool) -> tuple[Lexicon, DataFrame]:
    """From texts (column text), and the words not broadcast: id, c. The driver gets one row per distinct count (under sqrt(2N)) and bound words."""
    words = staged(train.select("text").mapInPandas(lean(_word_counts), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    texts = train.count()
    of = np.array([tuple(r) for r in words.groupBy("c").count().collect()], np.int64).reshape(-1, 2)
    of = of[np.argsort(-of[:, 0])]
    fits = np.cumsum(of[:, 1]) <= bound
    least = int(of[fits][-1, 0]) if fits.any() else (int(of[0, 0]) + 1 if len(of) else 1)
    top = words.where(F.col("c") >= least).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    by_count, order = np.lexsort((h, -c)), np.argsort(h)
    ranks = np.empty(len(h), np.uint64)
    ranks[by_count] = np.arange(len(h), dtype=np.uint64)
    h, ranks, c = h[order], ranks[order], c[by_count]
    total, types = int((of[:, 0] * of[:, 1]).sum()) + texts, int(of[:, 1].sum()) + (texts > 0)
    n = np.zeros(LOW + 2, np.int64)
    for r, k in of:
        if r <= LOW + 1:
            n[r] += k
    if 0 < texts <= LOW + 1:
        n[texts] += 1
    down = discounts(n)
    lex = Lexicon(h, ranks, np.concatenate([c, [texts, 0, texts]]), np.empty(0), total, types, down, 0.0, 1.0)
    below = of[of[:, 0] < least]
    lex.counts[lex.rare] = int((below[:, 0] * below[:, 1]).sum())
    lex.rare_weight = float((lex.weight(below[:, 0]) * below[:, 1]).sum())
    w = np.concatenate([lex.weight(c), [max(float(lex.weight(np.array([texts]))[0]), 0.5)]])
    unseen = max(total - w.sum() - lex.rare_weight, 0.5)
    lex.pooled, lex.whole = pooled, float(w.sum() + lex.rare_weight + unseen)
    lex.p1 = np.concatenate([w, [unseen + (lex.rare_weight if pooled else 0.0), 0.0]]) / lex.whole
    lex.unseen_share = unseen / (unseen + lex.rare_weight)
    tail = words.where(F.col("c") < least).select(F.col("h").bitwiseOR(F.lit(-(2**63))).alias("id"), "c")
    tail.staged_at = words.staged_at
    return lex, tail


_DEALT = "part int, kind int, block long, keys binary, words binary, counts binary, lens binary, docs binary, extra binary"


def _dealt(lex: Lexicon, parts: int):
    """Rows for partitions. kind 0: pairs (history in keys, word in words); 1: words not broadcast; 2: the block's texts. docs: for each key, the texts (by place in the block) it stands in, lens of them."""
    base_log = lex.base_log(lex.counts)

    def split(block: int, kind: int, part: np.ndarray, keys: np.ndarray, targets: np.ndarray | None, counts: np.ndarray, lens: np.ndarray, docs: np.ndarray) -> Iterator[dict]:
        order = np.argsort(part, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.flatnonzero(np.diff(part[order], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
            own = order[a:b]  # keys stay in order
            yield {
                "part": int(part[own[0]]), "kind": kind, "block": block, "keys": packed_ids(keys[own]) if kind == 0 else packed(keys[own], delta=True), "words": b"" if targets is None else packed_ids(targets[own]), "counts": packed(counts[own]),
                "lens": packed(lens[own]), "docs": packed(docs[_spread(starts[own], lens[own])]), "extra": b"",
            }

    def grouped(keys: np.ndarray, doc: np.ndarray, training: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
        if not len(k):
            return k, at, at, doc
        lens = np.diff(np.append(at, len(k)))
        return k[at], np.add.reduceat(training[doc[order]].astype(np.int64), at), lens, doc[order]

    def flush(block: int, held: list) -> pd.DataFrame:
        lengths = np.array([len(x[2]) for x in held])
        words = np.concatenate([x[2] for x in held])
        training = np.array([x[1] for x in held])
        distinct, inverse = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(lex.hashes, distinct), max(0, len(lex.hashes) - 1))
        other = lex.hashes[at] != distinct if len(lex.hashes) else np.ones(len(distinct), bool)
        place = np.where(other, np.uint64(lex.rare) if lex.pooled else distinct | TAIL, lex.ranks[at] if len(lex.ranks) else np.uint64(0))
        glob, loc = np.unique(np.concatenate([place, np.array([lex.end, lex.start], np.uint64)]), return_inverse=True)
        end, start = loc[-2:]
        ids = np.empty(len(words) + len(held), np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inner = np.ones(len(ids), bool)
        inner[ends] = False
        ids[ends], ids[inner] = end, loc[:-2][inverse]
        before = np.empty(len(ids), np.int64)
        before[1:] = ids[:-1]
        before[ends[:-1] + 1], before[0] = start, start
        doc = np.repeat(np.arange(len(held), dtype=np.uint16), lengths + 1)
        keys, counts, lens, docs = grouped(before * len(glob) + ids, doc, training)
        h, w = glob[keys // len(glob)], glob[keys % len(glob)]  # pairs stay in order
        by_pair, by_h = mixed(h ^ mixed(w + np.uint64(1))), mixed(h + np.uint64(77))
        spread = np.where(lex.is_hot(h), np.where(lex.is_hot(w), np.uint64(mixed(np.array([block], np.uint64))[0]), by_pair), by_h)
        rows = list(split(block, 0, (spread % np.uint64(parts)).astype(np.int64), h, w, counts, lens, docs))
        tail = other[inverse]
        known = np.ones(len(ids), bool)
        known[inner] = ~tail
        at = np.where(known, glob[ids], np.uint64(lex.rare)).astype(np.int64)
        base = np.bincount(doc, np.where(known, base_log[at], 0.0), len(held))
        n_known = np.bincount(doc[known & (lex.counts[at] > 0)], minlength=len(held))
        keys, counts, lens, docs = grouped(words[tail], doc[inner][tail], training)
        if len(keys):
            rows += split(block, 1, (mixed(keys) % np.uint64(parts)).astype(np.int64), keys, None, counts, lens, docs)
        about = pd.DataFrame({"id": [x[0] if x[0] is not None else 0 for x in held], "null": [x[0] is None for x in held], "train": training, "n": lengths + 1, "known": n_known, "base": base})
        rows.append({"part": block % parts, "kind": 2, "block": block, "keys": b"", "words": b"", "counts": b"", "lens": b"", "docs": b"", "extra": about.to_records(index=False).astype(_ABOUT).tobytes()})
        return pd.DataFrame(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, n = TaskContext.get().partitionId() << 22, [], 0
        for pdf in batches:
            for key, no_id, train, text in zip(pdf["id"], pdf["no_id"], pdf["train"], pdf["text"], strict=True):
                held.append((None if no_id else int(key), bool(train), word_hashes(text)))
                n += len(held[-1][2]) + 1
                if n >= BLOCK or len(held) >= 60_000:
                    yield flush(block, held)
                    block, held, n = block + 1, [], 0
        if held:
            yield flush(block, held)

    return run


_ABOUT = np.dtype([("id", "<i8"), ("null", "?"), ("train", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8")])


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places starts[0].., lens[0] of them, then starts[1].., and so on."""
    if not len(lens):
        return np.empty(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lens), lens)


_MERGED = "row long, kind int, keys binary, words binary, counts binary, lens binary, slots binary, extra binary, ones array<long>"


def _merged(lex: Lexicon, rows: int = 300_000):
    """A partition's keys summed over its blocks, in rows that end with a history. ones: counts of counts of pairs that are complete here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in (0, 1):
            own = pdf[pdf["kind"] == kind]
            if not len(own):
                continue
            keys = np.concatenate([unpacked_ids(x) if kind == 0 else unpacked(x, delta=True) for x in own["keys"]])
            counts = np.concatenate([unpacked(x) for x in own["counts"]]).astype(np.int64)
            lens = np.concatenate([unpacked(x) for x in own["lens"]]).astype(np.int64)
            blocks = np.unique(own["block"].to_numpy(np.int64))
            slots = np.concatenate([unpacked(d).astype(np.int64) + (int(np.searchsorted(blocks, b)) << 16) for d, b in zip(own["docs"], own["block"], strict=True)])
            targets = np.concatenate([unpacked_ids(x) for x in own["words"]]) if kind == 0 else np.zeros(len(keys), np.uint64)
            order = np.lexsort((targets, keys)) if kind == 0 else np.argsort(keys, kind="stable")
            slots = slots[_spread((np.cumsum(lens) - lens)[order], lens[order])]
            h, w = keys[order], targets[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
            h, w, c, n = h[at], w[at], np.add.reduceat(counts[order], at), np.add.reduceat(lens[order], at)
            ends = np.cumsum(n)
            a = 0
            while a < len(h):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + rows)))
                while b < len(h) and h[b] == h[b - 1]:
                    b = int(np.searchsorted(h, h[b - 1], side="right"))
                ones = np.zeros(LOW + 2, np.int64)
                if kind == 0:
                    whole = ~(lex.is_hot(h[a:b]) & lex.is_hot(w[a:b]))
                    low = c[a:b][whole & (c[a:b] > 0) & (c[a:b] <= LOW + 1)]
                    ones += np.bincount(low, minlength=LOW + 2)
                first = ends[a - 1] if a else 0
                # slots count blocks by their place in extra
                out.append({
                    "kind": kind, "keys": packed_ids(h[a:b]) if kind == 0 else packed(h[a:b], delta=True), "words": packed_ids(w[a:b]) if kind == 0 else b"", "counts": packed(c[a:b]), "lens": packed(n[a:b]),
                    "slots": packed(slots[first : ends[b - 1]]), "extra": packed(blocks, delta=True), "ones": ones.tolist(),
                })
                a = b
        for block, extra in zip(pdf.loc[pdf["kind"] == 2, "block"], pdf.loc[pdf["kind"] == 2, "extra"], strict=True):
            out.append({"kind": 2, "keys": int(block).to_bytes(8, "little"), "words": b"", "counts": b"", "lens": b"", "slots": b"", "extra": extra, "ones": [0] * (LOW + 2)})
        return pd.DataFrame(out).assign(row=(int(pdf["part"].iat[0]) << 24) + np.arange(len(out)))

    return run


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of a row's pairs that are not broadcast."""
    for pdf in batches:
        for row, raw in zip(pdf["row"], pdf["words"], strict=True):
            w = unpacked_ids(raw)
            yield pd.DataFrame({"row": row, "id": np.unique(w[w >= TAIL]).view(np.int64)})


def _carried(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(ids)
    return pd.DataFrame({"row": [pdf["row"].iat[0]], "tail_ids": [packed(ids[order], delta=True)], "tail_counts": [packed(pdf["c"].to_numpy(np.int64)[order])]})


def _hot_sums(lex: Lexicon):
    """For frequent histories: count and backoff mass of the pairs seen here, by count, and pairs of two frequent words whole. id: the word, where its mass is to be joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw_h, raw_w, raw_c in zip(pdf["keys"], pdf["words"], pdf["counts"], strict=True):
                h, w, c = unpacked_ids(raw_h), unpacked_ids(raw_w), unpacked(raw_c).astype(np.int64)
                use = lex.is_hot(h) & (c > 0)
                h, w, c = h[use].astype(np.int64), w[use], c[use]
                both, tail = lex.is_hot(w), w >= TAIL
                if both.any():
                    key = h[both] * lex.base + w[both].astype(np.int64)
                    yield pd.DataFrame({"key": key, "level": -1, "n": c[both], "mass": 0.0, "id": key})
                if tail.any():
                    yield pd.DataFrame({"key": h[tail], "level": np.minimum(c[tail], LOW + 1), "n": c[tail], "mass": 0.0, "id": w[tail].view(np.int64)})
                rest = ~both & ~tail
                if rest.any():
                    part = pd.DataFrame({"key": h[rest], "level": np.minimum(c[rest], LOW + 1), "n": c[rest], "mass": lex.p1[w[rest].astype(np.int64)]})
                    part = part.groupby(["key", "level"], as_index=False).agg({"n": "sum", "mass": "sum"})
                    yield part.assign(id=part["key"] * (LOW + 2) + part["level"])  # of no word, as those are negative

    return run


@dataclass
class Weights:
    """What scoring needs beside the lexicon: discounts, and for frequent histories their pairs with frequent words, scales and backoff weights."""

    down: np.ndarray
    pair_keys: np.ndarray
    pair_counts: np.ndarray
    hot_ids: np.ndarray
    hot_scale: np.ndarray
    hot_backoff: np.ndarray


def _normal(seen: np.ndarray, mass: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the seen words' discounted probabilities and backoff weight, from their sum, their backoff mass and the history's count.

    Where discounts free less than one count would, the seen words are scaled so that they do; where every word has been
    seen, so that they sum to one.
    """
    safe = np.maximum(total, 1)
    a = np.where(total > 0, seen / safe, 0.0)
    most = safe / (safe + 1.0)
    rest = 1 - mass
    scale = np.where(rest < 1e-9, 1 / np.maximum(a, 1e-300), np.where(a > most, most / np.maximum(a, 1e-300), 1.0))
    return scale, (1 - a * scale) / np.maximum(rest, 1e-9)


def _weights(lex: Lexicon, table: DataFrame, tail: DataFrame) -> Weights:
    pairs = table.where("kind = 0")
    n = np.array(pairs.agg(*[F.coalesce(F.sum(F.col("ones")[r]), F.lit(0)) for r in range(LOW + 2)]).first(), np.int64)
    sums = pairs.select("keys", "words", "counts").mapInPandas(_hot_sums(lex), "key long, level int, n long, mass double, id long")
    if not lex.pooled:
        weight = F.when(F.col("c") <= LOW, F.col("c") * F.element_at(F.array(*[F.lit(float(d)) for d in lex.down]), (F.least("c", F.lit(LOW)) + 1).cast("int"))).otherwise(F.col("c"))
        sums = sums.join(tail, "id", "left").withColumn("mass", F.coalesce(weight / lex.whole, "mass"))
    sums = sums.groupBy("key", "level").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).toPandas()
    both = sums[sums["level"] < 0].sort_values("key")
    keys, counts = both["key"].to_numpy(np.int64), both["n"].to_numpy(np.int64)
    n += np.bincount(counts[(counts > 0) & (counts <= LOW + 1)], minlength=LOW + 2)
    down = discounts(n)
    ids = np.flatnonzero(lex.hot())
    seen, mass = np.zeros(lex.base), np.zeros(lex.base)
    rest = sums[sums["level"] >= 0]
    level = rest["level"].to_numpy(np.int64)
    np.add.at(seen, rest["key"].to_numpy(np.int64), rest["n"].to_numpy() * np.where(level <= LOW, down[np.minimum(level, LOW)], 1.0))
    np.add.at(mass, rest["key"].to_numpy(np.int64), rest["mass"].to_numpy())
    np.add.at(seen, keys // lex.base, counts * np.where(counts <= LOW, down[np.minimum(counts, LOW)], 1.0))
    np.add.at(mass, keys // lex.base, lex.p1[keys % lex.base])
    scale, backoff = _normal(seen[ids], mass[ids], lex.counts[ids])
    return Weights(down, keys, counts, ids, scale, backoff)


def _scored(lex: Lexicon, wt: Weights):
    hot_at = np.zeros(lex.base, np.int64)
    hot_at[wt.hot_ids] = np.arange(len(wt.hot_ids))

    def pairs(h: np.ndarray, w: np.ndarray, c: np.ndarray, tail_ids: np.ndarray, tail_counts: np.ndarray) -> np.ndarray:
        """log10 probability of each pair; a history that is not frequent has all its pairs here."""
        c, p1 = c.copy(), lex.chance(w, tail_ids, tail_counts)
        both = lex.is_hot(h) & lex.is_hot(w)
        if both.any() and len(wt.pair_keys):
            keys = (h[both] * np.uint64(lex.base) + w[both]).astype(np.int64)
            at = np.minimum(np.searchsorted(wt.pair_keys, keys), len(wt.pair_keys) - 1)
            c[both] = np.where(wt.pair_keys[at] == keys, wt.pair_counts[at], 0)
        weight = c * np.where(c <= LOW, wt.down[np.minimum(c, LOW)], 1.0)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lens = np.diff(np.append(first, len(h)))
        own, placed = np.minimum(h[first], lex.start).astype(np.int64), h[first] < lex.base
        total = np.where(placed, lex.counts[own], np.add.reduceat(c, first))
        scale, backoff = _normal(np.add.reduceat(weight, first), np.add.reduceat(np.where(c > 0, p1, 0.0), first), total)
        if len(wt.hot_ids):
            hot = lex.is_hot(h[first])
            scale, backoff = np.where(hot, wt.hot_scale[hot_at[own]], scale), np.where(hot, wt.hot_backoff[hot_at[own]], backoff)
        scale, backoff, total = np.repeat(scale, lens), np.repeat(backoff, lens), np.repeat(np.maximum(total, 1), lens)
        with np.errstate(divide="ignore"):
            return np.where(c > 0, np.log10(scale * weight / total), np.log10(np.maximum(backoff, 1e-300)) + np.log10(np.maximum(p1, 1e-300)))

    def sums(slots: list[np.ndarray], **values: list[np.ndarray]) -> Iterator[dict]:
        """A row a block: its texts' places here and their sums."""
        distinct, inverse = np.unique(np.concatenate(slots), return_inverse=True)
        totals = {k: np.bincount(inverse, np.concatenate(v), len(distinct)) for k, v in values.items()}
        block = distinct >> 16
        at = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(at, [*at[1:], len(block)], strict=True):
            row = {"block": int(block[a]), "places": packed(distinct[a:b] & 0xFFFF, delta=True), "about": b""}
            yield row | {k: totals[k][a:b].tobytes() if k in totals else b"" for k in ("score", "base", "known")}

    def emptied(held: dict, kind: int) -> list[dict]:
        slots, *values = held[kind]
        out = list(sums(slots, **dict(zip(("score", "base", "known"), values, strict=False)))) if slots else []
        held[kind] = tuple([] for _ in held[kind])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], {0: ([], []), 1: ([], [], [], [])}
            for kind, keys, words, counts, lens, slots, extra, *tail in zip(*(pdf[x] for x in _READ), strict=True):
                if kind == 2:
                    rows.append({"block": int.from_bytes(keys, "little"), "places": b"", "about": extra, "score": b"", "base": b"", "known": b""})
                    continue
                c, n, s = (unpacked(x).astype(np.int64) for x in (counts, lens, slots))
                tail_ids, tail_counts = (unpacked(tail[0], delta=True), unpacked(tail[1]).astype(np.int64)) if tail[0] is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))
                values = [pairs(unpacked_ids(keys), unpacked_ids(words), c, tail_ids, tail_counts)] if kind == 0 else [lex.rare_log(c), lex.base_log(c), (c > 0).astype(float)]
                held[kind][0].append((unpacked(extra, delta=True).astype(np.int64)[s >> 16] << 16) | (s & 0xFFFF))
                for to, v in zip(held[kind][1:], values, strict=True):
                    to.append(np.repeat(v, n))
                if sum(map(len, held[kind][0])) >= HELD:
                    rows += emptied(held, kind)
            for kind in held:
                rows += emptied(held, kind)
            if rows:
                yield pd.DataFrame(rows)

    return run


_READ = ("kind", "keys", "words", "counts", "lens", "slots", "extra", "tail_ids", "tail_counts")
_SUMS = "block long, places binary, about binary, score binary, base binary, known binary"
_TEXT = "id long, no_id boolean, train boolean, n long, known long, base double, score double"


def _texts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The texts of a block with all their sums."""
    about = np.concatenate([np.frombuffer(x, _ABOUT) for x in pdf["about"] if len(x)])
    total = {"score": np.zeros(len(about)), "base": about["base"].astype(float), "known": about["known"].astype(float)}
    for places, *sums in zip(pdf["places"], pdf["score"], pdf["base"], pdf["known"], strict=True):
        if len(places):
            at = unpacked(places, delta=True).astype(np.int64)
            for name, raw in zip(total, sums, strict=True):
                if len(raw):
                    total[name][at] += np.frombuffer(raw, np.float64)
    return pd.DataFrame({
        "id": about["id"].astype(np.int64), "no_id": about["null"].astype(bool), "train": about["train"].astype(bool), "n": about["n"].astype(np.int64),
        "known": np.rint(total["known"]).astype(np.int64), "base": total["base"], "score": total["score"],
    })


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, vocabulary: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows outside the held-out fold. Null and empty texts are one token, the end. Rows that repeat an id are
    scored each; a null id stays null (and hashes like the empty text). Without training rows every text still gets a
    finite score. An empty table gives an empty result. Other columns are not read. Only with a vocabulary are words
    beyond it pooled; frequent bounds what is broadcast and changes no score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), (fold_of(id_col, folds) != held_out).alias("train"), F.col(text_col).alias("text"))
    lex, tail = lexicon(rows.where("train"), frequent if vocabulary is None else vocabulary, vocabulary is not None)
    parts = max(1, math.ceil(lex.total * folds / max(1, folds - 1) / PART))
    shared = spark.sparkContext.broadcast(lex)
    dealt = rows.mapInPandas(lean(lambda it: _dealt(shared.value, parts)(it)), _DEALT)
    table = staged(dealt.groupBy("part").applyInPandas(lambda pdf: _merged(shared.value)(pdf), _MERGED), "pairs")
    weights = spark.sparkContext.broadcast(_weights(lex, table, tail))
    if lex.pooled:
        table = table.withColumns({"tail_ids": F.lit(None).cast("binary"), "tail_counts": F.lit(None).cast("binary")})
    else:
        asked = table.where("kind = 0").select("row", "words").mapInPandas(_asked, "row long, id long")
        carried = staged(asked.join(tail, "id").groupBy("row").applyInPandas(_carried, "row long, tail_ids binary, tail_counts binary"), "tails")
        table = table.join(carried, "row", "left")
    discard(tail)
    scored = table.select(*_READ).mapInPandas(lean(lambda it: _scored(shared.value, weights.value)(it)), _SUMS)
    texts = scored.groupBy("block").applyInPandas(_texts, _TEXT)
    return texts.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), (~F.col("train")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score",
    )
