import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import embedding_dedup, exact_dedup, minhash_dedup
from millrace.llm.graph import connected_components

SF = "/root/testdata/sf0.001"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    want = components(500, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == touched and all(got[x] == want[x] for x in touched)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# exact


def test_exact_dedup_rules(spark):
    rows = [(5, "a b\n", "x"), (3, "ab", "x"), (4, "a\tb ", "x"), (9, None, "x"), (8, "", "x"), (7, " \x0b", "x"), (1, "a b", "x"), (2, "Ab", "x"), (None, "ab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("n", F.lit(0)).withColumn("keep_id", F.lit(0))
    for k in (2, 1024):  # few counters: the heavy path decides
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, k=k).collect()}
        assert [got[i].keep_id for i in (5, 3, 4, 1, None)] == [4] * 5 and got[4].kept and not got[5].kept and got[4].group_size == 5
        assert [got[i].keep_id for i in (9, 8, 7)] == [7] * 3 and got[2].kept
        assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert {r.doc_id for r in exact_dedup.drop_copies(df).collect()} == {4, 7, 2} and "digest" in exact_dedup.drop_copies(df).columns
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "h o t"]) if rng.random() < 0.4 else f"t{rng.randrange(300)}" + " " * rng.randrange(3)) for i in range(2000)]
    best = {}
    for i, t in rows:
        best.setdefault("".join(t.split()), []).append((-len(t), i))
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), k=16).collect()
    assert len(got) == 2000
    for r in got:
        group = best["".join(dict(rows)[r.doc_id].split())]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))


#: (id, text, tag): repeated ids with other and with equal texts, null ids, wholly equal rows; columns named like the operators' own.
AWKWARD = [
    (1, "a b c d e f", "x"), (2, "a b c d e  f", "x"), (2, "unique to this row of two", "x"), (3, "q r s t u v", "x"), (3, "q r s t u v", "x"), (4, None, "x"), (4, "", "x"),
    (None, "p q r s t u", "x"), (None, "p q r s t u", "y"), (None, "a b c d e f", "x"), (5, "only five has these words", "x"), (5, "only five has these words", "y"), (5, "q r s t u v", "z"), (6, None, None),
]


@pytest.mark.parametrize("most", [500_000, 0])  # what goes is broadcast, or hashed
def test_drops_judge_rows_and_not_ids(spark, monkeypatch, most):
    from millrace.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, id string").selectExpr("doc_id", "text", "id", "1 as mark", "2 as stays", "3 as own", "4 as node").repartition(3)
    for drop, bare in ((exact_dedup.drop_copies, True), (minhash_dedup.drop_near_duplicates, False)):
        out = drop(df)
        assert out.columns == df.columns
        got = [(r.doc_id, r.text, r.id) for r in out.collect()]
        words = sorted(("".join((t or "").split()), -1 if i is None else i) for i, t, _ in got if t)
        # one row of each text, of the smallest id unless another has more characters
        assert words == sorted([("abcdef", 2 if bare else 1), ("uniquetothisrowoftwo", 2), ("qrstuv", 3), ("pqrstu", -1), ("onlyfivehasthesewords", 5)])
        assert sum(not t for _, t, _ in got) == (1 if bare else 3) and set(got) <= set(AWKWARD)
        assert drop(df.limit(0)).collect() == []


def test_drops_leave_wholly_equal_rows_once_however_many(spark):
    df = spark.range(400).selectExpr("7L as doc_id", "'one two three four five six' as text", "id % 2 as tag").repartition(5)
    assert exact_dedup.drop_copies(df).count() == 1 == minhash_dedup.drop_near_duplicates(df).count()


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, long.replace("w1 ", "w1  ")), (4, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df).collect()} == {i: (n, c) for i, (n, c) in brute_documents(rows, 80).items()}
    assert {r.doc_id for r in minhash_dedup.drop_near_duplicates(exact_dedup.drop_copies(df)).collect()} == {2, 4}


def test_components_with_hubs(spark, monkeypatch):
    from millrace.llm import graph

    monkeypatch.setattr(graph, "LARGE", 10)
    monkeypatch.setattr(graph, "HUBS", 5)
    rng = random.Random(9)
    edges = [(5, 100 + i) for i in range(300)] + [(600, 601 + i) for i in range(200)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(60)]
    want = components(900, edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}


def test_misra_gries_keeps_what_is_frequent():
    counts = {}
    stream = ["a"] * 400 + ["b"] * 300 + [f"x{i}" for i in range(300)]
    random.Random(0).shuffle(stream)
    for at in range(0, 1000, 50):
        for d in stream[at : at + 50]:
            counts[d] = counts.get(d, 0) + 1
        counts = exact_dedup.trimmed(counts, 8)
    assert len(counts) <= 8 and counts["a"] >= 400 - 1000 / 9 and counts["b"] >= 300 - 1000 / 9


# embeddings


def brute_vectors(rows, threshold):
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v, g in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    group = {i: (g, len(v)) for i, v, g in rows if i in ok}
    links = [(a, b) for a in ok for b in ok if a < b and group[a] == group[b] and ok[a] @ ok[b] >= threshold]
    ids = sorted(i for i, *_ in rows)
    place = {x: n for n, x in enumerate(ids)}
    comp = components(len(ids), [(place[a], place[b]) for a, b in links])
    degree = {i: sum(i in link for link in links) for i in ids}
    return {i: (degree[i], ids[comp[place[i]]]) for i in ids}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in (0, 1):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.01).tolist() for _ in range(150)]  # a dense group, wider than the window
        rows += rng.normal(size=(100, 16)).tolist()
        rows += [rows[-1]] * 40 + [(np.array(rows[-1]) * 2).tolist()]
    labelled = [(i, v, i % 2 if i < 10 else int(i >= len(rows) // 2)) for i, v in enumerate(rows)]
    labelled += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0, None] + [0.0] * 14, 0), (1003, [float("nan")] * 16, 0), (1004, [float("inf")] * 16, 0), (1005, rows[0], None), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0)]
    df = spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df.repartition(5), window=8, block=64).collect()}
    want = brute_vectors(labelled, 0.98)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_vectors_that_repeat_an_id_or_have_none(spark):
    near = [1.0, 0.01, 0.0]
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 1), (None, near, 1), (None, [0.0, 0.0, 1.0], 1), (7, [0.0, 0.0, 2.0], 1), (None, None, 1), (8, [0.0, 0.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for exact in (False, True):
        got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df, exact=exact).collect()), key=str)
        # each row is a vector of its own; a component with a row that has an id is named by it
        assert got == sorted([(5, 2, 5, True), (5, 0, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, 7, False), (7, 1, 7, True), (None, 0, None, True), (8, 0, 8, True)], key=str)


def test_exact_comparison_misses_nothing(spark):
    """Pairs far apart in every sorted order: the exact way finds all of them, whatever the window."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 24))
    rows = [*base, *(base[:120] + rng.normal(size=(120, 24)) * 0.13), *([base[0]] * 5)]
    labelled = [(i, list(map(float, v)), i % 3 if i < 30 else 0) for i, v in enumerate(rows)]
    df = spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(df, block=50, exact=True).collect()}
    want = brute_vectors(labelled, 0.98)
    assert got == want and sum(n > 0 for n, _ in want.values()) > 40


def test_embedding_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()}
    want = brute_vectors(rows, 0.98)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want) and all(got[i][0] <= want[i][0] for i in want)


# documents


def brute_documents(rows, percent, width=5):
    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    ids = [i for i, _ in rows]
    low = {}
    for i, c in zip(ids, comp, strict=True):
        low[c] = min(low.get(c, i), i)
    return {i: (len(s), low[c]) for i, s, c in zip(ids, sets, comp, strict=True)}


def near_copies(rng, n, base, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_documents_against_brute_force(spark, percent):
    rng = random.Random(percent)
    texts = [None, "", " \n", "One two", "one TWO", "É one two three four five", "é one two three four five"]
    texts += near_copies(rng, 60, [f"w{i}" for i in range(200)], 5)  # many pairs on either side of the threshold
    texts += near_copies(rng, 40, [f"v{i}" for i in range(60)], 2)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 80))) for _ in range(80)] + [texts[10]] * 5 + ["long " * 20000]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df.repartition(3), percent=percent).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_documents(rows, percent).items()}
    kept = minhash_dedup.drop_near_duplicates(df, percent=percent)
    assert kept.count() == sum(k for *_, k in got.values()) and kept.columns == df.columns


def test_documents_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=str)
    other = df.union(spark.createDataFrame([(2, "quite another text of six words here"), (3, "Quite another text of six words here")], "doc_id long, text string"))
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(other).collect()), key=str)  # rows of one id go by their own texts
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False)], key=str)
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pigeonhole_index_finds_every_pair_within_the_distance():
    import pandas as pd

    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash_dedup.K, dtype=np.uint16)
        b = a.copy()
        places = rng.choice(minhash_dedup.K, 2 * minhash_dedup.CHUNKS - 1, replace=False)
        b[places] ^= 1 + rng.integers(0, 100, len(places), dtype=np.uint16)
        keys = [set(next(minhash_dedup._indexed([pd.DataFrame({"rep": [0], "sig": [x.tobytes()]})]))["key"]) for x in (a, b)]
        assert keys[0] & keys[1]
        near, far = minhash_dedup._nibbles(np.stack([a, b]))
        differ = sum(((int(x) ^ int(y)) >> s & 15) > 0 for x, y in zip(near.view(np.uint64), far.view(np.uint64), strict=True) for s in range(0, 64, 4))
        assert differ <= (a != b).sum()
