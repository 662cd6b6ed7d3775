import hashlib
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, mixing

SF = "/root/testdata/sf0.001"


@given(st.text(st.sampled_from("\\<>|/s[]INSTturnend\nx") | st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_hides_control_strings(text):
    safe = chat.escaped(text)
    assert chat.unescaped(safe) == text and not any(c in safe for c in chat.CONTROL)
    assert chat.unescaped_role(chat.escaped_role(text)) == text and "\n" not in chat.escaped_role(text)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_chat_reads_back(spark):
    rng = random.Random(2)
    rows = [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    for c in range(12):
        rows += [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], " ".join("word" for _ in range(rng.randrange(40))) + "\\<|end|>\n") for t in range(rng.randrange(1, 40))]
    rows += [(50, 1, None, None), (50, None, "user", "x"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (51, 0, "assistant", "huge " * 5000), (None, 0, "user", "lost")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash")).repartition(3)
    windows = chat.format_conversations(df, budget=120, history=40)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = [x for _, r, x in turns if r == "assistant"]
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest(f"{r}\n{x}\n" for _, r, x in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len("".join(said)), digest(said)), c
    rows_ = windows.collect()
    assert sum(len(w.text) for w in rows_ if w.conv_id == 3) == got[3].formatted_chars
    for w in rows_:  # the system turn heads every window, windows keep to the budget unless a turn exceeds it alone, history is limited
        turns = chat._TURN.findall(w.text)
        if w.conv_id in (0, 3, 6, 9) and w.window:
            assert turns[0][0] == "system"
        repeated = turns[: w.first_new]
        assert sum(chat.turn_tokens(chat.unescaped(x)) for r, x in repeated if r != "system") <= 40
        assert w.n_tokens <= 120 or w.n_new == 1
        assert len(turns) == w.first_new + w.n_new
    assert chat.format_conversations(df.limit(0)).count() == 0 == chat.read_back(windows.limit(0)).count()


def brute_windows(turns, budget, history):
    """(repeated, new) turns by place, from the definition: of all spans that hold the next new turn within the budget, the system turn, then the longest history, then the most new turns."""
    cost = [chat.turn_tokens(x) for _, x in turns]
    has_system = turns[0][0] == "system"
    out, at = [], 0
    while at < len(turns):
        system = [0] if has_system and at and cost[0] + cost[at] <= budget else []
        fixed = sum(cost[i] for i in system)
        first = next(h for h in range(1 if has_system and at else 0, at + 1) if sum(cost[h:at]) <= history and (h == at or fixed + sum(cost[h : at + 1]) <= budget))
        end = max(e for e in range(at + 1, len(turns) + 1) if e == at + 1 or fixed + sum(cost[first:e]) <= budget)
        out.append(([*system, *range(first, at)], list(range(at, end))))
        at = end
    return out


@pytest.mark.parametrize("budget,history", [(120, 40), (60, 100), (30, 10), (500, 0)])
def test_windows_by_brute_force(spark, budget, history):
    rng = random.Random(budget)
    rows = []
    for c in range(40):
        words = [203, 100, 3, 0][c % 4] if c < 12 else rng.randrange(30)  # system turns over the budget, and turns that fit alone
        rows += [(c, t, "system" if t == 0 and c % 3 else ("user", "assistant")[t % 2], "word " * (words if t == 0 else rng.choice([0, 1, 5, 20, 57, 100]))) for t in range(rng.randrange(1, 30))]
    by = {}
    for c, _, r, x in rows:
        by.setdefault(c, []).append((r, x))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for w in chat.format_conversations(df, budget=budget, history=history).orderBy("conv_id", "window").collect():
        turns = [(r, chat.unescaped(x)) for r, x in chat._TURN.findall(w.text)]
        got.setdefault(w.conv_id, []).append((turns[: w.first_new], turns[w.first_new :]))
        assert w.n_tokens == sum(chat.turn_tokens(x) for _, x in turns) and (w.n_tokens <= budget or len(turns) == 1)
    assert got == {c: [([t[i] for i in old], [t[i] for i in new]) for old, new in brute_windows(t, budget, history)] for c, t in by.items()}


def water_fill(sizes, weights, most):
    """Excess over a cap is shared again by weight until none is above."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            free.discard(i)
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 0, 20, 700], [0, 0], [7], [1, 1, 1, 100000, 1, 1]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_fill(sizes, [1 + i % 3 for i in range(len(sizes))], 3)
    assert all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want, strict=True))


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["b", "a", "é", None, "b"]), None if i % 97 == 0 else "w " * rng.randrange(200)) for i in range(3000)] + [(5, "a", "x y z"), (None, "a", "q"), (9999, "empty", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit(-1)).withColumn("bin", F.lit("clash"))
    got = mixing.mix(df.repartition(5), bins=64).collect()
    again = mixing.mix(df.repartition(2), bins=16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    per = {}
    for r in got:
        s = per.setdefault(r.source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r.size)
    assert all(abs(taken - target) <= most / 2 + 1 for taken, target, most in per.values())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_with_document_weights(spark):
    rows = [(i, f"s{i // 4 % 2}", "w " * (1 + i % 7), [None, 0.0, 1.0, 3.0][i % 4]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, quality double")
    got = mixing.mix(df, weights=[1.0, 1.0], weight_col="quality").collect()
    by = {}
    for r in got:
        n, taken = by.get(rows[r.doc_id][3], (0, 0))
        by[rows[r.doc_id][3]] = (n + r.size, taken + r.taken)
        assert r.taken <= 3 * r.size
    assert by[None][1] == 0 == by[0.0][1] and by[3.0][1] / by[3.0][0] > 1.2 * by[1.0][1] / by[1.0][0] > 0
    for s in ("s0", "s1"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4


def brute_mix(rows, targets, most=3, levels=256):
    """Copies by row from the definition, one source after another: expected numbers by bisection of the rate, then the ranked sample."""
    out = {}
    for source, target in targets.items():
        own = [r for r in rows if r[1] == source]
        top = max((r[3] for r in own), default=0)
        level = {r[0]: math.ceil(r[3] / top * levels) if top and r[2] else 0 for r in own}
        words = lambda rate: sum(min(rate * level[r[0]], most) * r[2] for r in own)  # noqa: B023, E731
        lo, hi = 0.0, 1e6
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if words((lo + hi) / 2) < target else (lo, (lo + hi) / 2)
        expected = {r[0]: min(hi * level[r[0]], most) for r in own}
        whole = {i: math.floor(e + 1e-9) for i, e in expected.items()}
        odds = lambda p: p / (1 - p)
        u = {r[0]: (int(hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for r in own}
        left = target - sum(whole[r[0]] * r[2] for r in own)
        ranked = sorted((odds(u[r[0]]) / odds(expected[r[0]] - whole[r[0]]), r[0], r[2]) for r in own if expected[r[0]] - whole[r[0]] > 1e-9)
        at = 0
        out |= whole
        for _, i, size in ranked:
            out[i] += at + size / 2 <= left
            at += size
    return out


def test_mix_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"s{rng.randrange(4)}", rng.randrange(60), round(rng.random(), 3)) for i in range(900)]
    df = spark.createDataFrame([(i, s, "w " * n, w) for i, s, n, w in rows], "doc_id long, source string, text string, odds double")
    got = mixing.mix(df, weight_col="odds", weights=[1.0, 4.0, 9.0, 2.0]).collect()
    want = brute_mix(rows, {r.source: r.target for r in got})
    assert {r.doc_id: r.copies for r in got} == want and len(set(want.values())) == 4
    names = df.withColumnsRenamed({"odds": "row"}).withColumn("copies", F.lit("clash")).withColumn("cut", F.lit(1)).withColumn("rank", F.lit(2))
    out = mixing.mixed_documents(names, weight_col="row", weights=[1.0, 4.0, 9.0, 2.0])
    assert out.columns == names.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: c for i, c in want.items() if c}


def test_mixed_documents_where_a_sample_ends_among_equal_rows(spark):
    rows = [(7, "a", "x y z")] * 9 + [(None, "b", "q q")] * 7 + [(1, "c", "w " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = {}
    for r in mixing.mix(df, weights=[1.0, 1.5, 9.0]).collect():
        got[r.source] = got.get(r.source, 0) + r.copies
    out = {r.source: r["count"] for r in mixing.mixed_documents(df, weights=[1.0, 1.5, 9.0]).groupBy("source").count().collect()}
    assert out == {s: n for s, n in got.items() if n} and got["a"] % 9 and got["b"] % 7


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), now.schema)
        counts.append(now.count())
    assert docs.count() >= counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]
    rows = lambda df: sorted((r.doc_id, tuple(r.ids)) for r in df.collect())
    assert rows(now) == rows(corpus_pipeline.run(spark, SF))
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_over_awkward_tables(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13), (None, "x y z", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SF).count()


def test_queries_agree_with_their_sql(spark):
    import duckdb

    from millrace.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall()), name
