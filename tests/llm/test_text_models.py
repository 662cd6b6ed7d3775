import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_model, license_scan, quality, queries, sentencepiece_codec, token_counts
from millrace.llm.unigram import Pieces

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "  a  b ", "▁x▁ y", "\n\n \t\r", "日本𓀀é", "a" * 300, "the cat\nsat. " * 30, "".join(random.Random(4).choices("abcthein ▁é\n日", k=2500))]


@pytest.fixture(scope="module")
def vocabulary():
    return Pieces(queries.MODEL)


def best_segmentation(p: Pieces, text: str) -> tuple[int, int]:
    """Best score of a text, and its tokens, by plain dynamic programming over substrings."""
    table = {}

    def collect(node, prefix):
        for c, child in node.items():
            if c == 0:
                table[prefix] = child
            else:
                collect(child, prefix + c)

    collect(p.root, "")
    best = [(0, 0)] + [None] * len(text)
    for j in range(1, len(text) + 1):
        found = []
        for i in range(max(0, j - p.longest), j):
            if text[i:j] in table:
                found.append((best[i][0] + table[text[i:j]][0], best[i][1] + 1))
        if text[j - 1] not in p.single:
            found.append((best[j - 1][0] + p.unknown, best[j - 1][1] + len(text[j - 1].encode())))
        best[j] = max(found, key=lambda x: x[0])
    return best[-1]


def test_encoding_is_the_best_segmentation(vocabulary):
    for text in TEXTS:
        t = text or ""
        ids = vocabulary.encode(t)
        assert vocabulary.decode(ids.tolist()) == t
        score = sum(vocabulary.best(s)[0] for s in vocabulary.span.findall(" " + t)) if t else 0
        want = best_segmentation(vocabulary, " " + t) if t else (0, 0)
        assert score == want[0] and len(ids) == want[1]


def by_scan(p, text, size):
    """Ids of a text by the scan of its chunks, step by step."""
    cut = list(sentencepiece_codec.chunks(text, size, p.longest))
    rows = sentencepiece_codec.scan([sentencepiece_codec.transfer(p, t, n) for _, t, n in cut], sentencepiece_codec.first_row(p.longest))
    end, out = 0, []
    for (_, t, n), row in reversed(list(zip(cut, rows, strict=True))):
        out = [*sentencepiece_codec.traced(p, t, n, row, end), *out]
        end = int(sentencepiece_codec.leads_back(p, t, n, row)[end])
    assert end == 0
    return out


#: Texts in which many segmentations score alike.
TIED = ["a" * 700, "ab" * 400, "aab" * 300, "the" * 250, "!!?" * 200 + "  " * 50, "\n" * 300, "é" * 200, "aaaa baaaa " * 60]


@pytest.mark.parametrize("size", [40, 97, 333])
def test_scan_of_chunks_equals_the_whole(vocabulary, size):
    for text in [*filter(None, TEXTS), *TIED]:
        assert by_scan(vocabulary, text, size) == vocabulary.encode(text).tolist(), text[:20]


def test_ids_are_those_of_the_librarys_lattice(spark, tmp_path):
    """The same pieces and scores in a file that says it is a unigram model: of words the first of the library's lattice. Its encode(), and
    its lattice of longer texts, are at times below the best sum of scores and never above."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(queries.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    (tmp_path / "u.model").write_bytes(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model")), Pieces(queries.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = sorted({w for t in texts for w in t.split()})
    score = lambda ids: sum(library.get_score(i) for i in ids)
    for w in words:
        ids = own.encode(w).tolist()
        assert library.nbest_encode(w, nbest_size=2, out_type=int)[0] == ids, w
        assert score(library.encode(w)) <= score(ids)
    for t in [*texts, *TIED]:  # of one letter over and over many segmentations are best, and each has its own way to choose
        assert score(library.encode(t[:300])) <= score(own.encode(t[:300]).tolist())


def test_merges_are_the_owners_ids(spark):
    import sentencepiece

    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    got = {r.doc_id: list(r.ids) for r in sentencepiece_codec.encode(df, queries.MODEL, merges=True).collect()}
    assert got == {i: library.encode(t or "") for i, t in rows}


def test_combination_is_associative(vocabulary):
    cut = list(sentencepiece_codec.chunks("thein" * 60, 40, vocabulary.longest))
    m = [sentencepiece_codec.transfer(vocabulary, t, n) for _, t, n in cut][:3]
    c = sentencepiece_codec.combined
    assert (c(c(m[0], m[1]), m[2]) == c(m[0], c(m[1], m[2]))).all()


def test_codec_over_tables(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate([*TEXTS, *TIED])] + [(3, TEXTS[3]), (None, TEXTS[8]), (99, TEXTS[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("sha", F.lit("x")).withColumn("ids", F.lit(0)).withColumn("key", F.lit("k")).withColumn("__key", F.lit("kk"))
    out = sentencepiece_codec.encode(df, queries.MODEL, chunk=64, giant=200)
    assert out.columns == ["doc_id", "text", "row", "sha", "key", "__key", "ids"] and {(r.key, r["__key"]) for r in out.collect()} == {("k", "kk")}
    back = sentencepiece_codec.decode(out, queries.MODEL).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.decoded == (r.text or "") and list(r.ids) == vocabulary.encode(r.text or "").tolist()
    assert sentencepiece_codec.encode(df.limit(0), queries.MODEL).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_codec.decode(nulls, queries.MODEL).collect()] == [None, ""]


def test_token_counts_equal_the_encoding(spark, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (3, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = token_counts.token_counts(df, queries.MODEL).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((i, len(vocabulary.encode(t or ""))) for i, t in rows), key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(r.ids) for r in sentencepiece_codec.encode(docs.select("doc_id", "text"), queries.MODEL).collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, queries.MODEL).collect()} == want
    assert token_counts.token_counts(df.limit(0), queries.MODEL).count() == 0


# language model


def brute_katz(rows, vocabulary_bound):
    """The model by its definition: (id -> scores), and the conditional distributions' sums."""
    words = {k: [w.decode() for w in (t or "").encode().lower().split()] for k, (i, t) in enumerate(rows)}
    train = [k for k, (i, _) in enumerate(rows) if zlib.crc32(str("" if i is None else i).encode()) % 10 != 0]
    count = collections.Counter(w for k in train for w in words[k])
    low = language_model.LOW

    def discount(counts):
        n = np.zeros(low + 2, np.int64)
        for c in counts:
            if 0 < c <= low + 1:
                n[c] += 1
        d = language_model.discounts(n)
        return lambda c: c * d[c] if c <= low else float(c)

    total, types = sum(count.values()) + len(train), len(count) + bool(train)
    by_count = sorted(collections.Counter(count.values()).items(), reverse=True)
    held, least = 0, (max(count.values()) + 1 if count else 1)
    for c, k in by_count:
        held += k
        if held > vocabulary_bound:
            break
        least = c
    star = discount([*count.values(), len(train)])
    weight = {w: star(c) for w, c in count.items() if c >= least}
    rare = sum(star(c) for c in count.values() if c < least)
    weight["</>"] = max(star(len(train)), 0.5) if train else 0.5
    unseen = max(total - sum(weight.values()) - rare, 0.5)
    weight["<rare>"] = rare + unseen
    whole = sum(weight.values())
    p1 = {w: x / whole for w, x in weight.items()}
    place = lambda w: w if w in p1 else "<rare>"
    steps = lambda k: list(zip(["<s>", *map(place, words[k])], [*map(place, words[k]), "</>"], strict=True))
    pairs = collections.Counter(x for k in train for x in steps(k))
    after = collections.Counter()
    for (h, _), c in pairs.items():
        after[h] += c
    star2 = discount(pairs.values())
    model = {}
    for h in {"<s>", *p1}:
        seen = {w: c for (g, w), c in pairs.items() if g == h}
        a, mass = sum(map(star2, seen.values())), sum(p1[w] for w in seen)
        n = after[h]
        scale, back = language_model._normal(np.array([a]), np.array([mass]), np.array([n]))
        model[h] = {w: scale[0] * star2(seen[w]) / n if w in seen else back[0] * p1[w] for w in p1}
    out = {}
    for k in words:
        score = base = 0.0
        for h, w in steps(k):
            score += math.log10(model[h][w])
        for w in words[k]:
            if place(w) == "<rare>":
                c = count[w]
                score += math.log10((rare / (rare + unseen)) * star(c) / rare if c else unseen / (rare + unseen))
        for c in [*(count[w] for w in words[k]), len(train)]:
            base += math.log10((c + 0.1) / (total + 0.1 * (types + 1)))
        out[k] = (k not in train, len(words[k]) + 1, sum(count[w] > 0 for w in words[k]) + (len(train) > 0), total, base, score)
    return out, model


@pytest.mark.parametrize("bound", [3, 10, 1000])
def test_katz_against_brute_force(spark, bound):
    rng = random.Random(bound)
    names = [f"W{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(names, k=rng.randrange(40)))) for i in range(80)] + [(200, None), (201, ""), (None, "w1 w2"), (7, "w1 zz"), (8, "q " * 500)]
    want, model = brute_katz(rows, bound)
    for h, d in model.items():
        assert abs(sum(d.values()) - 1) < 1e-9, h
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, id int").withColumn("train", F.lit(1)).repartition(3)
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score_texts(df, vocabulary=bound).collect())
    assert got == collections.Counter((rows[k][0], *w[:4], round(w[4], 6), round(w[5], 6)) for k, w in want.items())


def test_katz_partitions_and_hot_words(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "the of " * rng.randrange(9) + " ".join(f"w{rng.randrange(200)}" for _ in range(rng.randrange(60)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, _ = brute_katz(rows, 1000)
    monkeypatch.setattr(language_model, "PART", 700)  # many partitions
    got = {r.doc_id: r.score for r in language_model.score_texts(df).collect()}
    assert all(abs(got[rows[k][0]] - w[5]) < 1e-6 for k, w in want.items())


def test_katz_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score_texts(empty).count() == 0
    only = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = language_model.score_texts(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0.0


def test_model_beats_the_base_on_held_out_texts(spark):
    got = language_model.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_packing():
    rng = np.random.default_rng(0)
    for a in (np.empty(0, np.uint64), rng.integers(0, 200, 50).astype(np.uint64), np.sort(rng.integers(0, 1 << 63, 90, dtype=np.uint64)), np.array([2**64 - 1], np.uint64)):
        assert (language_model.unpacked(language_model.packed(a)) == a).all() and (language_model.unpacked(language_model.packed(a, delta=True), delta=True) == np.sort(a)).all() or len(a) == 50


# licences


def brute_licences(text):
    parts = [s for s in re.split(r"(?<=[.!?;:])[ \t\r\f\x0b]+|[\n\r]+", text or "") if re.search(r"[^\x20\x09-\x0D]", s)]
    names = {license_scan._plain(t): n for n, t in license_scan.SENTENCES.items()}
    seq = [names.get(license_scan._plain(s)) for s in parts]
    left, found, n = list(seq), set(), 0
    for rule in license_scan.RULES:
        at = 0
        while at < len(left):
            spots, here = [], at
            for i, want in enumerate(rule.sequence):
                options = [here] if not i else [here, here + 1]
                hit = next((o for o in options if o < len(left) and left[o] == want and all(x is None for x in left[here:o])), None)
                if hit is None:
                    break
                spots.append(hit)
                here = hit + 1
            if len(spots) == len(rule.sequence):
                n += 1
                found.add(rule.licence)
                for i in range(spots[0], spots[-1] + 1):
                    left[i] = None
                at = spots[-1] + 1
            else:
                at += 1
    known = [i for i, s in enumerate(seq) if s]
    return len(parts), len(known), sorted(found), n, known[0] if known else None


def test_licences(spark):
    s = license_scan.SENTENCES
    mit = f"{s['mit-grant']} {s['mit-notice']}\n\n{s['as-is']}"
    texts = [None, "", "no licence", "Released  under the mit LICENSE!", mit, mit.replace(s["mit-notice"], "Something else. " + s["mit-notice"]), s["bsd-redist"] + " " + s["bsd-source"] + "\n" + s["bsd-binary"] + "\nx.\n" + s["reserved"], f"a. {s['apache-ref']}\n{s['apache-ref']}", s["gpl3-ref"] + " tail " * 2000, "Released under the MIT License 2."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, mit)], "doc_id long, text string").withColumn("codes", F.lit("clash"))
    got = {r.doc_id: (r.n_sentences, r.n_known, list(r.licenses), r.n_matches, r.first_sentence) for r in license_scan.license_scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_licences(t), i
    assert got[4][2] == ["MIT"] and got[5][2] == ["MIT"] and got[6][2] == ["BSD-2-Clause", "all-rights-reserved"] and got[7][3] == 2
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_each_rule_finds_its_licence(spark):
    """Every rule's sentences give its licence; where a longer rule shares them, the longer one's."""
    s = license_scan.SENTENCES
    rows = [(i, "Some words.\n" + "\n".join(s[x] for x in r.sequence) + "\nMore words.") for i, r in enumerate(license_scan.RULES)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, r in enumerate(license_scan.RULES):
        assert list(got[i].licenses) == [r.licence] == brute_licences(rows[i][1])[2] and got[i].n_matches == 1, r


def test_licences_from_whole_texts(spark):
    """Hundreds of sentences and several texts that share some, as a parameter."""
    shared = "The first sentence that all of them share.\nAnd a second one of these."
    texts = {f"L-{i}": f"Licence number {i} of many.\n{shared}\n" + "\n".join(f"Clause {k} of licence {i} says this." for k in range(40)) for i in range(12)} | {"L-none": " \n"}
    table = license_scan.DEFAULT.with_texts(texts)
    assert len(table.sentences) > 400 and len(table.rules) == len(license_scan.RULES) + 24
    rows = [(1, texts["L-3"]), (2, "Preface.\n" + "\n".join(texts["L-5"].split("\n")[:10])), (3, shared), (4, texts["L-7"].replace("\nClause 9 ", "\nAn odd line between.\nClause 9 ") + "\nMIT License"), (5, None)]
    got = {r.doc_id: (list(r.licenses), r.n_matches) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), licences=table).collect()}
    assert got == {1: (["L-3"], 1), 2: (["L-5"], 1), 3: ([], 0), 4: (["L-7", "MIT"], 2), 5: ([], 0)}


def test_licence_plan_has_no_python(spark):
    plan = license_scan.license_scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# quality


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    held = scored.where("held_out").join(labels, "doc_id")
    r = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("predicted"))), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted")))).first()
    assert r[0] > 0.97 and r[1] > 0.98 and r[2] > 0.85
    fold = held.select("doc_id", "held_out").limit(20).collect()
    assert all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in fold)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "x"), (4, "word " * 50000, "x")], "doc_id long, text string, positive string")
    none = spark.createDataFrame([(1, 0), (2, None), (3, 7)], "doc_id long, quality int")
    assert quality.fit(docs, none) is None and quality.fit(docs.limit(0), none) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5} and quality.keep_good(docs, None).count() == 4
    good = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    net = quality.fit(docs, good)
    assert net is None or quality.score(docs, net).where("score is not null").count() == 4
    x = np.array([quality.features(t) for t in ("", "Plain words of a text.", "A | B | C")])
    assert np.isfinite(x).all() and x.shape == (3, quality.N_FEATURES)


def test_scores_and_licences_of_rows_that_repeat_an_id(spark):
    rows = [(1, "Plain words of a text. MIT License?!x"), (1, "A | B | C\nMIT License"), (1, "A | B | C\nMIT License"), (None, "A | B | C\nMIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(3)).repartition(2)
    net = quality.fit_nnpu(np.array([quality.features("Plain words of a text. ")] * 9 + [quality.features("More plain words, of another text.")]), np.array([quality.features(t) for t in ("A | B", "| C |", "Plain words of a text.")]), 0.4)
    got = sorted((str(r.doc_id), round(r.score, 9)) for r in quality.score(df, net).collect())
    one = lambda t: round(float(net.scores(quality.features(t)[None].astype(np.float64))[0]), 9)
    assert got == sorted((str(i), one(t)) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.licenses)) for r in license_scan.license_scan(df).collect()) == sorted((str(i), ["MIT"] if "\n" in t else []) for i, t in rows)


def test_nonnegative_risk_separates():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (600, 4)), rng.normal(-1.5, 1, (600, 4))
    u = np.concatenate([p[300:], n[:100]])
    net = quality.fit_nnpu(p[:300], u, 0.75)
    assert (net.scores(p) >= 0.5).mean() > 0.85 and (net.scores(n) < 0.5).mean() > 0.85
    assert 0.5 < quality._estimated_prior(p[:300], u, 1) <= 0.98


def test_risk_is_minimal_and_its_gradient_is_the_numeric_one():
    """The multiplier's linear system against a plain descent of the written risk, on both sides of the kink."""
    rng = np.random.default_rng(3)
    for shift in (0.4, 1.5):  # classes that overlap, and ones so far apart that the second part would fall below zero
        p, n = rng.normal(shift, 1, (80, 3)), rng.normal(-shift, 1, (400, 3))
        u = np.concatenate([rng.normal(shift, 1, (200, 3)), n[:120]])
        for prior in (0.3, 0.62, 0.9):
            one = lambda x: np.concatenate([np.ones((len(x), 1)), x], axis=1)
            positive, unlabelled = (one(x).T @ one(x) / len(x) for x in (p, u))

            def whole(w, prior=prior, p=p, u=u, one=one):
                g, h = one(p) @ w, one(u) @ w
                first, second = prior * np.mean((1 - g) ** 2), np.mean((1 + h) ** 2) - prior * np.mean((1 + g) ** 2)
                return first + max(0.0, second) + 1e-2 * w @ w, second

            w = quality.minimiser(positive, unlabelled, prior)
            parts = quality.risk(positive, unlabelled, w, prior)
            assert abs(parts[0] + max(0.0, parts[1]) + 1e-2 * w @ w - whole(w)[0]) < 1e-9 and parts[1] > -1e-6
            steps = [1e-4 * d for d in rng.normal(size=(200, 4))]
            assert min(whole(w + d)[0] for d in steps) > whole(w)[0] - 1e-7
            if whole(w)[1] > 1e-4:  # away from the kink the numeric gradient is zero
                grad = [(whole(w + 1e-6 * e)[0] - whole(w - 1e-6 * e)[0]) / 2e-6 for e in np.eye(4)]
                assert np.abs(grad).max() < 1e-5


def test_prior_is_that_of_the_unlabelled_side():
    rng = np.random.default_rng(5)
    p = rng.normal(2, 1, (3000, 4))
    for share in (0.2, 0.5, 0.85):
        u = np.concatenate([rng.normal(2, 1, (int(8000 * share), 4)), rng.normal(-2, 1, (int(8000 * (1 - share)), 4))])
        assert abs(quality._estimated_prior(p, u, 1) - share) < 0.04


def test_fit_over_partitions_is_the_fit_in_memory(spark):
    """Brute force: features of all training texts in one array, and no label but trusted positives matters."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    net = quality.fit(docs.repartition(7), labels, prior=0.8)
    train = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    x = np.array([quality.features(r.text) for r in train], np.float64)
    want = quality.fit_nnpu(x[[r.doc_id in good for r in train]], x, 0.8)
    assert np.allclose(net.logits(x), want.logits(x), atol=1e-6)
    assert np.allclose(quality.fit(docs, labels.where("quality = 1"), prior=0.8).logits(x), want.logits(x), atol=1e-6)
    scored = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    assert np.allclose([scored[r.doc_id] for r in train], np.clip((1 + want.logits(x)) / 2, 0, 1), atol=1e-6)
