"""Every word keeps its own n-gram counts, however few words are broadcast."""

import random

import pytest

from millrace.llm import language_model
from test_text_models import brute_katz


@pytest.mark.parametrize("frequent", [0, 3, 10])
def test_words_not_broadcast_keep_their_bigrams(spark, monkeypatch, frequent):
    rng = random.Random(frequent)
    names = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(400)]
    rows = [(i, " ".join(rng.choices(names, k=rng.randrange(40)) + [f"only{i}"])) for i in range(120)] + [(200, None), (201, ""), (7, "w1 zz")]
    want, _ = brute_katz(rows, 10**6)
    monkeypatch.setattr(language_model, "PART", 700)  # many partitions
    monkeypatch.setattr(language_model.score_texts, "__defaults__", tuple(frequent if d == 1 << 18 else d for d in language_model.score_texts.__defaults__))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in language_model.score_texts(df).collect())
    assert got == sorted((rows[k][0], *w[:4], round(w[4], 6), round(w[5], 6)) for k, w in want.items())
