"""Pairs planted among vectors that share a mean direction are all found."""

import numpy as np

from millrace.llm import embedding_dedup


def planted(n, pairs, share, seed, dim=64, low=0.981, high=0.985):
    """n unit vectors around one direction (cosines near share), the last pairs of which copy the first at a cosine between low and high."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(share) * unit(rng.standard_normal(dim)) + np.sqrt(1 - share) * unit(rng.standard_normal((n - pairs, dim))))
    a = x[:pairs]
    y = rng.standard_normal(a.shape)
    y = unit(y - (y * a).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(low, high, (pairs, 1))
    return np.concatenate([x, c * a + np.sqrt(1 - c * c) * y])


def test_pairs_around_a_mean_direction(spark):
    x = planted(4000, 800, 0.8, 1)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicate_vectors(df, window=4).collect()}
    assert want.sum() >= 1600 and got == dict(enumerate(want.tolist()))
