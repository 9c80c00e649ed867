"""Codes decide which pairs of a bucket are computed."""

import numpy as np

from panelwright.llm import embed


def around(r, centre, n, cosine, d):
    """Unit vectors whose inner product with each other is about `cosine`."""
    x = r.standard_normal((n, d))
    x -= np.outer(x @ centre, centre)
    return np.sqrt(cosine) * centre + np.sqrt(1 - cosine) * x / np.linalg.norm(x, axis=1)[:, None]


def test_few_pairs_of_a_dense_bucket_are_computed():
    r, d, n = np.random.default_rng(3), 64, 2000
    centre = np.eye(d)[0]
    u = around(r, centre, n, 0.5, d)
    u[1::50] = u[::50] + 0.02 * r.standard_normal((n // 50, d))  # each with a near copy
    u /= np.linalg.norm(u, axis=1)[:, None]
    i, j = np.nonzero(embed.open_among(embed.encode(u), np.arange(n), np.arange(n), d, 0.95))
    assert (i < j).all() and len(i) < 0.05 * n * (n - 1) / 2
    near = embed.linked(u, i, j, 0.95)
    want = np.triu(u @ u.T >= 0.95, 1)
    assert want.sum() >= n // 50 and {*zip(i[near].tolist(), j[near].tolist())} == {*zip(*map(np.ndarray.tolist, np.nonzero(want)))}


def test_two_blocks_that_meet():
    r, d = np.random.default_rng(5), 20
    u = around(r, np.eye(d)[0], 60, 0.94, d)
    one, two = np.arange(0, 60, 2), np.arange(1, 60, 2)
    found = embed.open_among(embed.encode(u), one, two, d, 0.95)
    i, j = np.nonzero(found)
    assert ((i + j) % 2 == 1).all()
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(u @ u.T >= 0.95, 1)))) if (a + b) % 2}
    near = embed.linked(u, i, j, 0.95)
    assert want and {*zip(i[near].tolist(), j[near].tolist())} == want


def test_a_cluster_beyond_a_block_links_whole(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 64)
    r, d = np.random.default_rng(7), 16
    v = np.r_[around(r, np.eye(d)[0], 400, 0.96, d), around(r, -np.eye(d)[0], 100, 0.3, d)].astype(np.float32)
    got = {x["vec_id"]: x for x in embed.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()}
    x = v.astype(float)
    c = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    np.fill_diagonal(c, False)
    label = embed.least_labels(500, *np.nonzero(c))
    assert c.sum() > 40_000 and all((got[i]["n_links"], got[i]["component_id"]) == (c[i].sum(), label[i]) for i in range(500))
