"""Near-duplicate embeddings against all pairs in numpy; the parts' own promises."""

import numpy as np
import pytest

from docvet.llm import op13_cross_polytope as op
from docvet.llm.op13_cross_polytope import bucket_codes, embedding_groups, hadamard
from docvet.llm.queries import op13_cross_polytope

VECTORS = "vec_id long, embedding array<float>, n_links string, node int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def at_cosine(rng, x, cosine):
    """Vectors at that cosine from the unit rows ``x``."""
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * z


def brute(vectors, threshold):
    """Per row: number of links and the numbers of all rows it can reach."""
    x = np.array(vectors, np.float32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        linked = (x @ x.T) / (norm[:, None] * norm) >= threshold
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.array([min(low[i], low[row].min(initial=len(x))) for i, row in enumerate(linked)])
        if (new == low).all():
            return linked.sum(axis=1), low
        low = new


def test_hadamard_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).normal(size=(5, 16))
    y = hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(hadamard(y), x)


@pytest.mark.parametrize("dim,cosine,least", [(64, 0.951, 0.99), (64, 0.97, 0.999), (50, 0.951, 0.99), (256, 0.951, 0.96)])
def test_pairs_meet(dim, cosine, least):
    rng = np.random.default_rng(dim)
    a = unit(rng.normal(size=(1500, dim)))
    x, y = (bucket_codes(v, 5, 4, 8).reshape(1500, 5, 8) for v in (a, at_cosine(rng, a, cosine)))
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= least
    # a bucket holds few of unrelated vectors: what a vector meets grows with its neighbours, not the table
    assert len(np.unique(x[:, 0, 0])) > 1450


def test_balls_hold_only_linked_vectors():
    rng = np.random.default_rng(3)
    center = unit(rng.normal(size=(1, 32)))
    x = np.concatenate([at_cosine(rng, np.repeat(center, 200, 0), c) for c in (0.999, 0.99, 0.98, 0.9)])
    parts = op._balls(x, np.arccos(0.95) / 2 - 1e-6)
    assert sorted(np.concatenate([p[0] for p in parts]).tolist()) == list(range(800))
    assert max(len(p[0]) for p in parts) >= 400
    for numbers, mean, _ in parts:
        assert mean is None or (x[numbers] @ x[numbers].T).min() >= 0.95


def check(spark, ids, vectors, **options):
    rows = [(i, None if v is None else [float(c) for c in v], "x", 1) for i, v in zip(ids, vectors, strict=True)]
    got = embedding_groups(spark.createDataFrame(rows, VECTORS), **options).collect()
    assert len(got) == len(rows)
    links, low = brute(vectors, options.get("threshold", 0.95))
    least = {}
    for i, c in zip(ids, low.tolist(), strict=True):
        least[c] = min(least.get(c, i), i)
    want = sorted((i, int(n), least[c], i == least[c]) for i, n, c in zip(ids, links, low.tolist(), strict=True))
    assert sorted(map(tuple, got)) == want
    return links


def test_equals_all_pairs_with_hot_groups(spark, monkeypatch):
    """A third near copies of one vector, some exact copies, loose neighbours around one direction (long buckets)."""
    monkeypatch.setattr(op, "_LIST", 4)
    rng = np.random.default_rng(7)
    centers = unit(rng.normal(size=(40, 24)))
    tight = at_cosine(rng, np.repeat(centers[:1], 250, 0), 0.992)
    edge = at_cosine(rng, np.repeat(centers[1:2], 90, 0), 0.972)
    loose = at_cosine(rng, np.repeat(centers[2:3], 90, 0), 0.95)
    pairs = at_cosine(rng, centers, 0.96)
    copies = np.repeat(centers[3:4] * 3, 60, 0)
    x = np.concatenate([centers, tight, edge, loose, pairs, copies])
    ids = rng.permutation(len(x)).tolist()
    links = check(spark, ids, x)
    assert links.max() >= 249 and (links == 0).any()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 2.0], None, None),
        (5, [2.0, 4.0, 4.0], "x", 1),  # the same direction
        (5, [0.0, 0.0, 1.0], "x", 1),  # a repeated id, another vector
        (6, [0.0, 0.0, 1.0], "x", 1),
        (6, [0.0, 0.0, 1.0], "x", 1),
        (7, None, "x", 1),
        (8, [], "x", 1),
        (9, [0.0, -0.0, 0.0], "x", 1),
        (10, [1.0, nan, 2.0], "x", 1),
        (11, [1.0, inf, 2.0], "x", 1),
        (12, [1.0, None, 2.0], "x", 1),
        (None, [1.0, 2.0, 2.0], "x", 1),
        (13, [1.0, 2.0, 2.0, 0.0], "x", 1),  # another length
        (14, [3e38, 3e38, 0.0], "x", 1),
        (15, [1e-38, 1e-38, 0.0], "x", 1),
        (16, [-0.0, 0.0, 2.0], "x", 1),
    ]
    got = embedding_groups(spark.createDataFrame(rows, VECTORS)).collect()
    want = [(1, 1, 1, True), (5, 1, 1, False), (5, 3, 5, True), (6, 3, 5, False), (6, 3, 5, False), (16, 3, 5, False)]
    want += [(i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 13)] + [(14, 1, 14, True), (15, 1, 14, False)]
    key = lambda r: tuple(-1 if c is None else c for c in r)
    assert sorted(map(tuple, got), key=key) == sorted([*want, (None, 0, None, False)], key=key)
    assert embedding_groups(spark.createDataFrame([], VECTORS)).count() == 0


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = {r.vec_id: r for r in op13_cross_polytope(spark, sf).collect()}
    links, low = brute([r.embedding for r in table], 0.95)
    assert [got[r.vec_id].n_links for r in table] == links.tolist()
    assert [got[r.vec_id].component_id for r in table] == [table[c].vec_id for c in low.tolist()]
