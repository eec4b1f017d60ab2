import math
import random

import duckdb
import numpy as np

from docvet.llm.op6_permutation_index import build_index, search, usable
from docvet.llm.queries import op6_permutation_index

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    out = {}
    for q in queries:
        mine = dict(rows)[q]
        near = sorted((math.dist(mine, v), i) for i, v in rows if i != q)
        out[q] = near[:k]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet'").fetchall()
    got = {}
    for r in op6_permutation_index(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [100 * i for i in range(5)]
    asked = [i for i, _ in rows if i % 100 == 0]
    assert sorted(got) == asked and set(queries) <= set(asked)
    want, hits = brute(rows, asked, 10), 0
    for q in asked:
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        for _, i, score in mine:
            assert abs(score - math.dist(dict(rows)[q], dict(rows)[i])) < 1e-12
        hits += len({m[1] for m in mine} & {i for _, i in want[q]})
    assert hits / (10 * len(asked)) >= 0.95


def test_blocks_agree_with_brute_force_when_all_is_reranked(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows = [(i, v if i % 3 else [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i, v in rows]  # a vector that a third share
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    index = build_index(frame, pivots=8, block_rows=100)
    assert index.blocks == 7
    found = search(index, index.table.filter("id % 20 = 0"), k=5, posted=8, rerank_share=1.0, query_rows=10).collect()
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    for q, near in want.items():
        mine = sorted((r["rank"], r.vec_id) for r in found if r.query_id == q)
        assert [m[1] for m in mine] == [i for _, i in near], q


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (7, [1.0], 1), (8, [], 1), (None, [1.0, 1.0], 1), (9, [1.0, 0.0], None), (9, [1.0, 0.0], None)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], VECTORS + ", places string, block int")
    assert sorted(r.id for r in usable(frame, "vec_id", "embedding").collect()) == [0, 1, 7, 9, 9]
    index = build_index(frame)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search(index, index.table, k=10).collect())
    two = math.sqrt(2)
    assert got == [(0, 1, 9, 0.0), (0, 2, 1, two), (1, 1, 0, two), (1, 2, 9, two), (9, 1, 0, 0.0), (9, 2, 1, two)]
    assert build_index(spark.createDataFrame([], VECTORS)) is None
    assert build_index(spark.createDataFrame([(1, None, 0)], VECTORS)) is None


def test_recall_with_a_third_near_copies(spark):
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    near = np.arange(len(x)) % 3 == 1
    x[near] = unit(x[0] + 0.05 * unit(rng.normal(size=(int(near.sum()), 64))))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    x = np.array([v for _, v, _ in rows])
    index = build_index(spark.createDataFrame(rows, VECTORS))
    got = {}
    for r in search(index, index.table.filter("id % 40 = 0"), k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = {True: [], False: []}
    for q, mine in got.items():
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        gap[q] = np.inf
        share[bool(near[q])].append(len(mine & set(np.argsort(gap)[:10].tolist())) / 10)
    assert len(got) == 150 and sum(share[False]) / len(share[False]) >= 0.9 and sum(share[True]) / len(share[True]) >= 0.9
