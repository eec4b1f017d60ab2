import itertools
import random
import zlib

import pytest

from docvet.llm.op7_shards import minimax_cuts, minimax_shards
from tests.llm.helpers import DOCS, awkward_docs


def brute_capacity(sizes, shards):
    """Smallest largest run over all ways to cut the sequence."""
    least = [[float("inf")] * (len(sizes) + 1) for _ in range(shards + 1)]
    least[0][0] = 0
    total = [0, *itertools.accumulate(sizes)]
    for k in range(1, shards + 1):
        for j in range(len(sizes) + 1):
            least[k][j] = min(max(least[k - 1][i], total[j] - total[i]) for i in range(j + 1))
    return least[shards][-1]


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_minimal(spark, seed):
    rng = random.Random(seed)
    n, shards = rng.choice([(1, 3), (5, 8), (60, 4), (150, 7)]), rng.choice([0])
    n, shards = n
    # few distinct prefixes, so that cells hold many groups and must be split
    keys = sorted({f"{rng.randrange(3):04x}{rng.randrange(4):02x}{rng.getrandbits(104):026x}" for _ in range(n)})
    sizes = [rng.choice([1, 5, 17, 300]) if seed % 2 else rng.randint(1, 50) for _ in keys]
    capacity, cuts = minimax_cuts(spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key string, bytes long"), shards)
    assert capacity == brute_capacity(sizes, shards)
    load = {}
    for k, s in zip(keys, sizes, strict=True):
        shard = sum(k >= c for c in cuts)
        load[shard] = load.get(shard, 0) + s
    assert max(load.values()) == capacity and max(load) < shards


def test_rows(spark):
    docs = awkward_docs()
    frame = spark.createDataFrame([(*d, 9, "x") for d in docs], DOCS + ", size int, key string")
    got = minimax_shards(frame, shards=5, bucket_rows=4).collect()
    assert len(got) == len(docs)
    size = {(r[0], (r[1] or "").encode().__len__() + 16, zlib.crc32((r[1] or "").encode())) for r in docs}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == size
    slots, load, home = {}, {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] = load.get(r.shard, 0) + r.size
        home.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {}
    for r in docs:
        texts.setdefault(r[1], set()).add(r[0])
    assert all(len({r.shard for r in got if r.doc_id in ids and r.size == len((t or "").encode()) + 16}) == 1 for t, ids in texts.items() if None not in ids)
    assert max(load) < 5 and max(load.values()) >= sum(load.values()) / 5
    assert minimax_shards(spark.createDataFrame([], DOCS)).count() == 0
