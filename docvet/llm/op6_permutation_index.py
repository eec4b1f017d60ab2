"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of the pivots from nearest to furthest.  It is posted in the
inverted files of its ``posted`` nearest pivots; a query reads the files of its own ``posted``
nearest pivots, ranks what stands there by Spearman's footrule between the two pivot orders, and
reranks the best ``rerank_share`` of a block by exact Euclidean distance in double precision.

The index is partitioned by row: blocks of about ``block_rows`` vectors, by the hash of the id,
each with the inverted files of its own vectors.  Queries, in blocks too, meet every vector block
in one cogroup; a pivot or a vector that a third of all rows share is spread over all blocks.  A
block's files holding fewer than ``k`` rows for a query are supplemented by the whole block, so a
query always finds min(k, all) neighbours.  Pivots are fitted on a bounded sample, the
``sample_rows`` rows with the smallest hash of their id: each pivot is the vector furthest from the
pivots before it, so that copies and near copies, however many, are not most of the pivots.  Every
row is indexed.

Defined results: vectors that are null, all zero, of another length than the pivots, or holding a
null or non-finite component take no part, as do rows with a null id; rows that repeat an id count
once (the vector that sorts first); ties go to the smaller id; no usable row gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvet.llm.common import materialise, smallest_hashes


@dataclass
class PermutationIndex:
    pivots: np.ndarray
    table: DataFrame  # block, id, vector, places (the rank of each pivot, one byte pair each)
    blocks: int


def _vectors(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _places(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The rank of each pivot for each vector; equal distances in pivot order."""
    apart = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    order = np.argsort(apart, axis=1, kind="stable")
    out = np.empty_like(order, dtype=np.int16)
    np.put_along_axis(out, order, np.arange(len(pivots), dtype=np.int16)[None], axis=1)
    return out


def _furthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows: the first, then always the one furthest from those chosen; ties to the first."""
    chosen = [0]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(good).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def build_index(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 128, sample_rows: int = 2048, block_rows: int = 2048
) -> PermutationIndex | None:
    """Index every usable row; None if there is none."""
    good = usable(rows, id_col, vector_col)
    sample = smallest_hashes(good, "id", sample_rows).orderBy("id", "vector").collect()
    if not sample:
        return None
    lengths = [len(r.vector) for r in sample]
    width = max(sorted(set(lengths)), key=lengths.count)
    centre = _furthest_first(np.array([r.vector for r in sample if len(r.vector) == width], np.float64), pivots)
    # an id counts once, with the vector that sorts first: repeats combine map-side and never fill a block
    good = good.filter(F.size("vector") == width).groupBy("id").agg(F.min("vector").alias("vector"))
    good = materialise(good, "vectors")
    blocks = max(1, -(-good.count() // block_rows))
    sent = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        for batch in batches:
            ids, vectors = batch.columns
            if not len(ids):
                continue
            places = _places(_vectors(vectors), sent.value)
            packed = pa.array([p.tobytes() for p in places], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, vectors, packed], names=["id", "vector", "places"])

    kind = good.schema["vector"].dataType.simpleString()
    table = good.mapInArrow(run, f"id long, vector {kind}, places binary")
    table = table.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return PermutationIndex(centre, materialise(table, "permutations"), blocks)


def _search_block(found: pa.Table, asked: pa.Table, k: int, posted: int, share: float, schema: pa.Schema) -> pa.Table:
    if not found.num_rows or not asked.num_rows:
        return schema.empty_table()
    # an id counts once, with the vector that sorts first
    ids = found.column("id").to_numpy()
    x = _vectors(found.column("vector"))
    order = np.lexsort((*x.T[::-1], ids))
    order = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
    ids, x = ids[order], x[order]
    place = np.frombuffer(b"".join(found.column("places").to_pylist()), np.int16).reshape(found.num_rows, -1)[order]
    files = [np.flatnonzero(place[:, p] < posted) for p in range(place.shape[1])]
    q_ids = asked.column("id").to_numpy()
    q_x = _vectors(asked.column("vector"))
    q_place = np.frombuffer(b"".join(asked.column("places").to_pylist()), np.int16).reshape(len(q_ids), -1)
    best = max(k, int(np.ceil(share * len(ids))))
    out: list[tuple] = []
    for q, v, places in zip(q_ids, q_x, q_place, strict=True):
        read = np.unique(np.concatenate([files[p] for p in np.flatnonzero(places < posted)]))
        read = read[ids[read] != q]
        if len(read) < k:
            read = np.flatnonzero(ids != q)
        if len(read) > best:
            footrule = np.abs(place[read] - places).sum(1, dtype=np.int32)
            read = read[np.argsort(footrule, kind="stable")[:best]]  # ties: the smaller id
        gap = x[read] - v
        apart = np.sqrt((gap * gap).sum(1))
        top = np.argsort(apart, kind="stable")[:k]
        out += [(int(q), int(i), float(d)) for i, d in zip(ids[read][top], apart[top], strict=True)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), schema.types, strict=True)], schema=schema)


def search(index: PermutationIndex, queries: DataFrame, k: int = 10, posted: int = 16, rerank_share: float = 0.2, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows of the index's table taken as queries."""
    asked = queries.groupBy("id").agg(F.min(F.struct("vector", "places")).alias("v")).select("id", "v.vector", "v.places")
    parts = max(1, -(-asked.count() // query_rows))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int")
    asked = asked.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(index.blocks - 1))))
    table = index.table.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    near = table.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(
        lambda found, asked: _search_block(found, asked, k, posted, rerank_share, schema), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
