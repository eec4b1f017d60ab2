"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobed, verified.

Two vectors are linked when their cosine, in double precision, reaches ``threshold``; the connected
components of the links are the groups of near-duplicates.

* A hash is the nearest of the 2d signed axes after a pseudo-random rotation (three rounds of random
  signs and a fast Hadamard transform).  A bucket is ``hashes`` of them together, in each of ``tables``
  tables.  Every vector is posted in its ``probes`` nearest buckets of each table, nearest by how far
  the chosen axes stay behind the best ones, so two near vectors meet even if neither is the other's
  nearest bucket.  With the defaults a pair of cosine 0.951 in 64 dimensions meets with probability
  above 0.99, a closer one more often.
* Exact copies are one entry.  Vectors of one bucket of the first table that lie within half the
  threshold's angle of their mean direction form a ball: any two of them are linked by the triangle
  inequality, whatever their number, and no pair of them is looked at.  What lies in no ball is a ball
  of its own.  Only balls are posted, paired and connected.
* Balls that meet are verified.  Mean directions and radii decide most pairs as a whole; where they
  leave it open, the members' own cosines are computed.  A bucket of many balls is cut into blocks, and
  its pairs of blocks are compared in matrices: such a bucket is no list of pairs, and no task holds
  more than two blocks.

Postings are shuffled as (bucket, ball) numbers; vectors are shuffled once to find copies, once to form
balls and once per pair left open.  Every step that others start from is written to the shared folder.

Defined results: a vector that is null, empty, all zero, or holds a null or non-finite component links
with nothing and is its own component; vectors of different lengths don't link; copies link with each
other, repeated rows too; rows without an id take no part (no links, no component, not kept); the
component of rows that repeat an id is named like any other; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import map_rows, materialise
from docvet.llm.components import connected_components

#: angles nearer than this to a limit are decided by the members' own cosines
_SLACK = 1e-6
#: members of a ball, at most: what one task holds of it
_BALL = 1024
#: balls of one bucket that are paired as a list; beyond, and up to _BLOCK a block, as matrices
_LIST, _BLOCK = 32, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows' Walsh-Hadamard transform, scaled to keep lengths; their length is a power of two."""
    rows, size = x.shape
    step = 1
    while step < size:
        pair = x.reshape(rows, size // (2 * step), 2, step)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(rows, size)
        step *= 2
    return x / np.sqrt(size)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 13, near: int = 3) -> np.ndarray:
    """(rows, tables * probes) bucket numbers of unit rows, of each table the nearest first."""
    rows, dim = x.shape
    size = max(2, 1 << (dim - 1).bit_length())
    near = min(near, size)
    padded = np.zeros((rows, size))
    padded[:, :dim] = x
    out = []
    for table in range(tables):
        code, behind = np.full((rows, 1), table, np.int64), np.zeros((rows, 1))
        for h in range(hashes):
            y = padded
            for turn in range(3):
                y = hadamard(y * np.random.default_rng([seed, table, h, turn]).choice([-1.0, 1.0], size))
            height = np.abs(y)
            axis = np.argsort(-height, axis=1, kind="stable")[:, :near]
            tall = np.take_along_axis(height, axis, 1)
            signed = 2 * axis + (np.take_along_axis(y, axis, 1) < 0)
            code = (code[:, :, None] * (2 * size) + signed[:, None, :]).reshape(rows, -1)
            behind = (behind[:, :, None] + ((tall[:, :1] - tall) ** 2)[:, None, :]).reshape(rows, -1)
        best = np.argsort(behind, axis=1, kind="stable")[:, :probes]
        out.append(np.take_along_axis(code, best, 1))
    return np.concatenate(out, axis=1)


def scaled(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, divided by a power of two so that no product overflows; None if it can't link."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    return np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column as rows padded by zeros, and the lists' lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=1))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width), lengths
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _pad(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _verdicts(cosine, same_length, radii, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of balls: whether all their members are linked, and whether that is open."""
    exact = radii == 0
    angle, limit = np.arccos(np.clip(cosine, -1, 1)), np.arccos(threshold)
    linked = np.where(exact, cosine >= threshold, angle + radii <= limit - _SLACK) & same_length
    unknown = ~exact & ~linked & (angle - radii <= limit + _SLACK) & same_length
    return linked, unknown


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(df: DataFrame, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = df.sparkSession.createDataFrame([], ddl).schema
    return kind, to_arrow_schema(kind)


def hashed_vectors(vectors: DataFrame, tables: int, hashes: int, probes: int, seed: int) -> DataFrame:
    """(node, vec, n) -> with ``codes``, the buckets of each vector, and ``home``, the first of them."""
    kind, schema = _arrow(vectors, "node long, vec array<double>, n long, codes array<long>, home long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, lengths = _matrix(batch.column(1))
                codes = np.zeros((len(x), tables * probes), np.int64)
                for dim in np.unique(lengths):
                    here = lengths == dim
                    part = x[here, :dim]
                    codes[here] = _filled(bucket_codes(part / _norms(part)[:, None], tables, hashes, probes, seed), tables, probes)
                yield _rows(schema, batch.column(0), batch.column(1), batch.column(2), codes.tolist(), codes[:, 0])

    return vectors.select("node", "vec", "n").mapInArrow(run, kind)


def _filled(codes: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """``codes`` with each table's nearest bucket repeated where there are fewer than ``probes`` of them."""
    per_table = codes.reshape(len(codes), tables, -1)
    missing = probes - per_table.shape[2]
    return np.concatenate([per_table, np.repeat(per_table[:, :, :1], missing, axis=2)], axis=2).reshape(len(codes), -1)


def _balls(x: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray | None, float]]:
    """Row numbers, mean direction and radius of each ball of the rows; one row is a ball without either."""
    unit = x / _norms(x)[:, None]
    left, out = np.arange(len(x)), []
    while len(left) > 1:
        mean = unit[left].sum(axis=0)
        size = np.sqrt(mean @ mean)
        if size < 1e-9:
            break
        mean /= size
        angle = np.arccos(np.clip(unit[left] @ mean, -1, 1))
        inside = angle <= radius
        if inside.sum() < 2:
            break
        out.append((left[inside], mean, float(angle[inside].max()) + _SLACK / 4))
        left = left[~inside]
    return out + [(left[i : i + 1], None, 0.0) for i in range(len(left))]


def ball_members(hashed: DataFrame, threshold: float) -> DataFrame:
    """Each vector with the ``ball`` it lies in, named by its smallest node.

    The row of that node holds the ball's ``pivot`` (the mean direction; the vector itself, if alone),
    ``radius`` and ``weight`` (rows of the input in it).  Sorted by bucket, so that a bucket of any size
    is split among partitions, and a ball holds a bounded number of members.
    """
    ddl = "ball long, node long, vec array<double>, n long, codes array<long>, pivot array<double>, radius double, weight long"
    kind, schema = _arrow(hashed, ddl)
    radius = np.arccos(threshold) / 2 - _SLACK

    def balls(members: list[tuple]) -> pa.RecordBatch:
        rows = []
        for _, part in groupby(sorted(members, key=lambda m: (len(m[1]), m[0])), key=lambda m: len(m[1])):
            part = list(part)
            for numbers, mean, reach in _balls(np.array([m[1] for m in part]), radius):
                inside = [part[i] for i in numbers.tolist()]
                ball, weight = inside[0][0], sum(m[2] for m in inside)
                for m in inside:
                    first = m[0] == ball
                    pivot = (m[1] if mean is None else mean.tolist()) if first else None
                    rows.append((ball, *m[:4], pivot, reach if first else None, weight if first else None))
        return _rows(schema, *zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, home = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if members and (row[4] != home or len(members) == _BALL):
                    yield balls(members)
                    members = []
                home = row[4]
                members.append(row)
        if members:
            yield balls(members)

    dealt = hashed.repartitionByRange("home", "node").sortWithinPartitions("home", "node")
    return dealt.select("node", "vec", "n", "codes", "home").mapInArrow(run, kind)


def bucket_blocks(members: DataFrame) -> DataFrame:
    """(code, block, balls): each bucket's balls, in blocks of at most ``_BLOCK``; buckets of one ball are left out.

    Sorted by bucket and ball over all partitions: a bucket of any size is split, never gathered.
    """
    postings = members.select(F.explode("codes").alias("code"), "ball")
    kind, schema = _arrow(postings, "code long, block long, balls array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        out, balls, code, first = [], [], None, True
        for batch in batches:
            for c, ball in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != code or len(balls) == _BLOCK:
                    # the first and last bucket of a partition may go on in another one
                    if balls and (first or len(balls) > 1 or c == code):
                        out.append((code, name, balls))
                        name += 1
                    first, code, balls = first and (code is None or c == code), c, []
                if not balls or balls[-1] != ball:
                    balls.append(ball)
            if len(out) >= 1024:
                yield _rows(schema, *zip(*out, strict=True))
                out = []
        if balls:
            out.append((code, name, balls))
        if out:
            yield _rows(schema, *zip(*out, strict=True))

    return postings.repartitionByRange("code", "ball").sortWithinPartitions("code", "ball").mapInArrow(run, kind)


def _cogroup(sides: list[DataFrame], keys: list[str], fn, kind) -> DataFrame:
    """``fn(left, right)`` on the rows of both sides by key; both tables have the sides' own column names."""
    left, right = sides[0], sides[1].toDF(*(f"{c}_" for c in sides[1].columns))
    names = sides[1].columns
    grouped = left.groupBy(*keys).cogroup(right.groupBy(*(f"{k}_" for k in keys)))
    return grouped.applyInArrow(lambda a, b: fn(a, b.rename_columns(names)), kind)


def _verify_listed(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, both balls' pivot and radius) -> (a, b, open) of the pairs that are linked or open."""
    kind, schema = _arrow(pairs, "a long, b long, open boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, n), (y, m) = _matrix(batch.column(2)), _matrix(batch.column(4))
            x, y = _pad(x, y)
            cosine = np.einsum("ij,ij->i", x, y) / (_norms(x) * _norms(y))
            radii = batch.column(3).to_numpy() + batch.column(5).to_numpy()
            linked, unknown = _verdicts(cosine, n == m, radii, threshold)
            keep = linked | unknown
            yield _rows(schema, batch.column(0).to_numpy()[keep], batch.column(1).to_numpy()[keep], unknown[keep])

    return pairs.mapInArrow(run, kind)


def _verify_blocks(blocks: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks of the same bucket, and long blocks with themselves, as matrices -> (a, b, open)."""
    many = blocks.groupBy("code").agg(F.count("*").alias("blocks")).filter("blocks > 1")
    split = blocks.join(many, "code").select("code", "block", "balls")
    other = split.select("code", F.col("block").alias("block2"), F.col("balls").alias("balls2"))
    pairs = split.join(other, "code").filter("block < block2").select("block", "block2", "balls", "balls2")
    alone = blocks.filter(F.size("balls") > _LIST).select("block", F.col("block").alias("block2"), "balls", F.array().cast("array<long>").alias("balls2"))
    pairs = materialise(pairs.union(alone), "block-pairs")
    sides = [pairs.select("block", "block2", F.explode(c).alias("ball")).join(balls, "ball") for c in ("balls", "balls2")]
    kind, schema = _arrow(blocks, "a long, b long, open boolean")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        same = right.num_rows == 0
        left, right = (t.combine_chunks() for t in (left, left if same else right))
        (x, n), (y, m) = (_matrix(t["pivot"].combine_chunks()) if t.num_rows else (np.zeros((0, 1)), np.zeros(0)) for t in (left, right))
        x, y = _pad(x, y)
        cosine = (x @ y.T) / (_norms(x)[:, None] * _norms(y))
        i, j = left["ball"].to_numpy(), right["ball"].to_numpy()
        radii = left["radius"].to_numpy()[:, None] + right["radius"].to_numpy()
        linked, unknown = _verdicts(cosine, n[:, None] == m, radii, threshold)
        p, q = np.nonzero((linked | unknown) & ((i[:, None] < j) if same else (i[:, None] != j)))
        a, b = np.minimum(i[p], j[q]), np.maximum(i[p], j[q])
        return pa.Table.from_batches([_rows(schema, a, b, unknown[p, q])])

    return _cogroup(sides, ["block", "block2"], compare, kind)


def _verify_members(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """Open pairs of balls -> (a, b, node, n): the rows of the other ball that a member is linked with."""
    of = members.select("ball", "node", "vec", "n")
    sides = [pairs.select("a", "b", F.col(c).alias("ball")).join(of, "ball").select("a", "b", "node", "vec", "n") for c in ("a", "b")]
    kind, schema = _arrow(pairs, "a long, b long, node long, n long")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        (x, _), (y, _) = (_matrix(t["vec"].combine_chunks()) for t in (left, right))
        linked = (x @ y.T) / (_norms(x)[:, None] * _norms(y)) >= threshold
        counts = np.concatenate([linked @ right["n"].to_numpy(), left["n"].to_numpy() @ linked])
        nodes = np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
        some = counts > 0
        a, b = left["a"][0].as_py(), left["b"][0].as_py()
        return pa.Table.from_batches([_rows(schema, [a] * int(some.sum()), [b] * int(some.sum()), nodes[some], counts[some])])

    return _cogroup(sides, ["a", "b"], compare, kind)


def embedding_groups(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.95,
    tables: int = 5,
    hashes: int = 4,
    probes: int = 8,
    seed: int = 13,
) -> DataFrame:
    """Per input row: id, ``n_links`` (other rows found linked with it), ``component_id`` (smallest id of its group), ``kept``."""
    if not 0 < threshold < 1:
        raise ValueError("a threshold lies between 0 and 1")
    kind = vectors.schema[id_col].dataType.simpleString()

    def make():
        def one(key, vector):
            x = None if key is None else scaled(vector)
            if x is None:
                return key, None, None
            return key, hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x.tolist()

        return one

    rows = materialise(map_rows(vectors, [id_col, vec_col], f"id {kind}, digest binary, vec array<double>", make, 1024), "vectors")
    # equal digests are equal vectors: any row's copy of the vector will do
    alike = rows.filter("digest is not null").groupBy("digest")
    distinct = alike.agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    hashed = materialise(hashed_vectors(distinct, tables, hashes, probes, seed), "hashed")
    members = materialise(ball_members(hashed, threshold), "members")
    balls = members.filter("ball = node").select("ball", "pivot", "radius", "weight")
    blocks = materialise(bucket_blocks(members), "blocks")

    listed = blocks.filter(F.size("balls").between(2, _LIST)).select("balls", F.posexplode("balls").alias("at", "a"))
    listed = listed.select("a", F.explode(F.expr("slice(balls, at + 2, size(balls))")).alias("b")).distinct()
    sides = [balls.select(F.col("ball").alias(c), F.col("pivot").alias(f"{c}_pivot"), F.col("radius").alias(f"{c}_radius")) for c in ("a", "b")]
    listed = listed.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_pivot", "a_radius", "b_pivot", "b_radius")
    met = _verify_listed(listed, threshold).union(_verify_blocks(blocks, balls.drop("weight"), threshold))
    met = materialise(met.distinct(), "met")
    whole = met.filter("not open").select("a", "b")
    single = materialise(_verify_members(met.filter("open"), members, threshold), "open")

    # links of a member: its ball's other rows, all rows of balls linked as a whole, rows found one by one
    other = whole.union(whole.select("b", "a")).join(balls.select(F.col("ball").alias("b"), "weight"), "b")
    per_ball = other.groupBy(F.col("a").alias("ball")).agg(F.sum("weight").alias("others"))
    per_ball = balls.join(per_ball, "ball", "left").select("ball", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("all"))
    per_node = single.groupBy("node").agg(F.sum("n").alias("some"))
    roots = connected_components(whole.union(single.select("a", "b").distinct()), "a", "b")
    placed = (
        members.select("ball", "node")
        .join(per_ball, "ball")
        .join(per_node, "node", "left")
        .join(roots.withColumnRenamed("node", "ball"), "ball", "left")
        .select("node", (F.col("all") + F.coalesce("some", F.lit(0))).alias("n_links"), F.coalesce("root", "ball").alias("root"))
        .join(distinct.select("node", "digest", "least"), "node")
    )
    placed = materialise(placed, "placed")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    out = rows.select("id", "digest").join(named.select("digest", "n_links", "component_id"), "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
