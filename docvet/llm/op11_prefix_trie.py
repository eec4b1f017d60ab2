"""The prefix trie of conversations, built by van Emde Boas recursion.

Every distinct sequence of first turns is a node.  A sequence is cut at half its depth; the part above
the cut gets a name, which is the node at the cut, and the part below goes on as a sequence of the lower
trie under that name; both halves are cut again, all at the same time.  A name is a digest of the name
above it and the (Merkle) digest of the turns between, so it depends on the first turns alone: upper
halves that are equal have equal names and are one, and no sequence is compared or carried as a whole.

Depths are cut at multiples of powers of two.  The lowest six levels of the recursion lie within 64
turns of one conversation, which are one row; the levels above are rounds over such rows, two small
joins each, and only conversations of 64 turns or more take part.  So the number of rounds grows with
the logarithm of the longest conversation, and a conversation that holds a third of all turns is as many
rows as others together, dealt like theirs.

Totals are grafted upward the same way.  A node is counted at one place, its smallest member; a member
passes on, at each of its depths, what is counted on it there or below (summed within its rows, and
above them by the same rounds).  The sum over a node's members is its subtree's total.

Turns are told apart by 128 bits of SHA-256; texts are not shuffled, only digests and numbers of words.

Defined results: a null role or text is an empty one; turns are ordered by ``turn``, null first, and
equal ones by their digest, so repeated rows are turns of their own; rows without a conversation id are
left out; a table without conversations has no node, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from docvet.llm.common import map_rows, materialise

#: turns of one conversation that are one row
SPAN = 64
#: the name of the root, no digest of anything
ROOT = bytes(16)
#: ids that are joined to one piece of text before a node's ids are hashed in order
_PIECE = 4096


def _join(upper: bytes, lower: bytes) -> bytes:
    return hashlib.sha256(upper + lower).digest()[:16]


def _joined(upper: Column, lower: Column) -> Column:
    """The same in SQL; null if either is."""
    return F.unhex(F.substring(F.sha2(F.concat(upper, lower), 256), 1, 32))


def merkle(turns: list[bytes]) -> bytes:
    """Digest of a power of two of turns."""
    if len(turns) == 1:
        return turns[0]
    half = len(turns) // 2
    return _join(merkle(turns[:half]), merkle(turns[half:]))


def cut_names(above: bytes, at_end: bytes | None, turns: list[bytes], size: int = SPAN) -> list[bytes]:
    """Names of the nodes behind each of at most ``size`` turns that follow the node ``above``.

    ``at_end`` is the name behind the last of ``size`` turns, which the cut that ends them gave it.
    """
    if size == 1:
        return [at_end]
    half = size // 2
    upper = turns[:half]
    cut = _join(above, merkle(upper)) if len(upper) == half else None
    names = cut_names(above, cut, upper, half)
    return names + cut_names(cut, at_end, turns[half:], half) if len(turns) > half else names


def turn_symbols(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(conv, turn, symbol, words): each turn's digest of role and text, and the words of its text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.substring(whole, 1, 32)).alias("symbol"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def in_order(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``pos``, their number (from 0) among the rows of their ``key``, by ``order``.

    Rows are sorted over all partitions, so that a key of any size is split.  Only the first key of a
    partition can go on from the one before; what it is moved by is worked out from one row a partition.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = StructType(list(rows.schema.fields)).add("part", "long").add("at", "long")
    schema, place = to_arrow_schema(kind), rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            numbers = []
            for value in batch.column(place).to_pylist():
                at = at + 1 if value == last else 0
                last = value
                numbers.append(at)
            columns = [*batch.columns, pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    placed = materialise(dealt.mapInArrow(run, kind), "ordered")
    edges = placed.groupBy("part").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), (F.max_by("at", F.struct(key, "at")) + 1).alias("n")
    )
    moved, last, carried = [], None, 0
    for edge in edges.orderBy("part").collect():  # one row a partition
        if edge["first"] == last:
            moved.append((edge["part"], last, carried))
        carried = edge["n"] + (carried if edge["first"] == edge["last"] == last else 0)
        last = edge["last"]
    kinds = StructType().add("part", "long").add(key, rows.schema[key].dataType).add("moved", LongType())
    moved = F.broadcast(rows.sparkSession.createDataFrame(moved, kinds))
    return placed.join(moved, ["part", key], "left").select(*rows.columns, (F.col("at") + F.coalesce("moved", F.lit(0))).alias("pos"))


def _spans(turns: DataFrame) -> DataFrame:
    """(conv, pos, symbol, words) -> (conv, span, symbols, words, digest); a full span has a digest."""
    listed = F.sort_array(F.collect_list(F.struct("pos", "symbol", "words")))
    spans = turns.groupBy("conv", F.floor(F.col("pos") / SPAN).alias("span")).agg(listed.alias("t"))
    spans = spans.select("conv", "span", F.col("t.symbol").alias("symbols"), F.col("t.words").alias("words"))

    def make():
        return lambda conv, span, symbols, words: (conv, span, symbols, words, merkle(symbols) if len(symbols) == SPAN else None)

    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, span long, symbols array<binary>, words array<long>, digest binary"
    return materialise(map_rows(spans, spans.columns, ddl, make), "spans")


def _is_long(symbols: str) -> Column:
    """Whether a span belongs to a conversation that is cut above its spans."""
    return (F.col("span") > 0) | (F.size(symbols) == SPAN)


def _pairs(level: DataFrame, *totals: Column) -> DataFrame:
    """One level up: neighbours that share a parent as one row."""
    return materialise(level.groupBy("conv", F.shiftright("span", 1).alias("span")).agg(*totals), "level")


def _odd() -> Column:
    return F.col("span") % 2 == 1


def _levels(long: DataFrame) -> int:
    """Levels above the spans: enough that the topmost pair is never full."""
    most = long.agg(F.max("span")).first()[0]
    return 0 if most is None else (most + 1).bit_length()


def _cut_above(spans: DataFrame) -> DataFrame:
    """(conv, span) -> ``above`` and ``at_end``, the names at both ends of each span, and whether ``more`` turns follow it."""
    long = spans.filter(_is_long("symbols")).select("conv", "span", "digest")
    levels = [long]
    for _ in range(_levels(long)):
        # only a full half has a digest; a lower half follows none but a full upper one
        upper, lower = F.max(F.when(~_odd(), F.col("digest"))), F.max(F.when(_odd(), F.col("digest")))
        both = _pairs(levels[-1], upper.alias("upper"), _joined(upper, lower).alias("digest"), F.max(_odd()).alias("lower"))
        levels.append(both)
    down = levels[-1].select("conv", "span", F.lit(ROOT).alias("above"), F.lit(None).cast("binary").alias("at_end"), F.lit(False).alias("more"))
    for level in reversed(levels[1:]):
        cut = _joined(F.col("above"), F.col("upper"))
        first = F.struct((2 * F.col("span")).alias("span"), "above", cut.alias("at_end"), F.col("lower").alias("more"))
        second = F.struct((2 * F.col("span") + 1).alias("span"), cut.alias("above"), "at_end", "more")
        halves = F.explode(F.when(F.col("lower"), F.array(first, second)).otherwise(F.array(first)))
        down = down.join(level, ["conv", "span"]).select("conv", halves.alias("h")).select("conv", "h.*")
        down = materialise(down, "level")
    return down


def named_spans(turns: DataFrame) -> DataFrame:
    """(conv, span, words, above, names, more): per span, the node above it and those behind each of its turns."""
    spans = _spans(turns)
    short = spans.filter(~_is_long("symbols")).select(
        "conv", "span", "symbols", "words", F.lit(ROOT).alias("above"), F.lit(None).cast("binary").alias("at_end"), F.lit(False).alias("more")
    )
    long = spans.filter(_is_long("symbols")).drop("digest").join(_cut_above(spans), ["conv", "span"])
    both = short.union(long.select(*short.columns))

    def make():
        def one(conv, span, symbols, words, above, at_end, more):
            return conv, span, words, above, cut_names(above, at_end, symbols), more

        return one

    ddl = f"conv {turns.schema['conv'].dataType.simpleString()}, span long, words array<long>, above binary, names array<binary>, more boolean"
    return materialise(map_rows(both, both.columns, ddl, make), "named")


def _carried(dues: DataFrame) -> DataFrame:
    """(conv, span, leaves, saved) of long conversations -> what the spans below each one hold together."""
    levels = [dues]
    for _ in range(_levels(dues)):
        sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
        below = [F.sum(F.when(_odd(), F.col(c)).otherwise(0)).alias(f"{c}_below") for c in ("leaves", "saved")]
        levels.append(_pairs(levels[-1], *sums, *below, F.max(_odd()).alias("lower"), F.max(~_odd()).alias("higher")))
    zero = F.lit(0).cast("long")
    down = levels[-1].select("conv", "span", zero.alias("leaves"), zero.alias("saved"))
    for level in reversed(levels[1:]):
        level = level.select("conv", "span", "leaves_below", "saved_below", "lower", "higher")
        under = [(F.col(c) + F.col(f"{c}_below")).alias(c) for c in ("leaves", "saved")]
        first = F.struct((2 * F.col("span")).alias("span"), *under)
        second = F.struct((2 * F.col("span") + 1).alias("span"), "leaves", "saved")
        halves = F.explode(F.filter(F.array(F.when(F.col("higher"), first), F.when(F.col("lower"), second)), lambda h: h.isNotNull()))
        down = materialise(down.join(level, ["conv", "span"]).select("conv", halves.alias("h")).select("conv", "h.*"), "level")
    return down.select("conv", "span", F.col("leaves").alias("leaves_under"), F.col("saved").alias("saved_under"))


def _totals(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node name: childless nodes and saved words in its subtree."""
    due = nodes.select(
        F.col("conv_id").alias("conv"),
        F.floor((F.col("depth") - 1) / SPAN).alias("span"),
        F.struct(
            ((F.col("depth") - 1) % SPAN).cast("int").alias("at"),
            (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ).alias("due"),
    ).filter("due.leaves > 0 or due.saved > 0")
    dues = due.groupBy("conv", "span").agg(F.collect_list("due").alias("dues"))
    spans = materialise(named.select("conv", "span", "names").join(dues, ["conv", "span"], "left"), "dues")
    sums = [F.aggregate(F.coalesce(f"dues.{c}", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda a, b: a + b).alias(c) for c in ("leaves", "saved")]
    long = spans.filter(_is_long("names")).select("conv", "span", *sums)
    spans = spans.join(_carried(long), ["conv", "span"], "left")
    after = lambda c: F.transform(
        "names",
        lambda _, i: F.aggregate(
            F.coalesce("dues", F.array().cast(spans.schema["dues"].dataType)),
            F.coalesce(f"{c}_under", F.lit(0)).cast("long"),
            lambda a, d: a + F.when(d["at"] >= i, d[c]).otherwise(0),
        ),
    )
    rows = spans.select(F.explode(F.arrays_zip("names", after("leaves").alias("leaves"), after("saved").alias("saved"))).alias("r"))
    rows = rows.select(F.col("r.names").alias("name"), "r.leaves", "r.saved").filter("leaves > 0 or saved > 0")
    return rows.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(name, conv) -> (name, ends_sha256): SHA-256 of each name's ids, ascending and joined by commas.

    Ids are sorted over all partitions and joined to pieces there, so a name of any number of ids is one
    short list of pieces; these are hashed one by one, and never held together.
    """
    kind = ends.sparkSession.createDataFrame([], f"name binary, least {ends.schema['conv'].dataType.simpleString()}, ids string").schema
    schema = to_arrow_schema(kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, out = None, [], []
        for batch in batches:
            for key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != name or len(ids) == _PIECE):
                    out.append((name, ids[0], ",".join(map(str, ids))))
                    ids = []
                name = key
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip((name, ids[0], ",".join(map(str, ids))), schema, strict=True)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != name:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_pylist([{"name": n, "ends_sha256": d} for n, d in out], schema=hashed)
                out = []
        if state:
            yield pa.RecordBatch.from_pylist([{"name": name, "ends_sha256": state.hexdigest()}], schema=hashed)

    digest = ends.sparkSession.createDataFrame([], "name binary, ends_sha256 string").schema
    hashed = to_arrow_schema(digest)
    dealt = ends.select("name", "conv").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    cut = materialise(dealt.mapInArrow(pieces, kind), "pieces")
    return cut.repartition("name").sortWithinPartitions("name", "least").mapInArrow(digests, digest)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (conv, pos from 0 without gaps, symbol, words); ``convs`` are all ids, turnless ones too.

    ``name``, ``parent`` (names), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    named = named_spans(turns)
    upper = F.concat(F.array("above"), F.expr("slice(names, 1, size(names) - 1)"))
    steps = named.select("conv", "span", "more", F.size("names").alias("n"), F.posexplode(F.arrays_zip("names", "words", upper.alias("parents"))).alias("at", "t"))
    steps = steps.select(
        "conv",
        F.col("t.names").alias("name"),
        F.col("t.parents").alias("parent"),
        F.col("t.words").alias("words"),
        (F.col("span") * SPAN + F.col("at") + 1).alias("depth"),
        ((F.col("at") == F.col("n") - 1) & ~F.col("more")).alias("ends"),
    )
    nodes = steps.groupBy("name").agg(
        F.min("parent").alias("parent"),
        F.min("conv").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("words").alias("words"),
        F.count("*").alias("n_convs"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"),
    )
    nodes = materialise(nodes, "nodes")
    totals = _totals(named, nodes)
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    none = hashlib.sha256(b"").hexdigest()
    last = steps.filter("ends").select("name", "conv")
    turnless = convs.select("conv").distinct().join(named.filter("span = 0").select("conv"), "conv", "left_anti")
    digests = ends_digests(last.union(turnless.select(F.lit(ROOT).alias("name"), "conv")))
    # nodes below the root's children find their parent's id by its name; the root's children know it
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    least = convs.agg(F.min("conv").alias("conv_id"), F.countDistinct("conv").alias("n_convs")).filter("n_convs > 0")
    root = least.select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs"
    )
    top = nodes.filter("depth = 1").withColumn("parent_conv_id", least.select("conv_id").scalar())
    rest = nodes.filter("depth > 1").join(parents, "parent")
    columns = ["name", "parent", "conv_id", "depth", "n_convs"]
    below = top.select(*columns, "parent_conv_id").union(rest.select(*columns, "parent_conv_id")).join(totals, "name")
    # the root's totals are over all nodes; a root without children is a leaf itself
    over = nodes.agg(
        F.coalesce(F.sum((F.col("n_ends") == F.col("n_convs")).cast("long")), F.lit(0)).alias("n_leaves"),
        F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), F.lit(0)).alias("saved_tokens"),
    )
    leaves = F.greatest(over.select("n_leaves").scalar(), F.lit(1))
    above = root.select(*columns, F.lit(None).cast(nodes.schema["conv_id"].dataType).alias("parent_conv_id"), leaves.alias("n_leaves"), over.select("saved_tokens").scalar().alias("saved_tokens"))
    both = below.select(*above.columns).union(above)
    return both.join(children, "name", "left").join(digests, "name", "left").select(
        "name",
        "parent",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The prefix trie of the conversations as they stand."""
    turns = in_order(turn_symbols(conversations, id_col, turn_col), "conv", F.col("turn").asc_nulls_first(), "symbol")
    turns = materialise(turns, "turns")
    return prefix_trie(turns, turns.filter("pos = 0").select("conv"))


def oracle() -> str:
    """DuckDB SQL for the query's rows: sequences grouped as whole lists, totals by listing every node's ancestors."""
    return r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text))) AS seq
  FROM t GROUP BY c
), h AS (
  SELECT c, seq, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295) % 4 AS h FROM l
), r AS (
  SELECT h.c, list_concat(coalesce(b.seq[1:h.h], []), h.seq[h.h + 1:]) AS seq FROM h LEFT JOIN l b ON b.c = h.c - h.c % 20
), p AS (
  SELECT c, seq, unnest(range(0, len(seq) + 1)) AS depth FROM r
), n AS (
  SELECT seq[1:depth] AS k, depth, min(c) AS conv_id, count(*) AS n_convs,
    coalesce(list(c ORDER BY c) FILTER (len(seq) = depth), []) AS ends
  FROM p GROUP BY ALL
), kids AS (
  SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.k[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved
  FROM n LEFT JOIN kids USING (k)
), up AS (
  SELECT k, n_children, saved, unnest(range(0, depth + 1)) AS d FROM own
), total AS (
  SELECT k[1:d] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL
)
SELECT own.conv_id, own.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, own.n_convs::BIGINT AS n_convs,
  own.n_children::BIGINT AS n_children, total.n_leaves::BIGINT AS n_leaves, total.saved_tokens::BIGINT AS saved_tokens,
  sha256(array_to_string(own.ends, ',')) AS ends_sha256
FROM own JOIN total USING (k) LEFT JOIN n parent ON own.depth > 0 AND parent.k = own.k[1:own.depth - 1]
"""
