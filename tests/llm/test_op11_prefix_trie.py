"""The prefix trie against a dictionary of prefixes, on short, deep and awkward conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from docvet.llm import op11_prefix_trie as op
from docvet.llm.op11_prefix_trie import ROOT, conversation_trie, cut_names, in_order, merkle, oracle
from docvet.llm.queries import op11_prefix_trie, rebuilt_turns

SCHEMA = "conv_id long, turn long, role string, text string, conv string, name string, pos long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """A row per distinct prefix, from the members and subtrees of each."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not kids[k]
    rows = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(k))
        parent = members[k[:-1]][0] if k else None
        rows.append((m[0], len(k), parent, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: (r[1], r[0]))


def ordered(rows) -> dict[int, list[tuple[str, str]]]:
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, (role or "", text or "")))
    return {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def collected(trie):
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.collect()), key=lambda r: (r[1], r[0]))


def talks(rng, n, words=("a", "b b", "c\x0bc c", "")):
    rows = []
    for _ in range(n):
        c = rng.randrange(400)
        rows += [(c, t, rng.choice(["user", None, "system"]), rng.choice(words)) for t in range(rng.randint(1, 5))]
    return rows


def test_names_depend_on_the_first_turns_alone():
    rng = random.Random(1)
    turns = [bytes([rng.randrange(256)]) * 16 for _ in range(64)]
    full = cut_names(ROOT, b"end", turns)
    assert full[-1] == b"end" and len(set(full)) == 64
    for n in range(1, 64):
        assert cut_names(ROOT, None, turns[:n]) == full[:n]
    # a change at a turn changes every name behind it, and none before it
    other = cut_names(ROOT, None, turns[:20] + [bytes(16)] + turns[21:40])
    assert other[:20] == full[:20] and not set(other[20:]) & set(full)
    # the name at a cut is the digest of the half above it
    assert full[31] == op._join(ROOT, merkle(turns[:32])) and full[47] == op._join(full[31], merkle(turns[32:48]))


def test_positions_over_many_partitions(spark):
    """One key holds most rows, so it is split among partitions; positions stay gapless and in order."""
    rng = random.Random(2)
    rows = [(rng.choice([3, 3, 3, 3, 5, 8, 9]), i, bytes(16), 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "conv long, turn long, symbol binary, words long").repartition(7)
    got = in_order(df, "conv", F.col("turn"))
    assert got.groupBy("conv").agg(F.countDistinct("pos").alias("n"), F.max("pos").alias("m"), F.count("*").alias("c")).filter(
        "n <> c or m <> c - 1"
    ).count() == 0
    want = {}
    for c, t, *_ in sorted(rows):
        want[(c, t)] = want.get(c, -1) + 1
        want[c] = want[(c, t)]
    assert all(want[(r.conv, r.turn)] == r.pos for r in got.collect())


def test_awkward_conversations_equal_brute_force(spark):
    rng = random.Random(3)
    rows = talks(rng, 150)
    rows += [(c, t, "user", "same words") for c in range(500, 560) for t in range(3)]  # a large group of copies
    rows += [(600, None, "user", "first"), (600, 2, None, None), (600, 2, None, None), (600, 2, "user", "tie"), (600, 1, "user", "x")]
    rows += [(None, 1, "user", "no conversation"), (-7, 0, "user", "long " * 3000), (601, 0, "u", "x"), (602, 0, "", "ux")]
    df = frame(spark, rows)
    assert collected(conversation_trie(df, "conv_id", "turn")) == brute(ordered(rows))
    assert conversation_trie(frame(spark, [])).count() == 0


def test_deep_conversations_equal_brute_force(spark):
    """Cuts above the spans: lengths around powers of two, shared to any depth, one conversation far longer than the rest."""
    rng = random.Random(4)
    line = [rng.choice("abcdef") for _ in range(700)]
    convs = {1: line[:640], 2: line[:641], 3: line[:64], 4: line[:128], 5: line[:127], 6: line[:65], 7: line[:639], 8: line[:640]}
    convs |= {20 + i: line[:cut] + ["other"] + line[: rng.randrange(200)] for i, cut in enumerate([0, 63, 64, 100, 128, 192, 448, 512])}
    rows = [(c, t, "user", text) for c, texts in convs.items() for t, text in enumerate(texts)]
    assert collected(conversation_trie(frame(spark, rows))) == brute({c: [("user", x) for x in texts] for c, texts in convs.items()})


def test_rebuilt_query_equals_brute_force_and_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [r for r in talks(rng, 250) if r[0] % 20 or rng.random() < 0.5]
    rows += [(400, 0, "user", "short")] + [(410, t, "user", f"t{t % 9}") for t in range(150)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = collected(op11_prefix_trie(spark, str(tmp_path)))
    assert got == brute(rebuilt(ordered(rows)))
    turns, convs = rebuilt_turns(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert convs.count() > turns.select("conv").distinct().count()  # some have no turn left
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({oracle()})").fetchall()
    assert got == sorted(want, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("ids", [[5], list(range(0, 30000, 2))])
def test_digests_of_any_number_of_ids(spark, ids):
    df = spark.createDataFrame([(ROOT, i) for i in ids] + [(b"x", 9), (b"x", 10)], "name binary, conv long").repartition(5)
    got = {bytes(r.name): r.ends_sha256 for r in op.ends_digests(df).collect()}
    assert got == {ROOT: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"x": hashlib.sha256(b"9,10").hexdigest()}
