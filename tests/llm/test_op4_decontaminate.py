import random
import re
import tracemalloc

import pytest

from docvet.llm.op4_decontaminate import WindowSet, benchmark_hits, contamination, remove_contaminated, window_set_bytes, words_of
from tests.llm.helpers import DOCS, awkward_docs, sentence

BENCH = "item_id long, text string"


def brute_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for row in docs:
        words, hit, ids = brute_words(row[1]), set(), set()
        for item, text in items:
            w = brute_words(text)
            n = min(13, len(w))
            grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1) if n else ():
                if tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
        out.append((str(row[0]), len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def tables():
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(8, 40))) for i in range(12)]
    items += [(20, None), (21, "…!"), (22, "One, two!"), (10, items[3][1]), (None, sentence(rng, 15)), (23, items[0][1].upper())]
    docs = awkward_docs()
    for i in range(20):
        text = items[i % 12][1].split()
        a = rng.randrange(len(text))
        docs.append((500 + i, sentence(rng, 20) + " " + " ".join(text[a : a + 20]) + ". " + sentence(rng, rng.randint(0, 400)), "en", "s", 1))
    docs.append((600, " ".join(t or "" for _, t in items) * 2, "en", "s", 1))
    return docs, items


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_both_paths_match_brute_force(spark, bound):
    docs, items = tables()
    frame = spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", row string")
    bench = spark.createDataFrame([(*i, 1) for i in items], BENCH + ", n_words int")
    got = contamination(benchmark_hits(frame, bench, broadcast_bytes=bound)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got) == brute(docs, items)
    kept = remove_contaminated(frame, bench, broadcast_bytes=bound)
    assert kept.columns == frame.columns
    bad = {r[0] for r in brute(docs, items) if r[4]}
    assert bad and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if str(d[0]) not in bad)


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_rows_are_judged_each_for_itself(spark, bound):
    docs, items = tables()
    dirty = next(t for _, t in items if t and len(t.split()) >= 13)
    docs = [(None, dirty, "en", "s", 1), (None, "clean words", "en", "s", 1), (7, dirty, "en", "s", 1), (7, "clean words", "en", "s", 1)]
    kept = remove_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH), broadcast_bytes=bound).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("7", "clean words"), ("None", "clean words")]


def test_reckoned_size_covers_the_window_set(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(2000)]
    tracemalloc.start()
    known = WindowSet(items, 13)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    text = sum(len(t) for _, t in items)
    assert known.windows and 4 * text < taken <= window_set_bytes(spark.createDataFrame(items, BENCH))
    assert window_set_bytes(spark.createDataFrame([], BENCH)) == 0


@pytest.mark.parametrize("bound", [1 << 20, -1])
def test_empty_tables(spark, bound):
    docs, bench = spark.createDataFrame(awkward_docs(), DOCS), spark.createDataFrame([], BENCH)
    assert contamination(benchmark_hits(docs, bench, broadcast_bytes=bound)).filter("contaminated").count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert benchmark_hits(empty, spark.createDataFrame(tables()[1], BENCH), broadcast_bytes=bound).count() == 0


def test_words():
    assert words_of("Ab-c9_Éx y") == [b"ab", b"c9", "Éx y".encode()]
