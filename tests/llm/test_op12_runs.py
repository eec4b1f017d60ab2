"""Periodic runs against brute force over words, and the query's digests against a plain restatement."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from docvet.llm.op12_runs import Extensions, all_runs, kept_words, periodic_runs, runs_of, stretches
from docvet.llm.queries import op12_runs

from .helpers import DOCS, awkward_docs


def brute_runs(w, least, exponent):
    out = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q):
                shorter = (all(w[i + k] == w[i + k + p] for k in range(length - p)) for p in range(1, q))
                if not any(shorter):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a + p, min(n, a + rng.randint(1, 5) * p + rng.randint(0, 5))):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 3), (2, 2), (5, 2), (9, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least * exponent)
    for _ in range(600):
        w = periodic(rng, rng.randint(0, 70), rng.choice([1, 2, 3, 5]))
        want = brute_runs(w, least, exponent)
        assert all_runs(w, least, exponent) == want
        if w:  # the trees alone, without the narrowing to stretches
            assert runs_of([x + 1 for x in w], least, exponent) == want


def test_extensions_equal_comparison():
    rng = random.Random(1)
    w = [rng.randint(1, 2) for _ in range(60)]
    i, j = map(np.array, zip(*((a, b) for a in range(61) for b in range(61) if a != b), strict=True))
    want = [next((k for k in range(61 - max(a, b)) if max(a, b) + k == 60 or w[a + k] != w[b + k]), 0) for a, b in zip(i, j, strict=True)]
    assert Extensions(w)(i, j).tolist() == want


def test_stretches_hold_every_run_and_little_else():
    rng = random.Random(2)
    w = [rng.randrange(500) for _ in range(3000)]
    w[1000:1400] = [w[1000 + k % 50] for k in range(400)]
    w[2000:2200] = w[200:400]  # a passage that occurs twice is no run
    (found,) = stretches(np.array(w), 24, 3)
    assert found[0] <= 1000 and 1400 <= found[1] < 1500
    assert [r for r in all_runs(w) if r[2] == 50 and r[0] <= 1000 and r[0] + r[1] >= 1400]


def test_long_texts_in_linear_time():
    assert all_runs([b"a"] * 150_000) == [(0, 150_000, 1)]
    w = [b"%d" % (k % 30_011) for k in range(150_000)]
    assert all_runs(w) == [(0, 150_000, 30_011)]


def test_kept_words():
    w = list("xyzabababab")
    assert kept_words(w, [(3, 8, 2)]) == list("xyzab")
    assert kept_words(w, []) == w
    assert kept_words(list("aaaabbbb"), [(0, 4, 1), (4, 4, 1)]) == ["a", "b"]


def test_operator_on_awkward_rows(spark):
    rows = awkward_docs() + [(900, "a b " * 30, "en", "s", 1), (900, "a b " * 30, "en", "s", 1), (901, " \n" + "go\x0b" * 24, "en", "s", 1)]
    out = periodic_runs(spark.createDataFrame(rows, DOCS).withColumnsRenamed({"n_chars": "runs", "lang": "collapsed"}))
    got = out.collect()
    assert len(got) == len(rows)
    for key, text in {(r[0], r[1]) for r in rows}:
        words = (text or "").encode().split()
        runs = brute_runs(words, 24, 3) if len(words) < 300 else []
        mine = [r for r in got if r.doc_id == key and r.n_words == len(words)]
        assert mine and all([tuple(x) for x in r.runs] == runs for r in mine)
        assert all(r.collapsed == b" ".join(kept_words(words, runs)).decode() for r in mine)
    assert [tuple(x) for r in got if r.doc_id == 901 for x in r.runs] == [(0, 24, 1)]
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def planted(key, words):
    code = zlib.crc32(str(key).encode())
    if code % 10 or not words:
        return words
    g, n = code // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = planted(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        if len(words) > 1500:
            continue
        runs = brute_runs(words, 24, 3)
        some += bool(runs)
        r = got[d.doc_id]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert some > 10
