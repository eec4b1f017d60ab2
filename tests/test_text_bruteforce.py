"""Brute force: the Unicode text helpers against Python's own string methods."""

import random

from pyspark.sql import functions as F

from docvet.functions.text import WS_CHARS, collapse_ws, collapse_ws_head, utrim


def _samples(n=3000, seed=7):
    rng = random.Random(seed)
    letters = "abcXYZé中😀-/."
    alphabet = letters + WS_CHARS
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 5, 40, 300, 1500, 2600])
        s = "".join(rng.choice(alphabet if rng.random() < 0.7 else WS_CHARS) for _ in range(k))
        out.append((i, s))
    return out


def test_helpers_match_python(spark):
    rows = _samples()
    df = spark.createDataFrame(rows, "i INT, s STRING")
    got = {
        r["i"]: (r["t"], r["c"], r["h"])
        for r in df.select("i", utrim("s").alias("t"), collapse_ws("s").alias("c"), collapse_ws_head("s", 200).alias("h")).collect()
    }
    for i, s in rows:
        t, c, h = got[i]
        assert t == s.strip(), i
        assert c == " ".join(s.split()), i
        assert h == " ".join(s.split())[:200], i


def test_whitespace_set_is_pythons():
    assert set(WS_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_endpoint_and_stated_counts_match_python_re(spark):
    import re

    from docvet.functions import fixed
    from docvet.functions.scoring import endpoint_count, stated_count

    rng = random.Random(11)
    tokens = ["GET", "get", "Post", "DELETE", "options", "FORGET", "é", "中", "x", "_", "/", "/v1/items", "12", "7", "12345",
              "endpoints", "Routes", "API methods", "operations", "apimethods", "."] + list(WS_CHARS)
    rows = [(i, "".join(rng.choice(tokens) for _ in range(rng.randint(0, 60)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "i INT, s STRING")
    got = {r["i"]: (r["e"], r["c"]) for r in df.select("i", endpoint_count("s").alias("e"), stated_count("s").alias("c")).collect()}
    ep = re.compile(fixed.ENDPOINT_PATTERN, re.IGNORECASE)
    st = re.compile(fixed.STATED_COUNT_PATTERN, re.IGNORECASE)
    for i, s in rows:
        m = st.search(s)
        assert got[i] == (len(ep.findall(s)), int(m.group(1)) if m else 0), (i, s)


def _py_classify(v, pack):
    from docvet.functions.rules import ALLOWED, KEEP

    if v is None:
        if pack.null_label is not None:
            return pack.null_label
        if pack.null_text is None:
            return "Unknown" if pack.fallback == ALLOWED else (None if pack.fallback == KEEP else pack.fallback)
        v = pack.null_text
    t = v.strip()
    low = t.lower()
    for r in pack.rules:
        ok = True
        if r.any_of:
            ok = ok and any(n in low for n in r.any_of)
        if r.all_of:
            ok = ok and all(n in low for n in r.all_of)
        if r.equals:
            ok = ok and low in r.equals
        if ok:
            return t if r.label == KEEP else r.label
    if pack.fallback == ALLOWED:
        return t if t in pack.allowed else "Unknown"
    return t if pack.fallback == KEEP else pack.fallback


def test_rule_packs_match_python_evaluation(spark):
    from docvet.functions import rules as RU

    packs = {**{f"n_{k}": p for k, p in RU.NORMALISERS.items()}, **{f"s_{k}": p for k, p in RU.SANITISERS.items()}, "auth_fix": RU.FIX_AUTH}
    words = sorted({w for p in packs.values() for r in p.rules for w in (*r.any_of, *r.all_of, *r.equals)} | {a for p in packs.values() for a in p.allowed})
    rng = random.Random(5)
    noise = ["é", "中", "x", "-", ",", " "] + list(WS_CHARS[:8])

    def make():
        parts = []
        for _ in range(rng.randint(0, 4)):
            w = rng.choice(words + noise)
            w = w.upper() if rng.random() < 0.3 else (w.title() if rng.random() < 0.3 else w)
            parts.append(w)
        return None if rng.random() < 0.05 else "".join(parts)

    rows = [(i, make()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i INT, s STRING")
    from docvet.functions.rules import classify

    out = df.select("i", *[classify("s", p).alias(k) for k, p in packs.items()]).collect()
    got = {r["i"]: r for r in out}
    for i, s in rows:
        for k, p in packs.items():
            assert got[i][k] == _py_classify(s, p), (k, s)
