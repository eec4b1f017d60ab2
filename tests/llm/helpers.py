"""Small tables that hold the awkward cases, and brute-force versions of what the operators do."""

from __future__ import annotations

import random

import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward_docs(seed: int = 5) -> list[tuple]:
    """Near and exact copies, nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(seed)
    rows, at = [], 0
    base = [sentence(rng, rng.randint(30, 90)) for _ in range(12)]
    for text in base:
        for _ in range(rng.randint(1, 3)):
            words = text.split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = "changed"
            rows.append((at, " ".join(words), "en", f"s{at % 3}", None))
            at += 1
    long = sentence(rng, 9000)
    rows += [
        (at, None, "de", "s0", 3),
        (at + 1, "", None, "s1", 0),
        (at + 2, long, "en", None, len(long)),
        (at + 3, long.upper(), "en", None, len(long)),
        (at + 4, " \t\n\v ", "fr", "s2", 5),
        (None, base[0], "en", "s1", 1),
        (at + 5, "one", "en", "s1", 3),
        (at + 5, "one", "en", "s1", 3),
        (at + 6, "one two", "en", "s1", 7),
        (at + 7, "Ünï cödé text 😀 \x1c end", "en", "s1", 7),
    ]
    return rows


def brute_fingerprint(text: str | None) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints: list[int], most: int) -> list[int]:
    """Index of the first member of each one's component."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]
