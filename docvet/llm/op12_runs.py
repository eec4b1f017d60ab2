"""Periodic runs of words: stretches that repeat one root three times or more, and texts without the repeats.

A run is a stretch of words with smallest period ``q`` that is long enough (``min_length`` words and
``min_exponent`` periods) and that no neighbouring word extends with the same period.  All runs of a
text are found in time linear in its words:

* Ukkonen's algorithm builds the suffix tree of the words and that of their reversal.  An Euler tour
  of each tree, kept as the smallest string depth between neighbouring leaves under a sparse table,
  gives the lowest common ancestor of two leaves in constant time: the longest common extension of two
  positions, forward from the one tree and backward from the other.
* Every run holds the longest Lyndon word that begins at some position, under the order of the words
  or under its reverse.  Its end is the next smaller (next greater) suffix in the leaf order, so there
  are at most two candidates a position; each is extended both ways by the two trees.

Trees are built only where a run can be: every ``g`` neighbouring words of a run (``g`` follows from
the two limits) occur again at most a third of the stretch away.  Stretches of such positions are
narrowed until nothing changes; what is left out holds no run, so no result depends on it.

The work is one pass over the rows: nothing is shuffled, and a task holds the words of one text and the
trees of one stretch (some 300 bytes a word) at a time.

Defined results: a null text has no words; a text without runs has an empty list and stays as its words
joined by one space; repeated rows and null ids each get a row; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from docvet.llm.common import map_rows

Run = tuple[int, int, int]


def suffix_tree(text: list[int], sigma: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's suffix tree of ``text``, whose last symbol occurs once; symbols are below ``sigma``.

    Edges as a map of node * sigma + first symbol to the child, the start and end of each node's edge
    label, and the leaves by the suffix they stand for.
    """
    n = len(text)
    go: dict[int, int] = {}
    start, end, link, leaves = [0], [0], [0], []
    node = edge = along = pending = 0
    for i, symbol in enumerate(text):
        pending += 1
        fresh = 0
        while pending:
            if not along:
                edge = i
            key = node * sigma + text[edge]
            child = go.get(key)
            if child is None:
                leaf = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                leaves.append(leaf)
                go[key] = leaf
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = start[child]
                label = min(end[child], i + 1) - first
                if along >= label:
                    node = child
                    edge += label
                    along -= label
                    continue
                if text[first + along] == symbol:
                    along += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(start)
                leaf = middle + 1
                start += (first, i)
                end += (first + along, n)
                link += (0, 0)
                leaves.append(leaf)
                go[key] = middle
                go[middle * sigma + symbol] = leaf
                start[child] = first + along
                go[middle * sigma + text[first + along]] = child
                if fresh:
                    link[fresh] = middle
                fresh = middle
            pending -= 1
            if node:
                node = link[node]
            elif along:
                along -= 1
                edge = i - pending + 1
    return go, start, end, leaves


class Extensions:
    """Longest common extensions of a text's positions, from its suffix tree; ``rank`` orders its suffixes."""

    def __init__(self, words: list[int]):
        """``words`` are numbered from 1; position ``len(words)`` is the empty suffix."""
        text = [*words, 0]
        sigma = max(text) + 1
        go, start, end, leaves = suffix_tree(text, sigma)
        keys = np.fromiter(go.keys(), np.int64, len(go))
        order = np.argsort(keys)
        children = np.fromiter(go.values(), np.int64, len(go))[order]
        parents = keys[order] // sigma
        del go
        size = len(start)
        parent = np.zeros(size, np.int64)
        parent[children] = parents
        # of each node, its children last to first, as a stack wants them
        bounds = np.searchsorted(parents, np.arange(size + 1)).tolist()
        children, up = children.tolist(), parent.tolist()
        depth, low, tour = [0] * size, [], []
        least = 0
        stack = children[bounds[0] : bounds[1]][::-1]
        while stack:
            node = stack.pop()
            above = depth[up[node]]
            if above < least:
                least = above
            depth[node] = above + end[node] - start[node]
            a, b = bounds[node], bounds[node + 1]
            if a < b:
                stack.extend(children[a:b][::-1])
            else:
                tour.append(node)
                low.append(least)
                least = len(text)
        place = np.zeros(size, np.int64)
        place[tour] = np.arange(len(tour))
        self.rank = place[leaves]
        # low[r]: the smallest depth on the tour between the leaves r-1 and r
        self.table = [np.array(low, np.int32)]
        width = 1
        while 2 * width <= len(low):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes from ``i`` and from ``j`` (another position) have in common."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            here = level == k
            row = self.table[k]
            out[here] = np.minimum(row[a[here]], row[b[here] - (1 << int(k))])
        return out


def _next_below(rank: list[int], none: int) -> list[int]:
    """For each position the next one with a smaller rank, or ``none``."""
    out, open_ = [none] * len(rank), []
    for at, value in enumerate(rank):
        while open_ and rank[open_[-1]] > value:
            out[open_.pop()] = at
        open_.append(at)
    return out


def runs_of(words: list[int], min_length: int, min_exponent: int) -> list[Run]:
    """All runs (start, length, period) of ``words``, numbered from 1, by start and period."""
    n = len(words)
    forward, backward = Extensions(words), Extensions(words[::-1])
    found = []
    for rank in (forward.rank, -forward.rank):
        root = np.arange(n)
        period = np.array(_next_below(rank.tolist(), 2 * n + 2)[:n], np.int64) - root
        fits = (period * min_exponent <= n) & (root + period <= n)
        root, period = root[fits], period[fits]
        ahead = forward(root, root + period)
        behind = backward(n - root, n - root - period)
        length = behind + period + ahead
        long = length >= np.maximum(min_length, min_exponent * period)
        found.append(np.stack([root - behind, length, period], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    return sorted(map(tuple, rows.tolist()), key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, min_length: int, min_exponent: int) -> Iterator[tuple[int, int]]:
    """(begin, end) of the stretches that can hold a run; every run lies within one of them.

    Of a run of length L and period q <= L / min_exponent, each window of g words occurs again q words
    before or behind within the run, where g is at most L - 2q + 1.
    """
    gram = max(1, int(min_length - 2 * min_length / min_exponent) + 1)
    factor = np.uint64(0x9E3779B97F4A7C15)
    stack = [(0, len(words))]
    while stack:
        begin, end = stack.pop()
        size = end - begin
        if size < min_length:
            continue
        part = words[begin:end].astype(np.uint64)
        hashed = np.zeros(size - gram + 1, np.uint64)
        for k in range(gram):
            hashed = hashed * factor + part[k : k + len(hashed)]
        order = np.argsort(hashed, kind="stable")
        same = hashed[order[1:]] == hashed[order[:-1]]
        near = same & (order[1:] - order[:-1] <= size // min_exponent)
        again = np.zeros(len(hashed) + 2, bool)
        again[order[1:][near] + 1] = True
        again[order[:-1][near] + 1] = True
        turn = np.flatnonzero(again[1:] != again[:-1])
        pieces = [(begin + a, begin + b + gram - 1) for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
        if pieces == [(begin, end)]:
            yield begin, end
        else:
            stack.extend(pieces)


def all_runs(words: list, min_length: int = 24, min_exponent: int = 3) -> list[Run]:
    """All runs of any list of words."""
    if len(words) < min_length:
        return []
    known: dict = {}
    numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out = []
    for begin, end in stretches(numbers, min_length, min_exponent):
        _, part = np.unique(numbers[begin:end], return_inverse=True)
        out += [(begin + s, length, q) for s, length, q in runs_of((part + 1).tolist(), min_length, min_exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, covered in zip(words, np.cumsum(change).tolist(), strict=False) if not covered]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3
) -> DataFrame:
    """Per input row: the id, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    Words are what spaces and the controls 9 to 13 separate; ``collapsed`` is the words that no run holds
    behind its first period, joined by one space.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("a run is two periods or more, and a word or more")

    def make():
        def one(key, text):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            runs = all_runs(words, min_length, min_exponent)
            kept = b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass")
            return key, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_rows(docs, [id_col, text_col], schema, make)
