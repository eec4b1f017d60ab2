"""Personal data: base rules, and a skip-chain conditional random field that carries them further.

Base spans are those of four rules (email, ip, card, phone), leftmost and non-overlapping per kind.
The field adds spans for tokens that the rules miss but that the document itself says are the same
thing: a phone number that the rule loses because another number stands right behind it, or one
written again without its country code.  A number that fails its kind's check (a card's checksum, an
address part over 255) is a feature, and evidence against it.

Nodes are the tokens that can belong to an entity at all (runs without white space that hold a
digit, an `@` or a `+`; every other token is certainly outside and cuts the chain).  Labels are
outside and the four kinds.  Potentials: shape features of a token; the labels of neighbouring
nodes; and, over skip edges, the labels of distant tokens with the same or a similar text (the same
lower-cased text, the same digits, or the same digits but for one).  A token is linked to the next
similar one, and a token outside the base spans also to the first similar one inside them, wherever
that stands: a text repeated n times costs at most 2 n edges, and every repeat is one edge from what
the rules know.  Tokens that a base span covers are observed with its kind; the others get their
marginals from loopy sum-product message passing, run until the messages settle (a field that never
settles stops after ``MOST_ROUNDS`` rounds).  Neighbouring tokens of one kind, each more probable than ``threshold`` and connected to an observed token, become one added span.

Weights are fitted by pseudo-likelihood on a bounded sample, the ``sample_docs`` documents with the
smallest hash of their id, labelled by the base rules.  Scoring covers whole texts in one scan
without a shuffle.

Defined results: a null text is an empty one, without spans; repeated rows each get a row; without
training tokens nothing is added; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import map_rows, smallest_hashes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of digits starts a run of digits or nowhere: what fails there fails later in the run too.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """The email rule, found from its `@`: the longest local part that ends there, after the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the four rules, by start, then kind."""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


#: Only a field whose messages keep swinging comes to this many rounds.
MOST_ROUNDS = 1000

_TOKEN = re.compile(r"\S+")
_ENTITY_SIGN = re.compile(r"[0-9@+]")
_EDGE = " .,;:|\"'!?$#&*%=<>[]{}"
#: Names of the shape features, in the order of a token's feature vector.
SHAPES = ("bias", "at", "dots3", "plus", "paren", "hyphen", "letters", "hex32", "digits1-2", "digits3-4", "digits5-9", "digits10-13", "digits14-19", "digits20+", "only_digits", "short", "bad_checksum", "part_over_255")


def _over(part: str) -> bool:
    part = part.lstrip("0")
    return part.isascii() and part.isdigit() and (len(part) > 3 or int(part) > 255)


def shape(core: str) -> tuple[int, ...]:
    """Indices of the features of a token."""
    number = "".join(c for c in core if "0" <= c <= "9")
    digits = len(number)
    letters = sum(c.isalpha() for c in core)
    size = 8 + sum(digits > n for n in (2, 4, 9, 13, 19)) if digits else -1
    on = [0]
    on += [i for i, yes in ((1, "@" in core), (2, core.count(".") == 3), (3, core[:1] == "+"), (4, "(" in core or ")" in core), (5, "-" in core), (6, letters > 0), (7, letters > 0 and len(core) >= 32), (14, digits == len(core)), (15, len(core) <= 4),
        (16, 14 <= digits <= 19 and not luhn(number)), (17, core.count(".") == 3 and any(_over(p) for p in core.split(".")))) if yes]
    return tuple(sorted(on + [size] * (size >= 0)))


#: Digits, at signs and dots that make a token an entity of its kind by itself.
_WHOLE = (("@", 1), (".", 3), ("", 14), ("", 10))


def is_whole(kind: int, token: str) -> bool:
    """Whether a token is a whole entity of the kind, not a piece that its neighbour goes on with."""
    sign, least = _WHOLE[kind]
    return (token.count(sign) if sign else sum("0" <= c <= "9" for c in token)) >= least


@dataclass
class Graph:
    """One document's field: tokens, their observed kinds (0 outside the rules), chain and skip edges."""

    spans: list[tuple[int, int]]
    shapes: list[tuple[int, ...]]
    observed: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def build_graph(text: str, base: list[Span]) -> Graph:
    spans, shapes, observed, chain, skip = [], [], [], [], []
    last: dict[tuple, int] = {}
    known: dict[tuple, int] = {}  # per key, its first observed token
    keyed: list[list[tuple]] = []
    at, prior_end = 0, -2
    for m in _TOKEN.finditer(text):
        core = m[0].strip(_EDGE) if _ENTITY_SIGN.search(m[0]) else ""
        if not core:
            continue
        start = m.start() + m[0].index(core)
        end = start + len(core)
        while at < len(base) and base[at][2] <= start:
            at += 1
        kind = next((1 + k for k, s, e in base[at : at + 4] if s < end and e > start), 0)
        i = len(spans)
        spans.append((start, end))
        shapes.append(shape(core))
        observed.append(kind)
        if i and text[prior_end : m.start()].isspace() and m.start() - prior_end == 1:
            chain.append((i - 1, i))
        prior_end = m.end()
        digits = "".join(c for c in core if "0" <= c <= "9")
        keys = [("text", core.lower())]
        if len(digits) >= 7:
            keys.append(("digits", digits))
        if 7 <= len(digits) <= 19:
            # one blanked digit: numbers that differ in one place share a key
            keys += [("but", n, digits[:n] + digits[n + 1 :]) for n in range(len(digits))]
        linked = set()
        for key in keys:
            j = last.get(key)
            if j is not None and j not in linked:
                linked.add(j)
                skip.append((j, i))
            last[key] = i
            if kind:
                known.setdefault(key, i)
        keyed.append(keys)
    direct = set(skip)
    for i, keys in enumerate(keyed):
        if not observed[i]:
            for j in {known[key] for key in keys if key in known}:
                edge = (min(i, j), max(i, j))
                if edge not in direct:
                    direct.add(edge)
                    skip.append(edge)
    return Graph(spans, shapes, observed, chain, skip)


@dataclass
class SkipChainCRF:
    """Log-potentials: shape x label, label x label on the chain, and agreement per label on skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = MOST_ROUNDS) -> np.ndarray:
        """Loopy sum-product over the document; observed tokens are fixed."""
        return self.settle(g, rounds)[0]

    def settle(self, g: Graph, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, bool]:
        """The marginals, and whether the messages settled; only edges that can still change are computed again."""
        n, k = len(g.spans), len(self.skip)
        scores = np.array([self.unary[list(s)].sum(0) for s in g.shapes])
        for i, y in enumerate(g.observed):
            if y:
                scores[i] = -50.0
                scores[i, y] = 0.0
        edges = g.chain + g.skip
        settled = not edges
        if edges:
            ends = np.array(edges)
            src, dst = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
            half = len(edges)
            pair = np.exp(np.stack([self.chain, self.chain.T, np.diag(self.skip)]))
            # which of the three potentials an edge has: along the chain, against it, or a skip edge
            kind = np.concatenate([np.repeat([0, 2], [len(g.chain), len(g.skip)]), np.repeat([1, 2], [len(g.chain), len(g.skip)])])
            back = np.concatenate((np.arange(half, 2 * half), np.arange(half)))
            message, total = np.zeros((2 * half, k)), scores.copy()
            active = np.arange(2 * half)
            for _ in range(rounds):
                out = total[src[active]] - message[back[active]]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, pair[kind[active]]) + 1e-30)
                new -= new.max(1, keepdims=True)
                step = 0.5 * (new - message[active])
                message[active] += step
                np.add.at(total, dst[active], step)
                moving = active[np.abs(step).max(1) >= 1e-4]
                if not len(moving):
                    settled = True
                    break
                touched = np.zeros(n, bool)
                touched[dst[moving]] = True
                again = touched[src]
                again[moving] = True
                active = np.flatnonzero(again)
            scores = total
        p = np.exp(scores - scores.max(1, keepdims=True))
        return (p / p.sum(1, keepdims=True)).reshape(n, k), settled

    def added(self, text: str, base: list[Span], threshold: float = 0.5) -> list[Span]:
        """Spans beyond the base ones; none where the messages do not settle."""
        return self.judged(text, base, threshold)[0]

    def judged(self, text: str, base: list[Span], threshold: float = 0.5) -> tuple[list[Span], bool]:
        """Spans beyond the base ones, and whether the field settled; if it did not, no label of it is used."""
        g = build_graph(text, base)
        # only a token tied to another can be told something that its own shape does not say
        if not any(g.observed) or all(g.observed) or not (g.chain or g.skip):
            return [], True
        told = {i for i, y in enumerate(g.observed) if y}
        ties = defaultdict(list)
        for a, b in g.chain + g.skip:
            ties[a].append(b)
            ties[b].append(a)
        reach = list(told)
        while reach:
            fresh = [j for j in ties[reach.pop()] if j not in told]
            told.update(fresh)
            reach += fresh
        if len(told) == sum(map(bool, g.observed)):
            return [], True
        p, settled = self.settle(g)
        if not settled:
            return [], False
        label = np.where(p.max(1) > threshold, p.argmax(1), 0)
        label[[i for i in range(len(label)) if i not in told]] = 0
        joined = set(g.chain)
        out: list[Span] = []
        prior = -1
        for i, y in enumerate(label.tolist()):
            if y and not g.observed[i]:
                pieces = not any(is_whole(y - 1, text[slice(*g.spans[j])]) for j in (prior, i))
                if prior >= 0 and prior == i - 1 and (prior, i) in joined and out[-1][0] == y - 1 and pieces:
                    out[-1] = (y - 1, out[-1][1], g.spans[i][1])
                else:
                    out.append((y - 1, *g.spans[i]))
                prior = i
        return out, True


def _training_rows(text: str) -> list[tuple[list[int], int, int, int, list[int]]]:
    """Per token: shape, label, labels before and after on the chain (-1 none), labels over skip edges."""
    g = build_graph(text, base_spans(text))
    before, after, skips = {}, {}, defaultdict(list)
    for a, b in g.chain:
        before[b], after[a] = g.observed[a], g.observed[b]
    for a, b in g.skip:
        skips[a].append(g.observed[b])
        skips[b].append(g.observed[a])
    return [(list(s), y, before.get(i, -1), after.get(i, -1), skips[i]) for i, (s, y) in enumerate(zip(g.shapes, g.observed, strict=True))]


def fit_crf(rows: list[tuple], steps: int = 200, l2: float = 1e-3) -> SkipChainCRF | None:
    """Pseudo-likelihood: each token's label given its shape and its neighbours' labels."""
    if not rows:
        return None
    k, n = len(KINDS) + 1, len(rows)
    x = np.zeros((n, len(SHAPES)))
    left, right, votes = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    y = np.zeros((n, k))
    for i, (s, label, a, b, skips) in enumerate(rows):
        x[i, s] = 1
        y[i, label] = 1
        if a >= 0:
            left[i, a] = 1
        if b >= 0:
            right[i, b] = 1
        for t in skips:
            votes[i, t] += 1
    u, c, s = np.zeros((len(SHAPES), k)), np.zeros((k, k)), np.zeros(k)
    rate = 1.0
    for _ in range(steps):
        z = x @ u + left @ c + right @ c.T + votes * s
        z = np.exp(z - z.max(1, keepdims=True))
        e = (z / z.sum(1, keepdims=True) - y) / n
        u -= rate * (x.T @ e + l2 * u)
        c -= rate * (left.T @ e + (right.T @ e).T + l2 * c)
        s -= rate * ((votes * e).sum(0) + l2 * s)
    return SkipChainCRF(u, c, np.maximum(s, 0))


def fit_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> SkipChainCRF | None:
    ids = smallest_hashes(docs.select(id_col).filter(F.col(id_col).isNotNull()), id_col, sample_docs).distinct()
    sample = docs.select(id_col, text_col).join(F.broadcast(ids), id_col)
    tokens = "array<struct<s:array<int>,y:int,a:int,b:int,k:array<int>>>"

    def make():
        return lambda key, text: (key, [dict(zip("syabk", r, strict=True)) for r in _training_rows(text or "")])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(sample, [id_col, text_col], f"`{id_col}` {kind}, t {tokens}", make).collect()
    rows = [(list(t["s"]), t["y"], t["a"], t["b"], list(t["k"])) for _, ts in found for t in ts]
    return fit_crf(sorted(rows))


_SPANS = "array<struct<kind:string,start:int,stop:int>>"


def find_pii(docs: DataFrame, model: SkipChainCRF | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, ``base`` and ``added``: spans as (kind, start, stop) in code points, by start, then kind; ``settled``.

    A document whose messages did not settle in ``MOST_ROUNDS`` rounds has its base spans alone, and ``settled`` false.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        crf = sent.value
        name = lambda spans: [{"kind": KINDS[k], "start": a, "stop": b} for k, a, b in spans]

        def one(key, text):
            base = base_spans(text or "")
            added, settled = crf.judged(text, base, threshold) if crf is not None and base else ([], True)
            return key, name(base), name(added), settled

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, base {_SPANS}, added {_SPANS}, settled boolean", make)


def joined_spans(spans):
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("n"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
