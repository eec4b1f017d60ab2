import itertools
import random
import re

import numpy as np

from docvet.llm.op2_pii import KINDS, SHAPES, Graph, SkipChainCRF, base_spans, build_graph, find_pii, fit_crf, fit_pii, is_whole, joined_spans, luhn
from docvet.llm.op2_pii import _training_rows
from tests.llm.helpers import DOCS, awkward_docs

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_rules_match_the_patterns():
    rng = random.Random(2)
    for alphabet in ("a.@-+1 0295()_%é\n8٣", "0123456789 -", "ab.@", "+1 (0)5-"):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert base_spans(text) == brute(text), text


def test_long_runs_stay_linear():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "+" * 100_000, "1." * 100_000, "0" * 6000 + ".1.1.1"):
        base_spans(text)
    assert base_spans("0" * 6000 + "1.1.1.1")[0][0] == 1
    known = "call +1 (204) 555-1004 "
    for text in ("a" * 200_000, "1" * 200_000, "x1 " * 5000, "555-1004 " * 3000):
        build_graph(known + text, base_spans(known + text))


TRAIN = [f"word call +1 ({a}) 555-{b} now or 10.0.{a % 200}.7 x{a}@mail.example.com then {b}" for a, b in zip(range(200, 400), range(1000, 1200), strict=True)]


def model():
    return fit_crf(sorted(r for t in TRAIN for r in _training_rows(t)))


def test_the_field_adds_what_the_document_repeats():
    crf = model()
    text = "ring +1 (204) 555-1004 today. Later she wrote (204) 555-1004 again, and (999) 555-4321."
    base = base_spans(text)
    assert [(KINDS[k], text[a:b]) for k, a, b in base] == [("phone", "+1 (204) 555-1004")]
    assert [(KINDS[k], text[a:b]) for k, a, b in crf.added(text, base)] == [("phone", "(204) 555-1004")]
    # nothing observed, nothing added
    assert crf.added("(204) 555-1004 twice (204) 555-1004", []) == []


def test_every_repeat_is_labelled_like_the_first():
    import numpy as np

    # shapes speak for outside, links for one label: only what the rules know can tell
    crf = SkipChainCRF(np.zeros((len(SHAPES), 5)), np.zeros((5, 5)), np.array([0.5, 3.0, 3.0, 3.0, 3.0]))
    crf.unary[0, 0] = 2.0
    for n in (1, 50, 400):
        for text in ("ring +1204555-1004." + " then 1204555-1004 again," * n, "first 1204555-1004 again," * n + " ring +1204555-1004."):
            base = base_spans(text)
            assert [(KINDS[k], text[a:b]) for k, a, b in base] == [("phone", "+1204555-1004")]
            assert [(KINDS[k], text[a:b]) for k, a, b in crf.added(text, base)] == [("phone", "1204555-1004")] * n


def test_links_stay_few():
    text = "call +1 (204) 555-1004 " + "555-1004 " * 3000
    g = build_graph(text, base_spans(text))
    assert len(set(g.skip)) == len(g.skip) <= 2 * len(g.spans) and all(a < b for a, b in g.skip)


def test_message_passing_is_exact_on_a_chain():
    import itertools

    import numpy as np

    crf = model()
    text = "see 10.0.0.7 +1 (204) 555-1004 12"
    g = build_graph(text, [])
    g.skip.clear()
    weights = {}
    for labels in itertools.product(range(5), repeat=len(g.spans)):
        score = sum(crf.unary[list(s), y].sum() for s, y in zip(g.shapes, labels, strict=True))
        weights[labels] = np.exp(score + sum(crf.chain[labels[a], labels[b]] for a, b in g.chain))
    total = sum(weights.values())
    want = np.array([[sum(w for l, w in weights.items() if l[i] == y) / total for y in range(5)] for i in range(len(g.spans))])
    assert np.allclose(crf.marginals(g, 200), want, atol=1e-3)


def test_frame(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in awkward_docs() + [(99, TRAIN[3], "en", "s", 1)]], DOCS + ", base string")
    crf = fit_pii(docs)
    assert isinstance(crf, SkipChainCRF)
    found = {r[0]: r[1] for r in find_pii(docs, crf).select("doc_id", joined_spans("base")).collect()}
    assert found[99] == ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in brute(TRAIN[3])) != ""
    assert find_pii(docs, None).count() == docs.count()
    empty = spark.createDataFrame([], DOCS)
    assert fit_pii(empty) is None and find_pii(empty, None).count() == 0


def _field():
    """Agreement on skip edges, a little pull along the chain, and no say for shapes."""
    k = 5
    return SkipChainCRF(np.zeros((len(SHAPES), k)), 0.1 * np.eye(k), np.full(k, 3.0))


def test_two_whole_entities_stay_two_spans():
    a, b = "4111 1111 1111 1111".replace(" ", ""), "5500000000000004"
    text = f"card {a} and {b} again:\n{a[:-1]}9 {b[:-1]}9 end"
    base = base_spans(text)
    assert [s[0] for s in base] == [2, 2]
    added = _field().added(text, base)
    found = [text[s:e] for _, s, e in added]
    assert found == [f"{a[:-1]}9", f"{b[:-1]}9"]
    assert is_whole(2, a) and not is_whole(2, a[:8]) and is_whole(0, "a@b") and is_whole(1, "1.2.3.4") and not is_whole(3, "+1555")


def test_messages_settle_to_the_exact_marginals_of_a_tree():
    """Without loops the settled messages are exact: enumeration over all labellings."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        crf = SkipChainCRF(rng.normal(size=(len(SHAPES), 3)), rng.normal(size=(3, 3)), np.abs(rng.normal(size=3)))
        g = Graph([(i, i + 1) for i in range(5)], [(0, int(rng.integers(1, 8))) for _ in range(5)], [0, 1, 0, 0, 0], [(0, 1), (2, 3)], [(0, 3), (1, 4)])
        p, settled = crf.settle(g)
        assert settled
        want = np.zeros((5, 3))
        for labels in itertools.product(range(3), repeat=5):
            if labels[1] == 1:
                score = sum(crf.unary[list(s), y].sum() for i, (s, y) in enumerate(zip(g.shapes, labels, strict=True)) if i != 1)
                score += sum(crf.chain[labels[a], labels[b]] for a, b in g.chain) + sum(crf.skip[labels[a]] for a, b in g.skip if labels[a] == labels[b])
                for i, y in enumerate(labels):
                    want[i, y] += np.exp(score)
        assert np.allclose(p, want / want.sum(1, keepdims=True), atol=2e-3)


def test_a_field_that_does_not_settle_labels_nothing(monkeypatch):
    text = "card 4111111111111111 and later 4111111111111112 end"
    base = base_spans(text)
    assert _field().judged(text, base)[0] and _field().judged(text, base)[1]
    monkeypatch.setattr(SkipChainCRF.settle, "__defaults__", (1,))
    assert _field().judged(text, base) == ([], False)
