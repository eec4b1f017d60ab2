import math
import random

import duckdb
import pytest

from docvet.llm.op10_toxicity import OrdinalModel, choose_features, distinct_words, fit_ordinal, fit_toxicity, remove_toxic, toxicity
from tests.llm.helpers import DOCS, awkward_docs, sentence

LABELS = "doc_id long, quality int, toxic int"


def test_labelled_rows_it_was_not_fitted_on(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs.filter("doc_id % 2 = 0"), labels)
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet' WHERE doc_id % 2 = 1").fetchall())
    got = {r.doc_id: r for r in toxicity(docs.filter("doc_id % 2 = 1"), model).collect() if r.doc_id in truth}
    # labels overlap in this table: a fifth of the clean German and French rows hold the same word
    # starts as the toxic ones, and some rows labelled toxic hold nothing telling at all
    caught = sum(got[i].toxic for i, t in truth.items() if t)
    assert caught >= 0.85 * sum(truth.values())
    assert sum(got[i].toxic for i, t in truth.items() if not t) <= 0.02 * len(truth)


def test_grades_are_ordered_and_share_weights():
    rng = random.Random(1)
    rows = []
    for i in range(400):
        words = distinct_words(sentence(rng, 30))
        if i % 4 == 0:
            words |= {f"vile{j}" for j in rng.sample("abcdefghi", rng.randint(1, 6))}
        rows.append((words, int(i % 4 == 0)))
    model = fit_ordinal(rows)
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    score = model.scorer(cache_words=3)
    mild, strong = score("beta vilea gamma"), score("beta vilea vileb vilec viled vilee vilef")
    clean = score("beta gamma")
    assert (mild[0] > clean[0]) and (strong >= mild).all() and (strong[:-1] >= strong[1:]).all()
    assert clean[0] < 0.5 < strong[0]


def labelled(rng, n=240):
    """(text, toxic, how many of the words are vile) rows; a vile row also has words of its own."""
    rows = []
    for i in range(n):
        vile = rng.sample("abcdefghi", rng.randint(1, 6)) if i % 4 == 0 else []
        rows.append((" ".join([sentence(rng, 20), *(f"vile{j}" for j in vile)]), int(bool(vile)), len(vile)))
    return rows


def test_chosen_features_are_those_of_a_plain_count():
    rows = [(distinct_words(t), y) for t, y, _ in labelled(random.Random(5))]
    present = [({f"={w}" for w in ws} | {f"^{w[:n]}" for w in ws for n in range(3, 7) if len(w) >= n}, y) for ws, y in rows]
    toxic = [fs for fs, y in present if y]
    clean = [fs for fs, y in present if not y]
    seen = {f: (sum(f in x for x in toxic), sum(f in x for x in clean)) for f in set().union(*(fs for fs, _ in present))}
    chosen, telling = choose_features(seen, len(toxic), len(clean))
    want = [f for f, (a, b) in seen.items() if a >= 3 and a * len(clean) > b * len(toxic)]
    assert chosen == sorted(want) and len(chosen) == len(set(chosen))
    assert {f for f in chosen if f.startswith("=vile")} <= telling and not any(f[1:] in sentence(random.Random(1), 99) for f in telling if f[0] == "=")


def test_fit_on_frames_equals_the_plain_fit_whatever_the_ids(spark):
    rows = labelled(random.Random(6))
    plain = fit_ordinal([(distinct_words(t), y) for t, y, _ in rows])
    for name, kind in ((lambda i: f"doc {i:04d}", "string"), (lambda i: i, "long"), (lambda i: i, "int")):
        docs = spark.createDataFrame([(name(i), t) for i, (t, _, _) in enumerate(rows)], f"key {kind}, text string")
        labels = spark.createDataFrame([(name(i), y) for i, (_, y, _) in enumerate(rows)], f"key {kind}, toxic int")
        # a third of all rows repeat one id: it counts once
        hot = docs.unionAll(spark.range(120).crossJoin(docs.limit(1)).select("key", "text")) if kind == "string" else docs
        model = fit_toxicity(hot, labels, id_col="key", rows_per_class=1000)
        assert model.thresholds == [pytest.approx(t) for t in plain.thresholds]
        assert model.weights == {f: pytest.approx(w) for f, w in plain.weights.items()}
        got = toxicity(docs, model, id_col="key")
        assert got.schema["key"].dataType.simpleString() == {"string": "string", "long": "bigint", "int": "int"}[kind]
        assert got.filter("toxic").count() >= 55


def test_scores_equal_the_definition_and_follow_planted_severity():
    train, held = labelled(random.Random(7), 400), labelled(random.Random(8), 400)
    model = fit_ordinal([(distinct_words(t), y) for t, y, _ in train])
    score = model.scorer()
    by_depth: dict[int, list[float]] = {}
    for text, _, depth in held:
        words = set(text.split())
        value = sum(w for f, w in model.weights.items() if any(f == f"={x}" or (f[0] == "^" and 3 <= len(f) - 1 <= 6 and x.startswith(f[1:])) for x in words))
        want = [1 / (1 + math.exp(t - value)) for t in model.thresholds]
        assert score(text).tolist() == [pytest.approx(x) for x in want]
        by_depth.setdefault(depth, []).append(sum(want))
    means = [sum(by_depth[d]) / len(by_depth[d]) for d in sorted(by_depth)]
    assert means == sorted(means) and means[0] < 0.5 < means[-1]


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in awkward_docs()], DOCS + ", toxic string")
    none = fit_toxicity(docs, spark.createDataFrame([], LABELS))
    one_class = fit_toxicity(docs, spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 1, 1)], LABELS))
    assert none == one_class == OrdinalModel()
    got = toxicity(docs, none).collect()
    assert len(got) == docs.count() and not any(r.toxic or r.severity for r in got)
    model = fit_toxicity(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(8)], LABELS))
    assert toxicity(docs, model).count() == docs.count()
    assert remove_toxic(docs, none).collect() == docs.collect()
    empty = spark.createDataFrame([], DOCS)
    assert toxicity(empty, model).count() == 0 and remove_toxic(empty, model).count() == 0
