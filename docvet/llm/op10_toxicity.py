"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are binary: the distinct words of a text and the first 3 to 6 letters of each; all are
kept that a thirtieth of the toxic rows hold (3 rows at least) and that are more frequent there than
in clean rows.  Weights are not negative, so a text without such features scores lowest, however short it is.  One weight
vector w is shared by all ordered thresholds t1 < t2 < ...: P(grade >= k) = sigmoid(w.x - tk), and
the expected severity is the sum of these probabilities over k.

Grades: labels are toxic or not, so grade 0 is a row labelled not toxic, and the rows labelled toxic
are graded 1 to ``grades`` by how many of their distinct words carry a feature that stands out in
toxic rows (equal-count cuts over those rows).  Severity thus means how much of a text is telling, as
labels have two values; the words that make it up are chosen by the labels alone.  A text is rejected when P(grade >= 1) reaches
``reject_at``.

The model is fitted on a bounded sample of labelled rows: per class, the ``rows_per_class`` rows
with the smallest hash of their id (of any type; rows that repeat an id count once, with the text that
sorts first).  Scoring covers whole texts of all rows in one scan, without a shuffle; only the weights
above zero are sent to the tasks.

Defined results: a null or wordless text has the scores of a text without features; labels that
are null are ignored; with one class only, or none, no text is rejected and scores are 0; repeated
rows each get a row; empty tables give no rows; other columns are ignored or pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import map_rows, materialise, smallest_hashes

_WORD = re.compile(r"[^\W\d_]+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:n]}" for n in range(3, 7) if len(word) >= n)]


@dataclass
class OrdinalModel:
    """Shared weights by feature and ordered thresholds; without thresholds every score is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def scorer(self, cache_words: int = 100_000):
        """text -> P(grade >= k) for each k."""
        cached: dict[str, tuple[str, ...]] = {}
        weights, cuts = self.weights, np.array(self.thresholds)

        def score(text: str | None) -> np.ndarray:
            hits: set[str] = set()
            for w in distinct_words(text):
                known = cached.get(w)
                if known is None:
                    if len(cached) >= cache_words:
                        cached.clear()
                    known = cached[w] = tuple(f for f in word_features(w) if f in weights)
                if known:
                    hits.update(known)
            value = sum(sorted(weights[f] for f in hits))
            return 1 / (1 + np.exp(np.clip(cuts - value, -60, 60)))

        return score


def _support(n_toxic: int) -> int:
    return max(3, n_toxic // 30)


def choose_features(seen: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> tuple[list[str], set[str]]:
    """From (toxic rows, clean rows) with each feature: the chosen ones, and those rarely seen in clean rows."""
    chosen = sorted(f for f, (a, b) in seen.items() if a >= _support(n_toxic) and a / n_toxic > b / n_clean)
    return chosen, {f for f in chosen if seen[f][0] / n_toxic > 20 * (seen[f][1] + 0.5) / n_clean}


def fit_weights(
    chosen: list[str], rows: list[tuple[list[int], int, bool]], grades: int = 3, toxic_share: float = 0.3, steps: int = 400, l2: float = 1e-4
) -> OrdinalModel:
    """Fit on (chosen features present, words with a telling feature, toxic) rows.

    Toxic rows carry ``toxic_share`` of the loss, however many they are.
    """
    toxic = np.array([t for _, _, t in rows], bool)
    depth = np.array([d for _, d, _ in rows])
    cuts = [c for c in sorted({float(np.quantile(depth[toxic], k / grades)) for k in range(1, grades)}) if (depth[toxic] > c).any()]
    grade = np.where(toxic, 1 + sum((depth > c).astype(int) for c in cuts) if cuts else 1, 0)
    top = int(grade.max())
    row_of = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    col_of = np.array([i for f, _, _ in rows for i in f], np.int64)
    weight = np.where(toxic, toxic_share / toxic.sum(), (1 - toxic_share) / (~toxic).sum())
    w, t = np.zeros(len(chosen)), np.linspace(0.0, 1.0, top)
    m, v = np.zeros(len(w) + top), np.zeros(len(w) + top)
    above = (grade[:, None] >= np.arange(1, top + 1)).astype(float)
    for step in range(1, steps + 1):
        value = np.bincount(row_of, w[col_of], minlength=len(rows))
        miss = (1 / (1 + np.exp(np.clip(t - value[:, None], -60, 60))) - above) * weight[:, None]
        by_row = miss.sum(1)
        g = np.concatenate((np.bincount(col_of, by_row[row_of], minlength=len(w)) + l2 * w, -miss.sum(0)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, t = np.maximum(w - change[: len(w)], 0), np.maximum.accumulate(t - change[len(w) :])
    return OrdinalModel({f: float(x) for f, x in zip(chosen, w, strict=True) if x > 0}, t.tolist())


def fit_ordinal(rows: list[tuple[set[str], int]], **options) -> OrdinalModel:
    """Fit on a small list of (distinct words, toxic 0/1) rows, without Spark."""
    n_toxic = sum(bool(y) for _, y in rows)
    if not 0 < n_toxic < len(rows):
        return OrdinalModel()
    present = [{f for w in words for f in word_features(w)} for words, _ in rows]
    seen: dict[str, tuple[int, int]] = {}
    for here, (_, y) in zip(present, rows, strict=True):
        for f in here:
            a, b = seen.get(f, (0, 0))
            seen[f] = (a + bool(y), b + (not y))
    chosen, telling = choose_features(seen, n_toxic, len(rows) - n_toxic)
    index = {f: i for i, f in enumerate(chosen)}
    return fit_weights(
        chosen,
        [
            (sorted(index[f] for f in here if f in index), sum(not telling.isdisjoint(word_features(w)) for w in words), bool(y))
            for here, (words, y) in zip(present, rows, strict=True)
        ],
        **options,
    )


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = 3000, **options
) -> OrdinalModel:
    """Fit on at most ``rows_per_class`` labelled rows of either class.

    Features are counted on the executors: first in the toxic rows, which leaves fewer than 30 times
    a text's mean number of features, then these in all rows; the driver gets counts and, per
    row, the indices of chosen features.
    """
    known = labels.select(id_col, F.col("toxic").cast("int").alias("toxic")).filter(f"toxic IN (0, 1) AND `{id_col}` IS NOT NULL")
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    ids = smallest_hashes(known.filter("toxic = 0"), id_col, rows_per_class).union(
        smallest_hashes(known.filter("toxic = 1"), id_col, rows_per_class)
    )
    # at most 2 * rows_per_class ids are broadcast; rows that repeat one combine before they move, words are cut out on the executors
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.withColumnRenamed(id_col, "id")), "id")
    sample = sample.groupBy("id", "toxic").agg(F.min("text").alias("text"))
    kind = sample.schema["id"].dataType.simpleString()
    cut = lambda: lambda key, text, toxic: (key, sorted(distinct_words(text)), toxic)
    sample = materialise(map_rows(sample, ["id", "text", "toxic"], f"id {kind}, words array<string>, toxic int", cut), "labelled")
    rows, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < rows:
        return OrdinalModel()
    of_word = lambda w: F.concat(
        F.array(F.concat(F.lit("="), w)), F.transform(F.filter(F.array(*map(F.lit, range(3, 7))), lambda n: F.length(w) >= n), lambda n: F.concat(F.lit("^"), F.substring(w, F.lit(1), n)))
    )
    features = F.array_distinct(F.flatten(F.transform("words", of_word)))
    common = sample.filter("toxic = 1").select(F.explode(features).alias("f")).groupBy("f").count().filter(F.col("count") >= _support(n_toxic))
    sent = docs.sparkSession.sparkContext.broadcast(sorted(r.f for r in common.collect()))

    def make_present():
        index = {f: i for i, f in enumerate(sent.value)}

        def one(words, toxic):
            return sorted({index[f] for w in words for f in word_features(w) if f in index}), toxic

        return one

    present = map_rows(sample, ["words", "toxic"], "at array<int>, toxic int", make_present)
    counts = present.select(F.explode("at").alias("at"), "toxic").groupBy("at").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()
    chosen, telling = choose_features({sent.value[i]: (a, b) for i, a, b in counts}, n_toxic, rows - n_toxic)

    def make_rows():
        index = {f: i for i, f in enumerate(chosen)}

        def one(key, words, toxic):
            here = [word_features(w) for w in words]
            return key, sorted({index[f] for fs in here for f in fs if f in index}), sum(not telling.isdisjoint(fs) for fs in here), toxic

        return one

    found = map_rows(sample, ["id", "words", "toxic"], f"id {kind}, at array<int>, depth int, toxic int", make_rows).collect()
    return fit_weights(chosen, [(list(at), depth, bool(t)) for _, at, depth, t in sorted(tuple(r) for r in found)], **options)


def toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """Per row: id, ``p_toxic``, ``severity`` (expected grade), ``grade`` (most grades reached), ``toxic``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer()

        def one(key, text):
            p = score(text)
            first = float(p[0]) if len(p) else 0.0
            return key, first, float(p.sum()), int((p >= reject_at).sum()), first >= reject_at

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, p_toxic double, severity double, grade int, toxic boolean", make)


def remove_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model rejects, in one scan; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        score = sent.value.scorer()
        for batch in batches:
            tops = (score(x.as_py())[:1] for x in batch.column(at))
            yield batch.filter(pa.array([not (len(p) and p[0] >= reject_at) for p in tops], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
