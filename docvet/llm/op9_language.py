"""Language identification by nearest centroid over TF-IDF vectors of byte n-grams.

A text is lower-cased and reduced to letters with one blank between words; the n-grams of 1 to 3
bytes of its UTF-8 form are hashed to ``2**bits`` features.  Each is weighted (1 + log tf) * idf, the
vector has length one.  Per language, spherical k-means makes ``clusters`` centroids; a text gets
the language of its nearest centroid by cosine, and the cosine is its score.  A text further from
every centroid than ``reject_below`` (a cosine, learned as a low quantile of the training rows' own
scores, less 0.01) is marked ``rejected``; one without a letter is `und`.

Fitted on a bounded sample: per language, the ``rows_per_language`` labelled rows with the smallest
hash of their id.  Scoring covers whole texts of all rows in one scan without a shuffle; long
texts are counted in pieces of fixed size, so memory does not follow the text.

Defined results: null, empty and letterless texts are `und` with score 0; a null language is never
learned; without training rows every text is `und`; equal scores go to the language that sorts
first; repeated rows each get a row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docvet.llm.common import hash_below, map_rows, materialise

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 16


def gram_counts(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the byte 1- to 3-grams of the whole text."""
    total = np.zeros(1 << bits, np.int64)
    tail = b" "
    for at in range(0, max(len(text), 1), _PIECE):
        piece = _NOT_LETTERS.sub(" ", text[at : at + _PIECE].lower()).encode("utf-8", "surrogatepass")
        if at + _PIECE >= len(text):
            piece += b" "
        raw = np.frombuffer(tail + piece, np.uint8).astype(np.uint32)
        new = len(raw) - len(tail)
        codes = [raw[-new:] | (1 << 24)] if new else []
        if len(raw) > 1:
            pair = raw[:-1] << 8 | raw[1:]
            codes.append(pair[-new:] | (2 << 24))
            if len(raw) > 2:
                codes.append((pair[:-1] << 8 | raw[2:])[-new:])
        for c in codes:
            total += np.bincount((c * np.uint32(2654435761)) >> np.uint32(32 - bits), minlength=1 << bits)
        tail = (tail + piece)[-2:]
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class CentroidModel:
    bits: int = 14
    idf: np.ndarray | None = None
    languages: list[str] = field(default_factory=list)  # of each centroid
    centroids: np.ndarray | None = None
    reject_below: float = 0.0

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine of the nearest centroid, whether it is too far."""
        if not text or not _LETTER.search(text):
            return "und", 0.0, True
        if not self.languages:
            return "und", 0.0, True
        at, n = gram_counts(text, self.bits)
        x = (1 + np.log(n)) * self.idf[at]
        norm = np.sqrt(x @ x)
        if not norm:
            return self.languages[0], 0.0, True
        near = self.centroids[at].T @ (x / norm)
        best = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[best])))
        return self.languages[best], score, score < self.reject_below


def fit_centroids(rows: list[tuple[str, list[int], list[int]]], bits: int, clusters: int = 4, rounds: int = 10, quantile: float = 0.001) -> CentroidModel:
    """(language, features, counts) rows -> centroids."""
    if not rows:
        return CentroidModel(bits)
    df = np.zeros(1 << bits)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    names, parts, scores = [], [], []
    for lang in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == lang]
        x = np.zeros((len(mine), 1 << bits), np.float32)
        for i, (_, at, n) in enumerate(mine):
            x[i, at] = (1 + np.log(n)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        k = min(clusters, len(mine))
        # start: the mean's nearest row, then always the row furthest from the starts
        first = int(np.argmax(x @ x.mean(0)))
        starts, near = [first], x @ x[first]
        while len(starts) < k:
            starts.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[starts[-1]])
        c = x[starts].copy()
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            for j in range(k):
                if (own == j).any():
                    c[j] = x[own == j].mean(0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        scores.append((x @ c.T).max(1))
        names += [lang] * k
        parts.append(c)
    return CentroidModel(bits, idf, names, np.ascontiguousarray(np.concatenate(parts).T, np.float64), float(np.quantile(np.concatenate(scores), quantile)) - 0.01)


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = 500, bits: int = 14, clusters: int = 4) -> CentroidModel:
    """Fit on at most ``rows_per_language`` labelled rows of each language in ``docs``."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # about twice the rows wanted, by the share of each language's hashes, before any are gathered
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    counts = F.broadcast(counts) if counts.count() <= 100_000 else counts
    near = known.join(counts, "lang").filter(hash_below("id", 2 * rows_per_language / F.col("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = near.withColumn("rank", rank).filter(F.col("rank") <= rows_per_language).select("id").distinct()
    ids = materialise(ids, "languages")
    # the bound is per language: the ids of very many languages are joined, not broadcast
    ids = F.broadcast(ids) if ids.count() <= 100_000 else ids
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(ids, "id", "left_semi").filter("lang is not null")

    def make():
        def one(key, lang, text):
            if not text or not _LETTER.search(text):
                return key, lang, None, None
            at, n = gram_counts(text, bits)
            return key, lang, at.tolist(), n.tolist()

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_rows(sample, ["id", "lang", "text"], f"id {kind}, lang string, at array<int>, n array<long>", make).collect()
    rows = sorted((r[1], r[0], r[2], r[3]) for r in found if r[2] is not None)
    return fit_centroids([(lang, at, n) for lang, _, at, n in rows], bits, clusters)


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (cosine), ``rejected``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = sent.value.predict
        return lambda key, text: (key, *predict(text))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean", make)
