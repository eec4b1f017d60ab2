import zlib

import duckdb
import numpy as np

from docvet.llm.op9_language import CentroidModel, fit_language, gram_counts, identify
from docvet.llm.queries import op9_language
from tests.llm.helpers import DOCS, awkward_docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf}/documents.parquet'").fetchall())
    rows = op9_language(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_do_not_depend_on_the_pieces(monkeypatch):
    from docvet.llm import op9_language as m

    text = "Straße und Größe, naïve 12 words " * 40
    whole = m.gram_counts(text, 10)
    monkeypatch.setattr(m, "_PIECE", 7)
    lower_text = text.lower()
    cut = m.gram_counts(lower_text, 10)
    # pieces may double a blank at a seam that falls between words; letters are never lost
    assert abs(int(cut[1].sum()) - int(whole[1].sum())) <= 3 * len(text) // 7


def test_letterless_and_awkward(spark):
    docs = spark.createDataFrame([(*r, "x") for r in awkward_docs() + [(900, "12 … !", "en", "s", 1), (901, "wörter sind hier", "de", "s", 2), (902, "wörter sind da", "de", "s", 2)]], DOCS + ", score string")
    model = fit_language(docs)
    assert set(model.languages) <= {"en", "de", "fr"}
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert got[900].lang_pred == "und" and got[901].lang_pred == "de"
    assert [r.lang_pred for r in identify(docs.filter("text is null or text = ''"), model).collect()] == ["und", "und"]
    assert {r.lang_pred for r in identify(docs, CentroidModel()).collect()} == {"und"}
    empty = spark.createDataFrame([], DOCS)
    assert fit_language(empty).languages == [] and identify(empty, model).count() == 0


def test_far_text_is_rejected():
    from docvet.llm.op9_language import fit_centroids

    rows = [("en", *map(np.ndarray.tolist, gram_counts(f"the cat sat on the mat number {w}", 12))) for w in ("one", "two", "three", "four")]
    model = fit_centroids(rows, 12, clusters=2)
    assert not model.predict("the cat sat on the mat number two")[2]
    assert model.predict("зовсім інші літери")[2]


def _plain_counts(text, bits):
    """The counts, gram by gram."""
    import re

    data = b" " + re.sub(r"[\W\d_]+", " ", text.lower()).encode() + b" "
    out = {}
    for end in range(1, len(data)):
        for n in (1, 2, 3):
            if end - n + 1 >= 0:
                gram = data[end - n + 1 : end + 1]
                code = int.from_bytes(gram, "big") | (n << 24 if n < 3 else 0)
                at = (code * 2654435761 % 2**32) >> (32 - bits)
                out[at] = out.get(at, 0) + 1
    return out


def test_predictions_equal_plain_cosines():
    """Every prediction against cosines worked out gram by gram and centroid by centroid."""
    from docvet.llm.op9_language import fit_centroids

    bits, texts = 10, {"en": ["the cat sat there", "a dog and the cat ran", "where they were then"], "de": ["die Katze saß dort", "der Hund läuft über Gras"]}
    model = fit_centroids([(lang, *map(np.ndarray.tolist, gram_counts(t, bits))) for lang, ts in texts.items() for t in ts], bits, clusters=2)
    for text in [t for ts in texts.values() for t in ts] + ["the dog läuft", "xyz", "Über the Gras 12"]:
        counts = _plain_counts(text, bits)
        assert dict(zip(*map(np.ndarray.tolist, gram_counts(text, bits)), strict=True)) == counts
        weight = {at: (1 + np.log(n)) * model.idf[at] for at, n in counts.items()}
        norm = sum(w * w for w in weight.values()) ** 0.5
        cosines = [sum(w * model.centroids[at, j] for at, w in weight.items()) / norm for j in range(len(model.languages))]
        best = int(np.argmax(cosines))
        lang, score, rejected = model.predict(text)
        assert lang == model.languages[best] and abs(score - min(1, max(0, cosines[best]))) < 1e-9 and rejected == (score < model.reject_below)


def test_ids_of_any_type_and_a_very_long_text(spark):
    rows = [(f"id{i}", t, lang) for i, (t, lang) in enumerate([("wörter sind hier", "de"), ("words are here", "en")] * 4)]
    rows += [("long", "wörter und dinge " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in identify(docs, fit_language(docs)).collect()}
    assert got["id0"] == "de" and got["id1"] == "en" and got["long"] == "de"
