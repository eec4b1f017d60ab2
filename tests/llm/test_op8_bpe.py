import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docvet.llm import op8_bpe
from docvet.llm.op8_bpe import Decoder, Encoder, Merges, PieceStream, encode_decode, token_digests
from docvet.llm.queries import bpe_path
from tests.llm.helpers import DOCS, awkward_docs


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_path())


@pytest.fixture(scope="module")
def merges():
    return Merges(bpe_path())


PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "'", "'ll", "'re", "!", "é", "ß", "中", "😀", "0", "12", "<|endoftext|>", "<|endof", "<", "\t", " ", "\x1c", "\x85", "́", "aaaa", "    ", "\r\n", "²", "…"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_matches_the_library(library, merges, monkeypatch, chunk):
    monkeypatch.setattr(op8_bpe, "_CHUNK", chunk)
    rng = random.Random(chunk)
    encoder, decoder = Encoder(merges, cache_pieces=50), Decoder(merges)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == want, text
        assert decoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_pieces_stream_in_constant_memory(library, merges):
    for text in ("a" * 20_000, "thereingtion" * 1500, " " * 9000 + "x", "中" * 4000, "!?" * 5000):
        for piece in (text,):
            stream, out, most = PieceStream(merges), [], 0
            data = piece.encode()
            for at in range(0, len(data), 100):
                out += stream.feed(data[at : at + 100])
                most = max(most, stream.pending())
            out += stream.finish()
            assert most <= merges.lookahead() and most < 12 * merges.longest
            if " " not in piece:
                assert out == library.encode(piece, add_special_tokens=False).ids
        assert Encoder(merges).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def merged(pairs, text):
    """Tokens of a text by the definition: the earliest merge of the list first, its leftmost pair first."""
    parts = list(text)
    while True:
        here = [(pairs.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        if not here:
            return parts
        _, i = min(here)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def tiny_vocabulary(rng, path):
    """Random merges over three letters of which every one encodes to itself."""
    tokens, pairs = ["a", "b", "c"], []
    for _ in range(rng.randint(1, 60)):
        pair = rng.choice(tokens), rng.choice(tokens)
        made = "".join(pair)
        if made not in tokens and len(made) <= 9 and len(merged([*pairs, pair], made)) == 1:
            tokens.append(made)
            pairs.append(pair)
    path.write_text(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": [list(p) for p in pairs]}}))
    return tokens, pairs


def test_transducer_equals_the_merge_rules_within_its_lookahead(tmp_path):
    rng = random.Random(8)
    for n in range(150):
        tokens, pairs = tiny_vocabulary(rng, tmp_path / f"{n}.json")
        merges = Merges(str(tmp_path / f"{n}.json"))
        stream = PieceStream(merges)
        for _ in range(6):
            unit = "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
            text = rng.choice([unit * rng.randint(1, 60), "".join(rng.choice("abc") for _ in range(rng.randint(1, 150)))])
            out, at = [], 0
            while at < len(text):
                step = rng.randint(1, 20)
                out += stream.feed(text[at : at + step].encode())
                at += step
                # a chunk is looked at when more than four longest tokens are pending
                assert stream.pending() <= max(merges.lookahead(), 4 * merges.longest) + 2 * merges.longest
            assert [tokens[i] for i in out + stream.finish()] == merged(pairs, text), (pairs, text)


def test_what_the_lookahead_proves_stable_is_emitted_without_a_common_prefix(merges, library, monkeypatch):
    text = "thereingtion" * 400
    want = library.encode(text, add_special_tokens=False).ids
    stream = PieceStream(merges)
    monkeypatch.setattr(merges, "_lookahead", 6 * merges.longest)
    monkeypatch.setattr(PieceStream, "_shared", lambda self: 0)  # prefixes that never meet
    out, most = [], 0
    for at in range(0, len(text), 50):
        out += stream.feed(text[at : at + 50].encode())
        most = max(most, stream.pending())
    assert out + stream.finish() == want and most <= 8 * merges.longest


def test_decoder_waits_for_whole_characters(merges, library):
    ids = library.encode("😀é中", add_special_tokens=False).ids
    decoder = Decoder(merges)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "😀é中"
    for broken in (ids[:1], ids[1:], ids[:1] + ids[:1]):
        assert decoder.decode(broken) == library.decode(broken, skip_special_tokens=False)


def test_frame(spark, library):
    rows = [(*r, "x", 1) for r in awkward_docs()]
    frame = spark.createDataFrame(rows, DOCS + ", decoded string, ids int")
    got = encode_decode(frame, bpe_path())
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]
    for r in got.collect():
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    import hashlib

    d = token_digests(got, "text").filter(F.col("text") == "one two").first()
    ids = library.encode("one two", add_special_tokens=False).ids
    assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert d.decoded_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert encode_decode(spark.createDataFrame([], DOCS), bpe_path()).count() == 0
