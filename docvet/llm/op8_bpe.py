"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding.  Text flows through three small machines, each holding a bounded buffer:

* the added tokens of the vocabulary file (such as an end-of-text marker) are cut out literally;
* the pre-tokeniser splits the rest by the byte-level pattern; a piece is passed on once no further
  character can change it, and an overlong piece is passed on while it still grows;
* the transducer turns a piece's bytes into tokens.  For every prefix of the piece it knows the
  last token of that prefix's encoding: among the tokens that end there, the one that is compatible
  with the last token of the prefix it would follow (a sequence is the encoding of its text exactly
  if every two neighbours encode to themselves).  No token is longer than ``longest`` bytes, so the
  final encoding runs through one of the last ``longest`` prefixes; the tokens that the encodings
  of all of these share are stable and are emitted.  ``lookahead`` is the bound, computed from the
  merge list, on how many bytes can be pending: the longest chain of merges of falling rank, each
  of which can take away or supply a symbol of the one before, times the longest token.  Where the
  prefixes have not met by then, the tokens before the bound are emitted all the same, so a piece
  of any length takes the memory of the lookahead and two longest tokens.

Pieces of every length go through the transducer.  Short ones repeat, so the encodings of those no
longer than the longest token are kept in a cache of bounded size (two generations of ``cache_pieces``,
some 150 bytes each).

Decoding feeds each token's bytes to a UTF-8 state machine that returns text as soon as its bytes
are complete.

Nothing is trained here; the vocabulary file's path is a parameter.

Defined results: a null text is an empty one, with no tokens; repeated rows each get a row; an empty
table gives no rows; ids unknown to the vocabulary are an error in decoding; other columns are
ignored or pass through.  Every token that a merge makes must encode to itself, as in any list that was
learned by merging.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokeniser's pattern.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same on texts of ASCII characters alone, which Python's own engine cuts twice as fast.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
#: What continues an overlong piece, by its kind.
_RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
_SPACES = 3
#: Characters after a piece that can still change where it ends (a contraction has three).
_HOLD = 3
_CHUNK = 1 << 16


def pieces_of(text: str) -> list[str]:
    return (_ASCII if text.isascii() else PATTERN).findall(text)


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary file's tokens as bytes, its merges, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in to_byte for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = [(self.ids[as_bytes(a)], self.ids[as_bytes(b)], self.ids[as_bytes(a + b)]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(self.pairs)}
        self.made = {c: r for r, (_, _, c) in enumerate(self.pairs)}
        self.texts = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        # tokens that merges can make: these, and the single bytes, end an encoding
        self.reach = {b: i for b, i in self.ids.items() if i in self.made or len(b) == 1}
        self.longest = max(map(len, self.reach))
        #: finds the tokens that end at each byte, longest first
        self.automaton = ahocorasick.Automaton()
        for b, i in self.reach.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self._lookahead = self._longest_chain() * self.longest
        self.fitting: dict[tuple[int, int], bool] = {}  # pairs of neighbours tried so far

    def lookahead(self) -> int:
        """Bytes of right context that can decide about a token, from the merge list alone."""
        return self._lookahead

    def _longest_chain(self) -> int:
        chain: dict[int, int] = {}  # of the merge that makes a token
        taking_left: dict[int, int] = {}  # longest chain of an earlier merge whose left symbol is this
        taking_right: dict[int, int] = {}
        for a, b, c in self.pairs:
            n = 1 + max(taking_left.get(b, 0), taking_right.get(a, 0), chain.get(a, 0), chain.get(b, 0))
            chain[c] = n
            taking_left[a] = max(taking_left.get(a, 0), n)
            taking_right[b] = max(taking_right.get(b, 0), n)
        return max(chain.values(), default=1)

    def fits(self, a: int, b: int) -> bool:
        """Whether token b after token a is an encoding of their joint text.

        Undoes the latest merge on either side of the border, step by step: the tokens fit if no
        two symbols that once met there would have merged before one of them was used up.  Of equal
        merges the left one comes first, so a tie counts against the right symbol only.
        """
        known = self.fitting.get((a, b))
        if known is None:
            if len(self.fitting) > 500_000:
                self.fitting.clear()
            known = self.fitting[a, b] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        rank, made = self.rank, self.made
        used_a = used_b = len(self.pairs)  # the merges that use up the two symbols at the border
        while True:
            r = rank.get((a, b))
            if r is not None and r < used_a and r <= used_b:
                return False
            made_a, made_b = made.get(a, -1), made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                used_a, a = made_a, self.pairs[made_a][1]
            else:
                used_b, b = made_b, self.pairs[made_b][0]


class PieceStream:
    """Bytes of one piece in, stable tokens out; at most the lookahead and two longest tokens are pending."""

    def __init__(self, merges: Merges):
        self.m, self.search = merges, merges.automaton.iter("")
        self._begin()

    def _begin(self) -> None:
        self.search.set("", True)
        self.last, self.start = [-1], [0]  # by length of the pending prefix: its last token, and where that starts
        self.before = -1  # the token emitted last
        self.cut = 0  # bytes of the piece that are emitted

    def pending(self) -> int:
        return len(self.last) - 1

    def feed(self, data: bytes) -> list[int]:
        longest = self.m.longest
        out: list[int] = []
        for at in range(0, len(data), longest):
            self._extend(data[at : at + longest])
            if len(self.last) > 4 * longest:
                out += self._stable()
        return out

    def _extend(self, data: bytes) -> None:
        known, fits, last, start, before = self.m.fitting.get, self.m.fits, self.last, self.start, self.before
        n, size = len(last), len(last) + len(data)
        self.search.set(data.decode("latin-1"))
        due = n - 1 + self.cut  # the byte whose prefix comes next
        for end, (token, length) in self.search:  # the tokens that end here, longest first
            if end != due:
                continue
            at = n - length
            if at > 0:
                prior = last[at]
            elif at < 0:  # begins in what is emitted
                continue
            else:
                prior = before
            if prior >= 0:
                good = known((prior, token))
                if not good and (good is not None or not fits(prior, token)):
                    continue
            last.append(token)
            start.append(at)
            n += 1
            due += 1
        if n != size:
            raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end = self.start[end]
        return out[::-1]

    def _shared(self) -> int:
        """The furthest prefix that the encodings of all of the last ``longest`` prefixes pass through."""
        n = len(self.last) - 1
        ends = set(range(n - self.m.longest + 1, n + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.discard(top)
            ends.add(self.start[top])
        return ends.pop()

    def _stable(self) -> list[int]:
        n, cut = len(self.last) - 1, self._shared()
        if n - cut > self.m.lookahead():  # what the merge list proves stable need not wait for this to show
            cut = n
            while n - cut < self.m.lookahead():
                cut = self.start[cut]
        out = self._path(cut)
        if out:
            self.before = out[-1]
            self.cut += cut
            self.last = [-1, *self.last[cut + 1 :]]
            self.start = [0, *(s - cut for s in self.start[cut + 1 :])]
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self.last) - 1)
        self._begin()
        return out


def _pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Pieces(dict):
    """Packed encodings of short pieces, by text.  When full, it starts anew and takes over what is asked for again."""

    def __init__(self, merges: Merges, most: int):
        self.m, self.stream, self.most, self.old = merges, PieceStream(merges), most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            data = piece.encode("utf-8", "surrogatepass")
            out = _pack(self.stream.feed(data) + self.stream.finish())
            if len(data) > self.m.longest:
                return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out


class Encoder:
    """Text in, in chunks of any size; tokens out as they become stable, as packed 32-bit numbers."""

    def __init__(self, merges: Merges, cache_pieces: int = 400_000):
        self.m, self.pieces = merges, _Pieces(merges, cache_pieces)
        self.long = PieceStream(merges)
        self.marks = sorted(merges.added, key=len, reverse=True)
        self.held = self.buffer = ""
        self.run = -1

    def feed(self, chunk: str) -> bytes:
        if not self.marks or not (self.held or any(x[0] in chunk for x in self.marks)):
            return self._feed(chunk)
        text, out = self.held + chunk, b""
        while True:
            at, mark = min(((text.find(x), -len(x), x) for x in self.marks if x in text), default=(-1, 0, ""))[::2]
            if at < 0:
                break
            out += self._feed(text[:at]) + self._end() + _pack([self.m.added[mark]])
            text = text[at + len(mark) :]
        hold = max((n for x in self.marks for n in range(1, len(x)) if text.endswith(x[:n])), default=0)
        self.held = text[len(text) - hold :]
        return out + self._feed(text[: len(text) - hold])

    def finish(self) -> bytes:
        held, self.held = self.held, ""
        return self._feed(held) + self._end()

    def encode(self, text: str) -> np.ndarray:
        parts = [self.feed(text[at : at + _CHUNK]) for at in range(0, len(text), _CHUNK)]
        return np.frombuffer(b"".join([*parts, self.finish()]), np.int32)

    def _feed(self, chunk: str) -> bytes:
        text, out = self.buffer + chunk, b""
        if self.run >= 0:
            text, out = self._continue(text)
        words = pieces_of(text) if self.run < 0 else []
        size, rest = len(text), 0
        while words and rest <= _HOLD:
            rest += len(words.pop())
        if self.run >= 0:
            rest = size
        out += b"".join(map(self.pieces.__getitem__, words))
        text = text[size - rest :]
        if self.run < 0 and rest > _CHUNK:  # one piece that still grows
            piece = PATTERN.match(text)
            body = piece[0]
            kind = next(k for k, x in enumerate(_RUNS) if x.match(body[-1]))
            end = piece.end() - (kind == _SPACES)
            if piece.end() == len(text):
                out += _pack(self.long.feed(text[:end].encode("utf-8", "surrogatepass")))
                text, self.run = text[end:], kind
        self.buffer = text
        return out

    def _continue(self, text: str) -> tuple[str, bytes]:
        """Pass on what continues the overlong piece; the rest of the text."""
        more = _RUNS[self.run].match(text)
        end = more.end() if more else 0
        ended = end < len(text)
        if self.run == _SPACES:  # the last blank before a word is the word's
            end = max(0, end - 1)
        out = self.long.feed(text[:end].encode("utf-8", "surrogatepass"))
        if ended:
            out += self.long.finish()
            self.run = -1
        return text[end:], _pack(out)

    def _end(self) -> bytes:
        out = b""
        if self.run >= 0:
            more = _RUNS[self.run].match(self.buffer)
            end = more.end() if more else 0
            out = _pack(self.long.feed(self.buffer[:end].encode("utf-8", "surrogatepass")) + self.long.finish())
            self.buffer, self.run = self.buffer[end:], -1
        out += b"".join(map(self.pieces.__getitem__, pieces_of(self.buffer)))
        self.buffer = ""
        return out


class Decoder:
    """Tokens in, text out as soon as its bytes are complete; broken bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.texts = [merges.texts.get(i) for i in range(max(merges.texts) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.texts.__getitem__, ids)))

    def finish(self) -> str:
        out = self.machine.decode(b"", final=True)
        self.machine.reset()
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        parts = [self.feed(ids[at : at + _CHUNK]) for at in range(0, len(ids), _CHUNK)]
        return "".join(parts) + self.finish()


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Encoder, Decoder]:
    """A worker's encoder and decoder, kept from task to task with the encoder's cache of pieces."""
    merges = Merges(path)
    return Encoder(merges), Decoder(merges)


_ADDED = pa.schema([pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())])


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", columns: list[str] | None = None, batch_rows: int = 128) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given), with ``ids`` (the tokens) and ``decoded`` (their text).

    ``path`` must be readable on the executors, as an installed package's file is.
    """
    from pyspark.sql.types import StructType

    columns = [c for c in (docs.columns if columns is None else columns) if c not in _ADDED.names]
    kept = docs.select(*columns)
    schema = StructType([*kept.schema.fields, *StructType.fromDDL("ids array<int>, decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                ids = [encoder.encode(x.as_py() or "") for x in part.column(part.num_columns - 1)]
                decoded = pa.array([decoder.decode(x) for x in ids], pa.string())
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = np.concatenate([np.empty(0, np.int32), *ids])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                arrays = [*part.columns[:-1], tokens, decoded]
                yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *_ADDED.names])

    return docs.select(*columns, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def token_digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""
    return encoded.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
