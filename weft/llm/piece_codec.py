"""Encoding and decoding with a merge-type (BPE) SentencePiece model, exactly as the library does.

Encoding is by backtracking instead of merging the whole text. At each position the longest pieces are
tried first (all matches come from an Aho-Corasick automaton). A piece may follow another only if
merging the two pieces' text from characters gives just these two again: a segmentation whose
neighbours are all compatible is the one that merging gives. A position from which no piece leads on is
marked in a bitfield and never tried again, so the work is linear in the text.

No piece has a space after another character, so a text falls into chunks (spaces and what follows)
that encode independently; chunks seen before are looked up. For models where that doesn't hold, the
whole text is one chunk.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import OWN, releasing, table, text_or_empty, without
from weft.runtime import bound_batches

#: Chunks that a worker remembers until its task ends, in each of two generations (when the newer one is full it replaces
#: the older one), and pairs of pieces that it remembers as long as it lives (when full, it starts anew).
CHUNKS, PAIRS = 200_000, 400_000
#: Characters of a chunk that is remembered, characters whose matches are held at a time, the score of what isn't merged.
SHORT, WINDOW, NEVER = 64, 1 << 16, float("-inf")
SPACE = "▁"
#: Piece types of the model format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


class PieceCodec:
    """A model read from its bytes."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != BPE:
            raise ValueError("not a merge-type (BPE) model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only identity normalisation with escaped, kept white space is supported")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.unk = self.kinds.index(UNKNOWN)
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        surface = {NORMAL: lambda p: p.replace(SPACE, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: b"", UNKNOWN: lambda p: " ⁇ ".encode()}
        self.surface = [surface[k](p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.most = max(map(len, self.ids), default=1)
        self.size = list(map(len, self.pieces))
        self.merged = {p: self.scores[i] for p, i in self.ids.items()}
        # the longest piece that a piece begins with, other than itself: the next one to try
        self.shorter = [next((j for k in range(len(p) - 1, 0, -1) if (j := self.ids.get(p[:k])) is not None), -1) for p in self.pieces]
        self.find = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.find.add_word(piece, i)
        self.find.make_automaton()
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        lines = not any("\n" in p for p in self.ids)
        self.split = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if apart and lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else r"(?s:.+)")
        self.pairs: dict[int, bool] = {}
        self.forget()

    def merge(self, text: str) -> list[str]:
        """The segmentation of a short text by merging the best-scored neighbours, the leftmost first."""
        parts = list(text)
        get = self.merged.get
        scores = [get(x + y, NEVER) for x, y in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > NEVER:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether right may follow left (-1: nothing before it)."""
        key = left * len(self.pieces) + right
        found = self.pairs.get(key)
        if found is None:
            own = [self.pieces[i] for i in (left, right) if i >= 0]
            found = self.merge("".join(own)) == own
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _longest(self, text: str, low: int, n: int) -> list[int]:
        """The longest piece that begins at each of n positions from low, -1 where none does."""
        found = [-1] * n
        size = self.size
        if n == len(text):
            for end, piece in self.find.iter(text):
                found[end + 1 - size[piece]] = piece  # of one begin, the longest ends last
            return found
        for end, piece in self.find.iter(text, low, min(len(text), low + n + self.most - 1)):
            begin = end + 1 - size[piece] - low
            if begin < n:
                found[begin] = piece
        return found

    def _chunk(self, text: str) -> bytes:
        """The ids of a text, as encode_bytes() gives them. Matches are held for one window at a time, and found again where a position before it is
        tried anew; beside that a position costs a bit, and a piece that is taken some bytes."""
        n = len(text)
        low, high = 0, min(n, WINDOW)
        longest = self._longest(text, 0, high)
        failed = bytearray(n // 8 + 1)
        size, shorter, pairs, many = self.size, self.shorter, self.pairs, len(self.pieces)
        taken = array("i")  # -1: a character that no piece has, which stands by itself
        at, before, piece, alone = 0, -1, longest[0], longest[0] < 0
        while at < n:
            while piece >= 0:
                end = at + size[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(before * many + piece)
                    if self.compatible(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0 or alone:
                taken.append(piece)
                before = piece
                at = end if piece >= 0 else at + 1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                while (last := taken.pop()) < 0:  # a character by itself has no other way
                    at -= 1
                    failed[at >> 3] |= 1 << (at & 7)
                at -= size[last]
                before = taken[-1] if taken else -1
                piece, alone = shorter[last], False
                continue
            if at < n:
                if not low <= at < high:
                    low = at // WINDOW * WINDOW
                    high = min(n, low + WINDOW)
                    longest = self._longest(text, low, high - low)
                piece = longest[at - low]
                alone = piece < 0
        if min(taken) >= 0:
            return _little(taken)
        out, at = array("I"), 0
        for piece in taken:
            if piece >= 0:
                out.append(piece)
                at += size[piece]
            else:
                out.extend([self.bytes[b] for b in text[at].encode()] if self.bytes else [self.unk])
                at += 1
        return _little(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        parts = []
        held = self.chunks
        for chunk in self.split.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
            found = held.get(chunk)
            if found is None:
                found = self.before.get(chunk) or self._chunk(chunk)
                if len(chunk) <= SHORT:
                    if len(held) >= CHUNKS:
                        self.before, self.chunks = held, {}
                        held = self.chunks
                    held[chunk] = found
            parts.append(found)
        return b"".join(parts)

    def forget(self) -> None:
        """Drop the chunks that are remembered."""
        self.chunks, self.before = {}, {}

    def encode(self, text: str) -> list[int]:
        """All ids, with begin and end."""
        return [self.bos, *np.frombuffer(self.encode_bytes(text), "<u4").tolist(), self.eos]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode gives it."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        if self.prefix:
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE):
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_invalid_byte(raw)


def _little(ids: array) -> bytes:
    """An array of 32-bit numbers as little-endian bytes."""
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _each_invalid_byte(raw: bytes) -> str:
    """Decoded as UTF-8, with one replacement character for each byte that is no part of a code point."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """The codec of a model's bytes, one in a process."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with ids (array<int>, begin and end included; an existing column ids is replaced). Null counts as empty."""
    bound_batches(docs.sparkSession)
    model = read_model(path)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model)
        encoded = lambda texts: (pa.array([own.encode(t.as_py()) for t in batch], pa.list_(pa.int32())) for batch in texts)
        yield from releasing(encoded, own.forget)(batches)

    return without(docs, ["ids"]).withColumn("ids", ids(text_or_empty(column)))


def decode(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """docs with decoded (string), the text of an array of ids; null ids give null."""
    bound_batches(docs.sparkSession)
    model = read_model(path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = codec(model)
        return pa.array([None if i is None else own.decode(i) for i in ids.to_pylist()], pa.string())

    return without(docs, ["decoded"]).withColumn("decoded", text(F.col(column)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs, the text encoded and decoded again.

    A null or empty text is begin and end alone. Repeated rows give repeated rows; an empty table gives an
    empty result; other columns of docs are dropped.
    """
    bound_batches(docs.sparkSession)
    model = read_model(path)

    def digested(texts: pa.Array) -> pa.Array:
        own = codec(model)
        begin, end = (struct.pack("<I", i) for i in (own.bos, own.eos))
        rows = []
        for t in texts:
            data = begin + own.encode_bytes(t.as_py()) + end
            back = own.decode(np.frombuffer(data, "<u4").tolist())
            rows.append((len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from releasing(lambda own: map(digested, own), codec(model).forget)(batches)

    own = f"{OWN}digests"
    return docs.select("doc_id", digests(text_or_empty()).alias(own)).select("doc_id", f"{own}.*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model())
