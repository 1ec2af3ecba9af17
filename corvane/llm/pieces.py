"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled into states and arcs:

* the normaliser rewrites characters (the longest match in the model's character map,
  which is a trie of UTF-8 bytes) and spaces (to U+2581, with one in front);
* the pieces are a trie of characters: an arc for each character, and at the end of a
  piece its id and weight, after which reading starts anew at the root;
* a character that is no piece has an arc of its own, to its bytes or the unknown id;
* for merge-trained models, an acceptor of neighbours: a pair of pieces that merging
  keeps has weight 0, any other infinite weight.

They are composed with each text as its characters are read; the nodes of the
composition are its places. The path of least weight (tropical semiring: weights add
along a path, the least wins) is the encoding. For unigram models a piece weighs its
negative score. Merge-trained (BPE) models are no sum of piece weights, but are decided
by pairs: a sequence of pieces is what merging gives if and only if merging each two
neighbours gives just these two back. So every piece weighs 1, and the one path
that the acceptor leaves finite equals the library's encoding.
"""

from __future__ import annotations

import re
import weakref
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs beyond the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Stretches that a task remembers in each of two generations, how long they may be, and pairs of pieces that it remembers.
REMEMBERED, LONGEST, PAIRS = 1 << 18, 64, 1 << 19
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Normaliser:
    """The normaliser of a model, from the fields of its specification; user-defined symbols stay as they are."""

    def __init__(self, spec: dict, symbols: re.Pattern | None):
        chars = spec.get(2, b"")
        self.in_front, self.fewer_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if not spec.get(5, 1):
            raise ValueError("models that keep spaces as they are are not supported")
        size = int.from_bytes(chars[:4], "little")
        #: A double-array trie: the node after reading byte b at node p is p ^ offset ^ b, if its label is b.
        self.units = np.frombuffer(chars[4 : 4 + size], dtype="<u4").tolist()
        self.rewritten = chars[4 + size :]
        self.symbols = symbols

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _longest(self, data: bytes, at: int) -> tuple[int, int] | None:
        """End of the longest match from ``at`` on, and where its rewriting starts."""
        place, found = self._offset(self.units[0]), None
        for k in range(at, len(data)):
            place ^= data[k]
            unit = self.units[place] if place < len(self.units) else 0
            if unit & 0x800000FF != data[k]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = k + 1, self.units[place] & 0x7FFFFFFF
        return found

    def _rewrite(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            if hit := self._longest(data, at):
                at, start = hit
                out.append(self.rewritten[start : self.rewritten.index(0, start)])
            else:
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                out.append(data[at:end])
                at = end
        return b"".join(out).decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        if self.units:
            parts = re.split(f"({self.symbols.pattern})", text) if self.symbols else [text]
            text = "".join(part if k % 2 else self._rewrite(part) for k, part in enumerate(parts))
        if self.fewer_spaces:
            text = re.sub(" +", " ", text.lstrip(" "))
        text = (SPACE if self.in_front and text else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.fewer_spaces else text


class PieceTransducer:
    """A compiled model: encode() and decode() of single texts."""

    def __init__(self, model: bytes):
        pieces, trainer, spec = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                fields = dict(_fields(value))
                pieces.append((fields[1].decode(), float(np.frombuffer(fields.get(2, bytes(4)), dtype="<f4")[0]), fields.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
            raise ValueError("only unigram and merge-trained models that put spaces in front of words are supported")
        kinds = {kind for *_, kind in pieces}
        if self.kind == BPE and UNUSED in kinds:
            raise ValueError("unused pieces of merge-trained models are not supported")
        self.text_of = [self._surface(piece, kind, trainer) for piece, _, kind in pieces]
        self.bytes = [-1] * 256
        for number, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = number
        self.by_bytes = bool(trainer.get(35, 0))
        if self.by_bytes and min(self.bytes) < 0:
            raise ValueError("the model lacks pieces for some bytes")
        self.unknown = next((k for k, (*_, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        own = [piece for piece, _, kind in pieces if kind == USER_DEFINED]
        self.symbols = re.compile("|".join(map(re.escape, sorted(own, key=len, reverse=True)))) if own else None
        self.normalise = Normaliser(spec, self.symbols)
        self._compile(pieces)
        self.stretches = self._cutter([piece for piece, _, kind in pieces if kind == NORMAL or kind == USER_DEFINED and self.kind == UNIGRAM])
        self.kept_pairs: dict[int, bool] = {}
        self.encoded = _Stretches(self)

    @staticmethod
    def _surface(piece: str, kind: int, trainer: dict) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return trainer.get(44, " ⁇ ".encode()) if kind == UNKNOWN else b"" if kind == CONTROL else piece.encode()

    def _compile(self, pieces: list[tuple[str, float, int]]) -> None:
        """The trie: ``arcs`` of each state by character, and ``ends``: (id + 1, weight) of the piece that ends there."""
        usual = [score for _, score, kind in pieces if kind == NORMAL]
        best, worst = max(usual, default=0.0), min(usual, default=0.0)
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float] | None] = [None]
        self.scores = {piece: score for piece, score, kind in pieces if kind == NORMAL}
        self.symbol_ids = {piece: k for k, (piece, _, kind) in enumerate(pieces) if kind == USER_DEFINED}
        self.unknown_weight = 1.0 if self.kind == BPE else UNKNOWN_PENALTY - worst
        for number, (piece, score, kind) in enumerate(pieces):
            if kind != NORMAL and not (kind == USER_DEFINED and self.kind == UNIGRAM):
                continue
            state = 0
            for c in piece:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(None)
                state = self.arcs[state][c]
            weight = 1.0 if self.kind == BPE else 0.1 - len(piece.encode()) * best if kind == USER_DEFINED else -score
            self.ends[state] = number + 1, weight
        if self.kind == BPE and any(self.ends[self.arcs[0][c]] is None if c in self.arcs[0] else True for piece in self.scores for c in piece):
            raise ValueError("a piece holds a character that is no piece")
        nothing: dict[str, int] = {}
        self.arcs = [arcs or nothing for arcs in self.arcs]

    def _cutter(self, pieces: list[str]) -> re.Pattern:
        """Stretches between which no piece can lie: the finest of three patterns that no piece contradicts."""
        letter = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
        for pattern in (f"{SPACE}*(?:{letter}+|(?:(?!{letter})[^{SPACE}])+)|{SPACE}+", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"):
            cut = re.compile(pattern)
            # unknown ids side by side become one, which must not depend on the cut
            if self.by_bytes and all(cut.fullmatch(p) for p in pieces):
                return cut
        return re.compile("(?s).+")

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: always the best-scored pair, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [(-self.scores[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.scores]
            if not pairs:
                break
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def keeps(self, pair: int) -> bool:
        """Whether merging keeps two neighbours (their ids + 1, the left one times 2^32; 0: none) apart and whole."""
        if len(self.kept_pairs) >= PAIRS:
            self.kept_pairs.clear()
        left, right = (self.text_of[i - 1].decode() if i else "" for i in divmod(pair, 1 << 32))
        found = self.kept_pairs[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def shortest_path(self, stretch: str) -> list[int]:
        """Piece ids on the path of least weight through one stretch; the earlier start wins among equals."""
        n = len(stretch)
        weight = [0.0] + [INFINITE] * n
        piece, start_of = [0] * (n + 1), [0] * (n + 1)  # the last piece (id + 1; 0: an unknown character) of the best path to each place
        arcs, ends, kept, keeps, paired = self.arcs, self.ends, self.kept_pairs, self.keeps, self.kind == BPE
        for start in range(n):
            here, before = weight[start], piece[start] << 32
            if here == INFINITE:
                continue
            state, single = 0, False
            for end in range(start, n):
                state = arcs[state].get(stretch[end])
                if state is None:
                    break
                if (done := ends[state]) is None:
                    continue
                number, own = done
                single |= end == start
                if here + own < weight[end + 1]:
                    if paired:
                        allowed = kept.get(before | number)
                        if not (keeps(before | number) if allowed is None else allowed):
                            continue
                    weight[end + 1], piece[end + 1], start_of[end + 1] = here + own, number, start
            if not single and here + self.unknown_weight < weight[start + 1]:
                weight[start + 1], piece[start + 1], start_of[start + 1] = here + self.unknown_weight, 0, start
        path: list[int] = []
        end = n
        while end:
            start = start_of[end]
            if piece[end]:
                path.append(piece[end] - 1)
            elif self.by_bytes:
                path.extend(self.bytes[b] for b in reversed(stretch[start:end].encode("utf-8", "surrogatepass")))
            elif not path or path[-1] != self.unknown:
                path.append(self.unknown)
            end = start
        return path[::-1]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers; null and empty texts have none."""
        if not text:
            return b""
        text = self.normalise(text)
        if self.symbols is None or self.kind == UNIGRAM:
            return b"".join(map(self.encoded.__getitem__, self.stretches.findall(text)))
        out = []
        for k, part in enumerate(re.split(f"({self.symbols.pattern})", text)):  # nothing merges with a symbol
            out += [array("i", [self.symbol_ids[part]]).tobytes()] if k % 2 else map(self.encoded.__getitem__, self.stretches.findall(part))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4")

    def decode(self, ids) -> str:
        """Pieces joined; bytes that are no UTF-8 become U+FFFD; the space in front goes, of each piece up to the first other character in models that drop spaces."""
        parts = list(map(self.text_of.__getitem__, ids))
        if self.normalise.in_front or self.normalise.fewer_spaces:
            for k, part in enumerate(parts):
                parts[k] = part.removeprefix(_SPACE_BYTES)
                if parts[k] or part and not self.normalise.fewer_spaces:
                    break
        return b"".join(parts).decode("utf-8", "replace").replace(SPACE, " ")


class _Stretches(dict):
    """stretch -> encoded bytes; of bounded size, in two generations: the older goes when the younger is full."""

    def __init__(self, model: PieceTransducer):
        super().__init__()
        self.path = weakref.proxy(model)  # no cycle, so the model's memory is free as soon as it is
        self.before: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        out = self.before.get(stretch)
        if out is None:
            out = array("i", self.path.shortest_path(stretch)).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[stretch] = out
        return out


@lru_cache(maxsize=2)
def compiled(model: bytes) -> PieceTransducer:
    """Compiled once in each Python worker."""
    return PieceTransducer(model)


def _model_bytes(model_path: str) -> bytes:
    with open(model_path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with an array of piece ids; a column named ``out`` is replaced.

    ``model_path`` is read on the driver; the file travels with the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = PieceTransducer(shared.value)  # compiled for this task alone: the worker goes on to other stages
        for texts in batches:
            yield pd.Series([model.encode(t) for t in texts])
        del model
        give_back()

    return docs.withColumn(out, F.pandas_udf(run, "array<int>")(text_col))


def decode(rows: DataFrame, model_path: str, ids_col: str = "pieces", out: str = "text") -> DataFrame:
    """``rows`` with the text of an array of piece ids; null arrays give empty texts; a column named ``out`` is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = compiled(shared.value)
        for arrays in batches:
            yield pd.Series([model.decode(() if ids is None else ids.tolist()) for ids in arrays], dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, "string")(ids_col))


def op2_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """Columns doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), decoded_crc32, round_trip for every row.

    Each text is encoded and decoded again; round_trip says whether the text came
    back (U+2581 in a text comes back as a space). Null counts as an empty text.
    Texts of any length are encoded whole, stretch by stretch. Paths of equal weight
    (ties, of unigram models only) go to the earlier start. Repeated rows come out as
    often as they went in; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model_bytes(model_path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = compiled(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                raw = model.encode_bytes(text)
                decoded = model.decode(np.frombuffer(raw, dtype="<i4").tolist())
                rows.append((len(raw) // 4, crc32(raw), crc32(decoded.encode("utf-8", "surrogatepass")), decoded == (text or "")))
            yield pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    both = F.pandas_udf(run, "n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
    return docs.select("doc_id", both("text").alias("p")).select("doc_id", "p.*")
