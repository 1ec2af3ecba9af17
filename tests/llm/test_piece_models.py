"""The transducer against the sentencepiece library, on models written by hand: no tokenizer is trained."""

import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pieces

TEXTS = st.text(alphabet="abcAé b▁中<sep>x  ", max_size=30)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _characters(changes: dict[str, str]) -> bytes:
    """A character map (double-array trie) for keys of one ASCII letter."""
    units, texts = [0] * 1024, b""
    units[0] = 256 << 10  # children of the root stand from 256 on
    for k, (key, value) in enumerate(changes.items()):
        at, leaf = 256 ^ ord(key), 512 + k
        units[at] = (at ^ leaf) << 10 | 256 | ord(key)
        units[leaf] = 1 << 31 | len(texts)
        texts += value.encode() + b"\0"
    trie = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(trie)) + trie + texts


def _model(kind: int, by_bytes: bool, changes=None, in_front=True, fewer_spaces=False, symbols=("<sep>",)) -> bytes:
    scored = {"a": -3.0, "b": -3.5, "c": -4.25, "▁": -2.5, "ab": -3.125, "▁a": -3.75, "bc": -5.5, "abc": -6.0, "é": -5.0, "▁ab": -4.5, "aa": -6.625, "e": -6.5, "s": -6.25, "▁▁": -7.0}
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((s, 0.0, 4) for s in symbols)]
    if by_bytes:
        rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    rows += [(piece, -k - 1.0 if kind == pieces.BPE else score, 1) for k, (piece, score) in enumerate(sorted(scored.items(), key=lambda x: (-len(x[0]), x[0]) if kind == pieces.BPE else x[0]))]
    data = b"".join(_field(1, _field(1, piece.encode()) + _field(2, score) + _field(3, k)) for piece, score, k in rows)
    data += _field(2, _field(3, kind) + _field(35, int(by_bytes)))
    return data + _field(3, (_field(2, _characters(changes)) if changes else b"") + _field(3, int(in_front)) + _field(4, int(fewer_spaces)) + _field(5, 1))


MODELS = [
    _model(pieces.UNIGRAM, True), _model(pieces.UNIGRAM, False), _model(pieces.UNIGRAM, True, {"A": "a", "x": "bc"}, fewer_spaces=True), _model(pieces.UNIGRAM, False, {"A": " a"}, in_front=False),
    _model(pieces.BPE, True), _model(pieces.BPE, True, {"A": "ab"}, fewer_spaces=True, symbols=("<sep>", "bb")), _model(pieces.BPE, False, symbols=()), _model(pieces.UNIGRAM, True, fewer_spaces=True, symbols=()),
]


@pytest.mark.parametrize("number", range(len(MODELS)))
@given(text=TEXTS)
@settings(max_examples=150, deadline=None)
def test_hand_written_models_equal_the_library(number, text):
    own = pieces.compiled(MODELS[number])
    library = sentencepiece.SentencePieceProcessor(model_proto=MODELS[number])
    ids = own.encode(text).tolist()
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)


def test_what_is_refused():
    with pytest.raises(ValueError):
        pieces.PieceTransducer(_model(4, True))
    with pytest.raises(ValueError):
        pieces.PieceTransducer(_field(1, _field(1, b"a")) + _field(3, _field(5, 0)))


def test_a_column_of_the_same_name_is_replaced(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some text", "old"), (2, None, None)], "doc_id long, text string, pieces string")
    rows = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert rows[0].pieces and all(isinstance(i, int) for i in rows[0].pieces) and not rows[1].pieces
