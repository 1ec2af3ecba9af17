"""Token-id files by bit-plane shuffling.

A file holds the ids of whole documents one after the other, in blocks of a fixed
number of ids. A block is transposed into planes, by byte or by bit of the 32-bit
ids, and each plane is compressed with zstandard; planes of zeros are left out.
At the end stand the chunk index (offset, ids and plane sizes of each block), the
document index (doc_id and number of ids of each document), and a fixed footer.

Files are written by tasks that each hold a range of doc_id, to names of their own
attempt; only files that a finished task has reported are ever read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import fresh_path, stored

BLOCK = 1 << 16
FOOTER = struct.Struct("<QQ8s")
MAGIC = b"CVPLANE1"
#: Ids, or documents, after which a task goes on in another file; documents that reading gives out at a time.
FILE_IDS, FILE_DOCS, READ_DOCS = 1 << 24, 1 << 19, 1 << 14
#: Words whose ids a task remembers in each of two generations.
REMEMBERED = 1 << 19
#: How the vocabulary writes a space.
SPACE = "Ġ"
#: Characters from here on are not taken for Latin letters.
LATIN_END = "\u0250"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: A byte-level vocabulary writes bytes that are no printable Latin-1 characters as those from U+0100 on, in order.
BYTE_LETTERS = dict(zip([b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)], range(256, 512), strict=False))
#: A space before such a character always begins a new word of a byte-level tokenizer.
_VISIBLE = re.compile(r"[!-~\w]")


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first: 4 by byte or 32 by bit."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int, plane: str) -> np.ndarray:
    """The ids of a block of ``n``; None stands for a plane of zeros."""
    if plane == "byte":
        raw = np.zeros((n, 4), dtype=np.uint8)
        for k, data in enumerate(planes):
            if data is not None:
                raw[:, k] = np.frombuffer(data, dtype=np.uint8)
        return raw.view("<u4").ravel()
    bits = np.zeros((n, 32), dtype=np.uint8)
    for k, data in enumerate(planes):
        if data is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class IdFileWriter:
    """Writes one file to a binary stream."""

    def __init__(self, stream, plane: str = "byte", block: int = BLOCK, level: int = 3):
        if plane not in ("byte", "bit"):
            raise ValueError("plane must be byte or bit")
        self.stream, self.plane, self.block = stream, plane, block
        self.codec = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.waiting = self.offset = self.ids = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document: its ids as little-endian unsigned 32-bit numbers."""
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.ids += len(ids) // 4
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self._write_blocks(self.block)

    def _write_blocks(self, least: int) -> None:
        data = b"".join(self.pending)
        at = 0
        while len(data) - at >= 4 * max(least, 1):
            ids = np.frombuffer(data[at : at + 4 * self.block], dtype="<u4")
            sizes = []
            for raw in to_planes(ids, self.plane):
                packed = self.codec.compress(raw) if any(raw) else b""
                self.stream.write(packed)
                sizes.append(len(packed))
            self.chunks.append([self.offset, len(ids), sizes])
            self.offset += sum(sizes)
            at += 4 * len(ids)
        self.pending, self.waiting = [data[at:]], (len(data) - at) // 4

    def close(self) -> None:
        self._write_blocks(1)
        chunks = self.codec.compress(json.dumps({"plane": self.plane, "chunks": self.chunks}).encode())
        docs = self.codec.compress(json.dumps([self.doc_ids, self.lengths]).encode())
        self.stream.write(chunks + docs + FOOTER.pack(len(chunks), len(docs), MAGIC))


class IdFileReader:
    """Reads a seekable binary stream: documents in order, or any block by its index entry."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, io.SEEK_END)
        stream.seek(end - FOOTER.size)
        n_chunks, n_docs, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        stream.seek(end - FOOTER.size - n_docs - n_chunks)
        codec = zstandard.ZstdDecompressor()
        head = json.loads(codec.decompress(stream.read(n_chunks)))
        self.plane, self.chunks = head["plane"], head["chunks"]
        self.doc_ids, self.lengths = json.loads(codec.decompress(stream.read(n_docs)))
        self.codec = codec

    def chunk(self, k: int) -> np.ndarray:
        offset, n, sizes = self.chunks[k]
        self.stream.seek(offset)
        data, at, planes = self.stream.read(sum(sizes)), 0, []
        for size in sizes:
            planes.append(self.codec.decompress(data[at : at + size]) if size else None)
            at += size
        return from_planes(planes, n, self.plane)

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(doc_id, pieces of its ids): a document's pieces lie in blocks one after the other."""
        k, block, at = 0, np.empty(0, dtype="<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths, strict=True):
            pieces = []
            while n:
                if at == len(block):
                    block, at, k = self.chunk(k), 0, k + 1
                take = min(n, len(block) - at)
                pieces.append(block[at : at + take])
                at, n = at + take, n - take
            yield doc_id, pieces


class _Irregular(Exception):
    """A space that is not followed by a visible character."""


class _WordIds(dict):
    """word -> ids of the word with a space in front, asked for once.

    Of bounded size, in two generations: the older goes when the younger is full.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer, self.model = tokenizer, tokenizer.model.tokenize
        self.line_end = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, word: str, lead: str) -> bytes | None:
        """Ids of Latin letters with punctuation after them, or of punctuation alone: pieces that need no splitting. None for others."""
        core = word.rstrip(PUNCTUATION)
        mark = word[len(core) :]
        if core and not (core.isalpha() and max(core) < LATIN_END) or not word:
            return None
        letters = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model(lead + (letters or mark))]
        if core and mark:
            ids += [t.id for t in self.model(mark)]
        return array("I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        if (own := self.before.get(word)) is None:
            if not _VISIBLE.match(word):
                raise _Irregular
            if (own := self._plain(word, SPACE)) is None:
                first, *rest = word.split("\n")
                parts = [self._plain(first, SPACE), *(self._plain(p, "") for p in rest)] if rest else [None]
                own = self.whole(" " + word) if None in parts else self.line_end.join(parts)
        self[word] = own
        return own


def _splits_at_spaces(tokenizer) -> bool:
    """Whether texts may be split where a space stands before a visible character.

    So it is where nothing normalises, words are cut by the usual byte-level pattern
    without a space put in front, and added tokens take no spaces to themselves and,
    like <|endoftext|>, begin with punctuation and hold a letter: no plain word has them.
    """
    made = json.loads(tokenizer.to_str())
    model, cutter = made["model"], made.get("pre_tokenizer") or {}
    if made.get("normalizer") or made.get("truncation") or made.get("padding") or model["type"] != "BPE":
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")):
        return False
    if cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space", True) or not cutter.get("use_regex", True):
        return False
    return all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and t["content"][0] in PUNCTUATION
        and any(c.isalnum() for c in t["content"]) and not any(c.isspace() for c in t["content"])
        for t in made.get("added_tokens", [])
    )


class WordwiseTokenizer:
    """The tokenizers library, asked once for each word.

    A byte-level tokenizer splits before every space that a visible character
    follows; texts are split there and the words' ids remembered. Plain words, and such
    on both sides of a line end, are pieces for the library's model as they are; other
    words go through the whole tokenizer, and so do whole texts with other spaces.
    With a tokenizer of any other kind, whole texts go through the library.
    """

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.ids = _WordIds(Tokenizer.from_buffer(data))
        self.by_word = _splits_at_spaces(self.ids.tokenizer)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return self.ids.whole(text)
        first, *rest = text.split(" ")
        try:
            return self.ids.whole(first) + b"".join(map(self.ids.__getitem__, rest))
        except _Irregular:
            return self.ids.whole(text)


@lru_cache(maxsize=2)
def tokenizer(data: bytes) -> WordwiseTokenizer:
    """Loaded once in each Python worker."""
    return WordwiseTokenizer(data)


def _open(uri: str, write: bool = False):
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    if write:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        return system.open_output_stream(path)
    return system.open_input_file(path)


def write_id_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, plane: str = "byte", block: int = BLOCK) -> DataFrame:
    """Encode texts and write them in ascending doc_id order (null first); returns the manifest.

    Manifest: path, part and number (their order is the files' order), n_docs, n_ids.
    Documents with equal doc_id are ordered by their text's hash, then by place in the
    input, so that even one doc_id of many rows spreads over tasks. ``folder`` must be
    open to all executors; ``tokenizer_path`` is read on the driver and travels with
    the tasks. doc_id must be an integer of at most 64 bits.
    """
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    order = ["doc_id", "_hash", "_place"]
    # to Python as text: a null beside them would make pandas round large numbers
    ranged = columns.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, end = tokenizer(shared.value), np.array([end_id], dtype="<u4").tobytes()
        part, number, writer, stream, path = TaskContext.get().partitionId(), 0, None, None, ""

        def finished() -> pd.DataFrame:
            writer.close()
            stream.close()
            return pd.DataFrame({"path": [path], "part": [part], "number": [number], "n_docs": [len(writer.lengths)], "n_ids": [writer.ids]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if writer is None:
                    path = f"{folder}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.ids"
                    stream = _open(path, write=True)
                    writer = IdFileWriter(stream, plane, block)
                writer.add(None if doc_id is None else int(doc_id), own.encode(text or "") + end)
                if writer.ids >= FILE_IDS or len(writer.lengths) >= FILE_DOCS:
                    yield finished()
                    number, writer = number + 1, None
        if writer is not None:
            yield finished()

    return stored(ranged.mapInPandas(write, "path string, part int, number int, n_docs long, n_ids long"), "token-manifest")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of every document in the manifest's files."""
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["base"], strict=True):
                with _open(path) as stream:
                    documents = IdFileReader(stream).documents()
                    while rows := list(islice(documents, READ_DOCS)):
                        out = []
                        for _, pieces in rows:
                            crc = n = 0
                            for piece in pieces:
                                crc, n = crc32(piece, crc), n + len(piece)
                            out.append((start, n, crc))
                            start += n
                        found = pd.DataFrame(out, columns=["start", "n_tokens", "ids_crc32"])
                        found.insert(0, "doc_id", pd.array([doc_id for doc_id, _ in rows], dtype="Int64"))
                        yield found

    return files.repartition(min(n, 10_000), "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, plane: str = "byte") -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32 for every row, as read back from the files.

    Null and empty texts consist of the end id alone; a null doc_id sorts first;
    repeated rows are written as often as they went in, and rows with the same doc_id
    (ties) in the order of their texts' hashes. Texts of any length go in whole, over
    as many blocks as they need. An empty table gives no files and no rows; other
    columns are ignored.
    """
    folder = fresh_path(docs.sparkSession, "token-files")
    return read_id_files(write_id_files(docs, tokenizer_path, end_id, folder, plane))
