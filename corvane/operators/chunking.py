"""Chunking: one document to many rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import heading_level, is_noise, sentences, token_estimate

SEPARATORS = ("\n\n", "\n", "。", "；", " ", "")


def fixed_windows(text: Column | str, size: int, overlap: int) -> Column:
    """Array of (index, start, text): windows of ``size`` characters that overlap; the last may be shorter."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    step = size - overlap
    last = F.greatest(F.ceil((F.length(c) - overlap) / F.lit(step)), F.lit(1).cast("long")) - 1
    windows = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.substring(c, (i * step + 1).cast("int"), F.lit(size)).alias("text")))
    return F.filter(windows, lambda w: F.length(F.trim(w["text"])) > 0)


def fixed_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text") -> DataFrame:
    """One row for each window: chunk_index, chunk_start, chunk_text."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.explode(fixed_windows(text, size, overlap)).alias("w")).select(*others, F.col("w.index").alias("chunk_index"), F.col("w.start").alias("chunk_start"), F.col("w.text").alias("chunk_text"))


def split_text(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that works, with overlaps of whole parts."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark = separators[at]
    if mark:
        first, *rest = text.split(mark)
        parts = [first, *(mark + p for p in rest)]
    else:
        parts = [text[k : k + size] for k in range(0, len(text), max(1, size - overlap))]
        return [p for p in parts if p.strip()]
    out: list[str] = []
    window: list[str] = []
    length = 0

    def flush() -> None:
        if (joined := "".join(window)).strip():
            out.append(joined.strip())

    for part in parts:
        if len(part) > size:
            flush()
            window, length = [], 0
            out.extend(split_text(part, size, overlap, separators[at + 1 :] or ("",)))
            continue
        if length + len(part) > size:
            flush()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    flush()
    return out


def _exploded(docs: DataFrame, pieces: Column, text: str) -> DataFrame:
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(pieces).alias("chunk_index", "chunk_text"))
    return rows.withColumn("chunk_hash", F.substring(F.md5("chunk_text"), 1, 12))


def recursive_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text") -> DataFrame:
    """The production splitter: chunk_index, chunk_text, chunk_hash. Documents without text give no rows."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([split_text(t or "", size, overlap) for t in texts])

    return _exploded(docs, F.pandas_udf(run, "array<string>")(text), text)


def budget_chunks(docs: DataFrame, budget: int = 500, carried: int = 2, share: float = 0.3, text: str = "text") -> DataFrame:
    """Sentences packed into chunks of a token budget, with some of their neighbours.

    Up to ``carried`` sentences before a chunk stand in front of it if they take at most
    ``share`` of the budget, and up to as many of those behind it follow if they fit half of
    what it leaves. A sentence over the budget is a chunk of its own. The document's
    first heading is put in front of each chunk.
    """

    def pack(parts: list[str], sizes: list[int]) -> list[str]:
        runs: list[tuple[int, int]] = []
        first = total = 0
        for k, size in enumerate(sizes):
            if k > first and total + size > budget:
                runs.append((first, k))
                first, total = k, 0
            total += size
        if sizes:
            runs.append((first, len(sizes)))
        out = []
        for a, b in runs:
            before = range(max(0, a - carried), a)
            if sum(sizes[j] for j in before) > share * budget:
                before = range(0)
            room, end = (budget - sum(sizes[a:b])) / 2, b
            while end < min(b + carried, len(sizes)) and sum(sizes[b : end + 1]) <= room:
                end += 1
            out.append(" ".join(parts[j] for j in (*before, *range(a, end))))
        return out

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for parts, sizes, titles in batches:
            packed = (pack(list(p), list(s)) for p, s in zip(parts, sizes, strict=True))
            yield pd.Series([[f"{t}\n{c}" if t else c for c in chunks] for chunks, t in zip(packed, titles, strict=True)])

    own = sentences(F.coalesce(F.col(text), F.lit("")))
    sizes = F.transform(own, lambda s: token_estimate(s))
    title = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?m)^#{1,6}\s+(.+)$", 1)
    return _exploded(docs, F.pandas_udf(run, "array<string>")(own, sizes, title), text)


def code_chunks(docs: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text") -> DataFrame:
    """Python sources cut in front of classes, functions and decorators at the left margin; short neighbours stay together, long ones are split on."""
    opening = re.compile(r"(?m)^(?=(?:class|def|async def)\s|@)")

    def pack(source: str) -> list[str]:
        out, current = [], ""
        for part in opening.split(source):
            if current and len(current) + len(part) > size:
                out.extend(split_text(current, size, overlap))
                current = ""
            # a decorator stays with what it decorates
            current += part
        return out + split_text(current, size, overlap)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pack(t or "") for t in texts])

    return _exploded(docs, F.pandas_udf(run, "array<string>")(text), text)


def hybrid_chunks(rows: DataFrame, threshold: float = 0.3, coarse_tokens: int = 500, max_tokens: int = 800, min_tokens: int = 150) -> DataFrame:
    """Sentences (doc_id, position, text, embedding) cut coarsely by tokens, then where the topic turns: (doc_id, chunk_index, chunk_text, n_sentences).

    Parts below ``min_tokens`` join the one before; no sentence is lost.
    """
    running = F.sum(token_estimate("text")).over(W.partitionBy("doc_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    coarse = rows.withColumn("doc_id", F.struct("doc_id", F.floor((running - 1) / F.lit(coarse_tokens)).alias("coarse")))
    parts = semantic_chunks(coarse, threshold, max_tokens, min_tokens)
    index = F.row_number().over(W.partitionBy("doc_id.doc_id").orderBy("doc_id.coarse", "chunk_index")) - 1
    return parts.withColumn("_index", index).select(F.col("doc_id.doc_id").alias("doc_id"), F.col("_index").cast("long").alias("chunk_index"), "chunk_text", "n_sentences")


def semantic_chunks(rows: DataFrame, threshold: float = 0.5, max_tokens: int = 500, min_tokens: int = 20) -> DataFrame:
    """Chunks of sentences (doc_id, position, text, embedding): (doc_id, chunk_index, chunk_text, n_sentences).

    A boundary stands where the cosine distance to the sentence before exceeds the
    threshold, or the token budget is used up. Chunks below ``min_tokens`` join the one
    before. All is windows and aggregates, except for the running budget.
    """
    from .retrieval import cosine

    order = W.partitionBy("doc_id").orderBy("position")
    before = F.lag("embedding").over(order)
    turned = F.coalesce(1 - cosine(before, F.col("embedding")) > threshold, F.lit(False))
    parts = rows.withColumn("turn", turned.cast("int")).withColumn("topic", F.sum("turn").over(order.rowsBetween(W.unboundedPreceding, 0)))
    running = F.sum(token_estimate("text")).over(W.partitionBy("doc_id", "topic").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("part", F.floor((running - 1) / F.lit(max_tokens)))
    chunks = parts.groupBy("doc_id", "topic", "part").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("s"), F.sum(token_estimate("text")).alias("tokens"))
    chunks = chunks.select("doc_id", F.col("s")[0]["position"].alias("first"), "s", "tokens")
    small = (F.col("tokens") < min_tokens) & (F.row_number().over(W.partitionBy("doc_id").orderBy("first")) > 1)
    chunks = chunks.withColumn("opens", (~small).cast("int"))
    chunks = chunks.withColumn("chunk_index", F.sum("opens").over(W.partitionBy("doc_id").orderBy("first").rowsBetween(W.unboundedPreceding, 0)) - 1)
    joined = chunks.groupBy("doc_id", "chunk_index").agg(F.flatten(F.array_sort(F.collect_list("s"))).alias("s"))
    return joined.select("doc_id", "chunk_index", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("chunk_text"), F.size("s").alias("n_sentences"))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each line: line_no and line, with heading level and title outside fenced code."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line"))
    keys = [c for c in ("doc_id", "source", "path") if c in others]
    if not keys:
        raise ValueError("lines of different documents are told apart by doc_id, source or path")
    fences = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(W.partitionBy(*keys).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    level = F.when(fences % 2 == 0, heading_level("line"))
    return rows.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)))


def outline(docs: DataFrame, text: str = "text") -> DataFrame:
    """The headings of each document."""
    return lines(docs, text).where("level is not null").drop("line")


def header_chunks(docs: DataFrame, key: str = "doc_id", max_level: int = 4, text: str = "text") -> DataFrame:
    """Sections by headings up to ``max_level``: (key, section, title, section_text)."""
    rows = lines(docs.select(key, text), text)
    opens = (F.col("level") <= max_level).cast("int")
    rows = rows.withColumn("section", F.sum(F.coalesce(opens, F.lit(0))).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "title", "level"))).alias("l"))
    title = F.when(F.col("l")[0]["level"] <= max_level, F.col("l")[0]["title"])
    body = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return parts.select(key, "section", title.alias("title"), body.alias("section_text")).where("section_text != ''")


def enriched(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    """Length, token estimate, noise flag and digest of each chunk."""
    return chunks.withColumns({"chunk_char_count": F.length(text), "chunk_token_estimate": token_estimate(text), "is_noise": is_noise(text), "chunk_digest": F.sha2(F.col(text), 256)})


def preview(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Number and sizes of the chunks that each document would give."""
    rows = recursive_chunks(docs.select("doc_id", "text"), size, overlap)
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min(F.length("chunk_text")).alias("shortest"), F.max(F.length("chunk_text")).alias("longest"), F.avg(F.length("chunk_text")).alias("mean_length"))


def chunks(docs: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
    """Chunks by one of the strategies fixed, recursive, budget, header (or markdown), code; of sentences with embeddings, semantic or hybrid."""
    known = {"fixed": fixed_chunks, "recursive": recursive_chunks, "budget": budget_chunks, "header": header_chunks, "markdown": header_chunks, "code": code_chunks, "semantic": semantic_chunks, "hybrid": hybrid_chunks}
    if strategy not in known:
        raise ValueError(f"strategy must be one of {sorted(known)}")
    return known[strategy](docs, **options)
