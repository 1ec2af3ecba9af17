"""Scores of every document for a batch of queries, added up where the document is: pairs of both are never shuffled.

Documents become vectors over the words that the batch has. A task scores its documents in tiles and keeps, for each
query, what may be among the best ``k``; only that is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Rows (query, term) of a batch up to which it goes to the tasks.
BATCH_ROWS = 200_000
#: Parts of scores that a task adds up, and scores that it holds, at a time: 8 bytes each, a few arrays of them.
TILE_PARTS, TILE_SCORES = 1 << 20, 1 << 21
#: Documents whose words are searched for parts at a time.
HELD_ROWS = 512


@dataclass(frozen=True)
class Batch:
    """Queries by term: those with term ``t`` are ``query[start[t]:start[t + 1]]``, with ``count`` as often as they have it."""

    ids: list
    terms: list[str]
    start: np.ndarray
    query: np.ndarray
    count: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        """Different terms of each query."""
        return np.bincount(self.query, minlength=len(self.ids))


def batch_of(wanted: DataFrame) -> Batch | None:
    """The queries of rows (query_id, term, qtf); None if there are more than BATCH_ROWS of these."""
    rows = wanted.select("query_id", "term", "qtf").limit(BATCH_ROWS + 1).collect()
    if len(rows) > BATCH_ROWS:
        return None
    ids, terms = list(dict.fromkeys(r[0] for r in rows)), sorted({r[1] for r in rows})
    own, place = {q: n for n, q in enumerate(ids)}, {t: n for n, t in enumerate(terms)}
    found = sorted((place[r[1]], own[r[0]], r[2]) for r in rows)
    columns = np.array(found, dtype=np.int64).reshape(len(found), 3)
    return Batch(ids, terms, np.searchsorted(columns[:, 0], np.arange(len(terms) + 1)), columns[:, 1], columns[:, 2])


def vectors(docs: DataFrame, words: Column, terms: list[str]) -> DataFrame:
    """(doc_id, dl, places, tfs), stored: each document's number of ``words``, and of these the ones in ``terms``, by their places there, with their counts."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    shared = spark.sparkContext.broadcast(terms)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            doc = np.repeat(np.arange(len(lists)), sizes.to_numpy())
            place = pc.fill_null(pc.index_in(pc.cast(lists.flatten(), pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, tf = np.unique(doc[place >= 0] * (len(known) + 1) + place[place >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) * (len(known) + 1)), pa.int32())
            of = lambda values, ends=ends: pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(sizes, pa.int64()), of(keys % (len(known) + 1)), of(tf)], names=["doc_id", "dl", "places", "tfs"])

    rows = docs.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return stored(rows.mapInArrow(counted, f"doc_id {kind.simpleString()}, dl long, places array<int>, tfs array<int>"), "vectors")


def held(docs: DataFrame, words: Column, parts: list[str]) -> DataFrame:
    """(doc_id, dl, places, tfs), stored: of ``parts``, by their places there, those that stand within one of a document's ``words``, once each."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    shared = spark.sparkContext.broadcast(parts)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {p: n for n, p in enumerate(shared.value)}
        widths = sorted({len(p) for p in known})
        for whole in batches:
            for low in range(0, len(whole), HELD_ROWS):
                batch = whole.slice(low, HELD_ROWS)
                lists = batch.column(1)
                sizes = pc.fill_null(pc.list_value_length(lists), 0)
                coded = pc.dictionary_encode(lists.flatten())
                each = [np.array(sorted({known[p] for w in widths for at in range(len(word) - w + 1) if (p := word[at : at + w]) in known}), dtype=np.int64) for word in coded.dictionary.to_pylist()]
                times = np.array([len(e) for e in each], dtype=np.int64)
                start, flat = times.cumsum() - times, np.concatenate([*each, np.zeros(0, dtype=np.int64)])
                code = coded.indices.to_numpy()
                n = times[code]
                entry = np.arange(n.sum()) + np.repeat(start[code] - (n.cumsum() - n), n)
                doc = np.repeat(np.repeat(np.arange(len(lists)), sizes.to_numpy()), n)
                keys = np.unique(doc * (len(known) + 1) + flat[entry])
                ends = pa.array(np.searchsorted(keys, np.arange(len(lists) + 1) * (len(known) + 1)), pa.int32())
                of = lambda values, ends=ends: pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(sizes, pa.int64()), of(keys % (len(known) + 1)), of(np.ones(len(keys)))], names=["doc_id", "dl", "places", "tfs"])

    rows = docs.select("doc_id", F.array_compact(F.array_distinct(F.coalesce(words, F.array().cast("array<string>")))).alias("words"))
    return stored(rows.mapInArrow(found, f"doc_id {kind.simpleString()}, dl long, places array<int>, tfs array<int>"), "held")


def best(found: DataFrame, batch: Batch, query_type: str, k: int, weights: np.ndarray, saturation: tuple[float, float, float] | None = None, sizes: np.ndarray | None = None, most: float = np.inf) -> DataFrame:
    """(query_id, doc_id, score): each task's rows that may be among the best ``k`` of a query with a score above 0, in the order of scores to nine digits, then ids.

    ``found``: rows of ``vectors``. A score is the sum of ``weights`` (one for each of the batch's rows), each times
    BM25's tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean)) with ``saturation`` (k1, b, mean), by ``sizes`` (one
    for each query), and ``most`` at most.
    """
    schema = f"query_id {query_type}, doc_id {found.schema['doc_id'].dataType.simpleString()}, score double"
    n = len(batch.ids)
    if not n or k < 1:
        return found.sparkSession.createDataFrame([], schema)
    shared = found.sparkSession.sparkContext.broadcast((batch.start, batch.query, weights, sizes))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, query, weights, sizes = shared.value
        kept, floor = _nothing(), np.zeros(n)
        for rows in batches:
            ends, place, tf = (np.asarray(x) for x in (pc.list_value_length(rows.column("places")).to_numpy().cumsum(), rows.column("places").flatten().to_numpy(), rows.column("tfs").flatten().to_numpy()))
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            part = tf.astype(np.float64)
            if saturation:
                k1, b, mean = saturation
                part = part * (k1 + 1) / (part + k1 * (1 - b + b * rows.column("dl").to_numpy()[doc] / mean))
            queries = start[place + 1] - start[place]
            upto = np.concatenate(([0], queries.cumsum()))
            low = 0
            while low < len(ends):
                at = ends[low - 1] if low else 0
                high = min(int(np.searchsorted(upto[ends], upto[at] + TILE_PARTS, "right")), low + max(1, TILE_SCORES // n), len(ends))
                high = max(high, low + 1)
                own = slice(at, ends[high - 1])
                scores = np.zeros(n * (high - low))
                # one document of very many terms is added up in pieces
                for a in range(own.start, own.stop, TILE_PARTS):
                    piece = slice(a, min(own.stop, a + TILE_PARTS))
                    times = queries[piece]
                    entry = np.arange(times.sum()) + np.repeat(start[place[piece]] - (times.cumsum() - times), times)
                    scores += np.bincount(query[entry] * (high - low) + np.repeat(doc[piece] - low, times), weights[entry] * np.repeat(part[piece], times), len(scores))
                scores = scores.reshape(n, high - low)
                if sizes is not None:
                    scores = np.minimum(most, scores / sizes[:, None])
                q, d = np.nonzero((scores > 0) & (scores >= floor[:, None] - 2e-9))
                if len(q):
                    ids = rows.column("doc_id").take(pa.array(low + d)).to_pylist()
                    kept, floor = _merged(kept, pd.DataFrame({"query": q, "id": pd.Series(ids, dtype=object), "score": scores[q, d]}), floor, k)
                low = high
        types = [f.type for f in pa_schema]
        yield pa.RecordBatch.from_arrays([pa.array([batch.ids[q] for q in kept["query"]], types[0]), pa.array(kept["id"].tolist(), types[1]), pa.array(kept["score"].to_numpy(), types[2])], names=["query_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    pa_schema = to_arrow_schema(StructType.fromDDL(schema))
    return found.mapInArrow(search, schema)


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"query": np.zeros(0, dtype=np.int64), "id": pd.Series([], dtype=object), "score": np.zeros(0)})


def _merged(kept: pd.DataFrame, new: pd.DataFrame, floor: np.ndarray, k: int) -> tuple[pd.DataFrame, np.ndarray]:
    """What may still be among the best ``k``, and each query's k-th score. How ties are rounded is left to the ranking: all that come near the k-th stay, of equal ones the ``k`` first ids."""
    rows = pd.concat([kept, new]) if len(kept) else new
    rows = rows.sort_values("id", na_position="first", kind="stable").sort_values(["query", "score"], ascending=[True, False], kind="stable")
    rows = rows[rows.groupby(["query", "score"]).cumcount() < k]
    kth = rows[rows.groupby("query").cumcount() == k - 1]
    floor = floor.copy()
    floor[kth["query"].to_numpy()] = kth["score"].to_numpy()
    return rows[rows["score"].to_numpy() >= floor[rows["query"].to_numpy()] - 2e-9], floor
