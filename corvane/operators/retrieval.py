"""Batch retrieval: BM25, exact vector search, fusion, reranking.

Queries are always a DataFrame; a single query is one row. Every ranking has a total
order: the score rounded to nine digits, then the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine, term_relevance, terms, tokens
from ..storage import stored
from . import scoring

#: Bytes of query vectors that go to the executors at a time.
VECTOR_BLOCK_BYTES = 32 << 20
#: Queries and rows of which a task multiplies all pairs at a time: 32 MB of scores.
TILE_QUERIES, TILE_ROWS = 2048, 2048
#: Rows (query, term) of a batch up to which it is broadcast.
BROADCAST_ROWS = 200_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The best ``k`` rows for each query, with ``rank`` from 1."""
    order = W.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(item))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=tokens) -> DataFrame:
    """Rows (doc_id, term, tf)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenizer(text)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, query_id: str, text: str, tokenizer=tokens) -> DataFrame:
    """Rows (query_id, term, qtf)."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokenizer(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def term_weights(df: DataFrame, n_docs: int, mean: float | None = None) -> DataFrame:
    """Rows (term, idf) of (term, df). Without ``mean`` always positive; with it, negative values become a quarter of it."""
    ratio = (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if mean is None:
        return df.select("term", F.log(1 + ratio).alias("idf"))
    return df.select("term", F.when(ratio < 1, F.lit(0.25 * mean)).otherwise(F.log(ratio)).alias("idf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, variant: str = "lucene", k1: float = 1.5, b: float = 0.75, searched: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, doc_id, score) of all pairs with a common term.

    The statistics are those of ``docs``; only rows of ``searched`` (doc_id), if given,
    are scored, so access rules apply before any cut. Of the documents' tokens only
    those that a query has are ever shuffled. The okapi variant's mean weight is over all
    terms, and so needs a count of each.
    """
    if variant not in ("lucene", "okapi"):
        raise ValueError("variant must be lucene or okapi")
    wanted = query_terms(queries, query_id, query_text)
    # the empty term stands for the document itself, so one pass gives statistics and postings
    every = F.concat(F.coalesce(tokens("text"), F.array().cast("array<string>")), F.array(F.lit("")))
    rows = docs.select("doc_id", every.alias("terms")).select("doc_id", (F.size("terms") - 1).alias("dl"), F.explode("terms").alias("term"))
    asked = wanted.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    found = stored(rows.join(asked, "term", "left_semi").groupBy("doc_id", "term", "dl").agg(F.count("*").alias("tf")), "bm25")
    n_docs, mean = found.where("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("dl") * F.col("tf")) / F.sum(F.when(F.col("dl") > 0, F.col("tf")))).first()
    hits = found.where("term != ''")
    usual = None
    if variant == "okapi":
        counts = postings(docs).groupBy("term").agg(F.count("*").alias("df"))
        usual = counts.agg(F.avg(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0
    weights = term_weights(hits.groupBy("term").agg(F.count("*").alias("df")), n_docs, usual)
    if searched is not None:
        hits = hits.join(searched.select("doc_id"), "doc_id", "left_semi")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    weighted = stored(wanted.join(weights, "term"), "bm25-queries")
    # common words are hot keys; a batch of queries of checked size is broadcast to them
    small = weighted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return hits.join(F.broadcast(weighted) if small else weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 10, **options) -> DataFrame:
    """The best ``k`` documents of each query with a positive score; for options see ``bm25_scores``.

    A batch of checked size goes to the documents, whose scores are added up where they are. A larger one, and
    ids that stand in several rows, take the joins of ``bm25_scores``.
    """
    best = _bm25_best(docs, queries, query_id, query_text, k, **options)
    return top_k(bm25_scores(docs, queries, query_id, query_text, **options).where("score > 0") if best is None else best, k)


def _bm25_best(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int, variant: str = "lucene", k1: float = 1.5, b: float = 0.75, searched: DataFrame | None = None) -> DataFrame | None:
    """What may be among the best ``k``, from each task."""
    if variant not in ("lucene", "okapi"):
        raise ValueError("variant must be lucene or okapi")
    batch = scoring.batch_of(query_terms(queries, query_id, query_text))
    if batch is None:
        return None
    found = scoring.vectors(docs, tokens("text"), batch.terms)
    n_docs, different, mean = found.agg(F.count("*"), F.count_distinct("doc_id"), F.avg(F.when(F.col("dl") > 0, F.col("dl")))).first()
    if different != n_docs:
        return None
    df = np.zeros(len(batch.terms))
    for place, count in found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count("*")).collect():
        df[place] = count
    ratio = (n_docs - df + 0.5) / (df + 0.5)
    if variant == "lucene":
        idf = np.log(1 + ratio)
    else:
        idf = np.where(ratio < 1, 0.25 * _usual_weight(docs, n_docs), np.log(ratio))
    if searched is not None:
        found = found.join(searched.select("doc_id"), "doc_id", "left_semi")
    weights = batch.count * np.repeat(idf, np.diff(batch.start))
    return scoring.best(found, batch, queries.schema[query_id].dataType.simpleString(), k, weights, (k1, b, mean or 1.0))


def _usual_weight(docs: DataFrame, n_docs: int) -> float:
    """Mean weight of all terms of ``docs``, each counted once for a document."""
    counts = docs.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.agg(F.avg(F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0


def overlap_search(docs: DataFrame, queries: DataFrame, k: int, words: Column | str = "words") -> DataFrame:
    """The best ``k`` documents (doc_id) of each query (query_id) by the share of the query's different ``words`` that they have, 0.99 at most; both sides have the column, an array."""
    wanted = queries.select("query_id", F.explode(words).alias("term")).where("term is not null").distinct().withColumn("qtf", F.lit(1))
    batch = scoring.batch_of(wanted)
    if batch is None:
        sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n"))
        held = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("term"))
        common = wanted.join(held, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).join(sizes, "query_id")
        return top_k(common.select("query_id", "doc_id", F.least(F.lit(0.99), F.col("c") / F.col("n")).alias("score")), k)
    found = scoring.vectors(docs, F.array_distinct(words), batch.terms)
    rows = scoring.best(found, batch, queries.schema["query_id"].dataType.simpleString(), k, np.ones(len(batch.query)), sizes=batch.sizes, most=0.99)
    return top_k(rows, k)


def with_texts(results: DataFrame, texts: DataFrame) -> DataFrame:
    """``results`` with the columns of ``texts`` (doc_id, ...); results of checked size go to the texts, which are not shuffled."""
    results = stored(results, "results")
    small = results.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(results) if small else results, "doc_id")


def overlap(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 10) -> DataFrame:
    """The best ``k`` documents of each query by the share of the query's different tokens that occur anywhere in the text, within words too.

    A token is a run of letters and digits, so a text has it within a word or not at all. Queries without tokens have no rows.
    """
    return _overlap(docs, stored(_asked(queries, query_id, query_text), "overlap-tokens"), k)


def overlap_fallback(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 10) -> DataFrame:
    """``overlap`` for queries no document has a term of. All other queries have no rows."""
    asked = stored(_asked(queries, query_id, query_text), "overlap-tokens")
    answered = asked.join(_words(docs), asked["token"] == F.col("term"), "left_semi").select("query_id").distinct()
    return _overlap(docs, stored(asked.join(answered, "query_id", "left_anti"), "overlap-open"), k)


def _asked(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """(query_id, n, token): each query's different tokens and their number."""
    return queries.select(F.col(query_id).alias("query_id"), F.array_distinct(tokens(query_text)).alias("tokens")).select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))


def _words(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).distinct()


def _overlap(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Documents by tokens within words, for rows (query_id, n, token).

    A batch of checked size goes to the documents. Of a larger one, tokens are looked up in the corpus's different
    words, by their first three characters at each place of a word; documents then join the words that hold one.
    """
    if asked.isEmpty():
        return top_k(asked.select("query_id", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(0.0).alias("score")), 0)
    batch = scoring.batch_of(asked.select("query_id", F.col("token").alias("term"), F.lit(1).alias("qtf")))
    if batch is not None:
        found = scoring.held(docs, tokens("text"), batch.terms)
        return top_k(scoring.best(found, batch, asked.schema["query_id"].dataType.simpleString(), k, np.ones(len(batch.query)), sizes=batch.sizes), k)
    heads = asked.select("token", F.substring("token", 1, 3).alias("head")).distinct()
    widths = F.array(*(F.lit(w) for w in range(1, 4)))
    cuts = F.array_distinct(F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - w + 1, F.lit(1))), lambda at: F.substring(F.col("term"), at, w)))))
    within = _words(docs).select("term", F.explode(cuts).alias("head")).join(heads, "head").where(F.contains("term", F.col("token"))).select("term", "token").distinct()
    within = stored(within, "overlap-within")
    small = within.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    words = docs.select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    held = words.join(F.broadcast(within) if small else within, "term").select("doc_id", "token").distinct()
    shares = held.join(asked, "token").groupBy("query_id", "doc_id").agg((F.count("*") / F.max("n")).alias("score"))
    return top_k(shares, k)


def bm25_or_overlap(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, k: int = 10) -> DataFrame:
    """BM25, and for queries without any term in the corpus the share of tokens within words; ``method`` says which."""
    columns = ("query_id", "doc_id", "score", "rank")
    lexical = bm25(docs, queries, query_id, query_text, k).select(*columns, F.lit("bm25").alias("method"))
    return lexical.unionByName(overlap_fallback(docs, queries, query_id, query_text, k).select(*columns, F.lit("overlap").alias("method")))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """Exact nearest rows by cosine: (query_id, vec_id, score, rank).

    ``queries``: (query_id, embedding). Their vectors go to the tasks in blocks of
    bounded size, one pass over ``vectors`` for each; a task multiplies at most TILE_QUERIES *
    TILE_ROWS pairs at a time and keeps its best ``k`` for each query, and only those are shuffled. Zero vectors score 0;
    rows and queries without a vector or an id, or with a null or NaN in the vector, are left out. Vectors of different
    lengths are an error that names the first id. Equal scores, to nine digits, are ranked by id.
    """
    spark = vectors.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    queries = queries.where(F.col("query_id").isNotNull() & whole("embedding")).select("query_id", "embedding")
    n, width, least, odd = queries.agg(F.count("*"), F.max(F.size("embedding")), F.min(F.size("embedding")), F.max_by("query_id", F.size("embedding"))).first()
    types = (queries.schema["query_id"].dataType, vectors.schema[vec_id].dataType)
    schema = f"query_id {types[0].simpleString()}, vec_id {types[1].simpleString()}, score double"
    if not n:
        return spark.createDataFrame([], schema + ", rank long")
    if width != least:
        raise ValueError(f"query vectors have {least} to {width} numbers; one of {width} is {odd!r}")
    blocks = max(1, -(-n * max(width, 1) * 8 // VECTOR_BLOCK_BYTES))
    same = F.when(F.size(embedding) == width, F.col(embedding)).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {width} numbers: "), F.col(vec_id).cast("string"))).cast(vectors.schema[embedding].dataType))
    rows = vectors.where(F.col(vec_id).isNotNull() & whole(embedding)).select(F.col(vec_id).alias("vec_id"), same.alias("embedding"))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        if not own:
            continue
        ids = pd.Series([r[0] for r in own]).to_numpy()
        matrix = _unit(np.array([r[1] for r in own], dtype=np.float64).reshape(len(own), width))
        shared = spark.sparkContext.broadcast((ids, matrix))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best: dict[int, pd.DataFrame] = {}
            for batch in batches:
                for low in range(0, len(batch), TILE_ROWS):
                    rows = batch.iloc[low : low + TILE_ROWS]
                    own, units = rows["vec_id"].to_numpy(), _unit(np.stack(rows["embedding"].to_list()).astype(np.float64))
                    for at in range(0, len(ids), TILE_QUERIES):
                        asked = ids[at : at + TILE_QUERIES]
                        scores = matrix[at : at + TILE_QUERIES] @ units.T
                        if exclude_self and asked.dtype == own.dtype:
                            scores[asked[:, None] == own[None, :]] = -np.inf
                        best[at] = _best(best.get(at), asked, own, scores, k)
            yield from best.values()

        part = rows.mapInPandas(search, schema)
        found = part if found is None else found.union(part)
    return top_k(found, k, item="vec_id")


def _best(before: pd.DataFrame | None, ids: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of ``before`` and these scores for each query, in the order of rounded scores and ids."""
    # every row that may be among the best k, ties included
    least = np.partition(scores, -k, axis=1)[:, -k] if 0 < k < scores.shape[1] else np.full(len(ids), -np.inf)
    q, at = np.nonzero((scores >= least[:, None] - 2e-9) & np.isfinite(scores))
    rows = pd.DataFrame({"query_id": ids[q], "vec_id": own[at], "score": scores[q, at]})
    rows = rows if before is None else pd.concat([before, rows])
    return rows.assign(r=rows["score"].round(9)).sort_values(["query_id", "r", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k).drop(columns="r")


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows by their length; zero rows stay zero."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def vector_filtered(vectors: DataFrame, queries: DataFrame, condition: Column, k: int = 10, **options) -> DataFrame:
    """Vector search among the rows that a condition admits: the filter comes first, so ``k`` rows are found where there are any."""
    return vector_search(vectors.where(condition), queries, k, **options)


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of rows (query_id, doc_id, list, rank): (query_id, doc_id, score, source).

    A list that has an item more than once counts its best rank. ``source`` names
    the lists, joined by +.
    """
    best = lists.groupBy(by, item, "list").agg(F.min("rank").alias("rank"))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(value)).otherwise(weight)
    return best.groupBy(by, item).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), "+").alias("source"))


def score_fusion(lists: DataFrame, weights: dict[str, float], by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Fusion by ranks made similarities, (max - rank + 1) / max for each list of each query."""
    longest = F.max("rank").over(W.partitionBy(by, "list"))
    similar = lists.withColumn("similar", (longest - F.col("rank") + 1) / longest)
    weight = F.lit(0.0)
    for name, value in weights.items():
        weight = F.when(F.col("list") == name, F.lit(value)).otherwise(weight)
    return similar.groupBy(by, item).agg(F.sum(weight * F.col("similar")).alias("score"))


def hybrid(lexical: DataFrame, vector: DataFrame, k: int = 10, weight: float = 0.5) -> DataFrame:
    """BM25 and vector rankings (query_id, doc_id, rank) fused with equal weights; source says which list had the item."""
    both = lexical.select("query_id", "doc_id", F.lit("bm25").alias("list"), "rank").unionByName(vector.select("query_id", "doc_id", F.lit("vector").alias("list"), "rank"))
    return top_k(rrf(both, weights={"bm25": weight, "vector": 1 - weight}), k)


def rerank(results: DataFrame, query: Column | str, text: Column | str, k: int, threshold: float | None = None, score=term_relevance) -> DataFrame:
    """Order results by a score of query and text (by default their term overlap); below ``threshold`` they go."""
    rescored = results.drop("rank", "score").withColumn("score", score(query, text))
    return top_k(rescored if threshold is None else rescored.where(F.col("score") >= threshold), k)


def decomposed(queries: DataFrame, retrieve, k: int = 10, most: int = 4, each: int = 3) -> DataFrame:
    """Queries (query_id, query, parts) and their parts, up to ``most`` different texts, retrieved at once and fused.

    ``parts`` is an array of subquestions; ``retrieve`` gives (query_id, doc_id, rank) for
    rows (query_id, query). Each text gives its best min(``each``, k).
    """
    texts = F.slice(F.array_distinct(F.concat(F.array("query"), F.coalesce("parts", F.array().cast("array<string>")))), 1, most)
    asked = stored(queries.select("query_id", F.posexplode(texts).alias("part", "query")).withColumn("part_id", F.struct("query_id", "part")), "decomposed")
    found = retrieve(asked.select(F.to_json("part_id").alias("query_id"), "query")).where(F.col("rank") <= min(each, k))
    named = found.withColumnRenamed("query_id", "_part").join(asked.select(F.to_json("part_id").alias("_part"), "query_id", F.col("part").cast("string").alias("list")), "_part")
    return top_k(rrf(named.select("query_id", "doc_id", "list", "rank")), k)


def without_reranker(results: DataFrame) -> DataFrame:
    """Scores that fall by 0.01 with each rank, in the order given."""
    return results.withColumn("score", 1 - 0.01 * (F.col("rank") - 1))


def merge_knowledge(raw: DataFrame, knowledge: DataFrame, limit: int) -> DataFrame:
    """Raw results, then knowledge that they do not have yet, in order of score; at most ``limit`` for each query."""
    extra = knowledge.join(raw.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = raw.select("query_id", "doc_id", "score", F.lit(0).alias("later")).unionByName(extra.select("query_id", "doc_id", "score", F.lit(1).alias("later")))
    order = W.partitionBy("query_id").orderBy("later", F.round("score", 9).desc(), "doc_id")
    return both.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def project_knowledge(queries: DataFrame, records: DataFrame, k: int = 2) -> DataFrame:
    """Active records with sources that are not merely derived, of the query's project, by term relevance above 0."""
    usable = records.where((F.col("status") == "active") & (F.col("origin") != "derived_only") & (F.size("source_ids") > 0))
    # a term of one project is not that of another
    of = lambda text: F.transform(terms(text), lambda t: F.concat(F.col("project_id").cast("string"), F.lit("\x1f"), t))
    return overlap_search(usable.select(F.col("id").alias("doc_id"), of("statement").alias("words")), queries.select("query_id", of("query").alias("words")), k)


def context(results: DataFrame, limit: int = 800) -> DataFrame:
    """One text for each query: numbered passages of at most ``limit`` characters with their scores."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] score="), F.format_number("score", 4), F.lit("\n"), F.substring("text", 1, limit))
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("context"))


def nearest_pairs(vectors: DataFrame) -> DataFrame:
    """Cosine of each vector with the next in order of ``position`` within its document."""
    following = F.lead("embedding").over(W.partitionBy("doc_id").orderBy("position"))
    return vectors.withColumn("following", following).where("following is not null").withColumn("similarity", cosine("embedding", "following"))
