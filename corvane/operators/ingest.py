"""Ingestion: upserts, patches, deletes, synchronisation, staged publication, digests.

Tables are DataFrames in and DataFrames out; writing them is left to the caller, or to
``replace_table`` where a table has to be swapped as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row for each key: the last in the given order."""
    keys = [key] if isinstance(key, str) else key
    ranked = rows.withColumn("_last", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_last = 1").drop("_last")


def upsert(current: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Rows of ``arriving`` replace those of ``current`` with the same key; others are added. Keys of ``arriving`` must differ."""
    return current.join(arriving.select(key), key, "left_anti").unionByName(arriving)


def insert_missing(current: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Only rows with new keys are added."""
    return current.unionByName(arriving.join(current.select(key), key, "left_anti").dropDuplicates([key]))


def patch(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of ``updates`` replace those of the same name where they are not null."""
    names = [c for c in updates.columns if c != key]
    renamed = updates.select(key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = current.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in current.columns))


def unmatched(updates: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys to be updated or deleted that do not exist: the caller's error."""
    return updates.select(key).join(current.select(key), key, "left_anti")


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key), key, "left_anti")


def sync_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key with its state: new, same, changed or obsolete."""
    a, b = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "obsolete").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def exact_duplicates(rows: DataFrame, text: str, order: str, within: str | None = None) -> DataFrame:
    """First row of equal texts, optionally within a group; ``order`` must tell rows with equal texts apart.

    The first is found by aggregation and joined back on ``order`` too, so that a large
    group of copies is never in one task.
    """
    keys = {"_digest": F.md5(text)} | ({"_within": F.col(within)} if within else {})
    marked = rows.withColumns(keys)
    first = marked.groupBy(*keys).agg(F.min(order).alias("_first"))
    same = marked[order] == first["_first"]
    for k in keys:
        same = same & marked[k].eqNullSafe(first[k])
    return marked.join(first, same, "left_semi").drop(*keys)


def first_of_equal(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Rows (digest, first, copies) by aggregation alone: no window gathers a large group of copies in one task."""
    return rows.groupBy(F.md5(text).alias("digest")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-insensitive digest, the sum of row hashes."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def orphans(child: DataFrame, foreign: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose foreign key is not null and has no parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti")


def publish(chunks: DataFrame, staged: DataFrame, version: str) -> DataFrame:
    """Staged publication: if all staged chunks are there, they become active and others of their sources retired.

    ``staged``: expected (source, chunk_id) of ``version``; ``chunks``: all rows with source,
    chunk_id, version and state. A source that misses a chunk keeps its old state.
    """
    arrived = chunks.where((F.col("version") == version) & (F.col("state") == "staging")).select("source", "chunk_id")
    incomplete = staged.join(arrived, ["source", "chunk_id"], "left_anti").select("source").distinct()
    ready = staged.select("source").distinct().join(incomplete, "source", "left_anti").withColumn("_ready", F.lit(True))
    state = F.when(F.col("_ready") & (F.col("version") == version), "active").when(F.col("_ready") & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    return chunks.join(ready, "source", "left").withColumn("state", state).drop("_ready")


def replace_table(df: DataFrame, path: str, generation: str) -> str:
    """Write a generation of a table beside the others; readers go on with theirs until they are told of this path."""
    target = f"{path.rstrip('/')}/generation={generation}"
    df.write.mode("overwrite").parquet(target)
    return target


def append_audit(rows: DataFrame) -> DataFrame:
    """Audit lines as JSON without null or empty fields."""
    names = [c for c in rows.columns]
    cleaned = rows.select(*(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in names))
    return cleaned.select(F.to_json(F.struct(*names)).alias("line"))


def catalogue_by_source(chunks: DataFrame, order: str = "chunk_index") -> DataFrame:
    """One row for each source: attributes of its first chunk and the number of chunks."""
    attributes = [c for c in chunks.columns if c not in ("source", "chunk_id", "text", order)]
    return chunks.groupBy("source").agg(*(F.min_by(c, order).alias(c) for c in attributes), F.count("*").alias("chunk_count"))


def overview(documents: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts in total and by each dimension, as grouping sets."""
    sets = documents.groupingSets([[], *[[F.col(d)] for d in dimensions]], *dimensions)
    return sets.agg(F.count("*").alias("documents"), F.grouping_id().alias("grouping"))


def upload_problems(uploads: DataFrame, jobs: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """Uploads with a problem column: unsupported kind, too large, empty, duplicate of a live job, or null."""
    live = jobs.where(F.col("status").isin("pending", "running", "retrying", "completed")).select("file_hash").distinct().withColumn("_live", F.lit(True))
    kind = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    known = kind.isin("pdf", "docx", "doc", "txt", "md", "markdown", "html", "csv", "json")
    problem = F.when(~known, "unsupported").when(F.col("size") > max_bytes, "too_large").when(F.col("size") == 0, "empty").when(F.col("_live"), "duplicate")
    return uploads.join(live, "file_hash", "left").withColumn("problem", problem).drop("_live")


def with_defaults(docs: DataFrame) -> DataFrame:
    """Access and kind fields with their defaults where blank."""
    defaults = {"visibility": "public", "confidentiality": "internal", "category": "general", "doc_type": "other"}
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit(None).cast("string")
    return docs.withColumns({c: F.coalesce(blank(c), F.lit(v)) for c, v in defaults.items()})
