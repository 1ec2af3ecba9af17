"""Vectors of texts through a table of what has been encoded before, addressed by content.

The table's parts are written whole and then named in a commit, so a part of a job that failed is never
read, and a text that two jobs encoded at once counts once.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

#: Gives a vector for each text of a list, in order.
Embedder = Callable[[list[str]], list[list[float]]]
VECTORS = "digest string, vector array<double>"


@lru_cache(maxsize=1 << 16)
def _place(token: str) -> int:
    return int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16)


def feature_hashing(width: int = 64) -> Embedder:
    """An embedder without a model: each [a-z0-9]+ token adds 1 or -1 to one of ``width`` numbers; vectors have length 1, of texts without tokens 0."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(width)
            for token in re.findall("[a-z0-9]+", text.lower()):
                h = _place(token)
                vector[h % width] += 1 - 2 * (h // width % 2)
            norm = np.linalg.norm(vector)
            out.append((vector / norm if norm else vector).tolist())
        return out

    return embed


def content_key(text: Column | str, model: str) -> Column:
    """SHA-256 of the model's name and the whole text; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.lit(model + "\0"), c), 256)


def _parts(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Commits of the table, (number, part), in order."""
    try:
        rows = spark.read.schema("number long, part string").parquet(f"{path}/commits/*")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted((r.number, r.part) for r in rows.collect())


def known(spark: SparkSession, path: str) -> DataFrame:
    """(digest, vector, commit) of all that has been encoded; of a text encoded twice the earlier one."""
    whole = spark.createDataFrame([], VECTORS + ", commit long")
    for number, part in _parts(spark, path):
        whole = whole.unionByName(spark.read.schema(VECTORS).parquet(f"{path}/parts/{part}").withColumn("commit", F.lit(number).cast("long")))
    return whole.groupBy("digest").agg(F.min_by("vector", "commit").alias("vector"), F.min("commit").alias("commit"))


def _commit(spark: SparkSession, path: str, part: str) -> None:
    """The part's vectors count from now on; a writer that comes second takes the next number."""
    while True:
        number = max((n for n, _ in _parts(spark, path)), default=-1) + 1
        try:
            spark.createDataFrame([(number, part)], "number long, part string").coalesce(1).write.mode("error").parquet(f"{path}/commits/{number:09d}")
            return
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise


def encoded(spark: SparkSession, path: str, texts: DataFrame, embedder: Embedder, model: str, text: str = "text", batch: int = 256) -> int:
    """Encode the different texts that the table at ``path`` lacks, ``batch`` at a time, and add them; says how many these were.

    A batch with too few vectors, or with one that is empty or not finite, is an error, and
    nothing of the job is added.
    """
    asked = texts.where(F.col(text).isNotNull()).select(content_key(text, model).alias("digest"), F.col(text).alias("text"))
    missing = stored(asked.groupBy("digest").agg(F.first("text").alias("text")).join(known(spark, path).select("digest"), "digest", "left_anti"), "embedding-missing")
    n = missing.count()
    if not n:
        return 0

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), batch):
                some = rows.iloc[at : at + batch]
                vectors = embedder(some["text"].tolist())
                if len(vectors) != len(some) or not all(len(v) and all(math.isfinite(x) for x in v) for v in vectors):
                    raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(some)} texts, or one that is empty or not finite")
                yield pd.DataFrame({"digest": some["digest"].to_numpy(), "vector": vectors})

    part = uuid.uuid4().hex
    missing.mapInPandas(encode, VECTORS).write.parquet(f"{path}/parts/{part}")
    _commit(spark, path, part)
    return n


def with_vectors(spark: SparkSession, path: str, texts: DataFrame, embedder: Embedder, model: str, text: str = "text", batch: int = 256) -> DataFrame:
    """``texts`` with ``vector`` and the number of the ``commit`` that added it, read through the table at ``path``: only what is missing is encoded. Null texts have no vector."""
    encoded(spark, path, texts, embedder, model, text, batch)
    return texts.withColumn("_digest", content_key(text, model)).join(known(spark, path).withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")
