"""The queries of this subpackage, by the names under which they are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, licenses, mixing, periodic, pieces, quality, sharding, simhash, tokenfiles, toxicity, urlfilter, variants, warc
from .common import batches_of, stored, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op1_url_filter(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op2_sentencepiece(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4_shards(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5_quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7_simhash(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.op8_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9_licenses(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10_warc(table(spark, sf_dir, "pages"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op11_periodic(table(spark, sf_dir, "documents"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.op12_variants(table(spark, sf_dir, "documents"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op13_mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filter, op2_sentencepiece, op3_decontaminate, op4_shards, op5_quality, op6_toxicity,
        op7_simhash, op8_token_files, op9_licenses, op10_warc, op11_periodic, op12_variants, op13_mix,
    )
    return {f.__name__: _in_modest_batches(f) for f in found}


def _in_modest_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with batches_of(spark):  # results are rows of a few numbers; as a table they need no batches later
            return stored(query(spark, sf_dir), query.__name__)

    return run


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": urlfilter.OP1_SQL, "op5_quality": quality.OP5_SQL, "op10_warc": warc.OP10_SQL, "op12_variants": variants.OP12_SQL, "op13_mix": mixing.OP13_SQL}
