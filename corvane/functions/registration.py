"""SQL names for the column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.stats import calculated

#: Temporary SQL functions by name: arguments, result type, and the SQL of the body.
SQL_FUNCTIONS = {
    "corvane_rrf": ("rank BIGINT, k BIGINT", "DOUBLE", "CASE WHEN rank > 0 THEN 1.0D / (k + rank) ELSE 0.0D END"),
    "corvane_backoff": ("attempt BIGINT", "DOUBLE", "least(30.0D, pow(2.0D, attempt) * 2)"),
    "corvane_token_estimate": ("txt STRING", "BIGINT", "CAST(floor(regexp_count(txt, '[一-鿿]') / 1.5 + (length(txt) - regexp_count(txt, '[一-鿿]')) / 4) AS BIGINT)"),
    "corvane_slug": ("txt STRING", "STRING", "regexp_replace(regexp_replace(lower(trim(txt)), '[^a-z0-9]+', '-'), '^-+|-+$', '')"),
}


def _calculate(expressions: pd.Series) -> pd.Series:
    return pd.Series([calculated(e) for e in expressions], dtype="float64")


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions available to SQL in this session; returns their names."""
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("corvane_calculate", F.pandas_udf(_calculate, "double"))
    return [*SQL_FUNCTIONS, "corvane_calculate"]
