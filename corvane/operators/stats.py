"""Profiles, group aggregates, comparisons, and a safe calculator."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of every value in a calculation, and of exponents.
LARGEST, MAX_EXPONENT = 1e100, 100


def profile(df: DataFrame, distinct: list[str] | None = None) -> DataFrame:
    """One row for each column: missing, filled and distinct values, kind, numeric minimum, maximum and mean.

    Blank texts are missing. Everything but distinct values comes from one aggregate of one
    row. Distinct values are exact, and counted for the columns ``distinct`` (all, unless given;
    null for others): only these columns' values are shuffled, each once from a task.
    """
    text = {c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in df.columns}
    number = {c: text[c].try_cast("double") for c in df.columns}
    sums = lambda c: F.struct(
        F.lit(c).alias("column"), F.count_if(text[c].isNull()).alias("missing"), F.count(text[c]).alias("filled"), F.count_if(text[c].isNotNull() & number[c].isNull()).alias("odd"),
        F.min(number[c]).alias("minimum"), F.max(number[c]).alias("maximum"), F.avg(number[c]).alias("mean"),
    )
    rows = df.agg(F.array(*map(sums, df.columns)).alias("columns")).select(F.explode("columns").alias("c")).select("c.*")
    wanted = df.columns if distinct is None else [c for c in df.columns if c in distinct]
    if wanted:
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in wanted))).alias("c")).select("c.*").where("value is not null")
        counted = cells.distinct().groupBy("column").agg(F.count("*").alias("distinct"))
        rows = rows.join(F.broadcast(counted), "column", "left").withColumn("distinct", F.when(F.col("column").isin(*wanted), F.coalesce("distinct", F.lit(0))))
    else:
        rows = rows.withColumn("distinct", F.lit(None).cast("long"))
    plain = F.col("odd") == 0
    numeric = {c: F.when(plain, F.col(c)) for c in ("minimum", "maximum", "mean")}
    return rows.withColumns({"kind": F.when(plain & (F.col("filled") > 0), "number").otherwise("text")} | numeric).select("column", "missing", "filled", "distinct", "kind", "minimum", "maximum", "mean")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows that repeat an earlier one."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def group_aggregate(df: DataFrame, group: str, value: str, operation: str) -> DataFrame:
    """mean, sum, min, max or count of the filled values of each group, with the number of blank ones."""
    known = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    if operation not in known:
        raise ValueError(f"operation must be one of {sorted(known)}")
    number = F.expr(f"try_cast(nullif(trim(cast(`{value}` as string)), '') as double)")
    return df.groupBy(group).agg(known[operation](number).alias("value"), F.count_if(number.isNull()).alias("skipped"))


def summary(df: DataFrame, value: str, sample: bool = False) -> DataFrame:
    """n, mean, median, min, max and standard deviation, rounded to six digits."""
    c = F.col(value)
    deviation = F.coalesce(F.stddev_samp(c) if sample else F.stddev_pop(c), F.lit(0.0))
    return df.agg(F.count(c).alias("n"), *(F.round(f, 6).alias(n) for n, f in (("mean", F.avg(c)), ("median", F.median(c)), ("minimum", F.min(c)), ("maximum", F.max(c)), ("deviation", deviation))))


def compared(baseline: Column, candidate: Column, higher_is_better: bool = True) -> Column:
    """Struct (delta, relative, improved); relative is null for a baseline of 0."""
    delta = candidate - baseline
    return F.struct(delta.alias("delta"), F.when(baseline != 0, delta / F.abs(baseline)).alias("relative"), (delta > 0 if higher_is_better else delta < 0).alias("improved"))


def _checked(value) -> float:
    """Every step of a calculation stays below LARGEST, so numbers cannot grow without bound on the way."""
    if type(value) not in (int, float) or not math.isfinite(value) or abs(value) > LARGEST:
        raise ValueError("too large, or no number")
    return value


def _power(left: float, right: float) -> float:
    if abs(right) > MAX_EXPONENT:
        raise ValueError("exponent")
    # a float first: it overflows at once, where an exact power could take for ever
    return _checked(left**right if abs(float(left) ** right) <= LARGEST else math.inf)


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant):
        return _checked(node.value)
    if isinstance(node, ast.Name) and node.id in _CONSTANTS:
        return _CONSTANTS[node.id]
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATIONS:
        return _checked(_OPERATIONS[type(node.op)](_value(node.operand)))
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATIONS:
        return _checked(_OPERATIONS[type(node.op)](_value(node.left), _value(node.right)))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
        return _checked(_FUNCTIONS[node.func.id](*map(_value, node.args)))
    raise ValueError("not allowed")


_OPERATIONS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Pow: _power, ast.USub: operator.neg, ast.UAdd: operator.pos,
}
_FUNCTIONS = {
    "abs": abs, "round": round, "min": min, "max": max, "pow": _power, "sqrt": math.sqrt, "log": math.log, "log10": math.log10, "exp": math.exp,
    "sin": math.sin, "cos": math.cos, "tan": math.tan,
}
_CONSTANTS = {"pi": math.pi, "e": math.e}


def calculated(expression: str | None) -> float | None:
    """Value of an arithmetic expression of numbers and a few functions; None for anything else, or where a step goes beyond LARGEST."""
    if not expression or len(expression) > 512:
        return None
    try:
        tree = ast.parse(expression.replace("^", "**").replace("×", "*").replace("÷", "/"), mode="eval")
        if sum(1 for _ in ast.walk(tree)) > 100:
            return None
        value = float(_value(tree))
    except (SyntaxError, ValueError, ArithmeticError, TypeError, RecursionError):
        return None
    return value


def calculator(expression: Column | str) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([calculated(e) for e in batch], dtype="float64")

    return F.pandas_udf(run, "double")(expression)


def line_diff(before: Column | str, after: Column | str, limit: int = 12_000) -> Column:
    """Struct (added, removed, diff): lines that changed, and the unified diff up to ``limit`` characters."""
    import difflib

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = []
            for old, new in zip(a, b, strict=True):
                diff = list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), lineterm=""))[2:]
                rows.append((sum(d.startswith("+") for d in diff), sum(d.startswith("-") for d in diff), "\n".join(diff)[:limit]))
            yield pd.DataFrame(rows, columns=["added", "removed", "diff"])

    return F.pandas_udf(run, "added long, removed long, diff string")(before, after)
