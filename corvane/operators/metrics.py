"""Retrieval quality and evaluation metrics as aggregates.

Conventions differ between evaluators and are parameters: ``empty`` says what queries
without relevant documents score (one, zero, null), ``duplicates`` whether later
occurrences in a ranking are ignored (first) or count again in AP and NDCG (as_is).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import running_total


def _ideal(n: Column, k: int) -> Column:
    """DCG of min(k, n) relevant documents at the top."""
    count = F.least(n, F.lit(k)).cast("int")
    return F.when(count >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))).otherwise(0.0)


def ir_metrics(results: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), empty: str = "one", duplicates: str = "first") -> DataFrame:
    """One row for each query of ``results`` (query_id, doc_id, rank) or ``relevant`` (query_id, doc_id).

    Columns recall_k, precision_k, f1_k, hit_k, ndcg_k for each k, and mrr, ap.
    """
    if empty not in ("one", "zero", "null") or duplicates not in ("first", "as_is"):
        raise ValueError("empty is one, zero or null; duplicates is first or as_is")
    gold = relevant.select("query_id", "doc_id").distinct()
    rows = results.select("query_id", "doc_id", "rank").join(gold.withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left")
    first = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    rows = rows.withColumn("rel", F.coalesce("rel", F.lit(0))).withColumn("new", first.cast("int")).withColumn("hit", F.col("rel") * F.col("new"))
    counted = "hit" if duplicates == "first" else "rel"
    rows = rows.withColumn("hits", F.sum(counted).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    aggs = [F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_rank"), F.sum(F.when(F.col(counted) == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(inside, F.col(counted) / F.log2(F.col("rank") + F.lit(1))).otherwise(0.0)).alias(f"dcg_{k}")]
    sums = rows.groupBy("query_id").agg(*aggs)
    n_rel = gold.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    both = sums.join(n_rel, "query_id", "full").fillna(0, ["n_rel", "precisions", *(f"n_{k}" for k in ks), *(f"dcg_{k}" for k in ks)])
    none = {"one": F.lit(1.0), "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[empty]
    if_any = lambda c, other=none: F.when(F.col("n_rel") > 0, c).otherwise(other)
    out = ["query_id"]
    for k in ks:
        recall, precision = if_any(F.col(f"n_{k}") / F.col("n_rel")), F.col(f"n_{k}") / k
        f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
        out += [recall.alias(f"recall_{k}"), precision.alias(f"precision_{k}"), f1.alias(f"f1_{k}"), if_any((F.col(f"n_{k}") > 0).cast("double")).alias(f"hit_{k}"), if_any(F.col(f"dcg_{k}") / _ideal(F.col("n_rel"), k)).alias(f"ndcg_{k}")]
    out += [F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("mrr"), if_any(F.col("precisions") / F.col("n_rel")).alias("ap")]
    return both.select(*out)


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of all metric columns, over all queries or for each group."""
    names = [c for c in per_query.columns if c not in ("query_id", *(by or []))]
    return per_query.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names))


def percentile(df: DataFrame, value: str, fraction: float, rule: str = "floor", by: str | None = None) -> DataFrame:
    """An exact percentile by index: floor((n-1)f), ceil(fn)-1 or int(fn), from 0; of all rows or for each group.

    Equal values are counted first, and the different ones put in order by ranges, so
    that no task has to hold all of them.
    """
    if rule not in ("floor", "ceil", "int"):
        raise ValueError("rule is floor, ceil or int")
    keys = [by] if by else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, keys, ["_v"], "_upto", weight="_n")
    n = F.col("_total")
    index = {"floor": F.floor((n - 1) * fraction), "ceil": F.ceil(n * fraction) - 1, "int": F.least(F.floor(n * fraction), n - 1)}[rule]
    totals = upto.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    rows = upto.join(totals, keys) if keys else upto.join(F.broadcast(totals))
    return rows.where(F.col("_upto") > F.greatest(index, F.lit(0).cast("long"))).groupBy(*keys).agg(F.min("_v").alias("percentile"))


def confusion(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Rows (label, tp, fp, fn, precision, recall, f1)."""
    counts = rows.groupBy(F.col(expected).alias("e"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    sides = counts.select(F.col("e").alias("label"), F.when(F.col("e") == F.col("a"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col("e") != F.col("a"), F.col("n")).otherwise(0).alias("fn"))
    sides = sides.unionByName(counts.where("e != a").select(F.col("a").alias("label"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn")))
    total = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return total.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement and Cohen's kappa (1 if chance alone would agree always)."""
    joint = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    left, right = joint.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("p")), joint.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("q"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("c"))
    total = joint.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    both = total.join(chance, F.lit(True))
    observed, expected = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return both.select("n", observed.alias("agreement"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(1.0).alias("kappa"))


def trigger_scores(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Precision, recall and F1 of a boolean decision."""
    tp, fp, fn = (F.count_if(c) for c in (F.col(expected) & F.col(actual), ~F.col(expected) & F.col(actual), F.col(expected) & ~F.col(actual)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def score_buckets(rows: DataFrame, score: str) -> DataFrame:
    """Mean and numbers of scores of at least 0.8, 0.6, 0.4, and below."""
    c = F.col(score)
    return rows.agg(F.avg(c).alias("mean"), F.count_if(c >= 0.8).alias("excellent"), F.count_if((c >= 0.6) & (c < 0.8)).alias("good"), F.count_if((c >= 0.4) & (c < 0.6)).alias("fair"), F.count_if(c < 0.4).alias("poor"))


def variant_deltas(rows: DataFrame, variant: str, value: str, baseline: str) -> DataFrame:
    """Mean for each variant, its difference and relative difference to the baseline (null if that is 0)."""
    means = rows.groupBy(F.col(variant).alias("variant")).agg(F.avg(value).alias("mean"))
    base = means.where(F.col("variant") == baseline).select(F.col("mean").alias("base"))
    return means.join(base, F.lit(True), "left").select("variant", "mean", (F.col("mean") - F.col("base")).alias("delta"), F.when(F.col("base") != 0, (F.col("mean") - F.col("base")) / F.abs("base")).alias("relative"))


def no_answer_rate(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Share of queries without any result."""
    seen = results.select("query_id").distinct().withColumn("any", F.lit(True))
    return queries.select("query_id").join(seen, "query_id", "left").agg(F.count("*").alias("queries"), F.avg(F.col("any").isNull().cast("double")).alias("empty_rate"))


def rrf_score(rank: Column, k: int = 60, weight: float = 1.0) -> Column:
    """1 / (k + rank), weighted; 0 for a rank of 0 or null, which stand for absence."""
    return F.when(rank > 0, F.lit(weight) / (k + rank)).otherwise(0.0)


def verdict_map(results: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """(task_id, axis, verdict) of results with a column for each axis, an array of (item_id, verdict): supported or not_supported.

    ``keys`` and the item make the task's id. Axes become rows by ``unpivot``; null arrays have no rows.
    """
    rows = results.unpivot(keys, axes, "axis", "items").select(*keys, "axis", F.explode("items").alias("item"))
    task = F.concat_ws(":", *(F.col(k).cast("string") for k in keys), "axis", F.col("item.item_id").cast("string"))
    return rows.select(task.alias("task_id"), "axis", F.when(F.col("item.verdict") == "supported", "supported").otherwise("not_supported").alias("verdict"))


def kappa_by(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, agreement, kappa) for each value of ``by``, from one aggregation; kappa is 1 if chance alone would agree always."""
    joint = pairs.groupBy(by, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    sides = joint.select(by, F.col("x").alias("v"), F.col("n").alias("p"), F.lit(0).alias("q")).union(joint.select(by, "y", F.lit(0), "n"))
    chance = sides.groupBy(by, "v").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).groupBy(by).agg(F.sum(F.col("p") * F.col("q")).alias("c"))
    total = joint.groupBy(by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    observed, expected = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.join(chance, by).select(by, "n", observed.alias("agreement"), F.when(expected < 1, (observed - expected) / (1 - expected)).otherwise(1.0).alias("kappa"))


def verdict_table(verdicts: DataFrame, axes: list[str]) -> DataFrame:
    """(verdict, one column for each axis): numbers of tasks, by ``pivot`` with the given axes."""
    return verdicts.groupBy("verdict").pivot("axis", axes).agg(F.count("*")).fillna(0)
