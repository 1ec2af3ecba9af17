"""How the recall gate joins claims."""

from pyspark.sql import functions as F

from corvane.operators import memory


def test_claims_made_of_few_rows_are_not_broadcast(spark):
    """The estimated size of exploded rows is that of what they are made of, so claims are never sent whole to each task."""
    claims = spark.range(10).select(F.col("id").cast("string").alias("run_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("claim_id"), F.lit("p").alias("project_id"), F.array(F.lit("S1")).alias("source_ids"), F.lit(True).alias("readable"))
    memories = claims.drop("readable").selectExpr("*", "'note' memory_type", "'user' scope", "'PASS' review_decision", "true user_confirmed", "true verified")
    gated = memory.recall_gate(memories, claims, F.lit(True))
    assert "BroadcastHashJoin" not in gated._jdf.queryExecution().executedPlan().toString()
    assert gated.count() == 20
