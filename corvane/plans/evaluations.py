"""Registered queries: evaluation of answers and pipelines, and question rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation, evidence, ingest, retrieval
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query


@query("""with e as (select c_nationkey as query_id, c_custkey as doc_id from customer), h as (select distinct c_nationkey as query_id, c_custkey as doc_id from customer join orders on o_custkey = c_custkey and o_orderstatus = 'F'),
f as (select e.*, h.doc_id is not null as hit, e.doc_id % 7 != 0 and e.doc_id % 5 != 0 as eligible from e left join h using (query_id, doc_id))
select query_id, count(*) as n_expected, count(*) filter (eligible) as n_eligible, round(count(*) filter (hit) / count(*), 6) as recall, round(count(*) filter (hit and eligible) / nullif(count(*) filter (eligible), 0), 6) as eligible_recall from f group by query_id""")
def evaluation_eligible_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as queries, their customers as expected documents, those with a closed order as found."""
    customers = load(spark, sf_dir, "customer")
    expected = customers.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"))
    closed = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc_id"))
    results = expected.join(closed, "doc_id", "left_semi")
    out = evaluation.eligible_recall(expected, results, expected.where("doc_id % 7 != 0"), expected.where("doc_id % 5 != 0"))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "eligible_recall")})


@query("""select event_id, case when event_id % 11 = 0 then 'missing_document' when event_id % 7 = 0 then 'acl' when event_id % 5 = 0 then 'planning' when event_id % 40 > 10 then 'rerank' when event_id % 40 > 0 then 'unknown'
  when event_id % 3 = 0 then 'lexical' else 'semantic' end as reason from events""")
def evaluation_miss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rank = F.nullif(i % 40, F.lit(0).cast("long"))
    reason = evaluation.miss_reason(i % 11 != 0, i % 7 != 0, i % 5 != 0, rank, 10, F.when(i % 3 != 0, 1), F.lit(1))
    return load(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query("""with k as (select conv_id as case_id, turn as position, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key from conversations),
f as (select case_id, key, min(position) as position from k where key != '' group by all), n as (select *, row_number() over (partition by case_id order by position) as n from f)
select case_id, 'C' || n as claim_id, arg_min(k.text, k.position) as text from n join k using (case_id, key) where n <= 24 group by case_id, n""")
def evaluation_unique_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.unique_claims(load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("position"), "text"))


@query("""with v as (select l_orderkey as case_id, case l_linenumber % 3 when 0 then 'response' when 1 then 'gold' else 'context' end as axis, l_returnflag = 'N' as ok from lineitem),
s as (select case_id, avg(ok::int) filter (axis = 'response') as p, avg(ok::int) filter (axis = 'gold') as r, avg(ok::int) filter (axis = 'context') as f from v group by 1)
select case_id, round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as faithfulness, round(case when coalesce(p, 0) + coalesce(r, 0) > 0 then 2 * coalesce(p, 0) * coalesce(r, 0) / (coalesce(p, 0) + coalesce(r, 0)) else 0 end, 6) as f1 from s""")
def evaluation_claim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as verdicts on three axes."""
    axis = F.get(F.array(F.lit("response"), F.lit("gold"), F.lit("context")), F.col("l_linenumber") % 3)
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), axis.alias("axis"), F.when(F.col("l_returnflag") == "N", "supported").otherwise("contradicted").alias("verdict"))
    return evaluation.claim_scores(rows).select("case_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "faithfulness", "f1")))


@query("""select category, count(*) as n, round(avg(value), 6) as value, round(avg(value) filter (value > 0), 6) as positive from (
  select 'overall' as category, value from events union all select event_type, value from events union all select 'late', value from events where event_id % 10 = 0) group by 1""")
def evaluation_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping categories, and the mean above 0."""
    rows = load(spark, sf_dir, "events").withColumn("categories", F.when(F.col("event_id") % 10 == 0, F.array("event_type", F.lit("late"))).otherwise(F.array("event_type"))).withColumn("positive", F.when(F.col("value") > 0, F.col("value")))
    out = evaluation.by_category(rows, "categories", "value", "positive")
    return out.withColumns({c: F.round(c, 6) for c in ("value", "positive")})


@query("""with s as (select o_custkey as case_id, o_orderkey % 2 as label, max(floor(o_totalprice / 50000)) as score from orders group by all), m as (select *, case when (case_id + label) % 2 = 0 then 'new' else 'old' end as system from s),
t as (select *, score = max(score) over (partition by case_id) as top from m), u as (select *, sum(top::int) over (partition by case_id) as winners from t)
select system, count(*) as reviews, round(avg(score), 6) as mean, cast(sum((top and winners = 1)::int) as bigint) as wins from u group by 1""")
def evaluation_review_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 2).alias("label")).agg(F.max(F.floor(F.col("o_totalprice") / 50000)).alias("score"))
    mapping = rows.select("case_id", "label", F.when((F.col("case_id") + F.col("label")) % 2 == 0, "new").otherwise("old").alias("system"))
    return evaluation.review_wins(rows, mapping).withColumn("mean", F.round("mean", 6))


@query("""with r as (select user_id as query_id, event_type as variant, max(value) > 50 as hit from events group by all), b as (select query_id, hit as base from r where variant = 'view')
select variant, round(avg((not hit)::int) filter (base), 6) as lost, round(avg(hit::int) filter (not base), 6) as gained from r join b using (query_id) where variant != 'view' group by 1""")
def evaluation_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("variant")).agg((F.max("value") > 50).alias("hit"))
    return evaluation.regressions(rows, "view").withColumns({c: F.round(c, 6) for c in ("lost", "gained")})


@query("select event_type as kind, count(*) as requests, round(avg((event_id % 3 = 0)::int), 6) as hit_rate from events group by 1")
def evaluation_cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("hit"))
    return evaluation.hit_rate(rows).withColumn("hit_rate", F.round("hit_rate", 6))


@query("""with f as (select l_orderkey as query_id, 'p' || l_partkey as source, l_shipmode_ as excerpt, l_extendedprice as score from (select *, l_returnflag || l_linestatus as l_shipmode_ from lineitem)),
b as (select query_id, md5(source || chr(31) || excerpt) as key, max(score) as score, arg_max(source, score) as source from f group by all),
n as (select *, row_number() over (partition by query_id order by round(score, 9) desc, key) as n from b)
select query_id, 'S' || n as source_id, source, score from n where n <= 12""")
def evidence_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence of their orders, numbered by score."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat("l_returnflag", "l_linestatus").alias("excerpt"), F.col("l_extendedprice").alias("score"))
    return evidence.numbered_evidence(rows).select("query_id", "source_id", "source", "score")


@query("""with q as (select item_id as query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t, item_id % 3 as project_id from benchmark), r as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t, doc_id % 3 as project_id from documents where doc_id % 4 = 0 and doc_id % 5 != 0),
s as (select query_id, doc_id, least(0.99, len(list_intersect(q.t, r.t))::double / len(q.t)) as score from q join r using (project_id)), k as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s where score > 0)
select query_id, doc_id, rank, round(score, 6) as score from k where rank <= 2""")
def retrieval_project_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two best active records with sources of each query's project."""
    docs = load(spark, sf_dir, "documents")
    i = F.col("doc_id")
    records = docs.select(i.alias("id"), (i % 3).alias("project_id"), F.col("text").alias("statement"), F.when(i % 4 == 0, "active").otherwise("revoked").alias("status"), F.lit("extracted").alias("origin"), F.when(i % 5 != 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("source_ids"))
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("project_id"), F.col("text").alias("query"))
    return retrieval.project_knowledge(queries, records).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("select p_partkey, split_part(replace(p_name, ' ', '_'), '.', 1) as safe, 'other' as kind from part")
def text_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made safe, and the kind that their path tells."""
    path = F.concat(F.lit("/data/"), F.col("p_name"))
    return load(spark, sf_dir, "part").select("p_partkey", text.safe_filename(path).alias("safe"), text.doc_type_of(F.lit("/data/file.bin")).alias("kind"))


@query("select l_orderkey, l_linenumber from lineitem where l_orderkey % 3 != 0 union all select distinct l_orderkey + 100000000, l_linenumber from lineitem where l_orderkey % 3 = 0")
def ingest_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that exist are not inserted again."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    current = rows.where("l_orderkey % 3 != 0")
    new = rows.where("l_orderkey % 3 = 0").select((F.col("l_orderkey") + 100_000_000).alias("l_orderkey"), "l_linenumber", F.concat(F.lit("n"), "k").alias("k"))
    return ingest.insert_missing(current, current.limit(10).unionByName(new), "k").drop("k")
