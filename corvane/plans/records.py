"""Registered queries: relational records, conversations, metrics, statistics, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversations, metrics, registry, stats
from ..operators import evidence as ev
from ..operators.ingest import orphans
from ..streaming import ratelimit, windows
from ..storage import fresh_path
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query


@query("select c_custkey, c_name, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def users_with_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, nations as departments, regions as their parents."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("""with ur as (select c_custkey as user_id, case c_nationkey % 3 when 0 then 'admin' when 1 then 'editor' else 'viewer' end as role from customer)
select c_custkey as user_id from customer where exists (select 1 from ur where ur.user_id = c_custkey and role in ('admin', 'editor'))""")
def users_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who may write documents."""
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    roles = users.select("user_id", F.get(F.array(F.lit("admin"), F.lit("editor"), F.lit("viewer")), F.col("c_nationkey") % 3).alias("role"))
    permissions = registry.expanded_permissions({"editor": {"document": ["read", "write"]}, "viewer": {"document": ["read"]}}, spark)
    return registry.allowed(users.select("user_id"), roles, permissions, "document", "write")


@query("select r_name, count(n_name) as nations, string_agg(n_name, ',' order by n_name) as names from region left join nation on n_regionkey = r_regionkey group by r_name")
def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with the joined names in order."""
    r, n = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    return r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy("r_name").agg(F.count("n_name").alias("nations"), F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orphans(load(spark, sf_dir, "lineitem"), "l_orderkey", closed, "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as experiments, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'O') as open_tasks from customer""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each project, pre-aggregated and left-joined."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("experiments"), F.count_if(F.col("o_orderstatus") == "O").alias("open_tasks"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0)


@query("""select o_orderkey from orders where o_orderstatus = 'P' or o_custkey % 100 = 7 or o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3)""")
def accessible_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public projects, own ones, and those one is a member of."""
    members = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' and c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("member"))
    rows = load(spark, sf_dir, "orders").join(members, "o_custkey", "left")
    return rows.where((F.col("o_orderstatus") == "P") | (F.col("o_custkey") % 100 == 7) | F.col("member")).select("o_orderkey")


_VERSIONS = """select o_custkey as doc_id, o_orderkey as version_id, 'v1.' || (o_orderkey % 12) || '.' || (o_orderkey % 5) as version, o_orderdate as created_at,
  case o_orderstatus when 'F' then 'archived' when 'O' then 'active' else 'draft' end as status from orders"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    version = F.concat(F.lit("v1."), (k % 12).cast("string"), F.lit("."), (k % 5).cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "active").otherwise("draft")
    return load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("version_id"), version.alias("version"), F.col("o_orderdate").alias("created_at"), status.alias("status"), F.col("o_orderdate").alias("effective_date"))


@query(f"select doc_id, version_id from (select *, row_number() over (partition by doc_id order by created_at desc, version_id desc) as n from ({_VERSIONS}) where status in ('active', 'draft')) where n = 1")
def versions_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.current_versions(_versions(spark, sf_dir)).select("doc_id", "version_id")


_KEY = "(split_part({v}, '.', 2)::int * 1000 + split_part({v}, '.', 3)::int)"


@query(f"""with v as ({_VERSIONS}), a as (select doc_id, max(version_id) + 1000000 as version_id, 'v1.6.2' as version, timestamp '1995-01-01' as eff from v group by doc_id)
select a.doc_id, a.version_id, v.version_id as live_id, case when {_KEY.format(v="a.version")} < {_KEY.format(v="v.version")} then 'older_conflict' when eff < created_at then 'date_conflict' else 'newer_override' end as conflict
from a join v on a.doc_id = v.doc_id where v.status in ('active', 'draft') and {_KEY.format(v="a.version")} != {_KEY.format(v="v.version")}""")
def versions_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir)
    arriving = v.groupBy("doc_id").agg((F.max("version_id") + 1_000_000).alias("version_id")).withColumn("version", F.lit("v1.6.2")).withColumn("effective_date", F.lit("1995-01-01").cast("timestamp_ntz"))
    return registry.version_conflicts(v, arriving)


@query(f"""with v as ({_VERSIONS}), live as (select doc_id, max({_KEY.format(v="version")}) as top from v where status in ('active', 'draft') group by doc_id),
a as (select d.doc_id, d.doc_id + 10000000 as version_id, case when 6002 < coalesce(top, 0) then 'rejected' else 'active' end as status from (select distinct doc_id from v) d left join live using (doc_id))
select v.doc_id, v.version_id, case when a.status = 'active' and v.status in ('active', 'draft') then 'superseded' else v.status end as status, case when a.status = 'active' and v.status in ('active', 'draft') then a.version_id end as superseded_by from v join a using (doc_id)
union all select doc_id, version_id, status, null from a""")
def versions_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After v1.6.2 of every document arrived: rejected where a later one is live, else active, with others superseded."""
    v = _versions(spark, sf_dir)
    arriving = v.select("doc_id").distinct().select("doc_id", (F.col("doc_id") + 10_000_000).alias("version_id"), F.lit("v1.6.2").alias("version"))
    return registry.published(v, arriving).select("doc_id", "version_id", "status", "superseded_by")


@query("""select s.status, count(event_id) as n from (values ('click'), ('view'), ('purchase'), ('refund'), ('unheard')) as s(status) left join events on event_type = s.status group by s.status""")
def jobs_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for each state, also those without any."""
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("status"))
    return registry.zero_filled(rows, "status", ("click", "view", "purchase", "refund", "unheard"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(load(spark, sf_dir, "events"), "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "event_type")


@query("select o_orderkey, least(30.0, pow(2, o_orderkey % 6) * 2)::double as seconds from orders")
def jobs_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", registry.backoff(F.col("o_orderkey") % 6).alias("seconds"))


@query("select event_id, user_id, (select count(*) from events where event_type = 'click') as total from events where event_type = 'click' order by ts desc, event_id limit 20 offset 20")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of twenty, with the number of all rows."""
    rows = load(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    return registry.page(rows, [F.col("ts").desc(), "event_id"], 2, 20).drop("ts")


@query("select o_orderkey, row_number() over (order by case left(o_orderpriority, 1) when '1' then 0 when '2' then 1 else 2 end, o_orderdate desc, o_orderkey) as place from orders qualify place <= 100")
def tasks_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred first tasks: a top-k report."""
    first = F.substring("o_orderpriority", 1, 1)
    order = F.when(first == "1", 0).when(first == "2", 1).otherwise(2)
    top = load(spark, sf_dir, "orders").select("o_orderkey", order.alias("p"), "o_orderdate").orderBy("p", F.col("o_orderdate").desc(), "o_orderkey").limit(100)
    from pyspark.sql import Window as W

    return top.select("o_orderkey", F.row_number().over(W.orderBy("p", F.col("o_orderdate").desc(), "o_orderkey")).cast("long").alias("place"))


@query("select user_id, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'view') as \"view\", count(*) as total from events group by user_id")
def feedback_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return rows.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "view")), F.count("*").alias("total"))


@query("select n_nationkey as id, '/' || r_name || '/' || n_name as path from nation join region on n_regionkey = r_regionkey union all select -1 - r_regionkey, '/' || r_name from region")
def department_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    tree = region.select((-1 - F.col("r_regionkey")).alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    tree = tree.unionByName(nation.select(F.col("n_nationkey").alias("id"), (-1 - F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name")))
    return registry.department_paths(tree)


@query("select o_orderkey, case when n > 1 then o_orderpriority || '-' || n else o_orderpriority end as slug from (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) as n from orders)")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slug"))
    return registry.unique_slugs(rows, "slug", "o_orderkey")


@query("""with p as (select p_brand as chain_id, p_partkey as id, p_size as published_at from part)
select id, row_number() over w as version, lead(published_at) over w as valid_to, case when lead(published_at) over w is null then 'active' else 'superseded' end as status from p window w as (partition by chain_id order by published_at, id)""")
def knowledge_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select(F.col("p_brand").alias("chain_id"), F.col("p_partkey").alias("id"), F.col("p_size").alias("published_at"))
    return registry.superseded_chain(rows).select("id", F.col("version").cast("long").alias("version"), "valid_to", "status")


_CLAIMS = """claims as (select o_orderkey as run_id, o_orderkey as claim_id, case when o_orderkey % 7 = 0 then [] when o_orderkey % 5 = 0 then [1, 99] else [1] end as source_ids from orders),
evidence as (select distinct l_orderkey as run_id, l_linenumber as source_id from lineitem)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    ids = F.when(k % 7 == 0, F.array().cast("array<int>")).when(k % 5 == 0, F.array(F.lit(1), F.lit(99))).otherwise(F.array(F.lit(1)))
    claims = load(spark, sf_dir, "orders").select(k.alias("run_id"), k.alias("claim_id"), ids.alias("source_ids"))
    return claims, load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("source_id")).distinct()


@query(f"""with {_CLAIMS}, x as (select run_id, claim_id, unnest(source_ids) as source_id from claims),
c as (select claims.run_id, claims.claim_id, count(x.source_id) as n_cited, count(*) filter (x.source_id is not null and e.source_id is null) as n_unknown
  from claims left join x using (run_id, claim_id) left join evidence e on e.run_id = x.run_id and e.source_id = x.source_id group by all)
select *, case when n_cited = 0 then 'missing_citation' when n_unknown > 0 then 'invalid_source' end as issue from c""")
def evidence_claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with a claim each, line items as their evidence."""
    return ev.claim_issues(*_claims(spark, sf_dir))


@query(f"""with {_CLAIMS}, c as (select distinct run_id, unnest(source_ids) as source_id from claims)
select e.run_id, count(*) as n_evidence, count(c.source_id) as n_cited, round(count(c.source_id) / count(*), 6) as coverage from evidence e left join c on c.run_id = e.run_id and c.source_id = e.source_id group by e.run_id""")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coverage(*_claims(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6)).withColumn("n_cited", F.col("n_cited").cast("long"))


@query("""select conv_id, turn, position from (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as position from conversations) where position <= 5""")
def conversation_last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.last_messages(load(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "position")


@query("""select conv_id, turn, substr(last_value(case when role = 'user' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 1, 120) as anchor from conversations""")
def conversation_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user message before each message."""
    return conversations.with_anchor(load(spark, sf_dir, "conversations")).select("conv_id", "turn", "anchor")


@query("select conv_id, count(*) as messages, count(*) filter (role = 'user') as user_messages, arg_min(text, turn) filter (role = 'user') as first_message from conversations group by conv_id")
def conversation_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.session_overview(load(spark, sf_dir, "conversations"))


@query("""with r as (select *, row_number() over (partition by conv_id order by turn desc) as p from conversations), h as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as position from r where p <= 10 and contains(lower(text), 'the'))
select conv_id, turn, position from h where position <= 3""")
def conversation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.search(load(spark, sf_dir, "conversations"), "the").select("conv_id", "turn", "position")


@query("""with b as (select conv_id, turn, text, 600 - (sum(length(text) + 2) over (partition by conv_id order by turn) - length(text) - 2) as rest from conversations)
select conv_id, turn, length(case when length(text) + 2 <= rest then text else substr(text, 1, rest::bigint) end) as kept from b where length(text) + 2 <= rest or rest > 50""")
def conversation_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that fit in 600 characters of each session."""
    return conversations.within_budget(load(spark, sf_dir, "conversations"), 600, "conv_id", "turn").select("conv_id", "turn", F.length("kept").cast("long").alias("kept"))


#: Rankings of ten: for each label, vectors in order of a hash of their ids; relevant are those with an even id and the label.
_RANKED = """results as (select query_id, doc_id, rank from (select l.label as query_id, vec_id as doc_id, row_number() over (partition by l.label order by (vec_id * 7919) % 1009, vec_id) as rank from embeddings cross join (select unnest(range(0, 12)) as label) l) where rank <= 10),
relevant as (select label::bigint as query_id, vec_id as doc_id from embeddings where vec_id % 2 = 0 and label != 3)"""


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    vectors = load(spark, sf_dir, "embeddings")
    rows = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("query_id"), F.col("vec_id").alias("doc_id"))
    order = W.partitionBy("query_id").orderBy((F.col("doc_id") * 7919) % 1009, "doc_id")
    results = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return results, vectors.where("vec_id % 2 = 0 and label != 3").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"))


def _metrics_sql(none: str) -> str:
    return f"""with {_RANKED}, n as (select query_id, count(*) as n_rel from relevant group by 1),
h as (select r.query_id, rank, case when g.doc_id is null then 0 else 1 end as rel from results r left join relevant g using (query_id, doc_id)),
s as (select *, sum(rel) over (partition by query_id order by rank) as hits from h),
a as (select query_id, min(rank) filter (rel = 1) as first_rank, sum(rel * hits / rank) as precisions, sum(rel) filter (rank <= 5) as n5, coalesce(sum(rel / log2(rank + 1)) filter (rank <= 5), 0) as dcg5 from s group by 1),
b as (select q.query_id, coalesce(n_rel, 0) as n_rel, first_rank, precisions, n5, dcg5 from (select query_id from a union select query_id from n) q left join a using (query_id) left join n using (query_id))
select query_id, case when n_rel > 0 then round(n5 / n_rel, 6) else {none} end as recall_5, round(n5 / 5, 6) as precision_5, case when n_rel > 0 then (n5 > 0)::double else {none} end as hit_5,
  case when n_rel > 0 then round(dcg5 / list_sum(list_transform(range(1, least(n_rel, 5) + 1), lambda i: 1 / log2(i + 1))), 6) else {none} end as ndcg_5,
  round(coalesce(1 / first_rank, 0), 6) as mrr, case when n_rel > 0 then round(precisions / n_rel, 6) else {none} end as ap from b"""


def _rounded_metrics(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall_5", "precision_5", "hit_5", "ndcg_5", "mrr", "ap")))


@query(_metrics_sql("1.0"))
def metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics where queries without relevant documents count as perfect."""
    return _rounded_metrics(metrics.ir_metrics(*_ranked(spark, sf_dir), empty="one"))


@query(_metrics_sql("0.0"))
def metrics_per_query_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(metrics.ir_metrics(*_ranked(spark, sf_dir), empty="zero"))


@query(_metrics_sql("null"))
def metrics_per_query_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_metrics(metrics.ir_metrics(*_ranked(spark, sf_dir), empty="null"))


@query(f"select count(*) as queries, round(avg(recall_5), 6) as recall_5, round(avg(mrr), 6) as mrr, round(avg(ap), 6) as ap from ({_metrics_sql('0.0')})")
def metrics_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = metrics.mean_metrics(_rounded_metrics(metrics.ir_metrics(*_ranked(spark, sf_dir), empty="zero")))
    return means.select("queries", *(F.round(c, 6).alias(c) for c in ("recall_5", "mrr", "ap")))


@query("""with e as (select event_type as e, case when event_id % 5 = 0 then 'click' else event_type end as a from events), l as (select distinct e as label from e union select distinct a from e),
c as (select label, (select count(*) from e where e = label and a = label) as tp, (select count(*) from e where e != label and a = label) as fp, (select count(*) from e where e = label and a != label) as fn from l)
select label, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c""")
def metrics_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("e"), F.when(F.col("event_id") % 5 == 0, "click").otherwise(F.col("event_type")).alias("a"))
    out = metrics.confusion(rows, "e", "a")
    return out.select("label", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""with p as (select quality as x, toxic as y from labels), t as (select count(*) as n, count(*) filter (x = y) as same from p),
c as (select sum(a.n * b.n) as c from (select x as v, count(*) as n from p group by 1) a join (select y as v, count(*) as n from p group by 1) b using (v))
select n, round(same / n, 6) as agreement, round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) as kappa from t, c""")
def metrics_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kappa(load(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""with r as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events where value is not null)
select (select value from r where i = floor((n - 1) * 0.95) limit 1) as floor_95, (select value from r where i = ceil(n * 0.95) - 1 limit 1) as ceil_95, (select value from r where i = floor(n * 0.99) limit 1) as int_99""")
def metrics_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conventions of an exact percentile."""
    rows = load(spark, sf_dir, "events")
    parts = [metrics.percentile(rows, "value", f, rule).select(F.lit(1).alias("k"), F.col("percentile").alias(n)) for f, rule, n in ((0.95, "floor", "floor_95"), (0.95, "ceil", "ceil_95"), (0.99, "int", "int_99"))]
    return parts[0].join(parts[1], "k").join(parts[2], "k").drop("k")


@query("select round(avg(s), 6) as mean, count(*) filter (s >= 0.8) as excellent, count(*) filter (s >= 0.6 and s < 0.8) as good, count(*) filter (s >= 0.4 and s < 0.6) as fair, count(*) filter (s < 0.4) as poor from (select (l_discount * 10) as s from lineitem)")
def metrics_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("s"))
    return metrics.score_buckets(rows, "s").withColumn("mean", F.round("mean", 6))


@query("""with m as (select event_type as variant, avg(value) as mean from events group by 1), b as (select mean as base from m where variant = 'view')
select variant, round(mean, 6) as mean, round(mean - base, 6) as delta, round((mean - base) / abs(base), 6) as relative from m, b""")
def metrics_variant_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.variant_deltas(load(spark, sf_dir, "events"), "event_type", "value", "view")
    return out.select("variant", *(F.round(c, 6).alias(c) for c in ("mean", "delta", "relative")))


@query("select count(*) as queries, round(avg((n = 0)::int), 6) as empty_rate from (select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer)")
def metrics_no_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"))
    results = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"))
    return metrics.no_answer_rate(queries, results).withColumn("empty_rate", F.round("empty_rate", 6))


@query("""select unnest(['p_size', 'p_retailprice', 'p_brand']) as "column", unnest([0, 0, 0])::bigint as missing, (select count(*) from part) as filled, unnest([(select count(distinct p_size) from part), (select count(distinct p_retailprice) from part), (select count(distinct p_brand) from part)]) as "distinct", unnest(['number', 'number', 'text']) as kind,
  unnest([(select min(p_size)::double from part), (select min(p_retailprice) from part), null]) as minimum, unnest([(select max(p_size)::double from part), (select max(p_retailprice) from part), null]) as maximum,
  unnest([(select round(avg(p_size), 6) from part), (select round(avg(p_retailprice), 6) from part), null]) as mean""")
def stats_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile(load(spark, sf_dir, "part").select("p_size", "p_retailprice", "p_brand")).withColumn("mean", F.round("mean", 6))


@query("select l_returnflag, round(avg(l_quantity), 6) as value, 0::bigint as skipped from lineitem group by 1")
def stats_group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.group_aggregate(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "mean").withColumn("value", F.round("value", 6))


@query("select count(o_totalprice) as n, round(avg(o_totalprice), 6) as mean, round(median(o_totalprice), 6) as median, min(o_totalprice) as minimum, max(o_totalprice) as maximum, round(stddev_pop(o_totalprice), 6) as deviation from orders")
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(load(spark, sf_dir, "orders"), "o_totalprice")


@query("select (select count(*) from (select event_type, user_id from events)) - (select count(*) from (select distinct event_type, user_id from events)) as duplicates")
def stats_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicate_rows(load(spark, sf_dir, "events").select("event_type", "user_id"))


@query("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def stats_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select p_brand, p_size, count(*) as n, grouping_id(p_brand, p_size) as level from part group by rollup(p_brand, p_size)")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("select c_nationkey as k, 'both' as side from customer intersect select s_nationkey, 'both' from supplier union all (select c_nationkey, 'customer' from customer except select s_nationkey, 'customer' from supplier)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("customer")))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.event_stream(spark, sf_dir, load(spark, sf_dir, "events").schema, "events.parquet")


def _finished(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    base = fresh_path(spark, "stream")
    windows.run_to_end(result, f"{base}/table", f"{base}/checkpoint", mode)
    return spark.read.parquet(f"{base}/table")


def _untimed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end") if c in df.columns})


@query("""select time_bucket(interval '1 day', ts) as start, time_bucket(interval '1 day', ts) + interval '1 day' as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind, as a stream run to its end."""
    return _untimed(_finished(spark, windows.tumbling(_stream(spark, sf_dir), "1 day", "event_type"), "complete")).withColumn("total", F.round("total", 4))


@query("""with e as (select event_type, value, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as start from events)
select start, start + interval '2 hours' as "end", event_type, count(*) as n, round(sum(value), 4) as total from e group by all""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untimed(_finished(spark, windows.sliding(_stream(spark, sf_dir), "2 hours", "1 hour", "event_type"), "complete")).withColumn("total", F.round("total", 4))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as opens from events),
s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n, round(sum(value), 4) as total from s group by user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untimed(_finished(spark, windows.sessions(_stream(spark, sf_dir), "6 hours", "user_id"), "complete")).withColumn("total", F.round("total", 4))


@query("select count(*) as n, count(distinct event_id) as keys from events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events twice in one stream, deduplicated."""
    once = _stream(spark, sf_dir)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = _finished(spark, windows.deduplicated(twice, "event_id").drop("copy"), "append")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("keys"))


@query("select c_mktsegment, count(*) as n from events left join customer on user_id = c_custkey group by 1")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = _finished(spark, windows.with_static(_stream(spark, sf_dir), users, "user_id").select("event_id", "c_mktsegment"), "append")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, event_id, ts, n, true as allowed, cast(null as timestamp) as older, ts as newer from e where n = 1
  union all select e.user_id, e.event_id, e.ts, e.n, r.older is null or r.older <= e.ts - interval '1 hour',
    case when r.older is null or r.older <= e.ts - interval '1 hour' then r.newer else r.older end, case when r.older is null or r.older <= e.ts - interval '1 hour' then e.ts else r.newer end
  from r join e on e.user_id = r.user_id and e.n = r.n + 1)
select cast(user_id as varchar) as key, event_id, ts, allowed from r""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests of a user an hour; tests hold the decisions against a plain loop."""
    base = fresh_path(spark, "stream")
    ratelimit.limit_stream(_stream(spark, sf_dir), "user_id", 2, 3600, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table/decisions").drop("generation").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select event_id, (select count(*) from events o where o.user_id = e.user_id and o.ts > e.ts - interval '1 hour' and o.ts <= e.ts) as in_window from events e")
def events_sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratelimit.sliding_counts(load(spark, sf_dir, "events"), "user_id", 3600).select("event_id", "in_window")
