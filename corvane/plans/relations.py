"""Registered queries: users, roles and permissions, on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ingest, registry
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query

PERMISSIONS = {"admin": {"document": ["read", "write", "delete"], "user": ["manage"]}, "editor": {"document": ["read", "write"]}, "viewer": {"document": ["read"]}}
_PERMISSIONS = ", ".join(f"('{r}', '{s}', '{a}')" for r, resources in PERMISSIONS.items() for s, actions in resources.items() for a in actions)
_ROLES = "select c_custkey as user_id, case c_nationkey % 3 when 0 then 'admin' when 1 then 'editor' else 'viewer' end as role from customer"


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.get(F.array(F.lit("admin"), F.lit("editor"), F.lit("viewer")), F.col("c_nationkey") % 3)
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))


@query(f"select user_id, resource, action from ({_ROLES}) join (values {_PERMISSIONS}) as p(role, resource, action) using (role)")
def users_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user may do."""
    return _roles(spark, sf_dir).join(registry.expanded_permissions(PERMISSIONS, spark), "role").select("user_id", "resource", "action")


@query("""select s_suppkey as user_id, n_name as role, row_number() over (partition by r_name order by case r_name when 'EUROPE' then 0 else 1 end, case when n_nationkey % 2 = 0 then 0 else 1 end, n_name, s_suppkey) as place
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def users_roles_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with roles of three joined tables, in an order of their own."""
    s, n, r = (load(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    order = W.partitionBy("r_name").orderBy(F.when(F.col("r_name") == "EUROPE", 0).otherwise(1), F.when(F.col("n_nationkey") % 2 == 0, 0).otherwise(1), "n_name", "s_suppkey")
    return rows.select(F.col("s_suppkey").alias("user_id"), F.col("n_name").alias("role"), F.row_number().over(order).cast("long").alias("place"))


@query("""with target as (select c_custkey as id, c_name as name from customer where c_custkey % 3 != 0), legacy as (select distinct c_custkey as id, c_name || '!' as name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join orders on o_custkey = c_custkey where r_name = 'ASIA')
select id, name from target union all select id, name from legacy where id not in (select id from target)""")
def users_legacy_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of a joined legacy system, inserted where their id is new."""
    c, n, r, o = (load(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    target = c.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    asia = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"))
    legacy = c.join(asia, "c_nationkey").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return ingest.insert_missing(target, legacy.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("!")).alias("name")), "id")


@query(f"select user_id, role from ({_ROLES}) where not (user_id = (select min(c_custkey) from customer where c_nationkey % 3 = 1) and role = 'editor')")
def users_role_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's role taken away; both are looked up."""
    rows = _roles(spark, sf_dir)
    gone = rows.where("role = 'editor'").groupBy("role").agg(F.min("user_id").alias("user_id"))
    return rows.join(gone, ["user_id", "role"], "left_anti")


@query("""with d as (select source, md5(text) as h, length(text) as n, doc_id from documents), f as (select source, h, min(doc_id) as doc_id, any_value(n) as n from d group by all)
select d.source, count(*) as loaded, count(distinct d.h) as unique_texts, count(*) - count(distinct d.h) as duplicates, cast((select sum(greatest(cast(ceil((n - 150) / 1050.0) as bigint), 1)) from f where f.source = d.source) as bigint) as chunks from d group by d.source""")
def ingest_process_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, deduplicate and chunk each source, with what each step left; blank windows do not occur."""
    from ..operators import chunking

    docs = load(spark, sf_dir, "documents")
    unique = ingest.exact_duplicates(docs, "text", "doc_id", within="source")
    counts = docs.groupBy("source").agg(F.count("*").alias("loaded"))
    left = unique.groupBy("source").agg(F.count("*").alias("unique_texts"), F.sum(F.size(chunking.fixed_windows("text", 1200, 150))).alias("chunks"))
    return counts.join(left, "source").select("source", "loaded", "unique_texts", (F.col("loaded") - F.col("unique_texts")).alias("duplicates"), "chunks")
