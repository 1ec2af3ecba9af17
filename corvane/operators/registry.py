"""Versions, jobs, sessions, feedback, projects, users: records as event logs and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import version_key
from ..storage import stored
from .ordered import numbered, with_next

JOB_STATES = ("pending", "running", "completed", "failed", "retrying")


def current_versions(versions: DataFrame) -> DataFrame:
    """The newest active or draft version of each document."""
    order = W.partitionBy("doc_id").orderBy(F.col("created_at").desc(), F.col("version_id").desc())
    live = versions.where(F.col("status").isin("active", "draft"))
    return live.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def published(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """Versions after publishing ``arriving`` (doc_id, version_id, version, ...).

    A version older than a live one of its document is rejected; an id that exists is not
    published again. Of the rest the greatest becomes active, other live ones superseded.
    """
    live = versions.where(F.col("status").isin("active", "draft")).groupBy("doc_id").agg(F.max(version_key("version")).alias("_live"))
    fresh = arriving.join(versions.select("version_id"), "version_id", "left_anti").join(live, "doc_id", "left")
    fresh = fresh.withColumn("status", F.when(version_key("version") < F.col("_live"), "rejected").otherwise("active")).drop("_live")
    both = versions.unionByName(fresh, allowMissingColumns=True)
    winners = fresh.where("status = 'active'").groupBy("doc_id").agg(F.max(F.struct(version_key("version").alias("k"), "version_id"))["version_id"].alias("_winner"))
    beaten = F.col("_winner").isNotNull() & F.col("status").isin("active", "draft") & (F.col("version_id") != F.col("_winner"))
    changed = {"status": F.when(beaten, "superseded").otherwise(F.col("status")), "superseded_by": F.when(beaten, F.col("_winner"))}
    return both.join(winners, "doc_id", "left").withColumns(changed).drop("_winner")


def version_conflicts(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """How arriving versions conflict with live ones of the same document: older_conflict, newer_override or date_conflict."""
    live = versions.where(F.col("status").isin("active", "draft")).select("doc_id", F.col("version_id").alias("live_id"), F.col("version").alias("live_version"), F.col("effective_date").alias("live_date"))
    pairs = arriving.join(live, "doc_id").where("version_id != live_id")
    return pairs.withColumn("conflict", _conflict()).where("conflict is not null").select("doc_id", "version_id", "live_id", "conflict")


def _conflict() -> Column:
    a, b = version_key("version"), version_key("live_version")
    return F.when(a < b, "older_conflict").when((a > b) & (F.col("effective_date") < F.col("live_date")), "date_conflict").when(a > b, "newer_override")


def _conflict_kinds(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """(version_id, conflict) as ``version_conflicts`` has them, without a row for each pair.

    Rows of a document with one version and date conflict alike, so only these classes are compared. Of the live ids
    the least and the greatest tell whether one is another than the arriving row's own.
    """
    columns = ["doc_id", "version", "effective_date"]
    live = versions.where(F.col("status").isin("active", "draft")).groupBy(*columns).agg(F.min("version_id").alias("_least"), F.max("version_id").alias("_most"))
    live = live.select("doc_id", F.col("version").alias("live_version"), F.col("effective_date").alias("live_date"), "_least", "_most")
    kinds = arriving.select(*columns).distinct().join(live, "doc_id").withColumn("conflict", _conflict()).where("conflict is not null")
    kinds = kinds.groupBy(*columns, "conflict").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))
    kinds = kinds.select(*(F.col(c).alias(f"_{c}") for c in columns), "conflict", "_least", "_most")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))
    found = arriving.select(*columns, "version_id").join(kinds, same)
    return found.where("version_id != _least or version_id != _most").select("version_id", "conflict")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def job_states(events: DataFrame) -> DataFrame:
    """Current state of each job from its events (job_id, at, event, attempt)."""
    state = F.max(F.struct("at", "attempt", "event"))
    return events.groupBy("job_id").agg(state.alias("s"), F.min("at").alias("created_at")).select("job_id", "s.event", "s.attempt", F.col("s.at").alias("updated_at"), "created_at")


def recovered(jobs: DataFrame, now: Column, stale_seconds: int = 900, max_attempts: int = 3) -> DataFrame:
    """Running jobs without news for ``stale_seconds`` go back to retrying, or fail after the last attempt."""
    stale = (F.col("event") == "running") & (F.unix_timestamp(now) - F.unix_timestamp("updated_at") > stale_seconds)
    return jobs.withColumn("event", F.when(stale & (F.col("attempt") >= max_attempts), "failed").when(stale, "retrying").otherwise(F.col("event")))


def next_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The oldest pending or retrying jobs."""
    return jobs.where(F.col("event").isin("pending", "retrying")).orderBy("created_at", "job_id").limit(n)


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Numbers of rows for each of the values, 0 included."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def backoff(attempt: Column, most: int = 30) -> Column:
    """Seconds before the next attempt: 2 * 2^attempt, at most ``most``."""
    return F.least(F.lit(float(most)), F.pow(F.lit(2.0), attempt) * 2)


def department_paths(departments: DataFrame) -> DataFrame:
    """Rows (id, path): names from the root down, joined by slashes, for any depth; path is null in and below a cycle, and below an id that does not exist.

    Each level is a table, so that the lineage does not grow with the depth. An id that
    stands in several rows is an error: it could be below itself.
    """
    if repeated := departments.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").first():
        raise ValueError(f"department {repeated.id!r} stands in {repeated.n} rows")
    children = departments.select("id", "parent_id", "name")
    level = stored(children.where("parent_id is null").select("id", F.concat(F.lit("/"), F.col("name")).alias("path")), "departments")
    found = []
    while not level.isEmpty():
        found.append(level)
        below = level.select(F.col("id").alias("parent_id"), "path")
        level = stored(children.join(below, "parent_id").select("id", F.concat("path", F.lit("/"), "name").alias("path")), "departments")
    reached = reduce(DataFrame.union, found, level)
    return departments.select("id").join(reached, "id", "left")


def unique_slugs(rows: DataFrame, slug: str, order: str) -> DataFrame:
    """Equal slugs get -2, -3, ... in the given order; as many rows as there are may share one."""
    n = F.col("_number")
    return numbered(rows, [slug], [order], "_number").withColumn(slug, F.when(n > 1, F.concat(F.col(slug), F.lit("-"), n.cast("string"))).otherwise(F.col(slug))).drop("_number")


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """One page in a total order, with the number of all rows as ``total``."""
    size = min(max(size, 1), 100)
    total = rows.count()
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def expanded_permissions(roles: dict[str, dict[str, list[str]]], spark) -> DataFrame:
    """Rows (role, resource, action) of a nested mapping."""
    rows = [(r, s, a) for r, resources in roles.items() for s, actions in resources.items() for a in actions]
    return spark.createDataFrame(rows, "role string, resource string, action string")


def allowed(users: DataFrame, user_roles: DataFrame, permissions: DataFrame, resource: str, action: str, admin: str = "admin") -> DataFrame:
    """Users who may do something: administrators, and those with a role that has the permission."""
    grants = permissions.where((F.col("resource") == resource) & (F.col("action") == action)).select("role").distinct()
    able = user_roles.join(grants, "role", "left_semi").unionByName(user_roles.where(F.col("role") == admin)).select("user_id").distinct()
    return users.join(able, "user_id", "left_semi")


def superseded_chain(records: DataFrame) -> DataFrame:
    """Knowledge records as slowly changing rows: version numbers by chain, valid_to where the next begins."""
    order = ["published_at", "id"]
    rows = with_next(numbered(records, ["chain_id"], order, "version"), ["chain_id"], order, ["published_at"])
    return rows.withColumnRenamed("next_published_at", "valid_to").withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def replacements(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` (asked_doc_id, asked_version_id, and a version's columns) with ``problem`` and ``warnings``, before anything is replaced.

    identity: the version is not of the document or not the one asked for; older: a live version is newer. Warnings are
    the kinds of other conflicts, sorted. Rows without a problem may go to ``published``.
    """
    other = ~(F.col("asked_doc_id").eqNullSafe(F.col("doc_id")) & F.col("asked_version_id").eqNullSafe(F.col("version_id")))
    found = _conflict_kinds(versions, arriving).groupBy("version_id").agg(F.array_sort(F.collect_set("conflict")).alias("_kinds"))
    none = F.array().cast("array<string>")
    kinds = F.coalesce("_kinds", none)
    problem = F.when(F.array_contains(kinds, "older_conflict"), "older").when(other, "identity")
    return arriving.join(found, "version_id", "left").withColumn("problem", problem).withColumn("warnings", F.array_except(kinds, F.array(F.lit("older_conflict")))).drop("_kinds")


def archived_and_replaced(versions: DataFrame, arriving: DataFrame) -> DataFrame:
    """Versions after those of ``arriving`` without a problem have been published."""
    good = replacements(versions, arriving).where("problem is null").select(arriving.columns).drop("asked_doc_id", "asked_version_id")
    return published(versions, good)
