"""Registered queries: files that are written from the tables and read by the sources, and the queue of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry
from ..sources import files
from ..storage import fresh_path
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query


@query("""select 'source=' || source as folder, sha256(string_agg(text, chr(10) order by doc_id) || chr(10)) as digest, 'txt' as file_type from documents group by source""")
def sources_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source as one text file in a folder of its own, read as a tree of folders."""
    folder = fresh_path(spark, "folder")
    docs = load(spark, sf_dir, "documents").select("source", "doc_id", "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(folder)
    rows = files.text_files(spark, folder, "*.txt")
    return rows.select(F.element_at(F.split("source", "/"), -2).alias("folder"), F.sha2("text", 256).alias("digest"), "file_type")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("select 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_mktsegment: ' || c_mktsegment as text from customer")
def sources_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV files, a document for each row."""
    path = fresh_path(spark, "csv")
    _customers(spark, sf_dir).write.option("header", "true").csv(path)
    return files.csv_rows(spark, path).select("text")


@query("""select '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' as text from customer""")
def sources_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON values, a document for each."""
    path = fresh_path(spark, "json")
    _customers(spark, sf_dir).write.json(path)
    return files.json_documents(spark, path, multiline=False).select("text")


@query("select conv_id, turn, role, text from conversations")
def sources_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through JSON lines and back: line ends and quotes in texts stay."""
    path = fresh_path(spark, "jsonl")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.json(path)
    return files.json_lines(spark, path, "conv_id long, turn long, role string, text string")


@query("select distinct sha256(text) as digest from documents where length(text) >= 250")
def sources_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which each e is struck over: long enough ones without the overstrikes, one of each content."""
    struck = load(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("e"), F.lit("_\be")).alias("text"))
    return files.usable_archives(struck).select(F.col("sha256").alias("digest"))


@query("""with j as (select user_id as job_id, min(ts) as created_at, arg_max(event_type, (ts, event_id)) as event from events where user_id is not null group by 1)
select job_id, event from j where event in (select min(event_type) from events union all select max(event_type) from events) order by created_at, job_id limit 10""")
def jobs_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten jobs that come next: users as jobs, whose first and last kinds of events mean that they wait."""
    events = load(spark, sf_dir, "events").where("user_id is not null")
    first, last = events.agg(F.min("event_type"), F.max("event_type")).first()
    name = F.when(F.col("event_type") == first, "pending").when(F.col("event_type") == last, "retrying").otherwise("running")
    states = registry.job_states(events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("attempt"), name.alias("event")))
    found = registry.next_jobs(states, 10)
    return found.select("job_id", F.when(F.col("event") == "pending", first).otherwise(last).alias("event"))
