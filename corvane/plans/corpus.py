"""Registered queries: ingestion, chunking, text functions, safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety, text, units
from ..operators import chunking, evidence, ingest, stats
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query


@query("select md5(text) as digest, min(doc_id) as first, count(*) as copies from documents group by 1")
def corpus_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document and number of copies of each text."""
    return ingest.first_of_equal(load(spark, sf_dir, "documents"), "text", "doc_id")


@query("select doc_id, source from (select doc_id, source, row_number() over (partition by source, md5(text) order by doc_id) as n from documents) where n = 1")
def corpus_dedup_within_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.exact_duplicates(load(spark, sf_dir, "documents"), "text", "doc_id", within="source").select("doc_id", "source")


@query("""with w as (select doc_id, text, unnest(range(0, greatest(cast(ceil((length(text) - 150) / 1050.0) as bigint), 1))) as i from documents)
select doc_id, i as chunk_index, i * 1050 as chunk_start, md5(substr(text, i * 1050 + 1, 1200)) as digest, length(substr(text, i * 1050 + 1, 1200)) as length
from w where length(trim(substr(text, i * 1050 + 1, 1200))) > 0""")
def chunks_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1200 characters that overlap by 150, of every whole document."""
    rows = chunking.fixed_chunks(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_index", "chunk_start", F.md5("chunk_text").alias("digest"), F.length("chunk_text").cast("long").alias("length"))


@query()
def chunks_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.recursive_chunks(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.enriched(rows).drop("chunk_text")


@query()
def chunks_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.budget_chunks(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("chunk_text")


@query()
def chunks_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in runs of ten as the sentences of a document."""
    rows = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("doc_id"), (F.col("vec_id") % 10).alias("position"), F.concat(F.lit("sentence number "), F.col("vec_id").cast("string")).alias("text"), "embedding")
    return chunking.semantic_chunks(rows, threshold=0.9, min_tokens=4)


@query("""with w as (select doc_id, text, sha256(text) as h, unnest(range(0, greatest(cast(ceil((length(text) - 150) / 1050.0) as bigint), 1))) as i from documents),
c as (select doc_id, i, h, substr(text, i * 1050 + 1, 1200) as chunk from w)
select doc_id, i as chunk_index, substr(h, 1, 20) || '-' || i || '-' || substr(md5(chunk || h || i), 1, 12) as chunk_id from c where length(trim(chunk)) > 0""")
def chunk_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all windows of every whole document."""
    rows = chunking.fixed_chunks(load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "text"))
    return rows.select("doc_id", "chunk_index", text.worker_chunk_id(F.col("h"), F.col("chunk_index"), F.col("chunk_text")).alias("chunk_id"))


@query("select doc_id, cast(floor(length(text) / 4) as bigint) as tokens from documents")
def text_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.token_estimate("text").alias("tokens"))


@query("""with t as (select doc_id, trim(text) as c, length(regexp_replace(trim(text), '[^A-Za-z0-9]', '', 'g')) as valid from documents)
select doc_id, length(c) < 15 or (length(c) - valid > 0.6 * length(c) and valid < 10) or (regexp_matches(c, '[-*•·.]{10,}') and valid < 5) as noise from t""")
def text_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.is_noise("text").alias("noise"))


@query("""with a as (select page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') as h from pages),
b as (select page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') as h from a),
c as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from b)
select page_id, md5(trim(regexp_replace(h, '[ \\t\\r\\n]+', ' ', 'g'))) as digest from c""")
def text_of_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text("html")).alias("digest"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as lines, count(*) filter (regexp_matches(line, '^#{1,6}\\s+\\S')) as headings from l group by doc_id""")
def text_outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and Markdown headings; the tables hold no fences."""
    rows = chunking.lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("level").alias("headings"))


@query("select item_id, md5(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))[1:220]) as digest from benchmark")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select("item_id", F.md5(text.snippet("text")).alias("digest"))


@query("select p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def text_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", text.slug("p_name").alias("slug"))


@query("select conv_id, turn, case when length(trim(text)) > 20 then trim(text)[1:20] || '...' else trim(text) end as title from conversations where role = 'user'")
def text_session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", text.session_title("text").alias("title"))


@query("""with m as (select doc_id, 'number: ' || unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*(?:%|percent|百分比|人数|天|年|元|万元|人次)')) as fact from documents
union all select doc_id, 'date: ' || unnest(regexp_extract_all(text, '[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}|[0-9]{1,2}[-/月][0-9]{1,2}')) from documents
union all select doc_id, unnest(regexp_extract_all(text, '[一-龥]{2,6}\\s*[:：]\\s*[^\\n，,。；;]{2,20}')) from documents)
select doc_id, count(*) as facts, min(fact) as first from m group by doc_id""")
def text_key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units, dates, and pairs of names and values."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.key_facts("text")).alias("fact"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("facts"), F.min("fact").alias("first"))


@query("""with u as (select conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[S?([0-9]{1,6})\\]', 1), lambda x: cast(x as bigint)))) as used from conversations)
select conv_id, turn, len(list_filter(used, lambda x: x between 1 and 3)) as used, len(list_filter(used, lambda x: x < 1 or x > 3)) as invalid, 3 - len(list_filter(used, lambda x: x between 1 and 3)) as unused from u""")
def text_citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = text.citation_audit("text", F.lit(3))
    size = lambda c: F.size(f"a.{c}").cast("long").alias(c)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", audit.alias("a")).select("conv_id", "turn", size("used"), size("invalid"), size("unused"))


_PII = " union all ".join(f"select doc_id, '{k}' as kind, unnest(regexp_extract_all(text, '{p}')) as value from documents" for k, p in safety.PII_PATTERNS.items())


@query(f"select doc_id, kind, count(*) as found, min(value) as first from ({_PII}) group by all")
def safety_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of seven kinds in every whole document."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(safety.pii("text")).alias("p"))
    return rows.groupBy("doc_id", F.col("p.type").alias("kind")).agg(F.count("*").alias("found"), F.min("p.value").alias("first"))


@query("""select doc_id, md5(regexp_replace(regexp_replace(text, '\\b([A-Za-z0-9_.-]{1,2})[A-Za-z0-9_.-]*@([A-Za-z0-9_.-]+\\.[A-Za-z0-9_]+)\\b', '\\1***@\\2', 'g'), '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b', '***', 'g')) as digest from documents""")
def safety_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(safety.masked("text", ("email", "ip_address"))).alias("digest"))


def _alternatives(patterns) -> str:
    return " or ".join("regexp_matches(text, '{}')".format(p.replace("'", "''")) for p in patterns)


_HITS = " + ".join("cast(regexp_matches(text, '{}') as int)".format(p.replace("'", "''")) for p in safety.INJECTION_PATTERNS)


@query(f"""with s as (select conv_id, turn, text, greatest(0.0, 1 - 0.25 * ({_HITS}))::double as score from conversations)
select conv_id, turn, score, case when {_alternatives(safety.SQL_PATTERNS)} then 'sql_injection' when {_alternatives(safety.XSS_PATTERNS)} then 'xss' when {_alternatives(safety.PATH_PATTERNS)} then 'path_traversal'
  when score < 0.3 then 'prompt_injection' when score < 0.8 then 'suspicious_prompt' else 'none' end as threat from s""")
def safety_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each message fails, and its injection score; the tables hold no hidden characters."""
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", safety.injection_score("text").alias("score"), safety.threat("text").alias("threat"))


@query("select conv_id, turn, md5(trim(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '[ \\t\\r\\n]+', ' ', 'g'))) as digest from conversations")
def safety_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(safety.sanitised("text", escape=True)).alias("digest"))


@query("""with stated as (select doc_id, text || ' discount ' || (doc_id % 3 + 10) || '% and growth 4 percent' as text from documents),
m as (select doc_id, unnest(regexp_extract_all(text, '[a-zA-Z]{2,8}\\s*[0-9]+(?:\\.[0-9]+)?\\s*(?:%|percent)')) as m from stated),
q as (select doc_id, regexp_extract(m, '([a-zA-Z]{2,8})\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(%|percent)', 1) as attribute, regexp_extract(m, '([a-zA-Z]{2,8})\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(%|percent)', 2) as value,
  regexp_extract(m, '([a-zA-Z]{2,8})\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(%|percent)', 3) as unit from m)
select attribute, unit, count(distinct value) as n_values, count(distinct doc_id) as n_docs from q group by all having count(distinct value) > 1""")
def evidence_numeric_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document states a discount, which differs by id, and a growth, which does not."""
    stated = F.concat("text", F.lit(" discount "), (F.col("doc_id") % 3 + 10).cast("string"), F.lit("% and growth 4 percent"))
    return evidence.numeric_conflicts(evidence.quantities(load(spark, sf_dir, "documents").withColumn("text", stated), units="%|percent"))


@query("""with r as (select lang as query_id, doc_id, source as title, text, lead(doc_id) over w as next_doc_id, lead(source) over w as next_title, lead(text) over w as next_text
  from documents window w as (partition by lang order by doc_id))
select query_id, doc_id, next_doc_id from r where title != next_title and ((contains(text, 'with') and contains(next_text, 'from')) or (contains(text, 'from') and contains(next_text, 'with')))""")
def evidence_contradicting_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents next to each other of which one holds a word and the other its opposite."""
    rows = load(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), "doc_id", F.col("source").alias("title"), "text")
    return evidence.contradicting_neighbours(rows, pairs=(("with", "from"),), limit=None)


@query("""with a as (select doc_id, md5(text) as d from documents where doc_id % 10 != 3), b as (select doc_id, case when doc_id % 10 = 4 then md5(text || '!') else md5(text) end as d from documents where doc_id % 10 != 5)
select doc_id, case when a.d is null then 'new' when b.d is null then 'obsolete' when a.d = b.d then 'same' else 'changed' end as state from a full join b using (doc_id)""")
def ingest_sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are new, same, changed or obsolete between two states of the corpus."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"), F.md5(F.concat("text", F.lit("!"))).alias("other"))
    old = docs.where("doc_id % 10 != 3")
    new = docs.where("doc_id % 10 != 5").withColumn("digest", F.when(F.col("doc_id") % 10 == 4, F.col("other")).otherwise(F.col("digest")))
    return ingest.sync_diff(old, new, "doc_id", "digest")


@query("""select c_custkey, case when c_custkey % 9 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer
union all select c_custkey + 10000000, c_acctbal from customer where c_custkey % 11 = 0""")
def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changed = current.where("c_custkey % 9 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    added = current.where("c_custkey % 11 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return ingest.upsert(current, changed.unionByName(added), "c_custkey")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'PATCHED' else c_mktsegment end as c_mktsegment, c_nationkey from customer")
def ingest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return ingest.patch(current, current.where("c_custkey % 4 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), "c_custkey")


@query("select doc_id, source from documents where source not in ('src1', 'src2')")
def ingest_delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.delete(docs, docs.where(F.col("source").isin("src1", "src2")).select("source").distinct(), "source")


@query("""with chunks as (select source, doc_id as chunk_id, case when doc_id // 20 % 2 = 0 then 'v2' else 'v1' end as version, case when doc_id // 20 % 2 = 0 then 'staging' else 'active' end as state from documents)
select chunk_id, source, case when source in ('src3', 'src5') or source not in (select source from chunks where version = 'v2') then state when version = 'v2' then 'active' when state = 'active' then 'retired' else state end as state from chunks""")
def ingest_staged_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents are staged as v2; two sources miss a chunk and keep their old state."""
    docs = load(spark, sf_dir, "documents")
    even = F.floor(F.col("doc_id") / 20) % 2 == 0
    rows = docs.select("source", F.col("doc_id").alias("chunk_id"), F.when(even, "v2").otherwise("v1").alias("version"), F.when(even, "staging").otherwise("active").alias("state"))
    expected = rows.where("version = 'v2'").select("source", "chunk_id")
    missing = expected.select("source").where(F.col("source").isin("src3", "src5")).distinct().select("source", F.lit(-1).cast("long").alias("chunk_id"))
    return ingest.publish(rows, expected.union(missing), "v2").select("chunk_id", "source", "state")


@query("select source, arg_min(lang, doc_id) as lang, count(*) as chunk_count from documents group by source")
def ingest_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.catalogue_by_source(load(spark, sf_dir, "documents").select("source", "doc_id", "lang"), order="doc_id")


@query("select lang, source, count(*) as documents, cast(grouping_id(lang, source) as bigint) as grouping from documents group by grouping sets ((), (lang), (source))")
def ingest_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.overview(load(spark, sf_dir, "documents"), ["lang", "source"])


@query("select count(*) as n from lineitem")
def ingest_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table, if two digests of it in different order agree."""
    rows = load(spark, sf_dir, "lineitem")
    a = ingest.table_digest(rows)
    b = ingest.table_digest(rows.repartition(7)).select(F.col("digest").alias("other"))
    return a.join(b, F.col("digest") == F.col("other")).select("n")


@query("""with u as (select page_id, md5(html) as file_hash, case page_id % 4 when 0 then 'a.html' when 1 then 'b.exe' when 2 then 'c.PDF' else 'd.md' end as filename, length(html) as size from pages),
j as (select md5(html) as file_hash from pages where page_id % 5 = 0)
select page_id, case when filename = 'b.exe' then 'unsupported' when size > 5000 then 'too_large' when file_hash in (select file_hash from j) then 'duplicate' end as problem from u""")
def ingest_upload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    names = F.get(F.array(*map(F.lit, ("a.html", "b.exe", "c.PDF", "d.md"))), (F.col("page_id") % 4).cast("int"))
    uploads = pages.select("page_id", F.md5("html").alias("file_hash"), names.alias("filename"), F.length("html").alias("size"))
    jobs = pages.where("page_id % 5 = 0").select(F.md5("html").alias("file_hash"), F.lit("completed").alias("status"))
    return ingest.upload_problems(uploads, jobs, max_bytes=5000).select("page_id", "problem")


@query("""select l_orderkey, l_linenumber, round(l_quantity * 1048576 / 1e6, 6) as megabytes, round(l_quantity * 1e9 / (125000000 * 0.8), 6) as seconds from lineitem""")
def units_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MiB as MB, and seconds for as many GB at 1 Gbps with an efficiency of 0.8."""
    q = F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(units.converted(q, "MiB", "MB"), 6).alias("megabytes"), F.round(units.transfer_seconds(q, "GB", F.lit(1.0), "Gbps", 0.8), 6).alias("seconds"))


@query("select doc_id, 0 as added, case when contains(text, chr(10)) then 1 else 0 end as removed from documents")
def text_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself without its first line."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", r"^[^\n]*\n", "").alias("rest"))
    return rows.select("doc_id", stats.line_diff("text", "rest").alias("d")).select("doc_id", "d.added", "d.removed")


@query("select o_orderkey, round((o_totalprice + 2.5) * 3 - 7 / 2.0, 6) as value from orders")
def stats_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic expressions as texts, evaluated safely."""
    expression = F.concat(F.lit("("), F.col("o_totalprice").cast("string"), F.lit(" + 2.5) * 3 - 7 / 2"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(stats.calculator(expression), 6).alias("value"))
