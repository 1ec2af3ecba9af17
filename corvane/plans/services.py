"""Registered queries: stored indexes, segmentation, office files, state in streams, and what is composed of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import access, filters, research, text
from ..operators import answers, embedding, index, memory, metrics, planner, registry, retrieval, segmentation
from ..sources import element_source, office
from ..storage import fresh_path, stored
from ..streaming import jobs, state, windows
from .base import Catalogue, load
from .retrieval import LUCENE, _READABLE, TODAY, bm25_sql, derived, published

catalogue = Catalogue()
query = catalogue.query


def _indexed(spark: SparkSession, sf_dir: str) -> index.Revision:
    """An index that was built from older texts and fewer documents, and then brought up to date: what is not divisible by 7 with remainder 3."""
    docs, path = load(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "bm25")
    older = docs.where("doc_id % 5 != 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.reverse("text")).otherwise(F.col("text")))
    first = index.built(spark, path, older, "first")
    second = index.changed(spark, first, "second", docs.where("doc_id % 5 = 0 or doc_id % 3 = 0"), docs.where("doc_id % 14 = 3").select("doc_id"))
    return index.ensured(spark, second.path, docs.where("doc_id % 7 != 3"), "third")


@query(bm25_sql(LUCENE).replace("from documents", "from (select * from documents where doc_id % 7 != 3)"))
def retrieval_bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item, from an index after upserts, deletes and a comparison of revisions."""
    return published(index.search(spark, _indexed(spark, sf_dir), load(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(bm25_sql(LUCENE, k=3))
def retrieval_bm25_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one segment, after the deleted documents have come back."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    whole = index.changed(spark, _indexed(spark, sf_dir), "fourth", docs.where("doc_id % 7 = 3"))
    return published(index.search(spark, index.merged(spark, whole), load(spark, sf_dir, "benchmark"), "item_id", "text", k=3))


_SEGMENTED = r"""with recursive words as (select word, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents) group by word),
total as (select sum(n)::double as t from words),
dict as (select word, round(1000000 * ln(t / n))::bigint as cost from words, total),
runs as (select item_id, generate_subscripts(rs, 1) - 1 as run_no, unnest(rs) as run from (select item_id, regexp_extract_all(regexp_replace(lower(text), '[ \n]+', '', 'g'), '[a-z]+') as rs from benchmark)),
cuts as (select item_id, run_no, i, w, substr(run, i + 1, w) as piece from runs, unnest(range(length(run))) as t1(i), unnest(range(1, 1 + (select max(length(word)) from words))) as t2(w) where i + w <= length(run)),
edges as (select item_id, run_no, i, w, coalesce(cost, case when w = 1 then (select round(1000000 * ln(t))::bigint from total) end) as cost from cuts left join dict on piece = word where cost is not null or w = 1),
dp as (select item_id, run_no, length(run) as i, [0::bigint] as best, []::bigint[] as steps from runs
  union all
  select item_id, run_no, i, list_prepend(b.c, best), list_prepend(-b.w, steps) from (
    select d.item_id, d.run_no, d.i - 1 as i, any_value(d.best) as best, any_value(d.steps) as steps, min({'c': e.cost + d.best[e.w], 'w': -e.w}) as b
    from dp d join edges e on e.item_id = d.item_id and e.run_no = d.run_no and e.i = d.i - 1 where d.i > 0 group by d.item_id, d.run_no, d.i)),
walk as (select item_id, run_no, run, steps, 1::bigint as place, '' as words from dp join runs using (item_id, run_no) where i = 0
  union all
  select item_id, run_no, run, steps, place + steps[place], words || case when words = '' then '' else ' ' end || substr(run, place, steps[place]) from walk where place <= length(run))
select item_id, run_no, words from walk where place > length(run)"""


@query(_SEGMENTED)
def text_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items without their spaces, cut into the words of all documents; the dictionary goes through a join of pieces."""
    words = load(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    joined = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[ \n]+", "").alias("text"))
    found = segmentation.segmented(joined, segmentation.dictionary(words), "item_id", runs="[a-z]+")
    return found.select("item_id", F.col("run_no").cast("long").alias("run_no"), F.array_join("words", " ").alias("words"))


@query("select doc_id, sha256(text) as digest, length(text) - length(replace(text, chr(10), '')) + 1 as paragraphs from documents")
def sources_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as DOCX files, a paragraph for each line, and read again."""
    packed = stored(office.as_docx(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "docx")
    return office.docx_documents(packed, between="\n").select("doc_id", F.sha2("text", 256).alias("digest"), F.col("n_paragraphs").cast("long").alias("paragraphs"))


@query("""select l_orderkey, string_agg(line, chr(10) order by place, line) as markdown from (
  select l_orderkey, -1 as place, '| Order | Line | Flag |' || chr(10) || '| --- | --- | --- |' as line from lineitem group by l_orderkey
  union all select l_orderkey, l_linenumber, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_returnflag || ' & ' || l_linestatus || ' |' from lineitem
  union all select l_orderkey, 1000000, '| Lines | Lines | ' || count(*) || ' |' from lineitem group by l_orderkey) group by l_orderkey""")
def sources_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an HTML table whose first cell is as high as it has lines, as Markdown."""
    cells = F.concat(F.lit("<td> "), F.col("l_linenumber").cast("string"), F.lit("</td><td>"), F.col("l_returnflag"), F.lit("\n&amp; <b>"), F.col("l_linestatus"), F.lit("</b></td>"))
    orders = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("cells")))).alias("lines"))
    n = F.size("lines").cast("string")
    body = F.array_join(F.transform("lines", lambda x: x["cells"]), "</tr><tr>")
    html = F.concat(F.lit("<p>Order</p><table><thead><tr><th>Order<th>Line<th>Flag</tr></thead><tbody><tr><td rowspan="), n, F.lit(">"), F.col("l_orderkey").cast("string"), F.lit("</td>"), body, F.lit("</tbody><tfoot><tr><td colspan='2'>Lines</td><td>"), n, F.lit("</td></tr></tfoot></table>"))
    return office.html_tables(orders.select("l_orderkey", html.alias("html"))).select("l_orderkey", "markdown")


def _streamed(spark: SparkSession, sf_dir: str, step) -> DataFrame:
    """What ``step`` makes of the events as a stream of three files in order of time: a query's state goes on from batch to batch."""
    base = fresh_path(spark, "state")
    events = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("value") < 50).alias("ok"))
    for low, high in ((0, 10), (10, 20), (20, 32)):
        events.where(F.dayofmonth("ts").between(low + 1, high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark("ts", "1 day")
    with state.rocks(spark):
        windows.run_to_end(step(rows), f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table")


_CALLS = """calls as (select user_id, event_id, ts, coalesce(value < 50, false) as ok, row_number() over (partition by user_id order by ts, event_id) as k from events where user_id is not null)"""


@query(f"""with recursive {_CALLS},
b as (select user_id, event_id, 1::bigint as k, 'closed' as phase, true as admitted, case when ok then 0 else 1 end as failed, null::timestamp as opened from calls where k = 1
  union all select c.user_id, c.event_id, c.k, case when c.ts < b.opened then 'open' when b.opened is not null then 'half_open' else 'closed' end, not coalesce(c.ts < b.opened, false),
    case when c.ts < b.opened then b.failed when c.ok or b.opened is not null or b.failed >= 1 then 0 else b.failed + 1 end,
    case when c.ts < b.opened then b.opened when c.ok then null when b.opened is not null or b.failed >= 1 then c.ts + interval 2 days end
  from b join calls c on c.user_id = b.user_id and c.k = b.k + 1)
select user_id::varchar as key, event_id as id, phase, admitted from b""")
def stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user's service: after two failures in a row, two days without any."""
    found = _streamed(spark, sf_dir, lambda rows: state.circuit_breaker(rows, "user_id", "event_id", "ts", "ok", failures=2, cooldown_seconds=2 * 86_400, forget_seconds=90 * 86_400))
    return found.select("key", "id", "phase", "admitted")


@query(f"""with recursive {_CALLS},
c as (select user_id, event_id, k, ts, ts as loaded from calls where k = 1
  union all select n.user_id, n.event_id, n.k, n.ts, case when n.ts < c.loaded + interval 18 hours then c.loaded else n.ts end from c join calls n on n.user_id = c.user_id and n.k = c.k + 1)
select user_id::varchar as key, event_id as id, loaded < ts or k > 1 and loaded = lag(loaded) over (partition by user_id order by k) as hit, round((epoch_us(ts) - epoch_us(loaded)) / 1e6, 3) as age_seconds from c""".replace(" or k > 1 and loaded = lag(loaded) over (partition by user_id order by k)", " or coalesce(loaded = lag(loaded) over (partition by user_id order by k), false)"))
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache with an entry for each user, which lives for 18 hours."""
    found = _streamed(spark, sf_dir, lambda rows: state.cache_lookups(rows, "user_id", "event_id", "ts", 18 * 3600))
    return found.select("key", "id", "hit", F.round("age_seconds", 3).alias("age_seconds"))


@query(f"""with {_CALLS}, s as (select *, coalesce(ts >= lag(ts) over (partition by user_id order by k) + interval 12 hours, true) as first from calls),
g as (select *, sum(first::int) over (partition by user_id order by k) as run from s)
select user_id::varchar as key, event_id as id, row_number() over (partition by user_id, run order by k) as n from g""")
def stream_expiring_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter for each user, which begins anew 12 hours after its last increment."""
    return _streamed(spark, sf_dir, lambda rows: state.expiring_counters(rows, "user_id", "event_id", "ts", 12 * 3600)).select("key", "id", "n")


_KIND = """case when regexp_matches(t, '^#{1,6}\\s') then 'Title' when regexp_matches(t, '^\\|[^\\n]*\\|') then 'Table' when regexp_matches(t, '^([-*+•]|[0-9]+[.)])\\s') then 'ListItem'
  when length(t) < 80 and not regexp_matches(t, '[.!?。！？]$') then 'Title' else 'NarrativeText' end"""
_ELEMENTS = f"""with e as (select unnest(string_split(regexp_replace(text, '\\n\\s*\\n', chr(1), 'g'), chr(1))) as t from documents), k as (select trim(t, ' ' || chr(10) || chr(13)) as t from e)
select {_KIND} as kind, sha256(t) as digest, count(*) as n from k where trim(t, ' ' || chr(9) || chr(10) || chr(13)) != '' group by all"""


def _as_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents as text files in a new folder, with a blank line after each."""
    folder = fresh_path(spark, "texts")
    load(spark, sf_dir, "documents").select(F.concat("text", F.lit("\n"))).write.text(folder)
    return folder


@query(_ELEMENTS)
def sources_elements_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of text files by the data source, in ranges of 64 kB: kinds and texts of all."""
    element_source.register(spark)
    rows = spark.read.format("corvane_elements").option("glob", "part-*").option("split_bytes", 1 << 16).load(_as_files(spark, sf_dir))
    return rows.groupBy("kind", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


@query(_ELEMENTS)
def sources_elements_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream."""
    element_source.register(spark)
    base = fresh_path(spark, "elements")
    rows = spark.readStream.format("corvane_elements").option("glob", "part-*").load(_as_files(spark, sf_dir))
    windows.run_to_end(rows, f"{base}/table", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/table").groupBy("kind", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"))


@query("""with t as (select doc_id, text, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents), h as (select doc_id, ('0x' || substr(md5(token), 1, 8))::bigint as h from t),
s as (select doc_id, h % 4 as slot, sum(1 - 2 * ((h // 4) % 2))::double as v from h group by all), n as (select doc_id, sqrt(sum(v * v)) as norm from s group by doc_id),
v as (select doc_id, slot, case when norm > 0 then v / norm else 0 end as v from s join n using (doc_id)),
w as (select doc_id, coalesce(max(v) filter (slot = 0), 0) as v0, coalesce(max(v) filter (slot = 1), 0) as v1, coalesce(max(v) filter (slot = 2), 0) as v2, coalesce(max(v) filter (slot = 3), 0) as v3 from documents left join v using (doc_id) group by doc_id)
select doc_id, min(doc_id % 2) over (partition by text)::bigint as commit, round(v0, 6) + 0.0 as v0, round(v1, 6) + 0.0 as v1, round(v2, 6) + 0.0 as v2, round(v3, 6) + 0.0 as v3 from w join documents using (doc_id)""")
def embeddings_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents after those with even numbers had been encoded: copies of these are not encoded again, and a third call encodes nothing."""
    path, docs = fresh_path(spark, "vectors"), load(spark, sf_dir, "documents").select("doc_id", "text")
    embedder = embedding.feature_hashing(4)
    embedding.encoded(spark, path, docs.where("doc_id % 2 = 0"), embedder, "hashing-4")
    rows = embedding.with_vectors(spark, path, docs, embedder, "hashing-4")
    if embedding.encoded(spark, path, docs, embedder, "hashing-4"):
        raise RuntimeError("a text was encoded twice")
    return rows.select("doc_id", "commit", *((F.round(F.col("vector")[k], 6) + 0.0).alias(f"v{k}") for k in range(4)))


_MEMORIES = """m as (select o_custkey % 150 as memory_id, case when o_orderkey % 9 = 0 then 'delete' else 'update' end as event, o_orderpriority as content, o_orderdate as ts, o_orderkey as seq, (o_custkey % 150) % 10 as owner from orders),
r as (select l_orderkey * 10000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as request_id, l_partkey % 150 as memory_id, l_suppkey % 10 as user_id, l_shipdate as ts from lineitem),
l as (select ts, memory_id, arg_max(struct_pack(event, content), seq) as c, any_value(owner) as owner from m group by ts, memory_id),
o as (select memory_id, any_value(owner) as owner from m group by memory_id)"""


@query(f"""with {_MEMORIES}, j as (select r.*, o.owner, l.c from r asof left join l on r.memory_id = l.memory_id and r.ts >= l.ts left join o on o.memory_id = r.memory_id)
select request_id, case when owner is null or user_id != owner then 'denied' when c is null or c.event = 'delete' then 'absent' else 'present' end as state,
  case when user_id = owner and c.event != 'delete' then c.content end as content from j""")
def memory_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line item's user may read of a memory at its shipping date; memories change with the orders."""
    return memory.as_of(_memory_events(spark, sf_dir), _memory_requests(spark, sf_dir)).select("request_id", "state", "content")


def _memory_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("o_custkey") % 150
    return load(spark, sf_dir, "orders").select(own.alias("memory_id"), (own % 10).alias("user_id"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 9 == 0, "delete").otherwise("update").alias("event"), F.col("o_orderpriority").alias("content"))


def _memory_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10000 + place).alias("request_id"), (F.col("l_partkey") % 150).alias("memory_id"), (F.col("l_suppkey") % 10).alias("user_id"), F.col("l_shipdate").alias("at"))


@query(f"""with {_MEMORIES}, n as (select *, lead(ts) over (partition by memory_id order by ts, seq) as valid_to from m) select memory_id, seq, valid_to from n""")
def memory_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when each state of a memory held."""
    return memory.history(_memory_events(spark, sf_dir)).select("memory_id", "seq", "valid_to")


@query("""with d as (select conv_id, turn, regexp_replace(text, '\\. ', ' [S' || (turn % 4) || '][S9]; ', 'g') as draft from conversations),
s as (select conv_id, turn, unnest(l) as s, generate_subscripts(l, 1) as k from (select conv_id, turn, regexp_split_to_array(draft, '[。；;\\n]+') as l from d)),
c as (select conv_id, turn, k, trim(s, ' -0123456789.、') as s from s),
f as (select conv_id, turn, k, s, list_distinct(list_filter(regexp_extract_all(s, '\\[(S[0-9]+)\\]', 1), lambda x: x in ('S1', 'S2', 'S3'))) as ids from c where length(s) >= 8),
g as (select *, row_number() over (partition by conv_id, turn order by k) as n from f where len(ids) > 0)
select conv_id, turn, 'C' || n as claim_id, trim(regexp_replace(s, '\\[S[0-9]+\\]', '', 'g')) as text, ids[1] as source_id from g where n <= 16""")
def claims_from_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a citation after each sentence, as claims that cite evidence that is there."""
    mark = F.concat(F.lit(" [S"), (F.col("turn") % 4).cast("string"), F.lit("][S9]; "))
    drafts = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.col("text"), F.lit("\\. "), mark).alias("draft"))
    known = F.array(*map(F.lit, ("S1", "S2", "S3")))
    rows = drafts.select("conv_id", "turn", F.explode(research.draft_claims("draft", known)).alias("c"))
    return rows.select("conv_id", "turn", "c.claim_id", "c.text", F.col("c.source_ids")[0].alias("source_id"))


@query("""with c as (select conv_id, turn, string_split(case when turn % 2 = 0 then '- ' || text else text end, chr(10)) as lines from conversations),
h as (select conv_id, turn, array_to_string(list_transform(lines, lambda x: case when regexp_matches(x, '^[ \\t]*([-*+]|[0-9]+[.、])[ \\t]+\\S') then translate(x, '.!?;,', chr(1) || chr(2) || chr(3) || chr(4) || chr(5)) else x end), chr(10)) as t from c),
p as (select conv_id, turn, unnest(string_split(regexp_replace(regexp_replace(t, '([.!?;])', '\\1' || chr(6), 'g'), ',([A-Za-z])', ',' || chr(6) || '\\1', 'g'), chr(6))) as s from h),
f as (select conv_id, turn, trim(translate(s, chr(1) || chr(2) || chr(3) || chr(4) || chr(5), '.!?;,'), ' ' || chr(9) || chr(10) || chr(13)) as s from p)
select conv_id, turn, count(*) as sentences, sum(length(s))::bigint as characters, md5(string_agg(md5(s), '' order by s)) as digest from f where s != '' group by all""")
def text_chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of messages as the chunker has them; every other message begins as a list item, whose first line stays whole."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text")).alias("text"))
    parts = rows.select("conv_id", "turn", text.chunk_sentences("text").alias("s")).where(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)).cast("long")
    digest = F.md5(F.array_join(F.transform(F.array_sort("s"), F.md5), ""))
    return parts.select("conv_id", "turn", F.size("s").cast("long").alias("sentences"), total.alias("characters"), digest.alias("digest"))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, axis, case when (case axis when 'answer' then l_quantity when 'truth' then l_partkey else l_suppkey end) % 3 = 0 then 'supported' else 'not_supported' end as a,
  case when (case axis when 'answer' then l_quantity else l_partkey end) % 5 < 2 then 'supported' else 'not_supported' end as b from lineitem, (select unnest(['answer', 'truth', 'context']) as axis)),
n as (select axis, count(*) as n, avg((a = b)::int) as o, avg((a = 'supported')::int) as pa, avg((b = 'supported')::int) as pb from r group by axis)
select axis, n, round(o, 6) as agreement, round((o - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) as kappa from n""")
def metrics_kappa_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on three axes of two judges, made rows of one kind, and how far the judges agree on each axis."""
    axes = ["answer", "truth", "context"]
    item = lambda hit: F.array(F.struct(F.col("id").alias("item_id"), F.when(hit, "supported").otherwise(F.when(F.col("id") % 2 == 0, "refuted")).alias("verdict")))
    rows = load(spark, sf_dir, "lineitem").withColumn("id", F.monotonically_increasing_id())
    rows = stored(rows, "verdicts")
    of = lambda columns, hit: metrics.verdict_map(rows.select("id", *(item(hit(F.col(c))).alias(a) for a, c in zip(axes, columns, strict=True))), axes, ["id"])
    first = of(("l_quantity", "l_partkey", "l_suppkey"), lambda c: c % 3 == 0).withColumnRenamed("verdict", "a")
    second = of(("l_quantity", "l_partkey", "l_partkey"), lambda c: c % 5 < 2).select("task_id", F.col("verdict").alias("b"))
    found = metrics.kappa_by(first.join(second, "task_id"), "axis", "a", "b")
    return found.select("axis", "n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


_FORMS = """a as (select item_id as query_id, text as query, ['none', 'plain', 'standalone', 'expanded', 'corrected'][item_id % 5 + 1] as branch, substr(text, 1, length(text) // 2) as head, substr(text, length(text) // 2 + 1) as tail from benchmark),
forms as (select query_id, branch, 0 as part, query as text from a where branch != 'none' union all select query_id, branch, 1, tail from a where branch = 'standalone'
  union all select query_id, branch, 1, head from a where branch = 'expanded' union all select query_id, branch, 2, tail from a where branch = 'expanded')"""
_PLANNED = f"""with {_FORMS},
tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents), tf as (select doc_id, term, count(*) as tf from tok group by all),
dl as (select doc_id, sum(tf) as dl from tf group by doc_id), st as (select (select count(*) from documents) as n, (select avg(dl) from dl) as mean), df as (select term, count(*) as df from tf group by term),
idf as ({LUCENE}),
qt as (select query_id, branch, part, term, count(*) as qtf from (select query_id, branch, part, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from forms) group by all),
sc as (select query_id, branch, part, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score from tf join qt using (term) join idf using (term) join dl using (doc_id) cross join st group by all),
lex as (select *, row_number() over (partition by query_id, part order by round(score, 9) desc, doc_id) as rank from sc where score > 0),
words as (select query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]+')) as q from a),
rel as (select l.*, least(0.99, len(list_intersect(w.q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+'))))::double / len(w.q)) as relevance from lex l join words w using (query_id) join documents d using (doc_id) where part = 0 and (branch = 'plain' and rank <= 15 or branch = 'corrected' and rank <= 5)),
gr as (select *, case when relevance >= 0.5 then 'high' when relevance >= 0.25 then 'medium' else 'low' end as grade from rel where branch = 'corrected'),
cn as (select query_id, count(*) as n, count(*) filter (grade = 'high') as h, count(*) filter (grade = 'medium') as m, count(*) filter (grade = 'low') as l, avg(relevance) as mean from gr group by query_id),
de as (select query_id, case when h = 0 and m = 0 and l / n >= 0.8 then 'no_results' when h / n >= 0.2 and mean >= 0.25 then 'high' when h + m > 0 and mean >= 0.15 then 'medium' else 'low' end as decision from cn),
out as (select query_id, branch, doc_id, relevance as score from rel where branch = 'plain'
  union all select query_id, branch, doc_id, sum(1.0 / (60 + rank)) from lex where branch = 'standalone' and rank <= 5 or branch = 'expanded' and rank <= 3 group by all
  union all select query_id, branch, doc_id, score from gr join de using (query_id) where decision = 'high' and grade = 'high' or decision = 'medium' and grade != 'low'),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from out)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions of five kinds; their halves are rewritten forms and parts."""
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    kind, none = F.col("item_id") % 5, F.array().cast("array<string>")
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(kind == 0, "...?").otherwise(F.col("text")).alias("query"), F.when(kind == 3, F.array(head, tail)).otherwise(none).alias("parts"), F.when(kind == 2, F.array(tail)).otherwise(none).alias("rewritten"),
        (kind == 3).alias("needs_expansion"), (kind == 4).alias("corrected"), F.concat(F.lit("p"), (F.col("item_id") % 2).cast("string")).alias("project_id"),
    )


def _bm25(docs: DataFrame):
    return lambda queries, k: retrieval.bm25(docs, queries, "query_id", "query", k)


@query(f"{_PLANNED} select query_id, doc_id, rank, round(score, 6) as score, branch from rk where rank <= 5")
def retrieval_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all kinds in one call: none, plain, standalone, expanded, corrected."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = planner.retrieve_documents(_questions(spark, sf_dir), docs, _bm25(docs), 5, rounds=1)
    return found.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "branch")


@query("""with m as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 'confirmed_research_fact' else 'note' end as memory_type, case when o_orderkey % 3 = 0 then 'research' when o_orderkey % 5 != 0 then 'user' end as scope,
  case when o_orderkey % 7 != 0 then 'p' || (o_custkey % 2) end as project_id, o_custkey as run_id, o_orderpriority as claim_id, case when o_orderkey % 11 = 0 then [] else ['S1', 'S2'] end as source_ids, case when o_orderkey % 13 = 0 then 'REVISE' else 'PASS' end as review, o_orderkey % 17 != 0 as confirmed, o_orderkey % 19 != 0 as verified from orders),
c as (select c_custkey as run_id, c_mktsegment, c_nationkey from customer), v as (select m.*, c.c_nationkey is not null and c.c_nationkey % 2 = 0 as readable, c.c_nationkey % 3 as k from m left join c on c.run_id = m.run_id and m.claim_id != '5-LOW')
select id, case when memory_type != 'confirmed_research_fact' and coalesce(scope, '') != 'research' then 'plain'
  when not (memory_type = 'confirmed_research_fact' and coalesce(scope, '') = 'research' and project_id is not null and len(source_ids) > 0 and review = 'PASS' and confirmed and verified) then 'invalid_metadata'
  when readable and k > 0 then 'verified' else 'acl_filtered' end as verdict from v""")
def memory_recall_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of orders against confirmed claims of customers: research needs all its marks and the very claim."""
    key, text_of = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    sources = F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("S1"), F.lit("S2")))
    memories = load(spark, sf_dir, "orders").select(
        key.alias("id"), F.when(key % 2 == 0, "confirmed_research_fact").otherwise("note").alias("memory_type"), F.when(key % 3 == 0, "research").when(key % 5 != 0, "user").alias("scope"),
        F.when(key % 7 != 0, F.concat(F.lit("p"), (F.col("o_custkey") % 2).cast("string"))).alias("project_id"), text_of("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("claim_id"), sources.alias("source_ids"),
        F.when(key % 13 == 0, "REVISE").otherwise("PASS").alias("review_decision"), (key % 17 != 0).alias("user_confirmed"), (key % 19 != 0).alias("verified"),
    )
    kinds = F.explode(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))))
    confirmed = F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit("S1"))).otherwise(F.array(F.lit("S2"), F.lit("S1")))
    claims = load(spark, sf_dir, "customer").select(text_of("c_custkey").alias("run_id"), kinds.alias("claim_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 2).cast("string")).alias("project_id"), confirmed.alias("source_ids"), (F.col("c_nationkey") % 2 == 0).alias("readable"))
    return memory.recall_gate(memories, claims, F.lit(True)).select("id", "verdict")


@query("""with recursive e as (select event_id // 4 as job_id, ts, case event_id % 4 when 0 then 'pending' when 2 then 'running' else 'failed' end as event, row_number() over (partition by event_id // 4 order by ts, case event_id % 4 when 0 then 'pending' when 2 then 'running' else 'failed' end) as k from events),
s as (select job_id, 0::bigint as k, '' as state, 0 as attempt, 0 as n from (select distinct job_id from e)
  union all select e.job_id, e.k, case when s.state = 'failed' then 'failed' when e.event = 'failed' then case when s.attempt < 1 then 'retrying' else 'failed' end else e.event end,
    case when s.state != 'failed' and e.event = 'failed' and s.attempt < 1 then s.attempt + 1 else s.attempt end, case when s.state = 'failed' then s.n else s.n + 1 end from s join e on e.job_id = s.job_id and e.k = s.k + 1)
select job_id::varchar as job_id, arg_max(state, k) as state, max(attempt)::bigint as attempt, max(n)::bigint as changes from s group by job_id""")
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each job of the stream ends: one failure is tried again, the second is for good, and what comes after it changes nothing."""
    base = fresh_path(spark, "jobs")
    events = windows.event_stream(spark, sf_dir, load(spark, sf_dir, "events").schema, "events.parquet", lateness="40 days")
    rows = events.select(F.floor(F.col("event_id") / 4).alias("job_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 4 == 0, "pending").when(F.col("event_id") % 4 == 2, "running").otherwise("failed").alias("event"))
    windows.run_to_end(jobs.job_changes(rows, max_attempts=1), f"{base}/table", f"{base}/checkpoint")
    order = F.struct("at", "attempt", (F.col("state") == "failed").alias("final"), (F.col("state") == "retrying").alias("again"), "state")
    found = spark.read.parquet(f"{base}/table").groupBy("job_id").agg(F.max(order).alias("last"), F.count("*").alias("changes"))
    return found.select("job_id", "last.state", F.col("last.attempt").cast("long").alias("attempt"), "changes")


@query("""with v as (select p_partkey % 300 as doc_id, p_partkey as version_id, (p_size % 5) as version, case when p_partkey % 3 = 0 then 'archived' else 'active' end as status, p_size % 7 as day from part),
a as (select c_custkey % 300 as doc_id, 1000000 + c_custkey as version_id, c_custkey % 6 as version, c_nationkey % 7 as day, c_custkey % 8 = 0 as other from customer),
c as (select version_id, case when a.version < v.version then 'older_conflict' when a.version > v.version and a.day < v.day then 'date_conflict' when a.version > v.version then 'newer_override' end as kind from a join (select doc_id, version, day from v where status = 'active') v using (doc_id)),
k as (select version_id, bool_or(kind = 'older_conflict') as older, string_agg(distinct kind, ',' order by kind) filter (kind != 'older_conflict') as warnings from c where kind is not null group by version_id)
select version_id, case when older then 'older' when other then 'identity' end as problem, coalesce(warnings, '') as warnings from a left join k using (version_id)""")
def versions_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as versions that are to replace those of parts: which may, and what there is to warn of."""
    day = lambda c: F.date_add(F.lit("2026-01-01").cast("date"), (c % 7).cast("int"))
    part, customer = load(spark, sf_dir, "part"), load(spark, sf_dir, "customer")
    versions = part.select((F.col("p_partkey") % 300).alias("doc_id"), F.col("p_partkey").alias("version_id"), F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")).alias("version"), F.when(F.col("p_partkey") % 3 == 0, "archived").otherwise("active").alias("status"), day(F.col("p_size")).alias("effective_date"))
    own = F.col("c_custkey") % 300
    arriving = customer.select(
        own.alias("doc_id"), (F.lit(1_000_000) + F.col("c_custkey")).alias("version_id"), F.concat(F.lit("v"), (F.col("c_custkey") % 6).cast("string")).alias("version"), day(F.col("c_nationkey")).alias("effective_date"),
        F.when(F.col("c_custkey") % 8 == 0, own + 1).otherwise(own).alias("asked_doc_id"), (F.lit(1_000_000) + F.col("c_custkey")).alias("asked_version_id"),
    )
    return registry.replacements(versions, arriving).select("version_id", "problem", F.array_join("warnings", ",").alias("warnings"))


@query(bm25_sql(LUCENE, k=10, extra=", " + _READABLE).replace("where rank <= 10", "where rank <= 10 and doc_id in (select doc_id from acl)"))
def retrieval_reauthorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that were found without any rule, held against a reader's rules at the end; ranks stay."""
    docs = derived(spark, sf_dir)
    found = retrieval.bm25(docs, load(spark, sf_dir, "benchmark"), "item_id", "text")
    return published(planner.reauthorised(found, docs, _rule()))


def _rule() -> F.Column:
    rule = access.may_read(F.lit("senior_student"), F.lit("lab"), F.lit(True), F.col("confidentiality"), F.col("visibility"), F.col("departments"), F.lit(""), F.col("effective_date"), F.col("expiry_date"), F.lit(TODAY).cast("date"))
    return access.is_published("state") & rule


_SEEN = "from (select * from documents where lang = 'en' and doc_id in (select doc_id from acl))"


@query(f"with {_READABLE}, " + bm25_sql(LUCENE, k=4).removeprefix("with ").replace("from documents", _SEEN))
def retrieval_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents that a reader may see, four for each item, without reordering."""
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = planner.service_search(queries, derived(spark, sf_dir), _bm25, 4, filters.compiled({"lang": "en"}), _rule(), reranked=False)
    return found.select("query_id", F.explode("results").alias("r")).select("query_id", "r.doc_id", "r.rank", "r.score")
