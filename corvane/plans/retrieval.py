"""Registered queries: retrieval, fusion, correction, access rules, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, filters, text
from ..operators import correction, retrieval
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query

#: Access attributes, which the tables do not have, follow from the id in both engines.
DERIVED = """select doc_id, text, lang, source, n_chars,
  case doc_id % 4 when 0 then 'public' when 1 then 'internal' when 2 then 'confidential' else 'secret' end as confidentiality,
  case doc_id % 3 when 0 then 'public' when 1 then 'project' else 'restricted' end as visibility,
  case when doc_id % 5 = 0 then 'dev,ops' else '' end as departments,
  case when doc_id % 7 = 0 then '2026-01-01' when doc_id % 7 = 1 then 'soon' else '' end as effective_date,
  case when doc_id % 7 = 2 then '2025-12-31' else '' end as expiry_date,
  case doc_id % 6 when 0 then 'staging' when 1 then 'retired' when 2 then null else 'active' end as state
from documents"""
TODAY = "2026-06-01"

_TOKENS = """tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
tf as (select doc_id, term, count(*) as tf from tok group by all),
dl as (select doc_id, sum(tf) as dl from tf group by doc_id),
st as (select (select count(*) from documents) as n, (select avg(dl) from dl) as mean),
qt as (select item_id as query_id, term, count(*) as qtf from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark) group by all),
df as (select term, count(*) as df from tf group by term)"""


def bm25_sql(idf: str, where: str = "", k: int = 10, extra: str = "") -> str:
    return f"""with {_TOKENS}{extra},
idf as ({idf}),
sc as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score
  from tf join qt using (term) join idf using (term) join dl using (doc_id) cross join st {where} group by all),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0)
select query_id, doc_id, rank, round(score, 6) as score from rk where rank <= {k}"""


LUCENE = "select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from df cross join st"
_OKAPI = """select term, case when raw < 0 then 0.25 * (select avg(ln((n - df + 0.5) / (df + 0.5))) from df cross join st) else raw end as idf
  from (select term, ln((n - df + 0.5) / (df + 0.5)) as raw from df cross join st)"""


def published(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(bm25_sql(LUCENE))
def retrieval_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for every benchmark item."""
    return published(retrieval.bm25(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "item_id", "text"))


@query(bm25_sql(_OKAPI))
def retrieval_bm25_okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(retrieval.bm25(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), "item_id", "text", variant="okapi"))


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with access attributes, as DERIVED has them."""
    i = F.col("doc_id")
    pick = lambda m, names: F.get(F.array(*map(F.lit, names)), (i % m).cast("int"))
    return load(spark, sf_dir, "documents").withColumns({
        "confidentiality": pick(4, access.LEVELS), "visibility": pick(3, ("public", "project", "restricted")),
        "departments": F.when(i % 5 == 0, "dev,ops").otherwise(""),
        "effective_date": F.when(i % 7 == 0, "2026-01-01").when(i % 7 == 1, "soon").otherwise(""),
        "expiry_date": F.when(i % 7 == 2, "2025-12-31").otherwise(""),
        "state": F.when(i % 6 == 0, "staging").when(i % 6 == 1, "retired").when(i % 6 == 2, None).otherwise("active"),
    })


_READABLE = f"""acl as (select doc_id from ({DERIVED}) where coalesce(state, 'active') = 'active' and confidentiality in ('public', 'internal', 'confidential')
  and visibility in ('public', 'project') and departments = '' and effective_date != 'soon'
  and (effective_date = '' or effective_date <= '{TODAY}') and (expiry_date = '' or expiry_date >= '{TODAY}'))"""


def _readable(docs: DataFrame, role: str, department: str = "lab") -> DataFrame:
    rule = access.may_read(F.lit(role), F.lit(department), F.lit(True), F.col("confidentiality"), F.col("visibility"), F.col("departments"), F.lit(""), F.col("effective_date"), F.col("expiry_date"), F.lit(TODAY).cast("date"))
    return docs.where(access.is_published("state") & rule)


@query(bm25_sql(LUCENE, "where doc_id in (select doc_id from acl)", 5, ", " + _READABLE))
def retrieval_bm25_acl_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best documents that a senior student may read: the rules come before the cut."""
    docs = derived(spark, sf_dir)
    allowed = _readable(docs, "senior_student")
    return published(retrieval.bm25(docs.select("doc_id", "text"), load(spark, sf_dir, "benchmark"), "item_id", "text", k=5, searched=allowed))


_COSINE = """sc as (select q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score
  from embeddings q join embeddings v on q.vec_id != v.vec_id where q.vec_id % 50 = 0 {where}),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from sc)"""


def _vector_queries(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"with {_COSINE.format(where='')} select query_id, vec_id, rank, round(score, 6) as score from rk where rank <= 10")
def retrieval_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all vectors for every vector whose id is divisible by 50."""
    vectors = load(spark, sf_dir, "embeddings")
    return retrieval.vector_search(vectors, _vector_queries(vectors)).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"with {_COSINE.format(where='and v.label < 5')} select query_id, vec_id, rank, round(score, 6) as score from rk where rank <= 5")
def retrieval_vector_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    found = retrieval.vector_filtered(vectors, _vector_queries(vectors), filters.compiled({"label": {"$lt": 5}}), k=5)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


#: Two rankings of documents for each benchmark item: BM25, and the vectors with the same numbers.
_LISTS = f"""{_TOKENS},
idf as ({LUCENE}),
sc as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score
  from tf join qt using (term) join idf using (term) join dl using (doc_id) cross join st group by all),
lex as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0),
vsc as (select b.item_id as query_id, v.vec_id as doc_id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score
  from benchmark b join embeddings q on q.vec_id = b.item_id join embeddings v on v.vec_id != q.vec_id),
vec as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from vsc),
lists as (select query_id, doc_id, 'bm25' as list, rank from lex where rank <= 20 union all select query_id, doc_id, 'vector', rank from vec where rank <= 20)"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    benchmark, vectors = load(spark, sf_dir, "benchmark"), load(spark, sf_dir, "embeddings")
    lexical = retrieval.bm25(load(spark, sf_dir, "documents"), benchmark, "item_id", "text", k=20)
    wanted = vectors.join(benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = retrieval.vector_search(vectors, wanted.select(F.col("vec_id").alias("query_id"), "embedding"), k=20)
    return lexical, near.withColumnRenamed("vec_id", "doc_id")


@query(f"""with {_LISTS},
f as (select query_id, doc_id, sum(0.5 / (60 + rank)) as score, string_agg(list, '+' order by list) as source from lists group by all),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from f)
select query_id, doc_id, rank, round(score, 6) as score, source from rk where rank <= 10""")
def retrieval_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and vectors fused by reciprocal ranks, with the lists that had each document."""
    return retrieval.hybrid(*_lists(spark, sf_dir)).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "source")


@query(f"""with {_LISTS},
n as (select *, max(rank) over (partition by query_id, list) as longest from lists),
f as (select query_id, doc_id, sum(case list when 'bm25' then 0.7 else 0.3 end * (longest - rank + 1) / longest) as score from n group by all),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from f)
select query_id, doc_id, rank, round(score, 6) as score from rk where rank <= 10""")
def retrieval_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, near = _lists(spark, sf_dir)
    rows = lexical.select("query_id", "doc_id", F.lit("bm25").alias("list"), "rank").unionByName(near.select("query_id", "doc_id", F.lit("vector").alias("list"), "rank"))
    return published(retrieval.top_k(retrieval.score_fusion(rows, {"bm25": 0.7, "vector": 0.3}), 10))


_HALVES = """halves as (select item_id, part, case part when 0 then substr(text, 1, length(text) // 2) else substr(text, length(text) // 2 + 1) end as text
  from benchmark cross join (select unnest([0, 1]) as part))"""


@query(f"""with {_HALVES}, {_TOKENS.replace("select item_id as query_id", "select item_id * 2 + part as query_id").replace("(select item_id, unnest", "(select item_id, part, unnest").replace("from benchmark)", "from halves)")},
idf as ({LUCENE}),
sc as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score
  from tf join qt using (term) join idf using (term) join dl using (doc_id) cross join st group by all),
lists as (select query_id // 2 as query_id, query_id % 2 as list, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0),
f as (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from lists where rank <= 10 group by all),
rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from f)
select query_id, doc_id, rank, round(score, 6) as score from rk where rank <= 5""")
def retrieval_multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each item as queries of their own, fused without weights."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text")))
    halves = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("part", "text")).select((F.col("item_id") * 2 + F.col("part")).alias("query_id"), "text")
    found = retrieval.bm25(load(spark, sf_dir, "documents"), halves, "query_id", "text", k=10)
    lists = found.select(F.floor(F.col("query_id") / 2).cast("long").alias("query_id"), "doc_id", (F.col("query_id") % 2).cast("string").alias("list"), "rank")
    return published(retrieval.top_k(retrieval.rrf(lists), 5))


#: Terms as the relevance function has them; no CJK in the tables.
_OVERLAP = "len(list_intersect(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9_]+')), list_distinct(regexp_extract_all(lower({b}), '[a-z0-9_]+'))))::double / len(list_distinct(regexp_extract_all(lower({a}), '[a-z0-9_]+')))"
_CANDIDATES = f"""{_TOKENS},
idf as ({LUCENE}),
sc as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) as score
  from tf join qt using (term) join idf using (term) join dl using (doc_id) cross join st group by all),
lex as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0),
cand as (select query_id, doc_id, lex.rank, b.text as query, d.text as text, least(0.99, {_OVERLAP.format(a="b.text", b="d.text")}) as relevance
  from lex join benchmark b on b.item_id = query_id join documents d using (doc_id) where lex.rank <= 15)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    found = retrieval.bm25(docs, benchmark, "item_id", "text", k=15)
    return retrieval.with_texts(found.join(benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id"), docs.select("doc_id", "text"))


@query(f"""with {_CANDIDATES},
rk as (select query_id, doc_id, relevance as score, row_number() over (partition by query_id order by round(relevance, 9) desc, doc_id) as rank from cand where relevance >= 0.2)
select query_id, doc_id, rank, round(score, 6) as score from rk where rank <= 5""")
def retrieval_overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times the candidates, reordered by term overlap, those below the threshold dropped."""
    return published(retrieval.rerank(_candidates(spark, sf_dir), "query", "text", 5, threshold=0.2))


@query(f"""with {_CANDIDATES},
g as (select query_id, count(*) as n_docs, count(*) filter (relevance >= 0.5) as n_high, count(*) filter (relevance >= 0.25 and relevance < 0.5) as n_medium,
  count(*) filter (relevance < 0.25) as n_low, avg(relevance) as mean_score from cand group by all)
select query_id, n_docs, n_high, n_medium, n_low, round(mean_score, 6) as mean_score,
  case when n_high = 0 and n_medium = 0 and n_low / n_docs >= 0.8 then 'no_results' when n_high / n_docs >= 0.2 and mean_score >= 0.25 then 'high'
    when n_high + n_medium > 0 and mean_score >= 0.15 then 'medium' else 'low' end as decision from g""")
def correction_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of each item's results, and what they decide."""
    return correction.decisions(correction.graded(_candidates(spark, sf_dir))).withColumn("mean_score", F.round("mean_score", 6))


@query()
def correction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds; the second asks with the first half of the item only."""
    docs = load(spark, sf_dir, "documents")

    def retrieve(queries: DataFrame) -> DataFrame:
        found = retrieval.bm25(docs, queries, "query_id", "query", k=5)
        return retrieval.with_texts(found.join(queries, "query_id"), docs.select("doc_id", "text"))

    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    shorter = lambda q: q.withColumn("query", F.expr("substr(query, 1, int(length(query) / 2))"))
    found = correction.corrective_retrieval(queries, retrieve, shorter, rounds=2)
    return found.select("query_id", "doc_id", "rank", "grade", "decision", "round")


@query(f"""select role, count(*) filter (ok) as readable, count(*) as documents from (
  select r.role, r.role is not null and coalesce(state, 'active') = 'active' and case confidentiality when 'public' then 0 when 'internal' then 1 when 'confidential' then 2 else 3 end <= r.top
    and list_contains(string_split(r.shown, ','), visibility) and (departments = '' or r.department in ('dev', 'ops'))
    and effective_date != 'soon' and (effective_date = '' or effective_date <= '{TODAY}') and (expiry_date = '' or expiry_date >= '{TODAY}') as ok
  from ({DERIVED}) cross join (values ('student', 1, 'public', 'lab'), ('employee', 1, 'public', 'ops'), ('senior_student', 2, 'public,project', 'dev'), ('pi', 3, 'public,project,restricted', 'lab'), ('stranger', 1, 'public', 'lab')) as r(role, top, shown, department)) group by role""")
def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of readable documents for each of five users."""
    users = (("student", "lab"), ("employee", "ops"), ("senior_student", "dev"), ("pi", "lab"), ("stranger", "lab"))
    docs = derived(spark, sf_dir)
    every = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(d).alias("department")) for r, d in users)))
    rows = docs.drop("text").select("*", every.alias("u"))
    rule = access.may_read(F.col("u.role"), F.col("u.department"), F.lit(True), F.col("confidentiality"), F.col("visibility"), F.col("departments"), F.lit(""), F.col("effective_date"), F.col("expiry_date"), F.lit(TODAY).cast("date"))
    return rows.groupBy(F.col("u.role").alias("role")).agg(F.count_if(access.is_published("state") & rule).alias("readable"), F.count("*").alias("documents"))


@query(f"select doc_id from ({DERIVED}) where confidentiality in ('public', 'internal', 'confidential') and visibility in ('public', 'project')")
def access_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the rules that can be pushed to a scan, for a teacher."""
    return derived(spark, sf_dir).where(access.prefilter(F.lit("teacher"), "confidentiality", "visibility")).select("doc_id")


@query(f"""select doc_id, effective_date != 'soon' and (effective_date = '' or effective_date <= '{TODAY}') and (expiry_date = '' or expiry_date >= '{TODAY}') as in_effect,
  effective_date != 'soon' and (effective_date = '' or effective_date <= '{TODAY}') as with_expired from ({DERIVED})""")
def version_in_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return derived(spark, sf_dir).select("doc_id", access.in_effect("effective_date", "expiry_date", today).alias("in_effect"), access.in_effect("effective_date", "expiry_date", today, include_expired=True).alias("with_expired"))


@query("select doc_id, lang, source, n_chars from documents where lang in ('en', 'de') and source != 'src0' and (n_chars >= 2000 or contains(source, '1')) and n_chars < 9000 and source not in ('src3', 'src4') and lang is not null")
def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All operators of the filter language in one condition; it reaches the scan as pushed filters."""
    condition = {"lang": {"$in": ["en", "de"], "$exists": True}, "source": {"$ne": "src0", "$nin": ["src3", "src4"]}, "n_chars": {"$lt": 9000}, "$or": [{"n_chars": {"$gte": 2000}}, {"source": {"$contains": "1"}}]}
    return load(spark, sf_dir, "documents").where(filters.compiled(condition)).select("doc_id", "lang", "source", "n_chars")


@query(f"select doc_id, state from ({DERIVED}) where coalesce(state, 'active') = 'active' and lang = 'en'")
def filter_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir).where(access.is_published("state") & filters.compiled({"lang": "en"})).select("doc_id", "state")


@query("""with r as (select conv_id, turn, regexp_replace(text, '[ \\t\\r\\n]+', '', 'g') as c from conversations)
select conv_id, turn, coalesce(regexp_matches(c, '[A-Za-z0-9]') and not (length(c) >= 32 and len(list_distinct(string_split(c, ''))) <= 2), false) as meaningful from r""")
def filter_meaningful_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_meaningful_query("text").alias("meaningful"))


@query(f"""with e as (select o_orderkey % 50 as run_id, o_orderkey % (select count(*) from documents) as doc_id from orders),
v as (select doc_id from ({DERIVED}) where coalesce(state, 'active') = 'active' and confidentiality != 'secret')
select run_id, count(*) as found, count(v.doc_id) as kept, count(v.doc_id) = 0 as blocked from e left join v using (doc_id) group by run_id""")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of each run that pass the access rules; a run without any is blocked."""
    docs = derived(spark, sf_dir)
    n = docs.count()
    rows = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("run_id"), (F.col("o_orderkey") % n).alias("doc_id"))
    seen = docs.where(access.is_published("state") & (F.col("confidentiality") != "secret")).select("doc_id", F.lit(1).alias("ok"))
    return rows.join(seen, "doc_id", "left").groupBy("run_id").agg(F.count("*").alias("found"), F.count("ok").alias("kept"), (F.count("ok") == 0).alias("blocked"))
