"""Registered queries: answers, claims and evidence, reviews, knowledge, and evaluation without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import research, text
from ..operators import answers, evaluation, evidence, metrics, retrieval
from .base import Catalogue, load

catalogue = Catalogue()
query = catalogue.query

#: Messages as answers that cite: some sentences of a message carry a mark, by the message's turn.
_CITED = "replace(text, '. ', case when turn % 3 = 0 then ' [S1]. ' when turn % 3 = 1 then '! ' else '; ' end)"


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("turn") % 3 == 0, " [S1]. ").when(F.col("turn") % 3 == 1, "! ").otherwise("; ")
    return load(spark, sf_dir, "conversations").withColumn("answer", F.replace(F.col("text"), F.lit(". "), mark))


@query(rf"""with s as (select conv_id, turn, list_filter(list_transform(regexp_split_to_array({_CITED}, '[。！？!?；;\n]+'), lambda x: trim(x)), lambda x: length(x) >= 6) as s from conversations),
t as (select conv_id, turn, list_filter(s, lambda x: not starts_with(x, '>') and not regexp_matches(x, '^#{{0,6}}\s*\d+[.、]\s*')) as s from s)
select conv_id, turn, round(case when len(s) > 0 then len(list_filter(s, lambda x: regexp_matches(x, '\[S\s*(\d+)\]'))) / len(s) else 0 end, 6) as coverage from t""")
def answers_citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).select("conv_id", "turn", F.round(answers.citation_coverage("answer"), 6).alias("coverage"))


@query("""with k as (select doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') as b, [lower(lang || source), 'with', 'fromthe', ''] as k from documents)
select doc_id, round(len(list_filter(k, lambda x: contains(b, x))) / 4.0, 6)::double as correctness from k""")
def answers_keyword_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords as letters and digits in whole documents."""
    words = F.array(F.concat_ws("-", "lang", "source"), F.lit("With"), F.lit("from the"), F.lit(""))
    return load(spark, sf_dir, "documents").select("doc_id", F.round(answers.keyword_correctness("text", words), 6).alias("correctness"))


@query("""with w as (select item_id, doc_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_+.-]{3,}')) as w, lower(d.text) as t from benchmark b join documents d on d.doc_id % 40 = b.item_id)
select item_id, doc_id, case when len(w) > 0 then len(list_filter(w, lambda x: contains(t, x))) / len(w) >= 0.35 else false end as mentioned from w""")
def answers_claim_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    docs = load(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % 40)
    return docs.join(items, "item_id").select("item_id", "doc_id", answers.claim_mentioned("text", "claim").alias("mentioned"))


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+'))"


@query(f"""with t as (select conv_id, turn, {_TERMS.format("text")} as c, {_TERMS.format("lead(text) over (partition by conv_id order by turn)")} as t, {_TERMS.format("role")} as q from conversations)
select conv_id, turn, round(case when len(t) > 0 then len(list_intersect(t, c)) / len(t) else 1 end, 6) as recall, round(case when len(c) > 0 then len(list_intersect(c, t)) / len(c) else 0 end, 6) as precision,
  round(case when len(c) > 0 then len(list_intersect(c, q)) / len(c) else 0 end, 6) as query_overlap from t where t is not null""")
def answers_context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message against the next one of its conversation."""
    from ..operators.ordered import with_next

    rows = with_next(load(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["text"]).where("next_text is not null")
    found = rows.select("conv_id", "turn", answers.context_overlap("text", "next_text", "role").alias("o"))
    return found.select("conv_id", "turn", *(F.round(f"o.{c}", 6).alias(c) for c in ("recall", "precision", "query_overlap")))


@query("""with e as (select distinct p_partkey % 50 as case_id, p_brand as title from part), f as (select distinct p_partkey % 50 as case_id, p_brand || ' ' || p_size as title from part where p_partkey % 3 = 0),
h as (select e.case_id, e.title, max((contains(lower(replace(f.title, ' ', '')), lower(replace(e.title, ' ', ''))))::int) as hit from e left join f using (case_id) group by all)
select case_id, round(sum(coalesce(hit, 0)) / count(*), 6) as recall from h group by case_id""")
def answers_title_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").withColumn("case_id", F.col("p_partkey") % 50)
    expected = part.select("case_id", F.col("p_brand").alias("title"))
    found = part.where("p_partkey % 3 = 0").select("case_id", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("title"))
    return answers.title_recall(expected, found).withColumn("recall", F.round("recall", 6))


#: Each benchmark item is a run; the documents of its remainder are its evidence, and claims cite by position.
_CLAIMS = """ev as (select doc_id % 40 as run_id, 'S' || (doc_id // 40 % 5) as source_id, min(text) as excerpt, min(doc_id) as doc_id from documents group by all),
cl as (select item_id as run_id, 'C' || c as claim_id, text, case when c = 0 then []::varchar[] else ['S' || c, 'S' || (c + 3)] end as source_ids from benchmark, range(0, 4) r(c))"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    source = F.concat(F.lit("S"), (F.floor(F.col("doc_id") / 40) % 5).cast("string"))
    found = docs.groupBy((F.col("doc_id") % 40).alias("run_id"), source.alias("source_id")).agg(F.min("text").alias("excerpt"), F.min("doc_id").alias("doc_id"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = F.col("c")
    cited = F.when(c == 0, F.array().cast("array<string>")).otherwise(F.array(name("S", c), name("S", c + 3)))
    claims = items.select(F.col("item_id").alias("run_id"), "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).select("run_id", name("C", c).alias("claim_id"), "text", cited.alias("source_ids"))
    return claims, found


_SHARE = f"""least(0.99, len(list_intersect({_TERMS.format("cl.text")}, {_TERMS.format("excerpt")})) / len({_TERMS.format("cl.text")}))"""


@query(f"""with {_CLAIMS}, p as (select run_id, claim_id, text, unnest(source_ids) as source_id from cl), g as (select run_id, claim_id, max(({_SHARE.replace("cl.text", "p.text")} >= 0.12)::int) as good from p join ev using (run_id, source_id) group by all)
select run_id, count(*) as claims, round(avg(coalesce(good, 0)), 6) as support from cl left join g using (run_id, claim_id) group by run_id""")
def answers_support_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, found = _claims(spark, sf_dir)
    return answers.support_rate(claims, found).withColumn("support", F.round("support", 6))


@query(f"""with {_CLAIMS}, s as (select run_id, claim_id, unnest(source_ids) as source_id from cl), bad as (select distinct run_id, claim_id from s anti join ev using (run_id, source_id)),
rj as (select run_id, text from cl where run_id % 4 = 1 and claim_id = 'C1')
select run_id, claim_id from cl where len(source_ids) > 0 and (run_id, claim_id) not in (select (run_id, claim_id) from bad) and (run_id, text) not in (select (run_id, text) from rj)""")
def evidence_valid_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with sources that exist and texts that no reviewer rejected."""
    claims, found = _claims(spark, sf_dir)
    rejected = claims.where("run_id % 4 = 1 and claim_id = 'C1'").select("run_id", F.col("text").alias("claim"))
    return evidence.valid_claims(claims, found, rejected).select("run_id", "claim_id")


@query(f"""with {_CLAIMS}, r as (select distinct run_id, source_id from ev where doc_id % 9 != 0), s as (select run_id, claim_id, unnest(source_ids) as source_id from cl), bad as (select distinct run_id, claim_id from s anti join r using (run_id, source_id))
select run_id, claim_id from cl where claim_id != 'C3' and len(source_ids) > 0 and run_id % 5 != 0 and run_id % 6 != 1 and not (run_id % 7 = 2 and claim_id = 'C1') and (run_id, claim_id) not in (select (run_id, claim_id) from bad)""")
def evidence_confirmable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of completed and passed runs, not rejected, whose sources may all be read."""
    claims, found = _claims(spark, sf_dir)
    claims = claims.withColumn("claim_type", F.when(F.col("claim_id") == "C3", "inference").otherwise("fact"))
    runs = claims.select("run_id").distinct().select("run_id", F.when(F.col("run_id") % 5 == 0, "failed").otherwise("completed").alias("status"), F.when(F.col("run_id") % 6 == 1, "REVISE").otherwise("PASS").alias("decision"))
    rejected = claims.where("run_id % 7 = 2 and claim_id = 'C1'")
    return answers.confirmable_claims(claims, runs, found, found.where("doc_id % 9 != 0").select("doc_id").distinct(), rejected).select("run_id", "claim_id")


@query(f"""with {_CLAIMS}, rec as (select run_id * 10 + cast(claim_id[2:] as int) as id, run_id, claim_id, case when run_id % 3 = 0 then trim(text) || ' changed' else trim(text) end as statement, list_reverse(source_ids) as source_ids from cl where claim_id != 'C0'),
s as (select id, run_id, unnest(source_ids) as source_id from rec), bad as (select distinct id from s anti join (select * from ev where doc_id % 9 != 0) using (run_id, source_id))
select rec.id, len(rec.source_ids) as sources, 'source_id=' || list_min(rec.source_ids) as locator from rec join cl using (run_id, claim_id) where rec.statement = trim(cl.text) and id not in (select id from bad)""")
def evidence_verified_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose claim still says the same, and whose sources may all be read."""
    claims, found = _claims(spark, sf_dir)
    statement = F.when(F.col("run_id") % 3 == 0, F.concat(F.trim("text"), F.lit(" changed"))).otherwise(F.trim("text"))
    records = claims.where("claim_id != 'C0'").select((F.col("run_id") * 10 + F.substring("claim_id", 2, 9).cast("int")).alias("id"), "run_id", "claim_id", statement.alias("statement"), F.reverse("source_ids").alias("source_ids"))
    seen = found.where("doc_id % 9 != 0").withColumns({"title": F.lit(None).cast("string"), "page": F.lit(None).cast("string"), "chunk_id": F.lit("")})
    rows = answers.verified_knowledge(records, claims, seen)
    return rows.select("id", F.size("sources").cast("long").alias("sources"), F.col("sources")[0]["locator"].alias("locator"))


@query("select run_id, case when n > 0 and decision = 'PASS' then 'REVISE' else decision end as decision, n as n_issues from (select o_custkey as run_id, case when o_custkey % 4 = 0 then 'NEED_MORE_EVIDENCE' else 'PASS' end as decision, count(*) filter (o_orderstatus = 'P') as n from orders group by all)")
def reviews_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), "o_orderstatus")
    reviews = orders.select("run_id").distinct().withColumn("decision", F.when(F.col("run_id") % 4 == 0, "NEED_MORE_EVIDENCE").otherwise("PASS"))
    return answers.merged_reviews(reviews, orders.where("o_orderstatus = 'P'"))


@query("""select o_orderkey, case when o_orderkey % 2 = 0 then 'PASS' else 'REVISE' end as decision, o_orderkey % 3 as revisions, case when o_orderkey % 2 = 0 or o_orderkey % 3 >= 1 then 'generate' else 'revise' end as route,
  case when o_orderkey % 11 = 0 then 'acl' when o_orderkey % 7 = 0 then 'knowledge_gap' when o_orderkey % 5 = 0 then 'retrieval' when o_orderkey % 4 = 0 then 'analysis' when o_orderkey % 3 >= o_orderkey % 4 then 'review' when 1 < o_orderkey % 4 - o_orderkey % 3 then 'generation' else 'none' end as failure from orders""")
def reviews_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a review leads, and the first stage that failed."""
    k = F.col("o_orderkey")
    decision, revisions = F.when(k % 2 == 0, "PASS").otherwise("REVISE"), k % 3
    failure = evidence.failure_attribution(k % 11 == 0, k % 7, k % 5, k % 4, k % 3, F.lit(1))
    return load(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"), revisions.alias("revisions"), evidence.review_route(decision, revisions).alias("route"), failure.alias("failure"))


@query(f"""with {_CLAIMS} select run_id, md5(string_agg('- ' || text || case when len(source_ids) > 0 then ' [' || array_to_string(source_ids, '][') || ']' else '' end, chr(10) order by claim_id)) as digest from cl group by run_id""")
def evidence_rendered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rendered_claims(_claims(spark, sf_dir)[0]).select("run_id", F.md5("answer").alias("digest"))


@query("""with r as (select o_orderkey as run_id, o_custkey as question, o_orderstatus, o_orderkey % 4 as n, o_orderdate as created from orders where o_orderstatus = 'F' and o_orderkey % 3 != 0 and o_orderkey % 4 >= 2 and o_orderkey % 10 != 7)
select run_id, question from r qualify row_number() over (partition by question order by created desc, run_id) = 1""")
def evidence_reusable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest usable run of each question."""
    k = F.col("o_orderkey")
    runs = load(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("question"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"), F.when(k % 3 != 0, "PASS").otherwise("REVISE").alias("decision"), (k % 4).alias("n_subquestions"), F.col("o_orderdate").alias("created_at"))
    return evidence.reusable_runs(runs, runs.where("run_id % 10 = 7")).select("run_id", "question")


@query(f"""with {_CLAIMS}, h as (select run_id, count(*) as n from ev where doc_id % 3 = 0 group by run_id) select item_id as run_id, case when n is null then text end as answer, coalesce(n, 0) as n_hidden from benchmark left join h on run_id = item_id""")
def evidence_redacted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are withheld where some evidence may not be seen."""
    _, found = _claims(spark, sf_dir)
    runs = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), F.col("text").alias("answer"))
    return evidence.redacted_runs(runs, found, load(spark, sf_dir, "documents").where("doc_id % 3 != 0"))


@query(f"""with {_CLAIMS}, a as (select run_id, list(claim_id) as a from cl where claim_id != 'C2' group by 1), b as (select run_id, list(claim_id) as b from cl where claim_id != 'C' || (run_id % 4) group by 1)
select run_id, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), ',') as added, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as removed from a join b using (run_id)""")
def evidence_revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, _ = _claims(spark, sf_dir)
    ids = lambda rows: rows.groupBy("run_id").agg(F.collect_list("claim_id").alias("claim_ids"))
    diff = evidence.revision_diff(ids(claims.where("claim_id != 'C2'")), ids(claims.where(F.col("claim_id") != F.concat(F.lit("C"), (F.col("run_id") % 4).cast("string")))))
    return diff.select("run_id", *(F.array_join(F.array_sort(c), ",").alias(c) for c in ("added", "removed")))


@query("""select name, version, effective_date, source_system, count(*) as n from (select source as name, 'v' || (doc_id % 3) as version, case when doc_id % 2 = 0 then '2024-01-01' else 'unknown' end as effective_date, case when doc_id % 5 = 0 then lang else 'upload' end as source_system from documents) group by all""")
def evidence_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by shown name, version, date and system."""
    i = F.col("doc_id")
    rows = load(spark, sf_dir, "documents").select(F.concat(F.lit("/data/files/"), "source", F.lit(".pdf")).alias("source"), F.concat(F.lit("v"), (i % 3).cast("string")).alias("version"), F.when(i % 2 == 0, "2024-01-01").otherwise("").alias("effective_date"), F.when(i % 5 == 0, F.col("lang")).alias("source_system"))
    return answers.provenance(rows)


@query("select priority, failure, n, round(n / sum(n) over (partition by priority), 6) as share from (select o_orderpriority as priority, o_orderstatus as failure, count(*) as n from orders group by all)")
def evaluation_failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("failure"))
    return answers.histogram(rows, "failure", ["priority"]).withColumn("share", F.round("share", 6))


@query("select l_orderkey as run_id, 'items' as name, cast(count(*) as bigint) as total from lineitem group by 1 union all select l_orderkey, 'lines', cast(sum(l_linenumber) as bigint) from lineitem group by 1")
def evaluation_merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run's stages, added up."""
    counters = F.create_map(F.lit("items"), F.lit(1).cast("long"), F.lit("lines"), F.col("l_linenumber").cast("long"))
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), counters.alias("c"))
    return answers.merged_counters(rows, "run_id", "c")


@query("""with q as (select item_id as query_id, substr(sha256(text), 1, 16) as query_digest from benchmark), f as (select doc_id % 60 as query_id, count(*) as results, max(n_chars) as best_score from documents group by 1)
select query_id, query_digest, coalesce(results, 0) as results, best_score, case when results > 0 then 'ok' else 'empty' end as status from q left join f using (query_id)""")
def retrieval_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each query: a digest, counts, a status."""
    queries = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    results = load(spark, sf_dir, "documents").select((F.col("doc_id") % 60).alias("query_id"), F.col("n_chars").alias("score"))
    return answers.retrieval_trace(queries, results)


@query("""with sq as (select item_id as run_id, p, case when p = 0 then text[1:40] else text[41:80] end as q from benchmark, range(0, 2) r(p)),
qt as (select distinct run_id, p, unnest(regexp_extract_all(lower(q), '[a-z0-9_]+')) as term from sq), n as (select run_id, p, count(*) as n from qt group by all),
dt as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents),
sc as (select run_id, doc_id, max(least(0.99, c / n)) as score from (select run_id, p, doc_id, count(*) as c from qt join dt using (term) group by all) join n using (run_id, p) group by all),
rk as (select *, row_number() over (partition by run_id order by round(score, 9) desc, doc_id) as k from sc)
select run_id, 'S' || k as source_id, doc_id, round(score, 6) as score from rk where k <= 12""")
def retrieval_evidence_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two subquestions for each run; passages by the share of terms, the best twelve numbered."""
    docs, items = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    asked = items.select(F.col("item_id").alias("run_id"), F.posexplode(F.array(F.substring("text", 1, 40), F.substring("text", 41, 40))).alias("position", "question"))

    def by_terms(queries: DataFrame) -> DataFrame:
        # a passage among a run's twelve is among the twelve of the subquestion that gives it its score
        found = retrieval.overlap_search(docs.select("doc_id", text.terms("text").alias("words")), queries.select("query_id", text.terms("query").alias("words")), 12)
        return found.select("query_id", "doc_id", F.lit("").alias("text"), "score")

    return answers.evidence_for_subquestions(asked, by_terms).select("run_id", "source_id", "doc_id", F.round("score", 6).alias("score"))


@query("""select p_partkey, p_size % 2 = 0 and p_size % 5 = 0 and p_size % 3 != 0 as valid from part""")
def knowledge_valid_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remembered claims: same project, same sources in any order, none twice, confirmed."""
    s = F.col("p_size")
    sources = F.array(F.lit("S1"), F.lit("S2"))
    remembered = F.when(s % 3 != 0, F.array(F.lit("S2"), F.lit("S1"))).otherwise(F.array(F.lit("S1"), F.lit("S2"), F.lit("S1")))
    valid = answers.valid_memory(F.lit("alpha"), F.when(s % 5 == 0, "alpha"), sources, remembered, s % 2 == 0)
    return load(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"))


@query("""with q as (select p_partkey, case p_size % 5 when 0 then '请核验所有实验是否成立' else 'which is better' end as q, p_size % 2 = 0 as r, p_size % 3 = 0 as a, p_size % 7 = 0 as c from part)
select p_partkey, case when q = 'which is better' then 'not_applicable' when r then 'supported' when a and not c then 'unsupported' else 'insufficient' end as assessment, case when q = 'which is better' then '' when r then 'S1' when a and not c then 'S2' else '' end as sources from q""")
def research_reconciled_premise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewer and analyst say of a premise, by the sources that are there."""
    s = F.col("p_size")
    one = lambda *names: F.array(*map(F.lit, names))
    question = F.when(s % 5 == 0, "请核验所有实验是否成立").otherwise("which is better")
    out = research.reconciled_premise(question, F.lit("supported"), F.when(s % 2 == 0, one("S1", "S9")).otherwise(one("S9")), F.lit("unsupported"), F.when(s % 3 == 0, one("S2")), one("S1", "S2"), s % 7 == 0)
    return load(spark, sf_dir, "part").select("p_partkey", out.alias("o")).select("p_partkey", "o.assessment", F.array_join("o.source_ids", ",").alias("sources"))


_QUESTIONS = ("你好！", "根据知识库说明规范", "请计算 3 + 4", "根据下面内容生成论文摘要", "继续", "我之前提到的偏好是什么", "what else", "结合实验记录统计平均延迟", "润色这段摘要")
_ROUTES = ("general", "knowledge", "operation", "operation", "undecided", "general", "undecided", "knowledge", "operation")
_TOOLS = ("", "", "calculator", "paper_writing,text_analysis,citation_check", "", "", "", "statistics", "paper_writing,text_analysis,citation_check")


@query(f"""with q as (select unnest(range(1, 10)) as k), r as (select k, {list(_ROUTES)!r}[k] as handler, {list(_TOOLS)!r}[k] as tools from q) select conv_id, turn, handler, tools from conversations join r on k = turn % 9 + 1""")
def research_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by who answers them and with which tools."""
    question = F.get(F.array(*map(F.lit, _QUESTIONS)), (F.col("turn") % 9).cast("int"))
    routed = research.routed(question)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", routed.alias("r")).select("conv_id", "turn", "r.handler", F.array_join("r.tools", ",").alias("tools"))


@query("""select p_partkey, p_size % 4 in (0, 1) as is_complex, p_size % 4 in (0, 3) as is_premise from part""")
def research_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that need several sources, and those that ask to check a premise."""
    texts = ("请综合分析多个项目的论文并验证结论是否成立", "对比论文与实验记录的差异并形成下一步建议", "这个方法的中文名字叫什么来着请告诉我", "该前提是否属实")
    question = F.get(F.array(*map(F.lit, texts)), (F.col("p_size") % 4).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", research.is_complex(question).alias("is_complex"), research.is_premise_task(question).alias("is_premise"))


@query("""select c_custkey, case c_nationkey % 6 when 0 then 'citation_gap' when 1 then 'invalid_source' when 2 then 'acl' when 3 then 'unsupported' when 4 then 'none' else 'missing_evidence' end as issue from customer""")
def research_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("Missing_Claim_2", "bad source", "ACCESS denied", "odd", " none ", "weak evidence")
    value = F.get(F.array(*map(F.lit, names)), F.col("c_nationkey") % 6)
    return load(spark, sf_dir, "customer").select("c_custkey", research.issue_type(value).alias("issue"))


@query("""select event_id, case event_type when 'click' then 3.0 when 'view' then 2.0 when 'purchase' then 1.0 else 0.0 end::double as gain, least(5, greatest(1, user_id % 9))::double as score, ((least(5, greatest(1, user_id % 9)) - 1) / 4.0)::double as normalised from events""")
def evaluation_judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of relevance labels, and scores read from a judge's reply."""
    label = F.when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "relevant").when(F.col("event_type") == "purchase", "partially_relevant").otherwise("?")
    score = text.judge_score(F.concat(F.lit("fine. Score: "), (F.col("user_id") % 9).cast("string")))
    return load(spark, sf_dir, "events").select("event_id", text.gain_of(label).alias("gain"), score.alias("score"), text.normalised_score(score).alias("normalised"))


@query("""with r as (select o_orderkey % 2 = 0 as e, o_orderkey % 3 != 0 as a from orders), c as (select count(*) filter (e and a) as tp, count(*) filter (not e and a) as fp, count(*) filter (e and not a) as fn from r)
select tp, fp, fn, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from c""")
def metrics_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2 == 0).alias("e"), (F.col("o_orderkey") % 3 != 0).alias("a"))
    return answers.rounded(metrics.trigger_scores(rows, "e", "a"), 6)


@query("""with e as (select o_custkey as case_id, 'gold' as axis, o_orderkey as claim_id, o_orderkey % 4 as v from orders) select case_id, axis, claim_id, case v when 0 then 'supported' when 1 then 'contradicted' else 'not_enough_information' end as verdict from e""")
def evaluation_complete_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge left out, or said in other words, is not enough information."""
    expected = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.lit("gold").alias("axis"), F.col("o_orderkey").alias("claim_id"))
    v = F.col("claim_id") % 4
    given = expected.where(v != 2).withColumn("verdict", F.when(v == 0, "supported").when(v == 1, "contradicted").otherwise("perhaps"))
    return evaluation.complete_verdicts(expected, given)


@query("select o_custkey as case_id, o_orderkey as claim_id, cast(floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 8) as bigint) as batch from orders")
def evaluation_judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.lit("gold").alias("axis"), F.col("o_orderkey").alias("claim_id"))
    return evaluation.judge_batches(rows).select("case_id", "claim_id", "batch")


@query("select doc_id % 40 as query_id, count(*) as leaks from documents where doc_id % 3 = 0 group by 1")
def evaluation_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that their reader may not see."""
    results = load(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return evaluation.leaks(results, results.where("doc_id % 3 = 0 or doc_id % 7 = 0").where("doc_id % 3 = 0"))


@query("""with r as (select doc_id % 40 as query_id, doc_id, n_chars, text, row_number() over (partition by doc_id % 40 order by n_chars desc, doc_id) as rank from documents qualify rank <= 3)
select query_id, md5(string_agg('[' || rank || '] score=' || printf('%.4f', rank / 8.0) || chr(10) || text[1:800], chr(10) || chr(10) order by rank)) as digest from r group by query_id""")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts for a model: numbered passages of at most 800 characters."""
    rows = load(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "text", F.col("n_chars").alias("score"))
    top = retrieval.top_k(rows, 3).withColumn("score", F.col("rank") / 8)
    return retrieval.context(top).select("query_id", F.md5("context").alias("digest"))


@query("select count(*) as files, cast(sum(cast(('0x' || substr(sha256(p_name || chr(31) || md5(p_brand)), 1, 15)) as hugeint)) as varchar) as digest from part")
def evaluation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of many files, in any order."""
    return answers.manifest_digest(load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.md5("p_brand").alias("digest")))
