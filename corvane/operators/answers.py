"""Answers and what they rest on: measures without a model, provenance, gates on claims and memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name, term_relevance, terms

# Marks of citations, labels and headings of an answer that state nothing themselves.
CITATION = r"\[(?:文档\s*(\d+)|S\s*(\d+))\]"
LABELS = ("证据局限", "资料冲突", "前提核验")
HEADINGS = r"(?i)^#{0,6}\s*(研究问题|已有证据|关键事实|冲突/不确定项|推断|下一步研究建议|Sources)\s*$"
NUMBERED, PROPOSALS = r"^#{0,6}\s*\d+[.、]\s*", r"^(推断|建议)[:：]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def answer_sentences(answer: Column | str, least: int = 6) -> Column:
    """Sentences of at least so many characters."""
    parts = F.transform(F.split(F.coalesce(_col(answer), F.lit("")), r"[。！？!?；;\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def citation_coverage(answer: Column | str) -> Column:
    """Share of the sentences that state something which cite a source; 0 if none does."""
    idle = lambda s: s.startswith(">") | s.rlike("|".join(LABELS)) | s.rlike(NUMBERED) | s.rlike(HEADINGS) | s.rlike(PROPOSALS)
    stating = F.filter(answer_sentences(answer), lambda s: ~idle(s))
    cited = F.size(F.filter(stating, lambda s: s.rlike(CITATION)))
    return F.when(F.size(stating) > 0, cited / F.size(stating)).otherwise(0.0)


def keyword_correctness(answer: Column | str, keywords: Column) -> Column:
    """Share of the keywords that the answer has, by letters and digits only; 1 without keywords."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "")
    body = bare(F.coalesce(_col(answer), F.lit("")))
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(body, bare(k)))) / F.size(keywords)).otherwise(1.0)


def claim_mentioned(answer: Column | str, claim: Column | str, least: float = 0.35) -> Column:
    """Whether an answer holds this share of a claim's words of three letters and pairs of CJK characters."""
    lowered, body = F.lower(F.coalesce(_col(claim), F.lit(""))), F.lower(F.coalesce(_col(answer), F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))
    words = F.array_distinct(F.concat(F.regexp_extract_all(lowered, F.lit("[a-z0-9_+.-]{3,}"), F.lit(0)), pairs))
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(body, w))) / F.size(words) >= least).otherwise(False)


def context_overlap(context: Column | str, truth: Column | str, query: Column | str) -> Column:
    """Struct (recall, precision, query_overlap) of terms: of the truth in the context, of the context in the truth and in the query."""
    c, t, q = terms(context), terms(truth), terms(query)
    share = lambda a, b, none: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(none)
    return F.struct(share(t, c, 1.0).alias("recall"), share(c, t, 0.0).alias("precision"), share(c, q, 0.0).alias("query_overlap"))


def title_recall(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Share of a case's expected titles (case_id, title) of which one stands in a found title, or the other way round.

    Upper case and spaces do not count. Titles are compared within their case only.
    """
    bare = F.regexp_replace(F.lower("title"), " ", "")
    want = expected.select("case_id", "title", bare.alias("e")).distinct()
    have = found.select("case_id", bare.alias("a")).distinct()
    hit = want.join(have, "case_id").where(F.contains("a", F.col("e")) | F.contains("e", F.col("a"))).select("case_id", "title").distinct().withColumn("hit", F.lit(1))
    return want.join(hit, ["case_id", "title"], "left").groupBy("case_id").agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*")).alias("recall"))


def support_rate(claims: DataFrame, evidence: DataFrame, least: float = 0.12) -> DataFrame:
    """For each run the share of its claims that some cited excerpt supports by common terms."""
    cited = claims.select("run_id", "claim_id", F.col("text").alias("claim"), F.explode_outer("source_ids").alias("source_id"))
    pairs = cited.join(evidence.select("run_id", "source_id", "excerpt"), ["run_id", "source_id"], "left")
    good = F.max(F.coalesce(term_relevance("claim", "excerpt") >= least, F.lit(False)).cast("int"))
    return pairs.groupBy("run_id", "claim_id").agg(good.alias("good")).groupBy("run_id").agg(F.count("*").alias("claims"), F.avg("good").alias("support"))


def provenance(docs: DataFrame, unknown: str = "unknown", system: str = "upload") -> DataFrame:
    """Numbers of passages by shown name, version, date and system (columns source, version, effective_date, source_system)."""
    filled = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other)).alias(c)
    name = F.coalesce(F.nullif(display_name("source"), F.lit("")), F.lit(unknown)).alias("name")
    return docs.select(name, filled("version", unknown), filled("effective_date", unknown), filled("source_system", system)).groupBy("name", "version", "effective_date", "source_system").agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Numbers of rows for each value, with their share of all rows or of the group."""
    keys = by or []
    counts = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    joined = counts.join(totals, keys) if keys else counts.join(F.broadcast(totals))
    return joined.withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def merged_counters(rows: DataFrame, by: str, counters: str) -> DataFrame:
    """Sums of the counters (a map) of all stages: (by, name, total)."""
    return rows.select(by, F.explode(counters).alias("name", "value")).groupBy(by, "name").agg(F.sum("value").alias("total"))


def confirmable_claims(claims: DataFrame, runs: DataFrame, evidence: DataFrame, visible: DataFrame, rejected: DataFrame) -> DataFrame:
    """Claims that may become knowledge: facts of completed, passed runs that the reviewer kept, all of whose sources are there and may be read.

    claims: (run_id, claim_id, claim_type, source_ids); runs: (run_id, status, decision); evidence: (run_id, source_id, doc_id);
    visible: (doc_id); rejected: (run_id, claim_id).
    """
    good = runs.where((F.col("status") == "completed") & (F.col("decision") == "PASS")).select("run_id")
    facts = claims.where((F.col("claim_type") == "fact") & (F.size("source_ids") > 0)).join(good, "run_id", "left_semi").join(rejected.select("run_id", "claim_id"), ["run_id", "claim_id"], "left_anti")
    readable = evidence.join(visible.select("doc_id"), "doc_id", "left_semi").select("run_id", "source_id").distinct()
    missing = facts.select("run_id", "claim_id", F.explode("source_ids").alias("source_id")).join(readable, ["run_id", "source_id"], "left_anti")
    return facts.join(missing.select("run_id", "claim_id").distinct(), ["run_id", "claim_id"], "left_anti")


def _same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def verified_knowledge(records: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Records whose claim still says the same from the same sources, all of which may still be read, with these sources.

    Anything that cannot be verified is left out. records: (id, run_id, claim_id, statement, source_ids); claims: (run_id,
    claim_id, text, source_ids); evidence: (run_id, source_id, title, excerpt, page, chunk_id), what the reader may see.
    """
    said = claims.select("run_id", "claim_id", F.trim("text").alias("_text"), F.col("source_ids").alias("_ids"))
    same = records.join(said, ["run_id", "claim_id"]).where((F.col("_text") == F.col("statement")) & _same_set(F.col("_ids"), F.col("source_ids"))).drop("_text", "_ids")
    named = lambda c: F.when(F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
    locator = F.coalesce(named("page"), named("chunk_id"), F.concat(F.lit("source_id="), F.col("source_id")))
    known = evidence.select("run_id", "source_id", F.struct("source_id", F.coalesce("title", "source_id").alias("title"), "excerpt", locator.alias("locator")).alias("source"))
    cited = same.select("id", "run_id", F.explode("source_ids").alias("source_id")).distinct().join(known, ["run_id", "source_id"], "left")
    sources = cited.groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.count_if(F.col("source").isNull()).alias("_hidden"))
    return same.join(sources.where("_hidden = 0").drop("_hidden"), "id")


def valid_memory(project: Column, memory_project: Column, sources: Column, memory_sources: Column, confirmed: Column) -> Column:
    """Whether a remembered claim is still what was confirmed: same project, same sources, none twice."""
    once = lambda ids: F.size(ids) == F.size(F.array_distinct(ids))
    same = _same_set(sources, memory_sources) & once(sources) & once(memory_sources) & (F.size(memory_sources) > 0)
    return F.coalesce(confirmed & (F.coalesce(project, F.lit("")) == F.coalesce(memory_project, F.lit(""))) & same, F.lit(False))


def merged_reviews(reviews: DataFrame, issues: DataFrame) -> DataFrame:
    """Reviews (run_id, decision) after issues found by rule (run_id, issue): a pass with issues becomes a revision."""
    counts = issues.groupBy("run_id").agg(F.count("*").alias("n_issues"))
    joined = reviews.join(counts, "run_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))
    return joined.withColumn("decision", F.when((F.col("n_issues") > 0) & (F.col("decision") == "PASS"), "REVISE").otherwise(F.col("decision")))


def retrieval_trace(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each query: a digest instead of its text, the number of results, the best score, and a status."""
    found = results.groupBy("query_id").agg(F.count("*").alias("results"), F.max("score").alias("best_score"))
    rows = queries.select("query_id", F.substring(F.sha2("query", 256), 1, 16).alias("query_digest")).join(found, "query_id", "left")
    return rows.withColumn("results", F.coalesce("results", F.lit(0))).withColumn("status", F.when(F.col("results") > 0, "ok").otherwise("empty"))


def evidence_for_subquestions(subquestions: DataFrame, retrieve, most: int = 4, limit: int = 12) -> DataFrame:
    """Evidence (run_id, source_id, doc_id, excerpt, score) for up to ``most`` subquestions (run_id, position, question) of each run.

    ``retrieve`` gives (query_id, doc_id, text, score) for all of them at once. A passage
    found for several counts with its best score; the best ``limit`` of a run are numbered S1, S2, ...
    """
    from pyspark.sql import Window as W

    asked = subquestions.where(F.col("position") < most).select("run_id", F.concat_ws("/", F.col("run_id").cast("string"), F.col("position").cast("string")).alias("query_id"), F.col("question").alias("query"))
    found = retrieve(asked.select("query_id", "query")).join(asked.select("query_id", "run_id"), "query_id")
    best = found.groupBy("run_id", "doc_id").agg(F.max("score").alias("score"), F.first("text").alias("excerpt"))
    n = F.row_number().over(W.partitionBy("run_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    rows = best.withColumn("n", n).where(F.col("n") <= limit)
    return rows.select("run_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("source_id"), "doc_id", "excerpt", "score")


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    """All doubles rounded, as reports show them."""
    return rows.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes))


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row: number of files (name, digest) and the sum of the hashes of their pairs, the same in any order."""
    pair = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "name", "digest"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.agg(F.count("*").alias("files"), F.sum(pair).cast("string").alias("digest"))


#: What an assembled answer says besides its claims. Fixed values.
NO_EVIDENCE = "现有权限范围内没有找到足够证据，无法可靠完成这项复杂科研分析。"
PREMISE_TEXTS = {
    "supported": "**前提核验**：当前证据支持该前提成立。", "unsupported": "**前提核验**：当前证据不支持该前提，该前提不成立。", "insufficient": "**前提核验**：当前证据不足，无法确认该前提是否成立。",
}
CONFLICTS, NO_CONFLICT = "**资料冲突**：", "**冲突核验**：现有证据不足以确认资料之间是否构成事实冲突；不能把缺少资料直接解释为结论一致。"
REVISED = "> 已按独立复核意见完成一次受限修订；未获得证据支持的内容不应视为事实。"
ASKS_CONFLICT, NAMES_CONFLICT = "冲突|矛盾|不一致|新旧.{0,8}差异", "冲突|矛盾|不一致"


def assembled(claims: Column, draft: Column, n_evidence: Column, premise: Column, false_premise: Column, conflicts: Column, question: Column, decision: Column, revisions: Column) -> Column:
    """The final answer: rendered claims (or the draft), what was found of the premise in front, then conflicts, then what a revision left open.

    ``conflicts`` is an array; they are named unless the answer does. A question about conflicts gets a word
    about them in any case. Without evidence there is no answer but that.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    body = F.when(F.coalesce(n_evidence, F.lit(0)) == 0, NO_EVIDENCE).otherwise(F.coalesce(F.nullif(text(claims), F.lit("")), F.trim(text(draft))))
    verdict = F.when((premise == "not_applicable") & F.coalesce(false_premise, F.lit(False)), "unsupported").otherwise(premise)
    front = F.lit("")
    for name, words in PREMISE_TEXTS.items():
        front = F.when(verdict == name, words + "\n\n").otherwise(front)
    first = F.concat(front, body)
    listed = F.coalesce(F.array_join(conflicts, "；"), F.lit(""))
    second = F.concat(first, F.when((listed != "") & ~F.contains(first, F.lit("冲突")), F.concat(F.lit("\n\n" + CONFLICTS), listed)).otherwise(""))
    third = F.concat(second, F.when(text(question).rlike(ASKS_CONFLICT) & ~second.rlike(NAMES_CONFLICT), "\n\n" + NO_CONFLICT).otherwise(""))
    return F.concat(third, F.when((text(decision) != "PASS") & (F.coalesce(revisions, F.lit(0)) >= 1), "\n\n" + REVISED).otherwise(""))


def package_documents(packages: DataFrame) -> DataFrame:
    """(run_id, place, source_id, title, source, text) of packages (run_id, evidences), in the order of the evidence: numbers S1, S2 keep their meaning."""
    rows = packages.select("run_id", F.posexplode("evidences").alias("place", "e"))
    return rows.select("run_id", (F.col("place") + 1).cast("long").alias("place"), "e.source_id", "e.title", "e.source", F.col("e.excerpt").alias("text"))


def resolved_items(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Review items (run_id, claim, ...) in which a claim's id gives way to its text (run_id, claim_id, text)."""
    named = claims.select("run_id", F.col("claim_id").alias("claim"), F.col("text").alias("_text")).dropDuplicates(["run_id", "claim"])
    return items.join(named, ["run_id", "claim"], "left").withColumn("claim", F.coalesce("_text", "claim")).drop("_text")


def reviewed(reviews: DataFrame) -> DataFrame:
    """Reviews after rules: (run_id, decision, premise, false_premise, n_issues by rule, has_premise_item, premise_task) with their final decision.

    A pass with issues becomes a revision. Of a task that checks a premise a verdict of not_applicable becomes
    unsupported, if the reviewer called the premise false, else insufficient; anything but supported needs an item
    (``adds_item`` where there is none) and a revision.
    """
    task = F.coalesce("premise_task", F.lit(False))
    own = F.when(task & (F.col("premise") == "not_applicable"), F.when(F.coalesce("false_premise", F.lit(False)), "unsupported").otherwise("insufficient")).otherwise(F.col("premise"))
    rows = reviews.withColumn("premise", own)
    open_ = task & F.col("premise").isin("unsupported", "insufficient")
    needs = open_ | (F.coalesce("n_issues", F.lit(0)) > 0)
    decision = F.when((F.col("decision") == "PASS") & needs, "REVISE").otherwise(F.col("decision"))
    false_premise = F.when(task, F.col("premise") == "unsupported").otherwise(F.col("false_premise"))
    return rows.withColumns({"decision": decision, "false_premise": false_premise, "adds_item": open_ & ~F.coalesce("has_premise_item", F.lit(False))})
