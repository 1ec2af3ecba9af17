"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled texts, smoothed by a
Dirichlet prior in proportion to the token's count in the whole corpus, and drawn
towards zero by their standard error. A text counts a token once, as texts that
repeat a word a hundred times are not a hundred witnesses. Less a fixed drift, their mean is negative,
so a linear scan finds all maximal scoring segments of a text, and Karlin-Altschul
statistics say how often chance gives such a segment. The significant ones are
summed, and a logistic fit on that sum gives a probability.

Tokens are counted in ``BUCKETS`` hashed buckets: the model has the same size
(``BUCKETS`` floats) for any vocabulary, which bounds what is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, narrow_name, stored

BUCKETS = 1 << 20
WORD = re.compile(r"\w+")
#: Words whose bucket or score a task remembers; then it starts anew.
REMEMBERED = 1 << 16
#: Taken from every token's score: the passage must earn it.
DRIFT = 0.2
#: Standard errors by which scores are drawn towards zero.
DOUBT = 2.0
#: Expected chance segments per text up to which a segment counts as significant.
SIGNIFICANT = 0.1


class Remembered(dict):
    """word -> value(bucket); of bounded size."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = self.value(crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
        return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence, in its order, in linear time (Ruzzo and Tompa).

    Only positive scores are walked over: ``before`` and ``after`` are the running
    totals on both sides of a segment.
    """
    total = np.cumsum(scores)
    kept: list[list] = []  # first, last, before, after, the nearest earlier segment with a smaller `before`
    for k in np.flatnonzero(scores > 0).tolist():
        after = float(total[k])
        first, before = k, after - float(scores[k])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                kept.append([first, k, before, after, j])
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


@dataclass
class ToxicityModel:
    """Score of each bucket, Karlin-Altschul lambda and K, and the logistic fit."""

    scores: np.ndarray
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0

    def segments(self, text: str | None, seen: Remembered) -> tuple[int, list[tuple[int, int, float]]]:
        words = WORD.findall((text or "").lower())
        return len(words), maximal_segments(np.array([seen[w] for w in words])) if words else []

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """Sum of the significant segments' normalised scores; these segments with E-values."""
        log_kn = np.log(self.k * max(n, 1))
        found = [(a, b, s, float(np.exp(min(log_kn - self.lam * s, 50.0)))) for a, b, s in segments]
        found = [x for x in found if x[3] <= SIGNIFICANT]
        return sum(self.lam * x[2] - log_kn for x in found), found

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -50, 50))))


def _token_score(sums):
    """A bucket's log-odds under the Dirichlet prior, less DOUBT standard errors and DRIFT; at least -DRIFT."""
    strength = min(sums["toxic"], sums["other"])
    prior = F.col("every") * (strength / sums["every"])
    toxic, other = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(toxic / (sums["toxic"] + strength)) - F.log(other / (sums["other"] + strength))
    return F.greatest(odds - DOUBT * F.sqrt(1 / toxic + 1 / other), F.lit(0.0)) - DRIFT


def _token_counts(docs: DataFrame, label: str) -> DataFrame:
    """Per bucket: numbers of toxic, other and all texts that hold its tokens. At most BUCKETS rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = Remembered(int), np.zeros((3, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch[label], strict=True):
                words = set(WORD.findall((text or "").lower()))
                if not words:
                    continue
                at = np.array(list({seen[w] for w in words}))
                total[2, at] += 1
                if toxic == toxic and toxic is not None:
                    total[1 - int(toxic), at] += 1
        used = np.flatnonzero(total[2])
        found = pd.DataFrame({"bucket": used, "toxic": total[0, used], "other": total[1, used], "every": total[2, used]})
        del seen, total
        give_back()
        yield found

    rows = docs.select("text", label).mapInPandas(count, "bucket long, toxic long, other long, every long")
    return rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("toxic", "other", "every")))


def _karlin_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1."""
    p = weights / weights.sum()
    low, high = 1e-6, 1.0
    total = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, positive: np.ndarray, count: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge, from grouped values."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([0.0, np.log((positive.sum() + 0.5) / (count.sum() - positive.sum() + 0.5))])
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a.T * (count * p * (1 - p))) @ a + ridge, a.T @ (positive - count * p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` rows (doc_id, toxic), one per doc_id, outside the held-out fold; chosen by a hash."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 2))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 50_000) -> ToxicityModel:
    """Token scores, extreme-value constants and the logistic fit.

    Labels come from at most ``max_labelled`` labelled documents, so their table
    may be broadcast; the corpus counts of the prior come from all documents.
    """
    rows = labelled(labels, max_labelled).select(F.col("doc_id").alias("_labelled_id"), F.col("toxic").alias("_toxic"))
    texts = docs.select("doc_id", "text")
    on = texts.doc_id == rows["_labelled_id"]
    counts = stored(_token_counts(texts.join(F.broadcast(rows), on, "left"), "_toxic"), "toxicity")
    model = ToxicityModel(np.full(BUCKETS, -DRIFT, dtype=np.float32))
    sums = counts.agg(*(F.sum(c).cast("double").alias(c) for c in ("toxic", "other", "every"))).first()
    if sums["toxic"] and sums["other"]:
        scores = counts.select("bucket", "every", _token_score(sums).alias("score"))
        positive = scores.where("score > 0").toPandas()
        model.scores[positive["bucket"].to_numpy(dtype=np.int64)] = positive["score"]
        spread = scores.groupBy(F.round("score", 2).alias("score")).agg(F.sum("every").alias("every")).toPandas()
        values, weights = spread["score"].to_numpy(dtype=float), spread["every"].to_numpy(dtype=float)
        if (values > 0).any() and values @ weights < 0:
            model.lam = _karlin_lambda(values, weights)
    seen = stored(texts.join(F.broadcast(rows), on), "toxicity-labelled")  # at most max_labelled ids; read twice
    chance = _top_segments(seen, model).where("_toxic = 0").agg(F.count("*"), F.sum("chance")).first()
    model.k = float(chance[0] / chance[1]) if chance[0] and chance[1] else 1.0
    bins = scored(seen, model, "_evidence").groupBy(F.round(F.col("_evidence.evidence") * 4).alias("bin"), "_toxic").count().toPandas()
    if len(bins):
        by = bins.pivot_table(index="bin", columns="_toxic", values="count", aggfunc="sum", fill_value=0)
        positive = by[1].to_numpy(dtype=float) if 1 in by else np.zeros(len(by))
        model.slope, model.intercept = _logistic(by.index.to_numpy(dtype=float) / 4, positive, by.sum(axis=1).to_numpy(dtype=float))
        model.slope = max(model.slope, 0.0)
    else:
        model.intercept = -50.0
    return model


def _top_segments(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with n * exp(-lambda S) of the best segment S: what the maximum-likelihood K of clean texts is made of."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        seen = Remembered(m.scores.item)
        for texts in batches:
            found = (m.segments(t, seen) for t in texts)
            yield pd.Series([max(n, 1) * np.exp(-m.lam * max((s for *_, s in parts), default=0.0)) for n, parts in found])

    return docs.withColumn("chance", chance("text"))


def scored(docs: DataFrame, model: ToxicityModel, out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score (0 to 1), evidence, and the significant segments in words (first, last, score, e_value)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence double, segments array<struct<first: int, last: int, score: double, e_value: double>>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        seen = Remembered(m.scores.item)
        for texts in batches:
            rows = []
            for text in texts:
                evidence, found = m.evidence(*m.segments(text, seen))
                rows.append((m.probability(evidence), float(evidence), [dict(zip(("first", "last", "score", "e_value"), x, strict=True)) for x in found]))
            yield pd.DataFrame(rows, columns=["score", "evidence", "segments"])
        give_back()

    return docs.withColumn(out, judge("text"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns stay as they are."""
    out = narrow_name(docs, "toxicity")
    return scored(docs, fit(docs, labels), out).where(F.col(f"{out}.score") < threshold).select(docs.columns)


def op6_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Columns doc_id, held_out, score, predicted and n_segments for every row.

    Null and empty texts have no segments and so the score of any text without
    evidence; texts of any length are scanned whole. With no labels of one class every
    text scores that class's rate. Of a doc_id's labels the higher counts, and a score
    equal to ``threshold`` (ties) is toxic. A null doc_id is never held out. Repeated rows
    come out as often as they went in; an empty table gives no rows; columns of other
    names are ignored.
    """
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return rows.select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"), F.size("toxicity.segments").alias("n_segments"),
    )
