"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order. A document's virtual finish time is the
words of its source up to and with it, divided by the source's target; the mix takes
documents in the order of finish times until the budget is spent, so that all sources reach
their shares together. Sources whose target is above their size begin again, in the same order.
Running totals are by range (``operators.ordered``), so that no source and no order has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running_total
from .common import ASCII_SPACE, spread_lookup, stored


def n_words(text: str) -> Column:
    """Words between ASCII spaces; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{ASCII_SPACE}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: int, most: int = 3) -> DataFrame:
    """``sources`` (key, n, size, weight) with ``target``: the budget by weight, but at most ``most`` times the size, the excess reshared by weight until none is above.

    A source is at its most if, at the share by weight that just fills it, all sources together
    do not exceed the budget; these come first in the order of most * size / weight.
    """
    full = sources.withColumn("most", most * F.col("size")).withColumn("level", F.col("most") / F.col("weight"))
    full = running_total(full, [], ["level", "key"], "filled", "most")
    full = stored(running_total(full, [], ["level", "key"], "weighed", "weight"), "mixing-levels")
    total = full.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    full = full.withColumn("at_most", F.col("filled") + F.col("level") * (total - F.col("weighed")) <= budget)
    spent, gone = full.where("at_most").agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share = (budget - spent) / (total - gone) if total > gone else 0.0
    return full.select("key", "n", "size", "weight", F.when(F.col("at_most"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def mixed(docs: DataFrame, seed: int = 13, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every row of ``docs``; the budget is all words.

    Sources, in the order of their code points with null last, get the ``weights`` in
    turn. The order within a source is by MD5 of seed and doc_id, so that reruns agree;
    rows that share doc_id and size may stand for each other. The last document that the budget
    reaches is taken in part. A document is taken at most ``most`` times.
    """
    key = F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1"))
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = stored(docs.select("doc_id", key.alias("key"), "source", n_words("text").alias("size"), turn.alias("turn")).withColumn("place", F.monotonically_increasing_id()), "mixing-sizes")
    sizes = stored(sized.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("size")), "mixing-sources")
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    weight = F.element_at(F.array(*map(F.lit, weights)), (1 + (F.col("rank") - 1) % len(weights)).cast("int"))
    weighed = numbered(sizes, [], ["key"], "rank").select("key", "n", "size", weight.cast("long").alias("weight"))
    aimed = stored(targets(weighed, budget, most).select("key", "n", F.col("size").alias("source_size"), "target"), "mixing-targets")
    rows = running_total(sized, ["key"], ["turn", "doc_id", "size"], "so_far", "size")
    rows = stored(spread_lookup(rows, aimed, "key", "n", ["source_size", "target"]), "mixing-rows")
    # a source goes round as often as its target needs, and once more to fill what others leave
    rounds = F.least(F.lit(most), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) + 1).cast("int")
    items = rows.where("size > 0").select("place", "key", "size", "so_far", "source_size", "target", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"))
    finish = (F.col("round") * F.col("source_size") + F.col("so_far")) / F.col("target")
    queue = running_total(items.select("place", "key", "size", "so_far", "round", finish.alias("finish")), [], ["finish", "key", "round", "so_far"], "spent", "size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("spent") + F.col("size")))
    taken = queue.groupBy("place").agg(F.sum(part).alias("taken"))
    return rows.join(taken, "place", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source")


def op13_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source) of every row of ``docs``.

    Null, empty and blank texts have size 0 and nothing is taken of them; texts of any length count whole.
    Rows without a source are one source, and so are rows with an empty one; a null doc_id
    orders as an empty one. Repeated rows come out as often as they went in, each with its own ``taken``. An
    empty table gives no rows; other columns are ignored.
    """
    return mixed(docs)


OP13_SQL = r"""with d as (select doc_id, source, coalesce('0' || source, '1') as key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5('13:' || coalesce(cast(doc_id as varchar), '')) as turn from documents),
s as (select key, sum(size)::bigint as source_size, 1 + (row_number() over (order by key) - 1) % 3 as weight from d group by key),
b as (select sum(source_size)::bigint as budget, sum(weight)::bigint as weights from s),
l as (select *, 3 * source_size as most, 3 * source_size::double / weight as level from s),
f as (select *, sum(most) over (order by level, key)::double as filled, sum(weight) over (order by level, key) as weighed from l),
m as (select *, filled + level * (weights - weighed) <= budget as at_most from f, b),
r as (select (any_value(budget) - coalesce(sum(most) filter (at_most), 0))::double / nullif(any_value(weights) - coalesce(sum(weight) filter (at_most), 0), 0) as share from m),
t as (select key, source_size, budget, case when at_most then most::double else weight * share end as target from m, r),
o as (select *, sum(size) over (partition by key order by turn, doc_id nulls first, size rows unbounded preceding)::bigint as so_far from d join t using (key)),
i as (select doc_id, key, size, so_far, e, budget, (e * source_size + so_far)::double / target as finish from o, (select unnest([0, 1, 2]) as e) where size > 0 and e < least(3, floor(target / source_size) + 1)),
q as (select *, sum(size) over (order by finish, key, e, so_far rows unbounded preceding)::bigint as spent from i),
k as (select key, so_far, sum(greatest(0, least(size, budget - spent + size)))::bigint as taken from q group by all)
select o.doc_id, o.size, o.source_size, o.target, case when o.size > 0 then k.taken else 0 end as taken, o.source from o left join k using (key, so_far)"""
