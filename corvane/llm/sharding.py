"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows stand in blocks (parts of the input's partitions). How many rows of each block
go to each shard is drawn first, exactly as a uniform shuffle would have it: each
block's row of the matrix is multivariate hypergeometric given what the blocks
before have left. Then each block permutes its rows and deals them out by these
counts, the rows are exchanged, and each shard is permuted again, in pieces.

The matrix is drawn down a tree: blocks stand in groups of GROUP_BLOCKS, groups in
groups of groups, until one is left. What a group gives to each shard is dealt out to
its members one after the other, all groups of a level in parallel. A draw takes a few
steps for counts of any size (rejection by ratio of uniforms), so the whole matrix
takes time in proportion to the blocks. All of this is Spark SQL; randomness is
xxhash64 of the seed and a row's place or a block's number, so that a recomputed
task draws alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import narrow_name, stored

#: Rows in a block and, about, in a piece of a shard; blocks in a group, and groups in a larger one, about.
BLOCK_ROWS, GROUP_BLOCKS = 1 << 15, 64
#: Standard deviations around the mode beyond which a draw has no weight in a double.
REACH = 12
#: Standard deviation up to which a draw walks over all counts, and tries of a draw by rejection (half of which succeed).
WALKED, TRIES = 2.0, 48
#: Below, logarithms of factorials come from a table, and above from Stirling's series.
TABLED = 16


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _steps(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def _log_factorial_ratio(a: Column, b: Column) -> Column:
    """log(a! / b!) for whole doubles; large parts cancel before they are added up, which keeps nine digits at any size."""
    table = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(TABLED)))
    series = lambda n: (1 / 12 - (1 / 360 - 1 / (1260 * n * n)) / (n * n)) / n
    large = lambda n: (n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi) + series(n)
    either = lambda n: F.when(n < TABLED, F.get(table, n.cast("int"))).otherwise(large(n))
    apart = (b + 0.5) * F.log1p((a - b) / b) + (a - b) * (F.log(a) - 1) + series(a) - series(b)
    return F.when((a < TABLED) | (b < TABLED), either(a) - either(b)).otherwise(apart)


def hypergeometric(total: Column, marked: Column, drawn: Column, *seeds: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among the ``marked``; random by the hash of ``seeds``.

    Narrow distributions are walked over (_walked). For others, points are thrown into
    a box around the region {(x, y): x * x <= weight(mode + y / x)}, and the first inside it
    gives the count y / x (Kinderman and Monahan's ratio of uniforms, with Stadlober's
    box for the hypergeometric). If none of TRIES points is inside, which has no
    measurable chance, the walk decides as well.
    """
    d = lambda c: c.cast("double")
    given = F.struct(d(total).alias("total"), d(marked).alias("marked"), d(drawn).alias("drawn"), F.xxhash64(*seeds).alias("seed"))

    def shape(s):
        share = s["marked"] / F.greatest(s["total"], F.lit(1.0))
        variance = s["drawn"] * share * (1 - share) * (s["total"] - s["drawn"]) / F.greatest(s["total"] - 1, F.lit(1.0))
        low, high = F.greatest(F.lit(0.0), s["drawn"] - (s["total"] - s["marked"])), F.least(s["drawn"], s["marked"])
        mode = F.greatest(low, F.least(high, F.floor((s["drawn"] + 1) * (s["marked"] + 1) / (s["total"] + 2)).cast("double")))
        return F.struct(
            s.alias("s"), low.alias("low"), high.alias("high"), mode.alias("mode"), (s["drawn"] * share + 0.5).alias("centre"),
            F.sqrt(variance).alias("spread"), (2 * math.sqrt(2 / math.e) * F.sqrt(variance + 0.5) + (3 - 2 * math.sqrt(3 / math.e))).alias("box"),
        )

    def log_weight(x, k):
        s, mode = x["s"], x["mode"]
        rest = s["total"] - s["marked"] - s["drawn"]
        above = _log_factorial_ratio(mode, k) + _log_factorial_ratio(rest + mode, rest + k)
        return above + _log_factorial_ratio(s["marked"] - mode, s["marked"] - k) + _log_factorial_ratio(s["drawn"] - mode, s["drawn"] - k)

    def throw(x, k):
        point = F.struct((1 - _uniform(x["s"]["seed"], F.lit(1), k)).alias("x"), (_uniform(x["s"]["seed"], F.lit(2), k) - 0.5).alias("y"))
        counted = lambda p: F.struct(p["x"].alias("x"), F.floor(x["centre"] + x["box"] * p["y"] / p["x"]).cast("double").alias("k"))
        inside = lambda p: F.when((p["k"] >= x["low"]) & (p["k"] <= x["high"]) & (2 * F.log(p["x"]) <= log_weight(x, p["k"])), p["k"])
        return _let(_let(point, counted), inside)

    def choose(x):
        s = x["s"]
        walked = _walked(s["total"], s["marked"], s["drawn"], _uniform(s["seed"], F.lit(0)))
        first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda a, k: F.when(a.isNotNull(), a).otherwise(throw(x, k)))
        return F.when(x["spread"] <= WALKED, walked).otherwise(F.coalesce(first.cast("long"), walked))

    return _let(_let(given, shape), choose)


def _walked(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The inverse of the distribution at ``u``.

    Weights follow from the mode outwards by the ratio of neighbours; the mode comes
    first, then what lies above, then below.
    """
    d = lambda c: c.cast("double")
    given = F.struct(d(total).alias("total"), d(marked).alias("marked"), d(drawn).alias("drawn"), u.alias("u"))

    def bounds(s):
        low, high = F.greatest(F.lit(0.0), s["drawn"] - (s["total"] - s["marked"])), F.least(s["drawn"], s["marked"])
        mode = F.greatest(low, F.least(high, F.floor((s["drawn"] + 1) * (s["marked"] + 1) / (s["total"] + 2)).cast("double")))
        share = s["marked"] / F.greatest(s["total"], F.lit(1.0))
        spread = F.sqrt(s["drawn"] * share * (1 - share) * (s["total"] - s["drawn"]) / F.greatest(s["total"] - 1, F.lit(1.0)))
        reach = F.ceil(REACH * spread + 2 * REACH)
        return F.struct(s["total"].alias("total"), s["marked"].alias("marked"), s["drawn"].alias("drawn"), s["u"].alias("u"), mode.alias("mode"), F.least(high - mode, reach).alias("above"), F.least(mode - low, reach).alias("below"))

    def up(s, k):  # weight of k + 1 against k
        return (s["marked"] - k) * (s["drawn"] - k) / ((k + 1) * (s["total"] - s["marked"] - s["drawn"] + k + 1))

    def down(s, k):  # weight of k - 1 against k
        return k * (s["total"] - s["marked"] - s["drawn"] + k) / ((s["marked"] - k + 1) * (s["drawn"] - k + 1))

    def weigh(s, steps, ratio, sign):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))

        def step(a, i):
            w = a["w"] * ratio(s, s["mode"] + sign * (d(i) - 1))
            return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))

        return F.aggregate(_steps(steps), start, step, lambda a: a["sum"])

    def walk(s, steps, ratio, sign, target):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("hit"))

        def step(a, i):
            w = a["w"] * ratio(s, s["mode"] + sign * (d(i) - 1))
            hit = F.when(a["sum"] <= target, d(i)).otherwise(a["hit"])
            return F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), hit.alias("hit"))

        return s["mode"] + sign * F.aggregate(_steps(steps), start, step, lambda a: a["hit"])

    def weighed(s):
        return F.struct(s.alias("s"), weigh(s, s["above"], up, 1).alias("above"), weigh(s, s["below"], down, -1).alias("below"))

    def choose(x):
        s, t = x["s"], x["s"]["u"] * (1 + x["above"] + x["below"]) - 1
        upper = walk(s, s["above"], up, 1, t)
        lower = walk(s, s["below"], down, -1, t - x["above"])
        return F.when(t < 0, s["mode"]).when((t < x["above"]) | (s["below"] < 1), upper).otherwise(lower).cast("long")

    return _let(_let(_let(given, bounds), weighed), choose)


def _deal(n: Column, room: Column, shards: int, *seeds: Column) -> Column:
    """Counts (array) of ``n`` rows dealt to shards with so much ``room`` each."""
    start = F.struct(n.cast("long").alias("left"), F.aggregate(room, F.lit(0).cast("long"), lambda a, c: a + c).alias("rest"), F.array().cast("array<bigint>").alias("out"))

    def step(a, j):
        own = F.get(room, j)
        drawn = hypergeometric(a["rest"], own, a["left"], *seeds, j)
        return _let(drawn, lambda k: F.struct((a["left"] - k).alias("left"), (a["rest"] - own).alias("rest"), F.concat(a["out"], F.array(k)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step, lambda a: a["out"])


def _matrix_rows(items: Column, room: Column, shards: int, seed: Column, id_type: str) -> Column:
    """For an array of (id, n): array of (id, counts), one item after the other from the same room."""
    start = F.struct(room.alias("room"), F.array().cast(f"array<struct<id:{id_type},counts:array<bigint>>>").alias("out"))

    def step(a, item):
        counts = _deal(item["n"], a["room"], shards, seed, F.hash(item["id"]))
        return _let(counts, lambda c: F.struct(F.zip_with(a["room"], c, lambda x, y: x - y).alias("room"), F.concat(a["out"], F.array(F.struct(item["id"].alias("id"), c.alias("counts")))).alias("out")))

    return F.aggregate(items, start, step, lambda a: a["out"])


def communication_matrix(blocks: DataFrame, room: list[int], seed: int) -> DataFrame:
    """From rows (block, n) the rows (block, counts): how many rows of each block go to each shard.

    ``room`` has the size of each shard. There are as many Spark jobs as levels of the
    tree, which grow with the logarithm of the blocks.
    """
    levels = [stored(blocks.select(F.col("block").alias("id"), "n"), "shard-blocks")]
    groups = levels[0].count()
    while groups > 1:
        groups = -(-groups // GROUP_BLOCKS)
        parent = F.pmod(F.xxhash64("id"), F.lit(groups))
        levels[-1] = levels[-1].withColumn("parent", parent)
        levels.append(stored(levels[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n")), "shard-groups"))
    rows = levels[-1].select("id", F.array(*map(_long, room)).alias("room"))
    for depth, level in enumerate(reversed(levels[:-1])):
        members = level.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("items"))
        # few bytes, but many draws: no coalescing
        dealt = members.join(rows.withColumnRenamed("id", "parent"), "parent").repartition(min(1000, rows.count()))
        found = dealt.select(F.explode(_matrix_rows(F.col("items"), F.col("room"), len(room), F.lit(seed * 64 + depth), "bigint")).alias("x"))
        rows = stored(found.select("x.id", F.col("x.counts").alias("room")), "shard-matrix")
    return rows.select(F.col("id").alias("block"), F.col("room").alias("counts"))


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def assign(places: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """Rows (place, shard, slot) for a table of ``n`` distinct places (partition number << 33 + row), as a uniform shuffle."""
    block = F.shiftleft(F.shiftrightunsigned("place", 33), 18) + F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_ROWS)
    rows = places.select("place", block.alias("block"))
    room = [n // shards + (j < n % shards) for j in range(shards)]
    matrix = communication_matrix(rows.groupBy("block").agg(F.count("*").alias("n")), room, seed)
    ends = F.transform("counts", lambda c, j: F.aggregate(F.slice("counts", F.lit(1), j + 1), _long(0), lambda a, x: a + x))
    own = F.row_number().over(W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 2), "place"), "place"))
    dealt = rows.withColumn("own", own).join(matrix.select("block", ends.alias("ends")), "block")
    dealt = dealt.select("place", F.size(F.filter("ends", lambda e: e < F.col("own"))).alias("shard"))
    # the second permutation: pieces of a shard, in the order of a hash
    pieces = max(1, n // shards // BLOCK_ROWS)
    again = F.xxhash64(F.lit(seed + 3), "place")
    dealt = stored(dealt.select("place", "shard", F.pmod(again, F.lit(pieces)).alias("piece")), "shards")
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n")).select("shard", "piece", F.coalesce(F.sum("n").over(before), _long(0)).alias("start"))
    within = F.row_number().over(W.partitionBy("shard", "piece").orderBy(again, "place"))
    return dealt.withColumn("within", within).join(starts, ["shard", "piece"]).select("place", "shard", (F.col("start") + F.col("within") - 1).alias("slot"))


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 42) -> DataFrame:
    """``df`` with shard (0 to ``shards`` - 1) and slot (from 0, without gaps, in each shard).

    Every arrangement of the rows is equally likely; shards differ by one row at
    most, the first ones having more. Values play no part, so nulls, repeated rows
    and hot keys are like any others. The input is stored once, which pins each
    row's place; columns named shard or slot are an error.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    if clash := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    place = narrow_name(df, "place")
    base = stored(df.withColumn(place, F.monotonically_increasing_id()), "shard-input")
    n = base.count()
    if not n:
        return base.drop(place).withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    assigned = assign(base.select(F.col(place).alias("place")), n, shards, seed)
    return base.join(assigned.withColumnRenamed("place", place), place).drop(place)


def op4_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Columns doc_id, size, text_crc32, law (rows), shard, slot, grown_shard (null) for every row; null texts have size 1.

    Rows with equal texts or ids (ties) are different rows. Only a text's size and
    checksum are carried, so texts of any length cost the same. An empty table gives
    no rows; columns of other names are ignored.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(rows, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
