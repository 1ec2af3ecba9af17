"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are split into two segments of 32 bits. If two fingerprints differ
in at most ``radius`` bits (0 to 3), the pigeonhole principle leaves either at
most ``a`` differing bits in the high segment or at most ``b`` in the low one,
with a + b + 1 = radius. Every fingerprint stands in one table per segment, and
probes each with a small Hamming ball. A pair that differs in a bit has it set on one side only,
so probes clear set bits and never set any: each pair meets once.

A segment value that more than ``bucket`` different fingerprints share is not
joined there, as that would make all pairs of a group. Its fingerprints go to
an exact second index instead: the Hamming ball around the whole fingerprint,
in which no key can gather more than 65 fingerprints.

Copies with edits differ in too many bits for that: at a Jaccard similarity of
0.8 in 10 of 64. keep_one_of_each therefore also looks for texts that share one of
BANDS keys, each of ROWS minima of hashed shingles, and links those whose sets of
hashed shingles reach the similarity. A pair at 0.8 shares no key with
probability (1 - 0.8 ** ROWS) ** BANDS = 0.0004. Keys bring ids and signatures (a byte
of each minimum) together; whole sets are fetched for pairs whose signatures allow the
similarity, which those of a pair at 0.8 fail to do with probability below 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, narrow_name, shuffled, small_side, spread_lookup, stored
from .components import connected_components

#: Texts are hashed in blocks of so many shingles, which bounds a task's memory for long texts.
BLOCK = 1 << 16
#: Keys of a text by which edited copies are looked for, and minima in each.
BANDS, ROWS = 20, 5
#: Numbers in a signature: a byte of each minimum.
SIGNATURE = -(-BANDS * ROWS // 8)
_RANDOM = np.random.default_rng(20)
_FLIPS, _FACTORS = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Shingles whose minima are taken at a time: the block stays in the processor's cache.
MINIMA_BLOCK = 1 << 9
#: Texts of a key from which on they are first held against a few centres.
CROWD = 32


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; no words: 0."""
    value = 0
    for value, _ in _hashed(text, words, seed):
        pass
    return value


def band_keys(text: str | None, words: int = 5, seed: int = 42) -> tuple[int, int, list[int], list[int]]:
    """The fingerprint, and of the set of word shingles the size, BANDS keys and the signature; no words: no keys.

    The signature holds the lowest byte of each of the BANDS * ROWS minima, eight in a number.
    """
    value, least, seen = 0, np.full(BANDS * ROWS, np.iinfo(np.uint64).max), []
    for value, hashes in _hashed(text, words, seed):
        seen = [np.unique(np.concatenate([*seen, hashes]))]
        for at in range(0, len(hashes), MINIMA_BLOCK):
            np.minimum(least, ((hashes[at : at + MINIMA_BLOCK] ^ _FLIPS[:, None]) * _FACTORS[:, None]).min(axis=1), out=least)
    raw, step = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) - (1 << 63) for k in range(BANDS)]
    # the lowest bits of products are those of their factors, so the bytes are taken from higher ones
    low = np.zeros(8 * SIGNATURE, dtype=np.uint8)
    low[: BANDS * ROWS] = (least >> np.uint64(24)).astype(np.uint8)
    return value, len(seen[0]) if seen else 0, keys if seen else [], low.view(np.int64).tolist()


def most_differing(similarity: float) -> int:
    """Bytes in which signatures of sets of that similarity differ at most: six standard deviations above the mean."""
    n = BANDS * ROWS
    return int(n * (1 - similarity) + 6 * (n * similarity * (1 - similarity)) ** 0.5)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int = 5) -> set[bytes]:
    """The word shingles; a text of fewer words is one shingle."""
    parts = _words(text)
    return {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def _hashed(text: str | None, words: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block, the fingerprint so far and the block's hashes of shingles; none if there are no words."""
    parts = _words(text)
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    ends = ends[min(words, len(parts)) - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : min(at + BLOCK, n)].tolist(), ends[at : min(at + BLOCK, n)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        yield int.from_bytes(np.packbits(2 * total > n).tobytes(), "big"), hashes.astype(np.uint64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with a bigint column ``out``: the fingerprint's bits as a signed number."""

    @F.pandas_udf("bigint")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return docs.withColumn(out, fp(F.col(text_col)))


def _ball(value, bits: int, radius: int):
    """Array of ``value`` and what results from clearing up to ``radius`` (0 or 1) of its set bits."""
    if radius == 0:
        return F.array(value)
    cleared = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int")))
    hit = F.filter(cleared, lambda bit: value.bitwiseAND(bit) != 0)
    return F.concat(F.array(value), F.transform(hit, lambda bit: value.bitwiseXOR(bit)))


def similar_fingerprints(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Pairs (a, b) of different values of column ``fp`` that differ in at most ``radius`` bits.

    ``fps`` holds each fingerprint once. Every pair comes out, at least once,
    in either order. Null fingerprints link to nothing.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3: larger balls in segments of 32 bits are not small")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # differing bits d0 + d1 <= radius: d0 <= r0 or d1 <= r1 where r0 + r1 + 1 = radius
    r0 = {1: 0, 2: 1, 3: 1}[radius]
    r1 = radius - 1 - r0
    segment = F.explode(
        F.array(
            F.struct(F.lit(0).alias("seg"), high.alias("own"), _ball(high, 32, r0).alias("keys")),
            F.struct(F.lit(1).alias("seg"), low.alias("own"), _ball(low, 32, r1).alias("keys")),
        )
    )
    split = fps.where("fp is not null").select("fp", segment.alias("s")).select("fp", "s.*")
    key = F.shiftleft(F.col("seg").cast("bigint"), 32).bitwiseOR(F.col("key"))
    shelves = split.select(key_of("own").alias("k"), F.col("fp").alias("b"))
    probes = split.select("fp", "seg", F.explode("keys").alias("key")).select(key.alias("k"), F.col("fp").alias("a"))
    sizes = shelves.groupBy("k").agg(F.count("*").alias("n"))
    hot = stored(sizes.where(F.col("n") > bucket).select("k"), "simhash-hot")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("a") != F.col("b"))
    hot = small_side(hot)
    cold = shelves.join(hot, "k", "left_anti")
    pairs = probes.join(shuffled(cold), "k").where(near).select("a", "b")
    if hot.isEmpty():
        return pairs
    crowded = probes.join(hot, "k", "left_semi").select("a").union(shelves.join(hot, "k", "left_semi").select("b")).distinct().select(F.col("a").alias("fp"))
    return pairs.union(_midpoint_pairs(crowded, radius))


def key_of(name: str):
    return F.shiftleft(F.col("seg").cast("bigint"), 32).bitwiseOR(F.col(name))


def _midpoint_pairs(fps: DataFrame, radius: int) -> DataFrame:
    """Pairs within ``radius`` bits through values that lie between them.

    Both sides of a pair at 2 bits are 1 bit from some common value; for radius 3
    one side probes at up to 2 bits. A key gathers at most 65 shelved fingerprints.
    """
    bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int")))
    around = F.concat(F.array("fp"), F.transform(bit, lambda x: F.col("fp").bitwiseXOR(x)))
    shelved = fps.select(F.explode(around).alias("k"), F.col("fp").alias("b"))
    if radius == 1:
        probes = fps.select(F.col("fp").alias("k"), F.col("fp").alias("a"))
    else:
        probes = fps.select(F.explode(around).alias("k"), F.col("fp").alias("a"))
        if radius == 3:
            further = F.explode(F.array_distinct(F.concat(F.array("k"), F.transform(bit, lambda x: F.col("k").bitwiseXOR(x)))))
            probes = probes.select(further.alias("k"), "a").distinct()
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & (F.col("a") < F.col("b"))
    return probes.join(shuffled(shelved), "k").where(near).select("a", "b").distinct()


def fingerprint_groups(docs: DataFrame, radius: int = 2) -> DataFrame:
    """From rows (doc_id, fp), fp never null: the same rows with component_id.

    Fingerprints link if they differ in at most ``radius`` bits; a component is
    what links reach. component_id is its smallest doc_id (null only if all are
    null). Equal fingerprints are one node however many rows share them, and rows
    of popular ones are dealt evenly to the tasks that look up the component.
    """
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    links = stored(similar_fingerprints(nodes.select("fp"), radius), "simhash-links")
    if links.isEmpty():
        found = nodes.select("fp", "n", F.col("first").alias("component_id"))
    else:
        labels = connected_components(links, "a", "b")
        firsts = nodes.join(shuffled(labels), nodes.fp == labels.node, "left").select("fp", "n", "first", F.coalesce("component", "fp").alias("comp"))
        smallest = firsts.groupBy("comp").agg(F.min("first").alias("component_id"))
        found = stored(firsts.join(shuffled(smallest), "comp").select("fp", "n", "component_id"), "simhash-found")
    return spread_lookup(docs.select("doc_id", "fp"), found, "fp", "n", ["component_id"])


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """place, doc_id, fp (fingerprint), same (digest of the words in order), and of the set of shingles its size n, keys and sig (of band_keys) of each text."""

    @F.pandas_udf("fp long, same string, n long, keys array<long>, sig array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(fp, xxhash.xxh3_128_hexdigest(b" ".join(_words(t))), n, keys, sig) for t in texts for fp, n, keys, sig in [band_keys(t, words)]]
            found = pd.DataFrame(rows, columns=["fp", "same", "n", "keys", "sig"])
            yield found.assign(fp=np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64))
        give_back()

    return docs.select("place", "doc_id", sketch("text").alias("s")).select("place", "doc_id", "s.*")


def _relabelled(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after the labels that ``links`` (a, b) join have become one."""
    if links.isEmpty():
        return labelled
    labels = connected_components(links, "a", "b")
    joined = labelled.join(shuffled(labels), labelled.label == labels.node, "left")
    return stored(joined.select(labelled.node, F.coalesce("component", "label").alias("label")), "simhash-labels")


def _shingle_sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the different hashes of each of these nodes' shingles, in 32 bits, as they travel with keys."""

    @F.pandas_udf("array<int>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.unique(np.array([xxhash.xxh32_intdigest(x) for x in shingle_set(t, words)], dtype=np.uint32)).view(np.int32) for t in batch])
        give_back()

    rows = texts.join(small_side(nodes), texts.place == nodes.node, "left_semi")
    return stored(rows.select(F.col("place").alias("node"), hashed("text").alias("hashes")), "simhash-shingles")


def _differing(a: str, b: str):
    """Bytes in which the signatures in two columns differ: bits are folded into each byte's lowest."""

    def bytes_of(k: int):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(add, (bytes_of(k) for k in range(SIGNATURE)))


def _side(df: DataFrame, x: str, *more: str) -> DataFrame:
    """Columns of one side of a comparison: key, node, label, n, sig and ``more``, by their first letters and ``x``."""
    return df.select(F.col("node").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in ("key", "label", "n", "sig", *more)))


def _near(similarity: float):
    """Whether two sides have a key in common and different labels, and neither sizes nor signatures show that they cannot be similar."""
    alike = (F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-9) & (_differing("sx", "sy") <= most_differing(similarity))
    return (F.col("kx") == F.col("ky")) & (F.col("lx") != F.col("ly")) & alike


def _similar(similarity: float):
    """Whether the sets of two sides have the similarity."""
    # common >= similarity * (both - common), with one intersection
    return (1 + similarity) * F.size(F.array_intersect("hx", "hy")) >= similarity * (F.size("hx") + F.size("hy")) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those ``pairs`` (x, y, a, b), at most one for each x, whose sets have the similarity."""
    pairs = small_side(stored(pairs, "simhash-pairs"))
    side = lambda x: shuffled(sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")))
    return stored(pairs.join(side("x"), "x").join(side("y"), "y").where(_similar(similarity)).select("a", "b").distinct(), "simhash-links")


def _hub_pairs(crowd: DataFrame, slots: int, similarity: float) -> DataFrame:
    """(x, y, a, b): each node of crowded keys with the likest of its centres.

    Centres are, in each of ``slots`` hashed parts of a key, the node that is in most
    crowded keys: that from which the others were copied has more of them than its copies.
    """
    busy = crowd.groupBy("node").agg(F.count("*").alias("busy"))
    parts = crowd.join(shuffled(busy), "node").withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(slots)))
    first = F.max(F.struct("busy", F.xxhash64("node", F.lit(slots)).alias("order"), "node", "label", "n", "sig")).alias("c")
    centres = parts.groupBy("key", "slot").agg(first).select("key", "c.node", "c.label", "c.n", "c.sig")
    best = F.min(F.struct(_differing("sx", "sy").alias("differing"), "y", F.col("lx").alias("a"), F.col("ly").alias("b"))).alias("best")
    return _side(crowd, "x").join(shuffled(_side(centres, "y")), _near(similarity)).groupBy("x").agg(best).select("x", "best.y", "best.a", "best.b")


def _join_similar(nodes: DataFrame, labelled: DataFrame, links: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(node, label) after ``links`` (a, b) between labels, and after texts that share a key and have the similarity have the same label.

    ``nodes`` have node, n, keys and sig. Nodes in keys of more than CROWD are first held against
    the likest of one centre for each key, then of four, which usually joins the groups of
    copies in them: keys bring ids and signatures together, and the sets of shingles are
    fetched for one pair of each node. Of what then still has different labels in a key, all
    pairs are compared but those of the key's most frequent label: exactly, and within
    the join, so that no list of pairs ever exists, and in the first of the keys that two
    texts share only. There sets travel with the keys that are left, once for each.
    """
    shelves = nodes.select("node", "n", "sig", F.explode("keys").alias("key"))
    mixed = lambda df: df.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key", (F.col("c") > CROWD).alias("crowded"))
    rows = shelves.select("node", "key").join(shuffled(labelled), "node")
    keys = stored(mixed(rows), "simhash-mixed")
    kept = stored(shelves.join(small_side(keys.select("key")), "key", "left_semi"), "simhash-shelved")
    sets = _shingle_sets(kept.select("node").distinct(), texts, words)
    found = links
    for slots in (1, 4, 0):
        if not found.isEmpty():
            labelled = _relabelled(labelled, found)
        rows = kept.join(shuffled(labelled), "node")
        rows = stored(rows.join(small_side(stored(mixed(rows), "simhash-mixed")), "key"), "simhash-shelved")
        if slots:
            found = _verified(_hub_pairs(rows.where("crowded"), slots, similarity), sets, similarity)
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("home"))
    rows = stored(rows.join(shuffled(counts), "key"), "simhash-shelved")
    held = rows.join(shuffled(sets), "node").join(shuffled(nodes.select("node", F.col("keys").alias("every"))), "node").withColumnRenamed("home", "most")
    once = (F.col("ly") == F.col("my")) | (F.col("x") < F.col("y"))
    first = F.array_min(F.array_intersect("ex", "ey")) == F.col("kx")
    pairs = _side(held.where("label != most"), "x", "hashes", "every").join(_side(held, "y", "hashes", "every", "most"), _near(similarity) & once & first & _similar(similarity))
    return _relabelled(labelled, stored(pairs.select(F.col("lx").alias("a"), F.col("ly").alias("b")).distinct(), "simhash-links"))


def keep_one_of_each(docs: DataFrame, radius: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id, of equals the first; all columns stay.

    Texts are near copies if their fingerprints differ in at most ``radius`` bits, or
    their sets of shingles have a Jaccard similarity of at least ``similarity``.
    The input is stored once with each row's place, so that exactly one row stays
    of rows that repeat, with or without a doc_id.
    """
    place = narrow_name(docs, "place")
    base = stored(docs.withColumn(place, F.monotonically_increasing_id()), "simhash-input")
    texts = base.select(F.col(place).alias("place"), "doc_id", "text")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    firsts = (F.first(c).alias(c) for c in ("fp", "n", "keys", "sig"))
    found = stored(_sketched(texts, words), "simhash-fp").groupBy("same").agg(F.min(best).alias("best"), *firsts)
    nodes = stored(found.select(F.col("best.place").alias("node"), "best", "fp", "n", "keys", "sig"), "simhash-nodes")
    links = similar_fingerprints(nodes.select("fp").distinct(), radius)
    labelled = nodes.select("node", F.col("fp").alias("label"))
    labelled = _join_similar(nodes, labelled, stored(links, "simhash-links"), texts, similarity, words)
    groups = nodes.select("node", "best").join(shuffled(labelled), "node").groupBy("label")
    kept = groups.agg(F.min("best").alias("best")).select(F.col("best.place").alias(place))
    return base.join(shuffled(kept), place, "left_semi").select(docs.columns)


def op7_simhash(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Null and empty texts have fingerprint zero and link with each other; texts of any
    length count whole, in blocks of shingles; a bit set in exactly half the shingles
    (a tie) is 0. Repeated rows come out as often as they went in; an empty table gives
    no rows; extra columns are ignored.
    """
    fps = stored(with_fingerprint(docs.select("doc_id", "text"), words=words).select("doc_id", "fp"), "simhash-fp")
    return fingerprint_groups(fps, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
