"""Operators against plain versions of themselves, round trips, and held-out accuracy."""

import re
import zlib
from io import BytesIO

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import decontaminate, licenses, pieces, quality, sharding, simhash, tokenfiles, toxicity, urlfilter
from corvane.llm.components import connected_components

from .conftest import prose

SF = "/root/testdata/sf0.001"
PIECES, TOKENS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(alphabet=" \n\tab'.,1é中🙂▁<|>\u00a0\u0000theing", max_size=60)


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_fingerprints_and_components(spark, documents):
    import xxhash

    rows = {r.doc_id: r.text for r in documents.collect()}
    fps = {}
    for i, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(documents).collect()}
    assert got == {i: (f"{fps[i]:016x}", root(i)) for i in fps}


@pytest.mark.parametrize("radius", [1, 2, 3])
@pytest.mark.parametrize("bucket", [1, 64])
def test_similar_fingerprints_lose_no_pair(spark, radius, bucket):
    rng = np.random.default_rng(5)
    values = list({int(v) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for v in rng.integers(0, 2**63, 20) for _ in range(8)})
    fps = spark.createDataFrame([(v,) for v in np.array(values, dtype=np.uint64).view(np.int64).tolist()], "fp long")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.similar_fingerprints(fps, radius, bucket).collect()}
    assert got == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_decontamination_finds_edited_copies_only(spark):
    items = [(k, prose(100 + k, 30)) for k in range(5)]
    docs = [(k, prose(k, 400)) for k in range(20)]
    edited = items[0][1].split()
    edited[9], edited[20] = "changed", "twice"
    docs += [(100, prose(50, 100) + " " + items[1][1].upper().replace(" ", ", ") + " " + prose(51, 100)), (101, prose(52, 50) + " " + " ".join(edited))]
    docs += [(102, " ".join(items[2][1].split()[:26])), (103, " ".join(items[3][1].split()[:9]))]
    got = {(r.doc_id, r.item_id): round(r.score, 4) for r in decontaminate.op3_decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(100, 1): 1.0, (101, 0): round(26 / 30, 4), (102, 2): round(26 / 30, 4)}


def test_parts_of_the_benchmark_give_the_same(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = lambda d: sorted((r.doc_id, r.item_id, r.score) for r in d.collect())
    whole = rows(decontaminate.contaminated(documents, items))
    assert whole and whole == rows(decontaminate.contaminated(documents, items, part_words=400))


def test_decontamination_equals_all_pairs(documents, spark):
    """Every document aligned with every item, without seeds."""
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    numbers = {w: k for k, w in enumerate({w for ws in items.values() for w in ws}, 1)}
    coded = {i: np.array([numbers[w] for w in ws]) for i, ws in items.items()}
    want = {}
    for r in documents.collect():
        doc = np.array([numbers.get(w, 0) for w in decontaminate.words_of(r.text)])
        for i, item in coded.items():
            if np.isin(item, doc).sum() >= decontaminate.least_score(len(item), 0.6):
                score = decontaminate.smith_waterman(doc, item)[0] if len(item) >= 3 else 0
                if score and score >= decontaminate.least_score(len(item), 0.6):
                    want[r.doc_id, i] = round(score / len(item), 9)
    got = decontaminate.op3_decontaminate(documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == want and want


def _align_plainly(doc, item):
    h = np.zeros((len(item) + 1, len(doc) + 1), dtype=int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(doc, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


@given(st.lists(st.integers(1, 4), max_size=25), st.lists(st.integers(1, 4), max_size=12))
@settings(max_examples=80, deadline=None)
def test_smith_waterman(doc, item):
    score, first, last = decontaminate.smith_waterman(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64))
    assert score == _align_plainly(doc, item)
    if score:
        assert _align_plainly(doc[first : last + 1], item) == score


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_pieces_equal_the_library(text):
    import sentencepiece

    model = pieces.compiled(pieces._model_bytes(PIECES))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = model.encode(text).tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == text.replace("▁", " ")


def test_pieces_round_trip(documents):
    assert pieces.op2_sentencepiece(documents, PIECES).where("not round_trip").count() == 0
    again = pieces.decode(pieces.encode(documents, PIECES), PIECES, out="again")
    assert again.where("again != text").count() == 0


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_give_the_tokenizers_ids(text):
    own = tokenfiles.tokenizer(_bytes(TOKENS))
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == own.ids.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("plane", ["byte", "bit"])
@given(docs=st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=12))
@settings(max_examples=40, deadline=None)
def test_id_files(plane, docs):
    stream = BytesIO()
    writer = tokenfiles.IdFileWriter(stream, plane, block=16)
    for k, ids in enumerate(docs):
        writer.add(k if k % 3 else None, np.array(ids, dtype="<u4").tobytes())
    writer.close()
    reader = tokenfiles.IdFileReader(stream)
    got = [(i, [int(x) for p in parts for x in p]) for i, parts in reader.documents()]
    assert got == [(k if k % 3 else None, ids) for k, ids in enumerate(docs)]
    assert [x for k in range(len(reader.chunks)) for x in reader.chunk(k).tolist()] == [x for ids in docs for x in ids]


def test_token_files(documents):
    own, start = tokenfiles.tokenizer(_bytes(TOKENS)).ids.tokenizer, 0
    got = {r.doc_id: r for r in tokenfiles.op8_token_files(documents, TOKENS).collect()}
    for r in documents.orderBy("doc_id").collect():
        ids = np.array([*own.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@given(st.text(alphabet="ab \n#\u00a0é", max_size=60))
@settings(max_examples=200, deadline=None)
def test_text_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n")]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 8)}
    repeats = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    assert quality.text_stats(text) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeats, len(covered))


def test_hosts_that_mostly_fail_go(spark):
    good = [(k, prose(k, 40), f"good{k % 3}") for k in range(300)]
    bad = [(1000 + k, prose(k, 40) if k % 10 == 0 else "too short", "bad") for k in range(100)]
    few = [(2000, "short", "tiny")] + [(2001, prose(7, 40), "tiny")]
    rows = {r.doc_id: (r.base_failed, r.kept) for r in quality.op5_quality(spark.createDataFrame(good + bad + few, "doc_id long, text string, source string")).collect()}
    assert all(rows[k] == (False, True) for k in range(300))
    assert not any(kept for k, (_, kept) in rows.items() if 1000 <= k < 2000)
    assert rows[2000] == (True, False) and rows[2001] == (False, True)


def test_hosts_that_differ_mildly_are_watched(spark):
    """Two hosts have symbols in a fifth of their texts, others in a twentieth: only texts with symbols of the two go."""
    marks = " " + "# $ % & | " * 3
    rows, k = [], 0
    for host in range(12):
        for _ in range(200):
            marked = k % (5 if host < 2 else 20) == 0
            rows.append((k, prose(k, 60) + (marks if marked else ""), f"h{host}"))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.op5_quality(docs).collect()}
    assert not any(failed for failed, _ in got.values())
    assert {i for i, (_, kept) in got.items() if not kept} == {i for i, text, host in rows if host in ("h0", "h1") and "#" in text}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert {r[0]: (r[6], r[7]) for r in con.execute(quality.OP5_SQL).fetchall()} == got


@given(st.lists(st.integers(-3, 3), max_size=40))
@settings(max_examples=150, deadline=None)
def test_maximal_segments(values):
    def plain(low, high):
        best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        _, _, a, b = best
        return [*plain(low, a), (a, b - 1, float(best[0])), *plain(b, high)]

    got = toxicity.maximal_segments(np.array(values, dtype=float))
    assert sorted(s for *_, s in got) == sorted(s for *_, s in plain(0, len(values)))
    assert all(abs(sum(values[a : b + 1]) - s) < 1e-9 for a, b, s in got)


def test_toxic_passages_of_held_out_documents(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for k in range(1500):
        words = prose(k, 80).split()
        toxic = k % 5 == 0
        if toxic:
            for at in rng.choice(80, 6, replace=False):
                words[at] = ("vile", "rotten", "foul")[at % 3]
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    rows = toxicity.op6_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1500 and 250 < len(held) < 500
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.doc_id % 5 == 0) and 0 <= r.score <= 1 for r in held)


def _plain_toxicity(docs: dict[int, str], labels: dict[int, int]) -> dict[int, tuple[float, int]]:
    """Scores and numbers of segments by loops over whole texts: counts, log-odds, segments, constants, fit."""
    words = {i: [zlib.crc32(w.encode()) % toxicity.BUCKETS for w in re.findall(r"\w+", t.lower())] for i, t in docs.items()}
    known = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in docs}
    toxic, other, every = ({}, {}, {})
    for i, ws in words.items():
        for w in set(ws):
            every[w] = every.get(w, 0) + 1
            if i in known:
                of = toxic if known[i] else other
                of[w] = of.get(w, 0) + 1
    strength = min(sum(toxic.values()), sum(other.values()))
    score = {}
    for w, n in every.items():
        prior = n * strength / sum(every.values())
        a, b = toxic.get(w, 0) + prior, other.get(w, 0) + prior
        odds = np.log(a / (sum(toxic.values()) + strength)) - np.log(b / (sum(other.values()) + strength))
        score[w] = float(np.float32(max(odds - toxicity.DOUBT * np.sqrt(1 / a + 1 / b), 0.0) - toxicity.DRIFT))

    def segments(values, low, high):
        best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1) if values[a] > 0), default=(0, 0, 0, 0))
        return [] if best[0] <= 0 else [*segments(values, low, best[2]), best[0], *segments(values, best[3], high)]

    parts = {i: segments([score[w] for w in ws], 0, len(ws)) for i, ws in words.items()}
    lam = toxicity._karlin_lambda(*(np.array(x, dtype=float) for x in zip(*((round(score[w], 2), n) for w, n in every.items()), strict=True)))
    chances = [max(len(words[i]), 1) * np.exp(-lam * max(parts[i], default=0.0)) for i, y in known.items() if not y]
    k = len(chances) / sum(chances)

    def evidence(i):
        level = np.log(k * max(len(words[i]), 1))
        found = [lam * s - level for s in parts[i] if np.exp(level - lam * s) <= toxicity.SIGNIFICANT]
        return sum(found), len(found)

    bins = {}
    for i, y in known.items():
        at = bins.setdefault(round(evidence(i)[0] * 4), [0, 0])
        at[0], at[1] = at[0] + y, at[1] + 1
    x = np.array(sorted(bins), dtype=float)
    slope, intercept = toxicity._logistic(x / 4, np.array([bins[b][0] for b in x], dtype=float), np.array([bins[b][1] for b in x], dtype=float))
    return {i: (1 / (1 + np.exp(-(intercept + max(slope, 0.0) * evidence(i)[0]))), evidence(i)[1]) for i in docs}


def test_toxicity_equals_plain_loops(spark):
    rng = np.random.default_rng(8)
    docs = {}
    for i in range(240):
        words = prose(i, 40).split()
        if i % 4 == 0:
            for at in rng.choice(40, 5, replace=False):
                words[at] = ("vile", "rotten", "foul")[at % 3]
        docs[i] = " ".join(words)
    docs[7], docs[11] = "", "vile vile rotten foul " * 3
    labels = {i: int(i % 4 == 0) for i in range(0, 240) if i % 7}
    rows = toxicity.op6_toxicity(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()
    want = _plain_toxicity(docs, labels)
    assert {r.doc_id: r.n_segments for r in rows} == {i: n for i, (_, n) in want.items()}
    assert all(abs(r.score - want[r.doc_id][0]) < 1e-3 and r.predicted == (want[r.doc_id][0] >= 0.3) for r in rows)


def test_licence_places_and_edits(spark):
    text = "under the MIT license.\nReleased undr the MIT License; Apache License, Version 2.0 cc by-nc cc BY NC"
    row = licenses.op9_licenses(spark.createDataFrame([(1, text), (2, "all about nothing")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].n_base, row[0].first_word, row[0].last_word) == (20, 4, 0, 17)
    assert row[0].base_labels == "apache-2,cc-by-nc,mit" and row[0].score == 1.0
    assert (row[1].n_base, row[1].first_word, row[1].labels, row[1].score) == (0, None, "", 0.0)


@pytest.mark.parametrize("notice", [licenses.Notice(*n) for n in licenses.ALL_NOTICES], ids=lambda n: n.template)
def test_notices_with_edits_are_found(notice):
    rng = np.random.default_rng(len(notice.text))
    sample, inside, places = notice.template.replace("{version}", "{4 0}"), False, []
    for c in sample:
        inside = inside if c not in "{}" else c == "{"
        if c not in "{}":
            places.append(not inside and c != " ")
    free = np.flatnonzero(places)
    for _ in range(5):
        letters = list(notice.text)
        for at in rng.choice(free, min(notice.errors, len(free)), replace=False):
            letters[at] = "q"
        found = notice.search("some words before " + "".join(letters) + " and some after")
        assert len(found) == 1 and found[0][2] <= notice.errors


@pytest.mark.parametrize("text,labels", [
    ("released under the bsd license", "bsd"), ("CC BY-ND 4.0", ""), ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
    ("Licensed under the Mozilla Public License version 1 1", "mpl-1.1"), ("unlicensed under cc by 4 0", ""), ("sublicensed under CC BY 4.0", ""), ("licensed under cc by 4 05", ""), ("released under the mitt license", ""),
    ("Relased undr the MIT licence", "mit"), ("licensd under CC BY-SA 3.0", "cc-by-sa"), ("SPDX-Licence-Identifier: Apache-2.0", "apache-2"),
])
def test_names_and_versions_are_exact(text, labels):
    notices = [licenses.Notice(*n) for n in licenses.ALL_NOTICES]
    assert licenses.judged("Some text. " + text + " and more", notices)[5] == labels
    assert licenses.judged(text, notices)[5] == labels


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_licences_equal_sql_and_plain_search(spark, documents):
    """Base columns against SQL; spans against the edit distance of what they cover."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(licenses.BASE_SQL).fetchall()}
    got = {r.doc_id: r for r in licenses.op9_licenses(documents).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()} == want
    notices = [licenses.Notice(*n) for n in licenses.ALL_NOTICES]
    edited = {}
    for r in documents.collect():
        joined = b" ".join(licenses.reduced(r.text)).decode()
        for edits, start, end, notice in licenses.best_matches(notices, joined):
            versions = [notice.text.replace("4 0", v) for v in ("4 0", "3 0", "2 5", "2 0", "1 0")] if "{version}" in notice.template else [notice.text]
            assert min(_edits(joined[start:end], v) for v in versions) == edits
            edited.setdefault(r.doc_id, set()).add(notice.label)
        # plainly: every notice that stands there unchanged is among the labels
        plain = {n.label for n in notices if f" {n.text} " in f" {joined} "}
        assert plain <= set(got[r.doc_id].labels.split(","))
    assert {i: set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) for i, r in got.items() if r.labels != r.base_labels} == {
        i: found - set(got[i].base_labels.split(",")) for i, found in edited.items() if found - set(got[i].base_labels.split(","))
    }


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"), "id")
    cascade = urlfilter.build_cascade(keys.unionByName(keys.limit(100)), keys.where("id % 37 = 5"), 20_100)
    rows = keys.toPandas()
    held = cascade.holds(rows["h1"].to_numpy(), rows["h2"].to_numpy())
    assert (held == (rows["id"] % 37 == 5)).all() and len(cascade.levels) > 1


def test_urls_equal_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(map(repr, con.execute(urlfilter.OP1_SQL).fetchall()))
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urlfilter.op1_url_filter(pages).collect()) == want


def test_long_lists_in_tables_are_split(spark, monkeypatch):
    """Parts of a few bytes, and columns with the names of helpers, against plain string functions."""
    monkeypatch.setattr(urlfilter, "MAX_BYTES", 40)
    rng = np.random.default_rng(4)
    hosts = [f"h{k % 40}.d{k % 7}.{('com', 'net')[k % 2]}" for k in range(300)]
    urls = [(k, f"https://{h}/a{rng.integers(3)}/b{rng.integers(3)}/c?x", "k", "f") for k, h in enumerate(hosts)] + [(900, None, "k", "f")]
    rules = [("block" if k % 2 else "allow", f"{h}/a{k % 3}/") for k, h in enumerate(sorted(set(hosts))[::3])] + [("block", "d1.net/"), ("allow", "com/a1/b1/")]
    blocked = [h.split(".", 1)[1] for h in sorted(set(hosts))[::9]] + ["nowhere.org"]
    pages = spark.createDataFrame(urls, "page_id long, url string, keys string, found string")
    found = urlfilter.judge(pages, spark.createDataFrame(rules, "kind string, rule string"), spark.createDataFrame([(h,) for h in blocked], "host string"))
    assert found.columns == [*pages.columns, "judged"]

    def plain(url):
        host, path = re.match("https://([^/]*)(/[^?]*)", url).groups() if url else ("", "")
        fits = [(len(r), len(r.split("/")[0]), kind, r) for kind, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
        listed = any(host == h or host.endswith("." + h) for h in blocked)
        return (max(fits)[3], max(fits)[2]) if fits else (None, "block" if listed else "allow")

    assert {r.page_id: (r.judged.rule, r.judged.verdict) for r in found.collect()} == {r[0]: plain(r[1]) for r in urls}
    with pytest.raises(ValueError):
        urlfilter.judge(pages, [("block", "no-slash.com")], [])


def test_shards_have_exact_sizes_and_are_uniform(spark):
    counts = np.zeros((24, 3))
    before = sharding.BLOCK_ROWS, sharding.GROUP_BLOCKS
    sharding.BLOCK_ROWS, sharding.GROUP_BLOCKS = 5, 2
    try:
        for seed in range(12):
            rows = sharding.shard_rows(spark.range(24).repartition(3), 3, 10 * seed).collect()
            for shard in range(3):
                assert sorted(r.slot for r in rows if r.shard == shard) == list(range(8))
            for r in rows:
                counts[r.id, r.shard] += 1
    finally:
        sharding.BLOCK_ROWS, sharding.GROUP_BLOCKS = before
    assert ((counts - 4) ** 2 / 4).sum() < 90  # 46 degrees of freedom


def _hypergeometric(total: int, marked: int, drawn: int, k: int) -> float:
    from math import exp, lgamma

    log = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    return exp(log(marked, k) + log(total - marked, drawn - k) - log(total, drawn)) if max(0, drawn - total + marked) <= k <= min(drawn, marked) else 0.0


@pytest.mark.parametrize("total,marked,drawn", [(50, 13, 20), (100, 97, 60), (1000, 300, 400), (524_288, 32_768, 32_768), (5000, 4900, 300)])
def test_hypergeometric_draws(spark, total, marked, drawn):
    """Walked and thrown draws by chi squared."""
    n = 20_000
    got = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.col("id"), F.lit(total)).alias("k")).toPandas()["k"]
    found = np.bincount(got, minlength=min(drawn, marked) + 1)
    want = n * np.array([_hypergeometric(total, marked, drawn, k) for k in range(len(found))])
    usual = want >= 5
    chi = ((found - want)[usual] ** 2 / want[usual]).sum()
    assert chi < usual.sum() + 4 * np.sqrt(2 * usual.sum()) and found[~usual].sum() < 5 + 3 * want[~usual].sum()


def test_factorials_keep_their_digits(spark):
    from math import log

    rows = [(10.0**10 + k, 10.0**10) for k in (0, 1, 1000)] + [(20.0, 15.0), (3.0, 9.0), (17.0, 16.0)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", sharding._log_factorial_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        low, high = sorted((int(r.a), int(r.b)))
        want = sum(log(x) for x in range(low + 1, high + 1)) * (1 if r.a >= r.b else -1)
        assert abs(r.r - want) < 1e-9 * max(1, abs(want))


def test_a_large_matrix_has_exact_sums(spark):
    blocks = spark.range(9000).select(F.col("id").alias("block"), (F.lit(1 << 15) + F.col("id") % 3).alias("n"))
    rows = 9000 * (1 << 15) + 9000
    room = [rows // 5 + (j < rows % 5) for j in range(5)]
    matrix = sharding.communication_matrix(blocks, room, 3).join(blocks, "block").toPandas()
    counts = np.array(matrix["counts"].to_list())
    assert counts.sum(axis=0).tolist() == room and (counts.sum(axis=1) == matrix["n"]).all() and (counts >= 0).all()
    spread = (counts[:, 0] - matrix["n"] / 5) / np.sqrt(matrix["n"] * 0.16)
    assert abs(spread.mean()) < 0.05 and 0.9 < spread.var() < 1.1


def test_query_of_shards(spark, documents):
    """The contract: shards at most one row apart, gapless slots, sizes and checksums of whole texts."""
    rows = sharding.op4_shards(documents).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in rows)
    slots = [sorted(r.slot for r in rows if r.shard == k) for k in range(16)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_sentencepiece_checksums_equal_the_library(documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in pieces.op2_sentencepiece(documents, PIECES).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, dtype="<i4").tobytes()))
        assert r.decoded_crc32 == zlib.crc32(library.decode(ids).encode())
