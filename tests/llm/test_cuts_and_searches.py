"""Fuzzy hashing, fill-in-middle and ranked search: their methods against plain versions, odd rows, and the SQL."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coderake.llm import best_position, fim, golay
from coderake.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA
from tests.llm.test_operators import DOCS, LONG, TEXTS, docs, words  # noqa: F401
from tests.oracle import same


# Fuzzy hashing


def plain_fingerprint(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def plain_components(prints):
    """Smallest number that each place of a list of fingerprints reaches."""
    root = list(range(len(prints)))
    for _ in prints:
        before = list(root)
        for i, p in enumerate(prints):
            close = np.flatnonzero(np.bitwise_count(np.array(prints, np.uint64) ^ np.uint64(p)) <= 4)
            root[i] = min(root[j] for j in close)
        if root == before:
            return root
    return root


def test_code_is_perfect_and_near_codewords_meet():
    code = golay.Golay()
    assert sorted(map(int, code.remainder(code.error))) == list(range(2048))
    codewords = (np.arange(1 << 12) << 11) | code.high
    assert (code.index(codewords) == np.arange(1 << 12)).all()
    distance = np.bitwise_count(codewords[:, None] ^ codewords[None, :256])
    assert distance[distance > 0].min() == 7
    random = np.random.default_rng(3)
    for width in (21, 22):
        table, counts = code.near(width)
        assert set(counts.tolist()) <= set(range(1, 7))
        near = lambda v: set((int(code.index(v)) ^ table[code.remainder(v)][: counts[code.remainder(v)]]).tolist())  # noqa: B023, E731
        for _ in range(2000):
            v = int(random.integers(1 << width))
            u = v ^ sum({1 << int(p) for p in random.integers(0, width, 2)})
            assert near(v) & near(u)


def test_linked_fingerprints_share_a_key():
    random = np.random.default_rng(4)
    prints = random.integers(0, 1 << 64, 3000, dtype=np.uint64)
    others = prints.copy()
    for _ in range(4):
        others ^= np.uint64(1) << random.integers(0, 64, len(others)).astype(np.uint64) * (random.random(len(others)) < 0.9).astype(np.uint64)
    own = golay.Keys()
    sets = []
    for found in (prints, others):
        keys, places = own(found)
        assert len(np.unique(np.stack([keys, places]), axis=1)[0]) == len(keys) <= 100 * len(found)
        sets.append([set() for _ in found])
        for k, p in zip(keys.tolist(), places.tolist()):
            sets[-1][p].add(k)
    close = np.bitwise_count(prints ^ others) <= 4
    assert close.sum() > 1000 and all(a & b for a, b, c in zip(*sets, close) if c)


@pytest.mark.parametrize("text", [*TEXTS, "A a A a A a", LONG * 2, "x" * 70_000 + " y z"])
def test_fingerprint(text):
    assert golay.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_forest_of_a_bucket():
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 64, 20, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(b)) ^ (np.uint64(1) << np.uint64(c)) for b, c in random.integers(0, 64, (15, 2))]))
    tree = golay.forest(prints)
    want = plain_components(prints.tolist())
    assert len(tree) == len(prints) - len(set(want)) and all(want[a] == want[b] for a, b in tree)
    pairs = golay.bucket_links(np.repeat(np.arange(3), [5, 200, 2])[: len(prints)].astype(np.int64), prints[:207])
    assert (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 4).all()


def near_copies(spark):
    """Groups of near copies that hang together in chains, and texts of their own."""
    random, rows = np.random.default_rng(6), []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(400)]
        for _ in range(40):
            own = list(base)
            for _ in range(int(random.integers(0, 4))):
                own[int(random.integers(400))] = f"x{random.integers(10**6)}"
            rows.append(" ".join(own))
    rows += [" ".join(f"o{random.integers(10**9)}" for _ in range(60)) for _ in range(60)]
    return [(1000 - i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bucket", [golay.BUCKET, 2])
def test_components_with_and_without_large_buckets(spark, bucket):
    rows = near_copies(spark)
    got = {r["doc_id"]: r for r in golay.simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    rows.sort()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints)
    assert {i: got[i]["component_id"] for i in got} == {rows[j][0]: rows[w][0] for j, w in enumerate(want)}
    assert all(got[i]["fingerprint"] == f"{p:016x}" for (i, _), p in zip(rows, prints))
    assert len(set(want)) < len(rows) - 150


def test_fingerprints_of_odd_rows(spark, docs):  # noqa: F811
    got = golay.simhash_duplicates(docs).toPandas()
    assert len(got) == docs.count()
    by = {None if np.isnan(r.doc_id) else int(r.doc_id): r for r in got.itertuples()}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[1].component_id == by[2].component_id == 0
    assert by[4].component_id == by[3].component_id == 3 and by[6].component_id == by[5].component_id == 5
    assert golay.simhash_duplicates(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "A b c d"), (None, "lone words of a row")], "doc_id long, text string")
    assert sorted(str(r["component_id"]) for r in golay.simhash_duplicates(none).collect()) == ["7", "7", "7", "None"]


def test_fingerprint_query(spark):
    got = QUERIES["op11_simhash_golay"](spark, DATA).collect()
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(prints)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(rows[j][0], f"{prints[j]:016x}", rows[w][0]) for j, w in enumerate(want)]


# Fill-in-middle


@pytest.mark.parametrize("share, kind", [(1.0, fim.Runs), (0.5, fim.Bits), (0.01, fim.Places)])
def test_containers_select(share, kind):
    on = np.random.default_rng(7).random(fim.CHUNK) < share
    own = fim.container(on)
    assert type(own) is kind and [own.select(k) for k in range(0, on.sum(), 97)] == np.flatnonzero(on)[::97].tolist()
    spans = np.zeros(fim.CHUNK, bool)
    spans[5:900] = spans[1000:1001] = spans[40_000:65_536] = True
    own = fim.container(spans)
    assert type(own) is fim.Runs and [own.select(k) for k in range(spans.sum())] == np.flatnonzero(spans).tolist()


@pytest.mark.parametrize("text", ["", "a", "é", "日本語 text", "x" * 65_536, "x" * 65_535 + "é", "é" * 40_000, "漢a" * 50_000 + "\U0001f600", "a" * 200_000 + "ß"])
def test_boundaries_are_those_of_code_points(text):
    own = fim.Boundaries.of_code_points(text.encode())
    assert own.units == len(text)
    for k in {0, len(text), *np.random.default_rng(8).integers(0, len(text) + 1, 50).tolist()}:
        assert own.select(k) == len(text[:k].encode())


def test_other_units():
    text = "one\ntwo é\n\nlast".encode()
    own = fim.Boundaries.of_matches(text, re.compile(rb"[^\n]*\n|[^\n]+"))
    assert own.units == 4 and [text[: own.select(k)] for k in range(5)] == [b"", b"one\n", "one\ntwo é\n".encode(), "one\ntwo é\n\n".encode(), text]
    assert fim.Boundaries.of_matches(b"", re.compile(rb"\w+")).units == 0 and fim.Boundaries.of_matches(b"--", re.compile(rb"\w+")).units == 1
    wide = b"ab " * 60_000
    own = fim.Boundaries.of_matches(wide, re.compile(rb"\w+ "))
    assert own.units == 60_000 and [own.select(k) for k in (0, 1, 30_000, 60_000)] == [0, 3, 90_000, 180_000]


def test_cuts_come_back(spark, docs):  # noqa: F811
    extra = spark.createDataFrame([(i, t, None, None, 0, "", 0, 0, "") for i, t in enumerate(["has <P> in it", "<", "<P", "ends with <S", "<<<>>>", "é<M" * 30, "日本語" * 30_000] * 6, 100)], DOCS)
    rows = docs.unionByName(extra)
    made = fim.fill_in_middle(rows).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in rows.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), r["back"]) for r in made) == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    for r in made:
        if r["form"] == "plain":
            assert r["output"] == r["back"] and r["middle_chars"] is None and r["prefix_chars"] is None
        else:
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            p, m, s = r["back"][:a], r["back"][a:b], r["back"][b:]
            assert r["output"] == (f"<P>{p}<S>{s}<M>{m}" if r["form"] == "psm" else f"<S>{s}<P>{p}<M>{m}") and r["n"] == len(r["back"])
    assert all(r["form"] == "plain" for r in made if "<P>" in r["back"] or not r["back"])
    assert fim.fill_in_middle(docs.limit(0)).count() == 0
    lines = fim.fill_in_middle(rows, unit=r"[^ ]* |[^ ]+").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r["doc_id"]), r["back"]) for r in lines) == want


def test_fill_in_middle_query(spark):
    filled = lambda f: f.assign(**{c: f[c].fillna(-1).astype("int64") for c in ("prefix_chars", "middle_chars")})
    got = filled(QUERIES["op12_fill_in_middle"](spark, DATA).toPandas())
    same(got, f"SELECT * REPLACE (coalesce(prefix_chars, -1) AS prefix_chars, coalesce(middle_chars, -1) AS middle_chars) FROM ({ORACLE_SQL['op12_fill_in_middle']})", DATA)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert all(hashlib.sha256(texts[r.doc_id].encode()).hexdigest() == r.restored_sha256 for r in got.itertuples())


# Ranked search


def scores(items, docs, k=20):
    """Plain version of the ranking: (item place, rank, doc_id, score)."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n, total, df = len(held), sum(s for _, _, s in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for place, text in enumerate(items):
        found = []
        for doc, c, size in held:
            m = 75 + (25 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(place, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_search_stops_early_and_is_exact():
    random = np.random.default_rng(9)
    term, doc, impact = [], [], []
    for t in range(12):
        own = np.flatnonzero(random.random(4000) < (0.9 if t < 6 else 0.02))
        term.append(np.full(len(own), 3 * t))
        doc.append(own)
        impact.append((random.pareto(1.0, len(own)) * (20 if t < 6 else 5000)).astype(np.int64) // 10 * 10)
    term, doc, impact = map(np.concatenate, (term, doc, impact))
    lists = best_position.Lists(term, doc, impact, 4000)
    early = 0
    for _ in range(40):
        query = {int(t): int(random.integers(1, 3)) for t in random.choice(40, 9, replace=False)}
        total = np.zeros(4000, np.int64)
        for t, times in query.items():
            np.add.at(total, doc[term == t], times * impact[term == t])
        want = [(-s, d) for s, d in sorted(zip((-total).tolist(), range(4000)))[:20] if s < 0]
        top, found, read = lists.search(query, 20)
        assert [(s, d) for d, s in zip(top.tolist(), found.tolist())] == [(-s, d) for s, d in [(-x, d) for x, d in want]]
        early += read < 3600
    assert early > 20


def test_equal_scores_go_to_smaller_ids():
    lists = best_position.Lists(np.zeros(500, np.int64), np.arange(500), np.full(500, 7), 500)
    top, found, _ = lists.search({0: 2, 9: 1}, 20)
    assert top.tolist() == list(range(20)) and set(found.tolist()) == {14}
    assert len(lists.search({}, 20)[0]) == len(lists.search({5: 1}, 20)[0]) == 0


def test_ranking_of_odd_rows(spark, docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(best_position, "BLOCK_BYTES", 256)
    items = ["a b c é ü W5", "", "nothing-of-this", "one one two w3 w900 tail", None, "İΣ null", "A B C"]
    table = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = best_position.ranked(table, docs).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got])) == sorted(map(str, scores(items, rows)))
    assert best_position.ranked(table.limit(0), docs).count() == best_position.ranked(table, docs.limit(0)).count() == 0
    two = best_position.ranked(table.limit(1).union(table.limit(1)), docs, k=2).collect()
    assert sorted(r["rank"] for r in two) == [1, 1, 2, 2]


def test_ranking_over_many_shards(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    monkeypatch.setattr(best_position, "DOCUMENTS", 7)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = best_position.ranked(table, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == scores(items, rows)


def test_ranking_query(spark):
    same(QUERIES["op13_best_position"](spark, DATA).toPandas(), ORACLE_SQL["op13_best_position"], DATA)
