"""The methods against plain versions of them, and odd rows: nulls, repeats, ragged and huge values, clashing columns."""

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from coderake.llm import ball_tree, kmeans_tree, langid, mixing, ngram_join, packing, quality, token_counts
from coderake.llm.common import numbered, parts
from tests.conftest import DATA
from tests.llm.test_operators import components, shingles, words


# Mixing


def test_seats_go_to_the_highest_quotients(spark):
    random = np.random.default_rng(1)
    votes = [float(v) for v in random.pareto(1.2, 60) * 40 + random.random(60)]
    claims = spark.createDataFrame([(v,) for v in votes], "vote double")
    for seats in (1, 7, 60, 2_000):
        queue, won = [(-v, i) for i, v in enumerate(votes)], Counter()
        heapq.heapify(queue)
        for _ in range(seats):
            _, i = heapq.heappop(queue)
            won[i] += 1
            heapq.heappush(queue, (-votes[i] / (2 * won[i] + 1), i))
        d = mixing.divisor(claims, seats)
        assert [math.floor(v / d + 0.5) for v in votes] == [won[i] for i in range(60)]


def test_targets_of_small_and_hot_sources(spark):
    rows = [(i if i % 3 else None, " ".join(f"w{i}x{j}" for j in range(40 + i % 7)), "big") for i in range(600)]
    rows += [(1000, "one two three", "tiny"), (1001, "a b c d e", None), (1002, None, "empty"), *[(7, "same row again and again", "rep")] * 50]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, mixing.cyclic_weights(docs)).toPandas()
    assert len(found) == len(rows) and (found["taken"] <= 2 * found["size"]).all()
    near = found.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((near["taken"] - near["target"]).abs() <= 16 + 0.005 * near["target"]).all()
    # Sources that stop at their cap are taken exactly twice.
    assert near.loc[3, "taken"] == 6 and near.loc[5, "taken"] == 10


def test_places_without_one_task_for_all(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [r["v"] for r in numbered(df, "place", F.col("v")).orderBy("place").collect()] == list(range(1000))
    assert numbered(df.limit(0), "place", F.col("v")).count() == 0


# Packing


def test_bounded_bins_close_and_pack_as_well_as_any(spark):
    """The query's own pieces, shard by shard: the bound acts, and costs nothing beside best-fit with any number of bins."""
    found = packing.op3_best_fit_packing(spark, "/root/testdata/sf0.1").select("sequence_id", "offset", "length").toPandas()
    made, least = found["sequence_id"].nunique(), -(-found["length"].sum() // 4096)
    random = np.random.default_rng(2)
    lengths, closed = found["length"].to_numpy()[random.permutation(len(found))].tolist(), []
    bins, _ = packing.best_fit(lengths, 4096, packing.OPEN_BINS, closed)
    free, plain = [], 0
    for n in lengths[:4000]:  # plain best-fit: the open bin with the least space that holds the item
        fits = [i for i, s in enumerate(free) if s >= n]
        if fits:
            i = min(fits, key=free.__getitem__)
            free[i] -= n
        else:
            free.append(4096 - n)
    mine, _ = packing.best_fit(lengths[:4000], 4096, packing.OPEN_BINS)
    assert len(closed) > 0 and max(mine) + 1 <= 1.01 * len(free) + 1
    assert made <= 1.01 * least + 2 and max(bins) + 1 <= 1.01 * least + 2


# Quality


def test_risk_by_hand():
    p, u, share = np.array([[1.0, 1.0], [3.0, 1.0]]), np.array([[-1.0, 1.0], [2.0, 1.0]]), np.array([0.25, 0.75])
    loss = lambda z: math.log(1 + math.exp(-z))
    for w, prior in (([0.5, -0.25], 0.3), ([2.0, 0.5], 0.9)):
        gp, gu = [w[0] * x + w[1] for x in (1.0, 3.0)], [w[0] * x + w[1] for x in (-1.0, 2.0)]
        positive = prior * (0.25 * loss(gp[0]) + 0.75 * loss(gp[1]))
        negative = (loss(-gu[0]) + loss(-gu[1])) / 2 - prior * (0.25 * loss(-gp[0]) + 0.75 * loss(-gp[1]))
        value, gradient = quality.risk(np.array(w), p, u, prior, share)
        assert abs(value - (positive + max(0.0, negative))) < 1e-12
        # Where the risk on negatives is below zero, only that part is followed, upwards.
        part = (lambda v: quality_negative(v, p, u, prior, share)) if negative < 0 else (lambda v: quality.risk(v, p, u, prior, share)[0])
        sign = -1 if negative < 0 else 1
        for i in range(2):
            step = np.eye(2)[i] * 1e-6
            assert abs(sign * (part(np.array(w) + step) - part(np.array(w) - step)) / 2e-6 - gradient[i]) < 1e-5
    assert quality_negative(np.array([2.0, 0.5]), p, u, 0.9, share) < 0  # the clamp acts in the second case


def quality_negative(w, p, u, prior, share):
    return np.logaddexp(0, u @ w).mean() - prior * share @ np.logaddexp(0, p @ w)


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled(prior):
    random = np.random.default_rng(3)
    good = lambda n: random.normal(2, 1, (n, 3))
    unlabelled = np.vstack([good(int(prior * 6000)), random.normal(-2, 1, (6000 - int(prior * 6000), 3))])
    assert abs(quality.class_prior(good(3000), unlabelled[random.permutation(6000)]) - prior) < 0.05


def test_quality_rows(spark):
    rows = [(i, "Plain words in a sentence, number %d." % i if i % 2 else "$$$ ### !!! %d" % i, "x") for i in range(300)] + [(3, "Plain words again.", "x")] * 400 + [(None, None, "x"), (5000, "", "x"), (5001, "word " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(3, 1, 0)] * 20, "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs, labels, sample=300).toPandas()
    assert len(found) == len(rows) and found["score"].between(0, 1).all()
    known = found[(found["doc_id"] < 300)]
    assert ((known["doc_id"] % 2 == 1) == (known["predicted"] == 1)).mean() > 0.98
    out = quality.score(docs, quality.train(docs, labels, 300), "own")
    assert out.columns == ["doc_id", "text", "score", "own"]


# Language


def test_decoding_by_hand():
    random = np.random.default_rng(4)
    model = {"code": langid.codewords(5), "w": random.normal(0, 1, (langid.DIMENSIONS + 1, 15)), "sure": random.random(15) + 0.5}
    x = random.random((20, langid.DIMENSIONS)).astype(np.float32) / 10
    best, share, lead = langid.decode(model, x)
    for i, row in enumerate(x):
        f = [sum(10 * float(v) * w for v, w in zip(row, model["w"][:-1, j])) + model["w"][-1, j] for j in range(15)]
        loss = [sum(s * math.log(1 + math.exp(-c * y)) for c, y, s in zip(word, f, model["sure"])) for word in model["code"]]
        z = [math.exp(min(loss) - v) for v in loss]
        ranked = sorted((v / sum(z) for v in z), reverse=True)
        assert best[i] == loss.index(min(loss)) and abs(share[i] - ranked[0]) < 1e-5 and abs(lead[i] - ranked[0] + ranked[1]) < 1e-5


def test_many_languages_learn_alike(spark):
    """260 languages, one with a hundred times as many rows: every one of them is learnt."""
    rows = [(i * 1000 + j, " ".join([chr(0x4E00 + i) * 3 + chr(97 + i % 26) * 2] * 6), f"l{i:03}", "s", "p") for i in range(260) for j in range(600 if i == 0 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string")
    found = langid.languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert found["lang_pred"].nunique() > 250 and (found["lang_pred"] == found["lang"]).mean() > 0.97
    assert len(langid.train(docs, most=5)["langs"]) == 5
    assert langid.label(docs.limit(3), langid.train(docs, most=2), names=("a", "b", "c")).columns == [*docs.columns, "a", "b", "c"]


# Vectors

ODD = [None, [], [0.0] * 4, [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0], [2.0, 1.0], [1e20, 1.0, -1.0, 0.0], [-1e20, 3.0, 1.0, 0.0], [1e20, 1.0, 1.0, 0.0]]


@pytest.fixture(scope="module")
def vectors(spark):
    random = np.random.default_rng(5)
    rows = [(1000 + 100 * i, v) for i, v in enumerate(ODD)] + [(i, [float(x) for x in random.normal(0, 1, 4)]) for i in range(0, 400, 5)]
    rows += [rows[20]] * 2 + [rows[-20]] * 3 + [(100, [float(x) for x in random.normal(0, 1, 4)])] * 2  # repeats of a candidate and of queries
    return rows


def saved_vectors(spark, rows, tmp_path):
    spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, leaf string, chunk int, score double").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def ok(v, zero):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_ball_tree_on_odd_rows(spark, vectors, tmp_path):
    got = {}
    for r in ball_tree.op10_ball_tree_topk(spark, saved_vectors(spark, vectors, tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [(i, [math.floor(1024 * x) if abs(1024 * x) < 2**53 else int(1024 * x) for x in v]) for i, v in vectors if ok(v, True)]
    want = {}
    for i in {i for i, _ in whole if i % 100 == 0}:
        q = min(v for j, v in whole if j == i)
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:10]
        want[i] = [(n, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores, 1)]
    cut = lambda rows: [(n, None if abs(s) >= 2**63 - 1 else j, s) for n, j, s in rows]
    assert {i: cut(sorted(v)) for i, v in got.items()} == {i: cut(v) for i, v in want.items() if v}


def test_kmeans_tree_on_odd_rows(spark, vectors, tmp_path):
    got = {}
    for r in kmeans_tree.op2_kmeans_tree_ann(spark, saved_vectors(spark, vectors, tmp_path)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, v) for i, v in vectors if ok(v, False)]
    hit = total = 0
    for i in {i for i, _ in rows if i % 100 == 0}:
        q = min(v for j, v in rows if j == i)
        near = sorted((math.dist(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:10]
        mine = sorted(got.get(i, []))
        assert [n for n, _, _ in mine] == list(range(1, len(near) + 1))  # all candidates, if fewer than ten
        at = Counter(j for _, j in near)
        if max(map(abs, q)) < 1e10:  # from far out all others are about equally far
            hit, total = hit + sum((Counter(j for _, j, _ in mine) & at).values()), total + len(near)
        for _, j, s in mine:
            assert min(abs(math.dist(q, v) - s) for k, v in rows if k == j and len(v) == len(q)) <= 1e-9 * max(1.0, s)
    assert hit >= 0.9 * total


def test_recall_of_the_query(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").toPandas()
    e = e[e["embedding"].map(lambda v: v is not None and ok(list(v), False))]
    x, ids = np.array(e["embedding"].tolist(), float), e["vec_id"].to_numpy()
    hit = total = 0
    for q, rows in kmeans_tree.op2_kmeans_tree_ann(spark, "/root/testdata/sf0.01").toPandas().groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit, total = hit + len(set(ids[np.lexsort((ids, d))[:10]]) & set(rows["vec_id"])), total + 10
    assert total and hit >= 0.9 * total


# Token counts


def test_path_of_a_very_long_word_is_bounded():
    pieces = {"▁a": -3.0, "a": -2.0, "aa": -2.5, "ab": -4.0, "b": -3.5, "▁": -1.0}
    forward = token_counts.SharedForward(pieces)
    long = "a" * 2_000_000 + "b"
    found = forward.counts({long, "a" * 400 + "b", "a" * 400, "ab", "b" * 300 + "c"})
    assert long not in forward.known and len("".join(forward.known)) < 1000

    def plain(word):
        text, best = token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(text) + 1):
            n = len(text[i - 1].encode())
            best.append(max([(best[i - 1][0] + n * token_counts.BYTE_SCORE, best[i - 1][1] - n)] + [(best[i - k][0] + pieces[text[i - k : i]], best[i - k][1] - 1) for k in range(1, min(i, 3) + 1) if text[i - k : i] in pieces]))
        return -best[-1][1]

    assert all(found[w] == plain(w) for w in found)


# Near copies and the pipeline


def test_a_row_without_an_id_joins_others(spark):
    base = [f"v{i}" for i in range(120)]
    change = lambda ks: " ".join("x" + w if i in ks else w for i, w in enumerate(base))
    a, n, b = change(()), change((20, 60)), change((20, 60, 90, 110))  # only the middle one links with both
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame([(5, a), (None, n), (9, b), (None, "alone here")], "doc_id long, text string")).collect()}
    assert got[5] == 5 and got[9] == 5


def test_cells_against_all_pairs():
    random = np.random.default_rng(6)
    base = np.unique(random.integers(0, 1 << 63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[random.random(200) > random.choice([0.03, 0.09])], random.integers(0, 1 << 63, random.integers(0, 12)).astype(np.uint64)])) for _ in range(60)]
    link = lambda s, t: 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))
    ids = np.arange(60)
    found = ngram_join.cell_links(ids[:25], sets[:25], ids, sets, 80, True)
    assert all(link(sets[a], sets[b]) for a, b in found) and len(found) < 60
    root = {i: i for i in range(60)}
    want = dict(root)
    for r, pairs in ((root, found), (want, [(a, b) for a in range(25) for b in range(60) if a != b and link(sets[a], sets[b])])):
        for a, b in pairs:
            x, y = r[a], r[b]
            for k in r:
                r[k] = min(x, y) if r[k] in (x, y) else r[k]
    assert root == want
    bits = [ngram_join.bitmap(s) for s in sets]
    sizes = np.array([len(s) for s in sets])
    asks, met = ngram_join.cell_bounds(ids[:25], sizes[:25], bits[:25], ids, sizes, bits, 80)
    assert {a for a in range(25) if any(a != b and link(sets[a], sets[b]) for b in range(60))} <= set(asks)
    assert {b for b in range(60) if any(a != b and link(sets[a], sets[b]) for a in range(25))} <= set(met)


CLASHES = ["score", "n_shingles", "lang_pred", "kept", "size", "shard", "row_key", "component_id", "draw", "quality_score", "language_found", "token", "turn"]


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as pipeline
    from coderake.llm.common import saved

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = [(None, None, "en", "web", 0), (None, "Plain words of a row without an id, twice the same as it stands here.", None, None, 1)] + [(10**6, t, "en", "web", 1) for t in ("", "12 34", "Some words that share an id with other rows but not a text at all.", "Some words that share an id with other rows but not a text at all.")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).select("*", *[F.lit(1).alias(c) for c in CLASHES])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stages, before = [], saved(docs, "test")
    for _, stage in pipeline.STAGES:
        after = saved(stage(spark, before, DATA), "test")
        stages.append((before, after))
        before = after
    text = lambda df: sorted(map(str, ((r["doc_id"], r["text"]) for r in df.collect())))
    assert all(a.columns == docs.columns for _, a in stages[:4])

    (before, after) = stages[0]
    m = quality.train(before.select("doc_id", "text"), labels)
    good = lambda t: ((quality.features(t) - m["mean"]) / m["scale"]) @ m["w"][:-1] + m["w"][-1] >= 0
    assert text(after) == sorted(map(str, ((r["doc_id"], r["text"]) for r in before.collect() if good(r["text"]))))

    (before, after) = stages[1]
    m = langid.train(before.select("doc_id", "text", "lang"))
    told = lambda t: t and any(c.isalpha() for c in t) and langid.decode(m, langid.features(t)[None])[2][0] >= 0.05
    assert text(after) == sorted(map(str, ((r["doc_id"], r["text"]) for r in before.collect() if told(r["text"]))))

    (before, after) = stages[2]
    rows = sorted(before.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    root = components({i: shingles(r["text"]) for i, r in enumerate(rows)})
    assert text(after) == sorted(str((r["doc_id"], r["text"])) for i, r in enumerate(rows) if root[i] == i)

    (before, after) = stages[3]
    taken = mixing.mix(before, mixing.cyclic_weights(before)).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r["text"])) for r in after.collect()) == taken
    own = {r["doc_id"]: set(words(r["text"])) for r in before.collect()}
    assert all(set(words(r["text"])) <= own[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in after.collect())

    (before, after) = stages[4]
    coder, want = Tokenizer.from_str(packing.tokenizer_json()), []
    for r in before.collect():
        ids = coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in after.collect())

    none = docs.limit(0)
    for _, stage in pipeline.STAGES:
        none = saved(stage(spark, none, DATA), "test")
        assert none.count() == 0


def test_parts_bound_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000, None, "", "y" * 6_000_000, "z"] + ["w"] * 10)], names=["t"])
    cut = list(parts(batch, 0))
    assert sum(p.num_rows for p in cut) == 15 and len(cut) > 1
    assert pa.Table.from_batches(cut).column(0).to_pylist() == batch.column(0).to_pylist()


# Chat


def test_layouts_with_more_fields_and_unknown_ones(spark):
    from coderake.llm import chat

    cases = [
        ('{"messages": [{"role": "user", "content": "a"}], "id": "7"}', "messages", [("user", "a")]),
        ('{"id": 7, "messages": [{"role": "user", "content": "a", "name": "n"}, {"role": "assistant", "content": "b"}], "source": "s"}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"messages": []}', "messages", []),
        ('{"conversations": [], "id": 3}', "from_value", []),
        ('{"conversations": [{"from": "human", "value": null}]}', "from_value", [("user", "")]),
        ('{"completion": "y", "lang": "en", "prompt": "x"}', "prompt_completion", [("user", "x"), ("assistant", "y")]),
        ('{"id": 1, "question": "x"}', None, None),
        ('{"name": "n", "question": "z"}', None, None),
        ('{"messages": {"role": "user"}}', None, None),
        ("[]", None, None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, j, "e") for i, (j, _, _) in enumerate(cases)] + [(0, cases[0][0], "e")], "n int, json string, escaped string").select("n", "escaped", F.parse_json("json").alias("record"))
    done = chat.format_chats(rows)
    got = {r["n"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in done.select("n", "layout", "turns").collect()}
    assert got == {i: (name, turns) for i, (_, name, turns) in enumerate(cases)}
    assert done.where("layout IS NULL AND formatted IS NOT NULL").count() == 0 and done.where("n = 2 AND formatted = ''").count() == 1
    assert sorted(r["records"] for r in chat.unknown_layouts(done).collect()) == [1, 1, 1, 2]
    assert chat.format_chats(rows.limit(0)).count() == 0


def test_chat_rows_that_repeat(spark, tmp_path):
    from coderake.llm import chat

    rows = [(1, 0, "user", "a <|end|> </s>", 1, "x")] * 2 + [(1, 1, "assistant", None, 1, "x"), (None, None, None, None, 2, "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int, turns string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op7_chat_format(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0), None: (1, 0), -1: (2, 21)}


def test_archives_of_repeated_rows(spark, tmp_path):
    from coderake.llm import warc

    rows = [(5, "u", "same", 1), (5, "u", "same", 1), (3, "v\r\nX: y", "same", 1), (None, None, "same", 1), (4, "w", None, 1), (2, "w", "", 1), (9, "z", "é" * 50_000 + "\r\n\r\nWARC/1.1\r\n", 1)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), f"{tmp_path}/a")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_archives(spark, f"{tmp_path}/a").collect()), key=str)
    want = [(5, "response", None, "same"), (5, "response", None, "same"), (3, "revisit", 5, None), (None, "revisit", 5, None), (4, "response", None, ""), (2, "revisit", 4, None), (9, "response", None, rows[-1][2])]
    assert got == sorted(want, key=str)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/b")
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0
