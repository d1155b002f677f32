"""The operators against brute force on small tables with nulls, empties, long texts, ties, repeats and clashing columns."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coderake.llm import ball_tree, chat, kmeans_tree, langid, mixing, ngram_join, packing, quality, token_counts, warc
from tests.conftest import DATA
from tests.oracle import same

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [None, "", "  \n", "one two", "One TWO", "a b c d e f g h i j k", "a b c d e f g h i j k", "a b c d e f g h i j x", "é ü, ß. İΣ", LONG, LONG + " tail"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, token string, size int, shard int, score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, ["x", None, "y"][i % 3], 1, "t", 0, 0, "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[5], (None, "null id", None, "x", 1, "t", 0, 0, "s")], DOCS)


def components(sets):
    """Brute force: smallest id that each row's set reaches."""
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, s in sets.items():
            for b, t in sets.items():
                if s and t and 100 * len(s & t) >= 80 * len(s | t) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def shingles(text, n=5):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_mixing(spark, docs):
    found = mixing.mix(docs, mixing.cyclic_weights(docs)).toPandas()
    assert len(found) == docs.count()
    sizes = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    for _, r in found.iterrows():
        assert r["size"] == sizes[None if np.isnan(r["doc_id"]) else r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
    assert abs(found.groupby("target")["target"].first().sum() - 1.5 * found["size"].sum()) < 1e-6
    near = found.groupby("target").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((near["taken"] - near["target"]).abs() <= 64 + 0.01 * near["target"]).all()
    again = mixing.mix(docs, mixing.cyclic_weights(docs)).toPandas()
    key = ["doc_id", "taken"]
    assert found[key].sort_values(key).equals(again[key].sort_values(key).set_index(found[key].sort_values(key).index))
    out = mixing.mixed_documents(docs, mixing.cyclic_weights(docs))
    assert out.columns == docs.columns
    assert sum(len(words(r["text"])) for r in out.select("text").collect()) == found["taken"].sum()
    assert mixing.mix(docs.limit(0), mixing.cyclic_weights(docs.limit(0))).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    found = packing.pack_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    own = Tokenizer.from_str(packing.tokenizer_json())
    want = []
    for r in docs.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want += [(r["doc_id"], n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    end = found.groupby("sequence_id").apply(lambda g: (g["offset"].tolist(), (g["offset"] + g["length"]).tolist()))
    assert all(a == [0, *b[:-1]] and b[-1] <= 4096 for a, b in end)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_bounded_best_fit():
    assert packing.best_fit([3, 3, 2, 1], 5, 10) == ([0, 1, 1, 0], [0, 0, 3, 3])
    assert packing.best_fit([3, 4, 3, 1, 1], 5, 1)[0] == [0, 1, 2, 2, 2]


def test_ngram_join(spark, docs):
    base = [f"v{i}" for i in range(120)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in (3, 30, 60, 61, 100)] + [" ".join(base), " ".join(base[:60]), " ".join(base[30:])]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(rows).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows.where("doc_id IS NOT NULL").collect()}
    root = components(sets)
    assert {i: (len(s), root[i]) for i, s in sets.items()} == {k: v for k, v in found.items() if k is not None}
    assert found[None] == (1, None)
    assert ngram_join.near_duplicates(rows.limit(0)).count() == 0


def test_bitmaps_bound_what_is_outside():
    random = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(random.integers(0, 400, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in random.integers(1, 300, 2))
        assert ngram_join.outside(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(np.setdiff1d(a, b))


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.quality_scores(docs.unionByName(spark.createDataFrame([(10**9, None, None, None, None)], docs.schema)), labels).toPandas()
    assert len(found) == docs.count() + 1 and found["score"].between(0, 1).all()
    held = found[found["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert (quality.quality_scores(docs.limit(9), labels.limit(0)).toPandas()["score"] == 0.5).all()


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", None, None), (10**9 + 1, "12 34!", "en", None, None)], docs.schema)
    found = langid.languages(docs.unionByName(odd)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id", how="left")
    assert (found[found["doc_id"] >= 10**9]["lang_pred"] == "und").all()
    held = found[found["held_out"] & found["lang"].notna()]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert langid.languages(docs.limit(0)).count() == 0
    assert set(langid.languages(docs.where("lang = 'de'")).toPandas()["lang_pred"]) == {"de"}


def test_codewords_differ():
    for n in (2, 4, 7, 8, 40):
        code = langid.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= (1 if n == 2 else 2)


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>", "[\\INST] [\\\\INST]", "<<SYS>>\\<s>", "plain", ""]
    rows = spark.createDataFrame([(i % 3, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(7, 0, None, None), (7, 0, "human", "x")], "conv_id long, turn long, role string, text string")
    done = chat.format_chats(chat.conversation_records(rows)).withColumn("back", chat.read_back(F.col("formatted")))
    assert done.where("back <=> turns").count() == 4
    marks = done.select(F.explode(F.array(*[F.locate(m, "formatted") for m in ("</s>", "[INST]", "<|turn|>user\n<|end|>", "<<SYS>>")])).alias("p")).where("p > 0")
    assert marks.count() == 0
    other = spark.createDataFrame([(1, '{"instruction": "do", "input": "", "output": "done"}'), (2, '{"prompt": "p", "response": null}'), (3, '{"odd": 1}')], "id int, j string")
    turns = {r["id"]: r["turns"] for r in chat.format_chats(other.select("id", F.parse_json("j").alias("record"))).collect()}
    assert turns == {1: [("user", "do"), ("assistant", "done")], 2: [("user", "p"), ("assistant", "")], 3: None}


def test_token_counts(spark, docs):
    vocabulary = token_counts.unigram_pieces()

    def plain(word):
        text, best = "▁" + word, [(0.0, 0)]
        for i in range(1, len(text) + 1):
            size = len(text[i - 1].encode())
            options = [(best[i - 1][0] + size * token_counts.BYTE_SCORE, best[i - 1][1] - size)]
            options += [(best[j][0] + vocabulary[text[j:i]], best[j][1] - 1) for j in range(max(0, i - 40), i) if text[j:i] in vocabulary]
            best.append(max(options))
        return -best[-1][1]

    sample = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(30).unionByName(docs.select("doc_id", "text"))
    want = sorted((str(r["doc_id"]), len((r["text"] or "").split()), sum(map(plain, (r["text"] or "").split()))) for r in sample.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(sample).collect()) == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nx\r\n\r\n" * 3), (None, "u", "same"), (6, "u", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("original", F.lit(2))
    warc.write_archives(pages, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    by_id = {r["page_id"]: r for r in found}
    assert len(found) == 7
    assert (by_id[1]["record_type"], by_id[1]["refers_to"], by_id[2]["record_type"], by_id[None]["refers_to"]) == ("revisit", 2, "response", 2)
    assert (by_id[3]["refers_to"], by_id[4]["payload"], by_id[5]["payload"], by_id[6]["payload_bytes"]) == (4, "", rows[4][2], 200_000)
    assert by_id[1]["payload_bytes"] == 4 and by_id[1]["payload_digest"] == by_id[2]["payload_digest"]
    assert by_id[1]["url"] == "http://a%0D%0AX: y"
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def vectors(spark, n, width=8):
    random = np.random.default_rng(3)
    x = np.vstack([random.normal(size=(n - 40, width)), np.ones((40, width))]).round(3)
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, vector array<double>")


def test_ball_tree_is_exact(spark):
    x, rows = vectors(spark, 900)
    whole = np.floor(x * 64)
    rows = rows.select("vec_id", F.transform("vector", lambda v: F.floor(v * 64).cast("double")).alias("vector"))
    found = ball_tree.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, shard_rows=200, query_block=7).collect()
    for q in range(0, 900, 50):
        scores = whole @ whole[q]
        want = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_kmeans_tree_recall(spark):
    x, rows = vectors(spark, 3000)
    found = kmeans_tree.neighbours(rows, rows.where("vec_id % 50 = 0"), k=5, query_block=25).collect()
    hit = 0
    for q in range(0, 3000, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:5]
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert np.allclose([r["score"] for r in own], far[[r["vec_id"] for r in own]])
        hit += len(set(want) & {r["vec_id"] for r in own})
    assert hit >= 0.9 * 300
    assert kmeans_tree.neighbours(rows.limit(0), rows.limit(0)).count() == 0
    assert ball_tree.top_k(rows.limit(0), rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op7_chat_format", "op9_warc_revisit", "op10_ball_tree_topk"])
def test_query_matches_sql(spark, name):
    from coderake.llm.queries import ORACLE_SQL, QUERIES

    same(QUERIES[name](spark, DATA).toPandas(), ORACLE_SQL[name], DATA)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:3]:
        after = stage(spark, kept, DATA)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), docs.schema)
        assert after.join(kept, "doc_id", "left_anti").count() == 0
        kept = after
    sets = {r["doc_id"]: shingles(r["text"]) for r in kept.collect()}
    assert components(sets) == {i: i for i in sets}
    out = p.run(spark, DATA)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert out.join(kept, "doc_id", "left_anti").count() == 0


def test_quality_uses_sparse_labels(spark):
    """Few labels among many rows all count, however small the sample is."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Plain words in a sentence, number "), F.col("id"), F.lit("."))).otherwise(F.concat(F.lit("$$$ ### !!! "), F.col("id"))).alias("text"))
    labels = spark.range(0, 4000, 101).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).cast("int").alias("quality"))
    (good, weights), (unlabelled, _) = quality._sample(docs, labels, 200)
    known = labels.where(quality.fold(F.col("doc_id")) != 1)
    assert len(good) == known.where("quality = 1").count() and (weights == 1).all()
    assert 50 < len(unlabelled) < 250
