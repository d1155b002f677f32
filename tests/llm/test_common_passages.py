"""Passages that very many documents share, and nothing else: the n-gram join stays exact and near linear."""

import random
import time

from pyspark.sql import functions as F

from coderake.llm import ngram_join
from tests.llm.test_operators import components, shingles


def test_equals_brute_force_where_passages_are_common(spark):
    """Tails of all lengths behind two passages, some of them copied with changes: links just above and just below 0.8."""
    draw = random.Random(11)
    passages = [[f"p{k}x{i}" for i in range(30)] for k in range(2)]
    rows, made = [], []
    for i in range(260):
        if made and i % 4 == 0:
            words = list(draw.choice(made))
            for _ in range(draw.choice([1, 1, 2])):
                words[draw.randrange(len(words))] = f"new{i}"
            words = words[: len(words) - draw.randrange(3)]
        else:
            tail = [f"o{i}x{j}" for j in range(draw.choice([0, 1, 2, 3, 4, 6, 9, 14, 40]))]
            words = tail + passages[i % 2] if i % 3 else passages[i % 2] + tail
            made.append(words)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components({i: shingles(text) for i, text in rows})
    assert got == want
    assert len(set(want.values())) > 20 and any(i != c for i, c in want.items())


def test_one_passage_in_all_documents_grows_with_rows_alone(spark, tmp_path):
    """30 common and 6 own words: two documents share 26 of 38 shingles, so none link; three times the rows take at most
    three and a half times as long."""
    common = " ".join(f"c{i}" for i in range(30))
    own = F.expr("concat_ws('', transform(sequence(1, 6), i -> concat(' o', id, 'x', i)))")
    took = []
    for n in (8_000, 24_000):
        spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(common), own).alias("text")).write.parquet(f"{tmp_path}/{n}")
        begun = time.monotonic()
        found = ngram_join.near_duplicates(spark.read.parquet(f"{tmp_path}/{n}"))
        assert found.where("component_id = doc_id AND n_shingles = 32").count() == n
        took.append(time.monotonic() - begun)
    assert took[1] <= 3.5 * took[0]
