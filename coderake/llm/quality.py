"""Quality classifier by positive-unlabelled learning.

Trusted positives are sampled documents labelled good; the unlabelled side is sampled
web text whose labels, if any, are not looked at. A linear model on shape statistics of
the whole text minimises the non-negative unbiased risk
``p R+(positives) + max(0, R-(unlabelled) - p R-(positives))`` with the logistic loss.
The class prior p is estimated from positives and unlabelled text alone: a classifier of
the one against the other orders texts, and above any of its thresholds the unlabelled side
holds at least p times the share that the positives have there; the least such ratio is p.
No label 0 is looked at.

Cases: a null text is scored as an empty one; without positives or unlabelled rows in
the training part every score is 0.5; labels for one id are averaged, good being 0.5 or
more; repeated rows count as often as they occur (of an id that more than COPIES rows share
about so many are drawn, and weigh for all); an empty table gives an empty result; a text
of any length is read whole. Only id and text are read.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import fold, hash_share, parts, tidy

#: Rows of each side, labelled and unlabelled, that a model is fitted on, about, however many there are.
SAMPLE = 40_000
#: Rows that are drawn of one labelled id, about.
COPIES = 64
_CLASSES = [bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b";:", b"!", b"?", b"\"'`", b"()[]{}", b"<>", b"/\\", b"|", b"#", b"$", b"%", b"&", b"*", b"@~^", b"_=+", b"-", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_KIND = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _KIND[list(_c)] = _i
N_FEATURES = 3 * (len(_CLASSES) + 1) + 12


def features(text: str | None) -> np.ndarray:
    """Shape statistics of a whole text: shares of kinds of characters, and how words and lines repeat."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    words = (text or "").split()
    n, lines = max(1, len(words)), (text or "").split("\n")
    share = np.bincount(_KIND[raw], minlength=len(_CLASSES) + 1) / max(1, len(raw))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    twice = sum(map(eq, words, words[1:]))
    upper = sum(map(str.isupper, words))
    odd = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?\"')" for w in words)
    more = [len(raw) and np.log1p(len(raw)) / 10, np.log1p(len(words)) / 10, len(counts) / n, top / n, twice / n, np.sqrt(twice / n), upper / n, np.sqrt(upper / n), odd / n, np.sqrt(odd / n), len(raw) / n / 20, len(set(lines)) / len(lines)]
    return np.concatenate([share, np.sqrt(share), np.minimum(1.0, 30 * share), more]).astype(np.float32)


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Features and weights of positives and of unlabelled rows, both from the training part. Each side is sampled by its
    own share, so few labels among many rows all count: unlabelled rows one by one, positives by id. The sampled ids are
    bounded like the sample, and few enough to broadcast."""
    training = fold(F.col("doc_id")) != 1
    good = labels.where(training).groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality >= 0.5").select("doc_id")
    found = docs.where(training).groupBy("doc_id").agg(F.count("*").alias("n")).join(good, "doc_id")
    share, good_share = rows / max(1, docs.where(training).count()), rows / max(1, found.count())
    kept = found.where(hash_share(good_share, F.col("doc_id"), seed=4))
    place = F.monotonically_increasing_id()
    drawn = docs.where(training).select("doc_id", "text", F.coalesce(hash_share(share, F.col("doc_id"), place, seed=4), F.lit(False)).alias("unlabelled"), F.pmod(F.xxhash64("doc_id", place, F.lit(5)), F.lit(1 << 30)).alias("draw"))
    drawn = drawn.join(F.broadcast(kept), "doc_id", "left").withColumn("weight", F.when(F.col("draw") * F.col("n") < COPIES * (1 << 30), F.greatest(F.col("n") / COPIES, F.lit(1.0))))
    drawn = drawn.where("unlabelled OR weight IS NOT NULL").select("text", "weight", "unlabelled")

    def scan(batches):
        for batch in (part for whole in batches for part in parts(whole, 0)):
            found = np.array([features(t.as_py()) for t in batch.column(0)], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), batch.column(1), batch.column(2)], names=["x", "weight", "unlabelled"])

    got = drawn.mapInArrow(tidy(scan), "x binary, weight double, unlabelled boolean").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES)
    weight = np.array([np.nan if w is None else w for w in got.column("weight").to_pylist()], float)
    side = np.array(got.column("unlabelled").to_pylist(), bool)
    order = np.lexsort(x.T)  # rows arrive in any order; sums of floats should not differ for it
    x, weight, side = x[order].astype(float), weight[order], side[order]
    positive = ~np.isnan(weight)
    return (x[positive], weight[positive]), (x[side], np.ones(side.sum()))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the bias) that minimise the non-negative risk by Adam on all rows. weights: of positives."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    share = np.full(len(p), 1 / len(p)) if weights is None else weights / weights.sum()
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        gradient = risk(w, p, u, prior, share)[1]
        gradient[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, share: np.ndarray) -> tuple[float, np.ndarray]:
    """The non-negative risk, and the gradient to follow. p, u: rows of positives and unlabelled; share: of each positive."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    gp, gu = p @ w, u @ w
    negative = loss(-gu).mean() - prior * share @ loss(-gp)
    down = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ (share * sigmoid(gp)))
    # Below zero the risk on negatives overfits: then only that part is moved back up.
    gradient = -prior * (p.T @ (share * sigmoid(-gp))) + down if negative >= 0 else -down
    return prior * share @ loss(gp) + max(0.0, negative), gradient


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The share of positives in the unlabelled rows. Every other row fits a classifier of positives against unlabelled
    ones; the others' scores give the least ratio of shares above a threshold that at least a fifth of the positives pass."""
    weights = np.ones(len(positive)) if weights is None else weights
    a, b = (slice(0, None, 2), slice(1, None, 2)) if len(positive) > 1 and len(unlabelled) > 1 else (slice(None), slice(None))
    w = _separate(positive[a], unlabelled[a], weights[a])
    p, u = (np.hstack([x[b], np.ones((len(x[b]), 1))]) @ w for x in (positive, unlabelled))
    order = np.argsort(p)
    cuts, above = p[order], np.cumsum(weights[b][order][::-1])[::-1] / weights[b].sum()
    share = 1 - np.searchsorted(np.sort(u), cuts, "left") / len(u)
    # The least of many ratios is low by chance: a deviation of both shares is allowed for.
    off = lambda x, n: (1 - x + 1 / n) / (np.maximum(x, 1 / n) * n)
    ratio = share / above * (1 + np.sqrt(off(share, len(u)) + off(above, len(p))))
    return float(np.clip(ratio[above >= 0.2].min(), 0.01, 0.99))


def _separate(p: np.ndarray, u: np.ndarray, weights: np.ndarray, steps: int = 300, rate: float = 0.05) -> np.ndarray:
    """A logistic classifier of positives (1) against unlabelled rows (0), both sides counting alike."""
    x = np.vstack([np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])])
    y, share = np.repeat([1.0, 0.0], [len(p), len(u)]), np.concatenate([weights / weights.sum(), np.full(len(u), 1 / len(u))]) / 2
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        gradient = x.T @ (share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """docs: (doc_id, text). labels: (doc_id, quality)."""
    (good, weights), (unlabelled, _) = _sample(docs, labels, sample)
    if not len(good) or not len(unlabelled):
        return {"mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES + 1), "prior": 0.5}
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    good, unlabelled = (good - mean) / scale, (unlabelled - mean) / scale
    prior = class_prior(good, unlabelled, weights)
    return {"mean": mean, "scale": scale, "w": fit_pu(good, unlabelled, prior, weights=weights), "prior": prior}


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """Adds the probability of good as the last column, which ``name`` names; the text is read once."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches):
        m = shipped.value
        for batch in batches:
            for part in parts(batch, at):
                x = np.array([features(t.as_py()) for t in part.column(at)]).reshape(-1, N_FEATURES)
                z = ((x - m["mean"]) / m["scale"]) @ m["w"][:-1] + m["w"][-1]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*part.schema.names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(tidy(scan), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(docs, labels.select("doc_id", "quality"), sample)
    # Spark drops the text from what leaves the task.
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_pu(spark, sf_dir):
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
