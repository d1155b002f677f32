"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier on hashed
character n-grams says which side a text is on; decoding adds up the loss of each bit,
weighted by how sure that bit was in training, and takes the nearest codeword. A text
whose two nearest codewords are about as near is flagged as ambiguous.

Cases: a null text, or one without a letter, is ``und`` with score 0; without labelled
rows everything is ``und``; with one language every text with letters is of it; a null
lang teaches nothing, nor do languages beyond the ``most`` frequent ones (ties by code
point), so that a column of dirty names can't make the model grow without end; repeated
rows count as often as they occur; an empty table gives an empty result; a text of any
length is read whole. Only id, text and, to learn, lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import fold, parts, tidy

#: Training rows, about, however many there are (shared evenly by the languages, EACH at least), hashed n-grams, and
#: languages that a model has at most.
SAMPLE, EACH, DIMENSIONS, LANGUAGES = 4_000, 16, 2_048, 1_000
UNKNOWN = "und"


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams of the lower-cased text's bytes, as a unit vector."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F)
    mixed = lambda h: (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21)
    counts = sum(np.bincount(mixed(h), minlength=DIMENSIONS) for h in (b * np.uint32(0x165667B1), two, three))
    found = np.sqrt(counts.astype(np.float32))
    return found / max(1e-9, float(np.linalg.norm(found)))


def codewords(n: int, seed: int = 6) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 7 languages, else the best of seeded random codes by smallest distance."""
    if n <= 7:
        bits = np.arange(1, 2 ** max(0, n - 1))
        return np.array([[1 if i == 0 else (-1 if b >> (i - 1) & 1 else 1) for b in bits] for i in range(n)], float).reshape(n, -1)
    random, width = np.random.Generator(np.random.PCG64(seed)), 15 * int(np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(64):
        code = random.choice([-1.0, 1.0], (n, width))
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        usable = np.abs(code.sum(0)).max() < n
        if usable and apart.min() > most:
            best, most = code, apart.min()
    return best if best is not None else code


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 120, rate: float = 1.0, most: int = LANGUAGES) -> dict:
    """docs: (doc_id, text, lang). Learns from rows that are not held out."""
    rows = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    langs = sorted(counts)
    code = codewords(len(langs)) if langs else np.zeros((0, 0))
    model = {"langs": langs, "code": code, "w": np.zeros((DIMENSIONS + 1, code.shape[1])), "sure": np.ones(code.shape[1])}
    if len(langs) < 2:
        return model
    each = max(EACH, sample // len(langs))
    # A row a language of the model.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id(), F.lit(6)), F.lit(1 << 30))
    drawn = rows.select("text", "lang", draw.alias("draw")).join(F.broadcast(shares), "lang").where(F.col("draw") < F.col("share") * (1 << 30)).select("text", "lang")

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py()).tobytes() for t in batch.column(0)], pa.binary()), batch.column(1)], names=["x", "lang"])

    found = drawn.mapInArrow(tidy(scan), "x binary, lang string").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, DIMENSIONS)
    # Rows arrive in any order; sums of floats should not differ for it.
    at = {k: i for i, k in enumerate(langs)}
    y = np.array([at[k] for k in found.column("lang").to_pylist()], int)
    if not len(x):
        return model
    order = np.lexsort((*x[:, :8].T, y))
    x, y = x[order], y[order]
    weight = (1 / np.bincount(y, minlength=len(langs))[y]).astype(np.float32)  # languages count alike
    weight = (weight / weight.sum())[:, None]
    x = np.hstack([10 * x, np.ones((len(x), 1), np.float32)])
    side = code[y].astype(np.float32)
    w, m, v = np.zeros((x.shape[1], code.shape[1]), np.float32), 0.0, 0.0
    for step in range(1, steps + 1):
        wrong = 1 / (1 + np.exp(np.clip(side * (x @ w), -30, 30)))
        g = -(x.T @ (wrong * side * weight)) + np.float32(1e-5) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - np.float32(rate * 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + np.float32(1e-8))
    right = (weight * ((x @ w) * side > 0)).sum(0).clip(0.51, 0.999)
    sure = np.log(right / (1 - right))
    return model | {"w": w.astype(np.float64), "sure": sure / sure.mean()}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share among all by exp(-loss), and the lead over the second nearest."""
    f = np.hstack([10 * x, np.ones((len(x), 1))]) @ model["w"]
    # Loss of bit j for language c is log(1 + exp(-code f)): f itself apart, it is linear in the code.
    losses = np.stack([(np.logaddexp(0, -c * f) * model["sure"]).sum(1) for c in model["code"]], 1)
    z = -(losses - losses.min(1, keepdims=True))
    share = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    best = share.argmax(1)
    ranked = np.sort(share, 1)
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if share.shape[1] > 1 else 0.0)


def label(docs: DataFrame, model: dict, ambiguous_below: float = 0.05, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Adds lang_pred, score and ambiguous as the last columns, under the given names."""
    from pyspark.sql import types as T

    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def scan(batches):
        import regex

        letter, m = regex.compile(r"\p{L}").search, shipped.value
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts = [t.as_py() for t in batch.column(at)]
            pred, score, flag = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            own = [i for i, t in enumerate(texts) if t and letter(t)] if m["langs"] else []
            for start in range(0, len(own), 500):
                part = own[start : start + 500]
                best, share, lead = decode(m, np.array([features(texts[i]) for i in part]))
                for i, b in zip(part, best):
                    pred[i] = m["langs"][b]
                score[part], flag[part] = share, lead < ambiguous_below
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(flag)], names=[*batch.schema.names, *names])

    more = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return docs.mapInArrow(tidy(scan), T.StructType([*docs.schema.fields, *more]))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = label(rows.select("doc_id", "text"), train(rows, sample))
    return found.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_language_ecoc(spark, sf_dir):
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
