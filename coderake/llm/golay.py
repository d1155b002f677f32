"""SimHash near copies by fuzzy hashing with the perfect Golay code.

A fingerprint has 64 bits, each the majority of that bit over the hashes of a text's word shingles. Two fingerprints
link when at most four bits differ. Finding the links:

1. Keys. A fingerprint is cut into segments of 22, 21 and 21 bits. The [23,12] Golay code is perfect: each word of 23
   bits lies within three bits of exactly one codeword. The codewords of a segment and of all words one bit away from it
   are its near codewords, six at most; two segments that differ in two bits or fewer have a word between them that is
   within one bit of both, so they share a near codeword. Of four errors in three segments, either one segment has none,
   and then another has at most two: keys join a whole segment and a near codeword of another. Or each has some; then
   two have one each, which leaves one half of each as it was, and the third has at most two: keys join halves of two
   segments and a near codeword of the third. A fingerprint has some ninety keys of 33 bits or more, few of which
   unlike fingerprints share, and fingerprints that link share one.
2. Join. Keys that one fingerprint has alone are dropped. Buckets of at most BUCKET fingerprints are searched in tasks,
   many small ones together: what is found is verified by counting bits, and a bucket gives a spanning forest, never
   its pairs.
3. The rest. Fingerprints of larger buckets are linked without comparing any two: all words within two bits of a
   fingerprint (2,081) are its midpoints; those that share a midpoint are within four bits of each other, and those
   within four bits share one. Each is linked with the smallest that shares a midpoint: a grouping with partial sums.

Both ways are exact. The smallest document of a component of links names it.

Cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; with fewer words
than a shingle has the whole sequence is the one shingle; equal fingerprints are one from the start, however many
documents have it; repeated rows are linked; a row with a null id takes part and gets the smallest id of its component,
null if there is none; very long texts are read in blocks; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import parts, saved, tidy, tidy_groups
from coderake.llm.components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
SEED, WORDS, ERRORS = 42, 4, 4
#: Words of a text that are hashed at once.
BLOCK_WORDS = 1 << 15
#: (lowest bit, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of a bucket that are compared in a task, and rows of buckets that are handed over together, about.
BUCKET, BIN_ROWS = 1 << 14, 1 << 17


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a text in UTF-8."""
    found = text.translate(_LOWER).split()
    if not found:
        return 0
    k, digest, counts, n = min(words, len(found)), xxhash.xxh64_digest, np.zeros((8, 8), np.int64), len(found) - min(words, len(found)) + 1
    for at in range(0, n, BLOCK_WORDS):
        own = found[at : at + BLOCK_WORDS + k - 1]
        line = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist())]), np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(hashes[:, i], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > n).tobytes())


class Golay:
    """The perfect [23,12,7] code, systematic, by the remainders of its generator polynomial."""

    GENERATOR = 0b110001110101

    def __init__(self) -> None:
        high = np.zeros(1 << 12, np.int64)
        for v in range(1 << 12):
            rest = v << 11
            for bit in range(22, 10, -1):
                if rest >> bit & 1:
                    rest ^= self.GENERATOR << (bit - 11)
            high[v] = rest
        self.high = high
        self.error = np.zeros(1 << 11, np.int64)  # the one pattern of three bits or fewer that has a remainder
        for weight in range(1, 4):
            for places in combinations(range(23), weight):
                pattern = sum(1 << p for p in places)
                self.error[self.remainder(pattern)] = pattern

    def remainder(self, v):
        return self.high[v >> 11] ^ (v & 0x7FF)

    def index(self, v: np.ndarray) -> np.ndarray:
        """The number (12 bits) of each word's codeword."""
        return (v ^ self.error[self.remainder(v)]) >> 11

    def near(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each remainder: how the numbers of near codewords differ from the word's own (which comes first, as 0), for
        words with this many bits in use; and how many there are."""
        found = np.zeros((1 << 11, 6), np.int64)
        counts = np.ones(1 << 11, np.int64)
        for rest in range(1 << 11):
            own = {int((1 << i) ^ self.error[rest ^ int(self.remainder(1 << i))] ^ self.error[rest]) >> 11 for i in range(width)} - {0}
            counts[rest] = 1 + len(own)
            found[rest, 1 : 1 + len(own)] = sorted(own)
        return found, counts


class Keys:
    """The keys of fingerprints."""

    def __init__(self) -> None:
        self.code = Golay()
        self.tables = {width: self.code.near(width) for width in {w for _, w in SEGMENTS}}

    def __call__(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places of their fingerprints)."""
        at, whole, near, valid = np.arange(len(prints)), [], [], []
        for low, width in SEGMENTS:
            v = (prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
            table, counts = self.tables[width]
            rest = self.code.remainder(v)
            whole.append(v)
            near.append(self.code.index(v)[:, None] ^ table[rest])
            valid.append(np.arange(6) < counts[rest][:, None])
        keys, places = [], []

        def add(kind: int, left: np.ndarray, right: np.ndarray, on: np.ndarray) -> None:
            rows, _ = np.nonzero(on)
            keys.append((kind << 58) | (np.broadcast_to(left, on.shape)[on] << 12) | np.broadcast_to(right, on.shape)[on])
            places.append(at[rows])

        for kind, (i, j) in enumerate(permutations(range(3), 2)):
            add(kind, whole[i][:, None], near[j], valid[j])
        halves = [(v >> 11, (v & 0x7FF) | 1 << 11) for v in whole]  # told apart by a bit
        for kind, (i, j, k) in enumerate(((1, 2, 0), (0, 2, 1), (0, 1, 2)), 6):
            for one in halves[i]:
                for other in halves[j]:
                    add(kind, ((one << 12) | other)[:, None], near[k], valid[k])
        return np.concatenate(keys), np.concatenate(places)


def forest(prints: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links among fingerprints: what is linked already is not compared again."""
    rest, queue, out = np.arange(len(prints)), [], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        one = queue.pop()
        close = np.bitwise_count(prints[rest] ^ prints[one]) <= errors
        found = rest[close].tolist()
        out += [(one, x) for x in found]
        queue += found
        rest = rest[~close]
    return out


#: Buckets of up to so many are compared all at once, place by place.
SMALL = 8


def bucket_links(keys: np.ndarray, prints: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Links (pairs of fingerprints) inside buckets of equal keys."""
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= SMALL, sizes)
    k, p = keys[small], prints[small]
    found = []
    for step in range(1, SMALL):
        hit = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(p[step:] ^ p[:-step]) <= errors))
        found.append(np.stack([p[hit], p[hit + step]], 1))
    for a, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
        own = prints[a : a + n]
        tree = np.array(forest(own, errors), np.int64).reshape(-1, 2)
        found.append(own[tree])
    return np.unique(np.concatenate(found), axis=0)


def midpoint_links(prints: DataFrame) -> DataFrame:
    """(a, b): each fingerprint (column fp) with the smallest one of those that share a midpoint with it."""
    masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    rows = prints.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("midpoint"))
    least = rows.groupBy("midpoint").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    return rows.join(least, "midpoint").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp is the fingerprint's bits as a signed number."""
    def scan(batches):
        for batch in batches:
            for part in parts(batch, 1):
                found = np.array([fingerprint(t.as_py() or b"", words) for t in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(scan), f"doc_id {kind}, fp long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all fingerprints (column fp, distinct) within ERRORS bits of each other."""
    def scan(batches):
        keys = Keys()
        for batch in batches:
            own = batch.column(0).to_numpy()
            found, places = keys(own.view(np.uint64))
            for at in range(0, len(found), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + (1 << 18)]), pa.array(own[places[at : at + (1 << 18)]])], names=["key", "fp"])

    rows = saved(prints.select("fp").mapInArrow(tidy(scan), "key long, fp long"), "fuzzy-keys")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = saved(rows.join(sizes, "key"), "shared-keys")
    cold = shared.where(F.col("size") <= bucket)
    bins = max(1, -(-cold.count() // BIN_ROWS))

    def compared(table: pa.Table) -> pa.Table:
        found = bucket_links(table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64)).view(np.int64)
        return pa.table({"a": pa.array(found[:, 0].copy()), "b": pa.array(found[:, 1].copy())})

    found = cold.groupBy(F.pmod(F.xxhash64("key"), F.lit(bins)).alias("bin")).applyInArrow(tidy_groups(compared), "a long, b long")
    hot = saved(shared.where(F.col("size") > bucket).select("fp").distinct(), "hot-fingerprints")
    return found.unionByName(midpoint_links(hot)) if hot.limit(1).count() else found


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs. The id may be of any type that has an order."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(fingerprints(own, words), "fingerprints")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(distinct, bucket)).select(F.col("id").alias("fp"), "root")
    rooted = saved(distinct.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_golay(spark, sf_dir):
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
