"""Approximate nearest neighbours: a hierarchical k-means tree, read best bin first.

The tree is fitted on a bounded sample; every row is then filed under a leaf. A query walks
the tree through a priority queue of nodes by distance to their centres, opening a node only
when it is the nearest left, and visits leaves in that order. How many is calibrated: for
sampled queries the true neighbours come from brute force over all rows, and the number of
leaves is widened until the recall of these reaches the target; beyond it a query goes on
until the leaves it visits hold k rows and those that may be its own.

Rows (query, leaf) are shuffled to the leaves they name: a leaf is dealt into chunks of rows
and its queries into parts, and a task compares one chunk with one part. The first leaves
give each query a k-th distance, and in its other leaves only rows that are not farther are
worth a result row. Distances are exact, in double precision.

Cases: vectors that are null, zero, or hold null or non-finite components take no part;
vectors have a distance to those of their own length only, so rows of each length are
searched apart, each with a tree of its own; ties go to the smaller id; an id that several
query rows share is one query, that with the smallest vector; rows that share an id are
candidates of their own, except for the query of that id; fewer candidates than k are all
returned (then every leaf is visited); an empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import hash_share, saved
from coderake.llm.vectors import best, matrix, one_each, usable

#: Sampled rows that the tree is fitted on, sampled queries for calibration, and their recall.
SAMPLE, CALIBRATION, RECALL = 32_768, 256, 0.96
#: Rows of a leaf's chunk, queries that meet it at once, and leaves visited before the wider visit.
CHUNK, QUERY_BLOCK, FIRST = 2048, 2048, 4


@dataclass
class KMeansTree:
    """Node i has children first[i] .. first[i] + n[i] - 1; n[i] is 0 for a leaf, whose number is leaf[i]."""

    centre: np.ndarray
    first: np.ndarray
    n: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, branches: int = 8, leaf_rows: int = 32, rounds: int = 8, seed: int = 2) -> KMeansTree:
        random = np.random.Generator(np.random.PCG64(seed))
        centre, first, n, todo, at = [x.mean(0)], [0], [0], [np.arange(len(x))], 0
        while at < len(todo):
            own = todo[at]
            if len(own) > leaf_rows:
                side, means = _kmeans(x[own], branches, rounds, random)
                if len(means) > 1:
                    first[at], n[at] = len(todo), len(means)
                    for i, mean in enumerate(means):
                        todo.append(own[side == i])
                        centre.append(mean)
                        first.append(0)
                        n.append(0)
            todo[at] = None
            at += 1
        n = np.array(n)
        return cls(np.array(centre), np.array(first), n, np.where(n == 0, np.cumsum(n == 0) - 1, -1))

    def file(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node."""
        at, out = [(0, np.arange(len(x)))], np.zeros(len(x), np.int32)
        while at:
            node, rows = at.pop()
            if not self.n[node]:
                out[rows] = self.leaf[node]
                continue
            children = np.arange(self.first[node], self.first[node] + self.n[node])
            nearest = _squares(x[rows], self.centre[children]).argmin(1)
            at += [(c, rows[nearest == i]) for i, c in enumerate(children) if (nearest == i).any()]
        return out

    def order(self, x: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The first ``most`` leaves of each row, best bin first; more, until these hold ``least`` rows, if held (rows of
        each leaf) is given."""
        return [self._walk(row, most, held, least) for row in x]

    def _walk(self, row: np.ndarray, most: int, held: np.ndarray | None, least: int) -> list[int]:
        queue, got, rows = [(0.0, 0)], [], 0
        while queue and (len(got) < most or rows < least):
            _, node = heapq.heappop(queue)
            while self.n[node]:
                first, n = self.first[node], self.n[node]
                far = ((self.centre[first : first + n] - row) ** 2).sum(1)
                near = int(far.argmin())
                for i, distance in enumerate(far.tolist()):
                    if i != near:
                        heapq.heappush(queue, (distance, int(first) + i))
                node = first + near
            got.append(int(self.leaf[node]))
            if held is not None:
                rows += held[got[-1]]
        return got


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T


def _kmeans(x: np.ndarray, k: int, rounds: int, random) -> tuple[np.ndarray, np.ndarray]:
    means = x[random.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        side = _squares(x, means).argmin(1)
        kept = [i for i in range(len(means)) if (side == i).any()]
        means = np.array([x[side == i].mean(0) for i in kept])
    side = _squares(x, means).argmin(1)
    kept = np.unique(side)
    return np.searchsorted(kept, side), means[kept]


def nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None):
    """(query index, id, distance) of each query's k nearest rows that are not its own, none farther than within."""
    rough = _squares(queries, rows)
    rough[own[:, None] == ids[None, :]] = np.inf
    room = 1e-9 * ((queries**2).sum(1) + (rows**2).sum(1).max() + 1)  # for the rounding of the shorter formula
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + room if rough.shape[1] > k else np.full(len(queries), np.inf)
    if within is not None:
        limit = np.minimum(limit, within**2 + room)
    if not np.isfinite(room).all():  # squares overflow: all rows are tried
        rough, limit = np.where(own[:, None] == ids[None, :], np.inf, 0.0), np.full(len(queries), 1.0)
    for i in np.flatnonzero((rough <= limit[:, None]).any(1)):
        near = np.flatnonzero((rough[i] <= limit[i]) & (rough[i] < np.inf))
        exact = np.sqrt(((rows[near] - queries[i]) ** 2).sum(1))
        for j in np.lexsort((ids[near], exact))[:k]:
            yield int(i), int(ids[near[j]]), float(exact[j])


FOUND = "query_id long, vec_id long, score double"


def _batch(found: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kinds[i]) for i in range(3)], names=["query_id", "vec_id", "score"])


def brute_force(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of a bounded block of queries against all rows."""
    shipped = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def scan(batches):
        own, vectors = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                there = part.column(0).to_numpy()
                yield _batch([(int(own[i]), v, s) for i, v, s in nearest(vectors, own, matrix(part.column(1)), there, k)])

    return best(rows.select("vec_id", "vector").mapInArrow(scan, FOUND), k, False)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found. rows and queries: (vec_id, vector)."""
    out = None
    # The lengths that vectors have: one in a sound table, and few in any.
    for row in rows.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect():
        own = F.size("vector") == row["width"]
        part = _neighbours(rows.where(own), queries.where(own), row["count"], k, sample, calibration, recall, query_block)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _neighbours(rows: DataFrame, queries: DataFrame, n: int, k: int, sample: int, calibration: int, recall: float, query_block: int) -> DataFrame:
    spark, place = rows.sparkSession, F.monotonically_increasing_id()
    # Rows are drawn by their place too, so that copies of a row are drawn one by one and the sample stays bounded.
    drawn = rows.where(hash_share(sample / n, F.col("vec_id"), F.col("vector"), place, seed=2)) if n > 64 else rows
    drawn = drawn.toArrow().sort_by("vec_id")
    tree = KMeansTree.fit(matrix((drawn if drawn.num_rows else rows.limit(1).toArrow()).column("vector").combine_chunks()))
    leaves, shipped = int((tree.n == 0).sum()), spark.sparkContext.broadcast(tree)

    def file(batches):
        for batch in batches:
            leaf = shipped.value.file(matrix(batch.column(1))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=["vec_id", "vector", "leaf"])

    filed = saved(rows.select("vec_id", "vector").mapInArrow(file, "vec_id long, vector array<double>, leaf int"), "filed")
    held = np.zeros(leaves, np.int64)
    for row in filed.groupBy("leaf").count().collect():  # a row a leaf, as many as the bounded sample gives
        held[row["leaf"]] = row["count"]
    visits = calibrated(filed, tree, leaves, k, min(1.0, calibration / n), recall)
    asked = one_each(queries)
    # Rows of the query's own id are no candidates: at most so many more have to be visited for k that are.
    times = filed.join(asked.select("vec_id"), "vec_id").groupBy("vec_id").agg(F.count("*").alias("copies"))
    asked = saved(asked.join(times, "vec_id", "left").fillna(0, ["copies"]), "queries")

    def walk(batches):
        for batch in batches:
            own = zip(matrix(batch.column(1)), batch.column(2).to_pylist()) if batch.num_rows else ()
            order = [shipped.value.order(x[None, :], visits, held, k + copies)[0] for x, copies in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order, pa.list_(pa.int32()))], names=["vec_id", "vector", "leaves"])

    walked = saved(asked.select("vec_id", "vector", "copies").mapInArrow(walk, "vec_id long, vector array<double>, leaves array<int>"), "walked")
    asks = walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("asks"))
    # As many rows as leaves, here and below.
    chunks = spark.createDataFrame([(i, int(-(-x // CHUNK))) for i, x in enumerate(held) if x], "leaf int, chunks int")
    parts = saved(asks.join(F.broadcast(chunks), "leaf").select("leaf", F.ceil(F.col("asks") / query_block).cast("int").alias("parts"), "chunks"), "leaves")
    dealt = filed.join(F.broadcast(parts), "leaf").select("leaf", "vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id()), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = saved(dealt, "dealt")

    def visit(walked: DataFrame) -> DataFrame:
        def compared(asking: pa.Table, there: pa.Table) -> pa.Table:
            if not asking.num_rows or not there.num_rows:
                return pa.Table.from_batches([_batch([])])
            asking = asking.sort_by("vec_id")
            own, vectors = asking.column("vec_id").to_numpy(), matrix(asking.column("vector").combine_chunks())
            found = nearest(vectors, own, matrix(there.column("vector").combine_chunks()), there.column("vec_id").to_numpy(), k, asking.column("known").to_numpy())
            return pa.Table.from_batches([_batch([(int(own[i]), v, s) for i, v, s in found])])

        asked = walked.select("vec_id", "vector", "known", F.explode("leaves").alias("leaf")).join(F.broadcast(parts), "leaf")
        asked = asked.select("vec_id", "vector", "known", "leaf", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        keys = ["leaf", "chunk", "part"]
        return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(compared, FOUND)

    inf = F.lit(float("inf"))
    first = saved(best(visit(walked.select("vec_id", "vector", F.slice("leaves", 1, FIRST).alias("leaves"), inf.alias("known"))), k, False), "first-nearest")
    known = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    wider = walked.where(F.size("leaves") > FIRST).select("vec_id", "vector", F.expr(f"slice(leaves, {FIRST + 1}, size(leaves) - {FIRST})").alias("leaves"))
    wider = saved(wider.join(known, "vec_id", "left").select("vec_id", "vector", "leaves", F.coalesce("known", inf).alias("known")), "wider")
    return best(first.drop("rank").unionByName(visit(wider)), k, False)


def calibrated(filed: DataFrame, tree: KMeansTree, leaves: int, k: int, share: float, recall: float) -> int:
    """Leaves to visit so that sampled queries find this share of their true k nearest."""
    asked = filed.where(hash_share(share, F.col("vec_id"), F.col("vector"), F.monotonically_increasing_id(), seed=22)).select("vec_id", "vector")
    ids = one_each(asked).toArrow().sort_by("vec_id")
    if not ids.num_rows:
        return leaves
    own, vectors = ids.column(0).to_numpy(), matrix(ids.column(1).combine_chunks())
    truth = brute_force(filed, own, vectors, k)
    # Copies of a vector are filed under one leaf, so a neighbour's id finds its leaf.
    where = filed.join(F.broadcast(truth.select("vec_id", "query_id").distinct()), "vec_id").select("query_id", "leaf", "vec_id").distinct().toArrow()
    place = np.zeros((len(own), leaves), np.int32)
    for i, order in enumerate(tree.order(vectors, leaves)):
        place[i, order] = np.arange(leaves)
    at = {int(q): i for i, q in enumerate(own)}
    found = np.array([place[at[q], leaf] for q, leaf in zip(where.column(0).to_pylist(), where.column(1).to_pylist())])
    visits = 1
    while visits < leaves and len(found) and (found < visits).mean() < recall:
        visits = min(leaves, visits + max(1, visits // 8))
    return visits


def op2_kmeans_tree_ann(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.where(usable(F.col("embedding"), zero=False))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return neighbours(rows, rows.where("vec_id % 100 = 0"))
