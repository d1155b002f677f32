"""Exact top-k search by inner product: a ball tree for each shard, branch and bound with a shared k-th score.

Rows are dealt to shards by a seeded hash; each shard's tree is built once and written
as one row of arrays. Queries are gathered into blocks, rows of arrays too, and a join of
blocks and shards meets every query with every tree: one job, however many queries there
are, in which a task holds one block and one tree. There are two such passes: the first
opens, for each query and shard, only the leaf with the highest bound, and the k-th best
score found so far becomes shared knowledge; the second descends every tree from the root,
dropping a node as soon as its bound ``q . centre + |q| * radius`` falls below the query's
current k-th score, opens leaves in order of their bounds, and raises the k-th score as it
goes. Nothing is approximate: integer vectors give integer scores, and a node is dropped
only if its bound is below the k-th score by more than rounding could explain.

Cases: null vectors, and those with null or non-finite components, take no part, nor
do those with a component above 1.7e305, which 1024 times is no number; vectors have an
inner product with those of their own length only, so rows of each length are searched
apart; ties go to the smaller id; an id that several query rows share is one query, that
with the smallest vector; rows that share an id are candidates of their own, except for
the query of that id; fewer candidates than k are all returned; an empty table gives an
empty result. Where products could pass 2^53 they are summed as whole numbers of any size;
scores outside of 64 bits are cut to their limits. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import saved
from coderake.llm.vectors import best, matrix, one_each, packed, query_blocks, usable

#: Rows of a leaf, of a shard (at least and at most) and of a block of queries; what a float holds exactly.
LEAF, SHARD, QUERY_BLOCK, EXACT = 64, (2048, 65_536), 2048, 2.0**53


@dataclass
class BallTree:
    """Rows in tree order; node i covers rows low[i]:high[i] and has children left[i] and left[i] + 1 (0: a leaf)."""

    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> BallTree:
        order, spans, left = np.arange(len(ids)), [(0, len(ids))], [0]
        at = 0
        while at < len(spans):
            low, high = spans[at]
            if high - low > leaf:
                own = rows[order[low:high]].astype(np.float64)
                far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
                other = own[((own - far) ** 2).sum(1).argmax()]
                along = own @ (other - far)
                order[low:high] = order[low:high][np.argsort(along, kind="stable")]
                middle = (low + high) // 2
                left[at] = len(spans)
                spans += [(low, middle), (middle, high)]
                left += [0, 0]
            at += 1
        rows = rows[order]
        centre = np.array([rows[a:b].mean(0) for a, b in spans])
        radius = np.array([np.sqrt(((rows[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(spans, centre)])
        return cls(ids[order], rows, *np.array(spans).T, np.array(left), centre, radius)

    def bounds(self, queries: np.ndarray, norms: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, queries by nodes, with room for rounding."""
        found = queries @ self.centre[nodes].T + norms[:, None] * self.radius[nodes]
        found = found + 1e-9 * (np.abs(found) + norms[:, None] * (np.abs(self.radius[nodes]) + np.linalg.norm(self.centre[nodes], axis=1))) + 1e-6
        return np.where(np.isnan(found), np.inf, found)  # where squares overflow nothing is bounded


class Best:
    """The k best of each query so far; kth is the score that a row has to reach."""

    def __init__(self, n: int, k: int, kth: np.ndarray) -> None:
        self.k, self.kth, self.found = k, kth.astype(float).copy(), [[] for _ in range(n)]

    def add(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        """vectors: of the queries. own: ids of all queries, which are no candidates of their own."""
        scores = vectors @ rows.T
        # Float sums may be off by this much, if a sum of absolute products passes what floats hold exactly.
        size = np.linalg.norm(vectors, axis=1) * np.sqrt((rows**2).sum(1).max(initial=0.0))
        room = np.where(size < EXACT, 0.0, 1e-12 * size)
        same = own[queries][:, None] == ids[None, :]
        may = ~(scores < (self.kth[queries] - room)[:, None]) & ~same
        for at in np.flatnonzero(may.any(1)):
            q, row, keep = queries[at], scores[at], np.flatnonzero(may[at])
            if size[at] < EXACT:
                new = [(-int(row[i]), int(ids[i])) for i in keep]
            else:
                new = [(-sum(int(x) * int(y) for x, y in zip(vectors[at], rows[i])), int(ids[i])) for i in keep]
            held = sorted(self.found[q] + new)[: self.k]
            self.found[q] = held
            if len(held) == self.k:
                self.kth[q] = max(self.kth[q], float(-held[-1][0]) * (1 - np.copysign(1e-15, -held[-1][0]) * (size[at] >= EXACT)))

    def rows(self, own: np.ndarray):
        for q, held in enumerate(self.found):
            for score, vec_id in held:
                yield int(own[q]), vec_id, max(-(1 << 63), min((1 << 63) - 1, -score))


def probe(tree: BallTree, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Best:
    """Each query's most promising leaf only."""
    out, norms = Best(len(ids), k, kth), np.linalg.norm(queries, axis=1)
    leaves = np.flatnonzero(tree.left == 0)
    first = leaves[tree.bounds(queries, norms, leaves).argmax(1)]
    for node in np.unique(first):
        own, (a, b) = np.flatnonzero(first == node), (tree.low[node], tree.high[node])
        out.add(own, tree.ids[a:b], queries[own], tree.rows[a:b], ids)
    return out


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Best:
    """Branch and bound for all queries at once; a step opens the best unopened leaf of each query that has one left."""
    out, norms = Best(len(ids), k, kth), np.linalg.norm(queries, axis=1)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = [(0, np.arange(len(ids)))]
    while level:
        deeper = []
        for node, asked in level:
            bound = tree.bounds(queries[asked], norms[asked], np.array([node]))[:, 0]
            keep = bound >= out.kth[asked]
            asked, bound = asked[keep], bound[keep]
            if not len(asked):
                continue
            if tree.left[node]:
                deeper += [(tree.left[node], asked), (tree.left[node] + 1, asked)]
            else:
                pairs.append((asked, np.full(len(asked), node), bound))
        level = deeper
    if not pairs:
        return out
    asked, nodes, bound = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((-bound, asked))
    asked, nodes, bound = asked[order], nodes[order], bound[order]
    turn = np.arange(len(asked)) - np.maximum.accumulate(np.where(np.r_[True, asked[1:] != asked[:-1]], np.arange(len(asked)), 0))
    for step in range(turn.max() + 1):
        now = np.flatnonzero((turn == step) & (bound >= out.kth[asked]))
        if not len(now) and not (bound[turn > step] >= out.kth[asked[turn > step]]).any():
            break
        for node in np.unique(nodes[now]):
            own, (a, b) = asked[now[nodes[now] == node]], (tree.low[node], tree.high[node])
            out.add(own, tree.ids[a:b], queries[own], tree.rows[a:b], ids)
    return out


def trees(rows: DataFrame, shards: int, seed: int = 10) -> DataFrame:
    """(width, shard, tree arrays): one row for each shard and length of vectors. rows: (vec_id, vector)."""
    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        t = BallTree.build(part.column("vec_id").to_numpy(), matrix(part.column("vector").combine_chunks()))
        arrays = [t.ids.astype(np.int64), t.rows.astype(np.float64), t.low.astype(np.int64), t.high.astype(np.int64), t.left.astype(np.int64), t.centre, t.radius]
        return pa.table([part.column("width")[:1], part.column("shard")[:1], *map(packed, arrays)], names=["width", "shard", *TREE])

    # Rows of one id may be many, and rows that repeat id and vector too: their place in the table spreads them.
    shard = F.pmod(F.xxhash64("vec_id", "vector", F.monotonically_increasing_id(), F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    dealt = rows.select("vec_id", "vector", F.size("vector").alias("width"), shard)
    return dealt.groupBy("width", "shard").applyInArrow(build, "width int, shard int, " + ", ".join(f"{c} binary" for c in TREE))


TREE = ["ids", "rows", "low", "high", "children", "centre", "radius"]


def _opened(row: dict, width: int) -> BallTree:
    whole = lambda name: np.frombuffer(row[name], np.int64)
    real = lambda name: np.frombuffer(row[name], np.float64)
    return BallTree(whole("ids"), real("rows").reshape(-1, width), whole("low"), whole("high"), whole("children"), real("centre").reshape(-1, width), real("radius"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. rows and queries: (vec_id, vector) with integral components. shard_rows: rows of a
    shard, about; by default so many that there are four shards a core, within the bounds SHARD."""
    n = rows.count()
    shard_rows = shard_rows or min(max(SHARD[0], n // (4 * rows.sparkSession.sparkContext.defaultParallelism)), SHARD[1])
    shards = max(1, -(-n // shard_rows))
    index = saved(trees(rows, shards), "ball-trees")
    asked = saved(one_each(queries), "queries")
    n = asked.count()

    def pass_over(queries: DataFrame, how) -> DataFrame:
        def scan(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    own, vectors, known = np.frombuffer(row["own"], np.int64), np.frombuffer(row["queries"], np.float64).reshape(-1, row["width"]), np.frombuffer(row["known"], np.float64)
                    found = list(how(_opened(row, row["width"]), own, vectors, known, k).rows(own))
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        # Each block goes to each shard: a stated query set against all rows, in blocks.
        blocks = query_blocks(queries, query_block, n).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
        return blocks.join(index, ["width", "shard"]).mapInArrow(scan, "query_id long, vec_id long, score long")

    first = best(pass_over(asked.withColumn("known", F.lit(float("-inf"))), probe), k, True).where(F.col("rank") == k)
    kth = first.select(F.col("query_id").alias("vec_id"), F.when(F.abs("score") < EXACT, F.col("score").cast("double")).otherwise(float("-inf")).alias("known"))
    asked = saved(asked.join(kth, "vec_id", "left").fillna(float("-inf"), ["known"]), "queries-and-bounds")
    return best(pass_over(asked, search), k, True)


def _whole(x):
    """floor(1024 * x) as double; numbers of 2^53 and more are whole already."""
    y = 1024 * x.cast("double")
    return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)


def op10_ball_tree_topk(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = rows.select("vec_id", F.transform("embedding", _whole).alias("vector")).where(usable(F.col("vector"), zero=True))
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
