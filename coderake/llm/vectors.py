"""What the two vector searches share: vectors as arrays inside tasks, blocks of queries, and merging of partial results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column, zero: bool) -> Column:
    """Not null or empty, with finite components only, of which one at least is not 0 unless zero is True."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & (F.lit(zero) | F.exists(vector, lambda x: x != 0))


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a list column as a matrix; lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def packed(x: np.ndarray) -> pa.Array:
    """An array as one binary value."""
    return pa.array([x.tobytes()], pa.binary())


def one_each(queries: DataFrame) -> DataFrame:
    """One query for each id: of rows that share it, that with the smallest vector. queries: (vec_id, vector)."""
    return queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def query_blocks(queries: DataFrame, rows_per_block: int, n: int) -> DataFrame:
    """(width, block, own, queries, known): queries (vec_id, vector, known) of one length gathered by hash into blocks of
    about rows_per_block, as arrays in order of the ids. n: how many queries there are."""
    blocks = max(1, -(-n // rows_per_block))

    def gathered(part: pa.Table) -> pa.Table:
        part = part.sort_by("vec_id")
        arrays = [part.column("vec_id").to_numpy().astype(np.int64), matrix(part.column("vector").combine_chunks()), part.column("known").to_numpy().astype(np.float64)]
        return pa.table([part.column("width")[:1], part.column("block")[:1], *map(packed, arrays)], names=["width", "block", "own", "queries", "known"])

    rows = queries.select("vec_id", "vector", "known", F.size("vector").alias("width"), F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)).cast("int").alias("block"))
    return rows.groupBy("width", "block").applyInArrow(gathered, "width int, block int, own binary, queries binary, known binary")


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, ties to the smaller vec_id."""
    order = F.desc("score") if descending else F.asc("score")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
