"""Connected components of an edge table by star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coderake.llm.common import saved


#: Rounds after which something must be wrong.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id with an edge can reach. edges: (a, b), in any order, repeats allowed.

    Large-star hangs the larger neighbours of a vertex on its smallest one, small-star the smaller ones; a few rounds
    leave one star for each component. Minima come from partial aggregates and are written before they meet the edges
    again, so a hub with very many edges is an ordinary skewed join. An empty table gives an empty result.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    # Each round brings the distance to the root down by a constant factor: some ten rounds do for any table.
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-star")
        edges = saved(edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small-star")
        hung = edges.join(least.where("n > 1"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(least.select("u", F.col("m").alias("v")).unionByName(hung).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
