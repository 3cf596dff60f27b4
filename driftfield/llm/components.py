"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftfield.llm.common import drop, table


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of an edge, the smallest node it reaches.

    ``edges`` has two long columns, u and v. In a round each node points its
    larger neighbours at the smallest node it knows (large star), then its smaller
    ones (small star), until nothing changes: about log2 of the longest path in
    rounds, each a few joins of the edge table with its own minima. Edges are
    written each round, so the lineage stays short. Raises if ``most_rounds`` do
    not settle it.
    """

    def settled(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = settled(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        pairs = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        last, now = now, table(pairs.distinct(), "edges")
        drop(last)
        before, state = state, settled(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
