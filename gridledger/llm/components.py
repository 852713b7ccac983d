"""Connected components of an edge table, by alternating large and small stars.

Every round is one written table, so lineage stays short and a lost executor costs one stage. The
number of rounds grows with the logarithm of the longest path; a node with many neighbours is a
skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the label is the smallest node it reaches.

    Loops and repeated edges are allowed; rows with a null are left out; no edges, no rows.
    """
    pairs = (edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    before = None
    loops = pairs.filter("u = v")
    state = pairs.filter("u <> v")
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        state = checkpointed(small.union(least).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")))
        if seen.get == before:
            break
        before = seen.get
    members = state.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return members.union(roots).union(loops.select(F.col("u").alias("node"), F.col("u").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
