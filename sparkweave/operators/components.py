"""Connected components of any edge table, by alternating stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.functions.skew import joined


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the least node it reaches.

    ``edges`` has the columns u and v of any type that can be ordered. Every round hangs neighbours on
    the least one they know; rounds grow with the logarithm of the longest path. Rows stay within twice
    the edges, no node's neighbours are gathered into one row or, if they are many, one task, and each round
    is written to the shared folder.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    mark, count = None, now.count()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "stars-least")
        large = stored(joined(both, least, "u", "n", 2 * count).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "stars-least")
        small = joined(large, least, "u", "n", 2 * count).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "stars")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(v, u))")).first()
        if tuple(seen) == mark:
            break
        mark, count = tuple(seen), seen[0]
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
