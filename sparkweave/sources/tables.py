"""Graphs from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_co(spark: SparkSession, sf_dir: str, least: int = 2, isolated: bool = False) -> Graph:
    """Parts that at least so many orders have in common; the nodes are the parts of any such edge, or all.

    The edges are stored, so that what is asked of the graph doesn't pair the lines again.
    """
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).distinct()
    pairs = lines.select("l_orderkey", F.col("part").alias("u")).join(lines.select("l_orderkey", F.col("part").alias("v")), "l_orderkey").where("u < v")
    edges = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= least).select("u", "v", F.lit(1.0).alias("weight"))
    edges = stored(edges, "parts-co")
    nodes = lines.select(F.col("part").alias("node")) if isolated else edges.select(F.explode(F.array("u", "v")).alias("node"))
    return Graph(nodes.distinct(), edges, False)


def planted(spark: SparkSession, sf_dir: str, size: int = 10) -> Graph:
    """A ring of cliques of customers."""
    nodes = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    n = nodes.count()
    group = F.floor(F.col("node") / size)
    inside = nodes.select(F.col("node").alias("u"), F.explode(F.sequence(F.col("node") + 1, group * size + size)).alias("v")).where(F.col("v") < F.least(F.floor(F.col("u") / size) * size + size, F.lit(n)))
    bridge = nodes.where(F.col("node") % size == size - 1).select(F.col("node").alias("u"), F.pmod(F.col("node") + 1, F.lit(n)).alias("v"))
    return Graph.of(nodes, inside.unionByName(bridge), check=False)


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """All nations: those of a region are linked with each other, and each region's first one with that of the next region."""
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("region"))
    a, b = nodes.select(F.col("node").alias("u"), "region"), nodes.select(F.col("node").alias("v"), "region")
    firsts = nodes.groupBy("region").agg(F.min("node").alias("first"))
    bridge = firsts.select(F.col("first").alias("u"), (F.col("region") + 1).alias("region")).join(firsts.select(F.col("first").alias("v"), "region"), "region")
    return Graph.of(nodes, a.join(b, "region").where("u < v").select("u", "v").unionByName(bridge.select("u", "v")), check=False)


def by_modulus(graph: Graph, k: int) -> DataFrame:
    return graph.vertices.select("node", F.pmod("node", F.lit(k)).cast("int").alias("label"))
