"""Label propagation (Raghavan, Albert and Kumara 2007) in supersteps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.graph import Graph, GraphError
from sparkweave.operators import partition
from sparkweave.operators.result import Result

TOLERANCE = 1e-12


@dataclass(frozen=True)
class Config:
    max_iterations: int = 100
    asynchronous: bool = True
    shuffle_nodes: bool = True
    random_ties: bool = True
    seed: int = 42
    split_disconnected_labels: bool = True
    colours: int = 4  # classes of nodes that move together when asynchronous (Cordasco and Gargano 2010)


def modal_labels(adjacency: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label, weight, most): the weight of each label around a node, loops left out, and the most of any."""
    around = adjacency.where("src <> dst").join(labels.select(F.col("node").alias("dst"), "label"), "dst")
    weights = around.groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("weight"))
    most = weights.groupBy("node").agg(F.max("weight").alias("most"))
    return weights.join(most, "node")


def _chosen(weights: DataFrame, key: Column) -> DataFrame:
    """The mode with the least key."""
    modes = weights.where(F.col("weight") >= F.col("most") - TOLERANCE)
    return modes.groupBy("node").agg(F.min_by("label", F.struct(key, F.col("label"))).alias("next"))


def run(graph: Graph, config: Config | None = None) -> Result:
    """Every node takes the heaviest label around it until all have such a label, or max_iterations.

    Synchronous sweeps with the smallest label on ties have one possible outcome. Asynchronous ones move
    the nodes of one hash colour at a time, in an order that the seed and the sweep give; ties go by a hash
    of seed, sweep, node and label. Nodes without neighbors keep their label. No result depends on how
    the data are partitioned.
    """
    c = config or Config()
    if c.max_iterations < 1:
        raise GraphError("label propagation needs at least one iteration")
    adjacency = stored(graph.adjacency().repartition("src"), "lpa-adjacency")
    labels = stored(graph.vertices.select("node", F.col("node").alias("label")), "lpa-labels")
    weights = stored(modal_labels(adjacency, labels), "lpa-weights")  # of each state once: for the choice and the test
    iterations, converged = 0, False
    while iterations < c.max_iterations and not converged:
        iterations += 1
        order = F.pmod(F.xxhash64(F.lit(c.seed), F.lit(iterations if c.shuffle_nodes else 0), F.col("node")), F.lit(c.colours))
        key = F.xxhash64(F.lit(c.seed), F.lit(iterations), F.col("node"), F.col("label")) if c.random_ties else F.lit(0)
        for colour in range(c.colours if c.asynchronous else 1):
            chosen = _chosen(weights, key)
            moves = F.col("next").isNotNull() & ((order == colour) if c.asynchronous else F.lit(True))
            labels = stored(labels.join(chosen, "node", "left").select("node", F.when(moves, F.col("next")).otherwise(F.col("label")).alias("label")), "lpa-labels")
            weights = stored(modal_labels(adjacency, labels), "lpa-weights")
        converged = is_stable(weights, labels)
    found = partition.split_disconnected(graph, labels) if c.split_disconnected_labels else partition.normalize(labels)
    return Result("label_propagation", stored(found, "lpa-result"), diagnostics={"iterations": float(iterations), "converged": float(converged)})


def is_stable(weights: DataFrame, labels: DataFrame) -> bool:
    """Whether every node has one of its heaviest labels, by the weights of ``modal_labels``; nodes without neighbors do."""
    most = weights.groupBy("node").agg(F.max("most").alias("most"))
    own = labels.join(weights.select("node", "label", "weight"), ["node", "label"], "left").join(most, "node", "left")
    return own.where(F.coalesce("weight", F.lit(0.0)) < F.coalesce("most", F.lit(0.0)) - TOLERANCE).isEmpty()
