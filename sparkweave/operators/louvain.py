"""Louvain's method (Blondel and others 2008): local moves, contraction, and again.

In a bulk pass a hash makes every community a giver or a receiver, and nodes move from givers to receivers. Two that
move add up to what each gains alone but for the product of their degrees, and that only if they leave or join the same
community; so as many join as gain more than the degrees of those before them can cost, and modularity cannot fall.
Where a hub has a million neighbors, half of them can join it at once. With ``driver_edges`` graphs of few edges move
node by node on the driver instead.
"""

from __future__ import annotations

import random
from collections import defaultdict
from dataclasses import dataclass
from math import isfinite

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.graph import Graph, GraphError
from sparkweave.operators import metrics, partition, transform
from sparkweave.operators.result import Result

BETTER = 1e-15


@dataclass(frozen=True)
class Config:
    resolution: float = 1.0
    max_levels: int = 100
    max_passes_per_level: int = 100
    min_modularity_gain: float = 1e-12
    shuffle_nodes: bool = True
    seed: int = 42
    driver_edges: int = 0  # levels with at most so many edges move on the driver


def proposed(adjacency: DataFrame, degrees: DataFrame, labels: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """(node, label, target, gain) of every node whose best neighboring community beats staying."""
    held = labels.join(degrees, "node")
    volumes = held.groupBy("label").agg(F.sum("degree").alias("volume"))
    around = adjacency.where("src <> dst").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("target")), "dst")
    links = around.groupBy(F.col("src").alias("node"), "target").agg(F.sum("weight").alias("link"))
    scored = links.join(held, "node").join(volumes.select(F.col("label").alias("target"), "volume"), "target")
    inside = F.col("target") == F.col("label")
    others = F.col("volume") - F.when(inside, F.col("degree")).otherwise(0.0)  # the community without the node
    scored = scored.withColumn("score", F.col("link") - F.lit(resolution / two_m) * F.col("degree") * others)
    stay = held.join(volumes, "label").select("node", "degree", (F.lit(-resolution / two_m) * F.col("degree") * (F.col("volume") - F.col("degree"))).alias("alone"))
    best = scored.groupBy("node", "label").agg(
        F.max_by(F.struct("target", "score"), F.struct(F.when(~inside, F.col("score")), -F.col("target"))).alias("best"), F.max(F.when(inside, F.col("score"))).alias("own")
    )
    moves = best.join(stay, "node").withColumn("gain", F.col("best.score") - F.coalesce("own", "alone"))
    return moves.where((F.col("gain") > BETTER) & (F.col("best.target") != F.col("label"))).select("node", "label", F.col("best.target").alias("target"), "gain", "degree")


def compatible(moves: DataFrame, salt: int) -> DataFrame:
    """Of these moves those that are best, by gain and then a hash, in both communities that they touch."""
    rank = F.struct("gain", F.xxhash64("node", F.lit(salt)), "node")
    touched = moves.select("node", "target", "gain", F.explode(F.array("label", "target")).alias("community"))
    winners = touched.groupBy("community").agg(F.max_by("node", rank).alias("node"))
    return winners.groupBy("node").count().where("count = 2").join(moves, "node").select("node", "target", "gain")


def together(moves: DataFrame, salt: int, two_m: float, resolution: float) -> DataFrame:
    """Moves that can be made at once: (node, target, gain), the gain after what the others can cost."""
    side = lambda c: F.pmod(F.xxhash64(F.lit(salt), F.col(c)), F.lit(2)) == 0
    allowed = moves.where(side("label") & ~side("target"))
    order = [F.desc("gain"), F.xxhash64("node", F.lit(salt)), F.col("node")]
    before = lambda c: F.coalesce(F.sum("degree").over(Window.partitionBy(c).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cost = F.lit(resolution / two_m) * F.col("degree") * (before("label") + before("target"))
    return allowed.withColumn("gain", F.col("gain") - cost).where(F.col("gain") > BETTER).select("node", "target", "gain")


def _moved(graph: Graph, config: Config, level: int) -> tuple[DataFrame, int, bool]:
    """Bulk moves from singletons: labels, passes, whether anything moved."""
    adjacency = stored(graph.adjacency().repartition("src"), "louvain-adjacency")
    degrees = stored(graph.degrees(), "louvain-degrees")
    two_m = 2 * graph.total_weight()
    labels = stored(graph.vertices.select("node", F.col("node").alias("label")), "louvain-labels")
    passes, any_moved = 0, False
    while two_m > 0 and passes < config.max_passes_per_level:
        passes += 1
        moves = stored(proposed(adjacency, degrees, labels, two_m, config.resolution), "louvain-moves")
        salt = config.seed * 1_000_003 + level * 1009 + passes
        taken = stored(together(moves, salt, two_m, config.resolution), "louvain-taken")
        gain = taken.agg(F.coalesce(F.sum("gain"), F.lit(0.0))).first()[0]
        if gain <= 0:  # the hash parted no move's communities, or there is none
            taken = stored(compatible(moves, salt), "louvain-taken")
            gain = taken.agg(F.coalesce(F.sum("gain"), F.lit(0.0))).first()[0]
        if gain <= 0:
            break
        any_moved = True
        labels = stored(labels.join(taken.select("node", "target"), "node", "left").select("node", F.coalesce("target", "label").alias("label")), "louvain-labels")
        if 2 * gain / two_m <= config.min_modularity_gain:
            break
    return labels, passes, any_moved


def move_on_driver(nodes: list[int], edges: list[tuple[int, int, float]], resolution: float, seed: int, shuffle: bool, max_passes: int, min_gain: float) -> tuple[dict[int, int], int, bool]:
    """The same, one node at a time."""
    links: dict[int, dict[int, float]] = {n: {} for n in nodes}
    degree = dict.fromkeys(nodes, 0.0)
    for u, v, w in edges:
        degree[u] += w
        degree[v] += w
        if u != v:
            links[u][v] = links[u].get(v, 0.0) + w
            links[v][u] = links[v].get(u, 0.0) + w
    two_m = sum(degree.values())
    label, volume = {n: n for n in nodes}, dict(degree)
    rng, passes, any_moved = random.Random(seed), 0, False
    while two_m > 0 and passes < max_passes:
        passes += 1
        order, total = sorted(nodes), 0.0
        if shuffle:
            rng.shuffle(order)
        for n in order:
            around: dict[int, float] = defaultdict(float)
            for other, w in links[n].items():
                around[label[other]] += w
            own = label[n]
            volume[own] -= degree[n]
            score = lambda c: around.get(c, 0.0) - resolution * degree[n] * volume[c] / two_m  # noqa: B023, E731
            stay = score(own)
            to, best = own, stay
            for c in sorted(around):
                if score(c) > best + BETTER:
                    to, best = c, score(c)
            volume[to] += degree[n]
            if to != own:
                label[n] = to
                any_moved = True
                total += 2 * (best - stay) / two_m
        if total <= min_gain:
            break
    return label, passes, any_moved


def run(graph: Graph, config: Config | None = None) -> Result:
    """Partition of highest modularity found; the hierarchy has a level for every change.

    Nodes move only to communities of their neighbors, ties go to the lower one. Graphs without weight
    keep every node alone.
    """
    c = config or Config()
    if not (isfinite(c.resolution) and c.resolution > 0):
        raise GraphError("the resolution must be finite and positive")
    if c.max_levels < 1 or c.max_passes_per_level < 1:
        raise GraphError("limits of levels and passes must be positive")
    if not (isfinite(c.min_modularity_gain) and c.min_modularity_gain >= 0):
        raise GraphError("the least gain must be finite and not negative")
    spark = graph.spark
    whole = stored(graph.vertices.select("node", F.col("node").alias("at")), "louvain-whole")
    level_graph, levels, passes, hierarchy = graph, 0, 0, None
    quality = None
    while levels < c.max_levels:
        m = level_graph.num_edges()
        if m <= c.driver_edges:
            nodes = [r.node for r in level_graph.vertices.collect()]
            edges = [(r.u, r.v, r.weight) for r in level_graph.edges.orderBy("u", "v").collect()]
            label, n, moved = move_on_driver(nodes, edges, c.resolution, c.seed + levels, c.shuffle_nodes, c.max_passes_per_level, c.min_modularity_gain)
            labels = spark.createDataFrame(list(label.items()), "node long, label long")
        else:
            labels, n, moved = _moved(level_graph, c, levels)
        passes += n
        if not moved:
            break
        labels = stored(partition.normalize(labels).select("node", F.col("label").cast("long").alias("label")), "louvain-level")
        whole = stored(whole.join(labels.select(F.col("node").alias("at"), "label"), "at").select("node", F.col("label").alias("at")), "louvain-whole")
        step = partition.normalize(whole.select("node", F.col("at").alias("label"))).select(F.lit(levels).alias("level"), "node", "label")
        hierarchy = stored(step if hierarchy is None else hierarchy.unionByName(step), "louvain-hierarchy")
        level_graph = transform.contract(level_graph, labels)
        level_graph = Graph(stored(level_graph.vertices, "louvain-vertices"), stored(level_graph.edges, "louvain-edges"), True)
        levels += 1
        now = metrics.modularity(graph, whole.select("node", F.col("at").alias("label")), c.resolution)
        if quality is not None and now - quality <= c.min_modularity_gain:
            quality = now
            break
        quality = now
    found = stored(partition.normalize(whole.select("node", F.col("at").alias("label"))), "louvain-result")
    if quality is None:
        quality = metrics.modularity(graph, found, c.resolution)
    return Result("louvain", found, hierarchy, objective=quality, diagnostics={"levels": float(levels), "local_passes": float(passes), "resolution": c.resolution})
