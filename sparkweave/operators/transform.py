"""Graph to graph: sanitizing, samples, dropout, contraction; and the hash behind the dropout."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.graph import Graph, GraphError
from sparkweave.operators import partition

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    """An unsigned 64-bit number as the long with the same bits."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def splitmix64(x: int) -> int:
    """The finalizer of SplitMix64 (Steele, Lea and Flood 2014)."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def splitmix64_sql(x: str) -> str:
    x = f"({x} + {signed(0x9E3779B97F4A7C15)}L)"
    x = f"(({x} ^ shiftrightunsigned({x}, 30)) * {signed(0xBF58476D1CE4E5B9)}L)"
    x = f"(({x} ^ shiftrightunsigned({x}, 27)) * {signed(0x94D049BB133111EB)}L)"
    return f"({x} ^ shiftrightunsigned({x}, 31))"


@contextmanager
def wrapping(spark):
    """Arithmetic that wraps around, for the expressions analysed inside."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_uniform(edges: DataFrame, seed: int) -> DataFrame:
    """Add ``uniform``, a number from 0 to 1 that the ends and the seed determine."""
    with wrapping(edges.sparkSession):
        inner = edges.withColumn("_h", F.expr(splitmix64_sql("(shiftleft(u, 32) | v)")))
        mixed = inner.withColumn("_h", F.expr(splitmix64_sql(f"({signed(seed)}L ^ _h)")))
        return mixed.withColumn("uniform", F.expr("shiftrightunsigned(_h, 11) / double(9007199254740992)")).drop("_h")


def drop_edges(graph: Graph, rate: float, seed: int) -> tuple[Graph, int]:
    """Without the edges whose uniform number is below the rate, and how many those are; all nodes stay."""
    if not 0 <= rate < 1:
        raise GraphError("the dropout rate must be at least 0 and below 1")
    drawn = stored(with_uniform(graph.edges, seed), "dropout")  # the edges' table is computed once
    removed = drawn.where(F.col("uniform") < rate).count() if rate else 0
    return graph.with_edges(drawn.where(F.col("uniform") >= rate).drop("uniform")), removed


def sanitize(vertices: DataFrame, pairs: DataFrame) -> Graph:
    """The simple unweighted graph of these pairs: no loops, no zero weights, every edge once with weight 1."""
    rows = pairs.where("weight <> 0") if "weight" in pairs.columns else pairs
    distinct = rows.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return Graph(vertices.select("node"), distinct.withColumn("weight", F.lit(1.0)), False)


def induced(graph: Graph, nodes: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph on these nodes, with ids 0.. in their order, and (old, node)."""
    ids = partition.dense_ids(nodes.select("node").distinct().join(graph.vertices, "node", "left_semi"), ["node"]).withColumnsRenamed({"node": "old", "id": "node"})
    u = ids.select(F.col("old").alias("u"), F.col("node").alias("nu"))
    v = ids.select(F.col("old").alias("v"), F.col("node").alias("nv"))
    edges = graph.edges.join(u, "u").join(v, "v").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"), "weight")
    return Graph(ids.select("node"), edges, graph.declared_weighted), ids


def largest_component(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph of the largest component; of equal ones that with the least node."""
    labels = partition.connected_components(graph)
    best = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).orderBy(F.desc("n"), "least").limit(1)
    return induced(graph, labels.join(F.broadcast(best.select("label")), "label", "left_semi").select("node"))


def contract(graph: Graph, labels: DataFrame) -> Graph:
    """Communities as nodes: weight inside becomes a loop, weight between two an edge."""
    a = labels.select(F.col("node").alias("u"), F.col("label").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("label").alias("cv"))
    edges = graph.edges.join(a, "u").join(b, "v").select(F.least("cu", "cv").cast("long").alias("u"), F.greatest("cu", "cv").cast("long").alias("v"), "weight")
    vertices = labels.select(F.col("label").cast("long").alias("node")).distinct()
    return Graph(vertices, edges.groupBy("u", "v").agg(F.sum("weight").alias("weight")), True)


def normalize_reference(values: DataFrame) -> DataFrame:
    """(node, label) from (node, value): values in the order of their text become 0, 1, ..."""
    text = values.select("node", F.col("value").cast("string").alias("value"))
    ids = partition.dense_ids(text.select("value").distinct(), ["value"])
    return text.join(ids, "value").select("node", F.col("id").cast("int").alias("label"))


def graph_metadata(graph: Graph) -> DataFrame:
    """One row: n, m, components, isolated_nodes, min_degree, max_degree, mean_degree."""
    degrees = graph.degrees().agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("degree") == 0).cast("long")), F.lit(0)).alias("isolated_nodes"),
        F.min("degree").cast("long").alias("min_degree"), F.max("degree").cast("long").alias("max_degree"), F.avg("degree").alias("mean_degree"),
    )
    components = partition.connected_components(graph).agg(F.countDistinct("label").alias("components"))
    return degrees.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("m"))).crossJoin(components)


def snowball_exact(n: int, offsets: np.ndarray, neighbors: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A breadth-first walk from random roots, each node's neighbors shuffled; the sorted nodes of the sample."""
    if size >= n:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    roots = np.flatnonzero(np.diff(offsets) > 0)
    if not len(roots):
        return np.sort(rng.choice(n, size=size, replace=False))
    seen, taken, queue = np.zeros(n, bool), [], []
    while len(taken) < size:
        if not queue:
            left = roots[~seen[roots]]
            left = left if len(left) else np.flatnonzero(~seen)
            queue = [int(rng.choice(left))]
            seen[queue[0]] = True
        node = queue.pop(0)
        taken.append(node)
        around = neighbors[offsets[node] : offsets[node + 1]].copy()
        rng.shuffle(around)
        for other in around.tolist():
            if not seen[other]:
                seen[other] = True
                queue.append(other)
    return np.sort(np.array(taken[:size]))


def snowball(graph: Graph, size: int, seed: int) -> DataFrame:
    """(node) of a sample of that many nodes by breadth-first rings around hashed roots.

    The distributed form of the walk: whole rings join as long as they fit, of the last one the nodes with
    the least hash of (seed, node). It has the walk's shape, not its random numbers.
    """
    draw = F.xxhash64(F.lit(seed), F.col("node"))
    if graph.num_nodes() <= size:
        return graph.vertices
    adjacency = graph.adjacency().where("src <> dst").select("src", "dst")
    taken = graph.vertices.limit(0)
    count = 0
    while count < size:
        left = graph.vertices.join(taken, "node", "left_anti")
        linked = left.join(adjacency.select(F.col("src").alias("node")), "node", "left_semi")
        ring = (left if linked.isEmpty() else linked).orderBy(draw, "node").limit(1)
        while True:
            ring = stored(ring, "snowball-ring")
            n = ring.count()
            if not n:
                break
            if count + n > size:
                ring = ring.orderBy(draw, "node").limit(size - count)
                n = size - count
            taken, count = stored(taken.unionByName(ring), "snowball-taken"), count + n
            if count >= size:
                break
            ring = adjacency.join(ring, adjacency["src"] == ring["node"], "left_semi").select(F.col("dst").alias("node")).distinct().join(taken, "node", "left_anti")
    return taken


def numbered(values: DataFrame, text_col: str) -> DataFrame:
    """(node, text): dense ids with whole numbers first, by value, and then other texts."""
    number = F.expr(f"try_cast({text_col} AS BIGINT)")
    keyed = values.select(text_col, number.isNull().alias("_text"), F.coalesce(number, F.lit(0)).alias("_number")).distinct()
    return partition.dense_ids(keyed, ["_text", "_number", text_col]).select(F.col("id").alias("node"), text_col)
