"""An undirected, optionally weighted graph as two DataFrames.

``vertices(node)`` names every node, isolated ones too; ``edges(u, v, weight)`` has every edge once,
with u <= v. A loop is one edge and adds twice its weight to a degree, so degrees sum to 2m.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Node ids must stay below this, the room of the binary format.
MOST_NODES = 2**32 - 1
EDGES = "u long, v long, weight double"


class GraphError(ValueError):
    """Input that isn't a graph of this kind, or an operation that needs another one."""


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    declared_weighted: bool | None = field(default=None)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    # construction

    @staticmethod
    def empty(spark: SparkSession, n: int = 0) -> Graph:
        if not 0 <= n < MOST_NODES:
            raise GraphError(f"{n} nodes are too many")
        return Graph(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame([], EDGES))

    @staticmethod
    def of(vertices: DataFrame, pairs: DataFrame, check: bool = True) -> Graph:
        """From (u, v[, weight]) in any order and direction; repeated edges add up. GraphError for ends that aren't nodes and wrong weights."""
        weight = F.col("weight").cast("double") if "weight" in pairs.columns else F.lit(1.0)
        rows = pairs.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), weight.alias("weight"))
        graph = Graph(vertices.select(F.col("node").cast("long").alias("node")), rows.groupBy("u", "v").agg(F.sum("weight").alias("weight")))
        if check:
            validate(graph, rows)
        return graph

    @staticmethod
    def dense(spark: SparkSession, n: int, edges: list[tuple], check: bool = True) -> Graph:
        rows = spark.createDataFrame([(*e, 1.0) if len(e) == 2 else (e[0], e[1], float(e[2])) for e in edges], EDGES)
        return Graph.of(Graph.empty(spark, n).vertices, rows, check)

    @staticmethod
    def from_csr(spark: SparkSession, offsets, neighbors, weights=None) -> Graph:
        """From a symmetric sparse matrix with both directions of every edge and a loop once."""
        offsets, neighbors = np.asarray(offsets, np.int64), np.asarray(neighbors, np.int64)
        n = len(offsets) - 1
        if n < 0 or offsets[0] != 0 or offsets[-1] != len(neighbors) or (np.diff(offsets) < 0).any():
            raise GraphError("the offsets aren't those of a sparse matrix")
        if len(neighbors) and not (0 <= neighbors.min() and neighbors.max() < n):
            raise GraphError("a neighbor is out of range")
        w = np.ones(len(neighbors)) if weights is None else np.asarray(weights, float)
        if len(w) != len(neighbors) or not (np.isfinite(w) & (w > 0)).all():
            raise GraphError("weights must be finite and positive, one an entry")
        src = np.repeat(np.arange(n), np.diff(offsets))
        there, back = np.lexsort((w, neighbors, src)), np.lexsort((w, src, neighbors))
        same = (src[there] == neighbors[back]) & (neighbors[there] == src[back]) & (w[there] == w[back])
        if not same.all() or ((np.diff(src[there]) == 0) & (np.diff(neighbors[there]) == 0)).any():
            raise GraphError("the matrix isn't symmetric, or has an entry twice")
        upper = src <= neighbors
        edges = pa.table({"u": src[upper], "v": neighbors[upper], "weight": w[upper]})
        return Graph(Graph.empty(spark, n).vertices, spark.createDataFrame(edges), weights is not None)

    # accessors

    def adjacency(self) -> DataFrame:
        """(src, dst, weight) in both directions, a loop once."""
        back = self.edges.where("u <> v").select(F.col("v").alias("src"), F.col("u").alias("dst"), "weight")
        return self.edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").unionByName(back)

    def neighbors(self, node: int) -> DataFrame:
        return self.adjacency().where(F.col("src") == node).select(F.col("dst").alias("node"), "weight").orderBy("node")

    def degrees(self) -> DataFrame:
        """(node, degree) for every node."""
        ends = self.edges.select(F.explode(F.array("u", "v")).alias("node"), "weight")
        sums = ends.groupBy("node").agg(F.sum("weight").alias("degree"))
        return self.vertices.join(sums, "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"))

    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def total_weight(self) -> float:
        return self.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]

    def max_degree(self) -> float:
        return self.degrees().agg(F.coalesce(F.max("degree"), F.lit(0.0))).first()[0]

    def is_weighted(self) -> bool:
        if self.declared_weighted is not None:
            return self.declared_weighted
        return not self.edges.where("abs(weight - 1) > 1e-12").isEmpty()

    def is_simple_unweighted(self, tolerance: float = 1e-12) -> bool:
        return self.edges.where((F.col("u") == F.col("v")) | (F.abs(F.col("weight") - 1) > tolerance)).isEmpty()

    def has_loops(self) -> bool:
        return not self.edges.where("u = v").isEmpty()

    def has_edge(self, u: int, v: int) -> bool:
        return not self._one(u, v).isEmpty()

    def edge_weight(self, u: int, v: int) -> float:
        row = self._one(u, v).first()
        return row.weight if row else 0.0

    def _one(self, u: int, v: int) -> DataFrame:
        return self.edges.where((F.col("u") == min(u, v)) & (F.col("v") == max(u, v)))

    def remove_edge(self, u: int, v: int) -> Graph:
        """Without the edge, if it is there; the nodes stay."""
        return Graph(self.vertices, self.edges.where((F.col("u") != min(u, v)) | (F.col("v") != max(u, v))), self.declared_weighted)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, edges, self.declared_weighted)


def validate(graph: Graph, rows: DataFrame | None = None) -> None:
    """Raise GraphError for endpoints that aren't nodes and weights that aren't finite and positive."""
    rows = graph.edges if rows is None else rows
    bad = rows.where("weight IS NULL OR isnan(weight) OR weight <= 0 OR weight = double('Infinity')")
    if not bad.isEmpty():
        raise GraphError("weights must be finite and positive")
    ends = rows.select(F.explode(F.array("u", "v")).alias("node"))
    if not ends.join(graph.vertices, "node", "left_anti").isEmpty():
        raise GraphError("an edge has an end that isn't a node")
