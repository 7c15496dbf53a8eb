"""Spectral clustering: Laplacian eigenvectors, sweep cuts and k-means.

The guard on edge visits bounds the matrix, which is gathered on the driver as sparse arrays, or stays a table of
the cluster (``matrix="cluster"``) that every product of the iteration is a job over; the driver then holds the basis alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import inf, isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.functions.scratch import stored
from sparkweave.graph import Graph, GraphError
from sparkweave.operators import partition
from sparkweave.operators.result import Result

NORMALIZED, UNNORMALIZED = "normalized", "unnormalized"
SWEEP, SIGN = "sweep", "sign"
DRIVER, CLUSTER = "driver", "cluster"
SAME = 1e-14  # coordinates this close aren't cut apart


@dataclass(frozen=True)
class Config:
    num_communities: int = 2
    laplacian: str = NORMALIZED
    bisection: str = SWEEP
    row_normalize_embedding: bool = True
    kmeans_restarts: int = 10
    kmeans_max_iterations: int = 300
    kmeans_tolerance: float = 1e-6
    seed: int = 42
    dense_solver_threshold: int = 256
    lanczos_basis_size: int = 0
    eigensolver_tolerance: float = 1e-9
    maximum_eigensolver_residual: float = 1e-4
    max_edge_visits: float = 2e9
    max_orthogonalization_ops: float = 5e9
    force: bool = False
    matrix: str = DRIVER


def automatic_basis(k: int) -> int:
    return max(128, 6 * k + 32)


class Operator:
    """x -> B x. Normalized: B = D^-1/2 A D^-1/2, eigenvalue 1 - mu; else B = s I - L, eigenvalue s - mu."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, laplacian: str):
        self.n, self.normalized = n, laplacian == NORMALIZED
        self.degree = np.bincount(u, w, n) + np.bincount(v, w, n)
        self.src, self.dst = np.concatenate([u, v]), np.concatenate([v, u])
        w = np.concatenate([w, w])
        if self.normalized:
            root = np.sqrt(self.degree)
            w = w / (root[self.src] * root[self.dst])
        self.weight, self.shift = w, 1.0 if self.normalized else max(1.0, 2 * self.degree.max(initial=0.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.bincount(self.src, self.weight * x[self.dst], self.n)
        return out if self.normalized else (self.shift - self.degree) * x + out

    def dense(self) -> np.ndarray:
        b = np.zeros((self.n, self.n))
        np.add.at(b, (self.src, self.dst), self.weight)
        return b if self.normalized else b + np.diag(self.shift - self.degree)


class ClusterOperator(Operator):
    """The same over a table of edges (i, j, weight); a vector goes to the tasks and their sums come back."""

    def __init__(self, n: int, edges: DataFrame, laplacian: str):
        self.n, self.normalized = n, laplacian == NORMALIZED
        both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
        self.entries = stored(both.repartition("i"), "spectral-entries")
        self.degree = self._sums(self.entries.select("i", F.col("weight").alias("s")))
        self.shift = 1.0 if self.normalized else max(1.0, 2 * self.degree.max(initial=0.0))
        self.root = np.sqrt(np.where(self.degree > 0, self.degree, 1.0)) if self.normalized else np.ones(n)

    def _sums(self, parts: DataFrame) -> np.ndarray:
        found, out = parts.groupBy("i").agg(F.sum("s").alias("s")).toArrow(), np.zeros(self.n)
        out[found.column("i").to_numpy()] = found.column("s").to_numpy()
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        sent = self.entries.sparkSession.sparkContext.broadcast(x / self.root)  # 8 bytes a node

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                i, j, w = (batch.column(c).to_numpy() for c in ("i", "j", "weight"))
                own, place = np.unique(i, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(place, w * sent.value[j], len(own)))], ["i", "s"])

        out = self._sums(self.entries.mapInArrow(products, "i long, s double")) / self.root
        sent.destroy()
        return out if self.normalized else (self.shift - self.degree) * x + out

    def dense(self) -> np.ndarray:
        return np.array([self(row) for row in np.eye(self.n)])


def lanczos(op: Operator, k: int, basis: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of B and their vectors, with every new vector made orthogonal twice."""
    rng = np.random.default_rng(seed & ((1 << 63) - 1))
    n = op.n
    q, alpha, beta = np.zeros((basis, n)), [], []

    def fresh(i: int) -> np.ndarray:
        for _ in range(16):
            x = rng.uniform(-1, 1, n)
            for _ in range(2):
                x -= q[:i].T @ (q[:i] @ x)
            size = np.linalg.norm(x)
            if size > 1e-8:
                return x / size
        raise GraphError("no start vector is orthogonal to the basis")

    q[0] = fresh(0)
    for i in range(basis):
        x = op(q[i])
        alpha.append(float(q[i] @ x))
        if i + 1 == basis:
            break
        for _ in range(2):
            x -= q[: i + 1].T @ (q[: i + 1] @ x)
        size = float(np.linalg.norm(x))
        if size <= tolerance:
            q[i + 1], size = fresh(i + 1), 0.0
        else:
            q[i + 1] = x / size
        beta.append(size)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
    order = np.argsort(-values, kind="stable")[:k]
    found = q.T @ vectors[:, order]
    size = np.linalg.norm(found, axis=0)
    if (size == 0).any():
        raise GraphError("an eigenvector is zero")
    return values[order], found / size


def eigenpairs(op: Operator, k: int, c: Config) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The k least Laplacian eigenvalues, their vectors, the backend (0 dense, 1 Lanczos) and its basis."""
    if op.n <= c.dense_solver_threshold:
        values, vectors = np.linalg.eigh(op.dense())
        order = np.argsort(-values, kind="stable")[:k]
        return op.shift - values[order], vectors[:, order], 0, op.n
    basis = min(op.n, c.lanczos_basis_size or automatic_basis(k))
    if basis <= k and basis < op.n:
        raise GraphError("the basis must have more vectors than communities are asked for")
    values, vectors = lanczos(op, k, basis, c.eigensolver_tolerance, c.seed)
    return op.shift - values, vectors, 1, basis


def residual(op: Operator, values: np.ndarray, vectors: np.ndarray) -> float:
    mu = op.shift - values
    return max((float(np.linalg.norm(op(x) - m * x)) / max(1.0, abs(m)) for m, x in zip(mu, vectors.T, strict=True)), default=0.0)


def kmeans(points: np.ndarray, k: int, c: Config) -> tuple[np.ndarray, float, int]:
    """Lloyd's method from k-means++ seeds (Arthur and Vassilvitskii 2007); labels, squared error and iterations of the best restart."""
    rng, best = np.random.default_rng(c.seed), None
    for _ in range(c.kmeans_restarts):
        centers = points[[rng.integers(len(points))]]
        near = ((points - centers[0]) ** 2).sum(1)
        while len(centers) < k:
            total = near.sum()
            pick = rng.choice(len(points), p=near / total) if total > 0 else rng.integers(len(points))
            centers = np.vstack([centers, points[pick]])
            near = np.minimum(near, ((points - points[pick]) ** 2).sum(1))
        label = np.full(len(points), -1)
        for step in range(1, c.kmeans_max_iterations + 1):
            far = squared_distances(points, centers)
            new = far.argmin(1)
            least, used = far[np.arange(len(points)), new], set()
            moved = np.array(centers)
            for j in range(k):
                own = new == j
                if own.any():
                    moved[j] = points[own].mean(0)
                else:  # the farthest point that no other empty cluster took
                    order = [p for p in np.argsort(-least, kind="stable") if p not in used]
                    used.add(order[0])
                    moved[j] = points[order[0]]
            shift, same = float(np.sqrt(((moved - centers) ** 2).sum())), (new == label).all()
            centers, label = moved, new
            if same or shift <= c.kmeans_tolerance:
                break
        error = float(((points - centers[label]) ** 2).sum())
        if best is None or error < best[1]:
            best = label, error, step
    return best


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((points - x) ** 2).sum(1) for x in centers], 1)


def bisection_objective(graph: Graph, labels: DataFrame, laplacian: str = NORMALIZED) -> DataFrame:
    """One row, objective: RatioCut or Ncut of two sides 0 and 1; infinite if a side is empty or has no volume."""
    a = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    b = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    cut = graph.edges.join(a, "u").join(b, "v").where("lu <> lv").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("cut"))
    side = lambda k, x: F.coalesce(F.sum(F.when(F.col("label") == k, x)), F.lit(0)).cast("double")
    size = F.lit(1) if laplacian == UNNORMALIZED else F.col("degree")
    sides = labels.join(graph.degrees(), "node").agg(side(0, size).alias("a"), side(1, size).alias("b"))
    ok = (F.col("a") > 0) & (F.col("b") > 0)
    return sides.crossJoin(cut).select(F.when(ok, F.expr("cut * (1 / a + 1 / b)")).otherwise(F.lit(inf)).alias("objective"))


def sweep(graph: Graph, coordinate: DataFrame, laplacian: str = NORMALIZED) -> DataFrame:
    """(position, score, cut, left) of the best threshold in the order of (coordinate, node).

    ``coordinate`` is (node, x). An edge is cut from the lesser of its ends' places to the greater, so
    running sums of what enters and leaves give all cuts at once. Places come from a range partitioning
    and running sums from sums of blocks of places, so no task sees all nodes.
    """
    placed = partition.dense_ids(coordinate.select("x", "node"), ["x", "node"]).select("node", "x", (F.col("id") + 1).alias("position"))
    placed = stored(placed.join(graph.degrees(), "node"), "sweep-places")
    at = placed.select("node", "position")
    ends = graph.edges.where("u <> v").join(at.withColumnsRenamed({"node": "u", "position": "pu"}), "u").join(at.withColumnsRenamed({"node": "v", "position": "pv"}), "v")
    steps = ends.select(F.inline(F.array(F.struct(F.least("pu", "pv").alias("position"), F.col("weight").alias("step")), F.struct(F.greatest("pu", "pv").alias("position"), (-F.col("weight")).alias("step")))))
    steps = steps.groupBy("position").agg(F.sum("step").alias("step"))
    size = F.lit(1.0) if laplacian == UNNORMALIZED else F.col("degree")
    rows = placed.join(steps, "position", "left").select("position", "x", size.alias("size"), F.coalesce("step", F.lit(0.0)).alias("step"))
    following = placed.select((F.col("position") - 1).alias("position"), F.col("x").alias("after"))
    block = 1 << 16
    rows = rows.join(following, "position", "left").withColumn("block", F.floor(F.col("position") / block))
    sums = rows.groupBy("block").agg(F.sum("size").alias("block_size"), F.sum("step").alias("block_step"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sums.select("block", F.coalesce(F.sum("block_size").over(before), F.lit(0.0)).alias("size0"), F.coalesce(F.sum("block_step").over(before), F.lit(0.0)).alias("step0"))
    own = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"size1": F.sum("size").over(own), "step1": F.sum("step").over(own)}).join(F.broadcast(starts), "block")
    total = rows.agg(F.sum("size").alias("total"))
    scored = run.crossJoin(F.broadcast(total)).select("position", (F.col("step0") + F.col("step1")).alias("cut"), (F.col("size0") + F.col("size1")).alias("left"), "total", "x", "after")
    right = F.col("total") - F.col("left")
    allowed = (F.col("after") - F.col("x") > SAME) & (F.col("left") > 0) & (right > 0)
    scored = scored.where(allowed).select("position", (F.col("cut") * (1 / F.col("left") + 1 / right)).alias("score"), "cut", "left")
    return scored.agg(F.min_by(F.struct("*"), F.struct(F.round("score", 12), "position")).alias("best")).select("best.*")


def run(graph: Graph, config: Config | None = None) -> Result:
    """K communities from the K least eigenvectors; two by a cut through the second one."""
    c = config or Config()
    k, n, m = c.num_communities, graph.num_nodes(), graph.num_edges()
    if not 2 <= k <= n:
        raise GraphError("the number of communities must be from 2 to the number of nodes")
    if c.laplacian not in (NORMALIZED, UNNORMALIZED) or c.bisection not in (SWEEP, SIGN) or c.matrix not in (DRIVER, CLUSTER):
        raise GraphError("no such Laplacian, bisection or place of the matrix")
    if min(c.kmeans_restarts, c.kmeans_max_iterations) < 1 or not all(isfinite(x) and x > 0 for x in (c.kmeans_tolerance, c.eigensolver_tolerance, c.maximum_eigensolver_residual)):
        raise GraphError("tolerances and limits must be positive")
    if graph.has_loops():
        raise GraphError("spectral clustering needs a graph without loops")
    basis = min(n, c.lanczos_basis_size or automatic_basis(k))
    if n > c.dense_solver_threshold and not c.force and (2 * m * basis > c.max_edge_visits or 4 * n * basis**2 > c.max_orthogonalization_ops):
        raise GraphError("the work is above the guards")
    ids = stored(partition.dense_ids(graph.vertices, ["node"]), "spectral-ids")
    edges = graph.edges.join(ids.withColumnsRenamed({"node": "u", "id": "i"}), "u").join(ids.withColumnsRenamed({"node": "v", "id": "j"}), "v").select("i", "j", "weight")
    if c.matrix == CLUSTER:
        op = ClusterOperator(n, edges, c.laplacian)
    else:
        held = edges.orderBy("i", "j").toArrow()
        op = Operator(n, *(held.column(x).to_numpy() for x in ("i", "j", "weight")), c.laplacian)
    values, vectors, backend, basis = eigenpairs(op, k, c)
    worst = residual(op, values, vectors)
    if worst > c.maximum_eigensolver_residual:
        raise GraphError(f"the eigenvectors' residual is {worst:g}")
    told = {"lambda_1": float(values[0]), "lambda_2": float(values[1]), "eigensolver_backend": float(backend), "eigensolver_basis_size": float(basis), "eigensolver_max_residual": worst}
    spark = graph.spark
    names = np.array([r.node for r in ids.orderBy("id").collect()])
    frame = lambda x, kind: spark.createDataFrame(list(zip(names.tolist(), x.tolist(), strict=True)), f"node long, {kind}")
    if k > 2:
        points = vectors
        if c.row_normalize_embedding:
            size = np.linalg.norm(points, axis=1, keepdims=True)
            points = points / np.where(size > 0, size, 1)
        label, error, steps = kmeans(points, k, c)
        told |= {"kmeans_sse": error, "kmeans_iterations_best_restart": float(steps)}
        return Result("spectral", stored(partition.normalize(frame(label, "label long")), "spectral-result"), objective=error, diagnostics=told)
    x = vectors[:, 1]
    if c.laplacian == NORMALIZED:
        root = np.sqrt(op.degree)
        x = np.where(root > 0, x / np.where(root > 0, root, 1), 0.0)
    x = np.round(x, 12) + 0.0
    side = (x >= 0).astype(int)
    if c.bisection == SWEEP or side.min() == side.max():
        best = sweep(graph, frame(x, "x double"), c.laplacian).first()
        at = best.position if best and best.position else n // 2
        side = np.ones(n, int)
        side[np.lexsort((names, x))[:at]] = 0
    labels = stored(partition.normalize(frame(side, "label long")), "spectral-result")
    return Result("spectral", labels, objective=bisection_objective(graph, labels, c.laplacian).first().objective, diagnostics=told)
