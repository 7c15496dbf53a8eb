"""Partitions: (node, label) with one label a node, 0 .. K-1 by the least node of each label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import Graph, GraphError
from sparkweave.operators.components import stars


def dense_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``id``: the row's place in this order, from 0, without one task that sees all rows.

    Rows are range-partitioned and numbered within partitions; the few partition sizes give the offsets.
    """
    from sparkweave.functions.scratch import stored

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns

    def numbers(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], [*names, "_part", "_at"])
            at += n

    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(numbers, f"{fields}, _part int, _at long"), "dense-ids")
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()  # one row a partition
    at, starts = 0, []
    for r in sizes:
        starts.append((r._part, at))
        at += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("id", F.col("_start") + F.col("_at")).select(*names, "id")


def normalize(labels: DataFrame) -> DataFrame:
    """Labels 0 .. K-1 in the order of their least nodes."""
    firsts = labels.groupBy("label").agg(F.min("node").alias("first"))
    ids = dense_ids(firsts, ["first"]).select("label", F.col("id").cast("int").alias("new"))
    return labels.join(ids, labels["label"].eqNullSafe(ids["label"])).select("node", F.col("new").alias("label"))


def count_communities(labels: DataFrame) -> int:
    return labels.select("label").distinct().count()


def check_cover(graph: Graph, labels: DataFrame) -> None:
    """Raise GraphError unless every node has exactly one label."""
    joined = graph.vertices.withColumn("_v", F.lit(1)).join(labels.groupBy("node").agg(F.count(F.lit(1)).alias("_n")), "node", "full")
    if not joined.where("_v IS NULL OR _n IS NULL OR _n <> 1").isEmpty():
        raise GraphError("the labels must give every node one label")


def component_roots(graph: Graph) -> DataFrame:
    """(node, component): the least node that each one reaches."""
    found = stars(graph.edges.select("u", "v"))
    return graph.vertices.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def connected_components(graph: Graph) -> DataFrame:
    return normalize(component_roots(graph).withColumnRenamed("component", "label"))


def split_disconnected(graph: Graph, labels: DataFrame) -> DataFrame:
    """Every connected part of a community becomes a community."""
    check_cover(graph, labels)
    a = labels.select(F.col("node").alias("u"), F.col("label").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("label").alias("cv"))
    inside = graph.edges.join(a, "u").join(b, "v").where(F.col("cu").eqNullSafe(F.col("cv"))).select("u", "v", "weight")
    return connected_components(graph.with_edges(inside))
