"""Scores of partitions: on the graph, and against another partition. Undefined values are null."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.graph import Graph, GraphError
from sparkweave.operators import partition


def _resolution(value: float) -> float:
    if not 0 < value < float("inf"):
        raise GraphError("the resolution must be finite and positive")
    return float(value)


def community_table(graph: Graph, labels: DataFrame) -> DataFrame:
    """One row per community: size, internal_edges, internal_weight, boundary_weight, volume, density, conductance."""
    a = labels.select(F.col("node").alias("u"), F.col("label").alias("cu"))
    b = labels.select(F.col("node").alias("v"), F.col("label").alias("cv"))
    ends = graph.edges.join(a, "u").join(b, "v")
    inside = F.col("cu") == F.col("cv")
    sides = ends.select(
        F.inline(F.array(
            F.struct(F.col("cu").alias("label"), F.when(inside, F.col("weight")).otherwise(0.0).alias("w_in"), (inside & (F.col("u") != F.col("v"))).cast("long").alias("e_in"), F.when(inside, 0.0).otherwise(F.col("weight")).alias("w_out"), F.col("weight").alias("w_end")),
            F.struct(F.col("cv").alias("label"), F.lit(0.0).alias("w_in"), F.lit(0).cast("long").alias("e_in"), F.when(inside, 0.0).otherwise(F.col("weight")).alias("w_out"), F.col("weight").alias("w_end")),
        ))
    )
    sums = sides.groupBy("label").agg(F.sum("w_in").alias("w_in"), F.sum("e_in").alias("e_in"), F.sum("w_out").alias("w_out"), F.sum("w_end").alias("vol"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    total = graph.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = sizes.join(sums, "label", "left").crossJoin(F.broadcast(total)).select(
        F.col("label").alias("community"), "size", F.coalesce("e_in", F.lit(0)).alias("internal_edges"), zero("w_in").alias("internal_weight"),
        zero("w_out").alias("boundary_weight"), zero("vol").alias("volume"), "m",
    )
    small = F.least(F.col("volume"), 2 * F.col("m") - F.col("volume"))
    return rows.select(
        "community", "size", "internal_edges", "internal_weight", "boundary_weight", "volume",
        F.when(F.col("size") >= 2, 2.0 * F.col("internal_edges") / (F.col("size") * (F.col("size") - 1))).alias("density"),
        F.when(small > 0, F.col("boundary_weight") / small).alias("conductance"),
    )


def modularity(graph: Graph, labels: DataFrame, resolution: float = 1.0) -> float:
    """Newman and Girvan's Q with a resolution (Reichardt and Bornholdt); 0 without edges."""
    return modularity_of(community_table(graph, labels), _resolution(resolution)).first().modularity


def modularity_of(table: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row from a community table. The volumes sum to 2m."""
    sums = table.agg(F.sum("internal_weight").alias("w"), F.sum("volume").alias("two_m"), F.sum(F.col("volume") * F.col("volume")).alias("squares"))
    m = F.col("two_m") / 2
    return sums.select(F.when(F.col("two_m") > 0, F.col("w") / m - F.lit(resolution) * F.col("squares") / (F.col("two_m") * F.col("two_m"))).otherwise(0.0).alias("modularity"))


def distribution(table: DataFrame, value: str) -> list:
    """Columns that describe the defined values: exact quantiles, their mean, and the mean weighted by size."""
    x = F.col(value).cast("double")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    weight = F.when(x.isNotNull(), F.col("size"))
    return [F.count(x).alias("valid_count"), F.min(x).alias("min"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.max(x).alias("max"), F.avg(x).alias("community_mean"), (F.sum(x * F.col("size")) / F.sum(weight)).alias("node_weighted_mean")]


def distributions(table: DataFrame) -> DataFrame:
    """Three rows: the distributions of size, density and conductance over communities."""
    rows = [table.agg(*distribution(table, c)).select(F.lit(c).alias("metric"), "*") for c in ("size", "density", "conductance")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def partition_metrics(graph: Graph, labels: DataFrame, resolution: float = 1.0, check: bool = True) -> DataFrame:
    """One row: all scores of the partition, with its distributions as structs; GraphError unless every node has one label."""
    if check:
        partition.check_cover(graph, labels)
    table = community_table(graph, labels)
    g = _resolution(resolution)
    describe = {c: F.struct(*distribution(table, c)) for c in ("size", "density", "conductance")}
    two_m, w = F.sum("volume"), F.sum("internal_weight")
    rows = table.agg(
        F.count(F.lit(1)).alias("num_communities"),
        F.coalesce(F.sum((F.col("size") == 1).cast("long")), F.lit(0)).alias("singletons"),
        F.when(two_m > 0, w / (two_m / 2)).alias("coverage"),
        F.sum(F.col("boundary_weight") / F.col("size")).alias("ratio_cut"),
        F.when(F.min("volume") > 0, F.sum(F.when(F.col("volume") > 0, F.col("boundary_weight") / F.col("volume")))).alias("normalized_cut"),
        F.when(two_m > 0, w / (two_m / 2) - g * F.sum(F.col("volume") * F.col("volume")) / (two_m * two_m)).otherwise(0.0).alias("modularity_q_gamma"),
        *(s.alias(f"{c}_distribution") for c, s in describe.items()),
    )
    isolated = graph.degrees().agg(F.coalesce(F.sum((F.col("degree") == 0).cast("long")), F.lit(0)).alias("isolated_nodes"))
    return rows.crossJoin(isolated)


# against another partition


def contingency(predicted: DataFrame, reference: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, p, r, n): how many nodes have the label p in the one and r in the other partition."""
    both = predicted.select(*keys, "node", F.col("label").alias("p")).join(reference.select(*keys, "node", F.col("label").alias("r")), [*keys, "node"])
    return both.groupBy(*keys, "p", "r").agg(F.count(F.lit(1)).alias("n"))


def check_same_nodes(predicted: DataFrame, reference: DataFrame) -> None:
    """Raise GraphError unless both give the same nodes one label each."""
    sides = [x.groupBy("node").agg(F.count(F.lit(1)).alias(n)) for x, n in ((predicted, "_p"), (reference, "_r"))]
    both = sides[0].join(sides[1], "node", "full")
    if not both.where("NOT (_p <=> 1 AND _r <=> 1)").isEmpty():
        raise GraphError("the partitions cover different nodes, or a node twice")


def _two(c: str):
    """Pairs among so many."""
    return F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1) / 2).cast("decimal(38,0)")


def _joined(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return left.join(right, list(keys)) if keys else left.crossJoin(right)


def agreement_of(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``agreement`` for the cells of each key; one row without keys."""
    total = cells.groupBy(*keys) if keys else cells.groupBy()
    joint = total.agg(_two("n").alias("a"), F.sum("n").alias("n"))
    sums = lambda c, name: cells.groupBy(*keys, c).agg(F.sum("n").alias("s")).groupBy(*keys).agg(_two("s").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    row = _joined(_joined(joint, sums("p", "pp"), keys), sums("r", "rr"), keys)
    row = row.select(*keys, zero("a").alias("a"), (zero("pp") - zero("a")).alias("b"), (zero("rr") - zero("a")).alias("c"), zero("n").alias("n"))
    row = row.withColumn("d", F.expr("CAST(n * (n - 1) div 2 AS BIGINT) - a - b - c"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    pairs = a + b + c + d
    expected = (a + b) * (a + c) / pairs
    most = (2 * a + b + c) / 2
    ari = F.when(pairs == 0, 1.0).when(most == expected, F.when((b == 0) & (c == 0), 1.0).otherwise(0.0)).otherwise((a - expected) / (most - expected))
    return row.select(
        *keys, "a", "b", "c", "d", F.when(a + b > 0, a / (a + b)).alias("pairwise_precision"), F.when(a + c > 0, a / (a + c)).alias("pairwise_recall"),
        F.when(2 * a + b + c > 0, 2 * a / (2 * a + b + c)).otherwise(1.0).alias("pairwise_f1"), ari.alias("ari"),
    )


def agreement(predicted: DataFrame, reference: DataFrame, check: bool = True) -> DataFrame:
    """One row: pairs together in both (a), in the prediction only (b), in the reference only (c), in neither (d); precision, recall, F1, ARI.

    GraphError unless both partitions cover the same nodes.
    """
    if check:
        check_same_nodes(predicted, reference)
    return agreement_of(contingency(predicted, reference))


def information_of(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``adjusted_mutual_information`` for the cells of each key; one row without keys."""
    on = list(keys)
    p = cells.groupBy(*keys, "p").agg(F.sum("n").alias("a"))
    r = cells.groupBy(*keys, "r").agg(F.sum("n").alias("b"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    wide = lambda x: x.join(F.broadcast(total) if not keys else total, on) if keys else x.crossJoin(F.broadcast(total))
    entropy = lambda c: -F.sum(F.col(c) / F.col("total") * F.ln(F.col(c) / F.col("total")))
    hp = wide(p).groupBy(*keys).agg(F.count(F.lit(1)).alias("kp"), entropy("a").alias("h_predicted"))
    hr = wide(r).groupBy(*keys).agg(F.count(F.lit(1)).alias("kr"), entropy("b").alias("h_reference"))
    each = wide(cells.join(p, [*on, "p"]).join(r, [*on, "r"]))
    mi = each.groupBy(*keys).agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mutual_information"))
    # sizes that occur are few (they sum to the nodes), so that pairs of them are at most about 2n
    size_p = p.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("times_a"))
    size_r = r.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("times_b"))
    chance = F.sum(F.col("times_a") * F.col("times_b") * F.arrow_udf(expected_information, "double")("a", "b", "total"))
    emi = wide(_joined(size_p, size_r, keys)).groupBy(*keys).agg(F.coalesce(chance, F.lit(0.0)).alias("expected_mutual_information"))
    row = _joined(_joined(_joined(mi, hp, keys), hr, keys), emi, keys)
    mean = (F.col("h_predicted") + F.col("h_reference")) / 2
    trivial = ((F.col("kp") == 1) & (F.col("kr") == 1)) | ((F.col("h_predicted") == 0) & (F.col("h_reference") == 0))
    bottom = mean - F.col("expected_mutual_information")
    tiny = F.lit(2.220446049250313e-16)
    bottom = F.when(bottom < 0, F.least(bottom, -tiny)).otherwise(F.greatest(bottom, tiny))
    ami = F.when(trivial, 1.0).otherwise((F.col("mutual_information") - F.col("expected_mutual_information")) / bottom)
    return row.select(*keys, "mutual_information", "h_predicted", "h_reference", "expected_mutual_information", ami.alias("ami"))


def adjusted_mutual_information(predicted: DataFrame, reference: DataFrame, check: bool = True) -> DataFrame:
    """One row: mutual information, entropies, its expectation, and AMI with the arithmetic mean (Vinh, Epps and Bailey)."""
    if check:
        check_same_nodes(predicted, reference)
    return information_of(contingency(predicted, reference))


CHUNK = 1 << 16


def expected_information(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    """What communities of a and b of n nodes add to the mutual information, expected under the hypergeometric model.

    The chance of k common nodes follows from that of k - 1 by a ratio, so a chunk of them is a running sum of logarithms.
    """
    out = []
    for a, b, n in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True):
        low, high, total = max(1, a + b - n), min(a, b), 0.0
        f = lambda x: lgamma(x + 1)
        log = f(a) + f(b) + f(n - a) + f(n - b) - f(n) - f(low) - f(a - low) - f(b - low) - f(n - a - b + low)
        for begin in range(low, high + 1, CHUNK):
            k = np.arange(begin, min(high + 1, begin + CHUNK), dtype=float)
            logs = log + np.concatenate([[0], np.cumsum(np.log((a - k) * (b - k) / ((k + 1) * (n - a - b + k + 1)), out=np.full(len(k), -np.inf), where=(a > k) & (b > k)))])
            total += float((k / n * np.log(n * k / (a * b)) * np.exp(logs[:-1])).sum())
            log = logs[-1]
        out.append(total)
    return pa.array(out, pa.float64())
