"""Tables over finished runs: what each found, how alike repeated and perturbed runs are, and distributions of both."""

from __future__ import annotations

import json
import posixpath
import re

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.scratch import passing, stored
from sparkweave.graph import GraphError
from sparkweave.operators import metrics
from sparkweave.plans.executor import DONE, index_table, read_index
from sparkweave.sources import files

# The names of the tables' columns. A dot separates the levels of a summary.
DISTRIBUTION = ("valid_count", "min", "q1", "median", "q3", "max", "community_mean", "node_weighted_mean")
INTERNAL = ("coverage", "ratio_cut", "normalized_cut", "modularity_q_gamma", "singletons", "isolated_nodes")
EXTERNAL = ("pairwise_precision", "pairwise_recall", "pairwise_f1", "ari")
DIAGNOSTICS = ("edges_removed", "hierarchy_levels", "eigensolver_basis_size", "eigensolver_max_residual", "kmeans_sse", "kmeans_iterations_best_restart", "levels", "local_passes", "iterations", "converged")
RUN_METRICS = (
    "num_communities", "elapsed_ms", "metrics_elapsed_ms", "wall_seconds", "peak_rss_mb", "dropout.removed_edges", "objective", "modularity_q1", *(f"internal.{c}" for c in INTERNAL),
    *(f"internal.{c}_distribution.{s}" for c in ("size", "density", "conductance") for s in DISTRIBUTION), *(f"external.{c}" for c in EXTERNAL), "external.ami_arithmetic", *(f"diagnostics.{c}" for c in DIAGNOSTICS),
)
GROUP = ("protocol", "dataset", "scope_id", "algorithm", "requested_k", "resolution", "parameters.laplacian")
SAMPLES = ("protocol", "dataset", "sample_profile", "algorithm", "requested_k", "resolution", "parameters.laplacian")
PAIR = ("ari", "ami_arithmetic")
STATISTICS = ("count", "mean", "std", "min", "q1", "median", "q3", "max")
_SPREAD = "struct<valid_count: long, min: double, q1: double, median: double, q3: double, max: double, community_mean: double, node_weighted_mean: double>"
SUMMARY = (
    "schema_version int, status string, dataset string, algorithm string, seed long, n long, m long, requested_k long, num_communities long, elapsed_ms double, metrics_elapsed_ms double, peak_rss_mb double, "
    "objective double, modularity_q1 double, dropout struct<rate: double, seed: long, removed_edges: long>, parameters struct<resolution: double, laplacian: string>, "
    f"internal struct<coverage: double, ratio_cut: double, normalized_cut: double, modularity_q_gamma: double, singletons: long, isolated_nodes: long, size_distribution: {_SPREAD}, density_distribution: {_SPREAD}, "
    f"conductance_distribution: {_SPREAD}>, external struct<a: long, b: long, c: long, d: long, pairwise_precision: double, pairwise_recall: double, pairwise_f1: double, ari: double>, diagnostics map<string,double>"
)
OF_JOB = ("job_id", "protocol", "scope_id", "sample_profile", "sample_seed", "graph", "graph_sha256", "reference", "reference_sha256", "summary", "command", "wall_seconds", "algorithm_seed", "resolution", "dropout_rate", "dropout_seed")
OF_COMMUNITY = ("job_id", "protocol", "dataset", "scope_id", "sample_profile", "sample_seed", "algorithm", "algorithm_seed", "requested_k", "resolution", "dropout_rate", "dropout_seed")
SAME = 1e-9


def col(name: str) -> Column:
    """A column whose name has dots."""
    return F.col(f"`{name}`")


def flat(rows: DataFrame) -> DataFrame:
    """Structs as columns with dotted names, and the diagnostics that any row has."""
    names: list[tuple[str, Column]] = []

    def down(name: str, at: Column, kind) -> None:
        if kind.typeName() == "struct":
            for f in kind.fields:
                down(f"{name}.{f.name}", at[f.name], f.dataType)
        elif kind.typeName() == "map":
            found = rows.select(F.explode(F.map_keys(at)).alias("k")).distinct().orderBy("k").collect()  # a few names
            names.extend((f"{name}.{r.k}", F.try_element_at(at, F.lit(r.k))) for r in found)
        else:
            names.append((name, at))

    for f in rows.schema.fields:
        down(f.name, F.col(f"`{f.name}`"), f.dataType)
    return rows.select(*(c.alias(n) for n, c in names))


def read_runs(spark: SparkSession, records: list[dict], base: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The runs that ended well, their communities, and (job_id, node, label).

    GraphError for files that are missing, labels that aren't one a node, and an ARI that differs from the labels'.
    """
    done = [r for r in records if r["status"] in DONE]
    if not done:
        raise GraphError("no run has ended well")
    home = {r["job_id"]: posixpath.dirname(files.resolved(r["summary"], base)) for r in done}
    missing = [f"{h}/{f}" for h in home.values() for f in ("summary.json", "partition.tsv", "communities.csv") if not files.exists(f"{h}/{f}")]
    if missing:
        raise GraphError(f"files of indexed runs are missing: {missing[:3]}")
    index = index_table(spark, done)
    uri = lambda p: re.sub("^file:/+", "file:///", files.uri_of(p))
    paths = spark.createDataFrame([(j, uri(f"{h}/summary.json")) for j, h in home.items()], "job_id string, _path string")
    summaries = spark.read.schema(SUMMARY).json([files.uri_of(f"{h}/summary.json") for h in home.values()], multiLine=True)
    summaries = summaries.select("*", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:///").alias("_path")).join(F.broadcast(paths), "_path").drop("_path")
    rows = flat(stored(summaries, "summaries"))
    labels = stored(files.read_partitions(spark, {j: f"{h}/partition.tsv" for j, h in home.items()}), "run-labels")
    partition = spark.createDataFrame([(j, files.relative(f"{h}/partition.tsv", base)) for j, h in home.items()], "job_id string, partition string")
    runs = rows.join(index.select(*OF_JOB), "job_id").join(partition, "job_id").join(_information(spark, done, labels, base), "job_id", "left")
    runs = stored(runs, "runs")
    _check(runs, labels)
    wrong = runs.where((col("reference").isNotNull()) & (col("external.ari").isNull() | (F.abs(col("external.ari") - col("_ari")) > SAME))).select("job_id").first()
    if wrong:
        raise GraphError(f"the ARI of the run {wrong.job_id} isn't that of its labels")
    communities = index.select(*OF_COMMUNITY).join(files.read_communities(spark, {j: f"{h}/communities.csv" for j, h in home.items()}), "job_id")
    return runs.drop("_ari"), communities, labels


def _check(runs: DataFrame, labels: DataFrame) -> None:
    counts = labels.groupBy("job_id").agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("node").alias("_nodes"))
    wrong = runs.select("job_id", "n").join(counts, "job_id", "left").where("NOT (_rows <=> n AND _nodes <=> n)").first()
    if wrong:
        raise GraphError(f"the partition of the run {wrong.job_id} doesn't give every node one label")


def _information(spark: SparkSession, done: list[dict], labels: DataFrame, base: str) -> DataFrame:
    """(job_id, _ari, external.ami_arithmetic) of runs with a reference."""
    named = {r["job_id"]: files.resolved(r["reference"], base) for r in done if r.get("reference")}
    if not named:
        return spark.createDataFrame([], "job_id string, _ari double, `external.ami_arithmetic` double")
    reference = stored(files.read_partitions(spark, named), "run-references")
    own = labels.join(reference.select("job_id").distinct(), "job_id")
    sizes = [x.groupBy("job_id").agg(F.count(F.lit(1)).alias(n)) for x, n in ((own, "_a"), (reference, "_b"))]
    wrong = sizes[0].join(sizes[1], "job_id").where("_a <> _b").first()
    if wrong:
        raise GraphError(f"the reference of the run {wrong.job_id} is of another size")
    cells = stored(metrics.contingency(own, reference, ("job_id",)), "run-cells")
    found = metrics.agreement_of(cells, ("job_id",)).select("job_id", F.col("ari").alias("_ari"))
    return found.join(metrics.information_of(cells, ("job_id",)).select("job_id", F.col("ami").alias("external.ami_arithmetic")), "job_id")


# pairs of runs


def kinds_of(labels: DataFrame) -> DataFrame:
    """(job_id, kind): runs of one kind have the same labels, but for a chance of 2^-100.

    A kind is the number of nodes and the sums of four parts of hashes of node and label, so that a task adds up its rows before any move.
    """
    one, other, low = F.xxhash64("node", "label"), F.xxhash64("label", "node", F.lit(1)), F.lit((1 << 32) - 1)
    parts = (one.bitwiseAND(low), F.shiftrightunsigned(one, 32), other.bitwiseAND(low), F.shiftrightunsigned(other, 32))
    return labels.groupBy("job_id").agg(F.struct(F.count(F.lit(1)).alias("n"), *(F.sum(x).alias(f"h{i}") for i, x in enumerate(parts))).alias("kind"))


def scored(pairs: DataFrame, labels: DataFrame, with_ami: bool = True) -> DataFrame:
    """Pairs of runs (left_job_id, right_job_id, left_kind, right_kind, ...) with ari and ami_arithmetic, without the kinds.

    Every two kinds that meet are compared once, all in one aggregation.
    """
    keys = ["left_kind", "right_kind"]
    met = stored(pairs.select(*keys).distinct(), "pair-kinds")
    ends = F.array(*(F.struct(F.col(f"{x}_kind").alias("kind"), F.col(f"{x}_job_id").alias("job_id")) for x in ("left", "right")))
    shown = stored(pairs.select(F.inline(ends)).groupBy("kind").agg(F.min("job_id").alias("job_id")), "kinds")  # a run of each kind
    own = stored(labels.join(shown, "job_id").select("kind", "node", "label"), "kind-labels")
    side = lambda k: met.join(own.withColumnRenamed("kind", k), k)
    cells = stored(metrics.contingency(side(keys[0]), side(keys[1]), tuple(keys)), "pair-cells")
    found = metrics.agreement_of(cells, tuple(keys)).select(*keys, "ari")
    if with_ami:
        found = found.join(metrics.information_of(cells, tuple(keys)).select(*keys, F.col("ami").alias("ami_arithmetic")), keys)
    else:
        found = found.withColumn("ami_arithmetic", F.lit(None).cast("double"))
    return pairs.join(stored(found, "kind-scores"), keys).drop(*keys)


def _same(keys: tuple[str, ...]) -> list[Column]:
    return [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]


def stability_pairs(runs: DataFrame, labels: DataFrame, with_ami: bool = True, sampled: bool = False) -> DataFrame:
    """Every two runs of a group without dropout, by job_id; labels: (job_id, node, label). ``sampled``: only pairs whose first run is on a sample."""
    calm = runs.where("dropout_rate = 0").select("job_id", *map(col, GROUP), "sample_profile", "sample_seed", "algorithm_seed").join(kinds_of(labels), "job_id")
    calm = stored(calm, "calm-runs")
    first = calm.where("sample_profile IS NOT NULL") if sampled else calm
    pairs = first.alias("l").join(calm.alias("r"), [*_same(GROUP), F.col("l.job_id") < F.col("r.job_id")]).select(
        *(F.col(f"l.`{k}`").alias(k) for k in (*GROUP, "sample_profile", "sample_seed")), F.col("l.job_id").alias("left_job_id"), F.col("r.job_id").alias("right_job_id"),
        F.col("l.algorithm_seed").alias("left_seed"), F.col("r.algorithm_seed").alias("right_seed"), F.col("l.kind").alias("left_kind"), F.col("r.kind").alias("right_kind"),
    )
    return scored(stored(pairs, "stability-pairs"), labels, with_ami)


def robustness_pairs(runs: DataFrame, labels: DataFrame, with_ami: bool = True) -> DataFrame:
    """Every perturbed run with the run of its group and seed without dropout; of several such the last by job_id."""
    keys = (*GROUP, "algorithm_seed")
    kinds = kinds_of(labels)
    calm = runs.where("dropout_rate = 0").groupBy(*map(col, keys)).agg(F.max("job_id").alias("left_job_id"))
    calm = calm.join(kinds.select(F.col("job_id").alias("left_job_id"), F.col("kind").alias("left_kind")), "left_job_id")
    shaken = runs.where("dropout_rate > 0").join(kinds, "job_id")
    shaken = shaken.select(F.col("job_id").alias("right_job_id"), *map(col, keys), "sample_profile", "sample_seed", "dropout_rate", "dropout_seed", col("dropout.removed_edges").alias("removed_edges"), F.col("kind").alias("right_kind"))
    pairs = calm.alias("l").join(shaken.alias("r"), _same(keys)).select(
        "left_job_id", "right_job_id", *(F.col(f"r.`{k}`").alias(k) for k in (*keys, "sample_profile", "sample_seed", "dropout_rate", "dropout_seed", "removed_edges")), "left_kind", "right_kind",
    )
    pairs = scored(stored(pairs, "robustness-pairs"), labels, with_ami)
    return pairs.withColumnsRenamed({"left_job_id": "baseline_job_id", "right_job_id": "perturbed_job_id"})


# distributions


def distribution_of(value: Column) -> list[Column]:
    """STATISTICS of the finite values; std is that of a sample, 0 of a single value."""
    x = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    std = F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0)
    return [c.alias(n) for c, n in zip((F.count(x), F.avg(x), std, F.min(x), q[0], q[1], q[2], F.max(x)), STATISTICS, strict=True)]


def aggregate(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per group and metric with its distribution; null keys form groups."""
    long = rows.select(*map(col, keys), F.inline(F.array(*(F.struct(F.lit(v).alias("metric"), col(v).cast("double").alias("value")) for v in values))))
    return long.groupBy(*map(col, keys), "metric").agg(*distribution_of(F.col("value")))


def wide(rows: DataFrame, keys: list[str], values: list[str], *more: Column) -> DataFrame:
    """One row per group: ``more``, and for every metric its distribution as the columns metric_statistic."""
    found = aggregate(rows, keys, values).groupBy(*map(col, keys)).pivot("metric", values).agg(F.first(F.struct(*STATISTICS)))
    counts = rows.groupBy(*map(col, keys)).agg(*more) if more else None
    spread = [F.coalesce(col(v)[s], F.lit(0)).alias(f"{v}_{s}") if s == "count" else col(v)[s].alias(f"{v}_{s}") for v in values for s in STATISTICS]
    found = found.select(*map(col, keys), *spread)
    if counts is None:
        return found
    names = [c for c in counts.columns if c not in keys]
    joined = counts.alias("l").join(found.alias("r"), _same(tuple(keys)))
    return joined.select(*(F.col(f"l.`{c}`").alias(c) for c in (*keys, *names)), *(F.col(f"r.`{c}`").alias(c) for c in found.columns if c not in keys))


def spread(pairs: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """As ``wide`` of PAIR, in one aggregation."""
    found = pairs.groupBy(*map(col, keys)).agg(*more, *(F.struct(*distribution_of(F.col(v))).alias(v) for v in PAIR))
    own = [c for c in found.columns if c not in PAIR]
    return found.select(*map(col, own), *(F.col(v)[s].alias(f"{v}_{s}") for v in PAIR for s in STATISTICS))


def _available(runs: DataFrame) -> list[str]:
    return [m for m in RUN_METRICS if m in runs.columns]


def aggregate_runs(runs: DataFrame) -> DataFrame:
    return wide(runs, [*GROUP, "dropout_rate"], _available(runs), F.count(F.lit(1)).alias("runs"))


def aggregate_samples(runs: DataFrame) -> DataFrame:
    """Over all samples of a profile."""
    return wide(runs.where("sample_profile IS NOT NULL"), [*SAMPLES, "dropout_rate"], _available(runs), F.count(F.lit(1)).alias("runs"))


def stability_summary(pairs: DataFrame) -> DataFrame:
    return spread(pairs, list(GROUP))


def robustness_summary(pairs: DataFrame) -> DataFrame:
    return spread(pairs, [*GROUP, "dropout_rate"])


def sample_stability_summary(pairs: DataFrame) -> DataFrame:
    """Over all samples of a profile, with the number of samples and of pairs."""
    more = (F.size(F.collect_set("sample_seed")).cast("long").alias("sample_scopes"), F.count(F.lit(1)).alias("partition_pairs"))
    return spread(pairs.where("sample_profile IS NOT NULL"), list(SAMPLES), *more)


DATASET = (
    "name string, source_format string, graph string, reference string, node_ids string, sha256 string, reference_sha256 string, node_ids_sha256 string, "
    "n long, m long, components long, isolated_nodes long, min_degree long, max_degree long, mean_degree double"
)


def dataset_table(datasets: DataFrame) -> DataFrame:
    """DATASET with the sources' paths and digests strung together; ``source_files`` is an array of (path, size_bytes, sha256)."""
    each = lambda c: F.array_join(F.transform("source_files", lambda x: x[c]), " | ")
    own = [c for c in datasets.columns if c not in ("samples", "source_files")]
    return datasets.select(*own, F.size("source_files").alias("source_file_count"), each("path").alias("source_paths"), each("sha256").alias("source_sha256"))


def datasets_of(spark: SparkSession, manifest: dict) -> DataFrame:
    names = [c.split()[0] for c in DATASET.split(", ")]
    rows = [(*(d.get(c) for c in names), [(f["path"], f["size_bytes"], f["sha256"]) for f in d.get("source_files", [])]) for d in manifest["datasets"]]
    return spark.createDataFrame(rows, f"{DATASET}, source_files array<struct<path: string, size_bytes: long, sha256: string>>")


def skipped(index: DataFrame) -> DataFrame:
    return index.where(~F.col("status").isin(*DONE))


def tables(spark: SparkSession, records: list[dict], manifest: dict, base: str = "", with_ami: bool = True) -> dict[str, DataFrame]:
    """All tables by name."""
    runs, communities, labels = read_runs(spark, records, base)
    stability, robustness = stored(stability_pairs(runs, labels, with_ami), "stability"), stored(robustness_pairs(runs, labels, with_ami), "robustness")
    return {
        "runs": runs, "communities": communities, "aggregate": aggregate_runs(runs), "sample_aggregate": aggregate_samples(runs), "stability_pairs": stability, "stability_summary": stability_summary(stability),
        "sample_stability_summary": sample_stability_summary(stability), "robustness_pairs": robustness, "robustness_summary": robustness_summary(robustness), "datasets": dataset_table(datasets_of(spark, manifest)),
        "skipped": skipped(index_table(spark, records)),
    }


def summarize(spark: SparkSession, folder: str, manifest_path: str, base: str = "", with_ami: bool = True) -> str:
    """Write all tables as CSV, with NA for null, and report_ready.json, which names them; its path."""
    with passing(spark):
        paths = _write(folder, tables(spark, read_index(folder), json.loads(files.read_text(manifest_path)), base, with_ami))
    ready = {
        "schema_version": 1, "spark_version": pyspark.__version__, "ami_convention": "arithmetic mean normalization; natural logarithm", "quantile_convention": "linear interpolation",
        "files": {n: files.relative(p, base) for n, p in paths.items()},
    }
    files.write_text(f"{folder}/report_ready.json", json.dumps(ready, ensure_ascii=False, indent=2) + "\n")
    return f"{folder}/report_ready.json"


def _write(folder: str, found: dict[str, DataFrame]) -> dict[str, str]:
    paths = {}
    for name, rows in found.items():
        lists = {f.name: F.array_join(f"`{f.name}`", " ").alias(f.name) for f in rows.schema.fields if f.dataType.typeName() == "array"}
        rows = rows.select(*(lists.get(c, col(c)) for c in rows.columns))
        paths[name] = f"{folder}/tables/{name}.csv"
        order = [c for c in (*GROUP, "dropout_rate", "sample_profile", "name", "job_id", "left_job_id", "right_job_id", "baseline_job_id", "perturbed_job_id", "community") if c in rows.columns]
        files.write_table(rows, paths[name], [f"`{c}`" for c in order], sep=",")
    return paths
