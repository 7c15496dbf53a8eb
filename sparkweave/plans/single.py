"""One run: a graph is read, perturbed, partitioned and scored, and three files tell the outcome."""

from __future__ import annotations

import json
import os
import resource
import time
from math import isfinite
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from sparkweave.graph import Graph, GraphError
from sparkweave.operators import girvan_newman, label_propagation, louvain, metrics, partition, spectral, transform
from sparkweave.operators.result import Result
from sparkweave.sources import files

ALGORITHMS = {
    "girvan_newman": (girvan_newman.run, girvan_newman.Config),
    "spectral": (spectral.run, spectral.Config),
    "louvain": (louvain.run, louvain.Config),
    "label_propagation": (label_propagation.run, label_propagation.Config),
}
# The options of a run, each with its kind and the value that it has if it isn't given.
OPTIONS = {
    "graph": (str, None), "algorithm": (str, None), "output-dir": (str, None), "dataset": (str, ""), "reference": (str, ""), "seed": (int, 42), "k": (int, 0), "resolution": (float, 1.0),
    "dropout-rate": (float, 0.0), "dropout-seed": (int, 0), "force": (bool, False), "help": (bool, False), "laplacian": (str, ""), "bisection": (str, "sweep"), "dense-threshold": (int, 256),
    "lanczos-basis": (int, 0), "kmeans-restarts": (int, 20), "kmeans-max-iterations": (int, 300), "eigensolver-tolerance": (float, 1e-9), "max-eigensolver-residual": (float, 1e-4),
    "gn-max-n": (int, 1000), "gn-max-m": (int, 10_000), "gn-random-ties": (bool, False), "spectral-max-edge-visits": (int, 2_000_000_000), "spectral-max-orthogonalization-ops": (int, 5_000_000_000),
    "lpa-synchronous": (bool, False), "lpa-smallest-tie": (bool, False), "max-iterations": (int, 100), "louvain-driver-edges": (int, 0), "spectral-matrix": (str, "driver"),
}


def number(text: str, kind: type, name: str) -> int | float:
    """A whole number of 0 or more, or a finite one; nothing else may stand beside it."""
    try:
        value = kind(text)
    except ValueError:
        value = None
    if value is None or text != text.strip() or "_" in text or not isfinite(value) or (kind is int and (value < 0 or not text.isascii() or not text.isdigit())):
        raise GraphError(f"--{name} has a wrong number: {text!r}")
    return value


def parse(words: list[str]) -> dict:
    """Options by name, from ``--name value`` and ``--name``."""
    given: dict[str, str | None] = {}
    at = 0
    while at < len(words):
        name = {"-h": "--help"}.get(words[at], words[at])
        if not name.startswith("--"):
            raise GraphError(f"{name!r} is no option")
        name, at = name[2:], at + 1
        if name not in OPTIONS:
            raise GraphError(f"no such option: --{name}")
        given[name] = None
        if name != "help" and at < len(words) and not words[at].startswith("--"):
            given[name], at = words[at], at + 1
    found = {}
    for name, (kind, otherwise) in OPTIONS.items():
        if kind is bool:
            found[name] = name in given
        elif name not in given:
            found[name] = otherwise
        elif given[name] is None:
            raise GraphError(f"--{name} needs a value")
        else:
            found[name] = given[name] if kind is str else number(given[name], kind, name)
    if not found["help"] and (missing := [n for n in found if found[n] is None]):
        raise GraphError(f"--{missing[0]} is missing")
    return found


def usage() -> str:
    lines = [f"  --{name}{'' if kind is bool else ' ' + {str: 'TEXT', int: 'N', float: 'X'}[kind]}{'' if kind is bool or default in (None, '') else f'  (without it {default})'}" for name, (kind, default) in OPTIONS.items()]
    return "\n".join(["python -m sparkweave run --graph FILE --algorithm NAME --output-dir FOLDER [options]", f"Algorithms: {', '.join(ALGORITHMS)}", *lines])


def configured(o: dict):
    """The algorithm's own settings from the options."""
    if o["algorithm"] == "girvan_newman":
        return girvan_newman.Config(target_communities=o["k"], random_ties=o["gn-random-ties"], seed=o["seed"], max_n=o["gn-max-n"], max_m=o["gn-max-m"], force=o["force"])
    if o["algorithm"] == "spectral":
        return spectral.Config(
            num_communities=o["k"], laplacian=o["laplacian"] or spectral.NORMALIZED, bisection=o["bisection"], kmeans_restarts=o["kmeans-restarts"], kmeans_max_iterations=o["kmeans-max-iterations"], seed=o["seed"],
            dense_solver_threshold=o["dense-threshold"], lanczos_basis_size=o["lanczos-basis"], eigensolver_tolerance=o["eigensolver-tolerance"], maximum_eigensolver_residual=o["max-eigensolver-residual"],
            max_edge_visits=o["spectral-max-edge-visits"], max_orthogonalization_ops=o["spectral-max-orthogonalization-ops"], force=o["force"], matrix=o["spectral-matrix"],
        )
    if o["algorithm"] == "louvain":
        return louvain.Config(resolution=o["resolution"], seed=o["seed"], driver_edges=o["louvain-driver-edges"])
    if o["algorithm"] == "label_propagation":
        return label_propagation.Config(max_iterations=o["max-iterations"], asynchronous=not o["lpa-synchronous"], random_ties=not o["lpa-smallest-tie"], seed=o["seed"])
    raise GraphError(f"no such algorithm: {o['algorithm']}")


def timed(graph: Graph, algorithm: str, config=None) -> Result:
    """Run, with labels normalized, modularity at resolution 1, and the time of the algorithm alone.

    Algorithms store their labels, so the clock stops when those are there.
    """
    if algorithm not in ALGORITHMS:
        raise GraphError(f"no such algorithm: {algorithm}")
    run, kind = ALGORITHMS[algorithm]
    began = time.perf_counter()
    result = run(graph, config or kind())
    result.elapsed_ms = (time.perf_counter() - began) * 1000
    result.labels = partition.normalize(result.labels)
    result.modularity = metrics.modularity(graph, result.labels)
    result.diagnostics["num_communities"] = float(partition.count_communities(result.labels))
    return result


def peak_rss_mb(spark: SparkSession) -> float | None:
    """The most memory that the driver's Python and its JVM have held; executors of a cluster are not in it."""
    own = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    try:
        told = Path(f"/proc/{spark.sparkContext._jvm.ProcessHandle.current().pid()}/status").read_text()
        return own + int(told.split("VmHWM:")[1].split()[0]) / 1024
    except (OSError, IndexError, ValueError):
        return own


def plain(value):
    """What JSON can hold: numbers that aren't finite are null."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return None if isinstance(value, float) and not isfinite(value) else value


def scored(spark: SparkSession, graph: Graph, o: dict, reference: DataFrame | None = None) -> tuple[Result, DataFrame, dict]:
    """Perturb, run and score: the result, its community table and the summary."""
    removed = 0
    if o["dropout-rate"] > 0:
        graph, removed = transform.drop_edges(graph, o["dropout-rate"], o["dropout-seed"])
    result = timed(graph, o["algorithm"], configured(o))
    began = time.perf_counter()
    internal = metrics.partition_metrics(graph, result.labels, o["resolution"]).first().asDict(recursive=True)
    external = metrics.agreement(result.labels, reference).first().asDict() if reference is not None else None
    took = (time.perf_counter() - began) * 1000
    names = ("coverage", "ratio_cut", "normalized_cut", "modularity_q_gamma", "singletons", "isolated_nodes", "size_distribution", "density_distribution", "conductance_distribution")
    summary = {
        "schema_version": 1, "status": "ok", "dataset": o["dataset"] or PurePosixPath(o["graph"]).stem, "algorithm": o["algorithm"], "seed": o["seed"], "n": graph.num_nodes(), "m": graph.num_edges(),
        "requested_k": o["k"], "num_communities": internal["num_communities"], "elapsed_ms": result.elapsed_ms, "metrics_elapsed_ms": took, "peak_rss_mb": peak_rss_mb(spark), "objective": result.objective,
        "modularity_q1": result.modularity, "dropout": {"rate": o["dropout-rate"], "seed": o["dropout-seed"], "removed_edges": removed},
        "parameters": {"resolution": o["resolution"], "laplacian": o["laplacian"] or "not_applicable"},
        "internal": {n: internal[n] for n in names},
        "external": external, "diagnostics": dict(sorted(result.diagnostics.items())),
    }
    return result, metrics.community_table(graph, result.labels), plain(summary)


def run(spark: SparkSession, o: dict) -> str:
    """Run as the options say and write partition.tsv, communities.csv and summary.json; the path of the last."""
    graph = files.read_binary(spark, o["graph"])
    reference = files.read_labels(spark, o["reference"], graph.num_nodes()) if o["reference"] else None
    result, table, summary = scored(spark, graph, o, reference)
    folder = o["output-dir"].rstrip("/")
    files.write_labels(result.labels, f"{folder}/partition.tsv")
    files.write_communities(table, f"{folder}/communities.csv")
    files.write_text(f"{folder}/summary.json", json.dumps(summary, ensure_ascii=False, indent=2) + "\n")
    return os.path.join(folder, "summary.json")
