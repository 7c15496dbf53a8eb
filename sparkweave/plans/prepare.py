"""From raw data to graphs, references and samples, with a manifest of all files."""

from __future__ import annotations

import json
import platform
import posixpath

import numpy as np
import pyarrow
import pyspark
from pyspark.sql import DataFrame, SparkSession

from sparkweave.functions.scratch import passing, stored
from sparkweave.graph import Graph, GraphError
from sparkweave.operators import transform
from sparkweave.sources import files

#: How samples are taken: the walk visits node by node on the driver, rings are taken by the cluster.
WALK, RINGS = "randomized_bfs_induced", "hashed_rings_induced"


def sample_nodes(graph: Graph, size: int, seed: int, sampling: str = WALK) -> DataFrame:
    """(node) of a sample. The walk holds the edges' ends on the driver, 32 bytes an edge."""
    if sampling == RINGS:
        return transform.snowball(graph, size, seed)
    if sampling != WALK:
        raise GraphError(f"no such sampling: {sampling}")
    held = graph.adjacency().select("src", "dst").toArrow()
    src, dst = (held.column(c).to_numpy() for c in ("src", "dst"))
    order, n = np.lexsort((dst, src)), graph.num_nodes()
    offsets = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    chosen = transform.snowball_exact(n, offsets, dst[order], size, seed)
    return graph.spark.createDataFrame([(int(x),) for x in chosen], "node long")


def samples_of(spec: dict, common: list[dict], n: int) -> list[tuple[str, int, int]]:
    """(profile, size, seed) of the samples to take: those smaller than the graph."""
    found = []
    for s in spec.get("samples", common):
        name, size = files.safe_name(str(s["name"])), int(s["size"])
        seeds = [int(x) for x in s.get("seeds", [0])]
        if size <= 0 or min(seeds, default=0) < 0:
            raise GraphError(f"the samples {name} need a positive size and seeds that aren't negative")
        found += [(name, size, seed) for seed in seeds if size < n]
    if len({(name, seed) for name, _, seed in found}) < len(found):
        raise GraphError(f"samples of {spec['name']} come twice")
    return found


def _written(graph: Graph, ids: DataFrame, reference: DataFrame | None, folder: str, name: str, base: str) -> dict:
    """Write a graph with its ids and reference; what the manifest says of them."""
    paths = {"graph": f"{folder}/{name}", "reference": f"{folder}/reference.tsv", "node_ids": f"{folder}/node_ids.tsv"}
    if not graph.is_simple_unweighted():
        raise GraphError("prepared graphs have no loops and weights")
    files.create_folder(folder)
    files.write_binary(graph, paths["graph"])
    files.write_node_ids(ids, paths["node_ids"])
    if reference is not None:
        files.write_labels(reference, paths["reference"])
    told = lambda what, f: f(paths[what]) if what != "reference" or reference is not None else None
    short = lambda p: files.relative(p, base)
    sums = {"sha256" if what == "graph" else f"{what}_sha256": told(what, files.sha256) for what in paths}
    found = transform.graph_metadata(graph).first().asDict()
    order = ("n", "m", "components", "isolated_nodes", "min_degree", "max_degree", "mean_degree")
    return {what: told(what, short) for what in paths} | sums | {c: found[c] or 0 for c in order}


def _kept(graph: Graph, ids: DataFrame, reference: DataFrame | None, part: tuple[Graph, DataFrame]) -> tuple[Graph, DataFrame, DataFrame | None]:
    """A part of the graph with new numbers, and its ids and reference."""
    inside, names = part
    renamed = lambda x: x.withColumnRenamed("node", "old").join(names, "old").drop("old")
    return inside, renamed(ids), None if reference is None else renamed(reference)


def _stored(graph: Graph, ids: DataFrame, reference: DataFrame | None) -> tuple[Graph, DataFrame, DataFrame | None]:
    held = Graph(stored(graph.vertices, "prepared-vertices"), stored(graph.edges, "prepared-edges"), graph.declared_weighted)
    return held, stored(ids, "prepared-ids"), None if reference is None else stored(reference, "prepared-reference")


def dataset(spark: SparkSession, spec: dict, folder: str, common: list[dict], base: str) -> dict:
    """Prepare one dataset in its folder; its entry of the manifest, which also goes to metadata.json."""
    name = files.safe_name(str(spec["name"]))
    graph, ids, reference, kind, sources = files.load(spark, spec, base)
    graph, ids, reference = _stored(graph, ids, reference)
    if spec.get("largest_component", False):
        graph, ids, reference = _stored(*_kept(graph, ids, reference, transform.largest_component(graph)))
    home = f"{folder}/{name}"
    entry = {"name": name, "source_format": kind, "source_files": [files.file_record(f, base) for f in sources]}
    entry |= _written(graph, ids, reference, home, "full.graph", base) | {"samples": []}
    sampling = spec.get("sampling", WALK)
    for profile, size, seed in samples_of(spec, common, entry["n"]):
        part = _stored(*_kept(graph, ids, reference, transform.induced(graph, sample_nodes(graph, size, seed, sampling))))
        told = _written(*part, f"{home}/samples/{profile}/seed_{seed}", "sample.graph", base)
        entry["samples"].append({"profile": profile, "seed": seed, "sampling": sampling} | told)
    files.write_text(f"{home}/metadata.json", json.dumps(entry, ensure_ascii=False, indent=2) + "\n")
    return entry


def prepare(spark: SparkSession, config: dict, base: str = "", only: list[str] | None = None) -> str:
    """Prepare the datasets of a configuration (or only those named) and write manifest.json; its path."""
    names = [str(d["name"]) for d in config["datasets"]]
    if len(set(names)) < len(names):
        raise GraphError("a dataset's name comes twice")
    if unknown := set(only or []) - set(names):
        raise GraphError(f"no such dataset: {', '.join(sorted(unknown))}")
    folder = files.resolved(config.get("output_dir", "data/processed"), base)
    with passing(spark):
        entries = [dataset(spark, d, folder, config.get("samples", []), base) for d in config["datasets"] if not only or d["name"] in only]
    manifest = {
        "schema_version": 1, "generator": "sparkweave prepare", "python_version": platform.python_version(), "numpy_version": np.__version__, "pyarrow_version": pyarrow.__version__,
        "spark_version": pyspark.__version__, "datasets": entries,
    }
    path = posixpath.join(folder, "manifest.json")
    files.write_text(path, json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")
    return path


def read_manifest(path: str) -> dict:
    return json.loads(files.read_text(path))

