"""The matrix of jobs that a configuration asks for over a manifest of graphs, and its guards."""

from __future__ import annotations

import hashlib
import itertools
import posixpath
import shlex
from collections import Counter
from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.graph import GraphError
from sparkweave.operators.spectral import automatic_basis

JOB = (
    "job_id string, protocol string, dataset string, scope_id string, graph string, graph_sha256 string, reference string, reference_sha256 string, n long, m long, "
    "sample_profile string, sample_seed long, algorithm string, algorithm_seed long, requested_k long, resolution double, dropout_rate double, dropout_seed long, output_dir string, options array<string>"
)
NO_DROPOUT = [{"rate": 0.0, "seeds": [0]}]
# The options that guard the work, with the setting that each takes its limit from, and that limit without one.
GUARDS = {
    "girvan_newman": {"gn_max_n": ("girvan_newman_max_n", 1000), "gn_max_m": ("girvan_newman_max_m", 10_000)},
    "spectral": {"spectral_max_edge_visits": ("spectral_max_edge_visits", 2_000_000_000), "spectral_max_orthogonalization_ops": ("spectral_max_orthogonalization_ops", 5_000_000_000)},
}


def job_id(parts) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def targets(manifest: dict, protocol: dict) -> list[dict]:
    """The graphs of a protocol: whole datasets, or the samples of its profile."""
    chosen = [d for d in manifest["datasets"] if not protocol.get("datasets") or d["name"] in protocol["datasets"]]
    if protocol["scope"] == "full":
        found = [(d["name"], "full", d, None, None) for d in chosen]
    else:
        profile = protocol["sample_profile"]
        found = [(d["name"], f"{profile}_seed_{s['seed']}", s, profile, int(s["seed"])) for d in chosen for s in d.get("samples", []) if s["profile"] == profile]
    return [
        {
            "dataset": name, "scope_id": scope, "graph": g["graph"], "graph_sha256": g["sha256"], "reference": g.get("reference"), "reference_sha256": g.get("reference_sha256"),
            "n": int(g["n"]), "m": int(g["m"]), "sample_profile": profile, "sample_seed": seed,
        }
        for name, scope, g, profile, seed in found
    ]


def k_values(config: dict, protocol: dict, target: dict, algorithm: str) -> list[int]:
    """Spectral clustering needs K, Girvan and Newman's method may have one (0: best modularity), others have none."""
    if algorithm not in GUARDS:
        return [0]
    settings = {}
    for source in (config, protocol):
        settings |= source.get("dataset_settings", {}).get(target["dataset"], {})
    found = [int(k) for k in settings.get(f"{algorithm}_k", [0] if algorithm == "girvan_newman" else [])]
    if not found:
        raise GraphError(f"no {algorithm}_k for {target['dataset']}")
    least = 2 if algorithm == "spectral" else 0
    if not all(least <= k <= target["n"] for k in found):
        raise GraphError(f"{algorithm} of {target['dataset']}/{target['scope_id']} needs K from {least} to {target['n']}")
    return found


def dropout_pairs(protocol: dict) -> list[tuple[float, int]]:
    found = [(float(d["rate"]), int(seed)) for d in protocol.get("dropout", NO_DROPOUT) for seed in d.get("seeds", [0])]
    if not all(0 <= rate < 1 for rate, _ in found) or not all(seed >= 0 for _, seed in found):
        raise GraphError(f"a dropout of {protocol['name']} has a rate outside 0 to 1 or a negative seed")
    return found


def option_words(config: dict, protocol: dict, algorithm: str) -> list[str]:
    """The options of an algorithm as words of a command line, by name; False and None leave one out, True has no value."""
    guards = config.get("resource_guards", {})
    chosen = {name: guards.get(setting, limit) for name, (setting, limit) in GUARDS.get(algorithm, {}).items()}
    for source in (config, protocol):
        chosen |= source.get("algorithm_options", {}).get(algorithm, {})
    words = []
    for name, value in sorted(chosen.items()):
        if value is not None and value is not False:
            words += ["--" + name.replace("_", "-")] + ([] if value is True else [str(value)])
    return words


def rows(config: dict, manifest: dict, protocols: list[str] | None = None) -> list[dict]:
    """All combinations of targets, algorithms, K, resolutions, seeds and dropouts, in the configuration's order."""
    known = [p["name"] for p in config["protocols"]]
    if unknown := set(protocols or []) - set(known):
        raise GraphError(f"no such protocol: {', '.join(sorted(unknown))}")
    found = []
    for p in config["protocols"]:
        if protocols and p["name"] not in protocols:
            continue
        resolutions = [float(x) for x in p.get("resolutions", [1.0])]
        if not all(isfinite(x) and x > 0 for x in resolutions):
            raise GraphError(f"a resolution of {p['name']} isn't finite and positive")
        for target, algorithm in itertools.product(targets(manifest, p), p["algorithms"]):
            seeds = [int(x) for x in p["algorithm_seeds"][algorithm]]
            if min(seeds, default=0) < 0:
                raise GraphError(f"a seed of {algorithm} is negative")
            words = option_words(config, p, algorithm)
            each = itertools.product(k_values(config, p, target, algorithm), resolutions if algorithm == "louvain" else [1.0], seeds, dropout_pairs(p))
            for k, resolution, seed, (rate, drop) in each:
                # the id is a text's digest, so numbers are written here and not by the engine
                name = job_id([p["name"], target["dataset"], target["scope_id"], target["graph_sha256"], target["reference_sha256"] or "no_reference", algorithm, k, resolution, seed, rate, drop, *words])
                folder = posixpath.join(config.get("output_dir", "results"), "raw", p["name"], target["dataset"], target["scope_id"], algorithm, f"job_{name}")
                own = {"job_id": name, "protocol": p["name"], "algorithm": algorithm, "algorithm_seed": seed, "requested_k": k, "resolution": resolution, "dropout_rate": rate, "dropout_seed": drop}
                found.append(own | target | {"output_dir": folder, "options": words})
    twice = [k for k, n in Counter(r["job_id"] for r in found).items() if n > 1]
    if twice or not found:
        raise GraphError(f"jobs come twice: {twice[:3]}" if twice else "there are no jobs")
    return found


def jobs(spark: SparkSession, config: dict, manifest: dict, most: int | None = None, protocols: list[str] | None = None) -> DataFrame:
    """The matrix as a table; ``most`` jobs of its beginning if that is given."""
    if most is not None and most < 0:
        raise GraphError("the number of jobs must not be negative")
    names = [c.split()[0] for c in JOB.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows(config, manifest, protocols)[:most]], JOB)


def option(name: str, otherwise) -> Column:
    """The number after an option of the job."""
    at = F.array_position("options", f"--{name}")
    given = F.get("options", at.cast("int"))
    wrong = F.raise_error(F.concat(F.lit(f"--{name} has no number in job "), F.col("job_id"))).cast("long")
    return F.when(at == 0, F.lit(otherwise).cast("long")).otherwise(F.coalesce(given.try_cast("long"), wrong))


def guarded(found: DataFrame, guards: dict) -> DataFrame:
    """Add ``reason``, null for jobs that may run; options of a job go before the settings."""
    limit = lambda algorithm, name: option(name.replace("_", "-"), guards.get(*GUARDS[algorithm][name]))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    n, m, whole = F.col("n"), F.col("m"), lambda c: c.cast("decimal(38,0)")
    most_n, most_m = limit("girvan_newman", "gn_max_n"), limit("girvan_newman", "gn_max_m")
    own = option("lanczos-basis", guards.get("spectral_basis_override", 0))
    basis = F.least(n, F.when(own > 0, own).otherwise(F.greatest(F.lit(automatic_basis(0)), 6 * F.col("requested_k") + 32)))
    visits, most_visits = whole(2 * m) * whole(basis), limit("spectral", "spectral_max_edge_visits")
    work, most_work = whole(4 * n) * whole(basis * basis), limit("spectral", "spectral_max_orthogonalization_ops")
    say = lambda c: c.cast("decimal(38,0)").cast("string")
    newman, spectral = F.col("algorithm") == "girvan_newman", F.col("algorithm") == "spectral"
    reason = F.when(newman & ((n > most_n) | (m > most_m)), text("exact_gn_guard:n=", say(n), ">", say(most_n), " or m=", say(m), ">", say(most_m)))
    reason = reason.when(spectral & (visits > most_visits), text("spectral_edge_guard:", say(visits), ">", say(most_visits)))
    return found.withColumn("reason", reason.when(spectral & (work > most_work), text("spectral_orthogonalization_guard:", say(work), ">", say(most_work))))


def command(job: dict) -> list[str]:
    """The words of the command line that runs a job."""
    words = ["run", "--graph", job["graph"], "--algorithm", job["algorithm"], "--dataset", job["dataset"], "--output-dir", job["output_dir"], "--seed", str(job["algorithm_seed"])]
    words += ["--resolution", str(job["resolution"]), "--dropout-rate", str(job["dropout_rate"]), "--dropout-seed", str(job["dropout_seed"])]
    words += ["--reference", job["reference"]] if job["reference"] else []
    words += ["--k", str(job["requested_k"])] if job["requested_k"] else []
    return [*words, *job["options"]]


def command_line(job: dict) -> str:
    return shlex.join(["python", "-m", "sparkweave", *command(job)])
