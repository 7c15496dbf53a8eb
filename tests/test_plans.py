import csv
import hashlib
import json

import pytest

from sparkweave.__main__ import main
from sparkweave.graph import GraphError
from sparkweave.operators import metrics
from sparkweave.plans import executor, jobs, prepare, results, single
from sparkweave.sources import files

SEEDS = [11, 23, 37, 53, 71, 89, 107, 131, 157, 191, 223, 257, 293, 331, 373, 419, 461, 509, 557, 607]
FEW = [11, 37, 71, 107, 157]
ALL = ["girvan_newman", "spectral", "louvain", "label_propagation"]
SUITE = {
    "output_dir": "results",
    "resource_guards": {"girvan_newman_max_n": 1000, "girvan_newman_max_m": 10_000, "spectral_max_edge_visits": 2_000_000_000, "spectral_max_orthogonalization_ops": 5_000_000_000},
    "algorithm_options": {
        "girvan_newman": {"gn_max_n": 1000, "gn_max_m": 10_000}, "louvain": {}, "label_propagation": {"max_iterations": 100},
        "spectral": {"laplacian": "normalized", "bisection": "sweep", "kmeans_restarts": 20, "dense_threshold": 256, "eigensolver_tolerance": "1e-9", "max_eigensolver_residual": "1e-4"},
    },
    "dataset_settings": {n: {"spectral_k": [k], "girvan_newman_k": [k]} for n, k in (("karate", 2), ("football", 12), ("cond_mat", 16), ("reddit2", 41))},
    "protocols": [
        {"name": "full_scale", "scope": "full", "algorithms": ALL, "algorithm_seeds": {"girvan_newman": [42], "spectral": SEEDS[:10], "louvain": SEEDS, "label_propagation": SEEDS}, "dropout": [{"rate": 0.0, "seeds": [0]}]},
        {"name": "all_algorithms_large_sample", "scope": "sample", "sample_profile": "all_algorithms", "datasets": ["cond_mat", "reddit2"], "algorithms": ALL, "algorithm_seeds": {"girvan_newman": [42], "spectral": FEW, "louvain": FEW, "label_propagation": FEW}},
        {"name": "spectral_medium_sample", "scope": "sample", "sample_profile": "spectral_medium", "datasets": ["cond_mat", "reddit2"], "algorithms": ["spectral"], "algorithm_seeds": {"spectral": FEW}},
        {"name": "spectral_k_sensitivity", "scope": "full", "datasets": ["cond_mat"], "algorithms": ["spectral"], "dataset_settings": {"cond_mat": {"spectral_k": [8, 16, 32]}}, "algorithm_seeds": {"spectral": FEW}},
        {
            "name": "robustness_scalable", "scope": "full", "algorithms": ["louvain", "label_propagation"], "algorithm_seeds": {"louvain": FEW, "label_propagation": FEW},
            "dropout": [{"rate": 0.0, "seeds": [0]}, {"rate": 0.01, "seeds": [701, 709, 719, 727, 733]}, {"rate": 0.05, "seeds": [739, 743, 751, 757, 761]}],
        },
        {"name": "louvain_resolution_sensitivity", "scope": "full", "algorithms": ["louvain"], "resolutions": [0.5, 0.75, 1.0, 1.25, 1.5, 2.0], "algorithm_seeds": {"louvain": FEW}},
    ],
}


def manifest():
    def graph(name, n, m):
        return {"graph": f"{name}.graph", "sha256": hashlib.sha256(name.encode()).hexdigest(), "reference": None, "reference_sha256": None, "n": n, "m": m}

    profiles = [("all_algorithms", 400, s) for s in (101, 202, 303, 404, 505)] + [("spectral_medium", 5000, s) for s in (101, 202, 303)]
    sizes = {"karate": (34, 78), "football": (115, 613), "cond_mat": (21_363, 91_286), "reddit2": (232_965, 11_606_919)}
    return {"datasets": [{"name": d, **graph(d, *nm), "samples": [{"profile": p, "seed": s, **graph(f"{d}{p}{s}", size, size * 4)} for p, size, s in profiles if size < nm[0]]} for d, nm in sizes.items()]}


def test_suite(spark):
    found = jobs.jobs(spark, SUITE, manifest()).collect()
    assert len(found) == 969 and len({r.job_id for r in found}) == 969
    assert {p["name"]: sum(r.protocol == p["name"] for r in found) for p in SUITE["protocols"]} == dict(zip((p["name"] for p in SUITE["protocols"]), (204, 160, 30, 15, 440, 120), strict=True))
    one = next(r for r in found if r.protocol == "full_scale" and r.algorithm == "spectral" and r.dataset == "karate")
    words = "--bisection sweep --dense-threshold 256 --eigensolver-tolerance 1e-9 --kmeans-restarts 20 --laplacian normalized --max-eigensolver-residual 1e-4 --spectral-max-edge-visits 2000000000 --spectral-max-orthogonalization-ops 5000000000".split()
    assert one.options == words and one.output_dir == f"results/raw/full_scale/karate/full/spectral/job_{one.job_id}"
    parts = ["full_scale", "karate", "full", hashlib.sha256(b"karate").hexdigest(), "no_reference", "spectral", "2", "1.0", "11", "0.0", "0", *words]
    assert one.job_id == hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]
    assert {r.scope_id for r in found if r.sample_profile} == {f"all_algorithms_seed_{s}" for s in (101, 202, 303, 404, 505)} | {f"spectral_medium_seed_{s}" for s in (101, 202, 303)}
    assert [r.job_id for r in jobs.jobs(spark, SUITE, manifest(), 7).collect()] == [r.job_id for r in found[:7]]
    reasons = {(r.dataset, r.scope_id, r.algorithm): r.reason for r in jobs.guarded(jobs.jobs(spark, SUITE, manifest()), SUITE["resource_guards"]).collect()}
    assert reasons["karate", "full", "girvan_newman"] is None and reasons["cond_mat", "full", "girvan_newman"] == "exact_gn_guard:n=21363>1000 or m=91286>10000"
    assert reasons["reddit2", "full", "spectral"] == f"spectral_edge_guard:{2 * 11_606_919 * 278}>2000000000"
    line = jobs.command(one.asDict())
    o = single.parse(line[1:])
    assert o["k"] == 2 and o["kmeans-restarts"] == 20 and o["eigensolver-tolerance"] == 1e-9 and line[0] == "run"


def test_configurations_that_cannot_be():
    changed = lambda **p: SUITE | {"protocols": [SUITE["protocols"][0] | p]}
    bad = [
        changed(dropout=[{"rate": 1.0, "seeds": [0]}]), changed(dropout=[{"rate": 0.1, "seeds": [-1]}]), changed(resolutions=[0.0]), changed(algorithm_seeds={a: [-1] for a in ALL}), changed(datasets=["none"]),
        changed(dataset_settings={"karate": {"spectral_k": [99]}}), SUITE | {"dataset_settings": {}}, SUITE | {"protocols": [SUITE["protocols"][0]] * 2},
    ]
    for config in bad:
        with pytest.raises(GraphError):
            jobs.rows(config, manifest())
    with pytest.raises(GraphError):
        jobs.rows(SUITE, manifest(), ["other"])


def test_command_line(capsys):
    need = ["--graph", "g", "--algorithm", "louvain", "--output-dir", "o"]
    o = single.parse([*need, "--lpa-synchronous", "--seed", "7"])
    assert o["lpa-synchronous"] and o["seed"] == 7 and o["resolution"] == 1.0 and not o["force"]
    for bad in (need[:4], [*need, "more"], [*need, "--no-such", "1"], [*need, "--seed", "-1"], [*need, "--seed", "1.5"], [*need, "--k", "1_0"], [*need, "--resolution", "nan"], [*need, "--resolution", "1x"], [*need, "--dataset"]):
        with pytest.raises(GraphError):
            single.parse(bad)
    assert main(["run", "--help"]) == 0 and "--graph" in capsys.readouterr().out
    assert main(["run", "--seed"]) == 2 and capsys.readouterr().err.startswith("sparkweave: ")


GML = 'graph [\n' + "\n".join(f'node [ id {i} label "a \\"{i}\\"" value "no" value "{"left" if i < 3 else "right"}" ]' for i in range(6)) + "\n" + "\n".join(f"edge [ source {a} target {b} ]" for a, b in [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (1, 0), (2, 2)]) + "\n]\n"


def table(path):
    with open(path) as f:
        return list(csv.DictReader(f))


def test_from_raw_data_to_tables(spark, tmp_path, capsys):
    (tmp_path / "toy.gml").write_text(GML)
    (tmp_path / "datasets.json").write_text(json.dumps({"output_dir": "processed", "samples": [{"name": "tiny", "size": 4, "seeds": [17]}], "datasets": [{"name": "toy", "format": "gml", "path": "toy.gml", "largest_component": True}]}))
    config = {
        "manifest": "processed/manifest.json", "output_dir": "results", "dataset_settings": {"toy": {"spectral_k": [2], "girvan_newman_k": [2]}}, "algorithm_options": {"spectral": {"laplacian": "normalized"}, "label_propagation": {"lpa_synchronous": True}, "louvain": {"louvain_driver_edges": 100}},
        "protocols": [
            {"name": "smoke", "scope": "full", "algorithms": ALL[:3], "algorithm_seeds": {"girvan_newman": [42], "spectral": [11, 37], "louvain": [11]}, "dropout": [{"rate": 0.0, "seeds": [0]}]},
            {"name": "shaken", "scope": "full", "algorithms": ["label_propagation"], "algorithm_seeds": {"label_propagation": [11]}, "dropout": [{"rate": 0.0, "seeds": [0]}, {"rate": 0.4, "seeds": [123]}]},
            {"name": "sampled", "scope": "sample", "sample_profile": "tiny", "algorithms": ["spectral"], "algorithm_seeds": {"spectral": [11, 37]}},
            {"name": "guarded", "scope": "full", "algorithms": ["girvan_newman"], "algorithm_seeds": {"girvan_newman": [42]}, "algorithm_options": {"girvan_newman": {"gn_max_n": 5}}},
        ],
    }
    (tmp_path / "suite.json").write_text(json.dumps(config))
    base = ["--base", str(tmp_path)]
    assert main(["prepare", "--config", "datasets.json", *base]) == 0
    told = json.loads((tmp_path / "processed/manifest.json").read_text())["datasets"][0]
    assert (told["n"], told["m"], told["components"], told["isolated_nodes"], told["max_degree"]) == (6, 7, 1, 0, 3) and told == json.loads((tmp_path / "processed/toy/metadata.json").read_text())
    assert told["sha256"] == hashlib.sha256((tmp_path / told["graph"]).read_bytes()).hexdigest() and told["source_files"][0]["path"] == "toy.gml"
    assert [(s["profile"], s["seed"], s["n"], s["sampling"]) for s in told["samples"]] == [("tiny", 17, 4, prepare.WALK)]
    assert (tmp_path / told["reference"]).read_text() == "node_id\tlabel\n0\t0\n1\t0\n2\t0\n3\t1\n4\t1\n5\t1\n"
    assert (tmp_path / told["node_ids"]).read_text().splitlines()[:2] == ["node_id\toriginal_id", "0\t0"]

    assert main(["experiments", "--config", "suite.json", "--dry-run", *base]) == 0
    assert not (tmp_path / "results").exists() and "9 jobs" in capsys.readouterr().out
    assert main(["experiments", "--config", "suite.json", *base]) == 0
    index = executor.read_index(str(tmp_path / "results"))
    assert len(index) == 9 and {r["status"] for r in index} == {"ok", "skipped_resource_guard"}
    summary = json.loads((tmp_path / next(r["summary"] for r in index if r["protocol"] == "smoke" and r["algorithm"] == "girvan_newman")).read_text())
    assert summary["num_communities"] == 2 and summary["external"]["ari"] == 1 and abs(summary["modularity_q1"] - 5 / 14) < 1e-9 and summary["parameters"]["laplacian"] == "not_applicable"

    assert main(["summarize", "--manifest", "processed/manifest.json", *base]) == 0
    ready = json.loads((tmp_path / "results/report_ready.json").read_text())
    found = {n: table(tmp_path / p) for n, p in ready["files"].items()}
    assert len(found) == 11 and len(found["runs"]) == 8 and {r["algorithm"] for r in found["runs"]} == set(ALL)
    assert all(float(r["wall_seconds"]) > 0 and r["external.ari"] != "NA" for r in found["runs"])
    assert next(r for r in found["runs"] if r["algorithm"] == "girvan_newman")["external.ami_arithmetic"] == "1.0"
    assert {r["algorithm"] for r in found["stability_pairs"]} == {"spectral"} and len(found["stability_pairs"]) == 2 and float(found["stability_pairs"][0]["ari"]) == 1
    assert {r["sample_profile"] for r in found["sample_aggregate"]} == {"tiny"} and found["sample_stability_summary"][0]["sample_scopes"] == "1"
    assert [(r["dropout_rate"], r["removed_edges"]) for r in found["robustness_pairs"]] == [("0.4", "3")] and len(found["robustness_summary"]) == 1
    assert [r["status"] for r in found["skipped"]] == ["skipped_resource_guard"] and found["datasets"][0]["source_file_count"] == "1"
    assert sum(int(r["runs"]) for r in found["aggregate"]) == 8 and len(found["communities"]) == sum(int(r["num_communities"]) for r in found["runs"])

    # what is done is kept, a run that fails leaves its story, and results of other settings don't mix
    broken = next(r for r in index if r["protocol"] == "sampled")
    (tmp_path / broken["summary"]).unlink()
    assert main(["experiments", "--config", "suite.json", "--resume", "--protocol", "sampled", *base]) == 0
    again = {r["job_id"]: r["status"] for r in executor.read_index(str(tmp_path / "results"))}
    assert len(again) == 9 and again.pop(broken["job_id"]) == "ok" and sorted(again.values()).count("existing") == 1
    (tmp_path / told["graph"]).write_bytes(b"broken")
    assert main(["experiments", "--config", "suite.json", "--protocol", "smoke", "--max-jobs", "1", *base]) == 1
    failed = next(r for r in executor.read_index(str(tmp_path / "results")) if r["status"] == "failed")
    assert "not a binary graph" in failed["stderr"] and (tmp_path / failed["output_dir"] / "failure.json").exists()
    (tmp_path / "suite.json").write_text(json.dumps(config | {"dataset_settings": {"toy": {"spectral_k": [3], "girvan_newman_k": [2]}}}))
    assert main(["experiments", "--config", "suite.json", *base]) == 2 and "provenance" in capsys.readouterr().err


def test_agreement_by_key_equals_that_of_each(spark):
    rows = [(j, n, (n * (j + 3)) % (2 + j), (n * 5) % 3) for j in range(5) for n in range(20)]
    cells = metrics.contingency(spark.createDataFrame([(j, n, p) for j, n, p, _ in rows], "job long, node long, label int"), spark.createDataFrame([(j, n, r) for j, n, _, r in rows], "job long, node long, label int"), ("job",))
    together = {r.job: r for r in metrics.agreement_of(cells, ("job",)).join(metrics.information_of(cells, ("job",)), "job").collect()}
    for j in range(5):
        p, r = (spark.createDataFrame([(x[1], x[k]) for x in rows if x[0] == j], "node long, label int") for k in (2, 3))
        alone = metrics.agreement(p, r).crossJoin(metrics.adjusted_mutual_information(p, r)).first().asDict()
        assert {k: v for k, v in together[j].asDict().items() if k != "job"} == pytest.approx(alone, abs=1e-9)
    with pytest.raises(GraphError):
        metrics.agreement(p, r.where("node > 0"))


def test_datasets_that_cannot_be(spark, tmp_path):
    (tmp_path / "toy.gml").write_text(GML)
    toy = {"name": "toy", "format": "gml", "path": "toy.gml"}
    for bad in ([toy, toy], [toy | {"name": "../x"}], [toy | {"format": "other"}], [toy | {"samples": [{"name": "a b", "size": 2}]}], [toy | {"samples": [{"name": "a", "size": 2, "seeds": [1, 1]}]}], [toy | {"reference": "builtin_karate"}]):
        with pytest.raises(GraphError):
            prepare.prepare(spark, {"datasets": bad, "output_dir": "out"}, str(tmp_path))
    with pytest.raises(GraphError):
        prepare.prepare(spark, {"datasets": [toy]}, str(tmp_path), ["other"])
    with pytest.raises(GraphError):
        results.read_runs(spark, [], str(tmp_path))


def test_karate_reference(spark, tmp_path):
    (tmp_path / "k.gml").write_text("\n".join(f"node [ id {i} ]" for i in range(34, 0, -1)) + "\n" + "\n".join(f"edge [ source {i} target {i + 1} ]" for i in range(1, 34)))
    graph, ids, reference = files.read_gml(spark, str(tmp_path / "k.gml"), reference="builtin_karate")
    clubs = {int(r.original_id): r.label for r in ids.join(reference, "node").collect()}
    assert graph.num_edges() == 33 and {m for m, c in clubs.items() if c == 0} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 17, 18, 20, 22}
