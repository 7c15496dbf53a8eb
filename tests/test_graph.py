import gzip
import random
import struct

import numpy as np
import pytest

from sparkweave.graph import Graph, GraphError
from sparkweave.operators import girvan_newman, label_propagation, louvain, metrics, partition, spectral, transform
from sparkweave.sources import files

TOY = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]


@pytest.fixture(scope="module")
def toy(spark):
    return Graph.dense(spark, 6, TOY)


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "node long, label int")


def told(labels):
    return [r.label for r in labels.orderBy("node").collect()]


def test_edges_merge_and_degrees(spark):
    graph = Graph.dense(spark, 3, [(0, 1, 1), (1, 0, 2), (1, 2, 1)])
    assert graph.num_edges() == 2 and graph.edge_weight(1, 0) == 3 and graph.is_weighted()
    assert {r.node: r.degree for r in graph.degrees().collect()} == {0: 3, 1: 4, 2: 1}
    assert graph.remove_edge(1, 0).num_edges() == 1 and graph.has_edge(2, 1) and not graph.has_edge(0, 2)
    loops = Graph.dense(spark, 2, [(0, 0, 3), (1, 1, 3), (0, 1, 1)])
    assert loops.max_degree() == 7
    assert metrics.modularity(loops, labelled(spark, [0, 1])) == pytest.approx(5 / 14)
    for bad in ([(0, 5)], [(0, 1, -1)], [(0, 1, float("nan"))]):
        with pytest.raises(GraphError):
            Graph.dense(spark, 3, bad)


def test_metrics_by_hand(spark, toy):
    two = labelled(spark, [0, 0, 0, 1, 1, 1])
    row = metrics.partition_metrics(toy, two, 2.0).first()
    assert row.coverage == pytest.approx(6 / 7) and row.ratio_cut == pytest.approx(2 / 3) and row.normalized_cut == pytest.approx(2 / 7)
    assert row.modularity_q_gamma == pytest.approx(-1 / 7) and row.singletons == 0 and row.isolated_nodes == 0
    assert row.density_distribution.median == 1
    for r in metrics.community_table(toy, two).collect():
        assert (r.size, r.internal_edges, r.internal_weight, r.boundary_weight, r.volume, r.density) == (3, 3, 3, 1, 7, 1)
        assert r.conductance == pytest.approx(1 / 7)
    assert metrics.modularity(toy, labelled(spark, range(6))) == pytest.approx(-34 / 196)
    none = metrics.partition_metrics(Graph.empty(spark, 2), labelled(spark, [0, 1])).first()
    assert none.coverage is None and none.normalized_cut is None and none.modularity_q_gamma == 0 and none.isolated_nodes == 2


def test_agreement_by_hand(spark):
    ref = labelled(spark, [0, 0, 0, 1, 1, 1])
    row = metrics.agreement(labelled(spark, [7, 7, 7, 3, 3, 3]), ref).first()
    assert row.pairwise_precision == row.pairwise_recall == row.pairwise_f1 == row.ari == 1
    row = metrics.agreement(labelled(spark, [0] * 6), ref).first()
    assert (row.a, row.b, row.pairwise_precision, row.pairwise_recall, row.ari) == (6, 9, 0.4, 1, 0) and row.pairwise_f1 == pytest.approx(4 / 7)
    row = metrics.agreement(labelled(spark, [0]), labelled(spark, [0])).first()
    assert row.ari == row.pairwise_f1 == 1 and row.pairwise_precision is None
    row = metrics.adjusted_mutual_information(labelled(spark, [0, 0, 0, 1, 1, 2]), ref).first()
    assert row.expected_mutual_information == pytest.approx(0.268086368715) and row.ami == pytest.approx(0.727607893091)


def test_dropout(spark, toy):
    assert transform.splitmix64(0) == 16294208416658607535 and transform.splitmix64(1) == 10451216379200822465
    drawn = {(r.u, r.v): r.uniform for r in transform.with_uniform(toy.edges, 123).collect()}
    want = [0.903939229738, 0.061562464350, 0.796729828146, 0.892337263703, 0.432799000209, 0.244886069895, 0.084401500232]
    assert [drawn[e] for e in TOY] == pytest.approx(want)
    left, removed = transform.drop_edges(toy, 0.4, 123)
    assert removed == 3 and left.num_edges() == 4 and left.num_nodes() == 6
    assert transform.drop_edges(toy, 0, 5)[1] == 0
    with pytest.raises(GraphError):
        transform.drop_edges(toy, 1.0, 5)


def test_components_samples_contraction(spark, toy):
    cut = toy.remove_edge(2, 3)
    assert told(partition.connected_components(cut)) == [0, 0, 0, 1, 1, 1]
    assert told(partition.split_disconnected(cut, labelled(spark, [9, 9, 9, 9, 9, 2]))) == [0, 0, 0, 1, 1, 2]
    assert transform.largest_component(Graph.dense(spark, 6, [(4, 5), (0, 1)]))[1].orderBy("old").first().old == 0
    small = transform.contract(toy, labelled(spark, [0, 0, 0, 1, 1, 1]))
    assert {(r.u, r.v): r.weight for r in small.edges.collect()} == {(0, 0): 3, (1, 1): 3, (0, 1): 1}
    assert transform.snowball(toy, 4, 17).distinct().count() == 4
    adjacency = toy.adjacency().orderBy("src", "dst").collect()
    offsets = np.concatenate([[0], np.cumsum(np.bincount([r.src for r in adjacency], minlength=6))])
    sample = transform.snowball_exact(6, offsets, np.array([r.dst for r in adjacency]), 4, 17)
    assert len(set(sample.tolist())) == 4 and transform.induced(toy, spark.createDataFrame([(int(x),) for x in sample], "node long"))[0].num_nodes() == 4
    with pytest.raises(GraphError):
        partition.check_cover(toy, labelled(spark, [0]))


def test_label_propagation(spark, toy):
    found = label_propagation.run(toy, label_propagation.Config(asynchronous=False, random_ties=False))
    assert told(found.labels) == [0, 0, 0, 1, 1, 1] or found.diagnostics["iterations"] == 3
    assert found.diagnostics == {"iterations": 3.0, "converged": 1.0}
    with pytest.raises(GraphError):
        label_propagation.run(toy, label_propagation.Config(max_iterations=0))


def test_asynchronous_label_propagation_by_hand(spark):
    """One node after another, by colour, with the hashes that the engine uses."""
    edges = [(a, b) for g in range(4) for a in range(5 * g, 5 * g + 5) for b in range(a + 1, 5 * g + 5)] + [(4, 5), (9, 10), (14, 15), (0, 19), (2, 7)]
    config = label_propagation.Config(max_iterations=6, split_disconnected_labels=False, seed=3)
    found = label_propagation.run(Graph.dense(spark, 21, edges), config)
    near = {n: [b for a, b in edges if a == n] + [a for a, b in edges if b == n] for n in range(21)}
    label, steps, converged = {n: n for n in range(21)}, 0, False
    modes = lambda n: [x for x in {label[m] for m in near[n]} if sum(label[m] == x for m in near[n]) == max(sum(label[m] == y for m in near[n]) for y in {label[m] for m in near[n]})]
    grid = spark.range(21).selectExpr("id AS node").crossJoin(spark.range(21).selectExpr("id AS label"))
    while steps < 6 and not converged:
        steps += 1
        colour = {r.node: r.c for r in spark.range(21).selectExpr("id AS node", f"pmod(xxhash64(3, {steps}, id), 4) AS c").collect()}
        key = {(r.node, r.label): r.k for r in grid.selectExpr("*", f"xxhash64(3, {steps}, node, label) AS k").collect()}
        for c in range(4):
            moved = {n: min(modes(n), key=lambda x: (key[n, x], x)) for n in range(21) if colour[n] == c and near[n]}
            label |= moved
        converged = all(label[n] in modes(n) for n in range(21) if near[n])
    first = {}
    assert told(found.labels) == [first.setdefault(label[n], len(first)) for n in range(21)]
    assert found.diagnostics == {"iterations": float(steps), "converged": float(converged)}


def test_louvain_never_gets_worse(spark, toy):
    on_driver = louvain.Config(driver_edges=10_000)
    assert told(louvain.run(toy, louvain.Config(shuffle_nodes=False, driver_edges=10_000)).labels) == [0, 0, 0, 1, 1, 1]
    rng = random.Random(4)
    graphs = [(9 * g + a, 9 * g + b) for g in range(100) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.28]
    graph = Graph.dense(spark, 900, graphs)
    found = louvain.run(graph)
    last = metrics.modularity(graph, labelled(spark, range(900)))
    for level in range(int(found.diagnostics["levels"])):
        now = metrics.modularity(graph, found.hierarchy.where(f"level = {level}").select("node", "label"))
        assert now >= last - 1e-10
        last = now
    assert found.objective > 0.97 * louvain.run(graph, on_driver).objective


def test_louvain_in_bulk_at_a_hub(spark):
    star = Graph.dense(spark, 61, [(0, i) for i in range(1, 61)])
    found = louvain.run(star)
    assert found.objective >= -1e-12 and found.diagnostics["local_passes"] < 25
    ring = Graph.dense(spark, 40, [(a, b) for g in range(8) for a in range(5 * g, 5 * g + 5) for b in range(a + 1, 5 * g + 5)] + [(5 * g, (5 * g + 6) % 40) for g in range(8)])
    assert told(louvain.run(ring).labels) == [i // 5 for i in range(40)]


def test_betweenness_and_division(spark, toy):
    scores = {(r.u, r.v): r.score for r in girvan_newman.betweenness(toy).collect()}
    assert scores == pytest.approx({(0, 1): 1, (0, 2): 4, (1, 2): 4, (2, 3): 9, (3, 4): 4, (3, 5): 4, (4, 5): 1})
    found = girvan_newman.run(toy, girvan_newman.Config(target_communities=2))
    assert told(found.labels) == [0, 0, 0, 1, 1, 1] and found.diagnostics == {"edges_removed": 1.0, "hierarchy_levels": 2.0}
    assert girvan_newman.run(toy).objective == pytest.approx(5 / 14)
    with pytest.raises(GraphError):
        girvan_newman.run(toy, girvan_newman.Config(max_n=3))


@pytest.mark.parametrize("laplacian", [spectral.NORMALIZED, spectral.UNNORMALIZED])
@pytest.mark.parametrize("dense", [256, 1])
def test_spectral(spark, toy, laplacian, dense):
    found = spectral.run(toy, spectral.Config(laplacian=laplacian, dense_solver_threshold=dense))
    assert told(found.labels) == [0, 0, 0, 1, 1, 1] and found.diagnostics["eigensolver_max_residual"] < 1e-6
    assert found.objective == pytest.approx(2 / 7 if laplacian == spectral.NORMALIZED else 2 / 3)


@pytest.mark.parametrize("laplacian", [spectral.NORMALIZED, spectral.UNNORMALIZED])
def test_spectral_matrix_on_the_cluster(spark, laplacian):
    edges = [(a, b, 1.0 + (a + b) % 3) for g in range(3) for a in range(6 * g, 6 * g + 6) for b in range(a + 1, 6 * g + 6)] + [(5, 6, 1.0), (11, 12, 1.0)]
    graph = Graph.dense(spark, 19, edges)
    ids = graph.edges.select(graph.edges.u.alias("i"), graph.edges.v.alias("j"), "weight")
    near = spectral.Operator(19, *np.array([e[:2] for e in sorted(edges)]).T, np.array([e[2] for e in sorted(edges)]), laplacian)
    far = spectral.ClusterOperator(19, ids, laplacian)
    x = np.random.default_rng(1).normal(size=19)
    assert np.allclose(far(x), near(x)) and far.shift == near.shift
    found = spectral.run(Graph.dense(spark, 18, edges), spectral.Config(num_communities=3, dense_solver_threshold=1, lanczos_basis_size=12, laplacian=laplacian, matrix=spectral.CLUSTER, kmeans_restarts=5))
    assert told(found.labels) == [i // 6 for i in range(18)] and found.diagnostics["eigensolver_backend"] == 1


def test_spectral_blocks(spark):
    edges = [(b * 100 + i, b * 100 + (i + k) % 100) for b in range(3) for i in range(100) for k in (1, 2, 3)] + [(99, 100), (199, 200)]
    found = spectral.run(Graph.dense(spark, 300, edges), spectral.Config(num_communities=3, seed=20260824, kmeans_restarts=5))
    assert told(found.labels) == [i // 100 for i in range(300)]
    assert found.diagnostics["eigensolver_basis_size"] == 128 and found.diagnostics["eigensolver_max_residual"] < 1e-6


def test_binary_files(spark, toy, tmp_path):
    path = str(tmp_path / "toy.graph")
    assert files.write_binary(toy, path) == 7
    back = files.read_binary(spark, path, records=3)
    assert sorted((r.u, r.v) for r in back.edges.collect()) == TOY and back.num_nodes() == 6 and not back.is_weighted()
    loops = Graph.dense(spark, 2, [(0, 0, 3), (1, 1, 3), (0, 1, 1)])
    files.write_binary(loops, path + "2")
    assert files.read_binary(spark, path + "2").edge_weight(1, 1) == 3
    (tmp_path / "bad").write_bytes(files.HEADER.pack(files.MAGIC, 3, 2, 0) + struct.pack("<4I", 1, 2, 0, 1))
    with pytest.raises(Exception, match="out of order"):
        files.read_binary(spark, str(tmp_path / "bad")).num_edges()
    (tmp_path / "short").write_bytes(b"x")
    with pytest.raises(GraphError):
        files.read_binary(spark, str(tmp_path / "short"))


def test_text_files(spark, tmp_path):
    gml = "graph [\n" + "".join(f' node [ id {i} value "{"ab"[i > 2]}" ]\n' for i in range(6)) + "".join(f" edge [ source {u} target {v} ]\n" for u, v in TOY) + "]"
    (tmp_path / "toy.gml").write_text(gml)
    graph, _, reference = files.read_gml(spark, str(tmp_path / "toy.gml"))
    assert graph.num_nodes() == 6 and graph.num_edges() == 7 and told(reference) == [0, 0, 0, 1, 1, 1]
    with gzip.open(tmp_path / "edges.txt.gz", "wt") as f:
        f.write("# a comment\n% another\n10 2\n2 10 extra\nx 10\n5 5\n")
    graph, ids, _ = files.read_edge_list(spark, str(tmp_path / "edges.txt.gz"))
    assert [r.original_id for r in ids.orderBy("node").collect()] == ["2", "10", "x"] and graph.num_edges() == 2
    (tmp_path / "labels.tsv").write_text("node_id\tlabel\n# c\n\n1\t5\n0\t9\n")
    assert told(files.read_labels(spark, str(tmp_path / "labels.tsv"), 2)) == [0, 1]
    with pytest.raises(GraphError):
        files.read_labels(spark, str(tmp_path / "labels.tsv"), 3)
    (tmp_path / "bare.tsv").write_text("node\n7\n\n7 \n3\n# end\n")
    assert told(files.read_labels(spark, str(tmp_path / "bare.tsv"), 3)) == [0, 0, 1]
    for bad in ("0 1\n0 2\n1 1\n", "0 1\n5 1\n", "0 x\n1 1\n", "a 1\n1 1\n"):
        (tmp_path / "bad.tsv").write_text(bad)
        with pytest.raises(GraphError):
            files.read_labels(spark, str(tmp_path / "bad.tsv"), 2)
    np.savez(tmp_path / "adj_full.npz", data=np.ones(4), indices=[1, 0, 2, 1], indptr=[0, 1, 3, 4], shape=[3, 3])
    (tmp_path / "class_map.json").write_text('{"0": [0, 1], "1": [1, 0], "2": 1}')
    graph, _, reference = files.read_sparse_archive(spark, str(tmp_path))
    assert graph.num_edges() == 2 and told(reference) == [1, 0, 1]
    files.ENTRIES, held = 3, files.ENTRIES
    try:
        assert files.read_sparse_archive(spark, str(tmp_path))[0].num_edges() == 2
    finally:
        files.ENTRIES = held


def test_sparse_arrays(spark):
    graph = Graph.from_csr(spark, [0, 2, 4, 5], [0, 1, 0, 2, 1], [2.0, 1.0, 1.0, 3.0, 3.0])
    assert sorted((r.u, r.v, r.weight) for r in graph.edges.collect()) == [(0, 0, 2.0), (0, 1, 1.0), (1, 2, 3.0)] and graph.is_weighted()
    for bad in (([0, 1, 1], [1]), ([0, 1, 2], [1, 1]), ([0, 2, 3], [1, 1, 0]), ([1, 1], []), ([0, 1, 2], [1, 0], [1.0, 2.0])):
        with pytest.raises(GraphError):
            Graph.from_csr(spark, *bad)


def test_isolated_nodes_count(spark):
    lonely = Graph.dense(spark, 5, [(0, 1)])
    assert transform.graph_metadata(lonely).first().isolated_nodes == 3 and metrics.partition_metrics(lonely, labelled(spark, [0, 0, 1, 2, 3])).first().isolated_nodes == 3
    with pytest.raises(GraphError):
        metrics.partition_metrics(lonely, labelled(spark, [0, 0, 1]))
