from collections import defaultdict, deque
from fractions import Fraction

from sparkweave.plans import registry
from sparkweave.sources import tables

SF = "/root/testdata/sf0.001"


def brute(edges):
    """Betweenness by counting shortest paths from every node."""
    near, score = defaultdict(set), defaultdict(Fraction)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    for s in near:
        far, ways, order, queue = {s: 0}, defaultdict(int, {s: 1}), [], deque([s])
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in near[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
                if far[y] == far[x] + 1:
                    ways[y] += ways[x]
        rest = defaultdict(Fraction)
        for y in reversed(order):
            for x in near[y]:
                if far[x] == far[y] - 1:
                    part = Fraction(ways[x], ways[y]) * (1 + rest[y])
                    score[min(x, y), max(x, y)] += part / 2
                    rest[x] += part
    return score


def test_whole_graph(spark):
    graph = tables.planted(spark, SF)
    nodes = {r.node for r in graph.vertices.collect()}
    assert len(nodes) == spark.read.parquet(f"{SF}/customer.parquet").count() > 100
    rows = registry.QUERIES["lpa_async"](spark, SF).collect()
    assert len(rows) == len(nodes) and {r.node for r in rows} == nodes
    want = brute([(r.u, r.v) for r in graph.edges.collect()])
    got = {(r.u, r.v): r.score for r in registry.QUERIES["edge_betweenness_customers"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - float(want[e])) < 1e-6 for e in want)


def test_queries_equal_their_sql(spark):
    """As the driver compares them, at the smallest scale."""
    import duckdb

    con = duckdb.connect()
    for name in ("nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v
    for name in ("girvan_newman_k", "spectral_k", "edge_betweenness", "stability_summary", "sample_stability_summary", "robustness_pairs", "robustness_summary", "aggregate_runs", "sample_aggregate", "skipped_runs", "dataset_table", "jobs_matrix", "guard_status", "graph_metadata", "partition_metrics", "edge_dropout"):
        rows = registry.QUERIES[name](spark, SF)
        columns = sorted(rows.columns)
        found = con.execute(registry.ORACLES[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
        assert sorted((tuple(map(plain, r)) for r in rows.select(*columns).collect()), key=str) == want, name


def test_equal_partitions_are_compared_once(spark, monkeypatch):
    """40 runs of two kinds and one that differs by a label; only pairs that begin with a sample's run, where these are asked for."""
    from sparkweave.operators import metrics
    from sparkweave.plans import results

    names = [f"'x' AS `{n}`" for n in results.GROUP]
    runs = spark.range(41).selectExpr("concat('j', lpad(id, 2, '0')) AS job_id", *names, "IF(id % 2 = 0, 'p', NULL) AS sample_profile", "id AS sample_seed", "id AS algorithm_seed", "0.0D AS dropout_rate")
    labels = spark.range(41).selectExpr("id", "concat('j', lpad(id, 2, '0')) AS job_id", "explode(sequence(0L, 5L)) AS node").selectExpr("job_id", "node", "CAST(IF(id = 40 AND node = 0, 9, node % (2 + id % 2)) AS INT) AS label")
    cells, plain = [], metrics.contingency
    monkeypatch.setattr(metrics, "contingency", lambda *a: cells.append(plain(*a)) or cells[-1])
    every = {(r.left_job_id, r.right_job_id): r for r in results.stability_pairs(runs, labels).collect()}
    assert len(every) == 41 * 20 and cells[0].select("left_kind", "right_kind").distinct().count() == 6
    by_run = {}
    for r in labels.collect():
        by_run.setdefault(r.job_id, {})[r.node] = r.label
    for a, b in (("j00", "j02"), ("j00", "j01"), ("j01", "j02"), ("j01", "j40"), ("j00", "j40")):
        one, two = (spark.createDataFrame(list(by_run[x].items()), "node long, label int") for x in (a, b))
        assert abs(every[a, b].ari - metrics.agreement(one, two).first().ari) < 1e-12
        assert abs(every[a, b].ami_arithmetic - metrics.adjusted_mutual_information(one, two).first().ami) < 1e-12
    some = results.stability_pairs(runs, labels, sampled=True).collect()
    assert {(r.left_job_id, r.right_job_id) for r in some} == {k for k, r in every.items() if r.sample_profile}
    one = results.sample_stability_summary(results.stability_pairs(runs, labels)).first()
    two = results.sample_stability_summary(results.stability_pairs(runs, labels, sampled=True)).first()
    plain = lambda row: [round(v, 9) if isinstance(v, float) else v for v in row]
    assert plain(one) == plain(two) and one.sample_scopes == 20 and one.partition_pairs == len(some)


def test_betweenness_on_rings_of_cliques(spark):
    """Rings by running sums, and what isn't one by its sources; both against counting."""
    import numpy as np

    from sparkweave.graph import Graph
    from sparkweave.operators import girvan_newman

    rng, rings = np.random.default_rng(1), 0
    for t in range(60):
        edges, n = [], 0
        for _ in range(rng.integers(1, 4)):
            size, base = int(rng.integers(4, 9)), n
            n += size
            for i in range(size):
                a, b = base + i, base + (i + 1) % size
                block = range(n, n + int(rng.integers(0, 4)))
                edges += [(a, b), *((x, y) for x in block for y in (a, b)), *((x, y) for x in block for y in block if x < y)]
                n += len(block)
        whole = t % 4 > 0
        if not whole:
            edges.append(tuple(rng.choice(n, 2, replace=False).tolist()))  # a chord, or an edge to elsewhere
        names = rng.permutation(n).tolist()
        edges = sorted({(min(names[u], names[v]), max(names[u], names[v])) for u, v in edges})
        score, want = girvan_newman._on_rings(n, np.array(edges)), brute(edges)
        assert score is not None or not whole
        rings += score is not None
        if score is not None:
            assert all(abs(s - float(want[e])) < 1e-9 for s, e in zip(score, edges, strict=True))
        elif rings < 10:
            found = girvan_newman.betweenness(Graph.dense(spark, n, edges)).collect()
            assert len(found) == len(edges) and all(abs(r.score - float(want[r.u, r.v])) < 1e-9 for r in found)
    assert rings >= 45
