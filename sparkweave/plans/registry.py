"""Named queries over the driver's tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.operators import girvan_newman, label_propagation, louvain, metrics, partition, spectral, transform
from sparkweave.plans import jobs, results
from sparkweave.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}

CO = """l AS (SELECT DISTINCT l_orderkey, l_partkey AS part FROM lineitem),
e AS (SELECT a.part AS u, b.part AS v, 1.0::DOUBLE AS weight FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.part < b.part GROUP BY 1, 2 HAVING count(*) >= 2),
v AS (SELECT DISTINCT node FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e)),
adj AS (SELECT u AS src, v AS dst, weight FROM e UNION ALL SELECT v, u, weight FROM e),
deg AS (SELECT v.node, coalesce(sum(adj.weight), 0)::DOUBLE AS degree FROM v LEFT JOIN adj ON adj.src = v.node GROUP BY 1)"""
LABELS = ", p AS (SELECT node, (node % 7)::INT AS label FROM v), ref AS (SELECT node, (node % 5)::INT AS label FROM v)"
RING = """v AS (SELECT c_custkey AS node FROM customer), n AS (SELECT count(*) AS n FROM v),
e AS (SELECT a.node AS u, b.node AS v, 1.0::DOUBLE AS weight FROM v a JOIN v b ON a.node // 10 = b.node // 10 AND a.node < b.node
  UNION ALL SELECT least(node, (node + 1) % n), greatest(node, (node + 1) % n), 1.0 FROM v, n WHERE node % 10 = 9),
adj AS (SELECT u AS src, v AS dst, weight FROM e UNION ALL SELECT v, u, weight FROM e)"""
REACH = """c AS (SELECT node, node AS hit FROM v UNION SELECT c.node, adj.dst FROM c JOIN adj ON adj.src = c.hit),
root AS (SELECT node, min(hit) AS component FROM c GROUP BY 1)"""
COMMUNITY = """, s AS (SELECT label, count(*) AS size FROM p GROUP BY 1),
x AS (SELECT a.label AS lu, b.label AS lv, e.u, e.v, weight FROM e JOIN p a ON a.node = e.u JOIN p b ON b.node = e.v),
i AS (SELECT lu AS label, sum(weight) AS w, count(*) FILTER (u <> v) AS k FROM x WHERE lu = lv GROUP BY 1),
o AS (SELECT label, sum(weight) AS w FROM (SELECT lu AS label, weight FROM x WHERE lu <> lv UNION ALL SELECT lv, weight FROM x WHERE lu <> lv) GROUP BY 1),
d AS (SELECT label, sum(degree) AS vol FROM p JOIN deg USING (node) GROUP BY 1), m AS (SELECT sum(weight) AS m FROM e),
t AS (SELECT s.label AS community, size::BIGINT AS size, coalesce(k, 0)::BIGINT AS internal_edges, coalesce(i.w, 0)::DOUBLE AS internal_weight, coalesce(o.w, 0)::DOUBLE AS boundary_weight,
  vol::DOUBLE AS volume, CASE WHEN size >= 2 THEN 2.0::DOUBLE * coalesce(k, 0) / (size * (size - 1)) END AS density,
  CASE WHEN least(vol, 2 * m - vol) > 0 THEN coalesce(o.w, 0) / least(vol, 2 * m - vol) END AS conductance, m
  FROM s LEFT JOIN i USING (label) LEFT JOIN o USING (label) JOIN d USING (label), m)"""
CELLS = """, j AS (SELECT p.label AS p, ref.label AS r, count(*) AS n FROM p JOIN ref USING (node) GROUP BY 1, 2),
jp AS (SELECT p, sum(n) AS a FROM j GROUP BY 1), jr AS (SELECT r, sum(n) AS b FROM j GROUP BY 1), nn AS (SELECT sum(n)::DOUBLE AS n FROM j)"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: All parts that any two lines of an order have in common are nodes here, so that those without an edge are isolated.
ALL_PARTS = CO.replace("v AS (SELECT DISTINCT node FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e))", "v AS (SELECT DISTINCT part AS node FROM l)")


def _nine(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query(f"WITH {CO} SELECT * FROM e")
def edges_canonical(spark, sf_dir):
    return tables.parts_co(spark, sf_dir).edges


@query(f"WITH {CO} SELECT node, degree FROM deg")
def degree_stats(spark, sf_dir):
    return tables.parts_co(spark, sf_dir).degrees()


@query(f"WITH RECURSIVE {ALL_PARTS}, {REACH} SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m, count(*) FILTER (degree = 0) AS isolated_nodes, min(degree)::BIGINT AS min_degree, max(degree)::BIGINT AS max_degree, round(avg(degree), 9) AS mean_degree, (SELECT count(DISTINCT component) FROM root) AS components FROM deg")
def graph_metadata(spark, sf_dir):
    return _nine(transform.graph_metadata(tables.parts_co(spark, sf_dir, isolated=True)), "mean_degree")


@query(f"WITH RECURSIVE {CO}, {REACH} SELECT node, (dense_rank() OVER (ORDER BY component) - 1)::INT AS label FROM root")
def connected_components(spark, sf_dir):
    return partition.connected_components(tables.parts_co(spark, sf_dir))


@query(f"WITH RECURSIVE {CO}, {REACH}, b AS (SELECT component FROM root GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), k AS (SELECT node AS old, row_number() OVER (ORDER BY node) - 1 AS node FROM root JOIN b USING (component)) SELECT x.node AS u, y.node AS v, weight FROM e JOIN k x ON x.old = e.u JOIN k y ON y.old = e.v")
def largest_component(spark, sf_dir):
    return transform.largest_component(tables.parts_co(spark, sf_dir))[0].edges


@query(f"WITH RECURSIVE {CO}{LABELS}, inside AS (SELECT adj.* FROM adj JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE a.label = b.label), c AS (SELECT node, node AS hit FROM v UNION SELECT c.node, inside.dst FROM c JOIN inside ON inside.src = c.hit), root AS (SELECT node, min(hit) AS component FROM c GROUP BY 1) SELECT node, (dense_rank() OVER (ORDER BY component) - 1)::INT AS label FROM root")
def split_communities(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return partition.split_disconnected(graph, tables.by_modulus(graph, 7))


def _splitmix_sql(x: str) -> str:
    a = f"((({x})::UHUGEINT + 11400714819323198485) % 18446744073709551616)::UBIGINT"
    b = f"((xor({a}, {a} >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT"
    c = f"((xor({b}, {b} >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT"
    return f"xor({c}, {c} >> 31)"


@query(f"WITH {CO}, h AS (SELECT *, {_splitmix_sql('(u::UBIGINT << 32) | v::UBIGINT')} AS h FROM e), g AS (SELECT *, {_splitmix_sql('xor(7::UBIGINT, h)')} AS g FROM h) SELECT u, v, weight FROM g WHERE (g >> 11)::DOUBLE / 9007199254740992 >= 0.05")
def edge_dropout(spark, sf_dir):
    return transform.drop_edges(tables.parts_co(spark, sf_dir), 0.05, 7)[0].edges


@query(f"WITH {CO}{LABELS}, f AS (SELECT label, min(node) AS first FROM p GROUP BY 1), r AS (SELECT label, (row_number() OVER (ORDER BY first) - 1)::INT AS n FROM f) SELECT node, n AS label FROM p JOIN r USING (label)")
def normalize_labels(spark, sf_dir):
    return partition.normalize(tables.by_modulus(tables.parts_co(spark, sf_dir), 7))


@query(f"WITH {CO}, k AS (SELECT node AS old, row_number() OVER (ORDER BY node) - 1 AS node FROM v WHERE node % 3 <> 0) SELECT x.node AS u, y.node AS v, weight FROM e JOIN k x ON x.old = e.u JOIN k y ON y.old = e.v")
def induced_subgraph(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return transform.induced(graph, graph.vertices.where("node % 3 <> 0"))[0].edges


@query(f"WITH {CO}{LABELS} SELECT least(a.label, b.label)::BIGINT AS u, greatest(a.label, b.label)::BIGINT AS v, sum(weight) AS weight FROM e JOIN p a ON a.node = e.u JOIN p b ON b.node = e.v GROUP BY 1, 2")
def contract_graph(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return transform.contract(graph, tables.by_modulus(graph, 7)).edges


@query(f"WITH {CO}{LABELS}{COMMUNITY} SELECT * EXCLUDE (m) REPLACE (round(density, 9) AS density, round(conductance, 9) AS conductance) FROM t")
def community_table(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return _nine(metrics.community_table(graph, tables.by_modulus(graph, 7)), "density", "conductance")


@query(f"WITH {CO}{LABELS}{COMMUNITY} SELECT round(sum(internal_weight) / any_value(m) - 2 * sum(volume * volume) / (4 * any_value(m) * any_value(m)), 9) AS modularity FROM t")
def modularity(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return _nine(metrics.modularity_of(metrics.community_table(graph, tables.by_modulus(graph, 7)), 2.0), "modularity")


@query(f"WITH {ALL_PARTS}{LABELS}{COMMUNITY} SELECT count(*) AS num_communities, count(*) FILTER (size = 1) AS singletons, round(sum(internal_weight) / any_value(m), 9) AS coverage, round(sum(boundary_weight / size), 9) AS ratio_cut, round(sum(boundary_weight / volume), 9) AS normalized_cut, round(sum(internal_weight) / any_value(m) - sum(volume * volume) / (4 * any_value(m) * any_value(m)), 9) AS modularity_q_gamma, (SELECT count(*) FILTER (degree = 0) FROM deg) AS isolated_nodes FROM t")
def partition_metrics(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir, isolated=True)
    rows = metrics.partition_metrics(graph, tables.by_modulus(graph, 7))
    return _nine(rows.drop("size_distribution", "density_distribution", "conductance_distribution"), "coverage", "ratio_cut", "normalized_cut", "modularity_q_gamma")


_DIST = " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count({c}) AS valid_count, round(min({c})::DOUBLE, 9) AS \"min\", round(quantile_cont({c}, 0.25)::DOUBLE, 9) AS q1, round(quantile_cont({c}, 0.5)::DOUBLE, 9) AS median, round(quantile_cont({c}, 0.75)::DOUBLE, 9) AS q3, round(max({c})::DOUBLE, 9) AS \"max\", round(avg({c}), 9) AS community_mean, round(sum({c} * size)::DOUBLE / sum(size) FILTER ({c} IS NOT NULL), 9) AS node_weighted_mean FROM t"
    for c in ("size", "density", "conductance")
)


@query(f"WITH {CO}{LABELS}{COMMUNITY} {_DIST}")
def distribution_summary(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    rows = metrics.distributions(metrics.community_table(graph, tables.by_modulus(graph, 7)))
    return _nine(rows, "min", "q1", "median", "q3", "max", "community_mean", "node_weighted_mean")


@query(f"""WITH {CO}{LABELS}{CELLS}, k AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM j)::BIGINT AS a, (SELECT sum(a * (a - 1) // 2) FROM jp)::BIGINT AS pp, (SELECT sum(b * (b - 1) // 2) FROM jr)::BIGINT AS rr, (SELECT (n * (n - 1) / 2)::BIGINT FROM nn) AS t),
z AS (SELECT a, pp - a AS b, rr - a AS c, t - pp - rr + a AS d, pp::DOUBLE * rr / t AS ex, (pp + rr) / 2.0::DOUBLE AS mx FROM k)
SELECT a, b, c, d, round(a / (a + b), 9) AS pairwise_precision, round(a / (a + c), 9) AS pairwise_recall, round(2 * a / (2 * a + b + c), 9) AS pairwise_f1, round((a - ex) / (mx - ex), 9) AS ari FROM z""")
def pairwise_agreement(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return _nine(metrics.agreement(tables.by_modulus(graph, 7), tables.by_modulus(graph, 5)), "pairwise_precision", "pairwise_recall", "pairwise_f1", "ari")


@query(f"""WITH {CO}{LABELS}{CELLS}, mi AS (SELECT sum(j.n / nn.n * ln(j.n * nn.n / (a::DOUBLE * b))) AS mi FROM j JOIN jp USING (p) JOIN jr USING (r), nn),
hp AS (SELECT -sum(a / nn.n * ln(a / nn.n)) AS h FROM jp, nn), hr AS (SELECT -sum(b / nn.n * ln(b / nn.n)) AS h FROM jr, nn),
ex AS (SELECT a::BIGINT AS a, b::BIGINT AS b, nn.n, unnest(range(greatest(1, a + b - nn.n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM jp, jr, nn),
emi AS (SELECT sum(k / n * ln(n * k / (a::DOUBLE * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM ex)
SELECT round(mi, 7) AS mutual_information, round(hp.h, 7) AS h_predicted, round(hr.h, 7) AS h_reference, round(emi, 7) AS expected_mutual_information, round((mi - emi) / ((hp.h + hr.h) / 2 - emi), 7) AS ami FROM mi, hp, hr, emi""")
def ami(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    row = metrics.adjusted_mutual_information(tables.by_modulus(graph, 7), tables.by_modulus(graph, 5))
    return row.select(*(F.round(c, 7).alias(c) for c in row.columns))


def _sweep_sql(k: int) -> str:
    return f"w{k} AS (SELECT src AS node, label, sum(weight) AS w FROM adj JOIN l{k} ON l{k}.node = adj.dst GROUP BY 1, 2), l{k + 1} AS (SELECT node, arg_max(label, (w, -label)) AS label FROM w{k} GROUP BY 1)"


@query(f"WITH RECURSIVE {RING}, l0 AS (SELECT node, node AS label FROM v), {_sweep_sql(0)}, {_sweep_sql(1)}, f AS (SELECT label, min(node) AS first FROM l2 GROUP BY 1) SELECT l2.node, (dense_rank() OVER (ORDER BY first) - 1)::INT AS label FROM l2 JOIN f USING (label)")
def lpa_sync(spark, sf_dir):
    return label_propagation.run(tables.planted(spark, sf_dir), label_propagation.Config(asynchronous=False, random_ties=False)).labels


@query("SELECT c_custkey AS node, (c_custkey // 10)::INT AS label FROM customer")
def louvain_planted(spark, sf_dir):
    """Node by node on the driver."""
    n = tables.read(spark, sf_dir, "customer").count()
    return louvain.run(tables.planted(spark, sf_dir), louvain.Config(resolution=max(1.0, n / 750), driver_edges=200_000)).labels


# nations: those of a region are linked with each other, and each region's first with that of the next one

NATIONS = """v AS (SELECT n_nationkey::BIGINT AS node, n_regionkey AS region FROM nation), f AS (SELECT region, min(node) AS node FROM v GROUP BY 1),
e AS (SELECT a.node AS u, b.node AS v, 1.0::DOUBLE AS weight FROM v a JOIN v b ON a.region = b.region AND a.node < b.node
  UNION ALL SELECT least(a.node, b.node), greatest(a.node, b.node), 1.0 FROM f a JOIN f b ON b.region = a.region + 1),
adj AS (SELECT u AS src, v AS dst, weight FROM e UNION ALL SELECT v, u, weight FROM e)"""
REGIONS = f"WITH {NATIONS} SELECT v.node, (dense_rank() OVER (ORDER BY f.node) - 1)::INT AS label FROM v JOIN f USING (region)"


@query(REGIONS)
def girvan_newman_k(spark, sf_dir):
    return girvan_newman.run(tables.nations(spark, sf_dir), girvan_newman.Config(target_communities=5)).labels


@query(REGIONS)
def spectral_k(spark, sf_dir):
    return spectral.run(tables.nations(spark, sf_dir), spectral.Config(num_communities=5, kmeans_restarts=20)).labels


@query(REGIONS)
def louvain_nations(spark, sf_dir):
    return louvain.run(tables.nations(spark, sf_dir)).labels


@query(f"""WITH RECURSIVE {NATIONS}, walk AS (SELECT node AS s, node AS t, 0 AS d, [node] AS seen FROM v UNION ALL SELECT s, adj.dst, d + 1, list_append(seen, adj.dst) FROM walk JOIN adj ON adj.src = walk.t WHERE d < 6 AND NOT list_contains(seen, adj.dst) AND (d = 0 OR NOT EXISTS (SELECT 1 FROM adj x WHERE x.src = seen[-2] AND x.dst = adj.dst))),
near AS (SELECT s, t, min(d) AS d FROM walk GROUP BY 1, 2), best AS (SELECT walk.* FROM walk JOIN near USING (s, t, d) WHERE s < t), ways AS (SELECT s, t, count(*) AS n FROM best GROUP BY 1, 2),
steps AS (SELECT s, t, unnest(range(1, len(seen))) AS i, seen FROM best WHERE len(seen) > 1)
SELECT least(seen[i], seen[i + 1]) AS u, greatest(seen[i], seen[i + 1]) AS v, round(sum(1.0::DOUBLE / n), 9) AS score FROM steps JOIN ways USING (s, t) GROUP BY 1, 2""")
def edge_betweenness(spark, sf_dir):
    return _nine(girvan_newman.betweenness(tables.nations(spark, sf_dir)), "score")


# over all customers; there SQL is too slow or has no unique answer, so tests/test_registry.py compares with brute force


@query()
def lpa_async(spark, sf_dir):
    return label_propagation.run(tables.planted(spark, sf_dir)).labels


@query()
def edge_betweenness_customers(spark, sf_dir):
    return _nine(girvan_newman.betweenness(tables.planted(spark, sf_dir)), "score")


@query("SELECT c_custkey AS node, (c_custkey // 10)::INT AS label FROM customer")
def louvain_bulk(spark, sf_dir):
    """No level moves on the driver."""
    n = tables.read(spark, sf_dir, "customer").count()
    return louvain.run(tables.planted(spark, sf_dir), louvain.Config(resolution=max(1.0, n / 750))).labels


@query(f"""WITH {RING}, deg AS (SELECT src AS node, sum(weight) AS degree FROM adj GROUP BY 1), pos AS (SELECT node, row_number() OVER (ORDER BY node) AS position, degree FROM deg),
st AS (SELECT least(a.position, b.position) AS position, weight AS step FROM e JOIN pos a ON a.node = e.u JOIN pos b ON b.node = e.v UNION ALL SELECT greatest(a.position, b.position), -weight FROM e JOIN pos a ON a.node = e.u JOIN pos b ON b.node = e.v),
s AS (SELECT position, degree, coalesce((SELECT sum(step) FROM st WHERE st.position = pos.position), 0) AS step FROM pos),
r AS (SELECT position, sum(step) OVER (ORDER BY position) AS cut, sum(degree) OVER (ORDER BY position) AS "left", sum(degree) OVER () AS total FROM s),
z AS (SELECT position, cut * (1 / "left" + 1 / (total - "left")) AS score, cut, "left" FROM r WHERE total > "left")
SELECT position, round(score, 9) AS score, cut, "left" FROM z ORDER BY round(score, 12), position LIMIT 1""")
def sweep_cut(spark, sf_dir):
    graph = tables.planted(spark, sf_dir)
    return _nine(spectral.sweep(graph, graph.vertices.select("node", F.col("node").cast("double").alias("x"))), "score")


@query(f"WITH {CO}, c AS (SELECT count(*)::DOUBLE AS cut FROM e WHERE u % 2 <> v % 2), s AS (SELECT sum(degree) FILTER (node % 2 = 0) AS a, sum(degree) FILTER (node % 2 = 1) AS b FROM deg) SELECT round(cut * (1 / a + 1 / b), 9) AS objective FROM c, s")
def bisection_objective(spark, sf_dir):
    graph = tables.parts_co(spark, sf_dir)
    return _nine(spectral.bisection_objective(graph, tables.by_modulus(graph, 2)), "objective")


# the experiment layer, over runs made of orders: a job is an order, its graph that of its customer, its labels follow from its number

RUNS = """runs AS (SELECT 'j' || lpad(o_orderkey::VARCHAR, 9, '0') AS job_id, 'p' AS protocol, 'c' || o_custkey AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'full' END AS scope_id, CASE WHEN o_orderkey % 5 < 2 THEN o_orderpriority END AS sample_profile,
  CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 END::BIGINT AS sample_seed, 'louvain' AS algorithm, 0::BIGINT AS requested_k, 1.0::DOUBLE AS resolution, CASE WHEN o_orderkey % 7 = 0 THEN 'unnormalized' ELSE 'normalized' END AS laplacian, (o_orderkey % 3)::BIGINT AS algorithm_seed,
  CASE WHEN o_orderkey % 4 < 3 THEN 0.0 ELSE 0.05 END::DOUBLE AS dropout_rate, o_orderkey AS dropout_seed, (o_orderkey % 11)::BIGINT AS removed_edges, o_totalprice AS objective, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 17 END::DOUBLE AS wall_seconds FROM orders),
labels AS (SELECT job_id, n AS node, ((n * 7 + dropout_seed) % 11 // 4)::INT AS label FROM runs, range(12) t(n))"""
_DOTS = {"laplacian": "parameters.laplacian", "removed_edges": "dropout.removed_edges"}


def _runs(spark, sf_dir):
    key = F.col("o_orderkey")
    return tables.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("j"), F.lpad(key.cast("string"), 9, "0")).alias("job_id"), F.lit("p").alias("protocol"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dataset"), F.when(key % 3 != 0, "full").alias("scope_id"),
        F.when(key % 5 < 2, F.col("o_orderpriority")).alias("sample_profile"), F.when(key % 5 < 2, key % 5).cast("long").alias("sample_seed"), F.lit("louvain").alias("algorithm"), F.lit(0).cast("long").alias("requested_k"), F.lit(1.0).alias("resolution"),
        F.when(key % 7 == 0, "unnormalized").otherwise("normalized").alias("parameters.laplacian"), (key % 3).cast("long").alias("algorithm_seed"), F.when(key % 4 < 3, 0.0).otherwise(0.05).alias("dropout_rate"), key.alias("dropout_seed"),
        (key % 11).cast("long").alias("dropout.removed_edges"), F.col("o_totalprice").alias("objective"), F.when(key % 13 > 0, key % 17).cast("double").alias("wall_seconds"),
    )


def _run_labels(runs):
    each = runs.select("job_id", "dropout_seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("node"))
    return each.select("job_id", "node", F.expr("CAST((node * 7 + dropout_seed) % 11 div 4 AS INT)").alias("label"))


def _plain(df, *rounded):
    """Without dots in names, and rounded."""
    short = {c: c.replace("parameters.", "").replace("dropout.", "") for c in df.columns}
    return df.select(*(F.round(results.col(c), 7).alias(n) if n.startswith(rounded) and not n.endswith("_count") else results.col(c).alias(n) for c, n in short.items()))


_LAST = "l.protocol, l.dataset, l.scope_id, l.algorithm, l.requested_k, l.resolution, l.laplacian"
_ON = "l.protocol = r.protocol AND l.dataset = r.dataset AND l.scope_id IS NOT DISTINCT FROM r.scope_id AND l.algorithm = r.algorithm AND l.requested_k = r.requested_k AND l.resolution = r.resolution AND l.laplacian = r.laplacian"
_SCORES = """, c AS (SELECT x, y, a.label AS p, b.label AS r, count(*) AS n FROM pairs JOIN labels a ON a.job_id = x JOIN labels b ON b.job_id = y AND a.node = b.node GROUP BY ALL),
nn AS (SELECT x, y, sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2) AS j FROM c GROUP BY ALL), jp AS (SELECT x, y, p, sum(n)::DOUBLE AS a FROM c GROUP BY ALL), jr AS (SELECT x, y, r, sum(n)::DOUBLE AS b FROM c GROUP BY ALL),
hp AS (SELECT x, y, count(*) AS kp, sum(a * (a - 1) / 2) AS pp, -sum(a / n * ln(a / n)) AS hp FROM jp JOIN nn USING (x, y) GROUP BY ALL), hr AS (SELECT x, y, count(*) AS kr, sum(b * (b - 1) / 2) AS rr, -sum(b / n * ln(b / n)) AS hr FROM jr JOIN nn USING (x, y) GROUP BY ALL),
mi AS (SELECT c.x, c.y, sum(c.n / nn.n * ln(c.n * nn.n / (a * b))) AS mi FROM c JOIN jp USING (x, y, p) JOIN jr USING (x, y, r) JOIN nn USING (x, y) GROUP BY ALL),
ex AS (SELECT x, y, a, b, n, unnest(range(greatest(1, a + b - n)::BIGINT, least(a, b)::BIGINT + 1)) AS k FROM jp JOIN jr USING (x, y) JOIN nn USING (x, y)),
em AS (SELECT x, y, sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM ex GROUP BY ALL),
sc AS (SELECT x, y, (j - pp * rr / (n * (n - 1) / 2)) / ((pp + rr) / 2 - pp * rr / (n * (n - 1) / 2)) AS ari, (mi - emi) / ((hp + hr) / 2 - emi) AS ami_arithmetic FROM nn JOIN hp USING (x, y) JOIN hr USING (x, y) JOIN mi USING (x, y) JOIN em USING (x, y))"""
_STABLE = f"WITH {RUNS}, pairs AS (SELECT l.job_id AS x, r.job_id AS y, {_LAST}, l.sample_profile, l.sample_seed, l.algorithm_seed AS left_seed, r.algorithm_seed AS right_seed FROM runs l JOIN runs r ON {_ON} AND l.job_id < r.job_id WHERE l.dropout_rate = 0 AND r.dropout_rate = 0){_SCORES}, t AS (SELECT * FROM pairs JOIN sc USING (x, y))"
_ROBUST = f"""WITH {RUNS}, base AS (SELECT max(job_id) AS job_id, {_LAST.replace("l.", "")}, algorithm_seed FROM runs WHERE dropout_rate = 0 GROUP BY ALL),
pairs AS (SELECT l.job_id AS x, r.job_id AS y, {_LAST}, l.algorithm_seed, r.sample_profile, r.sample_seed, r.dropout_rate, r.dropout_seed, r.removed_edges FROM base l JOIN runs r ON {_ON} AND l.algorithm_seed = r.algorithm_seed WHERE r.dropout_rate > 0){_SCORES}, t AS (SELECT * FROM pairs JOIN sc USING (x, y))"""


def _spread_sql(*names: str) -> str:
    each = (("mean", "avg(#)"), ("std", "CASE WHEN count(#) > 1 THEN stddev_samp(#) WHEN count(#) = 1 THEN 0 END"), ("min", "min(#)"), ("q1", "quantile_cont(#, 0.25)"), ("median", "quantile_cont(#, 0.5)"), ("q3", "quantile_cont(#, 0.75)"), ("max", "max(#)"))
    return ", ".join(f"count({c}) AS {c}_count, " + ", ".join(f"round({f.replace('#', c)}::DOUBLE, 7) AS {c}_{n}" for n, f in each) for c in names)


_GROUP, _SAMPLES = "protocol, dataset, scope_id, algorithm, requested_k, resolution, laplacian", "protocol, dataset, sample_profile, algorithm, requested_k, resolution, laplacian"


@query(f"{_STABLE} SELECT * EXCLUDE (x, y) REPLACE (round(ari, 7) AS ari, round(ami_arithmetic, 7) AS ami_arithmetic), x AS left_job_id, y AS right_job_id FROM t")
def stability_pairs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _plain(results.stability_pairs(runs, _run_labels(runs)), "ari", "ami")


@query(f"{_STABLE} SELECT {_GROUP}, {_spread_sql('ari', 'ami_arithmetic')} FROM t GROUP BY ALL")
def stability_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _plain(results.stability_summary(results.stability_pairs(runs, _run_labels(runs))), "ari", "ami")


@query(f"{_STABLE} SELECT {_SAMPLES}, count(DISTINCT sample_seed) AS sample_scopes, count(*) AS partition_pairs, {_spread_sql('ari', 'ami_arithmetic')} FROM t WHERE sample_profile IS NOT NULL GROUP BY ALL")
def sample_stability_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _plain(results.sample_stability_summary(results.stability_pairs(runs, _run_labels(runs), sampled=True)), "ari", "ami")


@query(f"{_ROBUST} SELECT * EXCLUDE (x, y) REPLACE (round(ari, 7) AS ari, round(ami_arithmetic, 7) AS ami_arithmetic), x AS baseline_job_id, y AS perturbed_job_id FROM t")
def robustness_pairs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _plain(results.robustness_pairs(runs, _run_labels(runs)), "ari", "ami")


@query(f"{_ROBUST} SELECT {_GROUP}, dropout_rate, {_spread_sql('ari', 'ami_arithmetic')} FROM t GROUP BY ALL")
def robustness_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return _plain(results.robustness_summary(results.robustness_pairs(runs, _run_labels(runs))), "ari", "ami")


_FOUND = ("wall_seconds", "removed_edges", "objective")


@query(f"WITH {RUNS} SELECT {_GROUP}, dropout_rate, count(*) AS runs, {_spread_sql(*_FOUND)} FROM runs GROUP BY ALL")
def aggregate_runs(spark, sf_dir):
    return _plain(results.aggregate_runs(_runs(spark, sf_dir)), *_FOUND)


@query(f"WITH {RUNS} SELECT {_SAMPLES}, dropout_rate, count(*) AS runs, {_spread_sql(*_FOUND)} FROM runs WHERE sample_profile IS NOT NULL GROUP BY ALL")
def sample_aggregate(spark, sf_dir):
    return _plain(results.aggregate_samples(_runs(spark, sf_dir)), *_FOUND)


@query("SELECT 'j' || o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'existing' WHEN 2 THEN 'failed' ELSE 'skipped_resource_guard' END AS status FROM orders WHERE o_orderkey % 4 >= 2")
def skipped_runs(spark, sf_dir):
    names = F.array(*map(F.lit, ("ok", "existing", "failed", "skipped_resource_guard")))
    index = tables.read(spark, sf_dir, "orders").select(F.concat(F.lit("j"), F.col("o_orderkey").cast("string")).alias("job_id"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("status"))
    return results.skipped(index)


@query("SELECT 'o' || l_orderkey AS name, count(*)::INT AS source_file_count, string_agg('p' || l_partkey, ' | ' ORDER BY l_linenumber, 'p' || l_partkey) AS source_paths, string_agg(sha256('p' || l_partkey), ' | ' ORDER BY l_linenumber, 'p' || l_partkey) AS source_sha256 FROM lineitem GROUP BY l_orderkey")
def dataset_table(spark, sf_dir):
    name = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    file = F.struct("l_linenumber", name.alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.sha2(name, 256).alias("sha256"))
    orders = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(file)).alias("source_files"))
    return results.dataset_table(orders.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"), "source_files"))


# the matrix of jobs over nations: a graph of a nation's customers, with the segments as its samples

_PROTOCOLS = [
    {"name": "whole", "scope": "full", "algorithms": ["girvan_newman", "louvain"], "algorithm_seeds": {"girvan_newman": [42], "louvain": [11, 23]}, "resolutions": [0.5, 1.0], "dropout": [{"rate": 0.0, "seeds": [0]}, {"rate": 0.05, "seeds": [7, 9]}]},
    {"name": "sampled", "scope": "sample", "sample_profile": "segment", "algorithms": ["spectral", "label_propagation"], "algorithm_seeds": {"spectral": [1, 2], "label_propagation": [3]}, "dataset_settings": {}},
]


def _manifest(spark, sf_dir):
    """All nations, with their customers as nodes and as many edges, and each segment as a sample; a row a nation and segment."""
    rows = tables.read(spark, sf_dir, "customer").join(tables.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = rows.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy("n_name", "c_mktsegment").collect()  # 125 rows at every scale
    found = {}
    for r in counts:
        d = found.setdefault(r.n_name, {"name": r.n_name, "graph": f"{r.n_name}/full", "sha256": f"h{r.n_name}", "n": 0, "m": 0, "samples": []})
        d["n"], d["m"] = d["n"] + r.n, d["m"] + 2 * r.n
        d["samples"].append({"profile": "segment", "seed": len(d["samples"]), "graph": f"{r.n_name}/{r.c_mktsegment}", "sha256": f"h{r.c_mktsegment}", "reference": "ref", "reference_sha256": "rh", "n": r.n + 1000, "m": 2 * r.n})
    return {"datasets": list(found.values())}


@query("""WITH c AS (SELECT n_name AS dataset, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY segment) - 1 AS seed FROM c), d AS (SELECT dataset, sum(n)::BIGINT AS n FROM c GROUP BY 1),
x AS (SELECT 'whole' AS protocol, dataset, 'full' AS scope_id, 'h' || dataset AS graph_sha256, 'no_reference' AS reference_sha256, n, 2 * n AS m, a.* , dr.* FROM d,
    (VALUES ('girvan_newman', 42, 3, '1.0', '--gn-max-m|60|--gn-max-n|40'), ('louvain', 11, 0, '0.5', ''), ('louvain', 11, 0, '1.0', ''), ('louvain', 23, 0, '0.5', ''), ('louvain', 23, 0, '1.0', '')) a(algorithm, algorithm_seed, requested_k, resolution, options),
    (VALUES ('0.0', 0), ('0.05', 7), ('0.05', 9)) dr(dropout_rate, dropout_seed)
  UNION ALL SELECT 'sampled', dataset, 'segment_seed_' || seed, 'h' || segment, 'rh', n + 1000, 2 * n, a.*, '0.0', 0 FROM s,
    (VALUES ('spectral', 1, 2, '1.0', '--bisection|sweep|--spectral-max-edge-visits|2000000000|--spectral-max-orthogonalization-ops|5000000000'), ('spectral', 1, 4, '1.0', '--bisection|sweep|--spectral-max-edge-visits|2000000000|--spectral-max-orthogonalization-ops|5000000000'),
      ('spectral', 2, 2, '1.0', '--bisection|sweep|--spectral-max-edge-visits|2000000000|--spectral-max-orthogonalization-ops|5000000000'), ('spectral', 2, 4, '1.0', '--bisection|sweep|--spectral-max-edge-visits|2000000000|--spectral-max-orthogonalization-ops|5000000000'), ('label_propagation', 3, 0, '1.0', '--max-iterations|50')) a(algorithm, algorithm_seed, requested_k, resolution, options))
SELECT substr(sha256(concat_ws('|', protocol, dataset, scope_id, graph_sha256, reference_sha256, algorithm, requested_k, resolution, algorithm_seed, dropout_rate, dropout_seed) || CASE WHEN options = '' THEN '' ELSE '|' || options END), 1, 16) AS job_id,
  protocol, dataset, scope_id, n::BIGINT AS n, m::BIGINT AS m, algorithm, algorithm_seed::BIGINT AS algorithm_seed, requested_k::BIGINT AS requested_k, resolution::DOUBLE AS resolution, dropout_rate::DOUBLE AS dropout_rate, dropout_seed::BIGINT AS dropout_seed,
  replace(options, '|', ' ') AS options, CASE WHEN algorithm = 'girvan_newman' AND (n > 40 OR m > 60) THEN 'exact_gn_guard:n=' || n || '>40 or m=' || m || '>60' END AS reason FROM x""")
def jobs_matrix(spark, sf_dir):
    manifest = _manifest(spark, sf_dir)
    names = [d["name"] for d in manifest["datasets"]]
    config = {
        "protocols": _PROTOCOLS, "dataset_settings": {n: {"girvan_newman_k": [3], "spectral_k": [2, 4]} for n in names}, "resource_guards": {"girvan_newman_max_n": 40, "girvan_newman_max_m": 60},
        "algorithm_options": {"spectral": {"bisection": "sweep"}, "label_propagation": {"max_iterations": 50, "lpa_synchronous": False}},
    }
    found = jobs.guarded(jobs.jobs(spark, config, manifest), config["resource_guards"])
    return found.select("job_id", "protocol", "dataset", "scope_id", "n", "m", "algorithm", "algorithm_seed", "requested_k", "resolution", "dropout_rate", "dropout_seed", F.array_join("options", " ").alias("options"), "reason")


@query("""WITH j AS (SELECT 'j' AS job_id, l_orderkey AS n, l_partkey * 4000 AS m, CASE WHEN l_linenumber % 2 = 0 THEN 'spectral' ELSE 'girvan_newman' END AS algorithm, (2 + l_suppkey % 40)::BIGINT AS requested_k, CASE WHEN l_linenumber % 3 = 0 THEN 500 ELSE 1000 END AS most FROM lineitem),
b AS (SELECT *, least(n, greatest(128, 6 * requested_k + 32)) AS basis FROM j)
SELECT n, m, algorithm, requested_k, CASE WHEN algorithm = 'girvan_newman' AND (n > most OR m > 10000) THEN 'exact_gn_guard:n=' || n || '>' || most || ' or m=' || m || '>10000' WHEN algorithm = 'spectral' AND 2 * m * basis > 2000000000 THEN 'spectral_edge_guard:' || (2 * m * basis)::BIGINT || '>2000000000'
  WHEN algorithm = 'spectral' AND 4 * n * basis * basis > 5000000000 THEN 'spectral_orthogonalization_guard:' || (4 * n * basis * basis)::BIGINT || '>5000000000' END AS reason FROM b""")
def guard_status(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") % 2 == 0, "spectral").otherwise("girvan_newman")
    words = F.when((F.col("l_linenumber") % 3 == 0) & (kind == "girvan_newman"), F.array(F.lit("--gn-max-n"), F.lit("500"))).otherwise(F.array().cast("array<string>"))
    rows = tables.read(spark, sf_dir, "lineitem").select(F.lit("j").alias("job_id"), F.col("l_orderkey").alias("n"), (F.col("l_partkey") * 4000).alias("m"), kind.alias("algorithm"), (2 + F.col("l_suppkey") % 40).cast("long").alias("requested_k"), words.alias("options"))
    return jobs.guarded(rows, {}).drop("job_id", "options")
