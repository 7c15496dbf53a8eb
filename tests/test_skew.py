from pyspark.sql import functions as F

from sparkweave.functions import skew
from sparkweave.operators.components import stars


def test_hot_keys_join_as_others(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id")
    for cast in ("long", "string", "binary"):
        keyed = rows.withColumn("k", F.col("k").cast("string").cast(cast) if cast != "long" else F.col("k"))
        values = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
        want = sorted((r.id, r.n, r.least) for r in keyed.join(values, "k").collect())
        found = skew.joined(keyed, values, "k", "n", 6000)
        assert set(found.columns) == {"k", "id", "n", "least"} and sorted((r.id, r.n, r.least) for r in found.collect()) == want


def test_no_task_has_a_hot_key_alone(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit(7).cast("long").alias("k"), "id")
    found = skew.joined(rows, spark.createDataFrame([(7, 20_000)], "k long, n long"), "k", "n", 20_000)
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert sum(sizes) == 20_000 and len(sizes) >= 20 and max(sizes) < 4000


def test_components_with_a_hub_and_a_path(spark):
    edges = [(10_000, i) for i in range(1, 2000)] + [(20_000 + i, 20_001 + i) for i in range(40)] + [(5, 5)]
    got = {r.node: r.component for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in [*range(1, 2000), 10_000]) and all(got[20_000 + i] == 20_000 for i in range(41)) and len(got) == 2041
