from pyspark.sql import functions as F

from sparkweave.llm import exact_dedup, ngram_join
from sparkweave.llm.places import Values, located, numbered


def _table(spark, tmp_path, rows=20_000):
    path = f"file://{tmp_path}/t"
    spark.range(rows).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_values_of_some_rows(spark, tmp_path):
    table, file, row = located(_table(spark, tmp_path))
    found = table.where("id % 7 = 0").select(file.alias("file"), row.alias("row"), (F.col("id") - 9).alias("value"))
    told = Values(spark, "test").write(found).of(file, row)
    assert all(r.v == (r.id - 9 if r.id % 7 == 0 else None) for r in table.select("id", told.alias("v")).collect())
    assert table.where(told.isNull()).count() == sum(1 for i in range(20_000) if i % 7)


def test_no_values(spark, tmp_path):
    table, file, row = located(_table(spark, tmp_path, 100))
    none = table.where("id < 0").select(file.alias("file"), row.alias("row"), F.col("id").alias("value"))
    assert table.where(Values(spark, "test").write(none).of(file, row).isNull()).count() == 100


def test_what_is_no_scan_is_stored(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "x")], "file long, _metadata string")
    table, file, row = located(docs)
    assert table.columns == docs.columns
    assert len({tuple(r) for r in table.select(file.alias("a"), row.alias("b")).collect()}) == 2


def test_a_file_that_is_listed_twice(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l")], "doc_id long, text string").coalesce(1).write.parquet(path)
    part = next(r.f for r in spark.read.parquet(path).selectExpr("_metadata.file_path AS f").collect())
    for twice in ((path, path), (path, part)):
        docs = spark.read.parquet(*twice)
        assert docs.count() == 6 and located(docs)[0].inputFiles() != docs.inputFiles()
    table, file, row = located(docs)
    assert len({tuple(r) for r in table.select(file.alias("a"), row.alias("b")).collect()}) == 6
    table, number = numbered(docs)
    assert sorted(r.n for r in table.select(number.alias("n")).collect()) == list(range(6))
    for keep in (exact_dedup.keep_first, ngram_join.keep_one):
        assert sorted((r.doc_id, r.text) for r in keep(docs).collect()) == [(1, "a b c d e f"), (3, "g h i j k l")]


def test_many_rows_in_a_chunk_and_more_buckets(spark, tmp_path):
    table, file, row = located(_table(spark, tmp_path, 300_000))
    found = table.where("id % 2 = 0").select(file.alias("file"), row.alias("row"), F.col("id").alias("value"))
    values = Values(spark, "test").write(found)
    got = table.select("id", values.of(file, row).alias("v")).agg(F.count_if(F.expr("v = id")), F.count_if(F.expr("v IS NULL AND id % 2 = 1"))).first()
    assert tuple(got) == (150_000, 150_000) and values.buckets >= 64
