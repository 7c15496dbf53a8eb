import re

import pyarrow as pa

import corpus_pipeline
from sparkweave.llm import mixing, packing, places, quality_model
from test_ngram_join import brute


def test_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    packed = corpus_pipeline.run(spark, sf).collect()
    ranker = quality_model.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = ranker.score(*quality_model.described(pa.array([t for _, t in rows])))
    good = [r for r, s in zip(rows, score, strict=True) if s >= 0.5]
    first = {}
    for k, t in sorted(good):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), (k, t))
    kept = sorted({r[1] for r in brute(sorted(first.values()))})
    assert sorted({r.doc_id for r in packed}) == kept
    words = {k: len((t or "").split()) + 1 for k, t in rows}
    assert sum(r.n_tokens for r in packed) == sum(words[k] for k in kept)


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_bins_follow_the_mixture(spark, tmp_path):
    rows = [(i, "w " * (20 + i * 7 % 60), "a" if i % 10 else "b") for i in range(20_000)]
    mixed = str(tmp_path / "mixed")
    mixing.in_order(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1, "b": 1}).write.parquet(mixed)
    source = {i: s for i, _, s in rows}
    docs, number = places.numbered(spark.read.parquet(mixed))
    ordered = [r.doc_id for r in docs.select("doc_id", number.alias("at")).orderBy("at").collect()]
    for packed in (packing.best_fit(docs, capacity=128, shard_rows=500, order=number), corpus_pipeline.packed(spark, spark.read.parquet(mixed), "")):
        got = packed.collect()
        assert sorted({r.doc_id for r in got}) == list(range(20_000))
        shards = {}
        for r in got:
            shards.setdefault(r.bin_id >> 32, set()).add(r.doc_id)
        size = 500 if len(shards) > 3 else packing.SHARD_ROWS
        assert all(shards[k] == set(ordered[k * size : (k + 1) * size]) for k in shards)
        # two sources of equal weight take turns as long as the smaller one lasts, 4000 documents
        begin = [source[i] for k in sorted(shards) if (k + 1) * size <= 4000 for i in shards[k]]
        assert abs(begin.count("a") - begin.count("b")) <= 2 * mixing.BLOCK


def test_stages_take_nulls_empties_ties_and_clashing_columns(spark, tmp_path):
    sf = str(tmp_path)
    rows = [(1, "a b c d e f g h i j k", "x", "s"), (2, "a b c d e f g h i j k", "x", None), (2, "a b c d e f g h i j k", "x", None), (None, None, None, None), (3, "", "x", "s"), (4, "w " * 60_000, "x", "s"), (5, "a b c  d e f g h i j k", "y", "t")]
    docs = spark.createDataFrame([(*r, 7, 8, 9) for r in rows], "doc_id long, text string, lang string, source string, file long, row long, kept int")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, table, sf)
            assert kept.columns == docs.columns and kept.count() <= table.count()
    docs.write.parquet(f"{sf}/documents.parquet")
    assert sorted({r.doc_id or 0 for r in corpus_pipeline.run(spark, sf).collect()}) == [1, 3, 4]
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
