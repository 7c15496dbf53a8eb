import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkweave.llm import quality_model, quality_rules

TEXTS = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 30_000, "line one\nline one\n \nline two", "é # ** a|b <c> " * 3, "\n".join(f"w{i} x{i} y{i}" for i in range(40)), "AA!! " * 20]


def slow(text):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").split() if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "one", 1), (3, "one", 1)], "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in quality_rules.measure(docs).collect()), key=str)
    assert got == sorted([(i, *slow(t)) for i, t in enumerate(TEXTS)] + [(None, *slow("one")), (3, *slow("one"))], key=str)
    assert quality_rules.measure(docs.limit(0)).count() == 0


def test_ledger_policies_and_ablations(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    marked = quality_rules.ledger(quality_rules.measure(docs))
    rows = {r.doc_id: r.failed_rules for r in marked.collect()}
    assert rows[3] & 1 and rows[5] & 2 and not rows[8]
    for version in quality_rules.POLICIES:
        mask = quality_rules.mask(quality_rules.POLICIES[version])
        assert {r.doc_id: r.kept for r in quality_rules.decide(marked, version).collect()} == {k: not (v & (mask | 3)) for k, v in rows.items()}
    for r in quality_rules.ablations(marked).collect():
        mask, bit = quality_rules.mask(quality_rules.POLICIES[r.policy]), quality_rules.mask((r.rule,))
        assert r.n_failed == sum(bool(v & bit) for v in rows.values())
        assert r.n_only == sum(v & mask == bit for v in rows.values())
        assert r.n_kept == sum(not v & mask for v in rows.values())
        assert r.n_kept_without == sum(not v & mask & ~bit for v in rows.values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_model.score(docs, quality_model.train(docs, labels)).join(labels, "doc_id").where(F.expr("pmod(crc32(CAST(doc_id AS STRING)), 3) = 1"))
    rows = scored.select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_ranker_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "x " * 50_000, "a"), (2, "x " * 50_000, "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, None)], "doc_id long, quality int")
    got = quality_model.score(docs, quality_model.train(docs, labels)).collect()
    assert len(got) == 4 and all(r.predicted == 1 and abs(r.score - 0.75) < 1e-9 for r in got)
    assert quality_model.keep_good(docs, quality_model.train(docs, labels)).columns == docs.columns
    assert quality_model.score(docs.limit(0), quality_model.train(docs, labels)).count() == 0


def test_pairs_rank_on_a_bounded_sample():
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality_model.FEATURES)))
    good = x[:, 0] + 0.1 * rng.random(400) > 0.4
    hashed = np.zeros((400, 2 * quality_model.HASHED), np.float16)
    score = quality_model.fit(x, hashed, good).score(x, hashed)
    assert ((score >= 0.5) == good).mean() > 0.9


def test_words_alone_tell():
    """Texts of the same form whose words differ, and the hashed counts by hand."""
    rng = np.random.default_rng(1)
    some = lambda words: " ".join(rng.choice(words, 30))
    texts = [some(["river", "stone", "cloud", "field"]) if i % 2 else some(["casino", "jackpo", "prizes", "clicks"]) for i in range(300)]
    x, hashed = quality_model.described(pa.array(texts))
    good = np.arange(300) % 2 == 1
    score = quality_model.fit(x[:200], hashed[:200], good[:200]).score(x[200:], hashed[200:])
    assert ((score >= 0.5) == good[200:]).all()
    counts = np.zeros(quality_model.HASHED)
    for w in {"a", "b"}:
        counts[zlib.crc32(w.encode()) % quality_model.HASHED] += 1
    want = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
    assert np.allclose(quality_model.lexical("A b a")[: quality_model.HASHED], want, atol=1e-3)
    assert not quality_model.lexical(None).any() and not quality_model.lexical("").any() and len(quality_model.lexical("é")) == 2 * quality_model.HASHED


def test_repeated_rows_train_once(spark):
    docs = spark.createDataFrame([(i % 40, "good text of words here " * (i % 5 + 1) if i % 2 else "!!! ### spam") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once, often = quality_model.train(docs.limit(40), labels), quality_model.train(docs.dropDuplicates(), labels)
    assert np.allclose(quality_model.train(docs, labels).weights, often.weights) and len(once.weights) == len(often.weights)


def test_all_labelled_rows_and_pairs_count(spark, monkeypatch):
    """On the cluster and on the driver: the slope of the loss over all pairs, by hand, is next to none, and the threshold parts all rows."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["river", "stone", "cloud", "WIN", "##", "cash!"], 12, p=[0.25, 0.25, 0.2, 0.1, 0.1, 0.1] if i % 3 else [0.1, 0.1, 0.1, 0.25, 0.2, 0.25])) for i in range(240)]
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    used = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 != 1]
    x, hashed = quality_model.described(pa.array([texts[i] for i in used]))
    good = np.array([i % 3 > 0 for i in used])
    for gathered in (0, 1000):
        ranker = quality_model.train(docs, labels, gathered)
        z = quality_model.expand((x - ranker.mean) / ranker.scale, hashed).astype(float)
        raw = z @ ranker.weights
        pull = 1 / (1 + np.exp(raw[good][:, None] - raw[~good][None]))
        slope = (pull.sum(0) @ z[~good] - pull.sum(1) @ z[good]) / pull.size + 1e-3 * ranker.weights
        assert np.allclose(ranker.mean, x.mean(0)) and np.abs(slope).max() < 2e-4
        assert abs(ranker.threshold - np.sort(raw)[(~good).sum() - 1 : (~good).sum() + 1].mean()) < 1e-4
    many = spark.range(30_000).selectExpr("id AS doc_id", "concat('word ', id) AS text", "CAST(id % 2 AS INT) AS quality")
    monkeypatch.setattr(quality_model, "_learn", lambda total: total(quality_model._moments)[0].tolist())
    want = [i % 2 for i in range(30_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert quality_model.train(many, many, 100) == quality_model.train(many, many) == [len(want), sum(want)]
