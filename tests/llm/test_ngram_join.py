import random

import numpy as np

from sparkweave.llm import ngram_join


def brute(rows, over=4, under=5):
    """Per row (id, class id, links, links to other sets, copies), and the class ids, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    link = [[i != j and (sets[i] == sets[j] or bool(sets[i] and sets[j]) and under * len(sets[i] & sets[j]) >= over * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    out = []
    for i in range(n):
        ids = [rows[k][0] for k in range(n) if root[k] == root[i] and rows[k][0] is not None]
        out.append((rows[i][0], min(ids, default=None), sum(link[i]), len({sets[j] for j in range(n) if link[i][j]} - {sets[i]}), sum(s == sets[i] for s in sets)))
    return sorted(out, key=str)


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=4))
    rows, n = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "a b"), (n + 3, "a b"), (None, "a  b"), (n + 4, "x " * 30_000)]
    return rows


def test_against_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    for config in (ngram_join.Config(), ngram_join.Config(block=3)):
        got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_text_links, r.copies) for r in ngram_join.join(docs, config=config).collect()), key=str)
        assert got == brute(rows)


def test_one_of_each_group(spark):
    rows = made(5)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    got = sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect())
    assert got == sorted({str(r[1]) for r in brute(rows)})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0
    assert ngram_join.keep_one(docs).count() == 0


def test_pruning_follows_the_posterior():
    least = ngram_join.least_matches(ngram_join.Config())
    assert all(0 < m < k * 0.8 for m, k in zip(least, ngram_join.Config().steps, strict=True))
    rng = np.random.default_rng(1)
    agree = rng.random((20_000, 128)) < 0.8  # pairs at the threshold
    kept = np.all([agree[:, :k].sum(1) >= m for k, m in zip(ngram_join.Config().steps, least, strict=True)], axis=0)
    assert kept.mean() > 0.999
    far = rng.random((20_000, 128)) < 0.3
    assert np.all([far[:, :k].sum(1) >= m for k, m in zip(ngram_join.Config().steps, least, strict=True)], axis=0).mean() < 0.001


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 150).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (ngram_join.overlaps(sets, sets, width=64) == want).all()


def all_links(texts):
    """Linked documents of each text, by comparing all pairs of sets."""
    sets = [ngram_join.shingles((t or "").encode()) for t in texts]
    size = np.array([len(x) for x in sets])
    found = np.zeros(len(sets), int)
    for i in range(0, len(sets), 500):
        common = ngram_join.overlaps(sets[i : i + 500], sets)
        link = (5 * common >= 4 * (size[i : i + 500, None] + size[None, :] - common)) & (common > 0)
        found[i : i + 500] = link.sum(1) - (size[i : i + 500] > 0)
    none = (size == 0).sum()
    return np.where(size > 0, found, none - 1)


def test_recall_on_a_thousand_texts(spark):
    """Links between different sets that are lost, of all there are."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in rows], all_links([r.text for r in rows]), strict=True))
    got = {r.doc_id: r.n_links for r in ngram_join.join(docs).collect()}
    assert len(want) >= 900 and got.keys() == want.keys()
    assert sum(got.values()) == sum(want.values()) > 100 and got == want
