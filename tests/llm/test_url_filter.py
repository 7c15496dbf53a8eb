import math
import random

from sparkweave.llm import url_filter

HOSTS = [
    ("HTTP://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/"), ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/"), ("https://example.com?x", "example.com", "", None),
    ("http://net/es/1", "net", "/es/1", "net/es/"), ("http://planet/es/1", "planet", "/es/1", None), ("no scheme", "", "", None), (None, "", "", None), ("x://y.com/a://b", "y.com", "/a://b", "com/"), ("http://É.net/fr/", "É.net", "/fr/", "net/fr/"),
]


def test_hosts_paths_and_rules(spark):
    docs = spark.createDataFrame([(i, u, "x") for i, (u, *_) in enumerate(HOSTS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(docs).collect()}
    assert got == {i: tuple(x) for i, (_, *x) in enumerate(HOSTS)}
    assert url_filter.judge(docs.limit(0)).count() == 0


def test_chances_sum_to_one():
    model = url_filter.Model({g: n for n, g in enumerate(url_filter.grams(url_filter.letters("abcabd.com/en/abc")), 1)})
    for context in ("", "a", "ab", "zzz", "^abc"):
        assert math.isclose(sum(model.chance(context, c) for c in url_filter.ALPHABET + "$"), 1)


def test_learns_the_difference(spark):
    rng = random.Random(1)
    good = ["".join(rng.choices("aeioubcd", k=12)) for _ in range(400)]
    bad = ["".join(rng.choices("xyzwqj01", k=12)) for _ in range(400)]
    rows = [f"http://a.com/{u}" for u in good[:300]] + [f"http://a.net/es/{u}" for u in bad[:300]] + [f"http://b.org/{u}" for u in good[300:] + bad[300:]]
    docs = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(docs).collect()}
    assert all(got[i] == "allow" for i in range(300)) and all(got[i] == "block" for i in range(300, 600))
    right = sum(got[i] == ("allow" if i < 700 else "block") for i in range(600, 800))
    assert right >= 190


def test_all_grams_count(spark):
    rng = random.Random(2)
    some = lambda k: "".join(rng.choices(url_filter.ALPHABET[:36], k=k))
    train = [(f"http://{some(3)}.com/{some(60)}", True) for _ in range(7000)] + [(f"http://{some(3)}.net/es/{some(60)}", False) for _ in range(7000)]
    rest = [f"http://{some(3)}.org/{some(60)}" for _ in range(500)] + [None, ""]
    docs = spark.createDataFrame([(i, u) for i, u in enumerate([u for u, _ in train] + rest)], "page_id long, url string")
    folds = {r.url: r.fold for r in docs.selectExpr("url", "pmod(xxhash64(url), 5) AS fold").collect()}
    models = [url_filter.Model(url_filter.Counter(g for u, w in train if w is good and folds[u] for g in url_filter.grams(url_filter.letters(u)))) for good in (True, False)]
    assert all(len(m.counts) > 300_000 for m in models)
    got = {r.page_id: r.score for r in url_filter.judge(docs).collect()}
    for i, u in enumerate(rest, len(train)):
        a, b = (sum(math.log(m.chance(g[:-1], g[-1])) for g in url_filter.needed(url_filter.letters(u))) for m in models)
        assert math.isclose(got[i], (a - b) / (len(url_filter.letters(u)) - 1), abs_tol=1e-9)


def test_long_repeated_and_null(spark):
    rows = [(i, f"http://a.com/{'ab' * (i % 40)}") for i in range(200)] + [(i, f"http://a.net/es/{'xy' * (i % 40)}") for i in range(200, 400)]
    odd = [(400, "http://b.org/" + "ab" * 50_000), (400, "http://b.org/" + "ab" * 50_000), (None, "http://b.org/abab"), (401, None), (402, ""), (402, ""), (403, "\u00e9\n://\u00e9")]
    docs = spark.createDataFrame(rows + odd, "page_id long, url string")
    got = url_filter.judge(docs).collect()
    assert len(got) == len(rows) + len(odd)
    same = [r for r in got if r.page_id == 400]
    assert len(same) == 2 and same[0] == same[1] and same[0].verdict == "allow" and same[0].host == "b.org"
    assert all(r.verdict in ("allow", "block") and (r.score is None) == (r.rule is not None) for r in got)
    assert sorted((r.page_id, r.host, r.path) for r in got if r.page_id and r.page_id > 400) == [(401, "", ""), (402, "", ""), (402, "", ""), (403, "\u00e9", "")]
    only = url_filter.judge(spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.org/y")], "page_id long, url string")).collect()
    assert {r.page_id: (r.verdict, r.score) for r in only} == {1: ("allow", None), 2: ("allow", None)}
