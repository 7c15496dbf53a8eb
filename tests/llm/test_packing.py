from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import packing


def slow(items, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], {}
    copies = [c for _, _, _, c in items]
    for key, size, source, cluster in items:
        while size > capacity:
            bins.append([0, {source}, set()])
            size -= capacity
        out[key] = [size, source, cluster if copies.count(cluster) > 1 else None]
    rest = sorted(out.items(), key=lambda kv: (-kv[1][0], kv[0]))
    open_bins, placed = [], {}
    for key, (size, source, cluster) in rest:
        fits = [(b[0], i) for i, b in enumerate(open_bins) if b[0] >= size and source not in b[1] and (cluster is None or cluster not in b[2])]
        if fits:
            at = min(fits)[1]
        else:
            open_bins.append([capacity, set(), set()])
            at = len(open_bins) - 1
        b = open_bins[at]
        b[0] -= size
        b[1].add(source)
        b[2].add(cluster)
        placed[key] = at
    return placed


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from("abc"), st.integers(0, 8)), max_size=30))
def test_tightest_bin_without_a_conflict(drawn):
    items = [(k, size, source, cluster) for k, (size, source, cluster) in enumerate(drawn)]
    found = packing.pack(items, 25)
    want = slow(items, 25)
    last = {}
    for key, piece, number, at, size in found:
        if key not in last or piece > last[key][0]:
            last[key] = (piece, number)
    groups = lambda d: sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))
    assert groups({k: b for k, (_, b) in last.items()}) == groups(want)
    filled = {}
    for key, _, number, at, size in sorted(found, key=lambda f: (f[2], f[3])):
        assert filled.get(number, 0) == at
        filled[number] = at + size
        assert filled[number] <= 25
    assert {k: sum(f[4] for f in found if f[0] == k) for k, *_ in items} == {k: s for k, s, *_ in items}


def test_rows(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 4}", 0) for i in range(300)] + [(300, None, None, 0), (None, "same", "s1", 0), (5, "x " * 1000, "s1", 0), (5, "x " * 1000, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bin_id long")
    got = packing.best_fit(docs, capacity=128, shard_rows=100).collect()
    words = lambda t: len((t or "").split()) + 1
    assert sum(r.n_tokens for r in got) == sum(words(t) for _, t, _, _ in rows)
    used = {}
    for r in got:
        used.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 128
    assert packing.best_fit(docs.limit(0)).count() == 0


def test_a_source_once_in_a_bin(spark):
    rows = [(i, "w " * (5 + i % 20), "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: s for i, _, s in rows}
    bins = {}
    for r in packing.best_fit(docs, capacity=128, shard_rows=200).collect():
        bins.setdefault(r.bin_id, []).append(source[r.doc_id])
    assert sum(map(len, bins.values())) == 600 and all(len(set(b)) == len(b) for b in bins.values())


def test_the_result_rests_on_the_rows_alone(spark):
    rows = [(i % 900, "w " * (i * 37 % 90), f"s{i % 11}") for i in range(1000)] + [(7, "same", "s")] * 300 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = [sorted(map(str, packing.best_fit(d, capacity=128, shard_rows=200).collect())) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy("text"))]
    assert told[0] == told[1] == told[2]
