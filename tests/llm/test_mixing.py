from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweave.llm import mixing


def shares(blocks, weights):
    weights = [Fraction(str(w)) for w in weights]
    return _shares(blocks, weights)


def _shares(blocks, weights):
    """For every slot what each source has given in the ideal mixture, by stepping from one that runs out to the next."""
    left, given, out = [Fraction(b) for b in blocks], [Fraction(0) for _ in blocks], []
    for _ in range(sum(blocks)):
        out.append(list(given))
        rest = Fraction(1)
        while rest:
            alive = [s for s in range(len(blocks)) if left[s]]
            total = sum(Fraction(weights[s]) for s in alive)
            step = min(rest, *(left[s] * total / Fraction(weights[s]) for s in alive))
            for s in alive:
                part = step * Fraction(weights[s]) / total
                left[s], given[s] = left[s] - part, given[s] + part
            rest -= step
    return [*out, given]


def brute(blocks, weights):
    """Earliest deadline first over all blocks, with windows read off the ideal shares."""
    at = shares(blocks, weights)
    jobs = []
    for s, n in enumerate(blocks):
        for j in range(n):
            release = max(t for t in range(len(at)) if at[t][s] <= j)
            due = min(t for t in range(len(at)) if at[t][s] >= j + 1)
            jobs.append((due, s, j, release))
    slots = {}
    for t in range(sum(blocks)):
        job = min(x for x in jobs if x[3] <= t)
        assert job[0] > t
        jobs.remove(job)
        slots[job[1], job[2]] = t
    return slots


SOURCES = st.lists(st.tuples(st.integers(1, 25), st.one_of(st.integers(1, 50), st.floats(0.001, 1).map(lambda x: round(x, 3)))), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(SOURCES)
def test_equals_brute_force(sources):
    blocks, weights = map(list, zip(*sources, strict=True))
    for period in (1, 7, 1 << 16):
        plan = mixing.Plan(blocks, weights, period)
        assert {(s, j): t for k in range(plan.pieces) for s, j, t in plan.piece(k)} == brute(blocks, weights)


@settings(max_examples=60, deadline=None)
@given(SOURCES, st.integers(1, 30))
def test_less_than_a_block_from_the_share_over_all_pieces(sources, period):
    blocks, weights = map(list, zip(*sources, strict=True))
    plan = mixing.Plan(blocks, weights, period)
    rows = [r for k in range(plan.pieces) for r in plan.piece(k)]
    assert [t for _, _, t in rows] == list(range(sum(blocks)))
    taken = [0] * len(blocks)
    for (s, j, _), share in zip(rows, shares(blocks, weights)[1:], strict=True):
        assert taken[s] == j
        taken[s] += 1
        assert all(abs(taken[k] - share[k]) < 1 for k in range(len(blocks)))
    assert taken == blocks


def test_a_million_slots():
    blocks, weights = [500_000, 300_000, 200_000, 50], [2, 1, 0.3333, 0.0001]
    plan = mixing.Plan(blocks, weights)
    total, seen = sum(Fraction(str(w)) for w in weights), [0] * 4
    for k in range(plan.pieces):
        for s, j, t in plan.piece(k):
            assert seen[s] == j
            seen[s] += 1
            if t < 600_000 and not t % 97:  # none has run out by then
                assert all(abs(seen[i] - (t + 1) * Fraction(str(weights[i])) / total) < 1 for i in range(4))
    assert seen == blocks


def test_weights_without_a_small_measure_and_late_sources():
    plan = mixing.Plan([40, 3000, 1], [0.1234567890123, 1e-5, 3], 16)
    assert sorted(t for k in range(plan.pieces) for _, _, t in plan.piece(k)) == list(range(3041))
    plan = mixing.Plan([10**9, 10**9], [0.9999, 0.0001])
    assert plan.pieces < 2 * 10**9 / mixing.PERIOD + 10 and len(list(plan.piece(plan.pieces - 2))) >= mixing.PERIOD


def test_rows(spark):
    rows = [(i, "t", "a" if i % 3 else "b", i) for i in range(500)] + [(None, "t", None, 1), (7, "t", "a", 1), (7, "t", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot long")
    weights = {"a": 1, "b": 3, None: 1}
    got = mixing.mix(docs, weights, block=4, period=50).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[2]) for r in rows)
    assert len({(r.slot, r.position) for r in got}) == len(rows)
    names = ["a", "b", None]
    plan = mixing.Plan([-(-sum(r[2] == s for r in rows) // 4) for s in names], [weights[s] for s in names], 50)
    assert {(r.source, r.block, r.slot) for r in got} == {(names[s], j, t) for k in range(plan.pieces) for s, j, t in plan.piece(k)}
    assert max(Counter(r.slot for r in got).values()) == 4
    ordered = mixing.in_order(docs, weights, block=4)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.in_order(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 1})


def test_many_buckets_rank_as_one(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 5 = 0, 'b', 'a') AS source")
    one = {(r.doc_id, r.slot, r.position) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    assert {(r.doc_id, r.slot, r.position) for r in mixing.mix(docs).collect()} == one


def test_many_sources(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "concat('s', pmod(hash(id), 2000)) AS source")
    got = mixing.mix(docs).groupBy("slot").count().agg({"slot": "max", "count": "max"}).first()
    assert got["max(slot)"] >= 1900 and got["max(count)"] <= mixing.BLOCK
