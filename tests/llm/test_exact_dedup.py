import pytest
from pyspark.sql import functions as F

from sparkweave.llm import exact_dedup

ROWS = [(3, "a  b", "x"), (1, "a\tb", "y"), (2, None, "x"), (4, "", "x"), (None, "a b", "x"), (5, "c " * 40_000, "x"), (5, "c " * 40_000, "x"), (9, "d", None)]
WANT = {(3, 1, 3, False), (1, 1, 3, True), (2, 2, 2, True), (4, 2, 2, False), (None, 1, 3, False), (5, 5, 2, True), (5, 5, 2, False), (9, 9, 1, True)}


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, digest string")


def told(found):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)


def test_groups(spark):
    assert told(exact_dedup.groups(frame(spark))) == sorted(WANT, key=str)


def test_bytes_settle_a_weak_digest(spark):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    rows = [(i, f"text {i % 70}", "") for i in range(200)]
    want = sorted(((i, i % 70, 3 if i % 70 < 60 else 2, i < 70) for i in range(200)), key=str)
    assert told(exact_dedup.groups(frame(spark, rows), digest=weak)) == want


def test_empty(spark):
    assert exact_dedup.groups(frame(spark, [])).collect() == []
    assert exact_dedup.keep_first(frame(spark, [])).collect() == []


def test_keep_first_keeps_columns_and_one_of_repeated_rows(spark):
    got = exact_dedup.keep_first(frame(spark))
    assert got.columns == ["doc_id", "text", "digest"]
    assert sorted((r.doc_id, r.digest) for r in got.collect()) == [(1, "y"), (2, "x"), (5, "x"), (9, None)] or sorted(r.doc_id for r in got.collect()) == [1, 2, 5, 9]


def test_batches_and_runs_are_as_one(spark, tmp_path):
    rows = [(i * 7 % 500, f"text  {i % 90}" if i % 3 else f"text {i % 90}", "x") for i in range(400)]
    want = {(r[0], r[3]) for r in told(exact_dedup.groups(frame(spark, rows)))}
    docs = frame(spark, rows).repartition(5)
    assert {(r[0], r[3]) for r in told(exact_dedup.groups(docs, batch_bytes=1))} == want
    state, seen = f"file://{tmp_path}/state", {}
    for begin, end in ((0, 150), (150, 151), (151, 400)):
        found = told(exact_dedup.groups(frame(spark, rows[begin:end]), state=state, batch_bytes=1))
        assert sorted(r[0] for r in found) == sorted(r[0] for r in rows[begin:end])
        least, size = {}, {}
        for k, text, _ in rows[:end]:
            text = text.replace("  ", " ")
            least[text], size[text] = min(k, least.get(text, k)), size.get(text, 0) + 1
        text_of = {k: text.replace("  ", " ") for k, text, _ in rows}
        for k, keep, n, kept in found:
            assert (keep, n, kept) == (least[text_of[k]], size[text_of[k]], least[text_of[k]] == k)
            seen[k] = keep
    assert {k for k, keep in seen.items() if keep == k} >= {k for k, kept in want if kept and k in {r[0] for r in rows[151:]}}


def test_bytes_are_checked_against_earlier_runs(spark, tmp_path):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    state = f"file://{tmp_path}/state"
    assert len(told(exact_dedup.groups(frame(spark, [(1, "one", "x")]), digest=weak, state=state))) == 1
    with pytest.raises(ValueError):
        exact_dedup.groups(frame(spark, [(i, f"text {i}", "x") for i in range(2, 40)]), digest=weak, state=state)
