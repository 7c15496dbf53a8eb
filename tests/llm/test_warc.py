import gzip

from sparkweave.llm import warc

BIG, SMALL = "é" * 600, "a" * 999
ROWS = [(1, "http://a/1", BIG, "x"), (2, "http://a/2", BIG, "x"), (3, None, BIG, "x"), (4, "http://b", SMALL, "x"), (5, "http://b\r\nX: y", SMALL, "x"), (6, "u", None, "x"), (None, "v", "q" * 2000, "x"), (None, "v", BIG, "x"), (7, "w", "<p>" * 200_000, "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark)).collect()}
    want = set()
    for key, _, html, _ in ROWS:
        data = (html or "").encode()
        again = html == BIG and key != 3
        want.add((key, len(data), warc.sha1(data), "revisit" if again else "response", 3 if again else None))
    assert got == want
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_filters_reach_the_reader(spark):
    files = warc.write(frame(spark))
    found = warc.read(spark, files).where("record_type = 'revisit' AND refers_to = '<urn:page:3>' AND target_uri LIKE 'http://a/%'")
    assert sorted(r.record_id for r in found.collect()) == ["<urn:page:1>", "<urn:page:2>"]
    reader = warc.WarcReader({"files": "[]"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_length",), 1)])) == []
    assert not reader.wanted({"record_type": "revisit", "payload_length": 1})


def test_unwanted_payloads_are_not_decoded(tmp_path):
    whole = warc.member(warc.record("response", "urn:page:1", "u", "0", 9000, None, bytes(range(256)) * 40))
    broken = whole[:400] + bytes(len(whole) - 400)  # headers are there, the payload is damaged
    kept = warc.member(warc.record("revisit", "urn:page:2", "u", "0", 9000, "urn:page:1", b""))
    path = tmp_path / "x.warc.gz"
    path.write_bytes(broken + kept)
    assert [r["record_id"] for r in warc.records(str(path), lambda r: r["record_type"] == "revisit")] == ["<urn:page:2>"]


def test_files_from_elsewhere(tmp_path):
    data = [warc.record("response", f"urn:page:{i}", "u", "0", 3, None, b"abc" * 3000 * i) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    for name in ("a.warc", "b.warc.gz"):
        assert [r["payload"] for r in warc.records(str(tmp_path / name), lambda r: True)] == [b"abc" * 3000 * i for i in range(3)]
