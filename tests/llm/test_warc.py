import base64
import hashlib

import pytest

from wattline.llm import warc

PAGES = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/\n3 x", "other é"), (4, None, None), (5, "http://a/5", ""), (None, "http://a/n", "same"), (None, "http://a/m", "lone"), (7, "http://a/7", "z" * 300000)]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def sha(s):
    return base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()


def test_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) for r in warc.archive_round_trip(pages(spark)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    want = [(1, 4, sha("same"), "revisit", 2, None), (2, 4, sha("same"), "response", None, True), (3, 8, sha("other é"), "response", None, True), (4, 0, sha(""), "revisit", 5, None),
            (5, 0, sha(""), "response", None, True), (7, 300000, sha("z" * 300000), "response", None, True), (None, 4, sha("lone"), "response", None, True), (None, 4, sha("same"), "revisit", 2, None)]
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_pushed_predicates_and_payloads(spark, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write(warc.page_records(pages(spark).repartition(2)), path, compression=compression, splitBytes="500")
    df = warc.read(spark, path)
    assert df.count() == len(PAGES)
    plan = df.filter("record_type = 'response'")._jdf.queryExecution().toString()
    assert "record_type" in plan
    assert {bytes(r.payload).decode() for r in df.filter("record_type = 'response'").collect()} == {"same", "other é", "", "lone", "z" * 300000}
    assert [r.target_uri for r in df.filter(f"payload_digest = '{sha('other é')}'").collect()] == ["http://a/%0A3%20x"]
    rid = lambda page, text: f"urn:x-page:{page}:{hashlib.sha1(text.encode()).hexdigest()}"
    assert df.filter(f"record_id in ('{rid(1, 'same')}', '{rid(2, 'same')}') and record_type = 'revisit'").count() == 1
    assert all(r.payload is None for r in warc.read(spark, path, payload="false").collect())


def test_unwanted_payloads_are_not_read(tmp_path):
    file = tmp_path / "a.warc"
    file.write_bytes(warc.record("response", "urn:x-page:1", "http://a", "2024-01-01T00:00:00Z", b"one", None) + warc.record("response", "urn:x-page:2", "http://b", "2024-01-01T00:00:00Z", b"two", None))
    reader = warc.WarcReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("target_uri",), "http://b"), GreaterThan(("payload_bytes",), 0)]))
    assert len(rest) == 1 and reader.wanted == {b"warc-target-uri": {"http://b"}}
    (span,) = reader.partitions()
    assert [r[0] for r in warc.records(span, reader.wanted, True)] == ["urn:x-page:2"]


def test_broken_record_and_empty_table(spark, tmp_path):
    file = tmp_path / "a.warc"
    file.write_bytes(warc.record("response", "urn:x-page:1", "u", "d", b"text", None)[:-8])
    with pytest.raises(ValueError, match="breaks off"):
        list(warc.records(warc.Span(str(file), 0, file.stat().st_size), {}, True))
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = lambda lo: warc.page_records(pages(spark, [(lo + i, "http://a", f"text {lo + i}") for i in range(5)]).repartition(3))
    texts = lambda: sorted(bytes(r.payload).decode() for r in warc.read(spark, path).collect())
    warc.write(rows(0), path)
    warc.write(rows(5), path)
    assert texts() == sorted(f"text {i}" for i in range(10))
    warc.write(rows(20), path, mode="overwrite")
    assert texts() == [f"text {i}" for i in range(20, 25)]
    assert len([f for f in (tmp_path / "w").iterdir() if f.name.startswith("_manifest")]) == 1
    warc.write(rows(5), path)
    assert len(texts()) == 10


def test_repeated_ids_and_long_payloads(spark):
    """A page_id with two payloads has two records; each reference names the record of its own payload."""
    long = "é" * 3_000_000
    rows = [(1, "u", "one"), (1, "u", "two"), (2, "u", "one"), (2, "u", "two"), (3, "u", long), (4, "u", long), (4, "u", long)]
    records = {(r.record_id, r.refers_to) for r in warc.page_records(pages(spark, rows)).collect()}
    rid = lambda page, text: f"urn:x-page:{page}:{hashlib.sha1(text.encode()).hexdigest()}"
    assert records == {(rid(1, "one"), rid(2, "one")), (rid(1, "two"), rid(2, "two")), (rid(2, "one"), None), (rid(2, "two"), None), (rid(3, long), rid(4, long)), (rid(4, long), None)}
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.digest_ok) for r in warc.archive_round_trip(pages(spark, rows)).filter("record_type = 'revisit'").collect())
    assert got == [(1, 3, "revisit", 2, None), (1, 3, "revisit", 2, None), (3, 6_000_000, "revisit", 4, None)]
    assert warc.archive_round_trip(pages(spark, rows)).filter("digest_ok").count() == 4
