import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from structlake.llm.warc import WarcArchive, page_facts

SCHEMA = "page_id long, url string, html string, digest string, first string"


def pages():
    big, other = "<p>é</p>" * 200, "x" * 1000
    out = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "http://b/\r\nWARC-Type: revisit", other), (5, "http://b/5", other[1:]), (6, "http://b/6", other[1:])]
    out += [(8, "u", None), (9, "u", ""), (10, None, None), (None, "n", big), (None, "n", "y" * 1200), (None, "m", "y" * 1200), (7, "again", big), (12, "w", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" * 40)]
    out += [(k, f"http://c/{k}", "hot page " * 150) for k in range(100, 160)]
    return [(*r, "d", "f") for r in out]


def brute(some):
    first = {}
    for key, _, html, *_ in some:
        if key is not None:
            first[html or ""] = max(first.get(html or "", key), key)
    out = []
    for key, _, html, *_ in some:
        b = (html or "").encode()
        again = len(b) >= 1000 and key != first.get(html or "")
        out.append((key, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=repr)


def archive_of(spark, path, some):
    archive = WarcArchive(spark, f"file://{path}/archive")
    archive.append_pages(spark.createDataFrame(some, SCHEMA).repartition(3))
    return archive


def test_equals_brute_force_and_stores_payloads_once(spark, tmp_path):
    archive = archive_of(spark, tmp_path, pages())
    assert sorted(map(tuple, page_facts(archive).collect()), key=repr) == brute(pages())
    distinct = {(r[2] or "").encode() for r in pages()}
    assert sorted(bytes(r.payload) for r in archive.payloads().collect()) == sorted(distinct)
    # a second append of the same and of one more page stores only what is new
    archive.append_pages(spark.createDataFrame([*pages(), (500, "z", "a new page", "d", "f")], SCHEMA))
    assert archive.payloads().count() == len(distinct) + 1 and archive.headers().count() == 2 * len(pages()) + 1


def test_empty_tables(spark, tmp_path):
    assert page_facts(archive_of(spark, tmp_path, [])).count() == 0
    assert page_facts(WarcArchive(spark, f"file://{tmp_path}/none")).count() == 0


def test_records_come_back_exactly(spark, tmp_path):
    some = [("WARC/1.1\r\nX-Any: 1\r\n\r\n", b"\x00\xff\r\n\r\nWARC/1.1"), ("WARC/1.0\r\nX: é\r\n\r\n", b""), ("", None), (None, b"\x00\xff\r\n\r\nWARC/1.1"), ("same\r\n\r\n", b"q"), ("same\r\n\r\n", b"q")]
    archive = WarcArchive(spark, f"file://{tmp_path}/a")
    archive.append_records(spark.createDataFrame(some, "header string, payload binary"))
    got = sorted((r.header, bytes(r.payload)) for r in archive.records().collect())
    assert got == sorted((h or "", p or b"") for h, p in some) and archive.payloads().count() == 3


def read_warc(data):
    """(fields, block) of the records of a WARC file, by their lengths."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        out.append((fields, data[end + 4 : end + 4 + n]))
        at = end + 4 + n
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    return out


def test_exported_files_are_valid(spark, tmp_path):
    archive = archive_of(spark, tmp_path, pages())
    archive.export(f"file://{tmp_path}/files")
    found = [r for f in sorted((tmp_path / "files").glob("part-*")) for r in read_warc(f.read_bytes())]
    told = []
    for fields, block in found:
        head, body = block.split(b"\r\n\r\n", 1)
        n = int(head.split(b"Content-Length: ")[1])
        key = fields["WARC-Record-ID"][len("<urn:page:") : -1]
        refers = fields.get("WARC-Refers-To")
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response":
            assert len(body) == n and hashlib.sha1(body).hexdigest() == digest
        else:
            assert body == b""
        told.append((int(key) if key else None, n, digest, fields["WARC-Type"], int(refers[len("<urn:page:") : -1]) if refers else None))
    assert sorted(told, key=repr) == brute(pages())


def test_damage_is_found(spark, tmp_path):
    archive = archive_of(spark, tmp_path, pages()[:3])
    bad = archive.payloads().withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(f"file://{tmp_path}/bad")
    archive._table = lambda kind, schema: spark.read.parquet(f"file://{tmp_path}/bad") if kind == "payloads" else WarcArchive._table(archive, kind, schema)
    with pytest.raises(PySparkException, match="doesn't give its digest"):
        page_facts(archive).collect()


def test_colliding_digests_are_found(spark, tmp_path):
    archive = WarcArchive(spark, f"file://{tmp_path}/c")
    rows = spark.createDataFrame([(b"d", b"one"), (b"d", b"two")], "digest binary, payload binary")
    with pytest.raises(PySparkException, match="two payloads"):
        archive._store(spark.createDataFrame([], "header string, digest binary"), rows)


def test_unfinished_appends_are_not_read(spark, tmp_path):
    archive = archive_of(spark, tmp_path, pages())
    before = archive.headers().count()
    rows = spark.createDataFrame([(b"d", b"one")], "digest binary, payload binary")
    rows.write.parquet(f"file://{tmp_path}/archive/payloads/died")
    (tmp_path / "archive/headers/died").mkdir()
    assert archive.headers().count() == before and archive.payloads().filter("payload = X'6F6E65'").count() == 0
