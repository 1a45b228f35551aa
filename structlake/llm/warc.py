"""WARC records in a content-addressed archive.

Payload bytes are stored once, under their SHA-256; the exact header text of every
record (WARC fields and HTTP head) is stored apart, with the digest of its payload.
A record is put together again by a join on the digest. Digests are verified twice: as
payloads are stored, all that fall together under one must agree in length and in a
second hash, and as they are read, the bytes must still give their digest. Either
failure stops the job.

Copies of a payload collapse before the shuffle. Headers travel without payloads, and
a payload that many records share can be split in both joins. Appending writes the new
payloads first and the headers last, under a name that is the same for both, and only
payloads whose headers were written whole are read. A run that dies in between leaves
nothing that readers see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Fixed values of the format.
CRLF = "\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_BYTES = 1000
HEADERS, PAYLOADS = "header string, digest binary", "digest binary, payload binary"


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a string column; null gives no bytes."""
    return F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _name(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def record_header(key: Column, url: Column, sha1: Column, n_bytes: Column, refers_to: Column, is_revisit: Column, date: str) -> Column:
    """The text before a record's payload: WARC fields and the HTTP head.

    A revisit has no payload, so its block is the head alone. Line breaks in an url are
    percent-encoded; a null url has no field.
    """
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), n_bytes.cast("string"), F.lit(CRLF + CRLF))
    place = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(VERSION + CRLF),
        field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _name(key)),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", place), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(is_revisit, F.concat(field("WARC-Refers-To", _name(refers_to)), field("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", (F.octet_length(head) + F.when(is_revisit, 0).otherwise(n_bytes)).cast("string")),
        F.lit(CRLF),
        head,
    )


def header_field(header: Column, name: str) -> Column:
    """The value of a WARC field; null where the record lacks it."""
    fields = F.substring_index(header, CRLF + CRLF, 1)
    value = F.regexp_extract(fields, rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(F.contains(fields, F.lit(f"{CRLF}{name}: ")), value)


def page_of(name: Column) -> Column:
    """The page id in a record's name."""
    return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


class WarcArchive:
    """Headers and payloads under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _batches(self) -> list[str]:
        """Names of the appends that were finished."""
        path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path(f"{self.root}/headers")):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/headers")))
        return sorted(n for n in names if fs.exists(path(f"{self.root}/headers/{n}/_SUCCESS")))

    def _table(self, kind: str, schema: str) -> DataFrame:
        places = [f"{self.root}/{kind}/{n}" for n in self._batches()]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def _store(self, headers: DataFrame, contents: DataFrame) -> None:
        """Append headers (header, digest) and the payloads (digest, payload) that aren't there yet."""
        name = uuid.uuid4().hex
        second, size = F.xxhash64("payload"), F.octet_length("payload")
        once = contents.groupBy("digest").agg(F.first("payload").alias("payload"), F.min(second).alias("_a"), F.max(second).alias("_b"), F.min(size).alias("_c"), F.max(size).alias("_d"))
        same = (F.col("_a") == F.col("_b")) & (F.col("_c") == F.col("_d"))
        new = once.select("digest", F.when(same, F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest"))).alias("payload"))
        if self._batches():
            new = new.join(self._table("payloads", PAYLOADS).select("digest"), "digest", "left_anti")
        new.write.parquet(f"{self.root}/payloads/{name}")
        headers.select("header", "digest").write.parquet(f"{self.root}/headers/{name}")

    def append_records(self, records: DataFrame, header: str = "header", payload: str = "payload") -> None:
        """Records whose header texts stand already; a null payload is empty. Their order is not kept."""
        rows = records.select(F.coalesce(F.col(header), F.lit("")).alias("header"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("digest", _digest(F.col("payload")))
        self._store(rows.select("header", "digest"), rows.select("digest", "payload"))

    def append_pages(self, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "2000-01-01T00:00:00Z") -> None:
        """One record per row: a response, or a revisit of the response with the same payload.

        Of rows with equal payloads of at least ``least_bytes`` bytes that with the
        largest id is the response (rows that repeat this id are responses too); the others,
        null ids among them, revisit it. Where all ids are null, all are responses. Shorter
        payloads are always responses. A null html is an empty payload. Other columns are
        ignored; an empty table adds no record.
        """
        rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), payload_of(F.col(html_col)).alias("payload")).withColumn("digest", _digest(F.col("payload")))
        narrow = rows.select("key", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n_bytes"))
        # written, so that Spark can split the rows of a hot payload in the join
        held = written(narrow.groupBy("digest").agg(F.max("key").alias("first")), "warc-responses")
        joined = narrow.join(held, "digest")
        again = (F.col("n_bytes") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first"))
        header = record_header(F.col("key"), F.col("url"), F.col("sha1"), F.col("n_bytes"), F.col("first"), again, date)
        self._store(joined.select(header.alias("header"), "digest"), rows.select("digest", "payload"))

    def payloads(self) -> DataFrame:
        """digest, payload: every payload once, its bytes verified."""
        got = self._table("payloads", PAYLOADS)
        whole = _digest(F.col("payload")) == F.col("digest")
        return got.select("digest", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't give its digest"))).alias("payload"))

    def headers(self) -> DataFrame:
        """header, digest: a row for each record."""
        return self._table("headers", HEADERS)

    def records(self) -> DataFrame:
        """header, payload: every record with its full payload, revisits too."""
        return self.headers().join(self.payloads(), "digest").select("header", "payload")

    def export(self, path: str, compression: str = "none") -> None:
        """The records as WARC files: responses with their payloads, revisits without."""
        block = F.when(header_field(F.col("header"), "WARC-Type").eqNullSafe("revisit"), F.lit(b"")).otherwise(F.col("payload"))
        # a record ends with two line ends; the writer adds the second
        record = F.concat(F.encode("header", "UTF-8"), block, F.encode(F.lit(CRLF), "UTF-8")).cast("string")
        self.records().select(record.alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)


def page_facts(archive: WarcArchive) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from the records."""
    sha1 = F.sha1("payload")
    told = header_field(F.col("header"), "WARC-Payload-Digest")
    digest = F.when(F.concat(F.lit("sha1:"), sha1).eqNullSafe(told), sha1).otherwise(F.raise_error(F.lit("a record's header names another payload")))
    return archive.records().select(
        page_of(header_field(F.col("header"), "WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        header_field(F.col("header"), "WARC-Type").alias("record_type"),
        page_of(header_field(F.col("header"), "WARC-Refers-To")).alias("refers_to"),
    )


#: DuckDB's form of the registered query.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to
FROM p JOIN g USING (html)
"""
