r"""URL filters by expression expansion and hash-prefix joins.

A rule (host, path, verdict) fits its host and all subdomains when the url's
path starts with the rule's path. Every url is expanded into expressions: each
suffix of its host at a label border, with each prefix of its path that ends
with a slash (and the empty one). A rule is posted under its host and its path
up to the last slash, so any fitting rule shares an expression with the url.
The join is an equi-join on the first 32 bits of the expressions' SHA-256; the
full digests are compared afterwards, then the rest of the rule's path. Of all
rules that fit, the longest wins (host and path together; then the longer host,
then block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed rules of the registered query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules of at most so many bytes are broadcast; larger sets are shuffled.
BROADCAST_BYTES = 32 << 20


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", host, folder), 256))


def _prefix(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    Rules have columns host (A-Z count as lower case), path, verdict; null parts count as ''. A null url or
    one without ``://`` has an empty host and path; no rule fits an empty host.
    Rows are judged by distinct (host, path), so a host with a third of all urls
    adds little to the join. Other columns are ignored.
    """
    split = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    posted = rules.select(
        _lower(F.coalesce("host", F.lit(""))).alias("_rhost"), F.coalesce("path", F.lit("")).alias("_rpath"), F.col("verdict").alias("_verdict")
    ).distinct().filter("_rhost != ''")
    posted = posted.withColumn("_digest", _digest(F.col("_rhost"), F.regexp_extract("_rpath", r"(?s)^.*/", 0))).withColumn("_short", _prefix(F.col("_digest")))
    posted = written(posted, "url-rules")
    deepest = posted.agg(
        F.coalesce(F.max(F.size(F.split("_rhost", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("_rpath", "/")) - 1), F.lit(0)).alias("slashes"),
        F.coalesce(F.sum(F.length("_rhost") + F.length("_rpath") + 64), F.lit(0)).alias("bytes"),
    ).first()
    # distinct (host, path): what is expanded and joined
    folder = F.regexp_extract("path", r"(?s)^.*/", 0)
    labels, steps = F.split("host", r"\."), F.split("folder", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest.labels))), lambda k: F.concat_ws(".", F.slice("labels", -k, k)))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size("steps") - 1, F.lit(deepest.slashes))), lambda k: F.when(k == 0, "").otherwise(F.concat(F.concat_ws("/", F.slice("steps", 1, k)), F.lit("/"))))
    distinct = split.filter("host != ''").select("host", "path").distinct().withColumn("folder", folder)
    expressions = (
        distinct.withColumns({"labels": labels, "steps": steps})
        .filter(F.lit(deepest.labels) > 0)
        .select("host", "path", F.explode(suffixes).alias("_h"), prefixes.alias("_ps"))
        .select("host", "path", "_h", F.explode("_ps").alias("_p"))
        .select("host", "path", _digest(F.col("_h"), F.col("_p")).alias("_full"))
        .withColumn("_short", _prefix(F.col("_full")))
    )
    side = F.broadcast(posted) if deepest.bytes <= broadcast_bytes else posted
    hits = expressions.join(side, "_short").filter((F.col("_full") == F.col("_digest")) & F.startswith("path", "_rpath"))
    rank = F.struct(F.length(F.concat("_rhost", "_rpath")), F.length("_rhost"), (F.col("_verdict") == "block").cast("int"), F.concat("_rhost", "_rpath").alias("rule"), F.col("_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("_best"))
    # written, so that both sides are dealt anew and Spark can split a hot url; it has a
    # row for each url that a rule fits, so it isn't broadcast
    hosted = split.filter("host != ''").join(written(best, "url-verdicts").hint("merge"), ["host", "path"], "left")
    out = hosted.unionByName(split.filter("host = ''"), allowMissingColumns=True)
    return out.select(id_col, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: DuckDB's form of the registered query.
SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC, verdict DESC) AS k
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
