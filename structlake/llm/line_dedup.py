"""Line dedup by distinct-site spread (DataFrame functions only).

A line that stands on many sites is boilerplate. One aggregation over all lines
builds a HyperLogLog sketch of the sites of each line hash; tasks sketch before the
shuffle and sketches merge after it, so a line on every site is a row a task. Lines
whose estimate is near the threshold, and only these, get an exact distinct count.
The lines found go back to their documents as hashes; texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matching, written

MIN_SITES, MIN_CHARS, LG_K = 5, 20, 12


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """Two independent hashes of the line without outer blanks."""
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("h"), F.xxhash64(F.lit("line"), F.reverse(trimmed)).alias("g"))


def boilerplate_lines(docs: DataFrame, text_col: str, site_col: str, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K) -> DataFrame:
    """line (hash pair), sites: lines of at least ``min_chars`` on ``min_sites`` sites.

    Null sites are one site. ``sites`` is exact near the threshold and an
    estimate far above it.
    """
    rows = docs.select(F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))).alias("site"), F.xxhash64(text_col).alias("doc"), F.explode(_lines(F.col(text_col))).alias("text"))
    keyed = rows.filter(F.char_length(F.trim("text")) >= min_chars).select("site", "doc", _key(F.col("text")).alias("k")).select("site", "doc", "k.h", "k.g")
    # least and greatest tell lines of one site, nearly all, without an estimate
    sketched = keyed.groupBy("h", "g").agg(F.min("site").alias("one"), F.max("site").alias("two"), F.hll_sketch_agg("site", lg_k).alias("s")).filter("one <> two" if min_sites > 1 else "true")
    slack = max(1.0, 5 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    likely = written(sketched.select("h", "g", F.hll_sketch_estimate("s").alias("sites")).filter(F.col("sites") >= min_sites - slack), "line-estimates")
    near = likely.filter(F.col("sites") <= min_sites + slack).select("h", "g")
    # partial distinct counts leave a row for each near line and site in a task
    exact = matching(keyed, near, ["h", "g"], F.col("doc")).groupBy("h", "g").agg(F.count_distinct("site").alias("sites"))
    far = likely.filter(F.col("sites") > min_sites + slack)
    return exact.filter(F.col("sites") >= min_sites).unionByName(far)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, lg_k: int = LG_K) -> DataFrame:
    """One row per input row: id, clean text, n_lines, n_removed.

    Every occurrence of a boilerplate line goes; other lines stay as they are and
    in order. A text all of whose lines go becomes ''. Lines compare without
    outer blanks; shorter ones than ``min_chars`` always stay. Null texts count
    as ''. Rows with the same id are cleaned each by itself. Other columns are
    ignored.
    """
    bad = written(boilerplate_lines(docs, text_col, site_col, min_sites, min_chars, lg_k), "boilerplate").select("h", "g")
    hashed = docs.select(F.col(id_col).alias("_id"), F.explode(_lines(F.col(text_col))).alias("line")).filter(F.char_length(F.trim("line")) >= min_chars)
    hits = hashed.select("_id", _key(F.col("line")).alias("k")).select("_id", "k.h", "k.g")
    hits = matching(hits, bad, ["h", "g"], F.col("_id"))
    per = hits.groupBy("_id").agg(F.collect_set(F.struct("h", "g")).alias("_bad"))
    lines = _lines(F.col(text_col))
    joined = docs.select(F.col(id_col), F.col(text_col)).join(per, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    long_ = lambda x: F.char_length(F.trim(x)) >= min_chars
    kept = F.when(F.col("_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~(long_(x) & F.array_contains("_bad", _key(x)))))
    return joined.withColumn("_kept", kept).select(id_col, F.array_join("_kept", "\n").alias("text"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("_kept")).cast("long").alias("n_removed"))


#: DuckDB's form of the registered query.
SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE length(trim(line, ' ')) >= 20 GROUP BY 1 HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
k AS (SELECT l.*, b.line IS NOT NULL AS bad FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT bad), '')) AS text_sha256
FROM k GROUP BY doc_id
"""
