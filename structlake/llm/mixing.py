"""Mixing sources to target weights by hash-threshold histograms.

DataFrame functions only. Each document has a hash of its id (and one of its text, for
rows that repeat an id). Words are summed
by source and hash bucket; the running sum over a source's buckets shows in
which bucket the source's budget runs out. Only that bucket is split further,
by the next bits of the hash, until it holds one hash. Documents under the
threshold are taken: a filter, no sort of the documents. Thresholds are nested,
so a larger budget takes a superset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

HASH_BITS, LEVEL_BITS = 60, 12
WEIGHTS = (5.0, 2.0, 1.0)


def id_hash(id_col: Column, seed: str = "mix") -> Column:
    """60 bits of an MD5 digest of the id; SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")), F.lit(seed))), 1, 15), 16, 10).cast("long")


def text_hash(text_col: Column) -> Column:
    """60 bits of an MD5 digest of the text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, full: words to take from each source.

    Sources by code point, null last, take the weights in turn. ``share`` of all
    words is dealt out by weight; no target passes ``most`` times its source,
    and the excess goes to the others by weight. The table has a row per source.
    A source is full when its target is at that bound: going through sources by
    size over weight, the first that stays below what is left settles all later
    ones.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = per.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    ranked = weighted.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_left"),
        F.sum("_w").over(after).alias("_wsum"),
        F.row_number().over(by_ratio).alias("_k"),
    )
    open_ = F.col("_left") / F.col("_wsum") * F.col("_w") <= F.lit(most) * F.col("source_size")
    first = ranked.withColumn("_first", F.min(F.when(open_, F.col("_k"))).over(every))
    scaled = first.withColumn("_scale", F.max(F.when(F.col("_k") == F.col("_first"), F.col("_left") / F.col("_wsum"))).over(every))
    full = F.col("_first").isNull() | (F.col("_k") < F.col("_first"))
    target = F.when(full, F.lit(most) * F.col("source_size")).otherwise(F.col("_scale") * F.col("_w"))
    return scaled.select("source", "source_size", target.cast("double").alias("target"), full.alias("full"))


def budget_thresholds(sizes: DataFrame, budgets: DataFrame, level_bits: int = LEVEL_BITS, hash_bits: int = HASH_BITS) -> DataFrame:
    """source, threshold, tied, tie_threshold: documents with a smaller hash use up the budget.

    ``sizes`` (source, size, hash, tie), ``budgets`` (source, budget, above nought and
    no more than the source). The document at the boundary is taken when at
    least half of it fits. Where several rows have the boundary's hash, ``tied`` is this
    hash, and those of them with a smaller ``tie`` than ``tie_threshold`` are taken too. One
    job a level, over the boundary bucket only.
    """
    done, several, inside = _thresholds(sizes.filter("size > 0").select("source", "size", "hash", "tie"), budgets, level_bits, hash_bits)
    single = done.withColumns({"tied": F.lit(None).cast("long"), "tie_threshold": F.lit(None).cast("long")})
    if several.isEmpty():
        return single
    keys = several.select(F.col("source").alias("_s"), F.col("least").alias("_h"))
    rows = inside.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.col("hash") == F.col("_h")), "left_semi")
    ties, alike, _ = _thresholds(rows.select("source", "size", F.col("tie").alias("hash"), F.col("hash").alias("tie")), several.select("source", "budget"), level_bits, hash_bits)
    # rows of one id and one text are taken together
    last = ties.unionByName(_at_boundary(alike)).select(F.col("source").alias("_s"), F.col("threshold").alias("tie_threshold"))
    return single.unionByName(several.join(last, F.col("source").eqNullSafe(F.col("_s"))).select("source", F.col("least").alias("threshold"), F.col("least").alias("tied"), "tie_threshold"))


def _at_boundary(edge: DataFrame) -> DataFrame:
    return edge.select("source", (F.col("least") + F.when(2 * F.col("budget") >= F.col("words"), 1).otherwise(0)).alias("threshold"))


def _thresholds(inside: DataFrame, budgets: DataFrame, level_bits: int, hash_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, threshold), the boundaries where several rows share the hash, and the rows left at the end."""
    open_ = budgets.filter("budget > 0").select("source", F.col("budget").cast("double").alias("budget"))
    edges = []
    low = hash_bits
    while low > 0:
        low = max(0, low - level_bits)
        histogram = inside.groupBy("source", F.shiftright("hash", low).alias("bucket")).agg(F.sum("size").alias("words"), F.min("hash").alias("least"), F.max("hash").alias("top"), F.count("*").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = histogram.withColumn("upto", F.sum("words").over(run))
        met = summed.alias("h").join(open_.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source"))).filter("upto >= budget and upto - words < budget")
        edge = written(met.select("h.source", "bucket", "words", "least", "top", "n", (F.col("budget") - F.col("upto") + F.col("words")).alias("budget")), "mix-edge")
        edges.append(edge.filter("least = top"))
        rest = edge.filter("least < top")
        if low == 0 or rest.isEmpty():
            break
        open_ = rest.select("source", "budget")
        keys = rest.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"))
        inside = written(inside.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("hash", low) == F.col("_b")), "left_semi"), "mix-bucket")
    found = reduce(DataFrame.unionByName, edges)
    return _at_boundary(found.filter("n = 1")), found.filter("n > 1"), inside


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: int, level_bits: int) -> DataFrame:
    """_id, source, tie, size, source_size, target, copies of every row."""
    sizes = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash"), text_hash(F.col(text_col)).alias("tie")), "mix-sizes")
    whole = F.when(F.col("full"), F.lit(most)).otherwise(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = written(source_targets(sizes, weights, share, float(most)).withColumn("whole", whole.cast("long")), "mix-targets")
    budgets = targets.select("source", F.when(F.col("full"), 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    limits = budget_thresholds(sizes, budgets, level_bits)
    plan = targets.alias("t").join(limits.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left").select("t.*", "threshold", "tied", "tie_threshold")
    taken = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("tied")) & (F.col("tie") < F.col("tie_threshold")))
    copies = F.col("whole") + F.when(taken, 1).otherwise(0)
    joined = sizes.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.select("d._id", "d.source", "d.tie", "size", F.col("source_size").cast("long"), "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, level_bits: int = LEVEL_BITS) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken.

    A document's size is its number of words (null text: 0). It is taken whole,
    ``copies`` times: as often as its source is used up by the target, and once
    more while the rest of the target lasts. Null is a source like any other.
    Rows that repeat an id are told apart by their texts; of rows alike in both, all are
    taken equally often. Other columns are ignored. The same rows give the same mix on every run.
    """
    got = _copies(docs, id_col, text_col, source_col, weights, share, most, level_bits)
    return got.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, level_bits: int = LEVEL_BITS) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its ``copies``.

    One id in two sources, or with two texts, is two documents; rows alike in all three
    are taken together. All columns stay; an empty table gives no rows.
    """
    got = _copies(docs, id_col, text_col, source_col, weights, share, most, level_bits)
    taken = got.filter("copies > 0").select(F.col("_id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("copies").cast("int").alias("__copies")).distinct()
    times = docs.join(taken, F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (text_hash(F.col(text_col)) == F.col("__tie"))).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return times.select(*docs.columns)


#: DuckDB's form of ``mix`` over ``documents``.
SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 15) AS BIGINT) AS hash FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
k AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_,
             sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum,
             row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM w),
f AS (SELECT *, min(CASE WHEN left_ / wsum * w <= 2.0::DOUBLE * source_size THEN k END) OVER () AS first_ FROM k),
g AS (SELECT *, max(CASE WHEN k = first_ THEN left_ / wsum END) OVER () AS scale, first_ IS NULL OR k < first_ AS full_ FROM f),
t AS (SELECT source, source_size, CASE WHEN full_ THEN 2.0::DOUBLE * source_size ELSE scale * w END AS target,
             CASE WHEN full_ THEN 2 WHEN source_size > 0 THEN CAST(floor(scale * w / source_size) AS BIGINT) ELSE 0 END AS whole, full_ FROM g),
b AS (SELECT *, CASE WHEN full_ THEN 0 ELSE target - whole * source_size END AS budget FROM t),
r AS (SELECT d.*, source_size, target, whole, budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY d.source, hash) AS same
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       whole + CASE WHEN budget > 0 AND upto - same < budget AND (upto < budget OR 2 * (budget - (upto - same)) >= same) THEN 1 ELSE 0 END AS copies,
       CAST(size * (whole + CASE WHEN budget > 0 AND upto - same < budget AND (upto < budget OR 2 * (budget - (upto - same)) >= same) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
