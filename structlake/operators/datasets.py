"""Unions, reproducible splits, samples and standardisation."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept


def hash_order(key: str, seed: int = 42) -> Column:
    """An order that every engine with MD5 can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def running(rows: DataFrame, order: list[Column], name: str, amount: Column | None = None, by: str | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` (1 where left out) up to each row in ``order``.

    No task holds all rows: they are dealt to ranges of the order and written once with
    the number of their range, so that the ranges that are summed are the ranges that
    are numbered. Each range goes on where those before it end. With ``by`` the sum
    starts anew in each group; a hot group spreads over several ranges. Ties of the
    whole order take any sequence.
    """
    names = [f"_o{k}" for k in range(len(order))]
    keys = [by, *names] if by else names
    ranged = rows.withColumns(dict(zip(names, order, strict=True)) | {"_a": F.lit(1) if amount is None else amount}).repartitionByRange(*keys)
    stored = kept(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    groups = ["_part", by] if by else ["_part"]
    local = stored.withColumn("_i", F.sum("_a").over(Window.partitionBy(*groups).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)))
    counts = stored.groupBy(*groups).agg(F.sum("_a").alias("_c"))
    # a row for each range (and group in it): as many as there are partitions and groups
    before = Window.partitionBy(by).orderBy("_part") if by else Window.orderBy("_part")
    starts = counts.select(F.col("_part").alias("_p"), *([F.col(by).alias("_b")] if by else []), (F.sum("_c").over(before) - F.col("_c")).alias("_s"))
    on = F.col("_part") == F.col("_p")
    if by:
        on &= F.col(by).eqNullSafe(F.col("_b"))
    return local.join(starts, on).withColumn(name, F.col("_i") + F.col("_s")).drop(*names, "_a", "_part", "_i", "_p", "_b", "_s")


def numbered(rows: DataFrame, order: list[Column], name: str = "_n", by: str | None = None) -> DataFrame:
    """Adds ``name`` = 1, 2, ... in ``order`` (within each ``by``), see ``running``."""
    return running(rows, order, name, None, by)


def split_by_count(rows: DataFrame, key: str, counts: list[int], shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Adds ``part`` 0, 1, ...: disjoint parts of these sizes; rows beyond are dropped."""
    edges = list(itertools.accumulate(counts))
    order = [hash_order(key, seed), F.col(key)] if shuffle else [F.col(key)]
    first = numbered(rows, order).filter(F.col("_n") <= edges[-1])
    part = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        part = F.when(F.col("_n") <= edges[k], k).otherwise(part)
    return first.withColumn("part", part).drop("_n")


def split_by_fraction(rows: DataFrame, key: str, fractions: list[float], shuffle: bool = True, seed: int = 42) -> DataFrame:
    """Parts of floor(n * fraction) rows each; what is left over is dropped."""
    n = rows.count()
    return split_by_count(rows, key, [int(n * f) for f in fractions], shuffle, seed)


def split_grouped(rows: DataFrame, key: str, parent: Column, fractions: list[float], seed: int = 42) -> DataFrame:
    """As ``split_by_fraction`` over parents; siblings share a part."""
    tagged = rows.withColumn("_parent", parent)
    parts = split_by_fraction(tagged.select("_parent").distinct(), "_parent", fractions, seed=seed)
    return tagged.join(parts, "_parent").drop("_parent")


def train_test_split(rows: DataFrame, key: str, ratio_test: float = 0.1, shuffle: bool = True, seed: int = 42) -> DataFrame:
    """part 0 (train) and 1 (test, floor(n * ratio) rows)."""
    n = rows.count()
    test = int(n * ratio_test)
    return split_by_count(rows, key, [n - test, test], shuffle, seed)


def slice_rows(rows: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows first..last (from 1) in ``order``."""
    return numbered(rows, [F.col(c) for c in order]).filter(F.col("_n").between(first, last)).drop("_n")


def weighted_sample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, each draw in proportion to its weight (exponential keys, top n)."""
    u = (F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") + 1) / float(16**13 + 1)
    return rows.filter(F.col(weight) > 0).withColumn("_x", -F.log(u) / F.col(weight)).orderBy("_x", key).limit(n).drop("_x")


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; the schemas must agree by name and type."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise ValueError(f"tables differ: {a.dtypes} and {b.dtypes}")
    return a.unionByName(b)


def fit_target_standardizer(rows: DataFrame, energy: str, natoms: str) -> tuple[float, float]:
    """Mean and sample deviation of the energy per atom (deviation 1 without spread)."""
    per = F.col(energy) / F.col(natoms)
    got = rows.agg(F.avg(per).alias("mean"), F.stddev_samp(per).alias("std")).first()
    return got.mean or 0.0, got.std if got.std else 1.0


def fit_standardizer(features: DataFrame, vector: str, first: int = 1) -> DataFrame:
    """slot, mean, std of every slot from ``first`` on, over all atoms (sample std).

    A slot without spread gets std 1.
    """
    rows = features.select(F.posexplode(vector).alias("_p", "_x")).withColumn("slot", F.col("_p") + 1).filter(F.col("slot") >= first)
    got = rows.groupBy("slot").agg(F.avg("_x").alias("mean"), F.stddev_samp(F.col("_x").cast("double")).alias("std"))
    return got.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def _stats(standardizer: DataFrame, n: int) -> tuple[Column, Column]:
    """Means and deviations as array literals (a value per feature slot)."""
    got = {r.slot: r for r in standardizer.collect()}
    mean = F.array(*(F.lit(got[k].mean if k in got else 0.0) for k in range(1, n + 1)))
    std = F.array(*(F.lit(got[k].std if k in got else 1.0) for k in range(1, n + 1)))
    return mean, std


def apply_standardizer(features: DataFrame, vector: str, standardizer: DataFrame, n: int) -> DataFrame:
    """(x - mean) / std per slot; slots without statistics stay."""
    mean, std = _stats(standardizer, n)
    return features.withColumn(vector, F.zip_with(F.zip_with(F.col(vector), mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s))


def invert_standardizer(features: DataFrame, vector: str, standardizer: DataFrame, n: int) -> DataFrame:
    mean, std = _stats(standardizer, n)
    return features.withColumn(vector, F.zip_with(F.zip_with(F.col(vector), std, lambda x, s: x.cast("double") * s), mean, lambda x, m: x + m))


def transform_y(energy: Column, natoms: Column, mean: float, scale: float) -> Column:
    return (energy / natoms - mean) / scale * natoms


def _blocks_times(tail: Column, matrix: list[list[float]]) -> Column:
    """Each block of len(matrix) slots becomes block . matrix."""
    rows, cols = len(matrix), len(matrix[0])
    weights = F.array(*(F.array(*(F.lit(float(matrix[r][c])) for r in range(rows))) for c in range(cols)))
    blocks = F.transform(F.sequence(F.lit(1), F.floor(F.size(tail) / rows).cast("int")), lambda b: F.slice(tail, (b - 1) * rows + 1, F.lit(rows)))
    blocks = F.when(F.size(tail) >= rows, blocks).otherwise(F.array().cast("array<array<double>>"))
    dot = lambda block, w: F.aggregate(F.zip_with(block, w, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return F.flatten(F.transform(blocks, lambda b: F.transform(weights, lambda w: dot(b, w))))


def embed_features(features: DataFrame, vector: str, ones: int, matrix: list[list[float]], twos: int | None = None, matrix3: list[list[float]] | None = None) -> DataFrame:
    """One-body slots stay; blocks of pair slots times ``matrix``, of triplet slots times ``matrix3``.

    ``ones`` and ``twos`` are the numbers of one-body and pair slots; without ``twos``
    all slots after the first are pairs.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    n = F.greatest(F.size(vector) - ones, F.lit(0))
    pairs = F.slice(x, ones + 1, n if twos is None else F.least(n, F.lit(twos)))
    parts = [F.slice(x, 1, ones), _blocks_times(pairs, matrix)]
    if matrix3 is not None:
        parts.append(_blocks_times(F.slice(x, ones + twos + 1, F.greatest(n - twos, F.lit(0))), matrix3))
    return features.withColumn(vector, F.concat(*parts))


PARTS = ("train", "test", "validate")


def write_dataset(rows: DataFrame, path: str, label: str = "label", fractions: tuple[float, ...] = (0.8, 0.1, 0.1), gen: str = "gen", seed: int = 42) -> None:
    """Rows split by label (all rows of a label together) into train, test and validate.

    A folder per generation and part, and beside it the manifest: label and part.
    Labels beyond the fractions are left out.
    """
    parts = split_by_fraction(rows.select(label).distinct(), label, list(fractions), seed=seed)
    named = kept(parts.select(label, F.element_at(F.array(*map(F.lit, PARTS)), F.col("part") + 1).alias("part")), "parts")
    named.write.parquet(f"{path}/manifest")
    rows.join(named, label).write.partitionBy(gen, "part").parquet(f"{path}/rows")


def load_dataset(spark, path: str, parts: tuple[str, ...] = PARTS, gens: list[int] | None = None, gen: str = "gen") -> DataFrame:
    """Rows of ``write_dataset``: some parts, some generations; other folders aren't read."""
    got = spark.read.parquet(f"{path}/rows").filter(F.col("part").isin(list(parts)))
    return got if gens is None else filter_generations(got, gens, gen)


def load_manifest(spark, path: str) -> DataFrame:
    """label and part of a written dataset."""
    return spark.read.parquet(f"{path}/manifest")


def filter_generations(rows: DataFrame, gens: list[int], gen: str = "gen") -> DataFrame:
    """Rows of these generations; a partition column prunes the folders read."""
    return rows.filter(F.col(gen).isin(gens))


def moving_average(rows: DataFrame, order: str, value: str, width: int, name: str, block: int = 4096) -> DataFrame:
    """Adds the mean of ``value`` over the last ``width`` rows in ``order`` (distinct values).

    Rows are numbered over ranges and dealt to blocks; the last rows of a block are
    sent to the next one too, so each block is a window of its own.
    """
    ranked = numbered(rows, [F.col(order)]).withColumn("_b", F.floor((F.col("_n") - 1) / block))
    late = F.pmod(F.col("_n") - 1, F.lit(block)) >= block - (width - 1)
    spread = ranked.withColumn("_to", F.explode(F.when(late, F.array(F.col("_b"), F.col("_b") + 1)).otherwise(F.array(F.col("_b")))))
    over = Window.partitionBy("_to").orderBy("_n").rowsBetween(-(width - 1), 0)
    return spread.withColumn(name, F.avg(value).over(over)).filter("_b = _to").drop("_n", "_b", "_to")


def save_features(features: DataFrame, path: str, version: str = "1.0") -> None:
    features.withColumn("version", F.lit(version)).write.parquet(path)


def load_features(spark, path: str, version: str = "1.0") -> DataFrame:
    """Rows of ``save_features``; another version raises."""
    got = spark.read.parquet(path)
    other = got.filter(F.col("version") != version).select("version").first()
    if other:
        raise ValueError(f"version {other.version} instead of {version}")
    return got.drop("version")


def feature_text(features: DataFrame, label: str, atom: str, vector: str, blocks: list[int], meta: Column) -> DataFrame:
    """label, text: a meta line, then for each atom a line per block of slots.

    ``blocks`` are the lengths of the blocks in vector order (one-body slots
    first); ``meta`` is computed from columns that a structure's rows share.
    Numbers have 14 digits after the point; the last is rounded from the shortest
    decimal form of the double.
    """
    edges = [0, *itertools.accumulate(blocks)]
    line = lambda lo, n: F.concat_ws(" ", F.transform(F.slice(vector, lo + 1, n), lambda x: F.format_string("%.14f", x.cast("double"))))
    lines = F.concat_ws("\n", *(line(lo, n) for lo, n in zip(edges, blocks)))
    rows = features.select(label, meta.alias("_meta"), F.struct(F.col(atom).alias("a"), lines.alias("l")).alias("_r"))
    packed = rows.groupBy(label).agg(F.min("_meta").alias("_meta"), F.array_sort(F.collect_list("_r")).alias("_r"))
    return packed.select(label, F.concat_ws("\n", F.col("_meta"), F.array_join(F.transform("_r", lambda r: r["l"]), "\n")).alias("text"))


def export_feature_text(features: DataFrame, path: str, *arguments) -> None:
    """Writes the texts of ``feature_text``, a part file per task."""
    feature_text(features, *arguments).select(F.col("text").alias("value")).write.text(path)
