"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Every text, with white space deleted, is cut into chunks at places that its own
characters choose (a doubled character after at least 512 others, 4096 at
most), so equal stretches give equal chunks wherever they stand. A text becomes
its recipe: the ordered list of its chunks' 64-bit hashes. The chunk dictionary
(one row per distinct chunk; copies collapse before the shuffle) shows whether
any hash stands for two different chunks. Where it does, the recipes that hold
it are rewritten with verified identifiers (hash and rank of the content under
that hash). Documents are equal when their recipes are. The text moves through
the network at most once, as chunks; long documents are never compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import without_whitespace, written

MIN_CHUNK, MAX_CHUNK = 512, 4096


def chunks(norm: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """Ordered chunks whose concatenation is ``norm``; none for ''."""
    pattern = rf"(?s).{{{least}}}.{{0,{most - least}}}?(.)\1|.{{1,{most}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), 0)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null texts count as empty; all empty texts are equal. Of equal texts the row
    with the most code points in the original text stays, then the smallest id
    (null ids last). Rows that repeat an id share its fate. Other columns of
    ``docs`` are ignored. ``hash_bits`` is lowered by tests to force colliding
    chunk hashes; the result doesn't depend on it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = (1 << hash_bits) - 1 if hash_bits < 64 else -1

    def hashed(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(F.lit(mask))

    base = docs.select(F.col(id_col).alias("_id"), F.char_length(text).cast("long").alias("_len"), without_whitespace(F.col(text_col)).alias("_norm"))
    cut = base.withColumn("_chunks", chunks(F.col("_norm"), least, most))
    recipes = written(
        cut.select("_id", "_len", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"), F.transform("_chunks", hashed).alias("_recipe")),
        "recipes",
    )
    dictionary = cut.select(F.explode("_chunks").alias("_chunk")).groupBy(hashed(F.col("_chunk")).alias("_hash"), "_chunk").agg(F.lit(1).alias("_one"))
    shared = written(dictionary.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash"), "chunk-collisions")
    if shared.isEmpty():
        recipes = recipes.withColumn("_ids", F.transform("_recipe", lambda h: F.struct(h.alias("h"), F.lit(1).alias("v"))))
    else:
        recipes = _verified(cut, recipes, dictionary, shared, hashed)
    groups = recipes.groupBy("_ids").agg(
        F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("z"), F.col("_id").alias("i"))).alias("_best"),
        F.count("*").alias("_size"),
    )
    # written, so that both sides of the join are dealt anew and Spark can split a hot recipe
    groups = written(groups, "recipe-groups")
    left = recipes.alias("r").join(groups.alias("g"), F.col("r._ids") == F.col("g._ids"))
    return left.select(
        F.col("r._id").alias(id_col),
        F.col("g._best.i").alias("keep_id"),
        F.col("g._size").cast("long").alias("group_size"),
        F.col("r._id").eqNullSafe(F.col("g._best.i")).alias("kept"),
        F.col("r._sha").alias("text_sha256"),
        F.size("r._ids").cast("long").alias("n_chunks"),
    )


def _verified(cut: DataFrame, recipes: DataFrame, dictionary: DataFrame, shared: DataFrame, hashed) -> DataFrame:
    """Recipes as (hash, rank of the chunk among the chunks of that hash)."""
    order = Window.partitionBy("_hash").orderBy("_chunk")
    ranks = dictionary.join(shared, "_hash", "left_semi").select("_hash", "_chunk", F.row_number().over(order).alias("_rank"))
    spread = cut.select("_id", "_len", F.sha2(F.encode("_norm", "UTF-8"), 256).alias("_sha"), F.posexplode_outer("_chunks").alias("_pos", "_chunk")).withColumn("_hash", hashed(F.col("_chunk")))
    known = spread.join(ranks, ["_hash", "_chunk"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(1)))
    made = F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.col("_hash").alias("h"), F.col("_rank").alias("v")))))
    one = known.groupBy("_id", "_len", "_sha").agg(made.alias("_all"), F.sum(F.when(F.coalesce("_pos", F.lit(0)) == 0, 1)).alias("_times"))
    # rows that repeat a document wholly come as one with every position several times
    ids = F.transform(F.filter("_all", lambda x, i: i % F.col("_times") == 0), lambda x: F.struct(x["h"].alias("h"), x["v"].alias("v")))
    return written(one.select("_id", "_len", "_sha", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_k"), ids.alias("_ids")).drop("_k"), "verified-recipes")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_groups`` drops; all columns stay.

    Rows that repeat an id are told apart by their texts; of rows alike in both, all
    stay or go. An empty table gives no rows.
    """
    text = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    key = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), text.alias("t"))
    keep = exact_groups(docs.select(key.alias("__key"), F.col(text_col).alias("text")), "__key").filter("kept").select("__key").distinct()
    return docs.join(keep, key.eqNullSafe(F.col("__key")), "left_semi")
