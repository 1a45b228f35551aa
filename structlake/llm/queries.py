"""The registered queries of the thirteen operators, and their DuckDB forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, fim, line_dedup, minhash, mixing, phrases, pii, quality, sharding, url_filter, warc
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and splitting pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_chunks")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    arrivals = docs.withColumn("arrival", F.pmod("doc_id", F.lit(8)))
    store = sharding.shard(arrivals, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", by="arrival")
    kept = store.read(arrivals.schema)

    def told(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first())

    first = len(store.runs(1)) if store.version() else 0
    whole = not first or told(store.read(arrivals.schema, 1)) == told(kept)
    return kept.select(
        "doc_id",
        "arrival",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
        F.lit(first).cast("long").alias("n_arrivals"),
        F.lit(len(store.runs()) < first).alias("compacted"),
        F.lit(whole).alias("first_version_whole"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(v, h, p) for v, h, p in url_filter.RULES], "verdict string, host string, path string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer())


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = chat.chat_conversations(chat.chain_messages(rows))
    turns = chat.read_turns(F.col("formatted"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    told = done.select("conv_id", turns.alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.KINDS),
        F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        pii.joined(pii._in_order(F.concat("base", "extra"))).alias("spans"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.WarcArchive(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    archive.append_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.page_facts(archive)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_minhash_near_dedup, op2_exact_dedup, op3_sharding, op4_url_filter, op5_quality_rules, op6_mixing, op7_line_dedup, op8_byte_bpe, op9_chat_formatting, op10_pii, op11_fill_in_middle, op12_warc, op13_phrase_collocations)
}

ESC = r"regexp_replace({}, '(\\|#|</turn>)', '\\\1', 'g')"
OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
OP9_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, {ESC.format("text")} AS esc FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + length(esc) + 9) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
#: Near-duplicates, perplexity, tokens and boosted trees have no SQL form; their
#: tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_sharding": sharding.SQL,
    "op4_url_filter": url_filter.SQL,
    "op6_mixing": mixing.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_chat_formatting": OP9_SQL,
    "op11_fill_in_middle": fim.SQL,
    "op12_warc": warc.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
