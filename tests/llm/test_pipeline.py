"""The pipeline's stages against brute force on a small table."""

import hashlib
import os
import re
from collections import Counter

import corpus_pipeline

from structlake.llm import common
from structlake.llm.quality import judge

from .data import empty, frame, odd, rows
from .test_bpe import OWN
from .test_exact_dedup import brute as brute_exact
from .test_minhash import brute as brute_near
from .test_minhash import brute_rows, two_texts
from .test_others import brute_mix


def test_stages_keep_columns_and_equal_brute_force(spark, tmp_path):
    docs = frame(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    some = {r[0]: r for r in rows()}
    # perplexity has its own brute-force test; its verdicts are taken from there
    left = [some[r.doc_id] for r in judge(docs).filter("kept").collect()]
    left = [some[x[0]] for x in brute_exact(left) if x[3]]
    left = [some[x[0]] for x in brute_near([r[:2] for r in left]) if x[3]]
    size, _, target = brute_mix(left)
    counts = Counter(r.doc_id for r in got)
    assert set(counts) <= {r[0] for r in left}
    for name, want in target.items():
        mine = [r[0] for r in left if r[3] == name]
        assert abs(sum(counts[i] * size[i] for i in mine) - want) <= max(size[i] for i in mine) / 2 + 1e-6
    for r in got:
        ids = OWN.encode_ordinary(some[r.doc_id][1])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(some[r.doc_id][1].encode()).hexdigest()


def test_empty_and_odd_tables_run(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    # null and repeated ids, one id with two texts, clashing columns
    extra = [(5, "one id with a text of ten or more words in all here", *rows()[0][2:]), (5, "one id with another text of ten or more words in it", *rows()[0][2:])]
    some = odd(spark).unionByName(frame(spark)).unionByName(frame(spark, extra))
    some.write.parquet(f"{tmp_path}/odd/documents.parquet")
    texts = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in some.collect()}
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert got and {r.decoded_sha256 for r in got} <= texts
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, some, "").columns == some.columns


def test_ids_with_two_texts_keep_their_links_in_the_pipeline(spark, tmp_path):
    """Near copies of prose, some of whose ids have a second text that is no copy."""
    base = frame(spark).columns
    some = [(i, t, "en", "s1", None, *["x"] * (len(base) - 5)) for i, t in two_texts() if i is not None and t]
    docs = frame(spark, some)
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.exact_duplicates(spark, docs, ""), "")
    # exact duplicates first, as in the pipeline
    first, texts = [], set()
    for i, t in sorted(((r[0], r[1]) for r in some), key=lambda x: (-len(x[1]), x[0])):
        if "".join(t.split()) not in texts:
            texts.add("".join(t.split()))
            first.append((i, t))
    want = [r for r, w in zip(first, brute_rows(first), strict=True) if w[3]]
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(want)


def test_temporary_tables_go(spark, tmp_path):
    kept = common.written(spark.range(3), "stays")
    with common.temporary_tables(spark):
        gone = common.written(spark.range(3), "goes")
        places = [f.removeprefix("file://") for f in gone.inputFiles()]
        assert gone.count() == 3 and all(map(os.path.exists, places))
    assert kept.count() == 3 and not any(map(os.path.exists, places))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match("A training", corpus_pipeline.__doc__)
