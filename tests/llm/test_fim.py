import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlake.llm.fim import Fenwick, fill_in_middle, restored

from .data import empty, frame, odd, rows

MORE = ["<P>", "a<S>b", "<<P", "P>S>M><", "<M", "ab1cd", "ééaé", "\U0001f600x\U0001f600", "\n\r\n", "Z" * 5000, "a1" * 3000, "中" * 1500]


def brute(key, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("block", [1, 3, 64, 1024])
def test_equals_brute_force_for_every_block_size(spark, block):
    some = [(i, t) for i, t, *_ in rows()] + [(1000 + 50 * k + j, t) for j in range(12) for k, t in enumerate(MORE)]
    # repeated ids with other texts, null ids
    some += [(4, "another text of this id"), (None, "a text without an id"), (None, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    got = fill_in_middle(docs, block_bytes=block).withColumn("back", restored(F.col("output"), F.col("form"))).join(docs.withColumnRenamed("text", "was"), "doc_id", "left")
    made = sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(docs, block_bytes=block).collect())))
    assert made == sorted(repr((i, *brute(i, t))) for i, t in some)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    unique = got.filter("doc_id is not null and doc_id <> 4")
    assert unique.filter("not back <=> coalesce(was, '')").count() == 0


def test_long_texts_are_counted_in_stretches(spark, monkeypatch):
    from structlake.llm import fim

    monkeypatch.setattr(fim, "STRETCH_BYTES", 100)
    some = [(i, t) for i, t, *_ in rows()] + list(enumerate(MORE, 500))
    lengths = np.cumsum([0] + [len((t or "").encode()) for _, t in some])
    data = np.frombuffer("".join(t or "" for _, t in some).encode(), dtype=np.uint8)
    counts, first = fim.block_counts(data, lengths, 16)
    for k, (_, text) in enumerate(some):
        mine = counts[first[k] : first[k + 1]].sum(axis=0).tolist()
        assert mine == [len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")), len(text or "")]


def test_descent_finds_the_last_block_with_few_enough_units():
    rng = random.Random(2)
    for n in [1, 2, 3, 7, 8, 9, 100]:
        counts = np.array([[rng.choice([0, 0, 1, 5]), rng.randint(1, 9)] for _ in range(n)])
        sums = np.concatenate([[[0, 0]], np.cumsum(counts, axis=0)])
        for units in range(int(sums[-1][0]) + 2):
            block = int(np.searchsorted(sums[:, 0], units, side="right")) - 1
            assert Fenwick(counts).descend(units) == (block, *sums[block].tolist())


def test_odd_tables(spark):
    assert fill_in_middle(empty(spark)).count() == 0
    got = fill_in_middle(odd(spark)).collect()
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(repr((r.doc_id, *brute(r.doc_id, r.text))) for r in odd(spark).collect())
    clash = frame(spark).selectExpr("doc_id", "text", "'x' as _c", "'y' as form", "1 as _h1", "2 as n", "'z' as _text")
    assert fill_in_middle(clash).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and fill_in_middle(clash).count() == len(rows())


def test_other_shares(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('word ', id) as text")
    share = {r.form: r["count"] / 2000 for r in fill_in_middle(docs, plain_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.5) < 0.05 and abs(share["psm"] - share["spm"]) < 0.06
