import random
import re
from collections import Counter

import numpy as np
import pytest

from structlake.llm import phrases
from structlake.llm.phrases import Bloom, Summary, best_phrases, bloom_filter, collocations, phrase_counts

from .data import empty, frame, odd, rows


def grams(some, most):
    count, totals = Counter(), Counter()
    for text, lang in some:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, most + 1):
                count.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    return count, totals


def brute(some, most=4, threshold=30, percent=80, top=2000):
    count, totals = grams(some, most)
    cands = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= threshold}
    covered = Counter()
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = lang, w[i : i + m]
                covered[key] = max(covered[key], a)
    best = {}
    for (lang, w), a in cands.items():
        if 100 * covered[lang, w] >= percent * a:
            continue
        cuts = [(2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, totals[lang], -s) for lang, found in best.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


def texts(n=120, seed=3):
    """Few words, so that phrases repeat; odd separators and languages."""
    rng = random.Random(seed)
    vocabulary = ["new", "York", "city", "of", "the", "É", "\U0001f600", "Z\x1cq", "don't", "a-b", "#"]
    join = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ; ", "!?"]
    make = lambda k: "".join(rng.choice(vocabulary) + rng.choice(join) for _ in range(k))
    out = [(make(rng.randint(0, 60)), rng.choice(["en", "de", None, "und", "é"])) for _ in range(n)]
    return out + [("new york city " * 50, "en"), (None, "en"), ("", "xx"), (". , !", "yy"), ("the " * 400, "de"), (make(3000), "en")]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(texts(), "text string, lang string").repartition(5)
    for options in ({}, {"threshold": 3}, {"threshold": 2, "most": 5, "percent": 100, "top": 7}, {"threshold": 5, "most": 2}):
        mine = {("contained_percent" if k == "percent" else k): v for k, v in options.items()}
        want = brute(texts(), **options)
        assert sorted(map(tuple, collocations(docs, **mine).collect())) == want and want


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Many flushes, partitions, stretches, and a filter that lets nearly all through."""
    for name, value in {"FLUSH": 50, "PART_MASS": 100, "BLOCK_BYTES": 64, "MOST_BITS": 1 << 12, "BITS_EACH": 1, "HELD": 20, "ROOM": 1}.items():
        monkeypatch.setattr(phrases, name, value)
    docs = spark.createDataFrame(texts(), "text string, lang string").repartition(3)
    assert sorted(map(tuple, collocations(docs, threshold=4).collect())) == brute(texts(), threshold=4)


def test_counts_are_exact_though_keys_meet(spark, monkeypatch):
    """Keys of four bits only: phrases are told apart by the second hash."""
    whole = phrases.Grams.keys

    def narrow(self, most):
        for at, key in whole(self, most):
            yield at, key & np.uint64(15)

    monkeypatch.setattr(phrases.Grams, "keys", narrow)
    grams_, every = phrases.Grams(checked=True), Bloom(np.full(64, -1, dtype=np.int64).view(np.uint64))
    held = phrases._Held()
    count, _ = grams([("a b c a b d a b c", "x"), ("A b", "y")], 2)
    data = np.frombuffer(b"a b c a b d a b cA b", dtype=np.uint8)
    for _ in range(2):
        grams_.read(data, np.array([0, 17, 20]), phrases._lang_keys(["x", "y"]))
        names = np.array(["x", "y"], dtype=object)
        for n, (at, key) in enumerate(grams_.keys(2), 1):
            assert every.has(key).all()
            held.add(key, grams_.checks(at, n), lambda which, at=at, n=n: (phrases_lang(names, grams_, at[which]), phrases._phrase_texts(data, grams_.start, grams_.end, at[which], n)))
    got = Counter()
    for r in held.flushed(3).to_pylist():
        for phrase, f in zip(r["phrases"], r["counts"], strict=True):
            got[r["lang"], tuple(phrase.split(" "))] += f
    assert got == Counter({k: 2 * v for k, v in count.items()})


def phrases_lang(names, grams_, at):
    import pyarrow as pa

    return pa.array(names[grams_.text[at]], pa.string())


@pytest.mark.parametrize("skew", [0.0, 1.0, 2.0])
def test_frequent_keys_survive_merged_summaries(skew, monkeypatch):
    monkeypatch.setattr(phrases, "ROOM", 1)
    rng = np.random.default_rng(int(skew * 10))
    p = 1 / np.arange(1, 20001) ** skew
    stream = rng.choice(20000, size=60000, p=p / p.sum()).astype(np.uint64)
    exact = Counter(stream.tolist())
    for threshold in (5, 30, 100):
        state = Summary(threshold, len(stream) // threshold + 1)
        for part in np.array_split(stream, 37):
            state.merge([np.unique(part)], [np.unique(part, return_counts=True)[1]])
        kept = set(state.survivors().tolist())
        assert {k for k, c in exact.items() if c >= threshold} <= kept
        assert state.taken < threshold and state.mass == len(stream)
        counts = dict(zip(state.keys.tolist(), state.counts.tolist()))
        assert all(c <= exact[k] <= c + state.taken for k, c in counts.items())
        if threshold == 30 and skew < 2:
            assert len(state.keys) <= state.capacity < len(exact) / 4


def test_a_capacity_that_is_too_small_grows(monkeypatch):
    monkeypatch.setattr(phrases, "ROOM", 1)
    state = Summary(3, 1)
    for k in range(100):
        state.merge([np.arange(k, k + 3, dtype=np.uint64)], [np.ones(3, dtype=np.int64)])
    assert state.taken < 3 and set(range(2, 100)) <= set(state.survivors().tolist())


def test_filter_holds_all_keys(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as key")
    some = np.array([r.key for r in keys.collect()]).view(np.uint64)
    bloom = bloom_filter(keys)
    others = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    assert bloom.has(some).all() and bloom.has(others).mean() < 0.02


def test_large_counts_are_exact(spark):
    big = (1 << 62) + 12345
    rows_ = [("en", "a", big), ("en", "b", big + 7), ("en", "a b", big - 3), ("en", "c", 90), ("en", "c c", 30), ("en", "a b c", 40), ("en", "b c", 41)]
    counts = spark.createDataFrame(rows_, "lang string, phrase string, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in best_phrases(counts, spark.createDataFrame([("en", 5)], "lang string, n long")).collect()}
    assert got["a b"] == (big, big + 7, 2000000 * (big - 3) // (2 * big + 7)) and got["c c"] == (90, 90, 333333)
    # both cuts score nought, so the first one counts
    assert got["a b c"] == (big, 41, 0) and "b c" not in got


def test_odd_tables(spark):
    assert collocations(empty(spark)).count() == 0
    base = [(r[1], r[2]) for r in rows()]
    assert sorted(map(tuple, collocations(frame(spark), threshold=2).collect())) == brute(base, threshold=2)
    some = [(r.text, r.lang) for r in odd(spark).collect()]
    assert sorted(map(tuple, collocations(odd(spark), threshold=2).collect())) == brute(some, threshold=2)
    counts, totals = phrase_counts(odd(spark), threshold=1)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in counts.collect()} == dict(grams(some, 4)[0])
    assert {r.lang: r.n for r in totals.collect()} == dict(grams(some, 4)[1])
