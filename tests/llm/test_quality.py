import math
import random
import re
from collections import Counter

import pytest

from structlake.llm import quality
from structlake.llm.quality import judge, kneser_ney, ngram_counts, quality_filter

from .data import empty, frame, odd, rows, words


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1} if len(grams) < 500 else {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def brute_counts(data, order):
    """n-gram counts by order: raw ones at the top, continuation counts below."""
    n = {k: Counter() for k in range(1, order + 1)}
    for d in data:
        n[order].update(d[i - order + 1 : i + 1] for i in range(order - 1, len(d)))
    for k in range(order - 1, 0, -1):
        n[k].update(g[1:] for g in n[k + 1])
    return n


def brute_discounts(n):
    out = {}
    for k, table in n.items():
        c = [sum(v == i for v in table.values()) for i in range(5)]
        y = c[1] / (c[1] + 2 * c[2]) if all(c[1:]) else 0
        out[k] = [0, *(max(0.05, i - (i + 1) * y * c[i + 1] / c[i]) for i in (1, 2, 3))] if all(c[1:]) else [0, 0.5, 1, 1.5]
    return out


def padded(text, order):
    return b"\0" * (order - 1) + text.encode()


def brute_ppl(n, cuts, text, order):
    """Log perplexity by the textbook: interpolated, top order first."""
    total, cut = Counter(), Counter()
    for k in n:
        for g, v in n[k].items():
            total[g[:-1], k] += v
            cut[g[:-1], k] += cuts[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), (g[:-1], len(g))
        if not total[h]:
            return p(g[1:])
        return (n[k][g] - cuts[k][min(n[k][g], 3)] + cut[h] * p(g[1:])) / total[h]

    d = padded(text, order)
    return -sum(math.log(p(d[i - order + 1 : i + 1])) for i in range(order - 1, len(d))) / (len(d) - order + 1)


@pytest.mark.parametrize("limit", [quality.BROADCAST_BYTES, 0])
def test_equals_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(quality, "SHARDS", 4)
    order, some = 4, [r for r in rows() if not r[1] or len(r[1]) < 5000]
    got = {r.doc_id: r for r in judge(frame(spark, some), order=order, broadcast_bytes=limit).collect()}
    used = {lang: [r for r in some if r[2] == lang and not counts(r[1])[-1]] for lang in {r[2] for r in some}}
    cuts = {lang: brute_discounts(brute_counts([padded(r[1], order) for r in of], order)) for lang, of in used.items()}
    for i, text, lang, *_ in some:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text), i
        if text:
            others = brute_counts([padded(x[1], order) for x in used[lang] if x[0] != i], order)
            assert r.log_ppl == pytest.approx(brute_ppl(others, cuts[lang], text, order), abs=2e-9), i
        else:
            assert r.log_ppl is None and not r.kept


def test_verdicts_equal_brute_force(spark):
    """Bands by the textbook: each deviation times the root of the words, against its spread."""
    rng = random.Random(13)
    lexicon = words(rng, 50).split()
    docs = [(k, " ".join(rng.choice(lexicon) + ("%" * (k % 3) if k % 50 == 0 else "") for _ in range(rng.randint(12, 90))), rng.choice(["en", "de"])) for k in range(160)]
    docs += [(200 + k, "".join(rng.choice("qxz!#") + " " for _ in range(40)), "en") for k in range(4)] + [(300, None, "en"), (301, "only one here of its tongue and it has ten words", None)]
    got = judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()

    def quartile(values, p):
        return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]

    def spread(values):
        return max((quartile(values, 0.75) - quartile(values, 0.25)) / 1.349 * (1 + 2.34 / math.sqrt(len(values))), 1e-6)

    size = {k: len((t or "").encode()) for k, t, _ in docs}
    for lang in ("en", "de", None):
        mine = [r for r in got if r.lang == lang]
        seen = {(r.n_words, size[r.doc_id], r.log_ppl) for r in mine if not r.base_failed}
        byte, word = quartile([v for _, _, v in seen], 0.5), quartile([v * b / n for n, b, v in seen], 0.5)
        off = lambda n, b, v: ((v - byte) * math.sqrt(n), (v * b / n - word) * math.sqrt(n))  # noqa: B023, E731
        byte_s, word_s = spread([off(*x)[0] for x in seen]), spread([off(*x)[1] for x in seen])
        apart = [off(*x)[0] / byte_s - off(*x)[1] / word_s for x in seen]
        middle, apart_s = quartile(apart, 0.5), spread(apart)
        for r in mine:
            want = False
            if not r.base_failed:
                x, y = off(r.n_words, size[r.doc_id], r.log_ppl)
                want = abs(x) <= 8 * byte_s and abs(y) <= 5 * word_s and abs(x / byte_s - y / word_s - middle) <= 5 * apart_s
            assert r.kept == want, r
    assert 100 < sum(r.kept for r in got) < len(got) - 4


def test_every_ngram_is_counted_and_discounts_are_estimated(spark):
    used = {lang: [padded(r[1], 5) for r in rows() if r[2] == lang and not counts(r[1])[-1]] for lang in {r[2] for r in rows()}}
    want = {lang: brute_counts(data, 5) for lang, data in used.items() if data}
    model = kneser_ney(ngram_counts(frame(spark), order=5), 5)
    got = {(r.lang, r.k, r.gram): r.n for r in model.counts.collect()}
    assert got == {(lang, k, int.from_bytes(g, "big")): v for lang, n in want.items() for k in n for g, v in n[k].items()}
    cuts = {(r.lang, r.k): [0, r.d1, r.d2, r.d3] for r in model.discounts.collect()}
    for lang, n in want.items():
        for k, d in brute_discounts(n).items():
            assert cuts[lang, k] == pytest.approx(d)
    assert sum(v == 1 for v in want["en"][5].values()) > 0 and cuts["en", 5] != [0, 0.5, 1, 1.5]


@pytest.mark.parametrize("slot_rows", [quality.SLOT_ROWS, 500])
def test_both_ways_give_the_same_verdicts(spark, monkeypatch, slot_rows):
    """Also where several slots look into each shard."""
    monkeypatch.setattr(quality, "SHARDS", 3)
    monkeypatch.setattr(quality, "SLOT_ROWS", slot_rows)
    docs = frame(spark).unionByName(frame(spark, [(r[0], "other words under the same id, ten of them at least here", *r[2:]) for r in rows()[20:30]]))
    sides = [sorted(map(str, judge(docs, broadcast_bytes=limit).collect())) for limit in (quality.BROADCAST_BYTES, 0)]
    assert sides[0] == sides[1]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(3)
    lexicon = words(rng, 60).split()
    docs = [(k, " ".join(rng.choice(lexicon) for _ in range(80)), "en", "s") for k in range(100)] + [(5, "too short", "en", "t"), (None, "short too", "en", "t")]
    got = quality_filter(spark.createDataFrame(docs, "doc_id long, text string, lang string, log_ppl string"))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(100))


def test_rejects_noise_and_keeps_prose(spark):
    rng = random.Random(2)
    lexicon = words(rng, 60).split()
    prose = [(k, " ".join(rng.choice(lexicon) for _ in range(80)), "en") for k in range(200)]
    noise = [(1000 + k, " ".join("".join(rng.choice("QXZ0987#!?") for _ in range(6)) for _ in range(80)), "en") for k in range(4)]
    docs = spark.createDataFrame(prose + noise, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality_filter(docs).collect()}
    assert kept == {k for k, *_ in prose}


def test_long_texts_and_edges(spark):
    got = {r.doc_id: r for r in judge(frame(spark)).collect()}
    for i, text, *_ in rows():
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == counts(text)
    assert judge(empty(spark)).count() == 0
    assert judge(odd(spark)).count() == 7
    assert quality_filter(frame(spark)).columns == frame(spark).columns


def test_labelled_junk_goes_and_labelled_good_texts_stay(spark):
    rng = random.Random(5)
    lexicon = words(rng, 400).split()
    common, rare = lexicon[:8], lexicon[8:]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) + rng.choice(rare)
    prose = lambda n: " ".join(word() for _ in range(n))
    good = [(k, prose(rng.choice([12, 15, 40, 80, 200, 600])), "en") for k in range(600)]
    sigils = [(1000 + k, " ".join(word() + rng.choice(["%%%", "$$$", "&&&"]) for _ in range(80)), "en") for k in range(10)]
    menus = [(2000 + k, " | ".join(word() for _ in range(300)), "en") for k in range(10)]
    kept = {r.doc_id for r in judge(spark.createDataFrame(good + sigils + menus, "doc_id long, text string, lang string")).filter("kept").collect()}
    assert not kept & {k for k, *_ in sigils + menus}
    assert len(kept) >= 0.99 * len(good)
