import hashlib
import random

import pytest

from structlake.llm import minhash
from structlake.llm.components import connected_components
from structlake.llm.minhash import near_dedup, near_duplicates

from .data import empty, frame, odd, rows, words


def shingles(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def told(docs, **options):
    return near_duplicates(docs, **options).drop("text_key").collect()


def brute(some):
    sets = {i: shingles(t) for i, t in some}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_equals_brute_force(spark):
    got = {tuple(r) for r in told(frame(spark))}
    assert got == brute([r[:2] for r in rows()])


def test_groups_that_need_more_than_stars(spark):
    """Two clusters share their rarest values, and links form a path."""
    rng = random.Random(5)
    some, text = [], words(rng, 150).split()
    for k in range(60):
        text = text[:]
        text[rng.randrange(150)] = f"new{k}"
        if k % 20 == 0:
            text[:40] = words(rng, 40).split()
        some.append((k, " ".join(text)))
    some += [(k + 100, t) for k, t in some[:10]]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert {tuple(r) for r in told(docs)} == brute(some)


def template_texts(rng, n, passages, common=180, body=60):
    """Texts of one template with two passages of a pool: alike, but below the limit."""
    template = words(rng, common)
    pool = [words(rng, body) for _ in range(passages)]
    return [f"{template} {rng.choice(pool)} {rng.choice(pool)}" for _ in range(n)]


def test_long_lists_are_split(spark, monkeypatch):
    rng = random.Random(6)
    texts = template_texts(rng, 120, 25)
    # near copies of some, and a path of small steps
    texts += [" ".join(w if k % 97 else "changed" for k, w in enumerate(t.split())) for t in texts[:30]]
    some = list(enumerate(texts))
    docs = spark.createDataFrame(some, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    assert {tuple(r) for r in told(docs)} == brute(some)
    monkeypatch.undo()
    assert {tuple(r) for r in told(docs)} == brute(some)


def test_long_lists_compare_few_of_their_pairs(spark, monkeypatch):
    compared = []
    whole = minhash.final_lists

    def counted(mixed, *rest):
        out = minhash.written(whole(mixed, *rest), "counted")
        sizes = [mixed.groupBy("key").count(), out.groupBy("key").count()]
        pairs = lambda t, which="true": t.filter(which).selectExpr("coalesce(sum(count * count), 0)").first()[0]
        short = pairs(sizes[0], "count <= 32")
        compared.append((pairs(sizes[0]) - short, pairs(sizes[1]) - short))
        return out

    monkeypatch.setattr(minhash, "final_lists", counted)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 32)
    docs = spark.createDataFrame(list(enumerate(template_texts(random.Random(7), 500, 125))), "doc_id long, text string")
    near_duplicates(docs).count()
    ((long_, split),) = compared
    assert 0 < split < long_ / 2, compared


def brute_rows(some):
    """The same for rows (id, text) that may repeat ids: each row by its own text."""
    distinct = sorted({(i, hashlib.md5((t or "").encode()).digest(), t or "") for i, t in some if i is not None})
    whole = {x[0]: x[2] for x in brute([(k, t) for k, (_, _, t) in enumerate(distinct)])}
    place = {(i, t): k for k, (i, _, t) in enumerate(distinct)}
    out = []
    for i, t in some:
        if i is None:
            out.append((None, len(shingles(t)), None, True))
        else:
            head = whole[place[i, t or ""]]
            out.append((i, len(shingles(t)), distinct[head][0], head == place[i, t or ""]))
    return out


def two_texts(seed=8):
    """Near copies; some of their ids have a second text: longer, unlike, or of another component."""
    rng = random.Random(seed)
    base, other = words(rng, 100).split(), words(rng, 60)
    some = [(i, " ".join(w if k != i else f"own{i}" for k, w in enumerate(base))) for i in range(40)]
    more = words(rng, 8)
    some += [(i, f"{some[i][1]} {more} {i}") for i in range(5, 15)]
    some += [(i, f"{other} {i}") for i in range(0, 40, 7)] + [(50, other), (3, some[3][1]), (3, None), (50, ""), (None, other), (60, f"{other} 60"), (60, some[20][1])]
    return some


@pytest.mark.parametrize("rounds", [0, 2])
def test_ids_with_two_texts(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "STAR_ROUNDS", rounds)
    some = two_texts()
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    want = brute_rows(some)
    assert sorted(map(tuple, told(docs)), key=repr) == sorted(want, key=repr)
    left = [r for r, w in zip(some, want, strict=True) if w[3]]
    assert sorted(map(tuple, near_dedup(docs).collect()), key=repr) == sorted(left, key=repr)


def test_hot_sets_are_joined_without_an_aggregate(spark):
    """Spark splits a skewed partition only where the join reads its exchanges directly."""
    plan = near_duplicates(spark.createDataFrame(two_texts(), "doc_id long, text string"))._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan


def test_the_match_threshold_follows_the_limit():
    assert [minhash.match_threshold(p) for p in (50, 80, 85, 95)] == [9, 24, 28, 36]


def test_filter(spark):
    out = near_dedup(frame(spark))
    assert out.columns == frame(spark).columns
    assert {r.doc_id for r in out.collect()} == {x[0] for x in brute([r[:2] for r in rows()]) if x[3]}


def test_edges(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert near_duplicates(odd(spark)).count() == 7


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}
