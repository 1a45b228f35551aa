import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken

from structlake.llm.bpe import bpe_decode, bpe_digests, bpe_encode, load_ranks, replay

from .data import empty, frame, odd, rows

PATH = P.path("byte_bpe_multi_50k.tiktoken")
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}, special_tokens={})


def test_digests_equal_tiktoken(spark):
    got = {r.doc_id: tuple(r)[1:] for r in bpe_digests(frame(spark), PATH, P.PATTERN, block_bytes=3000).collect()}
    for i, text, *_ in rows():
        ids = OWN.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_replay_of_random_bytes():
    rng = random.Random(3)
    ranks = load_ranks(PATH)
    words = [bytes(rng.choice(b"abe \xc3\xa9th") for _ in range(rng.randint(0, 40))) for _ in range(500)] + [b"a" * 1000, b"", b"ha" * 77]
    ids, starts = replay(ranks, words)
    for k, w in enumerate(words):
        assert ids[starts[k] : starts[k + 1]].tolist() == ranks.one_word(w) == (OWN._encode_single_piece(w) if w else [])


def test_round_trip(spark):
    back = bpe_decode(bpe_encode(frame(spark), PATH, P.PATTERN), PATH)
    assert {r.doc_id: r.text for r in back.collect()} == {r[0]: r[1] or "" for r in rows()}


def test_edges(spark):
    assert bpe_digests(empty(spark), PATH, P.PATTERN).count() == 0
    assert bpe_digests(odd(spark), PATH, P.PATTERN).count() == 7
