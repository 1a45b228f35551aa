"""Byte-level BPE encoding and decoding by merge replay over a block's words.

A word's tokens depend on the word alone, so a block of the corpus (tens of MB of
text) is reduced to its distinct words. All their bytes stand in one array with
links to the neighbours. An inverted index holds, for each rank, the positions
of the token pairs that merge into it; a heap yields the ranks in order. One
step merges all live positions of a rank and looks up only the pairs that the
merges touched. Documents are then put together from their words. The corpus is
never shuffled: Spark deals the blocks to tasks, and a lost task is redone alone.
One index over the words of the whole corpus was built too: it moves every block's
words and word numbers twice and needs more disk than the texts have (README).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import lean

#: Unicode's White_Space characters, as inside of a character class.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLOCK_BYTES = 16 << 20


@lru_cache(maxsize=4)
def compiled(pattern: str):
    """(regex for any text, regex for ASCII texts) of a splitting pattern."""
    import re

    import regex

    spaces = pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", r"[^\t-\r ]").replace(r"\s", r"[\t-\r ]")
    return regex.compile(spaces), (None if "\\p" in plain else re.compile(plain))


class Ranks:
    """A rank file: tokens by id, and the pairs that merge, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.rank, self.token = rank, {v: k for k, v in rank.items()}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, values = [], []
        for tok, r in rank.items():
            for cut in range(1, len(tok)):
                a, b = rank.get(tok[:cut]), rank.get(tok[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.values = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where they don't merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost first, one merge at a time."""
        parts = [bytes([b]) for b in word]
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapify(heap)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or self.rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (s := self.rank.get(parts[i] + parts[k])) is not None:
                    heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := self.rank.get(parts[h] + parts[i])) is not None:
                heappush(heap, (s, h))
        return [self.rank[p] for p in parts if p is not None]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and where each word starts."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    n = int(edges[-1])
    token = ranks.byte[np.frombuffer(b"".join(words), dtype=np.uint8)] if n else np.zeros(0, dtype=np.int64)
    right = np.arange(1, n + 1)
    left = np.arange(-1, n - 1)
    full = edges[:-1][lengths > 0]
    right[(edges[1:] - 1)[lengths > 0]] = -1
    left[full] = -1
    pair = np.full(n, -1, dtype=np.int64)
    at = np.flatnonzero(right >= 0)
    pair[at] = ranks.merged(token[at], token[at + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def post(positions: np.ndarray, ranked: np.ndarray) -> None:
        if len(positions) > 1:
            order = np.argsort(ranked, kind="stable")
            positions, ranked = positions[order], ranked[order]
        cuts = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
        for r, p in zip(ranked[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts), strict=True):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heappush(heap, r)

    at = np.flatnonzero(pair >= 0)
    if len(at):
        post(at, pair[at])
    odd: list[np.ndarray] = []
    while heap:
        r = heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[pair[at] == r]
        if not len(at):
            continue
        nxt = right[at]
        if len(at) > 1:
            # of overlapping positions every second one merges, from the left
            linked = np.concatenate([[False], at[1:] == nxt[:-1]])
            if linked.any():
                k = np.arange(len(at))
                keep = (k - np.maximum.accumulate(np.where(linked, 0, k))) % 2 == 0
                at, nxt = at[keep], nxt[keep]
        token[at] = r
        token[nxt] = -1
        pair[nxt] = -1
        over = right[nxt]
        right[at] = over
        inner = over >= 0
        left[over[inner]] = at[inner]
        pair[at] = -1
        a = at[inner]
        before = left[at]
        b = before[before >= 0]
        touched = np.concatenate([a, b])
        if len(touched):
            fresh = ranks.merged(token[touched], token[right[touched]])
            pair[touched] = fresh
            some = fresh >= 0
            if some.any():
                touched, fresh = touched[some], fresh[some]
                if (fresh < r).any():
                    odd.append(touched[fresh < r])
                post(touched, fresh)
    alive = token >= 0
    ids = token[alive]
    starts = np.concatenate([[0], np.cumsum(alive)])[edges]
    if odd:
        # a merge made a pair of a lower rank: such a word is done by itself
        for w in np.unique(np.searchsorted(edges, np.concatenate(odd), side="right") - 1)[::-1].tolist():
            new = np.array(ranks.one_word(words[w]), dtype=np.int64)
            grown = len(new) - int(starts[w + 1] - starts[w])
            ids = np.concatenate([ids[: starts[w]], new, ids[starts[w + 1] :]])
            starts[w + 1 :] += grown
    return ids, starts


def encode_block(ranks: Ranks, pattern: str, texts: list[str]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    """Per text its word numbers; the distinct words; their ids and starts."""
    any_text, ascii_text = compiled(pattern)
    number: dict[str, int] = {}
    setdefault, per = number.setdefault, []
    for text in texts:
        found = (ascii_text if ascii_text is not None and text.isascii() else any_text).findall(text)
        per.append(np.array([setdefault(w, len(number)) for w in found], dtype=np.int64))
    words = [w.encode("utf-8") for w in number]
    ids, starts = replay(ranks, words)
    return per, words, ids, starts


def _texts(batches, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= block_bytes:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty and have no tokens. Every row stands for itself,
    repeated or not; other columns are ignored. The decoded bytes come from the
    ids. Long texts are encoded whole.
    """
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        ranks = load_ranks(ranks_path)
        for keys, texts in _texts(batches, id_col, text_col, block_bytes):
            per, words, ids, starts = encode_block(ranks, pattern, texts)
            count = np.diff(starts)
            flat, at = ids.tolist(), starts.tolist()
            decimal = [",".join(map(str, flat[i:j])).encode() for i, j in zip(at, at[1:])]
            decoded = [b"".join(map(ranks.token.__getitem__, flat[i:j])) for i, j in zip(at, at[1:])]
            out = {"id": [], "n": [], "i": [], "d": []}
            for key, numbers in zip(keys, per, strict=True):
                some = numbers.tolist()
                out["id"].append(key)
                out["n"].append(int(count[numbers].sum()))
                out["i"].append(hashlib.sha256(b",".join(map(decimal.__getitem__, some))).hexdigest())
                out["d"].append(hashlib.sha256(b"".join(map(decoded.__getitem__, some))).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(lean(run), f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id and ids (array of int) of every row; null texts have no ids."""
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        ranks = load_ranks(ranks_path)
        for keys, texts in _texts(batches, id_col, text_col, block_bytes):
            per, _, ids, starts = encode_block(ranks, pattern, texts)
            for k in range(0, len(keys), 256):
                rows = [np.concatenate([ids[starts[w] : starts[w + 1]] for w in p.tolist()]) if len(p) else ids[:0] for p in per[k : k + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 256], pa.int64()), pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], names=[id_col, "ids"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return picked.mapInArrow(lean(run), f"{id_col} long, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give ''."""
    ship(encoded.sparkSession)

    def run(batches):
        import pyarrow as pa

        token = load_ranks(ranks_path).token
        for batch in batches:
            texts = [b"".join(map(token.__getitem__, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(lean(run), f"{id_col} long, text string")
