"""Phrase collocations: frequent n-grams by Misra-Gries summaries, then exact counts.

First pass: tasks count the hashes of their n-grams and deal them to hash partitions
(ranges of the hash). Each partition's summaries are merged one after another. A merged
summary holds at most ``capacity`` counters, several times the partition's mass divided by
the threshold; what is over is brought down by taking the (capacity + 1)-th largest count
from all counters. What was taken in all stays below the threshold - where a skewed
partition would need more, its summary grows instead - so every n-gram as frequent as
the threshold survives, whatever the data. The less was taken, the fewer others do. Task summaries hold all that they saw: the
least decrement in each of many tasks would use the threshold up.

Words and pairs come first. Longer n-grams are counted only where each of their pairs
survived, since an n-gram is never more frequent than a part of it. Survivors travel
as a Bloom filter of bounded size; what it lets through by mistake costs time, not
exactness.

Second pass: tasks count the n-grams that pass the filters by their words, and deal them
packed to the same hash partitions, where they are added up and what is below the
threshold is dropped. Parts of frequent phrases are frequent, so the same table gives l
and r by joins.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WordHasher, lean, mix64, text_blocks, written

#: Characters that end a piece; words are runs of other characters than these, space and tab.
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
#: n-grams that a task counts at once, and the mass of a hash partition, about.
FLUSH, PART_MASS = 1 << 22, 1 << 25
#: A summary's capacity, in masses divided by thresholds.
ROOM = 4
BLOCK_BYTES = 2 << 20
#: A filter has about this many bits for a survivor, and no more than MOST_BITS in all (16 MB).
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 27, 4
#: Different phrases that a task of the second pass holds before it gives them away.
HELD = 1 << 20
SLOTS = 256

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407))


# --- n-grams of many texts at once ---------------------------------------------------


def _stretches(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(text numbers, bytes, offsets); a text beyond the limit is cut behind separators, where no n-gram goes across."""
    if len(offsets) > 2 or len(data) <= limit:
        yield np.arange(len(offsets) - 1), data, offsets
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        if end < len(data):
            cut = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                # one piece longer than the limit
                while end < len(data) and not _SEPARATOR[data[end - 1]]:
                    end += 1
        yield np.zeros(1, dtype=np.int64), data[at:end], np.array([0, end - at])
        at = end


class Grams:
    """The words of a block of texts, and the keys of their n-grams."""

    def __init__(self, checked: bool):
        self.hashers = [WordHasher(lower=True) for _ in range(2 if checked else 1)]
        for h in self.hashers:
            h.space[:] |= _SEPARATOR
        if checked:
            self.hashers[1].table = mix64(self.hashers[1].table)

    def read(self, data: np.ndarray, offsets: np.ndarray, text_keys: np.ndarray) -> None:
        """``text_keys`` are hashes of the texts' languages."""
        self.start, self.end, self.text, first = self.hashers[0].words(data, offsets)
        self.hash = [first, *(h.words(data, offsets)[3] for h in self.hashers[1:])]
        self.salt = text_keys[self.text] if len(self.text) else np.zeros(0, dtype=np.uint64)
        piece = np.cumsum(_SEPARATOR[data])[self.start] if len(self.start) else self.start
        self.goes_on = (self.text[1:] == self.text[:-1]) & (piece[1:] == piece[:-1])

    def keys(self, most: int):
        """For n = 1 to ``most``: (first words, keys); the keys tell lengths and languages apart."""
        n_words, h, step = len(self.hash[0]), self.hash[0], _STEP[0]
        at, key = np.arange(n_words), h
        with np.errstate(over="ignore"):
            for n in range(1, most + 1):
                if n > 1:
                    on = at[: np.searchsorted(at, n_words - n + 1)]
                    keep = self.goes_on[on + n - 2]
                    key = mix64(key[: len(on)][keep] * step + h[on[keep] + n - 1])
                    at = on[keep]
                yield at, mix64(key ^ (self.salt[at] + np.uint64(n) * step))

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        """Second hashes of the n-grams that begin at these words."""
        h, step = self.hash[1], _STEP[1]
        with np.errstate(over="ignore"):
            key = h[at]
            for k in range(1, n):
                key = mix64(key * step + h[at + k])
            return mix64(key ^ (self.salt[at] + np.uint64(n) * step))


class Bloom:
    """A bounded set of 64-bit keys; may have keys that weren't put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, n_bits: int):
        low, step, mask = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1), np.uint64(n_bits - 1)
        with np.errstate(over="ignore"):
            for j in range(PROBES):
                yield (low + np.uint64(j) * step) & mask

    def has(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for j in range(PROBES):
            *_, place = (p for _, p in zip(range(j + 1), self.places(keys[left], 64 * len(self.bits))))
            left = left[(self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        out = np.zeros(len(keys), dtype=bool)
        out[left] = True
        return out


def _lang_keys(langs: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for g in langs:
        if g not in known:
            known[g] = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
    return np.array([known[g] for g in langs], dtype=np.uint64)


def _blocks(batch):
    """(languages, bytes, offsets) of bounded parts of an Arrow batch (lang, text)."""
    langs = batch.column(0).to_pylist()
    for lo, hi, data, offsets in text_blocks(batch.column(1), BLOCK_BYTES):
        for texts, part, off in _stretches(data, offsets, BLOCK_BYTES):
            yield [langs[lo + int(k)] for k in texts], part, off


# --- first pass --------------------------------------------------------------------


class Summary:
    """A Misra-Gries summary of one hash partition: sorted keys with counts.

    No count is too large, and none is too small by more than ``taken``, which stays
    below the threshold.
    """

    def __init__(self, threshold: int, capacity: int):
        self.threshold, self.capacity = threshold, capacity
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.mass = self.taken = self.most = 0

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Add the counters of other summaries."""
        both, many = np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts])
        self.mass += int(many.sum()) - int(self.counts.sum())
        order = np.argsort(both, kind="stable")
        both, many = both[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])[: len(both)])
        self.keys, self.counts = both[first], np.add.reduceat(many, first) if len(first) else many
        self.most = max(self.most, len(self.keys))
        self.capacity = max(self.capacity, ROOM * self.mass // self.threshold + 1)
        if len(self.keys) > self.capacity:
            less = int(-np.partition(-self.counts, self.capacity)[self.capacity])
            less = min(less, self.threshold - 1 - self.taken)
            keep = self.counts > less
            self.keys, self.counts, self.taken = self.keys[keep], self.counts[keep] - less, self.taken + less

    def survivors(self) -> np.ndarray:
        return self.keys[self.counts + self.taken >= self.threshold]


def _parts(docs: DataFrame, mass: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(mass / PART_MASS))


def _edges(parts: int) -> np.ndarray:
    """The least key of every hash partition but the first; key k is in floor(k * parts / 2**64)."""
    return np.array([-((-p << 64) // parts) for p in range(1, parts)], dtype=np.uint64)


def _task_summaries(docs: DataFrame, widths: list[int], parts: int, pairs: Bloom | None) -> DataFrame:
    """part, keys, counts: what each task saw, a row for each hash partition."""

    def flushed(pending):
        import pyarrow as pa

        keys, counts = np.unique(np.concatenate(pending), return_counts=True)
        # sorted keys lie part by part
        cut = np.concatenate([[0], np.searchsorted(keys, _edges(parts)), [len(keys)]])
        some = np.flatnonzero(np.diff(cut))
        counts = counts.astype(np.uint32)
        packed = lambda a: pa.array([a[cut[p] : cut[p + 1]].tobytes() for p in some.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), packed(keys), packed(counts)], names=["part", "keys", "counts"])

    def run(batches):
        grams, pending, size = Grams(checked=False), [], 0
        for batch in batches:
            for langs, data, offsets in _blocks(batch):
                grams.read(data, offsets, _lang_keys(langs))
                good = None
                for n, (at, key) in enumerate(grams.keys(max(widths)), 1):
                    if n == 2 and pairs is not None:
                        good = np.zeros(len(grams.start), dtype=bool)
                        good[at] = pairs.has(key)
                    if n not in widths:
                        continue
                    if pairs is not None:
                        fits = np.ones(len(at), dtype=bool)
                        for k in range(n - 1):
                            fits &= good[at + k]
                        key = key[fits]
                    pending.append(key)
                    size += len(key)
                if size >= FLUSH:
                    yield flushed(pending)
                    pending, size = [], 0
        if size:
            yield flushed(pending)

    return docs.mapInArrow(lean(run), "part long, keys binary, counts binary")


def survivors(docs: DataFrame, widths: list[int], threshold: int, mass: int, pairs: Bloom | None = None) -> DataFrame:
    """key: all n-grams of these lengths that can be as frequent as ``threshold``.

    ``docs`` has lang and text without nulls; ``mass`` is at least the number of n-grams
    (it sets the number of partitions and the least capacity).
    """
    parts = _parts(docs, mass)
    capacity = ROOM * mass // parts // threshold + 1

    def run(batches):
        import pyarrow as pa

        now, state, keys, counts = None, None, [], []

        def ended():
            state.merge(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(state.survivors().view(np.int64))], names=["key"])

        for batch in batches:
            for part, k, c in zip(batch.column("part").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
                if part != now:
                    if now is not None:
                        yield ended()
                    now, state, keys, counts = part, Summary(threshold, capacity), [], []
                keys.append(np.frombuffer(k.as_buffer(), dtype=np.uint64))
                counts.append(np.frombuffer(c.as_buffer(), dtype=np.uint32).astype(np.int64))
                if sum(map(len, keys)) > max(capacity, 1 << 16):
                    state.merge(keys, counts)
                    keys, counts = [], []
        if now is not None:
            yield ended()

    dealt = _task_summaries(docs, widths, parts, pairs).repartition(parts, "part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(lean(run), "key long"), "phrase-survivors")


def bloom_filter(keys: DataFrame) -> Bloom:
    """A filter of all keys. At most MOST_BITS bits come to the driver, however many keys there are."""
    n_bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * keys.count()).bit_length()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.concatenate(list(Bloom.places(batch.column(0).to_numpy().view(np.uint64), n_bits)))
            got.sort()
            word = got >> np.uint64(6)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])[: len(word)])
            if len(first):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (got & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word[first].astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = keys.mapInArrow(lean(run), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n_bits >> 6, dtype=np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bloom(bits)


# --- second pass -------------------------------------------------------------------


class _Held:
    """Phrases of a task with their counts, found by key and told apart by a second hash."""

    def __init__(self):
        self.keys = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int64)
        self.checks, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.rows: list = []

    def add(self, key: np.ndarray, check: np.ndarray, put) -> None:
        """Count occurrences; ``put(which)`` gives the languages and phrases of some of them."""
        if not len(key):
            return
        unique, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        known = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), dtype=bool)
        want = check[first]
        want[known] = self.checks[self.slots[place[known]]]
        # keys that meet by chance: such occurrences make rows of their own
        other = np.flatnonzero(check != want[inverse])
        if len(other):
            self.rows.append((key[other], *put(other), np.ones(len(other), dtype=np.int64)))
            counts -= np.bincount(inverse[other], minlength=len(unique))
        self.counts[self.slots[place[known]]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            slots = len(self.counts) + np.arange(len(new))
            self.rows.append((unique[new], *put(first[new]), None))
            self.counts = np.concatenate([self.counts, counts[new]])
            self.checks = np.concatenate([self.checks, want[new]])
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.slots = keys[order], np.concatenate([self.slots, slots])[order]

    def flushed(self, parts: int):
        """Everything held, packed by hash partition and language; nothing is held afterwards."""
        import pyarrow as pa

        if not self.rows:
            return None
        at, own = 0, []
        for keys, _, _, counts in self.rows:
            if counts is None:
                counts, at = self.counts[at : at + len(keys)], at + len(keys)
            own.append(counts)
        part = np.searchsorted(_edges(parts), np.concatenate([r[0] for r in self.rows]), side="right")
        langs = pa.chunked_array([r[1] for r in self.rows]).combine_chunks().dictionary_encode()
        phrases = pa.chunked_array([r[2] for r in self.rows]).combine_chunks()
        code = langs.indices.to_numpy()
        order = np.lexsort((code, part))
        part, code = part[order], code[order]
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (code[1:] != code[:-1])]))
        off = pa.array(np.append(first, len(order)).astype(np.int32))
        packed = [pa.ListArray.from_arrays(off, a) for a in (phrases.take(pa.array(order)), pa.array(np.concatenate(own)[order]))]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(part[first]), langs.dictionary.take(pa.array(code[first])), *packed], names=["part", "lang", "phrases", "counts"])


def _phrase_texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, n: int):
    """The n words from each place on, lower-cased (A-Z), with one space between."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def word(k: np.ndarray):
        sizes = end[k] - start[k]
        off = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(start[k] - off[:-1], sizes) + np.arange(off[-1])
        return pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(lower[data[flat]].tobytes())])

    parts = [word(at + k) for k in range(n)]
    joined = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    return joined.cast(pa.large_string()).cast(pa.string())


def _counted(docs: DataFrame, most: int, parts: int, short: Bloom, long_: Bloom | None) -> DataFrame:
    """part, lang, phrases, counts: what each task counted of the n-grams that pass the filters."""

    def run(batches):
        import pyarrow as pa

        grams, held = Grams(checked=True), _Held()
        for batch in batches:
            for langs, data, offsets in _blocks(batch):
                grams.read(data, offsets, _lang_keys(langs))
                names, good = np.array(langs, dtype=object), np.zeros(len(grams.start), dtype=bool)
                for n, (at, key) in enumerate(grams.keys(most), 1):
                    if n <= 2:
                        fits = short.has(key)
                        if n == 2:
                            good[at[fits]] = True
                    else:
                        fits = np.ones(len(at), dtype=bool)
                        for k in range(n - 1):
                            fits &= good[at + k]
                        fits[fits] = long_.has(key[fits])
                    at, key = at[fits], key[fits]
                    held.add(key, grams.checks(at, n), lambda which, at=at, n=n: (pa.array(names[grams.text[at[which]]], pa.string()), _phrase_texts(data, grams.start, grams.end, at[which], n)))
                if len(held.counts) >= HELD:
                    yield held.flushed(parts)
        if held.rows:
            yield held.flushed(parts)

    return docs.mapInArrow(lean(run), "part long, lang string, phrases array<string>, counts array<long>")


def _added(packed: DataFrame, parts: int, threshold: int) -> DataFrame:
    """lang, phrase, f of the phrases that reach the threshold, hash partition by hash partition."""

    def run(batches):
        import pyarrow as pa

        now, held, size = None, [], 0

        def summed(tables):
            got = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
            return got.rename_columns({"f_sum": "f"}).select(["lang", "phrase", "f"])

        def ended():
            got = summed(held)
            keep = got.column("f").to_numpy() >= threshold
            return got.filter(pa.array(keep)).combine_chunks().to_batches()

        for batch in batches:
            parts_ = batch.column("part").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], parts_[1:] != parts_[:-1]])[: len(parts_)])
            for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(parts_)]):
                if parts_[lo] != now:
                    if held:
                        yield from ended()
                    now, held, size = parts_[lo], [], 0
                rows = batch.slice(lo, hi - lo)
                phrases = rows.column("phrases")
                lang = rows.column("lang").take(pa.array(np.repeat(np.arange(len(rows)), np.diff(phrases.offsets.to_numpy()))))
                held.append(pa.table({"lang": lang, "phrase": phrases.flatten(), "f": rows.column("counts").flatten()}))
                size += len(lang)
                if size > 2 * HELD:
                    held = [summed(held)]
                    size = 0
        if held:
            yield from ended()

    dealt = packed.repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lean(run), "lang string, phrase string, f long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 4, threshold: int = 30) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f of all phrases of 1 to ``most`` words with f >= ``threshold``; lang, n).

    Both are written tables; f and n are exact. ``n`` counts all words of a language.
    """
    if most < 2 or threshold < 1:
        raise ValueError("phrases have two words or more and occur")
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    totals = written(rows.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD)).cast("long")).alias("n")), "phrase-totals")
    mass = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    short = bloom_filter(survivors(rows, [1, 2], threshold, 2 * mass))
    long_ = bloom_filter(survivors(rows, list(range(3, most + 1)), threshold, (most - 2) * mass, short)) if most > 2 else None
    parts = _parts(docs, most * mass)
    return written(_added(_counted(rows, most, parts, short, long_), parts, threshold), "phrase-counts"), totals


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 4, threshold: int = 30, contained_percent: int = 80, top: int = 2000) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and split into pieces and words; phrases are 2 to ``most``
    contiguous words of a piece that occur ``threshold`` times or more. A cut after the
    first k words scores floor(2000000 a / (l + r)); the lowest cut counts, the smallest k
    among equals. Phrases inside a longer one of at least ``contained_percent`` of their
    occurrences go. Null texts are empty, a null language is ``und``; rows count as often
    as they are repeated; other columns are ignored; an empty table gives no rows.
    """
    return best_phrases(*phrase_counts(docs, text_col, lang_col, most, threshold), contained_percent, top)


def best_phrases(counts: DataFrame, totals: DataFrame, contained_percent: int = 80, top: int = 2000) -> DataFrame:
    """``collocations`` from what ``phrase_counts`` gives; exact for any long counts."""
    words = F.split("phrase", " ")
    phrases = counts.withColumn("_w", words).filter(F.size("_w") > 1)
    piece = lambda first, size: F.array_join(F.slice("_w", first, size), " ")
    part = lambda name, value: counts.select(F.col("lang"), F.col("phrase").alias(name), F.col("f").alias(value))
    cut = phrases.select("lang", "phrase", F.col("f").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("_first"), piece(F.col("k") + 1, F.size("_w")).alias("_rest"))
    joined = cut.join(part("_first", "l"), ["lang", "_first"]).join(part("_rest", "r"), ["lang", "_rest"])
    # products pass 64 bits, so they are decimals; div drops the fraction
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = joined.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_b"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("_w") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("_w") - m + 1), lambda i: F.array_join(F.slice("_w", i, m), " "))))
    inside = phrases.filter(F.size("_w") > 2).select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("_longer").isNull() | (_wide(F.col("_longer")) * 100 < _wide(F.col("a")) * contained_percent))
    named = kept.select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)).alias("_slot"))
    # a language's phrases are ranked in slots first, so that few of each come together
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for by in (["lang", "_slot"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return named.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB's form of the registered query.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM p))),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
      FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.*, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f + y.f) AS BIGINT) AS score
      FROM k JOIN f x ON k.lang = x.lang AND k.x = x.phrase JOIN f y ON k.lang = y.lang AND k.y = y.phrase),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[j:j + q - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, w, a, q, unnest(range(1, m - q + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS q FROM c WHERE m > 2)) GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT z.lang, rank, z.phrase, a, l, r, n, score FROM z JOIN t ON z.lang = t.lang WHERE rank <= 2000
"""
