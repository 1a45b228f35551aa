"""Quality rules: counts of a text, and n-gram perplexity within its language.

The language model is an interpolated modified Kneser-Ney model over the bytes of
the texts (order 5). Spark counts every n-gram of all documents that pass the base
rules and derives continuation counts, discounts from the counts of counts of each
order, and the totals of all contexts. The model is stored as two sorted arrays of
hashes, n-grams with their counts and contexts with their totals and discounted
mass.

No document is predicted by itself: while a text is scored, its own counts are taken
out of the counts, totals and discounted masses it meets, order by order (an n-gram
that only this text has counts as never seen, and no longer counts as a
continuation). So nothing needs to be pruned.

The perplexity bands of a language come from all its documents: the medians of the
distinct log perplexities a byte and a word, and spreads that shrink with the root of
a text's words, so groups of copies weigh as one and short texts need no wide band for
all.

A model whose arrays fit ``broadcast_bytes`` is broadcast and texts are scored
where they lie. A larger one stays distributed: its arrays lie in shards, ranges of the
hash, and the n-grams of all texts are dealt to the shards and looked up there, order by
order, by the same formulas in the same precision.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WordHasher, lean, mix64, text_blocks, windows, written

ORDER = 5
#: Of the model's arrays (16 bytes an n-gram, 24 a context); beyond it texts meet them shard by shard.
BROADCAST_BYTES = 128 << 20
SHARDS, SHARD_BYTES = 64, 32 << 20
#: n-grams that look into a shard from one task, about.
SLOT_ROWS = 1 << 22
#: Text that is scored at once: its n-grams take some hundred bytes each.
SCORE_BYTES = 1 << 19
#: Half widths in robust standard deviations of a text's length: nats a byte, nats a
#: word, and their difference (marks between or behind the words move them apart).
BYTE_WIDTH, WORD_WIDTH, APART_WIDTH = 8.0, 5.0, 5.0
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS, REPEAT_PERCENT, REPEAT_WIDTH = 10, 20, 5


def _packed(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram of bytes packed big-endian) at every byte.

    Texts are preceded by order - 1 nought bytes.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(data)) + (owner + 1) * (order - 1)
    room = np.zeros(len(data) + n * (order - 1), dtype=np.uint64)
    room[at] = data
    gram = room.copy()
    for k in range(1, order):
        gram[k:] |= room[:-k] << np.uint64(8 * k)
    return owner, gram[at]


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Words covered by windows that their text has at least twice."""
    at, window = windows(owner, hashes, REPEAT_WIDTH)
    if not len(at):
        return np.zeros(n, dtype=np.int64)
    # windows of different texts differ by a part made of the text's number
    with np.errstate(over="ignore"):
        window = window + mix64(np.arange(1, n + 1, dtype=np.uint64))[owner[at]]
    order = np.argsort(window)
    window = window[order]
    same = window[1:] == window[:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    edge[at[twice]] += 1
    edge[at[twice] + REPEAT_WIDTH] -= 1
    return np.bincount(owner, weights=np.cumsum(edge)[:-1] > 0, minlength=n).astype(np.int64)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    n = len(offsets) - 1
    out = np.zeros(n, dtype=np.int64)
    breaks = np.flatnonzero(data == 10)
    first = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    first = first[first < len(data)]
    of = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, first)], offsets[of + 1])
    holds = np.searchsorted(starts, stop) > np.searchsorted(starts, first)
    first, stop, of = first[holds], stop[holds], of[holds]
    some = np.flatnonzero(np.bincount(of, minlength=n) > 1)
    raw = data.tobytes()
    for t, i, j in zip(some.tolist(), np.searchsorted(of, some).tolist(), np.searchsorted(of, some, side="right").tolist(), strict=True):
        out[t] = (j - i) - len({raw[first[x] : stop[x]] for x in range(i, j)})
    return out


def _counts(hasher: WordHasher, symbol: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of every text of a block."""
    n = len(offsets) - 1
    starts, ends, owner, hashes = hasher.words(data, offsets)
    # code points: bytes that don't continue one
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    marks = np.concatenate([[0], np.cumsum(symbol[data])])
    return [
        np.bincount(owner, minlength=n),
        np.bincount(owner, weights=points[ends] - points[starts], minlength=n).astype(np.int64),
        marks[offsets[1:]] - marks[offsets[:-1]],
        _dup_lines(data, offsets, starts),
        _repeat_words(owner, hashes, n),
    ]


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[[ord(c) for c in SYMBOLS]] = 1
    return table


def _failed():
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _passes(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text of a block passes the base rules."""
    n = len(offsets) - 1
    _, _, owner, hashes = hasher.words(data, offsets)
    n_words = np.bincount(owner, minlength=n)
    return (n_words >= FEWEST_WORDS) & (100 * _repeat_words(owner, hashes, n) <= REPEAT_PERCENT * n_words)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _numbered_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run begins, and the number of the run of each value."""
    new = np.empty(len(keys), dtype=bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    keys = np.sort(keys)
    first = _runs(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """lang, gram, n: counts of all n-grams of all texts that pass the base rules.

    Each task counts its blocks before the shuffle. Null languages are one language;
    an empty table gives no rows.
    """
    ship(docs.sparkSession)
    bits, low = np.uint64(8 * order), np.uint64((1 << 8 * order) - 1)

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(lower=False)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names: dict = {}
            keys, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                owner, gram = _packed(data, offsets, order)
                keep = _passes(hasher, data, offsets)[owner]
                number = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]], dtype=np.uint64)
                more, times = _counted(gram[keep] | number[owner[keep]] << bits)
                both = np.concatenate([keys, more])
                at = np.argsort(both, kind="stable")
                first = _runs(both[at])
                keys = both[at][first]
                n = np.add.reduceat(np.concatenate([n, times])[at], first) if len(first) else n
            of = (keys >> bits).astype(np.int64)
            for name, k in names.items():
                part = of == k
                yield pa.RecordBatch.from_arrays([pa.array([name] * int(part.sum()), pa.string()), pa.array((keys[part] & low).astype(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])

    picked = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Written tables of a modified Kneser-Ney model of some order.

    counts: lang, k, gram, n (the highest order has raw counts, the lower ones the
    number of different bytes seen before the n-gram). contexts: lang, k, gram, total,
    cut (of all n-grams of order k that begin with ``gram``, k - 1 bytes: the sum of
    n, and of the discounts). discounts: lang, k, d1, d2, d3.
    """

    counts: DataFrame
    contexts: DataFrame
    discounts: DataFrame
    order: int


def _discount(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def kneser_ney(grams: DataFrame, order: int = ORDER) -> Model:
    """The model of all n-grams ``grams`` (lang, gram, n).

    Discounts come from the counts of counts of each language and order, by the
    usual formula (0.5, 1, 1.5 where one of the four counts of counts is nought). An
    empty table gives an empty model.
    """
    tables = [grams.select("lang", F.lit(order).alias("k"), "gram", "n")]
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables.append(written(tables[-1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")).select("lang", F.lit(k).alias("k"), "gram", "n"), f"kn-counts-{k}"))
    counts = reduce(DataFrame.unionByName, tables)
    of = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    parts = (F.when(enough, F.greatest(F.lit(0.05), F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0)))).otherwise(0.5 * i).alias(f"d{i}") for i in (1, 2, 3))
    # a row for each language and order: Spark broadcasts it if its size allows
    discounts = written(counts.groupBy("lang", "k").agg(*of).select("lang", "k", *parts), "kn-discounts")
    cut = counts.join(_renamed(discounts), F.col("lang").eqNullSafe(F.col("_l")) & (F.col("k") == F.col("_k")))
    contexts = cut.groupBy("lang", "k", F.shiftright("gram", 8).alias("gram")).agg(F.sum("n").alias("total"), F.sum(_discount(F.col("n"))).alias("cut"))
    return Model(counts, written(contexts, "kn-contexts"), discounts, order)


def _renamed(table: DataFrame) -> DataFrame:
    return table.withColumnsRenamed({"lang": "_l", "k": "_k", "gram": "_g"})


def _salt(lang: str | None, k: int) -> np.uint64:
    text = ("" if lang is None else "=" + lang).encode()
    h = np.uint64(k + 1)
    with np.errstate(over="ignore"):
        for b in text:
            h = h * np.uint64(0x100000001B3) + np.uint64(b)
        return mix64(np.array([h], dtype=np.uint64))[0]


def hash_arrays(table: DataFrame, values: list[str], shards: int = SHARDS) -> DataFrame:
    """shard, hashes (sorted), an array for each of ``values``: a row per hash range.

    ``table`` has lang, k, gram and the values; of no rows come no shards.
    """
    ship(table.sparkSession)
    kinds = dict(table.dtypes)

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            lang, k = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            salts = {x: _salt(*x) for x in set(zip(lang, k, strict=True))}
            gram = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            salt = np.array([salts[x] for x in zip(lang, k, strict=True)], dtype=np.uint64)
            with np.errstate(over="ignore"):
                h = mix64(gram + salt)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(32)).astype(np.int64) * shards >> 32), pa.array(h.view(np.int64)), *batch.columns[3:]], names=["shard", "h", *values])

    rows = table.select("lang", "k", "gram", *values).mapInArrow(lean(hashed), f"shard long, h long, {', '.join(f'{v} {kinds[v]}' for v in values)}")
    # unsigned order: the sign bit turned
    packed = F.array_sort(F.collect_list(F.struct(F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("hashes"), *values)))
    sorted_ = rows.groupBy("shard").agg(packed.alias("all"))
    return sorted_.select("shard", *(F.col(f"all.{c}").alias(c) for c in ["hashes", *values]))


class HashArrays:
    """Sorted hashes with arrays of values, found by hash through a prefix table."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        self.hashes = hashes
        # the last value stands for all hashes that are absent
        self.values = [np.append(v, v.dtype.type(0)) for v in values]
        bits = max(4, int(np.ceil(np.log2(max(len(hashes), 2)))) + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        runs = np.diff(np.append(self.first, len(hashes)))
        self.longest = int(runs.max()) if len(runs) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where it is absent."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int32)
        at = self.first[(h >> self.shift).view(np.int64)]
        last = np.int32(len(self.hashes) - 1)
        value = self.hashes[np.minimum(at, last)]
        out = np.where(value == h, at, np.int32(-1))
        todo = np.flatnonzero(value < h)
        for _ in range(self.longest):
            here = at[todo] + 1
            inside = here <= last
            todo, here = todo[inside], here[inside]
            if not len(todo):
                break
            at[todo] = here
            value = self.hashes[here]
            hit = value == h[todo]
            out[todo[hit]] = here[hit]
            todo = todo[value < h[todo]]
        return out

    def look_up(self, h: np.ndarray) -> list[np.ndarray]:
        """The values of each hash, nought where it is absent."""
        at = self.find(h)
        return [v[at] for v in self.values]


class Scorer:
    """Log probabilities of texts, each by the model without that text's counts."""

    def __init__(self, counts: HashArrays, contexts: HashArrays, discounts: dict, order: int):
        self.counts, self.contexts, self.discounts, self.order = counts, contexts, discounts, order
        self.known: dict = {}

    def _of(self, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Salts and discounts (for counts 0 to 3) of a language by order."""
        if lang not in self.known:
            none = (0.5, 1.0, 1.5)
            self.known[lang] = (
                np.array([_salt(lang, k) for k in range(self.order + 1)], dtype=np.uint64),
                np.array([[0.0, *self.discounts.get((lang, k), none)] for k in range(self.order + 1)]),
            )
        return self.known[lang]

    def score(self, data: np.ndarray, offsets: np.ndarray, langs: list, counted: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of each text's bytes.

        ``counted`` tells which texts are part of the model's counts.
        """
        order, n_texts = self.order, len(langs)
        owner, gram = _packed(data, offsets, order)
        if not len(owner):
            return np.zeros(n_texts)
        salts, cuts = (np.stack(x) for x in zip(*map(self._of, langs), strict=True))
        bits = np.uint64(8 * order)
        keys, times = _counted(gram | owner.astype(np.uint64) << bits)
        own = np.where(counted[(keys >> bits).view(np.int64)], times, 0)
        whole, levels = (keys >> bits).view(np.int64), []
        for k in range(order, 0, -1):
            of = (keys >> bits).view(np.int64)
            g = keys & np.uint64((1 << 8 * k) - 1)
            salt, cuts_k = salts[:, k].copy(), cuts[:, k].ravel()
            with np.errstate(over="ignore"):
                (n,) = self.counts.look_up(mix64(g + salt[of]))
                # keys go by text, then bytes: contexts are runs
                first, run = _numbered_runs(keys >> np.uint64(8))
                total, cut = self.contexts.look_up(mix64((g[first] >> np.uint64(8)) + salt[of[first]]))
            left = np.maximum(n - own, 0)
            of *= 4
            kept = cuts_k[of + np.minimum(left, 3)]
            less = cuts_k[of + np.minimum(n, 3)]
            less -= kept
            total -= np.add.reduceat(own, first)
            cut -= np.add.reduceat(less, first)
            gone = (n > left) & (left == 0)
            low = keys & np.uint64(~((1 << 8 * order) - 1) & 0xFFFFFFFFFFFFFFFF | (1 << 8 * (k - 1)) - 1)
            at = np.argsort(low)
            low = low[at]
            first, number = _numbered_runs(low)
            lower = np.empty_like(number)
            lower[at] = number
            levels.append((left - kept, total, cut, run, lower))
            keys, own = low[first], np.add.reduceat(gone[at], first, dtype=np.int64)
        p = np.full(len(keys), 1 / 256)
        for seen, total, cut, run, lower in reversed(levels):
            q = p[lower]
            # an unseen context leaves all to the order below
            empty = total <= 0
            total, cut = np.where(empty, 1.0, total), np.where(empty, 1.0, cut)
            seen[empty[run]] = 0.0
            p = (seen + cut[run] * q) / total[run]
        return np.bincount(whole, weights=times * np.log(p), minlength=n_texts)


def model_arrays(model: Model) -> tuple[list[np.ndarray], list[np.ndarray], dict]:
    """The arrays and discounts of a model whose size the caller has checked."""

    def collected(table: DataFrame, values: dict) -> list[np.ndarray]:
        rows = written(hash_arrays(table, list(values)), "hash-arrays").orderBy("shard").toArrow()

        def joined(name: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, dtype=kind), *(x.flatten().to_numpy(zero_copy_only=False).astype(kind) for x in rows.column(name).chunks)])

        return [joined("hashes", np.int64).view(np.uint64) ^ np.uint64(1 << 63), *(joined(v, kind) for v, kind in values.items())]

    discounts = {(r.lang, r.k): (r.d1, r.d2, r.d3) for r in model.discounts.collect()}
    return collected(model.counts, {"n": np.int64}), collected(model.contexts, {"total": np.int64, "cut": np.float64}), discounts


def row_key(id_col: str, text_col: str, lang_col: str) -> Column:
    """16 bytes that tell rows of different id, text or language apart."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\0", part(id_col), part(lang_col), part(text_col))))


def counted_and_scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, lang, the five counts, n_bytes, log_ppl, base_failed.

    log_ppl is minus the mean log probability of the text's bytes (9 digits), null
    for ''. The model must hold the counts of these documents.
    """
    ship(docs.sparkSession)
    kind, order = dict(docs.dtypes)[id_col], model.order
    picked = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    local = model.counts.count() * 16 + model.contexts.count() * 24 <= broadcast_bytes
    shared = docs.sparkSession.sparkContext.broadcast(model_arrays(model)) if local else None
    if not local:
        picked = picked.withColumn("key", row_key("id", "text", "lang"))

    def run(batches):
        import pyarrow as pa

        hasher, symbol = WordHasher(lower=False), _symbol_table()
        scorer = None
        if local:
            counts, contexts, discounts = shared.value
            scorer = Scorer(HashArrays(*counts), HashArrays(*contexts), discounts, order)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_blocks(batch.column(2), SCORE_BYTES):
                counts = _counts(hasher, symbol, data, offsets)
                n_words, repeated = counts[0], counts[-1]
                passes = (n_words >= FEWEST_WORDS) & (100 * repeated <= REPEAT_PERCENT * n_words)
                value = [None] * (hi - lo)
                if local:
                    sums = scorer.score(data, offsets, langs[lo:hi], passes)
                    value = [-s / m if m else None for s, m in zip(sums.tolist(), np.diff(offsets).tolist(), strict=True)]
                same = [batch.column(k).slice(lo, hi - lo) for k in (0, 1, *range(3, batch.num_columns))]
                yield pa.RecordBatch.from_arrays(
                    [*same[:2], *(pa.array(x.astype(np.int64)) for x in (*counts, np.diff(offsets))), pa.array(value, pa.float64()), *same[2:]],
                    names=["id", "lang", *COUNTS, "n_bytes", "log_ppl", *(["key"] if not local else [])],
                )

    out = picked.mapInArrow(lean(run), f"id {kind}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, n_bytes long, log_ppl double{'' if local else ', key binary'}")
    if not local:
        scored = _scored_by_shards(picked, model).withColumnRenamed("key", "_key")
        out = out.drop("log_ppl").join(scored, F.col("key") == F.col("_key"), "left").drop("key", "_key")
    return out.withColumn("log_ppl", F.round("log_ppl", 9)).withColumnRenamed("id", id_col).withColumn("base_failed", _failed())


def _hashed(rows: DataFrame, shards: int) -> DataFrame:
    """Adds _shard and _h, by which ``hash_arrays`` holds (lang, k, gram)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, k = batch.column("lang").to_pylist(), batch.column("k").to_pylist()
            salts = {x: _salt(*x) for x in set(zip(lang, k, strict=True))}
            salt = np.array([salts[x] for x in zip(lang, k, strict=True)], dtype=np.uint64)
            with np.errstate(over="ignore"):
                h = mix64(batch.column("gram").to_numpy(zero_copy_only=False).astype(np.uint64) + salt)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((h >> np.uint64(32)).astype(np.int64) * shards >> 32), pa.array(h.view(np.int64))], names=[*batch.schema.names, "_shard", "_h"])

    return rows.mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", _shard long, _h long")


def looked_up(rows: DataFrame, arrays: DataFrame, values: dict[str, str], shards: int) -> DataFrame:
    """``rows`` (lang, k, gram and more) with the ``values`` of their n-gram, nought where it is absent.

    ``arrays`` is a written table of ``hash_arrays``. Rows are dealt to the shards; the rows
    of a shard that many look into are spread over slots, each with the shard's arrays. A
    task holds one shard's arrays, which come first, and a batch of rows.
    """
    hashed = _hashed(rows, shards)
    # a row for each shard
    busiest = hashed.groupBy("_shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slots = max(1, -(-busiest // SLOT_ROWS))
    asked = hashed.withColumn("_slot", F.pmod(F.xxhash64("_h", F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
    held = arrays.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("_slot"), F.col("hashes").alias("_hashes"), *(F.col(v).alias(f"_v_{v}") for v in values))
    columns = rows.columns
    both = asked.withColumn("_last", F.lit(1)).unionByName(held.withColumn("_last", F.lit(0)), allowMissingColumns=True)
    dealt = both.repartition(shards * slots, "_shard", "_slot").sortWithinPartitions("_shard", "_slot", "_last")

    def run(batches):
        import pyarrow as pa

        now, table = None, None
        for batch in batches:
            place = list(zip(batch.column("_shard").to_pylist(), batch.column("_slot").to_pylist(), batch.column("_last").to_pylist(), strict=True))
            edge = [k for k in range(len(place)) if not k or place[k] != place[k - 1]]
            for lo, hi in zip(edge, [*edge[1:], len(place)]):
                shard, slot, last = place[lo]
                part = batch.slice(lo, hi - lo)
                if not last:
                    of = lambda c, kind: part.column(c)[0].values.to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
                    now, table = (shard, slot), HashArrays(of("_hashes", np.int64).view(np.uint64) ^ np.uint64(1 << 63), *(of(f"_v_{v}", np.float64 if t == "double" else np.int64) for v, t in values.items()))
                    continue
                if (shard, slot) != now:
                    now, table = (shard, slot), HashArrays(np.zeros(0, dtype=np.uint64), *(np.zeros(0, dtype=np.float64 if t == "double" else np.int64) for t in values.values()))
                found = table.look_up(part.column("_h").to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *map(pa.array, found)], names=[*columns, *values])

    return dealt.mapInArrow(lean(run), ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, *values.items()]))


def _scored_by_shards(picked: DataFrame, model: Model) -> DataFrame:
    """key, log_ppl: each text's n-grams looked up in the shards of the model's arrays.

    The same steps as ``Scorer.score``: down the orders for what is left of counts,
    totals and discounted masses, then up for the probabilities.
    """
    shards = [max(SHARDS, -(-t.count() * each // SHARD_BYTES)) for t, each in ((model.counts, 16), (model.contexts, 24))]
    counts, contexts = (written(hash_arrays(t, v, n), "hash-arrays") for t, v, n in ((model.counts, ["n"], shards[0]), (model.contexts, ["total", "cut"], shards[1])))
    order = model.order

    def run(batches):
        import pyarrow as pa

        hasher, bits = WordHasher(lower=False), np.uint64(8 * order)
        for batch in batches:
            keys, langs = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                owner, gram = _packed(data, offsets, order)
                both, times = _counted(gram | owner.astype(np.uint64) << bits)
                of = (both >> bits).astype(np.int64)
                own = np.where(_passes(hasher, data, offsets)[of], times, 0)
                rows = pa.array(of + lo)
                yield pa.RecordBatch.from_arrays([keys.take(rows), langs.take(rows), pa.array((both & np.uint64((1 << 8 * order) - 1)).astype(np.int64)), pa.array(own), pa.array(times)], names=["key", "lang", "gram", "own", "times"])

    rows = picked.select("key", "lang", "text").mapInArrow(lean(run), "key binary, lang string, gram long, own long, times long")
    # rows that repeat a text under one id have the same numbers
    rows = written(rows.groupBy("key", "lang", "gram").agg(F.first("own").alias("own"), F.first("times").alias("times")), "text-grams")
    level, levels = rows.select("key", "lang", "gram", "own"), {}
    for k in range(order, 0, -1):
        cuts = _renamed(model.discounts.filter(F.col("k") == k)).drop("_k")
        met = looked_up(level.withColumn("k", F.lit(k)), counts, {"n": "long"}, shards[0]).join(cuts, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")
        met = met.withColumn("left", F.greatest(F.col("n") - F.col("own"), F.lit(0)))
        met = met.withColumns({"kept": F.coalesce(_discount(F.col("left")), F.lit(0.0)), "was": F.coalesce(_discount(F.col("n")), F.lit(0.0)), "context": F.shiftright("gram", 8)})
        run_ = Window.partitionBy("key", "context")
        met = met.withColumns({"less": F.sum("own").over(run_), "less_cut": F.sum(F.col("was") - F.col("kept")).over(run_)})
        met = looked_up(met.withColumnsRenamed({"gram": "whole", "context": "gram"}), contexts, {"total": "long", "cut": "double"}, shards[1]).withColumnsRenamed({"gram": "context", "whole": "gram"})
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
        levels[k] = written(
            met.select("key", "lang", "gram", suffix.alias("suffix"), (F.col("left") - F.col("kept")).alias("seen"), (F.col("total") - F.col("less")).alias("total"), (F.col("cut") - F.col("less_cut")).alias("cut"), ((F.col("n") > 0) & (F.col("left") == 0)).alias("gone")),
            f"text-grams-{k}",
        )
        level = levels[k].groupBy("key", "lang", F.col("suffix").alias("gram")).agg(F.count_if("gone").alias("own"))
    p = None
    for k in range(1, order + 1):
        below = levels[k].withColumn("q", F.lit(1 / 256)) if p is None else levels[k].join(p, (F.col("key") == F.col("_key")) & (F.col("suffix") == F.col("_g")))
        p = below.select(F.col("key").alias("_key"), F.col("gram").alias("_g"), F.when(F.col("total") > 0, (F.col("seen") + F.col("cut") * F.col("q")) / F.col("total")).otherwise(F.col("q")).alias("q"))
    both = rows.join(p, (F.col("key") == F.col("_key")) & (F.col("gram") == F.col("_g")))
    return both.groupBy("key").agg((-F.sum(F.log("q") * F.col("times")) / F.sum("times")).alias("log_ppl"))


def _root():
    return F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))


def _per_word():
    """Bytes of a text for each of its words."""
    return F.col("n_bytes") / F.greatest("n_words", F.lit(1))


def bands(scored: DataFrame) -> DataFrame:
    """lang, byte, word, apart (medians), byte_s, word_s, apart_s (spreads).

    From the distinct values of the documents that passed the base rules. ``byte``
    and ``word`` are nats a byte and a word. The spread of a mean over a text falls
    with the root of its words, so deviations times that root have one spread for
    all lengths: the distance of their quartiles, as of a normal distribution.
    ``apart`` is the byte deviation minus the word deviation, each over its spread.
    With m values a spread is uncertain by about 1.17 / sqrt(m), and is taken two
    such errors wider.
    """

    def quartiles(c):
        return F.percentile_approx(c, [0.25, 0.5, 0.75], 10000)

    def spread(q, m):
        return F.greatest((F.element_at(q, 3) - F.element_at(q, 1)) / 1.349 * (1 + 2.34 / F.sqrt(m)), F.lit(1e-6))

    values = scored.filter("not base_failed and log_ppl is not null").select("lang", "n_words", "n_bytes", F.col("log_ppl").alias("v")).distinct()
    out = values.groupBy("lang").agg(F.percentile_approx("v", 0.5, 10000).alias("byte"), F.percentile_approx(F.col("v") * _per_word(), 0.5, 10000).alias("word"))

    def centred(limits):
        # a row for each language, written: Spark broadcasts it if its size allows
        return values.join(written(limits, "band-centres").withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")))

    byte, word = (F.col("v") - F.col("byte")) * _root(), (F.col("v") * _per_word() - F.col("word")) * _root()
    cut = centred(out).groupBy("lang", "byte", "word").agg(quartiles(byte).alias("b"), quartiles(word).alias("w"), F.count("*").alias("m"))
    out = cut.select("lang", "byte", "word", spread("b", F.col("m")).alias("byte_s"), spread("w", F.col("m")).alias("word_s"))
    cut = centred(out).groupBy("lang", "byte", "word", "byte_s", "word_s").agg(quartiles(byte / F.col("byte_s") - word / F.col("word_s")).alias("a"), F.count("*").alias("m"))
    return cut.select("lang", "byte", "word", F.element_at("a", 2).alias("apart"), "byte_s", "word_s", spread("a", F.col("m")).alias("apart_s"))


def within(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` with low and high: log perplexities that each text may have.

    All three bands are linear in the log perplexity of a text of given length; low
    and high bound their common part (low > high where there is none).
    """
    far = float("inf")
    root, per_word = _root(), _per_word()
    slope = root / F.col("byte_s") - root * per_word / F.col("word_s")
    at = F.col("apart") + root * F.col("byte") / F.col("byte_s") - root * F.col("word") / F.col("word_s")
    ends = [(at + side * APART_WIDTH * F.col("apart_s")) / F.nullif(slope, F.lit(0.0)) for side in (-1, 1)]
    # with no slope the difference is the same for all perplexities: within or not
    level = F.when(F.abs(at) <= APART_WIDTH * F.col("apart_s"), F.lit(far)).otherwise(F.lit(-far))
    low = F.greatest(F.col("byte") - BYTE_WIDTH * F.col("byte_s") / root, (F.col("word") - WORD_WIDTH * F.col("word_s") / root) / F.nullif(per_word, F.lit(0.0)), F.coalesce(F.least(*ends), -level))
    high = F.least(F.col("byte") + BYTE_WIDTH * F.col("byte_s") / root, (F.col("word") + WORD_WIDTH * F.col("word_s") / root) / F.nullif(per_word, F.lit(0.0)), F.coalesce(F.greatest(*ends), level))
    both = scored.join(written(limits, "bands").withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    return both.withColumns({"low": low, "high": high}).select(*scored.columns, "low", "high")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: the base counts, log_ppl, low, high, kept.

    A line is what ``\\n`` separates; it is a duplicate when it has a word and equals
    an earlier line. n_repeat_words are the words covered by 5-word windows that
    the text has at least twice. Null texts have no words and fail; null languages are
    one language. Each row is judged by its own text, repeated ids or not; rows alike
    in all three columns get the same verdict. A language without documents that pass
    the base rules has no bands, so all its rows fail; an empty table gives no rows.
    Other columns are ignored.
    """
    ship(docs.sparkSession)
    grams = written(ngram_counts(docs, text_col, lang_col, order), "ngrams")
    scored = written(counted_and_scored(docs, kneser_ney(grams, order), id_col, text_col, lang_col, broadcast_bytes), "scored")
    out = within(scored, bands(scored))
    inside = F.coalesce((F.col("log_ppl") >= F.col("low")) & (F.col("log_ppl") <= F.col("high")), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & inside).select(id_col, *COUNTS, "base_failed", "kept", "lang", "log_ppl", "low", "high")


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; all columns stay.

    Rows that repeat an id are judged each by its own text.
    """
    key = row_key(id_col, text_col, lang_col)
    judged = judge(docs.select(key.alias("__key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "__key", **options)
    keep = judged.filter("kept").select("__key").distinct()
    return docs.join(keep, key == F.col("__key"), "left_semi")
