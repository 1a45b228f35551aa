"""MinHash near-dedup by a signature-coordinate inverted join.

A document is the set of its distinct 5-word shingles. Its signature has K
coordinates, each the least value of one hash function over the set. Documents
with equal sets become one representative. Every representative is posted under
its (coordinate, value) pairs. A pair of similarity s shares each coordinate
with probability s, so pairs of at least 0.85 share T = 28 of K = 48 but for odds of
two in a million; pairs that share fewer aren't looked at.

Prefix merging: two signatures that share T of K values share one among the
K - T + 1 rarest values of either, so only these are posted; values that no
other document has fill the prefix first, and documents without partners post
nothing. Skip merging: the long lists (the common values) are never merged; for
each pair that meets in a prefix the remaining coordinates are counted from the
signatures, and pairs below T are skipped.

Links are confirmed on the full sets. Shingles that no other candidate has can't
be shared: with n shingles, u of its own, a document shares at most n - u, which
bounds the similarity of any pair; documents and pairs below are left out.

The result is connected components, so pairs inside one component need no look:
in star rounds each list compares its members with one of them (first the one
with the fewest shingles of its own), and what is linked falls together. What a
list still holds of several components is compared in one block: pairs across
components that pass the bound and share T coordinates are confirmed on the full
sets in the same task, and only the links that join components come out.

A list of more members than a block (texts around one template, say) is split first.
Similar sets of n shingles share one of the n - ceil(0.85 n) + 1 rarest of either, so
the members are posted again under these, rarest among the members of such lists;
shingles that no other of them has fill the prefix first. Lists of the same members
count once. What texts share with all others is common, so lists grow with what
few of them share, not with the template's texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import WordHasher, lean, mix64, text_blocks, windows, written
from .components import connected_components

K, WIDTH = 48, 5
#: Pairs of one document that a task confirms.
SLOT_ROWS = 256
#: Members of one list that a block holds, and their shingles, about; pairs of
#: blocks are compared in a task.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
STAR_ROUNDS = 2


def _sets_of(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts of a block, and their starts."""
    n = len(offsets) - 1
    _, _, text, hashes = hasher.words(data, offsets)
    at, shingle = windows(text, hashes, width)
    owner = text[at]
    counts = np.bincount(text, minlength=n)
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        first = np.searchsorted(text, few)
        with np.errstate(over="ignore"):
            h = counts[few].astype(np.uint64)
            for k in range(width - 1):
                more = k < counts[few]
                h[more] = h[more] * np.uint64(0xD6E8FEB86659FD93) + hashes[first[more] + k]
        owner, shingle = np.concatenate([owner, few]), np.concatenate([shingle, mix64(h)])
    if not len(shingle):
        return shingle, np.zeros(n + 1, dtype=np.int64)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[first], shingle[first]
    return shingle, np.searchsorted(owner, np.arange(n + 1))


def _coordinates(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a | np.uint64(1), mix64(a + np.uint64(77))


def text_key(text: Column) -> Column:
    """16 bytes that tell the texts of one id apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """id, text_key (MD5 of the text), n_shingles, set_hash (null for an empty set), sig (array of k ints)."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(lower=True)
        mul, add = _coordinates(k)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                sets, starts = _sets_of(hasher, data, offsets, width)
                size = np.diff(starts)
                full = np.flatnonzero(size)
                sig = np.zeros((len(full), k), dtype=np.int32)
                if len(full):
                    with np.errstate(over="ignore"):
                        for j in range(k):
                            least = np.minimum.reduceat(sets * mul[j] + add[j], starts[full])
                            sig[:, j] = (mix64(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                keys = [None] * (hi - lo)
                for t in full.tolist():
                    keys[t] = hashlib.blake2b(sets[starts[t] : starts[t + 1]].tobytes(), digest_size=16).digest()
                at = np.zeros(hi - lo + 1, dtype=np.int32)
                at[1:] = np.cumsum((size > 0) * k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(sig.ravel()))],
                    names=["id", "text_key", "n_shingles", "set_hash", "sig"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), "id long, text_key binary, n_shingles long, set_hash binary, sig array<int>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """id and the distinct shingle hashes of its text, sorted as signed numbers."""

    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(lower=True)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sets, starts = _sets_of(hasher, data, offsets, width)
                signed = np.concatenate([np.sort(sets[i:j].view(np.int64)) for i, j in zip(starts, starts[1:])] or [sets.view(np.int64)])
                values = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(signed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), values], names=["id", "shingles"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), "id long, shingles array<long>")


def prefix_postings(reps: DataFrame, k: int, t: int) -> DataFrame:
    """key, id: the k - t + 1 rarest values of each signature that others share."""
    posts = reps.select("id", F.posexplode("sig").alias("pos", "value")).select("id", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("key"))
    # written, so that Spark can split the posts of a common value in the join
    shared = written(posts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared-values")
    listed = posts.join(shared, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("all"))
    # the k - size(all) values of its own come first in the prefix
    prefix = listed.withColumn("own", F.lit(k) - F.size("all")).filter(F.col("own") <= k - t)
    return prefix.select("id", F.explode(F.slice("all", F.lit(1), F.lit(k - t + 1) - F.col("own"))).alias("p")).select(F.col("p.key").alias("key"), "id")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; a's set is sent once.

    Pairs of one ``a`` are dealt to slots of about 256 by ``b``'s hash.
    """
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("slots"))
    dealt = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"))
    named = sets.select(F.col("id").alias("_i"), F.col("shingles").alias("_s"))
    left = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).join(named, F.col("a") == F.col("_i")).select(F.col("a").alias("a1"), F.col("slot").alias("slot1"), F.col("_s").alias("one"))
    right = dealt.join(named, F.col("b") == F.col("_i")).select(F.col("a").alias("a2"), F.col("slot").alias("slot2"), "b", F.col("_s").alias("other"))

    def run(key, one, many):
        import pyarrow as pa

        if one.num_rows and many.num_rows:
            base = one.column("one")[0].values.to_numpy()
            linked = []
            for b, other in zip(many.column("b").to_pylist(), many.column("other"), strict=True):
                values = other.values.to_numpy()
                both = len(base) + len(values) - len(np.union1d(base, values))
                if 100 * both >= percent * (len(base) + len(values) - both):
                    linked.append(b)
        else:
            linked = []
        return pa.table({"a": pa.array([key[0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return left.groupBy("a1", "slot1").cogroup(right.groupBy("a2", "slot2")).applyInArrow(run, "a long, b long")


def _matching(pairs: DataFrame, reps: DataFrame, t: int, percent: int) -> DataFrame:
    """Pairs that pass the bound and share t coordinates (the long lists are skipped)."""
    side = lambda x: reps.select(F.col("id").alias(x), F.struct("sig", "n", "u").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.least(F.col("sa.n") - F.col("sa.u"), F.col("sb.n") - F.col("sb.u"))
    bound = 100 * most >= percent * (F.col("sa.n") + F.col("sb.n") - most)
    same = F.size(F.filter(F.arrays_zip(F.col("sa.sig").alias("x"), F.col("sb.sig").alias("y")), lambda z: z["x"] == z["y"]))
    return joined.filter(bound).filter(same >= t).select("a", "b")


def _blocks(mixed: DataFrame, reps: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """Confirmed links across components, of lists that hold several.

    A task sees two blocks of one list. It keeps its own labels, so a block of
    one component gives at most one link for each that it joins.
    """
    able = mixed.join(reps.select("id", "n", "u"), "id")
    # written, so that Spark can split the members of a long list in the join
    size = written(able.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "list-blocks")
    placed = able.join(size, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block i meets every block j; the pair of blocks is named by (low, high)
    spread = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "id", "component", "i", "n", "u", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    full = spread.join(reps.select("id", "sig"), "id").join(sets, "id")

    def run(key, table):
        import pyarrow as pa

        ids, comp, block, n, u = (np.array(table.column(c).to_numpy()) for c in ("id", "component", "i", "n", "u"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        shingles = table.column("shingles").combine_chunks()
        values, at = shingles.flatten().to_numpy(), np.concatenate([[0], np.cumsum(n)])
        lo, hi = key[1].as_py(), key[2].as_py()
        one, two = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        share = n - u
        a, b = [], []
        for x in one.tolist():
            most = np.minimum(share[two], share[x])
            fits = (comp[two] != comp[x]) & (100 * most >= percent * (n[two] + n[x] - most))
            other = two[fits & ((two > x) | (lo != hi))]
            other = other[(sig[other] == sig[x]).sum(axis=1) >= t]
            if not len(other):
                continue
            mine = values[at[x] : at[x + 1]]
            theirs = np.concatenate([values[at[y] : at[y + 1]] for y in other.tolist()])
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            both = np.add.reduceat((mine[place] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(n[other])[:-1]]))
            for y in other[100 * both >= percent * (n[other] + n[x] - both)].tolist():
                if comp[y] != comp[x]:
                    a.append(int(ids[x]))
                    b.append(int(ids[y]))
                    comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array(np.minimum(a, b).astype(np.int64)), "b": pa.array(np.maximum(a, b).astype(np.int64))})

    return full.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _rare_lists(ids: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """key, id, component: the members ``ids`` of long lists, by their rarest shingles.

    Only lists of several components, and of lists of the same members only one.
    """
    held = written(sets.join(ids, "id", "left_semi").select("id", F.explode("shingles").alias("s")), "long-shingles")
    # written, so that Spark can split a shingle that all have in the join
    common = written(held.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"), "long-common")
    ranked = held.join(common, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("all")).join(reps.select("id", "n"), "id")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("long") + 1 - (F.col("n") - F.size("all"))
    posts = ranked.filter(length > 0).select("id", F.explode(F.slice("all", F.lit(1), length.cast("int"))).alias("p")).select(F.col("p.s").alias("key"), "id")
    posts = written(posts.join(labels.select("id", "component"), "id"), "long-posts")
    print_ = (F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit("list"), F.col("id"))).alias("y"))
    lists = posts.groupBy("key").agg(*print_, F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2")
    one = written(lists.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key"), "long-lists")
    return posts.join(one, "key").select("key", "id", "component")


def final_lists(mixed: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """key, id, component: open lists as they are compared, the long ones split."""
    size = written(mixed.groupBy("key").agg(F.count("*").alias("members")), "list-sizes")
    named = mixed.join(size, "key")
    short = named.filter(F.col("members") <= BLOCK_ROWS).select("key", "id", "component")
    long_ = written(named.filter(F.col("members") > BLOCK_ROWS).select("id").distinct(), "long-members")
    return short if long_.isEmpty() else short.unionByName(_rare_lists(long_, reps, sets, labels, percent))


def match_threshold(percent: int, k: int = K, missed: float = 2e-6) -> int:
    """The most coordinates that pairs at the limit share but for odds of ``missed``.

    28 of 48 for 85 per cent.
    """
    s, below, t = percent / 100, 0.0, 0
    while t < k:
        below += math.comb(k, t) * s**t * (1 - s) ** (k - t)
        if below > missed:
            break
        t += 1
    if not t:
        raise ValueError(f"{k} coordinates can't tell {percent} per cent")
    return t


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = K, t: int | None = None, width: int = WIDTH) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_key.

    Texts are lower-cased (A-Z); a text of fewer than ``width`` words is one
    shingle; null texts and texts without words have empty sets, are linked with
    nothing and stay. Links: 100 * intersection >= percent * union. Each row is linked by
    its own text, so an id with two texts can be in two components; ``component_id`` is
    the smallest id in the row's one. Kept is the component's first row by id, then by
    ``text_key`` (the text's MD5 digest); rows alike in both are kept together. Rows
    with a null id have no component and stay. Other columns are ignored; an empty table
    gives no rows. ``t`` follows from ``percent`` (``match_threshold``) where it is left out.
    """
    ship(docs.sparkSession)
    t = match_threshold(percent, k) if t is None else t
    sigs = written(signatures(docs, id_col, text_col, k, width), "signatures")
    usable = sigs.filter("id is not null and set_hash is not null")
    # rows of one set collapse before the shuffle; written, so that the numbers stay as they are
    one = usable.groupBy("set_hash").agg(F.min(F.struct("id", "text_key")).alias("_row"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = written(one.select("set_hash", F.col("_row.id").alias("row_id"), F.col("_row.text_key").alias("row_text"), "sig", "n", F.monotonically_increasing_id().alias("id")), "representatives")
    reps = nodes.select("id", "sig", "n")
    lists = written(prefix_postings(reps, k, t), "postings")
    wanted = nodes.join(lists.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("node"), F.col("row_id").alias("_id"), F.col("row_text").alias("_key"))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(F.col(text_col)).alias("_key"), F.col(text_col).alias("text"))
    sets = written(shingle_sets(texts.join(wanted, ["_id", "_key"]).dropDuplicates(["_id", "_key"]), "node", "text", width), "shingle-sets")
    alone = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    able = reps.join(wanted.select(F.col("node").alias("id")), "id", "left_semi").join(alone, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).filter(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))
    reps = written(able, "candidates")
    lists = written(lists.join(reps.select("id"), "id", "left_semi"), "candidate-lists")
    labels = _labels(lists, reps, sets, t, percent)

    # written, so that Spark can split the rows of a hot set or component in the joins
    named = written(nodes.select("set_hash", F.col("id")).join(labels.select("id", "component"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component")), "set-components")
    rows = written(usable.join(named, "set_hash").select("id", "text_key", "n_shingles", "component"), "row-components")
    first = written(rows.groupBy("component").agg(F.min(F.struct("id", "text_key")).alias("_first")), "component-heads")
    linked = rows.join(first, "component").select("id", "n_shingles", F.col("_first.id").alias("component_id"), (F.struct("id", "text_key") == F.col("_first")).alias("kept"), "text_key")
    apart = sigs.filter("id is null or set_hash is null").select("id", "n_shingles", F.col("id").alias("component_id"), F.lit(True).alias("kept"), "text_key")
    return linked.unionByName(apart).withColumnRenamed("id", id_col)


def _labels(lists: DataFrame, reps: DataFrame, sets: DataFrame, t: int, percent: int) -> DataFrame:
    """id, component of every candidate: star rounds over the lists, then blocks of what is left."""
    links, labels = None, reps.select("id", (F.col("u") / F.col("n")).alias("own"), F.col("id").alias("component"))
    for turn in range(STAR_ROUNDS + 1):
        labelled = lists.join(labels, "id")
        first_of = F.struct((F.xxhash64("id", F.lit(turn)) if turn else F.col("own")).alias("o"), F.col("id").alias("id"), F.col("component").alias("c"))
        # written, so that Spark can split the members of a long list in the join
        several = written(labelled.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min(first_of).alias("hub")).filter("c1 <> c2").select("key", F.col("hub.id").alias("hub"), F.col("hub.c").alias("hub_c")), "open-heads")
        mixed = written(labelled.join(several, "key").select("key", "id", "component", "hub", "hub_c"), "open-lists")
        if mixed.isEmpty():
            break
        if turn < STAR_ROUNDS:
            star = mixed.filter("component <> hub_c").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
            new = written(_confirmed(written(_matching(star, reps, t, percent), "matches"), sets, percent), "links")
        else:
            new = written(_blocks(written(final_lists(mixed, reps, sets, labels, percent), "final-lists"), reps, sets, t, percent), "links")
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            known = connected_components(links)
            labels = written(reps.select("id", (F.col("u") / F.col("n")).alias("own")).join(known, F.col("id") == F.col("node"), "left").select("id", "own", F.coalesce("component", "id").alias("component")), "labels")
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component (rows with a null id stay).

    The first row by id stays. Rows that repeat an id are told apart by their texts;
    of rows alike in both, all stay or go. An empty table gives no rows.
    """
    drop = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select(F.col(id_col).alias("__drop"), F.col("text_key").alias("__key")).distinct()
    return docs.join(drop, (F.col(id_col) == F.col("__drop")) & (text_key(F.col(text_col)) == F.col("__key")), "left_anti")
