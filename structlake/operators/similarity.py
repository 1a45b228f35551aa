"""Vectors that no other vector is near, by clusters and matrix products.

Vectors go to the nearest of some centres. In the order of centre and distance to it they
are cut into bundles, of which there are few, so that each vector is sent to few tasks. Two
bundles can hold a pair nearer than the tolerance only if the triangle inequality over
centres allows it; others never meet. A task cuts its two bundles into blocks by centre and
distance, leaves out pairs of blocks by the same rule and vectors that are done, and
compares the others: one product of two matrices, and the exact distance for pairs close to
the tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.paths import kept

#: Rows of a block; centres are a row for each of as many reference blocks, and no more than MOST_CENTRES.
BLOCK_ROWS, MOST_CENTRES = 4096, 256
#: Rows of a block that are compared at once.
STRIP = 512
#: Bundles of a table, and the least and most rows of one: a vector is sent to about as many tasks as there are bundles.
BUNDLES, LEAST_ROWS, BUNDLE_ROWS = 16, 512, 65536


def _placed(rows: DataFrame, key: str, vector: str, centres: list[np.ndarray]) -> DataFrame:
    """_k, _v, _c, _d: the nearest centre of the same length and its distance.

    Vectors of a length that no centre has share a centre of their own (below nought), at distance nought.
    """
    by_length = {}
    for k, c in enumerate(centres):
        by_length.setdefault(len(c), []).append(k)
    stacked = {n: np.stack([centres[k] for k in ks]) for n, ks in by_length.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            vectors = batch.column(1)
            off, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            lengths = np.diff(off)
            c, d = -1 - lengths.astype(np.int64), np.zeros(len(lengths))
            for n, here in stacked.items():
                rows = np.flatnonzero(lengths == n)
                if len(rows):
                    x = flat[off[rows][:, None] + np.arange(n)].astype(float)
                    far = (x * x).sum(axis=1)[:, None] + (here * here).sum(axis=1) - 2 * x @ here.T
                    best = np.argmin(np.nan_to_num(far, nan=np.inf), axis=1)
                    c[rows] = np.array(by_length[n])[best]
                    d[rows] = np.sqrt(((x - here[best]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array(c), pa.array(d)], names=["_k", "_v", "_c", "_d"])

    # floats travel as they are, all else as doubles
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    picked = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.transform(vector, lambda x: x.cast(kind)).alias("_v"))
    return picked.mapInArrow(run, f"_k {dict(picked.dtypes)['_k']}, _v array<{kind}>, _c long, _d double")


def _bundles(placed: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(_k, _v, _c, _d, _b; _b, _c, _low, _high): rows dealt to bundles in order of centre and ring."""
    # a vector with a null or nan component is at no distance from any other
    whole = kept(placed.filter(~F.isnan("_d")), "placed")
    spread = whole.groupBy("_c").agg(F.min("_d").alias("_least"), F.max("_d").alias("_most"), F.ceil(F.count("*") / block_rows).alias("_rings"))
    ring = F.when(F.col("_most") > F.col("_least"), F.least(F.floor((F.col("_d") - F.col("_least")) / (F.col("_most") - F.col("_least")) * F.col("_rings")), F.col("_rings") - 1)).otherwise(0)
    ringed = whole.join(F.broadcast(kept(spread, "centres")), "_c").withColumn("_ring", ring.cast("long"))
    # a row for each ring: where it begins in the order of all
    rings = kept(ringed.groupBy("_c", "_ring").agg(F.count("*").alias("_n")), "rings")
    start = rings.withColumn("_start", F.sum("_n").over(Window.orderBy("_c", "_ring")) - F.col("_n"))
    total = rings.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    size = min(BUNDLE_ROWS, max(LEAST_ROWS, math.ceil(total / BUNDLES)))
    # within a ring rows go by hash, so that copies are dealt too
    share = F.pmod(F.xxhash64("_k", F.lit("part")), F.lit(1 << 30)) / float(1 << 30)
    dealt = ringed.join(F.broadcast(kept(start, "ring-starts")), ["_c", "_ring"]).withColumn("_b", F.floor((F.col("_start") + share * F.col("_n")) / size))
    heads = kept(dealt.groupBy("_b", "_c").agg(F.min("_d").alias("_low"), F.max("_d").alias("_high")), "bundle-heads")
    return dealt.select("_k", "_v", "_c", "_d", "_b"), heads


def _cut(t, block_rows: int) -> list[tuple]:
    """(centre, least distance to it, greatest, rows, vectors, their squares) of the blocks of a bundle."""
    c, d = t.column("_c").to_numpy(), t.column("_d").to_numpy()
    column = t.column("_v").combine_chunks()
    off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    order, out = np.lexsort((d, c)), []
    edges = [0, *(np.flatnonzero(np.diff(c[order])) + 1).tolist(), len(order)]
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        for lo in range(first, last, block_rows):
            rows = order[lo : min(lo + block_rows, last)]
            # vectors of a centre have one length
            x = flat[off[rows][:, None] + np.arange(off[rows[0] + 1] - off[rows[0]])].astype(float)
            out.append((int(c[rows[0]]), d[rows[0]], d[rows[-1]], rows, x, (x * x).sum(axis=1)))
    return out


def _met(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray, ka: np.ndarray, kb: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``a``, rows of ``b``) that have one of another key nearer than ``tol`` on the other side."""
    sums = a2[:, None] + b2
    d2 = sums - 2 * a @ b.T
    d2[ka[:, None] == kb] = np.inf
    # products round off: pairs close to the tolerance are measured again
    slack = 1e-9 * (sums + tol * tol)
    hit = d2 < tol * tol - slack
    i, j = np.nonzero((d2 <= tol * tol + slack) & ~hit)
    hit[i, j] = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1)) < tol
    return hit.any(axis=1), hit.any(axis=0)


def _near(left, right, apart: dict, tol: float, block_rows: int, both: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(left rows, right rows if ``both`` that have one of another key nearer than ``tol``, pairs compared)."""
    codes: dict = {}
    number = lambda t: np.array([codes.setdefault(k, len(codes)) for k in t.column("_k").to_pylist()], dtype=np.int64)
    ka, kb = number(left), number(right)
    hit_a, hit_b, compared = np.zeros(len(ka), dtype=bool), np.full(len(kb), not both), 0
    theirs = _cut(right, block_rows)
    for c, low, high, rows, x, x2 in _cut(left, block_rows):
        for c2, low2, high2, rows2, y, y2 in theirs:
            between = apart.get((c, c2), 0.0 if c == c2 else None)
            if between is None or max(between - high - high2, low2 - between - high, low - between - high2) >= tol * (1 + 1e-9) + 1e-9 * between:
                continue
            for lo in range(0, len(rows), STRIP):
                for done in (False, True):
                    # those without a near one meet all, the others those without a near one
                    i = lo + np.flatnonzero(hit_a[rows[lo : lo + STRIP]] == done)
                    j = np.flatnonzero(~hit_b[rows2]) if done else slice(None)
                    if not len(i) or not len(rows2[j]):
                        continue
                    compared += len(i) * len(rows2[j])
                    one, two = _met(x[i], y[j], x2[i], y2[j], ka[rows[i]], kb[rows2[j]], tol)
                    hit_a[rows[i[one]]] = True
                    hit_b[rows2[j][two]] = True
    return np.flatnonzero(hit_a), np.flatnonzero(hit_b) if both else np.zeros(0, dtype=np.int64), compared


def novel_vectors(vectors: DataFrame, reference: DataFrame, key: str, vector: str, tol: float, block_rows: int = BLOCK_ROWS, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """Vectors with no reference vector nearer than ``tol`` (Euclidean), themselves left out.

    Both tables have ``key``; a reference with the same key as a vector is that vector.
    Vectors of unlike lengths, null vectors and vectors with null components are near
    nothing. The result is exact for any data; the more the vectors lie in clusters, the
    fewer pairs are compared. Vectors that share a key stay or go together. ``report`` is
    called with the pairs compared and all pairs.
    """
    ship(vectors.sparkSession)
    n = reference.count()
    # a row for each block, at most MOST_CENTRES, comes to the driver
    found = reference.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).select(F.transform(vector, lambda x: x.cast("double"))).limit(min(MOST_CENTRES, math.ceil(n / block_rows))).collect()
    centres = [np.array(r[0], dtype=float) for r in found]
    centres = [c for c in centres if len(c) and np.isfinite(c).all()]
    same = reference is vectors
    left, left_heads = _bundles(_placed(vectors, key, vector, centres), block_rows)
    right, right_heads = (left, left_heads) if same else _bundles(_placed(reference, key, vector, centres), block_rows)

    apart = {(i, j): float(np.sqrt(((a - b) ** 2).sum())) for i, a in enumerate(centres) for j, b in enumerate(centres) if len(a) == len(b)}
    known = vectors.sparkSession.createDataFrame([(*c, d) for c, d in apart.items()], "_c long, _c2 long, _apart double")
    others = left_heads.filter("_c < 0").select("_c", F.col("_c").alias("_c2"), F.lit(0.0).alias("_apart")).distinct()
    theirs = right_heads.select(*(F.col(c).alias(f"{c}2") for c in ("_b", "_c", "_low", "_high")))
    far: Column = F.greatest(F.col("_apart") - F.col("_high") - F.col("_high2"), F.col("_low2") - F.col("_apart") - F.col("_high"), F.col("_low") - F.col("_apart") - F.col("_high2"))
    # rounding of distances to centres mustn't lose a pair
    met = left_heads.join(known.unionByName(others), "_c").join(theirs, "_c2").filter(far < tol * (1 + 1e-9) + 1e-9 * F.col("_apart"))
    # a table against itself: two bundles meet once, for both
    met = met.filter("_b <= _b2") if same else met
    pairs = kept(met.select("_b", "_b2").distinct().withColumn("_pair", F.monotonically_increasing_id()), "bundle-pairs")
    tasks = max(1, pairs.count())
    one = left.join(F.broadcast(pairs.select("_b", "_pair")), "_b").select("_pair", "_k", "_v", "_c", "_d").repartition(tasks, "_pair")
    two = right.join(F.broadcast(pairs.select(F.col("_b2").alias("_b"), F.col("_pair").alias("_pair2"))), "_b").select("_pair2", *(F.col(c).alias(f"{c}2") for c in ("_k", "_v", "_c", "_d"))).repartition(tasks, "_pair2")

    def run(a, b):
        import pyarrow as pa

        b = b.rename_columns(a.column_names)
        hits, others, compared = _near(a, b, apart, tol, block_rows, same) if a.num_rows and b.num_rows else ((), (), 0)
        take = lambda t, rows: t.column("_k").take(pa.array(rows, pa.int64())).combine_chunks()
        keys = pa.concat_arrays([take(a, hits), take(b, others)])
        # the count goes in a row of its own
        keys = pa.concat_arrays([keys, pa.nulls(1, keys.type)])
        return pa.table({"_k": keys, "_n": pa.array([0] * (len(keys) - 1) + [compared])})

    near = kept(one.groupBy("_pair").cogroup(two.groupBy("_pair2")).applyInArrow(lambda a, b: run(a, b), f"_k {dict(one.dtypes)['_k']}, _n long"), "near")
    if report is not None:
        report(int(near.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]), vectors.count() * n)
    gone = near.filter("_k is not null").select("_k").distinct()
    return vectors.join(gone, F.col(key) == F.col("_k"), "left_anti")
