"""Ensembles scored by matrix products: members are rows of a table.

A member has its parameters in one array, layer by layer (weights row by row, then
biases), and the widths of its layers; one without widths is linear. Members of like
widths are stacked, so a batch of feature vectors meets all of them in a few products.
A table of proven size is sent to every task; a larger one is dealt to blocks, and each
block of members meets each slot of features in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

MEMBERS = "model_id string, weight double, sizes array<int>, params array<double>, x_mean array<double>, x_std array<double>, y_mean double, y_std double"
#: Members of at most this size go to every task whole; features of a slot, about.
MEMBER_BYTES, SLOT_BYTES = 64 << 20, 64 << 20
#: Numbers that one product makes.
PRODUCT = 1 << 22


def member_table(spark: SparkSession, members: Iterable[tuple]) -> DataFrame:
    """Members (model_id, weight, sizes, params, x_mean, x_std, y_mean, y_std) as a table.

    ``sizes`` is null for a linear member. Inputs are standardised by ``x_mean`` and
    ``x_std``, outputs taken back by ``y_mean`` and ``y_std``, where these aren't null.
    """
    return spark.createDataFrame(list(members), MEMBERS)


class Stack:
    """Members of the same widths: their layers side by side."""

    def __init__(self, rows: list[dict]):
        self.names = [r["model_id"] for r in rows]
        sizes = rows[0]["sizes"] or [len(rows[0]["params"]), 1]
        if sizes[-1] != 1:
            raise ValueError("a member gives one output")
        self.width, self.layers, m = sizes[0], [], len(rows)
        theta = np.array([r["params"] for r in rows], dtype=float).reshape(m, -1)
        linear, at = not rows[0]["sizes"], 0
        if theta.shape[1] != (sizes[0] if linear else sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))):
            raise ValueError(f"{theta.shape[1]} parameters don't fit the widths {sizes}")
        for a, b in zip(sizes, sizes[1:]):
            w = theta[:, at : at + a * b].reshape(m, b, a).copy()
            bias = np.zeros((m, b)) if linear else theta[:, at + a * b : at + (a + 1) * b].copy()
            self.layers.append((w, bias))
            at += (a + 1) * b
        # the scales of inputs and outputs go into the first and the last layer
        for k, r in enumerate(rows):
            (w, bias), (out, shift) = self.layers[0], self.layers[-1]
            if r.get("x_std") is not None:
                w[k] /= np.array(r["x_std"], dtype=float)
            if r.get("x_mean") is not None:
                bias[k] -= w[k] @ np.array(r["x_mean"], dtype=float)
            scale = 1.0 if r.get("y_std") is None else float(r["y_std"])
            out[k] *= scale
            shift[k] = shift[k] * scale + (0.0 if r.get("y_mean") is None else float(r["y_mean"]))

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """A row for each row of ``x``, a column for each member."""
        if x.shape[1] != self.width:
            raise ValueError(f"vectors of {x.shape[1]} components, members of {self.width}")
        m = len(self.names)
        (w, bias), *more = self.layers
        h = w.shape[1]
        z = (x @ w.reshape(m * h, -1).T).reshape(len(x), m, h) + bias
        for w, bias in more:
            # for each member a product of all rows
            z = np.matmul(np.tanh(z).transpose(1, 0, 2), w.transpose(0, 2, 1)).transpose(1, 0, 2) + bias
        return z[:, :, 0]


def stacks(rows: list[dict]) -> list[Stack]:
    by: dict[tuple, list[dict]] = {}
    for r in rows:
        by.setdefault((tuple(r["sizes"] or ()), len(r["params"])), []).append(r)
    return [Stack(v) for v in by.values()]


def _partial(batch, members: list[Stack]):
    """label, model_id, energy: sums over the rows of an Arrow batch (label, vector)."""
    import pyarrow as pa

    coded = batch.column(0).dictionary_encode(null_encoding="encode")
    names, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = batch.column(1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) % len(at) or (np.diff(vectors.offsets.to_numpy()) != len(flat) // len(at)).any():
        raise ValueError("vectors differ in length")
    x = flat.reshape(len(at), -1)
    order = np.argsort(at, kind="stable")
    x, sorted_ = x[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    labels, ids, energies = [], [], []
    for s in members:
        sums = np.zeros((len(first), len(s.names)))
        step = max(1, PRODUCT // (len(s.names) * max(w.shape[1] for w, _ in s.layers)))
        owner = np.searchsorted(first, np.arange(len(x)), side="right") - 1
        for lo in range(0, len(x), step):
            part = s.outputs(x[lo : lo + step])
            mine = owner[lo : lo + step]
            edge = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            sums[mine[edge]] += np.add.reduceat(part, edge, axis=0)
        labels.append(np.repeat(sorted_[first], len(s.names)))
        ids += s.names * len(first)
        energies.append(sums.ravel())
    return pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(labels))), pa.array(ids, pa.string()), pa.array(np.concatenate(energies))], names=["label", "model_id", "energy"])


def score_networks(features: DataFrame, label: str, vector: str, members: DataFrame, member_bytes: int = MEMBER_BYTES, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """label, model_id, energy: every member's outputs, summed over the vectors of each label.

    ``members``: model_id, sizes and params, and where there are any x_mean, x_std,
    y_mean, y_std (``member_table``, ``models.load_models``). Rows without a vector are left
    out; a null label is a label. Vectors must have the members' input width. The features
    are read once.
    """
    ship(features.sparkSession)
    wanted = [c for c in ("model_id", "sizes", "params", "x_mean", "x_std", "y_mean", "y_std") if c in members.columns]
    rows = features.filter(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.transform(vector, lambda v: v.cast("double")).alias("vector"))
    kind = dict(rows.dtypes)["label"]
    schema = f"label {kind}, model_id string, energy double"
    size = members.agg(F.coalesce(F.sum(F.size("params") * 8 + 64), F.lit(0)).alias("b")).first().b
    if not size:
        part = rows.select("label", F.lit("").alias("model_id"), F.lit(0.0).alias("energy")).limit(0)
    elif size <= member_bytes:
        # at most ``member_bytes`` come to the driver and go to the tasks
        all_ = stacks([r.asDict() for r in members.select(*wanted).collect()])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield _partial(batch, all_)

        part = rows.mapInArrow(run, schema)
    else:
        n_blocks = math.ceil(2 * size / member_bytes)
        measured = rows.agg(F.coalesce(F.sum(8 * F.size("vector")), F.lit(0)).alias("b")).first().b
        n_slots = max(1, math.ceil(measured / slot_bytes))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = rows.withColumn("_slot", F.pmod(F.xxhash64("vector"), F.lit(n_slots)).cast("int")).withColumn("_block", every(n_blocks))
        held = members.select(*wanted).withColumn("_block", F.pmod(F.xxhash64("model_id"), F.lit(n_blocks)).cast("int")).withColumn("_slot", every(n_slots))

        def meet(left, right):
            import pyarrow as pa

            if not left.num_rows or not right.num_rows:
                empty = left.schema.field("label").type
                return pa.table({"label": pa.array([], empty), "model_id": pa.array([], pa.string()), "energy": pa.array([], pa.float64())})
            mine = stacks(right.select(wanted).to_pylist())
            return pa.Table.from_batches([_partial(b, mine) for b in left.select(["label", "vector"]).to_batches() if b.num_rows])

        part = dealt.groupBy("_block", "_slot").cogroup(held.groupBy("_block", "_slot")).applyInArrow(lambda left, right: meet(left, right), schema)
    return part.groupBy("label", "model_id").agg(F.sum("energy").alias("energy")).withColumnRenamed("label", label)
