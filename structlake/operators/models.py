"""Fitting, scoring and combining models through Spark aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fitting import slot_sums
from .networks import score_networks

#: Up to so many columns sums of products are columns of one aggregation.
FEW_COLUMNS = 8


def _dot(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, weights))), lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)


def score_linear(features: DataFrame, label: str, vector: str, weights: list[float]) -> DataFrame:
    """label, energy: weights . fvec summed over atoms."""
    return features.groupBy(label).agg(F.sum(_dot(F.col(vector), weights)).alias("energy"))


def mlp_energy(vector: Column, layers: list[tuple[list[list[float]], list[float], str]]) -> Column:
    """Dense layers (rows of weights, bias, ``tanh`` or ``linear``); one output."""
    x = F.transform(vector, lambda v: v.cast("double"))
    for weights, bias, act in layers:
        outs = []
        for row, b in zip(weights, bias, strict=True):
            z = _dot(x, row) + float(b)
            outs.append(F.tanh(z) if act == "tanh" else z)
        x = F.array(*outs)
    return x[0]


def score_mlp(features: DataFrame, label: str, vector: str, layers, x_mean: list[float] | None = None, x_std: list[float] | None = None, y_mean: float = 0.0, y_std: float = 1.0) -> DataFrame:
    """label, energy: the network's outputs summed over atoms.

    With ``x_mean`` and ``x_std`` inputs are standardised first; outputs are taken back
    by ``y_mean`` and ``y_std``, atom by atom.
    """
    x = F.col(vector)
    if x_mean is not None:
        column = lambda values: F.array(*(F.lit(float(v)) for v in values))
        x = F.zip_with(F.zip_with(x, column(x_mean), lambda a, m: a.cast("double") - m), column(x_std), lambda a, s: a / s)
    return features.groupBy(label).agg(F.sum(mlp_energy(x, layers) * float(y_std) + float(y_mean)).alias("energy"))


def evaluate_model(scores: DataFrame, records: DataFrame, label: str, energy: str, natoms: str, formula: str) -> DataFrame:
    """label, formula, natoms, target, pred: a table of predictions.

    ``scores`` (label, energy) come from any scorer; records without a score are left out.
    """
    named = scores.select(F.col(label).alias("_l"), F.col("energy").alias("pred"))
    return records.join(named, F.col(label) == F.col("_l")).select(F.col(label).alias("label"), F.col(formula).alias("formula"), F.col(natoms).cast("double").alias("natoms"), F.col(energy).cast("double").alias("target"), "pred")


def join_predictions_structures(predictions: DataFrame, structures: DataFrame, label: str = "label") -> DataFrame:
    """Predictions beside their structures' columns (volumes, enthalpies), by label."""
    return predictions.join(structures, label)


def score_members(features: DataFrame, label: str, vector: str, members: dict[str, list[float]] | DataFrame) -> DataFrame:
    """label, model_id, energy for every member, in one pass over the features.

    ``members`` is a dict of linear weights, summed by one aggregation (for a handful),
    or a table of linear members and networks (``networks.score_networks``).
    """
    if isinstance(members, DataFrame):
        return score_networks(features, label, vector, members)
    sums = features.groupBy(label).agg(*(F.sum(_dot(F.col(vector), w)).alias(m) for m, w in members.items()))
    pairs = F.array(*(F.struct(F.lit(m).alias("model_id"), F.col(m).alias("energy")) for m in members))
    return sums.select(label, F.explode(pairs).alias("_m")).select(label, "_m.model_id", "_m.energy")


def score_ensemble(scores: DataFrame, weights: dict[str, float] | DataFrame, label: str) -> DataFrame:
    """label, energy: weighted sum over members (weights as given; members without one count nought).

    ``weights`` is a dict, or a table with model_id and weight.
    """
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("model_id").alias("_m"), F.col("weight").alias("_w"))
        weighted = scores.join(named, F.col("model_id") == F.col("_m"), "left")
        return weighted.groupBy(label).agg(F.sum(F.col("energy") * F.coalesce("_w", F.lit(0.0))).alias("energy"))
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return scores.groupBy(label).agg(F.sum(F.col("energy") * F.coalesce(F.try_element_at(w, F.col("model_id")), F.lit(0.0))).alias("energy"))


def ensemble_std(scores: DataFrame, sizes: DataFrame, weights: dict[str, float], label: str, min_weight: float = 0.05) -> DataFrame:
    """Sample std over members above ``min_weight`` of the energy per atom."""
    names = [m for m, w in weights.items() if w > min_weight]
    return scores.filter(F.col("model_id").isin(names)).join(sizes, label).groupBy(label).agg(F.stddev_samp(F.col("energy") / F.col("natoms")).alias("std"))


def energy_std(scores: DataFrame, sizes: DataFrame, label: str) -> DataFrame:
    """Sample std over all members of the total energy, and per atom."""
    got = scores.groupBy(label).agg(F.stddev_samp("energy").alias("std"))
    return got.join(sizes, label).select(label, "std", (F.col("std") / F.col("natoms")).alias("std_per_atom"))


def filter_uncertainty_band(rows: DataFrame, std_per_atom: str, low: float, high: float) -> DataFrame:
    """A bound of 0 or less is off."""
    keep = F.lit(True)
    if low > 0:
        keep = keep & (F.col(std_per_atom) >= low)
    if high > 0:
        keep = keep & (F.col(std_per_atom) <= high)
    return rows.filter(keep)


def normal_sums(rows: DataFrame, columns: list[str], target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy of a table; only k x k numbers come back. Rows with a null count nought.

    A few columns take one aggregation; many take one matrix product for each batch.
    """
    w = F.lit(1.0) if weight is None else weight
    if len(columns) > FEW_COLUMNS:
        return gram_sums(rows.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), F.col(target).cast("double").alias("y"), w.cast("double").alias("w")), len(columns))
    rows = rows.dropna(subset=[*columns, target])
    names = [*columns, target]
    sums = [F.sum(w * F.col(a) * F.col(b)).alias(f"s{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(names) if j >= i]
    got = rows.agg(*sums).first()
    k = len(columns)
    xtx, xty = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = got[f"s{i}_{j}"] or 0.0
        xty[i] = got[f"s{i}_{k}"] or 0.0
    return xtx, xty


def gram_sums(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy of rows (x, y, w) with arrays of k numbers; rows with a null are left out."""

    def add(total, batch):
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
        y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        both = np.hstack([x, y[:, None]])
        whole = np.isfinite(both).all(axis=1) & np.isfinite(w)
        total += (both[whole] * w[whole, None]).T @ both[whole]

    sums = slot_sums(rows.select("x", "y", "w").filter(F.col("x").isNotNull()), lambda: np.zeros((k + 1, k + 1)), add)
    return sums[:k, :k], sums[:k, k]


def fit_linear(rows: DataFrame, columns: list[str], target: str, weight: Column | None = None) -> list[float]:
    """Weighted least squares by normal equations (least norm where singular)."""
    return np.linalg.lstsq(*normal_sums(rows, columns, target, weight), rcond=None)[0].tolist()


def nnls(xtx: np.ndarray, xty: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Non-negative least squares from normal equations, by an active set."""
    n = len(xty)
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    scale = max(1.0, float(np.abs(xty).max(initial=0)))
    for _ in range(30 * n + 10):
        gradient = xty - xtx @ x
        free = ~active & (gradient > tolerance * scale)
        if not free.any():
            break
        active[np.argmax(np.where(free, gradient, -np.inf))] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(xtx[np.ix_(active, active)], xty[active], rcond=None)[0]
            if (s[active] > 0).all():
                x = s
                break
            bad = active & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            active &= x > tolerance
            x[~active] = 0
    return x


def filter_ensemble_observations(scores: DataFrame, targets: DataFrame, label: str, limit: float = 0.5, fewest: int = 100) -> DataFrame:
    """Labels where every member is within ``limit`` per atom; all if too few."""
    err = F.abs(F.col("energy") / F.col("natoms") - F.col("target") / F.col("natoms"))
    good = scores.join(targets, label).groupBy(label).agg(F.max(err).alias("_e")).filter(F.col("_e") < limit).select(label)
    return good if good.limit(fewest).count() >= fewest else targets.select(label)


def nnls_ensemble_weights(scores: DataFrame, targets: DataFrame, label: str, members: list[str], drop: float = 1e-13) -> dict[str, float]:
    """Non-negative weights of the members over total energies.

    Labels that lack a member's score or a target are left out. A label's scores are
    one array, so a member adds a name to the plan, and no column.
    """
    place = F.create_map(*(F.lit(x) for k, m in enumerate(members) for x in (m, k))) if members else F.create_map()
    known = scores.filter(F.col("model_id").isin(members)).groupBy(F.col(label).alias("_l"), "model_id").agg(F.max("energy").alias("energy"))
    wide = known.groupBy("_l").agg(F.array_sort(F.collect_list(F.struct(F.element_at(place, F.col("model_id")).alias("k"), F.col("energy").cast("double").alias("e")))).alias("_all")).filter(F.size("_all") == len(members))
    rows = wide.join(targets, F.col("_l") == F.col(label)).select(F.transform("_all", lambda s: s["e"]).alias("x"), F.col("target").cast("double").alias("y"), F.lit(1.0).alias("w"))
    x = nnls(*gram_sums(rows, len(members)))
    return {m: float(w) for m, w in zip(members, x, strict=True) if w > drop}


def committee_force_error(forces: DataFrame, label: str) -> DataFrame:
    """label, error: greatest distance of a member's force from the mean force.

    forces: label, atom, model_id, fx, fy, fz.
    """
    mean = forces.groupBy(F.col(label).alias("_l"), F.col("atom").alias("_a")).agg(*(F.avg(c).alias(f"_{c}") for c in ("fx", "fy", "fz")))
    joined = forces.join(mean, (F.col(label) == F.col("_l")) & (F.col("atom") == F.col("_a")))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in ("fx", "fy", "fz")), F.lit(0.0))
    return joined.groupBy(label).agg(F.max(F.sqrt(d2)).alias("error"))


def walk_forward_join(data: DataFrame, models: DataFrame, gen: str = "gen") -> DataFrame:
    """Each generation's data with the model of the generation before."""
    return data.join(models.select((F.col(gen) + 1).alias(gen), *(c for c in models.columns if c != gen)), gen)


def in_out_sample(data: DataFrame, models: DataFrame, test: int, start: int = 0, gen: str = "gen") -> DataFrame:
    """Rows of four result sets, named by ``sample``, each beside its model.

    ``in_sample``: generations ``start`` to ``test`` with the model of ``test``;
    ``out_of_sample``: the next generation with that model; ``next_in_sample``: the
    next generation with its own model; ``next_structures``: the next generation
    without one. ``models`` has a row per generation, so two rows are broadcast.
    """
    named = lambda sample, by: F.struct(F.lit(sample).alias("sample"), F.lit(by).cast("long").alias("model_gen"))
    after = F.array(named("out_of_sample", test), named("next_in_sample", test + 1), named("next_structures", None))
    sets = F.when(F.col(gen) == test + 1, after).when(F.col(gen).between(start, test), F.array(named("in_sample", test)))
    spread = data.withColumn("_s", F.explode(sets)).select(*data.columns, "_s.sample", "_s.model_gen")
    by = models.filter(F.col(gen).isin(test, test + 1)).withColumn("_g", F.col(gen).cast("long")).drop(gen)
    return spread.join(F.broadcast(by), F.col("model_gen") == F.col("_g"), "left").drop("_g")


def save_models(models: DataFrame, path: str) -> None:
    """models: model_id, weight, params (array), sizes (array of layer widths, null for linear)."""
    models.select("model_id", "weight", "params", "sizes").write.parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Saved members with ``position`` by the number in their id, and ``kind``.

    A member with layer widths is an ``mlp``, one without ``linear``. The table
    has a row per member.
    """
    got = spark.read.parquet(path)
    number = F.regexp_extract("model_id", r"(\d+)", 1).try_cast("long")
    kind = F.when(F.size("sizes") > 0, "mlp").otherwise("linear")
    return got.withColumn("position", F.row_number().over(Window.orderBy(number.asc_nulls_last(), "model_id"))).withColumn("kind", kind)
