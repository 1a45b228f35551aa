"""Errors, correlations and curves over tables of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept
from .datasets import running

TARGET, PRED, SIZE, GROUP = "target", "pred", "natoms", "formula"


def per_atom(predictions: DataFrame) -> DataFrame:
    """Adds t and p, target and prediction per atom."""
    return predictions.withColumns({"t": F.col(TARGET) / F.col(SIZE), "p": F.col(PRED) / F.col(SIZE)})


def regression_errors(predictions: DataFrame) -> DataFrame:
    e = (F.col(PRED) - F.col(TARGET)) / F.col(SIZE)
    return predictions.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_ae"))


def worst_structure(predictions: DataFrame, label: str) -> DataFrame:
    """The row of the largest total error (least label on ties), per atom."""
    ae = F.abs(F.col(PRED) - F.col(TARGET))
    best = predictions.agg(F.min(F.struct((-ae).alias("ae"), F.col(label).alias("label"), F.col(SIZE).alias("n"))).alias("w"))
    return best.select(F.col("w.label").alias("label"), (-F.col("w.ae") / F.col("w.n")).alias("max_error_per_atom"))


def r2_by_composition(predictions: DataFrame) -> DataFrame:
    """formula, r2: 1 - SSres / SStot; null where the target is constant."""
    rows = per_atom(predictions)
    means = kept(rows.groupBy(F.col(GROUP).alias("_g")).agg(F.avg("t").alias("_mean")), "means")
    joined = rows.join(means, F.col(GROUP).eqNullSafe(F.col("_g")))
    res, tot = F.sum((F.col("t") - F.col("p")) ** 2), F.sum((F.col("t") - F.col("_mean")) ** 2)
    return joined.groupBy(GROUP).agg((1 - res / F.nullif(tot, F.lit(0.0))).alias("r2"))


def tied_rank(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value`` within its group.

    Distinct values are counted first, then summed up over ranges of group and
    value, so a large group is spread over tasks.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    summed = running(counts, [F.col("_v")], "_upto", F.col("_c"), "_g")
    ranks = kept(summed.select("_g", "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(name)), "ranks")
    return rows.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def spearman_by_composition(predictions: DataFrame) -> DataFrame:
    """formula, spearman: the correlation of both tied ranks; null where one side is all tied.

    Both columns are ranked from one table of counts: a column is part of the group, so
    values are dealt to ranges, summed and written once.
    """
    rows = per_atom(predictions)
    sides = rows.select(F.col(GROUP).alias("_g"), F.explode(F.array(*(F.struct(F.lit(side).alias("s"), F.col(c).alias("v")) for side, c in enumerate("tp")))).alias("_x"))
    counts = sides.groupBy(F.struct(F.col("_x.s").alias("s"), F.col("_g").alias("g")).alias("_k"), F.col("_x.v").alias("_v")).agg(F.count("*").alias("_c"))
    summed = running(counts, [F.col("_v")], "_upto", F.col("_c"), "_k")
    ranks = kept(summed.select("_k.s", F.col("_k.g").alias("_g"), "_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias("_r")), "ranks")
    for side, c in enumerate("tp"):
        mine = ranks.filter(F.col("s") == side).select("_g", "_v", F.col("_r").alias(f"_r{c}"))
        rows = rows.join(mine, F.col(GROUP).eqNullSafe(F.col("_g")) & F.col(c).eqNullSafe(F.col("_v"))).drop("_g", "_v")
    # corr itself would divide by the zero spread of one row or of like values
    spread = F.stddev_pop("_rt") * F.stddev_pop("_rp")
    return rows.groupBy(GROUP).agg((F.covar_pop("_rt", "_rp") / F.nullif(spread, F.lit(0.0))).alias("spearman"))


def evaluation_summary(predictions: DataFrame, label: str) -> DataFrame:
    """One row: rows, formulas, RMSE, MAE, worst error, mean Spearman.

    All but the last come from one pass over the rows.
    """
    e = (F.col(PRED) - F.col(TARGET)) / F.col(SIZE)
    worst = F.min(F.struct((-F.abs(F.col(PRED) - F.col(TARGET))).alias("ae"), F.col(label).alias("label"), F.col(SIZE).alias("n")))
    # formulas are counted by group, so that no row is copied for the distinct count
    sums = {"se": F.sum(e * e), "ae": F.sum(F.abs(e)), "ne": F.count(e), "n": F.count("*"), "w": worst}
    parts = predictions.groupBy(GROUP).agg(*(v.alias(k) for k, v in sums.items()))
    one = parts.agg(
        F.sum("n").alias("n"),
        F.count(GROUP).alias("n_formulas"),
        F.sqrt(F.sum("se") / F.nullif(F.sum("ne"), F.lit(0))).alias("rmse"),
        (F.sum("ae") / F.nullif(F.sum("ne"), F.lit(0))).alias("mae"),
        F.min("w").alias("_w"),
    )
    one = one.select(F.coalesce("n", F.lit(0)).alias("n"), "n_formulas", "rmse", "mae", F.col("_w.label").alias("label"), (-F.col("_w.ae") / F.col("_w.n")).alias("max_error_per_atom"))
    return one.crossJoin(spearman_by_composition(predictions).agg(F.avg("spearman").alias("spearman")))


def r2_mean(predictions: DataFrame) -> DataFrame:
    """The unweighted mean over formulas of r2 (those without one left out)."""
    return r2_by_composition(predictions).agg(F.avg("r2").alias("r2"))


def spearman_mean(predictions: DataFrame) -> DataFrame:
    """The unweighted mean over formulas of the rank correlation."""
    return spearman_by_composition(predictions).agg(F.avg("spearman").alias("spearman"))


def relative_energies(predictions: DataFrame, always: bool = True) -> DataFrame:
    """Adds rel_target and rel_pred over each formula's least target per atom.

    With ``always`` off, energies stay as they are where there is one formula only.
    """
    rows = per_atom(predictions)
    if not always and rows.agg(F.min(GROUP).eqNullSafe(F.max(GROUP))).first()[0]:
        return rows.withColumns({"rel_target": F.col("t"), "rel_pred": F.col("p")})
    # written: few formulas then go to all tasks, and a hot one's rows need no shuffle
    least = kept(rows.groupBy(F.col(GROUP).alias("_g")).agg(F.min("t").alias("_m")), "least")
    return rows.join(least, F.col(GROUP).eqNullSafe(F.col("_g"))).withColumns({"rel_target": F.col("t") - F.col("_m"), "rel_pred": F.col("p") - F.col("_m")}).drop("_g", "_m")


def threshold_curve(relative: DataFrame, low: float, high: float, points: int) -> DataFrame:
    """cutoff, n, mae, rmse over rows with rel_target below each cutoff.

    Rows are summed by the first cutoff above them; running sums over the cutoffs
    give the curve, so rows aren't repeated for every cutoff.
    """
    step = (high - low) / (points - 1)
    e = F.col("rel_pred") - F.col("rel_target")
    first = F.greatest(F.floor((F.col("rel_target") - low) / step).cast("int") + 1, F.lit(0))
    # rounding at a border: the slot must be the first cutoff above the value
    cut = lambda k: low + k * step
    first = F.when((first > 0) & (F.col("rel_target") < cut(first - 1)), first - 1).when(F.col("rel_target") >= cut(first), first + 1).otherwise(first)
    sums = relative.withColumns({"_k": first, "_e": e}).filter(F.col("_k") < points).groupBy("_k").agg(F.count("*").alias("c"), F.sum(F.abs("_e")).alias("a"), F.sum(F.col("_e") * F.col("_e")).alias("s"))
    grid = relative.sparkSession.range(points).select(F.col("id").cast("int").alias("k"))
    run = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    got = grid.join(sums, F.col("k") == F.col("_k"), "left").select("k", *(F.sum(F.coalesce(c, F.lit(0))).over(run).alias(c) for c in "cas"))
    n = F.nullif(F.col("c"), F.lit(0))
    return got.select(cut(F.col("k")).alias("cutoff"), F.col("c").cast("long").alias("n"), (F.col("a") / n).alias("mae"), F.sqrt(F.col("s") / n).alias("rmse"))


def per_atom_scatter(predictions: DataFrame) -> DataFrame:
    return per_atom(predictions).select(GROUP, "t", "p")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, bin (from 0), n: counts in equal bins of [low, high]; others left out."""
    k = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return rows.filter(F.col(value).between(low, high)).groupBy(*by, k.alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(rows: DataFrame, x: str, y: str, xs: tuple[float, float], ys: tuple[float, float], bins: int) -> DataFrame:
    k = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))
    return rows.filter(F.col(x).between(*xs) & F.col(y).between(*ys)).groupBy(k(x, *xs).alias("bin_x"), k(y, *ys).alias("bin_y")).agg(F.count("*").alias("n"))


def loss_power(atoms: DataFrame, label: str, energy: str, targets: DataFrame, target: str, power: float) -> DataFrame:
    """Sum over structures of abs(summed atom energies - target) to a power."""
    summed = atoms.groupBy(label).agg(F.sum(energy).alias("_e"))
    return summed.join(targets, label).agg(F.sum(F.pow(F.abs(F.col("_e") - F.col(target)), F.lit(power))).alias("loss"))


def loss_stacked(atoms: DataFrame, label: str, energy: str, targets: DataFrame, target: str, power: float) -> DataFrame:
    """natoms, loss: as ``loss_power``, summed over the structures of each size."""
    summed = atoms.groupBy(label).agg(F.sum(energy).alias("_e"), F.count("*").alias("natoms"))
    return summed.join(targets, label).groupBy("natoms").agg(F.sum(F.pow(F.abs(F.col("_e") - F.col(target)), F.lit(power))).alias("loss"))


def atomic_rmse(predictions: DataFrame, mean: float, scale: float) -> DataFrame:
    """RMSE per atom after undoing the standardisation of both columns."""
    back = lambda c: F.col(c) / F.col(SIZE) * scale + mean
    e = back(PRED) - back(TARGET)
    return predictions.agg(F.sqrt(F.avg(e * e)).alias("rmse"))
