"""Record tables: derived columns, group thresholds, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chem
from ..sources.paths import kept
from .datasets import numbered


def enrich_records(records: DataFrame, composition: str = "composition", enthalpy: str = "enthalpy", volume: str = "volume", natoms: str = "natoms") -> DataFrame:
    """Adds formula, reduced_formula, nform and values per atom and per formula unit."""
    n = chem.formula_units(F.col(composition))
    return records.withColumns(
        {
            "nform": n,
            "formula": chem.formula_string(F.col(composition)),
            "reduced_formula": chem.formula_string(chem.reduce_composition(F.col(composition))),
            "enthalpy_per_atom": F.col(enthalpy) / F.col(natoms),
            "volume_per_atom": F.col(volume) / F.col(natoms),
            "enthalpy_per_form": F.col(enthalpy) / n,
            "volume_per_form": F.col(volume) / n,
        }
    )


def filter_group_threshold(records: DataFrame, group: str, value: str, threshold: float, select: Callable[[Column], Column] = F.min) -> DataFrame:
    """Rows with value below select(values of the group) + threshold.

    The group's value comes from an aggregation that combines before the shuffle,
    so a hot group isn't gathered; groups are joined back null-safely, written first so
    that few of them go to all tasks.
    """
    least = kept(records.groupBy(F.col(group).alias("_g")).agg(select(F.col(value)).alias("_base")), "least")
    return records.join(least, F.col(group).eqNullSafe(F.col("_g"))).filter(F.col(value) < F.col("_base") + threshold).drop("_g", "_base")


def pressure_corrected_enthalpy(records: DataFrame, enthalpy: str, volume: str, natoms: str, pressure_gpa: float) -> DataFrame:
    """Adds per-atom ``corrected`` = (H + V P) / n and leaves H as it is."""
    return records.withColumn("corrected", (F.col(enthalpy) + F.col(volume) * (pressure_gpa / chem.GPA_PER_EV_ANG3)) / F.col(natoms))


def select_by_label(records: DataFrame, wanted: DataFrame, label: str, position: str, order: str) -> DataFrame:
    """For each wanted (label, position) the first record in ``order``; absent ones left out.

    Labels may repeat, among records and among what is wanted. Of records that are equal
    in label and order one is taken, the least of the columns that have an order. A null
    label is never found.
    """
    kinds = [f for f in records.schema.fields if f.name not in (label, order) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # few labels are wanted: only their records are compared, and a hot label's combine before the shuffle
    # (written, so that they go to all tasks and a hot label's records aren't shuffled into one)
    labels = kept(wanted.select(F.col(label).alias("_l")).distinct(), "labels")
    of = records.join(labels, F.col(label) == F.col("_l"), "left_semi")
    least = of.groupBy(F.col(label).alias("_l")).agg(F.min_by(F.struct(*records.columns), F.struct(order, *(f.name for f in kinds))).alias("_r"))
    return wanted.withColumnRenamed(label, "_w").join(least, F.col("_w") == F.col("_l")).select("_r.*", *(c for c in wanted.columns if c != label))


def missing_labels(records: DataFrame, wanted: DataFrame, label: str) -> DataFrame:
    return wanted.join(records.select(label).distinct(), label, "left_anti")


def subtract_elemental_energy(records: DataFrame, composition: str, enthalpy: str, reference: dict[str, float]) -> DataFrame:
    return records.withColumn(enthalpy, F.col(enthalpy) - chem.elemental_sum(F.col(composition), reference))


def boltzmann_weights(records: DataFrame, energy: str, natoms: str, kt: float) -> DataFrame:
    """Adds ``weight`` = exp(-(E/n - least) / kt); 1 where kt is not above 0."""
    if kt <= 0:
        return records.withColumn("weight", F.lit(1.0))
    least = records.agg(F.min(F.col(energy) / F.col(natoms)).alias("_least"))
    return records.crossJoin(F.broadcast(least)).withColumn("weight", F.exp(-(F.col(energy) / F.col(natoms) - F.col("_least")) / kt)).drop("_least")


def has_multiple_compositions(records: DataFrame, formula: str) -> DataFrame:
    # least and greatest differ: no distinct set is gathered
    return records.agg((F.min(formula) != F.max(formula)).alias("multiple"))


def min_energy_records(records: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each group's record of least value, the first in ``order`` on ties."""
    others = [c for c in records.columns if c not in (group, value, order)]
    best = records.groupBy(group).agg(F.min(F.struct(F.col(value), F.col(order), *others)).alias("_b"))
    return best.select(group, *(F.col(f"_b.{c}").alias(c) for c in [value, order, *others]))


def sort_by_enthalpy(records: DataFrame, enthalpy: str, natoms: str) -> DataFrame:
    """Rows by enthalpy per atom, least first."""
    return records.orderBy(F.col(enthalpy) / F.col(natoms))


def group_by_composition(records: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """group, position, label: each group's rows in order, a row for each record.

    The list of a group stays spread over rows, so a hot group needs no large row.
    """
    ranked = numbered(records.select(F.col(group).alias("_g"), F.col(label).alias("_l"), F.col(order).alias("_r")), [F.col("_r"), F.col("_l")], by="_g")
    return ranked.select(F.col("_g").alias(group), F.col("_n").alias("position"), F.col("_l").alias(label))


def lookup_min_record(records: DataFrame, least: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """``records`` with columns of the least record of their group (null where none).

    ``least`` has a row per group (``min_energy_records``); ``columns`` names its
    columns and what they are called in the result.
    """
    picked = kept(least.select(F.col(group).alias("_g"), *(F.col(a).alias(b) for a, b in columns.items())), "least")
    return records.join(picked, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def container_summary(records: DataFrame, size: str, enthalpy: str) -> DataFrame:
    per = F.col(enthalpy) / F.col(size)
    return records.agg(F.count("*").alias("n"), F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.max(per).alias("max_per_atom"), F.min(per).alias("min_per_atom"))


def generation_counts(records: DataFrame, gen: str, done: Column) -> DataFrame:
    """Structures and finished structures per generation."""
    return records.groupBy(gen).agg(F.count("*").alias("n_structures"), F.count_if(done).alias("n_done"))


def completion_ready(counts: DataFrame, expected: Column, threshold: float = 0.98) -> DataFrame:
    return counts.withColumn("ready", F.col("n_done") / expected > threshold)


def latest_generation(models: DataFrame, gen: str) -> DataFrame:
    return models.agg(F.max(gen).alias("latest"), F.coalesce(F.max(gen) + 1, F.lit(0)).alias("next"))


def early_stop_point(history: DataFrame, step: str, metric: str, patience: int) -> DataFrame:
    """best step (first of the least metric), last step, and whether to stop."""
    got = history.agg(F.min(F.struct(metric, step)).alias("_b"), F.max(step).alias("last"))
    return got.select(F.col(f"_b.{step}").alias("best"), "last", (F.col("last") - F.col(f"_b.{step}") > patience).alias("stop"))
