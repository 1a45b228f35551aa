"""Structures made from others or from a rule: shaken copies, dimers to squares, bonded units."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem
from ..sources.paths import kept
from . import features, models, neighbours

CELL = ("a", "b", "c", "alpha", "beta", "gamma")


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) made from the parts, the same in every engine with MD5."""
    text = F.concat_ws(":", *((F.lit(p) if isinstance(p, str) else p.cast("string")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def shaken_cells(structures: DataFrame, n: int, cell_amp: float, label: str = "label", attempts: int = 20) -> DataFrame:
    """n rows per structure: ``copy``, ``shaken`` label and cell parameters.

    Each parameter grows by a factor of 1 + U[0, 1) * amp. A cell without volume
    is drawn again, up to ``attempts`` times; then the cell stays as it was.
    """
    copies = structures.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def draw(k: Column) -> Column:
        new = [F.col(c) * (1 + uniform(F.col(label), F.col("copy"), k, c) * cell_amp) for c in CELL]
        volume = chem.cell_volume(*new)
        return F.when(~F.isnan(volume) & (volume > 0), F.struct(*(v.alias(c) for v, c in zip(new, CELL, strict=True))))

    same = F.struct(*(F.col(c).cast("double").alias(c) for c in CELL))
    none = F.lit(None).cast(f"struct<{', '.join(f'{c}:double' for c in CELL)}>")
    first = F.aggregate(F.sequence(F.lit(0), F.lit(attempts - 1)), none, lambda found, k: F.when(found.isNotNull(), found).otherwise(draw(k)))
    drawn = copies.withColumn("_cell", F.coalesce(first, same))
    others = [c for c in structures.columns if c not in CELL]
    return drawn.select(*others, "copy", F.concat(F.col(label), F.lit("-shake-"), F.col("copy")).alias("shaken"), *(F.col(f"_cell.{c}").alias(c) for c in CELL))


def augment_shake(structures: DataFrame, atoms: DataFrame, n: int, amp: float, cell_amp: float, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(structures, atoms) of n perturbed copies; labels end in ``-shake-i``.

    Atoms move by up to ``amp`` along each Cartesian axis in the old cell; their
    fractions are kept in the new one. Lattices are lower triangular, so the move
    is turned into fractions by forward substitution from the last axis.
    """
    base = structures.select(F.col(label).alias("_l"), chem.cell_to_lattice(*(F.col(c) for c in CELL)).alias("_m"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"))
    spread = atoms.join(base, F.col(label) == F.col("_l"))
    mx, my, mz = (amp * (2 * uniform(F.col(label), F.col("copy"), F.col("atom"), c) - 1) for c in "xyz")
    m = F.col("_m")
    dz = mz / m[2][2]
    dy = (my - dz * m[2][1]) / m[1][1]
    dx = (mx - dy * m[1][0] - dz * m[2][0]) / m[0][0]
    moved = spread.withColumns({"fx": chem.wrap_frac(F.col("fx") + dx), "fy": chem.wrap_frac(F.col("fy") + dy), "fz": chem.wrap_frac(F.col("fz") + dz)})
    out = moved.withColumn(label, F.concat(F.col(label), F.lit("-shake-"), F.col("copy"))).drop("_l", "_m", "copy")
    cells = shaken_cells(structures, n, cell_amp, label)
    return cells.withColumn(label, F.col("shaken")).drop("shaken", "copy"), out


def generate_model_structures(spark: SparkSession, elements: list[str], order: int, low: float, high: float, points: int = 30) -> DataFrame:
    """label, atom, species, x, y, z: dimers, triangles or squares of edge r.

    All combinations with repeats of ``order`` (2, 3 or 4) elements, at
    ``points`` distances; the label is ``A-B-r`` with three digits.
    """
    h = math.sqrt(3) / 2
    shape = {2: [(0, 0), (1, 0)], 3: [(0, 0), (1, 0), (0.5, h)], 4: [(0, 0), (1, 0), (1, 1), (0, 1)]}[order]
    combos = [list(c) for c in itertools.combinations_with_replacement(sorted(set(elements)), order)]
    kinds = spark.createDataFrame([(c,) for c in combos], "kinds array<string>")
    step = (high - low) / max(points - 1, 1)
    grid = kinds.crossJoin(spark.range(points).select((F.lit(low) + F.col("id") * step).alias("r")))
    where = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in shape))
    label = F.concat_ws("-", F.array_join("kinds", "-"), F.round("r", 3).cast("string"))
    rows = grid.withColumn("label", label).select("label", "r", F.posexplode(F.arrays_zip("kinds", where.alias("at"))).alias("_k", "_p"))
    return rows.select("label", (F.col("_k") + 1).alias("atom"), F.col("_p.kinds").alias("species"), (F.col("_p.at.x") * F.col("r")).alias("x"), (F.col("_p.at.y") * F.col("r")).alias("y"), F.lit(0.0).alias("z"))


def model_structure_energies(atoms: DataFrame, spec: DataFrame, members: dict[str, list[float]], weights: dict[str, float], rcut: float, box: float, core: Column | None = None) -> DataFrame:
    """label, natoms, energy, per_atom: made structures scored by an ensemble.

    ``box`` must exceed the widest structure by ``rcut``, so that no image is a
    neighbour. ``core`` is the repulsion of a pair as a column of its distance
    ``r``; every neighbour of every atom adds it. ``spec`` is a small table.
    """
    pairs = neighbours.neighbour_pairs(atoms, rcut, box, keep=("species",))
    triplets = neighbours.neighbour_triplets(pairs, rcut, keep=("species",))
    parts = [features.one_body_features(atoms, spec), features.two_body_features(pairs, spec, rcut), features.three_body_features(triplets, spec, rcut)]
    table = features.feature_table(parts, spec.count())
    scores = models.score_ensemble(models.score_members(table, "label", "fvec", members), weights, "label")
    out = atoms.groupBy("label").agg(F.count("*").alias("natoms")).join(scores, "label")
    if core is not None:
        added = neighbours.core_repulsion_energy(pairs, core).groupBy("label").agg(F.sum("core").alias("_core"))
        out = out.join(added, "label", "left").withColumn("energy", F.col("energy") + F.coalesce("_core", F.lit(0.0)))
    return out.select("label", "natoms", "energy", (F.col("energy") / F.col("natoms")).alias("per_atom"))


def structure_transform(rows: DataFrame, label: str, function: Callable, schema: str) -> DataFrame:
    """``function`` maps the atoms of one structure (pandas) to 0 or more rows."""
    return rows.groupBy(label).applyInPandas(function, schema)


def bond_modules(atoms: DataFrame, pairs: DataFrame, cutoff: float) -> DataFrame:
    """label, atom, module: the smallest atom of the same bonded unit.

    Each round takes the least module among the neighbours, then follows the
    module's own module; rounds end when nothing changes.
    """
    return linked_modules(atoms, pairs.filter(F.col("r") <= cutoff).select("label", "i", "j"))


def linked_modules(atoms: DataFrame, links: DataFrame) -> DataFrame:
    """As ``bond_modules``, from links (label, i, j) of either direction, such as ``dense.bond_links``."""
    both = links.unionByName(links.select("label", F.col("j").alias("i"), F.col("i").alias("j")))
    bonds = kept(both.filter("i <> j").select("label", F.col("i").alias("atom"), "j").distinct(), "bonds")
    now = kept(atoms.select("label", "atom", F.col("atom").alias("module")), "modules")
    while True:
        least = bonds.join(now.select("label", F.col("atom").alias("j"), F.col("module").alias("_m")), ["label", "j"]).groupBy("label", "atom").agg(F.min("_m").alias("_m"))
        near = now.join(least, ["label", "atom"], "left").select("label", "atom", "module", F.least("module", "_m").alias("_m"))
        jump = now.select("label", F.col("atom").alias("_m"), F.col("module").alias("_n"))
        new = kept(near.join(jump, ["label", "_m"]).select("label", "atom", F.least("_m", "_n").alias("module"), (F.least("_m", "_n") < F.col("module")).alias("moved")), "modules")
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now
