"""Column functions on compositions, labels, units, cutoffs and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: GPa in one eV per cubic angstrom.
GPA_PER_EV_ANG3 = 160.21766208


# --- compositions -------------------------------------------------------------


def composition_of(species: Column) -> Column:
    """Counts of the elements of an array of symbols: map<string,bigint>."""
    names = F.array_sort(F.array_distinct(species))
    return F.map_from_arrays(names, F.transform(names, lambda s: F.size(F.filter(species, lambda x: x == s)).cast("long")))


def parse_formula(formula: Column) -> Column:
    """``H2O`` as map; repeated symbols add up."""
    symbols = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), 1)
    digits = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), 2)
    counts = F.transform(digits, lambda d: F.when(d == "", 1).otherwise(F.nullif(d, F.lit("")).cast("long")))
    pairs = F.arrays_zip(symbols.alias("s"), counts.alias("n"))
    names = F.array_sort(F.array_distinct(symbols))
    total = lambda s: F.aggregate(F.filter(pairs, lambda p: p["s"] == s), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    return F.map_from_arrays(names, F.transform(names, total))


def _gcd(a: Column, b: Column) -> Column:
    # Euclid's steps: no more than five for each decimal digit of the smaller number
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b")))
    steps = 5 * F.length(F.least(F.abs(a), F.abs(b)).cast("string")) + 1
    return F.aggregate(F.sequence(F.lit(1), steps), state, step)["a"]


def formula_units(composition: Column) -> Column:
    """Greatest common divisor of the counts (1 for an empty composition)."""
    return F.greatest(F.aggregate(F.map_values(composition), F.lit(0).cast("long"), _gcd), F.lit(1))


def reduce_composition(composition: Column) -> Column:
    n = formula_units(composition)
    return F.transform_values(composition, lambda _, v: F.call_function("div", v, n))


def formula_string(composition: Column) -> Column:
    """Canonical text, elements in alphabetical order, a count of 1 left out."""
    sorted_ = F.array_sort(F.map_entries(composition))
    return F.array_join(F.transform(sorted_, lambda e: F.concat(e["key"], F.when(e["value"] == 1, "").otherwise(e["value"].cast("string")))), "")


def n_atoms(composition: Column) -> Column:
    return F.aggregate(F.map_values(composition), F.lit(0).cast("long"), lambda a, x: a + x)


def composition_coords(composition: Column, elements: list[str]) -> Column:
    """Fractions of all elements but the first."""
    return F.array(*(F.coalesce(F.try_element_at(composition, F.lit(e)), F.lit(0)) / n_atoms(composition) for e in elements[1:]))


def elemental_sum(composition: Column, reference: dict[str, float]) -> Column:
    """Sum over atoms of per-element values; absent elements count 0."""
    table = F.create_map(*(F.lit(x) for kv in reference.items() for x in kv)) if reference else F.create_map().cast("map<string,double>")
    return F.aggregate(F.map_entries(composition), F.lit(0.0), lambda a, e: a + e["value"] * F.coalesce(F.try_element_at(table, e["key"]), F.lit(0.0)))


def energy_per_atom(energy: Column, natoms: Column) -> Column:
    return energy / natoms


# --- units and radial functions --------------------------------------------------


def ev_ang3_to_gpa(x: Column) -> Column:
    return x * GPA_PER_EV_ANG3


def gpa_to_ev_ang3(x: Column) -> Column:
    return x / GPA_PER_EV_ANG3


def stress_to_pressure(stress: Column) -> Column:
    """A third of the trace of a 3x3 array."""
    return (stress[0][0] + stress[1][1] + stress[2][2]) / 3


def enthalpy_pv(energy: Column, volume: Column, pressure: Column) -> Column:
    return energy + volume * pressure


def cutoff_fr(r: Column, rcut: Column | float) -> Column:
    """2 (1 - r / rcut) inside the cutoff, else 0."""
    return F.when(r <= rcut, 2 * (1 - r / rcut)).otherwise(0.0)


def cutoff_gfr(r: Column, rcut: Column | float) -> Column:
    """Slope of ``cutoff_fr``."""
    return F.when(r <= rcut, F.lit(-2.0) / rcut).otherwise(0.0)


def core_repulsion(r: Column, core: float, power: int = 12) -> Column:
    return F.when(r < core, F.pow(2 * (core / r - 1), F.lit(power))).otherwise(0.0)


def core_repulsion_grad(r: Column, core: float, power: int = 12) -> Column:
    return F.when(r < core, -2 * core / (r * r) * power * F.pow(2 * (core / r - 1), F.lit(power - 1))).otherwise(0.0)


def int_pow(x: Column, n: int) -> Column:
    return F.pow(x, F.lit(n))


def geometric_exponents(low: float, high: float, n: int) -> list[float]:
    """n exponents from low to high in a geometric series, three digits."""
    if n < 2:
        return [round(float(low), 3)] * n
    ratio = (high / low) ** (1 / (n - 1))
    return [round(low * ratio**k, 3) for k in range(n)]


def pair_key(a: Column, b: Column) -> list[Column]:
    """Unordered pair as (smaller, larger)."""
    return [F.least(a, b), F.greatest(a, b)]


# --- labels ---------------------------------------------------------------------


def shake_parent_label(label: Column) -> Column:
    """The label without its last ``-shake...`` part."""
    return F.regexp_replace(label, r"(?s)^(.*)-shake.*$", "$1")


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)$", 1), r"(?s)(.)\.[^.]*$", "$1")


def swap_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?s)\.[^./]*$", ""), F.lit("." + extension.lstrip(".")))


def make_label(seed: Column, at: Column, key: Column) -> Column:
    """seed-yy-MM-dd-HH-mm-ss-xxxxxxxx; the last part is made from ``key``."""
    return F.concat_ws("-", seed, F.date_format(at, "yy-MM-dd-HH-mm-ss"), F.substring(F.md5(key.cast("string")), 1, 8))


def ev_distance(e1: Column, v1: Column, e2: Column, v2: Column) -> Column:
    return F.sqrt((e1 - e2) * (e1 - e2) + (v1 - v2) * (v1 - v2))


# --- cells ------------------------------------------------------------------------


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def cell_to_lattice(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Rows of the lattice: a along x, b in the xy plane."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    zero = F.lit(0.0)
    cy = (ca - cb * cg) / sg
    return F.array(F.array(a, zero, zero), F.array(b * cg, b * sg, zero), F.array(c * cb, c * cy, c * F.sqrt(1 - cb * cb - cy * cy)))


def frac_to_cart(lattice: Column, fx: Column, fy: Column, fz: Column) -> list[Column]:
    return [fx * lattice[0][k] + fy * lattice[1][k] + fz * lattice[2][k] for k in range(3)]


def wrap_frac(x: Column) -> Column:
    return x - F.floor(x)
