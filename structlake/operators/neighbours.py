"""Neighbour pairs and triplets under periodic images, and what follows from them."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def neighbour_pairs(atoms: DataFrame, rcut: float, box: float, label: str = "label", atom: str = "atom", xyz: tuple[str, str, str] = ("x", "y", "z"), keep: tuple[str, ...] = ()) -> DataFrame:
    """label, i, j, sx, sy, sz, dx, dy, dz, r: all pairs with 0 < r <= rcut.

    Cubic periodic boxes with edge ``box``, images within one box (rcut <= box).
    Atoms are binned in cells of at least rcut; each atom is sent to the cells
    around it, so the join is an equi-join on (label, cell) and its work follows
    the local density, not the square of the structure.
    """
    if rcut > box:
        raise ValueError("rcut must not exceed the box")
    n = max(1, int(box / rcut))
    wrapped = [(F.col(c) - box * F.floor(F.col(c) / box)) for c in xyz]
    base = atoms.select(F.col(label).alias("label"), F.col(atom).alias("atom"), *(w.alias(a) for w, a in zip(wrapped, "xyz", strict=True)), *keep)
    cell = lambda a: F.least(F.floor(F.col(a) / (box / n)).cast("int"), F.lit(n - 1))
    binned = base.withColumns({f"c{a}": cell(a) for a in "xyz"})
    steps = [-1, 0, 1]
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"o{a}") for v, a in zip(o, "xyz", strict=True))) for o in itertools.product(steps, repeat=3))))
    # where the target cell leaves the box, the atom is seen through an image
    left = binned.select("*", around.alias("o")).select(
        "label",
        F.col("atom").alias("i"),
        *(F.col(a).alias(f"{a}i") for a in "xyz"),
        *(F.col(k).alias(f"{k}_i") for k in keep),
        *(F.pmod(F.col(f"c{a}") + F.col(f"o.o{a}"), F.lit(n)).alias(f"c{a}") for a in "xyz"),
        *(F.floor((F.col(f"c{a}") + F.col(f"o.o{a}")) / n).cast("int").alias(f"s{a}") for a in "xyz"),
    )
    right = binned.select("label", "cx", "cy", "cz", F.col("atom").alias("j"), *(F.col(a).alias(f"{a}j") for a in "xyz"), *(F.col(k).alias(f"{k}_j") for k in keep))
    joined = left.join(right, ["label", "cx", "cy", "cz"])
    moved = joined.withColumns({f"d{a}": F.col(f"{a}j") + box * F.col(f"s{a}") - F.col(f"{a}i") for a in "xyz"})
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return moved.withColumn("r", r).filter((F.col("r") > 0) & (F.col("r") <= rcut)).select("label", "i", "j", "sx", "sy", "sz", "dx", "dy", "dz", "r", *(f"{k}_{s}" for k in keep for s in "ij"))


def lattice_pairs(atoms: DataFrame, lattices: DataFrame, rcut: float, label: str = "label", atom: str = "atom", frac: tuple[str, str, str] = ("fx", "fy", "fz"), lattice: str = "lattice", keep: tuple[str, ...] = ()) -> DataFrame:
    """label, i, j, sx, sy, sz, dx, dy, dz, r: as ``neighbour_pairs`` in any lattice.

    ``lattices`` has a row of three vectors for each label; atoms lie at fractions of
    them. Along each axis a cell is cut into as many bins as keep at least ``rcut``
    between their planes. Where the planes of the cell itself are nearer, further
    images are looked at: as many as ``rcut`` over the distance of the planes.
    """
    v = [[F.col(f"{lattice}")[a][b] for b in range(3)] for a in range(3)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    norm = lambda p: F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    normals = [cross(v[1], v[2]), cross(v[2], v[0]), cross(v[0], v[1])]
    volume = F.abs(sum((x * y for x, y in zip(v[0], normals[0], strict=True)), F.lit(0.0)))
    heights = [volume / norm(n) for n in normals]
    bins = [F.greatest(F.floor(h / rcut), F.lit(1)).cast("int") for h in heights]
    reach = [F.ceil(F.lit(rcut) * n / h).cast("int") for n, h in zip(bins, heights, strict=True)]
    cells = lattices.select(F.col(label).alias("_l"), F.col(lattice).alias("_v"), *(b.alias(f"_n{a}") for a, b in zip("xyz", bins, strict=True)), *(m.alias(f"_m{a}") for a, m in zip("xyz", reach, strict=True)))
    base = atoms.select(F.col(label).alias("label"), F.col(atom).alias("atom"), *((F.col(c).cast("double") - F.floor(c)).alias(a) for c, a in zip(frac, "xyz", strict=True)), *keep)
    binned = base.join(cells, F.col("label") == F.col("_l")).drop("_l").withColumns({f"c{a}": F.least(F.floor(F.col(a) * F.col(f"_n{a}")).cast("int"), F.col(f"_n{a}") - 1) for a in "xyz"})
    spread = binned
    for a in "xyz":
        spread = spread.withColumn(f"o{a}", F.explode(F.sequence(F.col(f"c{a}") - F.col(f"_m{a}"), F.col(f"c{a}") + F.col(f"_m{a}"))))
    left = spread.select(
        "label",
        F.col("atom").alias("i"),
        "_v",
        *(F.col(a).alias(f"{a}i") for a in "xyz"),
        *(F.col(k).alias(f"{k}_i") for k in keep),
        *(F.pmod(f"o{a}", f"_n{a}").alias(f"c{a}") for a in "xyz"),
        *(F.floor(F.col(f"o{a}") / F.col(f"_n{a}")).cast("int").alias(f"s{a}") for a in "xyz"),
    )
    right = binned.select("label", "cx", "cy", "cz", F.col("atom").alias("j"), *(F.col(a).alias(f"{a}j") for a in "xyz"), *(F.col(k).alias(f"{k}_j") for k in keep))
    joined = left.join(right, ["label", "cx", "cy", "cz"])
    apart = [F.col(f"{a}j") + F.col(f"s{a}") - F.col(f"{a}i") for a in "xyz"]
    moved = joined.withColumns({f"d{a}": sum((apart[k] * F.col("_v")[k][b] for k in range(3)), F.lit(0.0)) for b, a in enumerate("xyz")})
    r = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    return moved.withColumn("r", r).filter((F.col("r") > 0) & (F.col("r") <= rcut)).select("label", "i", "j", "sx", "sy", "sz", "dx", "dy", "dz", "r", *(f"{k}_{s}" for k in keep for s in "ij"))


def centre_atoms(atoms: DataFrame, label: str = "label", frac: tuple[str, str, str] = ("fx", "fy", "fz")) -> DataFrame:
    """Atoms shifted so that the mean of a structure's fractions is the cell's centre."""
    means = atoms.groupBy(F.col(label).alias("_l")).agg(*(F.avg(c).alias(f"_{c}") for c in frac))
    moved = atoms.join(means, F.col(label).eqNullSafe(F.col("_l"))).withColumns({c: F.col(c) - F.col(f"_{c}") + 0.5 for c in frac})
    return moved.drop("_l", *(f"_{c}" for c in frac))


def neighbour_triplets(pairs: DataFrame, rcut: float, keep: tuple[str, ...] = (), vectors: bool = False) -> DataFrame:
    """label, i, j, k, rij, rik, rjk: both neighbours of i, each pair {j, k} once.

    The pairs of an atom are packed into one list, so the shuffle holds a row for each pair;
    triplets are made where the list is, and those beyond the cutoff never become
    rows. ``vectors`` adds dx1 ... dz2, from i to j and from i to k.
    """
    item = F.struct("j", "sx", "sy", "sz", "dx", "dy", "dz", "r", *(f"{k}_j" for k in keep))
    lists = pairs.groupBy("label", "i", *(f"{k}_i" for k in keep)).agg(F.array_sort(F.collect_list(item)).alias("_n"))
    far = lambda x, y: F.sqrt(sum(((x[d] - y[d]) ** 2 for d in ("dx", "dy", "dz")), F.lit(0.0)))
    # list items go by atom and image, so what follows one makes each pair once
    each = lists.select("*", F.posexplode("_n").alias("_p", "x"))
    later = F.filter(F.slice("_n", F.col("_p") + 2, F.size("_n")), lambda y: (far(F.col("x"), y) <= rcut) & (far(F.col("x"), y) > 0))
    both = each.select("label", "i", *(f"{k}_i" for k in keep), "x", F.explode(later).alias("y"))
    return both.select(
        "label",
        "i",
        F.col("x.j").alias("j"),
        F.col("y.j").alias("k"),
        F.col("x.r").alias("rij"),
        F.col("y.r").alias("rik"),
        far(F.col("x"), F.col("y")).alias("rjk"),
        *(c for k in keep for c in (F.col(f"{k}_i"), F.col(f"x.{k}_j").alias(f"{k}_1"), F.col(f"y.{k}_j").alias(f"{k}_2"))),
        *(F.col(f"{end}.d{c}").alias(f"d{c}{e}") for c in "xyz" for e, end in ((1, "x"), (2, "y")) if vectors),
    )


def filter_min_separation(structures: DataFrame, pairs: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """Structures none of whose pairs is nearer than ``threshold``."""
    return structures.join(pairs.filter(F.col("r") < threshold).select(F.col("label").alias("_l")).distinct(), F.col(label) == F.col("_l"), "left_anti")


def species_separations(pairs: DataFrame, si: str = "species_i", sj: str = "species_j") -> DataFrame:
    """label, sa, sb, minsep, meansep, n over both directions of each pair."""
    return pairs.groupBy("label", F.least(si, sj).alias("sa"), F.greatest(si, sj).alias("sb")).agg(F.min("r").alias("minsep"), F.avg("r").alias("meansep"), F.count("*").alias("n"))


def complete_separations(separations: DataFrame, labels: DataFrame, species: DataFrame) -> DataFrame:
    """All pairs of ``species`` for each label; 999 / 0 / 0 where unseen."""
    a, b = species.select(F.col("species").alias("sa")), species.select(F.col("species").alias("sb"))
    grid = labels.select("label").crossJoin(F.broadcast(a.join(b, F.col("sa") <= F.col("sb"))))
    full = grid.join(separations, ["label", "sa", "sb"], "left")
    return full.select("label", "sa", "sb", F.coalesce("minsep", F.lit(999.0)).alias("minsep"), F.coalesce("meansep", F.lit(0.0)).alias("meansep"), F.coalesce("n", F.lit(0)).alias("n"))


def gather_separation_stats(separations: DataFrame) -> DataFrame:
    """Spread of minsep and meansep over the structures that have a pair."""
    seen = separations.filter("n > 0")
    return seen.groupBy("sa", "sb").agg(F.count("*").alias("n_structures"), F.min("minsep").alias("least"), F.avg("minsep").alias("mean_minsep"), F.avg("meansep").alias("mean_meansep"))


def supercell(atoms: DataFrame, reps: tuple[int, int, int], frac: tuple[str, str, str] = ("fx", "fy", "fz")) -> DataFrame:
    """Atoms repeated over a grid of translations, fractions of the larger cell."""
    grid = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"n{k}") for k, v in enumerate(o))) for o in itertools.product(*(range(n) for n in reps)))))
    spread = atoms.withColumn("_o", grid)
    moved = {c: (F.col(c) + F.col(f"_o.n{k}")) / reps[k] for k, c in enumerate(frac)}
    image = F.col("_o.n0") * reps[1] * reps[2] + F.col("_o.n1") * reps[2] + F.col("_o.n2")
    return spread.withColumns(moved).withColumn("image", image).drop("_o")


def core_repulsion_energy(pairs: DataFrame, term: Column) -> DataFrame:
    """label, i, core: summed repulsion of each atom's neighbours."""
    return pairs.groupBy("label", "i").agg(F.sum(term).alias("core"))
