"""Formation energies and the convex hull over one row per formula.

Only the step to least-energy records reads the large table. The lower hull of all
formulas is the lower hull of the lower hulls of any parts of them, so candidates are
first thinned in parts of bounded size, side by side, then once more until few are left;
the last part gives the facets. Where too many stay, the hull itself is that large: then the
space of slopes is cut into boxes. A facet is the set of points that are least at its slope,
so a box needs only points that can be least at one of its slopes, and boxes of many
points are cut again. Two elements take a monotone chain, more an incremental hull.
Points meet facets by the cells of a grid over the composition, an equi-join.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.paths import kept

TOLERANCE, SINGULAR = 1e-8, 1e-12
#: Candidates of a part, and cells along an axis (one axis, several axes).
PART_ROWS, CELLS = 2048, (1024, 32)
#: Relative size of the shifts that keep points off common planes while facets are found.
JOGGLE = 1e-9
#: Cuts of a box of slopes at most, and room for rounding while points are dealt to boxes (one
#: axis, where points on an edge are vertices; several axes).
LEVELS, SLACK = 32, (1e-8, 1e-12)


def elemental_references(least: DataFrame, is_element: Column, element: str, energy: str, needed: DataFrame | None = None) -> DataFrame:
    """element, mu: least energy per atom of the single-element records.

    ``needed`` (element) lists elements that must have a reference; an absent one raises.
    """
    got = least.filter(is_element).groupBy(element).agg(F.min(energy).alias("mu"))
    if needed is not None:
        got = kept(got, "references")
        absent = needed.join(got, element, "left_anti").select(element).first()
        if absent:
            raise ValueError(f"no record of the element {absent[0]} alone")
    return got


def formation_energy(records: DataFrame, counts: DataFrame, mu: DataFrame, key: str, energy: str) -> DataFrame:
    """key, formation: (E - sum of n mu) / n; counts has (key, element, n).

    A record with an element that has no reference gives null.
    """
    priced = counts.join(mu, "element", "left").groupBy(key).agg(F.sum(F.col("n") * F.col("mu")).alias("_ref"), F.sum("n").alias("_n"), F.count_if(F.col("mu").isNull()).alias("_missing"))
    return records.join(priced, key).withColumn("formation", F.when(F.col("_missing") == 0, (F.col(energy) - F.col("_ref")) / F.col("_n"))).drop("_ref", "_n", "_missing")


def _chain(x: np.ndarray, e: np.ndarray) -> list[tuple[int, ...]]:
    """Edges of the lower hull of points on a line, by the monotone chain.

    Points on an edge (within the tolerance of stable records) are vertices too.
    """
    hull: list[int] = []
    for k in np.lexsort((e, x)).tolist():
        if hull and x[k] - x[hull[-1]] < SINGULAR:
            continue
        while len(hull) > 1:
            i, j = hull[-2:]
            if (e[j] - e[i]) * (x[k] - x[i]) - (x[j] - x[i]) * (e[k] - e[i]) <= TOLERANCE / 10 * (x[k] - x[i]):
                break
            hull.pop()
        hull.append(k)
    return list(itertools.pairwise(hull))


def _independent(x: np.ndarray) -> list[int]:
    """Rows of a simplex over ``x``, each the farthest from the rows before it; fewer if flat."""
    first = int(np.argmin(x[:, 0]))
    rows, rest = [first], x - x[first]
    for _ in range(x.shape[1]):
        far = np.linalg.norm(rest, axis=1)
        k = int(np.argmax(far))
        if far[k] < 1e-7:
            break
        rows.append(k)
        unit = rest[k] / far[k]
        rest = rest - np.outer(rest @ unit, unit)
    return rows


def lower_facets(x: np.ndarray, e: np.ndarray, joggle: float | None = None) -> list[tuple[int, ...]] | None:
    """Facets (rows of d + 1 vertices) of the lower hull of energies over d coordinates.

    An apex far above closes the hull; facets without it that face down are the lower
    ones. None where all points lie in a flat part of the coordinates. Points that are
    shifted off common planes already take a ``joggle`` of 0.
    """
    n, d = x.shape
    if d == 1:
        return _chain(x[:, 0], e) if n and np.ptp(x) > SINGULAR else None
    start = _independent(x) if n > d else []
    if len(start) <= d:
        return None
    reach = JOGGLE if joggle is None else joggle
    shift = np.random.default_rng(1).uniform(-reach, reach, (n, d + 1))
    size = max(1.0, float(np.ptp(e)))
    points = np.column_stack([x, e / size]) + shift
    apex = np.append(points[start, :d].mean(axis=0), points[:, d].max() + 10.0)
    points = np.vstack([points, apex])
    inside = points[[*start, n]].mean(axis=0)
    facets: list[tuple[int, ...]] = []
    planes = np.zeros((0, d + 2))

    def plane(facet: tuple[int, ...]) -> np.ndarray:
        base = points[list(facet)]
        normal = np.linalg.svd(base[1:] - base[0])[2][-1]
        offset = normal @ base[0]
        side = 1.0 if normal @ inside < offset else -1.0
        return np.append(normal, offset) * side

    # in order, as ridges of neighbours are told to be the same by their vertices
    for facet in itertools.combinations([*sorted(start), n], d + 1):
        facets.append(facet)
        planes = np.vstack([planes, plane(facet)])
    for k in np.argsort(points[:n, d], kind="stable").tolist():
        if k in start:
            continue
        seen = planes[:, :-1] @ points[k] - planes[:, -1] > 1e-13
        if not seen.any():
            continue
        ridges: dict[tuple[int, ...], int] = {}
        for f in np.flatnonzero(seen).tolist():
            for ridge in itertools.combinations(facets[f], d):
                ridges[ridge] = ridges.get(ridge, 0) + 1
        fresh = [tuple(sorted((*r, k))) for r, times in ridges.items() if times == 1]
        facets = [f for f, s in zip(facets, seen.tolist(), strict=True) if not s] + fresh
        planes = np.vstack([planes[~seen], *(plane(f) for f in fresh)])
    return [f for f, p in zip(facets, planes, strict=True) if n not in f and p[d] < -1e-9]


def _thinned(candidates: DataFrame, coords: list[str], energy: str) -> DataFrame:
    """Candidates of which only vertices of the lower hulls of parts are left."""
    schema = candidates.schema

    def vertices(pdf):
        facets = lower_facets(pdf[coords].to_numpy(dtype=float), pdf[energy].to_numpy(dtype=float))
        return pdf if facets is None else pdf.iloc[sorted({k for f in facets for k in f})]

    n, turn = candidates.count(), 0
    while n > PART_ROWS:
        parts = -(-n // PART_ROWS)
        dealt = candidates.withColumn("_part", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(parts)))
        left = kept(dealt.groupBy("_part").applyInPandas(lambda pdf: vertices(pdf.drop(columns="_part")), schema), "hull-candidates")
        before, n, turn = n, left.count(), turn + 1
        candidates = left
        if n > 0.9 * before:
            # nearly all are vertices: the hull itself is that large, and found by boxes
            break
    return candidates


def _faces(d: int) -> list[tuple[int, float]]:
    """Slopes of any steepness as faces of a cube: (d, 1) holds those of at most one on each
    axis, (k, +-1) those that are steepest along axis k, up or down."""
    return [(d, 1.0), *((k, sign) for k in range(d) for sign in (1.0, -1.0))]


def _boxed(points: DataFrame, d: int) -> DataFrame:
    """Points with every box of slopes (``box``, ``lo``, ``hi``) at which they can be least.

    points: x0, x1 ..., e and more. A plane of slopes s touches the hull where e - s x is
    least; divided by the largest of 1, |s0|, |s1| ... this is a sum ``base + p0 g0 + p1 g1 ...``
    with a bounded p on each face of a cube. A box of more than PART_ROWS points is cut
    in half along each p. At the corners and the middle of each half the least point is
    found (one aggregate over all boxes); a point goes where it can be below each of these
    somewhere in the half. No such test drops a point that is least at a slope of the box.
    A box is left as it is after LEVELS cuts.
    """
    halves = list(itertools.product((0, 1), repeat=d))
    # corners are shared by halves; beyond three axes they are too many, and the middles do
    probes = {tuple(2 * h + 1 for h in half) for half in halves}
    if d <= 3:
        probes |= set(itertools.product((0, 2, 4), repeat=d))
    names = {probe: "p" + "".join(map(str, probe)) for probe in sorted(probes)}
    at = lambda k, quarter: F.col("lo")[k] + (F.col("hi")[k] - F.col("lo")[k]) * (quarter / 4)
    value = lambda probe: F.col("base") + _total([at(k, q) * F.col("g")[k] for k, q in enumerate(probe)])

    def face(number, axis, sign):
        terms = [*(-F.col(f"x{k}") for k in range(d)), F.col("e")]
        floor = [-1.0] * d + [0.0]
        free = [k for k in range(d + 1) if k != axis]
        lo, hi = F.array(*(F.lit(floor[k]) for k in free)), F.array(*[F.lit(1.0)] * d)
        return F.struct(F.lit(str(number)).alias("box"), lo.alias("lo"), hi.alias("hi"), (terms[axis] * sign).alias("base"), F.array(*(terms[k] for k in free)).alias("g"))

    def child(half):
        lo, hi = (F.array(*(at(k, 2 * h + end) for k, h in enumerate(half))) for end in (0, 2))
        rivals = [names[p] for p in sorted(probes) if all(2 * h <= q <= 2 * h + 2 for h, q in zip(half, p, strict=True))]
        return F.struct(F.concat("box", F.lit("." + "".join(map(str, half)))).alias("box"), lo.alias("lo"), hi.alias("hi"), F.array(*rivals).alias("rivals"))

    def below(c, rival):
        """The point can be as low as ``rival`` somewhere in ``c``."""
        steps = [F.col("g")[k] - rival["g"][k] for k in range(d)]
        least = [F.least(c["lo"][k] * step, c["hi"][k] * step) for k, step in enumerate(steps)]
        return F.col("base") - rival["base"] + _total(least) <= SLACK[d > 1]

    faces = F.explode(F.array(*(face(number, *which) for number, which in enumerate(_faces(d)))))
    active, done = points.withColumn("_f", faces).select(*points.columns, "_f.*"), []
    for level in range(LEVELS + 1):
        least = [F.min_by(F.struct("base", "g"), value(probe)).alias(name) for probe, name in names.items()]
        boxes = kept(active.groupBy("box", "lo", "hi").agg(F.count("*").alias("n"), *least), "slope-boxes")
        large = boxes.filter((F.col("n") > PART_ROWS) & F.lit(level < LEVELS))
        last = large.isEmpty()
        done.append(active if last else active.join(boxes.filter(F.col("n") <= PART_ROWS).select("box"), "box"))
        if last:
            break
        cut = large.select("box", F.array(*(child(half) for half in halves)).alias("children"))
        dealt = active.drop("lo", "hi").join(cut, "box").drop("box")
        fits = F.filter("children", lambda c: F.forall(c["rivals"], lambda rival: below(c, rival)))
        dealt = dealt.withColumn("_c", F.explode(F.transform(fits, lambda c: F.struct(c["box"].alias("box"), c["lo"].alias("lo"), c["hi"].alias("hi")))))
        active = kept(dealt.select(*points.columns, "base", "g", "_c.box", "_c.lo", "_c.hi"), "slope-points")
    return reduce(lambda a, b: a.unionByName(b), done).drop("base", "g")


def _facets_of_boxes(few: DataFrame, coords: list[str], energy: str, names: list[str], schema: str) -> DataFrame:
    """The facets of a hull too large for a task, found box by box of slopes."""
    d = len(coords)
    # rows at the same place: the lowest (least key on ties) is enough
    few = few.groupBy(*coords).agg(F.min(F.struct(energy, "key")).alias("_b")).select(*coords, "_b.*")
    low, high = few.agg(F.min(energy), F.max(energy)).first()
    size = max(1.0, 1.01 * (high - low))
    # the shift depends on the key, so that all boxes see one and the same hull
    shift = lambda k: ((F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 30)) / float(1 << 29)) - 1) * (JOGGLE if d > 1 else 0.0)
    moved = {f"x{k}": F.col(f"k{k}") + shift(k) for k in range(d)} | {"e": F.col("energy") / size + shift(d)}
    points = kept(few.select("key", *(F.col(c).alias(f"k{k}") for k, c in enumerate(coords)), F.col(energy).alias("energy")).withColumns(moved), "hull-points")
    boxes = kept(_boxed(points, d), "slope-points")

    def facets(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key", kind="stable")
        x, e = pdf[[f"x{k}" for k in range(d)]].to_numpy(dtype=float), pdf["e"].to_numpy(dtype=float)
        found = np.array([sorted(f) for f in lower_facets(x, e, 0.0) or []], dtype=int).reshape(-1, d + 1)
        edges = x[found[:, 1:]] - x[found[:, :1]]
        whole = np.abs(np.linalg.det(edges)) > 0
        found, edges = found[whole], edges[whole]
        slopes = np.linalg.solve(edges, (e[found[:, 1:]] - e[found[:, :1]])[..., None])[..., 0]
        # where the slopes lie on the box's face; one at a border may be found twice
        axis, sign = _faces(d)[int(pdf["box"].iloc[0].split(".")[0])]
        full = np.column_stack([slopes, np.ones(len(slopes))])
        scale = full[:, axis] * sign
        faced = scale > 0
        p = np.delete(full, axis, axis=1) / np.where(faced, scale, 1.0)[:, None]
        mine = faced & ((p >= pdf["lo"].iloc[0] - 1e-9) & (p <= pdf["hi"].iloc[0] + 1e-9)).all(axis=1)
        source = [*(f"k{k}" for k in range(d)), "energy", "key"]
        return pd.DataFrame([[pdf[c].iloc[i] for i in f for c in source] for f in found[mine].tolist()], columns=names)

    out = boxes.groupBy("box").applyInPandas(lambda pdf: facets(pdf), schema)
    return out.dropDuplicates([f"v{k}key" for k in range(d + 1)])


def lower_hull(candidates: DataFrame, coords: list[str], energy: str) -> DataFrame:
    """Facets of the lower hull of the candidates with energy <= 0.

    candidates: key, coords (fractions between 0 and 1), energy; rows with a null are
    left out. Each row has the vertices ``v0*``, ``v1*`` ... (coordinates, energy, key) and ``w{k}_{c}``,
    the linear form that gives the k-th barycentric coordinate of a point. No rows
    where the candidates don't span the coordinates.
    """
    ship(candidates.sparkSession)
    picked = candidates.select("key", *(F.col(c).cast("double").alias(c) for c in [*coords, energy])).dropna()
    few = _thinned(kept(picked.filter(F.col(energy) <= 0), "hull-candidates"), coords, energy)
    kind, d = dict(few.dtypes)["key"], len(coords)
    names = [f"v{k}{c}" for k in range(d + 1) for c in [*coords, energy, "key"]]

    def facets(pdf):
        import pandas as pd

        found = lower_facets(pdf[coords].to_numpy(dtype=float), pdf[energy].to_numpy(dtype=float)) or []
        rows = [[pdf[c].iloc[i] for i in f for c in [*coords, energy, "key"]] for f in found]
        return pd.DataFrame(rows, columns=names)

    schema = ", ".join(f"`{c}` {kind if c.endswith('key') else 'double'}" for c in names)
    if few.count() > PART_ROWS:
        out = _facets_of_boxes(few, coords, energy, names, schema)
    else:
        out = few.groupBy(F.lit(1).alias("_all")).applyInPandas(lambda pdf: facets(pdf), schema)
    edge = [[F.col(f"v{k}{c}") - F.col(f"v0{c}") for c in coords] for k in range(1, d + 1)]
    out = kept(out.withColumn("det", _det(edge)).filter(F.abs("det") >= SINGULAR), "facets")
    unit = lambda c: [F.lit(1.0 if x == c else 0.0) for x in coords]
    forms = {f"w{k}_{c}": _det([unit(c) if j == k - 1 else row for j, row in enumerate(edge)]) / F.col("det") for k in range(1, d + 1) for c in coords}
    return kept(out.withColumns(forms), "facet-forms")


def _det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    terms = [(-1) ** j * m[0][j] * _det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return reduce(lambda a, b: a + b, terms)


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def point_in_simplex(points: DataFrame, facets: DataFrame, coords: list[str], energy: str) -> DataFrame:
    """Points with every simplex that holds them, bary0..n and ``hull`` energy.

    Simplices are posted to all cells of a grid that their bounding boxes touch, so
    the join is an equi-join on the cell.
    """
    n = len(coords)
    cells = CELLS[0] if n == 1 else CELLS[1]
    cell = lambda x: F.floor(x * cells).cast("int")
    posted = facets
    for c in coords:
        ends = [F.col(f"v{k}{c}") for k in range(n + 1)]
        posted = posted.withColumn(f"_g{c}", F.explode(F.sequence(cell(F.least(*ends) - 1e-6), cell(F.greatest(*ends) + 1e-6))))
    placed = points.withColumns({f"_g{c}": cell(F.col(c)) for c in coords})
    joined = placed.join(posted, [f"_g{c}" for c in coords]).drop(*(f"_g{c}" for c in coords))
    bary = [_total([F.col(f"w{k}_{c}") * (F.col(c) - F.col(f"v0{c}")) for c in coords]) for k in range(1, n + 1)]
    bary = [1 - _total(bary), *bary]
    named = joined.withColumns({f"bary{k}": b for k, b in enumerate(bary)})
    held = named.filter(reduce(lambda a, b: a & b, [F.col(f"bary{k}") > -TOLERANCE for k in range(n + 1)]))
    return held.withColumn("hull", _total([F.col(f"bary{k}") * F.col(f"v{k}{energy}") for k in range(n + 1)]))


def e_above_hull(points: DataFrame, candidates: DataFrame, coords: list[str], energy: str) -> DataFrame:
    """points with ``e_above_hull``; null where the hull doesn't reach the point."""
    points = kept(points, "hull-points")
    held = point_in_simplex(points.select("key", *coords), lower_hull(candidates, coords, energy), coords, energy)
    best = kept(held.groupBy("key").agg(F.min("hull").alias("_hull")), "hull-energies")
    return points.join(best, "key", "left").withColumn("e_above_hull", F.col(energy) - F.col("_hull")).drop("_hull")


def decomposition(points: DataFrame, candidates: DataFrame, coords: list[str], energy: str) -> DataFrame:
    """key, product, fraction: stable products of the hull at each point."""
    points = kept(points, "hull-points")
    held = point_in_simplex(points.select("key", *coords), lower_hull(candidates, coords, energy), coords, energy)
    n = len(coords) + 1
    parts = F.array(*(F.struct(F.col(f"v{k}key").alias("product"), F.col(f"bary{k}").alias("fraction")) for k in range(n)))
    best = held.groupBy("key").agg(F.min(F.struct(F.round("hull", 12).alias("h"), *(F.col(f"v{k}key") for k in range(n)), parts.alias("parts"))).alias("_b"))
    return best.select("key", F.explode("_b.parts").alias("p")).select("key", "p.product", "p.fraction").filter(F.col("fraction") > TOLERANCE)


def stable_mask(points: DataFrame) -> DataFrame:
    """Adds ``stable``: the record lies on the hull."""
    return points.withColumn("stable", F.coalesce(F.abs("e_above_hull") <= TOLERANCE, F.lit(False)))


def filter_above_hull(points: DataFrame, threshold: float = 0.5) -> DataFrame:
    return points.filter(F.col("e_above_hull") < threshold)
