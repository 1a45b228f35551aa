"""More queries over the given tables, each beside its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chem
from ..operators import datasets, evaluate, features, hull, leaders, models, neighbours, records
from ..sources import shelx, texts
from ..sources.paths import scratch
from ..streaming import jobs
from .registry import _COMP, _F2, _GREEDY, _HULL, _PAIRS, _RC, _SCORES, _STD, _W, PRED, _as_folder, _atoms, _hull_points, _pairs, _predictions, _r, _spec, _vectors, query, table

# --- records ----------------------------------------------------------------------

_TEXT = "list_aggregate(list_transform(m, lambda x: x.k || CASE WHEN x.v{0} = 1 THEN '' ELSE CAST(x.v{0} AS VARCHAR) END), 'string_agg', '')"


def _orders_as_records(spark, sf_dir):
    """A record for each order: composition by return flag, summed price and quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("s"), F.sum("l_extendedprice").alias("enthalpy"), F.sum("l_quantity").alias("volume"), F.count("*").alias("natoms"))
    return rows.withColumn("composition", chem.composition_of(F.col("s"))).drop("s")


@query(
    f"WITH {_COMP}, s AS (SELECT l_orderkey, sum(l_extendedprice) AS e, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(g AS BIGINT) AS nform, {_TEXT.format('')} AS formula, {_TEXT.format(' // g')} AS reduced_formula, round(e / n, 6) AS enthalpy_per_atom, round(v / n, 6) AS volume_per_atom, round(e / g, 6) AS enthalpy_per_form, round(v / g, 6) AS volume_per_form FROM d JOIN s USING (l_orderkey)"
)
def enrich_records(spark, sf_dir):
    got = records.enrich_records(_orders_as_records(spark, sf_dir))
    return got.select("l_orderkey", "nform", "formula", "reduced_formula", F.round("enthalpy_per_atom", 6).alias("enthalpy_per_atom"), _r("volume_per_atom", "volume_per_atom"), F.round("enthalpy_per_form", 6).alias("enthalpy_per_form"), _r("volume_per_form", "volume_per_form"))


_COUNT = "coalesce(list_filter(m, lambda x: x.k = '{}')[1].v, 0)"


@query(f"WITH {_COMP}, s AS (SELECT l_orderkey, sum(l_extendedprice) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, round(e - ({_COUNT.format('A')} * 1.5::DOUBLE + {_COUNT.format('N')} * 2.25::DOUBLE), 3) AS enthalpy FROM c JOIN s USING (l_orderkey)")
def subtract_elemental_energy(spark, sf_dir):
    got = records.subtract_elemental_energy(_orders_as_records(spark, sf_dir), "composition", "enthalpy", {"A": 1.5, "N": 2.25})
    return got.select("l_orderkey", F.round("enthalpy", 3).alias("enthalpy"))


@query("SELECT p_partkey, round(p_retailprice / p_size, 6) AS per_atom, round(p_retailprice / 160.21766208::DOUBLE, 6) AS ev_ang3, round((p_size + p_retailprice + 3.0::DOUBLE) / 3, 6) AS pressure, round(p_retailprice + p_size * 0.25::DOUBLE, 6) AS enthalpy, round(pow(p_size / 10.0::DOUBLE, 5), 4) AS fifth FROM part")
def energy_functions(spark, sf_dir):
    part, price, size = table(spark, sf_dir, "part"), F.col("p_retailprice"), F.col("p_size")
    zero = F.lit(0.0)
    stress = F.array(F.array(size.cast("double"), zero, zero), F.array(zero, price, zero), F.array(zero, zero, F.lit(3.0)))
    return part.select(
        "p_partkey",
        _r(chem.energy_per_atom(price, size), "per_atom"),
        _r(chem.gpa_to_ev_ang3(price), "ev_ang3"),
        _r(chem.stress_to_pressure(stress), "pressure"),
        _r(chem.enthalpy_pv(price, size, F.lit(0.25)), "enthalpy"),
        F.round(chem.int_pow(size / 10.0, 5), 4).alias("fifth"),
    )


@query(f"WITH {_COMP} SELECT l_orderkey, CAST({_COUNT.format('A')} AS BIGINT) AS a, CAST({_COUNT.format('N')} AS BIGINT) AS n, CAST({_COUNT.format('R')} AS BIGINT) AS r FROM c")
def parse_formula(spark, sf_dir):
    """Formulas of all orders, written as text and parsed again."""
    parsed = _orders_as_records(spark, sf_dir).select("l_orderkey", chem.parse_formula(chem.formula_string(F.col("composition"))).alias("c"))
    return parsed.select("l_orderkey", *(F.coalesce(F.try_element_at("c", F.lit(x)), F.lit(0)).cast("long").alias(x.lower()) for x in "ANR"))


@query("SELECT event_id, 'run-' || strftime(ts, '%y-%m-%d-%H-%M-%S') || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS label FROM events")
def make_label(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", chem.make_label(F.lit("run"), F.col("ts"), F.col("event_id")).alias("label"))


@query("""WITH p AS (SELECT p_partkey, 3 + p_size / 10.0::DOUBLE AS a, cos(radians(60 + p_size)) AS cg, sin(radians(60 + p_size)) AS sg, cos(radians(80)) AS ca, cos(radians(95)) AS cb FROM part),
q AS (SELECT *, (ca - cb * cg) / sg AS cy FROM p)
SELECT p_partkey, round(a * 4 * 5 * sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg), 6) AS volume, round(0.1::DOUBLE * a + 0.2::DOUBLE * 4 * cg + 0.3::DOUBLE * 5 * cb, 6) AS x, round(0.2::DOUBLE * 4 * sg + 0.3::DOUBLE * 5 * cy, 6) AS y, round(0.3::DOUBLE * 5 * sqrt(1 - cb * cb - cy * cy), 6) AS z FROM q""")
def cell_functions(spark, sf_dir):
    cell = (3 + F.col("p_size") / 10.0, F.lit(4.0), F.lit(5.0), F.lit(80.0), F.lit(95.0), F.col("p_size") + 60.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", chem.cell_volume(*cell).alias("volume"), chem.cell_to_lattice(*cell).alias("lattice"))
    xyz = chem.frac_to_cart(F.col("lattice"), chem.wrap_frac(F.lit(1.1)), F.lit(0.2), chem.wrap_frac(F.lit(-0.7)))
    return rows.select("p_partkey", _r("volume", "volume"), *(_r(v, n) for v, n in zip(xyz, "xyz", strict=True)))


@query("WITH w AS (SELECT *, first_value(p_partkey) OVER o AS best, first_value(p_retailprice) OVER o AS price, first_value(p_size) OVER o AS size FROM part WINDOW o AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)) SELECT p_partkey, best, round(sqrt(pow(p_retailprice - price, 2) + pow(p_size - size, 2)), 6) AS distance FROM w")
def lookup_min_record(spark, sf_dir):
    """Each part beside the least of its brand, and how far it is from it."""
    part = table(spark, sf_dir, "part")
    least = records.min_energy_records(part, "p_brand", "p_retailprice", "p_partkey")
    got = records.lookup_min_record(part, least, "p_brand", {"p_partkey": "best", "p_retailprice": "e", "p_size": "v"})
    return got.select("p_partkey", "best", _r(chem.ev_distance(F.col("p_retailprice"), F.col("p_size"), F.col("e"), F.col("v")), "distance"))


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS position, p_partkey FROM part")
def group_by_composition(spark, sf_dir):
    return records.group_by_composition(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice")


@query("SELECT p_partkey, round(p_retailprice / p_size, 6) AS per_atom FROM part ORDER BY p_retailprice / p_size")
def sort_by_enthalpy(spark, sf_dir):
    return records.sort_by_enthalpy(table(spark, sf_dir, "part"), "p_retailprice", "p_size").select("p_partkey", _r(F.col("p_retailprice") / F.col("p_size"), "per_atom"))


def _manhattan(point, points):
    return abs(points - point).sum(axis=1)


@query(_GREEDY.replace("sqrt((x.e - o.p_retailprice) * (x.e - o.p_retailprice) + (x.s - o.s) * (x.s - o.s)) < 30", "abs(x.e - o.p_retailprice) + abs(x.s - o.s) < 40") + "SELECT p_brand, p_partkey, cluster, lead AS is_leader FROM g")
def dedupe_by_distance(spark, sf_dir):
    """Greedy clusters under a distance function of the caller."""
    return leaders.dedupe_greedy(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", ["p_retailprice", "p_size"], 40.0, _manhattan)


# --- evaluation -------------------------------------------------------------------------


@query(f"WITH {PRED}, m AS (SELECT *, avg(t) OVER (PARTITION BY formula) AS mean FROM q), r AS (SELECT 1 - sum(pow(t - p, 2)) / sum(pow(t - mean, 2)) AS r2 FROM m GROUP BY formula) SELECT round(avg(r2), 6) AS r2 FROM r")
def r2_mean(spark, sf_dir):
    return evaluate.r2_mean(_predictions(spark, sf_dir)).select(_r("r2", "r2"))


@query(f"WITH {PRED} SELECT formula, round(t, 4) AS t, round(p, 4) AS p FROM q")
def per_atom_scatter(spark, sf_dir):
    got = evaluate.per_atom_scatter(_predictions(spark, sf_dir))
    return got.select("formula", F.round("t", 4).alias("t"), F.round("p", 4).alias("p"))


@query(f"WITH {PRED} SELECT round(sqrt(avg(pow(((pred / natoms * 2.5::DOUBLE + 7) - (target / natoms * 2.5::DOUBLE + 7)), 2))), 3) AS rmse FROM p")
def atomic_rmse(spark, sf_dir):
    return evaluate.atomic_rmse(_predictions(spark, sf_dir), 7.0, 2.5).select(F.round("rmse", 3).alias("rmse"))


@query("WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS e, count(*) AS natoms FROM lineitem GROUP BY 1) SELECT natoms, round(sum(pow(abs(e - o_totalprice), 0.5)), 3) AS loss FROM s JOIN orders ON l_orderkey = o_orderkey GROUP BY natoms")
def loss_stacked(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return evaluate.loss_stacked(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", orders, "o_totalprice", 0.5).select("natoms", F.round("loss", 3).alias("loss"))


# --- hull ---------------------------------------------------------------------------------


@query(f"""WITH {_HULL}, st AS (SELECT key, x FROM pts JOIN h USING (key) WHERE abs(e - hull) <= 1e-8 AND e <= 0),
b AS (SELECT pts.key, pts.x, max_by(l.key, l.x) AS kl, max(l.x) AS xl FROM pts JOIN st l ON l.x <= pts.x GROUP BY pts.key, pts.x),
c AS (SELECT b.*, min_by(r.key, r.x) AS kr, min(r.x) AS xr FROM b JOIN st r ON r.x >= b.x GROUP BY ALL)
SELECT key, kl AS product, round(CASE WHEN kl = kr THEN 1 ELSE (xr - x) / (xr - xl) END, 6) AS fraction FROM c
UNION ALL SELECT key, kr, round((x - xl) / (xr - xl), 6) FROM c WHERE kl <> kr""")
def decomposition(spark, sf_dir):
    pts = _hull_points(spark, sf_dir)
    return hull.decomposition(pts, pts, ["x"], "e").select("key", "product", _r("fraction", "fraction"))


# --- neighbours and features ----------------------------------------------------------------

_LATTICE = [[1.0, 0.0, 0.0], [0.3, 1.1, 0.0], [0.1, 0.2, 0.9]]


def _cart(c: int) -> str:
    return " + ".join(f"({d}) * {_LATTICE[a][c]}::DOUBLE" for a, d in enumerate(("q.x + i.v - p.x", "q.y + j.v - p.y", "q.z + k.v - p.z")))


@query(f"""WITH w AS (SELECT label, vec_id AS atom, embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE) AS x, embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE) AS y, embedding[3]::DOUBLE - floor(embedding[3]::DOUBLE) AS z FROM embeddings),
v AS (SELECT unnest([-1, 0, 1]) AS v),
d AS (SELECT p.label, p.atom AS i, q.atom AS j, i.v AS sx, j.v AS sy, k.v AS sz, {_cart(0)} AS dx, {_cart(1)} AS dy, {_cart(2)} AS dz FROM w p JOIN w q USING (label), v i, v j, v k),
r AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM d) SELECT label, i, j, sx, sy, sz, round(r, 6) AS r FROM r WHERE r > 0 AND r <= 0.15""")
def lattice_pairs(spark, sf_dir):
    """Neighbours in a cell whose vectors are not at right angles."""
    atoms = _atoms(spark, sf_dir).select("label", "atom", *(F.col(c).alias(f"f{c}") for c in "xyz"))
    lattice = F.array(*(F.array(*map(F.lit, row)) for row in _LATTICE))
    cells = atoms.select("label").distinct().withColumn("lattice", lattice)
    return neighbours.lattice_pairs(atoms, cells, 0.15).select("label", "i", "j", "sx", "sy", "sz", _r("r", "r"))


@query("SELECT vec_id AS atom, label, " + ", ".join(f"round(embedding[{k}]::DOUBLE - avg(embedding[{k}]::DOUBLE) OVER (PARTITION BY label) + 0.5::DOUBLE, 6) AS f{x}" for k, x in ((1, "x"), (2, "y"), (3, "z"))) + " FROM embeddings")
def centre_atoms(spark, sf_dir):
    atoms = _atoms(spark, sf_dir).select("label", "atom", *(F.col(c).alias(f"f{c}") for c in "xyz"))
    return neighbours.centre_atoms(atoms).select("atom", "label", *(_r(c, c) for c in ("fx", "fy", "fz")))


@query(f"WITH {_PAIRS} SELECT least(species_i, species_j) AS sa, greatest(species_i, species_j) AS sb, count(*) AS n FROM prs GROUP BY ALL")
def species_match(spark, sf_dir):
    a, b = chem.pair_key(F.col("species_i"), F.col("species_j"))
    return _pairs(spark, sf_dir).groupBy(a.alias("sa"), b.alias("sb")).agg(F.count("*").alias("n"))


_BLOCKS = f"sp(pi, p) AS (VALUES (0, 2.0::DOUBLE), (1, 4.5::DOUBLE)), blocks(sa, sb, b) AS (VALUES ('A', 'A', 0), ('A', 'B', 1), ('B', 'A', 2), ('B', 'B', 3)), f AS (SELECT label, i AS atom, sa, sb, b, p, 3 + b * 2 + pi AS slot, sum(pow({_F2}, p)) AS value FROM prs, sp, blocks WHERE species_i = sa AND species_j = sb GROUP BY ALL)"


@query(f"WITH {_PAIRS}, {_BLOCKS} SELECT label, atom, '2-' || sa || '-' || sb || '-' || p AS name, round(value, 6) AS value FROM f")
def feature_names(spark, sf_dir):
    """Pair features under their names."""
    spec = _spec(spark)
    got = features.two_body_features(_pairs(spark, sf_dir), spec, _RC)
    return got.join(features.feature_names(spec), "slot").select("label", "atom", "name", _r("value", "value"))


@query(f"WITH {_PAIRS}, {_BLOCKS} SELECT label, atom, slot, 3 + b * 2 AS first, 4 + b * 2 AS last, 8 AS n FROM f")
def feature_slots(spark, sf_dir):
    """Pair features with the ends of their block and the number of pair slots."""
    spec = _spec(spark)
    got = features.two_body_features(_pairs(spark, sf_dir), spec, _RC)
    slots = features.feature_slots(spec).filter("body = 2").select("body", "first", "last")
    sizes = features.feature_sizes(spec).select("body", "n")
    return got.join(F.broadcast(slots.join(sizes, "body")), F.col("slot").between(F.col("first"), F.col("last"))).select("label", "atom", "slot", "first", "last", F.col("n").cast("int").alias("n"))


@query(f"WITH {_PAIRS}, {_BLOCKS} SELECT label, atom, slot, round(value, 6) AS value FROM f")
def merge_feature_specs(spark, sf_dir):
    """Pair features of two specifications put together."""
    one, two = (features.build_feature_spec(spark, ["A", "B"], [p], [2.0], [1.0]) for p in (2.0, 4.5))
    return features.two_body_features(_pairs(spark, sf_dir), features.merge_feature_specs(one, two), _RC).select("label", "atom", "slot", _r("value", "value"))


# --- datasets -----------------------------------------------------------------------------------


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS k, count(*) OVER () AS total FROM orders) SELECT o_orderkey, o_orderkey % 3 AS gen, CASE WHEN k <= floor(total * 0.8::DOUBLE) + floor(total * 0.1::DOUBLE) THEN 'test' ELSE 'validate' END AS part FROM n WHERE o_orderkey % 3 < 2 AND k > floor(total * 0.8::DOUBLE) AND k <= floor(total * 0.8::DOUBLE) + 2 * floor(total * 0.1::DOUBLE)")
def load_dataset(spark, sf_dir):
    """Orders written in three parts, two of them loaded for two generations."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("gen"))
    path = scratch(spark, "dataset")
    datasets.write_dataset(rows, path, "o_orderkey")
    got = datasets.load_dataset(spark, path, ("test", "validate"), [0, 1])
    return got.join(datasets.load_manifest(spark, path).withColumnRenamed("part", "listed"), "o_orderkey").filter("part = listed").select("o_orderkey", F.col("gen").cast("long").alias("gen"), "part")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3)")
def filter_generations(spark, sf_dir):
    return datasets.filter_generations(table(spark, sf_dir, "lineitem"), [1, 3], "l_linenumber").select("l_orderkey", "l_linenumber")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def invert_standardizer(spark, sf_dir):
    """Vectors standardised and taken back."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    fitted = datasets.fit_standardizer(e, "embedding")
    got = datasets.invert_standardizer(datasets.apply_standardizer(e, "embedding", fitted, n), "embedding", fitted, n)
    return got.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("WITH s AS (SELECT avg(p_retailprice / p_size) AS m, stddev_samp(p_retailprice / p_size) AS d FROM part) SELECT p_partkey, round((p_retailprice / p_size - m) / d * p_size, 5) AS y FROM part, s")
def transform_y(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mean, std = datasets.fit_target_standardizer(part, "p_retailprice", "p_size")
    return part.select("p_partkey", F.round(datasets.transform_y(F.col("p_retailprice"), F.col("p_size"), mean, std), 5).alias("y"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS one, round(embedding[4]::DOUBLE * 0.5 + embedding[5]::DOUBLE * -1.0, 6) AS pair, round(embedding[6]::DOUBLE * 2.0 + embedding[7]::DOUBLE * 0.25, 6) AS triplet, 4 AS n FROM embeddings")
def embed_two_matrices(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", 1, 7))
    got = datasets.embed_features(e, "embedding", 1, [[0.5], [-1.0]], 4, [[2.0], [0.25]])
    return got.select("vec_id", _r(F.col("embedding")[0], "one"), _r(F.col("embedding")[2], "pair"), _r(F.col("embedding")[3], "triplet"), F.size("embedding").alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def load_features(spark, sf_dir):
    """Feature vectors saved with a version and loaded again."""
    path = scratch(spark, "features")
    datasets.save_features(table(spark, sf_dir, "embeddings"), path, "2.0")
    return datasets.load_features(spark, path, "2.0").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# --- models ----------------------------------------------------------------------------------------


@query(f"WITH {_SCORES}, t AS (SELECT label, count(*) AS natoms, sum(embedding[1]::DOUBLE) AS target FROM embeddings GROUP BY label) SELECT label, 'L' || label % 2 AS formula, t.natoms::DOUBLE AS natoms, round(target, 5) AS target, round(energy, 5) AS pred FROM t JOIN s USING (label) WHERE model_id = 'm1'")
def evaluate_model(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    known = e.groupBy("label").agg(F.count("*").alias("natoms"), F.sum(F.col("embedding")[0].cast("double")).alias("target")).withColumn("formula", F.concat(F.lit("L"), F.col("label") % 2))
    got = models.evaluate_model(models.score_linear(_vectors(spark, sf_dir), "label", "fvec", _W["m1"]), known, "label", "target", "natoms", "formula")
    return got.select("label", "formula", "natoms", F.round("target", 5).alias("target"), F.round("pred", 5).alias("pred"))


@query("SELECT o_orderkey AS label, round(sum(l_extendedprice), 2) AS pred, any_value(round(o_totalprice, 2)) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_predictions_structures(spark, sf_dir):
    pred = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("label")).agg(F.round(F.sum("l_extendedprice"), 2).alias("pred"))
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.round("o_totalprice", 2).alias("volume"))
    return models.join_predictions_structures(pred, cells)


@query(f"WITH {_STD}, z AS (SELECT label, list((x - mean) / std ORDER BY slot) AS v FROM embeddings e JOIN u USING (vec_id) JOIN f USING (slot) WHERE slot <= 3 GROUP BY vec_id, label) SELECT label, round(sum((0.7 * tanh(0.5 * v[1] - 0.2 * v[2] + 0.1 * v[3] + 0.05) - 1.2 * tanh(v[2] - 0.3 * v[3] - 0.1) + 0.4) * 2.5 - 0.75), 4) AS energy FROM z GROUP BY label")
def score_mlp_scaled(spark, sf_dir):
    """A network behind the inputs' and before the outputs' standardisation."""
    layers = [([[0.5, -0.2, 0.1], [0.0, 1.0, -0.3]], [0.05, -0.1], "tanh"), ([[0.7, -1.2]], [0.4], "linear")]
    # three rows
    fitted = datasets.fit_standardizer(_vectors(spark, sf_dir), "fvec").orderBy("slot").collect()
    got = models.score_mlp(_vectors(spark, sf_dir), "label", "fvec", layers, [r["mean"] for r in fitted], [r["std"] for r in fitted], -0.75, 2.5)
    return got.select("label", F.round("energy", 4).alias("energy"))


@query("WITH f AS (SELECT label, vec_id, w, embedding[1]::DOUBLE * w AS fx, embedding[2]::DOUBLE * w * w AS fy, embedding[3]::DOUBLE AS fz FROM embeddings, (VALUES (1.0::DOUBLE), (0.9::DOUBLE), (1.2::DOUBLE)) m(w)), d AS (SELECT label, sqrt(pow(fx - avg(fx) OVER a, 2) + pow(fy - avg(fy) OVER a, 2) + pow(fz - avg(fz) OVER a, 2)) AS d FROM f WINDOW a AS (PARTITION BY label, vec_id)) SELECT label, round(max(d), 6) AS error FROM d GROUP BY label")
def committee_force_error(spark, sf_dir):
    e, w = table(spark, sf_dir, "embeddings"), F.col("w")
    part = lambda k: F.col("embedding")[k].cast("double")
    forces = e.withColumn("w", F.explode(F.array(*map(F.lit, (1.0, 0.9, 1.2))))).select("label", F.col("vec_id").alias("atom"), w.cast("string").alias("model_id"), (part(0) * w).alias("fx"), (part(1) * w * w).alias("fy"), part(2).alias("fz"))
    return models.committee_force_error(forces, "label").select("label", _r("error", "error"))


# --- sources and streams ---------------------------------------------------------------------------


def _record_texts(spark, sf_dir):
    """Record texts of two atoms, one for each part."""
    second = F.when(F.col("p_size") % 2 == 0, "B").otherwise("A")
    title = F.concat_ws(" ", F.lit("TITL"), F.concat(F.lit("rec-"), F.col("p_partkey")), F.lit("0.0"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("0 0 2 (P1) n - 1"))
    cell = F.concat_ws(" ", F.lit("CELL 1.54180 3 4"), F.col("p_size").cast("string"), F.lit("90 90 90"))
    second = F.concat_ws(" ", second, F.lit("2 0.5 0.5"), (F.col("p_size") / 64.0).cast("string"), F.lit("1.0"))
    return table(spark, sf_dir, "part").select(F.concat_ws("\n", title, cell, F.lit("LATT -1"), F.lit("SFAC A B"), F.lit("A 1 0.0 0.0 0.0 1.0"), second, F.lit("END")).alias("text"))


@query("WITH r AS (SELECT 'rec-' || p_partkey AS label, CASE WHEN p_size % 2 = 0 THEN 'AB' ELSE 'A' END AS f, (p_retailprice + p_size * (25.0 / 160.21766208)) / 2 AS e FROM part) SELECT label, f AS reduced_formula, round(e, 6) AS corrected FROM (SELECT *, min(e) OVER (PARTITION BY f) AS m FROM r) WHERE e < m + 300")
def load_structures(spark, sf_dir):
    """Record files found by a glob, with threshold and pressure."""
    path = scratch(spark, "records")
    shelx.write_records(_record_texts(spark, sf_dir), path)
    return shelx.load_structures(spark, f"{path}/part-*", 300.0, 25.0).select("label", "reduced_formula", _r("corrected", "corrected"))


@query("SELECT 'rec-' || p_partkey AS label, CAST(a AS INTEGER) AS atom, CASE WHEN a = 2 AND p_size % 2 = 0 THEN 'B' ELSE 'A' END AS species, CASE a WHEN 1 THEN 0.0 ELSE round(p_size / 64.0::DOUBLE, 9) END AS fz, round(12.0::DOUBLE * p_size, 6) AS volume FROM part, range(1, 3) t(a)")
def scan_shelx_structures(spark, sf_dir):
    """Structures parsed from record texts, written out and parsed again."""
    path = scratch(spark, "records")
    shelx.write_records(_record_texts(spark, sf_dir), path)
    first = shelx.scan_shelx_headers(spark, path)
    cells, atoms = shelx.parse_structures(first)
    header = ["label", "pressure", "volume", "enthalpy", "spin", "abs_spin", "natoms", "symm", "flag1", "flag2", "flag3"]
    again = scratch(spark, "records")
    shelx.write_records(shelx.render_records(first.select(*header).join(cells, "label"), atoms, header), again)
    cells, atoms = shelx.parse_structures(shelx.scan_shelx_headers(spark, again))
    return atoms.join(cells, "label").select("label", "atom", "species", F.round("fz", 9).alias("fz"), _r("cell_volume", "volume"))


@query("SELECT 'rec-' || p_partkey AS label, round(p_retailprice, 6) AS enthalpy, 2 AS natoms, CASE WHEN p_size % 2 = 0 THEN 'AB' ELSE 'A2' END AS formula FROM part")
def scan_extxyz(spark, sf_dir):
    """Frames made of the parts table, packed in files and read as records."""
    part = table(spark, sf_dir, "part")
    info = F.concat(F.lit("name=rec-"), F.col("p_partkey"), F.lit(" energy="), F.col("p_retailprice").cast("string"), F.lit(' spacegroup="P1"'))
    second = F.concat(F.when(F.col("p_size") % 2 == 0, "B").otherwise("A"), F.lit(" 0.5 0.5 0.5"))
    path = scratch(spark, "frames")
    part.select(F.concat_ws("\n", F.lit("2"), info, F.lit("A 0.0 0.0 0.0"), second).alias("value")).write.text(path)
    return texts.extxyz_to_records(texts.scan_extxyz(spark, path)).select("label", _r("enthalpy", "enthalpy"), "natoms", "formula")


@query("SELECT round(p_retailprice, 6) AS energy, CASE WHEN p_size % 2 = 0 THEN 'AB' ELSE 'A' END AS species, round(p_size / 64.0::DOUBLE, 6) AS fz, round(p_retailprice / 1000 + p_size, 4) AS pressure, count(*) AS n FROM part GROUP BY ALL")
def scan_castep_frames(spark, sf_dir):
    """Calculation logs made of the parts table, many frames a file, read frame by frame."""
    part = table(spark, sf_dir, "part")
    row = lambda *parts: F.concat_ws(" ", F.lit(" *"), *(x if not isinstance(x, str) else F.lit(x) for x in parts), F.lit("*"))
    z = (F.col("p_size") / 64.0).cast("string")
    second = F.when(F.col("p_size") % 2 == 0, row("B", "1", "0.5", "0.5", "-0.25"))
    stress = F.round(F.col("p_retailprice") / 1000 + F.col("p_size"), 4).cast("decimal(20,4)").cast("string")
    text = F.concat_ws("\n", F.lit("Title"), F.concat(F.lit("Final free energy (E-TS)    =  "), F.col("p_retailprice").cast("decimal(20,6)").cast("string"), F.lit("     eV")), row("A", "1", "0.5", "-0.5", z), second, row("x", stress, "0.0", "0.0"), row("y", "0.0", stress, "0.0"), row("z", "0.0", "0.0", stress))
    path = scratch(spark, "logs")
    part.select(text.alias("value")).write.text(path)
    got = texts.scan_castep_frames(spark, path)
    trace = sum((F.col("stress")[k][k] for k in range(3)), F.lit(0.0)) / 3
    told = got.select(F.round("energy", 6).alias("energy"), F.array_join("species", "").alias("species"), _r(F.col("forces")[0][2], "fz"), F.round(trace, 4).alias("pressure"))
    return told.groupBy("energy", "species", "fz", "pressure").agg(F.count("*").alias("n"))


@query("SELECT event_type AS gen, count(*) AS n_structures, count(*) FILTER (value > 50) AS n_done FROM events GROUP BY 1")
def stream_generation_progress(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "gen")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(_as_folder(events.repartition(4, "event_id"), scratch(spark, "events")))
    out = scratch(spark, "progress")
    jobs.stream_generation_progress(stream, "gen", F.col("value") > 50, out, scratch(spark, "checkpoint")).awaitTermination()
    return jobs.latest_progress(spark, out, "gen")
