"""Queries over the given tables, each beside its DuckDB form.

Operators take column names, so the tables stand in for record tables: parts by
brand for records by formula, lineitem rows for predictions, embeddings for
atoms in a box and for feature vectors, events for arriving records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem
from ..operators import datasets, dense, evaluate, features, fitting, forces, generate, hull, leaders, models, neighbours, networks, records, similarity
from ..sources import shelx, texts
from ..streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, name: str):
    return F.round(c, 6).alias(name)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("label"),
        F.col("l_returnflag").alias("formula"),
        F.col("l_linenumber").cast("double").alias("natoms"),
        F.col("l_extendedprice").alias("target"),
        (F.col("l_quantity") * 1500.0).alias("pred"),
    )


PRED = "p AS (SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS label, l_returnflag AS formula, CAST(l_linenumber AS DOUBLE) AS natoms, l_extendedprice AS target, l_quantity * 1500.0::DOUBLE AS pred FROM lineitem), q AS (SELECT *, target / natoms AS t, pred / natoms AS p FROM p)"


# --- records ----------------------------------------------------------------------


@query("SELECT p_partkey, p_brand, round(p_retailprice, 6) AS value FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_retailprice < m + 100")
def filter_group_threshold(spark, sf_dir):
    got = records.filter_group_threshold(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 100.0)
    return got.select("p_partkey", "p_brand", _r("p_retailprice", "value"))


@query("SELECT p_partkey, p_brand FROM (SELECT *, median(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_retailprice < m + 10")
def filter_group_threshold_median(spark, sf_dir):
    return records.filter_group_threshold(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", 10.0, F.median).select("p_partkey", "p_brand")


@query("SELECT p_partkey, round((p_retailprice + p_size * (25.0 / 160.21766208)) / 4, 6) AS corrected FROM part")
def pressure_corrected_enthalpy(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("n", F.lit(4))
    return records.pressure_corrected_enthalpy(rows, "p_retailprice", "p_size", "n", 25.0).select("p_partkey", _r("corrected", "corrected"))


@query("SELECT o_orderpriority AS priority, o_orderkey AS best, round(o_totalprice, 6) AS least FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1")
def min_energy_records(spark, sf_dir):
    got = records.min_energy_records(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return got.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("best"), _r("o_totalprice", "least"))


@query("SELECT o_orderkey, round(exp(-(o_totalprice / 100 - (SELECT min(o_totalprice / 100) FROM orders)) / 500.0), 6) AS weight FROM orders")
def boltzmann_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("n", F.lit(100))
    return records.boltzmann_weights(rows, "o_totalprice", "n", 500.0).select("o_orderkey", _r("weight", "weight"))


@query("SELECT count(DISTINCT o_orderpriority) > 1 AS multiple FROM orders")
def has_multiple_compositions(spark, sf_dir):
    return records.has_multiple_compositions(table(spark, sf_dir, "orders"), "o_orderpriority")


_GREEDY = """
WITH RECURSIVE o AS (SELECT p_brand, p_partkey, p_retailprice, CAST(p_size AS DOUBLE) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM part),
g AS (SELECT p_brand, k, p_partkey, true AS lead, p_partkey AS cluster, [{'e': p_retailprice, 's': s, 'l': p_partkey}] AS ls FROM o WHERE k = 1
      UNION ALL
      SELECT o.p_brand, o.k, o.p_partkey, len(near) = 0, CASE WHEN len(near) = 0 THEN o.p_partkey ELSE near[-1].l END,
             CASE WHEN len(near) = 0 THEN list_append(ls, {'e': o.p_retailprice, 's': o.s, 'l': o.p_partkey}) ELSE ls END
      FROM (SELECT g.ls, o.*, list_filter(g.ls, lambda x: sqrt((x.e - o.p_retailprice) * (x.e - o.p_retailprice) + (x.s - o.s) * (x.s - o.s)) < 30) AS near
            FROM g JOIN o ON g.p_brand = o.p_brand AND o.k = g.k + 1) AS o)
"""


@query(_GREEDY + "SELECT p_brand, p_partkey, cluster, lead AS is_leader FROM g")
def dedupe_greedy(spark, sf_dir):
    return leaders.dedupe_greedy(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", ["p_retailprice", "p_size"], 30.0)


@query(_GREEDY + "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY k) AS n FROM g WHERE lead) WHERE n <= 10")
def select_refine(spark, sf_dir):
    return leaders.select_refine(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "p_partkey", ["p_retailprice", "p_size"], 30.0, 10).select("p_brand", "p_partkey")


@query("SELECT count(*) AS n, max(l_linenumber) AS max_size, min(l_linenumber) AS min_size, round(max(l_extendedprice / l_linenumber), 6) AS max_per_atom, round(min(l_extendedprice / l_linenumber), 6) AS min_per_atom FROM lineitem")
def container_summary(spark, sf_dir):
    got = records.container_summary(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice")
    return got.select("n", "max_size", "min_size", _r("max_per_atom", "max_per_atom"), _r("min_per_atom", "min_per_atom"))


@query("WITH c AS (SELECT l_linenumber AS gen, count(*) AS n_structures, count(*) FILTER (l_linestatus = 'F') AS n_done FROM lineitem GROUP BY 1) SELECT *, n_done / n_structures > 0.5 AS ready FROM c")
def generation_counts(spark, sf_dir):
    counts = records.generation_counts(table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "gen"), "gen", F.col("l_linestatus") == "F")
    return records.completion_ready(counts, F.col("n_structures"), 0.5)


@query("SELECT max(l_linenumber) AS latest, max(l_linenumber) + 1 AS next FROM lineitem")
def latest_generation(spark, sf_dir):
    return records.latest_generation(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("WITH h AS (SELECT CAST(event_id AS BIGINT) AS step, round(avg(value) OVER (ORDER BY event_id ROWS 9 PRECEDING), 9) AS m FROM events) SELECT arg_min(step, (m, step)) AS best, max(step) AS last, max(step) - arg_min(step, (m, step)) > 50 AS stop FROM h")
def early_stop_point(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), "value")
    history = datasets.moving_average(events, "step", "value", 10, "m").select("step", F.round("m", 9).alias("m"))
    return records.early_stop_point(history, "step", "m", 50)


@query("WITH w AS (SELECT o_orderpriority AS l, min(o_orderkey) AS o FROM orders GROUP BY 1), v(l, pos) AS (VALUES ('5-LOW', 0), ('1-URGENT', 1), ('nothing', 2), ('5-LOW', 3)) SELECT v.pos, o_orderkey, o_orderpriority FROM v JOIN w USING (l) JOIN orders ON o_orderkey = w.o")
def select_by_label(spark, sf_dir):
    wanted = spark.createDataFrame([("5-LOW", 0), ("1-URGENT", 1), ("nothing", 2), ("5-LOW", 3)], "o_orderpriority string, pos int")
    return records.select_by_label(table(spark, sf_dir, "orders"), wanted, "o_orderpriority", "pos", "o_orderkey").select("pos", "o_orderkey", "o_orderpriority")


@query("WITH w AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber, l_orderkey, l_partkey) AS k FROM lineitem), v(l, pos) AS (VALUES ('A', 0), ('R', 1), ('nothing', 2), ('A', 3)) SELECT v.pos, l_returnflag, l_linenumber, l_orderkey, l_partkey FROM v JOIN w ON l = l_returnflag WHERE k = 1")
def select_by_label_repeated(spark, sf_dir):
    """Records whose labels and places in the order both repeat."""
    wanted = spark.createDataFrame([("A", 0), ("R", 1), ("nothing", 2), ("A", 3)], "l_returnflag string, pos int")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber", "l_orderkey", "l_partkey")
    return records.select_by_label(rows, wanted, "l_returnflag", "pos", "l_linenumber")


# --- compositions and other column functions -----------------------------------------

_COMP = "c AS (SELECT l_orderkey, list_sort(list({'k': l_returnflag, 'v': n})) AS m, sum(n) AS total FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1), d AS (SELECT *, list_reduce(list_transform(m, lambda x: x.v), lambda a, b: gcd(a, b)) AS g FROM c)"


@query(f"WITH {_COMP} SELECT l_orderkey, CAST(g AS BIGINT) AS nform, list_aggregate(list_transform(m, lambda x: x.k || CASE WHEN x.v = 1 THEN '' ELSE CAST(x.v AS VARCHAR) END), 'string_agg', '') AS formula, list_aggregate(list_transform(m, lambda x: x.k || CASE WHEN x.v // g = 1 THEN '' ELSE CAST(x.v // g AS VARCHAR) END), 'string_agg', '') AS reduced FROM d")
def composition_formula(spark, sf_dir):
    comp = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("s")).withColumn("c", chem.composition_of(F.col("s")))
    return comp.select("l_orderkey", chem.formula_units(F.col("c")).alias("nform"), chem.formula_string(F.col("c")).alias("formula"), chem.formula_string(chem.reduce_composition(F.col("c"))).alias("reduced"))


@query(f"WITH {_COMP} SELECT l_orderkey, round(coalesce(list_filter(m, lambda x: x.k = 'N')[1].v, 0) / total, 6) AS n, round(coalesce(list_filter(m, lambda x: x.k = 'R')[1].v, 0) / total, 6) AS r, round(coalesce(list_filter(m, lambda x: x.k = 'A')[1].v, 0) * 1.5 + coalesce(list_filter(m, lambda x: x.k = 'N')[1].v, 0) * 2.25, 6) AS reference FROM c")
def composition_coords(spark, sf_dir):
    comp = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("s")).withColumn("c", chem.composition_of(F.col("s")))
    xy = chem.composition_coords(F.col("c"), ["A", "N", "R"])
    return comp.select("l_orderkey", _r(xy[0], "n"), _r(xy[1], "r"), _r(chem.elemental_sum(F.col("c"), {"A": 1.5, "N": 2.25}), "reference"))


@query("SELECT p_partkey, round(CASE WHEN p_size <= 30 THEN 2 * (1 - p_size / 30.0) ELSE 0 END, 6) AS fr, round(CASE WHEN p_size <= 30 THEN -2.0 / 30 ELSE 0 END, 6) AS gfr, round(ln(1 + CASE WHEN p_size < 40 THEN pow(2 * (40.0::DOUBLE / p_size - 1), 12) ELSE 0 END), 6) AS log_core, round(p_retailprice * 160.21766208, 4) AS gpa FROM part")
def radial_functions(spark, sf_dir):
    r = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", _r(chem.cutoff_fr(r, 30.0), "fr"), _r(chem.cutoff_gfr(r, 30.0), "gfr"), _r(F.log1p(chem.core_repulsion(r, 40.0)), "log_core"), F.round(chem.ev_ang3_to_gpa(F.col("p_retailprice")), 4).alias("gpa"))


@query("SELECT doc_id, regexp_replace('run/' || source || '-shake-' || lang || '-shake-1', '^(.*)-shake.*$', '\\1') AS parent, source || '.' || lang AS stem, 'run/' || source || '.' || lang || '.xyz' AS swapped FROM documents")
def label_functions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("run/"), "source", F.lit("."), "lang", F.lit(".res"))
    shaken = F.concat(F.lit("run/"), "source", F.lit("-shake-"), "lang", F.lit("-shake-1"))
    return docs.select("doc_id", chem.shake_parent_label(shaken).alias("parent"), chem.file_stem(path).alias("stem"), chem.swap_extension(path, "xyz").alias("swapped"))


# --- hull -----------------------------------------------------------------------------

_HULL = """
pts AS (SELECT p_size AS key, p_size / 51.0::DOUBLE AS x, (min(p_retailprice) - 1500.0::DOUBLE) / 100 AS e FROM part GROUP BY p_size
        UNION ALL VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (51, 1.0::DOUBLE, 0.0::DOUBLE)),
seg AS (SELECT a.key AS ka, b.key AS kb, a.x AS xa, b.x AS xb, a.e AS ea, b.e AS eb FROM pts a JOIN pts b ON a.key < b.key WHERE a.e <= 0 AND b.e <= 0 AND abs(b.x - a.x) >= 1e-12),
h AS (SELECT key, min((1 - (x - xa) / (xb - xa)) * ea + (x - xa) / (xb - xa) * eb) AS hull FROM pts JOIN seg ON (x - xa) / (xb - xa) > -1e-8 AND 1 - (x - xa) / (xb - xa) > -1e-8 GROUP BY key)
"""


def _hull_points(spark, sf_dir):
    part = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("key")).agg(((F.min("p_retailprice") - 1500.0) / 100).alias("e"))
    ends = spark.createDataFrame([(0, 0.0), (51, 0.0)], "key int, e double")
    return part.unionByName(ends).withColumn("x", F.col("key") / 51.0)


@query(f"WITH {_HULL} SELECT key, round(x, 6) AS x, round(e, 6) AS e, round(e - hull, 6) AS e_above_hull, coalesce(abs(e - hull) <= 1e-8, false) AS stable FROM pts LEFT JOIN h USING (key)")
def binary_hull_table(spark, sf_dir):
    pts = _hull_points(spark, sf_dir)
    got = hull.stable_mask(hull.e_above_hull(pts, pts, ["x"], "e"))
    return got.select("key", _r("x", "x"), _r("e", "e"), _r("e_above_hull", "e_above_hull"), "stable")


@query(f"WITH {_HULL} SELECT key, round(e - hull, 6) AS e_above_hull FROM pts JOIN h USING (key) WHERE e - hull < 0.5")
def filter_above_hull(spark, sf_dir):
    pts = _hull_points(spark, sf_dir)
    return hull.filter_above_hull(hull.e_above_hull(pts, pts, ["x"], "e")).select("key", _r("e_above_hull", "e_above_hull"))


_TERN = """
pts AS (SELECT s * 10 + b AS key, s / 6.0::DOUBLE AS x, b / 12.0::DOUBLE AS y, (min(p_retailprice) - 1200.0::DOUBLE) / 100 AS e
        FROM (SELECT p_retailprice, p_size % 4 AS s, p_partkey % 5 AS b FROM part) GROUP BY s, b
        UNION ALL VALUES (900, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (901, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (902, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE)),
v AS (SELECT * FROM pts WHERE e <= 0),
t AS (SELECT a.x AS xa, a.y AS ya, a.e AS ea, b.x AS xb, b.y AS yb, b.e AS eb, c.x AS xc, c.y AS yc, c.e AS ec, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS det
      FROM v a JOIN v b ON a.key < b.key JOIN v c ON b.key < c.key),
m AS (SELECT key, e, ((x - xa) * (yc - ya) - (y - ya) * (xc - xa)) / det AS b1, ((xb - xa) * (y - ya) - (yb - ya) * (x - xa)) / det AS b2, ea, eb, ec FROM pts JOIN (SELECT * FROM t WHERE abs(det) >= 1e-12) ON true),
h AS (SELECT key, min((1 - (b1 + b2)) * ea + b1 * eb + b2 * ec) AS hull FROM m WHERE b1 > -1e-8 AND b2 > -1e-8 AND 1 - (b1 + b2) > -1e-8 GROUP BY key)
"""


@query(f"WITH {_TERN} SELECT key, round(e, 6) AS e, round(e - hull, 6) AS e_above_hull FROM pts LEFT JOIN h USING (key)")
def ternary_hull_table(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_retailprice", (F.col("p_size") % 4).alias("s"), (F.col("p_partkey") % 5).alias("b"))
    least = part.groupBy("s", "b").agg(((F.min("p_retailprice") - 1200.0) / 100).alias("e"))
    pts = least.select((F.col("s") * 10 + F.col("b")).alias("key"), (F.col("s") / 6.0).alias("x"), (F.col("b") / 12.0).alias("y"), "e")
    pts = pts.unionByName(spark.createDataFrame([(900, 0.0, 0.0, 0.0), (901, 1.0, 0.0, 0.0), (902, 0.0, 1.0, 0.0)], "key long, x double, y double, e double"))
    return hull.e_above_hull(pts, pts, ["x", "y"], "e").select("key", _r("e", "e"), _r("e_above_hull", "e_above_hull"))


@query("""
WITH c AS (SELECT l_orderkey AS key, l_returnflag AS element, count(*) AS n, sum(l_extendedprice) AS part FROM lineitem GROUP BY ALL),
r AS (SELECT key, sum(part) AS e, sum(n) AS natoms, count(*) AS kinds, min(element) AS element FROM c GROUP BY key),
mu AS (SELECT element, min(e / natoms) AS mu FROM r WHERE kinds = 1 GROUP BY element)
SELECT key, round((any_value(e) - sum(n * mu)) / any_value(natoms), 6) AS formation FROM c JOIN r USING (key) JOIN mu ON c.element = mu.element GROUP BY key
""")
def formation_energy(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("element")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("part"))
    rows = counts.groupBy("key").agg(F.sum("part").alias("e"), F.sum("n").alias("natoms"), F.count("*").alias("kinds"), F.min("element").alias("element"))
    mu = hull.elemental_references(rows.withColumn("per", F.col("e") / F.col("natoms")), F.col("kinds") == 1, "element", "per")
    return hull.formation_energy(rows.select("key", "e"), counts.select("key", "element", "n"), mu, "key", "e").select("key", F.round("formation", 6).alias("formation"))


# --- evaluation -------------------------------------------------------------------------


@query(f"WITH {PRED} SELECT round(sqrt(avg(pow((pred - target) / natoms, 2))), 4) AS rmse, round(avg(abs((pred - target) / natoms)), 4) AS mae, round(max(abs((pred - target) / natoms)), 4) AS max_ae FROM p")
def regression_errors(spark, sf_dir):
    got = evaluate.regression_errors(_predictions(spark, sf_dir))
    return got.select(*(F.round(c, 4).alias(c) for c in ("rmse", "mae", "max_ae")))


@query(f"WITH {PRED} SELECT label, round(abs(pred - target) / natoms, 4) AS max_error_per_atom FROM p ORDER BY abs(pred - target) DESC, label LIMIT 1")
def worst_structure(spark, sf_dir):
    return evaluate.worst_structure(_predictions(spark, sf_dir), "label").select("label", F.round("max_error_per_atom", 4).alias("max_error_per_atom"))


@query(f"WITH {PRED}, m AS (SELECT *, avg(t) OVER (PARTITION BY formula) AS mean FROM q) SELECT formula, round(1 - sum(pow(t - p, 2)) / sum(pow(t - mean, 2)), 6) AS r2 FROM m GROUP BY formula")
def r2_by_composition(spark, sf_dir):
    return evaluate.r2_by_composition(_predictions(spark, sf_dir)).select("formula", _r("r2", "r2"))


_SPEAR = f"{PRED}, k AS (SELECT *, rank() OVER (PARTITION BY formula ORDER BY t) + (count(*) OVER (PARTITION BY formula, t) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY formula ORDER BY p) + (count(*) OVER (PARTITION BY formula, p) - 1) / 2.0 AS rp FROM q)"


@query(f"WITH {_SPEAR} SELECT formula, round(corr(rt, rp), 6) AS spearman FROM k GROUP BY formula")
def spearman_by_composition(spark, sf_dir):
    return evaluate.spearman_by_composition(_predictions(spark, sf_dir)).select("formula", _r("spearman", "spearman"))


@query(f"WITH {_SPEAR}, s AS (SELECT avg(c) AS spearman FROM (SELECT corr(rt, rp) AS c FROM k GROUP BY formula)) SELECT count(*) AS n, count(DISTINCT formula) AS n_formulas, round(sqrt(avg(pow(p - t, 2))), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, round(any_value(spearman), 6) AS spearman FROM q, s")
def evaluation_summary(spark, sf_dir):
    got = evaluate.evaluation_summary(_predictions(spark, sf_dir), "label")
    return got.select("n", "n_formulas", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), _r("spearman", "spearman"))


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY round(value)) + (count(*) OVER (PARTITION BY event_type, round(value)) - 1) / 2.0::DOUBLE AS rank FROM events")
def tied_rank(spark, sf_dir):
    return evaluate.tied_rank(table(spark, sf_dir, "events").withColumn("v", F.round("value")), "event_type", "v", "rank").select("event_id", F.col("rank").cast("double").alias("rank"))


@query(f"WITH {PRED} SELECT label, round(t - min(t) OVER (PARTITION BY formula), 4) AS rel_target, round(p - min(t) OVER (PARTITION BY formula), 4) AS rel_pred FROM q")
def relative_energies(spark, sf_dir):
    return evaluate.relative_energies(_predictions(spark, sf_dir)).select("label", F.round("rel_target", 4).alias("rel_target"), F.round("rel_pred", 4).alias("rel_pred"))


@query(f"WITH {PRED}, e AS (SELECT t - min(t) OVER (PARTITION BY formula) AS rt, p - t AS d FROM q), c AS (SELECT 0.0::DOUBLE + k * (30000.0::DOUBLE / 99) AS cutoff FROM range(100) r(k)) SELECT round(cutoff, 6) AS cutoff, count(rt) AS n, round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse FROM c LEFT JOIN e ON rt < c.cutoff GROUP BY c.cutoff")
def threshold_curve(spark, sf_dir):
    got = evaluate.threshold_curve(evaluate.relative_energies(_predictions(spark, sf_dir)), 0.0, 30000.0, 100)
    return got.select(_r("cutoff", "cutoff"), "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("SELECT event_type, CAST(least(floor((value - 0) / (200.0 / 99)), 98) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 200 GROUP BY ALL")
def histogram(spark, sf_dir):
    return evaluate.histogram(table(spark, sf_dir, "events"), "value", 0.0, 200.0, 99, ("event_type",))


@query("SELECT CAST(least(floor(l_quantity / (50.0 / 20)), 19) AS INTEGER) AS bin_x, CAST(least(floor(l_discount / (0.1 / 20)), 19) AS INTEGER) AS bin_y, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0 AND 0.1::DOUBLE GROUP BY ALL")
def histogram2d(spark, sf_dir):
    return evaluate.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (0.0, 50.0), (0.0, 0.1), 20)


@query("WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS e FROM lineitem GROUP BY 1) SELECT round(sum(pow(abs(e - o_totalprice), 0.5)), 3) AS loss FROM s JOIN orders ON l_orderkey = o_orderkey")
def loss_power(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return evaluate.loss_power(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", orders, "o_totalprice", 0.5).select(F.round("loss", 3).alias("loss"))


# --- neighbours and features ----------------------------------------------------------------

_BOX, _RC = 1.0, 0.15
_ATOMS = "a AS (SELECT label, vec_id AS atom, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CASE WHEN vec_id % 3 = 0 THEN 'B' ELSE 'A' END AS species FROM embeddings)"
_PAIRS = f"""{_ATOMS}, w AS (SELECT label, atom, species, x - floor(x) AS x, y - floor(y) AS y, z - floor(z) AS z FROM a),
im AS (SELECT i.v AS sx, j.v AS sy, k.v AS sz FROM (VALUES (-1), (0), (1)) i(v), (VALUES (-1), (0), (1)) j(v), (VALUES (-1), (0), (1)) k(v)),
pp AS (SELECT p.label, p.atom AS i, q.atom AS j, sx, sy, sz, p.species AS species_i, q.species AS species_j, q.x + sx - p.x AS dx, q.y + sy - p.y AS dy, q.z + sz - p.z AS dz FROM w p JOIN w q USING (label), im),
pr AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM pp), prs AS (SELECT * FROM pr WHERE r > 0 AND r <= {_RC})"""


def _atoms(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", F.col("vec_id").alias("atom"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), F.when(F.col("vec_id") % 3 == 0, "B").otherwise("A").alias("species"))


def _pairs(spark, sf_dir):
    return neighbours.neighbour_pairs(_atoms(spark, sf_dir), _RC, _BOX, keep=("species",))


@query(f"WITH {_PAIRS} SELECT label, i, j, sx, sy, sz, round(r, 6) AS r FROM prs")
def neighbour_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("label", "i", "j", "sx", "sy", "sz", _r("r", "r"))


_TRI = f"""{_PAIRS}, tr AS (SELECT label, a.i, a.j, b.j AS k, a.species_i, least(a.species_j, b.species_j) AS s1, greatest(a.species_j, b.species_j) AS s2, a.r AS rij, b.r AS rik,
 sqrt((a.dx - b.dx) ** 2 + (a.dy - b.dy) ** 2 + (a.dz - b.dz) ** 2) AS rjk FROM prs a JOIN prs b USING (label, i) WHERE (b.j, b.sx, b.sy, b.sz) > (a.j, a.sx, a.sy, a.sz)), trs AS (SELECT * FROM tr WHERE rjk > 0 AND rjk <= {_RC})"""


@query(f"WITH {_TRI} SELECT label, i, j, k, round(rij, 6) AS rij, round(rik, 6) AS rik, round(rjk, 6) AS rjk FROM trs")
def neighbour_triplets(spark, sf_dir):
    got = dense.triplets(_atoms(spark, sf_dir), _RC, _BOX)
    return got.select("label", "i", "j", "k", *(_r(c, c) for c in ("rij", "rik", "rjk")))


@query(f"WITH {_PAIRS} SELECT DISTINCT label FROM a WHERE label NOT IN (SELECT label FROM prs WHERE r < 0.03)")
def filter_min_separation(spark, sf_dir):
    return neighbours.filter_min_separation(_atoms(spark, sf_dir).select("label").distinct(), _pairs(spark, sf_dir), 0.03)


_SEP = f"""{_PAIRS}, se AS (SELECT label, least(species_i, species_j) AS sa, greatest(species_i, species_j) AS sb, min(r) AS minsep, avg(r) AS meansep, count(*) AS n FROM prs GROUP BY ALL),
gr AS (SELECT * FROM (SELECT DISTINCT label FROM a), (VALUES ('A', 'A'), ('A', 'B'), ('B', 'B')) v(sa, sb)),
full_ AS (SELECT label, sa, sb, coalesce(minsep, 999) AS minsep, coalesce(meansep, 0) AS meansep, coalesce(n, 0) AS n FROM gr LEFT JOIN se USING (label, sa, sb))"""


def _separations(spark, sf_dir):
    seen = neighbours.species_separations(_pairs(spark, sf_dir))
    labels = _atoms(spark, sf_dir).select("label").distinct()
    return neighbours.complete_separations(seen, labels, spark.createDataFrame([("A",), ("B",)], "species string"))


@query(f"WITH {_SEP} SELECT label, sa, sb, round(minsep, 6) AS minsep, round(meansep, 6) AS meansep, n FROM full_")
def species_separations(spark, sf_dir):
    return _separations(spark, sf_dir).select("label", "sa", "sb", _r("minsep", "minsep"), _r("meansep", "meansep"), "n")


@query(f"WITH {_SEP} SELECT sa, sb, count(*) AS n_structures, round(min(minsep), 6) AS least, round(avg(minsep), 6) AS mean_minsep, round(avg(meansep), 6) AS mean_meansep FROM full_ WHERE n > 0 GROUP BY ALL")
def gather_separation_stats(spark, sf_dir):
    got = neighbours.gather_separation_stats(_separations(spark, sf_dir))
    return got.select("sa", "sb", "n_structures", _r("least", "least"), _r("mean_minsep", "mean_minsep"), _r("mean_meansep", "mean_meansep"))


def _spec(spark):
    return features.build_feature_spec(spark, ["A", "B"], [2.0, 4.5], [2.0], [1.0, 3.0])


_F2 = f"(CASE WHEN r <= {_RC} THEN 2 * (1 - r / {_RC}) ELSE 0 END)"


@query(f"WITH {_PAIRS}, sp(pi, p) AS (VALUES (0, 2.0::DOUBLE), (1, 4.5::DOUBLE)), blocks(sa, sb, b) AS (VALUES ('A', 'A', 0), ('A', 'B', 1), ('B', 'A', 2), ('B', 'B', 3)) SELECT label, i AS atom, 3 + b * 2 + pi AS slot, round(sum(pow({_F2}, p)), 6) AS value FROM prs, sp, blocks WHERE species_i = sa AND species_j = sb GROUP BY ALL")
def two_body_features(spark, sf_dir):
    return features.two_body_features(_pairs(spark, sf_dir), _spec(spark), _RC).select("label", "atom", "slot", _r("value", "value"))


#: Another basis: the square of the default one.
_SQUARE = f"pow({_F2}, 2)"


@query(f"WITH {_PAIRS}, sp(pi, p) AS (VALUES (0, 2.0::DOUBLE), (1, 4.5::DOUBLE)), blocks(sa, sb, b) AS (VALUES ('A', 'A', 0), ('A', 'B', 1), ('B', 'A', 2), ('B', 'B', 3)) SELECT label, i AS atom, 3 + b * 2 + pi AS slot, round(sum(pow({_SQUARE}, p)), 6) AS value FROM prs, sp, blocks WHERE species_i = sa AND species_j = sb GROUP BY ALL")
def two_body_features_basis(spark, sf_dir):
    """Pair features of a basis function that the caller gives."""
    got = features.two_body_features(_pairs(spark, sf_dir), _spec(spark), _RC, lambda r, c: chem.cutoff_fr(r, c) ** 2)
    return got.select("label", "atom", "slot", _r("value", "value"))


@query(f"""WITH {_TRI}, qs(qi, q) AS (VALUES (0, 1.0::DOUBLE), (1, 3.0::DOUBLE)), blocks(c, s1, s2, b) AS (VALUES ('A', 'A', 'A', 0), ('A', 'A', 'B', 1), ('A', 'B', 'B', 2), ('B', 'A', 'A', 3), ('B', 'A', 'B', 4), ('B', 'B', 'B', 5))
SELECT label, i AS atom, 11 + b * 2 + qi AS slot, round(sum(pow({_F2.replace('r <=', 'rij <=').replace('r /', 'rij /')} * {_F2.replace('r <=', 'rik <=').replace('r /', 'rik /')}, 2.0) * pow({_F2.replace('r <=', 'rjk <=').replace('r /', 'rjk /')}, q)), 6) AS value
FROM trs t JOIN blocks b ON t.species_i = b.c AND t.s1 = b.s1 AND t.s2 = b.s2, qs GROUP BY ALL""")
def three_body_features(spark, sf_dir):
    return dense.neighbour_features(_atoms(spark, sf_dir), _spec(spark), _RC, _BOX, (3,)).select("label", "atom", "slot", _r("value", "value"))


def _f2(r: str) -> str:
    return _F2.replace("r <=", f"{r} <=").replace("r /", f"{r} /")


_SLOTS = f"""{_TRI}, two(sa, sb, b) AS (VALUES ('A', 'A', 0), ('A', 'B', 1), ('B', 'A', 2), ('B', 'B', 3)), ps(pi, p) AS (VALUES (0, 2.0::DOUBLE), (1, 4.5::DOUBLE)),
three(c, s1, s2, b) AS (VALUES ('A', 'A', 'A', 0), ('A', 'A', 'B', 1), ('A', 'B', 'B', 2), ('B', 'A', 'A', 3), ('B', 'A', 'B', 4), ('B', 'B', 'B', 5)), qs(qi, q) AS (VALUES (0, 1.0::DOUBLE), (1, 3.0::DOUBLE)),
v AS (SELECT label, atom, CASE species WHEN 'A' THEN 1 ELSE 2 END AS slot, 1.0::DOUBLE AS value FROM a
 UNION ALL SELECT label, i, 3 + b * 2 + pi, sum(pow({_F2}, p)) FROM prs JOIN two ON species_i = sa AND species_j = sb, ps GROUP BY ALL
 UNION ALL SELECT label, i, 11 + b * 2 + qi, sum(pow({_f2("rij")} * {_f2("rik")}, 2.0) * pow({_f2("rjk")}, q)) FROM trs t JOIN three ON t.species_i = three.c AND t.s1 = three.s1 AND t.s2 = three.s2, qs GROUP BY ALL)"""


@query(f"WITH {_SLOTS} SELECT a.label, a.atom, CAST(n AS INTEGER) AS slot, round(coalesce(value, 0), 6) AS value FROM a CROSS JOIN range(1, 23) r(n) LEFT JOIN v ON a.label = v.label AND a.atom = v.atom AND n = slot")
def feature_table(spark, sf_dir):
    """All slots of all atoms' vectors, noughts too."""
    atoms, spec = _atoms(spark, sf_dir), _spec(spark)
    parts = [features.one_body_features(atoms, spec), dense.neighbour_features(atoms, spec, _RC, _BOX)]
    got = features.feature_table(parts, 22).select("label", "atom", F.posexplode("fvec").alias("k", "value"))
    return got.select("label", "atom", (F.col("k") + 1).alias("slot"), _r("value", "value"))


@query(f"WITH {_PAIRS} SELECT label, i, round(ln(1 + sum(CASE WHEN r < 0.08 THEN pow(2 * (0.08::DOUBLE / r - 1), 12) ELSE 0 END)), 6) AS log_core FROM prs GROUP BY ALL")
def score_core_repulsion(spark, sf_dir):
    # sums span many powers of ten, so their logarithms are told
    return neighbours.core_repulsion_energy(_pairs(spark, sf_dir), chem.core_repulsion(F.col("r"), 0.08)).select("label", "i", _r(F.log1p("core"), "log_core"))


@query("SELECT vec_id FROM embeddings v WHERE NOT EXISTS (SELECT 1 FROM embeddings w WHERE w.vec_id <> v.vec_id AND sqrt(list_sum(list_transform(list_zip(v.embedding, w.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))) < 1.1)")
def novel_vectors(spark, sf_dir):
    """Vectors without another one near them."""
    e = table(spark, sf_dir, "embeddings")
    # between the quartiles of the distances to the nearest
    return similarity.novel_vectors(e, e, "vec_id", "embedding", 1.1).select("vec_id")


@query("SELECT vec_id, CAST(a * 4 + b * 2 + c AS INTEGER) AS image, round((embedding[1]::DOUBLE + a) / 2, 6) AS fx, round((embedding[2]::DOUBLE + b) / 2, 6) AS fy, round((embedding[3]::DOUBLE + c) / 2, 6) AS fz FROM embeddings, range(2) x(a), range(2) y(b), range(2) z(c)")
def supercell(spark, sf_dir):
    atoms = _atoms(spark, sf_dir).select(F.col("atom").alias("vec_id"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    return neighbours.supercell(atoms, (2, 2, 2)).select("vec_id", "image", *(_r(c, c) for c in ("fx", "fy", "fz")))


# --- datasets -----------------------------------------------------------------------------------

_ORDER = "n AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS k, count(*) OVER () AS total FROM orders)"


@query(f"WITH {_ORDER} SELECT o_orderkey, CASE WHEN k <= floor(total * 0.7::DOUBLE) THEN 0 WHEN k <= floor(total * 0.7::DOUBLE) + floor(total * 0.2::DOUBLE) THEN 1 ELSE 2 END AS part FROM n WHERE k <= floor(total * 0.7::DOUBLE) + floor(total * 0.2::DOUBLE) + floor(total * 0.05::DOUBLE)")
def split_by_fraction(spark, sf_dir):
    return datasets.split_by_fraction(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [0.7, 0.2, 0.05])


@query(f"WITH {_ORDER} SELECT o_orderkey, CASE WHEN k <= 100 THEN 0 ELSE 1 END AS part FROM n WHERE k <= 300")
def split_by_count(spark, sf_dir):
    return datasets.split_by_count(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [100, 200])


@query(f"WITH {_ORDER} SELECT o_orderkey, CASE WHEN k <= total - floor(total * 0.1::DOUBLE) THEN 0 ELSE 1 END AS part FROM n")
def train_test_split(spark, sf_dir):
    return datasets.train_test_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("WITH c AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR) || ':42'), o_custkey) AS k, count(*) OVER () AS total FROM c) SELECT o_orderkey, o_custkey, CASE WHEN k <= floor(total * 0.5::DOUBLE) THEN 0 ELSE 1 END AS part FROM orders JOIN n USING (o_custkey) WHERE k <= 2 * floor(total * 0.5::DOUBLE)")
def split_grouped(spark, sf_dir):
    return datasets.split_grouped(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", F.col("o_custkey"), [0.5, 0.5])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k BETWEEN 101 AND 250")
def slice_rows(spark, sf_dir):
    return datasets.slice_rows(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 101, 250).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_size > 0 ORDER BY -ln((CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR) || ':42'), 1, 13) AS BIGINT)::DOUBLE + 1) / 4503599627370497.0::DOUBLE) / p_size, p_partkey LIMIT 50")
def weighted_sample(spark, sf_dir):
    return datasets.weighted_sample(table(spark, sf_dir, "part"), "p_partkey", "p_size", 50).select("p_partkey")


_STD = "u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS slot FROM embeddings), f AS (SELECT CAST(slot AS INTEGER) AS slot, avg(x) AS mean, stddev_samp(x) AS std FROM u GROUP BY 1)"


@query(f"WITH {_STD} SELECT slot, round(mean, 6) AS mean, round(std, 6) AS std FROM f")
def fit_standardizer(spark, sf_dir):
    got = datasets.fit_standardizer(table(spark, sf_dir, "embeddings"), "embedding")
    return got.select("slot", _r("mean", "mean"), _r("std", "std"))


@query(f"WITH {_STD} SELECT vec_id, round(sum((x - mean) / std), 4) AS total, round(max((x - mean) / std), 5) AS top FROM u JOIN f USING (slot) GROUP BY vec_id")
def apply_standardizer(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.max(F.size("embedding"))).first()[0]
    got = datasets.apply_standardizer(e, "embedding", datasets.fit_standardizer(e, "embedding"), n)
    return got.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("embedding"), 5).alias("top"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS one, round(embedding[2]::DOUBLE * 0.5 + embedding[3]::DOUBLE * -1.0, 6) AS first FROM embeddings")
def embed_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.slice("embedding", 1, 7))
    return datasets.embed_features(e, "embedding", 1, [[0.5], [-1.0]]).select("vec_id", _r(F.col("embedding")[0], "one"), _r(F.col("embedding")[1], "first"))


@query("SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def union_tables(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return datasets.union_tables(o, o.filter("o_totalprice > 100000")).select("o_orderkey")


# --- models ----------------------------------------------------------------------------------------

_W = {"m1": [0.5, -0.25, 1.0], "m2": [0.4, 0.1, 0.9], "m3": [-1.0, 2.0, 0.3]}
_WEIGHT = {"m1": 0.6, "m2": 0.37, "m3": 0.03}
_SCORES = "s AS (" + " UNION ALL ".join(f"SELECT label, '{m}' AS model_id, sum({w[0]} * embedding[1]::DOUBLE + {w[1]} * embedding[2]::DOUBLE + {w[2]} * embedding[3]::DOUBLE) AS energy, count(*) AS natoms FROM embeddings GROUP BY label" for m, w in _W.items()) + ")"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 3).alias("fvec"))


def _sizes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("natoms"))


@query(f"WITH {_SCORES} SELECT label, round(energy, 5) AS energy FROM s WHERE model_id = 'm1'")
def score_linear(spark, sf_dir):
    return models.score_linear(_vectors(spark, sf_dir), "label", "fvec", _W["m1"]).select("label", F.round("energy", 5).alias("energy"))


@query("SELECT label, round(sum(0.7 * tanh(0.5 * embedding[1]::DOUBLE - 0.2 * embedding[2]::DOUBLE + 0.1 * embedding[3]::DOUBLE + 0.05) - 1.2 * tanh(embedding[2]::DOUBLE - 0.3 * embedding[3]::DOUBLE - 0.1) + 0.4), 5) AS energy FROM embeddings GROUP BY label")
def score_mlp(spark, sf_dir):
    layers = [([[0.5, -0.2, 0.1], [0.0, 1.0, -0.3]], [0.05, -0.1], "tanh"), ([[0.7, -1.2]], [0.4], "linear")]
    return models.score_mlp(_vectors(spark, sf_dir), "label", "fvec", layers).select("label", F.round("energy", 5).alias("energy"))


@query(f"WITH {_SCORES} SELECT label, round(sum(energy * CASE model_id WHEN 'm1' THEN 0.6 WHEN 'm2' THEN 0.37 ELSE 0.03 END), 5) AS energy FROM s GROUP BY label")
def score_ensemble(spark, sf_dir):
    return models.score_ensemble(models.score_members(_vectors(spark, sf_dir), "label", "fvec", _W), _WEIGHT, "label").select("label", F.round("energy", 5).alias("energy"))


#: Networks of one hidden layer: widths, parameters, and the scales of two of them.
_NETS = [
    ("n1", 0.5, [3, 2, 1], [0.5, -0.2, 0.1, 0.0, 1.0, -0.3, 0.05, -0.1, 0.7, -1.2, 0.4], None, None, None, None),
    ("n2", 0.3, [3, 2, 1], [-0.4, 0.3, 0.8, 1.1, -0.6, 0.2, 0.2, 0.0, -0.9, 0.5, 0.1], [0.1, -0.2, 0.3], [0.5, 2.0, 1.5], -0.75, 2.5),
    ("n3", 0.2, [3, 1, 1], [0.6, 0.6, -0.6, 0.3, 1.4, -0.2], None, None, 0.25, 0.5),
]


def _net_sql(net: tuple) -> str:
    name, _, (d, h, _), p, mean, std, y_mean, y_std = net
    x = [f"((embedding[{k + 1}]::DOUBLE - {mean[k]}::DOUBLE) / {std[k]}::DOUBLE)" if mean else f"embedding[{k + 1}]::DOUBLE" for k in range(d)]
    hidden = ["tanh(" + " + ".join(f"{p[j * d + k]}::DOUBLE * {x[k]}" for k in range(d)) + f" + {p[h * d + j]}::DOUBLE)" for j in range(h)]
    out = " + ".join(f"{p[h * d + h + j]}::DOUBLE * {hidden[j]}" for j in range(h)) + f" + {p[-1]}::DOUBLE"
    return f"SELECT label, '{name}' AS model_id, sum(({out}) * {y_std or 1.0}::DOUBLE + {y_mean or 0.0}::DOUBLE) AS energy FROM embeddings GROUP BY label"


_NET_SCORES = "s AS (" + " UNION ALL ".join(map(_net_sql, _NETS)) + ")"


@query(f"WITH {_NET_SCORES} SELECT label, model_id, round(energy, 5) AS energy FROM s")
def score_networks(spark, sf_dir):
    """Three networks, one behind scaled inputs, scored side by side."""
    got = models.score_members(_vectors(spark, sf_dir), "label", "fvec", networks.member_table(spark, _NETS))
    return got.select("label", "model_id", F.round("energy", 5).alias("energy"))


@query(f"WITH {_NET_SCORES} SELECT label, round(sum(energy * CASE model_id WHEN 'n1' THEN 0.5 WHEN 'n2' THEN 0.3 ELSE 0.2 END), 5) AS energy FROM s GROUP BY label")
def score_network_ensemble(spark, sf_dir):
    members = networks.member_table(spark, _NETS)
    got = models.score_ensemble(models.score_members(_vectors(spark, sf_dir), "label", "fvec", members), members, "label")
    return got.select("label", F.round("energy", 5).alias("energy"))


@query(f"WITH {_SCORES} SELECT label, round(stddev_samp(energy / natoms), 6) AS std FROM s WHERE model_id <> 'm3' GROUP BY label")
def ensemble_std(spark, sf_dir):
    scores = models.score_members(_vectors(spark, sf_dir), "label", "fvec", _W)
    return models.ensemble_std(scores, _sizes(spark, sf_dir), _WEIGHT, "label").select("label", _r("std", "std"))


@query(f"WITH {_SCORES} SELECT label, round(stddev_samp(energy), 5) AS std, round(stddev_samp(energy) / any_value(natoms), 6) AS std_per_atom FROM s GROUP BY label HAVING stddev_samp(energy) / any_value(natoms) BETWEEN 0.01 AND 0.3")
def filter_uncertainty_band(spark, sf_dir):
    scores = models.score_members(_vectors(spark, sf_dir), "label", "fvec", _W)
    got = models.filter_uncertainty_band(models.energy_std(scores, _sizes(spark, sf_dir), "label"), "std_per_atom", 0.01, 0.3)
    return got.select("label", F.round("std", 5).alias("std"), _r("std_per_atom", "std_per_atom"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def fit_linear(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("one", F.lit(1.0))
    a, b = models.fit_linear(rows, ["one", "l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(a, 3), round(b, 4))], "intercept double, slope double")


def _active_sets() -> str:
    """The weights of every active set of three members, by Cramer's rule, and what each explains."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    det = lambda m: m[0][0] if len(m) == 1 else f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})" if len(m) == 2 else "(" + " + ".join(f"{m[0][k]} * {minor(m, k)}" for k in range(3)) + ")"
    minor = lambda m, k: f"({m[1][(k + 1) % 3]} * {m[2][(k + 2) % 3]} - {m[1][(k + 2) % 3]} * {m[2][(k + 1) % 3]})"
    sets = []
    for on in ([1], [2], [3], [1, 2], [1, 3], [2, 3], [1, 2, 3]):
        whole = [[g(i, j) for j in on] for i in on]
        x = {i: f"{det([[f'b{a}' if c == i else g(a, c) for c in on] for a in on])} / {det(whole)}" for i in on}
        sets.append("SELECT " + ", ".join(f"{x.get(i, '0.0::DOUBLE')} AS x{i}" for i in (1, 2, 3)) + ", " + " + ".join(f"b{i} * ({x[i]})" for i in on) + " AS gain FROM n WHERE " + " AND ".join(f"{x[i]} > 0" for i in on))
    return " UNION ALL ".join(sets)


_SUMS = ", ".join(f"sum(e{i} * e{j}) AS g{i}{j}" for i in (1, 2, 3) for j in range(i, 4)) + ", " + ", ".join(f"sum(e{i} * t) AS b{i}" for i in (1, 2, 3))
_OBS = "o AS (SELECT l_orderkey AS label, count(*) AS natoms, sum(l_extendedprice) AS t, sum(l_quantity * 1495.0::DOUBLE) AS e1, sum(l_extendedprice * 0.9::DOUBLE + l_tax * 50000.0::DOUBLE) AS e2, sum(l_extendedprice * (1 - l_discount)) AS e3 FROM lineitem GROUP BY 1), f AS (SELECT * FROM o WHERE greatest(abs(e1 / natoms - t / natoms), abs(e2 / natoms - t / natoms), abs(e3 / natoms - t / natoms)) < 4000)"


def _observations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scores of three members for every order, and its targets."""
    li, q, x = table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice")
    sums = li.groupBy(F.col("l_orderkey").alias("label")).agg(F.count("*").alias("natoms"), F.sum(x).alias("target"), F.sum(q * 1495.0).alias("m1"), F.sum(x * 0.9 + F.col("l_tax") * 50000.0).alias("m2"), F.sum(x * (1 - F.col("l_discount"))).alias("m3"))
    return sums.unpivot("label", ["m1", "m2", "m3"], "model_id", "energy"), sums.select("label", "natoms", "target")


@query(f"WITH {_OBS} SELECT label FROM f")
def filter_ensemble_observations(spark, sf_dir):
    scores, targets = _observations(spark, sf_dir)
    return models.filter_ensemble_observations(scores, targets, "label", 4000.0)


@query(f"WITH {_OBS}, n AS (SELECT {_SUMS} FROM f), s AS ({_active_sets()}), b AS (SELECT * FROM s ORDER BY gain DESC LIMIT 1) SELECT model_id, round(weight, 6) AS weight FROM (SELECT 'm1' AS model_id, x1 AS weight FROM b UNION ALL SELECT 'm2', x2 FROM b UNION ALL SELECT 'm3', x3 FROM b) WHERE weight > 1e-13")
def nnls_ensemble_weights(spark, sf_dir):
    scores, targets = _observations(spark, sf_dir)
    good = models.filter_ensemble_observations(scores, targets, "label", 4000.0)
    got = models.nnls_ensemble_weights(scores.join(good, "label", "left_semi"), targets, "label", ["m1", "m2", "m3"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "model_id string, weight double")


@query("SELECT a.l_linenumber AS gen, round(avg(abs(a.l_extendedprice - a.l_quantity * m.w)), 3) AS mae FROM lineitem a JOIN (SELECT l_linenumber + 1 AS gen, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS w FROM lineitem GROUP BY 1) m ON a.l_linenumber = m.gen GROUP BY 1")
def walk_forward_eval(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "gen")
    fitted = li.groupBy("gen").agg((F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("w"))
    return models.walk_forward_join(li, fitted).groupBy("gen").agg(F.round(F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("w"))), 3).alias("mae"))


_SETS = (("in_sample", "l_linenumber BETWEEN 1 AND 3", "3"), ("out_of_sample", "l_linenumber = 4", "3"), ("next_in_sample", "l_linenumber = 4", "4"), ("next_structures", "l_linenumber = 4", "NULL"))


@query("WITH m AS (SELECT l_linenumber AS g, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS w FROM lineitem GROUP BY 1), s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS sample, l_quantity AS q, l_extendedprice AS p, {g} AS g FROM lineitem WHERE {c}" for n, c, g in _SETS) + ") SELECT sample, count(*) AS n, round(avg(abs(p - q * w)), 3) AS mae FROM s LEFT JOIN m USING (g) GROUP BY 1")
def in_out_sample(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("gen"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"))
    fitted = li.groupBy("gen").agg((F.sum(F.col("q") * F.col("p")) / F.sum(F.col("q") * F.col("q"))).alias("w"))
    return models.in_out_sample(li, fitted, 3, 1).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("q") * F.col("w"))), 3).alias("mae"))


# --- forces, bonded units, shaken copies, fits --------------------------------------------------

_CORE = 0.08
_BONDS = f"""{_PAIRS}, sp(pi, p) AS (VALUES (0, 2.0::DOUBLE), (1, 4.5::DOUBLE)), blocks(sa, sb, b) AS (VALUES ('A', 'A', 0), ('A', 'B', 1), ('B', 'A', 2), ('B', 'B', 3)),
bo AS (SELECT label, i, j, dx, dy, dz, r, (3 + b * 2 + pi) / 10.0::DOUBLE * p * pow({_F2}, p - 1) * (-2.0::DOUBLE / {_RC}) AS g FROM prs, sp, blocks WHERE species_i = sa AND species_j = sb
       UNION ALL SELECT label, i, j, dx, dy, dz, r, -2 * {_CORE} / (r * r) * 2 * (2 * ({_CORE} / r - 1)) FROM prs WHERE r < {_CORE})"""


def _bonds(spark, sf_dir):
    spec, pairs = _spec(spark), _pairs(spark, sf_dir)
    slopes = spec.select("slot", (F.col("slot") / 10.0).alias("slope"))
    core = forces.core_bonds(pairs.filter(F.col("r") < _CORE), chem.core_repulsion_grad(F.col("r"), _CORE, 2))
    return forces.two_body_bonds(pairs, spec, slopes, _RC).unionByName(core)


@query(f"""WITH {_BONDS}, e AS (SELECT label, i AS atom, g * dx / r AS fx, g * dy / r AS fy, g * dz / r AS fz FROM bo UNION ALL SELECT label, j, -g * dx / r, -g * dy / r, -g * dz / r FROM bo),
s AS (SELECT label, atom, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM e GROUP BY ALL), f AS (SELECT label, atom, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(fz, 0) AS fz FROM a LEFT JOIN s USING (label, atom))
SELECT label, atom, round(fx - avg(fx) OVER w, 3) + 0.0 AS fx, round(fy - avg(fy) OVER w, 3) + 0.0 AS fy, round(fz - avg(fz) OVER w, 3) + 0.0 AS fz FROM f WINDOW w AS (PARTITION BY label)""")
def score_forces(spark, sf_dir):
    got = forces.score_forces(_bonds(spark, sf_dir), _atoms(spark, sf_dir))
    return got.select("label", "atom", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("fx", "fy", "fz")))


_NINE = [f"s{a}{b}" for a in "xyz" for b in "xyz"]


@query(f"WITH {_BONDS}, s AS (SELECT label, {', '.join(f'-sum(g * d{c[1]} * d{c[2]} / r) / 2 AS {c}' for c in _NINE)} FROM bo GROUP BY label) SELECT label, {', '.join(f'round(coalesce({c}, 0), 3) + 0.0 AS {c}' for c in _NINE)} FROM (SELECT DISTINCT label FROM a) LEFT JOIN s USING (label)")
def score_stress(spark, sf_dir):
    volumes = _atoms(spark, sf_dir).select("label", F.lit(2.0).alias("volume")).distinct()
    return forces.score_stress(_bonds(spark, sf_dir), volumes).select("label", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in _NINE))


_TRIPLE_BONDS = f"""{_PAIRS}, three(c, s1, s2, b) AS (VALUES ('A', 'A', 'A', 0), ('A', 'A', 'B', 1), ('A', 'B', 'B', 2), ('B', 'A', 'A', 3), ('B', 'A', 'B', 4), ('B', 'B', 'B', 5)), qs(qi, q) AS (VALUES (0, 1.0::DOUBLE), (1, 3.0::DOUBLE)),
tv AS (SELECT label, m.i, m.j, n.j AS k, m.species_i, least(m.species_j, n.species_j) AS s1, greatest(m.species_j, n.species_j) AS s2, {', '.join(f'm.d{c} AS d{c}1, n.d{c} AS d{c}2, n.d{c} - m.d{c} AS d{c}3' for c in 'xyz')}, m.r AS rij, n.r AS rik FROM prs m JOIN prs n USING (label, i) WHERE (n.j, n.sx, n.sy, n.sz) > (m.j, m.sx, m.sy, m.sz)),
td AS (SELECT *, sqrt(dx3 * dx3 + dy3 * dy3 + dz3 * dz3) AS rjk FROM tv), fv AS (SELECT td.*, 2 * (1 - rij / {_RC}) AS x, 2 * (1 - rik / {_RC}) AS y, 2 * (1 - rjk / {_RC}) AS z, (11 + b * 2 + qi) / 10.0::DOUBLE * (-2.0::DOUBLE / {_RC}) AS s, q FROM td JOIN three ON td.species_i = three.c AND td.s1 = three.s1 AND td.s2 = three.s2, qs WHERE rjk > 0 AND rjk <= {_RC}),
bo AS (SELECT label, i, j, dx1 AS dx, dy1 AS dy, dz1 AS dz, rij AS r, s * 2 * x * y * y * pow(z, q) AS g FROM fv UNION ALL SELECT label, i, k, dx2, dy2, dz2, rik, s * 2 * x * y * x * pow(z, q) FROM fv UNION ALL SELECT label, j, k, dx3, dy3, dz3, rjk, s * x * x * y * y * q * pow(z, q - 1) FROM fv)"""


@query(f"""WITH {_TRIPLE_BONDS}, e AS (SELECT label, i AS atom, g * dx / r AS fx, g * dy / r AS fy, g * dz / r AS fz FROM bo UNION ALL SELECT label, j, -g * dx / r, -g * dy / r, -g * dz / r FROM bo),
s AS (SELECT label, atom, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM e GROUP BY ALL), f AS (SELECT label, atom, coalesce(fx, 0) AS fx, coalesce(fy, 0) AS fy, coalesce(fz, 0) AS fz FROM a LEFT JOIN s USING (label, atom))
SELECT label, atom, round(fx - avg(fx) OVER w, 3) + 0.0 AS fx, round(fy - avg(fy) OVER w, 3) + 0.0 AS fy, round(fz - avg(fz) OVER w, 3) + 0.0 AS fz FROM f WINDOW w AS (PARTITION BY label)""")
def score_forces_triplets(spark, sf_dir):
    """Forces of the three-body features."""
    spec = _spec(spark)
    slopes = spec.select("slot", (F.col("slot") / 10).alias("slope"))
    atoms = _atoms(spark, sf_dir)
    got = forces.net_forces(dense.triplet_forces(atoms, spec, slopes, _RC, _BOX), atoms)
    return got.select("label", "atom", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("fx", "fy", "fz")))


@query(f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT DISTINCT label, i, j FROM prs WHERE r <= 0.1), reach AS (SELECT label, atom, atom AS root FROM a UNION SELECT reach.label, t.j, root FROM reach JOIN t ON reach.label = t.label AND reach.atom = t.i)
SELECT label, atom, min(root) AS module FROM reach GROUP BY ALL""")
def bond_modules(spark, sf_dir):
    atoms = _atoms(spark, sf_dir)
    return generate.linked_modules(atoms, dense.bond_links(atoms, 0.1, _BOX))


_U = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"


@query("SELECT vec_id AS atom, label || '-shake-' || c AS label, " + ", ".join(f"round(v{x} - floor(v{x}), 6) AS f{x}" for x in "xyz") + " FROM (SELECT vec_id, label, c, " + ", ".join(f"embedding[{k}]::DOUBLE + 0.2::DOUBLE * (2 * {_U.format(f"label || ':' || c || ':' || vec_id || ':{x}'")} - 1) / {e} AS v{x}" for k, x, e in ((1, "x", 2.0), (2, "y", 3.0), (3, "z", 4.0))) + " FROM embeddings, range(1, 4) r(c))")
def augment_shake(spark, sf_dir):
    """Three perturbed copies of every structure; the atoms are given."""
    atoms = _atoms(spark, sf_dir).select(F.col("label").cast("string").alias("label"), "atom", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    cells = atoms.select("label").distinct().select("label", *(F.lit(v).alias(c) for c, v in zip(generate.CELL, (2.0, 3.0, 4.0, 90.0, 90.0, 90.0), strict=True)))
    return generate.augment_shake(cells, atoms, 3, 0.2, 0.05)[1].select("label", "atom", *(_r(c, c) for c in ("fx", "fy", "fz")))


@query("SELECT o_orderkey, c AS copy, o_orderkey || '-shake-' || c AS shaken, " + ", ".join(f"round({v} * (1 + {_U.format(f"o_orderkey || ':' || c || ':0:{n}'")} * 0.02::DOUBLE), 6) AS {n}" for n, v in (("a", 5.0), ("b", 6.0), ("c", 7.0), ("alpha", 80.0), ("beta", 90.0), ("gamma", 100.0))).replace(" AS c,", " AS edge_c,") + " FROM orders, range(1, 3) r(c)")
def shaken_cells(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").select("o_orderkey", *(F.lit(v).alias(c) for c, v in zip(generate.CELL, (5.0, 6.0, 7.0, 80.0, 90.0, 100.0), strict=True)))
    got = generate.shaken_cells(cells, 2, 0.02, "o_orderkey")
    return got.select("o_orderkey", "copy", "shaken", *(_r(c, "edge_c" if c == "c" else c) for c in generate.CELL))


@query("WITH v AS (SELECT label, vec_id, list_transform(embedding[1:7], lambda x: printf('%.14f', round(x::DOUBLE, 6))) AS t FROM embeddings), l AS (SELECT label, vec_id, t[1] || chr(10) || array_to_string(t[2:4], ' ') || chr(10) || array_to_string(t[5:7], ' ') AS lines FROM v) SELECT label, md5('structure ' || label || chr(10) || string_agg(lines, chr(10) ORDER BY vec_id)) AS digest FROM l GROUP BY label")
def export_feature_text(spark, sf_dir):
    # engines differ in the 14th digit of numbers that have more
    # and Spark's rounding drops the sign of small negative numbers, which their texts show
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: F.round(F.abs(x.cast("double")), 6) * F.signum(x.cast("double"))))
    got = datasets.feature_text(e, "label", "vec_id", "embedding", [1, 3, 3], F.concat(F.lit("structure "), "label"))
    return got.select("label", F.md5("text").alias("digest"))


@query("SELECT 'm' || l_linenumber AS model_id, 'linear' AS kind, CAST(row_number() OVER (ORDER BY l_linenumber) AS INTEGER) AS position, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 6) AS w FROM lineitem GROUP BY l_linenumber")
def load_models(spark, sf_dir):
    """A linear member for each line number, saved and loaded again."""
    from ..sources.paths import scratch

    q, y = F.col("l_quantity"), F.col("l_extendedprice")
    fitted = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg((F.sum(q * y) / F.sum(q * q)).alias("w"))
    path = scratch(spark, "models")
    models.save_models(fitted.select(F.concat(F.lit("m"), "l_linenumber").alias("model_id"), F.lit(1.0).alias("weight"), F.array("w").alias("params"), F.lit(None).cast("array<int>").alias("sizes")), path)
    return models.load_models(spark, path).select("model_id", "kind", "position", _r(F.col("params")[0], "w"))


@query()
def fit_mlp_lm(spark, sf_dir):
    """A small network fitted to a curve of the vectors' first three components."""
    from ..sources.paths import kept

    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[k].cast("double") for k in range(3)]
    rows = kept(e.select(F.col("vec_id").alias("label"), F.slice("embedding", 1, 3).alias("fvec"), (F.sin(3 * x[0]) + x[1] * x[2]).alias("target")), "fit")
    theta, history = fitting.fit_mlp_lm(rows, rows, "label", "fvec", "target", [3, 3, 1], steps=6)
    return fitting.score_parameters(rows, "label", "fvec", theta, [3, 3, 1]).join(rows.select("label", "target"), "label").select("label", F.round("target", 6).alias("target"), F.round("energy", 4).alias("energy"))


# --- sources and streams ---------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS res FROM events")
def parse_job_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"x RES": '), "props", F.lit("}")).alias("j"))
    return texts.parse_job_summary(rows, "j").select("event_id", "res")


@query("SELECT event_type AS file, CAST(arg_max(user_id, event_id) AS DOUBLE) AS enthalpy, 0.0::DOUBLE AS pressure FROM events GROUP BY 1")
def parse_energy_log(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.concat(F.lit("Enthalpy = "), F.col("user_id").cast("string"), F.lit("  ")).alias("text"))
    return texts.parse_energy_log(lines, "file", "line", "text")


@query("SELECT 'rec-' || p_partkey AS label, round(p_retailprice, 2) AS enthalpy, 2 AS natoms, CASE WHEN p_size % 2 = 0 THEN 'AB' ELSE 'A2' END AS formula FROM part")
def scan_shelx_headers(spark, sf_dir):
    """Record texts made of the parts table are written, scanned and parsed."""
    from ..sources.paths import scratch

    part = table(spark, sf_dir, "part")
    second = F.when(F.col("p_size") % 2 == 0, "B").otherwise("A")
    text = F.concat_ws("\n", F.concat_ws(" ", F.lit("TITL"), F.concat(F.lit("rec-"), F.col("p_partkey")), F.lit("0.0"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("0 0 2 (P1) n - 1")), F.lit("CELL 1.54180 3 4 5 90 90 90"), F.lit("LATT -1"), F.lit("SFAC A B"), F.lit("A 1 0.0 0.0 0.0 1.0"), F.concat(second, F.lit(" 2 0.5 0.5 0.5 1.0")), F.lit("END"))
    path = scratch(spark, "records")
    shelx.write_records(part.select(text.alias("text")), path)
    got = shelx.scan_shelx_headers(spark, path)
    return got.select("label", F.round("enthalpy", 2).alias("enthalpy"), "natoms", "formula")


@query("SELECT user_id, event_id, round(value, 6) AS value, coalesce(value <= min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 20, false) AS admitted FROM events")
def energy_admission_batch(spark, sf_dir):
    return jobs.energy_admission_batch(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id", 20.0).select("user_id", "event_id", _r("value", "value"), "admitted")


@query("SELECT user_id, event_id, round(value, 6) AS value, coalesce(value <= min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 20, false) AS admitted FROM events")
def stream_energy_admission(spark, sf_dir):
    from ..sources.paths import scratch

    events = table(spark, sf_dir, "events")
    inbox, out = scratch(spark, "events"), scratch(spark, "admitted")
    # six files, one after another; half of the events come a file later than their time says
    days = F.datediff("ts", F.lit("2024-01-01"))
    slot = F.least(F.greatest(F.floor(days / 6), F.lit(0)), F.lit(4)) + F.pmod("event_id", F.lit(2))
    for k in range(6):
        events.filter(slot == k).coalesce(1).write.mode("append").parquet(inbox)
    # and an event of no user that ends the wait
    last = events.limit(0).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS user_id, TIMESTAMP_NTZ '2034-01-01 00:00:00' AS ts"), allowMissingColumns=True)
    last.select(*(F.col(f.name).cast(f.dataType) for f in events.schema)).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox).withColumn("ts", F.col("ts").cast("timestamp"))
    admitted = jobs.stream_energy_admission(stream, "user_id", "value", "ts", "event_id", 20.0, "14 days")
    admitted.writeStream.format("parquet").option("checkpointLocation", scratch(spark, "checkpoint")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).filter("user_id is not null").select("user_id", "event_id", _r("value", "value"), "admitted")


def _as_folder(rows: DataFrame, path: str) -> str:
    rows.write.parquet(path)
    return path


@query("SELECT event_type, count(*) AS n, count(*) / 100.0 > 0.98 AS done FROM events GROUP BY 1")
def stream_completion(spark, sf_dir):
    from ..sources.paths import scratch

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(_as_folder(events, scratch(spark, "events")))
    out = scratch(spark, "counts")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(out)

    jobs.stream_counts(stream, "event_type").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(out)
    expected = counts.select("event_type").withColumn("expected", F.lit(100))
    return jobs.stream_completion(counts, expected, "event_type").select("event_type", "n", "done")


