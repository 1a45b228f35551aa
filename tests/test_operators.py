"""Operators on small tables with values known by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlake.functions import chem
from structlake.operators import datasets, hull, leaders, models, neighbours, networks, records, similarity
from structlake.sources import shelx, texts
from structlake.streaming import jobs

RECORD = """TITL {label} 0.5 10.0 -3.25 0 0 3 (P1) n - 1
REM this line says END in its middle
CELL 1.54180 3.0 4.0 5.0 90 90 90
LATT -1
SFAC H O
H 1 0.0 0.0 0.0 1.0
H 1 0.5 0.5 0.5 1.0
O 2 0.25 0.25 0.25 1.0
END
"""


def test_records_are_scanned_packed_or_single(spark, tmp_path):
    (tmp_path / "gen3").mkdir()
    (tmp_path / "gen3" / "packed.res").write_text("".join(RECORD.format(label=f"p{k}") for k in range(5)))
    (tmp_path / "single.res").write_text(RECORD.format(label="s").rstrip("\n"))
    paths = [str(tmp_path / "gen3"), str(tmp_path / "single.res")]
    for whole in (False, True):
        got = shelx.scan_shelx_headers(spark, paths, whole=whole)
        assert sorted((r.label, r.gen, r.natoms, r.enthalpy, r.formula) for r in got.collect())[:1] == [("p0", 3, 3, -3.25, "H2O")]
        assert got.count() == 6
    structures, atoms = shelx.parse_structures(got)
    assert structures.first().cell_volume == pytest.approx(60.0) and atoms.count() == 18
    assert shelx.extract_records(got, "p[12]", regex=True).count() == 2
    text = shelx.render_records(structures, atoms, ["label"]).first().text
    assert text.startswith("TITL ") and text.endswith("END") and "SFAC H O" in text


def test_extxyz_and_castep(spark, tmp_path):
    (tmp_path / "a.xyz").write_text('2\nenergy=-1.5 name=one spacegroup="P21"\nH 0 0 0\nO 0 0 1.5\n1\nname="two b"\nH 1 2 3\n')
    rows = {r.label: r for r in texts.extxyz_to_records(texts.scan_extxyz(spark, str(tmp_path / "a.xyz"))).collect()}
    assert (rows["one"].enthalpy, rows["one"].symm, rows["one"].formula, rows["two b"].symm) == (-1.5, "(P21)", "HO", "(P1)")
    (tmp_path / "c.castep").write_text("Final free energy (E-TS) = -658.25 eV\n * B 1 0.5 -0.25 1.0 *\n * B 2 1.5 2.25 -1.0 *\n * x -17.5 0.0 0.1 *\n * y 0.0 -17.0 0.2 *\n * z 0.1 0.2 -16.0 *\n")
    got = texts.scan_castep(spark, str(tmp_path / "c.castep")).first()
    assert got.energies == [-658.25] and got.forces == [[0.5, -0.25, 1.0], [1.5, 2.25, -1.0]] and got.species == ["B", "B"] and got.stress[2] == [0.1, 0.2, -16.0]


def test_compositions(spark):
    got = spark.createDataFrame([("H2O",), ("C6H12O6",), ("Fe4",), ("CH3CH2OH",), ("",)], "f string").withColumn("c", chem.parse_formula(F.col("f"))).select(chem.formula_string(F.col("c")), chem.formula_string(chem.reduce_composition(F.col("c"))), chem.formula_units(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("H2O", "H2O", 1), ("C6H12O6", "CH2O", 6), ("Fe4", "Fe", 4), ("C2H6O", "C2H6O", 1), ("", "", 1)]
    assert chem.geometric_exponents(2, 8, 3) == [2.0, 4.0, 8.0] and chem.geometric_exponents(2, 8, 0) == []


def test_hull_energies(spark):
    pts = spark.createDataFrame([("H", 0.0, 0.0), ("O", 1.0, 0.0), ("H2O", 1 / 3, -1 / 3), ("high", 1 / 3, 1 / 3)], "key string, x double, e double")
    got = {r.key: r for r in hull.stable_mask(hull.e_above_hull(pts, pts, ["x"], "e")).collect()}
    assert got["high"].e_above_hull == pytest.approx(2 / 3) and not got["high"].stable and got["H2O"].stable
    parts = hull.decomposition(pts, pts.filter("key <> 'H2O'"), ["x"], "e").filter("key = 'H2O'").collect()
    assert {r["product"]: round(r.fraction, 6) for r in parts} == {"H": 0.666667, "O": 0.333333}


def test_neighbours_of_a_small_cell_see_their_images(spark):
    atoms = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0)], "label string, atom int, x double, y double, z double")
    assert neighbours.neighbour_pairs(atoms, 1.0, 1.0).count() == 6


def manhattan(point, points):
    return abs(points - point).sum(axis=1)


@pytest.mark.parametrize("chunk_rows", [50_000, 17, 3])
@pytest.mark.parametrize("metric", [None, manhattan])
def test_greedy_dedupe_equals_the_sequential_sweep(spark, chunk_rows, metric):
    import random

    rng = random.Random(1)
    rows = [(f"l{k:03}", rng.choice(["a", "b", None]), round(rng.uniform(0, 4), 2), round(rng.uniform(0, 1), 2)) for k in range(300)]
    table = spark.createDataFrame(rows, "label string, g string, e double, v double")
    got = {r.label: (r.cluster, r.is_leader) for r in leaders.dedupe_greedy(table, "g", "e", "label", ["e", "v"], 0.1, metric, chunk_rows).collect()}
    few = {}
    for r in leaders.select_refine(table, "g", "e", "label", ["e", "v"], 0.1, 10, metric, chunk_rows).collect():
        few.setdefault(r.g, set()).add(r.label)
    far = (lambda x, y: abs(x) + abs(y)) if metric else math.hypot
    for g in ("a", "b", None):
        found = []
        for label, _, e, v in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            near = [m for m, x, y in found if far(e - x, v - y) < 0.1]
            assert got[label] == ((near[-1], False) if near else (label, True))
            if not near:
                found.append((label, e, v))
        assert few[g] == {m for m, *_ in found[:10]}
    assert leaders.dedupe_greedy(table.limit(0), "g", "e", "label", ["e", "v"], 0.1).count() == 0


@pytest.fixture
def sweeps(monkeypatch):
    """Rounds of swept chunks, as they are made."""
    seen, whole = [], leaders._swept

    def counted(chunks, *rest):
        seen.append(chunks.select("_g", "_chunk").distinct().count())
        return whole(chunks, *rest)

    monkeypatch.setattr(leaders, "_swept", counted)
    return seen


def test_chunks_of_like_rows_need_few_sweeps(spark, sweeps):
    table = spark.range(4000).selectExpr("id", "'g' as g", "1.0D as e", "2.0D as v")
    assert [r.id for r in leaders.select_refine(table, "g", "e", "id", ["e", "v"], 0.1, 10, chunk_rows=100).collect()] == [0]
    assert len(sweeps) <= 6 and sum(sweeps) == 40
    sweeps.clear()
    got = leaders.dedupe_greedy(table, "g", "e", "id", ["e", "v"], 0.1, chunk_rows=100).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [(0, 4000)]
    assert len(sweeps) <= 3 and sum(sweeps) == 40


def test_only_chunks_whose_leaders_change_are_swept_again(spark, sweeps):
    # far apart but for one run of rows, each near the one before it
    orders = [float(k) for k in range(300)] + [299.0 + 0.07 * k for k in range(1, 101)]
    table = spark.createDataFrame([(k, "g", e) for k, e in enumerate(orders)], "id long, g string, e double")
    got = {r.id: r.is_leader for r in leaders.dedupe_greedy(table, "g", "e", "id", ["e"], 0.1, chunk_rows=10).collect()}
    assert [got[k] for k in range(300)] == [True] * 300 and [got[299 + k] for k in range(101)] == [k % 2 == 0 for k in range(101)]
    assert sum(sweeps) <= 40 + 25, sweeps


def test_first_leaders_stop_early(spark, sweeps):
    table = spark.range(3000).selectExpr("id", "id % 3 as g", "cast(id as double) as e")
    got = leaders.select_refine(table, "g", "e", "id", ["e"], 0.5, 10, chunk_rows=20).collect()
    assert sorted(r.id for r in got) == list(range(30)) and sum(sweeps) == 3


def test_records_are_selected_by_label_and_order(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z"), ("a", 0, "w"), (None, 0, "n")], "l string, o long, c string")
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("none", 3), (None, 4)], "l string, pos long")
    got = records.select_by_label(rows, wanted, "l", "pos", "o")
    assert got.columns == ["l", "o", "c", "pos"] and sorted(map(tuple, got.collect())) == [("a", 0, "w", 1), ("a", 0, "w", 2)]
    assert records.select_by_label(rows.limit(0), wanted, "l", "pos", "o").count() == 0


def plain_outputs(x, row):
    """One network in plain numpy."""
    _, _, sizes, params, x_mean, x_std, y_mean, y_std = row
    if x_mean is not None:
        x = (x - np.array(x_mean)) / np.array(x_std)
    if sizes is None:
        return x @ np.array(params)
    at = 0
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        w, bias = np.array(params[at : at + a * b]).reshape(b, a), np.array(params[at + a * b : at + (a + 1) * b])
        x, at = x @ w.T + bias, at + (a + 1) * b
        if k < len(sizes) - 2:
            x = np.tanh(x)
    return x[:, 0] * (1.0 if y_std is None else y_std) + (0.0 if y_mean is None else y_mean)


@pytest.mark.parametrize("limits", [{}, {"member_bytes": 3000, "slot_bytes": 20000}])
def test_networks_are_scored_side_by_side(spark, limits):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 50))
    labels = [None if k % 11 == 0 else f"s{k % 7}" for k in range(120)]
    members = []
    for m, sizes in enumerate([[50, 4, 1]] * 5 + [[50, 3, 2, 1]] * 3 + [None] * 2):
        n = 50 if sizes is None else sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))
        scaled = m % 2 == 1 and sizes is not None
        members.append((f"m{m}", 1.0, sizes, rng.normal(size=n).tolist(), rng.normal(size=50).tolist() if scaled else None, rng.uniform(0.5, 2, 50).tolist() if scaled else None, 0.3 if scaled else None, 1.7 if scaled else None))
    rows = spark.createDataFrame([(a, v.tolist()) for a, v in zip(labels, x)] + [("s1", None), ("only null", None)], "label string, v array<double>").repartition(3)
    got = {(r.label, r.model_id): r.energy for r in networks.score_networks(rows, "label", "v", networks.member_table(spark, members), **limits).collect()}
    want = {}
    for row in members:
        for a, e in zip(labels, plain_outputs(x, row)):
            want[a, row[0]] = want.get((a, row[0]), 0.0) + e
    assert got == pytest.approx(want)


def test_many_networks_in_one_pass(spark):
    rng, sizes = np.random.default_rng(4), [500, 8, 1]
    members = [(f"m{m}", 1 / 64, sizes, rng.normal(size=501 * 8 + 9).tolist(), None, None, None, None) for m in range(64)]
    x = rng.normal(size=(60, 500))
    rows = spark.createDataFrame([(k // 4, v.tolist()) for k, v in enumerate(x)], "label long, v array<double>")
    table = networks.member_table(spark, members)
    got = models.score_members(rows, "label", "v", table)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and len(plan) < 5000
    mean = np.mean([plain_outputs(x, r) for r in members], axis=0).reshape(15, 4).sum(axis=1)
    assert {r.label: r.energy for r in models.score_ensemble(got, table, "label").collect()} == pytest.approx(dict(enumerate(mean)))
    assert models.score_members(rows, "label", "v", table.limit(0)).count() == 0
    assert models.score_members(rows.limit(0), "label", "v", table).count() == 0
    with pytest.raises(Exception, match="500 components|parameters"):
        networks.score_networks(rows, "label", "v", networks.member_table(spark, [("m", 1.0, [3, 1], [0.0] * 4, None, None, None, None)])).collect()


def far_from_all(some, others, tol):
    far = lambda x, y: math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))) if x and y and len(x) == len(y) and None not in (*x, *y) else math.inf
    near = {k for k, v in some for j, w in others if k is not None and j is not None and k != j and far(v, w) < tol}
    return sorted((repr((k, v)) for k, v in some if k not in near))


@pytest.mark.parametrize("block_rows", [4096, 20])
def test_novel_vectors_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 6)) * 3
    some = [(k, (middles[k % 12] + rng.normal(size=6) * 0.2).tolist()) for k in range(200)]
    some += [(k, rng.normal(size=6).tolist()) for k in range(200, 230)] + [(300, some[0][1]), (301, some[0][1][:3]), (302, some[0][1][:3]), (303, None), (304, []), (305, [None] * 6), (0, some[5][1])]
    docs = spark.createDataFrame(some, "id long, v array<double>").repartition(3)
    seen = []
    for tol in (0.25, 1e-3, 4.0):
        got = similarity.novel_vectors(docs, docs, "id", "v", tol, block_rows, lambda *n: seen.append(n)).collect()
        assert sorted(repr((r.id, r.v)) for r in got) == far_from_all(some, some, tol)
    others = spark.createDataFrame(some[:50], "id long, v array<double>")
    got = similarity.novel_vectors(docs, others, "id", "v", 0.4, block_rows).collect()
    assert sorted(repr((r.id, r.v)) for r in got) == far_from_all(some, some[:50], 0.4)
    assert similarity.novel_vectors(docs, others.limit(0), "id", "v", 0.4).count() == len(some) and similarity.novel_vectors(docs.limit(0), others, "id", "v", 0.4).count() == 0


def test_vectors_in_clusters_meet_few_others(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 16)) * 5
    some = [(k, (middles[k % 40] + rng.normal(size=16) * 0.1).tolist()) for k in range(2000)]
    docs, seen = spark.createDataFrame(some, "id long, v array<double>"), []
    x = np.array([v for _, v in some])
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 9)
    got = similarity.novel_vectors(docs, docs, "id", "v", 0.4, 50, lambda *n: seen.append(n))
    assert {r.id for r in got.collect()} == set(np.flatnonzero(d.min(axis=1) >= 0.4).tolist()) and 0 < got.count() < 2000
    ((compared, every),) = seen
    assert every == 4_000_000 and compared < every / 4


def xyz_texts(rng, frames=25):
    """Files with frames of all sizes, numbers for metadata, broken frames, and what the pattern finds in them."""
    out = []
    for f in range(3):
        parts = ["loose line", "12"][: rng.choice([0, 1, 2])]
        for k in range(frames):
            n = rng.randint(1, 9)
            info = rng.choice([f"name=f{f}-{k} energy={k}.5", "7", "", "12 atoms"])
            parts += [f" {n} ", info, *(f"{rng.choice(['H', 'Si'])} {rng.random():.3f} 0.5 {i}" for i in range(n))]
            if rng.random() < 0.2:
                parts += rng.choice([["", ""], ["3", "no atoms here", "lower case"], ["4"], ["4", "5"], ["note"]])
        out.append("\n".join(parts) + rng.choice(["", "\n"]))
    return out


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_packed_frames_are_read_in_byte_ranges(spark, tmp_path, size):
    import random
    import re

    want = {}
    for f, text in enumerate(xyz_texts(random.Random(size))):
        (tmp_path / f"{f}.xyz").write_text(text)
        want[f"{f}.xyz"] = [(k, int(m[1]), len(m[3].strip().split("\n")), m[2]) for k, m in enumerate(re.finditer(texts._FRAME.replace(r"\z", r"\Z"), text))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        frames = texts.scan_extxyz(spark, str(tmp_path)).collect()
        ranges = texts._lines(spark, str(tmp_path)).select("fname", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (ranges > 10) == (size < 1000)
    got = {}
    for r in frames:
        got.setdefault(r.fname.rsplit("/", 1)[1], []).append((r.frame, r.natoms, len(r.atoms), r.metadata.get("name")))
    for name, rows in want.items():
        assert sorted(got[name], key=lambda x: x[0]) == [(k, n, m, dict(re.findall(r"(\w+)=(\S+)", info)).get("name")) for k, n, m, info in rows]


def test_frames_are_cut_the_same_for_any_ranges():
    """The cutting alone, lines dealt to ranges of any length."""
    import random
    import re

    import pyarrow as pa

    class Rows:
        def mapInArrow(self, run, schema):
            self.run = run

    pattern, rows = re.compile(texts._FRAME.replace(r"\z", r"\Z")), Rows()
    texts._cut(rows)
    for seed in range(60):
        rng = random.Random(seed)
        for text in xyz_texts(rng):
            lines, size = text.rstrip("\n").split("\n"), rng.choice([1, 2, 3, 7, 20, 1000])
            columns = [["f"] * len(lines), [k // size * 10 for k in range(len(lines))], lines]
            batch = pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["fname", "block", "value"])
            cut = [r for out in rows.run(iter([batch])) for r in out.to_pylist()]
            items, at, groups = [(r["block"], 1, r["n"], r["text"]) for r in cut if r["kind"] == texts._WHOLE], 0, {}
            for r in sorted((r for r in cut if r["kind"] in (texts._LEAD, texts._TAIL)), key=lambda r: (r["block"], r["kind"])):
                at += r["kind"] == texts._TAIL
                groups.setdefault(at, []).append(r)
            items += [(g[0]["block"], 2 if k else 0, 0, "\n".join(r["text"] for r in g)) for k, g in groups.items()]
            found = [m.groups() for item in sorted(items) for m in pattern.finditer(item[3])]
            plain = lambda ms: [(a, b, c.strip("\n")) for a, b, c in ms]
            assert plain(found) == plain(m.groups() for m in pattern.finditer("\n".join(lines)))


def test_logs_are_read_frame_by_frame(spark, tmp_path):
    frame = " Final free energy (E-TS) = {e} eV\n * H 1 {e} 0.5 -1.0 *\n * O 1 0.0 0.0 {e} *\n junk\n * x {e} 0 0 *\n * y 0 1 0 *\n * z 0 0 2 *\n"
    (tmp_path / "a.castep").write_text("head\n * H 9 9.0 9.0 9.0 *\n" + "".join(frame.format(e=float(k)) for k in range(40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        got = {r.frame: r for r in texts.scan_castep_frames(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == list(range(1, 41))
    for k, r in got.items():
        e = float(k - 1)
        assert (r.energy, r.species) == (e, ["H", "O"]) and r.forces == [[e, 0.5, -1.0], [0.0, 0.0, e]] and r.stress == [[e, 0, 0], [0, 1, 0], [0, 0, 2]]


def test_splits_are_exact_and_keep_siblings(spark):
    labels = spark.createDataFrame([(f"P{k % 20}-shake-{k}",) for k in range(100)], "label string")
    got = datasets.split_grouped(labels, "label", chem.shake_parent_label(F.col("label")), [0.5, 0.25])
    parents = {}
    for r in got.withColumn("p", chem.shake_parent_label(F.col("label"))).collect():
        parents.setdefault(r.p, set()).add(r.part)
    assert all(len(v) == 1 for v in parents.values()) and len(parents) == 15


def test_nnls_and_standardiser(spark):
    import numpy as np

    a = np.array([[1.0, 2, 0.5], [0, 1, 3], [2, 0.1, 1], [1, 1, 1]])
    x = models.nnls(a.T @ a, a.T @ (a @ np.array([0.7, 0.0, 0.3])))
    assert x == pytest.approx([0.7, 0.0, 0.3], abs=1e-9)
    assert models.nnls(a.T @ a, a.T @ np.array([-1.0, -1, -1, -1])).tolist() == [0, 0, 0]
    vec = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    st = datasets.fit_standardizer(vec, "v")
    back = datasets.invert_standardizer(datasets.apply_standardizer(vec, "v", st, 2), "v", st, 2)
    assert sorted(r.v for r in back.collect()) == [[1.0, 5.0], [3.0, 5.0]]


def test_records_are_routed_from_a_folder(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(4):
        (inbox / f"{k}.res").write_text(RECORD.format(label=f"r{k}") if k != 2 else "TITL broken\nEND\n")
    good = F.col("natoms").isNotNull() & F.col("enthalpy").isNotNull()
    jobs.route_good_bad(jobs.stream_record_ingest(spark, str(inbox), 2), good, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.label for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["r0", "r1", "r3"]
    assert [r.label for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["broken"]


def test_saved_features_check_their_version(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1.0])], "label string, atom int, fvec array<double>")
    datasets.save_features(rows, str(tmp_path / "f"))
    assert datasets.load_features(spark, str(tmp_path / "f")).count() == 1
    with pytest.raises(ValueError):
        datasets.load_features(spark, str(tmp_path / "f"), "2.0")


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_rows_are_numbered_once_each(spark, adaptive):
    wide = spark.range(400_000).withColumns({"k": F.md5(F.col("id").cast("string")), "pad": F.repeat(F.lit("x"), 200), "g": F.when(F.col("id") % 3 > 0, F.col("id") % 2)})
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = datasets.numbered(wide, [F.col("k")])
        assert got.agg(F.count("*"), F.count_distinct("_n"), F.min("_n"), F.max("_n")).first()[:] == (400_000, 400_000, 1, 400_000)
        least = got.orderBy("_n").select("k").head(50)
        assert least == wide.select("k").orderBy("k").head(50)
        for r in datasets.numbered(wide, [F.col("k")], by="g").groupBy("g").agg(F.count("*").alias("c"), F.count_distinct("_n").alias("d"), F.max("_n").alias("m")).collect():
            assert r.c == r.d == r.m
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pairs_in_a_small_slanted_cell(spark):
    """A cell smaller than the cutoff: several images along each axis."""
    import itertools
    import random

    rng = random.Random(4)
    lattice = [[1.3, 0.0, 0.0], [0.7, 1.1, 0.0], [-0.4, 0.3, 0.9]]
    spots = [(k, *(rng.uniform(-1, 2) for _ in "xyz"), "AB"[k % 2]) for k in range(5)]
    atoms = spark.createDataFrame([("s", *r) for r in spots], "label string, atom int, fx double, fy double, fz double, species string")
    cells = spark.createDataFrame([("s", lattice), ("empty", lattice)], "label string, lattice array<array<double>>")
    got = sorted((r.i, r.j, round(r.r, 9), r.species_i, r.species_j) for r in neighbours.lattice_pairs(atoms, cells, 2.0, keep=("species",)).collect())
    want = []
    for (i, *f, a), (j, *g, b) in itertools.product(spots, spots):
        for n in itertools.product(range(-6, 7), repeat=3):
            d = [sum((g[k] % 1 + n[k] - f[k] % 1) * lattice[k][c] for k in range(3)) for c in range(3)]
            r = math.sqrt(sum(x * x for x in d))
            if 0 < r <= 2.0:
                want.append((i, j, round(r, 9), a, b))
    assert got == sorted(want)


def test_an_element_without_a_reference_raises(spark):
    least = spark.createDataFrame([("A", 1, -1.0), ("B", 2, -2.0)], "element string, kinds int, e double")
    needed = spark.createDataFrame([("A",), ("B",)], "element string")
    with pytest.raises(ValueError, match="B"):
        hull.elemental_references(least, F.col("kinds") == 1, "element", "e", needed)
    assert hull.elemental_references(least, F.col("kinds") > 0, "element", "e", needed).count() == 2


@pytest.mark.parametrize("d", [1, 2, 3])
def test_hull_of_parts_equals_all_simplices(spark, d, monkeypatch):
    import itertools

    import numpy as np

    monkeypatch.setattr(hull, "PART_ROWS", 12)
    rng = np.random.default_rng(d)
    x = rng.integers(0, 9, (60, d)) / 8
    x = np.vstack([np.zeros(d), np.eye(d), x[x.sum(axis=1) <= 1][: (40, 26, 14)[d - 1]]])
    e = np.concatenate([np.zeros(d + 1), -rng.random(len(x) - d - 1)])
    best = np.full(len(x), np.inf)
    for c in itertools.combinations(range(len(x)), d + 1):
        square = np.vstack([x[list(c)].T, np.ones(d + 1)])
        if abs(np.linalg.det(square)) > 1e-12:
            bary = np.linalg.solve(square, np.vstack([x.T, np.ones(len(x))]))
            held = (bary > -1e-8).all(axis=0)
            best[held] = np.minimum(best[held], (e[list(c)] @ bary)[held])
    names = [f"x{k}" for k in range(d)]
    pts = spark.createDataFrame([(k, *map(float, p), float(v)) for k, (p, v) in enumerate(zip(x, e))], ["key", *names, "e"])
    got = {r.key: r.e_above_hull for r in hull.e_above_hull(pts, pts, names, "e").collect()}
    assert [got[k] for k in range(len(x))] == pytest.approx((e - best).tolist(), abs=1e-7)
    flat = pts.filter("key = 0")
    assert [r.e_above_hull for r in hull.e_above_hull(flat, flat, names, "e").collect()] == [None]
    assert hull.e_above_hull(pts.limit(0), pts.limit(0), names, "e").count() == 0


def _bowl(d, n, seed=3):
    """Points whose lower hull has nearly all of them as vertices, some repeated or collinear."""
    rng = np.random.default_rng(seed)
    x = np.vstack([np.zeros(d), np.eye(d), rng.dirichlet(np.ones(d + 1), n)[:, :d]])
    e = ((x - 0.3) ** 2).sum(axis=1)
    e = np.where(np.arange(len(x)) <= d, 0.0, e - e.max() - 0.1)
    return np.vstack([x, x[-3:]]), np.concatenate([e, e[-3:]])


@pytest.mark.parametrize("d", [2, 3])
def test_facets_lie_below_all_points(d):
    """For many subsets, whatever the order of the first simplex."""
    x, e = _bowl(d, 300)
    rng = np.random.default_rng(0)
    for _ in range(20):
        k = rng.choice(len(x) - 3, 50, replace=False)
        found = [list(f) for f in hull.lower_facets(x[k], e[k])]
        assert {v for f in found for v in f} == set(range(50))
        for f in found:
            edges = x[k][f[1:]] - x[k][f[0]]
            slope = np.linalg.lstsq(edges, e[k][f[1:]] - e[k][f[0]], rcond=None)[0]
            assert (e[k] - x[k] @ slope).min() > e[k][f[0]] - x[k][f[0]] @ slope - 1e-6


@pytest.mark.parametrize("d,n,part", [(1, 200, 60), (2, 500, 150), (3, 300, 150)])
def test_hulls_larger_than_a_task_are_found_by_slopes(spark, d, n, part, monkeypatch):
    x, e = _bowl(d, n)
    names = [f"x{k}" for k in range(d)]
    pts = spark.createDataFrame([(k, *map(float, p), float(v)) for k, (p, v) in enumerate(zip(x, e, strict=True))], ["key", *names, "e"])
    whole = {r.key: r.e_above_hull for r in hull.e_above_hull(pts.withColumn("e", F.col("e") + 0.01 * (F.col("key") % 3 == 0).cast("int")), pts, names, "e").collect()}
    monkeypatch.setattr(hull, "PART_ROWS", part)
    sizes = []
    plain = hull._boxed

    def watched(points, dims):
        out = hull.kept(plain(points, dims), "boxes")
        sizes.extend(r["count"] for r in out.groupBy("box").count().collect())
        return out

    monkeypatch.setattr(hull, "_boxed", watched)
    parted = {r.key: r.e_above_hull for r in hull.e_above_hull(pts.withColumn("e", F.col("e") + 0.01 * (F.col("key") % 3 == 0).cast("int")), pts, names, "e").collect()}
    assert len(sizes) > 2 and max(sizes) <= part
    keys = sorted(whole)
    assert np.allclose([parted[k] for k in keys], [whole[k] for k in keys], atol=1e-7)
    assert all(abs(parted[k]) < 1e-7 for k in keys if k % 3)


def test_a_flat_hull_ends_after_some_cuts(spark, monkeypatch):
    """All points on one plane have one slope, so no cut tells them apart."""
    monkeypatch.setattr(hull, "PART_ROWS", 100)
    monkeypatch.setattr(hull, "LEVELS", 2)
    grid = [(i / 16, j / 16) for i in range(17) for j in range(17 - i)]
    pts = spark.createDataFrame([(k, x, y, -x - y / 2) for k, (x, y) in enumerate(grid)], "key int, x double, y double, e double")
    got = [r.e_above_hull for r in hull.e_above_hull(pts, pts, ["x", "y"], "e").collect()]
    assert len(got) == len(grid) and np.allclose(np.array(got, dtype=float), 0, atol=1e-7)


def test_summary_of_odd_tables(spark):
    from structlake.operators import evaluate

    kind = "label string, formula string, natoms int, target double, pred double"
    rows = [("a", "X", 2, 1.0, 2.0), ("b", "X", 2, 3.0, 5.0), ("c", "Y", 1, None, 1.0), ("d", None, 1, 2.0, 2.0), ("d", None, 1, 2.0, 2.0)]
    got = evaluate.evaluation_summary(spark.createDataFrame(rows, kind).dropna(subset=["target"]), "label").first()
    assert (got.n, got.n_formulas, got.label) == (4, 1, "b") and got.mae == pytest.approx(1.5 / 4) and got.spearman == pytest.approx(1.0)
    unknown = evaluate.evaluation_summary(spark.createDataFrame(rows[2:3], kind), "label").first()
    assert (unknown.n, unknown.n_formulas, unknown.rmse, unknown.mae) == (1, 1, None, None)
    empty = evaluate.evaluation_summary(spark.createDataFrame([], kind), "label").first()
    assert (empty.n, empty.n_formulas, empty.rmse, empty.label) == (0, 0, None, None)


def test_moving_average_over_many_blocks(spark):
    rows = spark.range(1000).select("id", (F.col("id") * F.col("id") % 17).cast("double").alias("v"))
    got = {r.id: r.m for r in datasets.moving_average(rows, "id", "v", 10, "m", block=64).collect()}
    v = [k * k % 17 for k in range(1000)]
    assert [got[k] for k in range(1000)] == pytest.approx([sum(v[max(0, k - 9) : k + 1]) / min(k + 1, 10) for k in range(1000)])


def test_extracted_records_are_written_and_skipped(spark, tmp_path):
    texts_ = spark.createDataFrame([(f"a-{k}", RECORD.format(label=f"a-{k}")) for k in range(3)] + [("b/1", RECORD.format(label="b/1"))], "label string, text string")
    shelx.save_extracted(texts_, "a-", f"{tmp_path}/packed")
    assert shelx.scan_shelx_headers(spark, f"{tmp_path}/packed").count() == 3
    shelx.save_extracted(texts_, "a-[01]", f"{tmp_path}/each", regex=True, per_label=True)
    shelx.save_extracted(texts_, "", f"{tmp_path}/each", per_label=True)
    got = spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}/each").filter("value like 'TITL%'")
    assert sorted(r.value.split()[1] for r in got.collect()) == ["a-0", "a-1", "a-2", "b/1"]


def test_records_with_carriage_returns_need_whole_files(spark, tmp_path):
    (tmp_path / "crlf.res").write_bytes("".join(RECORD.format(label=f"p{k}") for k in range(3)).replace("\n", "\r\n").encode())
    assert shelx.scan_shelx_headers(spark, str(tmp_path / "crlf.res"), whole=True).count() == 3
    with pytest.raises(Exception, match="whole=True"):
        shelx.scan_shelx_headers(spark, str(tmp_path / "crlf.res")).collect()


def test_loaded_structures_by_generation(spark, tmp_path):
    for gen in (0, 1, 2):
        (tmp_path / f"gen{gen}-dft").mkdir()
        (tmp_path / f"gen{gen}-dft" / "one.res").write_text(RECORD.format(label=f"g{gen}"))
    got = shelx.load_structures(spark, [], 1.0, 10.0, gens=[0, 2], root=str(tmp_path))
    assert {(r.label, r.gen, round(r.corrected, 9)) for r in got.collect()} == {(f"g{k}", k, round((-3.25 + 10.0 * 10.0 / chem.GPA_PER_EV_ANG3) / 3, 9)) for k in (0, 2)}
    assert shelx.load_structures(spark, f"{tmp_path}/gen?-dft/*.res", None).count() == 3


def test_long_compositions_reduce(spark):
    row = spark.sql("select map('A', 701408733L, 'B', 433494437L) as fib, map('A', 6000000000000000000L, 'B', 4000000000000000000L) as big, map() as none")
    got = row.select(chem.formula_units(F.col("fib")).alias("f"), chem.formula_units(F.col("big")).alias("b"), chem.formula_string(chem.reduce_composition(F.col("big"))).alias("t"), chem.formula_units(F.col("none").cast("map<string,bigint>")).alias("n")).first()
    assert (got.f, got.b, got.t, got.n) == (1, 2 * 10**18, "A3B2", 1)


def test_relative_energies_of_one_formula_can_stay(spark):
    from structlake.operators import evaluate

    rows = spark.createDataFrame([("f", 2.0, 4.0, 5.0), ("f", 1.0, 3.0, 3.5)], "formula string, natoms double, target double, pred double")
    assert {(r.rel_target, r.rel_pred) for r in evaluate.relative_energies(rows, always=False).collect()} == {(2.0, 2.5), (3.0, 3.5)}
    assert {(r.rel_target, r.rel_pred) for r in evaluate.relative_energies(rows).collect()} == {(0.0, 0.5), (1.0, 1.5)}
