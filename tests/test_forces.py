"""Forces against finite differences, made structures, fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlake.functions import chem
from structlake.operators import features, fitting, forces, generate, models, neighbours

BOX, RC = 4.0, 1.9


def _energy_and_forces(spark, points, slopes_of, basis=(chem.cutoff_fr, chem.cutoff_gfr)):
    rows = [("s", k + 1, *map(float, p), "AB"[k % 2]) for k, p in enumerate(points)]
    atoms = spark.createDataFrame(rows, "label string, atom int, x double, y double, z double, species string")
    pairs = neighbours.neighbour_pairs(atoms, RC, BOX, keep=("species",))
    triplets = neighbours.neighbour_triplets(pairs, RC, keep=("species",), vectors=True)
    spec = features.build_feature_spec(spark, ["A", "B"], [2.0, 3.0], [2.0], [2.0])
    table = features.two_body_features(pairs, spec, RC, basis[0]).unionByName(features.three_body_features(triplets, spec, RC, basis[0]))
    slopes = slopes_of(spec)
    core = pairs.agg(F.sum(chem.core_repulsion(F.col("r"), 1.0, 3))).first()[0] or 0.0
    energy = table.join(slopes, "slot").agg(F.sum(F.col("slope") * F.col("value"))).first()[0] + core
    bonds = forces.two_body_bonds(pairs, spec, slopes, RC, basis).unionByName(forces.three_body_bonds(triplets, spec, slopes, RC, basis)).unionByName(forces.core_bonds(pairs, chem.core_repulsion_grad(F.col("r"), 1.0, 3)))
    return energy, bonds, atoms


#: A basis that isn't the default one: (1 + cos(pi r / rcut)) / 2.
COSINE = (lambda r, c: (1 + F.cos(r * (np.pi / c))) / 2, lambda r, c: -F.sin(r * (np.pi / c)) * (np.pi / c / 2))


@pytest.mark.parametrize("basis", [(chem.cutoff_fr, chem.cutoff_gfr), COSINE])
def test_forces_are_slopes_of_the_energy(spark, basis):
    points = np.random.default_rng(3).uniform(0.5, 2.6, (5, 3))
    slopes = lambda spec: spec.select("slot", F.sin("slot").alias("slope"))
    _, bonds, atoms = _energy_and_forces(spark, points, slopes, basis)
    got = {r.atom: (r.fx, r.fy, r.fz) for r in forces.score_forces(bonds, atoms).collect()}
    assert len(got) == 5 and np.abs(np.sum(list(got.values()), axis=0)).max() < 1e-9
    for atom, axis in ((4, 2),):
        step = np.zeros_like(points)
        step[atom - 1, axis] = 1e-5
        up, down = (_energy_and_forces(spark, points + s * step, slopes, basis)[0] for s in (1, -1))
        assert got[atom][axis] == pytest.approx(-(up - down) / 2e-5, rel=1e-4, abs=1e-5)
    stress = forces.score_stress(bonds, spark.createDataFrame([("s", BOX**3), ("empty", 1.0)], "label string, volume double"))
    rows = {r.label: r for r in stress.collect()}
    assert rows["s"].sxy == pytest.approx(rows["s"].syx) and rows["empty"].sxx == 0


def test_made_structures(spark):
    got = generate.generate_model_structures(spark, ["B", "A"], 3, 1.0, 2.0, 5)
    assert got.count() == 4 * 5 * 3 and got.filter("label = 'A-A-B-1.25'").count() == 3
    edges = neighbours.neighbour_pairs(got.filter("label = 'A-A-B-1.25'"), 5.0, 50.0)
    assert {round(r.r, 9) for r in edges.collect()} == {1.25}
    kept = generate.structure_transform(got, "label", lambda pdf: pdf[pdf["species"] == "A"], got.schema.simpleString()[7:-1].replace(":", " "))
    assert kept.filter("species <> 'A'").count() == 0 and kept.count() > 0


def test_energies_of_made_structures(spark):
    made = generate.generate_model_structures(spark, ["A", "B"], 2, 1.0, 3.0, 3)
    spec = features.build_feature_spec(spark, ["A", "B"], [2.0], [2.0], [1.0])
    members = {"m1": [1.0, 10.0, *[0.5] * 4, *[7.0] * 6], "m2": [0.0, 0.0, *[-0.25] * 4, *[7.0] * 6]}
    got = {r.label: r for r in generate.model_structure_energies(made, spec, members, {"m1": 0.5, "m2": 0.5}, 2.5, 20.0, chem.core_repulsion(F.col("r"), 1.5)).collect()}
    assert len(got) == 9
    for kinds, one in (("A-A", 2.0), ("A-B", 11.0), ("B-B", 20.0)):
        for r in (1.0, 2.0, 3.0):
            pair = (2 * (1 - r / 2.5)) ** 2 if r <= 2.5 else 0.0
            core = (2 * (1.5 / r - 1)) ** 12 if r < 1.5 else 0.0
            row = got[f"{kinds}-{r}"]
            assert row.energy == pytest.approx(0.5 * one + 0.125 * 2 * pair + 2 * core) and row.per_atom == row.energy / 2


def test_cells_without_volume_stay_as_they_were(spark):
    flat = spark.createDataFrame([("f", 1.0, 1.0, 1.0, 10.0, 10.0, 170.0)], "label string, a double, b double, c double, alpha double, beta double, gamma double")
    row = generate.shaken_cells(flat, 1, 0.01).first()
    assert (row.a, row.gamma, row.shaken) == (1.0, 170.0, "f-shake-1")


def test_bonded_units_of_a_long_chain(spark):
    atoms = spark.range(1, 41).select(F.lit("c").alias("label"), F.col("id").alias("atom"))
    near = [("c", k, k + 1, 1.0) for k in range(1, 40) if k != 20]
    pairs = spark.createDataFrame(near + [(a, j, i, r) for a, i, j, r in near], "label string, i long, j long, r double")
    got = {r.atom: r.module for r in generate.bond_modules(atoms, pairs, 1.5).collect()}
    assert got == {k: 1 if k <= 20 else 21 for k in range(1, 41)}


def test_slopes_of_the_network_and_fit(spark):
    sizes, rng = [2, 3, 1], np.random.default_rng(0)
    theta, x = fitting.initial_parameters(sizes, 1), rng.normal(size=(4, 2))
    rows = fitting.energies_and_slopes(x, theta, sizes)
    for k in range(fitting.n_parameters(sizes)):
        step = np.zeros_like(theta)
        step[k] = 1e-6
        up, down = (fitting.energies_and_slopes(x, theta + s * step, sizes)[:, 0] for s in (1, -1))
        assert rows[:, k + 1] == pytest.approx((up - down) / 2e-6, abs=1e-7)
    data = spark.createDataFrame([(k // 2, [float(a), float(b)]) for k, (a, b) in enumerate(rng.normal(size=(80, 2)))], "label long, v array<double>")
    truth = fitting.initial_parameters(sizes, 9)
    targets = fitting.score_parameters(data, "label", "v", truth, sizes).withColumnRenamed("energy", "h").persist()
    seen: list = []
    best, history = fitting.fit_mlp_lm(data.persist(), targets, "label", "v", "h", sizes, steps=8, on_step=lambda *row: seen.append(row))
    log = fitting.history_table(spark, history).orderBy("step").collect()
    assert seen == history and [r.best for r in log] == np.minimum.accumulate([h[2] for h in history]).tolist()
    assert history[-1][1] < 0.5 * history[0][1] and min(h[2] for h in history) < history[0][2]


def test_models_come_back_in_order_of_their_numbers(spark, tmp_path):
    rows = spark.createDataFrame([("m10", 0.5, [1.0], None), ("m2", 0.5, [1.0, 2.0, 3.0], [1, 1])], "model_id string, weight double, params array<double>, sizes array<int>")
    models.save_models(rows, str(tmp_path / "m"))
    got = models.load_models(spark, str(tmp_path / "m")).orderBy("position").collect()
    assert [(r.model_id, r.kind) for r in got] == [("m2", "mlp"), ("m10", "linear")]


def structures(spark, n=60, width=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k // 3, rng.normal(size=width).tolist()) for k in range(3 * n)]
    targets = {}
    for k, v in rows:
        targets[k] = targets.get(k, 0.0) + float(np.sin(v[0]) + v[1] * v[2])
    return spark.createDataFrame(rows, "label long, v array<double>"), spark.createDataFrame(sorted(targets.items()), "label long, h double"), rows, targets


def test_sums_of_structures_equal_plain_numpy(spark, monkeypatch):
    data, targets, rows, known = structures(spark)
    sizes, p = [3, 4, 1], fitting.n_parameters([3, 4, 1])
    thetas = [fitting.initial_parameters(sizes, k) for k in range(3)]
    packed = fitting.packed_structures(data.repartition(3), targets, "label", "v", "h")
    monkeypatch.setattr(fitting, "SLOPE_NUMBERS", 100)
    full = fitting.normal_equations(packed, thetas, sizes)
    vectors = [np.random.default_rng(k).normal(size=p) for k in range(3)]
    products = fitting.normal_products(packed, thetas, vectors, sizes)
    rmses = fitting._rmses(packed, thetas, sizes)
    monkeypatch.setattr(fitting, "DIRECT", 5)
    diagonals = fitting.normal_equations(packed, thetas, sizes)
    for k, theta in enumerate(thetas):
        g = np.zeros((60, p + 1))
        np.add.at(g, [r[0] for r in rows], fitting.energies_and_slopes(np.array([r[1] for r in rows]), theta, sizes))
        r, j = g[:, 0] - np.array([known[i] for i in range(60)]), g[:, 1:]
        w = np.abs(r + 1e-4) ** -0.75
        a = (j * w[:, None]).T @ j
        assert full[k][0] == pytest.approx(a) and full[k][1] == pytest.approx(j.T @ (w * r)) and full[k][2] == pytest.approx((np.abs(r + 1e-4) ** 1.25).sum())
        assert products[k] == pytest.approx(a @ vectors[k]) and diagonals[k][0] == pytest.approx(np.diag(a))
        assert rmses[k] == pytest.approx(np.sqrt(np.mean(r * r)))


def test_conjugate_gradients_take_the_same_steps(spark, monkeypatch):
    data, targets, *_ = structures(spark, 30)
    sizes = [3, 2, 1]
    _, direct = fitting.fit_mlp_lm(data, targets, "label", "v", "h", sizes, steps=3)
    monkeypatch.setattr(fitting, "DIRECT", 1)
    monkeypatch.setattr(fitting, "CG_RESIDUAL", 1e-10)
    _, free = fitting.fit_mlp_lm(data, targets, "label", "v", "h", sizes, steps=3)
    assert len(free) == len(direct) and np.array(free) == pytest.approx(np.array(direct), rel=1e-5)


def test_many_parameters_need_no_matrix(spark, monkeypatch):
    data, targets, *_ = structures(spark, 40, width=40)
    sizes = [40, 100, 1]
    assert fitting.n_parameters(sizes) > 4000
    monkeypatch.setattr(fitting, "CG_STEPS", 4)
    most = []
    whole = fitting.slot_sums
    monkeypatch.setattr(fitting, "slot_sums", lambda *args: most.append(len(out := whole(*args)) and out.size) or out)
    _, history = fitting.fit_mlp_lm(data, targets, "label", "v", "h", sizes, steps=1)
    assert history[-1][1] < history[0][1] and max(most) <= 2 * fitting.n_parameters(sizes) + 1


def test_damping_stays_within_bounds():
    for factor, end in ((0.0, fitting.LEAST_DAMPING), (2.0, fitting.MOST_DAMPING)):
        fit = fitting.Fit(0, np.zeros(1), end)
        member = fitting._member(fit, 1, 5)
        next(member)
        member.send((np.eye(1), np.ones(1), 5.0))
        member.send(1.0)
        with pytest.raises(StopIteration):
            # a step as good as foreseen, or a refused one
            member.send((np.eye(1), np.ones(1), 1.0 if not factor else 9.0))
            member.send(0.5)
        assert fit.done and fit.damping == end and fit.step == 1


def test_ensembles_are_refilled_and_go_on(spark, tmp_path, monkeypatch):
    data, targets, *_ = structures(spark, 30)
    sizes, run = [3, 2, 1], dict(label="label", vector="v", target="h", sizes=[3, 2, 1], steps=3)
    begin = fitting.initial_parameters
    # every second start is of no use
    monkeypatch.setattr(fitting, "initial_parameters", lambda s, seed: begin(s, seed) * (np.nan if seed % 2 else 1.0))
    good = fitting.train_ensemble(data, targets, n_models=3, batch=2, **run)
    assert len(good) == 3 and np.isfinite(good).all()
    with pytest.raises(ValueError, match="1 of 3"):
        fitting.train_ensemble(data, targets, n_models=3, batch=2, most_tries=2, **run)

    # a run that dies goes on from its last save and gives what a whole one gives
    place, calls, whole = f"file://{tmp_path}/fits", [], fitting.normal_equations

    def dies(rows, thetas, sizes_):
        calls.append(len(thetas))
        if len(calls) == 5:
            raise RuntimeError("lost")
        return whole(rows, thetas, sizes_)

    monkeypatch.setattr(fitting, "normal_equations", dies)
    with pytest.raises(RuntimeError, match="lost"):
        fitting.train_ensemble(data, targets, n_models=3, batch=2, store=place, **run)
    before = fitting.FitStore(spark, place).load()
    assert before and any(f.step > 0 for f in before)
    again = fitting.train_ensemble(data, targets, n_models=3, batch=2, store=place, **run)
    assert np.array(again) == pytest.approx(np.array(good), rel=1e-9)
    done = len(calls)
    assert np.array(fitting.train_ensemble(data, targets, n_models=3, batch=2, store=place, **run)) == pytest.approx(np.array(good), rel=1e-9) and len(calls) == done
    assert fitting.n_parameters(sizes) == len(good[0])


def test_weights_of_many_members(spark):
    rng = np.random.default_rng(5)
    a, names = rng.normal(size=(400, 256)), [f"m{k}" for k in range(256)]
    true = np.where(np.arange(256) % 16 == 0, rng.uniform(0.5, 1, 256), 0.0)
    scores = spark.createDataFrame([(n, names[k], float(a[n, k])) for n in range(400) for k in range(256)] + [(999, "m1", 1.0)], "label long, model_id string, energy double")
    targets = spark.createDataFrame([(n, float(a[n] @ true)) for n in range(400)] + [(999, 5.0)], "label long, target double")
    got = models.nnls_ensemble_weights(scores, targets, "label", names)
    assert set(got) == {n for n, w in zip(names, true) if w} and got == pytest.approx({n: w for n, w in zip(names, true) if w})
    wide = spark.createDataFrame([(*row.tolist(), float(row @ true[:12] * 2)) for row in a[:100, :12]], [*names[:12], "y"])
    assert models.fit_linear(wide, names[:12], "y") == pytest.approx((2 * true[:12]).tolist(), abs=1e-9)
