"""Networks fitted to structure energies by damped least squares.

A structure's energy is the sum of its atoms' network outputs. Structures are packed
once, a row each with its vectors and its target, so every step is one Spark job without
a shuffle of features: tasks give sums over their structures, Spark adds these up by
slot. Small networks send their normal equations, p x p numbers for p parameters, to the
driver. Larger ones never form them: conjugate gradients need only products of the
normal matrix with a vector, and each sends p numbers. Members of an ensemble take their
steps side by side, in batches, and their state is a table from which a fit goes on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.paths import kept

#: Fixed values of the fit: loss power, offset, least gain, damping factors and bounds, least diagonal.
POWER, OFFSET, LEAST_GAIN, GOOD_GAIN, EASE, TIGHTEN = 1.25, 1e-4, 1e-3, 0.75, 0.2, 2.0
LEAST_DAMPING, MOST_DAMPING, LEAST_DIAGONAL = 1e-16, 1e16, 1e-6
#: Up to so many parameters the normal equations are formed; members of a batch, by their numbers.
DIRECT, BATCH_NUMBERS = 300, 1 << 23
#: Slopes that a task holds at once, and the end of conjugate gradients.
SLOPE_NUMBERS, CG_STEPS, CG_RESIDUAL = 1 << 22, 60, 1e-6


def n_parameters(sizes: list[int]) -> int:
    return sum((a + 1) * b for a, b in zip(sizes, sizes[1:]))


def initial_parameters(sizes: list[int], seed: int) -> np.ndarray:
    """Uniform weights scaled by the layer's width; biases nought."""
    rng, parts = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        bound = math.sqrt(6 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), np.zeros(b)]
    return np.concatenate(parts)


def as_layers(theta: np.ndarray, sizes: list[int]) -> list[tuple[list[list[float]], list[float], str]]:
    """Layers as ``models.score_mlp`` takes them: tanh, and a linear last one."""
    out, at = [], 0
    for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
        w, bias = theta[at : at + a * b].reshape(b, a), theta[at + a * b : at + (a + 1) * b]
        out.append((w.tolist(), bias.tolist(), "linear" if k == len(sizes) - 2 else "tanh"))
        at += (a + 1) * b
    return out


def energies_and_slopes(x: np.ndarray, theta: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rows of (energy, slopes by theta) for rows of features."""
    layers = as_layers(theta, sizes)
    values = [x]
    for w, bias, act in layers:
        z = values[-1] @ np.array(w).T + np.array(bias)
        values.append(np.tanh(z) if act == "tanh" else z)
    back, parts = np.ones((len(x), 1)), []
    for (w, _, act), before, after in zip(layers[::-1], values[-2::-1], values[:0:-1], strict=True):
        if act == "tanh":
            back = back * (1 - after * after)
        parts = [(back[:, :, None] * before[:, None, :]).reshape(len(x), -1), back, *parts]
        back = back @ np.array(w)
    return np.hstack([values[-1], *parts])


def packed_structures(features: DataFrame, targets: DataFrame, label: str, vector: str, target: str) -> DataFrame:
    """y, x: the target of each structure and its vectors, one after another. A written table.

    A structure is a row, so it has to fit a task. Structures without target and rows
    without a vector are left out.
    """
    rows = features.filter(F.col(vector).isNotNull()).groupBy(F.col(label).alias("_l")).agg(F.flatten(F.collect_list(F.transform(vector, lambda v: v.cast("double")))).alias("x"))
    known = targets.filter(F.col(target).isNotNull()).select(F.col(label).alias("_t"), F.col(target).cast("double").alias("y"))
    return kept(rows.join(known, F.col("_l") == F.col("_t")).select("y", "x"), "structures")


def slot_sums(rows: DataFrame, start: Callable[[], np.ndarray], add: Callable) -> np.ndarray:
    """An array that all tasks add to: ``add(total, batch)`` adds an Arrow batch to one of ``start()``.

    Tasks' arrays are added by slot, so the driver gets as many numbers as there are slots.
    """
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        total = start()
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["slot", "value"])

    got = rows.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    total = start()
    total.reshape(-1)[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    return total


def _structures(batch, width: int, numbers: int):
    """(targets, vectors, structure of each vector) of an Arrow batch (y, x), in parts of about so many slopes."""
    y, x = batch.column(0).to_numpy(), batch.column(1)
    off, flat = x.offsets.to_numpy(), x.values.to_numpy()
    atoms = np.diff(off) // width
    ends, at = np.cumsum(atoms), 0
    while at < len(y):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + numbers, side="right")))
        yield y[at:to], flat[off[at] : off[to]].reshape(-1, width), np.repeat(np.arange(to - at), atoms[at:to])
        at = to


def _by_structure(x: np.ndarray, owner: np.ndarray, n: int, theta: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Rows of (energy, slopes) of each structure."""
    out = np.zeros((n, len(theta) + 1))
    step = max(1, SLOPE_NUMBERS // (len(theta) + 1))
    for lo in range(0, len(x), step):
        part, mine = energies_and_slopes(x[lo : lo + step], theta, sizes), owner[lo : lo + step]
        first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        out[mine[first]] += np.add.reduceat(part, first, axis=0)
    return out


def _weights(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.abs(r + OFFSET)
    return size, np.maximum(size, 1e-12) ** (POWER - 2)


def _each(sizes: list[int], thetas: list[np.ndarray], row: Callable) -> Callable:
    """An ``add`` for ``slot_sums``: for each member ``row(total[m], m, residuals, slopes)``."""
    p = len(thetas[0])

    def add(total, batch):
        for y, x, owner in _structures(batch, sizes[0], max(1, SLOPE_NUMBERS // (p + 1))):
            for m, theta in enumerate(thetas):
                g = _by_structure(x, owner, len(y), theta, sizes)
                row(total[m], m, g[:, 0] - y, g[:, 1:])

    return add


def normal_equations(rows: DataFrame, thetas: list[np.ndarray], sizes: list[int]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(J'WJ or, beyond DIRECT parameters, its diagonal; J'Wr; loss) of every member."""
    p = len(thetas[0])
    direct = p <= DIRECT

    def row(total, m, r, j):
        size, w = _weights(r)
        a = ((j * w[:, None]).T @ j).ravel() if direct else (w[:, None] * j * j).sum(axis=0)
        total += np.concatenate([a, j.T @ (w * r), [(size**POWER).sum()]])

    n_a = p * p if direct else p
    sums = slot_sums(rows, lambda: np.zeros((len(thetas), n_a + p + 1)), _each(sizes, thetas, row))
    return [(x[:n_a].reshape(p, p) if direct else x[:n_a], x[n_a:-1], float(x[-1])) for x in sums]


def normal_products(rows: DataFrame, thetas: list[np.ndarray], vectors: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """J'WJ v for every member, without its matrix."""

    def row(total, m, r, j):
        total += j.T @ (_weights(r)[1] * (j @ vectors[m]))

    return list(slot_sums(rows, lambda: np.zeros((len(thetas), len(thetas[0]))), _each(sizes, thetas, row)))


def _rmses(rows: DataFrame, thetas: list[np.ndarray], sizes: list[int]) -> list[float]:
    layers = [as_layers(t, sizes) for t in thetas]

    def add(total, batch):
        for y, x, owner in _structures(batch, sizes[0], SLOPE_NUMBERS // max(sizes)):
            for m in range(len(thetas)):
                z = x
                for w, bias, act in layers[m]:
                    z = z @ np.array(w).T + np.array(bias)
                    z = np.tanh(z) if act == "tanh" else z
                r = np.bincount(owner, weights=z[:, 0], minlength=len(y)) - y
                total[m] += [r @ r, len(y)]

    return [math.sqrt(a / n) if n else math.nan for a, n in slot_sums(rows, lambda: np.zeros((len(thetas), 2)), add)]


@dataclass
class Fit:
    """A fit's state after its last whole step."""

    seed: int
    theta: np.ndarray
    damping: float
    step: int = 0
    best: np.ndarray | None = None
    best_rmse: float = math.inf
    best_step: int = 0
    done: bool = False
    note: Callable[[int, float, float], None] | None = field(default=None, repr=False)

    def usable(self) -> bool:
        return self.best is not None and bool(np.isfinite(self.best).all()) and math.isfinite(self.best_rmse)


def _solved(a: np.ndarray, g: np.ndarray, theta: np.ndarray, damping: float) -> Generator:
    """(J'WJ + damping D) delta = -g, by the matrix or by conjugate gradients with D for preconditioner."""
    d = np.maximum(np.diag(a) if a.ndim == 2 else a, LEAST_DIAGONAL)
    if a.ndim == 2:
        return np.linalg.lstsq(a + damping * np.diag(d), -g, rcond=None)[0]
    delta, r = np.zeros_like(g), -g
    scale = (1 + damping) * d
    z = r / scale
    v, rz = z, r @ z
    end = CG_RESIDUAL**2 * rz
    for _ in range(CG_STEPS):
        if not rz > end:
            break
        product = (yield "product", (theta, v)) + damping * d * v
        step = rz / (v @ product)
        delta, r = delta + step * v, r - step * product
        z = r / scale
        rz, before = r @ z, rz
        v = z + rz / before * v
    return delta


def _member(fit: Fit, steps: int, patience: int) -> Generator:
    """Goes on with a fit: asks for sums at some parameters, and keeps ``fit`` up to date."""
    note = fit.note or (lambda *row: None)
    theta = fit.theta
    a, g, loss = yield "normal", theta
    if fit.best is None:
        rmse = yield "rmse", theta
        note(0, loss, rmse)
        if not (np.isfinite(a).all() and np.isfinite(loss) and math.isfinite(rmse)):
            fit.done = True
            return
        fit.best, fit.best_rmse = theta, rmse
    while fit.step < steps and fit.step - fit.best_step <= patience:
        damping = fit.damping
        delta = yield from _solved(a, g, theta, damping)
        d = np.maximum(np.diag(a) if a.ndim == 2 else a, LEAST_DIAGONAL)
        foreseen = POWER / 2 * (damping * delta @ (d * delta) - delta @ g)
        if not foreseen > 0:
            break
        a2, g2, loss2 = yield "normal", theta + delta
        step, rmse = fit.step + 1, None
        if (loss - loss2) / foreseen > LEAST_GAIN:
            good = (loss - loss2) / foreseen > GOOD_GAIN
            theta, a, g, loss = theta + delta, a2, g2, loss2
            rmse = yield "rmse", theta
            note(step, loss, rmse)
            damping = max(damping * EASE, LEAST_DAMPING) if good else damping
        else:
            damping = min(damping * TIGHTEN, MOST_DAMPING)
        fit.theta, fit.damping, fit.step = theta, damping, step
        if rmse is not None and rmse < fit.best_rmse:
            fit.best, fit.best_rmse, fit.best_step = theta, rmse, step
    fit.done = True


def _advance(fits: list[Fit], train: DataFrame, test: DataFrame, sizes: list[int], steps: int, patience: int, saved: Callable[[], None] | None = None) -> None:
    """Brings all fits to their ends; what they ask for at a time is one job of each kind."""
    ask = {
        "normal": lambda wanted: normal_equations(train, wanted, sizes),
        "product": lambda wanted: normal_products(train, [t for t, _ in wanted], [v for _, v in wanted], sizes),
        "rmse": lambda wanted: _rmses(test, wanted, sizes),
    }
    members = [_member(f, steps, patience) for f in fits]
    waiting = {k: next(m) for k, m in enumerate(members)}
    before = None
    while waiting:
        for kind, answer in ask.items():
            asking = [k for k, (what, _) in waiting.items() if what == kind]
            if not asking:
                continue
            for k, value in zip(asking, answer([waiting[k][1] for k in asking]), strict=True):
                try:
                    waiting[k] = members[k].send(value)
                except StopIteration:
                    del waiting[k]
        state = [(f.step, f.done, f.best is not None) for f in fits]
        if saved is not None and state != before:
            saved()
        before = state


def fit_mlp_lm(train: DataFrame, targets: DataFrame, label: str, vector: str, target: str, sizes: list[int], test: DataFrame | None = None, steps: int = 30, patience: int = 5, damping: float = 1.0, seed: int = 0, on_step: Callable[[int, float, float], None] | None = None) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """(parameters, history of (step, loss, test RMSE)); the best on ``test`` is kept.

    A step is taken when it gains more than a small part of what the quadratic
    model foresees; damping then falls, or rises after a refusal, within its bounds. The fit ends
    after ``patience`` steps without a lower RMSE on ``test`` (``train`` if absent). ``on_step``
    is called with every row of the history as it is made. A fit that breaks down at its
    start gives parameters that aren't finite.
    """
    history: list[tuple[int, float, float]] = []

    def note(*row) -> None:
        history.append(row)
        if on_step is not None:
            on_step(*row)

    rows = packed_structures(train, targets, label, vector, target)
    held = rows if test is None else packed_structures(test, targets, label, vector, target)
    fit = Fit(seed, initial_parameters(sizes, seed), damping, note=note)
    _advance([fit], rows, held, sizes, steps, patience)
    return fit.best if fit.best is not None else np.full_like(fit.theta, math.nan), history


def score_parameters(features: DataFrame, label: str, vector: str, theta: np.ndarray, sizes: list[int]) -> DataFrame:
    """label, energy of a network given by its parameters."""
    from .models import score_mlp

    return score_mlp(features, label, vector, as_layers(theta, sizes))


def history_table(spark: SparkSession, history: list[tuple[int, float, float]]) -> DataFrame:
    """step, loss, rmse, best: the history of a fit with the least RMSE so far."""
    least = [min(h[2] for h in history[: k + 1]) for k in range(len(history))]
    return spark.createDataFrame([(int(s), float(a), float(b), float(c)) for (s, a, b), c in zip(history, least, strict=True)], "step int, loss double, rmse double, best double")


STATE = "seed long, theta array<double>, damping double, step int, best array<double>, best_rmse double, best_step int, done boolean"


class FitStore:
    """States of fits under a folder: every save is a new table, the newest whole one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._to(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _saves(self) -> list[str]:
        if not self._fs.exists(self._to(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._to(self.path))]
        return sorted(n for n in names if n.startswith("save-") and self._fs.exists(self._to(f"{self.path}/{n}/_SUCCESS")))

    def save(self, fits: list[Fit]) -> None:
        rows = [(f.seed, f.theta.tolist(), f.damping, f.step, None if f.best is None else f.best.tolist(), f.best_rmse, f.best_step, f.done) for f in fits]
        old = self._saves()
        turn = int(old[-1][5:]) + 1 if old else 0
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/save-{turn:08d}")
        for name in old[:-1]:
            self._fs.delete(self._to(f"{self.path}/{name}"), True)

    def load(self) -> list[Fit]:
        """The fits of the newest save, by seed. A row for each member comes to the driver."""
        saves = self._saves()
        if not saves:
            return []
        rows = self.spark.read.schema(STATE).parquet(f"{self.path}/{saves[-1]}").orderBy("seed").collect()
        return [Fit(r.seed, np.array(r.theta), r.damping, r.step, None if r.best is None else np.array(r.best), r.best_rmse, r.best_step, r.done) for r in rows]


def train_ensemble(train: DataFrame, targets: DataFrame, label: str, vector: str, target: str, sizes: list[int], n_models: int, least_share: float = 0.9, test: DataFrame | None = None, steps: int = 30, patience: int = 5, damping: float = 1.0, store: str | None = None, batch: int | None = None, most_tries: int | None = None) -> list[np.ndarray]:
    """Parameters of ``n_models`` members fitted from different random starts.

    Members take their steps in the same jobs, ``batch`` of them at a time (by their
    numbers where left out). A fit that breaks down is replaced by one from another
    start, until there are enough or ``most_tries`` (four times ``n_models``) were
    made; then at least ``least_share`` of ``n_models`` are needed. With ``store``, a folder
    that is shared, the state is saved after every step, and a run that was ended goes
    on where it was; finished members aren't fitted again.
    """
    spark = train.sparkSession
    rows = packed_structures(train, targets, label, vector, target)
    held = rows if test is None else packed_structures(test, targets, label, vector, target)
    p = n_parameters(sizes)
    numbers = p * p + 2 * p if p <= DIRECT else 3 * p
    batch = batch or max(1, BATCH_NUMBERS // numbers)
    tries = most_tries or 4 * n_models
    keeper = FitStore(spark, store) if store else None
    fits = keeper.load() if keeper else []
    while True:
        usable = sum(f.done and f.usable() for f in fits)
        open_ = [f for f in fits if not f.done][:batch]
        while len(open_) < min(batch, n_models - usable) and len(fits) < tries:
            seed = 1 + max((f.seed for f in fits), default=-1)
            open_.append(Fit(seed, initial_parameters(sizes, seed), damping))
            fits.append(open_[-1])
        if usable >= n_models or not open_:
            break
        _advance(open_, rows, held, sizes, steps, patience, (lambda: keeper.save(fits)) if keeper else None)
    good = [f.best for f in fits if f.done and f.usable()][:n_models]
    if len(good) < least_share * n_models:
        raise ValueError(f"{len(good)} of {n_models} fits are usable")
    return good
