"""Many penalised logistic fits at once: every fold at every grid point, replicates, or any number of groups.

Rows are read once per step for all fits together. Tasks multiply matrices over Arrow batches and hand on sums of the
first two derivatives; small systems are solved from the sums. The penalty stands beside the sum of the losses:
``lam * ((1 - l1) / 2 * |b|^2 + l1 * |b|)`` without the intercept, on columns filled by their median and scaled.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from augury.functions.columns import stack_long
from augury.operators.ordered import exact_quantiles
from augury.session import cut_lineage, dealt

Point = tuple[float, float]  # penalty, share of the absolute values in it
MOST_STEPS, SETTLED = 60, 1e-9
FEW_GROUPS = 10_000  # coefficients of so many groups are broadcast
# The penalties that are tried, by kind of fit.
RIDGE = tuple(2.0**e for e in range(5, -5, -1))
LASSO = tuple(2.0**e for e in range(6, -4, -1))
ELASTIC = tuple(2.0**e for e in range(5, -4, -1))
RATIOS = (0.05, 0.15, 0.3, 0.5, 0.7, 0.85, 0.95)


def grid_points(kind: str) -> list[Point]:
    """The grid of a kind of fit: ridge, lasso or elastic."""
    return {"ridge": [(x, 0.0) for x in RIDGE], "lasso": [(x, 1.0) for x in LASSO], "elastic": [(x, r) for x in ELASTIC for r in RATIOS]}[kind]


class Fits(NamedTuple):
    """Fits by fold: the columns' medians, means and deviations, the points, and a row of coefficients per point."""
    cols: list[str]
    fill: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    points: dict[int, list[Point]]
    beta: dict[int, np.ndarray]


def _matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in cols])


def _scaled(x: np.ndarray, fill: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    median, mean, sd = fill
    x = np.where(np.isfinite(x), x, median)
    return np.column_stack([np.ones(len(x)), np.where(sd > 0, (x - mean) / np.where(sd > 0, sd, 1.0), 0.0)])


def _mu(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x @ beta.T / 2))


def _halves(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k)


def derivative_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Per fit (a row of ``beta``): the gradient of the log likelihood and the upper half of X'WX, side by side."""
    mu = _mu(x, beta)
    w = np.ones_like(mu) if weight is None else weight
    i, j = _halves(x.shape[1])
    return np.hstack([(w * (y[:, None] - mu)).T @ x, (w * mu * (1 - mu)).T @ (x[:, i] * x[:, j])])


def next_beta(sums: np.ndarray, beta: np.ndarray, lam: float, l1: float) -> np.ndarray:
    """The minimum of the quadratic model around ``beta``: one solve, or coordinate descent where absolute values count."""
    k = len(beta)
    g, h = sums[:k], np.zeros((k, k))
    h[_halves(k)] = sums[k:]
    h = h + np.triu(h, 1).T
    ridge = np.full(k, lam * (1 - l1))
    ridge[0] = 0.0
    a, c = h + np.diag(ridge) + 1e-10 * np.eye(k), g + h @ beta  # minimise b'Ab/2 - c'b + lam * l1 * |b|
    if lam * l1 == 0:
        return np.linalg.solve(a, c)
    b, cut = beta.copy(), np.full(k, lam * l1)
    cut[0] = 0.0
    for _ in range(2000):
        old = b.copy()
        for j in range(k):
            r = c[j] - a[j] @ b + a[j, j] * b[j]
            b[j] = np.sign(r) * max(abs(r) - cut[j], 0.0) / a[j, j]
        if np.abs(b - old).max() < 1e-12:
            break
    return b


SUMS = "fold int, at int, value double"


def _rows_of(folds: Mapping[int, np.ndarray]) -> pa.RecordBatch:
    """Sums as rows, which Spark adds up by fold and place."""
    f = np.concatenate([np.full(v.size, k) for k, v in folds.items()]) if folds else np.empty(0)
    at = np.concatenate([np.arange(v.size) for v in folds.values()]) if folds else np.empty(0)
    v = np.concatenate([v.ravel() for v in folds.values()]) if folds else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(v.astype(float))], ["fold", "at", "value"])


def _added(rows: DataFrame, fn, shapes: Mapping[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """What ``fn`` sums up over the batches of every task, per fold; as many numbers reach the driver as the fits have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(of):
                if int(fold) in shapes:
                    part = fn(int(fold), batch.filter(pa.array(of == fold)))
                    held[int(fold)] = held[int(fold)] + part if int(fold) in held else part
        yield _rows_of(held)
    out = {f: np.zeros(s) for f, s in shapes.items()}
    for r in rows.mapInArrow(run, SUMS).groupBy("fold", "at").agg(F.sum("value").alias("value")).collect():
        out[r["fold"]].ravel()[r["at"]] = r["value"]
    return out


def _added_each(rows: DataFrame, fns: Mapping[int, Callable[[pa.RecordBatch], np.ndarray]]) -> dict[int, np.ndarray]:
    """What every function sums up over all batches of all tasks: rows are read once, whatever the number of functions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, fn in fns.items():
                part = fn(batch)
                held[key] = held[key] + part if key in held else part
        yield _rows_of(held)
    out: dict[int, dict[int, float]] = {key: {} for key in fns}
    for r in rows.mapInArrow(run, SUMS).groupBy("fold", "at").agg(F.sum("value").alias("value")).collect():
        out[r["fold"]][r["at"]] = r["value"]
    return {key: np.array([v[i] for i in range(len(v))]) for key, v in out.items()}


def _slim(rows: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull()).select(F.col("fold").cast("int").alias("fold"), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])


def fit_points(train: DataFrame, cols: Sequence[str], label: str, points: Mapping[int, Sequence[Point]]) -> Fits:
    """Fit every point of every fold over ``train`` (with ``fold``): a pass over the rows per step, for all of them.

    Folds without rows of both classes have no fit. Raises if a coefficient still moves after ``MOST_STEPS`` steps.
    """
    cols, rows = list(cols), dealt(_slim(train, cols, label))
    both = {r["fold"] for r in rows.groupBy("fold").agg(F.min("_y").alias("a"), F.max("_y").alias("b")).where("a < b").collect()}
    points = {f: list(p) for f, p in points.items() if f in both}
    q = exact_quantiles(stack_long(rows, ["fold"], cols), ["fold", "feature"], "value", [0.5]).collect()  # a number per fold and column
    median = {f: {c: 0.0 for c in cols} for f in points}
    for r in q:
        if r["fold"] in median:
            median[r["fold"]][r["feature"]] = r["quantile"]
    start = {f: (np.array([median[f][c] for c in cols]), np.zeros(len(cols)), np.ones(len(cols))) for f in points}

    def moments(fold, batch):
        x = _scaled(_matrix(batch, cols), start[fold])[:, 1:]
        return np.vstack([np.full(x.shape[1], len(x)), x.sum(axis=0), (x * x).sum(axis=0)])
    fill = {}
    for f, (n, s, ss) in _added(rows, moments, {f: (3, len(cols)) for f in points}).items():
        fill[f] = (start[f][0], s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0.0)))
    k = len(cols) + 1
    beta = {f: np.zeros((len(p), k)) for f, p in points.items()}
    moving = set(points)
    for _ in range(MOST_STEPS):
        if not moving:
            return Fits(cols, fill, points, beta)
        now = {f: beta[f] for f in moving}

        def step(fold, batch):
            return derivative_sums(_scaled(_matrix(batch, cols), fill[fold]), batch.column("_y").to_numpy(zero_copy_only=False), now[fold])
        sums = _added(rows, step, {f: (len(points[f]), k + k * (k + 1) // 2) for f in moving})
        for f in list(moving):
            new = np.array([next_beta(s, b, *p) for s, b, p in zip(sums[f], beta[f], points[f])])
            if np.abs(new - beta[f]).max() < SETTLED:
                moving.discard(f)
            beta[f] = new
    raise RuntimeError(f"fits still move after {MOST_STEPS} steps")


def score_points(valid: DataFrame, fits: Fits, label: str) -> DataFrame:
    """``fold``, ``point``, ``lam``, ``l1``, ``n``, ``log_loss``, ``brier`` and ``accuracy`` of every fit on its fold's ``valid`` rows."""
    def score(fold, batch):
        y = batch.column("_y").to_numpy(zero_copy_only=False)[:, None]
        p = np.clip(_mu(_scaled(_matrix(batch, fits.cols), fits.fill[fold]), fits.beta[fold]), 1e-6, 1 - 1e-6)
        per = [np.ones_like(p), -(y * np.log(p) + (1 - y) * np.log(1 - p)), (p - y) ** 2, (p >= 0.5) == (y == 1)]
        return np.column_stack([x.sum(axis=0) for x in per])
    sums = _added(_slim(valid, fits.cols, label), score, {f: (len(p), 4) for f, p in fits.points.items()})
    out = [(f, i, *map(float, p), int(s[0]), *(float(v / s[0]) for v in s[1:])) for f, of in fits.points.items() for i, (p, s) in enumerate(zip(of, sums[f])) if s[0]]
    return valid.sparkSession.createDataFrame(out, "fold int, point int, lam double, l1 double, n long, log_loss double, brier double, accuracy double")


def predict_points(valid: DataFrame, fits: Fits, keep: Sequence[str], out: str = "pred") -> DataFrame:
    """``keep`` columns of the rows of every fold that has fits, ``fold``, ``point`` and the probability."""
    src = valid.select(F.col("fold").cast("int").alias("fold"), *keep, *[F.col(c).cast("double").alias(f"_x_{c}") for c in fits.cols])
    names = [f"_x_{c}" for c in fits.cols]
    kept = ["fold", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(of):
                if int(fold) not in fits.beta:
                    continue
                part = batch.filter(pa.array(of == fold))
                p = np.clip(_mu(_scaled(_matrix(part, names), fits.fill[int(fold)]), fits.beta[int(fold)]), 1e-6, 1 - 1e-6)
                for i in range(p.shape[1]):
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(np.full(len(part), i, np.int32)), pa.array(p[:, i])], [*kept, "point", out])
    schema = T.StructType([src.schema["fold"], *[src.schema[c] for c in keep], T.StructField("point", T.IntegerType()), T.StructField(out, T.DoubleType())])
    return src.mapInArrow(run, schema)


# ---- fits that differ by their columns ----------------------------------------------------------
class Design(NamedTuple):
    """A fit's columns made from the raw ones, their means and deviations, and its coefficients, intercept first."""
    make: Callable[[np.ndarray], np.ndarray]
    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        made = self.make(x)
        return np.column_stack([np.ones(len(made)), np.where(self.sd > 0, (made - self.mean) / np.where(self.sd > 0, self.sd, 1.0), 0.0)])

    def prob(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_mu(self.scaled(x), self.beta[None])[:, 0], 1e-6, 1 - 1e-6)


def fit_designs(rows: DataFrame, cols: Sequence[str], label: str, makes: Sequence[Callable[[np.ndarray], np.ndarray]], lam: float) -> list[Design]:
    """A ridge fit per function of ``makes``, each of which makes its columns from the raw ``cols`` (without nulls).

    All fits read the rows once per step; their columns exist in the tasks only. Raises if one does not settle.
    """
    cols = list(cols)

    def moments(make):
        def sums(batch):
            x = make(_matrix(batch, cols))
            return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return sums

    def step(design):
        def sums(batch):
            y = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
            return derivative_sums(design.scaled(_matrix(batch, cols)), y, design.beta[None])[0]
        return sums
    fits = []
    for make, s in zip(makes, _added_each(rows, {i: moments(m) for i, m in enumerate(makes)}).values()):
        k = (len(s) - 1) // 2
        mean = s[1:k + 1] / s[0]
        var = s[k + 1:] / s[0] - mean ** 2
        flat = var <= 1e-12 * (1e-12 + s[k + 1:] / s[0])
        fits.append(Design(make, mean, np.where(flat, 0.0, np.sqrt(np.where(flat, 1.0, var))), np.zeros(k + 1)))
    moving = set(range(len(fits)))
    for _ in range(MOST_STEPS):
        if not moving:
            return fits
        for i, s in _added_each(rows, {i: step(fits[i]) for i in moving}).items():
            new = next_beta(s, fits[i].beta, lam, 0.0)
            if np.abs(new - fits[i].beta).max() < SETTLED:
                moving.discard(i)
            fits[i] = fits[i]._replace(beta=new)
    raise RuntimeError(f"fits still move after {MOST_STEPS} steps")


def score_designs(rows: DataFrame, cols: Sequence[str], label: str, fits: Sequence[Design]) -> np.ndarray:
    """Log loss and Brier score of every fit over the rows, read once: a row of the result per fit."""
    cols = list(cols)

    def score(design):
        def sums(batch):
            y, p = batch.column(label).to_numpy(zero_copy_only=False).astype(float), design.prob(_matrix(batch, cols))
            return np.array([len(y), -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), ((p - y) ** 2).sum()])
        return sums
    sums = _added_each(rows, {i: score(d) for i, d in enumerate(fits)})
    return np.array([sums[i][1:] / sums[i][0] for i in range(len(fits))])


def slopes(fits: Fits, fold: int, point: int = 0) -> tuple[float, dict[str, float]]:
    """Intercept and slopes of a fit on the columns' own scale."""
    _, mean, sd = fits.fill[fold]
    b = fits.beta[fold][point]
    own = np.divide(b[1:], sd, out=np.zeros(len(sd)), where=sd > 0)
    return float(b[0] - own @ mean), dict(zip(fits.cols, map(float, own)))


def tune_points(folds: DataFrame, cols: Sequence[str], label: str, points: Sequence[Point], fold_ids: Sequence[int]) -> tuple[DataFrame, Fits]:
    """Mean scores of every grid point over time-ordered folds, best first (log loss, then Brier, then accuracy), and the fits."""
    fits = fit_points(folds.where("role = 'train'"), cols, label, {f: points for f in fold_ids})
    per = score_points(folds.where("role = 'valid'"), fits, label)
    mean = per.groupBy("point", "lam", "l1").agg(F.count(F.lit(1)).alias("folds_used"), *[F.avg(c).alias(c) for c in ("log_loss", "brier", "accuracy")])
    return mean.orderBy("log_loss", "brier", F.desc("accuracy"), "point"), fits


# ---- any number of groups -----------------------------------------------------------------------
def group_logits(rows: DataFrame, cols: Sequence[str], label: str, group: str, ridge: float = 1e-3, steps: int = 6) -> DataFrame:
    """``group``, ``n`` and ``beta`` (intercept first) of a ridge fit per group, on the columns as they are, null as zero.

    Each step joins the groups' coefficients to their rows, adds up derivatives in the map tasks, and solves a small system
    per group in tasks, so there may be any number of groups. Coefficients of ``FEW_GROUPS`` or fewer are broadcast, so that
    rows stay where they are, however few groups hold them. Steps are checked in lots of ``steps``.
    """
    k = len(cols) + 1
    x = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    data = dealt(rows.where(F.col(label).isNotNull()).select(F.col(group).alias("_g"), F.col(label).cast("double").alias("_y"), x.alias("_x")))
    i, j = (v.tolist() for v in _halves(k))
    fit = cut_lineage(data.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumns({"_b": F.array(*[F.lit(0.0)] * k), "_move": F.lit(0.0)}))
    near = F.broadcast if fit.count() <= FEW_GROUPS else lambda of: of

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c.startswith("_s")])
            new, move = [], []
            for s, b in zip(sums, batch.column("_b").to_pylist()):
                b = np.array(b)
                got = next_beta_all(s, b, ridge)
                new.append(got.tolist()), move.append(float(np.abs(got - b).max()))
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("_n"), pa.array(new, pa.list_(pa.float64())), pa.array(move, pa.float64())], ["_g", "_n", "_b", "_move"])
    schema = T.StructType([data.schema["_g"], T.StructField("_n", T.LongType()), T.StructField("_b", T.ArrayType(T.DoubleType())), T.StructField("_move", T.DoubleType())])
    for step in range(1, MOST_STEPS + 1):
        eta = sum((F.col("_x")[a] * F.col("_b")[a] for a in range(k)), F.lit(0.0))
        met = data.join(near(fit), "_g").withColumn("_m", 1.0 / (1.0 + F.exp(-eta)))
        w, r = F.col("_m") * (1 - F.col("_m")), F.col("_y") - F.col("_m")
        g = [F.sum(r * F.col("_x")[a]).alias(f"_s{a}") for a in range(k)]
        h = [F.sum(w * F.col("_x")[a] * F.col("_x")[b]).alias(f"_s{k + c}") for c, (a, b) in enumerate(zip(i, j))]
        fit = met.groupBy("_g", "_n", "_b").agg(*g, *h).mapInArrow(solve, schema)
        if step % steps == 0:
            fit = cut_lineage(fit)
            move = fit.agg(F.max("_move")).first()[0]
            if move is None or move < SETTLED:
                return fit.select(F.col("_g").alias(group), F.col("_n").alias("n"), F.col("_b").alias("beta"))
    raise RuntimeError(f"fits still move by {move} after {MOST_STEPS} steps")


def next_beta_all(sums: np.ndarray, beta: np.ndarray, ridge: float) -> np.ndarray:
    """A Newton step with the ridge on every coefficient, the intercept too."""
    k = len(beta)
    h = np.zeros((k, k))
    h[_halves(k)] = sums[k:]
    h = h + np.triu(h, 1).T + ridge * np.eye(k)
    return beta + np.linalg.solve(h, sums[:k] - ridge * beta)


def replicate_logits(rows: DataFrame, cols: Sequence[str], label: str, weights: str, n: int, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of ``n`` fits that differ by their row weights, the array column ``weights``: a row adds its weighted
    derivatives to all of them in its task, so rows are not multiplied. One row of the result per replicate."""
    slim = dealt(rows.where(F.col(label).isNotNull()).select(F.lit(0).alias("fold"), F.col(label).cast("double").alias("_y"), F.col(weights).alias("_w"),
                                                              *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]))
    k = len(cols) + 1
    beta = np.zeros((n, k))
    for _ in range(MOST_STEPS):
        def step(fold, batch):
            x = np.column_stack([np.ones(len(batch)), _matrix(batch, cols)])
            w = np.asarray(batch.column("_w").flatten(), float).reshape(len(batch), n)
            return derivative_sums(x, batch.column("_y").to_numpy(zero_copy_only=False), beta, w)
        sums = _added(slim, step, {0: (n, k + k * (k + 1) // 2)})[0]
        new = np.array([next_beta_all(s, b, ridge) for s, b in zip(sums, beta)])
        moved, beta = np.abs(new - beta).max(), new
        if moved < SETTLED:
            return beta
    raise RuntimeError(f"fits still move after {MOST_STEPS} steps")
