"""Does a feature act in a bent way? Spline fits beside the linear one, response curves, and a verdict per feature."""
from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from augury.functions.columns import stack_long
from augury.operators.logits import fit_designs, score_designs
from augury.operators.ordered import exact_quantiles
from augury.session import cut_lineage

# What a verdict needs, and the size of the curves.
MIN_ROWS, MIN_UNIQUE, KNOTS, GRID = 80, 8, 5, 25
GAIN_MODERATE, GAIN_STRONG, GAP_STRONG, NEAR_GAIN = 0.002, 0.005, 0.040, 1e-4
FLAT_STEP = 1e-9  # smaller steps of a curve are rounding, not a direction
SMOOTH, HINGE = 3, 1  # degrees of the splines

VERDICTS = ("feature string, status string, best_shape string, family_hint string, recommendation string, skip_reason string, n_unique long, n_non_missing long, "
            "log_loss_gain double, brier_gain double, train_gain double, shape_gap double, direction_changes int, "
            "smooth_gain double, hinge_gain double, smooth_brier_gain double, hinge_brier_gain double, smooth_gap double, hinge_gap double")
CURVES = "feature string, grid_rank int, grid_value double, linear_prob double, smooth_prob double, hinge_prob double"


def spline_columns(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline columns of ``x`` over rising ``knots``, the last one left out; straight lines beyond the outer knots.

    The knots go on by the width of the outermost gaps on either side.
    """
    low, high = knots[0], knots[-1]
    t = np.concatenate([low - (knots[1] - low) * np.arange(degree, 0, -1), knots, high + (high - knots[-2]) * np.arange(1, degree + 1)])
    at = np.clip(x, low, high)[:, None]
    b = ((at >= t[:-1]) & (at < t[1:])).astype(float)
    end = at[:, 0] == high  # belongs to the gap that it closes
    b[end] = 0.0
    b[end, degree + len(knots) - 2] = 1.0
    slope = np.zeros(1)
    for d in range(1, degree + 1):
        wide = t[d:] - t[:-d]
        slope = d * (b[:, :-1] / wide[:-1] - b[:, 1:] / wide[1:])
        b = (at - t[:-d - 1]) / wide[:-1] * b[:, :-1] + (t[d + 1:] - at) / wide[1:] * b[:, 1:]
    return (b + slope * (x[:, None] - at))[:, :-1]


def _bent(x: np.ndarray, at: int, knots: np.ndarray, degree: int) -> np.ndarray:
    return np.column_stack([np.delete(x, at, axis=1), spline_columns(x[:, at], knots, degree)])


def _straight(x: np.ndarray) -> np.ndarray:
    return x


def _turns(curve: np.ndarray) -> int:
    steps = np.diff(curve)
    signs = np.sign(steps[np.abs(steps) > FLAT_STEP])
    return int((signs[1:] != signs[:-1]).sum())


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(F.abs(x) < float("inf"), x)


def _verdict(smooth: dict, hinge: dict) -> dict:
    """The better of two bent fits and what its gains say."""
    by_gap = abs(hinge["gain"] - smooth["gain"]) <= NEAR_GAIN and hinge["gap"] > smooth["gap"]
    shape, best = ("hinge", hinge) if hinge["gain"] > smooth["gain"] + NEAR_GAIN or by_gap else ("smooth", smooth)
    if best["train"] <= 0:
        status = "weak"
    elif best["gain"] >= GAIN_STRONG:
        status = "strong"
    elif best["gain"] >= GAIN_MODERATE or (best["gain"] > 0 and best["gap"] >= GAP_STRONG):
        status = "moderate"
    else:
        status = "weak"
    if status == "weak":
        return {"status": status, "best_shape": "linear"}
    if shape == "hinge":
        family, advice = "mars", "consider_piecewise_transform_or_mars"
    else:
        family, advice = "gam", "consider_spline_transform_or_gam" if best["turns"] <= 1 else "consider_gam"
    return {"status": status, "best_shape": shape, "family_hint": family, "recommendation": advice, "log_loss_gain": best["gain"], "brier_gain": best["brier"],
            "train_gain": best["train"], "shape_gap": best["gap"], "direction_changes": best["turns"]}


def nonlinearity_verdicts(train: DataFrame, holdout: DataFrame, cols: Sequence[str], label: str, c: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A verdict per feature, best first (``rank``), and response curves over a grid of its values.

    For each feature a cubic spline and a piecewise linear one (knots at quantiles of the training rows; equal knots count
    once) take the place of its column in a ridge fit of all features. Gains are in holdout and training scores against
    the linear fit; curves hold the other features at their medians. All fits share a pass over the rows per step, and
    only their sums, quantiles and curves reach the driver. Infinite values count as missing, missing ones as the median.
    Features with too few rows or values, or without rows of both classes to learn from, have status ``skip``.
    """
    cols, spark = list(cols), train.sparkSession

    def clean(df):
        return df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), *[_finite(x).alias(x) for x in cols])
    raw, valid = cut_lineage(clean(train)), cut_lineage(clean(holdout))
    long = stack_long(raw, [], cols).where(F.col("value").isNotNull())
    merged = cut_lineage(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    size = {r["feature"]: (r["n"], r["u"]) for r in merged.groupBy("feature").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u")).collect()}
    probs = [0.5, *np.linspace(0.05, 0.95, GRID)]
    quantile = {(r["feature"], r["prob"]): r["quantile"] for r in exact_quantiles(long, ["feature"], "value", sorted({float(p) for p in probs})).collect()}
    median = {x: quantile.get((x, 0.5), 0.0) for x in cols}
    few = [x for x in cols if 0 < size.get(x, (0, 0))[1] <= GRID]
    values: dict[str, list[float]] = {x: [] for x in few}
    for r in merged.where(F.col("feature").isin(few)).select("feature", "value").collect():  # GRID values a feature at most
        values[r["feature"]].append(r["value"])
    fill = lambda df: cut_lineage(df.fillna(median))
    rows, held = fill(raw), fill(valid)
    knots: dict[str, list[float]] = {}
    for r in exact_quantiles(stack_long(rows, [], cols), ["feature"], "value", [i / (KNOTS - 1) for i in range(KNOTS)]).orderBy("feature", "prob").collect():
        knots.setdefault(r["feature"], []).append(r["quantile"])
    classes = rows.agg(F.min("_y").alias("a"), F.max("_y").alias("b")).first()
    enough = classes["a"] is not None and classes["a"] < classes["b"] and not held.isEmpty()

    out, makes, found = {}, [_straight], []
    for i, x in enumerate(cols):
        n, unique = size.get(x, (0, 0))
        at = np.unique(knots.get(x, []))
        why = ("insufficient_data" if not enough else "too_few_non_missing_rows" if n < MIN_ROWS else "too_few_unique_values" if unique < MIN_UNIQUE
               else "too_few_knots" if len(at) < 2 else "")
        out[x] = {"feature": x, "status": "skip", "best_shape": "linear", "family_hint": "keep_linear", "recommendation": "keep_linear", "skip_reason": why,
                  "n_unique": unique, "n_non_missing": n, "direction_changes": 0}
        if not why:
            found.append(x)
            makes += [partial(_bent, at=i, knots=at, degree=SMOOTH), partial(_bent, at=i, knots=at, degree=HINGE)]
    curves = []
    if found:
        fits = fit_designs(rows, cols, "_y", makes, 1.0 / c)
        learnt, shown = score_designs(rows, cols, "_y", fits), score_designs(held, cols, "_y", fits)
        for j, x in enumerate(found):
            grid = np.array(sorted(values[x])) if x in values else np.unique([quantile[x, float(p)] for p in probs[1:]])
            points = np.tile([median[o] for o in cols], (len(grid), 1))
            points[:, cols.index(x)] = grid
            line = fits[0].prob(points)
            bent = {}
            for name, k in (("smooth", 2 * j + 1), ("hinge", 2 * j + 2)):
                curve = fits[k].prob(points)
                bent[name] = {"gain": float(shown[0, 0] - shown[k, 0]), "brier": float(shown[0, 1] - shown[k, 1]), "train": float(learnt[0, 0] - learnt[k, 0]),
                              "gap": float(np.abs(curve - line).max()), "turns": _turns(curve), "curve": curve}
            out[x].update(_verdict(bent["smooth"], bent["hinge"]))
            out[x].update({f"{name}_{key}": b[of] for name, b in bent.items() for key, of in (("gain", "gain"), ("brier_gain", "brier"), ("gap", "gap"))})
            curves += [(x, i + 1, *map(float, v)) for i, v in enumerate(zip(grid, line, bent["smooth"]["curve"], bent["hinge"]["curve"]))]
    names = [p.split()[0] for p in VERDICTS.split(", ")]
    order = {"strong": 0, "moderate": 1, "weak": 2, "skip": 3}
    ranked = sorted(out.values(), key=lambda r: (order[r["status"]], -r.get("log_loss_gain", 0.0), -r.get("shape_gap", 0.0), r["feature"]))
    verdicts = [(*(r.get(n, 0.0) for n in names), i + 1) for i, r in enumerate(ranked)]
    return spark.createDataFrame(verdicts, f"{VERDICTS}, rank int"), spark.createDataFrame(curves, CURVES)
