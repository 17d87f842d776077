"""Ratings of entities that meet in pairs, and change points of series.

A rating depends on both sides' earlier events only. Inside a pool, events fall into *rounds*: an event is in the first
round after those of both sides' previous events. All events of a round are independent and are rated by one step on
arrays; a pool takes as many steps as its busiest entity has events. Pools are independent and spread over the cluster;
a pool (one league's season, say) is held by one task, so it must be a bounded unit: give a finer pool column otherwise.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from augury.session import dealt

# Fixed values of the two rating systems and the paired filter.
ELO_BASE, ELO_K, ELO_HOME, ELO_SCALE = 1500.0, 20.0, 35.0, 400.0
DYN_VAR, DYN_HOME = 0.07, 0.12
BT_VAR, BT_PRIOR, BT_INTERCEPT = 0.08, 1.5, 0.12
# Nodes and weights of a fixed normal quadrature for the mean of a logistic.
_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(21)
_WEIGHTS = _WEIGHTS / _WEIGHTS.sum()
_Z95 = 1.6448536269514722


def rounds(sides: np.ndarray) -> list[np.ndarray]:
    """Event numbers by round, for ``sides`` (events x 2) of entity codes in time order."""
    n = len(sides)
    event = np.repeat(np.arange(n), 2)
    later = pd.Series(event).groupby(sides.ravel()).shift(-1, fill_value=-1).to_numpy()
    later = np.where(later == event, -1, later)  # an entity that meets itself waits for nobody
    waits = np.bincount(later[later >= 0], minlength=n)
    follow = later.reshape(n, 2)
    out, now = [], np.flatnonzero(waits == 0)
    while len(now):
        out.append(now)
        nxt = follow[now].ravel()
        nxt = nxt[nxt >= 0]
        np.subtract.at(waits, nxt, 1)
        now = np.unique(nxt[waits[nxt] == 0])
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _rate(df: DataFrame, pool: Sequence[str], order: Sequence[str], home: str, away: str, label: str, start: Sequence[float], outputs: Sequence[str],
          step: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], np.ndarray, np.ndarray]], more: str | None = None) -> DataFrame:
    """Run ``step`` over the rounds of every pool. A state is a row of numbers that starts as ``start``; ``step`` gets both
    sides' states, the labels and the numbers of the column ``more`` (zero where it is missing) of a round, and returns the
    outputs and both sides' next states. A pool stays in Arrow columns: names are never objects of Python."""
    if not pool:
        raise ValueError("a pool column is required: one pool is one sequence")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(o, "ascending") for o in order])
        codes = pa.chunked_array([*rows.column(home).chunks, *rows.column(away).chunks]).combine_chunks().dictionary_encode("encode")
        sides = codes.indices.to_numpy().reshape(2, -1).T
        numbers = lambda c: rows.column(c).cast(pa.float64()).to_numpy()
        y = numbers(label)
        x = np.nan_to_num(numbers(more)) if more else np.zeros(len(y))
        state = np.tile(np.asarray(start, float), (len(codes.dictionary), 1))
        made = np.zeros((len(y), len(outputs)))
        for now in rounds(sides):
            h, a = sides[now].T
            out, new_h, new_a = step(state[h], state[a], y[now], x[now])
            made[now] = np.column_stack(out)
            state[h], state[a] = new_h, new_a
        for i, n in enumerate(outputs):
            rows = rows.append_column(n, pa.array(made[:, i]))
        return rows
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in outputs]])
    return df.groupBy(*pool).applyInArrow(run, schema)


def elo(events: DataFrame, pool: Sequence[str], order: Sequence[str], home: str = "home", away: str = "away",
        label: str = "home_win", margin: str = "margin", k: float = ELO_K, advantage: float = ELO_HOME) -> DataFrame:
    """Ratings of both sides before each event, and the home probability. Events without a label change nothing."""
    def step(h, a, y, margins):
        p = _logistic((h[:, 0] + advantage - a[:, 0]) / ELO_SCALE)
        size = np.minimum(np.abs(margins), 4.0)
        won = np.nan_to_num(k * (1.0 + size / 10.0) * (y - p))[:, None]
        return [h[:, 0], a[:, 0], p], h + won, a - won
    return _rate(events, pool, order, home, away, label, [ELO_BASE], ["elo_home_pre", "elo_away_pre", "elo_home_prob"], step, margin)


def _gain(var_h: np.ndarray, var_a: np.ndarray, p: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Gauss-Newton step of a logistic likelihood with curvature p (1 - p) on the difference of two independent
    states: both sides' shares of the innovation, the innovation, and the curvature; all zero without a label."""
    seen = ~np.isnan(y)
    curve = np.maximum(p * (1.0 - p), least)
    share = curve / (1.0 + curve * (var_h + var_a))
    return np.where(seen, share, 0.0), np.where(seen, np.nan_to_num(y) - p, 0.0) / curve, curve


def _moved(mean: np.ndarray, var: np.ndarray, share: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """The state after an innovation ``pull``; a variance never falls under 1e-4 by an update."""
    gain = var * share
    return np.column_stack([mean + gain * pull, np.where(share > 0, np.maximum(var * (1.0 - gain), 1e-4), var)])


def dynamic_rating(events: DataFrame, pool: Sequence[str], order: Sequence[str], home: str = "home", away: str = "away",
                   label: str = "home_win", drift: float = DYN_VAR) -> DataFrame:
    """Mean and variance filter per entity; emits the state before each event."""
    def step(h, a, y, _):
        vh, va = h[:, 1] + drift, a[:, 1] + drift
        p = _logistic(h[:, 0] - a[:, 0] + DYN_HOME)
        share, pull, _ = _gain(vh, va, p, y, 1e-4)
        return [h[:, 0], a[:, 0], p, vh + va], _moved(h[:, 0], vh, share, pull), _moved(a[:, 0], va, share, -pull)
    return _rate(events, pool, order, home, away, label, [0.0, 1.0], ["dyn_home_mean", "dyn_away_mean", "dyn_home_prob", "dyn_var"], step)


def paired_state(events: DataFrame, pool: Sequence[str], order: Sequence[str], home: str = "home", away: str = "away",
                 label: str = "home_win", offset: str | None = None, intercept: float = BT_INTERCEPT,
                 process_var: float = BT_VAR, prior_var: float = BT_PRIOR, strength: float = 1.0) -> DataFrame:
    """Paired-comparison state filter: mean, 5 % and 95 % of the home probability before each event.

    ``offset`` is a linear score of other columns. The interval is the logistic of normal quantiles, exact
    because the logistic is monotone; the mean is a fixed quadrature. Centring all means after each
    event shifts every entity alike and so cancels in every difference; it is left out.
    """
    def step(h, a, y, base):
        vh, va = h[:, 1] + process_var, a[:, 1] + process_var
        z = intercept + strength * (h[:, 0] - a[:, 0]) + base
        sd = np.sqrt(np.maximum(strength**2 * (vh + va), 1e-6))
        p = _logistic(z)
        share, pull, _ = _gain(vh, va, p, y, 1e-3)
        mean = _logistic(z[:, None] + sd[:, None] * _NODES) @ _WEIGHTS
        return [h[:, 0], a[:, 0], mean, _logistic(z - _Z95 * sd), _logistic(z + _Z95 * sd)], _moved(h[:, 0], vh, share, pull), _moved(a[:, 0], va, share, -pull)
    return _rate(events, pool, order, home, away, label, [0.0, prior_var], ["bt_home", "bt_away", "bt_mean", "bt_low", "bt_high"], step, offset)


def paired_state_fit(events: DataFrame, pool: Sequence[str], order: Sequence[str], features: Sequence[str], passes: int = 2,
                     home: str = "home", away: str = "away", label: str = "home_win") -> DataFrame:
    """Offline passes: filter, regress the result on strength difference and features, filter again.

    The regression is MLlib's over all pools; only its few coefficients reach the driver.
    """
    from augury.operators.models import penalized_logit, linear_terms
    out, offset, intercept, strength = None, None, BT_INTERCEPT, 1.0
    frame = events
    for i in range(passes):
        out = paired_state(frame, pool, order, home, away, label, offset, intercept, strength=strength)
        if i == passes - 1:
            break
        train = dealt(out.where(F.col(label).isNotNull()).select(label, (F.col("bt_home") - F.col("bt_away")).alias("strength_diff"), *features))  # filtered once for all passes of the fit
        model = penalized_logit(train, ["strength_diff", *features], label, c=0.8, l1=0.0)
        intercept, coefs = linear_terms(model)
        strength = max(coefs["strength_diff"], 1e-3)
        lin = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * coefs[f] for f in features), F.lit(0.0))
        frame, offset = events.withColumn("_offset", lin), "_offset"
    return out.drop("_offset")


def alarms(walks: Sequence[np.ndarray], limit: float, burn: int, cool: int) -> list[tuple[int, float]]:
    """(place, statistic) of each alarm. A walk's statistic is its height over its lowest point since the last restart
    (the restart included); the largest of ``walks`` counts. It alarms above ``limit`` from the ``burn``-th value on and
    ``cool`` values or more after the last alarm, and then restarts. Each stretch between alarms is one pass on arrays."""
    found, start, n = [], 0, len(walks[0])
    while start < n:
        heights = [np.cumsum(w[start:]) for w in walks]
        stat = np.max([c - np.minimum(np.minimum.accumulate(c), 0.0) for c in heights], axis=0)
        first = max(burn - 1, found[-1][0] + cool if found else 0, start)
        hit = np.flatnonzero(stat[first - start:] > limit)
        if not len(hit):
            break
        at = first + int(hit[0])
        found.append((at, float(stat[at - start])))
        start = at + 1
    return found


def detectors(x: np.ndarray, target: float, spread: float) -> dict[str, tuple[list[np.ndarray], float]]:
    """The walks and limits of both tests for a series with a target and a scale of at least 0.05: Page-Hinkley sums
    what exceeds the running mean and a slack, CUSUM what lies beyond the target and a slack, upwards and downwards."""
    mean = np.cumsum(x) / np.arange(1, len(x) + 1)
    slack = max(0.02, 0.20 * spread)
    return {"page_hinkley": ([x - mean - max(0.01, 0.05 * spread)], max(0.35, 2.5 * spread)), "cusum": ([x - target - slack, target - x - slack], max(0.45, 3.0 * spread))}


def change_points(scores: DataFrame, series: Sequence[str], order: Sequence[str], value: str, at_least: int = 30) -> DataFrame:
    """Page-Hinkley and CUSUM alerts of every series with ``at_least`` values, with burn-in, cool-down and restart.

    A series is one value per step of time (average first), so its length is bounded by the calendar; it is one group.
    """
    series, order = list(series), list(order)
    rows = scores.where(F.col(value).isNotNull()).select(*series, *order, F.col(value).cast("double").alias("value"))
    kinds = [f for f in rows.schema.fields if f.name in (*series, *order)]
    schema = T.StructType([*kinds, T.StructField("row", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("method", T.StringType()),
                           T.StructField("statistic", T.DoubleType()), T.StructField("threshold", T.DoubleType())])

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order, kind="stable").reset_index(drop=True)
        x, n = own["value"].to_numpy(), len(own)
        parts = []
        if n >= at_least:
            for method, (walks, limit) in detectors(x, x.mean(), max(x.std(), 0.05)).items():
                got = alarms(walks, limit, max(20, min(60, n // 5)), max(10, min(30, n // 12)))
                at = [i for i, _ in got]
                parts.append(own.iloc[at].assign(row=at, method=method, statistic=[s for _, s in got], threshold=limit))
        return pd.concat(parts)[schema.names] if parts else pd.DataFrame(columns=schema.names)
    return rows.groupBy(*series).applyInPandas(run, schema)
