"""Verdicts on bent features against a plain fit by hand."""
import numpy as np
import pytest

from augury.operators import shapes as S

COLS = ["bend", "line", "few"]


def hat(x, knots, i):
    """The hat function with its top at knot ``i``, straight beyond the ends."""
    y = np.zeros(len(knots))
    y[i] = 1.0
    out = np.interp(x, knots, y)
    for end, gap in ((0, 1), (-1, -2)):
        slope = (y[gap] - y[end]) / (knots[gap] - knots[end])
        beyond = x < knots[0] if end == 0 else x > knots[-1]
        out = np.where(beyond, y[end] + slope * (x - knots[end]), out)
    return out


def ridge_fit(x, y, lam=1.0):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    b, pen = np.zeros(z.shape[1]), np.diag([0.0] + [lam] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (y - p) - pen @ b)
    return lambda v: 1 / (1 + np.exp(-(np.column_stack([np.ones(len(v)), (v - mean) / sd]) @ b)))


def loss(y, p):
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=1500), rng.normal(size=1500), rng.integers(0, 3, 1500).astype(float)])
    y = (rng.random(1500) < 1 / (1 + np.exp(-(1.5 - 1.5 * x[:, 0] ** 2 + x[:, 1])))).astype(int)
    rows = [(*map(float, v), int(t)) for v, t in zip(x, y)]
    make = lambda r: spark.createDataFrame(r, "bend double, line double, few double, y int").repartition(3)
    return make(rows[:1000]), make(rows[1000:]), x, y


def test_hinge_columns_are_hats_and_cubics_sum_to_one():
    knots, x = np.array([-1.0, 0.0, 0.5, 2.0, 3.0]), np.array([-2.5, -1.0, -0.3, 0.0, 0.4, 1.9, 2.0, 3.0, 4.5])
    got = S.spline_columns(x, knots, 1)
    assert np.allclose(got, np.column_stack([hat(x, knots, i) for i in range(4)]), atol=1e-12)
    # on equal gaps the cubic's value at a knot is 1/6, 4/6, 1/6 of its neighbours, and a straight line goes on with its slope
    even = np.arange(5.0)
    assert np.allclose(S.spline_columns(np.array([2.0]), even, 3)[0], [0, 0, 1 / 6, 4 / 6, 1 / 6, 0], atol=1e-12)
    a = S.spline_columns(np.array([4.0, 5.0, 6.0, 4 - 1e-6]), even, 3)
    assert np.allclose(a[2] - a[1], a[1] - a[0], atol=1e-12) and np.allclose((a[0] - a[3]) / 1e-6, a[1] - a[0], atol=1e-4)


def test_verdicts_and_gains_by_hand(cases):
    train, test, x, y = cases
    v, curves = S.nonlinearity_verdicts(train, test, COLS, "y")
    v = {r["feature"]: r for r in v.collect()}
    assert v["bend"]["status"] == "strong" and v["bend"]["rank"] == 1 and v["bend"]["direction_changes"] == 1
    assert v["line"]["status"] == "weak" and (v["line"]["best_shape"], v["line"]["log_loss_gain"]) == ("linear", 0.0)
    assert (v["few"]["status"], v["few"]["skip_reason"], v["few"]["n_unique"]) == ("skip", "too_few_unique_values", 3)
    a, ya, b, yb = x[:1000], y[:1000], x[1000:], y[1000:]
    base = ridge_fit(a, ya)
    knots = np.quantile(a[:, 0], [0, .25, .5, .75, 1])
    bent = lambda m: np.column_stack([m[:, 1:], *[hat(m[:, 0], knots, i) for i in range(4)]])
    hinge = ridge_fit(bent(a), ya)
    assert abs(v["bend"]["hinge_gain"] - (loss(yb, base(b)) - loss(yb, hinge(bent(b))))) < 1e-7
    grid = np.quantile(a[:, 0], np.linspace(.05, .95, 25))
    points = np.tile(np.median(a, axis=0), (25, 1))
    points[:, 0] = grid
    got = [r for r in curves.orderBy("grid_rank").collect() if r["feature"] == "bend"]
    assert np.allclose([r["grid_value"] for r in got], grid) and np.allclose([r["linear_prob"] for r in got], base(points), atol=1e-7)
    assert np.allclose([r["hinge_prob"] for r in got], hinge(bent(points)), atol=1e-7)
    assert abs(v["bend"]["hinge_gap"] - np.abs(hinge(bent(points)) - base(points)).max()) < 1e-7


def test_rules_of_the_verdict():
    fit = lambda gain, gap=0.0, train=0.1, turns=0: {"gain": gain, "gap": gap, "train": train, "turns": turns, "brier": 0.0}
    status = lambda s, h: tuple(S._verdict(s, h).get(k) for k in ("status", "best_shape", "recommendation"))
    assert status(fit(0.006, turns=1), fit(0.001)) == ("strong", "smooth", "consider_spline_transform_or_gam")
    assert status(fit(0.006, turns=2), fit(0.001)) == ("strong", "smooth", "consider_gam")
    assert status(fit(0.003), fit(0.0041)) == ("moderate", "hinge", "consider_piecewise_transform_or_mars")
    assert status(fit(0.001, gap=0.05), fit(0.0))[0] == "moderate" and status(fit(0.001), fit(0.0))[0] == "weak"
    assert status(fit(0.003, gap=0.01), fit(0.00305, gap=0.02))[1] == "hinge" and status(fit(0.01, train=-0.1), fit(0.0))[0] == "weak"


def test_nulls_infinities_and_empty_tables(spark, cases):
    train, test, _, _ = cases
    none = train.limit(0)
    for a, b in ((none, test), (train, none), (train.where("y = 1"), test)):
        v, curves = S.nonlinearity_verdicts(a, b, COLS, "y")
        assert {r["skip_reason"] for r in v.collect()} == {"insufficient_data"} and curves.isEmpty()
    holes = train.selectExpr("CASE WHEN line > 1 THEN NULL WHEN line < -1 THEN double('inf') ELSE bend END AS bend", "line", "double(NULL) AS few", "y")
    v = {r["feature"]: r for r in S.nonlinearity_verdicts(holes, test, COLS, "y")[0].collect()}
    assert v["few"]["skip_reason"] == "too_few_non_missing_rows" and v["bend"]["status"] == "strong"
    assert v["bend"]["n_non_missing"] == train.where("abs(line) <= 1").count()
