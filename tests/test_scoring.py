"""Scores, curves and drift against brute force on small fixtures."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import curves as K, scoring as S


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def ece(y, p):
    b = np.ceil(p * 10)
    return sum(abs(p[b == k].mean() - y[b == k].mean()) * (b == k).sum() for k in np.unique(b)) / len(p)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(0.02, 0.98, 300), 2)  # many ties
    y = (rng.random(300) < p).astype(int)
    g = np.where(np.arange(300) % 3 == 0, "a", "b")
    rows = [(int(i), str(g[i]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(i)), float(p[i]), int(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id int, g string, ts timestamp, p double, y int").cache(), g, p, y


def test_bundle_matches_brute_force(data):
    df, g, p, y = data
    for r in S.score_groups(df, ["g"], "y", "p").collect():
        m = g == r["g"]
        assert r["n"] == m.sum()
        assert r["auc"] == pytest.approx(auc(y[m], p[m]), abs=1e-12)
        assert r["ece"] == pytest.approx(ece(y[m], p[m]), abs=1e-12)
        assert r["brier"] == pytest.approx(((p[m] - y[m]) ** 2).mean())
        assert r["log_loss"] == pytest.approx(-(y[m] * np.log(p[m]) + (1 - y[m]) * np.log(1 - p[m])).mean())


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.6)], "y int, p double")
    assert S.score_groups(df, [], "y", "p").first()["auc"] is None
    assert S.calibration_fit(df, [], "y", "p").first()["calibration_beta"] is None


def test_calibration_is_stationary(data):
    df, g, p, y = data
    r = S.calibration_fit(df, [], "y", "p").first()
    x = np.log(p / (1 - p))
    mu = 1 / (1 + np.exp(-(r["calibration_alpha"] + r["calibration_beta"] * x)))
    assert abs((y - mu).sum()) < 1e-6 and abs(((y - mu) * x).sum() - r["calibration_beta"]) < 1e-6


def test_brier_parts(data):
    df, g, p, y = data
    r = S.brier_parts(df, [], "y", "p").first()
    b, base = np.ceil(p * 10), y.mean()
    rel = sum((b == k).mean() * (p[b == k].mean() - y[b == k].mean()) ** 2 for k in np.unique(b))
    res = sum((b == k).mean() * (y[b == k].mean() - base) ** 2 for k in np.unique(b))
    assert r["reliability"] == pytest.approx(rel) and r["resolution"] == pytest.approx(res) and r["uncertainty"] == pytest.approx(base * (1 - base))


def test_drift_matches_brute_force(data):
    df, g, p, y = data
    out = S.drift(df.withColumn("one", F.lit(1)), ["one"], ["ts", "id"], "y", "p", (20,))
    for r in out.collect():
        lo = max(0, r["id"] - 19)
        yy, pp = y[lo:r["id"] + 1], p[lo:r["id"] + 1]
        assert r["n"] == len(yy)
        assert r["ece"] == pytest.approx(ece(yy, pp), abs=1e-9)
        if 0 < yy.sum() < len(yy):
            assert r["auc"] == pytest.approx(auc(yy, pp), abs=1e-9)


def test_windows_and_labels(spark):
    rows = [("m", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i % 2, 0.55) for i in range(12)]
    out = S.performance(spark.createDataFrame(rows, "model string, d timestamp, y int, p double"), ["model"], "d", "y", "p", (7,))
    got = {r["window"]: r["n"] for r in out.collect()}
    assert got == {"cumulative": 12, "7d": 8}


def test_latest_live_row_is_scored(spark):
    pred = spark.createDataFrame([(1, "m", dt.datetime(2024, 1, 1), 0.6, 1), (1, "m", dt.datetime(2024, 1, 9), 0.1, 2)], "event_id int, model string, as_of timestamp, p double, pid int")
    res = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2), 1)], "event_id int, final_ts timestamp, d timestamp, y int")
    r = S.latest_scored(pred, res, "event_id", "model", "as_of", "final_ts", "d", "y", "p", "pid").collect()
    assert len(r) == 1 and r[0]["p"] == 0.6


def test_roc_lorenz_and_quantiles(data):
    df, g, p, y = data
    pts = sorted((r["fpr"], r["tpr"]) for r in K.roc(df, [], "y", "p").collect())
    xs, ys = zip((0.0, 0.0), *pts)
    assert np.trapezoid(ys, xs) == pytest.approx(auc(y, p), abs=1e-9)
    r = K.lorenz(df, [], "y", "p", "id").first()
    order = np.lexsort((np.arange(300), -p))
    cum = np.concatenate([[0], np.cumsum(y[order]) / y.sum()])
    assert r["curve_area"] == pytest.approx(np.trapezoid(cum, np.arange(301) / 300))
    assert r["top_decile_capture"] == pytest.approx(y[order][:30].sum() / y.sum())
    curve = K.quantile_report(df, [], "y", "p")
    assert sum(x["n"] for x in curve.collect()) == 300
    assert curve.count() == len(np.unique(np.quantile(p, np.linspace(0, 1, 11)))) - 1


def test_integrity_counts(spark):
    d0 = dt.datetime(2024, 1, 10)
    pred = spark.createDataFrame([(1, "m", d0 - dt.timedelta(days=1), d0), (2, "m", d0 + dt.timedelta(days=1), d0), (2, "m", d0 + dt.timedelta(days=1), d0)],
                                 "event_id int, model string, as_of timestamp, d timestamp")
    res = spark.createDataFrame([(1,)], "event_id int")
    r = S.integrity_checks(pred, res, "event_id", "model", "as_of", "d", F.lit("2024-02-01").cast("timestamp"), 2).first()
    assert (r["late"], r["repeated_keys"], r["missing_results"], r["embargo_breaches"]) == (2, 1, 2, 3)


def test_poisson_weights_hash_once(spark):
    """The weight is the number of steps at or below the uniform number, and its digest is made outside the comparisons."""
    from augury.functions import draws as R
    u = F.col("u")
    old = F.size(F.filter(F.array(*[F.lit(c) for c in R.poisson_steps()]), lambda c: c <= u))
    df = spark.range(20000).select("id", R.uniform(3, "id").alias("u")).select(old.alias("want"), R.poisson_one(3, F.col("id")).alias("got"))
    assert df.where("want <> got").count() == 0 and df.agg(F.max("got")).first()[0] >= 5
    text = str(R.poisson_one(3, F.col("id"))._jc)
    assert text.count("md5") == 1 and text.index("md5") < text.index("->")
