"""Exact cases, pandas twins and the split-key path of the ordered operators."""
import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from augury.functions.rules import Roles, leakage_audit, select_features
from augury.operators import features as X, ordered as O, temporal as T
from augury.operators.ordered import RANGE_ROWS_CONF


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=int(n))


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("hot", 400), ("a", 12), ("b", 1)):
        for i in range(n):
            x = float(rng.normal()) if rng.random() > 0.3 else None
            rows.append((key, i, day(i * 2), x, float(rng.integers(0, 9))))
    # one long gap
    rows += [("gap", i, day(i), 5.0 if i in (0, 300) else None, 1.0) for i in range(320)]
    return spark.createDataFrame(rows, "k string, id int, ts timestamp, x double, z double").cache()


@pytest.fixture(params=[1_000_000, 50], ids=["plain", "split"])
def limit(request, spark):
    spark.conf.set(RANGE_ROWS_CONF, str(request.param))
    yield request.param
    spark.conf.unset(RANGE_ROWS_CONF)


def frame(df, cols):
    return df.select("k", "id", *cols).toPandas().sort_values(["k", "id"]).reset_index(drop=True)


def test_ewm_matches_pandas_with_gaps(gaps, limit):
    got = frame(X.prior_ewm(gaps, ["k"], ["ts", "id"], ["x", "z"], cell=F.date_trunc("hour", "ts")), ["ewm_x", "ewm_z"])
    src = frame(gaps, ["x", "z"])
    for c in ("x", "z"):
        want = src.groupby("k")[c].transform(lambda s: s.astype(float).shift(1).ewm(alpha=0.2, adjust=False).mean())
        assert np.allclose(got[f"ewm_{c}"].astype(float), want, atol=1e-9, equal_nan=True)


def test_ewm_sorts_its_ranges_once(gaps):
    """One sort of the ranges' rows, however many columns and chunks of decay there are."""
    rows = lambda out: out._jdf.queryExecution().executedPlan().toString()
    ewm = rows(X.prior_ewm(gaps, ["k"], ["ts", "id"], ["x", "z"], cell=F.date_trunc("hour", "ts")))
    count = rows(X.prior_mean(gaps, ["k"], ["ts", "id"], ["x", "z"], cell=F.date_trunc("hour", "ts")))
    top = lambda plan: plan.split("Union")[0].count("Sort [")
    assert top(ewm) == top(count) == 1


def test_ewm_hands_on_across_batches(gaps, limit, spark):
    """Batches of a few rows, so that keys begin and end anywhere in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = frame(X.prior_ewm(gaps, ["k"], ["ts", "id"], ["x", "z"], cell=F.date_trunc("hour", "ts")), ["ewm_x", "ewm_z"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    src = frame(gaps, ["x", "z"])
    for c in ("x", "z"):
        want = src.groupby("k")[c].transform(lambda s: s.astype(float).shift(1).ewm(alpha=0.2, adjust=False).mean())
        assert np.allclose(got[f"ewm_{c}"].astype(float), want, atol=1e-9, equal_nan=True)


def test_dense_ewm_matches_pandas(gaps, limit):
    got = frame(X.prior_ewm(gaps, ["k"], ["ts", "id"], {"z": 0.35}, nullable=False, cell=F.date_trunc("hour", "ts")), ["ewm_z"])
    want = frame(gaps, ["z"]).groupby("k")["z"].transform(lambda s: s.shift(1).ewm(alpha=0.35, adjust=False).mean())
    assert np.allclose(got["ewm_z"].astype(float), want, atol=1e-9, equal_nan=True)


def test_rolling_matches_pandas(gaps, limit):
    got = frame(X.prior_mean(gaps, ["k"], ["ts", "id"], ["x"], (5, 14), F.date_trunc("hour", "ts")), ["r5_x", "r14_x"])
    src = frame(gaps, ["x"])
    for n in (5, 14):
        want = src.groupby("k")["x"].transform(lambda s: s.astype(float).shift(1).rolling(n, min_periods=1).mean())
        assert np.allclose(got[f"r{n}_x"].astype(float), want, atol=1e-9, equal_nan=True)


def test_running_totals_match_window(spark, gaps):
    got = O.running_totals(gaps, ["k"], ["ts", "id"], F.date_trunc("hour", "ts"), {"s": F.col("z")})
    want = gaps.withColumn("s", F.sum("z").over(Window.partitionBy("k").orderBy("ts", "id")))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_causal_effect_matches_loop(spark):
    rng = np.random.default_rng(12)
    rows = [(i, str(rng.choice(list("uvw"))), day(i), int(rng.random() < 0.8), float(rng.normal(3, 9))) for i in range(80)]
    ev = spark.createDataFrame(rows, "event_id int, venue string, ts timestamp, is_final int, margin double")
    got = {r["event_id"]: r["effect"] for r in X.causal_effect(ev, "venue", ["ts", "event_id"], {"effect": "margin"}, 7.5, "is_final", F.date_trunc("hour", "ts")).collect()}
    for i, v, _, _, _ in rows:
        past = [m for j, u, _, done, m in rows if j < i and u == v and done]
        assert got[i] == pytest.approx(np.mean(past) * len(past) / (len(past) + 7.5) if past else 0.0)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=200), np.full(100, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = {r["prob"]: r["quantile"] for r in O.exact_quantiles(df, [], "v", [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(v, p), abs=1e-12)


def test_date_folds_embargo(spark):
    ev = spark.createDataFrame([(i, day(i)) for i in range(320)], "event_id int, start_ts timestamp")
    f = X.date_folds(ev, "start_ts", 4, 30, 2, 120).groupBy("fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("start_ts"))).alias("t"), F.min(F.when(F.col("role") == "valid", F.col("start_ts"))).alias("v0"),
        F.max(F.when(F.col("role") == "valid", F.col("start_ts"))).alias("v1")).collect()
    assert len(f) == 4
    for r in f:
        assert (r["v0"] - r["t"]).days == 3 and (r["v1"] - r["v0"]).days == 29


def test_row_folds_train_before_valid(spark):
    ev = spark.createDataFrame([(i, day(i)) for i in range(300)], "event_id int, start_ts timestamp")
    f = X.time_folds(ev, ["start_ts", "event_id"], F.date_trunc("month", "start_ts"), 4, 120)
    r = f.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("event_id"))).alias("t"),
                              F.min(F.when(F.col("role") == "valid", F.col("event_id"))).alias("v"), F.count_if(F.col("role") == "valid").alias("n")).collect()
    assert len(r) == 4 and all(x["v"] == x["t"] + 1 and x["n"] == 45 for x in r)


def test_leakage_rules(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0, 1, 0, 1, 0.3)], "event_id int, goals double, past_goals double, home_win int, is_final int, form int, twice double")
    roles = Roles(outcome=frozenset({"goals", "home_win"}), keys=frozenset({"event_id", "is_final"}),
                  lineage={"past_goals": (["goals"], True), "half": (["goals"], False), "twice": (["half"], False), "form": (["form"], False)})
    assert select_features(df, roles) == ["past_goals", "form"]
    issues = {(r["issue"], r["detail"]) for r in leakage_audit(df, df.columns, roles).collect()}
    assert issues == {("forbidden_column", c) for c in ("goals", "home_win", "twice")} | {("unlabeled_final_has_outcome", "")}


def test_features_never_read_their_own_row(spark):
    base = [("k", i, day(i), float(i)) for i in range(30)]
    bumped = [(k, i, t, 1e6 if i == 29 else x) for k, i, t, x in base]
    last = []
    for rows in (base, bumped):
        df = spark.createDataFrame(rows, "k string, id int, ts timestamp, x double")
        out = X.prior_ewm(X.prior_mean(df, ["k"], ["ts", "id"], ["x"]), ["k"], ["ts", "id"], ["x"])
        last.append(out.where("id = 29").select("r5_x", "r14_x", "ewm_x").first())
    assert last[0] == last[1]


def test_travel_miles(spark):
    s = spark.createDataFrame([(1, "t", day(0), "a"), (2, "t", day(1), "b")], "event_id int, entity string, start_ts timestamp, place string")
    p = spark.createDataFrame([("a", 40.0, -75.0, -5), ("b", 34.0, -118.0, -8)], "place string, lat double, lon double, utc_offset int")
    r = {x["event_id"]: x for x in X.travel(s, p, ["entity"], "start_ts", ["start_ts", "event_id"], "place").collect()}
    assert r[1]["travel_miles"] == 0 and 2300 < r[2]["travel_miles"] < 2500 and r[2]["tz_change"] == -3


def test_ranges_are_even_with_one_hot_key(spark):
    """Nine rows of ten in one key: no range holds more than the limit and one cell, and no job runs while the plan is built."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id",
                                  (F.lit(dt.datetime(2024, 1, 5)) + F.make_dt_interval(mins=(F.col("id") * 3).cast("int"))).alias("ts"), (F.col("id") % 5).cast("double").alias("x"))
    spark.conf.set(RANGE_ROWS_CONF, "100")
    tracker = spark.sparkContext.statusTracker()
    try:
        before = len(tracker.getJobIdsForGroup())
        ranged = O.with_ranges(df, ["k"], O.cell_of(df, "ts"))
        mean = X.prior_mean(df, ["k"], ["ts", "id"], ["x"])
        assert len(tracker.getJobIdsForGroup()) == before
        sizes = [r["count"] for r in ranged.groupBy("k", "_bucket").count().collect()]
        assert max(sizes) <= 100 + 20 and len(sizes) >= 36
        spark.conf.set(RANGE_ROWS_CONF, "1000000")
        whole = X.prior_mean(df, ["k"], ["ts", "id"], ["x"])
        assert mean.exceptAll(whole).isEmpty() and whole.exceptAll(mean).isEmpty()
    finally:
        spark.conf.unset(RANGE_ROWS_CONF)


def test_quantiles_of_one_narrow_score(spark):
    """All values within a hair and one far outlier: ranks are still found exactly."""
    v = np.concatenate([0.5 + np.arange(300) * 1e-9, [0.5] * 200, [1e12], [-3.0], [0.0]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for r in O.exact_quantiles(df, [], "v", [0.0, 0.3, 0.5, 0.99, 1.0]).collect():
        assert r["quantile"] == pytest.approx(np.quantile(v, r["prob"]), rel=1e-12)


def test_gathered_rosters_hold_the_rows(spark):
    """The rosters as arrays are the rows of the join, and no row is dealt by event once its range is known."""
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    r = random.Random(4)
    st = [(k, r.choice("AB"), f"p{r.randint(0, 9)}", at(r.randint(5, 90)), k, k * 0.5) for k in range(300)]
    ev = [(1000 + k, r.choice("ABC"), at(r.randint(0, 95))) for k in range(80)]
    states = spark.createDataFrame(st, "event_id long, team string, player string, ts timestamp, tie long, form double")
    series = spark.createDataFrame(ev + [x for x in ev if x[1] != "C" and x[2] > at(30)][:3], "event_id long, entity string, start_ts timestamp")
    for within in (None, 12.0):
        ask = lambda **kw: T.asof_roster(series, states, "team", "player", "ts", "event_id", "tie", within_days=within, least_range=4, **kw)
        want = sorted(map(repr, ask().collect()))
        met = ask(gathered=True)
        rows = met.select("event_id", "entity", F.explode_outer("states").alias("x")).select("event_id", "entity", "x.*")
        assert len(want) > 300 and sorted(map(repr, rows.collect())) == want
    per = met.groupBy("pool", "range", "event_id", "entity").agg(F.count(F.lit(1)))
    assert not re.search(r"hashpartitioning\(pool#\d+, range#\d+L?, event_id", per._jdf.queryExecution().executedPlan().toString())
