"""Work that is spread over tasks, or done once, however few ranges its rows lie in."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import diagnostics as G, logits as L, models as M, ratings as Q, scoring as S
from augury.plans import model_queries as MQ
from augury.session import dealt


@pytest.fixture
def few_rows(spark):
    spark.conf.set("spark.augury.taskRows", "20")
    yield
    spark.conf.unset("spark.augury.taskRows")


@pytest.fixture(scope="module")
def games(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = rng.normal(size=5)
        y = int(rng.random() < 1 / (1 + np.exp(-x[0] + 0.5 * x[1])))
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i), f"C{i % 9}", f"S{i % 7}", f"V{i % 3}", y, float(2 * y - 1), float(i % 5), float(i % 4), *map(float, x)))
    return spark.createDataFrame(rows, "event_id long, start_ts timestamp, home string, away string, venue string, home_win int, margin double, pace double, tempo double, "
                                       "lines double, quantity double, discount double, tax double, price double").cache()


def sizes(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_dealt_spreads_a_full_task_and_leaves_small_ones(spark, few_rows):
    full = dealt(spark.range(100).coalesce(1))
    assert max(sizes(full)) <= 40 and sorted(r[0] for r in full.collect()) == list(range(100))
    assert sizes(dealt(spark.range(20).coalesce(1))) == [20]
    assert dealt(spark.range(0)).count() == 0


def test_rows_of_one_range_are_split_over_tasks(spark, games, few_rows, monkeypatch):
    monkeypatch.setattr(MQ, "frame", lambda s, d: games)
    train, test = MQ.split(spark, None)
    assert (train.count(), test.count()) == (280, 120)
    assert max(sizes(train)) < 100  # one task held all rows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_two_stage_asks_its_forests_once(games, monkeypatch):
    seen, fit = [], M.penalized_logit
    monkeypatch.setattr(M, "penalized_logit", lambda rows, *a, **kw: seen.append(plan(rows)) or fit(rows, *a, **kw))
    got = M.TwoStage(games, ["lines", "price"], ["margin"], "home_win", trees=2, depth=2).predict(games)
    assert got.count() == 400 and "pred" in got.columns
    assert "UDF" not in seen[0]  # each pass of the last fit asked all forests again


def test_group_fits_do_not_shuffle_rows(spark, games, monkeypatch):
    seen, cut = [], L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = L.group_logits(games, ["lines", "price"], "home_win", "venue").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["venue"] for r in got) == ["V0", "V1", "V2"] and all(r["n"] for r in got)
    assert seen and not any("SortMergeJoin" in p for p in seen)


def test_group_fits_without_bound_join_by_group(games, monkeypatch):
    few = {r["venue"]: r["beta"] for r in L.group_logits(games, ["lines", "price"], "home_win", "venue").collect()}
    monkeypatch.setattr(L, "FEW_GROUPS", 2)
    for r in L.group_logits(games, ["lines", "price"], "home_win", "venue").collect():
        assert r["beta"] == pytest.approx(few[r["venue"]], abs=1e-12)


def test_replicate_weights_are_bytes(games, monkeypatch):
    seen, write = [], L.dealt
    monkeypatch.setattr(L, "dealt", lambda df: seen.append(df.schema["_w"].dataType.simpleString()) or write(df))
    got = G.coef_stability(games, ["lines", "price"], "home_win", "event_id", n=5).collect()
    assert {r["fits"] for r in got} == {5} and seen == ["array<tinyint>"]  # eight bytes a draw before


def test_stress_needs_no_ranks(games, monkeypatch):
    monkeypatch.setattr(G, "score_groups", lambda *a, **kw: pytest.fail("ranks and bins for a mean"))
    fit = M.penalized_logit(games, ["lines", "price"], "home_win")
    rows = {r["scenario"]: r for r in G.stress(lambda d: M.predict(fit, d, ["lines", "price"]), games, ["lines", "price"], "home_win", "event_id", {"flat": ["lines"]}, draws=2).collect()}
    assert set(rows) == {"base", "flat", "jitter_1", "jitter_2"} and {r["n"] for r in rows.values()} == {400}
    own = M.predict(fit, games, ["lines", "price"]).select("home_win", "pred").toPandas()
    want = -(own.home_win * np.log(own.pred) + (1 - own.home_win) * np.log(1 - own.pred)).mean()
    assert rows["base"]["log_loss"] == pytest.approx(want) and rows["base"]["delta_log_loss"] == 0
    assert rows["flat"]["log_loss"] > want


def test_drift_is_no_fold_over_arrays(spark):
    rng = np.random.default_rng(5)
    p, g = np.round(rng.uniform(0.06, 0.94, 90), 1), np.arange(90) % 2
    y = (rng.random(90) < p).astype(int)
    df = spark.createDataFrame([(str(g[i]), i, float(p[i]), int(y[i])) for i in range(90)], "g string, i int, p double, y int")
    out = S.drift(df, ["g"], ["i"], "y", "p", windows=(12, 30))
    assert "aggregate(" not in plan(out)
    rows = out.collect()
    assert len(rows) == 2 * 2 * (45 - 7)
    for r in rows:
        at = [i for i in range(r["i"] + 1) if str(g[i]) == r["g"]][-r["window_rows"]:]
        q, z = p[at], y[at]
        assert r["n"] == len(at) and r["log_loss"] == pytest.approx(-(z * np.log(q) + (1 - z) * np.log(1 - q)).mean())
        one, none = q[z == 1], q[z == 0]
        pairs = (one[:, None] > none).sum() + (one[:, None] == none).sum() / 2
        assert r["auc"] == (pytest.approx(pairs / (len(one) * len(none))) if len(one) and len(none) else None)
        b = np.ceil(q * 10)
        gap = {k: abs((q - z)[b == k].sum()) for k in set(b)}
        assert r["ece"] == pytest.approx(sum(gap.values()) / len(at)) and r["mce"] == pytest.approx(max(v / (b == k).sum() for k, v in gap.items()))
        if r["auc"] is None:
            assert r["calibration_alpha"] is None and r["calibration_beta"] is None
        else:
            x = np.log(q / (1 - q))
            err = z - 1 / (1 + np.exp(-(r["calibration_alpha"] + r["calibration_beta"] * x)))
            assert abs(err.sum()) < 1e-4 and abs((err * x).sum() - r["calibration_beta"]) < 1e-4


def test_pools_stay_in_arrow(spark, games):
    pools = games.withColumns({"pool": F.lit("a"), "home": F.when(F.col("event_id") % 50 != 0, F.col("home"))})
    out = Q.elo(pools, ["pool"], ["start_ts", "event_id"])
    assert "FlatMapGroupsInArrow" in plan(out)  # names were objects of Python
    state, rows = {}, sorted(out.collect(), key=lambda r: r["event_id"])
    for r in rows:
        h, a = state.get(r["home"], 1500.0), state.get(r["away"], 1500.0)
        assert (r["elo_home_pre"], r["elo_away_pre"]) == (pytest.approx(h), pytest.approx(a))
        won = 20 * 1.1 * (r["home_win"] - 1 / (1 + np.exp(-(h + 35 - a) / 400)))
        state[r["home"]], state[r["away"]] = h + won, a - won


def test_filter_runs_once_for_the_regression(games, monkeypatch):
    seen, fit = [], M.penalized_logit
    monkeypatch.setattr(M, "penalized_logit", lambda rows, *a, **kw: seen.append(plan(rows)) or fit(rows, *a, **kw))
    assert Q.paired_state_fit(games.withColumn("pool", F.lit("a")), ["pool"], ["start_ts", "event_id"], ["pace"]).count() == 400
    assert "FlatMapGroups" not in seen[0]


def test_bent_fits_need_no_ranks_and_find_knots_once(games, monkeypatch):
    """Mean losses as the whole score bundle has them; all knots come from one search."""
    calls, search = [], M.exact_quantiles
    monkeypatch.setattr(M, "exact_quantiles", lambda *a: calls.append(a) or search(*a))
    out = G.nonlinearity(games, games, ["lines"], "home_win")
    assert len(calls) == 1 and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["feature"]: r for r in out.collect()}
    for c in ("lines",):
        fits = {"linear": M.predict(M.penalized_logit(games, [c], "home_win"), games, [c]),
                "hinge": M.basis_logit(games, games, [c], "home_win", 3, 1), "spline": M.basis_logit(games, games, [c], "home_win", 3, 3)}
        for kind, p in fits.items():
            assert got[c][kind] == pytest.approx(S.score_groups(p, [], "home_win", "pred").first()["log_loss"], abs=1e-9)
