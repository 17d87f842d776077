"""Ratings, change points, draws and diagnostics against plain loops."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.functions import draws as R
from augury.operators import decisions as D, diagnostics as G, logits as L, models as M, ratings as Q, research as RB
from augury.sources import imports as I, nested as N, tables as B


@pytest.fixture(scope="module")
def games(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pool in ("p", "q"):
        for i in range(60):
            h, a = rng.choice(6, 2, replace=False)
            w = None if i % 11 == 10 else int(rng.random() < 0.55)
            rows.append((len(rows), pool, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), f"t{h}", f"t{a}", w, float(rng.integers(-7, 8))))
    return spark.createDataFrame(rows, "event_id int, pool string, ts timestamp, home string, away string, home_win int, margin double"), rows


def test_elo_matches_loop(games):
    df, rows = games
    got = {r["event_id"]: (r["elo_home_pre"], r["elo_away_pre"]) for r in Q.elo(df, ["pool"], ["ts", "event_id"]).collect()}
    rate = {}
    for e, pool, _, h, a, w, m in rows:
        rh, ra = rate.get((pool, h), 1500.0), rate.get((pool, a), 1500.0)
        assert got[e] == pytest.approx((rh, ra))
        if w is not None:
            d = 20 * (1 + 0.1 * min(abs(m), 4)) * (w - 1 / (1 + math.exp(-(rh + 35 - ra) / 400)))
            rate[(pool, h)], rate[(pool, a)] = rh + d, ra - d


def test_dynamic_and_paired_are_probabilities(games):
    df, _ = games
    d = Q.dynamic_rating(df, ["pool"], ["ts", "event_id"]).agg(F.min("dyn_home_prob"), F.max("dyn_home_prob"), F.min("dyn_var")).first()
    assert 0 < d[0] < d[1] < 1 and d[2] > 0
    p = Q.paired_state(df, ["pool"], ["ts", "event_id"]).where("NOT (bt_low < bt_mean AND bt_mean < bt_high)").count()
    assert p == 0


def alarms_by_loop(x):
    """Both tests value by value, from their definitions."""
    n, out = len(x), []
    spread = max(np.std(x), 0.05)
    burn, cool = max(20, min(60, n // 5)), max(10, min(30, n // 12))
    limits = (max(0.35, 2.5 * spread), max(0.45, 3 * spread))
    slack, walks, last = max(0.02, 0.2 * spread), [[0.0], [0.0], [0.0]], [None, None]
    for i, v in enumerate(x):
        steps = (v - np.mean(x[:i + 1]) - max(0.01, 0.05 * spread), v - np.mean(x) - slack, np.mean(x) - v - slack)
        for w, s in zip(walks, steps):
            w.append(w[-1] + s)
        for k, own in enumerate(((0,), (1, 2))):
            stat = max(walks[w][-1] - min(walks[w]) for w in own)
            if i + 1 >= burn and stat > limits[k] and (last[k] is None or i - last[k] >= cool):
                out.append((i, ("page_hinkley", "cusum")[k], stat))
                last[k] = i
                for w in own:
                    walks[w] = [0.0]
    return sorted(out)


def test_change_points_match_loop(spark):
    rng = np.random.default_rng(6)
    level = {"calm": np.zeros(90), "steps": np.repeat([0.0, 0.8, 0.1, 1.3], 60), "slow": np.linspace(0, 2, 150), "short": np.ones(12)}
    rows = [(m, i, float(v + rng.normal(0, 0.08))) for m, x in level.items() for i, v in enumerate(x)]
    out = Q.change_points(spark.createDataFrame(rows, "model string, i int, loss double"), ["model"], ["i"], "loss").collect()
    for m in level:
        x = np.array([v for k, _, v in rows if k == m])
        got = sorted((r["row"], r["method"], r["statistic"]) for r in out if r["model"] == m)
        want = alarms_by_loop(x) if len(x) >= 30 else []
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert {r["model"] for r in out} == {"steps", "slow"}


def test_draws_have_their_moments(spark):
    df = spark.range(20000)
    r = df.select(R.uniform(1, "id").alias("u"), R.normal(2, "id").alias("z"), R.poisson_one(3, "id").alias("k")).agg(*[F.avg(c).alias(c) for c in "uzk"], F.stddev("z").alias("sz")).first()
    assert r["u"] == pytest.approx(0.5, abs=0.01) and r["z"] == pytest.approx(0, abs=0.03) and r["sz"] == pytest.approx(1, abs=0.03)
    assert r["k"] == pytest.approx(1, abs=0.03)


def test_normal_quantile_inverts(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double").withColumn("z", R.normal_quantile(F.col("p"))).withColumn("back", M.normal_cdf(F.col("z")))
    assert all(abs(r["back"] - r["p"]) < 1e-6 for r in df.collect())


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(500)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int").cache(), x, y


def test_moments_and_vif(design):
    df, x, y = design
    assert np.allclose(G.correlation(df, ["a", "b", "c"]), np.corrcoef(x.T), atol=1e-9)
    vif = [r["vif"] for r in G.collinearity(df, ["a", "b", "c"])["vif"].orderBy("feature").collect()]
    assert np.allclose(vif, np.diag(np.linalg.inv(np.corrcoef(x.T))), atol=1e-6)


def test_status_of_copies_clusters_and_holes(spark, design):
    df, x, _ = design
    wide = df.withColumns({"copy": F.col("a"), "sum": F.col("a") + F.col("b") + F.sin("id") / 50, "flat": F.lit(2.0), "void": F.lit(None).cast("double"),
                           "steps": F.when(F.col("id") < 499, 1.0).otherwise(0.0), "rare": F.when(F.col("id") < 4, F.col("c")), "hole": F.when(F.col("id") > 2, F.col("c"))})
    cols = ["a", "b", "c", "copy", "sum", "flat", "void", "rare", "steps"]
    r = {v["feature"]: v for v in G.feature_status(wide, cols, "id").collect()}
    assert r["copy"]["duplicate_of"] == "a" and r["copy"]["vif"] == r["a"]["vif"] == float("inf") and r["copy"]["flags"].startswith("exact_duplicate | severe_pairwise_corr")
    assert (r["flat"]["flags"], r["void"]["flags"], r["rare"]["flags"], r["steps"]["flags"]) == ("constant", "all_missing", "insufficient", "near_constant")
    assert (r["flat"]["in_matrix"], r["steps"]["status"], r["flat"]["vif"]) == (False, "warning", None)
    z = np.column_stack([x, x[:, 0] + x[:, 1] + np.sin(np.arange(500)) / 50])
    vif = np.diag(np.linalg.inv(np.corrcoef(z.T)))
    r = {v["feature"]: v for v in G.feature_status(wide, ["a", "b", "c", "sum"], "id").collect()}
    assert np.allclose([r[c]["vif"] for c in ("a", "b", "c", "sum")], vif, rtol=1e-6)
    assert {c for c in r if r[c]["condition_clusters"]} == {"a", "b", "sum"} and r["a"]["flags"] == "severe_vif | critical_condition_cluster" and r["c"]["status"] == "ok"
    assert sorted(v["rank"] for v in r.values()) == [1, 2, 3, 4] and r["c"]["rank"] == 4
    # the only rows with another value of "steps" have a hole elsewhere: constant where it counts
    cut = wide.withColumn("hole", F.when(F.col("id") < 499, F.col("c")))
    r = {v["feature"]: v for v in G.feature_status(cut, ["hole", "steps", "b"], "id").collect()}
    assert r["steps"]["flags"] == "near_constant | complete_case_constant" and not r["steps"]["in_matrix"] and r["hole"]["in_matrix"]
    assert [(v["feature"], v["flags"]) for v in G.feature_status(wide.limit(0), ["a", "b"], "id").collect()] == [("a", "all_missing"), ("b", "all_missing")]


def test_screen_drops_copies(spark, design):
    df, _, _ = design
    wide = df.withColumns({"copy": F.col("a"), "near": F.col("a") + F.col("c") * 1e-3, "flat": F.lit(2.0)})
    r = {x["feature"]: (x["status"], x["reason"]) for x in G.screen_features(wide, ["a", "b", "c", "copy", "near", "flat"], "y", "id").collect()}
    assert r["flat"] == ("dropped", "constant") and r["copy"] == ("dropped", "exact_duplicate")
    assert {r["a"][0], r["near"][0]} == {"kept", "dropped"} and r["b"][0] == "kept"


def test_group_logits_are_stationary(design):
    df, x, y = design
    both = df.withColumn("g", F.lit("all")).unionByName(df.withColumn("g", F.when(F.col("id") % 2 == 0, "even")))
    fits = {r["g"]: (r["n"], np.array(r["beta"])) for r in L.group_logits(both.where("g IS NOT NULL"), ["a", "b", "c"], "y", "g", ridge=1e-9).collect()}
    xx = np.column_stack([np.ones(500), x])
    even = np.array([r["id"] % 2 == 0 for r in df.select("id").collect()])
    for (n, b), at in ((fits["all"], slice(None)), (fits["even"], even)):
        assert n == len(xx[at]) and np.abs(xx[at].T @ (y[at] - 1 / (1 + np.exp(-xx[at] @ b)))).max() < 1e-6
    m = M.penalized_logit(df, ["a", "b", "c"], "y", c=1e6)
    i0, slopes = M.linear_terms(m)
    assert np.allclose([i0, slopes["a"], slopes["b"], slopes["c"]], fits["all"][1], atol=0.02)


def test_replicates_equal_single_fits(design):
    df, x, y = design
    w = F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.0))
    b = L.replicate_logits(df.withColumn("w", w), ["a", "b", "c"], "y", "w", 2, ridge=1e-6)
    one, third = (np.array(L.group_logits(d, ["a", "b", "c"], "y", "g", 1e-6).first()["beta"]) for d in (df.withColumn("g", F.lit(1)), df.where("id % 3 = 0").withColumn("g", F.lit(1))))
    assert np.allclose(b[0], one, atol=1e-8) and np.allclose(b[1], third, atol=1e-4)


@pytest.mark.parametrize("kind", ["ridge", "lasso", "elastic"])
def test_grid_of_fits_equals_single_fits(design, kind):
    """Every point of a grid against MLlib's fit of it, and the fits of a fold read its own training rows only."""
    df, x, y = design
    folds = df.withColumn("fold", F.lit(1)).unionByName(df.where("id < 300").withColumn("fold", F.lit(2))).withColumn("role", F.when(F.col("id") % 5 == 0, "valid").otherwise("train"))
    points = L.grid_points(kind)[::4]
    table, fits = L.tune_points(folds, ["a", "b", "c"], "y", points, [1, 2])
    n = {f: (1 if f == 1 else 0) for f in (1, 2)}
    assert {r["folds_used"] for r in table.collect()} == {2} and table.count() == len(points) and n
    for f, rows in ((1, df), (2, df.where("id < 300"))):
        train = rows.where("id % 5 <> 0")
        size = train.count()
        for i in (0, len(points) - 1):
            lam, l1 = points[i]
            # MLlib scales by the sample deviation: (n - 1) / n of the squared penalty, and its root of the absolute one
            want = M.linear_terms(M.penalized_logit(train, ["a", "b", "c"], "y", c=1 / lam, l1=l1, max_iter=500))
            got = L.slopes(fits, f, i)
            assert np.allclose([got[0], *got[1].values()], [want[0], *want[1].values()], atol=0.02 / size**0.5 + 2e-3)


def test_nested_backtest_reads_no_later_row(spark):
    """Folds follow the calendar, the embargo and the holdout; labels of the holdout and of later folds change nothing before them."""
    rng = np.random.default_rng(3)
    rows = [(i, dt.datetime(2023, 1, 1) + dt.timedelta(days=i // 2, hours=i % 2), f"h{i % 7}", f"a{i % 5}", float(rng.normal()), int(rng.random() < 0.5)) for i in range(1200)]
    df = spark.createDataFrame([(*r[:5], int(r[4] + rng.normal() > 0)) for r in rows], "event_id int, start_ts timestamp, home string, away string, x double, y int")
    spec = RB.Spec(2, 40, 2, 30, 3, 50)
    folds = RB.research_folds(df, "start_ts", "y", spec)
    assert folds.outer == [100, 200] and folds.inner == [101, 102, 201, 202] and folds.holdout.count() == 100
    days = {(r["fold"], r["role"]): (r["a"], r["b"]) for r in folds.rows.groupBy("fold", "role").agg(F.min("start_ts").alias("a"), F.max("start_ts").alias("b")).collect()}
    last = dt.datetime(2023, 1, 1) + dt.timedelta(days=600 - 50)
    for f in folds.outer + folds.inner:
        assert (days[f, "valid"][0] - days[f, "train"][1]).days >= 3 and days[f, "valid"][1] < last
        if f % 100:
            assert days[f, "valid"][1] <= days[f // 100 * 100, "train"][1]
    grid = {"ridge": (["x"], L.grid_points("ridge")), "flat": (["x"], [(1e6, 0.0)])}
    keep = ["event_id", "start_ts", "home", "away"]
    pred, points = RB.nested_predictions(folds, grid, "y", keep)
    first = {(r["model"], r["event_id"]): r["prob"] for r in pred.where("fold = 100").collect()}
    later = df.withColumn("y", F.when(F.col("start_ts") > F.lit(days[100, "train"][1]), 1 - F.col("y")).otherwise(F.col("y")))
    again, _ = RB.nested_predictions(RB.research_folds(later, "start_ts", "y", spec), grid, "y", keep)
    assert first == {(r["model"], r["event_id"]): r["prob"] for r in again.where("fold = 100").collect()} and len(first) == 160
    prices = df.select("event_id", F.lit(-110.0).alias("home_price"), F.lit(120.0).alias("away_price"))
    card = RB.research_scorecard(pred, prices, D.policy_table(spark), "event_id", "y", "start_ts", "flat", F.date_trunc("month", "start_ts"), 3).collect()
    assert {r["model"] for r in card} == {"ridge"} and all(r["embargo_respected"] == r["unique_keys"] == r["prediction_before_event"] == 1 and r["mean_log_loss"] < 0.68 for r in card)
    with pytest.raises(ValueError):
        RB.research_scorecard(pred, prices.where("event_id < 0"), D.policy_table(spark), "event_id", "y", "start_ts", "flat", F.date_trunc("month", "start_ts"))
    with pytest.raises(ValueError):
        RB.research_folds(df.where("event_id < 100"), "start_ts", "y", spec)


def test_break_test_and_bootstrap_plan(spark, design):
    df, x, y = design
    days = df.withColumn("ts", F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / 4).cast("int")))
    r = G.break_test(days, ["a", "b", "c"], "y", "ts", 3, 7).first()
    assert r["n_pre"] + r["n_post"] == 500 and r["n_pre"] == 66 * 4 and r["delta_coef"] > 0
    assert G.break_test(days.where("id < 270"), ["a", "b", "c"], "y", "ts", 3, 7).first()["delta_coef"] is None
    rows = df.select("id", F.lit("m").alias("m"), F.abs("a").alias("l")).union(df.select("id", F.lit("k"), F.abs("b")))
    assert "Generate" not in G.bootstrap_deltas(rows, "id", "m", "l", 200)._jdf.queryExecution().executedPlan().toString()


def test_influence_matches_numpy(design):
    df, x, y = design
    top, shift = G.influence(df, ["a", "b", "c"], "y", "id", 5)
    xx = np.column_stack([np.ones(500), x])
    b = np.array(L.group_logits(df.withColumn("g", F.lit(1)), ["a", "b", "c"], "y", "g", ridge=1e-6).first()["beta"])
    mu = 1 / (1 + np.exp(-xx @ b))
    v = mu * (1 - mu)
    h = v * np.einsum("ij,jk,ik->i", xx, np.linalg.inv((xx * v[:, None]).T @ xx), xx)
    cook = (y - mu) ** 2 / v * h / (4 * (1 - h) ** 2)
    got = top.collect()
    assert [r["id"] for r in got] == list(np.argsort(-cook)[:5]) and shift > 0
    assert got[0]["leverage"] == pytest.approx(h[got[0]["id"]], rel=1e-6)


def test_f_tail():
    assert G.f_tail(4.96, 1, 10) == pytest.approx(0.05, abs=2e-3) and G.f_tail(0.0, 2, 5) == 1.0


def test_bootstrap_covers_the_difference(spark):
    rng = np.random.default_rng(1)
    rows = [(i, m, float(rng.normal(mu, 0.1))) for i in range(300) for m, mu in (("good", 0.6), ("bad", 0.7))]
    r = G.bootstrap_deltas(spark.createDataFrame(rows, "e int, m string, l double"), "e", "m", "l", 60).first()
    assert r["reference"] == "good" and r["delta_p025"] < r["delta_mean"] < r["delta_p975"] and r["reference_better"] == 1.0


def test_tables_round_trip(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("d", T.TimestampType())])
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)], schema)
    assert B.read_table(spark, str(tmp_path), "none", schema).count() == 0
    B.write_table(df, f"{tmp_path}/t.csv", "csv")
    assert B.read_table(spark, str(tmp_path), "t", schema).count() == 10
    B.write_table(df, f"{tmp_path}/t.parquet")
    assert B.read_table(spark, str(tmp_path), "t", schema).exceptAll(df).isEmpty()
    m = B.export_chunks(df, "d", 4, f"{tmp_path}/chunks")
    assert m.agg(F.sum("rows")).first()[0] == 10 and spark.read.parquet(f"{tmp_path}/chunks").count() == 10
    B.replace_partitions(df.withColumn("p", F.lit(1)), f"{tmp_path}/parts", ["p"])
    B.replace_partitions(df.limit(3).withColumn("p", F.lit(2)), f"{tmp_path}/parts", ["p"])
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 13


def test_import_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,x\n1,2\n")
    (tmp_path / "b.jsonl").write_text('{"event_id": 2, "x": 3}\n')
    (tmp_path / "c.json").write_text('{"rows": [{"event_id": 3, "y": "z"}]}')
    (tmp_path / "d.json").write_text('[{"event_id": 4}]')
    out = I.import_bundle(spark, [{"path": f} for f in ("a.csv", "b.jsonl", "c.json", "d.json")], str(tmp_path))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        I.normalize_events(out, {}, F.current_timestamp())


def test_price_payload(spark):
    """The feed's own key names; an open price stands in for a missing close, and a book without prices gives no row."""
    import json
    side = lambda name, short: {"homeAway": name, "team": {"displayName": f"{short} Club", "abbreviation": short}}
    book = {"provider": {"id": "3", "name": "North"}, "moneyline": {"home": {"close": {"odds": "-142"}}, "away": {"open": {"odds": "+128"}}},
            "pointSpread": {"home": {"close": {"line": "-2.5", "odds": "-104"}}, "away": {"close": {"line": "+2.5", "odds": "-116"}}}, "overUnder": 47.5, "overOdds": 102.0, "underOdds": -122.0}
    doc = json.dumps({"header": {"id": "31", "competitions": [{"id": "32", "date": "2025-11-02T03:15Z", "competitors": [side("home", "NOR"), side("away", "SUD")]}]}, "pickcenter": [book]})
    rows = N.flatten_prices(spark.createDataFrame([(doc, dt.datetime(2025, 11, 1))], "doc string, t timestamp"), "doc", [], "t").collect()
    got = {(r["market"], r["side"]): (r["price"], r["point"]) for r in rows}
    assert got == {("h2h", "home"): (-142.0, None), ("h2h", "away"): (128.0, None), ("spreads", "home"): (-104.0, -2.5), ("spreads", "away"): (-116.0, 2.5),
                   ("totals", "over"): (102.0, 47.5), ("totals", "under"): (-122.0, 47.5)}
    assert str(rows[0]["local_day"]) == "2025-11-01"


def test_stat_texts(spark):
    df = spark.createDataFrame([("5-10", "12:30"), ("7", "31")], "s string, m string")
    a, b = N.made_attempted(F.col("s"))
    got = [tuple(r) for r in df.select(a, b, N.minutes(F.col("m"))).collect()]
    assert got == [(5.0, 10.0, 12.5), (7.0, None, 31.0)]
