"""Stakes, gates, budget and settlement on stated cases and against a loop."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from augury.operators import decisions as D, replay as R, standings as Z


def cand(spark, p, h, a):
    df = spark.createDataFrame([(1, "H", "A", p, float(h), float(a), None)], "event_id int, home string, away string, prob double, hp double, ap double, peer double")
    return D.candidates(df, "prob", "hp", "ap").withColumn("cand_team", F.when(F.col("cand_side") == "home", F.col("home")).otherwise(F.col("away")))


@pytest.mark.parametrize("p,h,a,tight,side,stake", [(.653, -135, 125, False, "home", 125.0), (.71, -430, 340, False, "away", 125.0), (.71, -430, 340, True, "none", 0.0)])
def test_stated_cases(spark, p, h, a, tight, side, stake):
    r = D.decide(cand(spark, p, h, a), D.policy_table(spark, tight)).where("policy = 'riskAdjusted'").first()
    assert (r["side"], r["stake"]) == (side, stake)


def test_missing_price(spark):
    df = spark.createDataFrame([(1, 0.5, None, 120.0, None)], "event_id int, prob double, hp double, ap double, peer double")
    r = D.decide(D.candidates(df, "prob", "hp", "ap"), D.policy_table(spark)).first()
    assert r["reason"] == "no_price" and r["stake"] == 0


def test_budget_equals_the_loop(spark):
    rng = np.random.default_rng(5)
    rows = []
    for d in range(30):
        for i in range(int(rng.integers(1, 12))):
            rows.append((d * 100 + i, f"t{i}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(np.round(rng.uniform(0.02, 0.3), 2)), float(np.round(rng.uniform(0.03, 0.1), 2)),
                         float(rng.integers(1, 35) * 5), "home", 110.0, "why", 4.13))
    df = spark.createDataFrame(rows, "event_id int, cand_team string, day date, cand_ev double, cand_edge double, stake double, side string, price double, reason string, max_day_pct double")
    got = {r["event_id"]: r["stake"] for r in D.cap_daily(df, ["day"], "cand_team", "event_id").collect()}
    for d in {r[2] for r in rows}:
        left = 413.0
        for r in sorted((r for r in rows if r[2] == d), key=lambda r: (-r[3], -r[4], -r[5], r[1], r[0])):
            amount = min(r[5], left)
            want = np.floor(amount / 5 + 0.5) * 5 if amount > 0 else 0.0
            want = want if want >= 5 else 0.0
            assert got[r[0]] == want
            left -= want


def test_settlement_and_ledger(spark):
    rows = [(1, "home", 50.0, -120.0, 1), (2, "away", 50.0, -130.0, 0), (3, "none", 0.0, None, 1), (4, "home", 40.0, 150.0, None)]
    b = D.settle(spark.createDataFrame(rows, "event_id int, side string, stake double, price double, home_win int")).withColumn("day", F.lit("2024-01-01").cast("date"))
    assert {r["event_id"]: r["outcome"] for r in b.collect()} == {1: "win", 2: "win", 3: "no_bet", 4: "unsettled"}
    s = R.ledger_summary(b.where("home_win is not null"), [], "day").first()
    assert (s["tracked"], s["settled"], s["wins"], s["losses"], s["risked"]) == (3, 2, 2, 0, 100.0)
    assert s["profit"] == pytest.approx(80.13, abs=0.005)


def test_bankroll_path_matches_loop(spark):
    rng = np.random.default_rng(2)
    prof = rng.normal(0, 300, 200)
    rows = [("g", i, dt.date(2024, 1, 1) + dt.timedelta(days=i // 3), float(prof[i])) for i in range(200)]
    out = R.bankroll_path(spark.createDataFrame(rows, "g string, i int, day date, profit double"), ["g"], ["day", "i"], F.date_trunc("month", "day")).orderBy("i").collect()
    bank, peak = 5000.0, 5000.0
    for r, x in zip(out, prof):
        bank += x
        peak = max(peak, bank)
        assert r["bankroll"] == pytest.approx(bank) and r["peak"] == pytest.approx(peak)


def test_guarded_policies_ban_underdogs(spark):
    r = D.policy_table(spark, tight=True, guarded=True).collect()
    assert all(not x["allow_underdogs"] and x["max_day_pct"] == 1.5 and x["stake_scale"] == 0.2 for x in r)


def test_next_events_distribution(spark):
    rows = spark.createDataFrame([("e", 0.5, 1), ("e", 0.25, 2), ("e", 0.8, 3), ("e", 0.1, 4)], "entity string, entity_prob double, o int")
    r = Z.next_events_odds(rows, 3, ["o"]).first()
    assert r["wins_dist"] == pytest.approx([0.075, 0.4, 0.425, 0.1]) and r["prob_win_all"] == pytest.approx(0.1)


def test_rate_win_prob_symmetry(spark):
    df = spark.createDataFrame([(3.0, 3.0), (4.0, 2.0)], "h double, a double")
    r = [x["prob"] for x in Z.rate_win_prob(df, "h", "a").collect()]
    assert r[0] == pytest.approx(0.5, abs=1e-9) and 0.75 < r[1] < 0.85


def test_sweep_equals_the_loop_and_multiplies_no_rows(spark, capsys):
    """Every policy against a loop, with ties in value and edge; rows are not exploded over the grid."""
    rng = np.random.default_rng(9)
    rows = [(d * 100 + i, f"t{rng.integers(5)}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(rng.choice([.016, .022, .04, .08])), float(rng.choice([.026, .032, .05])),
             float(np.round(rng.uniform(-.01, .2), 3)) if i else 1e-9, ["home", "away"][i % 2], float(rng.choice([-150., 120.])), True, True, int(rng.integers(2))) for d in range(24) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id int, cand_team string, day date, cand_ev double, cand_edge double, base_share double, cand_side string, cand_price double, priced boolean, positive boolean, home_win int")
    grid = {"min_edge": (.025, .03), "min_ev": (.015, .02), "stake_scale": (.2, 1.0), "max_bet_pct": (.5, 2.0), "max_day_pct": (1.5, 6.0)}
    out = R.policy_sweep(df, "day", "event_id", grid=grid)
    out.explain("formatted")
    assert "Generate" not in capsys.readouterr().out
    got = {(r["allow_underdogs"], r["min_edge"], r["min_ev"], r["stake_scale"], r["max_bet_pct"], r["max_day_pct"]): r for r in out.collect()}
    assert len(got) == 64
    unit = lambda a: max(0.0, np.floor(a / 5 + .5) * 5)
    for (dogs, edge, ev, scale, cap, most), r in got.items():
        path, bets, risked = [], 0, 0.0
        for d in sorted({x[2] for x in rows}):
            left, won = most * 100, 0.0
            live = [(x, unit(round(10000 * min(cap / 100, scale * x[5]), 9))) for x in rows if x[2] == d and x[4] >= edge and x[3] >= ev and (dogs or x[7] < 0)]
            for x, s in sorted((z for z in live if z[1] > 0), key=lambda z: (-z[0][3], -z[0][4], -z[1], z[0][1], z[0][0])):
                s = unit(min(s, left)) if left > 0 else 0.0
                left, risked, bets = left - s, risked + s, bets + (s > 0)
                won += s * ((x[7] / 100 if x[7] > 0 else 100 / -x[7]) if (x[6] == "home") == (x[10] == 1) else -1)
            path.append(won)
        c = np.cumsum(path)
        assert (r["settled_bets"], r["total_risked"], r["active_days"]) == (bets, risked, sum(abs(x) > 1e-9 for x in path))
        assert r["total_profit"] == pytest.approx(c[-1], abs=2e-6) and r["max_drawdown_dollars"] == pytest.approx((np.maximum.accumulate(np.maximum(c, 0)) - c).max(), abs=2e-6)
        assert r["downside_deviation"] == pytest.approx(np.sqrt(sum(x * x for x in path if x < 0) / 24), abs=2e-6)
