"""The fixed questions, standings, rates, ensembles and scorecards."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from augury.functions.columns import clip_prob
from augury.operators import prices as P, replay as R, scoring as S, standings as Z, temporal as T
from augury.operators.ordered import latest_by
from augury.plans.registry import query, sql
from augury.plans.replay_queries import (DEC, EVK, LEDGER, MKT_SQL, PATH_SQL, POL_SQL, DEC_SQL, PRB, SNAP_SQL, cands, lines)
from augury.plans.roles import EVENTS_SQL, FORECASTS_SQL, PRICES_SQL, events, table
from augury.plans.scoring_queries import BASE, bundle_sql, named_forecasts, newton_sql, scored
from augury.operators.decisions import policy_table

UP_SQL = """
up AS (SELECT e.event_id, e.league, e.home, e.away, e.start_ts, avg(f.prob) AS prob, max(f.as_of) AS as_of, min(f.prob) AS lo, max(f.prob) AS hi FROM ev e
  JOIN (SELECT event_id, model, avg(prob) AS prob, max(as_of) AS as_of FROM fc GROUP BY 1, 2) f USING (event_id) WHERE e.is_final = 0 GROUP BY ALL)"""
UP = (EVENTS_SQL, FORECASTS_SQL, UP_SQL)


def upcoming(spark, d):
    """Open events with the mean probability and the models' probabilities as a JSON map."""
    per = named_forecasts(spark, d).groupBy("event_id", "model").agg(F.avg("prob").alias("prob"), F.max("as_of").alias("as_of"))
    m = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "prob")))))
    agg = per.groupBy("event_id").agg(F.avg("prob").alias("prob"), F.max("as_of").alias("as_of"), m.alias("model_probs_json"),
                                      F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    ev = events(spark, d).where("is_final = 0").select("event_id", "league", "home", "away", "start_ts")
    return ev.join(agg, "event_id")


@query("orient", sql("""SELECT event_id, u.model, CASE WHEN home = 'C7' OR home LIKE 'C1%' THEN prob ELSE 1-prob END AS entity_prob FROM (SELECT f.event_id, f.model, avg(f.prob) AS prob, e.home FROM fc f JOIN ev e USING (event_id)
    WHERE e.is_final = 0 GROUP BY 1, 2, 4) u""", EVENTS_SQL, FORECASTS_SQL, r="entity_prob"))
def _(spark, d):
    u = upcoming(spark, d)
    who = F.when(F.col("home").startswith("C1") | (F.col("home") == "C7"), F.col("home")).otherwise(F.col("away"))
    o = Z.orient(u, who, model_probs="model_probs_json")
    return o.select("event_id", F.explode("entity_model_probs").alias("model", "entity_prob"))


STAND_SQL = """
tg AS (SELECT venue AS entity, home_win AS won FROM ev WHERE home_win IS NOT NULL UNION ALL SELECT 'N' || s_nationkey, 1-home_win FROM ev JOIN supplier ON 'S' || s_suppkey = away WHERE home_win IS NOT NULL),
sd1 AS (SELECT entity, sum(won)::BIGINT AS wins, count(*) AS played FROM tg GROUP BY 1),
sd2 AS (SELECT *, played-wins AS losses, (wins+1)/(played+2) AS mean_rate FROM sd1),
sd3 AS (SELECT *, ln(greatest(0.15::DOUBLE, least(0.85::DOUBLE, mean_rate))/(1-greatest(0.15::DOUBLE, least(0.85::DOUBLE, mean_rate)))) AS strength FROM sd2),
sd4 AS (SELECT *, row_number() OVER (ORDER BY strength DESC) AS pos FROM sd3),
sd5 AS (SELECT *, 1/(1+exp(-(strength-(SELECT min(strength) FROM sd4 WHERE pos <= 16))/0.30))*exp(1.75*strength) AS raw FROM sd4),
sd6 AS (SELECT *, raw/sum(raw) OVER () AS title_share FROM sd5)"""


def nation_events(spark, d):
    """Events between nations: few entities with many results each, as a league has."""
    sup = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("away"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("_n"))
    return events(spark, d).join(sup, "away").withColumns({"home": F.col("venue"), "away": F.col("_n")}).drop("_n")


@query("standings", sql("SELECT entity, wins, losses, played, mean_rate, strength, title_share, row_number() OVER (ORDER BY round(title_share, 12) DESC, entity)::INT AS rank FROM sd6", EVENTS_SQL, STAND_SQL, r="mean_rate strength title_share"))
def _(spark, d):
    return Z.standings(nation_events(spark, d))


@query("title_odds", sql("""WITH z AS (SELECT sd6.*, (SELECT min(strength) FROM sd4 WHERE pos <= 16) AS last, sum(raw) OVER () - raw AS rest, ln(mean_rate/(1-mean_rate)) AS lo, 1.6448536269514722::DOUBLE*sqrt(1/(wins+1.0::DOUBLE) + 1/(losses+1.0::DOUBLE)) AS w, ln(0.85::DOUBLE/0.15::DOUBLE) AS g FROM sd6),
    m AS (SELECT *, greatest(-g, least(g, lo - w)) AS s0, greatest(-g, least(g, lo + w)) AS s1 FROM z),
    q AS (SELECT *, 1/(1+exp(-(s0-last)/0.30::DOUBLE))*exp(1.75::DOUBLE*s0) AS r0, 1/(1+exp(-(s1-last)/0.30::DOUBLE))*exp(1.75::DOUBLE*s1) AS r1 FROM m)
SELECT entity, wins, losses, played, mean_rate, strength, title_share, row_number() OVER (ORDER BY round(title_share, 12) DESC, entity)::INT AS rank, r0/(rest+r0) AS low_90, r1/(rest+r1) AS high_90 FROM q""",
    EVENTS_SQL, STAND_SQL, r="mean_rate strength title_share low_90 high_90"))
def _(spark, d):
    return Z.title_odds(nation_events(spark, d))


RATE_SQL = """
fe AS (SELECT event_id, home, away, home_win, home_score/25 AS hs, away_score/25 AS as_, is_final FROM ev),
rt0 AS (SELECT (sum(hs)+sum(as_))/(2*count(*)) AS lg, greatest(0.8, least(1.2, avg(hs)/greatest(avg(as_), 1e-6))) AS hf FROM fe WHERE home_win IS NOT NULL),
rt1 AS (SELECT entity, sum(f) AS f, sum(a) AS a, count(*) AS n FROM (SELECT home AS entity, hs AS f, as_ AS a FROM fe WHERE home_win IS NOT NULL UNION ALL SELECT away, as_, hs FROM fe WHERE home_win IS NOT NULL) GROUP BY 1),
rt AS (SELECT entity, n AS played, (f+5*lg)/(n+5)/lg AS attack, (a+5*lg)/(n+5)/lg AS defence, lg AS league_avg, hf AS home_factor FROM rt1, rt0)"""


def small_scores(spark, d):
    return events(spark, d).withColumns({"home_score": F.col("home_score") / 25, "away_score": F.col("away_score") / 25})


@query("scoring_rates", sql("SELECT * FROM rt", EVENTS_SQL, RATE_SQL, r="attack defence league_avg home_factor"))
def _(spark, d):
    return Z.scoring_rates(small_scores(spark, d), 5.0)


@query("gamma_poisson_rates", sql("SELECT entity, 2+f AS alpha, 1.0+n AS beta, (2+f)/(1+n) AS rate FROM rt1", EVENTS_SQL, RATE_SQL, r="alpha beta rate"))
def _(spark, d):
    return Z.gamma_poisson_rates(small_scores(spark, d))


@query("rate_win_prob", sql("""WITH l AS (SELECT fe.event_id, greatest(0.8, rt0.lg*coalesce(h.attack, 1)*coalesce(a.defence, 1)*rt0.hf) AS lh, greatest(0.8, rt0.lg*coalesce(a.attack, 1)*coalesce(h.defence, 1)) AS la
      FROM rt0, fe LEFT JOIN rt h ON h.entity = home LEFT JOIN rt a ON a.entity = away WHERE fe.home_win IS NULL),
    k AS (SELECT event_id, lh, la, i, exp(-lh+i*ln(lh)-lgamma(i+1)) AS ph, exp(-la+i*ln(la)-lgamma(i+1)) AS pa FROM l, range(0, 61) r(i)),
    c AS (SELECT *, sum(pa) OVER (PARTITION BY event_id ORDER BY i) - pa AS below FROM k)
SELECT event_id, lh AS home_rate, la AS away_rate, sum(ph*(below+pa/2)) AS prob FROM c GROUP BY 1, 2, 3""", EVENTS_SQL, RATE_SQL, r="home_rate away_rate prob"))
def _(spark, d):
    ev = small_scores(spark, d)
    r = Z.scoring_rates(ev, 5.0)
    lg = r.agg(F.max("league_avg").alias("lg"), F.max("home_factor").alias("hf"))
    side = lambda c: r.select(F.col("entity").alias(c), F.col("attack").alias(f"{c}_att"), F.col("defence").alias(f"{c}_def"))
    x = ev.where("home_win is null").select("event_id", "home", "away").join(side("home"), "home", "left").join(side("away"), "away", "left").crossJoin(F.broadcast(lg))  # one row
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    x = x.withColumns({"home_rate": F.greatest(F.lit(0.8), F.col("lg") * one("home_att") * one("away_def") * F.col("hf")),
                       "away_rate": F.greatest(F.lit(0.8), F.col("lg") * one("away_att") * one("home_def"))})
    return Z.rate_win_prob(x, "home_rate", "away_rate").select("event_id", "home_rate", "away_rate", "prob")


WT_SQL = """
wm AS (SELECT b.model, log_loss, brier, ece, calibration_beta FROM bundle b JOIN fit USING (model)),
wp AS (SELECT model, log_loss + 0.7*brier + 0.6*ece + 0.5*abs(calibration_beta-1) AS penalty FROM wm),
wt AS (SELECT model, penalty, exp(-penalty)/sum(exp(-penalty)) OVER () AS weight FROM wp)"""
WT = (*BASE, bundle_sql("SELECT * FROM sc", "model"), newton_sql("SELECT * FROM sc", "model"), WT_SQL)


def weights(spark, d):
    s = scored(spark, d)
    m = S.score_groups(s, ["model"], "home_win", "prob").join(S.calibration_fit(s, ["model"], "home_win", "prob"), "model")
    return Z.ensemble_weights(m)


@query("ensemble_weights", sql("SELECT * FROM wt", *WT, r="penalty weight"))
def _(spark, d):
    return weights(spark, d)


@query("blend", sql("""WITH m AS (SELECT event_id, model, avg(prob) AS prob FROM fc GROUP BY 1, 2)
SELECT event_id, sum(prob*weight)/sum(weight) AS weighted, count(*) AS models, min(prob) AS spread_min, quantile_cont(prob, 0.5) AS spread_median, max(prob) AS spread_max, avg(prob) AS spread_mean, stddev_pop(prob) AS spread_sd,
    quantile_cont(prob, 0.75)-quantile_cont(prob, 0.25) AS spread_iqr, 0.6*avg(prob)+0.4*sum(prob*weight)/sum(weight) AS ensemble FROM m JOIN wt USING (model) WHERE model <> 'm_r0' GROUP BY 1""", *WT,
    r="weighted spread_min spread_median spread_max spread_mean spread_sd spread_iqr ensemble"))
def _(spark, d):
    long = named_forecasts(spark, d).groupBy("event_id", "model").agg(F.avg("prob").alias("prob"))
    b = Z.blend(long, weights(spark, d), "event_id", "model", "prob", exclude=["m_r0"])
    return Z.stacked_blend(b, "spread_mean", "weighted")


CARD_SQL = """
fo AS (SELECT model, policy, year(start_ts) AS fold, 5000+sum(profit) AS ending_bankroll, sum(profit) AS net_profit, coalesce(sum(profit)/nullif(sum(cap), 0), 0) AS roi, sum(cap)/5000 AS turnover, sum((cap>0)::INT) AS bet_count FROM bt GROUP BY 1, 2, 3),
fp0 AS (SELECT *, 5000 + sum(profit) OVER (PARTITION BY model, policy, year(start_ts) ORDER BY start_ts, event_id ROWS UNBOUNDED PRECEDING) AS bankroll FROM bt),
fp1 AS (SELECT *, greatest(5000, max(bankroll) OVER (PARTITION BY model, policy, year(start_ts) ORDER BY start_ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM fp0),
fd AS (SELECT model, policy, year(start_ts) AS fold, max((peak-bankroll)/peak) AS max_drawdown_ratio, max(peak-bankroll) AS max_drawdown_dollars FROM fp1 GROUP BY 1, 2, 3),
cdd AS (SELECT model, policy, avg(ending_bankroll) AS mean_ending_bankroll, avg(net_profit) AS mean_net_profit, median(roi) AS median_roi, avg(roi) AS mean_roi, avg(turnover) AS mean_turnover, avg(max_drawdown_ratio) AS mean_max_drawdown,
  avg(max_drawdown_dollars) AS mean_max_drawdown_dollars, sum((ending_bankroll>5000)::INT)::BIGINT AS profitable_folds, sum((net_profit>0)::INT)::BIGINT AS profit_winning_folds, avg(log_loss) AS mean_log_loss, avg(brier) AS mean_brier, avg(ece) AS mean_ece,
  avg(auc) AS mean_auc, sum(bet_count)::BIGINT AS bet_count FROM fo JOIN fd USING (model, policy, fold) JOIN (SELECT model, yr AS fold, log_loss, brier, ece, auc FROM bundle) USING (model, fold) GROUP BY 1, 2)"""
CARD = (EVENTS_SQL, FORECASTS_SQL, BASE[2], MKT_SQL, POL_SQL, DEC_SQL, bundle_sql("SELECT *, year(start_ts) AS yr FROM sc", "model,yr"), CARD_SQL)
CARD_R = "mean_ending_bankroll mean_net_profit median_roi mean_roi mean_turnover mean_max_drawdown mean_max_drawdown_dollars mean_log_loss mean_brier mean_ece mean_auc"


def card(spark, d):
    c = cands(spark, d).withColumn("fold", F.year("start_ts"))
    money = R.replay(c, policy_table(spark), ["model", "fold"], "day", "event_id", ["start_ts", "event_id"], F.date_trunc("hour", "start_ts"))
    s = S.score_groups(scored(spark, d).withColumn("fold", F.year("start_ts")), ["model", "fold"], "home_win", "prob")
    return Z.scorecard(money.join(s.select("model", "fold", "log_loss", "brier", "ece", "auc"), ["model", "fold"]), ["model", "policy"])


@query("scorecard", sql("SELECT * FROM cdd", *CARD, r=CARD_R))
def _(spark, d):
    return card(spark, d)


@query("promotion_gates", sql("""WITH g AS (SELECT c.*, (c.mean_ending_bankroll > b.mean_ending_bankroll)::INT AS gate_bankroll, (c.mean_net_profit > b.mean_net_profit)::INT AS gate_profit, (c.median_roi >= b.median_roi)::INT AS gate_roi,
      (c.profit_winning_folds >= b.profit_winning_folds)::INT AS gate_fold_wins, (c.mean_max_drawdown_dollars <= least(b.mean_max_drawdown_dollars+250, 750))::INT AS gate_drawdown, (c.mean_ece <= b.mean_ece+0.01)::INT AS gate_ece,
      (c.bet_count >= 30)::INT AS gate_bets, (c.profitable_folds >= 2)::INT AS gate_profitable_folds FROM cdd c JOIN cdd b ON b.model = 'm_r1' AND b.policy = c.policy WHERE c.model <> 'm_r1')
SELECT model, policy, gate_bankroll, gate_profit, gate_roi, gate_fold_wins, gate_drawdown, gate_ece, gate_bets, gate_profitable_folds, row_number() OVER (ORDER BY round(mean_ending_bankroll, 9) DESC, round(mean_net_profit, 9) DESC, round(mean_roi, 9) DESC,
      profitable_folds DESC, round(mean_max_drawdown, 9), round(mean_log_loss, 9), round(mean_brier, 9), model, policy)::INT AS candidate_rank, (gate_bankroll+gate_profit+gate_roi+gate_fold_wins+gate_drawdown+gate_ece+gate_bets+gate_profitable_folds = 8)::INT AS promoted FROM g""", *CARD))
def _(spark, d):
    g = Z.promotion_gates(card(spark, d), "model", "policy", "m_r1")
    return g.select("model", "policy", *[c for c in g.columns if c.startswith("gate_")], "candidate_rank", "promoted")


# ---- questions ----------------------------------------------------------------------------------
@query("q_bet_summary", sql(f"SELECT model, policy, {LEDGER}, min(start_ts) AS first_day, max(start_ts) AS last_day FROM bt WHERE home_win IS NOT NULL AND start_ts::DATE = (SELECT max(start_ts)::DATE - 1 FROM bt) GROUP BY 1, 2", *DEC,
    r="risked profit roi bankroll", day="first_day last_day"))
def _(spark, d):
    c = cands(spark, d)
    last = c.agg(F.date_sub(F.to_date(F.max("start_ts")), 1).alias("_y"))
    y = c.crossJoin(F.broadcast(last)).where(F.col("day") == F.col("_y"))  # one row; a day's bets depend on that day only
    b = R.play(y, policy_table(spark), ["model"], "day", "event_id")
    return R.ledger_summary(b.where("home_win is not null"), ["model", "policy"], "day")


@query("q_next_event", sql("""SELECT event_id, home, away, start_ts, CASE WHEN home = 'S7' THEN prob ELSE 1-prob END AS entity_prob, (home='S7')::INT AS is_home, lo, hi FROM up WHERE home = 'S7' OR away = 'S7'
    ORDER BY start_ts, event_id LIMIT 1""", *UP, r="entity_prob lo hi", ts="start_ts"))
def _(spark, d):
    n = T.next_n(upcoming(spark, d), "S7", 1, ["start_ts", "event_id"])
    return Z.orient(n, F.lit("S7")).select("event_id", "home", "away", "start_ts", "entity_prob", "is_home", "lo", "hi")


@query("q_next_n_events", sql("""WITH t AS (SELECT home AS entity, prob AS p, start_ts, event_id FROM up UNION ALL SELECT away, 1-prob, start_ts, event_id FROM up),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_ts, event_id) AS k FROM t),
    x AS (SELECT entity, count(*)::INT AS events, exp(sum(ln(p))) AS prob_win_all, sum(p) AS expected_wins, 1-exp(sum(ln(1-p))) AS prob_at_least_one, list(p ORDER BY k) AS ps FROM r WHERE k <= 3 GROUP BY 1)
SELECT entity, events, prob_win_all, expected_wins, prob_at_least_one, CASE events WHEN 1 THEN ps[1] WHEN 2 THEN ps[1]*(1-ps[2])+ps[2]*(1-ps[1])
    ELSE ps[1]*(1-ps[2])*(1-ps[3])+ps[2]*(1-ps[1])*(1-ps[3])+ps[3]*(1-ps[1])*(1-ps[2]) END AS prob_exactly_one FROM x""", *UP, r="prob_win_all expected_wins prob_at_least_one prob_exactly_one"))
def _(spark, d):
    u = upcoming(spark, d)
    side = lambda c, p: u.select(F.col(c).alias("entity"), p.alias("entity_prob"), "start_ts", "event_id")
    rows = T.stack_roles(side("home", F.col("prob")), side("away", 1 - F.col("prob")))
    o = Z.next_events_odds(rows, 3, ["start_ts", "event_id"])
    return o.select("entity", "events", "prob_win_all", "expected_wins", "prob_at_least_one", F.element_at("wins_dist", 2).alias("prob_exactly_one"))


@query("q_league_report", sql("""WITH t AS (SELECT home AS entity, up.* FROM up WHERE league = '1-URGENT' UNION ALL SELECT away, up.* FROM up WHERE league = '1-URGENT'),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY start_ts, event_id) AS k FROM t),
    m AS (SELECT event_id, avg(CASE WHEN model='m_a1' THEN prob END) AS m_a1, avg(CASE WHEN model='m_n0' THEN prob END) AS m_n0, avg(CASE WHEN model='m_n1' THEN prob END) AS m_n1, avg(CASE WHEN model='m_r0' THEN prob END) AS m_r0,
      avg(CASE WHEN model='m_r1' THEN prob END) AS m_r1 FROM fc GROUP BY 1)
SELECT entity, r.event_id, CASE WHEN entity = home THEN prob ELSE 1-prob END AS entity_prob, CASE WHEN entity = home THEN m_a1 ELSE 1-m_a1 END AS m_a1, CASE WHEN entity = home THEN m_n0 ELSE 1-m_n0 END AS m_n0,
    CASE WHEN entity = home THEN m_n1 ELSE 1-m_n1 END AS m_n1, CASE WHEN entity = home THEN m_r0 ELSE 1-m_r0 END AS m_r0, CASE WHEN entity = home THEN m_r1 ELSE 1-m_r1 END AS m_r1,
    row_number() OVER (ORDER BY round(CASE WHEN entity = home THEN prob ELSE 1-prob END, 9) DESC, entity)::INT AS rank FROM r JOIN m USING (event_id) WHERE k = 1""", *UP, r="entity_prob m_a1 m_n0 m_n1 m_r0 m_r1"))
def _(spark, d):
    from augury.operators.ordered import earliest_by
    u = upcoming(spark, d).where("league = '1-URGENT'")
    both = u.withColumn("entity", F.explode(F.array("home", "away")))
    nxt = earliest_by(both, ["entity"], [F.col("start_ts"), F.col("event_id")])
    o = Z.orient(nxt, F.col("entity"), model_probs="model_probs_json")
    models = ["m_a1", "m_n0", "m_n1", "m_r0", "m_r1"]
    # a ranking of the whole report, one row per entity of one league
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.round("entity_prob", 9).desc(), "entity"))
    return o.select("entity", "event_id", "entity_prob", *[F.try_element_at("entity_model_probs", F.lit(m)).alias(m) for m in models], rank.alias("rank"))


@query("q_best_model", sql("""SELECT model, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(accuracy) AS accuracy, count(*) AS n FROM sc WHERE start_ts::DATE >= (SELECT max(start_ts)::DATE FROM sc) - 30
    GROUP BY 1 ORDER BY 2, 1 LIMIT 1""", *BASE, r="log_loss brier accuracy"))
def _(spark, d):
    return S.leaderboard(scored(spark, d), "event_id", "model", "start_ts", "as_of", "forecast_id", 30).limit(1)


@query("q_forecast_board", sql(f"""WITH sn AS (SELECT u.event_id, p.snapshot_id, row_number() OVER (PARTITION BY u.event_id ORDER BY p.snapshot_as_of DESC, p.snapshot_id DESC) AS k FROM up u JOIN pr p
      ON p.market = 'h2h' AND (p.event_ref = u.event_id OR (p.home = u.home AND p.away = u.away)) AND p.snapshot_as_of <= u.start_ts),
    b AS (SELECT snapshot_id, {EVK} AS event_key, max(CASE WHEN side='home' THEN price END) AS home_price, max(CASE WHEN side='away' THEN price END) AS away_price FROM pr WHERE market = 'h2h' AND side IN ('home','away') GROUP BY 1, 2),
    a AS (SELECT snapshot_id, event_key, alt_point FROM (SELECT snapshot_id, {EVK} AS event_key, min(point) AS alt_point FROM pr WHERE market='totals' AND side='over' AND point >= 182 GROUP BY 1, 2))
SELECT u.event_id, u.home, u.away, u.prob, sn.snapshot_id, coalesce(b1.home_price, b2.home_price) AS home_price, coalesce(b1.away_price, b2.away_price) AS away_price, coalesce(a1.alt_point, a2.alt_point) AS alt_point FROM up u
    LEFT JOIN sn ON sn.event_id = u.event_id AND sn.k = 1 LEFT JOIN b b1 ON b1.snapshot_id = sn.snapshot_id AND b1.event_key = u.event_id::VARCHAR LEFT JOIN b b2 ON b2.snapshot_id = sn.snapshot_id AND b2.event_key = u.home || '|' || u.away
    LEFT JOIN a a1 ON a1.snapshot_id = sn.snapshot_id AND a1.event_key = u.event_id::VARCHAR LEFT JOIN a a2 ON a2.snapshot_id = sn.snapshot_id AND a2.event_key = u.home || '|' || u.away""", EVENTS_SQL, FORECASTS_SQL, UP_SQL, PRICES_SQL, r="prob home_price away_price alt_point"))
def _(spark, d):
    u, l = upcoming(spark, d), lines(spark, d)
    h2h = l.where("market = 'h2h'")
    snap = T.asof_snapshot(u.select("event_id", "home", "away", "start_ts"), h2h.select("event_ref", "home", "away", "snapshot_id", "snapshot_as_of", F.col("snapshot_as_of").alias("eff"),
                           F.col("snapshot_id").alias("line_id")), "event_id", "event_ref", ["home", "away"], "start_ts", "eff", "snapshot_id", "snapshot_as_of", "line_id")
    best = P.best_prices(h2h, "snapshot_id", "event_ref", "home", "away", "side", "price", "book", "updated_at", "line_id").select("snapshot_id", "event_key", "home_price", "away_price")
    alt = P.alt_total(l.where("market='totals' AND side='over'"), "snapshot_id", "event_ref", "home", "away", "price", "point", "book", "updated_at", "line_id", 182.0).select("snapshot_id", "event_key", "alt_point")
    out = u.select("event_id", "home", "away", "prob").join(snap.select("event_id", "snapshot_id"), "event_id")
    for df, cols in ((best, ["home_price", "away_price"]), (alt, ["alt_point"])):
        for key, suffix in ((F.col("event_id").cast("string"), "1"), (F.concat_ws("|", "home", "away"), "2")):
            side = df.select("snapshot_id", "event_key", *[F.col(c).alias(f"{c}_{suffix}") for c in cols])
            out = out.withColumn("event_key", key).join(side, ["snapshot_id", "event_key"], "left").drop("event_key")
    return out.select("event_id", "home", "away", "prob", "snapshot_id", *[F.coalesce(f"{c}_1", f"{c}_2").alias(c) for c in ("home_price", "away_price", "alt_point")])
