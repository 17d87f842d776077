"""Forecast scoring queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from augury.functions.columns import canonical_name, frozen_only, season_code
from augury.operators import scoring as S
from augury.plans.registry import query, sql
from augury.plans.roles import (ALIASES, EVENTS_SQL, FORECASTS_SQL, SCORED_SQL, events, forecasts)

BASE = (EVENTS_SQL, FORECASTS_SQL, SCORED_SQL)
METRICS = "log_loss brier accuracy auc ece mce"


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("model", canonical_name("raw_model", ALIASES))


def named_forecasts(spark: SparkSession, d: str) -> DataFrame:
    return named(forecasts(spark, d))


def scored(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d).select("event_id", "league", "start_ts", "final_ts", "home", "away", "venue", "home_win")
    return S.latest_scored(named_forecasts(spark, d), ev, "event_id", "model", "as_of", "final_ts", "start_ts",
                           "home_win", "prob", "forecast_id", frozen=F.col("source") == "live")


def bundle_sql(src: str, keys: str, extra: str = "") -> str:
    """AUC by tie-aware ranks and calibration error by bins, written directly in SQL."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(","))
    return f"""
b_rows AS ({src}),
b_rank AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p)
    + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2.0::DOUBLE AS avg_rank FROM b_rows),
b_main AS (SELECT {keys}, count(*) AS n,
    avg(-(home_win*ln(p) + (1-home_win)*ln(1-p))) AS log_loss, avg((p-home_win)*(p-home_win)) AS brier,
    avg(((p >= 0.5)::INT = home_win)::INT) AS accuracy,
    (sum(CASE WHEN home_win=1 THEN avg_rank ELSE 0 END) - sum(home_win)*(sum(home_win)+1)/2.0::DOUBLE)
      / nullif(sum(home_win)*(count(*)-sum(home_win)), 0) AS auc {extra}
  FROM b_rank GROUP BY {keys}),
b_bin AS (SELECT {keys}, ceil(p*10) AS bin, count(*) AS bn, abs(avg(p) - avg(home_win)) AS gap FROM b_rows GROUP BY {keys}, bin),
b_cal AS (SELECT {keys}, sum(bn*gap)/sum(bn) AS ece, max(gap) AS mce FROM b_bin GROUP BY {keys}),
bundle AS (SELECT a.*, b.ece, b.mce FROM b_main a JOIN b_cal b ON {on})"""


def newton_sql(src: str, keys: str, steps: int = 7) -> str:
    """The same ridge-on-slope logistic fit as nested SELECTs, one per Newton step."""
    on = " AND ".join(f"d.{k} = f.{k}" for k in keys.split(","))
    k_d = ", ".join(f"d.{k}" for k in keys.split(","))
    parts = [f"nd AS MATERIALIZED (SELECT *, ln(p/(1-p)) AS x FROM ({src}))",
             f"f0 AS (SELECT {keys}, 0.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM nd GROUP BY {keys} "
             "HAVING min(home_win) = 0 AND max(home_win) = 1)"]
    for i in range(steps):
        parts.append(f"""f{i + 1} AS MATERIALIZED (SELECT {keys}, a + ((h2+1)*g0 - h1*(g1-c))/(h0*(h2+1)-h1*h1) AS a,
            c + (h0*(g1-c) - h1*g0)/(h0*(h2+1)-h1*h1) AS c FROM (SELECT {k_d}, f.a, f.c, sum(home_win-mu) AS g0,
            sum((home_win-mu)*x) AS g1, sum(mu*(1-mu)) AS h0, sum(mu*(1-mu)*x) AS h1, sum(mu*(1-mu)*x*x) AS h2
            FROM (SELECT d.*, f.a, f.c, 1/(1+exp(-(f.a+f.c*d.x))) AS mu FROM nd d JOIN f{i} f ON {on}) d
            JOIN f{i} f ON {on} GROUP BY ALL))""")
    parts.append(f"fit AS (SELECT {keys}, a AS calibration_alpha, c AS calibration_beta FROM f{steps})")
    return ",\n".join(parts)


@query("scored_latest", sql(
    "SELECT event_id, model, prob, home_win, as_of, log_loss, brier, accuracy FROM sc", *BASE,
    r="prob log_loss brier", ts="as_of"))
def _(spark, d):
    return scored(spark, d).select("event_id", "model", "prob", "home_win", "as_of", "log_loss", "brier", "accuracy")


WINDOWS_SRC = """SELECT s.*, w.lab AS win FROM (SELECT *, date_diff('day', start_ts,
    max(start_ts) OVER (PARTITION BY model)) AS age FROM sc) s
  JOIN (VALUES ('cumulative', 1000000000), ('7d', 7), ('30d', 30), ('60d', 60), ('90d', 90)) w(lab, len) ON s.age <= w.len"""


@query("performance_windows", sql(
    "SELECT b.model, b.win AS \"window\", n, log_loss, brier, accuracy, auc, ece, mce, start_date, end_date, calibration_alpha, calibration_beta FROM bundle b LEFT JOIN fit ON b.model = fit.model AND b.win = fit.win",
    *BASE, bundle_sql(WINDOWS_SRC, "model,win", ", min(start_ts) AS start_date, max(start_ts) AS end_date"), newton_sql(WINDOWS_SRC, "model,win"),
    r=METRICS + " calibration_alpha calibration_beta", ts="start_date end_date"))
def _(spark, d):
    return S.performance(scored(spark, d), ["model"], "start_ts", "home_win", "prob")


@query("calibration_fit", sql("SELECT model, calibration_alpha, calibration_beta FROM fit", *BASE,
                              newton_sql("SELECT * FROM sc", "model"), r="calibration_alpha calibration_beta"))
def _(spark, d):
    return S.calibration_fit(scored(spark, d), ["model"], "home_win", "prob")


@query("metric_bundle", sql("SELECT model, league, n, log_loss, brier, accuracy, auc, ece, mce FROM bundle", *BASE,
                            bundle_sql("SELECT * FROM sc", "model,league"), r=METRICS))
def _(spark, d):
    return S.score_groups(scored(spark, d), ["model", "league"], "home_win", "prob")


@query("reliability", sql("""SELECT model, ceil(p*10)::INT AS bin, count(*) AS n, avg(p) AS pred_mean, avg(home_win) AS obs_rate,
    abs(avg(p)-avg(home_win)) AS abs_gap FROM sc GROUP BY 1, 2""", *BASE, r="pred_mean obs_rate abs_gap"))
def _(spark, d):
    return S.reliability(scored(spark, d), ["model"], "home_win", "prob")


@query("ece_mce", sql("""SELECT model, sum(n*g)/sum(n) AS ece, max(g) AS mce FROM (SELECT model, ceil(p*10) AS bin,
    count(*) AS n, abs(avg(p)-avg(home_win)) AS g FROM sc GROUP BY 1, 2) GROUP BY 1""", *BASE, r="ece mce"))
def _(spark, d):
    return S.ece_mce(scored(spark, d), ["model"], "home_win", "prob")


@query("brier_parts", sql("""SELECT t.model, t.brier, sum(c.n*(c.pk-c.ok)*(c.pk-c.ok))/t.n AS reliability,
    sum(c.n*(c.ok-t.base)*(c.ok-t.base))/t.n AS resolution, t.base*(1-t.base) AS uncertainty
  FROM (SELECT model, ceil(prob*10) AS bin, count(*) AS n, avg(prob) AS pk, avg(home_win) AS ok FROM sc GROUP BY 1, 2) c
  JOIN (SELECT model, count(*) AS n, avg(home_win) AS base, avg((prob-home_win)*(prob-home_win)) AS brier FROM sc GROUP BY 1) t
    USING (model) GROUP BY t.model, t.brier, t.n, t.base""", *BASE, r="brier reliability resolution uncertainty"))
def _(spark, d):
    return S.brier_parts(scored(spark, d), ["model"], "home_win", "prob")


@query("ave_by_date", sql("""SELECT start_ts AS event_date, avg(prob) AS avg_pred, avg(home_win) AS avg_obs,
    avg(prob)-avg(home_win) AS gap FROM sc GROUP BY 1""", *BASE, r="avg_pred avg_obs gap", day="event_date"))
def _(spark, d):
    rows = scored(spark, d).withColumn("event_date", F.to_date("start_ts"))
    return S.mean_by_date(rows, [], "event_date", "home_win", "prob")


@query("slice_metrics", sql("""SELECT slice_col, slice_val, n, log_loss, brier, accuracy, auc FROM bundle WHERE n >= 8""",
    *BASE, bundle_sql("""SELECT sc.*, u.slice_col, u.slice_val FROM sc, LATERAL (VALUES
      ('favorite', CASE WHEN prob >= 0.6 THEN 'favorite' ELSE 'other' END), ('league', league), ('venue', venue),
      ('month', month(start_ts)::VARCHAR)) u(slice_col, slice_val)""", "slice_col,slice_val"),
    r="log_loss brier accuracy auc"))
def _(spark, d):
    return S.slice_metrics(scored(spark, d), {
        "favorite": F.when(F.col("prob") >= 0.6, "favorite").otherwise("other"), "league": F.col("league"),
        "venue": F.col("venue"), "month": F.month("start_ts")}, "home_win", "prob")


@query("leaderboard", sql("""SELECT model, avg(log_loss) AS log_loss, avg(brier) AS brier, avg(accuracy) AS accuracy,
    count(*) AS n FROM sc WHERE start_ts::DATE >= (SELECT max(start_ts)::DATE FROM sc) - 365 GROUP BY 1""",
    *BASE, r="log_loss brier accuracy"))
def _(spark, d):
    return S.leaderboard(scored(spark, d), "event_id", "model", "start_ts", "as_of", "forecast_id", 365)


@query("daily_scores", sql("SELECT model, start_ts, avg(log_loss) AS log_loss FROM sc GROUP BY 1, 2", *BASE,
                           r="log_loss", ts="start_ts"))
def _(spark, d):
    return S.daily_scores(scored(spark, d), "model", "start_ts")


@query("run_summaries", sql("""WITH s AS (SELECT model, run_id, count(*) AS n, avg(log_loss) AS avg_log_loss,
      avg(brier) AS avg_brier, avg(accuracy) AS accuracy, min(start_ts) AS first_date, max(start_ts) AS last_date,
      first(event_id ORDER BY start_ts, event_id, forecast_id) AS first_event,
      first(event_id ORDER BY start_ts DESC, event_id DESC, forecast_id DESC) AS last_event FROM sc GROUP BY 1, 2),
    ru AS (SELECT run_id, max(as_of) AS created_at FROM fc WHERE run_id <> 'run1998' GROUP BY 1)
SELECT model, s.run_id, n, avg_log_loss, avg_brier, accuracy, first_date, last_date, first_event, last_event, created_at,
      row_number() OVER w AS version_rank, (row_number() OVER w = 1)::INT AS is_latest FROM s LEFT JOIN ru ON s.run_id = ru.run_id
      WINDOW w AS (PARTITION BY model ORDER BY coalesce(created_at, last_date + INTERVAL 86399 SECOND) DESC, s.run_id DESC)""",
    *BASE, r="avg_log_loss avg_brier accuracy", ts="first_date last_date created_at"))
def _(spark, d):
    runs = forecasts(spark, d).where("run_id <> 'run1998'").groupBy("run_id").agg(F.max("as_of").alias("created_at"))
    return S.run_summaries(scored(spark, d), runs, "model", "run_id", "start_ts", "start_ts", "event_id",
                           "forecast_id", "created_at")


@query("backtest_metrics", sql("SELECT b.*, calibration_alpha, calibration_beta FROM bundle b JOIN fit USING (model)",
    EVENTS_SQL, FORECASTS_SQL,
    """wide AS (SELECT f.model, e.home_win, f.p FROM (SELECT event_id, model, avg(prob) AS p FROM fc GROUP BY 1, 2) f JOIN ev e USING (event_id) WHERE e.home_win IS NOT NULL)""",
    bundle_sql("SELECT * FROM wide", "model"), newton_sql("SELECT * FROM wide", "model"),
    r=METRICS + " calibration_alpha calibration_beta"))
def _(spark, d):
    models = ["m_a1", "m_n0", "m_n1", "m_r0", "m_r1"]
    wide = named_forecasts(spark, d).groupBy("event_id").agg(
        *[F.avg(F.when(F.col("model") == m, F.col("prob"))).alias(m) for m in models])
    wide = wide.join(events(spark, d).select("event_id", "home_win"), "event_id")
    return S.backtest_metrics(wide, models, "home_win")


@query("integrity_checks", sql("""WITH k AS (SELECT event_id, model, as_of, count(*) AS c, max(start_ts) AS dt
       FROM fc JOIN ev USING (event_id) GROUP BY 1, 2, 3),
    j AS (SELECT k.*, r.event_id IS NULL AS miss FROM k LEFT JOIN (SELECT event_id FROM ev WHERE home_win IS NOT NULL) r USING (event_id)),
    t AS (SELECT sum(CASE WHEN as_of > dt THEN c ELSE 0 END)::BIGINT AS late, sum((c > 1)::INT)::BIGINT AS repeated_keys,
      sum(CASE WHEN miss AND dt <= TIMESTAMP '2001-01-01' THEN c ELSE 0 END)::BIGINT AS missing_results,
      sum(CASE WHEN epoch(dt)-epoch(as_of) < (2-0.01)*86400 THEN c ELSE 0 END)::BIGINT AS embargo_breaches FROM j)
SELECT *, (late=0)::INT AS prediction_before_event, (repeated_keys=0)::INT AS unique_keys,
      (missing_results=0)::INT AS no_missing_results, (embargo_breaches=0)::INT AS embargo_respected FROM t""",
    EVENTS_SQL, FORECASTS_SQL))
def _(spark, d):
    ev = events(spark, d)
    pred = named_forecasts(spark, d).join(ev.select("event_id", "start_ts"), "event_id")
    return S.integrity_checks(pred, ev.where("home_win is not null"), "event_id", "model", "as_of", "start_ts",
                              F.lit("2001-01-01").cast("timestamp"), embargo_days=2)


@query("missing_results", sql("""SELECT event_id, forecast_id FROM fc WHERE event_id NOT IN
    (SELECT event_id FROM ev WHERE home_win IS NOT NULL)""", EVENTS_SQL, FORECASTS_SQL))
def _(spark, d):
    done = events(spark, d).where("home_win is not null")
    return S.missing_results(forecasts(spark, d).select("event_id", "forecast_id"), done, "event_id")


@query("drift", sql("""WITH ix AS (SELECT *, row_number() OVER (PARTITION BY model, league ORDER BY start_ts, event_id) AS i FROM sc),
    wd AS (SELECT a.model, a.league, a.start_ts, a.event_id, w.len AS window_rows, b.p, b.home_win, b.log_loss AS ll, b.brier AS br,
       b.accuracy AS ok, a.i FROM ix a, (VALUES (30), (60)) w(len), ix b
       WHERE a.model = b.model AND a.league = b.league AND b.i BETWEEN a.i - w.len + 1 AND a.i),
    rk AS (SELECT *, rank() OVER (PARTITION BY event_id, model, window_rows ORDER BY p)
       + (count(*) OVER (PARTITION BY event_id, model, window_rows, p) - 1)/2.0::DOUBLE AS ar FROM wd),
    mm AS (SELECT model, league, start_ts, event_id, window_rows, count(*) AS n, avg(ll) AS log_loss, avg(br) AS brier, avg(ok) AS accuracy,
       (sum(CASE WHEN home_win=1 THEN ar ELSE 0 END) - sum(home_win)*(sum(home_win)+1)/2.0::DOUBLE)
         / nullif(sum(home_win)*(count(*)-sum(home_win)), 0) AS auc FROM rk GROUP BY ALL),
    bb AS (SELECT model, event_id, window_rows, sum(g*c)/sum(c) AS ece, max(g) AS mce FROM (SELECT model, event_id, window_rows, ceil(p*10) AS bin,
       count(*) AS c, abs(avg(p)-avg(home_win)) AS g FROM wd GROUP BY ALL) GROUP BY ALL)
SELECT mm.*, ece, mce, calibration_alpha, calibration_beta FROM mm JOIN bb USING (model, event_id, window_rows) LEFT JOIN fit USING (model, event_id, window_rows) WHERE n >= 8""",
    *BASE, "dix AS (SELECT *, row_number() OVER (PARTITION BY model, league ORDER BY start_ts, event_id) AS i FROM sc)", newton_sql("SELECT a.model, a.event_id, w.len AS window_rows, b.p, b.home_win FROM dix a, (VALUES (30), (60)) w(len), dix b WHERE a.model = b.model AND a.league = b.league AND b.i BETWEEN a.i - w.len + 1 AND a.i",
                      "model,event_id,window_rows"), r=METRICS + " calibration_alpha calibration_beta", ts="start_ts"))
def _(spark, d):
    return S.drift(scored(spark, d), ["model", "league"], ["start_ts", "event_id"], "home_win", "prob",
                   cell=F.date_trunc("hour", F.col("start_ts")))


@query("pit_histogram", sql("""SELECT model, least(floor(prob*10), 9)::INT AS bin, count(*) AS n, avg(prob) AS mean_pit,
    count(*)*10/sum(count(*)) OVER (PARTITION BY model) AS density FROM fc GROUP BY 1, 2""", FORECASTS_SQL, r="mean_pit density"))
def _(spark, d):
    return S.pit_histogram(named_forecasts(spark, d), ["model"], "prob")


@query("recent_seasons", sql("""WITH s AS (SELECT event_id, ((year(start_ts)+(month(start_ts)>=7)::INT-1)*10000
      + year(start_ts)+(month(start_ts)>=7)::INT)::INT AS season FROM ev)
SELECT * FROM s WHERE season IN (SELECT DISTINCT season FROM s ORDER BY 1 DESC LIMIT 3)""", EVENTS_SQL))
def _(spark, d):
    from augury.sources.imports import recent_seasons
    ev = events(spark, d).select("event_id", season_code("start_ts").alias("season"))
    return recent_seasons(ev, 3)


@query("frozen_forecasts", sql("SELECT event_id, forecast_id, source FROM fc WHERE source = 'live'", FORECASTS_SQL))
def _(spark, d):
    rows = forecasts(spark, d).withColumn("meta", F.to_json(F.struct("source")))
    return frozen_only(rows, "meta", ["live"]).select("event_id", "forecast_id", "source")
