"""Standings, scoring rates, ensembles and model scorecards."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from augury.functions.columns import clip, clip_prob
from augury.operators.features import expand_two_sided


def orient(df: DataFrame, entity: Column, home: str = "home", prob: str = "prob", model_probs: str | None = None) -> DataFrame:
    """Turn a home-side probability, and a JSON map of them, to the given entity's side."""
    at_home = F.col(home) == entity
    out = df.withColumns({"is_home": at_home.cast("int"), "entity_prob": F.when(at_home, F.col(prob)).otherwise(1 - F.col(prob))})
    if model_probs:
        m = F.from_json(F.col(model_probs), "map<string,double>")
        out = out.withColumn("entity_model_probs", F.transform_values(m, lambda k, v: F.when(at_home, v).otherwise(1 - v)))
    return out


def standings(events: DataFrame, by: Sequence[str] = (), slots: int = 16) -> DataFrame:
    """Wins and losses with a Beta(1,1) mean, strength, and title share per group.

    The windows run over one row per entity, after the results are summed.
    """
    rows = expand_two_sided(events).where(F.col("won").isNotNull())
    s = rows.groupBy(*by, "entity").agg(F.sum("won").cast("long").alias("wins"), F.count(F.lit(1)).alias("played"))
    s = s.withColumn("losses", F.col("played") - F.col("wins"))
    s = s.withColumn("mean_rate", (F.col("wins") + 1.0) / (F.col("played") + 2.0))
    return title_share(s, by, "mean_rate", slots).withColumn("rank", F.row_number().over(
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy(F.round("title_share", 12).desc(), "entity")))


def title_share(df: DataFrame, by: Sequence[str], rate: str, slots: int) -> DataFrame:
    """Strength log(w / (1 - w)), smooth qualification around the last slot, then normalised shares."""
    w = clip(F.col(rate), 0.15, 0.85)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    x = df.withColumn("strength", F.log(w / (1 - w)))
    pos = F.row_number().over(group.orderBy(F.col("strength").desc()))
    x = x.withColumn("_pos", pos)
    last = F.min(F.when(F.col("_pos") <= slots, F.col("strength"))).over(group)
    x = x.withColumn("_raw", 1.0 / (1.0 + F.exp(-(F.col("strength") - last) / 0.30)) * F.exp(1.75 * F.col("strength")))
    return x.withColumn("title_share", F.col("_raw") / F.sum("_raw").over(group)).drop("_raw", "_pos")


def title_odds(events: DataFrame, slots: int = 16) -> DataFrame:
    """Standings with a 90 % interval of every entity's title share, without simulation.

    Given its results, the log-odds of an entity's win rate spread by sqrt(1 / (wins + 1) + 1 / (losses + 1)), the delta
    method for its Beta. The share is worked out with the entity's own strength moved by 1.645 of those and all others
    held; it rises with the strength, so the moved shares are the interval. One pass over one row per entity.
    """
    st = standings(events, [], slots)
    every = Window.partitionBy(F.lit(1))
    pos = F.row_number().over(every.orderBy(F.col("strength").desc()))
    last = F.min(F.when(F.col("_pos") <= slots, F.col("strength"))).over(every)
    raw = lambda s: 1.0 / (1.0 + F.exp(-(s - F.col("_last")) / 0.30)) * F.exp(1.75 * s)
    x = st.withColumn("_pos", pos).withColumn("_last", last).withColumn("_raw", raw(F.col("strength")))
    x = x.withColumn("_rest", F.sum("_raw").over(every) - F.col("_raw"))
    edge = math.log(0.85 / 0.15)
    moved = lambda z: clip(F.log(F.col("mean_rate") / (1 - F.col("mean_rate"))) + z * F.sqrt(1 / (F.col("wins") + 1.0) + 1 / (F.col("losses") + 1.0)), -edge, edge)
    share = lambda z: raw(moved(z)) / (F.col("_rest") + raw(moved(z)))
    return x.withColumns({"low_90": share(-1.6448536269514722), "high_90": share(1.6448536269514722)}).drop("_pos", "_last", "_raw", "_rest")


def scoring_rates(events: DataFrame, alpha: float = 5.0) -> DataFrame:
    """Shrunken attack and defence per entity relative to the average, with the average and home factor."""
    done = events.where(F.col("home_win").isNotNull())
    tot = done.agg(((F.sum("home_score") + F.sum("away_score")) / (2 * F.count(F.lit(1)))).alias("league_avg"),
                   clip(F.avg("home_score") / F.greatest(F.avg("away_score"), F.lit(1e-6)), 0.8, 1.2).alias("home_factor"))
    s = expand_two_sided(done).groupBy("entity").agg(
        F.sum("value_for").alias("_f"), F.sum("value_against").alias("_a"), F.count("value_for").alias("played"))
    s = s.crossJoin(F.broadcast(tot))  # one row
    rate = lambda c: (F.col(c) + alpha * F.col("league_avg")) / (F.col("played") + alpha) / F.greatest(F.col("league_avg"), F.lit(1e-6))
    return s.select("entity", "played", rate("_f").alias("attack"), rate("_a").alias("defence"), "league_avg", "home_factor")


def gamma_poisson_rates(events: DataFrame, prior_alpha: float = 2.0, prior_beta: float = 1.0) -> DataFrame:
    s = expand_two_sided(events.where(F.col("home_win").isNotNull())).groupBy("entity").agg(
        (F.lit(prior_alpha) + F.sum("value_for")).alias("alpha"), (F.lit(prior_beta) + F.count(F.lit(1))).alias("beta"))
    return s.withColumn("rate", F.col("alpha") / F.col("beta"))


def rate_win_prob(df: DataFrame, home_rate: str, away_rate: str, kmax: int = 60) -> DataFrame:
    """P(home > away) + P(tie) / 2 for two Poisson counts, as one fold over the counts up to ``kmax``."""
    h, a = F.col(home_rate), F.col(away_rate)
    start = F.struct(F.exp(-h).alias("ph"), F.exp(-a).alias("pa"), F.lit(0.0).alias("below"), F.lit(0.0).alias("p"))

    def step(s, k):
        return F.struct((s["ph"] * h / (k + 1)).alias("ph"), (s["pa"] * a / (k + 1)).alias("pa"), (s["below"] + s["pa"]).alias("below"),
                        (s["p"] + s["ph"] * (s["below"] + s["pa"] / 2)).alias("p"))
    ks = F.transform(F.sequence(F.lit(0), F.lit(kmax)), lambda k: k.cast("double"))
    return df.withColumn("prob", clip_prob(F.aggregate(ks, start, step, lambda s: s["p"])))


def ensemble_weights(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Softmax of minus the penalty over models; missing metrics take the models' mean."""
    one = Window.partitionBy(F.lit(1))  # one row per model
    m = lambda c: F.coalesce(F.col(c), F.avg(c).over(one))
    pen = m("log_loss") + 0.7 * m("brier") + 0.6 * m("ece") + 0.5 * F.abs(F.coalesce(F.col("calibration_beta"), F.lit(1.0)) - 1.0)
    x = metrics.withColumn("penalty", pen).withColumn("_w", F.exp(-F.col("penalty")))
    return x.select(model, "penalty", (F.col("_w") / F.sum("_w").over(one)).alias("weight"))


def blend(long: DataFrame, weights: DataFrame, event: str, model: str, prob: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Weighted blend and the spread of the models' probabilities per event.

    An event's group is its models, so exact percentiles are cheap. Weights are renormalised over the
    models the event has.
    """
    rows = long.where(~F.col(model).isin(list(exclude))) if exclude else long
    j = rows.where(F.col(prob).isNotNull()).join(weights, model)
    q = lambda x: F.percentile(prob, F.lit(x))
    return j.groupBy(event).agg(
        clip_prob(F.sum(F.col(prob) * F.col("weight")) / F.sum("weight")).alias("weighted"), F.count(F.lit(1)).alias("models"),
        F.min(prob).alias("spread_min"), q(0.5).alias("spread_median"), F.max(prob).alias("spread_max"), F.avg(prob).alias("spread_mean"),
        F.stddev_pop(prob).alias("spread_sd"), (q(0.75) - q(0.25)).alias("spread_iqr"))


def stacked_blend(df: DataFrame, stack: str, weighted: str, share: float = 0.6) -> DataFrame:
    return df.withColumn("ensemble", clip_prob(share * F.col(stack) + (1 - share) * F.col(weighted)))


def scorecard(folds: DataFrame, by: Sequence[str], start: float = 5000.0, flags: Sequence[str] = ()) -> DataFrame:
    """Means, medians and counts over folds per candidate; flags must hold in every fold."""
    avg = lambda c, n: F.avg(c).alias(n)
    return folds.groupBy(*by).agg(
        avg("ending_bankroll", "mean_ending_bankroll"), avg("net_profit", "mean_net_profit"), F.percentile("roi", F.lit(0.5)).alias("median_roi"),
        avg("roi", "mean_roi"), avg("turnover", "mean_turnover"), avg("max_drawdown_ratio", "mean_max_drawdown"),
        avg("max_drawdown_dollars", "mean_max_drawdown_dollars"), F.count_if(F.col("ending_bankroll") > start).alias("profitable_folds"),
        F.count_if(F.col("net_profit") > 0).alias("profit_winning_folds"), avg("log_loss", "mean_log_loss"), avg("brier", "mean_brier"),
        avg("ece", "mean_ece"), avg("auc", "mean_auc"), F.sum("bet_count").alias("bet_count"),
        *[F.bool_and(F.col(f) == 1).cast("int").alias(f) for f in flags])


def promotion_gates(card: DataFrame, model: str, strategy: str, baseline: str, max_drawdown: float = 750.0, min_bets: int = 30,
                    min_folds: int = 2, max_ece_delta: float = 0.01) -> DataFrame:
    """Each candidate row beside the baseline's row of the same strategy, its gates, and its rank.

    Drawdown gates use dollars, so the limits can bind.
    """
    keys = ["mean_ending_bankroll", "mean_net_profit", "median_roi", "profit_winning_folds", "mean_max_drawdown_dollars", "mean_ece"]
    base = card.where(F.col(model) == baseline).select(strategy, *[F.col(k).alias(f"_b_{k}") for k in keys])
    j = card.where(F.col(model) != baseline).join(base, strategy, "left")
    r = lambda c: F.round(c, 9)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(  # one row per candidate
        r("mean_ending_bankroll").desc(), r("mean_net_profit").desc(), r("mean_roi").desc(), F.col("profitable_folds").desc(),
        r("mean_max_drawdown").asc(), r("mean_log_loss").asc(), r("mean_brier").asc(), model, strategy))
    g = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    gates = {
        "gate_bankroll": g(F.col("mean_ending_bankroll") > F.col("_b_mean_ending_bankroll")),
        "gate_profit": g(F.col("mean_net_profit") > F.col("_b_mean_net_profit")), "gate_roi": g(F.col("median_roi") >= F.col("_b_median_roi")),
        "gate_fold_wins": g(F.col("profit_winning_folds") >= F.col("_b_profit_winning_folds")),
        "gate_drawdown": g(F.col("mean_max_drawdown_dollars") <= F.least(F.col("_b_mean_max_drawdown_dollars") + 250.0, F.lit(max_drawdown))),
        "gate_ece": g(F.col("mean_ece") <= F.col("_b_mean_ece") + max_ece_delta), "gate_bets": g(F.col("bet_count") >= min_bets),
        "gate_profitable_folds": g(F.col("profitable_folds") >= min_folds)}
    out = j.withColumns(gates).withColumn("candidate_rank", rank)
    ok = F.lit(True)
    for name in gates:
        ok = ok & (F.col(name) == 1)
    return out.withColumn("promoted", ok.cast("int")).drop(*[f"_b_{k}" for k in keys])


def next_events_odds(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Per entity its next ``n`` events: P(win all), expected wins, and the distribution of total wins.

    ``rows`` is ``entity, entity_prob`` plus the order. The distribution is a convolution over at most
    ``n`` probabilities.
    """
    from augury.operators.ordered import top_k_by
    top = top_k_by(rows, ["entity"], [F.col(o).asc() for o in order], n)
    g = top.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("rank", "entity_prob"))).alias("_e"))
    probs = F.transform("_e", lambda e: e["entity_prob"])

    def step(dist, p):
        stay = F.concat(F.transform(dist, lambda x: x * (1 - p)), F.array(F.lit(0.0)))
        move = F.concat(F.array(F.lit(0.0)), F.transform(dist, lambda x: x * p))
        return F.zip_with(stay, move, lambda a, b: a + b)
    g = g.withColumn("_p", probs).withColumn("wins_dist", F.aggregate("_p", F.array(F.lit(1.0)), step))
    return g.select("entity", F.size("_p").alias("events"), F.aggregate("_p", F.lit(1.0), lambda a, p: a * p).alias("prob_win_all"),
                    F.aggregate("_p", F.lit(0.0), lambda a, p: a + p).alias("expected_wins"), "wins_dist",
                    (1 - F.element_at("wins_dist", 1)).alias("prob_at_least_one"))
