"""Stake decisions per event and policy, the daily risk budget, and settlement."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from augury.functions.columns import clip, decimal_odds, implied_probability, snap
from augury.operators.ordered import of_crowded, range_bounds, running_totals, value_cell

# Bankrolls, rounding, and the weights of the probability adjustment.
REFERENCE_BANKROLL, START_BANKROLL, ROUND_TO = 10_000.0, 5_000.0, 5.0
MARKET_WEIGHT, PEER_WEIGHT = 0.7, 0.3
MIN_CONFIDENCE, FULL_MARGIN, MIN_AGREEMENT, MAX_DISAGREEMENT = 0.25, 0.2, 0.55, 0.2

POLICY_SCHEMA = T.StructType([
    T.StructField("policy", T.StringType()), T.StructField("allow_underdogs", T.BooleanType()),
    T.StructField("max_underdog_price", T.DoubleType()), T.StructField("min_edge", T.DoubleType()),
    T.StructField("min_ev", T.DoubleType()), T.StructField("stake_scale", T.DoubleType()),
    T.StructField("max_bet_pct", T.DoubleType()), T.StructField("max_day_pct", T.DoubleType())])

# The three default policies, the tighter variants of one league, and the guarded limits.
POLICIES = [
    ("riskAdjusted", True, None, 0.03, 0.02, 0.5, 1.25, 4.0),
    ("aggressive", True, None, 0.03, 0.02, 0.75, 1.75, 6.0),
    ("capitalPreservation", False, None, 0.03, 0.02, 0.25, 0.75, 2.5)]
TIGHT_POLICIES = [
    ("riskAdjusted", True, 300.0, 0.05, 0.05, 0.25, 0.75, 2.5),
    ("aggressive", True, 300.0, 0.05, 0.05, 0.4, 1.0, 3.0),
    ("capitalPreservation", False, None, 0.04, 0.03, 0.25, 0.75, 2.5)]


def policy_table(spark: SparkSession, tight: bool = False, guarded: bool = False) -> DataFrame:
    """The policies as a parameter table. A guarded regime bans underdogs and lowers every limit."""
    df = spark.createDataFrame(TIGHT_POLICIES if tight else POLICIES, POLICY_SCHEMA)
    if not guarded:
        return df
    safe = F.col("policy") == "capitalPreservation"
    return df.withColumns({
        "allow_underdogs": F.lit(False), "max_underdog_price": F.lit(None).cast("double"),
        "min_edge": F.greatest("min_edge", F.when(safe, 0.05).otherwise(0.06)),
        "min_ev": F.greatest("min_ev", F.when(safe, 0.035).otherwise(0.05)),
        "stake_scale": F.least("stake_scale", F.lit(0.2)), "max_bet_pct": F.least("max_bet_pct", F.lit(0.5)),
        "max_day_pct": F.least("max_day_pct", F.lit(1.5))})


def round_stake(amount: Column, half_even: bool = False) -> Column:
    """To the stake unit; below one unit is nothing. Half up by default, half to even on request."""
    units = F.bround(amount / ROUND_TO, 0) if half_even else F.floor(amount / ROUND_TO + 0.5)
    return F.when((amount > 0) & (units >= 1), units * ROUND_TO).otherwise(0.0).cast("double")


def adjusted(raw: Column, fair: Column, peer: Column) -> Column:
    """Pull a model's probability towards market and peers, by its margin and the peers' agreement."""
    ref = F.when(peer.isNull(), fair).otherwise(clip(fair * MARKET_WEIGHT + peer * PEER_WEIGHT, 0, 1))
    margin = F.abs(raw - 0.5)
    by_margin = F.when(margin >= FULL_MARGIN, 1.0).otherwise(MIN_CONFIDENCE + (1 - MIN_CONFIDENCE) * margin / FULL_MARGIN)
    by_peer = F.when(peer.isNull(), 1.0).otherwise(F.greatest(F.lit(MIN_AGREEMENT), 1.0 - F.abs(raw - peer) / MAX_DISAGREEMENT))
    weight = clip(by_margin * by_peer, MIN_CONFIDENCE, 1.0)
    return clip(ref + weight * (raw - ref), 0, 1)


def peer_means(long: DataFrame, event: str, model: str, prob: str) -> DataFrame:
    """Each model's peers' mean for the event: (sum - own) / (n - 1), NULL without peers."""
    mine = Window.partitionBy(event)  # the forecasts of one event
    own = F.coalesce(F.col(prob), F.lit(0.0))
    others = F.count(prob).over(mine) - F.col(prob).isNotNull().cast("long")
    peer = (F.sum(prob).over(mine) - own) / F.nullif(others, F.lit(0).cast("long"))
    return long.withColumn("peer", F.when(F.col(event).isNotNull(), peer))


def candidates(df: DataFrame, prob: str, home_price: str, away_price: str, peer: str = "peer") -> DataFrame:
    """The better side of each event with its adjusted probability, edge and expected value.

    Nothing here depends on a policy, so it is worked out once, before policies multiply the rows.
    """
    raw = clip(F.coalesce(F.col(prob), F.lit(0.5)), 0, 1)
    x = df.withColumns({"_ih": implied_probability(home_price), "_ia": implied_probability(away_price),
                        "_dh": decimal_odds(home_price), "_da": decimal_odds(away_price), "_raw": raw})
    fair = F.col("_ih") / (F.col("_ih") + F.col("_ia"))
    # Both sides see the same adjustment mirrored, but the clips are applied per side as stated.
    fair_away = F.col("_ia") / (F.col("_ih") + F.col("_ia"))
    x = x.withColumns({"_fh": fair, "_fa": fair_away})
    x = x.withColumns({"_ah": adjusted(F.col("_raw"), F.col("_fh"), F.col(peer)),
                       "_aa": adjusted(1 - F.col("_raw"), F.col("_fa"), 1 - F.col(peer))})
    x = x.withColumns({"_eh": snap(F.col("_ah") * F.col("_dh") - 1, 12), "_ea": snap(F.col("_aa") * F.col("_da") - 1, 12)})
    home = (F.col("_eh") > F.col("_ea")) | ((F.col("_eh") == F.col("_ea")) & (F.col("_ah") >= F.col("_aa")))
    pick = lambda h, a: F.when(home, F.col(h)).otherwise(F.col(a))
    priced = F.col("_ih").isNotNull() & F.col("_ia").isNotNull()
    out = x.withColumns({
        "priced": priced, "positive": (F.col("_eh") > 0) | (F.col("_ea") > 0),
        "cand_side": F.when(priced, F.when(home, "home").otherwise("away")), "cand_price": pick(home_price, away_price),
        "cand_prob": snap(pick("_ah", "_aa"), 12), "cand_fair": snap(pick("_fh", "_fa"), 12),
        "cand_ev": pick("_eh", "_ea"), "_dec": pick("_dh", "_da")})
    share = (F.col("cand_prob") * F.col("_dec") - 1) / (F.col("_dec") - 1)
    return out.withColumns({"cand_edge": snap(F.col("cand_prob") - F.col("cand_fair"), 12),
                            "base_share": F.when((F.col("cand_prob") > 0) & (F.col("cand_prob") < 1) & (F.col("_dec") > 1), share)}).drop(
        "_ih", "_ia", "_dh", "_da", "_raw", "_fh", "_fa", "_ah", "_aa", "_eh", "_ea", "_dec")


def decide(cands: DataFrame, policies: DataFrame, half_even: bool = False) -> DataFrame:
    """Candidates under every policy: gates, stake and reason. Policies are a small parameter table, so they are broadcast."""
    from augury.operators.temporal import with_grid
    x = with_grid(cands, F.broadcast(policies))
    dog = F.col("cand_price") > 0
    amount = REFERENCE_BANKROLL * F.least(F.col("max_bet_pct") / 100, F.greatest(F.col("stake_scale") * F.col("base_share"), F.lit(0.0)))
    stake = round_stake(snap(amount, 9), half_even)
    gate = (F.col("cand_edge") >= F.col("min_edge")) & (F.col("cand_ev") >= F.col("min_ev"))
    cap = dog & (F.col("cand_price") > F.col("max_underdog_price"))
    # Codes: no_price, fair (no edge, or a stake under one unit), no_underdogs, long_shot, and the two kinds of bet.
    code = (F.when(~F.col("priced"), "no_price").when(~F.col("positive") | ~gate, "fair").when(dog & ~F.col("allow_underdogs"), "no_underdogs")
            .when(F.coalesce(cap, F.lit(False)), "long_shot").when(F.coalesce(stake, F.lit(0.0)) <= 0, "fair").when(dog, "value_underdog").otherwise("value_favorite"))
    x = x.withColumn("reason", code)
    bet = F.col("reason").isin("value_underdog", "value_favorite")
    return x.withColumns({"stake": F.when(bet, stake).otherwise(0.0), "side": F.when(bet, F.col("cand_side")).otherwise("none"),
                          "price": F.when(bet, F.col("cand_price"))})


def cap_daily(decisions: DataFrame, keys: Sequence[str], tie: str, event: str, half_even: bool = False) -> DataFrame:
    """Spend each day's budget in order of expected value, edge, stake and name.

    Stakes before a bet add up to what is spent before it as long as the budget lasts, and once a bet is
    cut nothing is left. So the cap is ``round(min(stake, budget - stakes before))``, a running total
    over expected-value buckets, and no day has to fit in one task. Values are counted only for keys with more rows than a
    range holds, as nearly every row has a value of its own.
    """
    live = decisions.where(F.col("stake") > 0)
    cell = value_cell(F.col("cand_ev"))
    bounds = range_bounds(of_crowded(live, decisions, list(keys)), list(keys), cell, True)
    order = [F.col("cand_ev").desc(), F.col("cand_edge").desc(), F.col("stake").desc(), F.col(tie).asc(), F.col(event).asc()]
    run = running_totals(live, list(keys), order, cell, {"_before": F.col("stake")}, inclusive=False, descending=True, bounds=bounds)
    budget = REFERENCE_BANKROLL * F.col("max_day_pct") / 100
    left = budget - F.col("_before")
    capped = F.when(budget.isNull() | (budget <= 0), F.col("stake")).otherwise(
        F.when(left <= 0, 0.0).otherwise(round_stake(F.least("stake", left), half_even)))
    run = run.withColumn("_c", capped)
    reason = F.when(F.col("_c") <= 0, "day_spent").when(F.col("_c") < F.col("stake"), F.concat("reason", F.lit("+day_cap"))).otherwise(F.col("reason"))
    run = run.withColumns({"reason": reason, "side": F.when(F.col("_c") > 0, F.col("side")).otherwise("none"),
                           "price": F.when(F.col("_c") > 0, F.col("price")), "stake": F.col("_c")}).drop("_before", "_c")
    return run.unionByName(decisions.where(F.col("stake") <= 0))


def settle(bets: DataFrame, label: str = "home_win") -> DataFrame:
    """Outcome, profit and payout. A bet on an event without a result stays unsettled."""
    none = (F.col("stake") <= 0) | (F.col("side") == "none") | F.col("price").isNull()
    won = ((F.col("side") == "home") & (F.col(label) == 1)) | ((F.col("side") == "away") & (F.col(label) == 0))
    gain = F.when(F.col("price") > 0, F.col("stake") * F.col("price") / 100).otherwise(F.col("stake") * 100 / F.abs("price"))
    outcome = F.when(none, "no_bet").when(F.col(label).isNull(), "unsettled").when(won, "win").otherwise("loss")
    return bets.withColumn("outcome", outcome).withColumn(
        "profit", F.when(F.col("outcome") == "win", gain).when(F.col("outcome") == "loss", -F.col("stake")).otherwise(0.0)).withColumn(
        "payout", F.when(F.col("outcome") == "win", F.col("stake") + F.col("profit")).otherwise(0.0))
