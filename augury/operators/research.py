"""Nested research backtest: time-ordered outer folds, tuning inside each, an embargo and a holdout that nothing reads."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from augury.functions.columns import end_of_day
from augury.operators import decisions as D, logits as L
from augury.operators.features import date_folds
from augury.operators.replay import replay
from augury.operators.scoring import score_groups
from augury.operators.standings import promotion_gates, scorecard
from augury.session import cut_lineage

PER_OUTER = 100  # fold numbers: an outer fold f is f * 100, its inner folds follow


class Spec(NamedTuple):
    """Numbers of folds and lengths in days."""
    outer_folds: int = 5
    outer_valid_days: int = 60
    inner_folds: int = 3
    inner_valid_days: int = 45
    embargo_days: int = 1
    holdout_days: int = 90


class Folds(NamedTuple):
    """Rows by fold and role; of each outer fold the last day it trains on; and the rows held out."""
    rows: DataFrame
    ends: DataFrame
    outer: list[int]
    inner: list[int]
    holdout: DataFrame


def train_span(days: int, valid_days: int, embargo_days: int, asked: int) -> int | None:
    """Days to train on at least: as many as asked for, or as the calendar leaves; none where that is too few."""
    most = days - max(1, valid_days) - max(0, embargo_days) - 1
    return None if most < max(30, valid_days) else min(max(1, asked), most)


def research_folds(df: DataFrame, ts: str, label: str, spec: Spec = Spec()) -> Folds:
    """Outer folds over all days before the holdout, and inner folds over the training rows of each, in one table."""
    known = df.where(F.col(label).isNotNull() & F.col(ts).isNotNull())
    last = known.agg(F.date_sub(F.max(F.to_date(ts)), max(1, spec.holdout_days) - 1).alias("_from"))
    marked = cut_lineage(known.crossJoin(F.broadcast(last)).withColumn("_out", F.to_date(ts) >= F.col("_from")).drop("_from"))  # one row
    open_, holdout = marked.where(~F.col("_out")).drop("_out"), marked.where("_out").drop("_out")
    days = open_.agg(F.count_distinct(F.to_date(ts))).first()[0]
    span = train_span(days, spec.outer_valid_days, spec.embargo_days, max(180, 2 * spec.outer_valid_days))
    if span is None or not holdout.take(1):
        raise ValueError(f"{days} days are too few for outer folds of {spec.outer_valid_days} days and a holdout")
    bounds = ["train_end", "valid_start", "valid_end"]
    outer = cut_lineage(date_folds(open_, ts, spec.outer_folds, spec.outer_valid_days, spec.embargo_days, span).withColumn("fold", F.col("fold") * PER_OUTER))
    train = outer.where("role = 'train'")
    sizes = {r["fold"]: r["days"] for r in train.groupBy("fold").agg(F.count_distinct(F.to_date(ts)).alias("days")).collect()}  # a row per fold
    rows, inner = [outer], []
    for f in sorted(sizes):
        own = train_span(sizes[f], spec.inner_valid_days, spec.embargo_days, max(120, 2 * spec.inner_valid_days))
        if own is not None:
            part = date_folds(train.where(F.col("fold") == f).drop("fold", "role", *bounds), ts, spec.inner_folds, spec.inner_valid_days, spec.embargo_days, own)
            rows.append(part.withColumn("fold", F.col("fold") + f))
            inner += [f + k + 1 for k in range(spec.inner_folds)]
    every = cut_lineage(reduce(DataFrame.unionByName, rows))
    ends = outer.groupBy("fold", *bounds).agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "valid").alias("n_valid"))
    return Folds(every, ends, sorted(sizes), inner, holdout)


def choose_points(folds: Folds, cols: Sequence[str], label: str, points: Sequence[L.Point]) -> DataFrame:
    """Per outer fold the grid point with the best mean over its inner folds: log loss, then Brier, then accuracy."""
    inside = folds.rows.where(F.col("fold") % PER_OUTER != 0)
    fits = L.fit_points(inside.where("role = 'train'"), cols, label, {f: points for f in folds.inner})
    per = L.score_points(inside.where("role = 'valid'"), fits, label).withColumn("outer", (F.floor(F.col("fold") / PER_OUTER) * PER_OUTER).cast("int"))
    mean = per.groupBy("outer", "point", "lam", "l1").agg(*[F.avg(c).alias(c) for c in ("log_loss", "brier", "accuracy")])
    best = F.struct(F.col("log_loss").alias("a"), F.col("brier").alias("b"), (-F.col("accuracy")).alias("c"), F.col("point").alias("d"))
    return mean.groupBy("outer").agg(F.min_by(F.struct("point", "lam", "l1", "log_loss"), best).alias("_p")).select(F.col("outer").alias("fold"), "_p.point", "_p.lam", "_p.l1", F.col("_p.log_loss").alias("inner_log_loss"))


def nested_predictions(folds: Folds, candidates: Mapping[str, tuple[Sequence[str], Sequence[L.Point]]], label: str, keep: Sequence[str], threads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of every candidate (its columns and grid), long, with ``model``, ``fold``, ``prob`` and ``as_of``,
    the end of the fold's last training day; and the chosen points. Candidates are fitted at the same time over one table."""
    outer = folds.rows.where(F.col("fold") % PER_OUTER == 0)

    def one(item):
        name, (cols, points) = item
        chosen = choose_points(folds, cols, label, points).withColumn("model", F.lit(name)).collect()  # a row per outer fold
        fits = L.fit_points(outer.where("role = 'train'"), cols, label, {r["fold"]: [(r["lam"], r["l1"])] for r in chosen})
        return L.predict_points(outer.where("role = 'valid'"), fits, [*keep, label], "prob").drop("point").withColumn("model", F.lit(name)), chosen

    with ThreadPoolExecutor(threads) as pool:
        done = list(pool.map(one, candidates.items()))
    pred = reduce(DataFrame.unionByName, [p for p, _ in done]).join(F.broadcast(folds.ends.select("fold", "train_end")), "fold")  # a row per outer fold
    chosen = [r for _, rows in done for r in rows]
    points = outer.sparkSession.createDataFrame([(r["model"], r["fold"], r["point"], r["lam"], r["l1"], r["inner_log_loss"]) for r in chosen],
                                                "model string, fold int, point int, lam double, l1 double, inner_log_loss double")
    return cut_lineage(pred.withColumn("as_of", end_of_day("train_end"))), points


def research_scorecard(pred: DataFrame, prices: DataFrame, policies: DataFrame, event: str, label: str, ts: str, baseline: str, bucket: Column,
                       embargo_days: float = 0.0, team: Sequence[str] = ("home", "away")) -> DataFrame:
    """Replay of every fold's predictions under every policy, the scorecard over folds, and the promotion gates against a baseline.

    Raises if no predicted event has a price: a replay would count them all as missing.
    """
    if not pred.join(prices, event, "left_semi").take(1):
        raise ValueError("no predicted event has a price")
    metrics = score_groups(pred, ["model", "fold"], label, "prob")
    x = D.peer_means(pred.withColumn("_in", F.struct(event, "fold")), "_in", "model", "prob").drop("_in").join(prices, event)  # windows of folds may overlap
    c = D.candidates(x, "prob", "home_price", "away_price")
    c = c.withColumn("cand_team", F.when(F.col("cand_side") == "away", F.col(team[1])).otherwise(F.col(team[0]))).withColumns({"day": F.to_date(ts), "home_win": F.col(label)})
    money = replay(c, policies, ["model", "fold"], "day", event, [ts, event], bucket)
    late = pred.groupBy("model", "fold").agg((F.count_if(F.col("as_of") >= F.col(ts)) == 0).cast("int").alias("prediction_before_event"), (F.count(F.lit(1)) == F.count_distinct(event)).cast("int").alias("unique_keys"),
                                             (F.count_if(F.col(label).isNull()) == 0).cast("int").alias("no_missing_results"),
                                             (F.count_if(F.datediff(F.col(ts), F.col("as_of")) <= embargo_days) == 0).cast("int").alias("embargo_respected"))
    flags = ["prediction_before_event", "unique_keys", "no_missing_results", "embargo_respected"]
    per = money.join(metrics.select("model", "fold", "log_loss", "brier", "ece", "auc"), ["model", "fold"]).join(late, ["model", "fold"])
    card = scorecard(per, ["model", "policy"], flags=flags)
    return promotion_gates(card, "model", "policy", baseline)
