"""Probability scores per row, group, window and slice."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from augury.functions.columns import brier, clip, clip_prob, end_of_day, hit, log_loss, micros
from augury.operators.ordered import latest_by, value_cell, windowed
from augury.session import cut_lineage



def scorable(pred: DataFrame, results: DataFrame, event: str, as_of: str, final: str, date: str, frozen: Column | None = None) -> DataFrame:
    """Predictions joined to known results, made no later than the event's end; only rows where ``frozen`` holds."""
    limit = F.coalesce(F.col(final), end_of_day(date))
    pred = pred if frozen is None else pred.where(frozen)
    return pred.join(results, event).where(F.col(as_of) <= limit)


def score_rows(df: DataFrame, label: str, prob: str) -> DataFrame:
    return df.withColumns({"log_loss": log_loss(label, prob), "brier": brier(label, prob),
                           "accuracy": hit(label, prob)})


def latest_scored(pred: DataFrame, results: DataFrame, event: str, model: str, as_of: str, final: str,
                  date: str, label: str, prob: str, tie: str, frozen: Column | None = None) -> DataFrame:
    """One scored row per event and model: the newest valid prediction among those where ``frozen`` holds."""
    rows = scorable(pred, results, event, as_of, final, date, frozen)
    rows = rows.where(F.col(label).isNotNull() & F.col(prob).isNotNull() & F.col(model).isNotNull())
    return score_rows(latest_by(rows, [event, model], [F.col(as_of), F.col(tie)]), label, prob)


def bin_of(prob: Column, bins: int = 10) -> Column:
    """Right-closed equal-width bin, 1 to ``bins``."""
    return F.ceil(clip_prob(prob) * bins).cast("int")


def reliability(df: DataFrame, by: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    p = clip_prob(prob)
    return (
        df.groupBy(*by, bin_of(F.col(prob), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(F.col(label)).alias("obs_rate"))
        .withColumn("abs_gap", F.abs(F.col("pred_mean") - F.col("obs_rate")))
    )


def ece_mce(df: DataFrame, by: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    return reliability(df, by, label, prob, bins).groupBy(*by).agg(
        (F.sum(F.col("n") * F.col("abs_gap")) / F.sum("n")).alias("ece"), F.max("abs_gap").alias("mce"))


def brier_parts(df: DataFrame, by: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty; from bin sums, so the base rate needs no second pass."""
    p, y = F.col(prob), F.col(label).cast("double")
    cells = df.groupBy(*by, F.ceil(p * bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_sp"), F.sum(y).alias("_sy"),
        F.sum((p - y) * (p - y)).alias("_sq"))
    total = F.sum("_n")
    base = F.sum("_sy") / total
    kept = (F.col("_bin") >= 1) & (F.col("_bin") <= bins)
    pk, ok = F.col("_sp") / F.col("_n"), F.col("_sy") / F.col("_n")
    in_bins = F.sum(F.when(kept, F.col("_n"))) / total
    # sum_k w_k (o_k - base)^2 expanded, so that it stays a single aggregate
    resolution = (F.sum(F.when(kept, F.col("_n") * ok * ok)) / total
                  - 2 * base * F.sum(F.when(kept, F.col("_sy"))) / total + base * base * in_bins)
    return cells.groupBy(*by).agg(
        (F.sum("_sq") / total).alias("brier"),
        (F.sum(F.when(kept, F.col("_n") * (pk - ok) * (pk - ok))) / total).alias("reliability"),
        resolution.alias("resolution"),
        (base * (1 - base)).alias("uncertainty"),
    )


def score_groups(df: DataFrame, by: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """n, log loss, Brier, accuracy, AUC, ECE and MCE per group.

    Equal probabilities merge in the map tasks. AUC ranks are counted inside narrow probability
    buckets and the buckets' totals are added afterwards, so no group is sorted in one task.
    """
    return _scores(_merged(df, by, label, prob), by, bins)


def _merged(df: DataFrame, by: Sequence[str], label: str, prob: str, *more: Column) -> DataFrame:
    """Rows merged to (group, probability): ``_p``, their number ``_n`` and positives ``_pos``."""
    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    return rows.groupBy(*by, clip_prob(prob).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"), *more)


def _scores(counts: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    by, p = list(by), F.col("_p")
    merged = counts.withColumns({"_bin": F.ceil(p * bins).cast("int"), "_b": value_cell(p), "_neg": F.col("_n") - F.col("_pos")})
    below = Window.partitionBy(*by, "_bin", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    local = merged.withColumn("_under", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    right = F.when(p >= 0.5, F.col("_pos")).otherwise(F.col("_neg"))
    cells = local.groupBy(*by, "_bin", "_b").agg(
        F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"),
        F.sum(p * F.col("_n")).alias("_sp"),
        F.sum(F.col("_pos") * (F.col("_under") + F.col("_neg") / 2)).alias("_wins"),
        F.sum(-(F.col("_pos") * F.log(p) + F.col("_neg") * F.log(1 - p))).alias("_ll"),
        F.sum(F.col("_pos") * (1 - p) * (1 - p) + F.col("_neg") * p * p).alias("_br"),
        F.sum(right).alias("_ok"))
    lower = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("_bin", "_b").rowsBetween(
        Window.unboundedPreceding, -1)
    cells = cells.withColumn("_wins", F.col("_wins") + F.col("_pos") * F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    per_bin = cells.groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in
                                               ("_n", "_pos", "_neg", "_sp", "_wins", "_ll", "_br", "_ok")])
    n = F.sum("_n")
    gap = F.abs(F.col("_sp") - F.col("_pos"))
    return per_bin.groupBy(*by).agg(
        n.alias("n"), (F.sum("_ll") / n).alias("log_loss"), (F.sum("_br") / n).alias("brier"),
        (F.sum("_ok") / n).alias("accuracy"),
        (F.sum("_wins") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0).cast("long"))).alias("auc"),
        (F.sum(gap) / n).alias("ece"), F.max(gap / F.col("_n")).alias("mce"))


def calibration_fit(df: DataFrame, by: Sequence[str], label: str, prob: str, ridge: float = 1.0) -> DataFrame:
    """Intercept and slope of a logistic fit on logit(p), ridge on the slope, for all groups at once.

    Each Newton step is one aggregate over the merged (group, p) counts, and the current parameters join back by group.
    Groups with one class get NULL.
    """
    return _calibration(cut_lineage(_merged(df, by, label, prob)), by, ridge)


STEPS, MOST_STEPS, SETTLED = 6, 48, 1e-9


def _calibration(counts: DataFrame, by: Sequence[str], ridge: float = 1.0) -> DataFrame:
    """Newton steps over counts in the checkpoint folder, until no parameter moves. Raises if some still do after
    ``MOST_STEPS``; a group whose own step grows, which separable data can bring, is stopped by the ridge."""
    by = list(by)
    data = counts.withColumn("_x", F.log(F.col("_p") / (1 - F.col("_p"))))
    fit = data.groupBy(*by).agg(F.sum("_n").alias("_N"), F.sum("_pos").alias("_P")).select(
        *by, ((F.col("_P") > 0) & (F.col("_P") < F.col("_N"))).alias("_two"), F.lit(0.0).alias("_a"), F.lit(0.0).alias("_c"), F.lit(0.0).alias("_move"))
    for step in range(1, MOST_STEPS + 1):
        joined = data.join(fit, by) if by else data.crossJoin(fit)
        mu = 1.0 / (1.0 + F.exp(-(F.col("_a") + F.col("_c") * F.col("_x"))))
        w = F.col("_n") * mu * (1 - mu)
        r = F.col("_pos") - F.col("_n") * mu
        sums = joined.where("_two").groupBy(*by, "_two", "_a", "_c").agg(
            F.sum(r).alias("_g0"), F.sum(r * F.col("_x")).alias("_g1"), F.sum(w).alias("_h0"),
            F.sum(w * F.col("_x")).alias("_h1"), F.sum(w * F.col("_x") * F.col("_x")).alias("_h2"))
        g1 = F.col("_g1") - ridge * F.col("_c")
        h2 = F.col("_h2") + ridge
        det = F.col("_h0") * h2 - F.col("_h1") * F.col("_h1")
        da, dc = (h2 * F.col("_g0") - F.col("_h1") * g1) / det, (F.col("_h0") * g1 - F.col("_h1") * F.col("_g0")) / det
        fit = sums.select(*by, "_two", (F.col("_a") + da).alias("_a"), (F.col("_c") + dc).alias("_c"), F.greatest(F.abs(da), F.abs(dc)).alias("_move"))
        if step % STEPS == 0:
            fit = cut_lineage(fit)
            move = fit.agg(F.max("_move")).first()[0]
            if move is None or move < SETTLED:
                break
    else:
        raise RuntimeError(f"calibration still moves by {move} after {MOST_STEPS} steps")
    groups = data.select(*by).distinct() if by else data.limit(1).select(F.lit(1).alias("_one"))
    found = fit.select(*by, F.col("_a").alias("calibration_alpha"), F.col("_c").alias("calibration_beta"))
    return groups.join(found, by, "left") if by else groups.join(found, F.lit(True), "left").drop("_one")


def window_rows(df: DataFrame, by: Sequence[str], date: str, days: Sequence[int]) -> DataFrame:
    """Label rows ``cumulative`` and with each trailing window, anchored at the group's last date."""
    last = df.groupBy(*by).agg(F.max(date).alias("_last"))
    age = F.datediff(F.col("_last"), F.col(date))
    labels = F.array(F.lit("cumulative"), *[F.when(age <= d, F.lit(f"{d}d")) for d in days])
    return df.join(last, list(by)).withColumn("window", F.explode(F.array_compact(labels))).drop("_last")


def performance(df: DataFrame, by: Sequence[str], date: str, label: str, prob: str,
                days: Sequence[int] = (7, 30, 60, 90), fit: bool = True) -> DataFrame:
    """Cumulative and trailing-window score bundle per group, all from the rows merged by day and probability."""
    keys = [*by, "window"]
    days_of = cut_lineage(_merged(df, [*by, date], label, prob))
    counts = window_rows(days_of, by, date, days).groupBy(*keys, "_p").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"), F.min(date).alias("_from"), F.max(date).alias("_to"))
    counts = cut_lineage(counts)
    out = _scores(counts, keys, 10).join(counts.groupBy(*keys).agg(F.min("_from").alias("start_date"), F.max("_to").alias("end_date")), keys)
    return out.join(_calibration(counts, keys), keys) if fit else out


def mean_by_date(df: DataFrame, by: Sequence[str], date: str, label: str, prob: str) -> DataFrame:
    """Average prediction against outcome per date."""
    ok = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull() & F.col(date).isNotNull())
    return ok.groupBy(*by, date).agg(F.avg(prob).alias("avg_pred"), F.avg(label).alias("avg_obs")).withColumn(
        "gap", F.col("avg_pred") - F.col("avg_obs"))


def slice_metrics(df: DataFrame, slices: dict[str, Column], label: str, prob: str, at_least: int = 8) -> DataFrame:
    """Score bundle per value of each bucket column, dropping small slices."""
    pairs = F.array(*[F.struct(F.lit(k).alias("slice_col"), v.cast("string").alias("slice_val"))
                      for k, v in slices.items()])
    rows = df.select(F.col(label), F.col(prob), F.explode(pairs).alias("_s")).select(label, prob, "_s.*")
    out = score_groups(rows.where(F.col("slice_val").isNotNull()), ["slice_col", "slice_val"], label, prob)
    return out.where(F.col("n") >= at_least).drop("ece", "mce")


def leaderboard(scores: DataFrame, event: str, model: str, date: str, scored_at: str, tie: str, days: int,
                today: Column | None = None) -> DataFrame:
    """Mean scores per model over the last days, using the newest score of each event and model."""
    if today is None:
        last = scores.agg(F.max(date).alias("_today"))
        recent = scores.crossJoin(F.broadcast(last))  # one row
        recent = recent.where(F.col(date) >= F.date_sub(F.to_date("_today"), days)).drop("_today")
    else:
        recent = scores.where(F.col(date) >= F.date_sub(today, days))
    newest = latest_by(recent, [event, model], [F.col(scored_at), F.col(tie)])
    return newest.groupBy(model).agg(
        F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("accuracy").alias("accuracy"),
        F.count(F.lit(1)).alias("n")).orderBy("log_loss", model)


def daily_scores(scores: DataFrame, model: str, date: str) -> DataFrame:
    return scores.groupBy(model, date).agg(F.avg("log_loss").alias("log_loss"))


def run_summaries(scores: DataFrame, runs: DataFrame, model: str, run: str, sort_ts: str, date: str,
                  event: str, tie: str, created: str) -> DataFrame:
    """Per run: counts, means, first and last event, rank of the run among the model's runs."""
    order = F.struct(F.col(sort_ts), F.col(event), F.col(tie))
    sums = scores.groupBy(model, run).agg(
        F.count(F.lit(1)).alias("n"), F.avg("log_loss").alias("avg_log_loss"), F.avg("brier").alias("avg_brier"),
        F.avg("accuracy").alias("accuracy"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.min_by(event, order).alias("first_event"), F.max_by(event, order).alias("last_event"))
    out = sums.join(runs.select(run, created), run, "left")
    newest = F.coalesce(F.col(created), end_of_day("last_date"))
    rank = F.row_number().over(Window.partitionBy(model).orderBy(newest.desc(), F.col(run).desc()))
    return out.withColumn("version_rank", rank).withColumn("is_latest", (F.col("version_rank") == 1).cast("int"))


def backtest_metrics(wide: DataFrame, models: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Score bundle per model from one column per model."""
    long = wide.select(*by, label, *models).unpivot([*by, label], list(models), "model", "prob")
    return score_groups(long, [*by, "model"], label, "prob").join(
        calibration_fit(long, [*by, "model"], label, "prob"), [*by, "model"])


def integrity_checks(pred: DataFrame, results: DataFrame, event: str, model: str, as_of: str, date: str,
                     now: Column, embargo_days: float = 0.0) -> DataFrame:
    """One row of counts and flags: late predictions, repeated keys, missing results, embargo breaches.

    The embargo is measured in days before the event, as asked for.
    """
    keys = pred.groupBy(event, model, as_of).agg(F.count(F.lit(1)).alias("_c"), F.max(date).alias("_d"))
    known = results.select(event).distinct().withColumn("_has", F.lit(1))
    j = keys.join(known, event, "left")
    gap = (micros("_d") - micros(as_of)) / 86400e6
    n = lambda cond: F.sum(F.when(cond, F.col("_c")).otherwise(0))
    out = j.agg(
        n(F.col(as_of) > F.col("_d")).alias("late"),
        F.sum((F.col("_c") > 1).cast("long")).alias("repeated_keys"),
        n(F.col("_has").isNull() & (F.col("_d") <= now)).alias("missing_results"),
        n(gap < embargo_days - 0.01).alias("embargo_breaches"))
    return out.withColumns({
        "prediction_before_event": (F.col("late") == 0).cast("int"),
        "unique_keys": (F.col("repeated_keys") == 0).cast("int"),
        "no_missing_results": (F.col("missing_results") == 0).cast("int"),
        "embargo_respected": (F.col("embargo_breaches") == 0).cast("int")})


def missing_results(pred: DataFrame, results: DataFrame, event: str) -> DataFrame:
    return pred.join(results.select(event), event, "left_anti")


WINDOW_SCORES = ("auc", "ece", "mce", "calibration_alpha", "calibration_beta")


def _window_scores(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    """Ranks, bins and the calibration fit of every row's points ``_pts``, as matrices of a row's points side by side."""
    for batch in batches:
        points = batch.column("_pts")
        size, flat = points.value_lengths().to_numpy(), points.flatten()
        here = np.arange(size.max(initial=1)) < size[:, None]
        p, y = np.full(here.shape, 2.0), np.zeros(here.shape)  # what is missing sorts last
        p[here], y[here] = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("_p", "_y"))
        order = np.argsort(p, axis=1, kind="stable")
        p, y = np.take_along_axis(p, order, 1), np.take_along_axis(y, order, 1)
        pos = y.sum(axis=1)
        upto = np.cumsum(np.where(here, 1 - y, 0.0), axis=1)
        place, step = np.broadcast_to(np.arange(here.shape[1]), here.shape), p[:, 1:] != p[:, :-1]
        edge = np.ones((len(p), 1), bool)
        first = np.maximum.accumulate(np.where(np.hstack([edge, step]), place, 0), axis=1)  # of equal probabilities
        last = np.minimum.accumulate(np.where(np.hstack([step, edge]), place, here.shape[1])[:, ::-1], axis=1)[:, ::-1]
        under = np.take_along_axis(np.hstack([np.zeros((len(p), 1)), upto]), first, 1)
        wins = (y * (under + np.take_along_axis(upto, last, 1)) / 2).sum(axis=1)
        gaps, worst = np.zeros(len(p)), np.zeros(len(p))
        at = np.ceil(p * bins)
        for b in range(1, bins + 1):
            own = here & (at == b)
            gap, n = np.abs(np.where(own, p - y, 0.0).sum(axis=1)), own.sum(axis=1)
            gaps, worst = gaps + gap, np.maximum(worst, gap / np.maximum(n, 1))
        x = np.log(np.where(here, p / np.where(here, 1 - p, 1.0), 1.0))
        alpha, beta = np.zeros(len(p)), np.zeros(len(p))
        with np.errstate(all="ignore"):
            for _ in range(7):  # Newton steps
                mu = 1.0 / (1.0 + np.exp(-(alpha[:, None] + beta[:, None] * x)))
                w, r = np.where(here, mu * (1 - mu), 0.0), np.where(here, y - mu, 0.0)
                g0, g1 = r.sum(axis=1), (r * x).sum(axis=1) - beta
                h0, h1, h2 = w.sum(axis=1), (w * x).sum(axis=1), (w * x * x).sum(axis=1) + 1.0
                det = h0 * h2 - h1 * h1
                alpha, beta = alpha + (h2 * g0 - h1 * g1) / det, beta + (h0 * g1 - h1 * g0) / det
            two = (pos > 0) & (pos < size)
            made = [np.where(two, wins / (pos * (size - pos)), np.nan), gaps / size, worst, np.where(two, alpha, np.nan), np.where(two, beta, np.nan)]
        kept = [c for c in batch.schema.names if c != "_pts"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(v, mask=np.isnan(v)) for v in made]], [*kept, *WINDOW_SCORES])


def drift(df: DataFrame, by: Sequence[str], order: Sequence[str], label: str, prob: str,
          windows: Sequence[int] = (30, 60), at_least: int = 8, bins: int = 10, cell: Column | None = None) -> DataFrame:
    """Score bundle and calibration fit over the last ``w`` rows, at every row, for each window length.

    The bounded frame is gathered as an array in the row's own partition, so the rows are not
    multiplied by a self-join; the arrays of a batch are scored as matrices.
    """
    base = df.withColumns({"_p": clip_prob(prob), "_y": F.col(label).cast("int")})
    base = base.withColumns({"_ll": log_loss("_y", "_p"), "_br": brier("_y", "_p"), "_ok": hit("_y", "_p")})

    def build(w):
        cols = {}
        for k in windows:
            frame = w.rowsBetween(-(k - 1), 0)
            cols[f"_w{k}"] = F.struct(
                F.lit(k).alias("window_rows"), F.count(F.lit(1)).over(frame).alias("n"),
                F.avg("_ll").over(frame).alias("log_loss"), F.avg("_br").over(frame).alias("brier"),
                F.avg("_ok").over(frame).alias("accuracy"),
                F.collect_list(F.struct("_p", "_y")).over(frame).alias("_pts"))
        return cols

    wide = windowed(base, list(by), list(order), build, max(windows), cell)
    long = wide.select(*by, *order, F.explode(F.array(*[F.col(f"_w{k}") for k in windows])).alias("_w")).select(
        *by, *order, "_w.*").where(F.col("n") >= at_least)
    kept = [c for c in long.columns if c != "_pts"]
    schema = T.StructType([*[long.schema[c] for c in kept], *[T.StructField(c, T.DoubleType()) for c in WINDOW_SCORES]])
    return long.mapInArrow(partial(_window_scores, bins=bins), schema)


def pit_histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Histogram of probability-integral-transform values with each bin's density."""
    b = F.least(F.floor(clip(F.col(value), 0, 1) * bins), F.lit(bins - 1)).cast("int")
    out = df.where(F.col(value).isNotNull()).groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_pit"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return out.withColumn("density", F.col("n") * bins / total)
