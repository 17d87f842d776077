"""Ordered report curves: quantile bins, lift, Lorenz, ROC, operating points, weighted bins.

None of them sorts a whole group in one task. Rows with equal scores are merged first, then ranks and
cumulative sums run inside narrow score buckets.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from augury.functions.columns import Z95, brier, clip_prob, hit, log_loss
from augury.operators.ordered import _join_by, exact_quantiles, located, running_totals, value_cell
from augury.session import cut_lineage



def score_counts(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """Rows merged to (group, probability) with counts ``n`` and positives ``pos``."""
    ok = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    return ok.groupBy(*by, clip_prob(prob).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def _b(p: str = "p") -> Column:
    return value_cell(F.col(p))


def quantile_report(df: DataFrame, by: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Quantile bins with interpolated edges; equal edges merge. One row per realised bin."""
    by = list(by)
    counts = cut_lineage(score_counts(df, by, label, prob))
    distinct = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_u"), F.sum("n").alias("_total"))
    # fewer distinct values than bins means fewer bins, so the edges depend on the group
    edges = _edges(counts, distinct, by, bins)
    rows = _join_by(counts, _join_by(edges, distinct, by) if by else edges.crossJoin(distinct), by)
    at = F.size(F.filter(F.slice("_edges", F.lit(2), F.size("_edges") - 1), lambda e: e < F.col("p"))) + 1
    nb = F.size("_edges") - 1
    rows = rows.withColumn("quantile_raw", F.least(at, nb))
    out = rows.groupBy(*by, "quantile_raw", "_total").agg(
        F.sum("n").alias("n"), F.min("p").alias("min_pred"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("avg_pred"),
        F.max("p").alias("max_pred"), (F.sum("pos") / F.sum("n")).alias("actual_rate"))
    return out.select(*by, F.col("quantile_raw").alias("quantile"), "n", (F.col("n") / F.col("_total")).alias("share"),
                      "min_pred", "avg_pred", "max_pred", "actual_rate",
                      (F.col("avg_pred") - F.col("actual_rate")).alias("gap"))


def _edges(counts: DataFrame, distinct: DataFrame, by: list[str], bins: int) -> DataFrame:
    want = F.least(F.lit(bins), F.col("_u"))
    grid = distinct.select(*by, F.col("_total"), want.alias("_q"), F.explode(F.sequence(F.lit(0), want)).alias("_k"))
    grid = grid.withColumn("_pos", F.col("_k") / F.col("_q") * (F.col("_total") - 1))
    grid = grid.withColumns({"_r0": F.floor("_pos").cast("long"), "_r1": F.ceil("_pos").cast("long")})
    e = located(counts, grid, by, "p", "n", ["_r0", "_r1"])
    edge = F.col("_r0_value") + (F.col("_r1_value") - F.col("_r0_value")) * (F.col("_pos") - F.col("_r0"))
    return e.groupBy(*by).agg(F.sort_array(F.collect_set(edge)).alias("_edges"))


def quantile_summary(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summary of a quantile report: gaps, monotonicity violations, first and last bin."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # at most one row per bin
    c = curve.withColumn("_prev", F.lag("actual_rate").over(w.orderBy("quantile")))
    first = lambda x: F.min_by(x, "quantile")
    last = lambda x: F.max_by(x, "quantile")
    return c.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins_realized"), F.avg(F.abs("gap")).alias("mean_abs_gap"),
        F.max(F.abs("gap")).alias("max_abs_gap"), F.sqrt(F.avg(F.col("gap") * F.col("gap"))).alias("rmse_gap"),
        F.count_if(F.col("actual_rate") - F.col("_prev") < -1e-9).alias("monotonicity_violations"),
        first("actual_rate").alias("first_rate"), last("actual_rate").alias("last_rate"),
        (last("actual_rate") - first("actual_rate")).alias("rate_lift"))


def avp_report(curve: DataFrame) -> DataFrame:
    """Actual against predicted per quantile: the gap from the identity line."""
    return curve.select(*[c for c in curve.columns if c not in ("min_pred", "max_pred", "gap")],
                        (F.col("actual_rate") - F.col("avg_pred")).alias("identity_gap"))


def lift_report(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Predicted and actual lift over the base rate, with the top bin's ratio to the bottom one."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # at most one row per bin
    base = F.sum(F.col("n") * F.col("actual_rate")).over(w) / F.sum("n").over(w)
    c = curve.withColumn("_base", F.nullif(base, F.lit(0.0))).withColumns({
        "predicted_lift": F.col("avg_pred") / F.col("_base"), "actual_lift": F.col("actual_rate") / F.col("_base")})
    low = F.min_by("actual_lift", "quantile").over(w)
    top = F.max_by("actual_lift", "quantile").over(w)
    return c.withColumns({"top_bottom_ratio": top / F.nullif(low, F.lit(0.0)), "top_bottom_diff": top - low}).drop(
        "_base", "min_pred", "max_pred", "gap", "share")


def lorenz(df: DataFrame, by: Sequence[str], label: str, prob: str, tie: str) -> DataFrame:
    """Curve area, raw and normalised Gini, and the share of positives in the top tenth and fifth.

    Rows are ranked by falling probability, ties by ``tie``. The trapezoid sum needs only each
    positive's rank: the area is 1 - sum(rank - 1/2) / (n * positives).
    """
    by = list(by)
    ok = cut_lineage(df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(
        *by, clip_prob(prob).alias("p"), F.col(label).cast("long").alias("y"), F.col(tie).alias("_tie")))
    # Ties are cut by the tie column, so that one score with a third of the rows is several ranges.
    numeric = isinstance(ok.schema["_tie"].dataType, T.NumericType)
    cell = F.struct((-_b()).alias("p"), (F.floor(F.col("_tie") / 4096) if numeric else F.lit(0)).alias("t"))
    ranked = running_totals(ok, by, [F.col("p").desc(), F.col("_tie").asc()], cell, {"_rank": F.lit(1)})
    n = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))
    pos = _join_by(ranked.where("y = 1"), n, by)
    within = lambda share: F.count_if(F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share)))
    s = pos.groupBy(*by, "n", "positives").agg(F.sum(F.col("_rank") - 0.5).alias("_s"), within(0.1).alias("_d"), within(0.2).alias("_q"))
    area = 1.0 - F.col("_s") / (F.col("n") * F.col("positives"))
    perfect = 1.0 - F.col("positives") / F.col("n")
    raw = 2 * area - 1
    out = s.select(*by, F.col("n"), "positives", area.alias("curve_area"), raw.alias("raw_gini"), perfect.alias("perfect_raw_gini"),
                   (raw / F.nullif(perfect, F.lit(0.0))).alias("normalized_gini"),
                   (F.col("_d") / F.col("positives")).alias("top_decile_capture"), (F.col("_q") / F.col("positives")).alias("top_quintile_capture"))
    return out


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, sums: dict[str, Column],
               descending: bool = False) -> DataFrame:
    """Cumulative sums over a global or per-key order; see ``running_totals``."""
    return running_totals(df, keys, order, bucket, sums, True, descending)


def roc(df: DataFrame, by: Sequence[str], label: str, prob: str) -> DataFrame:
    """ROC points at every distinct score, highest first."""
    by = list(by)
    counts = cut_lineage(score_counts(df, by, label, prob))
    run = running_totals(counts, by, [F.col("p").desc()], _b(), {"_tp": F.col("pos"), "_fp": F.col("n") - F.col("pos")}, descending=True)
    tot = counts.groupBy(*by).agg(F.sum("pos").alias("_P"), F.sum(F.col("n") - F.col("pos")).alias("_N"))
    return _join_by(run, tot, by).select(*by, F.col("p").alias("threshold"), (F.col("_fp") / F.col("_N")).alias("fpr"),
                                         (F.col("_tp") / F.col("_P")).alias("tpr"))


def youden(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Threshold with the largest tpr - fpr per group; ties take the highest threshold."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    return curve.groupBy(*by).agg(F.max(F.struct(j.alias("j"), F.col("threshold"))).alias("_b")).select(
        *by, F.col("_b.threshold").alias("best_threshold"), F.col("_b.j").alias("best_j"))


# The reported thresholds and half widths.
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))
HALF_WIDTHS = tuple(round(0.01 * i, 2) for i in range(16))


def operating_points(df: DataFrame, by: Sequence[str], label: str, prob: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Confusion counts and rates at each threshold: one pass of conditional counts, then unpivoted."""
    p, y = clip_prob(prob), F.col(label)
    ok = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull())
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if((p >= t) & (y == 1)).alias("tp"),
                               F.count_if((p >= t) & (y == 0)).alias("fp")) for t in thresholds])
    wide = ok.groupBy(*by).agg(cells.alias("_c"), F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_P"))
    x = wide.select(*by, "_n", "_P", F.inline("_c"))
    x = x.withColumns({"fn": F.col("_P") - F.col("tp"), "tn": F.col("_n") - F.col("_P") - F.col("fp")})
    z = lambda c: F.nullif(c, F.lit(0).cast("long"))
    sens, spec = F.col("tp") / z(F.col("_P")), F.col("tn") / z(F.col("_n") - F.col("_P"))
    return x.select(*by, "threshold", "tp", "fp", "tn", "fn", sens.alias("sensitivity"), spec.alias("specificity"),
                    (1 - spec).alias("false_positive_rate"), (F.col("tp") / z(F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tn") / z(F.col("tn") + F.col("fn"))).alias("negative_predictive_value"),
                    ((F.col("tp") + F.col("tn")) / F.col("_n")).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
                    ((F.col("tp") + F.col("fp")) / F.col("_n")).alias("predicted_positive_rate"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    n = F.nullif(n, F.lit(0).cast("long"))
    ph, z2 = successes / n, Z95 * Z95
    den = 1 + z2 / n
    mid = (ph + z2 / (2 * n)) / den
    half = Z95 * F.sqrt((ph * (1 - ph) + z2 / (4 * n)) / n) / den
    return mid - half, mid + half


def tossup_sweep(df: DataFrame, by: Sequence[str], label: str, prob: str, widths: Sequence[float] = HALF_WIDTHS) -> DataFrame:
    """Abstain inside 0.5 +/- width: what the decided rows gain, and how even the abstained ones are."""
    p, y = clip_prob(prob), F.col(label)
    ok = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(
        *by, p.alias("p"), y.alias("y"), log_loss(label, prob).alias("ll"), brier(label, prob).alias("br"), hit(label, prob).alias("ok"))

    def cell(w):
        band = (F.col("p") >= 0.5 - w) & (F.col("p") <= 0.5 + w) if w > 0 else F.lit(False)
        return F.struct(F.lit(float(w)).alias("half_width"), F.count_if(band).alias("tossup_n"), F.count_if(~band).alias("decisive_n"),
                        F.avg(F.when(~band, F.col("ok"))).alias("accuracy"), F.avg(F.when(~band, F.col("br"))).alias("brier"),
                        F.avg(F.when(~band, F.col("ll"))).alias("log_loss"), F.sum(F.when(band, F.col("y"))).alias("_s"),
                        F.avg(F.when(band, F.col("p"))).alias("tossup_pred"))
    zero = F.struct(F.avg("ok").alias("a"), F.avg("br").alias("b"), F.avg("ll").alias("l"))
    wide = ok.groupBy(*by).agg(F.array(*[cell(w) for w in widths]).alias("_c"), zero.alias("_z"))
    x = wide.select(*by, "_z", F.inline("_c"))
    lo, hi = wilson(F.col("_s"), F.col("tossup_n"))
    rate = F.col("_s") / F.nullif(F.col("tossup_n"), F.lit(0).cast("long"))
    return x.select(*by, "half_width", "decisive_n", "tossup_n", (F.col("decisive_n") / (F.col("decisive_n") + F.col("tossup_n"))).alias("decisive_share"),
                    "accuracy", "brier", "log_loss", rate.alias("tossup_rate"), "tossup_pred", F.abs(rate - 0.5).alias("tossup_gap"),
                    lo.alias("ci_low"), hi.alias("ci_high"), F.coalesce((lo <= 0.5) & (hi >= 0.5), F.lit(False)).cast("int").alias("ci_contains_half"),
                    (F.col("accuracy") - F.col("_z.a")).alias("accuracy_gain"), (F.col("_z.b") - F.col("brier")).alias("brier_gain"),
                    (F.col("_z.l") - F.col("log_loss")).alias("log_loss_gain"))


def weighted_bins(df: DataFrame, axis: str, weight: str, values: Sequence[str], n: int, bucket: Column, tie: str) -> DataFrame:
    """Bins of equal total weight along an axis, with weighted means of the value columns."""
    w = F.greatest(F.col(weight), F.lit(1e-9))
    rows = df.where(F.col(axis).isNotNull() & F.col(weight).isNotNull()).withColumn("_w", w)
    run = running_totals(rows, [], [axis, tie], bucket, {"_cw": F.col("_w")})
    total = rows.agg(F.sum("_w").alias("_tw"))
    run = run.crossJoin(F.broadcast(total))  # one row
    idx = F.least(F.floor(F.round(F.col("_cw") / (F.col("_tw") / n), 9)), F.lit(n - 1)).cast("int")
    mean = lambda c: F.sum(F.col(c) * F.col("_w")) / F.sum("_w")
    return run.groupBy((idx + 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("weight"), mean(axis).alias("axis_mean"), F.min(axis).alias("axis_min"),
        F.max(axis).alias("axis_max"), *[mean(v).alias(f"{v}_mean") for v in values])
