"""Leakage-free entity features: lagged windows, workload, effects, projections, travel."""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from augury.functions.draws import uniform
from augury.functions.columns import clip, days_between, haversine_miles, snap
from augury.operators.ordered import cell_of, exact_quantiles, in_buckets, row_index, running_totals, windowed


def expand_two_sided(events: DataFrame, home: str = "home", away: str = "away", home_score: str = "home_score",
                     away_score: str = "away_score", won: str = "home_win") -> DataFrame:
    """Two rows per event, one per side, from one scan."""
    keep = [c for c in events.columns if c not in (home, away, home_score, away_score, won)]

    def side(me, other, mine, theirs, flag, result):
        return F.struct(F.col(me).alias("entity"), F.col(other).alias("opponent"), F.lit(flag).alias("is_home"),
                        F.col(mine).alias("value_for"), F.col(theirs).alias("value_against"), result.alias("won"))

    rows = F.array(side(home, away, home_score, away_score, 1, F.col(won)),
                   side(away, home, away_score, home_score, 0, 1 - F.col(won)))
    return events.select(*keep, F.inline(rows))


def rollup_stats(stats: DataFrame, keys: Sequence[str], spec: Mapping[str, tuple[str, str]], order: str) -> DataFrame:
    """Per (event, entity) rollup; ``spec`` maps output to (column, max|min|sum|mean|first).

    ``first`` means the row with the least ``order``, so the result does not depend on input order.
    """
    def agg(c: str, how: str) -> Column:
        return {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[how](c) if how != "first" else F.min_by(
            c, F.when(F.col(c).isNotNull(), F.col(order)))
    return stats.groupBy(*keys).agg(*[agg(c, how).alias(out) for out, (c, how) in spec.items()])


def attach_stats(series: DataFrame, summary: DataFrame, starters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outer-join the two rollups and left-join them to the series."""
    return series.join(summary.join(starters, list(keys), "full_outer"), list(keys), "left")


def attach_dim(series: DataFrame, left: DataFrame, right: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Two per-entity dimensions, outer-joined, onto the series; gaps take defaults.

    The dimensions hold one row per entity, which grows with the data: Spark broadcasts them only
    when their size is under the configured threshold.
    """
    out = series.join(left.join(right, key, "full_outer"), key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def pair_features(series: DataFrame, event: str, values: Sequence[str], diffs: Mapping[str, str]) -> DataFrame:
    """Both sides' features in one row per event, with home-minus-away differences."""
    def of(flag: int, prefix: str):
        return [F.max(F.when(F.col("is_home") == flag, F.col(v))).alias(f"{prefix}_{v}") for v in values]
    wide = series.groupBy(event).agg(*of(1, "home"), *of(0, "away"))
    return wide.withColumns({f"diff_{out}": F.col(f"home_{v}") - F.col(f"away_{v}") for v, out in diffs.items()})


def prior_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               sizes: Sequence[int] = (5, 14), cell: Column | None = None) -> DataFrame:
    """Means over the previous ``n`` rows, current row excluded."""
    return windowed(df, keys, order, lambda w: {
        f"r{n}_{c}": F.avg(c).over(w.rowsBetween(-n, -1)) for c in cols for n in sizes}, max(sizes), cell)


def ewm_reach(alpha: float, tolerance: float = 2.0**-56) -> int:
    """Rows after which a weight of (1 - alpha)^n lies below the last bit of a double, so that it cannot change a sum."""
    return math.ceil(math.log(tolerance) / math.log(1 - alpha))


def prior_ewm(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Mapping[str, float] | Sequence[str],
              alpha: float = 0.2, nullable: bool = True, cell: Column | None = None) -> DataFrame:
    """Exponential means of the previous rows (recursive form), one column ``ewm_<c>`` each.

    Across missing values the old weight keeps decaying. Each range of a key carries the last values before it, as
    many as can still change a double.
    """
    alphas = dict(cols) if isinstance(cols, Mapping) else {c: alpha for c in cols}
    reach = max(ewm_reach(a) for a in alphas.values()) + 1
    values = {c: ewm_reach(a) + 1 for c, a in alphas.items()} if nullable else None
    return in_buckets(df, keys, order, cell, reach, lambda f, parts: _ewm_scan(f, parts, order, alphas, nullable),
                      values, index="_i").drop("_i")


def _recurred(l: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """m_j = l_j m_(j-1) + b_j for runs of rows, ``at`` the place of a row in its run: spans of 1, 2, 4 ... rows are joined."""
    l, m, step = l.copy(), b.copy(), 1
    while step < len(m):
        far = at[step:] >= step
        if not far.any():
            break
        m[step:] += np.where(far, l[step:] * m[:-step], 0.0)
        l[step:] *= np.where(far, l[:-step], 1.0)
        step *= 2
    return m


def _ewm_batch(i: np.ndarray, run: np.ndarray, x: np.ndarray, has: np.ndarray, alpha: float, held: tuple[int, float] | None) -> tuple[np.ndarray, np.ndarray, tuple[int, float] | None]:
    """Means before each row and whether there is one, over rows of keys in order. ``i`` is the place of a row in its key, ``run``
    numbers the keys from 0, ``held`` is the place and mean of the last value of key 0 before these rows. The last item is
    the same for the last key."""
    j = np.flatnonzero(has)
    none = np.zeros(len(i), bool)
    if len(j):
        first = np.concatenate([[True], run[j][1:] != run[j][:-1]])
        start = np.flatnonzero(first)
        back = np.concatenate([[0], i[j][:-1]])
        if held and run[j[0]] == 0:
            back[0], first[0] = held[0], False
        decay = (1 - alpha) ** (i[j] - back).astype(float)
        l = np.where(first, 0.0, decay / (decay + alpha))
        b = (1 - l) * x[j]
        if not first[0]:
            b[0] += l[0] * held[1]
        m = _recurred(l, b, np.arange(len(j)) - np.repeat(start, np.diff(np.append(start, len(j)))))
        last = np.cumsum(has) - has - 1  # the value before a row
        seen = (last >= 0) & (run[j[last]] == run)
        mean = np.where(seen, m[last], 0.0)
    else:
        seen, mean = none, np.zeros(len(i))
    own = (int(i[j[-1]]), float(m[-1])) if len(j) and run[j[-1]] == run[-1] else None
    if held:
        early = ~seen & (run == 0)
        seen, mean = seen | early, np.where(early, held[1], mean)
        own = own or (held if run[-1] == 0 else None)
    return mean, seen, own


def _ewm_scan(df: DataFrame, parts: list[str], order: Sequence[str], alphas: Mapping[str, float], nullable: bool) -> DataFrame:
    """Exponential means along the ranges of ``in_buckets``, whose rows lie together and in order since it counted ``_i``:
    they are read once, as Arrow batches, and a batch hands the last means on to the next one."""
    cols = list(alphas)
    names = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            new = np.zeros(n, bool)
            for p in parts:
                code = batch.column(p).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            run = np.cumsum(new)
            at = lambda r: tuple(batch.column(p)[r].as_py() for p in parts)
            if at(0) != key:
                held = {}
            i, out = batch.column("_i").to_numpy(zero_copy_only=False).astype(np.int64), []
            for c in cols:
                v = batch.column(f"_x_{c}")
                x = v.fill_null(0.0).to_numpy(zero_copy_only=False)
                has = v.is_valid().to_numpy(zero_copy_only=False) if nullable else np.ones(n, bool)
                mean, seen, held[c] = _ewm_batch(i, run, x, has, alphas[c], held.get(c))
                out.append(pa.array(mean, mask=~seen))
            key = at(n - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *out], schema=pa.schema([*[batch.schema.field(c) for c in names], *[pa.field(f"ewm_{c}", pa.float64()) for c in cols]]))
    rows = df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in cols}).sortWithinPartitions(*parts, *order)
    return rows.mapInArrow(scan, T.StructType([*df.schema.fields, *[T.StructField(f"ewm_{c}", T.DoubleType()) for c in cols]]))


def rest_gap(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], default: float = 7.0,
             short: float = 1.1, cell: Column | None = None) -> DataFrame:
    """Days since the previous event (default for the first) and a back-to-back flag."""
    def gap(w):
        return F.greatest(F.coalesce(days_between(ts, F.lag(ts).over(w)), F.lit(default)), F.lit(0.0))
    return windowed(df, keys, order, lambda w: {"rest_days": gap(w), "b2b": (gap(w) <= short).cast("int")}, 1, cell)


def prior_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column | None = None,
                name: str = "prior_count") -> DataFrame:
    """Rows of the key before this one."""
    return row_index(df, keys, order, cell_of(df, order[0]) if cell is None else cell, name)


def prior_load(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str,
               rules: Mapping[str, tuple[int, int]], cell: Column | None = None) -> DataFrame:
    """1 where at least ``m`` of the previous ``k`` rows carry the flag, per named (k, m)."""
    return windowed(df, keys, order, lambda w: {
        name: (F.coalesce(F.sum(flag).over(w.rowsBetween(-k, -1)), F.lit(0)) >= m).cast("int")
        for name, (k, m) in rules.items()}, max(k for k, _ in rules.values()), cell)


def causal_effect(df: DataFrame, group: str, order: Sequence[str], metrics: Mapping[str, str], shrink: float,
                  final: str, cell: Column) -> DataFrame:
    """Mean of earlier final rows of the group, shrunk by n / (n + shrink)."""
    done = clip(F.coalesce(F.col(final).cast("double"), F.lit(0.0)), 0, 1)
    sums = {"_n": done} | {f"_m_{o}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * done for o, c in metrics.items()}
    out = running_totals(df, [group], list(order), cell, sums, inclusive=False)
    n = F.col("_n")
    return out.withColumns({o: F.when(n > 0, F.col(f"_m_{o}") / n * (n / (n + shrink))).otherwise(0.0)
                            for o in metrics}).drop("_n", *[f"_m_{o}" for o in metrics])


def starter_load(df: DataFrame, keys: Sequence[str], order: Sequence[str], known: str, b2b: str, quality: str,
                 default_quality: float = 0.905, cell: Column | None = None) -> DataFrame:
    """Starter workload over 7 and 14 rows, lagged uncertainty, and lagged start on a back-to-back."""
    base = df.withColumns({"_k": F.col(known).cast("int"), "_q": F.coalesce(F.col(quality), F.lit(default_quality))})

    def chain(f: DataFrame, parts: list[str]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order)
        f = f.withColumns({
            "starts_last7": F.coalesce(F.sum("_k").over(w.rowsBetween(-7, -1)), F.lit(0)),
            "starts_last14": F.coalesce(F.sum("_k").over(w.rowsBetween(-14, -1)), F.lit(0)),
            "b2b_starter": F.coalesce(F.lag("_k").over(w), F.lit(0)) * F.coalesce(F.col(b2b), F.lit(0)),
            "starter_uncertain": F.coalesce(1 - F.lag("_k").over(w), F.lit(1))})
        return _ewm_scan(f, parts, order, {"_q": 0.25}, nullable=False)
    out = in_buckets(base, keys, order, cell, ewm_reach(0.25) + 1, chain, index="_i")
    return out.withColumn("starter_quality", F.coalesce("ewm__q", F.lit(default_quality))).drop("_k", "_q", "ewm__q", "_i")


def special_rates(df: DataFrame, keys: Sequence[str], order: Sequence[str], taken: str, drawn: str, made: str,
                  cell: Column | None = None, fill: str = "prior") -> DataFrame:
    """Special-situation rates and their lagged exponential means.

    ``fill='prior'`` gives first rows 0; ``fill='group'`` uses the whole group's mean, which sees the
    future and is kept for parity.
    """
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    base = df.withColumns({
        "eff": z(made) / F.when(z(drawn) == 0, 1.0).otherwise(z(drawn)),
        "discipline": z(drawn) - z(taken), "_taken": z(taken)})
    out = prior_ewm(base, keys, order, {"eff": 0.25, "discipline": 0.25, "_taken": 0.25}, nullable=False, cell=cell)
    first = F.lit(0.0)
    if fill == "group":
        out = out.join(base.groupBy(*keys).agg(F.avg("eff").alias("_mean")), list(keys))
        first = F.col("_mean")
    return out.withColumns({
        "eff_ewm": F.coalesce("ewm_eff", first), "discipline_ewm": F.coalesce("ewm_discipline", F.lit(0.0)),
        "taken_ewm": F.coalesce("ewm__taken", F.lit(0.0))}).drop(
        "_taken", "ewm_eff", "ewm_discipline", "ewm__taken", "_mean")


# Box-score weights and the projections' bounds.
OFFENCE = {"points": 1.0, "fg_made": 0.4, "fg_attempted": -0.7, "ft_attempted": -0.4, "ft_made": 0.4,
           "rebounds_offensive": 0.7, "assists": 0.7, "three_made": 0.3, "turnovers": -1.0}
DEFENCE = {"rebounds_defensive": 0.3, "steals": 1.0, "blocks": 0.7, "fouls": -0.4}
BOUNDS = {"offence": 18.0, "defence": 12.0, "overall": 24.0}


def player_projection(players: DataFrame, player: str, order: Sequence[str], cell: Column | None = None) -> DataFrame:
    """Per-36 ratings and minutes projected from earlier appearances and shrunk to the overall means."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    total = lambda weights: sum((z(c) * w for c, w in weights.items()), F.lit(0.0))
    mins = F.greatest(z("minutes"), F.lit(0.0))
    per36 = lambda raw: raw * 36.0 / F.greatest(F.col("_min"), F.lit(6.0))
    base = players.withColumn("_min", mins).withColumns({
        "_off": total(OFFENCE), "_def": total(DEFENCE),
        "_played": clip(F.coalesce(F.col("played").cast("double"), (F.col("_min") > 0).cast("double")), 0, 1),
        "_start": clip(z("starter"), 0, 1)})
    base = base.withColumn("_all", F.col("_off") + F.col("_def") + 0.08 * z("plus_minus"))
    base = base.withColumns({"offence": per36(F.col("_off")), "defence": per36(F.col("_def")),
                             "overall": per36(F.col("_all"))})
    stems = ["offence", "defence", "overall"]
    means = base.agg(*[F.avg(s).alias(f"_mean_{s}") for s in stems],
                     F.coalesce(F.avg(F.when(F.col("_min") > 0, F.col("_min"))), F.lit(18.0)).alias("_mean_min"))

    def chain(f: DataFrame, parts: list[str]) -> DataFrame:
        w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-5, -1)
        f = f.withColumns({f"r5_{c}": F.avg(c).over(w) for c in (*stems, "_min")}).withColumn("prior_count", F.col("_i"))
        return _ewm_scan(f, parts, order, {"offence": 0.25, "defence": 0.25, "overall": 0.25, "_min": 0.35, "_start": 0.3,
                                    "_played": 0.3}, nullable=False)
    out = in_buckets(base, [player], order, cell, ewm_reach(0.25) + 1, chain, index="_i").drop("_i")
    out = out.crossJoin(F.broadcast(means))  # one row
    n = F.col("prior_count").cast("double")

    def shrink(value, mean, k):
        return (value * n + mean * k) / (n + k)

    cols = {}
    for s in stems:
        mean = F.col(f"_mean_{s}")
        mix = 0.7 * F.coalesce(F.col(f"ewm_{s}"), mean) + 0.3 * F.coalesce(F.col(f"r5_{s}"), mean)
        cols[f"{s}_projection"] = clip(shrink(mix, mean, 8.0), -BOUNDS[s], BOUNDS[s])
    m = F.col("_mean_min")
    mix = (0.65 * F.coalesce("ewm__min", m) + 0.35 * F.coalesce("r5__min", m)
           + 4.0 * F.coalesce("ewm__start", F.lit(0.0)))
    cols["minutes_projection"] = clip(shrink(mix, m, 6.0), 0.0, 42.0)
    cols["projection_confidence"] = n / (n + 6.0)
    cols["played_rate"] = F.col("ewm__played")
    return out.withColumns(cols).select(*players.columns, "prior_count", *cols)


# Roster rules.
TEAM_MINUTES, ROTATION, TOP = 240.0, 12, 6
MOST_MINUTES, LEAST_MINUTES = 42.0, 0.5
# A state this old counts for LEAST_MINUTES at most, so that no roster is stronger for knowing it.
ROSTER_REACH_DAYS = 7.0 + 14.0 * math.log(MOST_MINUTES / LEAST_MINUTES)


def roster_strength(states: DataFrame, keys: Sequence[str], gap_days: str, tie: str) -> DataFrame:
    """Expected minutes of each known player at the event, best twelve, scaled to the team's minutes.

    ``states`` holds one row per (event, entity, player) with the projection columns, the days since
    the player's last event, and optionally ``status_factor``. A row without days stands for an event of which no player
    is known yet: nothing is known of its roster, and its uncertainty is whole.
    """
    gap = F.greatest(F.col(gap_days), F.lit(0.0))
    factor = F.col("status_factor") if "status_factor" in states.columns else F.lit(1.0)
    raw = (clip(F.coalesce("minutes_projection", F.lit(0.0)), 0, MOST_MINUTES)
           * clip(F.coalesce("played_rate", F.lit(0.6)), 0.1, 1.0)
           * F.when(gap <= 7, 1.0).otherwise(F.exp(-(gap - 7.0) / 14.0)) * factor)
    unknown = F.col(gap_days).isNull()  # no minutes, from which the rest follows
    rows = states.withColumns({"_m": F.when(unknown, 0.0).otherwise(raw), "_gap": gap}).where(unknown | (F.col("_m") > LEAST_MINUTES))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(snap("_m", 9).desc(), tie))
    rows = rows.withColumn("_r", rank).where(F.col("_r") <= ROTATION)
    m, known = F.col("_m"), F.sum("_m")
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(TEAM_MINUTES), known))
    w = lambda c: F.sum(F.coalesce(c, F.lit(0.0)) * m)
    sums = rows.groupBy(*keys).agg(
        known.alias("_known"), scale.alias("_scale"), F.collect_list("_m").alias("_ms"),
        w(F.col("projection_confidence")).alias("_conf"), w(F.col("overall_projection")).alias("_all"),
        w(F.col("offence_projection")).alias("_off"), w(F.col("defence_projection")).alias("_def"),
        w(1.0 - F.least(F.col("_gap"), F.lit(21.0)) / 21.0).alias("_stable"),
        F.sum(F.when(F.col("_r") <= TOP, m)).alias("_top"))
    s = F.col("_scale")
    total = F.col("_known") * s
    share = total / TEAM_MINUTES
    weight = F.greatest(total, F.lit(1.0))
    deep = F.size(F.filter("_ms", lambda x: x * s >= 8.0))
    conf = F.col("_conf") * s / weight
    return sums.select(
        *keys, (deep / 8.0 * share).alias("depth_index"), share.alias("known_share"),
        F.greatest(1.0 - share, F.lit(0.0)).alias("absence_pressure"), conf.alias("confidence"),
        (F.col("_stable") * s / weight).alias("stability"), (share * conf).alias("reliability"),
        clip(1.0 - share * conf, 0, 1).alias("uncertainty"),
        (F.col("_all") * s / TEAM_MINUTES).alias("strength_total"),
        (F.col("_off") * s / TEAM_MINUTES).alias("strength_offence"),
        (F.col("_def") * s / TEAM_MINUTES).alias("strength_defence"),
        (F.col("_top") * s / TEAM_MINUTES).alias("top6_share"))


def travel(series: DataFrame, places: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str], place: str,
           cell: Column | None = None) -> DataFrame:
    """Miles and time-zone change from the previous event's place, and a local start outside 15 to 22 h.

    ``places`` is ``place, lat, lon, utc_offset``: a lookup of places. The event's own place is used,
    over the entity's full series.
    """
    rows = series.join(places, place, "left")
    rows = windowed(rows, keys, order, lambda w: {
        "_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w), "_off": F.lag("utc_offset").over(w)}, 1, cell)
    hour = F.hour(F.col(ts)) + F.col("utc_offset")
    return rows.withColumns({
        "travel_miles": F.coalesce(haversine_miles(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), F.lit(0.0)),
        "tz_change": F.coalesce(F.col("utc_offset") - F.col("_off"), F.lit(0)),
        "start_mismatch": F.coalesce(((hour < 15) | (hour > 22)).cast("int"), F.lit(0)),
    }).drop("_lat", "_lon", "_off", "lat", "lon", "utc_offset")


def impute(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinities to NULL, then the median of ``fit_on`` (default: the rows themselves), then 0."""
    from augury.functions.columns import finite, stack_long
    src = fit_on if fit_on is not None else df
    long = stack_long(src.select(*[finite(F.col(c).cast("double")).alias(c) for c in cols]), [], list(cols))
    med = exact_quantiles(long, ["feature"], "value", [0.5])
    wide = med.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(f"_md_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(wide))  # one row of medians
    return out.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.col(f"_md_{c}"), F.lit(0.0))
                            for c in cols}).drop(*[f"_md_{c}" for c in cols])


def time_folds(df: DataFrame, order: Sequence[str], cell: Column, folds: int, min_train: int,
               at_least: int = 15) -> DataFrame:
    """Expanding folds by rows: fold f trains on the rows before its block and validates on the block.

    With too few rows for that there is one fold with a 70 % cut.
    """
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    few = F.col("_n") <= min_train + folds
    size = F.greatest(F.floor((F.col("_n") - min_train) / folds), F.lit(1))
    spans = n.select("_n", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).where(~few | (F.col("fold") == 1))
    lo = F.when(few, F.greatest(F.lit(min_train), F.floor(F.col("_n") * 0.7))).otherwise(
        min_train + (F.col("fold") - 1) * size)
    spans = spans.select("fold", lo.alias("_lo"), F.when(few, F.col("_n")).otherwise(F.least(lo + size, F.col("_n"))).alias("_hi"),
                         few.alias("_few"))
    spans = spans.where(F.col("_few") & (F.col("_hi") > F.col("_lo")) | (F.col("_hi") - F.col("_lo") >= at_least))
    x = row_index(df, [], list(order), cell, "_i").crossJoin(F.broadcast(spans))  # one row per fold
    role = F.when(F.col("_i") < F.col("_lo"), "train").when(F.col("_i") < F.col("_hi"), "valid")
    return x.withColumn("role", role).where(F.col("role").isNotNull()).drop("_i", "_lo", "_hi", "_few")


def date_folds(df: DataFrame, ts: str, folds: int, valid_days: int, embargo_days: int = 0,
               min_train_days: int | None = None) -> DataFrame:
    """Expanding folds by date: evenly spaced train ends, an embargo gap, then a validation window."""
    need = max(valid_days * 2, 90) if min_train_days is None else max(1, min_train_days)
    days = df.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("_d")).distinct()
    ends = days.crossJoin(days.agg(F.min("_d").alias("_a"), F.max("_d").alias("_z"))).where(
        (F.col("_d") >= F.date_add("_a", need - 1)) & (F.col("_d") <= F.date_sub("_z", valid_days + embargo_days)))
    one = Window.partitionBy(F.lit(1))  # one row per calendar day, not per event
    ends = ends.select("_d", (F.row_number().over(one.orderBy("_d")) - 1).alias("_i"), F.count(F.lit(1)).over(one).alias("_c"))
    want = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)),
                       lambda k: F.bround(k * (F.col("_c") - 1) / max(folds - 1, 1)).cast("int"))
    ends = ends.where((F.col("_c") <= folds) | F.array_contains(want, F.col("_i")))
    spans = ends.select(F.row_number().over(one.orderBy("_d")).alias("fold"), F.col("_d").alias("train_end"),
                        F.date_add("_d", embargo_days + 1).alias("valid_start"),
                        F.date_add("_d", embargo_days + valid_days).alias("valid_end"))
    day = F.to_date(ts)
    out = df.crossJoin(F.broadcast(spans))  # one row per fold
    role = F.when(day <= F.col("train_end"), "train").when(day.between(F.col("valid_start"), F.col("valid_end")), "valid")
    return out.withColumn("role", role).where(F.col("role").isNotNull())


def share_split(df: DataFrame, order: Sequence[str], cell: Column, shares: Mapping[str, float]) -> DataFrame:
    """Label rows in time order by cumulative shares, such as train .4, valid .3, test .3."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    rows = row_index(df, [], list(order), cell, "_i").crossJoin(F.broadcast(n))  # one row
    names, edge, role = list(shares), 0.0, None
    for name in names[:-1]:
        edge = round(edge + shares[name], 12)
        cond = F.col("_i") < F.bround(F.col("_total") * F.lit(edge))
        role = F.when(cond, name) if role is None else role.when(cond, name)
    return rows.withColumn("role", role.otherwise(names[-1])).drop("_i", "_total")


def random_split(df: DataFrame, key: str, share: float = 0.7, seed: int = 42, name: str = "train", rest: str = "test") -> DataFrame:
    """Seeded split by a hash of the key, so that it does not change with the partitioning."""
    return df.withColumn("role", F.when(uniform(seed, key) < share, name).otherwise(rest))


def thin(df: DataFrame, order: Sequence[str], cell: Column, points: int = 250, keys: Sequence[str] = ()) -> DataFrame:
    """At most ``points`` evenly spaced rows of an ordered curve, ends included. A display operator."""
    from augury.operators.ordered import _join_by
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = _join_by(row_index(df, keys, list(order), cell, "_i"), n, keys)
    last, i = F.col("_total") - 1, F.col("_i")
    # row i is kept where floor(k * last / (points - 1)) = i for some k
    k = F.ceil(i * (points - 1) / F.greatest(last, F.lit(1)))
    at = F.floor(k * last / (points - 1))
    return rows.where((F.col("_total") <= points) | (at == i)).drop("_i", "_total")
