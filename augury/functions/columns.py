"""Column expressions shared by the operators. All of them stay inside whole-stage codegen."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Probability clip and the Wilson interval's normal quantile.
EPS = 1e-6
Z95 = 1.959963984540054


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(col(ts).cast("timestamp"))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / 86400e6


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo)))


def clip_prob(p: Column | str) -> Column:
    return clip(col(p), EPS, 1 - EPS)


def logit(p: Column | str) -> Column:
    q = clip_prob(p)
    return F.log(q / (1 - q))


def snap(x: Column | str, digits: int) -> Column:
    """Round a double without going through decimals. Makes values that differ only in the last bits
    equal before they are compared or ranked."""
    scale = float(10 ** digits)
    return F.rint(col(x) * scale) / scale


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def log_loss(label: Column | str, prob: Column | str) -> Column:
    q, y = clip_prob(prob), col(label)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def brier(label: Column | str, prob: Column | str) -> Column:
    d = clip_prob(prob) - col(label)
    return d * d


def hit(label: Column | str, prob: Column | str) -> Column:
    return ((clip_prob(prob) >= 0.5).cast("int") == col(label)).cast("int")


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities, so that NULL is the only missing value."""
    x = col(c)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is 0."""
    return num / F.nullif(den, F.lit(0.0))


def implied_probability(american: Column | str) -> Column:
    o = col(american)
    return F.when(o > 0, 100.0 / (o + 100.0)).when(o < 0, -o / (-o + 100.0))


def decimal_odds(american: Column | str) -> Column:
    o = col(american)
    return F.when(o > 0, 1.0 + o / 100.0).when(o < 0, 1.0 + 100.0 / -o)


def price_terms(df: DataFrame, home: str, away: str) -> DataFrame:
    """Implied probability, decimal price and the two-sided fair probability of a priced pair."""
    hi, ai = implied_probability(home), implied_probability(away)
    return (
        df.withColumns({"home_implied": hi, "away_implied": ai,
                        "home_decimal": decimal_odds(home), "away_decimal": decimal_odds(away)})
        .withColumns({"fair_home": F.col("home_implied") / (F.col("home_implied") + F.col("away_implied")),
                      "overround": F.col("home_implied") + F.col("away_implied")})
        .withColumn("fair_away", 1.0 - F.col("fair_home"))
    )


def effective_as_of(imported: Column, commence: Column | str, updated: Column | str,
                    snapshot: Column | str) -> Column:
    """Imported bundles count as known at the start of the event; live rows when the book updated."""
    return F.when(imported, col(commence)).otherwise(F.coalesce(col(updated), col(snapshot)))


def frozen_only(df: DataFrame, meta: str, sources: list[str]) -> DataFrame:
    """Rows whose JSON metadata names one of the frozen sources; a row without source is not frozen."""
    return df.where(F.get_json_object(F.col(meta), "$.source").isin(sources))


def local_day(ts: Column | str, tz: str = "America/Chicago") -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), tz))


def day_key(start: Column, final: Column, date: Column, tz: str = "America/Chicago") -> Column:
    """Local calendar day from the start, else the final time, else the date itself."""
    return F.coalesce(local_day(start, tz), local_day(final, tz), F.to_date(date))


def monday_of(day: Column | str) -> Column:
    return F.to_date(F.date_trunc("week", col(day)))


def end_of_day(date: Column | str) -> Column:
    return F.to_timestamp(F.concat(F.date_format(col(date), "yyyy-MM-dd"), F.lit(" 23:59:59")))


def season_code(ts: Column | str) -> Column:
    """Eight-digit season such as 20242025; a season starts in July."""
    last = F.year(col(ts)) + (F.month(col(ts)) >= 7).cast("int")
    return (last - 1) * 10000 + last


def canonical_name(name: Column | str, aliases: dict[str, str]) -> Column:
    """Lower-cased, trimmed name with aliases resolved; blank becomes NULL."""
    token = F.lower(F.trim(col(name)))
    out = F.when(token == "", F.lit(None).cast("string"))
    for alias, target in sorted(aliases.items()):
        out = out.when(token == alias, F.lit(target))
    return out.otherwise(token)


def hinges(df: DataFrame, knots: dict[str, float], cubic: bool = False, zero_flag: bool = False) -> DataFrame:
    """One-sided hinge columns at fixed knots, with optional cubes and is-zero flags."""
    cols: dict[str, Column] = {}
    for name, knot in knots.items():
        h = F.greatest(F.col(name) - float(knot), F.lit(0.0))
        cols[f"{name}_hinge"] = h
        if cubic:
            cols[f"{name}_cubic"] = F.pow(h, F.lit(3.0))
        if zero_flag:
            cols[f"{name}_is_zero"] = (F.col(name) == 0).cast("double")
    return df.withColumns(cols)


def season_phase(df: DataFrame, ts: str, start: Column, cuts: tuple[int, int] = (45, 120),
                 flag_month: int = 3) -> DataFrame:
    """Days since the season start, its root, three phase flags and one month flag.

    ``start`` is a column that already holds the season's first day, so no window is needed here.
    """
    d = F.greatest(F.datediff(F.col(ts), start), F.lit(0))
    lo, hi = cuts
    return df.withColumns({
        "days_in": d,
        "days_in_root": F.sqrt(d.cast("double")),
        "phase_early": (d <= lo).cast("int"),
        "phase_mid": ((d > lo) & (d <= hi)).cast("int"),
        "phase_late": (d > hi).cast("int"),
        "after_flag_month": (F.month(F.col(ts)) >= flag_month).cast("int"),
    })


def proxy_fill(df: DataFrame, rules: dict[str, Column], used: str = "proxy_used") -> DataFrame:
    """Fill missing stats from proxies and note in ``used`` whether any proxy was needed."""
    flag = None
    for name in rules:
        flag = F.col(name).isNull() if flag is None else flag | F.col(name).isNull()
    out = df.withColumn(used, flag.cast("int"))
    return out.withColumns({name: F.coalesce(F.col(name), expr) for name, expr in rules.items()})


# Share of normal minutes expected under each reported status.
STATUS_WEIGHTS = [
    ("out", 0.0), ("suspend", 0.0), ("doubt", 0.15), ("question", 0.45),
    ("day-to-day", 0.65), ("day to day", 0.65), ("probable", 0.9),
]


def status_weight(status: Column | str) -> Column:
    token = F.lower(F.trim(F.coalesce(col(status), F.lit(""))))
    out = None
    for word, weight in STATUS_WEIGHTS:
        cond = token.contains(word)
        out = F.when(cond, F.lit(weight)) if out is None else out.when(cond, F.lit(weight))
    return out.otherwise(F.lit(1.0))


def flags_json(flags: dict[str, Column]) -> Column:
    """Named boolean flags as one JSON text, keys in name order."""
    return F.to_json(F.struct(*[F.coalesce(flags[k], F.lit(True)).alias(k) for k in sorted(flags)]))


def share_targets(df: DataFrame, for_: str, against: str, drawn: str, taken: str) -> DataFrame:
    """Volume share, discipline difference and pace of an entity's row."""
    f, a = F.coalesce(F.col(for_), F.lit(0.0)), F.coalesce(F.col(against), F.lit(0.0))
    total = F.when(f + a == 0, F.lit(1.0)).otherwise(f + a)
    return df.withColumns({
        "volume_share": f / total,
        "discipline_diff": F.coalesce(F.col(drawn), F.lit(0.0)) - F.coalesce(F.col(taken), F.lit(0.0)),
        "pace": total,
    })


EARTH_RADIUS_MILES = 3958.7613


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s1 = F.sin((p2 - p1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    return 2 * EARTH_RADIUS_MILES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def stack_long(df: DataFrame, ids: list[str], values: list[str], name: str = "feature",
               value: str = "value") -> DataFrame:
    """Wide to long over same-typed numeric columns."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, name, value)
