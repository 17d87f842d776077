"""Queries on bent features, with the splines and fits said in SQL as well."""
from __future__ import annotations

import numpy as np

from augury.operators import shapes as S
from augury.plans.feature_queries import recursive
from augury.plans.model_queries import COLS, FR_SQL, LABEL, split
from augury.plans.registry import query, sql
from augury.plans.twins import newton_sql

PROBS = ", ".join(repr(float(p)) for p in np.linspace(0.05, 0.95, S.GRID))
OTHERS = [f"o{i}" for i in range(1, len(COLS))]


def _others(of: str, read) -> str:
    return ", ".join(f"{read(c)} AS o{i + 1}" for i, c in enumerate(c for c in COLS if c != of))


def _median(c: str) -> str:
    return f"(SELECT med FROM st WHERE feature = '{c}')"


def _rows_sql() -> str:
    """Rows of both roles and of the grid, per feature that is looked at, and its value."""
    data = " UNION ALL ".join(f"SELECT '{c}' AS feature, role, event_id AS id, {LABEL} AS y, {_others(c, lambda o: o)}, {c} AS x FROM ro" for c in COLS)
    grid = " UNION ALL ".join(f"SELECT '{c}', 'grid', rn, NULL, {_others(c, _median)}, v FROM gr WHERE feature = '{c}'" for c in COLS)
    return f"{data} UNION ALL {grid}"


def _spline_sql(name: str, degree: int) -> str:
    """CTEs up to ``name``: spline columns c1... of every row, scaled by the training rows, as ``shapes.spline_columns`` makes them."""
    last = S.KNOTS + degree - 2
    pieces = S.KNOTS + 2 * degree - 1
    low = ", ".join(f"k[1] - (k[2] - k[1]) * {j}" for j in range(degree, 0, -1))
    high = ", ".join(f"k[-1] + (k[-1] - k[-2]) * {j}" for j in range(1, degree + 1))
    out = [f"{name}_t AS (SELECT b.*, k, list_concat(list_concat([{low}], k), [{high}]) AS t, greatest(k[1], least(k[-1], x)) AS held FROM bx b JOIN ok USING (feature))",
           f"{name}_0 AS (SELECT *, " + ", ".join(f"coalesce((CASE WHEN held = k[-1] THEN {i} = len(k) + {degree - 1} ELSE held >= t[{i}] AND held < t[{i + 1}] END)::INT, 0)::DOUBLE AS p{i}" for i in range(1, pieces + 1)) + f" FROM {name}_t)"]
    for d in range(1, degree + 1):
        n = pieces - d
        rise = [f"coalesce((held - t[{i}]) / (t[{i + d}] - t[{i}]) * p{i} + (t[{i + d + 1}] - held) / (t[{i + d + 1}] - t[{i + 1}]) * p{i + 1}, 0) AS p{i}" for i in range(1, n + 1)]
        slope = [f"{d} * coalesce(p{i} / (t[{i + d}] - t[{i}]) - p{i + 1} / (t[{i + d + 1}] - t[{i + 1}]), 0) AS q{i}" for i in range(1, n + 1)] if d == degree else []
        out.append(f"{name}_{d} AS (SELECT feature, role, id, y, {', '.join(OTHERS)}, x, k, t, held, {', '.join(rise + slope)} FROM {name}_{d - 1})")
    cols = [*OTHERS, *[f"c{i}" for i in range(1, last + 1)]]
    made = ", ".join(f"CASE WHEN {i} < len(k) + {degree - 1} THEN p{i} + q{i} * (x - held) ELSE 0.0::DOUBLE END AS c{i}" for i in range(1, last + 1))
    out.append(f"{name}_c AS (SELECT feature, role, id, y, {', '.join(OTHERS)}, {made} FROM {name}_{degree})")
    return ",\n".join(out) + ",\n" + _scaled_sql(name, cols)


def _scaled_sql(name: str, cols) -> str:
    m = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(f"CASE WHEN s_{c} > 1e-7 THEN ({c} - a_{c}) / s_{c} ELSE 0.0::DOUBLE END AS {c}" for c in cols)
    return (f"{name}_m AS (SELECT feature, {m} FROM {name}_c WHERE role = 'train' GROUP BY feature), {name} AS (SELECT feature, role, id, y, {z} FROM {name}_c JOIN {name}_m USING (feature)),\n"
            f"{name}_l AS (SELECT feature, y, {', '.join(cols)} FROM {name} WHERE role = 'train'),\n"
            + newton_sql(f"{name}_n", f"{name}_l", cols, "y", ["feature"], "1.0") + ",\n"
            + f"{name}_p AS (SELECT z.feature, role, id, y, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, 1.0::DOUBLE / (1.0 + exp(-(b[1] + {' + '.join(f'b[{i + 2}] * {c}' for i, c in enumerate(cols))}))))) AS p FROM {name} z JOIN {name}_n n ON n.feature = z.feature AND step = 12)")


SHAPE_SQL = (*FR_SQL, f"""go AS (SELECT *, row_number() OVER (ORDER BY start_ts, event_id) - 1 AS i, count(*) OVER () AS n FROM fe),
ro AS (SELECT event_id, {LABEL}, {', '.join(COLS)}, CASE WHEN i < round_even(n*0.7::DOUBLE, 0) THEN 'train' ELSE 'hold' END AS role FROM go),
un AS (FROM (SELECT {', '.join(f'{c}::DOUBLE AS {c}' for c in COLS)} FROM ro WHERE role = 'train') UNPIVOT (v FOR feature IN ({', '.join(COLS)}))),
st AS (SELECT feature, count(*) AS n, count(DISTINCT v) AS u, quantile_cont(v, 0.5) AS med, list_sort(list_distinct(quantile_cont(v, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS k,
  CASE WHEN count(DISTINCT v) <= {S.GRID} THEN list_sort(list(DISTINCT v)) ELSE list_sort(list_distinct(quantile_cont(v, [{PROBS}]))) END AS grid FROM un GROUP BY feature),
ok AS (SELECT feature, k FROM st WHERE n >= {S.MIN_ROWS} AND u >= {S.MIN_UNIQUE} AND len(k) >= 2),
gr AS (SELECT feature, unnest(grid) AS v, generate_subscripts(grid, 1) AS rn FROM st JOIN ok USING (feature)),
bx AS ({_rows_sql()}),
line_c AS (SELECT feature, role, id, y, {', '.join(OTHERS)}, x FROM bx JOIN ok USING (feature))""",
    _scaled_sql("line", [*OTHERS, "x"]), _spline_sql("smooth", S.SMOOTH), _spline_sql("hinge", S.HINGE),
    """al AS (SELECT 'line' AS fit, * FROM line_p UNION ALL SELECT 'smooth', * FROM smooth_p UNION ALL SELECT 'hinge', * FROM hinge_p),
cv AS (SELECT feature, id AS grid_rank, any_value(v) AS grid_value, max(p) FILTER (WHERE fit = 'line') AS linear_prob, max(p) FILTER (WHERE fit = 'smooth') AS smooth_prob, max(p) FILTER (WHERE fit = 'hinge') AS hinge_prob
  FROM al JOIN (SELECT feature, rn AS id, v FROM gr) USING (feature, id) WHERE role = 'grid' GROUP BY ALL)""")

VERDICT_SQL = f"""WITH sc AS (SELECT feature, fit, role, avg(-(y*ln(p) + (1-y)*ln(1-p))) AS ll, avg((p-y)*(p-y)) AS br FROM al WHERE role <> 'grid' GROUP BY ALL),
    gn AS (SELECT b.feature, b.fit, max(l.ll - b.ll) FILTER (WHERE b.role = 'hold') AS gain, max(l.br - b.br) FILTER (WHERE b.role = 'hold') AS brier, max(l.ll - b.ll) FILTER (WHERE b.role = 'train') AS train
      FROM sc b JOIN sc l ON l.fit = 'line' AND l.feature = b.feature AND l.role = b.role WHERE b.fit <> 'line' GROUP BY ALL),
    lo AS (FROM (SELECT feature, grid_rank, linear_prob, smooth_prob AS smooth, hinge_prob AS hinge FROM cv) UNPIVOT (p FOR fit IN (smooth, hinge))),
    gp AS (SELECT feature, fit, max(abs(p - linear_prob)) AS gap FROM lo GROUP BY ALL),
    sp AS (SELECT feature, fit, grid_rank, p - lag(p) OVER (PARTITION BY feature, fit ORDER BY grid_rank) AS s FROM lo),
    tu AS (SELECT feature, fit, count(*) FILTER (WHERE sign(s) <> z)::INT AS turns FROM (SELECT *, lag(sign(s)) OVER (PARTITION BY feature, fit ORDER BY grid_rank) AS z FROM sp WHERE abs(s) > {S.FLAT_STEP!r}) q GROUP BY ALL),
    ft AS (SELECT feature, fit, gain, brier, train, gap, coalesce(turns, 0) AS turns FROM gn JOIN gp USING (feature, fit) LEFT JOIN tu USING (feature, fit)),
    two AS (SELECT s.feature, s.gain AS smooth_gain, h.gain AS hinge_gain, s.brier AS smooth_brier_gain, h.brier AS hinge_brier_gain, s.gap AS smooth_gap, h.gap AS hinge_gap,
      CASE WHEN h.gain > s.gain + {S.NEAR_GAIN!r} OR (abs(h.gain - s.gain) <= {S.NEAR_GAIN!r} AND h.gap > s.gap) THEN 'hinge' ELSE 'smooth' END AS fit FROM ft s JOIN ft h ON h.feature = s.feature AND h.fit = 'hinge' WHERE s.fit = 'smooth'),
    ve AS (SELECT two.*, ft.gain, ft.brier, ft.train, ft.gap, ft.turns, CASE WHEN train <= 0 THEN 'weak' WHEN gain >= {S.GAIN_STRONG} THEN 'strong' WHEN gain >= {S.GAIN_MODERATE} OR (gain > 0 AND gap >= {S.GAP_STRONG}) THEN 'moderate' ELSE 'weak' END AS verdict FROM two JOIN ft USING (feature, fit)),
    wh AS (SELECT st.feature, coalesce(verdict, 'skip') AS status, CASE WHEN n < {S.MIN_ROWS} THEN 'too_few_non_missing_rows' WHEN u < {S.MIN_UNIQUE} THEN 'too_few_unique_values' WHEN len(k) < 2 THEN 'too_few_knots' ELSE '' END AS skip_reason,
      u AS n_unique, n AS n_non_missing, verdict IN ('strong', 'moderate') IS TRUE AS says, ve.* EXCLUDE (feature) FROM st LEFT JOIN ve USING (feature)),
    fl AS (SELECT feature, status, CASE WHEN says THEN fit ELSE 'linear' END AS best_shape, CASE WHEN NOT says THEN 'keep_linear' WHEN fit = 'hinge' THEN 'mars' ELSE 'gam' END AS family_hint,
      CASE WHEN NOT says THEN 'keep_linear' WHEN fit = 'hinge' THEN 'consider_piecewise_transform_or_mars' WHEN turns <= 1 THEN 'consider_spline_transform_or_gam' ELSE 'consider_gam' END AS recommendation, skip_reason, n_unique, n_non_missing,
      CASE WHEN says THEN gain ELSE 0.0 END AS log_loss_gain, CASE WHEN says THEN brier ELSE 0.0 END AS brier_gain, CASE WHEN says THEN train ELSE 0.0 END AS train_gain, CASE WHEN says THEN gap ELSE 0.0 END AS shape_gap,
      CASE WHEN says THEN turns ELSE 0 END AS direction_changes, coalesce(smooth_gain, 0.0) AS smooth_gain, coalesce(hinge_gain, 0.0) AS hinge_gain, coalesce(smooth_brier_gain, 0.0) AS smooth_brier_gain, coalesce(hinge_brier_gain, 0.0) AS hinge_brier_gain,
      coalesce(smooth_gap, 0.0) AS smooth_gap, coalesce(hinge_gap, 0.0) AS hinge_gap FROM wh)
SELECT *, row_number() OVER (ORDER BY list_position(['strong', 'moderate', 'weak', 'skip'], status), log_loss_gain DESC, shape_gap DESC, feature) AS rank FROM fl"""


@query("nonlinearity_verdicts", recursive(sql(VERDICT_SQL, *SHAPE_SQL, r="log_loss_gain brier_gain train_gain shape_gap smooth_gain hinge_gain smooth_brier_gain hinge_brier_gain smooth_gap hinge_gap")))
def _(spark, d):
    """All features: gains of bent fits, and what they advise."""
    train, test = split(spark, d)
    return S.nonlinearity_verdicts(train, test, COLS, LABEL)[0]


@query("response_curves", recursive(sql("SELECT * FROM cv", *SHAPE_SQL, r="grid_value linear_prob smooth_prob hinge_prob")))
def _(spark, d):
    """Win probability over a grid of each feature by the straight and the bent fits, the others at their medians."""
    train, test = split(spark, d)
    return S.nonlinearity_verdicts(train, test, COLS, LABEL)[1]
