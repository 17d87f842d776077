"""SQL text of logistic fits: Newton's method as a recursive query, with the linear systems solved in lists."""
from __future__ import annotations

from collections.abc import Sequence


def solve_sql(matrix: str, k: int) -> str:
    """Gauss-Jordan elimination of a flat list: ``k`` rows of ``k`` coefficients and the right side."""
    m = k + 1
    at = f"p[1]::INT * {k + 2} + 1"
    step = (f"CASE WHEN e // {m} = p[1]::INT THEN m[e + 1] / m[{at}] "
            f"ELSE m[e + 1] - m[(e // {m}) * {m} + p[1]::INT + 1] * m[p[1]::INT * {m} + e % {m} + 1] / m[{at}] END")
    pivots = "[" + ", ".join(f"[{p}.0::DOUBLE]" for p in range(k)) + "]"
    return f"list_reduce(list_prepend({matrix}, {pivots}), lambda m, p: list_transform(range(0, {k * m}), lambda e: {step}))"


def newton_sql(name: str, rows: str, feats: Sequence[str], label: str, by: Sequence[str], lam: str = "0.0", weight: str = "1.0", all_ridge: bool = False, steps: int = 12) -> str:
    """CTE ``name`` (``by``, ``lam``, ``step``, ``b``): coefficients of a ridge fit per group of ``by``, intercept first. ``rows`` is a
    CTE with the groups, the columns, and ``lam`` where the penalty differs by group."""
    k = len(feats) + 1
    x = ["1.0::DOUBLE", *[f"r.{f}" for f in feats]]
    eta = " + ".join(f"s.b[{i + 1}] * {v}" for i, v in enumerate(x))
    penal = [lam if all_ridge or i else "0.0" for i in range(k)]
    g = [f"sum({weight} * ({label} - mu) * x{i}) - any_value({penal[i]})::DOUBLE * any_value(b)[{i + 1}]" for i in range(k)]
    h = {(i, j): f"sum({weight} * mu * (1 - mu) * x{i} * x{j})" + (f" + any_value({penal[i]})::DOUBLE" if i == j else "") for i in range(k) for j in range(i, k)}
    flat = ", ".join(", ".join([*(h[min(i, j), max(i, j)] for j in range(k)), g[i]]) for i in range(k))
    keys = ", ".join(by)
    on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM r.{c}" for c in by) or "true"
    xs = ", ".join(f"{v} AS x{i}" for i, v in enumerate(x))
    zero = "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"
    return f"""{name} AS (SELECT {keys}, 0 AS step, {zero} AS b FROM {rows} GROUP BY ALL
  UNION ALL SELECT {keys}, step + 1, list_transform(range(0, {k}), lambda i: b[i + 1] + d[(i + 1) * {k + 1}]) FROM (
    SELECT {keys}, step, b, {solve_sql('mat', k)} AS d FROM (
      SELECT {keys}, step, any_value(b) AS b, [{flat}] AS mat FROM (
        SELECT r.*, s.step, s.b, {xs}, 1.0::DOUBLE / (1.0 + exp(-({eta}))) AS mu FROM {name} s JOIN {rows} r ON {on} WHERE s.step < {steps})
      GROUP BY {keys}, step)))"""


def jacobi_sql(matrix: str, k: int, sweeps: int = 8) -> str:
    """Eigenvalues and vectors of a symmetric flat list of ``k`` x ``k``: a list of the turned matrix, whose diagonal holds the
    values, and of the vectors as columns. Every turn takes three steps: its angle, the columns, the rows."""
    kk = k * k
    p, q, cos, sin = "p[2]::INT", "p[3]::INT", f"m[{2 * kk + 1}]", f"m[{2 * kk + 2}]"
    cell = lambda i, j: f"m[({i}) * {k} + {j} + 1]"
    tau = f"(({cell(q, q)} - {cell(p, p)}) / (2 * {cell(p, q)}))"
    tan = f"(CASE WHEN abs({cell(p, q)}) < 1e-15 THEN 0.0 ELSE (CASE WHEN {tau} < 0 THEN -1.0 ELSE 1.0 END) / (abs({tau}) + sqrt(1 + {tau} * {tau})) END)"
    i, j = f"(e // {k})", f"(e % {k})"
    angle = f"CASE WHEN e = {2 * kk} THEN 1 / sqrt(1 + {tan} * {tan}) WHEN e = {2 * kk + 1} THEN {tan} / sqrt(1 + {tan} * {tan}) ELSE m[e + 1] END"
    turn = lambda at, a, b: f"CASE WHEN {at} = {p} THEN {cos} * {a} - {sin} * {b} WHEN {at} = {q} THEN {sin} * {a} + {cos} * {b} ELSE m[e + 1] END"
    step = (f"CASE WHEN p[1] = 0 THEN {angle} WHEN e >= {2 * kk} THEN m[e + 1] WHEN p[1] = 1 THEN {turn(j, cell(i, p), cell(i, q))} "
            f"WHEN e >= {kk} THEN m[e + 1] ELSE {turn(i, cell(p, j), cell(q, j))} END")
    turns = ", ".join(f"[{kind}.0::DOUBLE, {a}.0, {b}.0]" for _ in range(sweeps) for a in range(k) for b in range(a + 1, k) for kind in range(3))
    unit = ", ".join(f"{float(a == b)}::DOUBLE" for a in range(k) for b in range(k))
    return f"list_reduce(list_prepend(list_concat({matrix}, [{unit}, 1.0::DOUBLE, 0.0::DOUBLE]), [{turns}]), lambda m, p: list_transform(range(0, {2 * kk + 2}), lambda e: {step}))"
