"""Repeatable random numbers as columns.

Values come from MD5 of a seed and a row's own keys, so a lost executor redraws the same numbers, and so does any
other engine.
"""
from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, functions as F

_M = 1 << 52


def uniform(seed: int, *keys: Column | str) -> Column:
    """In (0, 1), never an end point: the first 52 bits of MD5 of ``seed:key:...``."""
    text = F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(_M))


def uniform_sql(seed: int, *keys: str) -> str:
    """``uniform`` as SQL text."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join([str(seed), *keys])})), 1, 13))::BIGINT + 0.5::DOUBLE) / {_M}::DOUBLE)"


def poisson_steps() -> list[float]:
    """Distribution function of Poisson(1) at 0 to 7."""
    mass, cum, out = math.exp(-1), 0.0, []
    for k in range(8):
        cum += mass
        out.append(cum)
        mass /= k + 1
    return out


def normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def poisson_one(seed: int, *keys: Column | str) -> Column:
    """Poisson(1) by inversion: the weight of a row in one bootstrap replicate.

    The number of steps at or below ``uniform``, found from the digits that it is made of: a draw is hashed once.
    """
    text = F.concat_ws(":", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    least = [f"{math.ceil(Fraction(c) * _M - Fraction(1, 2)):013x}" for c in poisson_steps()]

    def below(digits: Column) -> Column:
        out = F.when(digits < least[0], 0)
        for k, step in enumerate(least[1:], 1):
            out = out.when(digits < step, k)
        return out.otherwise(len(least))
    return F.transform(F.array(F.substring(F.md5(text), 1, 13)), below)[0]


# Coefficients of the rational approximation of the normal quantile.
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)


def _poly(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for k in coefs[1:]:
        out = out * x + k
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function, relative error under 1.2e-9."""
    tail = 0.02425
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    low = _poly(q, _C) / _poly(q, (*_D, 1.0))
    r = p - 0.5
    t = r * r
    mid = _poly(t, _A) * r / _poly(t, (*_B, 1.0))
    return F.when(p < tail, low).when(p > 1 - tail, -low).otherwise(mid)


def normal_quantile_sql(p: str) -> str:
    """``normal_quantile`` as SQL text, for a column or a short expression."""
    def poly(x: str, coefs) -> str:
        out = f"{coefs[0]!r}::DOUBLE"
        for k in coefs[1:]:
            out = f"({out}*{x} + {k!r}::DOUBLE)"
        return out
    q, r = f"sqrt(-2*ln(least({p}, 1-{p})))", f"({p}-0.5)"
    low = f"{poly(q, _C)}/{poly(q, (*_D, 1.0))}"
    mid = f"{poly(f'({r}*{r})', _A)}*{r}/{poly(f'({r}*{r})', (*_B, 1.0))}"
    return f"CASE WHEN {p} < 0.02425 THEN {low} WHEN {p} > 0.97575 THEN -({low}) ELSE {mid} END"
