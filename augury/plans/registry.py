"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SNAP = 4  # digits kept before rounding, so that sums in another order don't fall on the other side of a half


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and print times, so that both engines' results compare by value."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x, scale, fine = c.cast("double"), float(10 ** digits), float(10 ** (digits + SNAP))
            near = lambda v, s: F.signum(v) * F.floor(F.abs(v) * s + 0.5) / s
            c = F.when(F.abs(x) * fine < 9e15, near(near(x, fine), scale)).when(F.abs(x) * scale < 9e15, near(x, scale)).otherwise(F.round(x, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def sql(body: str, *parts: str, r: str = "", ts: str = "", day: str = "", digits: int = 6) -> str:
    """A SELECT behind shared WITH parts, with ``r`` columns rounded and ``ts``/``day`` columns printed."""
    fine = 10.0 ** (digits + SNAP)
    repl = [f"round(CASE WHEN abs({c}::DOUBLE) * {fine!r} < 9e15 THEN round({c}::DOUBLE, {digits + SNAP}) ELSE {c}::DOUBLE END, {digits}) + 0.0::DOUBLE AS {c}" for c in r.split()]
    repl += [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in ts.split()]
    repl += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in day.split()]
    head = f"SELECT * REPLACE ({', '.join(repl)})" if repl else "SELECT *"
    pre = ("WITH " + ",\n".join(p.strip() for p in parts) + "\n") if parts else ""
    if body.lstrip().upper().startswith("WITH "):
        cte, pre = ",\n" + body.lstrip()[5:], pre
        main_at = cte.rindex("\nSELECT")
        return f"{pre or 'WITH '}{(cte if pre else cte[2:])[:main_at if pre else main_at - 2]}\n{head} FROM ({cte[main_at:]}) AS z"
    return f"{pre}{head} FROM (\n{body}\n) AS z"


def query(name: str, oracle: str | None = None, digits: int = 6):
    def add(fn):
        QUERIES[name] = lambda spark, d: tidy(fn(spark, d), digits)
        QUERIES[name].__name__ = name
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add
