"""The driver's tables read as events, forecasts, price lines, players and series.

Every role is a plain projection or one join of whole tables; nothing is sampled or invented.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from augury.functions.columns import snap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_id() -> Column:
    return (F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")


def side_score(status: str) -> Column:
    """What a line adds to the score of a side."""
    return F.when(F.col("l_linestatus") == status, F.col("l_quantity")).otherwise(0.0)


def events(spark: SparkSession, d: str) -> DataFrame:
    """One row per order that has lines: two sides, scores and a result once the order is closed."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("_opp"),
        F.sum(side_score("O")).alias("_h"), F.sum(side_score("F")).alias("_a"))
    return events_of(spark, d, lines)


def events_of(spark: SparkSession, d: str, lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Orders with their customers, joined with ``lines``: ``event_id``, ``_opp``, ``_h``, ``_a`` and the columns to ``keep``.
    Orders meet their customers first, so that what is known of lines is not shuffled by customer."""
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "event_id")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    final = F.col("o_orderstatus") != "P"
    return orders.join(customers, "o_custkey").join(lines, "event_id").select(
        "event_id", F.col("o_orderpriority").alias("league"), F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderdate") + F.expr("INTERVAL 3 HOURS")).alias("final_ts"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("home"), F.concat(F.lit("S"), F.col("_opp")).alias("away"),
        F.concat(F.lit("V"), F.col("c_nationkey")).alias("venue"), final.cast("int").alias("is_final"),
        F.when(final, F.col("_h")).alias("home_score"), F.when(final, F.col("_a")).alias("away_score"),
        F.when(final, (F.col("_h") > F.col("_a")).cast("int")).alias("home_win"), *keep)


EVENTS_SQL = """
line_rank AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
line_sum AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus='O' THEN l_quantity ELSE 0 END) AS h,
    sum(CASE WHEN l_linestatus='F' THEN l_quantity ELSE 0 END) AS a FROM lineitem GROUP BY 1),
ev AS (SELECT o_orderkey AS event_id, o_orderpriority AS league, o_orderdate AS start_ts,
    o_orderdate + INTERVAL 3 HOUR AS final_ts, 'C' || o_custkey AS home, 'S' || l_suppkey AS away,
    'V' || c_nationkey AS venue, (o_orderstatus <> 'P')::INT AS is_final,
    CASE WHEN o_orderstatus <> 'P' THEN h END AS home_score, CASE WHEN o_orderstatus <> 'P' THEN a END AS away_score,
    CASE WHEN o_orderstatus <> 'P' THEN (h > a)::INT END AS home_win
  FROM orders JOIN line_sum s ON s.l_orderkey = o_orderkey
  JOIN line_rank r ON r.l_orderkey = o_orderkey AND r.rn = 1 JOIN customer ON c_custkey = o_custkey)"""

ALIASES = {"m_a0": "m_a1"}


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """One row per order line: a model's probability at the line's ship date."""
    return forecasts_of(table(spark, d, "lineitem"))


def forecasts_of(lines: DataFrame, *keep: Column) -> DataFrame:
    sign = F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
    z = 0.06 * (F.col("l_quantity") - 25.5) * sign + 8.0 * (F.col("l_discount") - 0.05)
    kind = F.when(F.col("l_discount") >= 0.05, "1").otherwise("0")
    return lines.select(
        F.col("l_orderkey").alias("event_id"), line_id().alias("forecast_id"),
        F.concat(F.lit("M_"), F.col("l_returnflag"), kind).alias("raw_model"),
        F.concat(F.lit("run"), F.year("l_shipdate")).alias("run_id"), F.col("l_shipdate").alias("as_of"),
        F.when(F.col("l_tax") < 0.06, "live").when(F.col("l_tax") < 0.075, "history").alias("source"),  # some have none
        snap(1.0 / (1.0 + F.exp(-z)), 12).alias("prob"), *keep)


FORECASTS_SQL = """
fc0 AS (SELECT l_orderkey AS event_id, (l_partkey*1000000 + l_suppkey)*10 + l_linenumber AS forecast_id,
    'M_' || l_returnflag || CASE WHEN l_discount >= 0.05 THEN '1' ELSE '0' END AS raw_model,
    'run' || year(l_shipdate) AS run_id, l_shipdate AS as_of,
    CASE WHEN l_tax < 0.06 THEN 'live' WHEN l_tax < 0.075 THEN 'history' END AS source,
    round(1.0::DOUBLE/(1.0+exp(-(0.06::DOUBLE*(l_quantity-25.5)*(CASE WHEN l_linestatus='O' THEN 1.0::DOUBLE ELSE -1.0 END)
      + 8.0::DOUBLE*(l_discount-0.05::DOUBLE)))), 12) AS prob FROM lineitem),
fc AS (SELECT *, CASE WHEN lower(raw_model) = 'm_a0' THEN 'm_a1' ELSE lower(raw_model) END AS model FROM fc0)"""


def american() -> Column:
    q = F.col("l_quantity")
    return F.when(q >= 25, -(100.0 + 4.0 * (q - 25.0))).otherwise(100.0 + 4.0 * (25.0 - q))


def prices(spark: SparkSession, d: str) -> DataFrame:
    """One row per order line: a book's price for one side of one market. Lines without tax lost their
    event id and can be matched by the pair of sides only."""
    ev = events(spark, d).select("event_id", "home", "away", "start_ts")
    flag, status, q = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_quantity")
    side = F.when(flag == "R", F.when(status == "O", "over").otherwise("under")).otherwise(
        F.when(status == "O", "home").otherwise("away"))
    market = F.when(flag == "A", "h2h").when(flag == "N", "spreads").otherwise("totals")
    cents = F.round(F.col("l_discount") * 100)
    point = F.when(flag == "N", F.when(status == "O", -cents).otherwise(cents)).when(flag == "R", 180.0 + cents)
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "event_id")
    return lines.join(ev, "event_id").select(
        "event_id", F.when(F.col("l_tax") > 0, F.col("event_id")).alias("event_ref"), line_id().alias("line_id"),
        "home", "away", "start_ts", F.concat(F.lit("b"), F.col("l_suppkey") % 3).alias("book"),
        market.alias("market"), side.alias("side"), american().alias("price"), point.alias("point"),
        F.concat(F.lit("snap"), F.date_format("l_shipdate", "yyyyMM")).alias("snapshot_id"),
        F.date_trunc("month", "l_shipdate").alias("snapshot_as_of"),
        F.when(F.col("l_tax") < 0.08, F.col("l_shipdate")).alias("updated_at"),
        F.when(F.col("l_tax") >= 0.08, '{"import":"bundle"}').otherwise('{"import":"live"}').alias("meta"))


PRICES_SQL = """
pr AS (SELECT l_orderkey AS event_id, CASE WHEN l_tax > 0 THEN l_orderkey END AS event_ref,
    (l_partkey*1000000 + l_suppkey)*10 + l_linenumber AS line_id, home, away, start_ts, 'b' || (l_suppkey % 3) AS book,
    CASE l_returnflag WHEN 'A' THEN 'h2h' WHEN 'N' THEN 'spreads' ELSE 'totals' END AS market,
    CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus='O' THEN 'over' ELSE 'under' END
         ELSE CASE WHEN l_linestatus='O' THEN 'home' ELSE 'away' END END AS side,
    (CASE WHEN l_quantity >= 25 THEN -(100 + 4*(l_quantity-25)) ELSE 100 + 4*(25-l_quantity) END)::DOUBLE AS price,
    (CASE l_returnflag WHEN 'N' THEN CASE WHEN l_linestatus='O' THEN -round(l_discount*100) ELSE round(l_discount*100) END
         WHEN 'R' THEN 180.0 + round(l_discount*100) END)::DOUBLE AS point,
    'snap' || strftime(l_shipdate, '%Y%m') AS snapshot_id, date_trunc('month', l_shipdate)::TIMESTAMP AS snapshot_as_of,
    CASE WHEN l_tax < 0.08 THEN l_shipdate END AS updated_at,
    CASE WHEN l_tax >= 0.08 THEN start_ts ELSE coalesce(CASE WHEN l_tax < 0.08 THEN l_shipdate END,
      date_trunc('month', l_shipdate)) END AS eff
  FROM lineitem JOIN ev ON ev.event_id = l_orderkey)"""


def players(spark: SparkSession, d: str) -> DataFrame:
    """One row per order line: a part's appearance for a supplier in an order."""
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "event_id")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("ts"))
    q, disc, tax = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return lines.join(orders, "event_id").select(
        "event_id", "ts", F.col("l_partkey").alias("player"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("team"),
        line_id().alias("line_id"), (F.col("event_id") * 10000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("appearance"), q.alias("minutes"), (q * 0.5 + disc).alias("points"), disc.alias("assists"),
        tax.alias("rebounds_offensive"), (tax * 0.5).alias("rebounds_defensive"), (disc * 0.25).alias("steals"),
        (tax * 0.25).alias("blocks"), (disc * 0.5).alias("turnovers"), (tax * 0.5).alias("fouls"),
        (q * 0.25).alias("fg_made"), (q * 0.5).alias("fg_attempted"), (disc * 0.5).alias("ft_made"),
        disc.alias("ft_attempted"), (tax * 0.5).alias("three_made"), (q - 25.0).alias("plus_minus"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(1.0).alias("played"),
        F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0).alias("starter"))


PLAYERS_SQL = """
pl AS (SELECT l_orderkey AS event_id, o_orderdate AS ts, l_partkey AS player, 'S' || l_suppkey AS team,
    (l_partkey*1000000 + l_suppkey)*10 + l_linenumber AS line_id, l_orderkey*10000000 + l_suppkey*10 + l_linenumber AS appearance, l_quantity AS minutes,
    l_quantity*0.5::DOUBLE + l_discount*100 AS points, l_discount*100 AS assists, l_tax*100 AS rebounds_offensive,
    l_tax*100*0.5::DOUBLE AS rebounds_defensive, l_discount*100*0.25::DOUBLE AS steals, l_tax*100*0.25::DOUBLE AS blocks,
    l_discount*100*0.5::DOUBLE AS turnovers, l_tax*100*0.5::DOUBLE AS fouls, l_quantity*0.25::DOUBLE AS fg_made,
    l_quantity*0.5::DOUBLE AS fg_attempted, l_discount*100*0.5::DOUBLE AS ft_made, l_discount*100 AS ft_attempted,
    l_tax*100*0.5::DOUBLE AS three_made, l_quantity-25.0::DOUBLE AS plus_minus,
    CASE WHEN l_returnflag='R' THEN 0.0 ELSE 1.0 END::DOUBLE AS played,
    CASE WHEN l_linestatus='O' THEN 1.0 ELSE 0.0 END::DOUBLE AS starter
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

# Latest valid frozen forecast per event and model, with its result and row scores. A forecast that was made up later
# from history, or has no source, is not scored, however new it is.
SCORED_SQL = """
sc0 AS (SELECT f.*, e.start_ts, e.final_ts, e.league, e.home, e.away, e.venue, e.home_win,
    row_number() OVER (PARTITION BY f.event_id, f.model ORDER BY f.as_of DESC, f.forecast_id DESC) AS rn
  FROM fc f JOIN ev e USING (event_id)
  WHERE f.as_of <= coalesce(e.final_ts, date_trunc('day', e.start_ts) + INTERVAL '23:59:59' HOUR TO SECOND)
    AND e.home_win IS NOT NULL AND f.source = 'live'),
sc1 AS (SELECT *, greatest(least(prob, 1 - 1e-6), 1e-6) AS p FROM sc0 WHERE rn = 1),
sc AS (SELECT *, -(home_win*ln(p) + (1-home_win)*ln(1-p)) AS log_loss, (p-home_win)*(p-home_win) AS brier,
    ((p >= 0.5)::INT = home_win)::INT AS accuracy FROM sc1)""".replace(
    "INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND")
