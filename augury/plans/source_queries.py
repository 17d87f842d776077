"""Ingestion, streaming, rating and change-point queries."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession, functions as F, types as T

from augury.functions import columns as C
from augury.operators import ratings as Q
from augury.plans.registry import query, sql
from augury.plans.roles import EVENTS_SQL, FORECASTS_SQL, PLAYERS_SQL, american, events, forecasts, table
from augury.plans.feature_queries import recursive
from augury.plans.scoring_queries import BASE, named_forecasts, scored
from augury.session import checkpoint_folder
from augury.sources import imports as I, nested as N, tables as B
from augury.streaming import jobs as J


@query("import_bundle", """SELECT entity_key, name, nation, balance, segment, import_source FROM (SELECT c_custkey AS entity_key, c_name AS name, c_nationkey AS nation, round(c_acctbal, 6) AS balance, c_mktsegment AS segment, 'crm' AS import_source FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 6), '-', 'import' FROM supplier)""")
def _(spark, d):
    b = I.import_bundle(spark, [{"path": "customer.parquet", "source": "crm"}, {"path": "supplier.parquet"}], d)
    pick = lambda a, s: F.coalesce(F.col(f"c_{a}"), F.col(f"s_{s}"))
    return b.select(pick("custkey", "suppkey").alias("entity_key"), pick("name", "name").alias("name"), pick("nationkey", "nationkey").alias("nation"),
                    pick("acctbal", "acctbal").alias("balance"), F.coalesce("c_mktsegment", F.lit("-")).alias("segment"), "import_source")


@query("normalize_events", sql("""SELECT o_orderkey AS event_id, (year(o_orderdate)*10000)::INT AS season, strftime(o_orderdate, '%Y-%m-%d') AS event_date, o_orderdate AS start_ts,
    CASE WHEN o_totalprice > 250000 THEN 'final' ELSE 'scheduled' END AS state, 'C' || o_custkey AS home, o_orderpriority AS away, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS is_final,
    CASE WHEN o_totalprice > 250000 THEN o_totalprice END AS home_score FROM orders""", r="home_score", ts="start_ts"))
def _(spark, d):
    o = table(spark, d, "orders")
    big = F.col("o_totalprice") > 250000
    raw = o.select(F.col("o_orderkey").alias("gameId"), (F.year("o_orderdate") * 10000).alias("season"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderdate").alias("start_ts"),
                   F.concat(F.lit("C"), F.col("o_custkey")).alias("homeTeam"), F.col("o_orderpriority").alias("awayTeam"),
                   F.when(big, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("home_score"), F.when(big, 1).alias("home_win"))
    n = I.normalize_events(raw, {"gameId": "event_id", "homeTeam": "home", "awayTeam": "away"}, F.lit("2024-01-01").cast("timestamp"))
    return n.select("event_id", "season", "event_date", "start_ts", "state", "home", "away", "is_final", "home_score")


PX = "(CASE WHEN l_quantity >= 25 THEN -(100 + 4*(l_quantity-25)) ELSE 100 + 4*(25-l_quantity) END)::DOUBLE"


@query("normalize_prices", sql(f"""SELECT price_event_id, local_day, outcome_entity, price, CASE WHEN price > 0 THEN 100/(price+100) WHEN price < 0 THEN -price/(-price+100) END AS implied FROM (SELECT l_orderkey AS price_event_id,
    strftime(timezone('America/Chicago', timezone('UTC', l_shipdate)), '%Y-%m-%d') AS local_day, CASE WHEN l_linestatus = 'O' THEN 'P' || l_partkey ELSE 'S' || l_suppkey END AS outcome_entity, {PX} AS price FROM lineitem)""", r="price implied"))
def _(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("price_event_id"), F.col("l_shipdate").alias("commence_ts"), F.concat(F.lit("P"), F.col("l_partkey")).alias("home"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("away"), F.lit("b").alias("book"), F.lit("h2h").alias("market"), F.col("l_returnflag").alias("outcome_name"),
        F.when(F.col("l_linestatus") == "O", "Home").otherwise(" away ").alias("outcomeSide"), american().alias("price"))
    n = I.normalize_prices(raw, {"outcomeSide": "side"}, F.lit("L"), F.lit("2024-01-01").cast("timestamp"))
    return n.select("price_event_id", F.col("local_date").alias("local_day"), "outcome_entity", "price", "implied")


@query("upsert", sql("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS version FROM orders"""))
def _(spark, d):
    o = table(spark, d, "orders")
    base = o.select("o_orderkey", "o_orderpriority", F.lit(1).alias("version"))
    delta = o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("late").alias("o_orderpriority"), F.lit(2).alias("version"))
    once = B.upsert(base, delta, ["o_orderkey"], [F.col("version")])
    return B.upsert(once, delta, ["o_orderkey"], [F.col("version")])


@query("snapshot_audit", sql("SELECT source, row_count, extracted_at, 16 AS id_length FROM (SELECT 'lines' AS source, count(*) AS row_count, max(l_shipdate) AS extracted_at FROM lineitem)", ts="extracted_at"))
def _(spark, d):
    a = B.snapshot_audit(table(spark, d, "lineitem"), "lines", "l_shipdate", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return a.select("source", "row_count", "extracted_at", F.length("snapshot_id").alias("id_length"))


@query("results_from_events", sql("SELECT event_id, final_ts, home, away, home_score, away_score, home_win FROM ev WHERE home_win IS NOT NULL", EVENTS_SQL, r="home_score away_score", ts="final_ts"))
def _(spark, d):
    ev = events(spark, d)
    return B.results_from_events(ev.unionByName(ev))


@query("chunk_manifest", sql("""SELECT strftime(DATE '1970-01-01' + ((l_shipdate::DATE - DATE '1970-01-01')//90*90)::INT, '%Y-%m-%d') AS chunk_start, count(*) AS rows, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem GROUP BY 1""", ts="first_ts last_ts"))
def _(spark, d):
    return B.chunk_manifest(B.chunks(table(spark, d, "lineitem"), "l_shipdate", 90), "l_shipdate")


@query("interim_table", sql("SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, NULL::VARCHAR AS o_note FROM orders", ts="o_orderdate", r="o_totalprice"))
def _(spark, d):
    """A table of the folder by a declared schema, a column of which the file lacks, and one that is not there."""
    schema = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_note string"
    read = lambda name: B.read_table(spark, d, name, T.StructType.fromDDL(schema))
    return read("orders").unionByName(read("no_such_table"))


@query("artifact_tables", sql("SELECT event_id, home, away, home_score, away_score, year(final_ts) + CASE WHEN quarter(final_ts) = 2 THEN 100 ELSE 0 END AS season, quarter(final_ts) AS part FROM ev WHERE home_win IS NOT NULL", EVENTS_SQL, r="home_score away_score"))
def _(spark, d):
    """Results written by quarter, the second quarter replaced in place, then kept as CSV and read by schema."""
    folder = scratch(spark)
    done = B.results_from_events(events(spark, d)).select("event_id", "home", "away", "home_score", "away_score", F.year("final_ts").alias("season"), F.quarter("final_ts").alias("part"))
    B.write_table(done, f"{folder}/parts", partition_by=["part"])
    B.replace_partitions(done.where("part = 2").withColumn("season", F.col("season") + 100), f"{folder}/parts", ["part"])
    B.write_table(spark.read.parquet(f"{folder}/parts"), f"{folder}/results.csv", fmt="csv")
    return B.read_table(spark, folder, "results", done.schema)


@query("exported_chunks", sql("""WITH c AS (SELECT l_orderkey, l_linenumber, l_extendedprice, DATE '1970-01-01' + ((l_shipdate::DATE - DATE '1970-01-01')//90*90)::INT AS chunk_start FROM lineitem)
SELECT *, count(*) OVER (PARTITION BY chunk_start) AS chunk_rows FROM c""", r="l_extendedprice", day="chunk_start"))
def _(spark, d):
    """All rows as read back from the chunks' folders, beside the count in the manifest."""
    folder = scratch(spark)
    manifest = B.export_chunks(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"), "l_shipdate", 90, folder)
    rows = spark.read.parquet(folder).select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("chunk_start").cast("date").alias("chunk_start"))
    return rows.join(manifest.select("chunk_start", F.col("rows").alias("chunk_rows")), "chunk_start")


@query("snapshot_ids", sql("SELECT count(*) AS row_count, 1 AS same_in_any_order, 1 AS moved_by_a_value, 1 AS moved_by_the_source FROM lineitem"))
def _(spark, d):
    """The id depends on the source and on every value, but not on the order of rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    first = li.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("m"))  # one row
    one = li.crossJoin(F.broadcast(first)).withColumn("l_extendedprice", F.col("l_extendedprice") + (F.struct("l_orderkey", "l_linenumber") == F.col("m")).cast("int")).drop("m")
    audit = lambda df, source="lines": B.snapshot_audit(df, source, "l_shipdate", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    ids = {"_a": li, "_b": li.repartition(7, "l_linenumber"), "_c": one}
    out = audit(li, "other").select("row_count", F.col("snapshot_id").alias("_d"))
    for name, df in ids.items():
        out = out.crossJoin(audit(df).select(F.col("snapshot_id").alias(name)))  # one row each
    same = lambda a, b: (F.col(a) == F.col(b)).cast("int")
    return out.select("row_count", same("_a", "_b").alias("same_in_any_order"), (1 - same("_a", "_c")).alias("moved_by_a_value"), (1 - same("_a", "_d")).alias("moved_by_the_source"))


@query("split_ledger", sql("SELECT CASE WHEN source = 'history' THEN 'diagnostics' ELSE 'ledger' END AS target, event_id, forecast_id, source FROM (SELECT *, row_number() OVER (PARTITION BY event_id, forecast_id ORDER BY as_of DESC, model) AS n FROM fc) WHERE n = 1 AND (event_id, forecast_id) NOT IN (SELECT (event_id, forecast_id) FROM fc WHERE run_id = 'run1996')", FORECASTS_SQL))
def _(spark, d):
    f = named_forecasts(spark, d)
    led, diag = B.split_ledger(f.unionByName(f), f.where("run_id = 'run1996'"), ["event_id", "forecast_id"], "source", ["history"], [F.col("as_of").desc(), F.col("model")])
    both = led.withColumn("target", F.lit("ledger")).unionByName(diag.withColumn("target", F.lit("diagnostics")))
    return both.select("target", "event_id", "forecast_id", "source")


@query("canonical_names", sql("SELECT model, count(*) AS n FROM fc GROUP BY 1", FORECASTS_SQL))
def _(spark, d):
    return named_forecasts(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("day_keys", sql("""SELECT event_id, strftime(timezone('America/Chicago', timezone('UTC', coalesce(CASE WHEN is_final = 1 THEN start_ts END, final_ts))), '%Y-%m-%d') AS day FROM ev""", EVENTS_SQL))
def _(spark, d):
    return events(spark, d).select("event_id", C.day_key(F.when(F.col("is_final") == 1, F.col("start_ts")), F.col("final_ts"), F.col("start_ts")).alias("day"))


@query("flatten_prices", sql(f"""WITH l AS (SELECT l_orderkey AS k, (l_partkey*1000000 + l_suppkey)*10 + l_linenumber AS book, {PX} AS px, l_discount*100 AS pt, l_linestatus AS st, l_returnflag AS rf FROM lineitem),
    u AS (SELECT k, book, 'h2h' AS market, 'home' AS side, px AS price, NULL::DOUBLE AS point FROM l UNION ALL SELECT k, book, 'h2h', 'away', -px, NULL FROM l WHERE st = 'F'
      UNION ALL SELECT k, book, 'spreads', 'home', CASE WHEN rf = 'A' THEN -110::DOUBLE END, -round(pt) FROM l UNION ALL SELECT k, book, 'spreads', 'away', NULL, round(pt) FROM l
      UNION ALL SELECT k, book, 'totals', 'over', -105, 200 + round(pt) FROM l UNION ALL SELECT k, book, 'totals', 'under', NULL, 200 + round(pt) FROM l)
SELECT k::VARCHAR AS price_event_id, 'C' || o_custkey AS home, book::VARCHAR AS book, market, side, price, point, CASE WHEN price > 0 THEN 100/(price+100) WHEN price < 0 THEN -price/(-price+100) END AS implied FROM u JOIN orders ON o_orderkey = k""", r="price point implied"))
def _(spark, d):
    from augury.plans.roles import line_id
    li = table(spark, d, "lineitem").withColumns({"_px": american(), "_pt": F.round(F.col("l_discount") * 100).cast("int")})
    s = lambda c: c.cast("int").cast("string")
    odds = lambda c: F.struct(F.struct(s(c).alias("odds")).alias("close"))
    line = lambda c: F.struct(F.struct(s(c).alias("line")).alias("open"))
    away = F.when(F.col("l_linestatus") == "F", -F.col("_px"))
    entry = F.struct(
        F.struct(line_id().cast("string").alias("id"), F.lit("Book").alias("name")).alias("provider"),
        F.struct(odds(F.col("_px")).alias("home"), F.struct(F.struct(s(away).alias("odds")).alias("open")).alias("away")).alias("moneyline"),
        F.struct(F.struct(F.struct(F.when(F.col("l_returnflag") == "A", "-110").alias("odds"), s(-F.col("_pt")).alias("line")).alias("close")).alias("home"),
                 line(F.col("_pt")).alias("away")).alias("pointSpread"),
        F.lit("-105").alias("overOdds"), F.concat(F.lit("o"), s(200 + F.col("_pt"))).alias("overUnder"))
    picks = li.groupBy("l_orderkey").agg(F.collect_list(entry).alias("pickcenter"))  # one order's lines
    side = lambda which, name: F.struct(F.lit(which).alias("homeAway"), F.struct(name.alias("displayName"), name.alias("abbreviation")).alias("team"))
    o = table(spark, d, "orders").join(picks, F.col("o_orderkey") == F.col("l_orderkey"))
    comp = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
                    F.array(side("home", F.concat(F.lit("C"), F.col("o_custkey"))), side("away", F.col("o_orderpriority"))).alias("competitors"))
    raw = o.select(F.to_json(F.struct(F.struct(F.array(comp).alias("competitions")).alias("header"), "pickcenter")).alias("payload"), F.col("o_orderdate").alias("seen"))
    return N.flatten_prices(raw, "payload", [], "seen").select("price_event_id", "home", "book", "market", "side", "price", "point", "implied")


def box(spark, d):
    li = table(spark, d, "lineitem")
    i = lambda c: F.col(c).cast("int").cast("string")
    stats = F.array(F.concat(i("l_quantity"), F.lit(":30")), F.concat(i("l_quantity"), F.lit("-"), F.lit("60")), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("--"))
    ath = F.struct(F.struct(F.col("l_partkey").cast("string").alias("id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("displayName")).alias("athlete"),
                   (F.col("l_linestatus") == "O").alias("starter"), (F.col("l_returnflag") == "R").alias("didNotPlay"), stats.alias("stats"))
    one = li.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(ath).alias("athletes"))  # one order's lines of one supplier
    team = F.struct(F.struct(F.concat(F.lit("S"), F.col("l_suppkey")).alias("abbreviation")).alias("team"),
                    F.array(F.struct(F.array(F.lit("min"), F.lit("FG"), F.lit("PTS"), F.lit("AST")).alias("labels"), "athletes")).alias("statistics"))
    raw = one.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.to_json(F.struct(F.collect_list(team).alias("players"))).alias("payload"))
    return N.flatten_boxscores(raw, "payload", ["event_id"])


@query("flatten_boxscores", sql("""SELECT l_orderkey AS event_id, 'S' || l_suppkey AS team, l_partkey::VARCHAR AS player, (l_returnflag <> 'R')::INT AS played, (l_linestatus = 'O')::INT AS starter, l_quantity + 0.5 AS minutes,
    l_quantity AS fg_made, 60.0 AS fg_attempted, round(l_discount*100) AS points, 0.0 AS assists FROM lineitem""", r="minutes fg_made fg_attempted points assists"))
def _(spark, d):
    return box(spark, d).select("event_id", "team", "player", "played", "starter", "minutes", "fg_made", "fg_attempted", "points", "assists")


@query("boxscore_totals", sql("""SELECT l_orderkey AS event_id, 'S' || l_suppkey AS team, sum((l_returnflag <> 'R')::INT)::BIGINT AS players, sum(l_quantity + 0.5) AS minutes, sum(round(l_discount*100)) AS points FROM lineitem GROUP BY 1, 2""", r="minutes points"))
def _(spark, d):
    return N.team_totals(box(spark, d), ["event_id"]).select("event_id", "team", "players", "minutes", "points")


@query("flatten_goalies", sql("""WITH l AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'HOM' ELSE 'AWY' END AS team FROM lineitem),
    t AS (SELECT l_orderkey AS event_id, sum((team = 'HOM')::INT) AS hs, sum((team = 'AWY')::INT) AS s_a, sum((team = 'HOM' AND l_tax >= 0.04)::INT) AS hp, sum((team = 'AWY' AND l_tax >= 0.04)::INT) AS ap,
      sum((team = 'HOM' AND l_discount >= 0.05 AND l_returnflag = 'R')::INT) AS hg, sum((team = 'AWY' AND l_discount >= 0.05 AND l_returnflag = 'R')::INT) AS ag FROM l GROUP BY 1),
    s AS (SELECT event_id, 'HOM' AS team, 1 AS is_home, hs AS sf, s_a AS sa, hp AS tk, ap AS dr, hg AS pp FROM t UNION ALL SELECT event_id, 'AWY', 0, s_a, hs, ap, hp, ag FROM t)
SELECT s.event_id, s.team, is_home, l_partkey AS goalie_id, CASE WHEN l_returnflag = 'A' THEN 'confirmed' ELSE 'probable' END AS starter_status, (l_quantity + 3)::BIGINT AS shots_against, l_quantity::BIGINT AS saves,
      l_quantity + 0.5 AS toi_minutes, NULL::BIGINT AS shots_for, CASE WHEN tk + dr > 0 THEN tk::BIGINT END AS penalties_taken, CASE WHEN tk + dr > 0 THEN dr::BIGINT END AS penalties_drawn, pp::BIGINT AS pp_goals FROM s JOIN l ON l_orderkey = event_id AND l.team = s.team
    UNION ALL SELECT event_id, team, is_home, NULL, 'unknown', sa::BIGINT, NULL, NULL, sf::BIGINT, CASE WHEN tk + dr > 0 THEN tk::BIGINT END, CASE WHEN tk + dr > 0 THEN dr::BIGINT END, pp::BIGINT FROM s""", r="toi_minutes"))
def _(spark, d):
    """Order lines written as the feed's two documents, and read back."""
    home = F.col("l_linestatus") == "O"
    abbrev = F.struct(F.when(home, "HOM").otherwise("AWY").alias("default")).alias("teamAbbrev")
    goalie = F.struct(F.col("l_partkey").alias("playerId"), (F.col("l_returnflag") == "A").alias("starter"), (F.col("l_quantity") + 3).cast("long").alias("shotsAgainst"),
                      F.col("l_quantity").cast("long").alias("saves"), F.concat(F.col("l_quantity").cast("int"), F.lit(":30")).alias("toi"))
    goal = F.struct(F.when(F.col("l_returnflag") == "R", "PP").otherwise("ev").alias("strength"), abbrev)
    of = lambda cond, x: F.collect_list(F.when(cond, x))
    o = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        of(home, goalie).alias("h"), of(~home, goalie).alias("a"), of(F.col("l_tax") >= 0.04, F.struct(abbrev)).alias("f"), of(F.col("l_discount") >= 0.05, goal).alias("g"))
    team = lambda short, who: F.struct(F.lit(short).alias("abbrev"), F.size(who).alias("sog"))
    raw = o.select("event_id", F.to_json(F.struct(team("AWY", "a").alias("awayTeam"), team("HOM", "h").alias("homeTeam"), F.struct(F.struct(F.col("a").alias("goalies")).alias("awayTeam"), F.struct(F.col("h").alias("goalies")).alias("homeTeam")).alias("playerByGameStats"))).alias("players"),
                   F.to_json(F.struct(F.struct(F.array(F.struct(F.col("f").alias("penalties"))).alias("penalties"), F.array(F.struct(F.col("g").alias("goals"))).alias("scoring")).alias("summary"))).alias("periods"))
    return N.flatten_goalies(raw, "players", "periods", ["event_id"]).select(
        "event_id", "team", "is_home", "goalie_id", "starter_status", "shots_against", "saves", "toi_minutes", "shots_for", "penalties_taken", "penalties_drawn", "pp_goals")


# ---- recurrences --------------------------------------------------------------------------------
def pooled(spark, d):
    """Events in many independent pools: one per league and season, between nations."""
    from augury.plans.questions import nation_events
    ev = nation_events(spark, d)
    return ev.select("event_id", F.concat_ws("|", "league", C.season_code("start_ts")).alias("pool"), "start_ts", "home", "away", "home_win",
                     (F.col("home_score") - F.col("away_score")).alias("margin"))


POOL_SQL = """
pe AS MATERIALIZED (SELECT event_id, league || '|' || (((year(start_ts)+(month(start_ts)>=7)::INT-1)*10000 + year(start_ts)+(month(start_ts)>=7)::INT)::INT) AS pool, venue AS home, 'N' || s_nationkey AS away, home_win, home_score-away_score AS margin,
  row_number() OVER (PARTITION BY league, year(start_ts)+(month(start_ts)>=7)::INT ORDER BY start_ts, event_id) AS i FROM ev JOIN supplier ON 'S' || s_suppkey = away)"""
# One step per event of each pool, the ratings carried in a map.
ELO_SQL = """
el AS (SELECT pool, 0::BIGINT AS i, MAP([]::VARCHAR[], []::DOUBLE[]) AS st, NULL::BIGINT AS event_id, NULL::DOUBLE AS rh, NULL::DOUBLE AS ra FROM pe GROUP BY 1
  UNION ALL SELECT pool, i, CASE WHEN home_win IS NULL THEN st ELSE map_concat(st, MAP([home, away], [rh+dl, ra-dl])) END, event_id, rh, ra FROM (SELECT *, 20*(1+0.1::DOUBLE*least(abs(margin), 4))*(home_win-1/(1+exp(-(rh+35-ra)/400))) AS dl
    FROM (SELECT e.pool, e.i, e.event_id, e.home, e.away, e.home_win, e.margin, el.st, coalesce(el.st[e.home], 1500::DOUBLE) AS rh, coalesce(el.st[e.away], 1500::DOUBLE) AS ra FROM el JOIN pe e ON e.pool = el.pool AND e.i = el.i + 1)))"""
DYN_SQL = """
dn AS (SELECT pool, 0::BIGINT AS i, MAP([]::VARCHAR[], []::DOUBLE[]) AS sm, MAP([]::VARCHAR[], []::DOUBLE[]) AS sv, NULL::BIGINT AS event_id, NULL::DOUBLE AS mh, NULL::DOUBLE AS ma, NULL::DOUBLE AS p, NULL::DOUBLE AS z FROM pe GROUP BY 1
  UNION ALL SELECT pool, i, CASE WHEN home_win IS NULL THEN map_concat(sm, MAP([home, away], [mh, ma])) ELSE map_concat(sm, MAP([home, away], [mh+vh/(1+f*z)*(home_win-p), ma-va/(1+f*z)*(home_win-p)])) END,
      CASE WHEN home_win IS NULL THEN map_concat(sv, MAP([home, away], [vh, va])) ELSE map_concat(sv, MAP([home, away], [greatest(vh*(1-vh/(1+f*z)*f), 1e-4), greatest(va*(1-va/(1+f*z)*f), 1e-4)])) END, event_id, mh, ma, p, z
    FROM (SELECT *, greatest(p*(1-p), 1e-4) AS f FROM (SELECT *, 1/(1+exp(-(mh-ma+0.12::DOUBLE))) AS p, vh+va AS z FROM (SELECT e.*, dn.sm, dn.sv, coalesce(dn.sm[e.home], 0::DOUBLE) AS mh, coalesce(dn.sm[e.away], 0::DOUBLE) AS ma,
      coalesce(dn.sv[e.home], 1::DOUBLE)+0.07::DOUBLE AS vh, coalesce(dn.sv[e.away], 1::DOUBLE)+0.07::DOUBLE AS va FROM dn JOIN pe e ON e.pool = dn.pool AND e.i = dn.i + 1))))"""
BT_SQL = """
bt_ AS (SELECT pool, 0::BIGINT AS i, MAP([]::VARCHAR[], []::DOUBLE[]) AS sm, MAP([]::VARCHAR[], []::DOUBLE[]) AS sv, NULL::BIGINT AS event_id, NULL::DOUBLE AS mh, NULL::DOUBLE AS ma, NULL::DOUBLE AS z, NULL::DOUBLE AS sd FROM pe GROUP BY 1
  UNION ALL SELECT pool, i, CASE WHEN home_win IS NULL THEN map_concat(sm, MAP([home, away], [mh, ma])) ELSE map_concat(sm, MAP([home, away], [mh+vh/t*(home_win-p)/f, ma-va/t*(home_win-p)/f])) END,
      CASE WHEN home_win IS NULL THEN map_concat(sv, MAP([home, away], [vh, va])) ELSE map_concat(sv, MAP([home, away], [greatest(vh*(1-vh/t), 1e-4), greatest(va*(1-va/t), 1e-4)])) END, event_id, mh, ma, z, sqrt(vh+va)
    FROM (SELECT *, vh+va+1/f AS t FROM (SELECT *, greatest(p*(1-p), 1e-3) AS f FROM (SELECT *, 1/(1+exp(-z)) AS p FROM (SELECT *, mh-ma+0.12::DOUBLE AS z FROM (SELECT e.*, bt_.sm, bt_.sv, coalesce(bt_.sm[e.home], 0::DOUBLE) AS mh, coalesce(bt_.sm[e.away], 0::DOUBLE) AS ma,
      coalesce(bt_.sv[e.home], 1.5::DOUBLE)+0.08::DOUBLE AS vh, coalesce(bt_.sv[e.away], 1.5::DOUBLE)+0.08::DOUBLE AS va FROM bt_ JOIN pe e ON e.pool = bt_.pool AND e.i = bt_.i + 1))))))"""
WIN_PROB = "1/(1+exp(-(rh+35-ra)/400))"


@query("elo", recursive(sql(f"SELECT event_id, pool, rh AS elo_home_pre, ra AS elo_away_pre, {WIN_PROB} AS elo_home_prob FROM el WHERE i > 0", EVENTS_SQL, POOL_SQL, ELO_SQL, r="elo_home_pre elo_away_pre elo_home_prob")))
def _(spark, d):
    return Q.elo(pooled(spark, d), ["pool"], ["start_ts", "event_id"]).select("event_id", "pool", "elo_home_pre", "elo_away_pre", "elo_home_prob")


@query("dynamic_rating", recursive(sql("SELECT event_id, pool, mh AS dyn_home_mean, ma AS dyn_away_mean, p AS dyn_home_prob, z AS dyn_var FROM dn WHERE i > 0", EVENTS_SQL, POOL_SQL, DYN_SQL, r="dyn_home_mean dyn_away_mean dyn_home_prob dyn_var")))
def _(spark, d):
    return Q.dynamic_rating(pooled(spark, d), ["pool"], ["start_ts", "event_id"]).select("event_id", "pool", "dyn_home_mean", "dyn_away_mean", "dyn_home_prob", "dyn_var")


@query("paired_state", recursive(sql("SELECT event_id, pool, mh AS bt_home, ma AS bt_away, 1/(1+exp(-(z-1.6448536269514722::DOUBLE*sd))) AS bt_low, 1/(1+exp(-(z+1.6448536269514722::DOUBLE*sd))) AS bt_high FROM bt_ WHERE i > 0", EVENTS_SQL, POOL_SQL, BT_SQL, r="bt_home bt_away bt_low bt_high")))
def _(spark, d):
    return Q.paired_state(pooled(spark, d), ["pool"], ["start_ts", "event_id"]).select("event_id", "pool", "bt_home", "bt_away", "bt_low", "bt_high")


@query("paired_state_fit")
def _(spark, d):
    ev = pooled(spark, d).withColumn("month_no", F.month("start_ts").cast("double"))
    return Q.paired_state_fit(ev, ["pool"], ["start_ts", "event_id"], ["month_no"]).drop("month_no")


CP_SQL = """
cs0 AS (SELECT model, start_ts::DATE AS day, avg(log_loss) AS x FROM sc GROUP BY 1, 2),
cs1 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY model) AS n, avg(x) OVER (PARTITION BY model) AS mu, greatest(stddev_pop(x) OVER (PARTITION BY model), 0.05::DOUBLE) AS sc_ FROM cs0),
cs AS MATERIALIZED (SELECT *, greatest(20, least(60, n//5)) AS burn, greatest(10, least(30, n//12)) AS cool, greatest(0.01::DOUBLE, 0.05::DOUBLE*sc_) AS dl, greatest(0.35::DOUBLE, 2.5::DOUBLE*sc_) AS th, greatest(0.02::DOUBLE, 0.2::DOUBLE*sc_) AS k, greatest(0.45::DOUBLE, 3.0::DOUBLE*sc_) AS h FROM cs1 WHERE n >= 30),
cp AS (SELECT model, -1::BIGINT AS i, NULL::DATE AS day, NULL::DOUBLE AS x, 0::DOUBLE AS mean, 0::DOUBLE AS cum, 0::DOUBLE AS low, 0::DOUBLE AS up, 0::DOUBLE AS dn, -1000000::BIGINT AS lp, -1000000::BIGINT AS lc, NULL::DOUBLE AS ph, NULL::DOUBLE AS cu, th, h FROM cs WHERE i = 0
  UNION ALL SELECT model, i, day, x, mean, CASE WHEN a1 THEN 0 ELSE cum END, CASE WHEN a1 THEN 0 ELSE low END, CASE WHEN a2 THEN 0 ELSE up END, CASE WHEN a2 THEN 0 ELSE dn END, CASE WHEN a1 THEN i ELSE lp END, CASE WHEN a2 THEN i ELSE lc END,
      CASE WHEN a1 THEN cum-low END, CASE WHEN a2 THEN greatest(up, -dn) END, th, h FROM (SELECT *, i+1 >= burn AND cum-low > th AND i-lp >= cool AS a1, i+1 >= burn AND greatest(up, -dn) > h AND i-lc >= cool AS a2
    FROM (SELECT *, least(low0, cum) AS low FROM (SELECT *, cum0 + x - mean - dl AS cum FROM (SELECT s.model, s.i, s.day, s.x, s.burn, s.cool, s.dl, s.th, s.h, c.mean + (s.x-c.mean)/(s.i+1) AS mean, c.cum AS cum0, c.low AS low0,
      greatest(0, c.up+s.x-s.mu-s.k) AS up, least(0, c.dn+s.x-s.mu+s.k) AS dn, c.lp, c.lc FROM cp c JOIN cs s ON s.model = c.model AND s.i = c.i + 1)))))"""


@query("change_points", recursive(sql("""SELECT model, day, i AS row, x AS value, 'page_hinkley' AS method, ph AS statistic, th AS threshold FROM cp WHERE ph IS NOT NULL
    UNION ALL SELECT model, day, i, x, 'cusum', cu, h FROM cp WHERE cu IS NOT NULL""", *BASE, CP_SQL, r="value statistic threshold", day="day")))
def _(spark, d):
    daily = scored(spark, d).groupBy("model", F.to_date("start_ts").alias("day")).agg(F.avg("log_loss").alias("log_loss"))
    return Q.change_points(daily, ["model"], ["day"], "log_loss")


# ---- streaming ----------------------------------------------------------------------------------
def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/{name}.parq*")


def finish(spark, df):
    out = scratch(spark)
    J.tail(df, "", f"{out}/checkpoint", f"{out}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def in_parts(spark, df, parts: int = 4):
    """A stream of ``df`` from several files, dealt by hash and read one at a time: times come in no order."""
    at = f"{scratch(spark)}/parts"
    df.repartition(parts, F.xxhash64(*df.columns)).write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(at)


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("stream_prices", sql("""SELECT DISTINCT l_orderkey AS event_id, 'b' || (l_suppkey % 3) AS book, l_returnflag AS market, l_linestatus AS side, l_shipdate AS updated_at FROM lineitem""", ts="updated_at"))
def _(spark, d):
    """Prices from files in no order: those in time, and those set aside behind the watermark merged in."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.concat(F.lit("b"), F.col("l_suppkey") % 3).alias("book"), F.col("l_returnflag").alias("market"),
        F.col("l_linestatus").alias("side"), F.col("l_shipdate").cast("timestamp").alias("updated_at"))
    out = scratch(spark)
    J.ingest_whole(in_parts(spark, li), out, f"{out}/checkpoint", "700 days").awaitTermination()
    return J.with_late(spark, out, li.schema)


@query("stream_scored_latest", sql("SELECT event_id, model, forecast_id, log_loss, brier FROM sc", *BASE, r="log_loss brier"))
def _(spark, d):
    """Forecasts and results from files in no order; what the last revisions say equals the batch."""
    rocks(spark)
    f = named_forecasts(spark, d).where("source = 'live'").select("event_id", "model", "forecast_id", F.col("as_of").cast("timestamp").alias("as_of"), "prob")
    r = events(spark, d).where("home_win IS NOT NULL").select("event_id", F.col("final_ts").cast("timestamp").alias("final_ts"), "home_win")
    out = scratch(spark)
    rows = J.score_latest_stream(in_parts(spark, f), in_parts(spark, r))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
    rows.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).outputMode("update").foreachBatch(write).start().awaitTermination()
    return J.newest(spark.read.schema(rows.schema).parquet(f"{out}/rows")).select("event_id", "model", "forecast_id", "log_loss", "brier")


@query("stream_scores", sql("""WITH r AS (SELECT o_orderkey AS event_id, o_orderdate + INTERVAL 1 DAY AS final_ts, (o_totalprice > 250000)::INT AS home_win FROM orders),
    x AS (SELECT f.event_id, f.forecast_id, prob, home_win, greatest(least(prob, 1-1e-6), 1e-6) AS p FROM fc f JOIN r USING (event_id) WHERE as_of <= final_ts AND as_of >= final_ts - INTERVAL 400 DAY)
SELECT event_id, forecast_id, home_win, -(home_win*ln(p)+(1-home_win)*ln(1-p)) AS log_loss FROM x""", FORECASTS_SQL, r="log_loss"))
def _(spark, d):
    z = 0.06 * (F.col("l_quantity") - 25.5) * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0) + 8.0 * (F.col("l_discount") - 0.05)
    from augury.plans.roles import line_id
    pred = stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), line_id().alias("forecast_id"), F.col("l_shipdate").cast("timestamp").alias("as_of"),
                                               C.snap(1.0 / (1.0 + F.exp(-z)), 12).alias("prob"))
    res = stream(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("final_ts"),
                                            (F.col("o_totalprice") > 250000).cast("int").alias("home_win"))
    s = J.score_stream(pred, res, "1 day", "400 days")
    return finish(spark, s).select("event_id", "forecast_id", "home_win", "log_loss")


ALERT_SQL = """
da AS (SELECT event_type AS series, date_trunc('day', ts) AS ts, avg(value) AS x FROM events GROUP BY 1, 2 HAVING date_trunc('day', any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
db AS (SELECT *, row_number() OVER w - 1 AS i, avg(x) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean FROM da WINDOW w AS (PARTITION BY series ORDER BY ts)),
dc AS MATERIALIZED (SELECT db.*, target, spread FROM db JOIN (SELECT series, avg(x) AS target, greatest(stddev_pop(x), 0.05::DOUBLE) AS spread FROM db WHERE i < 20 GROUP BY series) USING (series)),
al AS (SELECT series, 19::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::DOUBLE AS x, 0::DOUBLE AS cum, 0::DOUBLE AS low, 0::DOUBLE AS up, 0::DOUBLE AS dn, -10::BIGINT AS lp, -10::BIGINT AS lc, NULL::DOUBLE AS ph, NULL::DOUBLE AS cu FROM dc GROUP BY series
  UNION ALL SELECT series, i, ts, x, CASE WHEN a1 THEN 0 ELSE cum END, CASE WHEN a1 THEN 0 ELSE low END, CASE WHEN a2 THEN 0 ELSE up END, CASE WHEN a2 THEN 0 ELSE dn END, CASE WHEN a1 THEN i ELSE lp END, CASE WHEN a2 THEN i ELSE lc END,
      CASE WHEN a1 THEN cum - low END, CASE WHEN a2 THEN greatest(up, dn) END FROM (
    SELECT *, cum - low > greatest(0.35::DOUBLE, 2.5::DOUBLE*spread) AND i - lp >= 10 AS a1, greatest(up, dn) > greatest(0.45::DOUBLE, 3.0::DOUBLE*spread) AND i - lc >= 10 AS a2 FROM (
      SELECT *, least(low0, cum) AS low FROM (SELECT s.series, s.i, s.ts, s.x, s.spread, a.low AS low0, a.lp, a.lc, a.cum + s.x - s.mean - greatest(0.01::DOUBLE, 0.05::DOUBLE*s.spread) AS cum,
        greatest(0, a.up + s.x - s.target - greatest(0.02::DOUBLE, 0.2::DOUBLE*s.spread)) AS up, greatest(0, a.dn + s.target - s.x - greatest(0.02::DOUBLE, 0.2::DOUBLE*s.spread)) AS dn
        FROM al a JOIN dc s ON s.series = a.series AND s.i = a.i + 1))))"""


@query("stream_alerts", recursive(sql("SELECT series, i AS row, ts, x AS value, ph AS page_hinkley, cu AS cusum FROM al WHERE ph IS NOT NULL OR cu IS NOT NULL", ALERT_SQL, r="value page_hinkley cusum", ts="ts")))
def _(spark, d):
    """Alerts of the daily mean value per kind of event, over the days that the watermark has closed."""
    rocks(spark)
    ev = stream(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return finish(spark, J.alert_stream(J.daily(ev)))
