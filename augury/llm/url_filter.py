"""URL filters by a temporal join of captures with the list entries active when they were fetched."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from augury.llm.common import masked, spare


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without user, port and closing dot) and path of an address; empty where there is none."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return host, F.when(path == "", F.lit("/")).otherwise(path)


def url_keys(url: Column) -> Column:
    """All list patterns that can match an address: its host and every parent domain, each alone and with every
    beginning of its path up to a slash. An address without host has none. Bounded by the address's own length."""
    host, path = url_parts(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/")
    fronts = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))))
    keys = F.flatten(F.transform(domains, lambda d: F.transform(fronts, lambda f: F.concat(d, f))))
    return F.when(host != "", F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame, pattern: str = "pattern", action: str = "action", day: str = "day", listed: str = "list") -> DataFrame:
    """Dated entries as intervals: ``pattern``, ``list``, ``verdict`` (the action, such as block or allow), ``start``
    (included), ``end`` (excluded; null is open). The entry of a day ends the one before it on the same pattern and list,
    and the action ``remove`` only ends. Of several on one day the last action in code-point order counts. Entries
    without pattern, action or day say nothing."""
    e = entries.select(F.col(pattern).alias("pattern"), F.col(listed).alias("list"), F.col(action).alias("verdict"), F.col(day).cast("date").alias("start"))
    e = e.where("pattern IS NOT NULL AND verdict IS NOT NULL AND start IS NOT NULL").groupBy("pattern", "list", "start").agg(F.max("verdict").alias("verdict"))
    e = e.withColumn("end", F.lead("start").over(W.partitionBy("pattern", "list").orderBy("start")))
    return e.where("verdict <> 'remove'").select("pattern", "list", "verdict", "start", "end")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched", cell_days: int = 64) -> DataFrame:
    """``captures`` with ``__verdict`` (block, allow or null), ``__pattern`` and ``__list`` of the entry that decides: of
    those active on the capture's day that match its address, the longest pattern, then verdict, then list, in order.

    A pattern is a domain (which covers its subdomains) or a domain with a path front that ends in a slash. The as-of
    join is an equality join on pattern and time cell: an interval is listed in each cell of ``cell_days`` days that it
    touches up to the last capture, so a capture meets at most the entries that change in its own cell, and a hot host
    is split by time and by Spark's skew join. Matches are reduced in the map tasks to one per capture, keyed by
    address and day: captures of one address on one day get one answer. Null addresses and days match nothing; rows
    that repeat stay; an empty list decides nothing; columns of ``captures`` keep names and values,
    and a new one whose name is taken ends in an underscore.
    """
    keyed = captures.select(F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day")).where("url IS NOT NULL AND day IS NOT NULL").distinct()
    cell = lambda d: F.floor(F.unix_date(d) / cell_days).cast("int")
    last = keyed.agg(F.max("day").alias("last"))
    spans = validity(entries).crossJoin(F.broadcast(last)).where("start <= last").withColumn("end", F.least(F.coalesce("end", F.date_add("last", 1)), F.date_add("last", 1)))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.date_sub("end", 1))))).drop("last")
    asked = keyed.select("url", "day", cell(F.col("day")).alias("cell"), F.explode(url_keys(F.col("url"))).alias("pattern"))
    hit = asked.join(spans, ["pattern", "cell"]).where("start <= day AND day < end")
    rank = F.row_number().over(W.partitionBy("url", "day").orderBy(F.length("pattern").desc(), "pattern", "verdict", F.col("list").asc_nulls_last()))
    best = hit.withColumn("n", rank).where("n = 1").select(F.col("url").alias("__url"), F.col("day").alias("__day"), F.col("verdict").alias("__verdict"), F.col("pattern").alias("__pattern"), F.col("list").alias("__list"))
    d, at = masked(captures)
    out = d.join(best, (F.col(at[url_col]) == F.col("__url")) & (F.col(at[day_col]).cast("date") == F.col("__day")), "left")
    made = ("__verdict", "__pattern", "__list")
    return out.select(*[F.col(at[c]).alias(c) for c in captures.columns], *[F.col(c).alias(n) for c, n in zip(made, spare(captures, *made))])
