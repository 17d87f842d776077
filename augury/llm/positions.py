"""Global order numbers of a table, without a window over it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from augury.session import cut_lineage


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted by ``order`` over its partitions, in the shared checkpoint folder, with ``name``, the place of each
    row from 0 in that order. Rows equal in ``order`` come in any order, and may lie in different partitions.

    One range exchange sorts, however hot a key is, as a row number breaks ties; then a row's place is its place in its
    partition and the rows of all partitions before, of which there is one number each (broadcast).
    """
    keys = [*order, F.col("__tie")]
    d = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = cut_lineage(d.drop("__tie")).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = d.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut_lineage(sizes.select("__part", before.alias("__start")))
    placed = d.withColumn("__own", part).join(F.broadcast(starts), F.col("__own") == F.col("__part"))
    return placed.select(*df.columns, (F.col("__start") + F.col("__at").bitwiseAND(2**33 - 1)).alias(name))
