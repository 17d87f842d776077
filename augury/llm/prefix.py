"""Distributed row numbers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def row_numbers(df: DataFrame, group: list[str], key: str, name: str, per_range: int = 100_000) -> DataFrame:
    """``df`` with ``name``, the place from 0 of every row in its ``group`` in order of ``key``, a hash-random long (rows
    with equal keys in any order).

    Ranges of the key hold about ``per_range`` rows each, however large a group is: a group has as many even ranges as
    its row count asks for, rows are numbered within (group, range), and a running sum of the few range counts is added.
    """
    sizes = df.groupBy(*[F.col(g).alias(f"__s_{g}") for g in group]).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_range)).cast("int").alias("__ranges"))
    same = lambda mark: [F.col(g).eqNullSafe(F.col(f"__{mark}_{g}")) for g in group]
    share = (F.col(key).cast("double") + float(2**63)) / float(2**64)
    d = df.join(sizes, same("s")).select(*df.columns, F.least(F.floor(share * F.col("__ranges")), F.col("__ranges") - 1).cast("int").alias("__range"))
    counts = d.groupBy(*[F.col(g).alias(f"__c_{g}") for g in group], F.col("__range").alias("__c_range")).agg(F.count(F.lit(1)).alias("__n"))
    running = W.partitionBy(*[f"__c_{g}" for g in group]).orderBy("__c_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = counts.withColumn("__before", F.sum("__n").over(running) - F.col("__n"))
    local = d.withColumn(name, F.row_number().over(W.partitionBy(*group, "__range").orderBy(key)).cast("long"))
    out = local.join(before, [*same("c"), F.col("__range") == F.col("__c_range")])
    return out.select(*df.columns, (F.col(name) - 1 + F.col("__before")).alias(name))
