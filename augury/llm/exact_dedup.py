"""Exact copies by a heavy-hitter split, in DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from augury.llm.common import squeeze
from augury.session import cut_lineage

BUCKETS = 64


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 1 / 2000, tracked: int = 16384) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their SHA-256 without white space is. Of equal texts the one with the most code points stays,
    then the smallest id (null ids last). Null text counts as empty; repeated rows are rows of their own, of which one
    stays; an empty table gives no rows; other columns, whatever their names, are not read.

    Method: a Misra-Gries sketch (Spark's ``approx_top_k``) per bucket of map tasks names every digest that holds
    ``share`` of the rows: such a digest is as frequent in at least one bucket. An exact, map-side combined count
    verifies them, so at most ``1 / share`` winners are broadcast and their rows never shuffle. Each other digest holds
    fewer rows than that, and is ranked in an ordinary shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"),
                       F.unhex(F.sha2(squeeze(F.col(text_col)), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    base = cut_lineage(base)
    order = [F.col("n").desc(), F.col("id").isNull(), F.col("id"), F.col("row")]
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))

    bucket = F.pmod(F.shiftright("row", 33), F.lit(BUCKETS))
    seen = base.groupBy(bucket.alias("bucket")).agg(F.expr(f"approx_top_k(hex(digest), {tracked // 4}, {tracked})").alias("top"), F.count(F.lit(1)).alias("rows"))
    # Estimates never lie below the count, so a digest with the share of a bucket is listed there: about BUCKETS / share
    # digests at most.
    named = seen.select("rows", F.explode("top").alias("t")).where(F.col("t.count") >= F.greatest(F.lit(2), F.lit(share) * F.col("rows")))
    named = named.select(F.unhex("t.item").alias("digest")).distinct()
    need = F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("rows")))
    total = base.agg(F.count(F.lit(1)).alias("rows"))
    heavy = (base.join(F.broadcast(named), "digest").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(best).alias("best"))
             .crossJoin(F.broadcast(total)).where(F.col("size") >= need)
             .select("digest", "size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")))
    heavy = cut_lineage(heavy)

    marked = base.join(F.broadcast(heavy), "digest", "left")
    hot = marked.where("size IS NOT NULL")
    group = W.partitionBy("digest")
    first = group.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cold = marked.where("size IS NULL").withColumns({
        "size": F.count(F.lit(1)).over(group), "keep_id": F.first("id").over(first), "keep_row": F.first("row").over(first)})
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
