"""Packing token sequences into padded batches with optimal length buckets."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import word_count
from augury.llm.prefix import row_numbers
from augury.session import cut_lineage


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in total, exact.

    ``lengths`` are distinct and ascending. Padding of a bucket over lengths i+1..j is length[j] * its rows - its tokens;
    best splits of ever longer prefixes move right only, so every layer of the dynamic program is found by halving.
    """
    n = len(lengths)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = lengths * rows[1:] - tokens[1:]  # one bucket for the first 1..n lengths
    splits = []
    for _ in range(min(buckets, n) - 1):
        new, at = best.copy(), np.zeros(n, np.int64)  # at: how many lengths lie before the last bucket
        todo = [(1, n - 1, 1, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)
            cost = best[i - 1] + lengths[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            k = int(np.argmin(cost))
            if cost[k] < best[j]:
                new[j], at[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, i[k]), (j + 1, hi, i[k], b)]
        splits.append(at)
        best = new
    bounds, j = [int(lengths[-1])], n - 1
    for at in reversed(splits):
        if at[j]:  # else fewer buckets are as good for this prefix
            j = int(at[j]) - 1
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def pieces(docs: DataFrame, id_col: str, tokens: Column, most_tokens: int) -> DataFrame:
    """One row per sequence: documents longer than ``most_tokens`` continue in further pieces; one without tokens is a
    piece of none."""
    d = docs.select(F.col(id_col).alias("id"), tokens.alias("n"))
    d = d.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0L) div {most_tokens})")))
    return d.select("id", "piece", (F.col("piece") * most_tokens).alias("first_token"), F.least(F.col("n") - F.col("piece") * most_tokens, F.lit(most_tokens)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = 16, most_tokens: int = 8192, budget: int = 65536) -> DataFrame:
    """The layout of all batches: ``doc_id``, ``piece``, ``first_token``, ``n_tokens``, ``bucket_tokens`` (the length that
    the sequence is padded to), ``batch`` (from 0 in its bucket), ``slot``, ``padding``.

    Tokens are words unless a column with their number is given. The histogram of piece lengths covers all rows and has
    at most ``most_tokens`` + 1 lengths, so the exact dynamic program over it runs on the driver. Inside a bucket the
    sequences lie in hash order and fill batches of ``budget`` div bucket_tokens rows (one at least); only a bucket's
    last batch may be short. Null and empty texts are pieces without tokens; rows that repeat an id are packed each;
    an empty table gives no rows; other columns are not read.
    """
    n = tokens.cast("long") if tokens is not None else word_count(F.col(text_col))
    seq = cut_lineage(pieces(docs, id_col, n, most_tokens))
    hist = sorted((r["n_tokens"], r["count"]) for r in seq.groupBy("n_tokens").count().collect())
    bounds = bucket_bounds(np.array([x for x, _ in hist], np.int64), np.array([c for _, c in hist], np.int64), buckets)
    if not bounds:
        bounds = [0]
    bound = F.element_at(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")), 1)
    seq = seq.withColumns({"bucket_tokens": bound, "key": F.xxhash64(F.lit("pack"), "id", "piece", "n_tokens")})
    seq = row_numbers(seq, ["bucket_tokens"], "key", "place")
    rows = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(bucket_tokens, 1L)"))
    seq = seq.withColumn("rows", rows)
    return seq.select(F.col("id").alias(id_col), "piece", "first_token", "n_tokens", "bucket_tokens", F.expr("place div rows").alias("batch"), F.expr("place % rows").alias("slot"),
                      (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))
