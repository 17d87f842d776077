"""Approximate nearest neighbours: one robust-pruned graph per shard, beam search of every query on each."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from augury.llm.pruned_graph import PrunedGraph
from augury.session import cut_lineage


def usable(v: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _slim(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = rows.schema[vec_col].dataType.elementType
    kind = kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType()
    v = F.transform(F.col(vec_col).cast(T.ArrayType(kind)), lambda x: x + F.lit(0).cast(kind))  # no negative zeros
    return rows.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 8192, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> DataFrame:
    """One row per shard: ``dim``, ``shard`` and ``graph``, the vectors of the shard with their pruned graph.

    Every usable vector is indexed. Equal vectors are one point with its ``k`` smallest ids: no answer of ``k`` ids can
    hold another. They are found in the map tasks first, so one common vector is no hot task. Points are dealt to shards
    of about ``shard_rows`` by hash, so each shard looks like the whole and each build is bounded.
    """
    rows = _slim(vectors, id_col, vec_col)
    rank = F.dense_rank().over(W.partitionBy("vec").orderBy("id"))
    points = rows.withColumn("n", rank).where(F.col("n") <= k).groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    points = cut_lineage(points.select("vec", "ids", F.size("vec").alias("dim"), F.xxhash64("vec").alias("h")))
    sizes = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    placed = points.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod("h", "shards").cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("h")
        dim = group.column("dim")[0].as_py()
        ids = group.column("ids").combine_chunks()
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        g = PrunedGraph.build(_matrix(group.column("vec"), dim), ids.flatten().to_numpy(), starts, degree, beam, alpha)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": group.column("shard")[:1].cast(pa.int32()), "graph": pa.array([g.dumps()], pa.binary())})

    return cut_lineage(placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"))


def _search(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (dim, shard, block), each shard's graph before its queries: one graph in memory at a time."""
        graph = None
        for batch in batches:
            blobs = batch.column("graph")
            q1, q2 = (batch.column(c).to_numpy() for c in ("q1", "q2"))
            starts = np.flatnonzero(~np.asarray(blobs.is_null()))
            cuts, out = [0, *starts, len(q1)], ([], [], [], [])
            for lo, hi in zip(cuts, cuts[1:]):
                if lo in starts:
                    graph = PrunedGraph.loads(blobs[int(lo)].as_py())
                    lo += 1
                for at in range(lo, hi, 512):
                    block = slice(at, min(hi, at + 512))
                    v = _matrix(batch.column("vec")[block.start:block.stop], graph.x.shape[1])
                    for a, b, (ids, d) in zip(q1[block], q2[block], graph.search(v, k, beam)):
                        for col, x in zip(out, (np.full(len(ids), a), np.full(len(ids), b), ids, d)):
                            col.append(x)
            kinds = (np.int64, np.int64, np.int64, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, t)) for c, t in zip(out, kinds)], ["q1", "q2", "id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = 128, block_rows: int = 20_000) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance in double precision): of every
    usable query its ``k`` nearest ids found other than its own, ties to the smaller id; all, if there are fewer.

    ``index`` must hold ``k + 1`` ids of a point. Queries with equal vectors are searched once. Distinct query vectors
    meet every shard of their dimension in blocks of about ``block_rows``; each shard answers with its best ``k + 1``,
    so what is merged is in proportion to queries times shards, never to the rows.
    """
    q = _slim(queries, id_col, vec_col).withColumns({"q1": F.xxhash64("vec"), "q2": F.xxhash64(F.lit(1), "vec")})
    q = cut_lineage(q.distinct())
    points = q.dropDuplicates(["q1", "q2"]).withColumn("dim", F.size("vec"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("points") / block_rows)).cast("int")
    per_dim = points.groupBy("dim").agg(F.count(F.lit(1)).alias("points")).select("dim", blocks.alias("blocks"))
    shards = index.select("dim", "shard").join(F.broadcast(per_dim), "dim").groupBy("dim").agg(F.max("shard").alias("last"), F.max("blocks").alias("blocks"))
    kind = q.schema["vec"].dataType
    graphs = index.join(F.broadcast(per_dim), "dim").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph",
                                                            F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2"), F.array().cast(kind).alias("vec"))
    asked = points.join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"), F.pmod("q1", "blocks").cast("int").alias("block"),
                                                           F.lit(None).cast("binary").alias("graph"), "q1", "q2", "vec")
    both = graphs.unionByName(asked).repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", F.col("graph").isNull())
    found = both.select("graph", "q1", "q2", "vec").mapInArrow(_search(k + 1, beam), "q1 long, q2 long, id long, score double")
    best = W.partitionBy("q1", "q2").orderBy("score", "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    pairs = q.select(F.col("id").alias("query_id"), "q1", "q2").join(found, ["q1", "q2"]).where("query_id <> id")
    rank = F.row_number().over(W.partitionBy("query_id", "q1", "q2").orderBy("score", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **index) -> DataFrame:
    """Nearest neighbours of the rows of ``vectors`` where ``is_query`` holds among all rows.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part;
    vectors meet those of their own length only; rows that repeat id and vector count once; an empty table, or one
    vector alone, gives no rows; other columns are not read.
    """
    return search(build_index(vectors, k + 1, id_col, vec_col, **index), vectors.where(is_query), k, id_col, vec_col)
