"""Lines found in many documents, by a sharded minimal perfect hash that documents probe."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import masked, row_key, spare
from augury.llm.perfect_hash import PerfectHash
from augury.session import cut_lineage

MOST_SHARDS = 32768


def _keys(text: bytes, least: int) -> list[bytes]:
    """Digest of every line's key, empty for lines whose key is shorter than ``least`` code points."""
    h = xxhash.xxh3_128_digest
    return [h(k) if len(k := line.strip().lower()) >= least and (len(k) >= 4 * least or len(k.decode("utf-8", "replace")) >= least) else b"" for line in text.split(b"\n")]


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _distinct_keys(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Once per document and key: the row's key and the line key."""
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("__k1", "__k2"))
            found, of = [], []
            for i, text in enumerate(_texts(batch, "text")):
                own = set(_keys(text, least)) - {b""}
                found += own
                of.append(len(own))
            h, at = _pairs(found), np.repeat(np.arange(len(of)), of)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], h[:, 0], h[:, 1])], ["k1", "k2", "h1", "h2"])
    return run


def _build(group: pa.Table) -> pa.Table:
    cols = [group.column(c).to_numpy() for c in ("h1", "h2", "n")]
    index = PerfectHash.build(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2])
    return pa.table({"shard": group.column("shard")[:1].cast(pa.int32()), "copies": group.column("copies")[:1].cast(pa.int32()), "blob": pa.array([index.dumps()], pa.binary())})


def _probe(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (shard, copy), each shard's arrays before its probes: one shard's arrays in memory at a time."""
        index = None
        for batch in batches:
            blobs = batch.column("blob")
            k1, k2, h1, h2 = (batch.column(c).to_numpy() for c in ("k1", "k2", "h1", "h2"))
            starts = np.flatnonzero(~np.asarray(blobs.is_null()))
            cuts, hits = [0, *starts, len(k1)], []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo in starts:
                    index = PerfectHash.loads(blobs[int(lo)].as_py())
                    lo += 1
                if hi > lo:
                    n = index.count(h1[lo:hi].view(np.uint64), h2[lo:hi].view(np.uint64))
                    hits.append(lo + np.flatnonzero(n >= least_docs))
            at = np.concatenate(hits) if hits else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (k1, k2, h1)], ["k1", "k2", "h1"])
    return run


def _without(text: Column, drops: Column, least: int) -> Column:
    """The lines that stay, joined, and how many went; null where there is nothing to drop."""
    @F.arrow_udf("struct<kept:string,n:bigint>")
    def of(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kept, n = [], []
        for t, g in zip(texts.cast(pa.large_binary()).to_pylist(), gone.to_pylist()):
            if g is None:
                kept.append(None), n.append(0)
                continue
            t, g = t or b"", set(g)
            stay = [line for line, k in zip(t.split(b"\n"), _keys(t, least)) if not k or int.from_bytes(k[:8], "little", signed=True) not in g]
            kept.append(b"\n".join(stay).decode())
            n.append(t.count(b"\n") + 1 - len(stay))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n, pa.int64())], ["kept", "n"])
    return of(text, drops)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1,
                      shard_keys: int = 500_000, shard_probes: int = 2_000_000) -> DataFrame:
    """``docs`` with ``__kept_text``, ``__n_lines`` and ``__n_dropped`` as the last columns (where ``docs`` has a column of
    such a name, the new one ends in an underscore).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least ``least_chars`` code
    points found in at least ``least_docs`` rows lose all their lines. Null and empty texts are one empty line; empty
    keys never go unless ``least_chars`` is 0; a row that repeats counts as a document of its own; an empty table gives
    no rows; columns of ``docs`` keep their names and values. Keys are compared by 128-bit hashes.

    Method: counts per distinct key combine in the map tasks. Keys fall into shards of about ``shard_keys``; each shard
    becomes a minimal perfect hash over a fingerprint and a count array (about 7 bytes a key). Documents send the hashes
    of their lines, not the lines, to the shards, whose arrays are read once and probed as the rows stream by. A shard
    that common keys make hot is copied, once per ``shard_probes`` probes, and its probes are dealt among the copies.
    Only hits travel back; texts are joined to them by a key of the row's content.
    """
    spark = docs.sparkSession
    src = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("text"))
    probes = src.mapInArrow(_distinct_keys(least_chars), "k1 long, k2 long, h1 long, h2 long")
    counts = cut_lineage(probes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    shards = min(MOST_SHARDS, max(1, -(-counts.count() // shard_keys)))
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    sizes = counts.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("n") / shard_probes).cast("int").alias("copies"))  # MOST_SHARDS rows at most
    sizes = cut_lineage(sizes)
    keyed = counts.withColumn("shard", shard).join(F.broadcast(sizes), "shard")
    arrays = keyed.groupBy("shard").applyInArrow(_build, "shard int, copies int, blob binary")
    arrays = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "blob", *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "h1", "h2")])
    sent = probes.withColumn("shard", shard).join(F.broadcast(sizes), "shard").select(
        "shard", F.pmod("k1", "copies").cast("int").alias("copy"), F.lit(None).cast("binary").alias("blob"), "k1", "k2", "h1", "h2")
    both = arrays.unionByName(sent).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())
    hits = both.select("blob", "k1", "k2", "h1", "h2").mapInArrow(_probe(least_docs), "k1 long, k2 long, h1 long")
    drops = hits.groupBy("k1", "k2").agg(F.collect_set("h1").alias("__drops"))

    d, at = masked(docs)
    text = F.col(at[text_col])
    d = d.withColumns(dict(zip(("__k1", "__k2"), row_key(F.col(at[id_col]), text))))
    out = d.join(drops, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left")
    cut = _without(F.when(F.col("__drops").isNotNull(), text), F.col("__drops"), least_chars)
    whole = F.coalesce(text, F.lit(""))
    made = (F.coalesce("__cut.kept", whole), (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long"), F.coalesce("__cut.n", F.lit(0).cast("long")))
    names = spare(docs, "__kept_text", "__n_lines", "__n_dropped")
    return out.withColumn("__cut", cut).select(*[F.col(at[c]).alias(c) for c in docs.columns], *[c.alias(n) for c, n in zip(made, names)])
