"""Near copies by SimHash: deletion variants of two half fingerprints, equality joins, verification."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.components import components
from augury.session import cut_lineage

_STEP = 1 << 16


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words in lower case; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words)))
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    h = xxhash.xxh64_intdigest
    starts = [0, *(e + i + 1 for i, e in enumerate(ends[:n - 1]))]
    return np.fromiter((h(joined[a:b + i], 42) for i, (a, b) in enumerate(zip(starts, ends[last:]), last)), np.uint64, n)


def simhash(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if more than half of the shingles' XXH64 (seed 42) have it."""
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):  # bounded memory for texts of any length
        bits = np.unpackbits(hashes[at:at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """``simhash`` of a text column as a long; null and wordless texts give zero."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(x, width) if x else 0 for x in texts.cast(pa.large_binary()).to_pylist()], pa.int64())
    return of(text)


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links among ``fps`` connect: each member to the smallest it reaches."""
    u = fps.view(np.uint64)  # numpy counts the bits of a signed number's absolute value
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= bits
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(len(fps)))
    return fps[at], fps[label[at]]


def _verified(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by task; a task holds two blocks at most, so a carried rest is small."""
        rest_t, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def solve(t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            cuts = np.flatnonzero(np.diff(t)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(t)]):
                if hi - lo == 2:
                    x, y = int(f[lo]), int(f[lo + 1])
                    if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= bits:
                        a.append([x]), b.append([y])
                elif hi - lo > 2:
                    x, y = _forest(f[lo:hi], bits)
                    a.append(x), b.append(y)
            cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64))
            return pa.RecordBatch.from_arrays([cat(a), cat(b)], ["a", "b"])

        for batch in batches:
            t = np.concatenate([rest_t, batch.column("task").to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            yield solve(t[:cut], f[:cut])
            rest_t, rest_f = t[cut:], f[cut:]
        if len(rest_t):
            yield solve(rest_t, rest_f)
    return run


def links(fps: DataFrame, bits: int = 3, block: int = 512) -> DataFrame:
    """Edges (``a``, ``b``) over the distinct fingerprints of ``fps`` (column ``fp``) that connect exactly what pairs
    with ``bits`` or fewer differing bits connect. ``bits`` is at most 3.

    A fingerprint is cut into two halves, so one half of a linked pair differs by at most one bit. Index: every distinct
    half value with each of its 32 bits as a wildcard; an equality group of a variant holds at most two values, the one
    with the bit and the one without, so no group can be hot. Candidates are the fingerprints of one half value, or of
    two values that a variant ties. Half values with many fingerprints are cut into blocks by hash; each pair of blocks
    is a task that verifies whole fingerprints and emits a spanning forest, never all pairs.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves find links of at most 3 bits")
    half = lambda side: F.when(F.lit(side) == 0, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    members = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), half(s).alias("seg")) for s in (0, 1)])).alias("x")).select("fp", "x.side", "x.seg")
    segs = cut_lineage(members.groupBy("side", "seg").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))

    p = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p")
    var = segs.select("side", "seg", p)
    bit = F.expr("shiftleft(1L, p)")
    key = F.col("seg").bitwiseAND(F.bitwise_not(bit)) + F.expr("shiftleft(CAST(p AS BIGINT), 32) + shiftleft(CAST(side AS BIGINT), 40)")
    var = var.select(key.alias("key"), F.when(F.col("seg").bitwiseAND(bit) == 0, 1).otherwise(2).alias("has"))
    tied = var.groupBy("key").agg(F.bit_or("has").alias("has")).where("has = 3")
    low = F.col("key").bitwiseAND(0xFFFFFFFF)
    tied = tied.select(F.expr("CAST(shiftright(key, 40) AS INT)").alias("side"), low.alias("s0"), (low + F.expr("shiftleft(1L, CAST(shiftright(key, 32) & 31 AS INT))")).alias("s1"))

    size = lambda name, n: segs.select("side", F.col("seg").alias(name), F.col("blocks").alias(n))
    cross = tied.join(size("s0", "n0"), ["side", "s0"]).join(size("s1", "n1"), ["side", "s1"])
    own = segs.where("n > 1").select("side", F.col("seg").alias("s0"), F.col("seg").alias("s1"), F.col("blocks").alias("n0"), F.col("blocks").alias("n1"))
    pairs = cross.select("side", "s0", "s1", "n0", "n1").union(own.select("side", "s0", "s1", "n0", "n1"))
    pairs = pairs.withColumn("b0", F.explode(F.expr("sequence(0, n0 - 1)"))).withColumn("b1", F.explode(F.expr("sequence(0, n1 - 1)"))).where("s0 <> s1 OR b0 <= b1")
    task = F.xxhash64("side", "s0", "b0", "s1", "b1").alias("task")
    need = pairs.select(task, "side", F.explode(F.array(F.struct(F.col("s0").alias("seg"), F.col("b0").alias("b"), F.col("n0").alias("n")), F.struct(F.col("s1").alias("seg"), F.col("b1").alias("b"), F.col("n1").alias("n")))).alias("x"))
    need = need.select("task", "side", "x.seg", "x.b", "x.n").distinct()
    placed = members.join(segs.select("side", "seg", "blocks"), ["side", "seg"]).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = need.join(placed, ["side", "seg", "b"]).select("task", "fp")
    rows = rows.repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(_verified(bits), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3, block: int = 512) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long) and ``component_id``, the smallest id reachable over
    links of ``bits`` or fewer differing bits.

    Null, empty and wordless texts have fingerprint zero and link like any other. Rows with equal fingerprints are one
    node whatever their number; null ids never name a component unless all its ids are null; an empty table gives no
    rows; other columns are not read. Fingerprints are written once to the shared checkpoint folder.
    """
    base = cut_lineage(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")))
    nodes = cut_lineage(base.groupBy("fp").agg(F.min("id").alias("low")))
    roots = components(links(nodes.select("fp"), bits, block))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(least, "root").select(F.col("fp").alias("node"), "component_id")
    return base.join(named, base["fp"] == named["node"]).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id names their group: one document of each group stays. Rows that repeat an id
    repeat it in the result only as often as they are in ``docs``; groups without any id keep all their rows."""
    marked = near_copies(docs, id_col, text_col, width, bits)
    gone = marked.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
