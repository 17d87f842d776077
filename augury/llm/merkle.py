"""A Merkle manifest of a table: one tree per group, a tree over their roots, and a proof of every row by pointer jumping."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.positions import in_order
from augury.session import cut_lineage

SEGMENT = "array<struct<before:array<binary>,after:array<binary>>>"
TOP = -1  # the tree over the roots of all groups


def record_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields of a row, each ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lower(F.hex(d))), "")


def proof_digest(proof: Column) -> Column:
    """Hex SHA-256 of all digests of a proof in order."""
    return F.sha2(F.aggregate(proof, F.lit(""), lambda s, x: F.concat(s, _joined(x["before"]), _joined(x["after"]))), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and its proof lead to: at every level the digest of the run with the leaf's in its place."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(_joined(x["before"]), h, _joined(x["after"])), 256))


def _height(n: Column, fan: int) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    steps = [fan**k for k in range(63) if fan**k < 2**62]
    return reduce(lambda a, b: a + b, [(n > F.lit(s)).cast("int") for s in steps])


def _runs(level: DataFrame, fan: int) -> DataFrame:
    """The parents of a level's nodes: each holds its ``kids``, ``fan`` at most, in order."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("i", "digest"))), lambda k: k["digest"])
    up = level.groupBy("t", "height", F.expr(f"i div {fan}").alias("i")).agg(kids.alias("kids"))
    return up.withColumn("digest", F.unhex(F.sha2(_joined(F.col("kids")), 256)))


def _raised(level: DataFrame, height: int, fan: int) -> list[DataFrame]:
    """All levels above ``level`` (``t``, ``height``, ``i``, ``digest``); a tree ends at its own height."""
    out = []
    for k in range(1, height + 1):
        level = cut_lineage(_runs(level.where(F.col("height") >= k), fan))
        out.append(level.select("t", F.lit(k).alias("l"), "i", "height", "digest", "kids"))
    return out


def _beside(kids: Column, at: Column) -> Column:
    """The segment of a node: the digests of its run to its left and right."""
    return F.struct(F.slice(kids, 1, at).alias("before"), F.slice(kids, at + 2, F.size(kids)).alias("after"))


def _ancestors(nodes: DataFrame, tops: int, steps: int, fan: int, most_broadcast: int) -> DataFrame:
    """Of every inner node (``t``, ``l``, ``i``) the proof (``path``) from it to the root of all.

    A node starts with its siblings as the segment to its parent. In each round it takes over what its ancestor holds: it
    puts the ancestor's segment behind its own and points where the ancestor points, twice as far. Nodes that point to a
    level of few nodes meet them by broadcast, as many of them share one; all others in a shuffled join.
    """
    last = F.col("l") == F.col("height")
    up = nodes.where(~(last & ((F.col("t") == TOP) | F.lit(tops == 1))))
    up = up.select("t", "l", "i", *[F.when(last, a).otherwise(b).alias(n) for n, a, b in (
        ("pt", F.lit(TOP).cast("long"), F.col("t")), ("pl", F.lit(1), F.col("l") + 1), ("pi", F.expr(f"t div {fan}"), F.expr(f"i div {fan}")),
        ("at", F.expr(f"int(t % {fan})"), F.expr(f"int(i % {fan})")))])
    sizes = {r["l"]: r["n"] for r in nodes.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per level
    small = [k for k in sizes if sum(n for x, n in sizes.items() if x >= k) <= most_broadcast]
    wide = F.col("pl") < F.lit(min(small, default=99))

    def meet(rows: DataFrame, others: DataFrame, join: str) -> DataFrame:
        key = [rows[a] == others[b] for a, b in (("pt", "ot"), ("pl", "ol"), ("pi", "oi"))]
        return rows.join(others, key, join)

    def both(rows: DataFrame, others: DataFrame, join: str) -> DataFrame:
        far = meet(rows.where(wide), others, join)
        return far if not small else far.unionByName(meet(rows.where(~wide), F.broadcast(others.where(F.col("ol") >= min(small))), join))

    named = [F.col(a).alias(b) for a, b in (("t", "ot"), ("l", "ol"), ("i", "oi"))]
    first = both(up, nodes.select(*named, "kids"), "inner")
    held = cut_lineage(first.select("t", "l", "i", "pt", "pl", "pi", F.array(_beside(F.col("kids"), F.col("at"))).cast(SEGMENT).alias("path")))
    for _ in range(max(0, (steps - 1).bit_length())):
        theirs = held.select(*named, *[F.col(c).alias(f"n{c}") for c in ("pt", "pl", "pi", "path")])
        met = both(held, theirs, "left")
        held = cut_lineage(met.select("t", "l", "i", *[F.coalesce(f"n{c}", c).alias(c) for c in ("pt", "pl", "pi")], F.concat("path", F.coalesce("npath", F.array().cast(SEGMENT))).alias("path")))
    return held.select("t", "l", "i", "path")


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
             altered: dict[str, Column] | None = None, where: Column | None = None, fan: int = 8, most_broadcast: int = 4096) -> DataFrame:
    """One row per row of ``docs``: its id, group, ``leaf``, ``subroot``, ``root`` (hex), ``proof`` and ``folded``.

    A leaf is the digest of the row's ``fields``. Per group, leaves ascend by id; while several nodes remain, every
    ``fan`` consecutive ones (the last run may be shorter, even one) become the digest of their hex digests. The roots of
    the groups, ordered by group (null first), give the root in the same way. ``proof`` lists, level by level from leaf
    to root, the other nodes of the run left and right. ``folded`` is the root recomputed from the proof and the leaf, or
    from the leaf of the row with ``altered`` columns (name to expression) where ``where`` holds.

    Null ids come last, rows of one id in order of their leaves; equal rows are leaves each. Null and empty texts differ.
    An empty table gives no rows; other columns, whatever their names, are not read. Only digests are shuffled: a leaf
    meets the run above it, ``fan`` leaves a key, and inner nodes, a ``fan``-th of all, collect proofs by pointer jumping.
    """
    cols = [F.col(f) for f in fields]
    forged = record_digest([(altered or {}).get(f, F.col(f)) for f in fields])
    base = docs.select(F.col(group_col).alias("g"), F.col(id_col).alias("id"), F.unhex(record_digest(cols)).alias("leaf"),
                       F.unhex(F.when(F.coalesce(F.lit(False) if where is None else where, F.lit(False)), forged)).alias("forged"))
    rows = in_order(cut_lineage(base), [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_last(), F.col("leaf")], "at")
    groups = rows.groupBy("g").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    trees = in_order(groups.select("g", "start", _height(F.col("n"), fan).alias("height")), [F.col("start")], "t")
    trees = cut_lineage(trees)
    found = trees.agg(F.count(F.lit(1)).alias("tops"), F.max("height").alias("height")).first()
    tops, height = found["tops"], found["height"] or 0
    of = trees.select(F.col("g").alias("og"), "t", "start", "height")
    leaves = rows.join(F.broadcast(of) if tops <= most_broadcast else of, F.col("g").eqNullSafe(F.col("og")))
    leaves = leaves.select("g", "id", "leaf", "forged", "t", "height", (F.col("at") - F.col("start")).alias("i"))

    levels = _raised(leaves.select("t", "height", "i", F.col("leaf").alias("digest")), height, fan)
    subroots = leaves.where("height = 0").select("t", F.col("leaf").alias("digest"))
    subroots = reduce(DataFrame.unionByName, [x.where("l = height").select("t", "digest") for x in levels], subroots)
    subroots = cut_lineage(subroots)
    top_height = next(k for k in range(64) if fan**k >= tops)
    above = _raised(subroots.select(F.lit(TOP).cast("long").alias("t"), F.lit(top_height).alias("height"), F.col("t").alias("i"), "digest"), top_height, fan)
    root = above[-1].select(F.col("digest").alias("root")) if above else subroots.select(F.col("digest").alias("root"))

    out = leaves.join(F.broadcast(subroots.select(F.col("t").alias("st"), F.col("digest").alias("subroot"))) if tops <= most_broadcast else
                      subroots.select(F.col("t").alias("st"), F.col("digest").alias("subroot")), F.col("t") == F.col("st")).crossJoin(F.broadcast(root))
    nodes = [*levels, *above]
    if nodes:
        nodes = reduce(DataFrame.unionByName, nodes)
        paths = _ancestors(nodes, tops, height + top_height, fan, most_broadcast)
        runs = nodes.where(F.col("l") == 1).join(paths, ["t", "l", "i"], "left").select(F.col("t").alias("rt"), F.col("i").alias("ri"), "kids", "path")
        alone = F.col("height") == 0
        out = out.withColumns({"pt": F.when(alone, F.lit(TOP)).otherwise(F.col("t")), "pi": F.when(alone, F.expr(f"t div {fan}")).otherwise(F.expr(f"i div {fan}")),
                               "place": F.when(alone, F.expr(f"int(t % {fan})")).otherwise(F.expr(f"int(i % {fan})"))})
        out = out.join(runs, (F.col("pt") == F.col("rt")) & (F.col("pi") == F.col("ri")), "left")
        own = F.when(F.col("kids").isNotNull(), F.array(_beside(F.col("kids"), F.col("place"))).cast(SEGMENT)).otherwise(F.array().cast(SEGMENT))
        proof = F.concat(own, F.coalesce("path", F.array().cast(SEGMENT)))
    else:
        proof = F.array().cast(SEGMENT)
    shown = lambda c: F.lower(F.hex(c))
    out = out.withColumn("proof", proof)
    return out.select(F.col("id").alias(id_col), F.col("g").alias(group_col), *[shown(c).alias(c) for c in ("leaf", "subroot", "root")], "proof",
                      fold(shown(F.coalesce("forged", "leaf")), F.col("proof")).alias("folded"))
