"""Mixing sources to target weights, in DataFrame functions only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from augury.llm.common import BLANKS, WORD, masked, spare, word_count
from augury.session import cut_lineage


def _targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of a table with one row per source: weights by rank, shares of ``share`` of all words, none above
    ``most`` times its source; the excess is shared out again by weight.

    The sources that end at their ceiling are those with the smallest ceiling per weight, so one ordered pass finds
    them: a source is free when the level that all later ones would share lies below its own ceiling.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    up = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    s = sources.withColumns({"rank": rank, "weight": weight, "cap": F.lit(float(most)) * F.col("source_size")})
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
                       "goal": F.lit(float(share)) * F.sum("source_size").over(every), "heft": F.sum("weight").over(every)})
    s = s.withColumn("level", (F.col("goal") - F.col("capped")) / (F.col("heft") - F.col("used")))
    s = s.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("shared", F.max(F.when(F.col("free"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("free"), F.col("weight") * F.col("shared")).otherwise(F.col("cap")).alias("target"))


def order_key(id_: Column, seed: str) -> Column:
    """Hash-random order of a document, the same in every run; null ids share one key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
             share: float = 1.5, most: float = 2.0, seed: str = "mix", digits: int = 4) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``epochs`` (whole passes over the source) and the
    place where the last, partial pass ends: ``cut_key``, with ``cut_words`` of the ``cut_size`` words at that key.

    Range-sort and prefix sums run in two levels. Keys are hash-random, so their first ``digits`` hexadecimal digits are
    even ranges of every source; the words of each (source, range) add up in the map tasks, and a running sum over the
    ranges of a source finds the one with the cut. Only that range of each source is sorted by whole key.
    """
    base = docs.select(F.col(source_col).alias("source"), order_key(F.col(id_col), seed).alias("key"), word_count(F.col(text_col)).alias("size"))
    base = cut_lineage(base.withColumn("range", F.substring("key", 1, digits)))
    ranges = base.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ranges = cut_lineage(ranges)
    plan = _targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    plan = cut_lineage(plan)

    running = F.sum("words").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    r = ranges.withColumn("upto", running)
    cut = r.join(plan.select("source", "rest"), same(r, plan)).select(r["source"], "range", (F.col("upto") - F.col("words")).alias("before"), "upto", "rest")
    cut = cut.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    rows = base.join(cut, same(base, cut) & (base["range"] == cut["range"])).groupBy(base["source"].alias("source"), "key", "before", "rest").agg(F.sum("size").alias("words"))
    rows = rows.withColumn("upto", F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = rows.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    found = found.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("upto") + F.col("words")).alias("cut_words"), F.col("words").alias("cut_size"))
    out = plan.join(found, plan["source"].eqNullSafe(found["cut_source"]), "left").drop("cut_source", "rest")
    return cut_lineage(out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
        share: float = 1.5, most: float = 2.0, seed: str = "mix", most_broadcast: int = 50_000) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__taken``, the words the mix takes of each row, as the
    last four columns (where ``docs`` has a column of such a name, the new one ends in an underscore).

    Every source is taken ``epochs`` times whole, then in hash order until its exact budget, the whole part of its
    target, is spent: the document at the cut gives its first words only. A null text has no words; null is a source
    of its own, last in order; rows that repeat an id share what their key may still give in proportion to their sizes;
    an empty table gives no rows. Columns of ``docs`` keep their names and values, whatever those are.

    A row needs only its own key and its source's row of the plan to know its share. The plan is broadcast while it has
    ``most_broadcast`` sources or fewer, so that texts are not shuffled; beyond that it is joined by shuffle.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    small = plan.count() <= most_broadcast
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    d, at = masked(docs)
    d = d.withColumns({"__key": order_key(F.col(at[id_col]), seed), "__size": word_count(F.col(at[text_col]))})
    d = d.join(F.broadcast(plan) if small else plan, F.col(at[source_col]).eqNullSafe(F.col("__source")), "left")
    part = F.when(F.col("__key") < F.col("__cut_key"), F.col("__size")).when(
        F.col("__key") == F.col("__cut_key"), F.expr("__cut_words * __size div greatest(__cut_size, 1)")).otherwise(0)
    d = d.withColumn("__taken", F.col("__epochs") * F.col("__size") + part)
    made = ("__size", "__source_size", "__target", "__taken")
    return d.select(*[F.col(at[c]).alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(made, spare(docs, *made))])


def take(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``mix`` (whose last columns tell what is taken) as the mix delivers them: a document once per pass; of a
    partial pass, the words it takes with the white space before them."""
    d, at = masked(mixed)
    size, taken, text = F.col(at[mixed.columns[-4]]), F.col(at[mixed.columns[-1]]), F.col(at[text_col])
    d = d.withColumns({"__whole": F.floor(taken / F.greatest(size, F.lit(1))), "__part": (taken % F.greatest(size, F.lit(1))).cast("int")})
    copies = F.when(taken > 0, F.sequence(F.lit(1).cast("long"), F.col("__whole") + F.when(F.col("__part") > 0, 1).otherwise(0))).otherwise(F.array().cast("array<bigint>"))
    rows = d.withColumn("__pass", F.explode(copies))
    pieces = F.regexp_extract_all(text, F.lit(f"[{BLANKS}]*{WORD}"), F.lit(0))
    out = F.when(F.col("__pass") <= F.col("__whole"), text).otherwise(F.array_join(F.slice(pieces, 1, F.greatest(F.col("__part"), F.lit(1))), ""))
    return rows.select(*[(out if c == text_col else F.col(at[c])).alias(c) for c in mixed.columns])
