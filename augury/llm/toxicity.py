"""Toxicity by non-negative positive-unlabelled learning in numpy."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from augury.llm.common import masked, spare
from augury.session import cut_lineage

_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
TIMES = (1, 2, 3)
SHARES = (0.005, 0.01, 0.015)
LEVELS = len(TIMES) + len(SHARES)


def _marks_of(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) > k)] if len(word) >= 3 else []


class _Known(dict):
    """Words seen so far with their marks, all or those that ``used`` holds; forgets them when it grows large."""

    def __init__(self, used=None):
        super().__init__()
        self.used = used

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 60_000:
            self.clear()
        got = self[word] = [m for m in _marks_of(word) if self.used is None or m in self.used]
        return got


def marks(text: str, known: _Known) -> dict[str, tuple[int, int]]:
    """Of each word and word beginning in the whole text, in lower case: how many of ``TIMES`` its count reaches, and
    how many of ``SHARES`` its share of all words."""
    words = Counter(_WORDS.findall(text.lower()))
    total, out = words.total(), {}
    for w, n in words.items():
        for m in known[w]:
            out[m] = out.get(m, 0) + n
    return {m: (sum(n >= t for t in TIMES), sum(n >= x * total for x in SHARES)) for m, n in out.items()}


def _levels(of: tuple[int, int]) -> list[int]:
    return [*range(of[0]), *range(len(TIMES), len(TIMES) + of[1])]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a mark at a level, among positives and unlabelled ones, added up per 256 texts: most marks are rare, so
    larger steps would hold far more and save few rows."""
    known = _Known()
    for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
        seen = {0: Counter(), 1: Counter()}
        for t, y in zip(batch.column("text").to_pylist(), batch.column("positive").to_pylist()):
            seen[y].update(marks(t or "", known).items())
        both = list(seen[0].keys() | seen[1].keys())
        cols = [[m for m, _ in both], [x[0] for _, x in both], [x[1] for _, x in both], [seen[1][k] for k in both], [seen[0][k] for k in both]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["mark", "times", "shares", "p", "u"])


def _places(place: dict[tuple[str, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known({m for m, _ in place})
        for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
            x = [[place[m, k] for m, of in marks(t or "", known).items() for k in _levels(of) if (m, k) in place] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("positive"), pa.array(x, pa.list_(pa.int32()))], ["row", "positive", "x"])
    return run


def nnpu(x: list[np.ndarray], positive: np.ndarray, size: int, prior: float, steps: int, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk: prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),
    logistic loss, Adam. Where the estimate of the negative part falls below zero the step goes against it alone."""
    at = np.concatenate(x) if x else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    p, u = positive.astype(bool), ~positive.astype(bool)
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[at], len(x)) + b
        s = 0.5 * (1 + np.tanh(z / 2))
        negative = np.where(u, 1 / n_u, -prior / n_p)  # weights of the negative loss log(1 + exp(z))
        risk = float((negative * np.logaddexp(0, z)).sum())
        g = negative * s if risk >= 0 else -negative * s
        if risk >= 0:
            g = g + np.where(p, prior / n_p * (s - 1), 0.0)
        gw, gb = np.bincount(at, g[row], size) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, float(b)


def _fit(size: int, prior: float, steps: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        part = rows.column("part")[0].as_py()
        x = [np.asarray(i, np.int64) for i in rows.column("x").to_pylist()]
        w, b = nnpu(x, rows.column("positive").to_numpy(), size, prior, steps)
        return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([w.tolist()], pa.list_(pa.float64())), "bias": pa.array([b], pa.float64())})
    return run


def train(docs: DataFrame, positives: Column, prior: float, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 6000, most_unlabelled: int = 16000,
          parts: int = 4, most_features: int = 4000, least_docs: int = 4, steps: int = 400) -> tuple[dict[tuple[str, int], float], float]:
    """The model: (mark, level) -> weight, and a bias; the mean of ``parts`` classifiers.

    Positive rows are those of ``docs`` where ``positives`` holds, the unlabelled sample is drawn from all rows. Both are
    bounded samples: rows whose hashed id lies under the bound that gives ``most_positive`` and ``most_unlabelled`` rows
    (as expected numbers), or all, so a rerun draws the same. Each classifier sees all sampled positives and its own
    share of the unlabelled rows in one task. Features are (mark, level) pairs found in ``least_docs`` positives or more
    whose share there is over three times that among what the unlabelled rows leave for negatives; the ``most_features``
    with the largest gain are used.
    """
    slim = docs.select(F.xxhash64(F.lit("toxicity"), F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), F.coalesce(positives, F.lit(False)).cast("int").alias("y"))
    n = slim.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("u")).first()
    drawn = lambda most, of: F.lit(True) if of <= most else F.col("h") < int(-2**63 + 2**64 * most / of)
    p = slim.where((F.col("y") == 1) & drawn(most_positive, n["p"] or 0)).select("text", F.lit(1).alias("positive"), "h")
    u = slim.where(drawn(most_unlabelled, n["u"])).select("text", F.lit(0).alias("positive"), "h")
    sample = p.unionByName(u).select(F.xxhash64("h", "text", "positive").alias("row"), "positive", "text")
    sample = cut_lineage(sample.repartition(parts * 6, "row"))
    count = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    nothing = {}, float(np.log(prior / (1 - prior)))
    if not count.get(1) or not count.get(0):
        return nothing
    tally = sample.select("text", "positive").mapInArrow(_tally, "mark string, times int, shares int, p long, u long")
    tally = tally.groupBy("mark", "times", "shares").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    reached = F.expr(f"concat(sequence(0, times - 1), CASE WHEN shares > 0 THEN sequence({len(TIMES)}, {len(TIMES)} + shares - 1) ELSE array() END)")
    stats = tally.withColumn("level", F.explode(reached)).groupBy("mark", "level").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least_docs)
    rp, ru = (F.col("p") + 0.5) / (count[1] + 1), (F.col("u") + 0.5) / (count[0] + 1)
    rn = F.greatest((ru - prior * rp) / (1 - prior), F.lit(0.5 / count[0]))
    chosen = stats.withColumn("gain", rp * F.log(rp / rn)).where(rp > 3 * rn).orderBy(F.desc("gain"), "mark", "level").limit(most_features).collect()
    names = sorted((r["mark"], r["level"]) for r in chosen)
    if not names:
        return nothing
    x = sample.mapInArrow(_places({k: i for i, k in enumerate(names)}), "row long, positive int, x array<int>")
    part = F.when(F.col("positive") == 1, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.pmod("row", F.lit(parts)).cast("int")))
    fits = x.withColumn("part", F.explode(part)).groupBy("part").applyInArrow(_fit(len(names), prior, steps), "part int, weights array<double>, bias double").orderBy("part").collect()
    w, b = np.mean([f["weights"] for f in fits], axis=0), float(np.mean([f["bias"] for f in fits]))
    return {k: float(v) for k, v in zip(names, w) if abs(v) > 1e-6}, b


def score(text: Column, model: tuple[dict[tuple[str, int], float], float]) -> Column:
    """Probability that a text is toxic, from the whole text; null and empty texts give the bias alone."""
    weights, bias = model
    by: dict[str, list[float]] = {}
    for (m, k), w in weights.items():
        by.setdefault(m, [0.0] * LEVELS)[k] = w
    known: list = []

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        if not known:
            known.append(_Known(by))
        z = [bias + (sum(sum(by[m][k] for k in _levels(got)) for m, got in marks(t, known[0]).items()) if t else 0.0) for t in texts.to_pylist()]
        return pa.array(0.5 * (1 + np.tanh(np.array(z, float) / 2)))
    return of(text)


def held_out(id_: Column, folds: int = 5) -> Column:
    """Rows whose label is never learnt from: crc32 of the id as text divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, **fit) -> DataFrame:
    """``docs`` with ``__held_out``, ``__score`` and ``__predicted`` (1 if the score is 0.5 or more) as the last columns (where
    ``docs`` has a column of such a name, the new one ends in an underscore).

    Labels of held-out ids are not read. The class prior is the share of toxic rows among the labels that may be read,
    kept within 0.001 and 0.9; confirmed toxic rows are the positives, all rows the unlabelled text. Null or missing
    labels mean unlabelled; of repeated labels the largest counts; null and empty texts are scored by the bias. Without
    any positive, or without marks that tell, every row scores the prior. An empty table gives no rows; other columns
    keep names and values. Only the text enters a score.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where(~held_out(F.col("__id"), folds) & F.col("__label").isNotNull())
    known = known.groupBy("__id").agg(F.max("__label").alias("__label"))
    prior = known.agg(F.avg((F.col("__label") == 1).cast("double"))).first()[0]
    prior = min(max(prior or 0.0, 0.001), 0.9)
    seen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id"), folds))
    joined = seen.join(known, F.col("id") == F.col("__id"), "left")
    model = train(joined, F.col("__label") == 1, prior, "id", "text", **fit)
    d, at = masked(docs)
    out = d.withColumn("__score", score(F.col(at[text_col]), model))
    made = (held_out(F.col(at[id_col]), folds), F.col("__score"), (F.col("__score") >= 0.5).cast("int"))
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns], *[c.alias(n) for c, n in zip(made, spare(docs, "__held_out", "__score", "__predicted"))])
