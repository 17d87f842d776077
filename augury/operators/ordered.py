"""Ordered computations that do not need a whole key in one task.

A plain ``Window.partitionBy(key)`` sorts every row of a key in one task, which is wrong when a key holds a third of
the table. Here every key is cut into *ranges* of its order by one plan, whatever its size: rows are counted per key and
fine *cell* (an hour of the first order column, say; rows of equal order share a cell), counts add up along the cells,
and a new range starts every ``spark.augury.rangeRows`` rows. A small key is one range. Only keys with several ranges have
bounds, which are few and broadcast, so that rows are shuffled once, by key and range; what is added for hot keys joins the
bounds too and vanishes at run time where there are none. Two tools use the ranges:

* ``running_totals``: sums inside a range plus the totals of the earlier ranges.
* ``in_buckets``: windows inside a range, which also holds copies of the few rows that precede it, so any frame of at
  most ``reach`` rows back is complete. Only keys with several ranges have such copies.

Nothing runs while a plan is built. Totals and ranges come from one-row-per-cell aggregates combined in the map tasks;
a key has at most as many cells as its calendar has hours.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from augury.session import cut_lineage

RANGE_ROWS = 1_000_000
RANGE_ROWS_CONF = "spark.augury.rangeRows"


def range_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(RANGE_ROWS_CONF, str(RANGE_ROWS)))


def cell_of(df: DataFrame, name: str) -> Column:
    """A fine monotone cell of an order column: hours of times, days of dates, numbers themselves."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(F.col(name).cast("timestamp")) / 3_600_000_000)
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    return F.col(name) if isinstance(kind, T.NumericType) else F.lit(0)


CHUNK = 256  # bounds are searched in two steps of arrays of this length


def range_bounds(df: DataFrame, keys: Sequence[str], cell: Column, descending: bool = False) -> DataFrame:
    """Of every key with more than ``spark.augury.rangeRows`` rows where its ranges begin: the key as ``_k_<key>``, and
    ``_bounds``, arrays of (``bucket``, ``at``, ``start``) in order. A range holds that many rows or one cell at least, so
    there are at most twice as many bounds as rows divided by it, and the table can be broadcast.

    Reads only the keys and the cell, counts of which combine in the map tasks.
    """
    keys = list(keys)
    line = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.col("_cell").desc() if descending else F.col("_cell").asc())
    n = df.groupBy(*keys, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.coalesce(F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("_bucket", F.floor(F.col("_before") / range_rows(df)).cast("long"))
    first = F.min_by(F.col("_cell"), F.col("_before"))
    starts = n.groupBy(*keys, "_bucket").agg(first.alias("_at"), F.min("_before").alias("_start"))
    flat = F.array_sort(F.collect_list(F.struct(F.col("_bucket").alias("bucket"), F.col("_at").alias("at"), F.col("_start").alias("start"))))
    hot = starts.groupBy(*keys).agg(flat.alias("_flat")).where(F.size("_flat") > 1)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_flat") - 1) / CHUNK).cast("int")), lambda i: F.slice("_flat", i * CHUNK + 1, CHUNK))
    return hot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], chunks.alias("_bounds"))


def of_crowded(df: DataFrame, all_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key has more than ``spark.augury.rangeRows`` rows in ``all_rows``, of which ``df`` is a part: the
    only ones that bounds are made of. Such keys are as many as the rows divided by that number at most, and broadcast."""
    many = all_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > range_rows(df))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(F.broadcast(many.select(*[F.col(k).alias(f"_k_{k}") for k in keys])), cond, "left_semi")


def _at_bounds(work: DataFrame, bounds: DataFrame, keys: list[str], descending: bool, how: str) -> DataFrame:
    """``work`` (with ``_cell``) joined with the bounds of its key, and the bound that its cell lies behind, as ``_bound``."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    cell = F.col("_cell")
    behind = lambda b: F.coalesce(b["at"] >= cell, cell.isNull()) if descending else F.coalesce(b["at"] <= cell, F.lit(False))
    last = lambda found: F.greatest(F.size(found), F.lit(1)) - 1
    chunk = F.get("_bounds", last(F.filter("_bounds", lambda c: behind(c[0]))))
    out = work.join(F.broadcast(bounds), cond, how).withColumn("_chunk", F.when(F.col("_bounds").isNotNull(), chunk))
    return out.withColumn("_bound", F.get("_chunk", last(F.filter("_chunk", behind)))).drop("_chunk", *[f"_k_{k}" for k in keys])


def with_ranges(df: DataFrame, keys: Sequence[str], cell: Column, descending: bool = False, bounds: DataFrame | None = None, hot: bool = False) -> DataFrame:
    """``df`` with ``_bucket`` (number of the row's range in its key), ``_range_start`` (rows of the key before the range) and
    ``_range_many`` (the key has several ranges). ``hot`` keeps the rows of keys with several ranges only, which costs
    nothing where there are none."""
    keys = list(keys)
    bounds = range_bounds(df, keys, cell, descending) if bounds is None else bounds
    out = _at_bounds(df.withColumn("_cell", cell), bounds, keys, descending, "inner" if hot else "left")
    zero = F.lit(0).cast("long")
    return out.select(*df.columns, F.coalesce("_bound.bucket", zero).alias("_bucket"), F.coalesce("_bound.start", zero).alias("_range_start"), F.col("_bounds").isNotNull().alias("_range_many"))


def _before_ranges(totals: DataFrame, keys: list[str], over: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """Per range of hot keys what its earlier ranges add up to; as many rows as there are bounds, so it can be broadcast."""
    prior = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_bb"), *[fn(prior).alias(name) for name, fn in over.items()]))


def _by_range(work: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    cond = F.col("_bucket") == F.col("_bb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return work.join(offsets, cond, "left")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column,
                   sums: dict[str, Column], inclusive: bool = True, descending: bool = False, bounds: DataFrame | None = None) -> DataFrame:
    """Running sums per key in ``order``. ``cell`` must be non-decreasing along the order
    (non-increasing when ``descending``). ``bounds`` has the ranges where they are known."""
    names, keys = list(sums), list(keys)
    valued = df.withColumns({f"_v_{n}": e for n, e in sums.items()})
    bounds = range_bounds(df, keys, cell, descending) if bounds is None else bounds
    totals = with_ranges(valued, keys, cell, descending, bounds, hot=True).groupBy(*keys, "_bucket").agg(
        *[F.sum(F.coalesce(F.col(f"_v_{n}"), F.lit(0))).alias(f"_t_{n}") for n in names])
    offsets = _before_ranges(totals, keys, {f"_o_{n}": lambda w, n=n: F.sum(f"_t_{n}").over(w) for n in names})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = _by_range(with_ranges(valued, keys, cell, descending, bounds), offsets, keys)
    out = out.withColumns({n: F.coalesce(F.sum(F.col(f"_v_{n}")).over(inside), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n in names})
    return out.select(*df.columns, *names)


def running_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column, value: Column,
                   name: str) -> DataFrame:
    """Greatest value so far per key, in two levels like the totals. NULLs are passed over.

    With a struct that starts with the row's time, the greatest is the latest.
    """
    keys = list(keys)
    bounds = range_bounds(df, keys, cell)
    valued = df.withColumn(name, value)
    tops = with_ranges(valued, keys, cell, bounds=bounds, hot=True).groupBy(*keys, "_bucket").agg(F.max(name).alias("_top"))
    offsets = _before_ranges(tops, keys, {"_offset": lambda w: F.max("_top").over(w)})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _by_range(with_ranges(valued, keys, cell, bounds=bounds), offsets, keys)
    return out.withColumn(name, F.greatest(F.max(name).over(inside), F.col("_offset"))).select(*df.columns, name)


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column,
              name: str = "row_index") -> DataFrame:
    """Position of each row in its key, from 0."""
    keys = list(keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return with_ranges(df, keys, cell).withColumn(name, F.col("_range_start") + F.row_number().over(inside) - 1).select(*df.columns, name)


def _halo(work: DataFrame, bounds: DataFrame, keys: list[str], order: Sequence[str], reach: int, values: dict[str, int] | None) -> DataFrame:
    """For every range of hot keys the ``reach`` rows before it, and for each column in ``values`` the last so many rows
    where it is not NULL. Rows of a key need distinct order values. ``work`` is read once."""
    cols = [c for c in work.columns if c != "_bucket"]
    row = F.struct(*[F.col(o).alias(f"_s{i}") for i, o in enumerate(order)], F.struct(*cols).alias("_row"))
    last = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(o).desc() for o in order])
    upto = last.rowsBetween(Window.unboundedPreceding, 0)
    wanted = {"_near": (F.lit(True), reach)} | {f"_last_{name}": (F.col(name).isNotNull(), n) for name, n in (values or {}).items()}
    ranked = work.withColumns({tag: F.sum(has.cast("int")).over(upto) for tag, (has, _) in wanted.items()})
    keep = {tag: has & (F.col(tag) <= n) for tag, (has, n) in wanted.items()}
    some = F.lit(False)
    for k in keep.values():
        some = some | k
    lists = {tag: F.sort_array(F.collect_list(F.when(k, row))) for tag, k in keep.items()}
    tails = ranked.where(some).groupBy(*keys, "_bucket").agg(*[F.when(F.size(x) > 0, x).alias(tag) for tag, x in lists.items()])
    spots = bounds.select(*[F.col(f"_k_{k}").alias(k) for k in keys], F.explode(F.flatten("_bounds")).alias("_b")).select(*keys, F.col("_b.bucket").alias("_bucket"))
    cond = F.col("_bucket") == F.col("_tb")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    at = spots.join(tails.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_bucket").alias("_tb"), *wanted), cond, "left")
    line = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))
    # the n previous ranges that have a tail hold at least n rows; ranges without one are stepped over
    at = at.withColumns({f"_seen{tag}": F.count(tag).over(line.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)) for tag in wanted})
    got = []
    for tag, (_, n) in wanted.items():
        prior = F.flatten(F.sort_array(F.collect_list(tag).over(line.orderBy(f"_seen{tag}").rangeBetween(-n, -1))))
        got.append(F.slice(prior, F.greatest(F.size(prior) - n + 1, F.lit(1)), n))
    halo = at.select("_bucket", F.concat(*got).alias("_prior")).select("_bucket", F.explode("_prior").alias("_x")).select("_x._row.*", "_bucket")
    return halo.dropDuplicates([*keys, "_bucket", *order]) if values else halo


def in_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column | None, reach: int,
               fn: Callable[[DataFrame, list[str]], DataFrame], values: dict[str, int] | None = None,
               index: str | None = None) -> DataFrame:
    """Apply ``fn(frame, partition columns)`` to the ranges of all keys, each with the rows its frames reach back to.

    ``cell`` is a fine monotone function of the order (by default one of the first order column). ``index`` names a
    column that holds each row's position in its key.
    """
    keys, order = list(keys), list(order)
    if "_bucket" in keys:  # inside a range already, whose copies the outer call has brought
        return fn(df, keys)
    cell = cell_of(df, order[0]) if cell is None else cell
    bounds = range_bounds(df, keys, cell)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    several = with_ranges(df, keys, cell, bounds=bounds, hot=True)
    if index:
        several = several.withColumn(index, (F.col("_range_start") + F.row_number().over(inside) - 1).cast("long"))
    before = _halo(several.drop("_range_start", "_range_many"), bounds, keys, order, reach, values)
    own = with_ranges(df, keys, cell, bounds=bounds).drop("_range_many").withColumn("_own", F.lit(True))
    wide = own.unionByName(before.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    if index:
        place = F.col("_range_start") + F.sum(F.col("_own").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1
        wide = wide.withColumn(index, F.when(F.col("_own"), place).otherwise(F.col(index)).cast("long"))
    return fn(wide.drop("_range_start"), [*keys, "_bucket"]).where("_own").drop("_bucket", "_own")


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             build: Callable[[Window], dict[str, Column]], reach: int,
             cell: Column | None = None) -> DataFrame:
    """Add window columns whose frames reach at most ``reach`` rows back."""
    return in_buckets(df, keys, order, cell, reach,
                      lambda f, parts: f.withColumns(build(Window.partitionBy(*parts).orderBy(*order))))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the greatest by ``order``. The rank filter cuts every map task to one row per key before the
    shuffle, so hot keys do not matter.

    NULLs sort first. Negate a numeric column in ``order`` to take its smallest value.
    """
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*df.columns)


def earliest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_first() for o in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*df.columns)


def top_k_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Top ``k`` rows per key. The rank filter lets Spark cut each map task to ``k`` rows per key
    before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def keep_preferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Drop all but the preferred row of each key."""
    return latest_by(df, keys, order)


def order_nulls_last(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in cols])


def value_cell(value: Column, per_e: int = 65536) -> Column:
    """Monotone cell of a number, of the same relative width everywhere: outliers and narrow spreads leave it fine."""
    size = lambda v: F.floor(F.log(v) * per_e).cast("long") + 1_000_000_000
    return F.when(value > 0, size(value)).when(value < 0, -size(-value)).otherwise(F.lit(0).cast("long"))


def located(counts: DataFrame, ranks: DataFrame, by: Sequence[str], value: str, n: str, rank: Sequence[str]) -> DataFrame:
    """Rows of ``ranks`` with ``<rank>_value`` for each 0-based rank column: the value that holds that rank of its group,
    where ``counts`` has the distinct values of each group with their numbers ``n``.

    First the few cells that hold a wanted rank are found from the cells' totals; only the values of those cells are
    read again and added up, so no value meets a rank that it cannot hold.
    """
    by = list(by)
    placed = counts.withColumn("_cell", value_cell(F.col(value)))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    cells = placed.groupBy(*by, "_cell").agg(F.sum(n).alias("_t"))
    cells = cells.withColumn("_from", F.sum("_t").over(part.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_t"))
    # All ranks and all cells of a group on one line: a rank lies in the last cell that starts at or before it.
    asked = ranks.select(*by, F.explode(F.array(*rank)).alias("_at")).distinct()
    line = cells.select(*by, F.col("_from").alias("_at"), "_cell", "_from").unionByName(asked.withColumns({"_cell": F.lit(None).cast("long"), "_from": F.lit(None).cast("long")}))
    known = part.orderBy("_at", F.col("_cell").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumns({"_in": F.last("_cell", True).over(known), "_base": F.last("_from", True).over(known)}).where("_cell IS NULL")
    found = line.select(*by, "_at", F.col("_in").alias("_cell"), "_base")
    need = found.select(*by, "_cell", "_base").distinct()
    inside = placed.join(need, [*by, "_cell"])
    upto = F.col("_base") + F.sum(n).over(Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = inside.withColumn("_upto", upto).join(found.drop("_base"), [*by, "_cell"]).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col(n)))
    got = inside.select(*by, "_at", F.col(value).alias("_value"))
    out = ranks
    for r in rank:
        out = out.join(got.select(*by, F.col("_at").alias(r), F.col("_value").alias(f"{r}_value")), [*by, r])
    return out


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per group without collecting a group.

    Equal values are merged first, so ties cost nothing. Returns ``by..., prob, quantile``.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n")))
    want = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    ranks = counts.groupBy(*by).agg(F.sum("_n").alias("_m")).where("_m IS NOT NULL").select(*by, "_m", want.alias("prob"))
    ranks = ranks.withColumn("_pos", F.col("prob") * (F.col("_m") - 1))
    ranks = ranks.withColumns({"_r0": F.floor("_pos").cast("long"), "_r1": F.ceil("_pos").cast("long")})
    at = located(counts, ranks, by, "_x", "_n", ["_r0", "_r1"])
    return at.select(*by, "prob", (F.col("_r0_value") + (F.col("_r1_value") - F.col("_r0_value")) * (F.col("_pos") - F.col("_r0"))).alias("quantile"))


def _join_by(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Equi-join on ``by``; with no keys the right side is a one-row (or few-row) summary."""
    return left.join(right, list(by)) if by else left.crossJoin(right)
