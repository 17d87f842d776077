"""Table reads and writes: interim tables, upserts, audits, chunked exports, ledger routing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.errors import AnalysisException

from augury.operators.ordered import latest_by


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Parquet, else CSV with header, else an empty frame of the schema."""
    base = f"{folder.rstrip('/')}/{name}"
    for read in (lambda: spark.read.schema(schema).parquet(f"{base}.parquet"), lambda: spark.read.schema(schema).csv(f"{base}.csv", header=True)):
        try:
            return read()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Base and delta merged, newest row per key; repeating it changes nothing. The delta wins ties."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, key, [*order, F.col("_new")]).drop("_new")


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` touches."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def snapshot_audit(df: DataFrame, source: str, as_of: str, content: Sequence[str]) -> DataFrame:
    """One row: snapshot id (hash of source, rows, newest time and content), row count, extraction time."""
    a = df.agg(F.count(F.lit(1)).alias("row_count"), F.max(as_of).alias("extracted_at"),
               F.sum(F.xxhash64(*content).cast("decimal(38,0)")).alias("_h"))
    sid = F.substring(F.sha2(F.concat_ws("|", F.lit(source), F.col("row_count"), F.col("extracted_at").cast("string"), F.col("_h").cast("string")), 256), 1, 16)
    return a.select(sid.alias("snapshot_id"), F.lit(source).alias("source"), "row_count", "extracted_at")


def results_from_events(events: DataFrame, event: str = "event_id", final: str = "is_final") -> DataFrame:
    """Final events as results, one row per event: the newest copy."""
    done = events.where((F.col(final) == 1) & F.col("home_win").isNotNull())
    return latest_by(done, [event], [F.col("final_ts")]).select(event, "final_ts", "home", "away", "home_score", "away_score", "home_win")


def chunks(df: DataFrame, ts: str, days: int, origin: str = "1970-01-01") -> DataFrame:
    """Add ``chunk_start``, the first day of the row's run of ``days`` days."""
    n = F.floor(F.datediff(F.col(ts), F.lit(origin)) / days) * days
    return df.withColumn("chunk_start", F.date_add(F.lit(origin).cast("date"), n.cast("int")))


def export_chunks(df: DataFrame, ts: str, days: int, path: str, origin: str = "1970-01-01") -> DataFrame:
    """Write one folder per date chunk; returns the manifest (chunk, rows, first and last time)."""
    c = chunks(df, ts, days, origin)
    c.write.mode("overwrite").partitionBy("chunk_start").parquet(path)
    return chunk_manifest(c, ts)


def chunk_manifest(chunked: DataFrame, ts: str) -> DataFrame:
    return chunked.groupBy("chunk_start").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def split_ledger(rows: DataFrame, existing: DataFrame, key: Sequence[str], source: str, diagnostic: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """New rows for the ledger, and new rows of the ``diagnostic`` sources for the diagnostics; a row without source
    stays in the ledger. Of rows with one key the first by ``order`` counts."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    fresh = rows.withColumn("_n", first).where("_n = 1").drop("_n").join(existing.select(*key), list(key), "left_anti")
    aside = F.coalesce(F.col(source).isin(list(diagnostic)), F.lit(False))
    return fresh.where(~aside), fresh.where(aside)
