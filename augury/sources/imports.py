"""Imports of external event and price files: manifest, normalisation, season filter."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from augury.functions.columns import implied_probability, local_day


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV with header, JSON lines, or one JSON document (a list, or ``rows``/``data``)."""
    ext = path.rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext == "csv":
        return (reader if schema is not None else reader.option("inferSchema", True)).csv(path, header=True)
    if ext in ("jsonl", "ndjson"):
        return reader.json(path)
    if ext == "json":
        doc = spark.read.option("multiLine", True).json(path)
        for key in ("rows", "data"):
            if key in doc.columns and isinstance(doc.schema[key].dataType, T.ArrayType):
                doc = doc.select(F.explode(key).alias("_r")).select("_r.*")
                break
        if schema is not None:
            doc = doc.select(*[(F.col(f.name) if f.name in doc.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                               for f in schema.fields])
        return doc
    raise ValueError(f"unsupported file type: {path}")


def import_bundle(spark: SparkSession, manifest: Sequence[Mapping], base: str = "",
                  default_source: str = "import") -> DataFrame:
    """Read every manifest entry and stack the files by name, with source and extraction time columns.

    An entry is ``{path, source?, snapshot_id?, extracted_at?, season?}``; the files stay distributed.
    """
    out = None
    for entry in manifest:
        path = str(entry.get("path") or "").strip()
        if not path:
            continue
        full = path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"
        df = read_any(spark, full)
        extra = {"import_source": F.lit(entry.get("source") or default_source),
                 "snapshot_id": F.lit(entry.get("snapshot_id")).cast("string"),
                 "extracted_at": F.lit(entry.get("extracted_at")).cast("timestamp")}
        if entry.get("season") is not None and "season" not in df.columns:
            extra["season"] = F.lit(int(entry["season"]))
        df = df.withColumns(extra)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("the manifest names no files")
    return out


def rename_known(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    have = {a: b for a, b in aliases.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(have)


def require(df: DataFrame, cols: Sequence[str]) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


# Columns that must be present, and the numeric columns of an event row.
EVENT_REQUIRED = ["event_id", "season", "event_date", "start_ts", "home", "away"]
EVENT_NUMBERS = ["home_score", "away_score", "home_win"]
PRICE_REQUIRED = ["price_event_id", "commence_ts", "home", "away", "book", "market", "outcome_name", "side", "price"]


def normalize_events(df: DataFrame, aliases: Mapping[str, str], extracted_at: Column | None = None,
                     defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Canonical event rows: renamed, checked, defaulted and cast."""
    out = rename_known(df, aliases)
    require(out, EVENT_REQUIRED)
    for name in EVENT_NUMBERS:
        c = F.col(name).cast("string").try_cast("double") if name in out.columns else F.lit(None).cast("double")
        out = out.withColumn(name, c)
    fill = {"venue": F.lit(None).cast("string"), "is_neutral": F.lit(0), "went_extra": F.lit(0),
            "as_of": extracted_at if extracted_at is not None else F.current_timestamp()}
    fill.update(defaults or {})
    out = out.withColumns({k: v for k, v in fill.items() if k not in out.columns})
    if "is_final" not in out.columns:
        out = out.withColumn("is_final", F.col("home_win").isNotNull().cast("int"))
    out = out.withColumn("is_final", F.coalesce(F.col("is_final").cast("int"), F.lit(0)))
    if "state" not in out.columns:
        out = out.withColumn("state", F.when(F.col("is_final") == 1, "final").otherwise("scheduled"))
    return out.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("season").cast("int").alias("season"),
        F.col("event_date").cast("date").alias("event_date"), F.col("start_ts").cast("timestamp").alias("start_ts"),
        "state", "home", "away", "venue", "is_neutral", "home_score", "away_score", "went_extra",
        F.col("home_win").cast("int").alias("home_win"), "is_final", "as_of")


def normalize_prices(df: DataFrame, aliases: Mapping[str, str], league: Column, as_of: Column,
                     tz: str = "America/Chicago") -> DataFrame:
    """Canonical price rows: implied probability, local date and the entity named by the side."""
    out = rename_known(df, aliases)
    require(out, PRICE_REQUIRED)
    side = F.lower(F.trim("side"))
    add = {"league": league, "updated_at": as_of, "point": F.lit(None).cast("double"),
           "local_date": local_day(F.col("commence_ts").cast("timestamp"), tz),
           "outcome_entity": F.when(side == "home", F.col("home")).when(side == "away", F.col("away")),
           "implied": implied_probability(F.col("price").cast("double"))}
    out = out.withColumns({k: v for k, v in add.items() if k not in out.columns or k == "league"})
    return out.select("league", "price_event_id", F.col("commence_ts").cast("timestamp").alias("commence_ts"),
                      "local_date", "home", "away", "book", "updated_at", "market", "outcome_name", "side",
                      "outcome_entity", F.col("price").cast("double").alias("price"),
                      F.col("point").cast("double").alias("point"), F.col("implied").cast("double").alias("implied"))


def recent_seasons(df: DataFrame, n: int, season: str = "season") -> DataFrame:
    """Rows of the ``n`` newest seasons. The season list is a distinct of a few values, joined back."""
    newest = df.select(season).distinct().orderBy(F.col(season).desc()).limit(n)
    return df.join(newest, season, "left_semi").select(*df.columns)
