"""Session defaults and lineage cutting."""
from __future__ import annotations

import math
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

TASK_ROWS = 20_000
TASK_ROWS_CONF = "spark.augury.taskRows"


def local_session(cores: str | int | None = None, app: str = "augury") -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter's own settings apply."""
    n = str(cores or os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", os.environ.get("AUGURY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``, or a fresh local one in local mode only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="augury-checkpoint-"))
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; files go when the frame is collected as garbage, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` written once, for work that costs far more per row than to move it: where a task would hold more than
    ``spark.augury.taskRows`` (20,000) rows, as behind a window over one range, rows are dealt evenly to more tasks, up to
    four a core or as many as keep a task under a million."""
    out, spark = cut_lineage(df), df.sparkSession
    rows = int(spark.conf.get(TASK_ROWS_CONF, str(TASK_ROWS)))
    size = out.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    n, most = size["n"] or 0, size["most"] or 0
    tasks = min(math.ceil(n / rows), max(4 * spark.sparkContext.defaultParallelism, math.ceil(n / 1_000_000)))
    return cut_lineage(out.repartition(tasks)) if most > max(rows, 2 * n / max(tasks, 1)) else out
