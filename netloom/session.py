"""Session and shared-folder helpers for the analytics operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: rows that `dealt` gives to a task
TASK_ROWS = 1 << 20


def session(name: str = "netloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster the master and sizes come from spark-submit."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; in a local session without it a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return context.getCheckpointDir().get().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back, so that iterations don't grow the plan.

    Unlike checkpoint(), which computes its input twice, this computes it once; a lost executor costs nothing. The table
    is deleted by `release`, else when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/netloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folder(df.sparkSession, path, "deleteOnExit")
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.netloom_path = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by the keys so that a task gets about TASK_ROWS of `rows` rows, however many there are; for steps whose tasks would
    otherwise grow with the input, as the number of shuffle partitions is fixed."""
    return df.repartition(max(rows // TASK_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables of `cut_lineage` that no later plan reads; None and other DataFrames are left alone."""
    for df in tables:
        if (path := getattr(df, "netloom_path", None)) is not None:
            _folder(df.sparkSession, path, "delete", True)


def _folder(spark: SparkSession, path: str, action: str, *more: bool) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    getattr(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), action)(where, *more)
