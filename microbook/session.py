"""Session settings and durable intermediate tables."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "microbook", cores: str | None = None, **conf: str) -> SparkSession:
    """Session for local work; on a cluster pass settings through spark-submit instead."""
    builder = SparkSession.builder.appName(app)
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", cores)
        builder = builder.config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # Recording the Python call site of each column costs milliseconds, seconds for a plan with hundreds of columns.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir` of the session.

    Only a local master may fall back to a temporary folder, because there every task runs on this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: dict[str, list[str]] = {}


def claim(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted by `clean_up`."""
    path = os.path.join(work_dir(spark), "microbook", f"{label}-{uuid.uuid4().hex}")
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete every intermediate table that this application has written so far; returns their number.

    DataFrames that read them are of no use afterwards: call it when results are stored.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
    return len(paths)


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage and fixes values such as partition ids.

    Runs a job at once; the table stays until `clean_up`.
    """
    spark = df.sparkSession
    path = claim(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)
