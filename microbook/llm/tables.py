"""The given tables, and folders for what the operators write."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from microbook.session import claim


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; each call of an operator gets its own, so reruns never see half-written files."""
    return claim(spark, label)


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: cuts the lineage, so a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def dealt(rows: DataFrame, most_tasks: int = 20_000) -> DataFrame:
    """Small stored rows that each stand for much work (a file, a range): a partition for each, beyond `most_tasks` several share one."""
    return rows.repartition(max(1, min(rows.count(), most_tasks)))


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for the jobs inside: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
