"""Sources and sinks around the streaming operators."""

from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from microbook.functions.predicates import route_order_ops
from microbook.schema import KEYS, SEQ
from microbook.session import claim


def read_event_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, *, by: tuple[str, ...] = (), once: bool = True) -> StreamingQuery:
    """Append every row exactly once: the file sink's log and the checkpoint survive a restart."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_log_stream(events: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Event log as a table by day and symbol, in any number of files; `seq` is the replay order.

    Give it `streaming.book.accepted_event_log`, so that events without effect leave no trace.
    """
    return append_stream(events, path, checkpoint, by=tuple(reversed(KEYS)), once=once)


def order_op_stream(messages: DataFrame, partial_as: str = "reduce") -> DataFrame:
    return route_order_ops(messages, partial_as)


def score_stream(features: DataFrame, score: Callable[[DataFrame], DataFrame] | Transformer) -> DataFrame:
    """(symbol, seq, score) per event. Scoring only observes: nothing flows back into the events."""
    scored = score.transform(features) if isinstance(score, Transformer) else score(features)
    return scored.select(*KEYS, SEQ, F.col("score"))


def run_to_table(df: DataFrame, label: str) -> DataFrame:
    """Process what is available, with checkpoint and output in the shared work folder, and return the written table."""
    spark = df.sparkSession
    root = claim(spark, label)
    append_stream(df, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/table")
