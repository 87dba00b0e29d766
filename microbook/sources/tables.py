"""Tables of the engine: event log, fills, metric rows and the microprice table file."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microbook.operators.microprice import MicropriceTable
from microbook.schema import FEATURE_NAMES, KEYS, SCHEMA_VERSION, SEQ


def append_events(events: DataFrame, path: str, *, by: Sequence[str] = KEYS) -> None:
    """Append to the event log. `seq` is the replay order, so files may be written in parallel and reopened any time.

    Rows are gathered by day and symbol and split by event range, so a busy symbol is written by several tasks.
    """
    placed = events.repartition(*by, F.expr(f"{SEQ} div 1000000")).sortWithinPartitions(*by, SEQ)
    placed.write.mode("append").partitionBy(*reversed(by)).parquet(path)


def read_events(spark: SparkSession, path: str, *, ordered: bool = False) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.orderBy(*[k for k in KEYS if k in rows.columns], SEQ) if ordered else rows


def append_fills(fills: DataFrame, path: str) -> None:
    """Fills keep their touch order in (`seq`, `fill_no`)."""
    missing = {SEQ, "fill_no", "taker_id", "maker_id", "price", "quantity"} - set(fills.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    append_events(fills, path)


_TABLE_FILE = T.StructType(
    [
        T.StructField("n_imbalance_buckets", T.IntegerType()),
        T.StructField("n_spread_buckets", T.IntegerType()),
        T.StructField("tick_size", T.IntegerType()),
        T.StructField("table", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)


def write_microprice_table(spark: SparkSession, table: MicropriceTable, path: str) -> None:
    """One JSON document with the two bucket counts, the tick and the rows of the table."""
    row = (table.imbalance_buckets, table.spread_buckets, table.tick_size, [list(r) for r in table.values])
    spark.createDataFrame([row], _TABLE_FILE).coalesce(1).write.mode("overwrite").json(path)


def read_microprice_table(spark: SparkSession, path: str) -> MicropriceTable:
    found = spark.read.schema(_TABLE_FILE).option("multiLine", True).json(path).limit(2).collect()
    if len(found) != 1:
        raise ValueError("expected one microprice table")
    row = found[0]
    rows = row["table"] or []
    if len(rows) != row["n_imbalance_buckets"] or any(len(r) != row["n_spread_buckets"] for r in rows):
        raise ValueError("table shape does not match its bucket counts")
    return MicropriceTable(tuple(tuple(r) for r in rows), row["tick_size"])


def microprice_cells(spark: SparkSession, path: str) -> DataFrame:
    """The same file as (imb_bucket, sp_bucket, g) rows."""
    raw = spark.read.schema(_TABLE_FILE).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("table").alias("imb_bucket", "_row"))
    return rows.select("imb_bucket", F.posexplode("_row").alias("sp_bucket", "g"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def run_metadata(spark: SparkSession, *, k: int, params: Mapping[str, str], shares: Mapping[int, float]) -> DataFrame:
    """One row that describes a training run: contract version, features, horizon, parameters, class shares."""
    schema = T.StructType(
        [
            T.StructField("schema_version", T.IntegerType()),
            T.StructField("features", T.ArrayType(T.StringType())),
            T.StructField("k", T.IntegerType()),
            T.StructField("params", T.MapType(T.StringType(), T.StringType())),
            T.StructField("train_class_shares", T.MapType(T.IntegerType(), T.DoubleType())),
        ]
    )
    row = (SCHEMA_VERSION, list(FEATURE_NAMES), k, {a: str(b) for a, b in params.items()}, {int(c): float(s) for c, s in shares.items()})
    return spark.createDataFrame([row], schema)
