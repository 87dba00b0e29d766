"""Readers for order messages, depth snapshots and quotes kept as CSV files, one or more files per symbol and day.

File names carry the symbol and the day: `<SYMBOL>_<yyyy-mm-dd>_..._message_<levels>[_<part>].csv` and
`..._orderbook_<levels>[_<part>].csv`. All symbols are read in one scan.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microbook.functions.predicates import extract_trades
from microbook.functions.scalars import millis_to_ns, session_time_ns, to_fixed_point
from microbook.operators.joins import positional_join, require_equal_heights
from microbook.schema import KEYS, ORDER_MESSAGE_CSV, QUOTE_CSV, SEQ, depth_columns, depth_csv

CORRUPT = "_corrupt"
#: Name without its last number, and that number.
_PART = r"^(.*?)(\d*)\.csv[^/]*$"
_NAME = r"([^/_]+)_(\d{4}-\d{2}-\d{2})_[^/]*$"


def _scan(spark: SparkSession, path: str, schema: T.StructType, *, header: bool, mode: str) -> DataFrame:
    """CSV rows with the position of their input split and of the row inside the scan."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("header", header).option("mode", mode).option("enforceSchema", True)
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    # Every field is mandatory. Naming them all here also keeps the reader from skipping fields that the query does not use,
    # in which case a bad value there would go unnoticed.
    incomplete = reduce(or_, [F.col(name).isNull() for name in schema.names], F.col(CORRUPT).isNotNull())
    return rows.select(
        *schema.names,
        F.when(incomplete, F.coalesce(F.col(CORRUPT), F.lit("a field is missing"))).alias(CORRUPT),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_scan_row"),
    )


def assign_seq(rows: DataFrame, by: tuple[str, ...] = KEYS, out: str = SEQ) -> DataFrame:
    """0-based position of each row in file order, per `by`.

    Rows of one input split are consecutive in the scan, so the position is the row's distance from the start of its
    split plus the length of the splits before it. Only one row per split is aggregated and joined back; nothing is sorted.
    Several files of one symbol and day follow each other by the number at the end of their names, so part 10 comes after part 2.
    """
    splits = rows.groupBy(*by, "_file", "_split").agg(F.min("_scan_row").alias("_start"), F.count("*").alias("_rows"))
    part = [F.regexp_extract("_file", _PART, 1), F.expr(f"try_cast(regexp_extract(_file, r'{_PART}', 2) AS bigint)"), F.col("_file"), F.col("_split")]
    earlier = Window.partitionBy(*by).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        *by, "_file", "_split", "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")
    )
    placed = rows.join(offsets, [*by, "_file", "_split"])
    return placed.withColumn(out, F.col("_scan_row") - F.col("_start") + F.col("_offset")).drop(
        "_file", "_split", "_scan_row", "_start", "_offset"
    )


def _with_file_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "symbol": F.regexp_extract("_file", _NAME, 1),
            "trade_date": F.try_to_date(F.regexp_extract("_file", _NAME, 2), "yyyy-MM-dd"),
        }
    )


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Files under `path` with symbol, day and kind (message or orderbook)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path)
    named = _with_file_keys(files.select(F.col("path").alias("_file"), "length"))
    return named.select(
        "symbol", "trade_date", F.regexp_extract("_file", r"_(message|orderbook)_", 1).alias("kind"), F.col("_file").alias("path"), "length"
    )


def read_order_messages(spark: SparkSession, path: str, *, mode: str = "PERMISSIVE") -> DataFrame:
    """Order messages of all symbols with `seq` and `ts_ns`.

    With the default mode an unparsable line keeps its place in `seq` and comes out with its text in `_corrupt`; split it
    off with `good_rows`. `mode="FAILFAST"` stops at the first one.
    """
    rows = assign_seq(_with_file_keys(_scan(spark, path, ORDER_MESSAGE_CSV, header=False, mode=mode)))
    return rows.select(
        *KEYS, SEQ, session_time_ns("trade_date", "time").alias("ts_ns"), "event_type", "order_id",
        F.col("direction").alias("side"), "size", "price", CORRUPT,
    )


def read_depth_snapshots(spark: SparkSession, path: str, levels: int = 10, *, mode: str = "PERMISSIVE") -> DataFrame:
    """Depth after each message, `levels` per side, with `seq`."""
    rows = assign_seq(_with_file_keys(_scan(spark, path, depth_csv(levels), header=False, mode=mode)))
    return rows.select(*KEYS, SEQ, *depth_columns(levels), CORRUPT)


def read_quotes(spark: SparkSession, path: str, *, mode: str = "PERMISSIVE") -> DataFrame:
    """Best bid and ask of a quote feed; prices and sizes in units of 1e-8, event times in ns."""
    rows = assign_seq(_with_file_keys(_scan(spark, path, QUOTE_CSV, header=True, mode=mode)))
    return rows.select(
        *KEYS, SEQ, millis_to_ns("event_time").alias("ts_ns"), "update_id",
        to_fixed_point("best_bid_price").alias("bid_price_l1"), to_fixed_point("best_bid_qty").alias("bid_size_l1"),
        to_fixed_point("best_ask_price").alias("ask_price_l1"), to_fixed_point("best_ask_qty").alias("ask_size_l1"), CORRUPT,
    )


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNotNull())


def count_bad_rows(rows: DataFrame) -> DataFrame:
    """Rows and unparsable rows per symbol and day."""
    return rows.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("bad_rows"))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return extract_trades(good_rows(read_order_messages(spark, path)))


def read_joined(
    spark: SparkSession, message_path: str, depth_path: str, levels: int = 10, *, unequal: str = "fail", bad: str = "fail"
) -> DataFrame:
    """Message and depth side by side, row by row.

    Files of different heights fail (`unequal="drop"` keeps the rows that both have), and so do bad lines on either side
    (`bad="drop"` leaves their events out; `count_bad_rows` says how many there are).
    """
    messages, depth = read_order_messages(spark, message_path), read_depth_snapshots(spark, depth_path, levels)
    if unequal == "fail":
        require_equal_heights(messages, depth)
    if bad == "fail" and (found := bad_rows(messages.select(*KEYS, SEQ, CORRUPT)).unionByName(bad_rows(depth.select(*KEYS, SEQ, CORRUPT))).head(5)):
        raise ValueError(f"lines that do not parse, first ones: {[r.asDict() for r in found]}")
    return positional_join(good_rows(messages), good_rows(depth))
