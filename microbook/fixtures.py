"""Order-book shaped tables derived from the driver's `events` and `lineitem` tables with integer arithmetic.

The wide `book` table is derived once per session and folder and kept as a Parquet table in the work folder, as a user
would keep ingested data; everything is computed by Spark from the whole input.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.partitioning import dense_index, forward_fill, order_chunks, running_sum
from microbook.schema import KEYS, SEQ
from microbook.session import claim, materialise

TRADE_DATE = "2012-06-21"

_tables: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table that is built on first use and read from the work folder afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialise(build(), name)
    return _tables[key]


def _book_columns(steps: DataFrame, order: tuple[str, ...]) -> DataFrame:
    keyed = steps.withColumn("trade_date", F.lit(TRADE_DATE).cast("date"))
    staged = order_chunks(keyed, (*KEYS, *order))
    walked = running_sum(
        staged,
        {"seq": F.lit(1).cast("bigint"), "walk": (F.col("rid") * 7919 + F.col("h")) % 3 - 1},
        order=order,
        chunk="chunk_no",
    )
    h, rid = F.col("h"), F.col("rid")
    priced = walked.withColumns({"seq": F.col("seq") - 1, "_bid": F.lit(5_650_000) + F.col("walk") * 100}).withColumn(
        "_ask", F.col("_bid") + (h % 3 + 1) * 100
    )
    columns = [
        F.col("_bid").alias("bid_price_l1"),
        (F.lit(100) + (h * 31 + rid * 17) % 400).alias("bid_size_l1"),
        F.col("_ask").alias("ask_price_l1"),
        (F.lit(100) + (h * 13 + rid * 29) % 400).alias("ask_size_l1"),
    ]
    for level in range(2, 6):
        columns += [
            (F.col("_bid") - 100 * (level - 1)).alias(f"bid_price_l{level}"),
            (F.lit(100) + (h * (7 + 2 * level) + rid * _BID_FACTOR[level]) % 300).alias(f"bid_size_l{level}"),
            (F.col("_ask") + 100 * (level - 1)).alias(f"ask_price_l{level}"),
            (F.lit(100) + (h * (5 + 2 * level) + rid * (11 + 4 * level)) % 300).alias(f"ask_size_l{level}"),
        ]
    return priced.select("symbol", "trade_date", "seq", "ts_ns", "rid", "et", "h", *columns)


_BID_FACTOR = {2: 11, 3: 15, 4: 19, 5: 23}


def _symbol(column: str):
    names = ("AAPL", "AMZN", "GOOG", "INTC")
    out = F
    for i, name in enumerate(names):
        out = out.when(F.col(column) % 5 == i, name)
    return out.otherwise("MSFT")


def _ns(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * 1000


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One depth snapshot per row of `events`, five levels, unique timestamps."""

    def build():
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        steps = events.select(
            F.col("event_id").alias("rid"),
            _ns("ts").alias("ts_ns"),
            F.col("event_type").alias("et"),
            F.round(F.col("value") * 100).cast("bigint").alias("h"),
            _symbol("user_id").alias("symbol"),
        )
        return _book_columns(steps, ("ts_ns", "rid"))

    return stored(spark, sf_dir, "book", build)


def book_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One depth snapshot per row of `lineitem`; timestamps are days and tie heavily."""

    def build():
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        steps = lines.select(
            F.col("l_orderkey").alias("rid"),
            _ns("l_shipdate").alias("ts_ns"),
            F.col("l_returnflag").alias("et"),
            (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1_000_003).alias("h"),
            _symbol("l_partkey").alias("symbol"),
        )
        return _book_columns(steps, ("ts_ns", "rid", "h", "et"))

    return stored(spark, sf_dir, "book_large", build)


def _messages(book_df: DataFrame) -> DataFrame:
    et, h = F.col("et"), F.col("h")
    kind = (
        F.when(et.isin("click", "view"), 1).when(et == "signup", 3).when(et == "error", 2)
        .when(h % 10 == 0, 5).otherwise(4)
    )
    is_bid = F.col("rid") % 2 == 0
    away = (h % 3) * 100
    added = F.struct(
        F.col("rid").alias("order_id"),
        F.when(is_bid, 1).otherwise(-1).cast("tinyint").alias("side"),
        F.when(is_bid, F.col("bid_price_l1") - away).otherwise(F.col("ask_price_l1") + away).alias("price"),
    )
    filled = forward_fill(
        book_df.select("symbol", "trade_date", "seq", "ts_ns", "rid", "h", "et", "bid_price_l1", "ask_price_l1").withColumn(
            "event_type", kind.cast("tinyint")
        ),
        {"order": F.when(F.col("event_type") == 1, added)},
    )
    return filled.where(F.col("order").isNotNull()).select(
        "symbol", "trade_date", "seq", "ts_ns", "event_type", "order.order_id", "order.side",
        F.when(F.col("event_type") == 1, h % 190 + 10).otherwise(h % 60 + 1).alias("size"), "order.price",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order messages; cancels and executions name the latest earlier add of the symbol."""
    return stored(spark, sf_dir, "messages", lambda: _messages(book(spark, sf_dir)))


def messages_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages on the rows of `book_large`: return flags N and R stand for adds, A for executions and cancels."""

    def build():
        renamed = book_large(spark, sf_dir).withColumn(
            "et", F.when(F.col("et") == "N", "view").when(F.col("h") % 3 == 0, "purchase").otherwise("error")
        )
        return _messages(renamed)

    return stored(spark, sf_dir, "messages_large", build)


#: Rows of one file of a feed, index steps that stay together in it.
FEED_ROWS, FEED_STEP = 16_384, 1_024


def _written_once(spark: SparkSession, sf_dir: str, name: str, write) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        path = claim(spark, name)
        write(path)
        _tables[key] = spark.read.parquet(path)
    return _tables[key]


def feed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table stored as files of bounded size that arrive in any order: steps of the index are dealt by hash, in one job."""

    def write(path: str) -> None:
        build().repartition(F.expr(f"{SEQ} div {FEED_STEP}")).write.option("maxRecordsPerFile", FEED_ROWS).parquet(path)

    return _written_once(spark, sf_dir, name, write)


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with `at`, their dense index per symbol and day."""
    return feed(spark, sf_dir, "message_log", lambda: dense_index(messages(spark, sf_dir), "at"))


def _in_order(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table stored file after file in event order: a later file holds later events only.

    The rows are built once, into one folder per step; the steps are then copied in their order, each reads its own folder alone.
    """

    def write(path: str) -> None:
        rows = build()
        last = rows.agg(F.max(SEQ)).first()[0]
        step = min(50_000, max(500, last // 5))
        staged = materialise(rows.withColumn("_step", F.expr(f"{SEQ} div {step}")).repartition("_step"), f"{name}-steps", ("_step",))
        for number in range(last // step + 1):
            staged.where(F.col("_step") == number).drop("_step").coalesce(1).write.mode("append").parquet(path)

    return _written_once(spark, sf_dir, name, write)


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows with the message of the same index; the few rows before the first order have no message."""

    def build():
        columns = messages(spark, sf_dir).select(*KEYS, SEQ, "event_type", "side", "size")
        return book(spark, sf_dir).join(columns, [*KEYS, SEQ], "left")

    return _in_order(spark, sf_dir, "joined", build)


def folder_of(table: DataFrame) -> str:
    """Folder of a stored table."""
    return os.path.dirname(table.inputFiles()[0])


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic class probabilities and labels for the metric operators."""
    h, rid = F.col("h"), F.col("rid")
    weights = book(spark, sf_dir).select(
        "symbol", "trade_date", "seq",
        (F.lit(1) + (h * 37 + rid * 101) % 97).cast("double").alias("a"),
        (F.lit(1) + (h * 53 + rid * 59) % 89).cast("double").alias("b"),
        (F.lit(1) + (h * 71 + rid * 43) % 83).cast("double").alias("c"),
        ((h + rid * 5) % 3).cast("tinyint").alias("label"),
    )
    total = F.col("a") + F.col("b") + F.col("c")
    return weights.select(
        "symbol", "trade_date", "seq", "label",
        (F.col("a") / total).alias("p_down"), (F.col("b") / total).alias("p_stable"), (F.col("c") / total).alias("p_up"),
    )
