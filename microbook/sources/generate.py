"""Synthetic order flow for tests: the same rows for any partitioning, because every value is a hash of its row key."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.partitioning import forward_fill, running_sum
from microbook.schema import KEYS, SEQ, SYMBOLS, TICK_SIZE

# Event mix 5:2:1 of types 1, 3 and 4; start price, tick and level count.
EVENT_MIX = ((1, 5), (3, 2), (4, 1))
START_MID = 5_650_000
LEVELS = 10


def generate_order_flow(
    spark: SparkSession,
    n_events: int,
    symbols: Sequence[str] = SYMBOLS,
    seed: int = 42,
    *,
    trade_date: str = "2012-06-21",
    levels: int = LEVELS,
) -> DataFrame:
    """Messages with the depth after each of them: never crossed, time never goes back."""
    names = F.array(*[F.lit(s) for s in symbols])
    ids = spark.range(n_events * len(symbols)).select(
        F.element_at(names, (F.col("id") % len(symbols) + 1).cast("int")).alias("symbol"),
        F.lit(trade_date).cast("date").alias("trade_date"),
        F.expr(f"id div {len(symbols)}").alias(SEQ),
    )

    def draw(purpose: str, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), "symbol", SEQ), F.lit(below))

    mix = draw("type", sum(w for _, w in EVENT_MIX))
    kind, bound = None, 0
    for event_type, weight in EVENT_MIX:
        bound += weight
        kind = F.when(mix < bound, event_type) if kind is None else kind.when(mix < bound, event_type)
    rows = ids.withColumns(
        {
            "event_type": F.when(F.col(SEQ) == 0, 1).otherwise(kind).cast("tinyint"),
            "_step": draw("step", 3) - 1,
            "_gap": draw("gap", 2_000_000),
            "_h": draw("size", 401),
        }
    )
    walked = running_sum(rows, {"_walk": F.col("_step"), "_time": F.col("_gap")})
    side = F.when(draw("side", 2) == 0, 1).otherwise(-1)
    order = F.struct(
        (F.col(SEQ) + 1).alias("order_id"), side.cast("tinyint").alias("side"),
        (F.lit(START_MID) + F.col("_walk") * TICK_SIZE - side * (draw("away", levels) + 1) * TICK_SIZE).alias("price"),
    )
    open_ns = F.unix_date("trade_date").cast("bigint") * 86_400_000_000_000 + 34_200_000_000_000
    placed = forward_fill(walked, {"_order": F.when(F.col("event_type") == 1, order)})
    mid = F.lit(START_MID) + F.col("_walk") * TICK_SIZE
    depth = []
    for i in range(1, levels + 1):
        for name, sign in (("bid", -1), ("ask", 1)):
            depth.append((mid + sign * i * TICK_SIZE).alias(f"{name}_price_l{i}"))
            depth.append((F.lit(100) + draw(f"{name}{i}", 401)).alias(f"{name}_size_l{i}"))
    return placed.select(
        *KEYS, SEQ, (open_ns + F.col("_time")).alias("ts_ns"), "event_type", "_order.order_id", "_order.side",
        (F.lit(100) + F.col("_h")).alias("size"), "_order.price", *depth,
    )
