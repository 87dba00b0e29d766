"""Row filters (DataFrame -> DataFrame) and the boolean columns behind them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microbook.functions.scalars import aggressor_side
from microbook.schema import DOWN, MAX_EXCHANGE_ORDER_ID, QUOTE_THRESHOLD, UP

TRADE_TYPES = (4, 5)


def both_sides_present(bid="bid_price_l1", ask="ask_price_l1") -> Column:
    return F.col(bid).isNotNull() & F.col(ask).isNotNull()


def posts_bid(score: str | Column = "score", threshold: float = QUOTE_THRESHOLD) -> Column:
    return (F.col(score) if isinstance(score, str) else score) <= F.lit(threshold)


def posts_ask(score: str | Column = "score", threshold: float = QUOTE_THRESHOLD) -> Column:
    return (F.col(score) if isinstance(score, str) else score) >= F.lit(-threshold)


def extract_trades(messages: DataFrame) -> DataFrame:
    """Executions as trade prints, with the aggressor's side."""
    keep = [c for c in ("symbol", "trade_date", "seq", "ts_ns", "order_id", "size", "price") if c in messages.columns]
    return messages.where(F.col("event_type").isin(*TRADE_TYPES)).select(*keep, aggressor_side().alias("aggressor_side"))


def route_order_ops(messages: DataFrame, partial_as: str = "reduce") -> DataFrame:
    """Messages that change the book by instruction: column `op` is add, cancel or reduce.

    `partial_as="reduce"` keeps the true size of a partial cancel, `"cancel"` removes the whole order.
    Executions, crosses and halts are dropped.
    """
    if partial_as not in ("reduce", "cancel"):
        raise ValueError("partial_as must be 'reduce' or 'cancel'")
    op = (
        F.when(F.col("event_type") == 1, "add")
        .when(F.col("event_type") == 2, partial_as)
        .when(F.col("event_type") == 3, "cancel")
    )
    return messages.withColumn("op", op).where(F.col("op").isNotNull())


def exchange_orders(df: DataFrame, order_id: str = "order_id", limit: int = MAX_EXCHANGE_ORDER_ID) -> DataFrame:
    """Leave out the ids reserved for own quotes."""
    return df.where(F.col(order_id) < limit)


def directional(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isin(DOWN, UP))


def crossed_or_locked(df: DataFrame) -> DataFrame:
    return df.where(F.col("bid_price_l1") >= F.col("ask_price_l1"))


def two_sided(df: DataFrame) -> DataFrame:
    return df.where(both_sides_present())
