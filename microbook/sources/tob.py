"""One top-of-book table for both feeds."""

from pyspark.sql import DataFrame

from microbook.schema import TOB_COLUMNS

_LEADING = ("symbol", "trade_date", "update_id", "seq", "ts_ns")


def depth_to_tob(joined: DataFrame) -> DataFrame:
    """Best prices and sizes of a depth table. The order lives in `ts_ns` and `seq`; sort only where rows are shown."""
    return joined.select(*[c for c in _LEADING if c in joined.columns], *TOB_COLUMNS)


def quotes_to_tob(quotes: DataFrame) -> DataFrame:
    return quotes.select(*[c for c in _LEADING if c in quotes.columns], *TOB_COLUMNS)


def in_time_order(tob: DataFrame) -> DataFrame:
    """Global time order; ties keep the event order."""
    return tob.orderBy("ts_ns", *[c for c in ("symbol", "seq") if c in tob.columns])
