"""Trade-flow features over the last N trades of a symbol."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.operators.windows import WindowFeature, _full, _rolling, _running, add_features, rolling_sum
from microbook.partitioning import CHUNK, dense_index
from microbook.schema import KEYS

TRADE_NO = "trade_no"


def signed_trade_flow(window: int, *, partial: bool = False) -> WindowFeature:
    """Sum of aggressor side times size over the last `window` trades."""
    signed = F.col("aggressor_side").cast("bigint") * F.col("size")
    return rolling_sum(signed, window, f"signed_trade_flow_{window}", partial=partial)


def trade_flow_imbalance(window: int, *, partial: bool = False) -> WindowFeature:
    """(buys - sells) / (buys + sells) over the last `window` trades, 0 without volume."""
    name = f"tfi_{window}"
    buy = F.when(F.col("aggressor_side") == 1, F.col("size")).otherwise(F.lit(0))
    sell = F.when(F.col("aggressor_side") == -1, F.col("size")).otherwise(F.lit(0))

    def totals(w):
        return {"_buys": _running(buy, w), "_sells": _running(sell, w)}

    def rolled(w):
        return {"_buy": _rolling("_buys", window, w), "_sell": _rolling("_sells", window, w)}

    def ratio(w):
        volume = F.col("_buy") + F.col("_sell")
        share = F.when(volume == 0, 0.0).otherwise(
            F.try_divide((F.col("_buy") - F.col("_sell")).cast("double"), volume.cast("double"))
        )
        return {name: _full(share, window, partial)}

    return WindowFeature([totals, rolled, ratio], back=window)


def add_trade_features(
    trades: DataFrame, *features: WindowFeature, by: Sequence[str] = KEYS, size: int = CHUNK
) -> DataFrame:
    """Windows over trades count trades, not messages: they run on the dense trade number `trade_no`."""
    numbered = dense_index(trades, TRADE_NO, by=by, size=size)
    return add_features(numbered, *features, by=by, seq=TRADE_NO, size=size)
