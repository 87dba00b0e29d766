"""Table contracts: column names, types and the versioned feature list."""

from pyspark.sql import types as T

# One partition of the data model is one symbol on one day. `seq`, the dense event index inside it,
# is the time axis; timestamps tie and only serve as a label.
KEYS = ("symbol", "trade_date")
SEQ = "seq"

# --- fixed values: they must equal the published contract ---
SCHEMA_VERSION = 1
SYMBOLS = ("AAPL", "AMZN", "GOOG", "INTC", "MSFT")
FEATURE_NAMES = (
    "microprice_g_dev",
    "imbalance_l1",
    "spread_ticks",
    "spread_zscore_200",
    "ofi_50",
    "ofi_200",
    "mlofi_l2_l5_w50",
    "signed_trade_flow_50",
    "tfi_50",
    "realized_vol_200",
    "queue_depletion_bid",
    "queue_depletion_ask",
    "ticker_AAPL",
    "ticker_AMZN",
    "ticker_GOOG",
    "ticker_INTC",
    "ticker_MSFT",
    "is_warm_50",
    "is_warm_200",
)
HORIZONS = (10, 50, 100)
DEADBAND_TICKS = 1
DOWN, STABLE, UP = 0, 1, 2
CLASSES = (DOWN, STABLE, UP)
TICK_SIZE = 100
EWMA_ALPHA = 0.05
IMBALANCE_BUCKETS = 11
SPREAD_BUCKETS = 5
QUOTE_THRESHOLD = 0.15
MARKOUT_EVENTS = 100
MAX_EXCHANGE_ORDER_ID = 9_000_000_000
# --- end of fixed values ---

TOB_PRICES = ("bid_price_l1", "ask_price_l1")
TOB_COLUMNS = ("bid_price_l1", "bid_size_l1", "ask_price_l1", "ask_size_l1")

ORDER_MESSAGE_CSV = T.StructType(
    [
        T.StructField("time", T.DoubleType()),
        T.StructField("event_type", T.ByteType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("price", T.LongType()),
        T.StructField("direction", T.ByteType()),
    ]
)

QUOTE_CSV = T.StructType(
    [
        T.StructField("update_id", T.LongType()),
        T.StructField("best_bid_price", T.DoubleType()),
        T.StructField("best_bid_qty", T.DoubleType()),
        T.StructField("best_ask_price", T.DoubleType()),
        T.StructField("best_ask_qty", T.DoubleType()),
        T.StructField("transaction_time", T.LongType()),
        T.StructField("event_time", T.LongType()),
    ]
)

ORDER_EVENT_COLUMNS = ("seq", "kind", "order_id", "old_id", "side", "price", "qty")


def depth_csv(levels: int) -> T.StructType:
    """Depth file layout: ask price, ask size, bid price, bid size for each level."""
    return T.StructType(
        [
            T.StructField(f"{side}_{what}_l{i}", T.LongType())
            for i in range(1, levels + 1)
            for side in ("ask", "bid")
            for what in ("price", "size")
        ]
    )


def depth_columns(levels: int) -> list[str]:
    """Depth table layout: bid before ask for each level."""
    return [f"{side}_{what}_l{i}" for i in range(1, levels + 1) for side in ("bid", "ask") for what in ("price", "size")]
