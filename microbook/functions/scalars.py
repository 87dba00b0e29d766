"""Column expressions on one row. All return Column and stay inside generated code."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from microbook.schema import IMBALANCE_BUCKETS, SPREAD_BUCKETS, SYMBOLS, TICK_SIZE


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mid_x2(bid="bid_price_l1", ask="ask_price_l1") -> Column:
    """Twice the mid price: exact in integers."""
    return _c(bid) + _c(ask)


def mid(bid="bid_price_l1", ask="ask_price_l1") -> Column:
    return mid_x2(bid, ask) / F.lit(2.0)


def mid_floor(bid="bid_price_l1", ask="ask_price_l1") -> Column:
    """Integer mid, rounded down."""
    return F.shiftright(mid_x2(bid, ask), 1)


def microprice(bid="bid_price_l1", bid_size="bid_size_l1", ask="ask_price_l1", ask_size="ask_size_l1") -> Column:
    """Size-weighted price; NULL when both sides are empty."""
    weighted = _c(bid_size) * _c(ask) + _c(ask_size) * _c(bid)
    return F.try_divide(weighted.cast("double"), (_c(bid_size) + _c(ask_size)).cast("double"))


def imbalance(bid_size="bid_size_l1", ask_size="ask_size_l1") -> Column:
    """(bid - ask) / (bid + ask) in [-1, 1]; NULL when both sides are empty."""
    return F.try_divide(
        (_c(bid_size) - _c(ask_size)).cast("double"), (_c(bid_size) + _c(ask_size)).cast("double")
    )


def spread_ticks(tick_size: int = TICK_SIZE, bid="bid_price_l1", ask="ask_price_l1") -> Column:
    if tick_size <= 0:
        raise ValueError("tick_size must be positive")
    return (_c(ask) - _c(bid)).cast("double") / F.lit(float(tick_size))


def _clip(value: Column, buckets: int) -> Column:
    return F.least(F.greatest(value.cast("int"), F.lit(0)), F.lit(buckets - 1))


def imbalance_bucket(buckets: int = IMBALANCE_BUCKETS, value: Column | None = None) -> Column:
    """Equal-width bucket over [-1, 1]; an empty book counts as balanced."""
    balance = F.coalesce(imbalance() if value is None else value, F.lit(0.0))
    return _clip((balance + 1.0) / 2.0 * F.lit(buckets), buckets)


def spread_bucket(buckets: int = SPREAD_BUCKETS, tick_size: int = TICK_SIZE, value: Column | None = None) -> Column:
    """One bucket per whole tick of spread, wide spreads share the last one."""
    ticks = spread_ticks(tick_size) if value is None else value
    return _clip(F.floor(ticks) - 1, buckets)


def state_id(imb_buckets: int = IMBALANCE_BUCKETS, spread_buckets: int = SPREAD_BUCKETS, tick_size: int = TICK_SIZE) -> Column:
    return imbalance_bucket(imb_buckets) * F.lit(spread_buckets) + spread_bucket(spread_buckets, tick_size)


def symbol_one_hot(vocabulary: Sequence[str] = SYMBOLS, symbol: str | Column = "symbol") -> dict[str, Column]:
    return {f"ticker_{s}": F.when(_c(symbol) == s, 1.0).otherwise(0.0) for s in vocabulary}


def warm_flags(windows: Sequence[int] = (50, 200), index: str | Column = "seq") -> dict[str, Column]:
    """1.0 once the row index (0-based) has reached the window."""
    return {f"is_warm_{n}": (_c(index) >= n).cast("float") for n in windows}


def opposite(side: str | Column = "side") -> Column:
    return (-_c(side)).cast("tinyint")


def aggressor_side(side: str | Column = "side") -> Column:
    """An execution names the side of the resting order; the aggressor is on the other one."""
    return opposite(side)


def probs_to_score(down="p_down", up="p_up") -> Column:
    """P(up) - P(down) in [-1, 1]."""
    return _c(up) - _c(down)


def argmax_class(probs: Sequence[str] = ("p_down", "p_stable", "p_up")) -> Column:
    """First class with the largest probability."""
    best = F.greatest(*[F.col(p) for p in probs])
    picks = [F.when(F.col(p) == best, i) for i, p in enumerate(probs)]
    return F.coalesce(*picks).cast("tinyint")


def prob_of_label(label="label", probs: Sequence[str] = ("p_down", "p_stable", "p_up")) -> Column:
    first, *rest = list(enumerate(probs))
    return reduce(lambda acc, p: acc.when(_c(label) == p[0], F.col(p[1])), rest, F.when(_c(label) == first[0], F.col(first[1])))


def signed_markout(future_mid="future_mid", price="fill_price", side="side_sign", tick_size: int = TICK_SIZE) -> Column:
    """Move of the mid in ticks since the fill, positive when it favours the quoting side."""
    return ((_c(future_mid) - _c(price)) * _c(side)).cast("double") / F.lit(float(tick_size))


def session_time_ns(trade_date: str | Column, seconds: str | Column) -> Column:
    """Nanoseconds since the epoch from a UTC date and seconds after midnight (fraction truncated to ns)."""
    midnight = F.unix_date(_c(trade_date)).cast("bigint") * F.lit(86_400_000_000_000)
    return midnight + (_c(seconds) * F.lit(1e9)).cast("bigint")


def millis_to_ns(millis: str | Column) -> Column:
    return _c(millis) * F.lit(1_000_000)


def to_fixed_point(value: str | Column, scale: float = 1e8) -> Column:
    """Decimal text or double to integer units, truncating."""
    return (_c(value).cast("double") * F.lit(scale)).cast("bigint")


def timestamp_of_ns(ts_ns: str | Column = "ts_ns") -> Column:
    """Microsecond timestamp, for watermarks and display only."""
    return F.timestamp_micros(F.floor(_c(ts_ns) / F.lit(1000)))
