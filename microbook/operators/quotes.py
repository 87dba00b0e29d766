"""Quote policies and their fills against the recorded trade tape."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microbook.functions.predicates import both_sides_present, posts_ask, posts_bid
from microbook.functions.scalars import mid_floor, signed_markout
from microbook.operators.joins import at_offset
from microbook.operators.metrics import summarise_markouts
from microbook.schema import KEYS, MARKOUT_EVENTS, QUOTE_THRESHOLD, SEQ, TICK_SIZE

QUOTE_TTL = 100


def _quotes(tob: DataFrame, policy: str, post_bid: Column, post_ask: Column, by: Sequence[str]) -> DataFrame:
    def quote(side: int, price: str, posted: Column) -> Column:
        return F.when(posted, F.struct(F.lit(side).cast("tinyint").alias("side_sign"), F.col(price).alias("price")))

    posted = F.array_compact(F.array(quote(1, "bid_price_l1", post_bid), quote(-1, "ask_price_l1", post_ask)))
    return tob.where(both_sides_present()).select(*by, SEQ, F.lit(policy).alias("policy"), F.inline(posted))


def naive_quotes(tob: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """One lot on each side at the best price after every event."""
    return _quotes(tob, "naive", F.lit(True), F.lit(True), by)


def score_aware_quotes(
    tob_with_score: DataFrame, threshold: float = QUOTE_THRESHOLD, *, score: str = "last_score", by: Sequence[str] = KEYS
) -> DataFrame:
    """Like `naive_quotes`, but without the side that the score expects to be run over."""
    return _quotes(tob_with_score, "ml_aware", posts_bid(score, threshold), posts_ask(score, threshold), by)


def quote_fills(
    quotes: DataFrame, trades: DataFrame, ttl_events: int = QUOTE_TTL, *, by: Sequence[str] = KEYS
) -> DataFrame:
    """First later trade within `ttl_events` whose aggressor comes from the other side at the quote's price or through it.

    Trades are gathered into blocks of `ttl_events` messages, so a block list holds at most `ttl_events` trades. A quote meets
    the list of its own and the next block in one row and picks the first match there; no quote-trade pairs are built.
    """
    block = F.expr(f"{SEQ} div {ttl_events}")
    trade = F.struct(F.col(SEQ).alias("seq"), F.col("price").alias("price"), F.col("aggressor_side").alias("aggressor"))
    blocks = (
        trades.select(*by, F.explode(F.array(block, block - 1)).alias("_block"), trade.alias("_trade"))
        .groupBy(*by, "_block")
        .agg(F.sort_array(F.collect_list("_trade")).alias("_trades"))
    )
    side = F.col("side_sign")

    def hits(t: Column) -> Column:
        timely = (t["seq"] > F.col(SEQ)) & (t["seq"] <= F.col(SEQ) + ttl_events)
        return timely & (t["aggressor"] == -side) & ((t["price"] - F.col("price")) * side <= 0)

    met = quotes.withColumn("_block", block).join(blocks, [*by, "_block"])
    first = F.get(F.filter("_trades", hits), F.lit(0))
    return (
        met.withColumn("_hit", first).where("_hit IS NOT NULL")
        .select(
            *by, "policy", F.col(SEQ).alias("quote_seq"), "side_sign", F.col("price").alias("fill_price"),
            F.col("_hit.seq").alias(SEQ), F.lit(1).cast("bigint").alias("quantity"),
        )
    )


def own_fills(fills: DataFrame, own: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Fills that involve an own quote, once per own order; the id sits on either side of the fill."""
    sides = F.array_distinct(F.array("taker_id", "maker_id"))
    return fills.withColumn("order_id", F.explode(sides)).join(own.select(*by, "order_id", "side_sign"), [*by, "order_id"])


def markouts(
    fills: DataFrame, tob: DataFrame, k: int = MARKOUT_EVENTS, *, tick_size: int = TICK_SIZE, by: Sequence[str] = KEYS
) -> DataFrame:
    """Add `markout` in ticks: the mid `k` events after the fill (or at the end) against the fill price.

    A fill without an event index (filled on entry) keeps a NULL markout.
    """
    mids = tob.select(*by, SEQ, mid_floor().alias("future_mid"))
    found = at_offset(fills, mids, offset=k, values=("future_mid",), by=by)
    return found.withColumn("markout", signed_markout(tick_size=tick_size))


def policy_summary(
    quotes: DataFrame, fills_with_markout: DataFrame, tob: DataFrame, *, tick_size: int = TICK_SIZE
) -> DataFrame:
    """Quotes, fills, fill rate, markouts and adverse selection per symbol and policy."""
    posted = quotes.groupBy("symbol", "policy").agg(F.count("*").alias("quotes_posted"))
    mids = tob.groupBy("symbol").agg(F.avg(mid_floor()).alias("mid_avg"))
    return summarise_markouts(posted, fills_with_markout, mids, tick_size=tick_size)


def compare_policies(summary: DataFrame, base: str = "naive", other: str = "ml_aware") -> DataFrame:
    """One row per symbol with both policies side by side and their differences."""
    columns = ("quotes_posted", "fills", "fill_rate", "markout_mean_ticks", "adverse_selection_bps", "gross_pnl_ticks")

    def of(policy: str, column: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(column)))

    cells = []
    for c in columns:
        cells += [of(base, c).alias(f"{c}_{base}"), of(other, c).alias(f"{c}_{other}"), (of(other, c) - of(base, c)).alias(f"{c}_delta")]
    return summary.groupBy("symbol").agg(*cells)
