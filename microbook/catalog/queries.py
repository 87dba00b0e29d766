"""Registered queries: each operator of the library over the driver's whole tables."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.functions import predicates as P
from microbook.functions import scalars as S
from microbook.operators import book as B
from microbook.operators import joins as J
from microbook.operators import metrics as Q
from microbook.operators import microprice as G
from microbook.operators import quality as C
from microbook.operators import quotes as K
from microbook.operators import sampling as L
from microbook.operators import trades as TR
from microbook.operators import windows as W
from microbook.partitioning import dense_index, global_index
from microbook.plans import matrix as M
from microbook.plans import training as TN
from microbook.plans.backtest import run_backtest
from microbook.schema import FEATURE_NAMES, HORIZONS, KEYS, SYMBOLS, TOB_COLUMNS
from microbook.sources.tob import depth_to_tob, quotes_to_tob
from microbook.streaming import book as SB
from microbook.streaming import features as SF
from microbook.streaming import pipelines as PI

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
KEY = ("symbol", "seq")
FLOATS = ("float", "double")
GRID = {5: 99_991, 6: 999_983}
# Table used where a query needs a fitted one as a given: g = 2.5 * (imbalance bucket - 5) + 0.5 * spread bucket.
GIVEN_TABLE = G.MicropriceTable(tuple(tuple((i - 5) * 2.5 + s * 0.5 for s in range(5)) for i in range(11)))
PARTS = (0.25, 0.5, 1.0)


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def rounded(column: str, digits: int = 6):
    """Rounded to digits. Exponential averages start as short decimals, often halfway between two of them, so they are rounded to multiples
    of one part in a prime number instead."""
    exact = F.col(column).cast("double")
    if column.startswith("queue_depletion"):
        return (F.floor(exact * GRID[digits] + 0.5) / float(GRID[digits])).alias(column)
    value = F.round(exact, digits)
    return F.when(value == 0, 0.0).otherwise(value).alias(column)


def with_rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(c, digits) if c in columns else c for c in df.columns])


# --- projections ------------------------------------------------------------------------------------------------


@query
def tob_from_depth(spark, sf):
    return depth_to_tob(fx.book(spark, sf)).drop("trade_date")


@query
def tob_from_quotes(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    quotes = orders.select(
        F.col("o_orderkey").alias("update_id"),
        S.millis_to_ns(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("ts_ns"),
        S.to_fixed_point("o_totalprice").alias("bid_price_l1"),
        S.to_fixed_point(F.col("o_custkey") / 8.0).alias("bid_size_l1"),
        S.to_fixed_point(F.col("o_totalprice") + 0.25).alias("ask_price_l1"),
        S.to_fixed_point(F.col("o_orderkey") % 64 / 4.0).alias("ask_size_l1"),
    )
    return quotes_to_tob(quotes)


@query
def mid_prices(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.mid().alias("mid"), S.mid_floor().alias("mid_floor"), S.mid_x2().alias("mid_x2"))


@query
def microprice(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.microprice().alias("microprice"))


@query
def imbalance(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.imbalance().alias("imbalance"))


@query
def spread_ticks(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.spread_ticks().alias("spread_ticks"))


@query
def imbalance_bucket(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.imbalance_bucket().alias("imb_bucket"))


@query
def spread_bucket(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.spread_bucket().alias("sp_bucket"))


@query
def state_id(spark, sf):
    return fx.book(spark, sf).select(*KEY, S.state_id().alias("state"))


@query
def symbol_one_hot(spark, sf):
    return fx.book(spark, sf).select(*KEY, *[c.alias(n) for n, c in S.symbol_one_hot(SYMBOLS).items()])


@query
def warm_flags(spark, sf):
    return fx.book(spark, sf).select(*KEY, *[c.cast("double").alias(n) for n, c in S.warm_flags().items()])


@query
def score_of_probabilities(spark, sf):
    return fx.scored(spark, sf).select(*KEY, S.probs_to_score().alias("score"))


@query
def opposite_side(spark, sf):
    return fx.messages(spark, sf).select(*KEY, S.opposite().alias("opposite"))


@query
def event_times(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    day = F.to_date("ts")
    seconds = F.floor((micros - F.unix_micros(day.cast("timestamp"))) / 1_000_000).cast("double")
    return events.select(
        "event_id", (micros * 1000).alias("ts_ns"), S.millis_to_ns(F.unix_millis("ts")).alias("ts_of_millis"),
        S.session_time_ns(day, seconds).alias("ts_of_seconds"),
    )


# --- filters ----------------------------------------------------------------------------------------------------


@query
def extract_trades(spark, sf):
    return P.extract_trades(fx.messages(spark, sf)).drop("trade_date")


@query
def route_order_ops(spark, sf):
    return P.route_order_ops(fx.messages(spark, sf)).select(*KEY, "order_id", "op")


@query
def order_op_counts(spark, sf):
    ops = P.route_order_ops(fx.messages(spark, sf), partial_as="cancel")
    return ops.groupBy("symbol", "op").agg(F.count("*").alias("n"))


@query
def exchange_orders(spark, sf):
    spread_ids = fx.messages(spark, sf).select(*KEY, (F.col("order_id") * 4_500_000).alias("order_id"))
    return P.exchange_orders(spread_ids)


@query
def directional_rows(spark, sf):
    return P.directional(fx.scored(spark, sf)).select(*KEY, "label")


@query
def crossed_books(spark, sf):
    book = fx.book(spark, sf)
    bad = P.crossed_or_locked(book).groupBy("symbol").agg(F.count("*").alias("crossed"))
    counts = book.groupBy("symbol").agg(F.count("*").alias("rows"))
    return counts.join(bad, ["symbol"], "left").fillna(0, ["crossed"])


@query
def two_sided_books(spark, sf):
    book = fx.book(spark, sf)
    thin = {f"{s}_price_l1": F.when(F.col(f"{s}_size_l1") > 120, F.col(f"{s}_price_l1")) for s in ("bid", "ask")}
    return P.two_sided(book.withColumns(thin)).select(*KEY)


# --- joins ------------------------------------------------------------------------------------------------------


@query
def positional_join(spark, sf):
    joined = J.positional_join(fx.messages(spark, sf), fx.book(spark, sf))
    return joined.select(*KEY, "event_type", "order_id", "bid_price_l1", "ask_price_l1")


@query
def height_mismatch(spark, sf):
    return J.height_mismatch(fx.messages(spark, sf), fx.book(spark, sf)).select("symbol", "left_rows", "right_rows")


@query
def asof_trades(spark, sf):
    trades = P.extract_trades(fx.messages(spark, sf)).select(*KEYS, "seq", F.col("price").alias("last_price"), F.col("size").alias("last_size"))
    return J.asof_backward(fx.book(spark, sf).select(*KEYS, "seq"), trades, values=("last_price", "last_size")).drop("trade_date")


@query
def asof_peers(spark, sf):
    book = fx.book_large(spark, sf)
    right = book.select(*KEYS, "ts_ns", "seq", F.col("bid_size_l1").alias("last_rid"))
    found = J.asof_backward(
        book.select(*KEYS, "seq", "ts_ns"), right, on="ts_ns", right_order="seq", values=("last_rid",), width=10 * 86_400 * 10**9
    )
    return found.select(*KEY, "last_rid")


@query
def microprice_lookup(spark, sf):
    return G.lookup_microprice(fx.book(spark, sf), GIVEN_TABLE, "g").select(*KEY, "g")


def _classified(spark, sf):
    return B.classify_order_events(B.order_events_of(fx.messages(spark, sf)))


def _positions(spark, sf, parts=PARTS):
    """A quarter, half and all of each symbol's events."""
    last = fx.messages(spark, sf).groupBy(*KEYS).agg(F.max("seq").alias("last"))
    return last.select(*KEYS, F.explode(F.array(*[F.floor(F.col("last") * p).cast("bigint") for p in parts])).alias("at_seq"))


@query
def locate_orders(spark, sf):
    resting = B.book_at(_classified(spark, sf), _positions(spark, sf, (1.0,)))
    ids = fx.messages(spark, sf).where("event_type = 4").select(*KEYS, "order_id").distinct()
    return B.locate_orders(ids, resting.withColumnRenamed("at_seq", "_at")).select("symbol", "order_id", "side", "price", "remaining")


@query
def unknown_cancels(spark, sf):
    return B.unknown_cancels(_classified(spark, sf)).select(*KEY, "order_id")


@query
def future_mid(spark, sf):
    book = fx.book(spark, sf)
    mids = book.select(*KEYS, "seq", S.mid_floor().alias("future_mid"))
    return J.at_offset(book.select(*KEYS, "seq"), mids, offset=100, values=("future_mid",)).drop("trade_date")


# --- aggregates -------------------------------------------------------------------------------------------------


@query
def class_share(spark, sf):
    return with_rounded(Q.class_share(fx.scored(spark, sf)), "share")


@query
def state_transitions(spark, sf):
    return G.transition_counts(G.next_state_pairs(fx.book(spark, sf)))


@query
def transition_probabilities(spark, sf):
    return with_rounded(G.normalise_transitions(G.transition_counts(G.next_state_pairs(fx.book(spark, sf)))), "probability", "payoff")


@query
def fit_microprice(spark, sf):
    return with_rounded(G.fit_microprice(fx.book(spark, sf)).cells(spark), "g", digits=4)


@query
def fit_microprice_fine(spark, sf):
    """100,000 states: 2,000 imbalance buckets by 50 spread buckets, a fixed number of rounds."""
    fine = G.fit_microprice(fx.book(spark, sf), imb_buckets=2_000, spread_buckets=50, max_rounds=16, tolerance=0.0)
    return with_rounded(fine.cells(spark), "g", digits=4)


@query
def log_loss(spark, sf):
    return with_rounded(Q.log_loss(fx.scored(spark, sf)), "logloss")


@query
def auc_up_vs_down(spark, sf):
    return with_rounded(Q.auc_up_vs_down(fx.scored(spark, sf)), "auc")


@query
def brier(spark, sf):
    return with_rounded(Q.brier(fx.scored(spark, sf)), "brier")


@query
def brier_per_class(spark, sf):
    return with_rounded(Q.brier_per_class(fx.scored(spark, sf)), "brier")


@query
def reliability_bins(spark, sf):
    return with_rounded(Q.reliability_bins(fx.scored(spark, sf)), "mean_pred", "frac_pos")


@query
def confusion_matrix(spark, sf):
    return Q.confusion_matrix(fx.scored(spark, sf))


@query
def score_drift(spark, sf):
    scores = fx.scored(spark, sf).select(*KEY, S.probs_to_score().alias("score"))
    moved = scores.withColumn("score", F.col("score") + F.col("seq") % 11 * F.lit(1e-7))
    return with_rounded(Q.drift(scores, moved, KEY, "score"), "max_abs_diff", "mean_abs_diff", "rmse", digits=12)


@query
def level_quantity(spark, sf):
    book = fx.book(spark, sf)
    tops = book.select(*KEYS, F.lit(1).cast("tinyint").alias("side"), F.col("bid_price_l1").alias("price")).unionByName(
        book.select(*KEYS, F.lit(-1).cast("tinyint").alias("side"), F.col("ask_price_l1").alias("price"))
    )
    return B.level_quantity(B.depth_by_level(fx.messages(spark, sf)), tops.distinct()).drop("trade_date")


@query
def column_ranges(spark, sf):
    return C.column_ranges(fx.book(spark, sf), ["seq", "ts_ns", *[c for c in TOB_COLUMNS]])


@query
def message_checks(spark, sf):
    return C.message_checks(fx.messages(spark, sf))


# --- windows ----------------------------------------------------------------------------------------------------


@query
def ofi_duration(spark, sf):
    return W.ofi_duration(fx.book_large(spark, sf), 5 * 86_400 * 10**9).select(*KEY, "ofi")


@query
def ofi_events(spark, sf):
    return W.add_features(fx.book(spark, sf), W.ofi_events(50), W.ofi_events(200)).select(*KEY, "ofi_50", "ofi_200")


@query
def multi_level_ofi(spark, sf):
    return W.add_features(fx.book(spark, sf), W.multi_level_ofi([2, 3, 4, 5], 50)).select(*KEY, "mlofi_l2_l5_w50")


@query
def spread_zscore(spark, sf):
    return W.add_features(fx.book(spark, sf), W.spread_zscore(200)).select(*KEY, rounded("spread_zscore_200"))


@query
def realized_vol(spark, sf):
    return W.add_features(fx.book(spark, sf), W.realized_vol(200)).select(*KEY, rounded("realized_vol_200"))


@query
def queue_depletion_ewma(spark, sf):
    done = W.exact_queue_depletion(fx.book(spark, sf))
    return done.select(*KEY, rounded("queue_depletion_bid"), rounded("queue_depletion_ask"))


def _trades(spark, sf):
    return P.extract_trades(fx.messages(spark, sf))


@query
def signed_trade_flow(spark, sf):
    return TR.add_trade_features(_trades(spark, sf), TR.signed_trade_flow(50)).select(*KEY, "signed_trade_flow_50")


@query
def trade_flow_imbalance(spark, sf):
    return TR.add_trade_features(_trades(spark, sf), TR.trade_flow_imbalance(50)).select(*KEY, rounded("tfi_50", 9))


@query
def labels(spark, sf):
    return W.add_features(fx.book(spark, sf), W.make_labels(50)).select(*KEY, "label")


@query
def first_difference(spark, sf):
    return W.add_features(fx.book(spark, sf), W.first_difference("bid_size_l1", "d_bid")).select(*KEY, "d_bid")


@query
def next_state(spark, sf):
    return G.next_state_pairs(fx.book(spark, sf)).select(*KEY, "state", "next_state", "delta_mid")


@query
def row_index(spark, sf):
    return dense_index(_trades(spark, sf), "trade_no").select(*KEY, "trade_no")


def _sparse_scores(spark, sf):
    return fx.scored(spark, sf).select(*KEYS, "seq", F.when(F.col("seq") % 7 == 3, S.probs_to_score()).alias("score"))


@query
def carry_last_score(spark, sf):
    return W.carry_last_score(_sparse_scores(spark, sf)).select(*KEY, "last_score")


# --- order, heads, samples, sets -----------------------------------------------------------------------------------


@query
def time_order(spark, sf):
    rows = fx.book_large(spark, sf).select("symbol", "seq", "ts_ns")
    return global_index(rows, "position", ("ts_ns", "symbol", "seq")).drop("ts_ns")


@query
def head_per_symbol(spark, sf):
    return L.head_per_symbol(fx.book(spark, sf), 500).select(*KEY, "bid_price_l1")


@query
def time_split(spark, sf):
    return L.time_split(fx.book(spark, sf).select(*KEYS, "seq"), 0.7).drop("trade_date")


@query
def balanced_undersample(spark, sf):
    return L.balanced_undersample(fx.scored(spark, sf).select(*KEY, "label"), 1000)


@query
def best_horizon(spark, sf):
    horizons = [W.make_labels(k, out=f"label_{k}", keep_tail=True) for k in HORIZONS]
    labelled = W.add_features(fx.book(spark, sf).select(*KEYS, "seq", "bid_price_l1", "ask_price_l1"), *horizons)
    shares = labelled.agg(*[F.avg((F.col(f"label_{k}") == 1).cast("double")).alias(str(k)) for k in HORIZONS])
    losses = shares.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("logloss")) for k in HORIZONS])))
    return with_rounded(L.best_horizon(losses), "logloss")


@query
def top_of_ladder(spark, sf):
    by = ("at_seq", *KEYS)
    sizes = B.level_sizes(B.book_at(_classified(spark, sf), _positions(spark, sf)), by=by)
    return B.top_levels(sizes, 5, by=by).drop("trade_date")


@query
def pool_symbols(spark, sf):
    book = fx.book(spark, sf).select(*KEY, F.lit("book").alias("origin"))
    return book.unionByName(fx.messages(spark, sf).select(*KEY, F.lit("messages").alias("origin")))


@query
def result_difference(spark, sf):
    book = fx.book(spark, sf)
    small = W.add_features(book, W.ofi_events(50), W.spread_zscore(200), size=700).select(*KEY, "ofi_50", rounded("spread_zscore_200"))
    large = W.add_features(book, W.ofi_events(50), W.spread_zscore(200)).select(*KEY, "ofi_50", rounded("spread_zscore_200"))
    return C.differing_rows(small, large).select(*KEY, "only_in")


# --- book analytics ---------------------------------------------------------------------------------------------


def _replace_events(spark, sf):
    kind = F.when(F.col("event_type") == 1, "limit").when(F.col("event_type") == 2, "replace").when(F.col("event_type") == 3, "cancel").otherwise("ioc")
    replaced = F.col("kind") == "replace"
    rows = fx.messages(spark, sf).where("event_type <= 4").withColumn("kind", kind)
    return rows.select(
        *KEYS, "seq", "kind",
        F.when(replaced, F.col("order_id") + F.lit(1_000_000) * (F.col("seq") + 1)).otherwise(F.col("order_id")).alias("order_id"),
        F.when(replaced, F.col("order_id")).alias("old_id"),
        F.when(~replaced, F.col("side")).alias("side"), "price", F.col("size").alias("qty"),
    )


@query
def normalise_order_events(spark, sf):
    return B.normalise_order_events(_replace_events(spark, sf)).drop("trade_date")


@query
def classify_order_events(spark, sf):
    return _classified(spark, sf).select(*KEY, "kind", "order_id", "accepted", "reason", "effective_qty", "remaining")


def _all_replaces(spark, sf):
    """Replaces of missing orders, onto live ids, onto themselves and without quantity among the others."""
    seq, rows = F.col("seq"), _replace_events(spark, sf)
    replaced = F.col("kind") == "replace"
    return rows.withColumns(
        {
            "order_id": F.when(replaced & (seq % 7 == 0), F.col("old_id")).when(replaced & (seq % 11 == 0), F.lit(7)).otherwise(F.col("order_id")),
            "qty": F.when(replaced & (seq % 13 == 0), 0).otherwise(F.col("qty")),
        }
    )


@query
def classify_replaces(spark, sf):
    return B.classify_replaces(_all_replaces(spark, sf)).drop("trade_date")


@query
def accepted_events(spark, sf):
    events = _all_replaces(spark, sf)
    return B.accepted_events(events, B.classify_replaces(events)).select(*KEY, "kind", "order_id")


@query
def order_lifecycle(spark, sf):
    return B.order_lifecycle(_classified(spark, sf)).drop("trade_date")


@query
def depth_by_level(spark, sf):
    return B.depth_by_level(fx.messages(spark, sf)).select(*KEY, "side", "price", "depth")


@query
def best_prices(spark, sf):
    return B.best_prices(fx.messages(spark, sf)).drop("trade_date")


@query
def ladder_over_time(spark, sf):
    return B.ladder_over_time(fx.messages(spark, sf), 3).drop("trade_date")


@query
def sweep_ladder(spark, sf):
    buys = F.col("rid") % 2 == 0
    away = F.col("h") % 4 * 100
    orders = fx.book(spark, sf).withColumns(
        {
            "side": F.when(buys, 1).otherwise(-1),
            "kind": F.when(F.col("rid") % 3 == 0, "limit").when(F.col("rid") % 3 == 1, "market").otherwise("ioc"),
            "limit_price": F.when(buys, F.col("ask_price_l1") + away).otherwise(F.col("bid_price_l1") - away),
            "qty": F.lit(200) + F.col("h") % 1300,
        }
    )
    swept = B.sweep_ladder(orders, 5)
    return swept.select(*KEY, "filled_qty", "levels_touched", rounded("avg_price"), rounded("slippage"), "rests_qty", "dropped_qty")


@query
def book_at(spark, sf):
    return B.book_at(_classified(spark, sf), _positions(spark, sf)).drop("trade_date")


@query
def level_sizes(spark, sf):
    by = ("at_seq", *KEYS)
    sizes = B.level_sizes(B.book_at(_classified(spark, sf), _positions(spark, sf)), by=by)
    return sizes.drop("trade_date")


@query
def sweep_orders(spark, sf):
    by = ("at_seq", *KEYS, "sweep")
    resting = B.book_at(_classified(spark, sf), _positions(spark, sf))
    sides = F.array(F.lit(1).cast("tinyint"), F.lit(-1).cast("tinyint"))
    incoming = resting.select("at_seq", *KEYS).distinct().withColumn("side", F.explode(sides)).select(
        "at_seq", *KEYS, F.col("side").alias("sweep"), F.lit(999_999_999).alias("taker_id"), "side",
        F.lit("market").alias("kind"), F.lit(None).cast("bigint").alias("limit_price"), F.lit(1000).alias("qty"),
    )
    facing = resting.withColumn("sweep", (-F.col("side")).cast("tinyint"))
    fills = B.sweep_orders(facing, incoming, by=by)
    return fills.select("at_seq", "symbol", F.col("sweep").alias("side"), F.col("fill_no").cast("bigint").alias("fill_no"), "maker_id", "price", "quantity")


@query
def queue_ahead(spark, sf):
    return B.queue_ahead(fx.messages(spark, sf)).select(*KEY, "order_id", "queue_ahead")


@query
def book_invariants(spark, sf):
    return B.book_invariants(_classified(spark, sf), B.best_prices(fx.messages(spark, sf)))


# --- feature matrix ---------------------------------------------------------------------------------------------


def _rounded_matrix(matrix: DataFrame) -> DataFrame:
    five = ("spread_zscore_200", "realized_vol_200", "queue_depletion_bid", "queue_depletion_ask")
    return matrix.select(*KEY, "ts_ns", *[rounded(f, 5 if f in five else 6) for f in FEATURE_NAMES])


@query
def feature_matrix(spark, sf):
    return _rounded_matrix(M.build_feature_matrix(fx.book(spark, sf), _trades(spark, sf), GIVEN_TABLE, as_float=False))


@query
def labelled_dataset(spark, sf):
    matrix = M.build_feature_matrix(fx.book(spark, sf), _trades(spark, sf), GIVEN_TABLE, horizons=(10,))
    return M.assemble_dataset(matrix, 10).groupBy("symbol", "label").agg(F.count("*").alias("n"))


@query
def symbol_summary(spark, sf):
    rows = W.add_features(fx.book(spark, sf).select(*KEYS, "seq", *TOB_COLUMNS), W.ofi_events(50))
    summary = rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.avg(S.imbalance()).alias("mean_imbalance"), F.avg(S.spread_ticks()).alias("mean_spread"),
        F.avg("ofi_50").alias("mean_ofi_50"),
    )
    return with_rounded(summary, "mean_imbalance", "mean_spread", "mean_ofi_50")


# --- models (no SQL counterpart) -----------------------------------------------------------------------------------


def _matrix(spark, sf):
    """The feature table with all labels, stored once: models are fitted on stored features."""
    def build():
        return M.build_feature_matrix(fx.book(spark, sf), _trades(spark, sf), GIVEN_TABLE, horizons=HORIZONS)

    return fx.stored(spark, sf, "matrix", build)


@query
def train_forest(spark, sf):
    return TN.train(_matrix(spark, sf), 50).metrics


@query
def evaluate_forest(spark, sf):
    """All evaluation tables of the fitted model."""
    return TN.evaluation_report(TN.train(_matrix(spark, sf), 50).scored)


@query
def evaluation_report(spark, sf):
    """The same tables on given probabilities."""
    return with_rounded(TN.evaluation_report(fx.scored(spark, sf)), "value")


@query
def feature_importances(spark, sf):
    return L.top_features(TN.train(_matrix(spark, sf), 50).model.importances(spark), len(FEATURE_NAMES))


@query
def horizon_grid(spark, sf):
    runs, best = TN.train_grid(_matrix(spark, sf))
    losses = [run.metrics.where(F.col("symbol") == Q.POOLED).select("k", "logloss") for run in runs.values()]
    return reduce(DataFrame.unionByName, losses).withColumn("is_best", F.col("k") == best)


@query
def batch_scores(spark, sf):
    matrix = _matrix(spark, sf)
    return TN.train(matrix, 50).model.score(matrix).select(*KEY, "score")


# --- quote policies ---------------------------------------------------------------------------------------------


def _backtest(spark, sf):
    return run_backtest(fx.book(spark, sf), _trades(spark, sf), _sparse_scores(spark, sf))


@query
def naive_quotes(spark, sf):
    return K.naive_quotes(fx.book(spark, sf)).select(*KEY, "side_sign", "price")


@query
def score_aware_quotes(spark, sf):
    return _backtest(spark, sf).quotes.where("policy = 'ml_aware'").select(*KEY, "side_sign", "price")


@query
def quote_fills(spark, sf):
    return _backtest(spark, sf).fills.drop("trade_date", "future_mid", "markout")


@query
def markouts(spark, sf):
    return _backtest(spark, sf).fills.select("symbol", "policy", "quote_seq", "side_sign", "seq", rounded("markout"))


_SUMMARY_DOUBLES = ("fill_rate", "markout_mean_ticks", "markout_median_ticks", "adverse_selection_bps", "gross_pnl_ticks")


@query
def policy_summary(spark, sf):
    return with_rounded(_backtest(spark, sf).summary, *_SUMMARY_DOUBLES)


@query
def compare_policies(spark, sf):
    compared = K.compare_policies(_backtest(spark, sf).summary)
    return with_rounded(compared, *[c for c in compared.columns if c.startswith(_SUMMARY_DOUBLES)])


@query
def own_fills(spark, sf):
    fills = _trades(spark, sf).select(*KEYS, "seq", F.col("order_id").alias("maker_id"), (F.col("order_id") + 1).alias("taker_id"))
    own = fx.book(spark, sf).select(
        *KEYS, F.col("rid").alias("order_id"), F.when(F.col("rid") % 2 == 0, 1).otherwise(-1).cast("tinyint").alias("side_sign")
    )
    return K.own_fills(fills, own).select(*KEY, "order_id", "side_sign")


# --- streaming ----------------------------------------------------------------------------------------------------


def _stream(spark, table: DataFrame, files: int = 2):
    """The stored table as a stream: all of its files, a few per micro-batch in their order of writing."""
    return PI.read_event_stream(spark, fx.folder_of(table), table.schema, files_per_trigger=files)


@query
def stream_features(spark, sf):
    stream = _stream(spark, fx.joined(spark, sf))
    windows = PI.run_to_table(SF.stream_windows(stream), "windows")
    return _rounded_matrix(SF.stream_features(windows, GIVEN_TABLE, as_float=False))


#: Files of a micro-batch of the book. Its rows are packed before one task gets those of a symbol.
BOOK_FILES = 64


def _booked(table: DataFrame, levels: int, events=SB.book_events) -> DataFrame:
    """The stored feed lacks no index, so no gap is given up however long the replay takes."""
    spark = table.sparkSession
    stream = events(_stream(spark, table, BOOK_FILES))
    with SB.state_on_disk(spark, SB.state_partitions(table)):
        return PI.run_to_table(SB.stream_book(stream, at="at", levels=levels, patience_ms=None), "booked")


@query
def stream_depth(spark, sf):
    return SB.depth_rows(_booked(fx.message_log(spark, sf), 0)).drop("trade_date")


@query
def stream_best_prices(spark, sf):
    return SB.ladder_rows(_booked(fx.message_log(spark, sf), 1)).drop("trade_date")


@query
def stream_order_ops(spark, sf):
    ops = PI.order_op_stream(_stream(spark, fx.message_log(spark, sf))).select(*KEY, "order_id", "op")
    return PI.run_to_table(ops, "ops")


@query
def stream_event_log(spark, sf):
    log = fx.feed(spark, sf, "replace_log", lambda: dense_index(_all_replaces(spark, sf), "at"))
    return SB.accepted_event_log(_booked(log, 0, lambda events: events)).select(*KEY, "kind", "order_id")


def registered() -> dict[str, Query]:
    return dict(_QUERIES)
