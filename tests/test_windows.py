import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.functions.predicates import extract_trades
from microbook.operators import joins as J
from microbook.operators import trades as TR
from microbook.operators import windows as W
from microbook.operators.quality import assert_deterministic, differing_rows
from microbook.partitioning import dense_index, forward_fill, global_index, running_sum
from tests.helpers import column, frame, tob


def trade_frame(spark, signed):
    return frame(spark, [{"ts_ns": i, "size": abs(s), "aggressor_side": 1 if s > 0 else -1} for i, s in enumerate(signed)])


def test_signed_trade_flow(spark):
    df = trade_frame(spark, [10, 20, -30, 40])
    assert column(TR.add_trade_features(df, TR.signed_trade_flow(2)), "signed_trade_flow_2") == [None, 30, -10, 10]
    df = trade_frame(spark, [50, -30, 20])
    assert column(TR.add_trade_features(df, TR.signed_trade_flow(3)), "signed_trade_flow_3")[-1] == 40


def test_trade_flow_imbalance(spark):
    for signed, want in (([5, 6], 1.0), ([-5, -6], -1.0), ([50, -50], 0.0)):
        assert column(TR.add_trade_features(trade_frame(spark, signed), TR.trade_flow_imbalance(2)), "tfi_2") == [None, want]
    partial = TR.add_trade_features(
        trade_frame(spark, [100, 50, -30]), TR.signed_trade_flow(50, partial=True), TR.trade_flow_imbalance(50, partial=True)
    )
    assert column(partial, "signed_trade_flow_50")[-1] == 120
    assert column(partial, "tfi_50")[-1] == pytest.approx(2 / 3)


def test_realized_vol(spark):
    mids = tob(spark, [(10_000 + 100 * i, 1, 10_000 + 100 * i, 1) for i in range(5)])
    assert column(W.add_features(mids, W.realized_vol(4)), "realized_vol_4") == [None, None, None, pytest.approx(30_000**0.5), 200.0]
    mids = tob(spark, [(p, 1, p, 1) for p in (100, 102, 100, 102)])
    assert column(W.add_features(mids, W.realized_vol(200, partial=True)), "realized_vol_200")[-1] == pytest.approx(12**0.5)


def test_zscore_of_constant_spread(spark):
    df = tob(spark, [(100, 1, 200, 1)] * 7)
    assert column(W.add_features(df, W.spread_zscore(5)), "spread_zscore_5") == [None] * 4 + [0.0] * 3


def test_ofi_partial_window(spark):
    df = tob(spark, [(100, 100 + 10 * i, 200, 50) for i in range(6)])
    assert column(W.add_features(df, W.ofi_events(50, partial=True)), "ofi_50")[-1] == 50
    assert column(W.add_features(df, W.ofi_events(50)), "ofi_50") == [None] * 6


def test_ofi_duration(spark):
    df = frame(spark, [{"ts_ns": i * 10**9, "bid_size_l1": b, "ask_size_l1": 10} for i, b in ((1, 10), (2, 20), (3, 20))])
    assert column(W.ofi_duration(df, 5 * 10**9), "ofi") == [0, 10, 10]


def test_multi_level_ofi(spark):
    def book(grow):
        return frame(
            spark, [{f"{s}_size_l{k}": 100 + (grow * i if s == "bid" else 0) for k in range(1, 6) for s in ("bid", "ask")} for i in range(8)]
        )

    assert column(W.add_features(book(0), W.multi_level_ofi([2, 3, 4, 5], 5)), "mlofi_l2_l5_w5")[-1] == 0
    assert column(W.add_features(book(3), W.multi_level_ofi([2, 3, 4, 5], 5)), "mlofi_l2_l5_w5")[-1] == 60
    with pytest.raises(ValueError):
        W.multi_level_ofi([], 5)


@pytest.mark.parametrize("alpha", [0.5, 0.05, 0.9, 0.004, 1.0])
def test_ewma_against_recursion(spark, alpha):
    values = np.random.default_rng(3).integers(-500, 500, 6_000)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "seq": range(6_000), "x": values}))
    got = column(W.add_features(df, W.ewma("x", alpha, "y"), by=("symbol",)), "y")
    want = pd.Series(values.astype(float)).ewm(alpha=alpha, adjust=False).mean()
    assert np.allclose(got, want, rtol=0, atol=1e-8)
    short = column(W.add_features(df, W.ewma("x", alpha, "y"), by=("symbol",), size=500), "y")
    assert np.allclose(short, want, rtol=0, atol=1e-8)


@pytest.mark.parametrize("alpha", [0.05, 0.9, 1.0])
def test_exact_ewma_keeps_the_whole_history(spark, alpha):
    """One huge value at the start outlives any fixed look-back; indices have holes; chunks of any size."""
    values = np.random.default_rng(4).integers(-5, 5, 3_000).astype(float)
    values[0] = 1e30
    seqs = np.arange(3_000) * 2 + (np.arange(3_000) > 1_500) * 700
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "seq": seqs, "x": values}))
    want = pd.Series(values).ewm(alpha=alpha, adjust=False).mean()
    for size in (90, 65_536):
        got = column(W.exact_ewma(df, {"y": F.col("x")}, alpha, by=("symbol",), size=size), "y")
        assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_queue_depletion_signs(spark):
    df = tob(spark, [(100, 10 + 10 * i, 200, 200 - 10 * i) for i in range(6)])
    out = W.add_features(df, *W.queue_depletion_ewma(0.5))
    assert column(out, "queue_depletion_bid")[-1] > 0 > column(out, "queue_depletion_ask")[-1]


@pytest.mark.parametrize(
    "mids,k,band,want", [((10_000, 10_100), 1, 1, [2]), ((10_100, 10_000), 1, 1, [0]), ((10_000, 10_000), 1, 1, [1]), ((10_000, 10_100), 1, 2, [1])]
)
def test_labels(spark, mids, k, band, want):
    df = tob(spark, [(m, 1, m, 1) for m in mids])
    assert column(W.add_features(df, W.make_labels(k, band)), "label") == want


def test_labels_drop_tail(spark):
    df = tob(spark, [(100, 1, 200, 1)] * 10)
    assert W.add_features(df, W.make_labels(3)).count() == 7
    with pytest.raises(ValueError):
        W.make_labels(0)


def test_window_features_do_not_depend_on_chunks(spark, sf):
    book = fx.book(spark, sf)
    features = [W.ofi_events(50), W.multi_level_ofi([2, 3], 20), W.spread_zscore(50), W.realized_vol(50), W.make_labels(10)]

    def run(size):
        out = W.add_features(book, *features, size=size)
        return out.select("symbol", "seq", "ofi_50", "mlofi_l2_l3_w20", F.round("spread_zscore_50", 8).alias("z"), "realized_vol_50", "label")

    base = run(65_536)
    for size in (7, 64):
        assert differing_rows(base, run(size)).count() == 0
    assert_deterministic(lambda df: W.add_features(df, *features[:1], size=50).select("symbol", "seq", "ofi_50"), book)


def test_running_sum_and_fill_with_skewed_key(spark):
    n = 3_000
    pdf = pd.DataFrame({"seq": range(n), "key": ["hot" if i % 3 else f"k{i % 7}" for i in range(n)]})
    pdf["v"] = (pdf["seq"] * 37) % 11 - 5
    pdf["w"] = pdf["v"].where(pdf["seq"] % 13 == 0)
    df = spark.createDataFrame(pdf[["seq", "key", "v"]]).withColumn("w", F.when(F.col("seq") % 13 == 0, F.col("v")))
    summed = running_sum(df, {"s": F.col("v")}, by=("key",), size=100)
    got = {r["seq"]: r["s"] for r in summed.collect()}
    assert got == pdf.assign(s=pdf.groupby("key")["v"].cumsum()).set_index("seq")["s"].to_dict()
    filled = {r["seq"]: r["f"] for r in forward_fill(df, {"f": F.col("w")}, by=("key",), size=100).collect()}
    want = pdf.assign(f=pdf.groupby("key")["w"].ffill()).set_index("seq")["f"]
    assert all((filled[i] is None and pd.isna(want[i])) or filled[i] == want[i] for i in range(n))
    index = {r["seq"]: r["i"] for r in dense_index(df, "i", by=("key",), size=100).collect()}
    assert index == pdf.groupby("key").cumcount().to_dict()


def test_global_index(spark):
    df = spark.range(1_000).select(F.col("id"), (F.col("id") * 7919 % 1_000).alias("x"), (F.col("id") % 3).alias("g"))
    assert all(r["x"] == r["i"] for r in global_index(df, "i", ("x",)).collect())
    by_group = global_index(df, "i", ("x",), by=("g",)).toPandas().sort_values(["g", "x"])
    assert (by_group.groupby("g").cumcount() == by_group["i"]).all()


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
def test_asof_by_time_with_ties(spark, rows_per_task):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"symbol": rng.choice(["A", "B"], 800, p=[0.8, 0.2]), "t": np.sort(rng.integers(0, 300, 800)), "row": range(800)})
    left.loc[100:400, "t"] = 77
    right = pd.DataFrame({"symbol": rng.choice(["A", "B"], 150), "t": rng.integers(20, 280, 150), "o": range(150)})
    right["v"] = right["o"] * 10
    found = J.asof_backward(
        spark.createDataFrame(left), spark.createDataFrame(right), values=("v",), on="t", by=("symbol",), right_order="o", width=25,
        rows_per_task=rows_per_task,
    )
    got = {r["row"]: r["v"] for r in found.collect()}
    assert len(got) == 800
    for r in left.itertuples():
        seen = right[(right["symbol"] == r.symbol) & (right["t"] <= r.t)].sort_values(["t", "o"])
        assert got[r.row] == (None if seen.empty else seen["v"].iloc[-1])


def test_trade_windows_cross_chunks(spark, sf):
    trades = extract_trades(fx.messages(spark, sf))
    base = TR.add_trade_features(trades, TR.signed_trade_flow(5), TR.trade_flow_imbalance(5))
    small = TR.add_trade_features(trades, TR.signed_trade_flow(5), TR.trade_flow_imbalance(5), size=4)
    assert differing_rows(base, small).count() == 0
