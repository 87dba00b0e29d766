import math
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.catalog.queries import GIVEN_TABLE
from microbook.functions.predicates import extract_trades
from microbook.operators import metrics as Q
from microbook.operators import microprice as G
from microbook.operators import quotes as K
from microbook.operators import sampling as L
from microbook.operators.quality import differing_rows, non_finite_features
from microbook.plans import training as TN
from microbook.plans.matrix import build_feature_matrix
from microbook.schema import FEATURE_NAMES, SYMBOLS
from microbook.session import materialise
from tests.helpers import DAY, column, frame, rows, tob


def scored(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n).round(2)
    pdf = pd.DataFrame({"symbol": rng.choice(["A", "B"], n), "seq": range(n), "label": rng.integers(0, 3, n)})
    pdf[["p_down", "p_stable", "p_up"]] = p
    return pdf, spark.createDataFrame(pdf)


def test_class_share(spark):
    df = spark.createDataFrame([("A", x) for x in (0, 0, 1, 1, 1, 2)] + [("B", 1)], "symbol string, label int")
    got = {(r["symbol"], r["label"]): r["share"] for r in Q.class_share(df).collect()}
    assert [got["A", c] for c in range(3)] == pytest.approx([2 / 6, 3 / 6, 1 / 6])
    assert [got["B", c] for c in range(3)] == [0.0, 1.0, 0.0]


def test_auc_with_ties_and_floor(spark):
    pdf, df = scored(spark, 400)
    got = {r["symbol"]: r["auc"] for r in Q.auc_up_vs_down(df, min_rows=1).collect()}
    moved = pdf[pdf["label"] != 1]
    score = moved["p_up"] - moved["p_down"]
    up, down = score[moved["label"] == 2].to_numpy(), score[moved["label"] == 0].to_numpy()
    want = ((up[:, None] > down[None, :]).sum() + 0.5 * (up[:, None] == down[None, :]).sum()) / (len(up) * len(down))
    assert got["ALL"] == pytest.approx(want)
    assert all(math.isnan(r["auc"]) for r in Q.auc_up_vs_down(df).collect())


def test_reliability_edges_are_exact_quantiles(spark):
    pdf, df = scored(spark, 300)
    got = {(r["bin"]): r["n"] for r in Q.reliability_bins(df).where("symbol = 'ALL' AND class = 2").collect()}
    edges = np.quantile(pdf["p_up"], np.linspace(0, 1, 11))[1:-1]
    assert got == pd.Series(np.searchsorted(edges, pdf["p_up"])).value_counts().to_dict()


def test_undersample_is_exact_and_stable(spark):
    _, df = scored(spark, 3_000)
    keep = df.select("symbol", "seq", "label")
    sample = L.balanced_undersample(keep, 200)
    assert rows(sample.groupBy("label").count(), "label", "count") == [(0, 200), (1, 200), (2, 200)]
    assert differing_rows(sample, L.balanced_undersample(keep.repartition(7), 200)).count() == 0
    assert L.balanced_undersample(keep, 10_000).count() == 3_000


@pytest.mark.parametrize("most", [1, 10_000])
def test_undersample_by_refined_edges_equals_a_sort(spark, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_RANKED", most)
    df = spark.range(3_000).select(
        F.lit("A").alias("symbol"), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(7)).alias("seq"),  # a third of all keys are one
        F.when(F.col("id") % 10 == 9, 5).when(F.col("id") < 2_900, F.col("id") % 2).alias("label"),
    )
    for n in (1, 150, 700):
        rank = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "symbol", F.col("seq").cast("string"))), "seq"))
        want = df.where("label IS NOT NULL").withColumn("r", rank).where(F.col("r") <= n).drop("r")
        assert rows(L.balanced_undersample(df, n), *df.columns) == rows(want, *df.columns)


def test_time_split_rounds_down(spark):
    df = tob(spark, [(1, 1, 2, 1)] * 7)
    assert column(L.time_split(df, 0.7), "is_train") == [True] * 4 + [False] * 3


def test_microprice_fit_orders_states(spark):
    rng = np.random.default_rng(0)
    n, walk, out = 3_000, 10_000, []
    sizes = rng.integers(1, 100, (n, 2))
    for bid, ask in sizes:
        out.append((int(walk), int(bid), int(walk) + 100, int(ask)))
        lean = (bid - ask) / (bid + ask)
        walk += 100 * (int(rng.random() < 0.5 + 0.4 * lean) * 2 - 1)
    table = G.fit_microprice(tob(spark, out), imb_buckets=11, spread_buckets=3)
    high, low, mid = table.values[9][0], table.values[1][0], table.values[5][0]
    assert low < mid < high
    again = G.fit_microprice(tob(spark, out).repartition(5), imb_buckets=11, spread_buckets=3)
    assert np.allclose(again.values, table.values)
    sparse = G.fit_sparse_microprice(tob(spark, out), imb_buckets=11, spread_buckets=3, max_rounds=40)
    dense = G.fit_microprice(tob(spark, out), imb_buckets=11, spread_buckets=3, max_rounds=sparse.rounds)
    cells = {(r["imb_bucket"], r["sp_bucket"]): r["g"] for r in sparse.rows.collect()}
    assert cells and all(abs(dense.values[i][j] - g) < 1e-6 for (i, j), g in cells.items())
    assert {(i, j) for i, row in enumerate(dense.values) for j, g in enumerate(row) if g} <= set(cells)
    looked_up = [column(G.lookup_microprice(tob(spark, out[:20]), t), "microprice_g_dev") for t in (sparse, dense)]
    assert np.allclose(*looked_up)
    empty = G.lookup_microprice(tob(spark, out[:3]), G.MicropriceTable(()))
    assert column(empty, "microprice_g_dev") == [0.0] * 3


def test_fill_on_entry_counts_without_markout(spark):
    fills = spark.createDataFrame(
        [("A", "naive", 1, 2.0), ("A", "naive", 1, -1.0), ("A", "naive", 1, 0.5), ("A", "naive", 1, None)],
        "symbol string, policy string, quantity bigint, markout double",
    )
    quotes = spark.createDataFrame([("A", "naive", 8), ("A", "ml_aware", 3)], "symbol string, policy string, quotes_posted bigint")
    mids = spark.createDataFrame([("A", 10_000.0)], "symbol string, mid_avg double")
    out = {r["policy"]: r for r in Q.summarise_markouts(quotes, fills, mids).collect()}
    naive, other = out["naive"], out["ml_aware"]
    assert (naive["fills"], naive["fill_qty"], naive["fill_rate"]) == (4, 3, 0.5)
    assert (naive["markout_mean_ticks"], naive["markout_median_ticks"], naive["gross_pnl_ticks"]) == (0.5, 0.5, 1.5)
    assert naive["adverse_selection_bps"] == pytest.approx(-0.5 * 100 / 10_000 * 1e4)
    assert (other["fills"], other["markout_mean_ticks"], other["adverse_selection_bps"]) == (0, 0.0, 0.0)


def test_quote_fills_against_brute_force(spark, sf):
    quotes = K.naive_quotes(fx.book(spark, sf))
    trades = extract_trades(fx.messages(spark, sf))
    got = {(r["symbol"], r["quote_seq"], r["side_sign"]): r["seq"] for r in K.quote_fills(quotes, trades, 20).collect()}
    want, tape = {}, trades.toPandas()
    for q in quotes.toPandas().itertuples():
        t = tape[(tape["symbol"] == q.symbol) & (tape["seq"] > q.seq) & (tape["seq"] <= q.seq + 20) & (tape["aggressor_side"] == -q.side_sign)]
        t = t[(t["price"] - q.price) * q.side_sign <= 0]
        if len(t):
            want[q.symbol, q.seq, q.side_sign] = t["seq"].min()
    assert got == want


def test_matrix_contract_and_chunk_independence(spark, sf):
    book, trades = fx.book(spark, sf), extract_trades(fx.messages(spark, sf))
    matrix = build_feature_matrix(book, trades, GIVEN_TABLE, horizons=(10,))
    assert matrix.columns[4:-1] == list(FEATURE_NAMES)
    assert all(dict(matrix.dtypes)[f] == "float" for f in FEATURE_NAMES)
    assert matrix.count() == book.count() and non_finite_features(matrix).count() == 0
    rounded = [F.round(F.col(c).cast("double"), 3).alias(c) if c in FEATURE_NAMES else c for c in matrix.columns]
    small = build_feature_matrix(book, trades, GIVEN_TABLE, horizons=(10,), size=23)
    assert differing_rows(matrix.select(rounded), small.select(rounded)).count() == 0
    peers = build_feature_matrix(book, trades, GIVEN_TABLE, horizons=(10,), ties="peers")
    assert differing_rows(matrix.select(rounded), peers.select(rounded)).count() == 0  # timestamps are unique here
    odd = book.withColumn("symbol", F.lit("XXXX"))
    with pytest.raises(Exception, match="unknown symbol"):
        build_feature_matrix(odd, trades, GIVEN_TABLE).collect()


@pytest.fixture(scope="module")
def dataset(spark):
    path = "/root/testdata/sf0.01"
    matrix = build_feature_matrix(fx.book(spark, path), extract_trades(fx.messages(spark, path)), GIVEN_TABLE, horizons=(10, 50))
    return materialise(matrix, "matrix")


@pytest.mark.parametrize("algorithm,params", [("forest", {"numTrees": 5}), ("logistic", {}), ("boosted", {"maxIter": 2})])
def test_training_and_persistence(spark, dataset, algorithm, params):
    run = TN.train(dataset, 10, algorithm=algorithm, samples_per_class=1_000, **params)
    got = run.scored.select((F.col("p_down") + F.col("p_stable") + F.col("p_up")).alias("t"))
    assert got.where("abs(t - 1) > 1e-9").count() == 0
    pooled = run.metrics.where("symbol = 'ALL'").first()
    assert 0 < pooled["logloss"] < 2 and pooled["n"] == run.scored.count()
    assert set(column(run.metrics, "symbol", "symbol")) == {*SYMBOLS, "ALL"}
    folder = tempfile.mkdtemp(prefix="spark-")
    TN.save_model(run, folder, spark)
    loaded = TN.load_model(folder, spark)
    assert loaded.k == 10
    a, b = run.model.score(dataset), loaded.score(dataset)
    gap = Q.drift(a, b, ["symbol", "trade_date", "seq"], "score").first()
    assert gap["max_abs_diff"] < 1e-12 and gap["n"] == dataset.count()
    ranked = L.top_features(run.model.importances(spark), 5)
    assert ranked.count() == 5
    with pytest.raises(Exception):
        TN.load_model(folder + "-missing", spark)


def test_scenarios(spark, dataset):
    """Scores stay in [-1, 1], repeat, and follow the imbalance they were fitted on."""
    base = {f: 0.0 for f in FEATURE_NAMES} | {"spread_ticks": 1.0, "is_warm_50": 1.0, "is_warm_200": 1.0, "ticker_AAPL": 1.0}
    # Fixed values of the named regimes.
    heavy = {"imbalance_l1": 0.95, "ofi_50": 500.0, "ofi_200": 1500.0, "tfi_50": 0.8, "signed_trade_flow_50": 400.0}
    regimes = [heavy, {k: -v for k, v in heavy.items()}, {}, {"spread_ticks": 20.0, "spread_zscore_200": 3.5}, {"is_warm_50": 0.0, "is_warm_200": 0.0}]
    train = frame(spark, [{**base, "imbalance_l1": i / 50 - 1, "label": 2 if i > 66 else 0 if i < 33 else 1} for i in range(100)])
    model = TN.fit_model(train, "logistic")
    cases = frame(spark, [{**base, **r} for r in regimes])
    scores = column(model.score(cases), "score")
    assert all(-1 <= s <= 1 for s in scores) and scores[0] > scores[2] > scores[1]
    assert scores == column(model.score(cases.repartition(3)), "score")


def test_grid_picks_smallest_loss(spark, dataset):
    runs, best = TN.train_grid(dataset, (10, 50), algorithm="logistic", samples_per_class=500)
    losses = {k: r.metrics.where("symbol = 'ALL'").first()["logloss"] for k, r in runs.items()}
    assert best == min(losses, key=losses.get)
    tables = TN.evaluate(runs[best].scored)
    assert tables["confusion"].where("symbol = 'ALL'").count() == 3
    assert tables["brier"].where("symbol = 'ALL'").first()["brier"] < 0.7


def test_own_fills_and_policy_pairing(spark):
    fills = spark.createDataFrame([("A", DAY, 5, 1, 2)], "symbol string, trade_date date, seq bigint, taker_id bigint, maker_id bigint")
    own = spark.createDataFrame([("A", DAY, 2, 1), ("A", DAY, 9, 1)], "symbol string, trade_date date, order_id bigint, side_sign int")
    assert rows(K.own_fills(fills, own), "order_id", "side_sign") == [(2, 1)]


def test_intermediate_tables_can_be_deleted(spark):
    from microbook import session

    kept = session._written.pop(spark.sparkContext.applicationId, [])  # what other tests still read
    try:
        path = materialise(spark.range(5), "brief").inputFiles()[0]
        assert session.clean_up(spark) == 1 and session.clean_up(spark) == 0
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path).count()
    finally:
        session._written[spark.sparkContext.applicationId] = kept
