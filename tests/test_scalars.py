import math

import pytest
from pyspark.sql import functions as F

from microbook.functions import predicates as P
from microbook.functions import scalars as S
from microbook.schema import FEATURE_NAMES
from tests.helpers import column, frame, tob


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()["x"]


def test_microprice(spark):
    df = tob(spark, [(100, 10, 102, 10), (100, 90, 102, 10), (100, 0, 102, 0)])
    assert column(df.withColumn("m", S.microprice()), "m") == [101.0, pytest.approx(101.8), None]


def test_imbalance(spark):
    df = tob(spark, [(1, a, 2, b) for a, b in ((10, 10), (100, 0), (0, 100), (0, 0), (3, 5))])
    assert column(df.withColumn("i", S.imbalance()), "i") == [0.0, 1.0, -1.0, None, -0.25]


def test_spread_and_mid(spark):
    df = tob(spark, [(10_000, 1, 10_100, 1), (10_001, 1, 10_002, 1)])
    out = df.withColumns({"s": S.spread_ticks(100), "m": S.mid(), "f": S.mid_floor()})
    assert column(out, "s") == [1.0, 0.01]
    assert column(out, "m") == [10_050.0, 10_001.5]
    assert column(out, "f") == [10_050, 10_001]
    with pytest.raises(ValueError):
        S.spread_ticks(0)


def test_buckets_clip(spark):
    df = tob(spark, [(100, 10, 200, 0), (100, 0, 200, 10), (100, 0, 200, 0), (100, 5, 2_000, 5), (100, 5, 100, 5)])
    out = df.withColumns({"i": S.imbalance_bucket(11), "s": S.spread_bucket(5)})
    assert column(out, "i") == [10, 0, 5, 5, 5]
    assert column(out, "s") == [0, 0, 0, 4, 0]


def test_score_of_probabilities(spark):
    for (down, up), want in (((0.1, 0.7), 0.6), ((0.5, 0.2), -0.3), ((0.33, 0.33), 0.0)):
        assert one(spark, S.probs_to_score(), p_down=down, p_up=up) == pytest.approx(want)


def test_time_and_fixed_point(spark):
    at = spark.sql("SELECT date'2012-06-21' AS d, 34200.123456789D AS t")
    midnight = 1_340_236_800_000_000_000
    assert at.select(S.session_time_ns("d", "t").alias("x")).first()["x"] == midnight + int(34200.123456789 * 1e9)
    assert one(spark, S.to_fixed_point(F.lit(0.123456789))) == 12_345_678
    assert one(spark, S.millis_to_ns(F.lit(7))) == 7_000_000


def test_argmax_takes_first_of_equal(spark):
    assert one(spark, S.argmax_class(), p_down=0.4, p_stable=0.4, p_up=0.2) == 0


def test_feature_contract():
    assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 19


def test_trades_and_routing(spark):
    df = frame(spark, [{"event_type": t, "order_id": 9, "side": 1, "size": 5, "price": 100, "ts_ns": t} for t in range(1, 8)])
    assert column(P.extract_trades(df), "aggressor_side") == [-1, -1]
    assert column(P.route_order_ops(df), "op") == ["add", "reduce", "cancel"]
    assert column(P.route_order_ops(df, partial_as="cancel"), "op") == ["add", "cancel", "cancel"]
    with pytest.raises(ValueError):
        P.route_order_ops(df, partial_as="other")


def test_quote_suppression_is_inclusive(spark):
    df = frame(spark, [{"score": s} for s in (-0.16, -0.15, 0.0, 0.15, 0.16)])
    assert column(df.withColumn("b", P.posts_bid()), "b") == [True, True, True, True, False]
    assert column(df.withColumn("a", P.posts_ask()), "a") == [False, True, True, True, True]


def test_markout_sign(spark):
    assert one(spark, S.signed_markout(), future_mid=10_200, fill_price=10_000, side_sign=1) == 2.0
    assert one(spark, S.signed_markout(), future_mid=10_200, fill_price=10_000, side_sign=-1) == -2.0
    assert not math.isnan(one(spark, S.signed_markout(), future_mid=10_000, fill_price=10_000, side_sign=1))
