import random

import pytest
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.operators import book as B
from microbook.operators.quality import differing_rows
from microbook.sources.generate import generate_order_flow
from tests.helpers import DAY, Book, column, frame, rows

EVENT = "symbol string, trade_date date, seq bigint, kind string, order_id bigint, old_id bigint, side tinyint, price bigint, qty bigint"


def events(spark, *items):
    """(kind, id, side, price, qty[, old id])"""
    full = [("AAPL", DAY, i, e[0], e[1], e[5] if len(e) > 5 else None, e[2], e[3], e[4]) for i, e in enumerate(items)]
    return spark.createDataFrame(full, EVENT)


def test_rejections(spark):
    df = events(
        spark, ("limit", 1, 1, 100, 0), ("limit", 1, 1, 100, 5), ("limit", 1, 1, 101, 7), ("cancel", 9, None, None, None),
        ("cancel", 1, None, None, None), ("cancel", 1, None, None, None), ("market", 3, 1, None, 0), ("ioc", 4, 1, 100, 2),
    )
    out = B.classify_order_events(df)
    assert column(out, "reason") == ["bad_qty", None, "duplicate_id", "unknown_id", None, "unknown_id", "bad_qty", None]
    assert column(out, "effective_qty") == [0, 5, 0, 0, 5, 0, 0, 2]
    assert B.accepted_log(out).count() == 3


def test_replace_onto_live_id_and_side_chain(spark):
    df = events(
        spark, ("limit", 1, -1, 100, 5), ("replace", 2, None, 101, 4, 1), ("replace", 3, None, 102, 3, 2), ("replace", 4, None, 99, 2, 3)
    )
    out = B.normalise_order_events(df)
    assert rows(out.where("kind = 'limit'"), "order_id", "side", "price") == [(1, -1, 100), (2, -1, 101), (3, -1, 102), (4, -1, 99)]
    assert rows(out.where("kind = 'cancel'"), "order_id", "sub_no") == [(1, 0), (2, 0), (3, 0)]


def test_sides_of_cycles_swaps_and_reused_ids(spark):
    df = events(
        spark, ("replace", 1, None, 100, 5, 1), ("replace", 2, None, 100, 5, 3), ("replace", 3, None, 100, 5, 2),
        ("limit", 7, 1, 100, 5), ("replace", 8, None, 100, 5, 7), ("limit", 7, -1, 100, 5), ("replace", 9, None, 100, 5, 7), ("replace", 8, None, 1, 1, 8),
    )
    assert column(B.inherit_side(df), "side") == [None, None, None, 1, 1, -1, -1, 1]


def brute_replaces(stream):
    """One verdict per event: (accepted, effective sizes of its parts)."""
    live, out = {}, []
    for kind, oid, qty, old in stream:
        resting = live.get(oid, 0)
        if kind == "replace":
            if qty <= 0 or not live.get(old) or (old != oid and resting):
                out.append((False, [0]))
                continue
            gone = live[old]
            live[old] = 0
            live[oid] = qty
            out.append((True, [gone, qty]))
        elif kind == "limit":
            out.append((qty > 0 and not resting, [qty if qty > 0 and not resting else 0]))
            if qty > 0 and not resting:
                live[oid] = qty
        else:
            fine = bool(resting) and (kind == "cancel" or qty > 0)
            done = (resting if kind == "cancel" else min(qty, resting)) if fine else 0
            live[oid] = resting - done
            out.append((fine, [done]))
    return out


@pytest.mark.parametrize("seed,ids", [(1, 8), (2, 60)])
def test_replaces_have_one_verdict(spark, seed, ids):
    rng = random.Random(seed)
    stream = [
        (rng.choice(["limit", "limit", "replace", "replace", "execute", "cancel"]), rng.randrange(ids), rng.randrange(0, 12), rng.randrange(ids)) for _ in range(220)
    ]
    df = events(spark, *[(k, o, 1 if k == "limit" else None, 100, q, old if k == "replace" else None) for k, o, q, old in stream])
    classified = B.classify_replaces(df)
    got = {}
    for r in classified.orderBy("seq", "sub_no").collect():
        accepted, sizes = got.setdefault(r["seq"], (r["accepted"], []))
        assert accepted == r["accepted"]
        sizes.append(r["effective_qty"])
    want = brute_replaces(stream)
    assert [got[i] for i in range(len(stream))] == want
    assert column(B.accepted_events(df, classified), "seq") == [i for i, w in enumerate(want) if w[0]]


def test_later_rounds_of_replaces_play_only_touched_orders(spark, monkeypatch):
    """A chain in which each refusal refuses the next replace, beside 300 orders that it never touches."""
    chain = [("limit", 1_000, 1, 100, 5, None)] + [("replace", 1_001 + i, None, 100, 0 if i == 0 else 5, 1_000 + i) for i in range(6)]
    df = events(spark, *chain, *[("limit", i, 1, 100, 5, None) for i in range(300)])
    played, rule = [], B.classify_order_events

    def counted(rows, **options):
        played.append(rows.count())
        return rule(rows, **options)

    monkeypatch.setattr(B, "classify_order_events", counted)
    done = B.classify_replaces(df)
    assert rows(done.where("NOT accepted"), "order_id", "reason") == [(1_001, "bad_qty")] + [(1_002 + i, "unknown_id") for i in range(5)]
    assert played[0] == played[-1] == 313 and len(played) > 3 and max(played[1:-1]) < 20


def test_removal_of_an_unseen_order_changes_no_level(spark):
    df = message(spark, (3, 9, 1, 30, 100), (1, 1, 1, 50, 100), (4, 1, 1, 80, 100), (1, 2, 1, 5, 100))
    assert column(B.depth_by_level(df), "depth") == [0, 50, 0, 5]
    assert column(B.best_prices(df), "bid_size_l1") == [0, 50, 0, 5]


def brute_lifecycle(stream):
    live, out = {}, []
    for seq, (kind, oid, qty) in enumerate(stream):
        resting = live.get(oid, 0)
        if kind != "cancel" and qty <= 0:
            out.append((seq, "bad_qty", 0, resting))
        elif kind == "limit":
            if resting:
                out.append((seq, "duplicate_id", 0, resting))
            else:
                live[oid] = qty
                out.append((seq, None, qty, qty))
        elif not resting:
            out.append((seq, "unknown_id", 0, 0))
        else:
            done = resting if kind == "cancel" else min(qty, resting)
            live[oid] = resting - done
            out.append((seq, None, done, resting - done))
    return out


@pytest.mark.parametrize("seed,ids", [(1, 12), (2, 300)])
def test_classification_equals_state_machine(spark, monkeypatch, seed, ids):
    monkeypatch.setattr(B, "MOST_FOLDED", 20 if ids < 100 else 1_000)
    rng = random.Random(seed)
    stream = [(rng.choice(["limit", "limit", "reduce", "execute", "cancel"]), rng.randrange(ids), rng.randrange(0, 40)) for _ in range(600)]
    df = events(spark, *[(k, o, 1, 100, q) for k, o, q in stream])
    for size in (65_536, 37):
        out = B.classify_order_events(df, size=size)
        got = [(r["seq"], r["reason"], r["effective_qty"], r["remaining"]) for r in out.orderBy("seq").collect()]
        assert got == brute_lifecycle(stream)


def ladder(spark, **order):
    row = {"side": 1, "kind": "limit", "limit_price": None, **order}
    for i, (p, q) in enumerate(((100, 3), (101, 5), (102, 10)), 1):
        row |= {f"ask_price_l{i}": p, f"ask_size_l{i}": q, f"bid_price_l{i}": 99 - i, f"bid_size_l{i}": 5}
    base = frame(spark, [{k: v for k, v in row.items() if k != "limit_price"}])
    return base.withColumn("limit_price", F.lit(row["limit_price"]).cast("bigint"))


def swept(spark, **order):
    return B.sweep_ladder(ladder(spark, **order), 3).first().asDict()


def test_sweep_ladder(spark):
    full = swept(spark, limit_price=102, qty=12)
    assert (full["filled_qty"], full["levels_touched"], full["rests_qty"]) == (12, 3, 0)
    assert full["avg_price"] == pytest.approx((300 + 505 + 408) / 12)
    market = swept(spark, kind="market", qty=7)
    assert (market["filled_qty"], market["levels_touched"], market["dropped_qty"]) == (7, 2, 0)
    ioc = swept(spark, kind="ioc", limit_price=100, qty=10)
    assert (ioc["filled_qty"], ioc["rests_qty"], ioc["dropped_qty"]) == (3, 0, 7)
    outside = swept(spark, limit_price=99, qty=4)
    assert (outside["filled_qty"], outside["avg_price"], outside["rests_qty"]) == (0, None, 4)


def test_sweep_orders_equals_sequential_book(spark):
    rng = random.Random(11)
    book, resting = Book(), []
    for oid in range(1, 60):
        side, price, qty = rng.choice([1, -1]), 0, rng.randrange(1, 20)
        price = (99 if side == 1 else 101) - side * rng.randrange(0, 4)
        book.orders[oid] = [side, price, qty, oid]
        resting.append((1, oid, side, price, qty, oid))
    schema = "sweep int, order_id bigint, side tinyint, price bigint, remaining bigint, entry_seq bigint"
    maker = spark.createDataFrame(resting, schema)
    taker = spark.createDataFrame([(1, 12, 1, "limit", 103, 90)], "sweep int, taker_id bigint, side int, kind string, limit_price bigint, qty bigint")
    want, _ = book.fills(12, 1, 90, 103)
    got = B.sweep_orders(maker, taker, by=("sweep",)).orderBy("fill_no").collect()
    assert [(r["taker_id"], r["maker_id"], r["price"], r["quantity"]) for r in got] == want
    assert all(r["self_trade"] == (r["maker_id"] == 12) for r in got)


def message(spark, *items):
    """(type, id, side, size, price)"""
    return frame(spark, [dict(zip(("event_type", "order_id", "side", "size", "price"), m), ts_ns=i) for i, m in enumerate(items)])


def test_queue_ahead_and_depth(spark):
    df = message(spark, (1, 1, 1, 10, 100), (1, 2, 1, 5, 100), (4, 1, 1, 4, 100), (1, 3, 1, 7, 100), (5, 0, 1, 9, 100), (3, 2, 1, 5, 100))
    assert column(B.depth_by_level(df), "depth") == [10, 15, 11, 18, 18, 13]
    assert column(B.queue_ahead(df), "queue_ahead") == [0, 10, 11]
    start = spark.createDataFrame([("AAPL", DAY, 1, 100, 50)], "symbol string, trade_date date, side bigint, price bigint, size bigint")
    assert column(B.depth_by_level(df, start), "depth") == [60, 65, 61, 68, 68, 63]


def test_best_prices_and_removal(spark):
    df = message(spark, (1, 1, 1, 10, 100), (1, 2, -1, 5, 105), (1, 3, 1, 7, 101), (3, 3, 1, 7, 101), (3, 1, 1, 10, 100))
    for size in (1, 2, 1_000):
        out = B.best_prices(df, size=size)
        assert column(out, "bid_price_l1") == [100, 100, 101, 100, None]
        assert column(out, "bid_size_l1") == [10, 10, 7, 10, 0]
        assert column(out, "ask_price_l1") == [None, 105, 105, 105, 105]


def test_ladder_does_not_depend_on_chunks(spark, sf):
    messages = fx.messages(spark, sf)
    base = B.ladder_over_time(messages, 3)
    for size in (11, 64):
        assert differing_rows(base, B.ladder_over_time(messages, 3, size=size)).count() == 0


def test_generated_flow(spark):
    flow = generate_order_flow(spark, 500, ["AAPL", "MSFT"], seed=42)
    assert flow.count() == 1_000
    assert flow.where("bid_price_l1 >= ask_price_l1").count() == 0
    again = generate_order_flow(spark, 500, ["AAPL", "MSFT"], seed=42).repartition(3)
    assert differing_rows(flow, again).count() == 0
    pdf = flow.toPandas().sort_values(["symbol", "seq"])
    assert (pdf.groupby("symbol")["ts_ns"].diff().dropna() >= 0).all()
    assert set(pdf["event_type"]) == {1, 3, 4}
    classified = B.classify_order_events(B.order_events_of(flow))
    checks = {r["check"]: r["violations"] for r in B.book_invariants(classified, B.best_prices(flow)).collect()}
    assert checks["double_cancel"] == checks["negative_remaining"] == checks["empty_top"] == 0


def test_book_at_and_locate(spark):
    df = events(spark, ("limit", 1, 1, 100, 5), ("limit", 2, -1, 105, 4), ("reduce", 1, 1, 100, 2), ("cancel", 2, None, None, None))
    at = B.book_at(B.classify_order_events(df), spark.createDataFrame([("AAPL", DAY, 1), ("AAPL", DAY, 3)], "symbol string, trade_date date, at_seq bigint"))
    assert rows(at, "at_seq", "order_id", "side", "price", "remaining") == [(1, 1, 1, 100, 5), (1, 2, -1, 105, 4), (3, 1, 1, 100, 3)]
    ids = spark.createDataFrame([("AAPL", DAY, 1), ("AAPL", DAY, 2)], "symbol string, trade_date date, order_id bigint")
    assert rows(B.locate_orders(ids, at.where("at_seq = 3")), "order_id", "remaining") == [(1, 3)]


def test_ladder_with_initial_depth(spark):
    df = message(spark, (1, 1, 1, 10, 100), (3, 0, -1, 4, 105), (3, 0, -1, 2, 105), (1, 2, -1, 3, 104))
    start = spark.createDataFrame([("AAPL", DAY, -1, 105, 6), ("AAPL", DAY, -1, 107, 1)], "symbol string, trade_date date, side bigint, price bigint, size bigint")
    for size in (1, 2, 100):
        out = B.ladder_over_time(df, 2, start, size=size)
        assert column(out, "ask_price_l1") == [105, 105, 107, 104]
        assert column(out, "ask_size_l1") == [6, 2, 1, 3]
        assert column(out, "ask_price_l2") == [107, 107, None, 107]


def brute_ladder(stream, levels):
    """(type, id, side, size, price) -> best levels after each message; every id is entered once."""
    live, sizes, out = {}, {}, []
    for kind, oid, side, size, price in stream:
        change = size if kind == 1 else -min(size, live.get(oid, 0)) if kind in (2, 4) else -live.get(oid, 0) if kind == 3 else 0
        live[oid] = live.get(oid, 0) + change
        sizes[side, price] = sizes.get((side, price), 0) + change
        cells = []
        tops = {s: sorted((p for (t, p), q in sizes.items() if t == s and q > 0), key=lambda p: -s * p) for s in (1, -1)}
        for i in range(levels):
            for s in (1, -1):
                cells += [tops[s][i], sizes[s, tops[s][i]]] if i < len(tops[s]) else [None, 0]
        out.append(tuple(cells))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_ladder_equals_messages_played_one_by_one(spark, levels):
    rng = random.Random(levels)
    orders, stream = {}, []
    for oid in range(400):
        if orders and rng.random() < 0.5:
            old = rng.choice(list(orders))
            stream.append((rng.choice((2, 3, 4, 5)), old, orders[old][0], rng.randrange(1, 9), orders[old][1]))
        else:
            orders[oid] = rng.choice((1, -1)), 100 + rng.randrange(-15, 15)
            stream.append((1, oid, orders[oid][0], rng.randrange(1, 9), orders[oid][1]))
    wide = [f"{s}_{w}_l{i}" for i in range(1, levels + 1) for s in ("bid", "ask") for w in ("price", "size")]
    for size in (3, 16):
        out = B.ladder_over_time(message(spark, *stream), levels, size=size).orderBy("seq").collect()
        assert [tuple(r[c] for c in wide) for r in out] == brute_ladder(stream, levels)


def test_intervals_do_not_depend_on_chunks(spark, sf):
    changed = B.effective_changes(fx.messages(spark, sf)).withColumnRenamed("_change", "change")

    def covered(size):
        spans = B.level_intervals(changed, size=size).withColumn("until", F.coalesce("until", F.lit(5_000)))
        return spans.groupBy("symbol", "side", "price", "quantity").agg(F.sum(F.col("until") - F.col("begin")).alias("n"))

    assert differing_rows(covered(7), covered(65_536)).count() == 0


def test_cover_is_exact_and_short(spark):
    rng = random.Random(5)
    spans = [(a, a + rng.randrange(1, 300)) for a in (rng.randrange(1_000) for _ in range(60))] + [(0, 1 << 20), (3, 4)]
    df = spark.createDataFrame(spans, "a bigint, b bigint")
    nodes = df.select("a", "b", F.explode(B._cover(F.col("a"), F.col("b"))).alias("x")).select("a", "b", "x.*").collect()
    for a, b in spans:
        own = sorted((r["node"] << r["h"], (r["node"] + 1) << r["h"]) for r in nodes if (r["a"], r["b"]) == (a, b))
        own = sorted(set(own))
        assert own[0][0] == a and own[-1][1] == b and all(x[1] == y[0] for x, y in zip(own, own[1:])) and len(own) <= 2 * (b - a).bit_length()


def test_many_positions(spark):
    rng = random.Random(3)
    stream = []
    for oid in range(150):
        stream.append(("limit", oid, rng.choice((1, -1)), 100, rng.randrange(1, 9)))
        if rng.random() < 0.7:
            stream.append((rng.choice(("reduce", "cancel")), rng.randrange(oid + 1), None, None, rng.randrange(1, 9)))
    classified = B.classify_order_events(events(spark, *stream))
    stops = spark.createDataFrame([("AAPL", DAY, i) for i in (-1, 0, 7, *range(20, 400, 3))], "symbol string, trade_date date, at_seq bigint")
    live, want = {}, set()
    for i in range(400):
        if i < len(stream):
            kind, oid, side, _, qty = stream[i]
            if kind == "limit":
                live[oid] = [side, qty, i]
            elif live.get(oid, (0, 0))[1]:
                live[oid][1] -= min(qty, live[oid][1]) if kind == "reduce" else live[oid][1]
        if i in (0, 7) or (i >= 20 and (i - 20) % 3 == 0):
            want |= {(i, oid, s, q, e) for oid, (s, q, e) in live.items() if q}
    for size in (65_536, 16):
        got = B.book_at(classified, stops, size=size)
        assert {tuple(r) for r in got.select("at_seq", "order_id", "side", "remaining", "entry_seq").collect()} == want
