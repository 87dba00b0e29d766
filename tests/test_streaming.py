import os
import random
import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.catalog.queries import GIVEN_TABLE, _stream
from microbook.functions.predicates import extract_trades
from microbook.operators import book as BK
from microbook.operators.metrics import drift
from microbook.operators.quality import differing_rows
from microbook.plans.matrix import build_feature_matrix
from microbook.schema import FEATURE_NAMES, KEYS, SYMBOLS
from microbook.streaming import book as SB
from microbook.streaming import features as SF
from microbook.streaming import pipelines as PI
from tests.helpers import DAY


def test_stream_equals_batch(spark, sf):
    batch = build_feature_matrix(fx.book(spark, sf), extract_trades(fx.messages(spark, sf)), GIVEN_TABLE, as_float=False)
    windows = PI.run_to_table(SF.stream_windows(_stream(spark, fx.joined(spark, sf), files=1)), "w")
    live = SF.stream_features(windows, GIVEN_TABLE, as_float=False)
    for name in FEATURE_NAMES:
        gap = drift(batch, live, [*KEYS, "seq"], name).first()
        assert gap["n"] == batch.count() and gap["max_abs_diff"] < 1e-6, name


def run_batches(spark, batches, **options):
    folder = tempfile.mkdtemp(prefix="spark-")
    schema, out = batches[0].schema, None
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = PI.read_event_stream(spark, f"{folder}/in", schema)
        out = SF.stream_windows(stream, **options)
        PI.append_stream(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def book_row(seq, bid_size=100, mid=0, event_type=None, side=None, size=None):
    row = {"seq": seq, "ts_ns": seq, "bid_price_l1": 1_000 + mid, "bid_size_l1": bid_size, "ask_price_l1": 1_000 + mid, "ask_size_l1": 50}
    row |= {f"{s}_size_l{i}": 10 for i in range(2, 6) for s in ("bid", "ask")}
    return row | {"event_type": event_type, "side": side, "size": size}


KIND = "symbol string, trade_date date, seq bigint, ts_ns bigint, bid_price_l1 bigint, bid_size_l1 bigint, ask_price_l1 bigint, ask_size_l1 bigint, " + ", ".join(
    f"{s}_size_l{i} bigint" for i in range(2, 6) for s in ("bid", "ask")
) + ", event_type int, side int, size bigint"


def live(spark, items):
    return spark.createDataFrame([tuple({**{"symbol": "AAPL", "trade_date": None}, **i}.values()) for i in items], KIND).withColumn(
        "trade_date", F.lit("2024-01-02").cast("date")
    )


def test_restart_late_rows_and_gaps(spark):
    first = live(spark, [book_row(i, 100 + 10 * i) for i in range(3)])
    second = live(spark, [book_row(1, 999), book_row(3, 130), book_row(4, 140), book_row(7, 150)])
    out = run_batches(spark, [first, second], partial=True)
    done = {r["seq"]: r for r in out.where("status = 'ok'").collect()}
    assert sorted(done) == [0, 1, 2, 3, 4, 7]
    assert [done[i]["ofi_50"] for i in (0, 1, 2, 3, 4, 7)] == [0, 10, 20, 30, 40, 50]
    assert done[7]["gap"] == 2 and done[3]["gap"] == 0
    assert [r["seq"] for r in SF.late_rows(out).collect()] == [1]


def test_partial_windows_and_emit_before(spark):
    mids = live(spark, [book_row(i, mid=m) for i, m in enumerate((0, 2, 0, 2))])
    after = run_batches(spark, [mids], partial=True)
    before = run_batches(spark, [mids], partial=True, emit="before")
    a = [r["realized_vol_200"] for r in after.orderBy("seq").collect()]
    b = [r["realized_vol_200"] for r in before.orderBy("seq").collect()]
    assert a[-1] == pytest.approx(12**0.5)
    assert b == [0.0, *a[:-1]]
    trades = live(spark, [book_row(i, event_type=4, side=-s, size=q) for i, (s, q) in enumerate(((1, 100), (1, 50), (-1, 30)))])
    flow = run_batches(spark, [trades], partial=True).orderBy("seq").collect()[-1]
    assert (flow["signed_trade_flow_50"], flow["tfi_50"]) == (120.0, pytest.approx(2 / 3))


def test_event_log_is_written_once(spark, sf):
    folder = tempfile.mkdtemp(prefix="spark-")
    source = fx.message_log(spark, sf)
    for _ in range(2):
        stream = PI.read_event_stream(spark, fx.folder_of(source), source.schema, files_per_trigger=2)
        PI.event_log_stream(stream, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    assert os.path.isdir(f"{folder}/log")
    assert differing_rows(spark.read.parquet(f"{folder}/log").select(source.columns), source).count() == 0


def test_scores_only_observe(spark, sf):
    """Scoring a stream leaves its events as they were."""
    stream = _stream(spark, fx.joined(spark, sf))
    windows = PI.run_to_table(SF.stream_windows(stream), "observed")
    scores = PI.score_stream(SF.stream_features(windows, GIVEN_TABLE), lambda f: f.withColumn("score", F.col("imbalance_l1").cast("double")))
    kept = windows.select(*KEYS, "seq", "bid_price_l1", "bid_size_l1")
    joined = kept.join(scores, [*KEYS, "seq"]).drop("score")
    assert differing_rows(joined, fx.book(spark, sf).select(kept.columns)).count() == 0


EVENT = "symbol string, trade_date date, seq bigint, kind string, order_id bigint, old_id bigint, side tinyint, price bigint, qty bigint"
RULES = ("accepted", "rejected")


def brute_book(stream, levels):
    """(reason, effective size, rest, depth at the changed level, best prices) per event, played one by one."""
    live, out = {}, []
    for _, kind, oid, old, side, price, qty in stream:
        rest = live.get(oid, (0, 0, 0))
        level, done, after, reason = (side, price), 0, 0, None
        if kind != "cancel" and qty <= 0:
            reason, after = "bad_qty", rest[2]
        elif kind in ("market", "ioc"):
            done = qty
        elif kind == "limit" and rest[2]:
            reason, after = "duplicate_id", rest[2]
        elif kind == "replace":
            was = live.get(old, (0, 0, 0))
            reason = "unknown_id" if not was[2] else "duplicate_id" if old != oid and rest[2] else None
            if not reason:
                live.pop(old)
                live[oid] = (was[0], price, qty)
                level, done, after = (was[0], price), qty, qty
        elif kind == "limit":
            live[oid], done, after = (side, price, qty), qty, qty
        elif not rest[2]:
            reason = "unknown_id"
        else:
            done = rest[2] if kind == "cancel" else min(qty, rest[2])
            after, level = rest[2] - done, rest[:2]
            if after:
                live[oid] = (*rest[:2], after)
            else:
                live.pop(oid)
        after = 0 if kind in ("market", "ioc") or (reason and kind == "replace") else after
        sizes = {}
        for s, p, q in live.values():
            sizes[s, p] = sizes.get((s, p), 0) + q
        tops = [sorted((p for s, p in sizes if s == sign), key=lambda p: -sign * p) for sign in (1, -1)]
        cells = []
        for i in range(levels):
            for sign, prices in zip((1, -1), tops):
                cells += [prices[i], sizes[sign, prices[i]]] if i < len(prices) else [None, 0]
        out.append((reason, done, after, sizes.get(level, 0) if None not in level else None, *cells))
    return out


def random_events(n, ids, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["limit", "limit", "limit", "replace", "replace", "execute", "reduce", "cancel", "ioc"])
        side = rng.choice([1, -1])
        removal = kind in ("execute", "reduce", "cancel")
        rows.append((
            i, kind, rng.randrange(ids) + (1 << 60), rng.randrange(ids) + (1 << 60) if kind == "replace" else None,
            None if removal or kind == "replace" else side, None if removal else 100 - side * rng.randrange(1, 5), rng.randrange(0, 12),
        ))
    return rows


def booked(spark, folder, files, levels=2, symbol="AAPL", **options):
    """Each list of events becomes one file and one run of the stream, with the state of the runs before."""
    for events in files:
        full = [(symbol, DAY, *event) for event in events]
        spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        with SB.state_on_disk(spark):
            out = SB.stream_book(PI.read_event_stream(spark, f"{folder}/in", spark.createDataFrame([], EVENT).schema), levels=levels, **options)
            PI.append_stream(out, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("seed,ids", [(1, 9), (2, 80)])
def test_streamed_book_equals_events_played_one_by_one(spark, seed, ids):
    """Files in disorder, several runs on one state; the same rows as the batch operators accept."""
    events = random_events(240, ids, seed)
    want = brute_book(events, 2)
    parts = [events[i::3] if seed == 1 else events[80 * i : 80 * i + 80] for i in (2, 0, 1)]
    out = booked(spark, tempfile.mkdtemp(prefix="spark-"), parts)
    got = {r["seq"]: r for r in out.collect()}
    assert out.count() == len(events) and all(r["gap"] == 0 and r["status"] in RULES for r in got.values())
    wide = [f"{s}_{w}_l{i}" for i in (1, 2) for s in ("bid", "ask") for w in ("price", "size")]
    assert [tuple(got[i][c] for c in ("reason", "effective_qty", "remaining", "depth", *wide)) for i in range(len(events))] == want
    batch = spark.createDataFrame([("AAPL", DAY, *e) for e in events], EVENT)
    accepted = BK.accepted_events(batch, BK.classify_replaces(batch))
    assert differing_rows(SB.accepted_event_log(out).select(batch.columns), accepted).count() == 0


def test_late_rows_gaps_and_expired_days(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    row = lambda seq, oid, qty=5: (seq, "limit", oid, None, 1, 100, qty)
    out = booked(spark, folder, [[row(0, 1), row(1, 2)], [row(1, 9), row(4, 3), row(5, 4)]], levels=1, patience_ms=1)
    assert sorted((r["seq"], r["status"], r["gap"]) for r in out.collect()) == [(0, "accepted", 0), (1, "accepted", 0), (1, "late", 0)]
    out = booked(spark, folder, [[row(6, 5)]], levels=1, patience_ms=1)  # the gap has been open for longer than its patience
    done = {(r["seq"], r["status"]): r for r in out.collect()}
    assert {k[0] for k in done if k[1] == "accepted"} == {0, 1, 4, 5, 6}
    assert done[4, "accepted"]["gap"] == 2 and done[6, "accepted"]["depth"] == 25
    out = booked(spark, folder, [[row(2, 7)]], levels=1, patience_ms=1)
    assert [r["seq"] for r in SB.dead_letters(out).orderBy("seq").collect()] == [1, 2]
    assert SB.depth_rows(out).count() == SB.ladder_rows(out).count() == 5


def test_a_day_without_rows_gives_its_state_back(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    row = lambda seq, oid: (seq, "limit", oid, None, 1, 100, 5)
    booked(spark, folder, [[row(0, 1), row(1, 2)]], levels=1, expire_ms=1)
    booked(spark, folder, [[row(0, 3)]], levels=1, symbol="MSFT", expire_ms=1)  # timers go off with any symbol's rows
    out = booked(spark, folder, [[row(0, 1)]], levels=1, expire_ms=1)
    assert [r["status"] for r in out.where("symbol = 'AAPL'").collect()] == ["accepted"] * 3


def test_streamed_depth_and_ladder_equal_batch(spark, sf):
    stream = _stream(spark, fx.message_log(spark, sf))
    with SB.state_on_disk(spark):
        out = PI.run_to_table(SB.stream_book(SB.book_events(stream), at="at", levels=3), "book")
    messages = fx.messages(spark, sf)
    assert differing_rows(SB.ladder_rows(out), BK.ladder_over_time(messages, 3)).count() == 0
    assert differing_rows(SB.depth_rows(out), BK.depth_by_level(messages).select(*KEYS, "seq", "side", "price", "depth")).count() == 0


def test_replay_without_patience_gives_up_no_gap_and_writes_waiting_rows_once(spark, monkeypatch):
    """Files in reverse, each run later than any patience; the rows that wait lie in blocks that later runs add to."""
    events = random_events(3_000, 900, 3)
    want = brute_book(events, 0)
    parts = [events[a : a + 1_000] for a in (2_000, 1_000, 0)]
    out = booked(spark, tempfile.mkdtemp(prefix="spark-"), [parts[0][::2], parts[1], parts[0][1::2], parts[2]], levels=0, patience_ms=None)
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == out.count() == len(events) and all(r["gap"] == 0 and r["status"] in RULES for r in got.values())
    assert [tuple(got[i][c] for c in ("reason", "effective_qty", "remaining", "depth")) for i in range(len(events))] == want


class MapState(dict):
    """A map state that counts what is written."""

    written = 0

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value
        self.written += len(str(value))

    def removeKey(self, key):
        del self[key]


def test_what_waits_is_written_once():
    """Written again in each micro-batch, 64 of them would write 32 times as much."""
    blocks, pieces, count = MapState(), MapState(), 0
    events = [(i, i, "limit", i, None, 1, 100, 5) for i in range(1, 8_193)]
    random.Random(5).shuffle(events)
    for part in range(64):
        waiting = SB._Waiting(blocks, pieces, count)
        waiting.add(events[part::64])
        waiting.flush()
        count = waiting.count
    assert count == len(events) and pieces.written < 2 * len(str(events))
    assert [e for block in waiting.blocks() for e in waiting.take(block)] == sorted(events)
    assert waiting.count == 0 and not blocks and not pieces


def test_orders_are_kept_by_ranges_of_ids(monkeypatch):
    """A plain dict and ranges hold the same, with many flushes between; neighbours share a state entry."""
    monkeypatch.setattr(SB, "_CACHED", 40)
    state, plain, rng = MapState(), {}, random.Random(8)
    ids = [None, -3, 1 << 60, *range(2_000)]
    orders = SB._Orders(state)
    for _ in range(6_000):
        oid, qty = rng.choice(ids), rng.randrange(3)
        assert orders.get(oid) == plain.get(oid, (0, 0, 0))
        plain[oid] = (1, 100, qty) if qty else (0, 0, 0)
        orders.put(oid, plain[oid])
    orders.flush()
    assert len(state) <= 11
    again = SB._Orders(state)
    assert all(again.get(oid) == plain.get(oid, (0, 0, 0)) for oid in ids)


def test_orders_with_ids_far_apart_share_state_entries():
    """As ids of replaces are. By ranges of ids each order was an entry of its own, with a call to read and one to write it."""
    state, ids = MapState(), [1_000_000 * i for i in range(6_000)]
    orders = SB._Orders(state)
    for oid in ids:
        orders.put(oid, (1, 100, 5))
    orders.flush()
    assert len(state) <= 1 + 2 * len(ids) / SB._PAGE + 1
    orders = SB._Orders(state)
    assert all(orders.get(oid) == (1, 100, 5) and orders.get(oid + 1) == (0, 0, 0) for oid in ids)
    for oid in ids[:-1]:
        orders.put(oid, (0, 0, 0))
    orders.flush()
    assert len(state) == 2 and SB._Orders(state).get(ids[-1]) == (1, 100, 5)


def test_events_reach_the_state_machine_by_blocks(spark):
    """One row of the shuffle per symbol and block, not one per event; nothing of an event is lost."""
    events = [(*e[:3], None if i % 5 == 0 else e[3], *e[4:]) for i, e in enumerate(random_events(10_000, 500, 11))]
    random.Random(2).shuffle(events)
    rows = spark.createDataFrame([(s, DAY, *e) for s in ("AAPL", "MSFT") for e in events], EVENT).coalesce(1)
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(SB._NULL)).alias(c) for c in ("order_id", "old_id", "side", "price", "qty")]
    packed = rows.select(*KEYS, F.col("seq").alias("at"), "seq", "kind", *numbers).mapInArrow(
        SB._pack_events, "symbol string, trade_date date, block bigint, low bigint, n bigint, events binary"
    )
    waiting, pieces = SB._Waiting(MapState(), MapState(), 0), packed.where("symbol = 'MSFT'").collect()
    assert len(pieces) == 10_000 // SB._BLOCK + 1
    for piece in pieces:
        waiting.add_piece(piece["block"], piece["n"], piece["events"])
    assert [e[1:] for block in waiting.blocks() for e in waiting.take(block)] == sorted(events)


def test_symbols_of_a_stored_feed_share_no_task(spark):
    """With 8 parts, the session's number, three of the five symbols were one task."""
    feed = spark.createDataFrame([(s, date(2012, 6, 21)) for s in SYMBOLS for _ in range(20)], "symbol string, trade_date date")
    parts = SB.state_partitions(feed)
    assert feed.repartition(parts, *KEYS).select("symbol", F.spark_partition_id().alias("part")).distinct().groupBy("part").count().count() == 5
    assert feed.repartition(8, *KEYS).select("symbol", F.spark_partition_id().alias("part")).distinct().groupBy("part").count().count() == 3
    many = spark.range(20).select(F.col("id").cast("string").alias("symbol"), F.lit(DAY).alias("trade_date"))
    assert SB.state_partitions(many) == 8 == SB.state_partitions(many.limit(0))
    with SB.state_on_disk(spark, parts):
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(parts)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_best_levels_follow_every_change():
    rng, tops, sizes = random.Random(4), SB._Tops(3, []), {}
    for _ in range(4_000):
        key, size = (rng.choice([1, -1]), rng.randrange(-9, 9)), rng.choice([0, 0, 1, 2])
        sizes[key] = size
        tops.put(*key, size)
        best = {side: sorted(((p, q) for (s, p), q in sizes.items() if s == side and q), key=lambda level: -side * level[0]) for side in (1, -1)}
        want = [(best[side] + [(SB._NULL, 0)] * 3)[i] for i in range(3) for side in (1, -1)]
        assert tops.row() == [value for level in want for value in level]


def test_a_table_in_event_order_is_built_once(spark):
    built = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(seq):
        built.add(1)
        return seq

    rows = spark.range(2_600).select(F.col("id").alias("seq"), counted.asNondeterministic()("id").alias("value"))
    table = fx._in_order(spark, tempfile.mkdtemp(prefix="spark-"), "counted", lambda: rows)
    assert built.value == 2_600
    files = sorted((os.stat(p.removeprefix("file://")).st_mtime_ns, p) for p in table.inputFiles())
    seen = [[r["seq"] for r in spark.read.parquet(p).collect()] for _, p in files]
    assert [sorted(s) for s in seen] == [list(range(a, min(a + 519, 2_600))) for a in range(0, 2_600, 519)]
