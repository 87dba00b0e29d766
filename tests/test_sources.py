import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from microbook import fixtures as fx
from microbook.operators import microprice as G
from microbook.operators.quality import differing_rows
from microbook.sources import files as S
from microbook.sources import tables as ST
from microbook.sources.generate import generate_order_flow
from tests.helpers import column, rows

DAY = "2012-06-21"


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def write(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    return path


def message_lines(n, start=0):
    return [f"{34200 + i * 0.001:.9f},{1 + i % 4},{1000 + i},{10 + i},{5_650_000 + 100 * (i % 7)},{1 if i % 2 else -1}" for i in range(start, start + n)]


def test_messages_from_two_symbols(spark, folder):
    write(folder, f"AAPL_{DAY}_34200000_57600000_message_10.csv", message_lines(50))
    write(folder, f"MSFT_{DAY}_34200000_57600000_message_10.csv", message_lines(20))
    out = S.read_order_messages(spark, f"{folder}/*_message_*.csv")
    assert rows(out.groupBy("symbol").agg(F.count("*").alias("n"), F.max("seq").alias("m")), "symbol", "n", "m") == [("AAPL", 50, 49), ("MSFT", 20, 19)]
    aapl = out.where("symbol = 'AAPL'")
    assert column(aapl, "order_id") == [1000 + i for i in range(50)]
    midnight = 1_340_236_800_000_000_000
    assert column(aapl, "ts_ns")[1] == midnight + int(34200.001 * 1e9)
    assert set(column(aapl, "side")) == {1, -1}


def test_seq_over_many_splits_and_parts(spark, folder):
    write(folder, f"AAPL_{DAY}_a_b_message_10_0.csv", message_lines(3_000))
    write(folder, f"AAPL_{DAY}_a_b_message_10_1.csv", message_lines(1_000, start=3_000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        out = S.read_order_messages(spark, f"{folder}/*_message_*.csv")
        assert out.rdd.getNumPartitions() > 1
        assert out.where("order_id <> seq + 1000").count() == 0
        assert out.agg(F.countDistinct("seq")).first()[0] == 4_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_parts_follow_their_numbers(spark, folder):
    for part in range(12):
        write(folder, f"AAPL_{DAY}_a_b_message_10_{part}.csv", message_lines(10, start=10 * part))
    out = S.read_order_messages(spark, f"{folder}/*_message_*.csv")
    assert out.count() == 120 and out.where("order_id <> seq + 1000").count() == 0


def test_unequal_files_and_bad_lines_fail(spark, folder):
    flow = generate_order_flow(spark, 10, ["AAPL"]).orderBy("seq").toPandas()
    names = [f"{s}_{w}_l{i}" for i in range(1, 11) for s in ("ask", "bid") for w in ("price", "size")]
    depth = [",".join(str(v) for v in r) for r in flow[names].values.tolist()]
    write(folder, f"AAPL_{DAY}_a_b_message_10.csv", message_lines(10))
    write(folder, f"AAPL_{DAY}_a_b_orderbook_10.csv", depth[:7])
    paths = f"{folder}/*_message_*.csv", f"{folder}/*_orderbook_*.csv"
    with pytest.raises(ValueError, match="different heights"):
        S.read_joined(spark, *paths)
    assert S.read_joined(spark, *paths, unequal="drop").count() == 7
    write(folder, f"AAPL_{DAY}_a_b_orderbook_10.csv", [*depth[:9], "oops"])
    with pytest.raises(ValueError, match="do not parse"):
        S.read_joined(spark, *paths)
    assert S.read_joined(spark, *paths, bad="drop").count() == 9
    counted = S.count_bad_rows(S.read_depth_snapshots(spark, paths[1])).first()
    assert (counted["rows"], counted["bad_rows"]) == (10, 1)


def test_malformed_lines_keep_their_place(spark, folder):
    lines = message_lines(5)
    lines[2] = "34200.002,1,oops,1,2,1"
    lines.append("34200.9,1")
    write(folder, f"AAPL_{DAY}_a_b_message_10.csv", lines)
    out = S.read_order_messages(spark, f"{folder}/*_message_*.csv")
    assert column(S.good_rows(out), "seq") == [0, 1, 3, 4]
    assert column(S.bad_rows(out), "seq") == [2, 5]
    assert S.bad_rows(out).count() == 2
    with pytest.raises(Exception):
        S.read_order_messages(spark, f"{folder}/*_message_*.csv", mode="FAILFAST").collect()


def test_depth_and_join(spark, folder):
    flow = generate_order_flow(spark, 40, ["AAPL"]).orderBy("seq").toPandas()
    write(folder, f"AAPL_{DAY}_a_b_message_10.csv", message_lines(40))
    names = [f"{s}_{w}_l{i}" for i in range(1, 11) for s in ("ask", "bid") for w in ("price", "size")]
    write(folder, f"AAPL_{DAY}_a_b_orderbook_10.csv", [",".join(str(v) for v in r) for r in flow[names].values.tolist()])
    joined = S.read_joined(spark, f"{folder}/*_message_*.csv", f"{folder}/*_orderbook_*.csv")
    assert joined.count() == 40
    assert column(joined, "bid_price_l1") == flow["bid_price_l1"].tolist()
    assert column(joined, "ask_size_l10") == flow["ask_size_l10"].tolist()
    kinds = rows(S.list_inputs(spark, folder), "symbol", "kind")
    assert kinds == [("AAPL", "message"), ("AAPL", "orderbook")]


def test_quotes(spark, folder):
    head = "update_id,best_bid_price,best_bid_qty,best_ask_price,best_ask_qty,transaction_time,event_time"
    write(folder, f"BTCUSDT_{DAY}_bookTicker.csv", [head, "7,100.5,0.25,100.6,3.0,1,1700000000123"])
    row = S.read_quotes(spark, f"{folder}/*.csv").first()
    assert (row["bid_price_l1"], row["bid_size_l1"], row["ask_size_l1"]) == (10_050_000_000, 25_000_000, 300_000_000)
    assert (row["ts_ns"], row["seq"], row["symbol"]) == (1_700_000_000_123_000_000, 0, "BTCUSDT")


def test_event_log_appends_in_order(spark, folder, sf):
    messages = fx.messages(spark, sf)
    ST.append_events(messages.where("seq < 100"), f"{folder}/log")
    ST.append_events(messages.where("seq >= 100"), f"{folder}/log")
    log = ST.read_events(spark, f"{folder}/log").select(messages.columns)
    assert differing_rows(messages, log).count() == 0
    ordered = [(r["symbol"], r["seq"]) for r in ST.read_events(spark, f"{folder}/log", ordered=True).select("symbol", "trade_date", "seq").collect()]
    assert ordered == sorted(ordered)
    with pytest.raises(ValueError):
        ST.append_fills(messages, f"{folder}/fills")


def test_microprice_table_file(spark, folder):
    table = G.MicropriceTable(((1.0, 2.0), (3.0, -4.5), (0.0, 0.25)), 100)
    ST.write_microprice_table(spark, table, f"{folder}/t")
    back = ST.read_microprice_table(spark, f"{folder}/t")
    assert back.values == table.values and back.tick_size == 100
    assert rows(ST.microprice_cells(spark, f"{folder}/t"), "imb_bucket", "sp_bucket", "g")[3] == (1, 1, -4.5)
    path = os.path.join(folder, "bad.json")
    with open(path, "w") as out:
        json.dump({"n_imbalance_buckets": 3, "n_spread_buckets": 2, "tick_size": 100, "table": [[1.0, 2.0]]}, out)
    with pytest.raises(ValueError):
        ST.read_microprice_table(spark, path)
