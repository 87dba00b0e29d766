"""Independent DuckDB SQL for the registered queries: plain windows and joins over the whole tables."""

_BOOK_TAIL = """
{p}s AS (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY {order}) - 1 AS BIGINT) AS seq,
    CAST(SUM((rid*7919 + h) % 3 - 1) OVER (PARTITION BY symbol ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS walk
  FROM {p}e),
{p}p AS (
  SELECT *, 5650000 + 100*walk AS bid_price, 5650000 + 100*walk + 100*(1 + h % 3) AS ask_price FROM {p}s),
{name} AS (SELECT symbol, seq, ts_ns, rid, et, h,
  bid_price AS bid_price_l1, 100 + (h*31 + rid*17) % 400 AS bid_size_l1,
  ask_price AS ask_price_l1, 100 + (h*13 + rid*29) % 400 AS ask_size_l1,
  bid_price - 100 AS bid_price_l2, 100 + (h*11 + rid*11) % 300 AS bid_size_l2,
  ask_price + 100 AS ask_price_l2, 100 + (h*9 + rid*19) % 300 AS ask_size_l2,
  bid_price - 200 AS bid_price_l3, 100 + (h*13 + rid*15) % 300 AS bid_size_l3,
  ask_price + 200 AS ask_price_l3, 100 + (h*11 + rid*23) % 300 AS ask_size_l3,
  bid_price - 300 AS bid_price_l4, 100 + (h*15 + rid*19) % 300 AS bid_size_l4,
  ask_price + 300 AS ask_price_l4, 100 + (h*13 + rid*27) % 300 AS ask_size_l4,
  bid_price - 400 AS bid_price_l5, 100 + (h*17 + rid*23) % 300 AS bid_size_l5,
  ask_price + 400 AS ask_price_l5, 100 + (h*15 + rid*31) % 300 AS ask_size_l5
FROM {p}p)"""

_SYMBOL = "CASE {c} % 5 WHEN 0 THEN 'AAPL' WHEN 1 THEN 'AMZN' WHEN 2 THEN 'GOOG' WHEN 3 THEN 'INTC' ELSE 'MSFT' END AS symbol"

BOOK = (
    """e AS (SELECT event_id AS rid, epoch_us(ts)*1000 AS ts_ns, event_type AS et, CAST(ROUND(value*100) AS BIGINT) AS h, """
    + _SYMBOL.format(c="user_id")
    + " FROM events),"
    + _BOOK_TAIL.format(p="", order="ts_ns, rid", name="book")
)
BOOK_LARGE = (
    """le AS (SELECT l_orderkey AS rid, epoch_us(l_shipdate)*1000 AS ts_ns, l_returnflag AS et,
    CAST(ROUND(l_extendedprice*100) AS BIGINT) % 1000003 AS h, """
    + _SYMBOL.format(c="l_partkey")
    + " FROM lineitem),"
    + _BOOK_TAIL.format(p="l", order="ts_ns, rid, h, et", name="book_large")
)
MESSAGES = (
    BOOK
    + """,
t AS (SELECT *, CASE WHEN et IN ('click','view') THEN 1 WHEN et = 'signup' THEN 3 WHEN et = 'error' THEN 2
                 WHEN h % 10 = 0 THEN 5 ELSE 4 END AS event_type,
    MAX(CASE WHEN et IN ('click','view') THEN seq END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ref_seq
  FROM book),
messages AS (SELECT t.symbol, t.seq, t.ts_ns, CAST(t.event_type AS TINYINT) AS event_type, a.rid AS order_id,
  CAST(CASE WHEN a.rid % 2 = 0 THEN 1 ELSE -1 END AS TINYINT) AS side,
  CASE WHEN t.event_type = 1 THEN 10 + t.h % 190 ELSE 1 + t.h % 60 END AS size,
  CASE WHEN a.rid % 2 = 0 THEN a.bid_price_l1 - 100*(a.h % 3) ELSE a.ask_price_l1 + 100*(a.h % 3) END AS price
FROM t JOIN book a ON a.symbol = t.symbol AND a.seq = t.ref_seq)"""
)
SCORED = (
    BOOK
    + """,
r AS (SELECT symbol, seq, CAST(1 + (h*37 + rid*101) % 97 AS DOUBLE) AS a, CAST(1 + (h*53 + rid*59) % 89 AS DOUBLE) AS b,
    CAST(1 + (h*71 + rid*43) % 83 AS DOUBLE) AS c, CAST((h + rid*5) % 3 AS TINYINT) AS label FROM book),
scored AS (SELECT symbol, seq, label, a/(a+b+c) AS p_down, b/(a+b+c) AS p_stable, c/(a+b+c) AS p_up FROM r)"""
)
TRADES = (
    MESSAGES
    + """,
trades AS (SELECT symbol, seq, ts_ns, order_id, size, price, CAST(-side AS TINYINT) AS aggressor_side
  FROM messages WHERE event_type IN (4, 5))"""
)


def rnd(expression: str, digits: int = 6) -> str:
    """Rounded double without negative zero."""
    return f"CASE WHEN round({expression}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expression}, {digits})::DOUBLE END"


# Early values of an exponential average are short decimals. This offset keeps them off the rounding boundary.


IMB = "((bid_size_l1 - ask_size_l1)::DOUBLE / NULLIF(bid_size_l1 + ask_size_l1, 0))"
SPREAD = "((ask_price_l1 - bid_price_l1)::DOUBLE / 100.0)"
IMB_BUCKET = f"CAST(least(greatest(trunc((coalesce({IMB}, 0) + 1.0) / 2.0 * 11), 0), 10) AS INTEGER)"
SP_BUCKET = f"CAST(least(greatest(floor({SPREAD}) - 1, 0), 4) AS INTEGER)"


def _grid(value: str, parts: int) -> str:
    return f"(floor({value} * {parts} + 0.5::DOUBLE) / {parts}::DOUBLE)"


def _q(ctes: str, body: str) -> str:
    body = body.strip()
    return f"WITH RECURSIVE {ctes}{body}" if body.startswith(",") else f"WITH RECURSIVE {ctes}\n{body}"


def _rows(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _diff(column: str) -> str:
    return f"coalesce({column} - lag({column}) OVER (PARTITION BY symbol ORDER BY seq), 0)"


def _full(expression: str, n: int) -> str:
    return f"CASE WHEN seq >= {n - 1} THEN {expression} END"


_DIFFS = (
    ", d AS (SELECT *, "
    + ", ".join(f"{_diff(f'{s}_size_l{i}')} AS d{s[0]}{i}" for s in ("bid", "ask") for i in range(1, 6))
    + f", {_diff('bid_price_l1 + ask_price_l1')} AS dm2, (ask_price_l1 - bid_price_l1) AS sp FROM book)"
)
_ML = "(db2+db3+db4+db5-da2-da3-da4-da5)"
_Z = f"""CASE WHEN seq >= 199 THEN CASE WHEN coalesce(stddev_samp(sp) {_rows(200)}, 0) = 0 THEN 0.0
  ELSE (sp - avg(sp) {_rows(200)}) / (stddev_samp(sp) {_rows(200)}) END END"""
_FLOW = """, tn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) AS n,
   CAST(SUM(aggressor_side*size) OVER w AS BIGINT) AS flow,
   CAST(SUM(CASE WHEN aggressor_side = 1 THEN size ELSE 0 END) OVER w AS BIGINT) AS buys,
   CAST(SUM(CASE WHEN aggressor_side = -1 THEN size ELSE 0 END) OVER w AS BIGINT) AS sells
   FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
flows AS (SELECT symbol, seq, order_id, CASE WHEN n >= 50 THEN flow END AS signed_trade_flow_50,
   CASE WHEN n >= 50 THEN CASE WHEN buys + sells = 0 THEN 0.0 ELSE (buys - sells)::DOUBLE / (buys + sells) END END AS tfi_50 FROM tn)"""
_EWMA = """, ew AS (SELECT x.symbol, x.seq, SUM(0.05::DOUBLE * pow(0.95::DOUBLE, x.seq - y.seq) * y.db1) AS qb,
   SUM(0.05::DOUBLE * pow(0.95::DOUBLE, x.seq - y.seq) * y.da1) AS qa
   FROM d x JOIN d y ON x.symbol = y.symbol AND y.seq <= x.seq GROUP BY x.symbol, x.seq)"""
_LABEL = (
    ", lab AS (SELECT symbol, seq, lead(bid_price_l1 + ask_price_l1, {k}) OVER (PARTITION BY symbol ORDER BY seq)"
    " - (bid_price_l1 + ask_price_l1) AS mv FROM book)"
)
_CLASS = "CAST(CASE WHEN mv <= -200 THEN 0 WHEN mv >= 200 THEN 2 ELSE 1 END AS TINYINT)"
_STATES = f""", st AS (SELECT symbol, seq, {IMB_BUCKET} * 5 + {SP_BUCKET} AS state, bid_price_l1 + ask_price_l1 AS m2 FROM book),
pairs AS (SELECT * FROM (SELECT symbol, seq, state, lead(state) OVER w AS next_state, (lead(m2) OVER w - m2) / 2.0 AS delta_mid
  FROM st WINDOW w AS (PARTITION BY symbol ORDER BY seq)) WHERE next_state IS NOT NULL),
counts AS (SELECT state, next_state, COUNT(*) AS transitions, SUM(delta_mid)::DOUBLE AS sum_delta_mid FROM pairs GROUP BY 1, 2),
norm AS (SELECT state, next_state, transitions / SUM(transitions) OVER (PARTITION BY state) AS probability,
  SUM(sum_delta_mid) OVER (PARTITION BY state) / SUM(transitions) OVER (PARTITION BY state) AS payoff FROM counts)"""
FIXED_TABLE_SQL = f"(({IMB_BUCKET} - 5) * 2.5 + {SP_BUCKET} * 0.5)::DOUBLE"

# Order events as a state machine per order id. Every id of this table is entered once.
_ORDERS = """, oe AS (SELECT symbol, seq, CASE event_type WHEN 1 THEN 'limit' WHEN 2 THEN 'reduce' WHEN 3 THEN 'cancel' ELSE 'execute' END AS kind,
   order_id, side, price, size AS qty FROM messages WHERE event_type <= 4),
ob AS (SELECT *, MAX(CASE WHEN kind = 'limit' THEN qty END) OVER (PARTITION BY symbol, order_id) AS entered,
   coalesce(SUM(CASE WHEN kind IN ('reduce', 'execute') THEN qty END) OVER b, 0) AS gone,
   coalesce(SUM(CASE WHEN kind = 'cancel' THEN 1 END) OVER b, 0) AS killed
   FROM oe WINDOW b AS (PARTITION BY symbol, order_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
oc AS (SELECT *, CASE WHEN kind = 'limit' OR killed > 0 THEN 0 ELSE greatest(entered - gone, 0) END AS live FROM ob),
classified AS (SELECT symbol, seq, kind, order_id, side, price, qty,
   CASE WHEN kind <> 'limit' AND live = 0 THEN 'unknown_id' END AS reason,
   CAST(CASE WHEN kind = 'limit' THEN qty WHEN kind = 'cancel' THEN live ELSE least(qty, live) END AS BIGINT) AS effective_qty,
   CAST(CASE WHEN kind = 'limit' THEN qty WHEN kind = 'cancel' THEN 0 ELSE live - least(qty, live) END AS BIGINT) AS remaining,
   (kind = 'limit' OR live > 0) AS accepted FROM oc)"""
# A level holds what accepted events left there.
_DEPTH = _ORDERS + """, dp AS (SELECT m.*, CAST(SUM(coalesce(CASE WHEN c.kind = 'limit' THEN c.effective_qty ELSE -c.effective_qty END, 0))
   OVER (PARTITION BY m.symbol, m.side, m.price ORDER BY m.seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth
   FROM messages m LEFT JOIN classified c ON c.symbol = m.symbol AND c.seq = m.seq)"""
_ALIVE = """, iv AS (SELECT symbol, side, price, seq AS lo, coalesce(lead(seq) OVER (PARTITION BY symbol, side, price ORDER BY seq), 1000000000000) AS hi, depth FROM dp),
alive AS (SELECT m.symbol, m.seq, iv.side, iv.price, iv.depth,
   ROW_NUMBER() OVER (PARTITION BY m.symbol, m.seq, iv.side ORDER BY -iv.side * iv.price) AS rk
   FROM messages m JOIN iv ON iv.symbol = m.symbol AND iv.lo <= m.seq AND m.seq < iv.hi AND iv.depth > 0)"""
_LEVELS = _DEPTH + _ALIVE
_POSITIONS = "(SELECT symbol, CAST(floor(max(seq) * unnest([0.25, 0.5, 1.0]::DOUBLE[])) AS BIGINT) AS at_seq FROM messages GROUP BY symbol) v"
_RESTING = f"""{_ORDERS}, rest AS (SELECT v.at_seq, c.symbol, c.order_id,
   CAST(SUM(CASE WHEN c.kind = 'limit' THEN c.effective_qty ELSE -c.effective_qty END) AS BIGINT) AS remaining,
   MAX(CASE WHEN c.kind = 'limit' THEN c.side END) AS side, MAX(CASE WHEN c.kind = 'limit' THEN c.price END) AS price,
   MAX(CASE WHEN c.kind = 'limit' THEN c.seq END) AS entry_seq
   FROM classified c JOIN {_POSITIONS} ON c.symbol = v.symbol AND c.seq <= v.at_seq WHERE c.accepted GROUP BY 1, 2, 3),
resting AS (SELECT * FROM rest WHERE remaining > 0)"""
_SNAP_ORDERS = """, so AS (SELECT symbol, seq, CASE WHEN rid % 2 = 0 THEN 1 ELSE -1 END AS side,
   CASE rid % 3 WHEN 0 THEN 'limit' WHEN 1 THEN 'market' ELSE 'ioc' END AS kind,
   CASE WHEN rid % 2 = 0 THEN ask_price_l1 + 100*(h % 4) ELSE bid_price_l1 - 100*(h % 4) END AS limit_price, 200 + h % 1300 AS qty FROM book)"""
_LADDER_ROWS = ", lad AS (" + " UNION ALL ".join(
    f"SELECT b.symbol, b.seq, o.side, o.kind, o.limit_price, o.qty, {i} AS lv, CASE WHEN o.side = 1 THEN b.ask_price_l{i} ELSE b.bid_price_l{i} END AS p, "
    f"CASE WHEN o.side = 1 THEN b.ask_size_l{i} ELSE b.bid_size_l{i} END AS q FROM book b JOIN so o USING (symbol, seq)"
    for i in range(1, 6)
) + ")"
_QUOTES = """, quotes AS (SELECT symbol, seq, 'naive' AS policy, CAST(1 AS TINYINT) AS side_sign, bid_price_l1 AS price FROM book
  UNION ALL SELECT symbol, seq, 'naive', CAST(-1 AS TINYINT), ask_price_l1 FROM book),
sc AS (SELECT symbol, seq, CASE WHEN seq % 7 = 3 THEN p_up - p_down END AS score FROM scored),
cs AS (SELECT symbol, seq, coalesce(last_value(score IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 0.0) AS last_score FROM sc),
aware AS (SELECT b.symbol, b.seq, 'ml_aware' AS policy, CAST(1 AS TINYINT) AS side_sign, bid_price_l1 AS price FROM book b JOIN cs USING (symbol, seq) WHERE last_score <= 0.15::DOUBLE
  UNION ALL SELECT b.symbol, b.seq, 'ml_aware', CAST(-1 AS TINYINT), ask_price_l1 FROM book b JOIN cs USING (symbol, seq) WHERE last_score >= -0.15::DOUBLE),
allq AS (SELECT * FROM quotes UNION ALL SELECT * FROM aware)"""
_FILLS = """, fills AS (SELECT q.symbol, q.policy, q.seq AS quote_seq, q.side_sign, q.price AS fill_price, MIN(t.seq) AS seq, 1::BIGINT AS quantity
  FROM allq q JOIN trades t ON t.symbol = q.symbol AND t.seq > q.seq AND t.seq <= q.seq + 100 AND t.aggressor_side = -q.side_sign
   AND (t.price - q.price) * q.side_sign <= 0 GROUP BY ALL),
ends AS (SELECT symbol, MAX(seq) AS last_seq FROM book GROUP BY 1),
mk AS (SELECT f.*, ((b.bid_price_l1 + b.ask_price_l1) // 2 - f.fill_price) * f.side_sign / 100.0 AS markout
  FROM fills f JOIN ends USING (symbol) JOIN book b ON b.symbol = f.symbol AND b.seq = least(f.seq + 100, last_seq))"""
_SUMMARY = f""", pq AS (SELECT symbol, policy, COUNT(*) AS quotes_posted FROM allq GROUP BY 1, 2),
ms AS (SELECT symbol, AVG((bid_price_l1 + ask_price_l1) // 2) AS mid_avg FROM book GROUP BY 1),
fs AS (SELECT symbol, policy, COUNT(*) AS fills, CAST(SUM(quantity) AS BIGINT) AS fill_qty, AVG(markout) AS mean_m, MEDIAN(markout) AS med_m, SUM(markout) AS sum_m FROM mk GROUP BY 1, 2),
summary AS (SELECT symbol, policy, quotes_posted, fills, fill_qty, fills / quotes_posted AS fill_rate, mean_m::DOUBLE AS markout_mean_ticks,
  med_m::DOUBLE AS markout_median_ticks, (-mean_m * 100 / mid_avg * 1e4)::DOUBLE AS adverse_selection_bps, sum_m::DOUBLE AS gross_pnl_ticks
  FROM pq JOIN fs USING (symbol, policy) JOIN ms USING (symbol))"""
_POOL = ", pool AS (SELECT symbol, seq, label, p_down, p_stable, p_up FROM scored UNION ALL SELECT 'ALL', seq, label, p_down, p_stable, p_up FROM scored)"
_VS = ", vs AS (" + " UNION ALL ".join(
    f"SELECT symbol, CAST({c} AS TINYINT) AS class, {p} AS p, CASE WHEN label = {c} THEN 1 ELSE 0 END AS y FROM pool"
    for c, p in enumerate(("p_down", "p_stable", "p_up"))
) + ")"
_REPLACES = """, ev AS (SELECT symbol, seq, CASE event_type WHEN 1 THEN 'limit' WHEN 2 THEN 'replace' WHEN 3 THEN 'cancel' ELSE 'ioc' END AS kind,
   CASE WHEN event_type = 2 THEN order_id + 1000000 * (seq + 1) ELSE order_id END AS order_id, CASE WHEN event_type = 2 THEN order_id END AS old_id,
   side, price, size AS qty FROM messages WHERE event_type <= 4)"""


# Replaces of missing orders, onto live ids, onto themselves and without quantity among the others.
_ALL_REPLACES = _REPLACES + """, ar AS (SELECT symbol, seq, kind,
   CASE WHEN kind = 'replace' AND seq % 7 = 0 THEN old_id WHEN kind = 'replace' AND seq % 11 = 0 THEN 7 ELSE order_id END AS order_id, old_id,
   CASE WHEN kind <> 'replace' THEN side END AS side, price, CASE WHEN kind = 'replace' AND seq % 13 = 0 THEN 0 ELSE qty END::BIGINT AS qty FROM ev),
numbered AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM ar)"""
# The order rule played event by event: sizes that rest by id, in one row per symbol and event.
_PLAYED = _ALL_REPLACES + """, play AS (
  SELECT symbol, 0::BIGINT AS n, MAP {}::MAP(BIGINT, STRUCT(qty BIGINT, side TINYINT)) AS live, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::BIGINT AS order_id,
    NULL::BIGINT AS old_id, NULL::TINYINT AS side, NULL::BIGINT AS price, NULL::BIGINT AS qty, NULL::BIGINT AS own, NULL::BIGINT AS gone, NULL::VARCHAR AS reason
  FROM (SELECT DISTINCT symbol FROM numbered)
  UNION ALL
  SELECT symbol, n,
    CASE WHEN reason IS NOT NULL OR kind = 'ioc' THEN live
      WHEN kind = 'limit' THEN map_concat(live, MAP {order_id: {'qty': qty, 'side': side}})
      WHEN kind = 'cancel' THEN map_concat(live, MAP {order_id: {'qty': 0::BIGINT, 'side': side}})
      ELSE map_concat(live, MAP {old_id: {'qty': 0::BIGINT, 'side': side}}, MAP {order_id: {'qty': qty, 'side': side}}) END,
    seq, kind, order_id, old_id, side, price, qty, own, gone, reason
  FROM (
    SELECT p.symbol, e.n, p.live, e.seq, e.kind, e.order_id, e.old_id, CASE WHEN e.kind = 'replace' THEN p.live[e.old_id].side ELSE e.side END::TINYINT AS side,
      e.price, e.qty, coalesce(p.live[e.order_id].qty, 0) AS own, coalesce(p.live[e.old_id].qty, 0) AS gone,
      CASE WHEN e.kind <> 'cancel' AND e.qty <= 0 THEN 'bad_qty'
        WHEN e.kind = 'limit' AND coalesce(p.live[e.order_id].qty, 0) > 0 THEN 'duplicate_id'
        WHEN e.kind = 'cancel' AND coalesce(p.live[e.order_id].qty, 0) = 0 THEN 'unknown_id'
        WHEN e.kind = 'replace' AND coalesce(p.live[e.old_id].qty, 0) = 0 THEN 'unknown_id'
        WHEN e.kind = 'replace' AND e.old_id <> e.order_id AND coalesce(p.live[e.order_id].qty, 0) > 0 THEN 'duplicate_id' END AS reason
    FROM play p JOIN numbered e ON e.symbol = p.symbol AND e.n = p.n + 1)),
verdicts AS (SELECT * EXCLUDE (live, n) FROM play WHERE seq IS NOT NULL)"""


def _range_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS nulls, MIN({c})::DOUBLE AS smallest, MAX({c})::DOUBLE AS largest FROM book" for c in columns
    )


def oracle_sql() -> dict[str, str]:
    cells = {}
    cells["tob_from_depth"] = _q(BOOK, "SELECT symbol, seq, ts_ns, bid_price_l1, bid_size_l1, ask_price_l1, ask_size_l1 FROM book")
    cells["tob_from_quotes"] = """SELECT o_orderkey AS update_id, epoch_us(o_orderdate)*1000 AS ts_ns,
      CAST(trunc(o_totalprice * 1e8::DOUBLE) AS BIGINT) AS bid_price_l1, CAST(trunc((o_custkey / 8.0)::DOUBLE * 1e8::DOUBLE) AS BIGINT) AS bid_size_l1,
      CAST(trunc((o_totalprice + 0.25::DOUBLE) * 1e8::DOUBLE) AS BIGINT) AS ask_price_l1, CAST(trunc((o_orderkey % 64 / 4.0)::DOUBLE * 1e8::DOUBLE) AS BIGINT) AS ask_size_l1
      FROM orders"""
    cells["mid_prices"] = _q(BOOK, """SELECT symbol, seq, (bid_price_l1 + ask_price_l1) / 2.0::DOUBLE AS mid,
      (bid_price_l1 + ask_price_l1) // 2 AS mid_floor, bid_price_l1 + ask_price_l1 AS mid_x2 FROM book""")
    cells["microprice"] = _q(BOOK, """SELECT symbol, seq, (bid_size_l1*ask_price_l1 + ask_size_l1*bid_price_l1)::DOUBLE
      / NULLIF(bid_size_l1 + ask_size_l1, 0) AS microprice FROM book""")
    cells["imbalance"] = _q(BOOK, f"SELECT symbol, seq, {IMB} AS imbalance FROM book")
    cells["spread_ticks"] = _q(BOOK, f"SELECT symbol, seq, {SPREAD} AS spread_ticks FROM book")
    cells["imbalance_bucket"] = _q(BOOK, f"SELECT symbol, seq, {IMB_BUCKET} AS imb_bucket FROM book")
    cells["spread_bucket"] = _q(BOOK, f"SELECT symbol, seq, {SP_BUCKET} AS sp_bucket FROM book")
    cells["state_id"] = _q(BOOK, f"SELECT symbol, seq, CAST({IMB_BUCKET} * 5 + {SP_BUCKET} AS INTEGER) AS state FROM book")
    cells["symbol_one_hot"] = _q(BOOK, "SELECT symbol, seq, " + ", ".join(
        f"CASE WHEN symbol = '{s}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"ticker_{s}\"" for s in ("AAPL", "AMZN", "GOOG", "INTC", "MSFT")) + " FROM book")
    cells["warm_flags"] = _q(BOOK, "SELECT symbol, seq, (seq >= 50)::INT::DOUBLE AS is_warm_50, (seq >= 200)::INT::DOUBLE AS is_warm_200 FROM book")
    cells["score_of_probabilities"] = _q(SCORED, "SELECT symbol, seq, p_up - p_down AS score FROM scored")
    cells["opposite_side"] = _q(MESSAGES, "SELECT symbol, seq, CAST(-side AS TINYINT) AS opposite FROM messages")
    cells["event_times"] = """SELECT event_id, epoch_us(ts)*1000 AS ts_ns, (epoch_us(ts) // 1000) * 1000000 AS ts_of_millis,
      epoch_us(date_trunc('day', ts))*1000 + (epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000000 * 1000000000 AS ts_of_seconds FROM events"""

    cells["extract_trades"] = _q(TRADES, "SELECT symbol, seq, ts_ns, order_id, size, price, aggressor_side FROM trades")
    cells["route_order_ops"] = _q(MESSAGES, """SELECT symbol, seq, order_id, CASE event_type WHEN 1 THEN 'add' WHEN 2 THEN 'reduce' ELSE 'cancel' END AS op
      FROM messages WHERE event_type IN (1, 2, 3)""")
    cells["order_op_counts"] = _q(MESSAGES, """SELECT symbol, CASE event_type WHEN 1 THEN 'add' ELSE 'cancel' END AS op, COUNT(*) AS n
      FROM messages WHERE event_type IN (1, 2, 3) GROUP BY 1, 2""")
    cells["exchange_orders"] = _q(MESSAGES, "SELECT symbol, seq, order_id * 4500000 AS order_id FROM messages WHERE order_id * 4500000 < 9000000000")
    cells["directional_rows"] = _q(SCORED, "SELECT symbol, seq, label FROM scored WHERE label IN (0, 2)")
    cells["crossed_books"] = _q(BOOK, "SELECT symbol, COUNT(*) AS rows, COUNT(*) FILTER (bid_price_l1 >= ask_price_l1) AS crossed FROM book GROUP BY 1")
    cells["two_sided_books"] = _q(BOOK, "SELECT symbol, seq FROM book WHERE bid_size_l1 > 120 AND ask_size_l1 > 120")

    cells["positional_join"] = _q(MESSAGES, """SELECT symbol, m.seq, m.event_type, m.order_id, b.bid_price_l1, b.ask_price_l1
      FROM messages m JOIN book b USING (symbol, seq)""")
    cells["height_mismatch"] = _q(MESSAGES, """SELECT symbol, m.n AS left_rows, b.n AS right_rows FROM (SELECT symbol, COUNT(*) AS n FROM messages GROUP BY 1) m
      JOIN (SELECT symbol, COUNT(*) AS n FROM book GROUP BY 1) b USING (symbol) WHERE m.n <> b.n""")
    cells["asof_trades"] = _q(TRADES, """SELECT b.symbol, b.seq, t.price AS last_price, t.size AS last_size
      FROM book b ASOF LEFT JOIN trades t ON b.symbol = t.symbol AND b.seq >= t.seq""")
    cells["asof_peers"] = _q(BOOK_LARGE, """SELECT b.symbol, b.seq, t.last_rid FROM book_large b ASOF LEFT JOIN
      (SELECT symbol, ts_ns, MAX(seq) AS last_seq, arg_max(bid_size_l1, seq) AS last_rid FROM book_large GROUP BY 1, 2) t
      ON b.symbol = t.symbol AND b.ts_ns >= t.ts_ns""")
    cells["microprice_lookup"] = _q(BOOK, f"SELECT symbol, seq, {FIXED_TABLE_SQL} AS g FROM book")
    cells["locate_orders"] = _q(MESSAGES + _RESTING, """SELECT r.symbol, r.order_id, r.side, r.price, r.remaining FROM resting r
      JOIN (SELECT DISTINCT symbol, order_id FROM messages WHERE event_type = 4) x USING (symbol, order_id)
      WHERE r.at_seq = (SELECT max(seq) FROM messages m WHERE m.symbol = r.symbol)""")
    cells["unknown_cancels"] = _q(MESSAGES + _ORDERS, "SELECT symbol, seq, order_id FROM classified WHERE kind = 'cancel' AND reason IS NOT NULL")
    cells["future_mid"] = _q(BOOK, """, x AS (SELECT symbol, MAX(seq) AS last_seq FROM book GROUP BY 1)
      SELECT a.symbol, a.seq, (b.bid_price_l1 + b.ask_price_l1) // 2 AS future_mid FROM book a JOIN x USING (symbol)
      JOIN book b ON b.symbol = a.symbol AND b.seq = least(a.seq + 100, last_seq)""")

    cells["class_share"] = _q(SCORED + _POOL, " UNION ALL ".join(
        f"SELECT symbol, CAST({c} AS TINYINT) AS label, {rnd(f'AVG((label = {c})::INT::DOUBLE)')} AS share FROM pool GROUP BY 1" for c in range(3)))
    cells["state_transitions"] = _q(BOOK + _STATES, "SELECT state, next_state, transitions, sum_delta_mid FROM counts")
    cells["transition_probabilities"] = _q(BOOK + _STATES, f"SELECT state, next_state, {rnd('probability')} AS probability, {rnd('payoff')} AS payoff FROM norm")
    cells["fit_microprice"] = _q(BOOK + _STATES + """,
      pay AS (SELECT state, MAX(payoff) AS payoff FROM norm GROUP BY 1),
      g AS (SELECT 0 AS n, s.state, 0.0::DOUBLE AS v FROM range(55) s(state)
        UNION ALL SELECT g.n + 1, s.state, COALESCE(MAX(pay.payoff), 0) + COALESCE(SUM(norm.probability * g.v), 0)
          FROM range(55) s(state) LEFT JOIN norm ON norm.state = s.state LEFT JOIN pay ON pay.state = s.state
          JOIN g ON g.state = COALESCE(norm.next_state, s.state) WHERE g.n < 200 GROUP BY g.n, s.state)""",
      f"SELECT CAST(state // 5 AS INTEGER) AS imb_bucket, CAST(state % 5 AS INTEGER) AS sp_bucket, {rnd('v', 4)} AS g FROM g WHERE n = 200")
    fine = _STATES.replace(IMB_BUCKET, IMB_BUCKET.replace("* 11)", "* 2000)").replace(", 0), 10)", ", 0), 1999)")).replace(SP_BUCKET, SP_BUCKET.replace(", 4)", ", 49)")).replace("* 5 +", "* 50 +")
    cells["fit_microprice_fine"] = _q(BOOK + fine + """,
      pay AS (SELECT state, MAX(payoff) AS payoff FROM norm GROUP BY 1),
      seen AS (SELECT state FROM norm UNION SELECT next_state FROM norm),
      g AS (SELECT 0 AS n, state, 0.0::DOUBLE AS v FROM seen
        UNION ALL SELECT g.n + 1, s.state, COALESCE(MAX(pay.payoff), 0) + COALESCE(SUM(norm.probability * g.v), 0)
          FROM seen s LEFT JOIN norm ON norm.state = s.state LEFT JOIN pay ON pay.state = s.state
          JOIN g ON g.state = COALESCE(norm.next_state, s.state) WHERE g.n < 16 GROUP BY g.n, s.state)""",
      f"SELECT CAST(state // 50 AS INTEGER) AS imb_bucket, CAST(state % 50 AS INTEGER) AS sp_bucket, {rnd('v', 4)} AS g FROM g JOIN pay USING (state) WHERE n = 16")
    cells["log_loss"] = _q(SCORED + _POOL, f"SELECT symbol, {rnd('AVG(-ln(CASE label WHEN 0 THEN p_down WHEN 1 THEN p_stable ELSE p_up END))')} AS logloss, COUNT(*) AS n FROM pool GROUP BY 1")
    cells["auc_up_vs_down"] = _q(SCORED + _POOL + """, rk AS (SELECT symbol, label, rank() OVER w + (COUNT(*) OVER (PARTITION BY symbol, s) - 1) / 2.0 AS rk
      FROM (SELECT *, p_up - p_down AS s FROM pool WHERE label IN (0, 2)) WINDOW w AS (PARTITION BY symbol ORDER BY s)),
      ag AS (SELECT symbol, SUM(rk) FILTER (label = 2) AS rs, COUNT(*) FILTER (label = 2)::DOUBLE AS p, COUNT(*) FILTER (label = 0)::DOUBLE AS n FROM rk GROUP BY 1)""",
      f"SELECT symbol, CASE WHEN p + n >= 1000 THEN {rnd('(rs - p*(p+1)/2) / (p*n)')} ELSE 'nan'::DOUBLE END AS auc, CAST(p + n AS BIGINT) AS directional_rows FROM ag")
    cells["brier"] = _q(SCORED + _POOL, f"""SELECT symbol, {rnd('AVG(pow(p_down - (label=0)::INT, 2) + pow(p_stable - (label=1)::INT, 2) + pow(p_up - (label=2)::INT, 2))')} AS brier FROM pool GROUP BY 1""")
    cells["brier_per_class"] = _q(SCORED + _POOL + _VS, f"SELECT symbol, class, {rnd('AVG(pow(p - y, 2))')} AS brier FROM vs GROUP BY 1, 2")
    cells["reliability_bins"] = _q(SCORED + _POOL + _VS + """, eg AS (SELECT symbol, class, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS ed FROM vs GROUP BY 1, 2),
      bn AS (SELECT symbol, class, p, y, len(list_filter(ed, lambda e: e < p)) AS bin FROM vs JOIN eg USING (symbol, class))""",
      f"SELECT symbol, class, bin, COUNT(*) AS n, {rnd('AVG(p)')} AS mean_pred, {rnd('AVG(y)')} AS frac_pos FROM bn GROUP BY 1, 2, 3")
    cells["confusion_matrix"] = _q(SCORED + _POOL + """, pr AS (SELECT symbol, label, CASE WHEN p_down >= p_stable AND p_down >= p_up THEN 0 WHEN p_stable >= p_up THEN 1 ELSE 2 END AS pred FROM pool)""",
      "SELECT symbol, label, COUNT(*) FILTER (pred = 0) AS pred_0, COUNT(*) FILTER (pred = 1) AS pred_1, COUNT(*) FILTER (pred = 2) AS pred_2 FROM pr GROUP BY 1, 2")
    reports = (
        ("brier", "brier", "NULL", "NULL", ("brier",)), ("brier_per_class", "brier_per_class", "class", "NULL", ("brier",)),
        ("reliability", "reliability_bins", "class", "bin", ("n", "mean_pred", "frac_pos")), ("confusion", "confusion_matrix", "label", "NULL", ("pred_0", "pred_1", "pred_2")),
    )
    cells["evaluation_report"] = " UNION ALL ".join(
        f"SELECT '{name}' AS report, symbol, CAST({group} AS INTEGER) AS class, CAST({place} AS BIGINT) AS bin, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({cells[of]}) x"
        for name, of, group, place, measures in reports for m in measures)
    cells["score_drift"] = _q(SCORED, f"""SELECT COUNT(*) AS n, {rnd('MAX(abs(x))', 12)} AS max_abs_diff, {rnd('AVG(abs(x))', 12)} AS mean_abs_diff, {rnd('sqrt(AVG(x*x))', 12)} AS rmse
      FROM (SELECT (p_up - p_down) - (p_up - p_down + (seq % 11) * 1e-7::DOUBLE) AS x FROM scored)""")
    cells["level_quantity"] = _q(MESSAGES + _DEPTH, """, fin AS (SELECT symbol, side, price, arg_max(depth, seq) AS quantity FROM dp GROUP BY 1, 2, 3),
      lk AS (SELECT DISTINCT symbol, CAST(1 AS TINYINT) AS side, bid_price_l1 AS price FROM book UNION SELECT DISTINCT symbol, CAST(-1 AS TINYINT), ask_price_l1 FROM book)
      SELECT symbol, side, price, coalesce(quantity, 0) AS quantity FROM lk LEFT JOIN fin USING (symbol, side, price)""")
    cells["column_ranges"] = _q(BOOK, _range_sql(("seq", "ts_ns", "bid_price_l1", "bid_size_l1", "ask_price_l1", "ask_size_l1")))
    cells["message_checks"] = _q(MESSAGES, """SELECT symbol, COUNT(*) AS rows, COUNT(*) FILTER (side NOT IN (-1, 1)) AS bad_side, COUNT(*) FILTER (event_type NOT BETWEEN 1 AND 7) AS bad_type,
      COUNT(*) FILTER (size <= 0) AS bad_size, COUNT(*) FILTER (price <= 1000) AS bad_price FROM messages GROUP BY 1""")

    cells["ofi_duration"] = _q(BOOK_LARGE + ", dl AS (SELECT *, " + _diff("bid_size_l1") + " - " + _diff("ask_size_l1") + " AS dd FROM book_large)",
      """SELECT symbol, seq, CAST(SUM(dd) OVER (PARTITION BY symbol ORDER BY ts_ns RANGE BETWEEN 431999999999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS ofi FROM dl""")
    cells["ofi_events"] = _q(BOOK + _DIFFS, f"SELECT symbol, seq, {_full(f'CAST(SUM(db1 - da1) {_rows(50)} AS BIGINT)', 50)} AS ofi_50, {_full(f'CAST(SUM(db1 - da1) {_rows(200)} AS BIGINT)', 200)} AS ofi_200 FROM d")
    cells["multi_level_ofi"] = _q(BOOK + _DIFFS, f"SELECT symbol, seq, {_full(f'CAST(SUM({_ML}) {_rows(50)} AS BIGINT)', 50)} AS mlofi_l2_l5_w50 FROM d")
    cells["spread_zscore"] = _q(BOOK + _DIFFS, f"SELECT symbol, seq, {rnd(_Z)} AS spread_zscore_200 FROM d")
    cells["realized_vol"] = _q(BOOK + _DIFFS, f"SELECT symbol, seq, {rnd(_full(f'sqrt(SUM(dm2*dm2/4.0) {_rows(200)})', 200))} AS realized_vol_200 FROM d")
    cells["queue_depletion_ewma"] = _q(BOOK + _DIFFS + _EWMA, f"SELECT symbol, seq, {_grid('qb', 999983)} AS queue_depletion_bid, {_grid('qa', 999983)} AS queue_depletion_ask FROM ew")
    cells["signed_trade_flow"] = _q(TRADES + _FLOW, "SELECT symbol, seq, signed_trade_flow_50 FROM flows")
    cells["trade_flow_imbalance"] = _q(TRADES + _FLOW, f"SELECT symbol, seq, {rnd('tfi_50', 9)} AS tfi_50 FROM flows")
    cells["labels"] = _q(BOOK + _LABEL.format(k=50), f"SELECT symbol, seq, {_CLASS} AS label FROM lab WHERE mv IS NOT NULL")
    cells["first_difference"] = _q(BOOK, f"SELECT symbol, seq, {_diff('bid_size_l1')} AS d_bid FROM book")
    cells["next_state"] = _q(BOOK + _STATES, "SELECT symbol, seq, state, next_state, delta_mid::DOUBLE AS delta_mid FROM pairs")
    cells["row_index"] = _q(TRADES, "SELECT symbol, seq, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS trade_no FROM trades")
    cells["carry_last_score"] = _q(SCORED + _QUOTES, "SELECT symbol, seq, last_score FROM cs")

    cells["time_order"] = _q(BOOK_LARGE, "SELECT symbol, seq, CAST(ROW_NUMBER() OVER (ORDER BY ts_ns, symbol, seq) - 1 AS BIGINT) AS position FROM book_large")
    cells["head_per_symbol"] = _q(BOOK, "SELECT symbol, seq, bid_price_l1 FROM book WHERE seq < 500")
    cells["time_split"] = _q(BOOK, "SELECT symbol, seq, seq < floor(COUNT(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) AS is_train FROM book")
    cells["balanced_undersample"] = _q(SCORED, """SELECT symbol, seq, label FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('42|' || symbol || '|' || seq), symbol, seq) AS rn
      FROM scored) WHERE rn <= 1000""")
    cells["best_horizon"] = _q(BOOK, " , ".join(["", *[
        f"l{k} AS (SELECT {k} AS k, AVG((mv > -200 AND mv < 200)::INT::DOUBLE) AS logloss FROM (SELECT lead(bid_price_l1 + ask_price_l1, {k}) OVER (PARTITION BY symbol ORDER BY seq) - (bid_price_l1 + ask_price_l1) AS mv FROM book) WHERE mv IS NOT NULL)"
        for k in (10, 50, 100)]]) + f" SELECT CAST(arg_min(k, logloss) AS INTEGER) AS k, {rnd('MIN(logloss)')} AS logloss FROM (SELECT * FROM l10 UNION ALL SELECT * FROM l50 UNION ALL SELECT * FROM l100)")
    cells["top_of_ladder"] = _q(MESSAGES + _RESTING, """, lv AS (SELECT at_seq, symbol, side, price, CAST(SUM(remaining) AS BIGINT) AS quantity FROM resting GROUP BY ALL),
      rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY at_seq, symbol, side ORDER BY -side * price) AS n FROM lv)
      SELECT at_seq, symbol, MAX(price) FILTER (side = 1 AND n = 1) AS bid_price_l1, """ + ", ".join(
        f"coalesce(MAX(quantity) FILTER (side = {s} AND n = {i}), 0) AS {nm}_size_l{i}" for s, nm in ((1, "bid"), (-1, "ask")) for i in range(1, 6)) +
      ", MAX(price) FILTER (side = -1 AND n = 1) AS ask_price_l1 FROM rk WHERE n <= 5 GROUP BY 1, 2")

    cells["pool_symbols"] = _q(MESSAGES, """SELECT symbol, seq, 'book' AS origin FROM book UNION ALL SELECT symbol, seq, 'messages' FROM messages""")
    cells["result_difference"] = _q(BOOK + _DIFFS, "SELECT symbol, seq, NULL::VARCHAR AS only_in FROM book WHERE FALSE")

    cells["normalise_order_events"] = _q(MESSAGES + _REPLACES, """SELECT symbol, seq, CAST(0 AS INTEGER) AS sub_no, 'cancel' AS kind, old_id AS order_id,
        NULL::TINYINT AS side, NULL::BIGINT AS price, NULL::BIGINT AS qty FROM ev WHERE kind = 'replace'
      UNION ALL SELECT symbol, seq, CAST(1 AS INTEGER), 'limit', order_id, side, price, qty FROM ev WHERE kind = 'replace'
      UNION ALL SELECT symbol, seq, CAST(0 AS INTEGER), kind, order_id, side, price, qty FROM ev WHERE kind <> 'replace'""")
    cells["classify_order_events"] = _q(MESSAGES + _ORDERS, "SELECT symbol, seq, kind, order_id, accepted, reason, effective_qty, remaining FROM classified")
    cells["order_lifecycle"] = _q(MESSAGES + _ORDERS, """, life AS (SELECT symbol, order_id,
        CAST(SUM(effective_qty) FILTER (kind = 'limit') AS BIGINT) AS submitted, CAST(coalesce(SUM(effective_qty) FILTER (kind IN ('cancel', 'reduce')), 0) AS BIGINT) AS cancelled,
        CAST(coalesce(SUM(effective_qty) FILTER (kind = 'execute'), 0) AS BIGINT) AS executed, MIN(seq) AS first_seq, MAX(seq) AS last_seq, arg_max(kind, seq) AS last_kind
        FROM classified WHERE accepted GROUP BY 1, 2)
      SELECT symbol, order_id, submitted, cancelled, executed, submitted - cancelled - executed AS remaining, first_seq, last_seq,
        CASE WHEN submitted - cancelled - executed > 0 THEN CASE WHEN executed > 0 THEN 'part_filled' ELSE 'resting' END
             WHEN last_kind = 'execute' THEN 'filled' ELSE 'cancelled' END AS state FROM life""")
    cells["depth_by_level"] = _q(MESSAGES + _DEPTH, "SELECT symbol, seq, side, price, depth FROM dp")
    cells["best_prices"] = _q(MESSAGES + _LEVELS, """SELECT m.symbol, m.seq, MAX(a.price) FILTER (a.side = 1 AND rk = 1) AS bid_price_l1, coalesce(MAX(a.depth) FILTER (a.side = 1 AND rk = 1), 0) AS bid_size_l1,
      MAX(a.price) FILTER (a.side = -1 AND rk = 1) AS ask_price_l1, coalesce(MAX(a.depth) FILTER (a.side = -1 AND rk = 1), 0) AS ask_size_l1
      FROM messages m LEFT JOIN alive a ON a.symbol = m.symbol AND a.seq = m.seq AND rk = 1 GROUP BY 1, 2""")
    cells["ladder_over_time"] = _q(MESSAGES + _LEVELS, "SELECT m.symbol, m.seq, " + ", ".join(
        f"MAX(a.price) FILTER (a.side = {s} AND rk = {i}) AS {nm}_price_l{i}, coalesce(MAX(a.depth) FILTER (a.side = {s} AND rk = {i}), 0) AS {nm}_size_l{i}"
        for i in range(1, 4) for s, nm in ((1, "bid"), (-1, "ask"))) + " FROM messages m LEFT JOIN alive a ON a.symbol = m.symbol AND a.seq = m.seq AND rk <= 3 GROUP BY 1, 2")
    cells["sweep_ladder"] = _q(BOOK + _SNAP_ORDERS + _LADDER_ROWS, f""", tk AS (SELECT *, CASE WHEN kind = 'market' OR (side = 1 AND p <= limit_price) OR (side = -1 AND p >= limit_price)
          THEN least(q, greatest(qty - coalesce(SUM(q) OVER (PARTITION BY symbol, seq ORDER BY lv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) ELSE 0 END AS take FROM lad),
      sw AS (SELECT symbol, seq, side, kind, qty, CAST(SUM(take) AS BIGINT) AS filled_qty, COUNT(*) FILTER (take > 0) AS levels_touched, SUM(take * p) AS val, MIN(CASE WHEN lv = 1 THEN p END) AS best
        FROM tk GROUP BY ALL)
      SELECT symbol, seq, filled_qty, levels_touched, {rnd('val::DOUBLE / NULLIF(filled_qty, 0)')} AS avg_price, {rnd('(val::DOUBLE / NULLIF(filled_qty, 0) - best) * side')} AS slippage,
        CASE WHEN kind = 'limit' THEN qty - filled_qty ELSE 0 END AS rests_qty, CASE WHEN kind <> 'limit' THEN qty - filled_qty ELSE 0 END AS dropped_qty FROM sw""")
    cells["sweep_orders"] = _q(MESSAGES + _RESTING, """, inc AS (SELECT at_seq, symbol, 999999999 AS taker_id, s AS side, 1000 AS qty FROM (SELECT DISTINCT at_seq, symbol FROM resting), (VALUES (1), (-1)) AS z(s)),
      fc AS (SELECT i.at_seq, i.symbol, i.side, i.taker_id, i.qty, r.order_id AS maker_id, r.price, r.remaining,
        coalesce(SUM(r.remaining) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, ROW_NUMBER() OVER w AS fill_no
        FROM inc i JOIN resting r ON r.at_seq = i.at_seq AND r.symbol = i.symbol AND r.side = -i.side
        WINDOW w AS (PARTITION BY i.at_seq, i.symbol, i.side ORDER BY i.side * r.price, r.entry_seq, r.order_id))
      SELECT at_seq, symbol, CAST(side AS TINYINT) AS side, fill_no, maker_id, price, CAST(least(remaining, qty - before) AS BIGINT) AS quantity FROM fc WHERE before < qty""")
    cells["book_at"] = _q(MESSAGES + _RESTING, "SELECT at_seq, symbol, order_id, side, price, remaining, entry_seq FROM resting")
    cells["level_sizes"] = _q(MESSAGES + _RESTING, "SELECT at_seq, symbol, side, price, CAST(SUM(remaining) AS BIGINT) AS quantity, COUNT(*) AS orders FROM resting GROUP BY 1, 2, 3, 4")
    cells["queue_ahead"] = _q(MESSAGES + _DEPTH, "SELECT symbol, seq, order_id, greatest(depth - size, 0) AS queue_ahead FROM dp WHERE event_type = 1")
    cells["book_invariants"] = _q(MESSAGES + _LEVELS, """, tops AS (SELECT symbol, seq, MAX(price) FILTER (side = 1) AS b, MIN(price) FILTER (side = -1) AS a FROM alive WHERE rk = 1 GROUP BY 1, 2),
      ids AS (SELECT symbol, order_id, COUNT(*) FILTER (kind = 'limit') AS i, COUNT(*) FILTER (kind = 'cancel') AS o, MIN(remaining) AS lo FROM classified WHERE accepted GROUP BY 1, 2)
      SELECT 'crossed' AS "check", COUNT(*) FILTER (b >= a) AS violations FROM tops UNION ALL SELECT 'empty_top', 0
      UNION ALL SELECT 'double_cancel', COUNT(*) FILTER (o > i) FROM ids UNION ALL SELECT 'negative_remaining', COUNT(*) FILTER (lo < 0) FROM ids""")

    matrix = f"""SELECT d.symbol, d.seq, d.ts_ns, {rnd(FIXED_TABLE_SQL)} AS microprice_g_dev, {rnd(IMB)} AS imbalance_l1, {rnd(SPREAD)} AS spread_ticks,
      {rnd(f'coalesce({_Z}, 0)', 5)} AS spread_zscore_200, {_full(f'SUM(db1 - da1) {_rows(50)}', 50)} AS o50, {_full(f'SUM(db1 - da1) {_rows(200)}', 200)} AS o200,
      {_full(f'SUM({_ML}) {_rows(50)}', 50)} AS ml, {rnd(f"coalesce({_full(f'sqrt(SUM(dm2*dm2/4.0) {_rows(200)})', 200)}, 0)", 5)} AS realized_vol_200,
      {_grid('qb', 99991)} AS queue_depletion_bid, {_grid('qa', 99991)} AS queue_depletion_ask FROM d JOIN ew USING (symbol, seq)"""
    cells["feature_matrix"] = _q(TRADES + _DIFFS + _EWMA + _FLOW + f", mx AS ({matrix})", f"""SELECT mx.symbol, mx.seq, ts_ns, microprice_g_dev, imbalance_l1, spread_ticks, spread_zscore_200,
      coalesce(o50, 0)::DOUBLE AS ofi_50, coalesce(o200, 0)::DOUBLE AS ofi_200, coalesce(ml, 0)::DOUBLE AS mlofi_l2_l5_w50, coalesce(signed_trade_flow_50, 0)::DOUBLE AS signed_trade_flow_50,
      {rnd('coalesce(tfi_50, 0)')} AS tfi_50, realized_vol_200, queue_depletion_bid, queue_depletion_ask, """
      + ", ".join(f"(mx.symbol = '{s}')::INT::DOUBLE AS \"ticker_{s}\"" for s in ("AAPL", "AMZN", "GOOG", "INTC", "MSFT"))
      + """, (mx.seq >= 50)::INT::DOUBLE AS is_warm_50, (mx.seq >= 200)::INT::DOUBLE AS is_warm_200
      FROM mx ASOF LEFT JOIN flows f ON mx.symbol = f.symbol AND mx.seq >= f.seq""")
    cells["stream_features"] = cells["feature_matrix"]
    cells["stream_depth"] = cells["depth_by_level"]
    cells["stream_best_prices"] = cells["best_prices"]
    cells["stream_order_ops"] = cells["route_order_ops"]
    cells["accepted_events"] = _q(MESSAGES + _PLAYED, "SELECT symbol, seq, kind, order_id FROM verdicts WHERE reason IS NULL")
    cells["stream_event_log"] = cells["accepted_events"]
    # An accepted replace is a cancel and a limit, a refused one a single row without effect.
    cells["classify_replaces"] = _q(MESSAGES + _PLAYED, """, whole AS (SELECT *, kind = 'replace' AND reason IS NULL AS parts FROM verdicts)
      SELECT symbol, seq, 0 AS sub_no, CASE WHEN parts THEN 'cancel' ELSE kind END AS kind, CASE WHEN parts THEN old_id ELSE order_id END AS order_id,
        CASE WHEN kind <> 'replace' THEN side END AS side, CASE WHEN NOT parts THEN price END AS price, CASE WHEN NOT parts THEN qty END AS qty, reason,
        CASE WHEN reason IS NOT NULL THEN 0 WHEN parts THEN gone WHEN kind = 'cancel' THEN own ELSE qty END AS effective_qty,
        CASE WHEN kind = 'replace' OR kind IN ('cancel', 'ioc') THEN 0 WHEN reason IS NOT NULL THEN own ELSE qty END AS remaining, reason IS NULL AS accepted
      FROM whole
      UNION ALL SELECT symbol, seq, 1, 'limit', order_id, side, price, qty, NULL, qty, qty, true FROM whole WHERE parts""")
    cells["labelled_dataset"] = _q(BOOK + _LABEL.format(k=10), f"SELECT symbol, {_CLASS} AS label, COUNT(*) AS n FROM lab WHERE mv IS NOT NULL GROUP BY 1, 2")
    cells["symbol_summary"] = _q(BOOK + _DIFFS + f", s2 AS (SELECT symbol, seq, {IMB} AS imb, {SPREAD} AS spr, {_full(f'SUM(db1 - da1) {_rows(50)}', 50)} AS o FROM d)",
      f"SELECT symbol, COUNT(*) AS rows, {rnd('AVG(imb)')} AS mean_imbalance, {rnd('AVG(spr)')} AS mean_spread, {rnd('AVG(o)')} AS mean_ofi_50 FROM s2 GROUP BY 1")

    cells["naive_quotes"] = _q(SCORED + _QUOTES, "SELECT symbol, seq, side_sign, price FROM quotes")
    cells["score_aware_quotes"] = _q(SCORED + _QUOTES, "SELECT symbol, seq, side_sign, price FROM aware")
    everything = TRADES + SCORED[len(BOOK):] + _QUOTES
    cells["quote_fills"] = _q(everything + _FILLS, "SELECT symbol, policy, quote_seq, side_sign, fill_price, seq, quantity FROM fills")
    cells["markouts"] = _q(everything + _FILLS, f"SELECT symbol, policy, quote_seq, side_sign, seq, {rnd('markout')} AS markout FROM mk")
    rounded = ", ".join(f"{rnd(c)} AS {c}" for c in ("fill_rate", "markout_mean_ticks", "markout_median_ticks", "adverse_selection_bps", "gross_pnl_ticks"))
    cells["policy_summary"] = _q(everything + _FILLS + _SUMMARY, f"SELECT symbol, policy, quotes_posted, fills, fill_qty, {rounded} FROM summary")
    pairs = []
    for c in ("quotes_posted", "fills", "fill_rate", "markout_mean_ticks", "adverse_selection_bps", "gross_pnl_ticks"):
        a, b = f"MAX({c}) FILTER (policy = 'naive')", f"MAX({c}) FILTER (policy = 'ml_aware')"
        whole = c in ("quotes_posted", "fills")
        for expression, suffix in ((a, "naive"), (b, "ml_aware"), (f"({b}) - ({a})", "delta")):
            pairs.append(f"{expression if whole else rnd(expression)} AS {c}_{suffix}")
    cells["compare_policies"] = _q(everything + _FILLS + _SUMMARY, f"SELECT symbol, {', '.join(pairs)} FROM summary GROUP BY 1")
    cells["own_fills"] = _q(TRADES, """, fl AS (SELECT symbol, seq, order_id AS maker_id, order_id + 1 AS taker_id, size FROM trades),
      own AS (SELECT symbol, rid AS order_id, CAST(CASE WHEN rid % 2 = 0 THEN 1 ELSE -1 END AS TINYINT) AS side_sign FROM book)
      SELECT x.symbol, x.seq, x.order_id, o.side_sign FROM (SELECT symbol, seq, maker_id AS order_id FROM fl UNION ALL SELECT symbol, seq, taker_id FROM fl) x
      JOIN own o ON o.symbol = x.symbol AND o.order_id = x.order_id""")
    return cells
