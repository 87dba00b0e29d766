"""Small frames and plain-Python models of the operators, used as the expected side of tests."""

from datetime import date

import pandas as pd

DAY = date(2024, 1, 2)


def frame(spark, rows: list[dict], schema: str | None = None):
    """Rows of one symbol and day; `seq` is the list position unless given."""
    full = [{"symbol": "AAPL", "trade_date": DAY, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame(pd.DataFrame(full), schema) if schema else spark.createDataFrame(full)


def tob(spark, rows: list[tuple]):
    names = ("bid_price_l1", "bid_size_l1", "ask_price_l1", "ask_size_l1")
    return frame(spark, [dict(zip(names, r)) for r in rows])


def column(df, name: str, order: str = "seq"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


class Book:
    """Sequential order book: the reference for sweeps and lifecycles on tiny inputs."""

    def __init__(self):
        self.orders = {}  # id -> [side, price, qty, entry], insertion order is the queue order

    def fills(self, taker, side, qty, cap=None):
        out = []
        while qty > 0:
            facing = [(p * side, n, i) for n, (i, (s, p, q, _)) in enumerate(self.orders.items()) if s == -side]
            facing = [f for f in facing if cap is None or f[0] <= cap * side]
            if not facing:
                break
            _, _, maker = min(facing)
            take = min(qty, self.orders[maker][2])
            out.append((taker, maker, self.orders[maker][1], take))
            qty -= take
            self.orders[maker][2] -= take
            if not self.orders[maker][2]:
                del self.orders[maker]
        return out, qty
