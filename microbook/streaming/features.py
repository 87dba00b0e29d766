"""Streaming twin of the feature matrix: one state per symbol and day, updated batch by batch.

The state holds what the longest window needs, nothing more: the last 201 book rows (12 integers each), the last 50 trades,
the two exponential averages and the last event index. A batch is appended to that tail and all windows are read from
integer prefix sums, so the cost per event does not depend on the window.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from microbook.functions.predicates import TRADE_TYPES
from microbook.functions.scalars import imbalance, spread_ticks, symbol_one_hot, warm_flags
from microbook.operators.microprice import MicropriceTable, lookup_microprice
from microbook.plans.matrix import feature_columns
from microbook.schema import EWMA_ALPHA, KEYS, SEQ, SYMBOLS, TICK_SIZE, TOB_COLUMNS

SHORT, LONG = 50, 200
_OUTER = tuple(f"{side}_size_l{i}" for i in (2, 3, 4, 5) for side in ("bid", "ask"))
_BOOK = (*TOB_COLUMNS, *_OUTER)
_COMPUTED = (
    "spread_zscore_200", "ofi_50", "ofi_200", "mlofi_l2_l5_w50", "signed_trade_flow_50", "tfi_50", "realized_vol_200",
    "queue_depletion_bid", "queue_depletion_ask",
)
_STATE = "last_seq bigint, rows bigint, tail array<bigint>, trades array<bigint>, averages array<double>, flows array<double>, newest array<double>"
_STATUS = "status string, gap bigint"


def _window_sum(values: np.ndarray, window: int) -> np.ndarray:
    """Sum of up to `window` values ending at each position."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.arange(1, len(values) + 1)
    return total[ends] - total[np.maximum(ends - window, 0)]


def _smooth(start: float, changes: np.ndarray, alpha: float) -> np.ndarray:
    series = pd.Series(np.concatenate([[start], changes.astype(float)]))
    return series.ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


class _Features:
    """Vectorised update for one symbol: old tail + new rows in, features of the new rows out."""

    def __init__(self, partial: bool):
        self.partial = partial

    def gate(self, values: np.ndarray, index: np.ndarray, window: int) -> np.ndarray:
        return values if self.partial else np.where(index >= window - 1, values, 0.0)

    def __call__(self, old: tuple, rows: pd.DataFrame) -> tuple[np.ndarray, tuple]:
        last_seq, seen, tail, trades, averages, flows, _ = old
        before = np.asarray(tail, dtype=np.int64).reshape(-1, len(_BOOK))
        book = np.vstack([before, rows[list(_BOOK)].to_numpy(dtype=np.int64)])
        new = slice(len(before), None)
        index = seen + np.arange(len(rows))
        bid, bid_size, ask, ask_size = book[:, 0], book[:, 1], book[:, 2], book[:, 3]

        def change(x: np.ndarray) -> np.ndarray:
            return np.diff(x, prepend=x[:1])

        d_bid, d_ask = change(bid_size), change(ask_size)
        outer = book[:, 4::2].sum(axis=1) - book[:, 5::2].sum(axis=1)
        spread, moved = ask - bid, change(bid + ask)
        n = np.minimum(index + 1, LONG)
        s1, s2 = _window_sum(spread, LONG)[new], _window_sum(spread * spread, LONG)[new]
        scatter = n * s2 - s1 * s1
        with np.errstate(divide="ignore", invalid="ignore"):
            deviation = np.sqrt(scatter / (n * (n - 1.0)))
            zscore = np.where(scatter > 0, (spread[new] - s1 / n) / deviation, 0.0)
        net = d_bid - d_ask
        smooth_bid = _smooth(averages[0], d_bid[new], EWMA_ALPHA)
        smooth_ask = _smooth(averages[1], d_ask[new], EWMA_ALPHA)

        flow, share, trades, flows = self.trade_flows(rows, np.asarray(trades, dtype=np.int64), flows)
        computed = np.column_stack(
            [
                self.gate(zscore, index, LONG),
                self.gate(_window_sum(net, SHORT)[new], index, SHORT),
                self.gate(_window_sum(net, LONG)[new], index, LONG),
                self.gate(_window_sum(change(outer), SHORT)[new], index, SHORT),
                flow,
                share,
                self.gate(np.sqrt(_window_sum(moved * moved, LONG)[new] / 4.0), index, LONG),
                smooth_bid,
                smooth_ask,
            ]
        )
        kept = book[-(LONG + 1) :]
        state = (
            int(rows[SEQ].iloc[-1]), seen + len(rows), kept.reshape(-1).tolist(), trades.tolist(),
            [float(smooth_bid[-1]), float(smooth_ask[-1])], flows, computed[-1].tolist(),
        )
        return computed, state

    def trade_flows(self, rows: pd.DataFrame, trades: np.ndarray, flows: list[float]):
        """Signed volume and imbalance of the last 50 trades, at or before each row. `trades` are signed sizes."""
        is_trade = rows["event_type"].isin(TRADE_TYPES).to_numpy()
        signed = np.where(is_trade, -rows["side"].fillna(0).to_numpy() * rows["size"].fillna(0).to_numpy(), 0).astype(np.int64)
        recent = np.concatenate([trades, signed[is_trade]])
        flow, buys = _window_sum(recent, SHORT), _window_sum(np.maximum(recent, 0), SHORT)
        volume = _window_sum(np.abs(recent), SHORT)
        share = np.where(volume > 0, (2 * buys - volume) / np.maximum(volume, 1), 0.0)
        ready = np.arange(1, len(recent) + 1) >= (1 if self.partial else SHORT)
        at_trades = np.column_stack([np.where(ready, flow, 0.0), np.where(ready, share, 0.0)])
        table = np.vstack([[flows], at_trades[len(trades) :]]).astype(float)
        found = table[np.cumsum(is_trade)]
        return found[:, 0], found[:, 1], recent[-SHORT:], found[-1].tolist()


_EMPTY = (-1, 0, [], [], [0.0, 0.0], [0.0, 0.0], [0.0] * len(_COMPUTED))


def _updater(partial: bool, emit: str):
    compute = _Features(partial)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(SEQ, kind="stable")
        old = state.get if state.exists else _EMPTY
        late = (rows[SEQ] <= old[0]) | rows[SEQ].duplicated()
        on_time, behind = rows[~late], rows[late]
        if len(on_time):
            values, new = compute(old, on_time)
            if emit == "before":
                values = np.vstack([[old[6]], values[:-1]])
            state.update(new)
            out = on_time[[*KEYS, SEQ, "ts_ns", *TOB_COLUMNS]].copy()
            for position, name in enumerate(_COMPUTED):
                out[name] = values[:, position]
            steps = np.diff(on_time[SEQ].to_numpy(), prepend=old[0])
            yield out.assign(status="ok", gap=steps - 1)
        if len(behind):
            out = behind[[*KEYS, SEQ, "ts_ns", *TOB_COLUMNS]].copy()
            yield out.assign(**{name: np.nan for name in _COMPUTED}, status="late", gap=0)

    return update


def stream_windows(joined: DataFrame, *, partial: bool = False, emit: str = "after") -> DataFrame:
    """Window features of a stream of joined message and book rows.

    `emit="after"` gives the features including the event (as in batch), `"before"` those in force when it arrived.
    Rows at or behind the last processed index of their symbol come out with status `late`; `gap` counts skipped indices.
    """
    if emit not in ("after", "before"):
        raise ValueError("emit must be 'after' or 'before'")
    needed = joined.select(*KEYS, SEQ, "ts_ns", *_BOOK, "event_type", "side", "size")
    kinds = ", ".join(f"{c} bigint" for c in (SEQ, "ts_ns", *TOB_COLUMNS))
    output = f"symbol string, trade_date date, {kinds}, " + ", ".join(f"{c} double" for c in _COMPUTED) + f", {_STATUS}"
    return needed.groupBy(*KEYS).applyInPandasWithState(
        _updater(partial, emit), output, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def late_rows(windows: DataFrame) -> DataFrame:
    return windows.where("status = 'late'")


def stream_features(windows: DataFrame, table: MicropriceTable, *, as_float: bool = True) -> DataFrame:
    """The 19 features from `stream_windows`; everything here reads one row at a time."""
    derived = {
        "imbalance_l1": imbalance(), "spread_ticks": spread_ticks(TICK_SIZE), **symbol_one_hot(SYMBOLS), **warm_flags((50, 200), SEQ),
    }
    looked_up = lookup_microprice(windows.where("status = 'ok'").withColumns(derived), table)
    return looked_up.select(*KEYS, SEQ, "ts_ns", *feature_columns("float" if as_float else "double"))
