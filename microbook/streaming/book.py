"""Streaming order book: one verdict per source event, the depth at its level and the best prices after it.

A keyed state machine per symbol and day (`transformWithState` on RocksDB). State: resting orders in pages of near ids and sizes by side and price
(maps, read and written only where a micro-batch touches them), the last index, and the rows that wait because an earlier
index has not come yet, in blocks of the index: a row that waits is written once and read once when its turn comes, however many
micro-batches pass until then. Events take effect in the order of their dense index whatever the order of arrival. Timers end what never
comes: a gap that stays open for `patience_ms` is jumped and counted, a day without rows for `expire_ms` gives its state back.
A replay of stored rows lacks no index, and how long it takes says nothing about them: `patience_ms=None` never jumps.

One task handles a symbol and day, so nothing but the rules runs there row by row: the tasks that read the files pack events of a block as
columns of whole numbers, these wait packed, and results leave packed and are laid out as rows behind the state machine.

The rules are those of `classify_order_events` and `classify_replaces`; an order's removals take effect at the order's own level.
"""

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from microbook.operators.book import order_kind
from microbook.schema import KEYS, SEQ

DAY_MS = 86_400_000
PATIENCE_MS = 60_000
#: Orders (and pages, levels) that one worker remembers of a micro-batch before it writes them to the state; orders of a page at most.
_CACHED, _PAGE = 400_000, 1_024
#: Indices of a block of waiting rows; rows that one worker holds before it packs them or stores those that wait; rows that come out at once.
_BLOCK, _HELD, _OUT = 4_096, 100_000, 10_000
_EVENT = (SEQ, "kind", "order_id", "old_id", "side", "price", "qty")
#: Packed columns of an event, whole numbers all: kinds, statuses and reasons by their place, NULL by a stand-in.
_PACKED = 1 + len(_EVENT)
KINDS = ("limit", "reduce", "execute", "cancel", "replace", "market", "ioc")
_LIMIT, _REDUCE, _EXECUTE, _CANCEL, _REPLACE, _MARKET, _IOC = range(len(KINDS))
STATUSES = ("accepted", "rejected", "ignored", "late")
_ACCEPTED, _REJECTED, _IGNORED, _LATE = range(len(STATUSES))
REASONS = ("bad_qty", "duplicate_id", "unknown_id")
_BAD_QTY, _DUPLICATE, _UNKNOWN = range(len(REASONS))
_RESTS = (0, 0, 0)
_NULL = -(1 << 63)

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # Timers would otherwise ask for one empty batch after the other; they go off with the next batch that has rows of any symbol.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which maps and timers need; `partitions` is the number of its parts, for good."""
    wanted = STATE_STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def state_partitions(feed: DataFrame) -> int:
    """Parts of the state for a stored feed: as few as give each symbol and day a task of its own, or nearly so.

    Each part costs every micro-batch a commit, and of few keys several easily share one by hash: three of the five symbols do with 8 or
    16 parts. Where there are more keys than shuffle partitions of the session, these are as good.
    """
    usual = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = [row[0] for row in feed.select(*KEYS).distinct().select(F.hash(*KEYS)).limit(usual + 1).collect()]
    if not 0 < len(hashes) <= usual:
        return usual
    return min(range(len(hashes), 8 * len(hashes) + 1), key=lambda parts: max(Counter(value % parts for value in hashes).values()))


class _Cached:
    """A map state, of which a micro-batch reads each key once and writes each changed key once."""

    def __init__(self, state, nothing):
        self._state, self._nothing = state, nothing
        self._seen: dict = {}
        self._changed: set = set()
        self._stored: set = set()

    def get(self, key: tuple):
        value = self._seen.get(key)
        if value is None:
            if len(self._seen) >= _CACHED:
                self.flush()
            value = self._state.getValue(key)
            if value is None:
                value = self._nothing
            else:
                self._stored.add(key)
            self._seen[key] = value
        return value

    def put(self, key: tuple, value: tuple) -> None:
        """Only after `get` of the same key."""
        self._seen[key] = value
        self._changed.add(key)

    def flush(self) -> None:
        for key in self._changed:
            value = self._seen[key]
            if value != self._nothing:
                self._state.updateValue(key, value)
            elif key in self._stored:
                self._state.removeKey(key)
        for part in (self._seen, self._changed, self._stored):
            part.clear()


def _pack(columns: np.ndarray) -> tuple[int, bytes]:
    """Number of rows and their columns of 64-bit numbers in one compressed piece."""
    return columns.shape[1], pa.compress(np.ascontiguousarray(columns).tobytes(), codec="zstd", asbytes=True)


def _unpack(columns: int, n: int, packed: bytes) -> np.ndarray:
    data = pa.decompress(bytes(packed), decompressed_size=8 * columns * n, codec="zstd", asbytes=True)
    return np.frombuffer(data, np.int64).reshape(columns, n)


class _Orders:
    """Resting orders. The state holds them in pages of near ids, which are read and written whole: orders near in time are near in id.

    A page that grows too large is divided, neighbours that have become small are joined, so the number of pages follows that of the orders
    however far apart their ids are. The list of pages (first id, number) is an entry of its own.
    """

    _LIST = (-1,)

    def __init__(self, state):
        self._state = state
        listed = state.getValue(self._LIST)
        self._firsts, self._numbers = _unpack(2, *listed).tolist() if listed else ([_NULL], [0])
        self._next = max(self._numbers) + 1
        self._listed = True
        self._pages: dict[int, dict] = {}
        self._changed: set[int] = set()
        self._stored: set[int] = set()
        self._held = 0

    def get(self, order_id: int | None) -> tuple:
        order_id = _NULL if order_id is None else order_id
        number = self._numbers[bisect_right(self._firsts, order_id) - 1]
        page = self._pages.get(number)
        return (self._load(number) if page is None else page).get(order_id, _RESTS)

    def put(self, order_id: int | None, value: tuple) -> None:
        order_id = _NULL if order_id is None else order_id
        place = bisect_right(self._firsts, order_id) - 1
        number = self._numbers[place]
        page = self._pages.get(number)
        if page is None:
            page = self._load(number)
            place = bisect_right(self._firsts, order_id) - 1  # others may have been joined
        self._changed.add(number)
        if value == _RESTS:
            page.pop(order_id, None)
            return
        self._held += order_id not in page
        page[order_id] = value
        if len(page) > _PAGE:
            self._divide(place)

    def flush(self) -> None:
        self._join()
        for number in self._changed:
            page = self._pages[number]
            if page:
                self._state.updateValue((number,), _pack(np.array([(order_id, *value) for order_id, value in page.items()], np.int64).T))
            elif number in self._stored:
                self._state.removeKey((number,))
        if not self._listed:
            self._state.updateValue(self._LIST, _pack(np.array([self._firsts, self._numbers], np.int64)))
            self._listed = True
        for part in (self._pages, self._changed, self._stored):
            part.clear()
        self._held = 0

    def _load(self, number: int) -> dict:
        if self._held >= _CACHED:
            self.flush()
        stored = self._state.getValue((number,))
        page = {}
        if stored:
            ids, *values = _unpack(4, *stored).tolist()
            page = dict(zip(ids, zip(*values, strict=True), strict=True))
            self._stored.add(number)
        self._pages[number] = page
        self._held += 1 + len(page)
        return page

    def _divide(self, place: int) -> None:
        page = self._pages[self._numbers[place]]
        ids = sorted(page)[len(page) // 2 :]
        self._firsts.insert(place + 1, ids[0])
        self._numbers.insert(place + 1, self._next)
        self._pages[self._next] = {order_id: page.pop(order_id) for order_id in ids}
        self._changed.add(self._next)
        self._next += 1
        self._listed = False

    def _join(self) -> None:
        """Small pages go into the one before, if both are at hand; empty ones leave the list."""
        firsts, numbers = self._firsts[:1], self._numbers[:1]
        for first, number in zip(self._firsts[1:], self._numbers[1:], strict=True):
            page, before = self._pages.get(number), self._pages.get(numbers[-1])
            if page is not None and not page:
                continue
            if page is not None and before is not None and len(page) + len(before) <= _PAGE // 2:
                before.update(page)
                page.clear()
                self._changed |= {number, numbers[-1]}
            else:
                firsts.append(first)
                numbers.append(number)
        self._listed &= len(numbers) == len(self._numbers)
        self._firsts, self._numbers = firsts, numbers


class _Waiting:
    """Rows whose turn has not come. A micro-batch adds one piece to each block that it has rows of; a block is read when its turn comes."""

    def __init__(self, blocks, pieces, count: int):
        self._blocks, self._pieces, self.count = blocks, pieces, count
        self._new: dict[int, list[tuple[int, bytes]]] = {}
        self._held = 0

    def add(self, events: list[tuple]) -> None:
        """Events as (at, seq, kind, order_id, old_id, side, price, qty)."""
        self.add_columns(np.array([[_number(value) for value in event] for event in events], np.int64).reshape(-1, _PACKED).T)

    def add_columns(self, columns: np.ndarray) -> None:
        for block, part in _by_block(columns[:, np.argsort(columns[0], kind="stable")]):
            self.add_piece(block, *_pack(part))

    def add_piece(self, block: int, n: int, packed: bytes) -> None:
        self._new.setdefault(block, []).append((n, packed))
        self.count += n
        self._held += n
        if self._held > _HELD:
            self.flush()

    def take(self, block: int) -> list[tuple]:
        """The rows of a block in the order of the index, equal ones in the order of arrival. They wait no longer."""
        return [
            (at, seq, None if kind == _NULL else KINDS[kind], *(None if value == _NULL else value for value in values))
            for at, seq, kind, *values in self.take_columns(block).T.tolist()
        ]

    def take_columns(self, block: int) -> np.ndarray:
        """The same as packed columns."""
        stored = range(self._stored(block))
        parts = [self._pieces.getValue((block, piece)) for piece in stored]
        for piece in stored:
            self._pieces.removeKey((block, piece))
        if parts:
            self._blocks.removeKey((block,))
        new = self._new.pop(block, [])
        self._held -= sum(n for n, _ in new)
        rows = [_unpack(_PACKED, *part) for part in (*parts, *new)]
        columns = np.concatenate(rows, axis=1) if rows else np.empty((_PACKED, 0), np.int64)
        self.count -= columns.shape[1]
        return columns[:, np.argsort(columns[0], kind="stable")]

    def blocks(self) -> list[int]:
        return sorted({*self._new, *(block for (block,) in self._blocks.keys())})

    def flush(self) -> None:
        for block, parts in self._new.items():
            piece = self._stored(block)
            whole = parts[0] if len(parts) == 1 else _pack(np.concatenate([_unpack(_PACKED, *part) for part in parts], axis=1))
            self._pieces.updateValue((block, piece), whole)
            self._blocks.updateValue((block,), (piece + 1,))
        self._new.clear()
        self._held = 0

    def _stored(self, block: int) -> int:
        pieces = self._blocks.getValue((block,))
        return pieces[0] if pieces else 0


def _number(value) -> int:
    return _NULL if value is None else KINDS.index(value) if isinstance(value, str) else value


def _by_block(columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal blocks; the columns are in the order of the index."""
    blocks = columns[0] // _BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if begin < end:
            yield int(blocks[begin]), columns[:, begin:end]


class _Tops:
    """Best levels per side. Prices are kept in order, and the row of the best is built anew only when a change reaches them."""

    def __init__(self, levels: int, sizes: Iterable[tuple[tuple, tuple]]):
        self._levels = levels
        self._sizes: dict[int, dict[int, int]] = {1: {}, -1: {}}
        for (side, price), (size,) in sizes:
            if side in self._sizes and price != _NULL:
                self._sizes[side][-side * price] = size
        self._ranks = {side: sorted(sizes) for side, sizes in self._sizes.items()}
        self._row: list | None = None

    def put(self, side: int, price: int, size: int) -> None:
        if side not in self._sizes or price == _NULL:
            return
        rank, sizes, ranks = -side * price, self._sizes[side], self._ranks[side]
        if size:
            if rank not in sizes:
                insort(ranks, rank)
            sizes[rank] = size
        elif sizes.pop(rank, None):
            del ranks[bisect_left(ranks, rank)]
        if len(ranks) < self._levels or rank <= ranks[self._levels - 1]:
            self._row = None

    def row(self) -> list:
        if self._row is None:
            cells: list[list] = []
            for side in (1, -1):
                best = self._ranks[side][: self._levels]
                cells.append([(-side * rank, self._sizes[side][rank]) for rank in best] + [(_NULL, 0)] * (self._levels - len(best)))
            self._row = [value for bid, ask in zip(*cells, strict=True) for level in (bid, ask) for value in level]
        return self._row


class _BookProcessor(StatefulProcessor):
    def __init__(self, first: int, levels: int, patience_ms: int | None, expire_ms: int):
        self._first, self._levels, self._patience, self._expire = first, levels, patience_ms, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._place = handle.getValueState("place", "last bigint, gap_alarm bigint, day_alarm bigint, seen_at bigint, waiting bigint")
        self._order_state = handle.getMapState("orders", "page bigint", "n bigint, orders binary")
        self._level_state = handle.getMapState("levels", "side bigint, price bigint", "size bigint")
        self._block_state = handle.getMapState("blocks", "block bigint", "pieces bigint")
        self._piece_state = handle.getMapState("pieces", "block bigint, piece bigint", "n bigint, events binary")

    def close(self) -> None:
        pass

    # --- rules ---

    def _change(self, side: int, price: int, by: int) -> int:
        size = self._sizes.get((side, price))[0] + by
        self._sizes.put((side, price), (size,))
        if self._tops:
            self._tops.put(side, price, size)
        return size

    def _remove(self, order_id: int, order: tuple, qty: int) -> tuple[int, int]:
        side, price, size = order
        self._orders.put(order_id, (side, price, size - qty) if size > qty else _RESTS)
        return size - qty, self._change(side, price, -qty)

    def _enter(self, order_id: int, side: int, price: int, qty: int) -> int:
        self._orders.put(order_id, (side, price, qty))
        return self._change(side, price, qty)

    def _apply(self, kind, order_id, old_id, side, price, qty) -> tuple:
        """(status, reason, effective_qty, remaining, depth)"""
        if kind == _NULL:
            return _IGNORED, _NULL, 0, _NULL, self._size_at(side, price)
        reason, depth, done, after = _NULL, _NULL, 0, 0
        rests = self._orders.get(order_id) if order_id != _NULL and kind != _MARKET and kind != _IOC else _RESTS
        if kind != _CANCEL and qty <= 0:  # NULL too
            reason, after = _BAD_QTY, rests[2]
        elif kind == _LIMIT:
            if rests[2]:
                reason, after = _DUPLICATE, rests[2]
            else:
                done = after = qty
                depth = self._enter(order_id, side, price, qty)
        elif kind == _MARKET or kind == _IOC:
            done = qty
        elif kind == _REPLACE:
            old = self._orders.get(old_id)
            if not old[2]:
                reason = _UNKNOWN
            elif old_id != order_id and rests[2]:
                reason = _DUPLICATE
            else:
                self._remove(old_id, old, old[2])
                done = after = qty
                depth = self._enter(order_id, old[0], price, qty)
        elif not rests[2]:
            reason = _UNKNOWN
        else:
            done = rests[2] if kind == _CANCEL or qty > rests[2] else qty
            after, depth = self._remove(order_id, rests, done)
        if reason == _NULL:
            status = _ACCEPTED
        else:
            status = _REJECTED
            if kind == _REPLACE:
                after = 0
        return status, reason, done, after, self._size_at(side, price) if depth == _NULL else depth

    def _size_at(self, side, price):
        return self._sizes.get((side, price))[0] if side != _NULL and price != _NULL else _NULL

    # --- order of events ---

    def _play(self, columns: np.ndarray, late: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """Packed results of events in turn; `late` ones change nothing."""
        if self._orders is None:
            self._orders, self._sizes = _Orders(self._order_state), _Cached(self._level_state, (0,))
            self._tops = _Tops(self._levels, self._level_state.iterator()) if self._levels else None
        done, apply, tops = [], self._apply, self._tops
        too_late = (_LATE, _NULL, 0, _NULL, _NULL, *[_NULL] * (4 * self._levels))
        for passed, *event in zip(late.tolist(), *columns[2:].tolist(), strict=True):
            if passed:
                done.append(too_late)
            elif tops:
                done.append((*apply(*event), *tops.row()))
            else:
                done.append(apply(*event))
        results = np.array(done, np.int64).reshape(-1, len(too_late)).T
        return np.concatenate([columns[1:], results[:5], gaps[None], results[5:]])

    def _late(self, columns: np.ndarray) -> np.ndarray:
        nothing = np.zeros(columns.shape[1], np.int64)
        return self._play(columns, nothing == 0, nothing)

    def _turns(self, waiting: _Waiting, last: int, jump: bool) -> Iterator[tuple[np.ndarray, int]]:
        """Results of the rows whose turn it is, with the new last index; `jump` goes over the gaps before those that wait."""
        ahead = iter(waiting.blocks()) if jump else None
        while True:
            block = next(ahead, None) if jump else (last + 1) // _BLOCK
            if block is None:
                return
            columns = waiting.take_columns(block)
            steps = np.diff(np.maximum(columns[0], last), prepend=last)
            gaps = np.flatnonzero(steps > 1)
            if len(gaps) and not jump:
                waiting.add_columns(columns[:, gaps[0] :])
                columns, steps = columns[:, : gaps[0]], steps[: gaps[0]]
            if columns.shape[1]:
                last = max(last, int(columns[0, -1]))
                yield self._play(columns, steps == 0, np.maximum(steps - 1, 0)), last
            if not jump and (len(gaps) or (last + 1) // _BLOCK == block):
                return

    def _run(self, key: tuple, chunks: Iterable[pd.DataFrame], now: int, alarm: int | None) -> Iterator[pd.DataFrame]:
        last, gap_alarm, day_alarm, seen_at, held = self._place.get() if self._place.exists() else (self._first - 1, 0, 0, now, 0)
        if alarm is not None and alarm == day_alarm and seen_at + self._expire > now:
            day_alarm = seen_at + self._expire  # rows have come since
            self._handle.registerTimer(day_alarm)
        expired = alarm is not None and alarm == day_alarm and seen_at + self._expire <= now
        self._orders = self._sizes = self._tops = None
        waiting, start = _Waiting(self._block_state, self._piece_state, held), last
        jump = expired or (alarm is not None and alarm == gap_alarm)
        if jump and alarm == gap_alarm:
            gap_alarm = 0

        out = _Out(key)
        for chunk in [None] if alarm is not None else chunks:
            next_in_turn = jump
            for block, low, n, packed in chunk[["block", "low", "n", "events"]].itertuples(index=False, name=None) if chunk is not None else ():
                if low <= last:
                    columns = _unpack(_PACKED, n, packed)
                    passed = columns[0] <= last
                    yield from out.add(self._late(columns[:, passed]))
                    columns = columns[:, ~passed]
                    if not columns.shape[1]:
                        continue
                    low, (n, packed) = columns[0, 0], _pack(columns)
                waiting.add_piece(block, n, packed)
                next_in_turn |= low == last + 1
            # Nothing that waits from before is next in turn, so a row of this chunk has to be.
            if next_in_turn:
                for played, last in self._turns(waiting, last, jump):
                    yield from out.add(played)
        yield from out.rest()
        if expired:
            for state in (self._place, self._order_state, self._level_state, self._block_state, self._piece_state):
                state.clear()
            if gap_alarm:
                self._handle.deleteTimer(gap_alarm)
            return
        if self._orders is not None:
            self._orders.flush()
            self._sizes.flush()
        waiting.flush()
        if gap_alarm and (not waiting.count or last > start):
            self._handle.deleteTimer(gap_alarm)
            gap_alarm = 0
        if waiting.count and not gap_alarm and self._patience is not None:
            gap_alarm = now + self._patience
            self._handle.registerTimer(gap_alarm)
        if not day_alarm:
            day_alarm = now + self._expire
            self._handle.registerTimer(day_alarm)
        self._place.update((last, gap_alarm, day_alarm, now if alarm is None else seen_at, waiting.count))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._run(key, rows, timerValues.getCurrentProcessingTimeInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._run(key, (), timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())


class _Out:
    """Packed results of one symbol and day, a few thousand rows in each."""

    def __init__(self, key: tuple):
        self._key, self._parts, self._n = key, [], 0

    def add(self, results: np.ndarray) -> Iterator[pd.DataFrame]:
        if results.shape[1]:
            self._parts.append(_pack(results))
            self._n += results.shape[1]
        if self._n >= _OUT:
            yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self._parts:
            yield pd.DataFrame([(*self._key, *part) for part in self._parts], columns=[*KEYS, "n", "booked"])
        self._parts, self._n = [], 0


def _pack_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events as one row per symbol, day and block of the index; (symbol, trade_date, at, the columns of an event) go in."""

    def packed(rows: pa.Table) -> pa.RecordBatch:
        places = {kind: number for number, kind in enumerate(KINDS)}
        kinds = rows["kind"].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.array([_NULL if kind is None else places[kind] for kind in kinds.dictionary.to_pylist()], np.int64)
        columns = np.empty((_PACKED, rows.num_rows), np.int64)
        for place, name in enumerate(("at", *_EVENT)):
            columns[place] = codes[kinds.indices.to_numpy()] if name == "kind" else rows[name].combine_chunks().to_numpy()
        keys = [rows[key].combine_chunks().dictionary_encode(null_encoding="encode") for key in KEYS]
        owners = [key.indices.to_numpy() for key in keys]
        order = np.lexsort((columns[0], *owners))
        columns, owners = columns[:, order], [owner[order] for owner in owners]
        out = []
        cuts = np.flatnonzero(np.any([np.diff(owner) != 0 for owner in owners], axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows], strict=True):
            key = [key.dictionary[int(owner[begin])].as_py() for key, owner in zip(keys, owners, strict=True)]
            out += [(*key, block, int(part[0, 0]), *_pack(part)) for block, part in _by_block(columns[:, begin:end])]
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _HELD:
            yield packed(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield packed(pa.Table.from_batches(held))


_PIECE = pa.schema(
    [("symbol", pa.string()), ("trade_date", pa.date32()), ("block", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("events", pa.binary())]
)


def _rows_of(columns: list[str]):
    """Packed results as rows with these columns."""
    names = {"kind": pa.array(KINDS), "status": pa.array(STATUSES), "reason": pa.array(REASONS)}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for symbol, day, n, packed in zip(*(batch[name] for name in (*KEYS, "n", "booked")), strict=True):
                n = n.as_py()
                cells = [pa.repeat(symbol, n), pa.repeat(day, n)]
                for name, values in zip(columns[len(KEYS) :], _unpack(len(columns) - len(KEYS), n, packed.as_py()), strict=True):
                    column = pa.array(values, mask=values == _NULL)
                    cells.append(names[name].take(column) if name in names else column.cast(pa.int8()) if name == "side" else column)
                yield pa.RecordBatch.from_arrays(cells, names=columns)

    return unpack


def ladder_columns(levels: int) -> str:
    return "".join(f", {side}_price_l{i} bigint, {side}_size_l{i} bigint" for i in range(1, levels + 1) for side in ("bid", "ask"))


def book_events(messages: DataFrame) -> DataFrame:
    """A stream of messages as order events; kinds that touch no resting order stay in with a NULL kind."""
    return messages.select(
        *KEYS, SEQ, *(c for c in ("at",) if c in messages.columns), order_kind().alias("kind"), "order_id", F.lit(None).cast("bigint").alias("old_id"),
        "side", "price", F.col("size").cast("bigint").alias("qty"),
    )


def stream_book(
    events: DataFrame, *, levels: int = 1, at: str = SEQ, first: int = 0, patience_ms: int | None = PATIENCE_MS, expire_ms: int = DAY_MS
) -> DataFrame:
    """One row per event of the stream: its columns, `status`, `reason`, `effective_qty`, `remaining`, `depth`, `gap`, and the
    best `levels` prices and sizes of both sides after it (none with 0).

    `at` is the dense index of a symbol and day, starting at `first`. Status: accepted, rejected (with a reason), ignored (a kind
    that touches no resting order), late (its index has passed already, or came twice; it changes nothing). `gap` counts the indices
    that were given up just before the row, none without `patience_ms`. `depth` is the size at the level that the row changed, or at its side and price.
    A kind that is neither NULL nor one of `KINDS` fails the stream. Start the query inside `state_on_disk`.
    """
    order = ["symbol string", "trade_date date", f"{SEQ} bigint", "kind string", "order_id bigint", "old_id bigint", "side tinyint", "price bigint", "qty bigint"]
    results = "status string, reason string, effective_qty bigint, remaining bigint, depth bigint, gap bigint"
    output = ", ".join(order) + f", {results}{ladder_columns(levels)}"
    numbers = [F.coalesce(F.col(c).cast("bigint"), F.lit(_NULL)).alias(c) for c in ("order_id", "old_id", "side", "price", "qty")]
    rows = events.select(*KEYS, F.col(at).cast("bigint").alias("at"), F.col(SEQ).cast("bigint").alias(SEQ), "kind", *numbers)
    pieces = rows.mapInArrow(_pack_events, "symbol string, trade_date date, block bigint, low bigint, n bigint, events binary")
    processor = _BookProcessor(first, levels, patience_ms, expire_ms)
    booked = pieces.groupBy(*KEYS).transformWithStateInPandas(
        processor, "symbol string, trade_date date, n bigint, booked binary", "append", "processingTime"
    )
    return booked.mapInArrow(_rows_of([part.strip().split(" ")[0] for part in output.split(",")]), output)


def accepted_event_log(booked: DataFrame) -> DataFrame:
    """The source events that took effect, one row each, replaces too."""
    return booked.where("status = 'accepted'").select(*KEYS, *_EVENT)


def dead_letters(booked: DataFrame) -> DataFrame:
    """Rows that changed nothing because they came too late."""
    return booked.where("status = 'late'")


def depth_rows(booked: DataFrame) -> DataFrame:
    return booked.where("status <> 'late'").select(*KEYS, SEQ, "side", "price", "depth")


def ladder_rows(booked: DataFrame) -> DataFrame:
    wide = [c for c in booked.columns if "_price_l" in c or "_size_l" in c]
    return booked.where("status <> 'late'").select(*KEYS, SEQ, *wide)
