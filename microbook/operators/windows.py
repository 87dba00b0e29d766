"""Event-window features. Each is a `WindowFeature`: a list of column stages over one chunk window.

Features are combined before they run (`add_features`), so that any number of them costs one shuffle and one sort.
A rolling sum over the last N rows is never a sliding frame: sums of differences telescope to `x - lag(x, N)`,
others are a running sum minus its own lag.
"""

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from microbook.functions.scalars import mid_x2
from microbook.operators.joins import asof_backward
from microbook.partitioning import CHUNK, chunk_window, forward_fill, halo_chunks, own_rows
from microbook.schema import DEADBAND_TICKS, DOWN, EWMA_ALPHA, KEYS, SEQ, STABLE, TICK_SIZE, UP

Stage = Callable[[WindowSpec], dict[str, Column]]

# exp(-42) is below the rounding of a double: rows further back no longer change an exponential average.
_EWMA_DEPTH = 42.0
# Weights inside a chunk span exp(-600)..exp(600), safely inside the range of a double.
_EWMA_RANGE = 1200.0


@dataclass(frozen=True)
class WindowFeature:
    """`stages` are applied in order; a name starting with an underscore is a temporary column.

    `prepare` are row-wise columns computed before the shuffle, so that several inputs travel as one.
    """

    stages: Sequence[Stage]
    back: int = 0
    ahead: int = 0
    max_rows: int = CHUNK
    drop_null: Sequence[str] = field(default_factory=tuple)
    prepare: dict[str, Column] = field(default_factory=dict)


def _row(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def _running(value: Column, w: WindowSpec) -> Column:
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def _full(value: Column, window: int, partial: bool) -> Column:
    return value if partial else F.when(F.col("_row") >= window, value)


def _change_over(name: str | Column, window: int, w: WindowSpec) -> Column:
    """Sum of the last `window` first differences, where the first row has difference 0."""
    value = F.col(name) if isinstance(name, str) else name
    return value - F.coalesce(F.lag(value, window).over(w), F.first(value).over(w))


def chunk_rows(features: Sequence[WindowFeature], size: int = CHUNK) -> int:
    back = max(f.back for f in features)
    limit = min(f.max_rows for f in features)
    return max(1, min(size, limit - back if limit < CHUNK else size))


def prepared(features: Sequence[WindowFeature]) -> dict[str, Column]:
    return {name: value for f in features for name, value in f.prepare.items()}


def run_stages(df: DataFrame, features: Sequence[WindowFeature], w: WindowSpec) -> DataFrame:
    depth = max(len(f.stages) for f in features)
    for level in range(depth):
        columns: dict[str, Column] = {"_row": _row(w)} if level == 0 else {}
        for feature in features:
            if level < len(feature.stages):
                columns.update(feature.stages[level](w))
        df = df.withColumns(columns)
    return df


def add_features(
    df: DataFrame, *features: WindowFeature, by: Sequence[str] = KEYS, seq: str = SEQ, size: int = CHUNK
) -> DataFrame:
    """Add the columns of all `features` in one pass; `seq` is the dense index inside `by`."""
    chunked = halo_chunks(
        df.withColumns(prepared(features)),
        back=max(f.back for f in features),
        ahead=max(f.ahead for f in features),
        size=chunk_rows(features, size),
        seq=seq,
    )
    out = own_rows(run_stages(chunked, features, chunk_window(by, seq)))
    needed = [name for f in features for name in f.drop_null]
    return out.dropna(subset=needed) if needed else out


# --- differences and sums -------------------------------------------------------------------------------------


def first_difference(column: str, out: str) -> WindowFeature:
    def stage(w):
        return {out: F.coalesce(F.col(column) - F.lag(column).over(w), F.lit(0))}

    return WindowFeature([stage], back=1)


def _gated(out: str, value: Callable[[WindowSpec], Column], window: int, partial: bool) -> WindowFeature:
    def gather(w):
        return {f"_{out}": value(w)}

    def gate(w):
        return {out: _full(F.col(f"_{out}"), window, partial)}

    return WindowFeature([gather, gate], back=window)


def ofi_events(window: int, *, partial: bool = False, out: str | None = None) -> WindowFeature:
    """Order-flow imbalance: net change of bid size minus ask size at the top over the last `window` events."""
    return _gated(
        out or f"ofi_{window}",
        lambda w: _change_over("bid_size_l1", window, w) - _change_over("ask_size_l1", window, w),
        window,
        partial,
    )


def multi_level_ofi(levels: Sequence[int], window: int, *, partial: bool = False) -> WindowFeature:
    if not levels:
        raise ValueError("levels must not be empty")
    net = sum((F.col(f"bid_size_l{i}") - F.col(f"ask_size_l{i}") for i in levels), F.lit(0))
    out = f"mlofi_l{min(levels)}_l{max(levels)}_w{window}"

    gated = _gated(out, lambda w: _change_over(f"_net_{out}", window, w), window, partial)
    return WindowFeature(gated.stages, back=window, prepare={f"_net_{out}": net})


def _rolling(total: str, window: int, w: WindowSpec) -> Column:
    return F.col(total) - F.coalesce(F.lag(total, window).over(w), F.lit(0))


def rolling_sum(value: Column, window: int, out: str, *, partial: bool = False) -> WindowFeature:
    def total(w):
        return {f"_sum_{out}": _running(value, w)}

    def difference(w):
        return {out: _full(_rolling(f"_sum_{out}", window, w), window, partial)}

    return WindowFeature([total, difference], back=window)


def spread_zscore(window: int = 200, *, unit: int = 1) -> WindowFeature:
    """(spread - mean) / sample deviation over the last `window` events, 0 for a constant spread, NULL until full.

    Sums are exact integers. `unit` divides the spread first; set it to the tick for feeds with very fine price units,
    so that the sum of squares of one chunk stays within 64 bits.
    """
    spread = F.expr(f"(ask_price_l1 - bid_price_l1) div {unit}")
    name = f"spread_zscore_{window}"

    def totals(w):
        return {"_sp": spread, "_sp1": _running(spread, w), "_sp2": _running(spread * spread, w)}

    def rolled(w):
        return {"_z1": _rolling("_sp1", window, w), "_z2": _rolling("_sp2", window, w)}

    def score(w):
        scatter = F.col("_z2") * window - F.col("_z1") * F.col("_z1")
        deviation = F.sqrt(scatter.cast("double") / F.lit(float(window * (window - 1))))
        value = (F.col("_sp") - F.col("_z1") / F.lit(float(window))) / deviation
        return {name: F.when(F.col("_row") >= window, F.when(scatter > 0, value).otherwise(0.0))}

    return WindowFeature([totals, rolled, score], back=window)


def realized_vol(window: int = 200, *, partial: bool = False) -> WindowFeature:
    """Root of the summed squared mid changes over the last `window` events."""
    out = f"realized_vol_{window}"

    def change(w):
        doubled = mid_x2()
        return {"_dm": F.coalesce(doubled - F.lag(doubled).over(w), F.lit(0))}

    def total(w):
        return {"_rv": _running(F.col("_dm") * F.col("_dm"), w)}

    def root(w):
        return {out: _full(F.sqrt(_rolling("_rv", window, w) / F.lit(4.0)), window, partial)}

    return WindowFeature([change, total, root], back=window + 1)


def ewma(column: str, alpha: float, out: str, *, after: Sequence[Stage] = ()) -> WindowFeature:
    """Recursive average y = alpha*x + (1-alpha)*y_before, starting at the first x.

    Inside a chunk: y_j = (1-alpha)^j * sum of alpha*x_i*(1-alpha)^-i, a plain running sum. The halo is long
    enough that anything before it has a weight below the rounding of a double, and the chunk short enough that the
    weights neither overflow nor underflow.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return WindowFeature([*after, lambda w: {out: F.col(column).cast("double")}])
    decay = -math.log1p(-alpha)
    back = math.ceil(_EWMA_DEPTH / decay)
    rows = math.floor(_EWMA_RANGE / decay)

    def weigh(w):
        power = (F.col("_row") - F.lit(1) - F.lit(rows // 2)).cast("double") * F.lit(decay)
        share = F.when(F.col("_row") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
        return {f"_w_{out}": F.exp(power), f"_a_{out}": share * F.col(column) * F.exp(power)}

    def total(w):
        return {f"_t_{out}": _running(F.col(f"_a_{out}"), w)}

    def scale(w):
        return {out: F.col(f"_t_{out}") / F.col(f"_w_{out}")}

    stages = [*after, weigh, total, scale]
    return WindowFeature(stages if after else [lambda w: {}, *stages], back=back + 1, max_rows=rows)


def exact_ewma(
    df: DataFrame, values: Mapping[str, Column], alpha: float, *, by: Sequence[str] = KEYS, seq: str = SEQ, size: int = CHUNK
) -> DataFrame:
    """Recursive averages of `values` (new column -> input) over the whole history, whatever its length and scale.

    A stretch of n rows takes the average y before it to (1-alpha)^n * y + b: the stretches are scanned on their own, their pairs
    (n, b) composed in order, one row per chunk, and each chunk continues from the exact average that it inherits. `seq` is unique inside
    `by` and need not be dense; the first row starts the average. Inputs must not be NULL.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return df.withColumns({out: value.cast("double") for out, value in values.items()})
    decay = -math.log1p(-alpha)
    rows = min(size, math.floor(_EWMA_RANGE / decay))
    inputs = {f"_x_{out}": value.cast("double") for out, value in values.items()}
    chunked = df.withColumns({"_chunk": F.expr(f"`{seq}` div {rows}"), **inputs})
    firsts = chunked.groupBy(*by).agg(F.min(seq).alias("_start"))
    chunked = chunked.join(firsts, list(by))
    inside = Window.partitionBy(*by, "_chunk").orderBy(seq)
    share = F.when(F.col(seq) == F.col("_start"), F.lit(1.0)).otherwise(F.lit(alpha))

    # A chunk has `rows` rows at most, so weights e^(decay * place) neither overflow nor underflow.
    placed = chunked.withColumn("_row", F.row_number().over(inside))
    weight = F.exp((F.col("_row") - rows // 2) * F.lit(decay))
    sums = {f"_s_{out}": F.sum(share * F.col(f"_x_{out}") * weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / weight for out in values}
    scanned = placed.withColumns(sums)
    ends = scanned.groupBy(*by, "_chunk").agg(
        F.max("_row").alias("_n"), *[F.max_by(f"_s_{out}", "_row").alias(f"_b_{out}") for out in values]
    )
    per_key = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_n", *[f"_b_{out}" for out in values]))).alias("_parts"))
    zero = F.struct(*[F.lit(0.0).alias(out) for out in values])
    start = F.struct(zero.alias("now"), F.array().cast(f"array<struct<_chunk: bigint, {', '.join(f'`_in_{out}`: double' for out in values)}>>").alias("done"))

    def step(state: Column, part: Column) -> Column:
        given = F.struct(part["_chunk"].alias("_chunk"), *[state["now"][out].alias(f"_in_{out}") for out in values])
        kept = F.exp(part["_n"] * F.lit(-decay))
        now = F.struct(*[(kept * state["now"][out] + part[f"_b_{out}"]).alias(out) for out in values])
        return F.struct(now.alias("now"), F.concat(state["done"], F.array(given)).alias("done"))

    inherited = per_key.select(*by, F.inline(F.aggregate("_parts", start, step)["done"]))
    kept = F.exp(F.col("_row") * F.lit(-decay))
    out = scanned.join(inherited, [*by, "_chunk"]).withColumns({out: F.col(f"_s_{out}") + kept * F.col(f"_in_{out}") for out in values})
    return out.drop("_chunk", "_row", "_start", *inputs, *sums, *[f"_in_{out}" for out in values])


def exact_queue_depletion(book: DataFrame, alpha: float = EWMA_ALPHA, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """`queue_depletion_bid` and `queue_depletion_ask` over the whole history."""
    changes = add_features(book, *[first_difference(f"{side}_size_l1", f"queue_growth_{side}") for side in ("bid", "ask")], by=by)
    grown = {f"queue_depletion_{side}": F.col(f"queue_growth_{side}") for side in ("bid", "ask")}
    return exact_ewma(changes, grown, alpha, by=by, size=size).drop("queue_growth_bid", "queue_growth_ask")


def queue_depletion_ewma(alpha: float = EWMA_ALPHA) -> list[WindowFeature]:
    """Smoothed growth of the best bid and ask queues."""

    def one(side: str) -> WindowFeature:
        size = f"{side}_size_l1"

        def change(w):
            return {f"_d_{side}": F.coalesce(F.col(size) - F.lag(size).over(w), F.lit(0))}

        return ewma(f"_d_{side}", alpha, f"queue_depletion_{side}", after=[change])

    return [one("bid"), one("ask")]


# --- looking ahead ----------------------------------------------------------------------------------------------


def make_labels(
    k: int, deadband: int = DEADBAND_TICKS, tick_size: int = TICK_SIZE, out: str = "label", *, keep_tail: bool = False
) -> WindowFeature:
    """Direction of the mid `k` events ahead: 0 down, 1 stable, 2 up. Rows without a future mid are dropped."""
    if k < 1:
        raise ValueError("k must be at least 1")

    moved = F.col(f"_moved_{out}")
    band = 2 * tick_size * deadband

    def move(w):
        return {f"_moved_{out}": F.lead(mid_x2(), k).over(w) - mid_x2()}

    def classify(w):
        label = F.when(moved <= -band, DOWN).when(moved >= band, UP).when(moved.isNotNull(), STABLE)
        return {out: label.cast("tinyint")}

    return WindowFeature([move, classify], ahead=k, drop_null=() if keep_tail else (out,))


def future_value(column: str, k: int, out: str) -> WindowFeature:
    return WindowFeature([lambda w: {out: F.lead(column, k).over(w)}], ahead=k, drop_null=(out,))


# --- frames without a row bound -----------------------------------------------------------------------------------


def carry_last_score(
    df: DataFrame, score: str = "score", out: str = "last_score", *, by: Sequence[str] = KEYS, size: int = CHUNK
) -> DataFrame:
    """Newest score so far, 0.0 before the first one."""
    filled = forward_fill(df, {out: F.col(score)}, by=by, size=size)
    return filled.withColumn(out, F.coalesce(F.col(out), F.lit(0.0)))


def ofi_duration(
    df: DataFrame, window_ns: int, *, by: Sequence[str] = KEYS, seq: str = SEQ, out: str = "ofi", width: int | None = None
) -> DataFrame:
    """Order-flow imbalance over the time span (t - window_ns, t]; rows with the same timestamp see each other.

    The sum telescopes to (net size at the last row of t) - (net size at the last row at or before t - window_ns), so it
    needs one row per timestamp and one as-of lookup on that smaller table.
    """
    net = F.col("bid_size_l1") - F.col("ask_size_l1")
    moments = df.groupBy(*by, "ts_ns").agg(F.max_by(net, seq).alias("_net"))
    starts = df.groupBy(*by).agg(F.min_by(net, seq).alias("_first"))
    probes = moments.withColumn("_edge", F.col("ts_ns") - window_ns)
    looked_up = asof_backward(
        probes,
        moments.select(*by, F.col("ts_ns").alias("_edge"), F.col("_net").alias("_past")),
        on="_edge",
        values=("_past",),
        by=by,
        width=width or max(window_ns, 1),
    )
    sums = looked_up.join(starts, list(by)).select(
        *by, "ts_ns", (F.col("_net") - F.coalesce("_past", "_first")).alias(out)
    )
    return df.join(sums, [*by, "ts_ns"])
