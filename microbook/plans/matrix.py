"""The versioned feature matrix: one row per book row, 19 float columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microbook.functions.scalars import imbalance, spread_ticks, symbol_one_hot, warm_flags
from microbook.operators.joins import asof_backward
from microbook.operators.microprice import MicropriceTable, lookup_microprice
from microbook.operators.trades import add_trade_features, signed_trade_flow, trade_flow_imbalance
from microbook.operators.windows import (
    WindowFeature,
    chunk_rows,
    make_labels,
    multi_level_ofi,
    ofi_events,
    prepared,
    queue_depletion_ewma,
    realized_vol,
    run_stages,
    spread_zscore,
)
from microbook.partitioning import halo_chunks
from microbook.schema import EWMA_ALPHA, FEATURE_NAMES, KEYS, SEQ, SYMBOLS, TICK_SIZE, TOB_COLUMNS

FLOWS = ("signed_trade_flow_50", "tfi_50")
FLOW_TRADES = 50
# Smaller than the general chunk: rows are wide here, and many even chunks balance better than few. The halo adds a tenth.
MATRIX_CHUNK = 8_192
_OUTER_LEVELS = (2, 3, 4, 5)


def window_features() -> list[WindowFeature]:
    return [
        spread_zscore(200),
        ofi_events(50),
        ofi_events(200),
        multi_level_ofi(_OUTER_LEVELS, 50),
        realized_vol(200),
        *queue_depletion_ewma(EWMA_ALPHA),
    ]


def trade_flows(trades: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Flow features at each trade, keyed by its message index."""
    computed = add_trade_features(
        trades.select(*by, SEQ, "ts_ns", "aggressor_side", "size"), signed_trade_flow(50), trade_flow_imbalance(50), by=by
    )
    return computed.select(*by, SEQ, "ts_ns", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FLOWS])


def _trade_rows(trades: DataFrame, chunks: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Trades by chunk; each chunk of `chunks` also gets the last 50 trades before it, however far back they lie.

    The tail of a chunk is the last 50 trades up to its end. Each listed chunk has at least one trade, so the 50 newest
    listed chunks suffice. Lists hold at most one chunk of trades, tails at most 50.
    """
    keys = [*by, "_chunk"]
    rows = trades.select(*by, SEQ, "aggressor_side", "size", F.expr(f"{SEQ} div {size}").alias("_chunk"))
    trade = F.struct(SEQ, "aggressor_side", "size")
    lists = rows.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(trade), asc=False), 1, FLOW_TRADES).alias("_list"))
    recent = Window.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(0, FLOW_TRADES - 1)
    tails = lists.select(*keys, F.slice(F.flatten(F.collect_list("_list").over(recent)), 1, FLOW_TRADES).alias("_tail"))
    present = chunks.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    merged = (
        tails.unionByName(present, allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.first("_tail", ignorenulls=True).alias("_tail"), F.max("_wanted").alias("_wanted"))
    )
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = merged.withColumn("_before", F.last("_tail", ignorenulls=True).over(earlier)).where("_wanted")
    return rows.unionByName(carried.select(*keys, F.inline("_before")))


def known_symbol(value: Column, vocabulary: Sequence[str] = SYMBOLS) -> Column:
    """`value` for a known symbol; an unknown one stops the query, because its one-hot columns would all be zero."""
    message = F.concat(F.lit("unknown symbol "), F.coalesce(F.col("symbol"), F.lit("NULL")))
    return F.when(F.col("symbol").isin(*vocabulary), value).otherwise(F.raise_error(message).cast("double"))


def feature_columns(kind: str) -> list[Column]:
    """The contract's columns in order, NULL filled with 0."""
    filled = {name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in FEATURE_NAMES}
    first = FEATURE_NAMES[0]
    return [(known_symbol(v) if name == first else v).cast(kind).alias(name) for name, v in filled.items()]


def build_feature_matrix(
    joined: DataFrame,
    trades: DataFrame,
    table: MicropriceTable,
    *,
    horizons: Sequence[int] = (),
    ties: str = "seq",
    by: Sequence[str] = KEYS,
    size: int = MATRIX_CHUNK,
    as_float: bool = True,
) -> DataFrame:
    """Keys, `ts_ns`, the features in contract order and a NULL-able `label_<k>` for each of `horizons`.

    Book rows and trades are shuffled once, together, by (symbol, day, chunk). Windows read the rows of their own kind; the
    flow at or before each book row is then the last one in the same chunk, where the 50 trades before the chunk are repeated.
    `ties="seq"` sees only trades up to the row itself, `ties="peers"` all trades with the same timestamp.
    """
    if ties not in ("seq", "peers"):
        raise ValueError("ties must be 'seq' or 'peers'")
    features = window_features() + [make_labels(k, out=f"label_{k}", keep_tail=True) for k in horizons]
    reduced = [value.alias(name) for name, value in prepared(features).items()]
    rows = joined.select(*by, SEQ, "ts_ns", *TOB_COLUMNS, *reduced)
    rows_per_chunk = chunk_rows(features, size)
    own_chunk = F.expr(f"{SEQ} div {rows_per_chunk}").alias("_chunk")
    stacked = halo_chunks(
        rows, back=max(f.back for f in features), ahead=max(f.ahead for f in features), size=rows_per_chunk
    ).withColumn("_kind", F.lit(1))
    if ties == "seq":
        features += [signed_trade_flow(FLOW_TRADES), trade_flow_imbalance(FLOW_TRADES)]
        extra = _trade_rows(trades, rows.select(*by, own_chunk), rows_per_chunk, by)
        stacked = stacked.unionByName(extra.withColumns({"_kind": F.lit(0), "_own": F.lit(True)}), allowMissingColumns=True)
    placed = stacked.repartition(*by, "_chunk")
    computed = run_stages(placed, features, Window.partitionBy(*by, "_chunk", "_kind").orderBy(SEQ)).where("_own")
    if ties == "seq":
        so_far = (
            Window.partitionBy(*by, "_chunk").orderBy(SEQ, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        flows = {f: F.last(F.when(F.col("_kind") == 0, F.coalesce(F.col(f).cast("double"), F.lit(0.0))), True).over(so_far) for f in FLOWS}
        computed = computed.withColumns(flows).where("_kind = 1")
    else:
        computed = asof_backward(
            computed.drop(*[c for c in computed.columns if c.startswith("_")]),
            trade_flows(trades, by=by),
            on="ts_ns",
            right_order=SEQ,
            values=FLOWS,
            by=by,
            width=1_000_000_000,
        )

    derived = {
        "imbalance_l1": imbalance(),
        "spread_ticks": spread_ticks(TICK_SIZE),
        **symbol_one_hot(SYMBOLS),
        **warm_flags((50, 200), SEQ),
    }
    looked_up = lookup_microprice(computed.withColumns(derived), table)
    columns = feature_columns("float" if as_float else "double")
    return looked_up.select(*by, SEQ, "ts_ns", *columns, *[f"label_{k}" for k in horizons])


def assemble_dataset(matrix: DataFrame, k: int) -> DataFrame:
    """Rows of a matrix built with horizon `k` that have a label, as `label`."""
    kept = [c for c in matrix.columns if not c.startswith("label_")]
    return matrix.where(F.col(f"label_{k}").isNotNull()).select(*kept, F.col(f"label_{k}").alias("label"))
