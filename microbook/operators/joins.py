"""Joins on the event axis."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microbook.partitioning import CHUNK
from microbook.schema import KEYS, SEQ

# A chunk with more left rows than this is split; its right rows go to every part.
_LEFT_ROWS_PER_TASK = 1_000_000


def positional_join(messages: DataFrame, depth: DataFrame, *, by: Sequence[str] = KEYS, seq: str = SEQ) -> DataFrame:
    """Row n of the messages belongs to row n of the depth table. See `require_equal_heights`: an inner join shows no missing rows."""
    return messages.join(depth.drop("ts_ns"), [*by, seq])


def height_mismatch(left: DataFrame, right: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Partitions whose two tables differ in row count; empty when a positional join is safe."""
    counted = left.groupBy(*by).agg(F.count("*").alias("left_rows")).join(
        right.groupBy(*by).agg(F.count("*").alias("right_rows")), list(by), "full"
    )
    return counted.fillna(0, ["left_rows", "right_rows"]).where("left_rows <> right_rows")


def require_equal_heights(left: DataFrame, right: DataFrame, by: Sequence[str] = KEYS) -> None:
    """Fail if the tables differ in rows for some partition; runs one count of each."""
    bad = height_mismatch(left, right, by).head(5)
    if bad:
        raise ValueError(f"tables of different heights, first ones: {[r.asDict() for r in bad]}")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    values: Sequence[str],
    on: str = SEQ,
    by: Sequence[str] = KEYS,
    right_order: str | None = None,
    width: int = CHUNK,
    unique_left: bool | None = None,
    rows_per_task: int = _LEFT_ROWS_PER_TASK,
) -> DataFrame:
    """Each left row gets `values` of the newest right row whose `on` is not larger; NULL where there is none.

    Both tables are stacked and read by one window per (`by`, `on div width`), so no row pairs are built. A chunk
    receives the newest right row of all earlier chunks as one extra row. When `on` is a time it may tie: the right
    side is first reduced to one row per moment (the last by `right_order`), and a chunk with very many left rows
    is spread over several tasks. `unique_left=True` (default for `seq`) says that left rows do not tie.
    """
    unique_left = on == SEQ if unique_left is None else unique_left
    keys = [*by, "_chunk"]
    chunk = F.expr(f"`{on}` div {width}")
    payload = F.struct(*[F.col(v) for v in values])
    if right_order:
        events = right.groupBy(*by, on).agg(F.max_by(payload, right_order).alias("_value"))
    else:
        events = right.select(*by, on, payload.alias("_value"))
    events = events.withColumn("_chunk", chunk)
    rows = left.withColumn("_chunk", chunk)

    chunks = (
        rows.groupBy(*keys).agg(F.count("*").alias("_rows"), F.lit(None).cast(events.schema["_value"].dataType).alias("_newest"))
        .unionByName(events.groupBy(*keys).agg(F.lit(0).cast("bigint").alias("_rows"), F.max_by("_value", on).alias("_newest")))
        .groupBy(*keys)
        .agg(F.sum("_rows").alias("_rows"), F.first("_newest", ignorenulls=True).alias("_newest"))
    )
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *keys,
        F.last("_newest", ignorenulls=True).over(earlier).alias("_value"),
        F.ceil(F.col("_rows") / F.lit(rows_per_task)).cast("int").alias("_parts"),
    ).where("_parts > 0")

    # Within a chunk: carried row (on is NULL) first, then right before left at the same position.
    if unique_left:
        keys_split = keys
        carried = chunks.drop("_parts")
    else:
        keys_split = [*keys, "_part"]
        all_parts = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
        carried = chunks.withColumn("_part", all_parts).drop("_parts")
        sizes = chunks.select(*keys, "_parts")
        events = events.join(sizes, keys).withColumn("_part", all_parts).drop("_parts")
        # A hash of the row, not a row counter: a recomputed task must place its rows as before.
        spread = F.pmod(F.xxhash64(*left.columns), F.col("_parts").cast("bigint")).cast("int")
        rows = rows.join(sizes, keys).withColumn("_part", spread).drop("_parts")
    stacked = (
        rows.withColumn("_side", F.lit(1))
        .unionByName(events.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        .unionByName(carried.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    )
    window = Window.partitionBy(*keys_split).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stacked.withColumn("_found", F.last("_value", ignorenulls=True).over(window)).where("_side = 1")
    return found.select(*left.columns, *[F.col(f"_found.{v}").alias(v) for v in values])


def at_offset(
    left: DataFrame,
    right: DataFrame,
    *,
    offset: int,
    values: Sequence[str],
    by: Sequence[str] = KEYS,
    seq: str = SEQ,
) -> DataFrame:
    """Values of the right row `offset` events later, clipped to the last row of the partition."""
    ends = right.groupBy(*by).agg(F.max(seq).alias("_end"))
    position = F.when(F.col(seq).isNotNull(), F.least(F.col(seq) + offset, F.col("_end")))
    target = left.join(ends, list(by)).withColumn("_at", position).drop("_end")
    return target.join(right.select(*by, F.col(seq).alias("_at"), *values), [*by, "_at"], "left").drop("_at")
