"""How ordered work is spread out: a symbol-day is cut into chunks so that no busy symbol becomes one task.

Three tools cover every ordered operator of the library:

* `halo_chunks`     each chunk also receives the neighbouring rows which a bounded frame reads;
* `running_sum` and `forward_fill`   a frame that reaches back to the first row gets one extra row per
  chunk, which carries the total (or the last value) of all earlier chunks;
* `order_chunks`    chunks of even size for an order that has no dense index yet.

Each shuffles the wide rows once. The per-chunk side tables have one row per chunk, i.e. thousands of times fewer rows.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from microbook.schema import KEYS, SEQ
from microbook.session import materialise

CHUNK = 65_536
SECOND_NS = 1_000_000_000


def halo_chunks(df: DataFrame, *, back: int = 0, ahead: int = 0, size: int = CHUNK, seq: str = SEQ) -> DataFrame:
    """Add `_chunk` and `_own`; a row is repeated in each chunk whose own rows lie within `back` after or `ahead` before it."""
    home = F.expr(f"`{seq}` div {size}")
    if not back and not ahead:
        return df.withColumns({"_chunk": home, "_own": F.lit(True)})
    first = F.expr(f"greatest(`{seq}` - {ahead}, 0) div {size}")
    last = F.expr(f"(`{seq}` + {back}) div {size}")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_chunk") == home)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the repeated rows and the helper columns (all start with an underscore)."""
    return drop_helpers(df.where("_own"))


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def chunk_window(by: Sequence[str] = KEYS, seq: str = SEQ) -> WindowSpec:
    return Window.partitionBy(*by, "_chunk").orderBy(seq)


def _up_to_here(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame,
    sums: Mapping[str, Column],
    *,
    by: Sequence[str] = KEYS,
    order: Sequence[str] = (SEQ,),
    chunk: str | None = None,
    size: int = CHUNK,
) -> DataFrame:
    """Inclusive running totals per `by`, exact for any chunk size.

    `order` must be a total order without NULLs; its first column is cut into chunks unless `chunk` names a column
    that already grows with the order.
    """
    inputs = {f"_in_{name}": value for name, value in sums.items()}
    rows = df.withColumns({"_chunk": F.col(chunk) if chunk else F.expr(f"`{order[0]}` div {size}"), **inputs})
    totals = rows.groupBy(*by, "_chunk").agg(*[F.sum(name).alias(name) for name in inputs])
    earlier = _before(Window.partitionBy(*by).orderBy("_chunk"))
    carried = totals.select(
        *by,
        "_chunk",
        *[F.sum(name).over(earlier).alias(name) for name in inputs],
        F.row_number().over(Window.partitionBy(*by).orderBy("_chunk")).alias("_nth"),
        F.lit(True).alias("_carry"),
    ).where("_nth > 1")
    window = _up_to_here(Window.partitionBy(*by, "_chunk").orderBy(*order))
    joined = rows.withColumn("_carry", F.lit(False)).unionByName(carried.drop("_nth"), allowMissingColumns=True)
    out = joined.withColumns({name: F.sum(f"_in_{name}").over(window) for name in sums}).where("NOT _carry")
    return out.drop("_carry", "_chunk", *inputs)


def forward_fill(
    df: DataFrame,
    values: Mapping[str, Column],
    *,
    by: Sequence[str] = KEYS,
    seq: str = SEQ,
    size: int = CHUNK,
) -> DataFrame:
    """Newest non-NULL value at or before each row, per `by`; `seq` is unique inside `by`."""
    inputs = {f"_in_{name}": value for name, value in values.items()}
    rows = df.withColumns({"_chunk": F.expr(f"`{seq}` div {size}"), **inputs})
    newest = rows.groupBy(*by, "_chunk").agg(
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col(seq))).alias(name) for name in inputs]
    )
    earlier = _before(Window.partitionBy(*by).orderBy("_chunk"))
    carried = newest.select(
        *by, "_chunk", *[F.last(name, ignorenulls=True).over(earlier).alias(name) for name in inputs], F.lit(True).alias("_carry")
    )
    window = _up_to_here(chunk_window(by, seq))
    joined = rows.withColumn("_carry", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    out = joined.withColumns({name: F.last(f"_in_{name}", ignorenulls=True).over(window) for name in values})
    return out.where("NOT _carry").drop("_carry", "_chunk", *inputs)


def dense_index(df: DataFrame, name: str, *, by: Sequence[str] = KEYS, seq: str = SEQ, size: int = CHUNK) -> DataFrame:
    """0-based row number inside `by`, ordered by the unique column `seq`."""
    counted = running_sum(df, {name: F.lit(1).cast("bigint")}, by=by, order=(seq,), size=size)
    return counted.withColumn(name, F.col(name) - 1)


def order_chunks(df: DataFrame, order: Sequence[str], *, label: str = "ordered") -> DataFrame:
    """Cut `df` into even ranges of `order` and store it with the range number `chunk_no`.

    Range bounds come from a sample, so they are only valid for the run that drew them: the result is written once
    and read back, never computed twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("chunk_no", F.spark_partition_id())
    return materialise(ranged, label)


def global_index(df: DataFrame, name: str, order: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in the order (`by`, `order`), for orders without a dense index."""
    staged = order_chunks(df, (*by, *order))
    keys = tuple(by) or ("_all",)
    staged = staged if by else staged.withColumn("_all", F.lit(0))
    counted = running_sum(staged, {name: F.lit(1).cast("bigint")}, by=keys, order=order, chunk="chunk_no")
    return counted.withColumn(name, F.col(name) - 1).drop("chunk_no", "_all")
