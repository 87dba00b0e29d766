"""Data checks and equality of results."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.schema import FEATURE_NAMES


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: NULLs, smallest and largest value, from a single pass."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.min(F.col(c).cast("double")).alias("smallest"),
            F.max(F.col(c).cast("double")).alias("largest"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("_stats")).select(F.inline("_stats"))


def message_checks(messages: DataFrame) -> DataFrame:
    """Counts of rows that break the message contract."""
    return messages.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col("side").isin(-1, 1)).alias("bad_side"),
        F.count_if(~F.col("event_type").between(1, 7)).alias("bad_type"),
        F.count_if(F.col("size") <= 0).alias("bad_size"),
        F.count_if(F.col("price") <= 1000).alias("bad_price"),
    )


def non_finite_features(matrix: DataFrame, features: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Rows with a NULL, NaN or infinite feature; empty for a valid matrix."""
    bad = F.lit(False)
    for name in features:
        value = F.col(name)
        bad = bad | value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return matrix.where(bad)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that occur in only one of the tables."""
    columns = sorted(left.columns)
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def ordered_hash(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Fingerprint of rows and their positions: equal for two tables with equal rows at equal order keys."""
    columns = [*order, *sorted(c for c in df.columns if c not in order)]
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.pmod(F.xxhash64(*columns), F.lit(1_000_000_007))).alias("fingerprint"),
    )


def assert_deterministic(operator: Callable[[DataFrame], DataFrame], df: DataFrame, partitions: Sequence[int] = (1, 7)) -> None:
    """The operator gives the same rows for different shuffle partition counts and input layouts."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    prints = []
    try:
        for n in partitions:
            conf.set("spark.sql.shuffle.partitions", str(n))
            out = operator(df.repartition(n))
            prints.append(tuple(ordered_hash(out, out.columns).first()))
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
    if len(set(prints)) != 1:
        raise AssertionError(f"results differ between partition counts: {prints}")
