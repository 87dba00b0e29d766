"""Per-symbol heads, time splits and class-balanced samples; all depend on the data only, never on the partitioning."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microbook.schema import KEYS, SEQ
from microbook.session import materialise


def head_per_symbol(df: DataFrame, n: int, seq: str = SEQ) -> DataFrame:
    return df.where(F.col(seq) < n)


def time_split(df: DataFrame, frac: float = 0.7, *, by: Sequence[str] = KEYS, seq: str = SEQ) -> DataFrame:
    """Column `is_train`: the first int(rows * frac) rows of each partition. `seq` must be dense from 0."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    cut = F.floor(F.col("_rows") * F.lit(float(frac)))
    return df.join(counts, list(by)).withColumn("is_train", F.col(seq) < cut).drop("_rows")


#: Rows of a class that one task may rank.
MOST_RANKED = 10_000
_DIGITS = 3


def _hash_edges(hashed: DataFrame, per_class: int, label: str) -> tuple[DataFrame, int]:
    """(label, edge, need) and the number of hash digits of an edge: rows below the edge belong to the sample, and `need` of those at it.

    Each round counts the rows at the edge by three more digits, so what is left at an edge is a 4,096th of what it was. A class that is
    wanted whole has no edge.
    """
    edges, digits = None, 0
    while True:
        digits += _DIGITS
        if edges is None:
            rows = hashed.withColumn("need", F.lit(per_class).cast("bigint"))
        else:
            rows = hashed.join(edges, label).where(F.substring("_hash", 1, digits - _DIGITS) == F.col("edge"))
        counts = rows.groupBy(label, "need", F.substring("_hash", 1, digits).alias("_prefix")).agg(F.count("*").alias("_n"))
        running = Window.partitionBy(label).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = counts.withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        at_edge = before.where("_before < need AND _before + _n >= need")
        edges = materialise(at_edge.select(label, F.col("_prefix").alias("edge"), (F.col("need") - F.col("_before")).alias("need"), "_n"), "edges")
        most = edges.agg(F.max("_n")).first()[0]
        edges = edges.drop("_n")
        if most is None or most <= MOST_RANKED or digits + _DIGITS > 32:
            return edges, digits


def balanced_undersample(
    df: DataFrame, per_class: int, seed: int = 42, *, label: str = "label", key: Sequence[str] = ("symbol", SEQ)
) -> DataFrame:
    """min(per_class, class size) rows of each class, chosen by a seeded hash of the row key; rows without a label are left out.

    A class is never sorted: counts by ever longer hash prefixes find the hash at which the sample ends, and only the rows at that edge,
    `MOST_RANKED` at most unless their hashes are equal, are ranked.
    """
    hashed = df.where(F.col(label).isNotNull()).withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])))
    edges, digits = _hash_edges(hashed, per_class, label)
    placed = hashed.join(edges, label, "left").withColumn("_prefix", F.substring("_hash", 1, digits))
    below = placed.where(F.col("edge").isNull() | (F.col("_prefix") < F.col("edge")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_hash", *key))
    at_edge = placed.where(F.col("_prefix") == F.col("edge")).withColumn("_rank", rank).where("_rank <= need")
    return below.select(*df.columns).unionByName(at_edge.select(*df.columns))


def best_horizon(losses: DataFrame) -> DataFrame:
    """The horizon `k` with the smallest `logloss`."""
    return losses.agg(F.min_by("k", F.struct("logloss", "k")).alias("k"), F.min("logloss").alias("logloss"))


def top_features(importances: DataFrame, n: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)
