"""Microprice adjustment table: states are (imbalance bucket, spread bucket) pairs.

The counts are aggregated by Spark. Up to `MAX_STATES` states the transition table, at most their square in rows, reaches the driver for
the fixed-point iteration, as the statistics of a Spark ML fit do. A finer grid stays in Spark: transitions are sparse, a round is a
join and a sum, and rounds are stored a few at a time.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microbook.functions.scalars import imbalance_bucket, mid_x2, spread_bucket, state_id
from microbook.operators.windows import WindowFeature, add_features
from microbook.partitioning import CHUNK
from microbook.schema import IMBALANCE_BUCKETS, KEYS, SEQ, SPREAD_BUCKETS, TICK_SIZE
from microbook.session import materialise

MAX_STATES = 1_024
CELLS = T.StructType(
    [T.StructField("imb_bucket", T.IntegerType()), T.StructField("sp_bucket", T.IntegerType()), T.StructField("g", T.DoubleType())]
)


@dataclass(frozen=True)
class MicropriceTable:
    """`values[i][s]` is the expected move of the mid, in price units, from imbalance bucket i and spread bucket s."""

    values: tuple[tuple[float, ...], ...]
    tick_size: int = TICK_SIZE
    rounds: int = 0
    converged: bool = True

    def __post_init__(self):
        widths = {len(row) for row in self.values}
        if len(widths) > 1 or widths == {0}:
            raise ValueError("the table must be rectangular")
        if len(self.values) * self.spread_buckets > MAX_STATES:
            raise ValueError(f"more than {MAX_STATES} states")

    @property
    def imbalance_buckets(self) -> int:
        return len(self.values)

    @property
    def spread_buckets(self) -> int:
        return len(self.values[0]) if self.values else 0

    def cells(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s, float(g)) for i, row in enumerate(self.values) for s, g in enumerate(row)]
        return spark.createDataFrame(rows, CELLS)


@dataclass(frozen=True)
class SparseMicroprice:
    """The same table for any number of states: `rows` has imb_bucket, sp_bucket, g for the states that were seen."""

    rows: DataFrame
    imbalance_buckets: int
    spread_buckets: int
    tick_size: int = TICK_SIZE
    rounds: int = 0
    converged: bool = True

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.rows


def next_state_pairs(
    tob: DataFrame,
    *,
    imb_buckets: int = IMBALANCE_BUCKETS,
    spread_buckets: int = SPREAD_BUCKETS,
    tick_size: int = TICK_SIZE,
    by: Sequence[str] = KEYS,
    size: int = CHUNK,
) -> DataFrame:
    """State of each event, the state after the next event and the mid change in between (last event left out)."""
    states = tob.select(*by, SEQ, state_id(imb_buckets, spread_buckets, tick_size).alias("state"), mid_x2().alias("_mid_x2"))

    def stage(w):
        return {
            "next_state": F.lead("state").over(w),
            "delta_mid": (F.lead("_mid_x2").over(w) - F.col("_mid_x2")) / F.lit(2.0),
        }

    return add_features(states, WindowFeature([stage], ahead=1, drop_null=("next_state",)), by=by, size=size)


def transition_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("state", "next_state").agg(
        F.count("*").alias("transitions"), F.sum("delta_mid").alias("sum_delta_mid")
    )


def normalise_transitions(counts: DataFrame) -> DataFrame:
    """Transition probabilities and the expected mid move per state; unseen states have no row."""
    per_state = Window.partitionBy("state")
    seen = F.sum("transitions").over(per_state)
    return counts.select(
        "state",
        "next_state",
        (F.col("transitions") / seen).alias("probability"),
        (F.sum("sum_delta_mid").over(per_state) / seen).alias("payoff"),
    )


def fit_microprice(
    tob: DataFrame,
    *,
    imb_buckets: int = IMBALANCE_BUCKETS,
    spread_buckets: int = SPREAD_BUCKETS,
    tick_size: int = TICK_SIZE,
    max_rounds: int = 200,
    tolerance: float = 1e-6,
    by: Sequence[str] = KEYS,
) -> MicropriceTable | SparseMicroprice:
    """Iterate G <- payoff + probability.G from zero until the largest change is below `tolerance`; more than `MAX_STATES` states in Spark."""
    states = imb_buckets * spread_buckets
    if states > MAX_STATES:
        return fit_sparse_microprice(
            tob, imb_buckets=imb_buckets, spread_buckets=spread_buckets, tick_size=tick_size, max_rounds=max_rounds, tolerance=tolerance, by=by
        )
    pairs = next_state_pairs(tob, imb_buckets=imb_buckets, spread_buckets=spread_buckets, tick_size=tick_size, by=by)
    stats = normalise_transitions(transition_counts(pairs)).toPandas()
    step = np.zeros((states, states))
    payoff = np.zeros(states)
    step[stats["state"], stats["next_state"]] = stats["probability"]
    payoff[stats["state"]] = stats["payoff"]
    g, converged, used = np.zeros(states), False, 0
    while used < max_rounds and not converged:
        following = payoff + step @ g
        converged = bool(np.abs(following - g).max() < tolerance)
        g, used = following, used + 1
    grid = g.reshape(imb_buckets, spread_buckets)
    return MicropriceTable(tuple(map(tuple, grid.tolist())), tick_size, used, converged)


#: Rounds of a sparse fit that are planned together before their result is stored.
ROUNDS_PER_JOB = 8


def fit_sparse_microprice(
    tob: DataFrame,
    *,
    imb_buckets: int,
    spread_buckets: int,
    tick_size: int = TICK_SIZE,
    max_rounds: int = 200,
    tolerance: float = 1e-6,
    by: Sequence[str] = KEYS,
) -> SparseMicroprice:
    """`fit_microprice` without a bound on the states. Convergence is looked at every `ROUNDS_PER_JOB` rounds.

    States that only ever come last have no transition and keep 0, as all unseen ones do. A state that a third of all events are in
    is one row here: what is joined and summed are distinct transitions.
    """
    pairs = next_state_pairs(tob, imb_buckets=imb_buckets, spread_buckets=spread_buckets, tick_size=tick_size, by=by)
    known = materialise(normalise_transitions(transition_counts(pairs)), "transitions")
    payoff = materialise(known.groupBy("state").agg(F.max("payoff").alias("payoff")), "payoffs")
    g, used, converged = payoff.select("state", F.lit(0.0).alias("g"), F.lit(0.0).alias("_before")), 0, False
    while used < max_rounds and not converged:
        rounds = min(ROUNDS_PER_JOB, max_rounds - used)
        for _ in range(rounds):
            following = known.join(g.select(F.col("state").alias("next_state"), "g"), "next_state").groupBy("state").agg(
                F.sum(F.col("probability") * F.col("g")).alias("_next")
            )
            before = g.select("state", F.col("g").alias("_before"))
            g = payoff.join(following, "state", "left").join(before, "state").select(
                "state", (F.col("payoff") + F.coalesce("_next", F.lit(0.0))).alias("g"), "_before"
            )
        g, used = materialise(g, "microprice"), used + rounds
        largest = g.agg(F.max(F.abs(F.col("g") - F.col("_before")))).first()[0]
        converged = largest is None or largest < tolerance
    cells = g.select(
        F.expr(f"int(state div {spread_buckets})").alias("imb_bucket"), F.expr(f"int(state % {spread_buckets})").alias("sp_bucket"), "g"
    )
    return SparseMicroprice(cells, imb_buckets, spread_buckets, tick_size, used, converged)


def lookup_microprice(df: DataFrame, table: MicropriceTable | SparseMicroprice, out: str = "microprice_g_dev") -> DataFrame:
    """Add the adjustment of each row's state; 0 for an empty table. A dense table is at most MAX_STATES rows, hence broadcast."""
    if isinstance(table, MicropriceTable) and not table.values:
        return df.withColumn(out, F.lit(0.0))
    cells = table.cells(df.sparkSession).withColumnRenamed("g", "_g")
    cells = F.broadcast(cells) if isinstance(table, MicropriceTable) else cells
    keyed = df.withColumns(
        {"imb_bucket": imbalance_bucket(table.imbalance_buckets), "sp_bucket": spread_bucket(table.spread_buckets, table.tick_size)}
    )
    found = keyed.join(cells, ["imb_bucket", "sp_bucket"], "left").withColumn(out, F.coalesce(F.col("_g"), F.lit(0.0)))
    return found.drop("imb_bucket", "sp_bucket", "_g")
