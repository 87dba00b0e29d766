"""Model quality and label metrics over a scored table (`symbol, label, p_down, p_stable, p_up`).

Every metric comes per symbol and pooled (`symbol = 'ALL'`) from one pass. Order statistics (AUC, quantile bins) run on
distinct scores that are counted first and then cut into even ranges, so neither a pooled sort nor a heavy tie
lands in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microbook.functions.predicates import directional
from microbook.functions.scalars import argmax_class, prob_of_label, probs_to_score
from microbook.partitioning import order_chunks, running_sum
from microbook.schema import CLASSES, TICK_SIZE, UP

POOLED = "ALL"
PROBS = ("p_down", "p_stable", "p_up")
MIN_DIRECTIONAL = 1_000
_EPS = 2.0**-52


def _with_pooled(df: DataFrame, *extra: str, aggs: Sequence[Column]) -> DataFrame:
    """Aggregate by (symbol, *extra) and by (*extra) alone, in one expansion."""
    sets = [[F.col("symbol"), *map(F.col, extra)], [F.col(c) for c in extra]]
    grouped = df.groupingSets(sets, "symbol", *extra).agg(*aggs, F.grouping("symbol").alias("_pooled"))
    return grouped.withColumn("symbol", F.when(F.col("_pooled") == 1, POOLED).otherwise(F.col("symbol"))).drop("_pooled")


def _pooled_rows(df: DataFrame) -> DataFrame:
    """Each row once for its symbol and once for the pool."""
    return df.withColumn("symbol", F.explode(F.array("symbol", F.lit(POOLED))))


def class_share(df: DataFrame, label: str = "label") -> DataFrame:
    """Share of each class per symbol and pooled; a class that does not occur has share 0."""
    shares = [F.avg((F.col(label) == c).cast("double")).alias(f"_{c}") for c in CLASSES]
    wide = _with_pooled(df, aggs=shares)
    pairs = F.array(*[F.struct(F.lit(c).cast("tinyint").alias("label"), F.col(f"_{c}").alias("share")) for c in CLASSES])
    return wide.select("symbol", F.inline(pairs))


def log_loss(scored: DataFrame) -> DataFrame:
    p = F.least(F.greatest(prob_of_label(), F.lit(_EPS)), F.lit(1.0 - _EPS))
    return _with_pooled(scored, aggs=[F.avg(-F.log(p)).alias("logloss"), F.count("*").alias("n")])


def brier(scored: DataFrame) -> DataFrame:
    """Mean over rows of the squared distance between the probabilities and the one-hot label."""
    errors = [F.pow(F.col(p) - (F.col("label") == c).cast("double"), F.lit(2.0)) for c, p in enumerate(PROBS)]
    return _with_pooled(scored, aggs=[F.avg(errors[0] + errors[1] + errors[2]).alias("brier")])


def _one_vs_rest(scored: DataFrame) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(c).cast("tinyint").alias("class"),
                F.col(p).alias("p"),
                (F.col("label") == c).cast("int").alias("y"),
            )
            for c, p in enumerate(PROBS)
        ]
    )
    return scored.select("symbol", F.inline(cells))


def brier_per_class(scored: DataFrame) -> DataFrame:
    return _with_pooled(_one_vs_rest(scored), "class", aggs=[F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier")])


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Rows: symbol and true label; columns pred_0..pred_2."""
    counted = [F.count_if(F.col("_pred") == c).alias(f"pred_{c}") for c in CLASSES]
    return _with_pooled(scored.withColumn("_pred", argmax_class()), "label", aggs=counted)


def auc_up_vs_down(scored: DataFrame, min_rows: int = MIN_DIRECTIONAL) -> DataFrame:
    """Rank AUC of P(up) - P(down) on the rows that moved; NaN below `min_rows` or with a single class."""
    rows = _pooled_rows(directional(scored).select("symbol", "label", probs_to_score().alias("score")))
    counts = rows.groupBy("symbol", "score").agg(
        F.sum((F.col("label") == UP).cast("bigint")).alias("ups"), F.sum((F.col("label") != UP).cast("bigint")).alias("downs")
    )
    below = running_sum(
        order_chunks(counts, ("symbol", "score"), label="auc"),
        {"downs_to_here": F.col("downs")},
        by=("symbol",),
        order=("score",),
        chunk="chunk_no",
    )
    wins = F.col("ups").cast("double") * (F.col("downs_to_here") - F.col("downs") / 2.0)
    totals = below.groupBy("symbol").agg(F.sum(wins).alias("_wins"), F.sum("ups").alias("_ups"), F.sum("downs").alias("_downs"))
    enough = (F.col("_ups") + F.col("_downs") >= min_rows) & (F.col("_ups") > 0) & (F.col("_downs") > 0)
    auc = F.when(enough, F.try_divide(F.col("_wins"), F.col("_ups").cast("double") * F.col("_downs"))).otherwise(F.lit(float("nan")))
    return totals.select("symbol", auc.alias("auc"), (F.col("_ups") + F.col("_downs")).alias("directional_rows"))


def reliability_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Per symbol and class: mean prediction and positive share in `bins` quantile bins; empty bins are left out.

    Bin edges are exact linear-interpolation quantiles. A probability belongs to the bin given by the number of inner
    edges below it.
    """
    cells = _pooled_rows(_one_vs_rest(scored))
    counts = cells.groupBy("symbol", "class", "p").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    staged = order_chunks(counts, ("symbol", "class", "p"), label="bins")  # stored: the counts are read three times
    counts = staged.drop("chunk_no")
    placed = running_sum(
        staged,
        {"_upto": F.col("n")},
        by=("symbol", "class"),
        order=("p",),
        chunk="chunk_no",
    )
    sizes = counts.groupBy("symbol", "class").agg(F.sum("n").alias("_rows"))
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    at = placed.join(sizes, ["symbol", "class"])
    ranks = F.array_distinct(
        F.flatten(
            F.transform(
                inner,
                lambda q: F.array(F.floor(q * (F.col("_rows") - 1)), F.ceil(q * (F.col("_rows") - 1))),
            )
        )
    )
    wanted = F.filter(ranks, lambda r: (r >= F.col("_upto") - F.col("n")) & (r < F.col("_upto")))
    # At most 2 * (bins - 1) rows per symbol and class.
    at_rank = at.select("symbol", "class", "_rows", "p", F.explode(wanted).alias("_rank"))
    edges = at_rank.groupBy("symbol", "class").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "p"))).alias("_at"), F.first("_rows").alias("_rows")
    )

    def edge(q: Column) -> Column:
        position = q * (F.col("_rows") - 1)
        low, high = F.element_at("_at", F.floor(position)), F.element_at("_at", F.ceil(position))
        return low + (high - low) * (position - F.floor(position))

    edges = edges.select("symbol", "class", F.transform(inner, edge).alias("_edges"))
    binned = counts.join(edges, ["symbol", "class"]).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col("p"))).cast("bigint")
    )
    total = F.sum("n")
    return binned.groupBy("symbol", "class", "bin").agg(
        total.alias("n"),
        (F.sum(F.col("p") * F.col("n")) / total).alias("mean_pred"),
        (F.sum("hits") / total).alias("frac_pos"),
    )


def drift(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distance of two score tables: n, largest and mean absolute difference, root mean square."""
    other = right.select(*keys, F.col(value).alias("_other"))
    gap = F.abs(F.col(value) - F.col("_other"))
    return left.join(other, list(keys)).agg(
        F.count("*").alias("n"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def summarise_markouts(
    quotes: DataFrame, fills: DataFrame, mids: DataFrame, *, tick_size: int = TICK_SIZE
) -> DataFrame:
    """One row per symbol and policy.

    quotes: symbol, policy, n quotes posted as `quotes_posted`; fills: symbol, policy, quantity, markout (NULL for a fill
    on entry: it counts as a fill, but has no markout and no quantity); mids: symbol, mid_avg.
    """
    by = ["symbol", "policy"]
    # Markouts are price differences in half ticks, so there are few distinct ones: everything is read from their counts.
    counts = fills.groupBy(*by, "markout").agg(F.count("*").alias("n"), F.sum("quantity").alias("_qty"))
    timed = F.col("markout").isNotNull()
    counts = counts.withColumn("_timed", F.when(timed, F.col("n")).otherwise(F.lit(0)))
    ordered = Window.partitionBy(*by).orderBy("markout").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumns({"_upto": F.sum("_timed").over(ordered), "_total": F.sum("_timed").over(Window.partitionBy(*by))})

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("_timed")) & (rank < F.col("_upto")), F.col("markout")))

    middle = (at_rank(F.floor((F.col("_total") - 1) / 2)) + at_rank(F.floor(F.col("_total") / 2))) / 2.0
    weighted = F.sum(F.col("markout") * F.col("n"))
    stats = placed.groupBy(*by).agg(
        F.sum("n").alias("fills"),
        F.sum(F.when(timed, F.col("_qty"))).alias("fill_qty"),
        F.try_divide(weighted, F.sum("_timed")).alias("_mean"),
        weighted.alias("_sum"),
        middle.alias("_median"),
    )
    joined = quotes.join(stats, by, "left").join(mids, ["symbol"], "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    fill_count = F.coalesce(F.col("fills"), F.lit(0)).cast("bigint")
    return joined.select(
        *by,
        F.col("quotes_posted").cast("bigint").alias("quotes_posted"),
        fill_count.alias("fills"),
        F.coalesce(F.col("fill_qty"), F.lit(0)).cast("bigint").alias("fill_qty"),
        (fill_count / F.greatest(F.col("quotes_posted"), F.lit(1))).alias("fill_rate"),
        zero("_mean").alias("markout_mean_ticks"),
        zero("_median").alias("markout_median_ticks"),
        (-zero("_mean") * tick_size / F.coalesce(F.col("mid_avg"), F.lit(1.0)) * 1e4).alias("adverse_selection_bps"),
        zero("_sum").alias("gross_pnl_ticks"),
    )
