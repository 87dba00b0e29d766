"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Whole copies that every document of a source certainly gets come first; what is left of the
target is sampled: a document's random odds u / (1 - u), divided by the odds of its inclusion, rank the source's documents, and
the first ones are taken until their words fill the rest. Random numbers are hashes of doc_id, so reruns agree.

Only (doc_id, source, size) is ranked. The order of a source is cut into chunks of even size along the ranking variable, with
totals per chunk carried forward, so a source with a third of all rows is never sorted by one task. The table of sources has one
row per source; its one-task window sees nothing else.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microbook.llm.tables import stored, unused
from microbook.partitioning import running_sum

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
CHUNK_ROWS = 8_192
#: 13 hexadecimal digits: 52 bits, exact in a double.
_DIGITS, _SPAN = 13, float(16**13)


def words(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: str) -> Column:
    """Random number in (0, 1) that depends on doc_id and seed alone."""
    name = F.concat_ws("#", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(name), 1, _DIGITS), 16, 10).cast("double") + 0.5) / _SPAN


def source_targets(sized: DataFrame, *, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources in code point order, NULL last, get the repeating `weights`; together they share `share` times all sizes. No target
    exceeds `most` times its source's size: the excess is shared again by weight. That fixed point is a water level: sources
    are capped in order of cap per weight, and the level is the largest over all numbers of capped sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.get(turns, (F.row_number().over(by_name) - 1) % len(weights)))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    first_capped = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumns(
        {
            "left_words": F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = F.max(F.col("left_words") / F.col("left_weight")).over(everything)
    return first_capped.withColumn("level", level).select(
        "source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def _take(ranked: DataFrame, chunks: int, budget: str, taken: str) -> DataFrame:
    """Mark the longest prefix of each source's ranking whose words fit into `budget`."""
    chunked = ranked.withColumn("chunk_no", F.floor(F.col("place") * chunks))
    summed = running_sum(chunked, {"so_far": F.col("size")}, by=("source",), order=("place", "doc_id", "size"), chunk="chunk_no")
    return summed.withColumn(taken, F.col("so_far") <= F.col(budget)).drop("so_far", "chunk_no")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    preference: Column | None = None,
    seed: str = "mix",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, copies, taken (words).

    `preference`, a positive multiplier of a document's inclusion odds, makes inclusion unequal inside a source too. After the
    first prefix, a second one of documents that still fit into the remainder tops the source up, so that a long document at
    the border costs little. Documents without words are taken as often as their source's whole copies, 0 words each. Rows with the
    same doc_id are ranked alike and may be taken separately. An empty table gives an empty result.
    """
    odds = (preference if preference is not None else F.lit(1.0)).cast("double")
    sized = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), odds.alias("preference")), "mix-sizes")
    targets = stored(source_targets(sized, weights=weights, share=share, most=most), "mix-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    chunks = max(1, -(-largest // chunk_rows))

    u = uniform(F.col("doc_id"), seed)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        "doc_id", sized.source, "size", "source_size", "target", "preference", u.alias("u"), F.floor(rate).alias("whole"), rate.alias("rate")
    )
    inclusion = (F.col("rate") - F.col("whole")) * F.col("preference")
    # Random odds over inclusion odds; inside a source, x / (1 + x) of it without the source's constant has the same order.
    random_odds = F.col("u") / (1 - F.col("u")) / F.col("preference")
    ranked = rows.withColumns(
        {
            "pareto": F.when(inclusion > 0, random_odds * (1 - (F.col("rate") - F.col("whole"))) / (F.col("rate") - F.col("whole"))),
            "place": random_odds / (1 + random_odds),
            "rest": F.col("target") - F.col("whole") * F.col("source_size"),
        }
    )
    first = stored(_take(ranked, chunks, "rest", "in_first"), "mix-first")
    filled = first.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("in_first"), F.col("size"))), F.lit(0)).alias("filled"))
    gap = F.col("rest") - F.col("filled")
    open_rows = first.join(filled.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    open_rows = open_rows.withColumns({"gap": gap, "fits": ~F.col("in_first") & (F.col("size") <= gap) & (F.col("rest") > 0)})
    second = _take(open_rows.where("fits"), chunks, "gap", "in_second")
    done = open_rows.where("NOT fits").withColumn("in_second", F.lit(False)).unionByName(second)
    copies = (F.col("whole") + ((F.col("in_first") & (F.col("rest") > 0)) | F.col("in_second")).cast("bigint")).cast("bigint")
    return done.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` repeated as often as the mix takes them; doc_id must be unique. Rows that it does not take go."""
    own, often, copy = (unused(docs, stem) for stem in ("_id", "_copies", "_copy"))
    copies = mix(docs, **how).where("copies > 0").select(F.col("doc_id").alias(own), F.col("copies").alias(often))
    named = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(own)))
    return named.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often).cast("int")))).select(*docs.columns)
