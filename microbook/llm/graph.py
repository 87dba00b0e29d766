"""Connected components by alternating large-star and small-star steps, all in joins and aggregates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.llm.tables import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with `least`, the smallest of a and all its b. A node of high degree is one aggregate row per task."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least, "a").withColumn("least", F.least("a", "least"))


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) -> node, component (the smallest node reachable). Nodes without an edge do not come out.

    NULL ends and loops are ignored. Each step is stored, so nothing is computed twice; the number of steps grows with the
    logarithm of a component's size, and a star is done after two.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "components")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        starred = _with_least(large)
        small = starred.select("a", F.col("least").alias("b")).union(starred.select(F.col("b").alias("a"), F.col("least").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
