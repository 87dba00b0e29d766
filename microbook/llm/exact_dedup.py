"""Exact deduplication with disk-backed streaming state.

A stream of (digest, identifier, locator) runs through a keyed aggregate without watermark: the state store (RocksDB, files in
the shared folder) keeps for each digest the row that stays, its content locator and the number of rows, and never expires. A
second call with the same state folder goes on where the first one ended, so a new crawl is compared with all earlier ones.
Digests only propose groups. Every proposed group is checked on the full bytes of its texts; a group in which texts differ is
divided by the text itself.

Skew: the aggregate combines rows before the shuffle, so a text that is a third of the corpus sends one row per task. Byte
checks use the smallest and largest text of a digest, which combine in the same way. Only narrow rows (id, digest, locator) are
joined with the state; that join is one that adaptive execution can divide when a digest is hot.
"""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.llm.tables import new_folder, stored, unused

#: State on disk. Space set aside ahead of use would cost megabytes per state partition, and without the bound each partition of
#: an executor has write buffers of its own.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
#: Feed files of one micro-batch: bounds the rows of a batch, not what is read in all.
FILES_PER_BATCH = 10_000


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def parquet_locator() -> Column:
    """Where a row of a Parquet scan lies: file and row number."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def ingest(feed_path: str, feed: DataFrame, state: str, *, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the rows of `feed_path` that the state has not seen through it; returns the state, one row per digest.

    Columns: digest, keeper (doc_id, locator), n. The keeper is the row with the largest (doc_id, locator).
    """
    spark = feed.sparkSession
    rows = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(feed_path)
    keyed = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, STATE_STORE):
        query = (
            keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        kept = spark.read.format("statestore").load(state)
        keeper, count = kept.schema["value"].dataType.names
        return stored(
            kept.select("key.digest", F.col(f"value.{keeper}").alias("keeper"), F.col(f"value.{count}").alias("n")), "dedup-state"
        )


def exact_dedup(
    docs: DataFrame,
    *,
    locator: Column | None = None,
    state: str | None = None,
    digest_bytes: int = 32,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, locator, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; NULL counts as empty. The row with the largest doc_id stays, among rows with the same
    doc_id the one with the largest locator; a NULL doc_id is smaller than any other. Without `locator`, doc_id must be unique
    (rows that share text and doc_id would all be kept). Other columns of `docs` are ignored; an empty table gives an empty
    result. `digest_bytes` shortens the digest that keys the state (a shorter key means more byte checks, never other results).
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"),
        (locator if locator is not None else F.col("doc_id").cast("string")).alias("locator"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sha = F.unhex(F.sha2("text", 256))
    rows = rows.withColumns({"sha": sha, "digest": F.substring(sha, 1, digest_bytes)})
    feed_path = new_folder(spark, "dedup-feed")
    rows.select("digest", "doc_id", "locator", "sha").write.parquet(feed_path)
    feed = spark.read.schema(rows.select("digest", "doc_id", "locator", "sha").schema).parquet(feed_path)
    groups = ingest(feed_path, feed, state or new_folder(spark, "dedup-rocksdb"), files_per_batch=files_per_batch)

    # Full bytes: all texts of a digest are equal exactly if the smallest equals the largest.
    spans = rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    clashing = stored(spans.where(F.col("least") != F.col("most")).select("digest"), "dedup-clashes")
    whole = feed.join(groups, "digest").join(clashing, "digest", "left_anti")
    divided = rows.join(clashing, "digest", "left_semi")
    by_text = divided.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    columns = ["doc_id", "locator", "keeper", "n", "sha"]
    placed = whole.select(columns).unionByName(divided.join(by_text, ["digest", "text"]).select(columns))
    return placed.select(
        "doc_id",
        "locator",
        F.col("keeper.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.struct("doc_id", "locator").eqNullSafe(F.col("keeper")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, *, locator: Column | None = None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    place = unused(docs, "_locator")
    marked = docs.withColumn(place, locator if locator is not None else F.col("doc_id").cast("string"))
    found = exact_dedup(marked, locator=F.col(place))
    gone = stored(found.where("NOT kept").select(F.col("locator").alias(place)), "dedup-dropped")
    return marked.join(gone, place, "left_anti").select(*docs.columns)
