"""Hard-negative mining: for an anchor and each of its nearest vectors of the same label, the nearest vectors of other labels that
score almost as high.

Vectors are integers; scores are exact inner products. Each vector is stored with the mean and deviation of its segments, few long
segments first, many short ones next. With segments of length L, a product lies within sum L * mean * mean +- sum L * deviation *
deviation. Pairs whose bounds cannot reach an anchor's window, or its best finds so far, are dropped by the coarse summary, the
rest by the fine one, and only what is left is multiplied out.

Vectors are ordered by label and cut into blocks; anchors likewise. A row of the join is one block of anchors with one block of vectors:
for the positives only blocks that share a label meet, for the negatives all but those of one and the same label. A block's best
finds per anchor leave the task, never its pairs, so a label that a third of all vectors have is many even blocks.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from microbook.llm.tables import rows_per_batch, stored
from microbook.partitioning import global_index

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
PERCENT = 80
#: Segments per vector, coarse to fine. Shorter vectors are filled with zeros, which change no product.
LEVELS = (4, 16)
ANCHORS_PER_BLOCK = 512
#: Components of a block of vectors, and vectors that are compared at once.
_BLOCK_COMPONENTS, _AT_ONCE = 1 << 19, 512
#: Summaries are 32 bits wide; this share of the product of norms covers their rounding.
_SLACK = 4e-6
_DENSE = 0.25
_LARGEST = (1 << 63) - 1
_HUGE = np.finfo(float).max


# --- bounds and exact scores ------------------------------------------------------------------------------------------


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels side by side, times the root of the segment length."""
    means, deviations = [], []
    for parts in LEVELS:
        segments = vectors.reshape(len(vectors), parts, -1)
        root = np.sqrt(segments.shape[2])
        means.append(segments.mean(2) * root)
        deviations.append(segments.std(2) * root)
    with np.errstate(over="ignore"):
        return np.concatenate(means, 1).astype(np.float32), np.concatenate(deviations, 1).astype(np.float32)


class Block(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    means: np.ndarray
    deviations: np.ndarray

    def part(self, rows: slice) -> "Block":
        return Block(*(column[rows] for column in self))

    def level(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Means, and deviations with one more column for the rounding."""
        own = slice(sum(LEVELS[:number]), sum(LEVELS[: number + 1]))
        means, deviations = self.means[:, own].astype(float), self.deviations[:, own].astype(float)
        norm = np.sqrt((means**2).sum(1) + (deviations**2).sum(1)) * np.sqrt(_SLACK)
        return means, np.column_stack([deviations, norm])


def exact(a: np.ndarray, b: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], largest: float) -> np.ndarray:
    """Integer products of the pairs' rows; `largest` bounds their size. Beyond 64 bits they count as the largest number."""
    if largest < 2.0**53:
        if len(pairs[0]) > _DENSE * len(a) * len(b):
            return (a @ b.T)[pairs].astype(np.int64)
        return np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]]).astype(np.int64)
    if largest < 2.0**62:
        return np.einsum("ij,ij->i", a[pairs[0]].astype(np.int64), b[pairs[1]].astype(np.int64))
    sums = (sum(int(x) * int(y) for x, y in zip(a[i], b[k], strict=True)) for i, k in zip(*pairs, strict=True))
    return np.array([max(-_LARGEST, min(_LARGEST, s)) for s in sums], np.int64)


class Finds:
    """The best `most` finds per anchor and window so far: a higher score first, then a smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most  # per anchor and window, both ends included; low > high is no window
        self.edge = low.copy()  # what a find must reach
        self.anchor, self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(4))
        self._update_needs()

    def _update_needs(self) -> None:
        open_windows = self.low <= self.high
        self.least = np.where(open_windows, self.edge, _LARGEST).min(1).astype(float)
        self.greatest = np.where(open_windows, self.high, -_LARGEST).max(1).astype(float)
        # 64-bit numbers as doubles may be off by their last bits; the largest one stands for all beyond.
        self.least -= np.abs(self.least) * 2.0**-52
        self.greatest += np.abs(self.greatest) * 2.0**-52
        self.greatest[self.greatest >= _LARGEST] = np.inf
        self.least[self.least <= -_LARGEST] = -np.inf

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        parts = [(self.anchor, self.window, self.score, self.id)]
        for window in range(self.low.shape[1]):
            fits = (score >= self.edge[anchor, window]) & (score <= self.high[anchor, window])
            parts.append((anchor[fits], np.full(int(fits.sum()), window), score[fits], ids[fits]))
        if sum(len(p[0]) for p in parts[1:]) == 0:
            return
        anchor, window, score, ids = (np.concatenate(column) for column in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, window, anchor))
        group = anchor[order] * self.low.shape[1] + window[order]
        first = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        kept = order[place < self.most]
        self.anchor, self.window, self.score, self.id = anchor[kept], window[kept], score[kept], ids[kept]
        last = order[place == self.most - 1]
        self.edge[anchor[last], window[last]] = score[last]
        self._update_needs()


def search(anchors: Block, rows: Block, finds: Finds, *, same_label: bool) -> None:
    """Add to `finds` what the vectors of `rows` have for the anchors; positives are of the same label and another id."""
    sizes = [np.abs(x.vectors).max(initial=0.0) for x in (anchors, rows)]
    largest = float(sizes[0]) * float(sizes[1]) * anchors.vectors.shape[1]
    a = anchors.vectors.astype(float)
    of_anchors = [anchors.level(k) for k in range(len(LEVELS))]
    for at in range(0, len(rows.ids), _AT_ONCE):
        part = rows.part(slice(at, at + _AT_ONCE))
        b = part.vectors.astype(float)
        allowed = anchors.labels[:, None] == part.labels[None, :]
        allowed = allowed & (anchors.ids[:, None] != part.ids[None, :]) if same_label else ~allowed
        pairs = np.nonzero(allowed)
        for number, (means, deviations) in enumerate(of_anchors):
            if not len(pairs[0]):
                break
            own_means, own_deviations = part.level(number)
            with np.errstate(over="ignore", invalid="ignore"):
                if len(pairs[0]) > _DENSE * allowed.size:
                    middle, reach = (means @ own_means.T)[pairs], (deviations @ own_deviations.T)[pairs]
                else:
                    middle = np.einsum("ij,ij->i", means[pairs[0]], own_means[pairs[1]])
                    reach = np.einsum("ij,ij->i", deviations[pairs[0]], own_deviations[pairs[1]])
                # Bounds that are no numbers drop nothing.
                hopeless = (middle + reach < finds.least[pairs[0]]) | (middle - reach > finds.greatest[pairs[0]])
            pairs = pairs[0][~hopeless], pairs[1][~hopeless]
        if len(pairs[0]):
            finds.add(pairs[0], exact(a, b, pairs, largest), part.ids[pairs[1]])


# --- blocks -----------------------------------------------------------------------------------------------------------

_PAYLOAD = "ids binary, labels binary, vectors binary, wide boolean, means binary, deviations binary"


def _bytes(block: Block) -> dict[str, object]:
    wide = bool(np.abs(block.vectors).max(initial=0.0) >= 2.0**31)
    vectors = block.vectors.astype(np.float64 if wide else np.int32)
    return {
        "ids": block.ids.tobytes(), "labels": block.labels.tobytes(), "vectors": vectors.tobytes(), "wide": wide,
        "means": block.means.tobytes(), "deviations": block.deviations.tobytes(),
    }


def _block(row: dict, prefix: str) -> Block:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    kind = np.float64 if row[f"{prefix}wide"] else np.int32
    shapes = [np.frombuffer(row[f"{prefix}{name}"], dtype).reshape(len(ids), -1) for name, dtype in (("vectors", kind), ("means", np.float32), ("deviations", np.float32))]
    return Block(ids, np.frombuffer(row[f"{prefix}labels"], np.int64), *shapes)


def _packer(key: str, width: int, windows: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        vectors = np.zeros((len(rows), width))
        for target, values in zip(vectors, rows["vector"], strict=True):
            target[: len(values)] = values
        vectors = np.clip(np.floor(vectors), -_HUGE, _HUGE)
        with np.errstate(over="ignore", invalid="ignore"):
            block = Block(rows["id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), vectors, *summaries(vectors))
        out = {key: rows[key].iloc[0], "least_label": block.labels.min(), "greatest_label": block.labels.max(), **_bytes(block)}
        scores = np.full((len(rows), windows), -1, np.int64)
        if windows:
            for target, values in zip(scores, rows["scores"], strict=True):
                target[: len(values)] = values
        return pd.DataFrame([out | {"places": rows["place"].to_numpy(np.int64).tobytes(), "scores": scores.tobytes()}])

    return pack


def _packed(rows: DataFrame, key: str, size: int, width: int, label: str, windows: int = 0) -> DataFrame:
    """One stored row per `size` rows in the order of `nth`."""
    keyed = rows.withColumn(key, F.expr(f"nth div {size}"))
    schema = f"{key} bigint, least_label bigint, greatest_label bigint, {_PAYLOAD}, places binary, scores binary"
    return stored(keyed.groupBy(key).applyInPandas(_packer(key, width, windows), schema), label)


def lowest(score: np.ndarray, percent: int) -> np.ndarray:
    """Smallest integer that is at least `percent` of a score, without leaving 64 bits."""
    return score // 100 * percent - (-(score % 100) * percent // 100)


def _best(pairs: DataFrame, anchors: DataFrame, blocks: DataFrame, most: int, label: str, windows: int = 0, percent: int = 0) -> DataFrame:
    """(place, window, score, id, rank): the best finds per anchor and window over all pairs (anchor_block, block).

    Without windows any vector of the same label counts; with them, vectors of other labels that score between `percent` of a
    window's score and all of it.
    """
    spark = pairs.sparkSession
    names = ("ids", "labels", "vectors", "wide", "means", "deviations", "places", "scores")
    facing = anchors.select("anchor_block", *[F.col(n).alias(f"a_{n}") for n in names])
    n_blocks = max(1, min(blocks.count(), 20_000))
    # The anchors travel to the vectors, which are the larger side.
    joined = pairs.join(facing, "anchor_block").repartition(n_blocks, "block").join(blocks.repartition(n_blocks, "block"), "block")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, rows = _block(row, "a_"), _block(row, "")
                if windows:
                    high = np.frombuffer(row["a_scores"], np.int64).reshape(-1, windows)
                    finds = Finds(np.where(high >= 0, lowest(high, percent), _LARGEST), high, most)
                else:
                    shape = len(own.ids), 1
                    finds = Finds(np.full(shape, -_LARGEST), np.full(shape, _LARGEST), most)
                search(own, rows, finds, same_label=not windows)
                places = np.frombuffer(row["a_places"], np.int64)
                yield pa.RecordBatch.from_pydict({"place": places[finds.anchor], "window": finds.window, "score": finds.score, "id": finds.id})

    with rows_per_batch(spark, 1):
        found = stored(joined.mapInArrow(searched, "place bigint, window bigint, score bigint, id bigint"), label)
    order = Window.partitionBy("place", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    percent: int = PERCENT,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives for each anchor and positive.

    A component x counts as floor(scale * x); a score is the integer product with the anchor. Higher scores come first, ties by the smaller
    identifier. An anchor's positives are the first `positives` vectors of its label and another identifier. Their hard negatives are the
    first `negatives` vectors of other labels with percent * positive_score <= 100 * score <= 100 * positive_score; a positive with a
    negative score has none.

    Rows with a NULL identifier, label or vector, or a component that is NULL or not finite, take no part. Vectors of different lengths
    are compared as if the shorter ones went on with zeros; an empty vector scores 0. Rows with the same identifier are rows of
    their own, also as anchors. Scores beyond 64 bits count as the largest 64-bit number. An empty table gives an empty result.
    Other columns of `vectors` are ignored.
    """
    value = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), value.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(finite).withColumn("vector", F.transform("vector", lambda x: x * F.lit(float(scale))))
    placed = stored(global_index(rows, "nth", ("label", "id")), "negatives-rows").withColumn("place", F.col("nth"))
    n_rows, longest = placed.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = -(-max(longest or 1, 1) // LEVELS[-1]) * LEVELS[-1]
    per_block = max(64, min(1 << 13, _BLOCK_COMPONENTS // width))
    per_anchor_block = min(ANCHORS_PER_BLOCK, per_block)
    blocks = _packed(placed, "block", per_block, width, "negatives-blocks")
    own = placed.where("anchor").select("place", "id", "label", "vector")
    own = stored(global_index(own, "nth", ("label", "place")), "negatives-anchors")

    anchors = _packed(own, "anchor_block", per_anchor_block, width, "negatives-anchor-blocks")
    of_anchors = own.select("label", F.expr(f"nth div {per_anchor_block}").alias("anchor_block")).distinct()
    of_rows = placed.select("label", F.expr(f"nth div {per_block}").alias("block")).distinct()
    sharing = of_anchors.join(of_rows, "label").select("anchor_block", "block").distinct()
    near = stored(_best(sharing, anchors, blocks, positives, "negatives-near"), "negatives-positives")

    scores = near.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("_found")).select(
        "place", F.transform("_found", lambda x: x["score"]).alias("scores")  # `positives` scores at most
    )
    asked = _packed(own.join(scores, "place"), "anchor_block", per_anchor_block, width, "negatives-windows", positives)
    last = max(0, -(-n_rows // per_block) - 1)
    every = asked.select("anchor_block", "least_label", "greatest_label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))).alias("block"))
    kinds = blocks.select("block", F.col("least_label").alias("_least"), F.col("greatest_label").alias("_greatest"))
    one_label = "least_label = greatest_label AND _least = _greatest AND least_label = _least"
    facing = every.join(kinds, "block").where(f"NOT ({one_label})").select("anchor_block", "block")
    hard = _best(facing, asked, blocks, negatives, "negatives-hard", positives, percent)

    named = near.join(own.select("place", F.col("id").alias("anchor_id")), "place").select(
        "place", (F.col("rank") - 1).cast("bigint").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return hard.join(named, ["place", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
