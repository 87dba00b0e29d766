"""Resampling towards a target distribution: documents whose word runs look like those of a target are drawn more often.

Two passes over the texts. The first counts hashed word runs (one array of counts per task), the second scores every document with
the array of bucket gains, one look-up per run. A hash of the identifier adds Gumbel noise, so that the largest scores are a
sample without replacement in proportion to the weights.

The cut-off is found without a sort of the corpus: each task reports the median of its remaining keys and their number, the
weighted median of these is the next pivot, and the side of the pivot that cannot hold the cut-off is gone, a guaranteed share of the
rows each time. What remains is written anew when it has shrunk to a quarter, so the rounds together read about as much as
the first few. Only the winners are sorted, by ranges.
"""

import math
import zlib
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.llm.tables import stored
from microbook.llm.tokens import slices
from microbook.partitioning import global_index

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Text that is cut into words at once, and distinct words whose checksums a task remembers.
_SLICE_BYTES, _WORDS_KEPT = 1 << 20, 200_000
#: So few remaining keys are sorted by the driver.
_FINISH = 4_096
_SHRUNK = 4
_NO_ID = (1 << 63) - 1

# Words are runs of digits, letters a-z and everything beyond ASCII; UTF-8 has only bytes of 128 and more for the latter.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


# --- checksums of word runs -------------------------------------------------------------------------------------------


def _zero_byte_operator() -> np.ndarray:
    """What one further zero byte does to a CRC-32, for each byte of it."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = (steps >> 1) ^ np.where(steps & 1, np.uint32(0xEDB88320), np.uint32(0))
    parts = [np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)]
    return np.stack([(part >> 8) ^ steps[part & 255] for part in parts])


def _shifted(operator: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return operator[0][sums & 255] ^ operator[1][(sums >> 8) & 255] ^ operator[2][(sums >> 16) & 255] ^ operator[3][sums >> 24]


_OPERATORS = [_zero_byte_operator()]


def _appended(sums: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of texts with checksums `sums`, each followed by one of `lengths` bytes with checksum `tails`."""
    moved, bit = sums.copy(), 0
    while (left := lengths >> bit).any():
        if bit == len(_OPERATORS):
            _OPERATORS.append(_shifted(_OPERATORS[-1], _OPERATORS[-1]))
        rows = np.flatnonzero(left & 1)
        moved[rows] = _shifted(_OPERATORS[bit], moved[rows])
        bit += 1
    return moved ^ tails


class _Words(dict):
    """Number of each distinct word; its checksum alone and behind a space."""

    def __init__(self):
        super().__init__()
        self.alone, self.spaced, self.lengths = array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.alone.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.lengths.append(len(word) + 1)
        return number


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded part of it at a time."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= _SLICE_BYTES else text.find(b" ", at + _SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Runs:
    """Buckets of all runs of 1 to `longest` words of texts, as (document number, buckets) parts."""

    def __init__(self, buckets: int, longest: int):
        self._buckets, self._longest = buckets, longest
        self._words = _Words()

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(owner, n_words, bucket): for each owner its words, and the owners' runs one after the other as `bucket` with `owner` repeated."""
        raw = [text.encode().translate(_WORD_BYTES) for text in texts]
        if len(raw) == 1:
            carried: list[bytes] = []
            for part in _pieces(raw[0]):
                yield self._runs([carried + part], [len(carried)])
                carried = (carried + part)[len(carried + part) - self._longest + 1 :] if self._longest > 1 else []
        else:
            yield self._runs([text.split() for text in raw], [0] * len(raw))

    def _runs(self, words: list[list[bytes]], known: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`known`: leading words of each list whose own runs are counted already."""
        if len(self._words) > _WORDS_KEPT:
            self._words = _Words()
        sizes = np.array([len(own) for own in words], np.int64)
        total = int(sizes.sum())
        number = np.fromiter((self._words[word] for own in words for word in own), np.int64, total)
        alone, spaced, lengths = (np.frombuffer(x, kind)[number] if total else np.zeros(0, kind) for x, kind in (
            (self._words.alone, np.uint32), (self._words.spaced, np.uint32), (self._words.lengths, np.int64)))
        owner = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)[owner]
        fresh = np.arange(total) - (ends - sizes[owner]) >= np.array(known, np.int64)[owner]  # the word itself is new
        sums, at = alone, np.arange(total)
        owners, found = [owner[fresh]], [sums[fresh]]
        for run in range(2, self._longest + 1):
            inside = at + run - 1 < ends[at]
            at, sums = at[inside], sums[inside]
            last = at + run - 1
            sums = _appended(sums, spaced[last], lengths[last])
            owners.append(owner[at][fresh[last]])
            found.append(sums[fresh[last]])
        n_words = np.bincount(owner[fresh], minlength=len(words))
        return np.concatenate(owners), n_words, np.concatenate(found).astype(np.int64) % self._buckets


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return slices(batches, "text", _SLICE_BYTES)


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def run_counts(texts: DataFrame, *, text_column: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how many runs of 1 to `longest` words of all texts fall into each bucket. NULL texts have no words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, runs = np.zeros(buckets, np.int64), Runs(buckets, longest)
        for batch in _texts(batches):
            for _, _, bucket in runs(_strings(batch)):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": total[used]})

    parts = texts.select(F.col(text_column).cast("string").alias("text")).mapInArrow(counted, "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """Gain per bucket from two tables of `run_counts`: thousandths of the smoothed log ratio of target to corpus, rounded down."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, column in ((corpus, s), (target, t)):
        for bucket, n in counts.collect():  # one row per bucket at most, whatever the corpus
            column[bucket] = n
    more, less = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(more.tolist(), less.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text", longest: int = LONGEST) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_features, weight (mean gain of its runs, rounded down; 0 without runs)."""
    buckets = len(gain)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(buckets, longest)
        for batch in _texts(batches):
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, n_words, bucket in runs(_strings(batch)):
                words += n_words
                features += np.bincount(owner, minlength=batch.num_rows)
                np.add.at(total, owner, gain[bucket])
            mean = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x) for x in (words, features, mean))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(weighed, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


# --- the cut-off key --------------------------------------------------------------------------------------------------


class Key(NamedTuple):
    """A larger score is better, then a smaller id."""

    score: int
    id: int

    @property
    def place(self) -> tuple[int, int]:
        return -self.score, self.id


def _better(key: Key, *, or_equal: bool = False):
    ties = F.col("id") <= key.id if or_equal else F.col("id") < key.id
    return (F.col("score") > key.score) | ((F.col("score") == key.score) & ties)


def _worse(key: Key):
    return (F.col("score") < key.score) | ((F.col("score") == key.score) & (F.col("id") > key.id))


def weighted_median(medians: list[tuple[Key, int]]) -> Key | None:
    """The key at which half of the weight is reached, best key first."""
    ordered = sorted(((key.place, n, key) for key, n in medians if n), key=lambda x: x[0])
    half, so_far = sum(n for _, n, _ in ordered) / 2, 0
    for _, n, key in ordered:
        so_far += n
        if so_far >= half:
            return key
    return None


def _medians(keys: DataFrame, pivot: Key | None) -> dict[str, list[tuple[Key, int]]]:
    """Per task and side of the pivot: the median key (of its batches' medians) and the number of keys."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, list[tuple[Key, int]]] = {"better": [], "equal": [], "worse": []}
        for batch in batches:
            score, ids = (batch.column(c).to_numpy() for c in ("score", "id"))
            if pivot is None:
                marks = {"worse": np.ones(len(score), bool)}
            else:
                better = (score > pivot.score) | ((score == pivot.score) & (ids < pivot.id))
                equal = (score == pivot.score) & (ids == pivot.id)
                marks = {"better": better, "equal": equal, "worse": ~better & ~equal}
            for side, mark in marks.items():
                own_score, own_id = score[mark], ids[mark]
                if n := len(own_score):
                    middle = np.lexsort((own_id, -own_score))[(n - 1) // 2]
                    sides[side].append((Key(int(own_score[middle]), int(own_id[middle])), n))
        rows = [(side, *weighted_median(found), sum(n for _, n in found)) for side, found in sides.items() if found]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(("side", "score", "id", "n"), map(list, zip(*rows, strict=True)), strict=True)))

    out: dict[str, list[tuple[Key, int]]] = {"better": [], "equal": [], "worse": []}
    for side, score, own_id, n in keys.mapInArrow(summed, "side string, score bigint, id bigint, n bigint").collect():  # three rows per task
        out[side].append((Key(score, own_id), n))
    return out


def cutoff(keys: DataFrame, wanted: int) -> Key | None:
    """The `wanted`-th best of the stored `keys` (score, id), best first; equal keys count each. None if there are not so many."""
    if wanted < 1:
        return None
    active, before, stored_rows, pivot = keys, 0, None, None  # `before`: keys better than all active ones
    while True:
        found = _medians(active, pivot)
        count = {side: sum(n for _, n in part) for side, part in found.items()}
        need = wanted - before
        if need > sum(count.values()):
            return None
        if count["better"] < need <= count["better"] + count["equal"]:
            return pivot
        if need <= count["better"]:
            side, active = "better", active.where(_better(pivot))
        else:
            side, before = "worse", before + count["better"] + count["equal"]
            active = active.where(_worse(pivot)) if pivot else active
        left = count[side]
        if left <= _FINISH:
            last = sorted((Key(*row) for row in active.collect()), key=lambda key: key.place)  # _FINISH keys at most
            return last[wanted - before - 1]
        if stored_rows is None:
            stored_rows = sum(count.values())
        elif left * _SHRUNK <= stored_rows:
            active, stored_rows = stored(active, "resampling-remaining"), left
        pivot = weighted_median(found[side])


# --- the draw ---------------------------------------------------------------------------------------------------------


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    percent: int = PERCENT,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_features, weight, score, rank (1 is best; NULL if not drawn).

    Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn: the highest scores, ties to the smaller
    identifier. `target` needs `text_column` alone. NULL and empty texts have no words and are never drawn if `least_words` is
    positive; a NULL identifier is hashed as an empty one and sorts last. Rows with the same identifier are documents of their own;
    between those with equal scores the one with fewer features comes first. Empty tables give an empty result, an empty target
    gives gains that only tell frequent runs from rare ones. Other columns of `docs` are ignored.
    """
    gain = gains(
        run_counts(docs, text_column=text_column, buckets=buckets, longest=longest),
        run_counts(target, text_column=text_column, buckets=buckets, longest=longest), buckets=buckets,
    )
    weighed = weights(docs, gain, id_column=id_column, text_column=text_column, longest=longest)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    scored = stored(
        weighed.withColumns({"score": F.col("weight") + noise, "id": F.coalesce("doc_id", F.lit(_NO_ID)), "_row": F.monotonically_increasing_id()}),
        "resampling-scores",
    )
    eligible = F.col("n_words") >= least_words
    wanted = percent * scored.where(eligible).count() // 100
    edge = cutoff(scored.where(eligible).select("score", "id"), wanted)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    nothing = F.lit(None).cast("bigint").alias("rank")
    if edge is None:
        return scored.select(*columns, nothing)
    wins = eligible & _better(edge, or_equal=True)
    placed = global_index(scored.where(wins).withColumn("_worse", -F.col("score")), "_place", ("_worse", "id", "n_features", "_row"))
    rank = F.when(F.col("_place") < wanted, F.col("_place") + 1).alias("rank")  # rows equal to the last one may be too many
    return placed.select(*columns, rank).unionByName(scored.where(~wins).select(*columns, nothing))


def resampled_documents(docs: DataFrame, target: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns; rows that share an identifier come together."""
    drawn = resample(docs, target, id_column=id_column, **options).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(drawn, docs[id_column].cast("bigint").eqNullSafe(drawn["doc_id"]), "left_semi")
