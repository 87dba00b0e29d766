"""Best-fit packing of tokenised documents into sequences of a fixed length, by patterns.

What decides a packing is the histogram of piece lengths, at most one entry per length whatever the corpus. On it, patterns of one
to three lengths that fill a sequence exactly are enumerated; non-negative least squares fits how often each is used; the counts
are rounded down, and the lengths that remain are packed best fit first, whole counts at a time. The result is a table of slots
bounded by the sequence length alone: the n-th piece of a length finds its slot there. Pieces are numbered per length in chunks
with carried totals, so a length that a third of all pieces have is never numbered by one task.
"""

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.llm.tables import rows_per_batch, stored
from microbook.llm.tokens import encoder, slices, tidy, with_end
from microbook.partitioning import running_sum

SEQUENCE = 2048
END_ID = 0
CHUNK_PIECES = 8_192
#: Whole texts that a worker gets at once.
_TEXTS_AT_ONCE = 2_048
_ROUNDS = 300
#: Short pieces fit almost anywhere, so a misfit of their counts weighs less.
_SHORT, _SHORT_WEIGHT = 256, 0.1
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def cut(n_tokens: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole sequences, the first piece takes what is over."""
    first = n_tokens % size or min(n_tokens, size)
    return [(0, first)] + [(at, size) for at in range(first, n_tokens, size)]


def pieces(docs: DataFrame, vocabulary: str, *, size: int = SEQUENCE, end: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece of each row of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, ids (NULL unless `with_ids`).

    `ids` are little-endian unsigned integers, 16 bits wide if the vocabulary allows it, else 32. NULL text counts as empty: the
    end id alone. Rows with the same doc_id are documents of their own.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(vocabulary)
        kind = "<u2" if library.vocabulary_size <= 1 << 16 else "<u4"
        for batch in slices(batches, "text"):
            ids, lengths = with_end(*library.encode(batch.column("text")), end)
            full = memoryview(ids.astype("<u4")).cast("B")
            stored_ids = memoryview(ids.astype(kind)).cast("B") if with_ids else None
            wide = np.dtype(kind).itemsize
            rows = ([], [], [], [], [], [])
            at = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), lengths.tolist(), strict=True):
                for number, (start, length) in enumerate(cut(n, size)):
                    a, b = at + start, at + start + length
                    for column, value in zip(
                        rows, (doc_id, number, start, length, zlib.crc32(full[4 * a : 4 * b]), stored_ids[wide * a : wide * b] if with_ids else None), strict=True
                    ):
                        column.append(value)
                at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(tokenised, keeps_words=True), _PIECES)


class Pattern(NamedTuple):
    """`repeats` sequences, each with (length, times) in this order."""

    repeats: int
    parts: tuple[tuple[int, int], ...]


def _exact_patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Rows of three ascending lengths that sum to `size`, 0 for none; each length occurs in the histogram."""
    there = np.zeros(size + 1, bool)
    there[lengths] = there[0] = True
    short = np.flatnonzero(there)
    found = []
    for a in short[short <= size // 3]:
        b = short[(short >= a) & (short <= (size - a) // 2)]
        b = b[(b > 0) | (a == 0)]
        c = size - a - b
        keep = there[c] & (c > 0)
        found.append(np.stack([np.full(keep.sum(), a), b[keep], c[keep]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fit(counts: np.ndarray, patterns: np.ndarray, rounds: int = _ROUNDS) -> np.ndarray:
    """Non-negative repeats x that bring the patterns' lengths near `counts`: accelerated projected gradient steps."""
    size = len(counts) - 1
    weight = np.where(np.arange(size + 1) <= _SHORT, _SHORT_WEIGHT, 1.0)
    weight[0] = 0.0
    # A bound of the curvature by columns and rows of the pattern matrix, scaled per pattern.
    uses = np.bincount(patterns.ravel(), minlength=size + 1).astype(float)
    step = 1.0 / np.maximum((weight[patterns] * uses[patterns]).sum(axis=1), 1e-9)
    x = y = np.zeros(len(patterns))
    pace = 1.0
    for _ in range(rounds):
        made = sum(np.bincount(patterns[:, k], weights=y, minlength=size + 1) for k in range(3))
        slope = (weight * (made - counts))[patterns].sum(axis=1)
        following = np.maximum(y - step * slope, 0.0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = np.maximum(following + (pace - 1) / faster * (following - x), 0.0)
        x, pace = following, faster
    return x


def _best_fit(left: np.ndarray, size: int) -> list[Pattern]:
    """Pack the counts that are left, longest first, each into the fullest sequences that still hold it."""
    spaces: list[int] = []  # of open sequences, ascending
    open_with: dict[int, list[tuple[int, tuple]]] = {}
    done: list[Pattern] = []

    def put(space: int, number: int, parts: tuple) -> None:
        if space == 0:
            done.append(Pattern(number, parts))
        else:
            if space not in open_with:
                bisect.insort(spaces, space)
            open_with.setdefault(space, []).append((number, parts))

    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            at = bisect.bisect_left(spaces, length)
            space = spaces[at] if at < len(spaces) else size
            number, parts = open_with[space].pop() if at < len(spaces) else (count, ())
            if at < len(spaces) and not open_with[space]:
                del open_with[space], spaces[at]
            times = space // length
            full = min(number, count // times)
            rest = count - full * times if full < number else 0
            if full:
                put(space - times * length, full, (*parts, (length, times)))
            if rest:
                put(space - rest * length, 1, (*parts, (length, rest)))
            unused = number - full - bool(rest)
            if unused and parts:
                put(space, unused, parts)
            count -= full * times + rest
    return done + [Pattern(number, parts) for groups in open_with.values() for number, parts in groups]


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Pattern]:
    """Patterns that use each length exactly as often as the histogram has it."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left = counts.copy()
    used: list[Pattern] = []
    if left[size]:
        used.append(Pattern(int(left[size]), ((size, 1),)))
        left[size] = 0
    patterns = _exact_patterns(np.flatnonzero(left), size)
    if len(patterns):
        repeats = fit(left.astype(float), patterns)
        whole = np.floor(repeats + 1e-6).astype(np.int64)
        for at in np.lexsort((np.arange(len(whole)), -whole)):
            if whole[at] == 0:
                break
            lengths, times = np.unique(patterns[at][patterns[at] > 0], return_counts=True)
            n = int(min(whole[at], (left[lengths] // times).min()))
            if n:
                left[lengths] -= n * times
                used.append(Pattern(n, tuple((int(a), int(b)) for a, b in zip(lengths[::-1], times[::-1], strict=True))))
    return used + _best_fit(left, size)


def slot_table(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Per length, runs of piece numbers: from which number on, how many sequences side by side, the first one, the place there."""
    rows, taken, sequence = [], {}, 0
    for repeats, parts in patterns:
        place = 0
        for length, times in parts:
            rows.append((length, taken.get(length, 0), repeats, sequence, place))
            taken[length] = taken.get(length, 0) + repeats * times
            place += length * times
        sequence += repeats
    table = np.array(rows, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "first", "side", "sequence", "place"), table.T.copy(), strict=True))


def place(cut_docs: DataFrame, *, size: int = SEQUENCE, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """Add sequence_id and offset to stored pieces (any columns, among them length and a unique `key`); `ids` should be left out."""
    spark = cut_docs.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_docs.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    slots = spark.sparkContext.broadcast(slot_table(plan(histogram, size)))  # bounded by the patterns of `size`
    chunks = max(1, -(-max(histogram.values(), default=1) // chunk_pieces))
    chunked = cut_docs.withColumn("chunk_no", F.pmod(F.xxhash64("key"), F.lit(chunks)))
    numbered = running_sum(chunked, {"nth": F.lit(1).cast("bigint")}, by=("length",), order=("key",), chunk="chunk_no")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = slots.value
        keys = (slot["length"] << 48) + slot["first"]
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            at = np.searchsorted(keys, (length << 48) + nth - 1, side="right") - 1
            nth = nth - 1 - slot["first"][at]
            sequence = slot["sequence"][at] + nth % slot["side"][at]
            offset = slot["place"][at] + nth // slot["side"][at] * length
            columns = {c: batch.column(c) for c in names} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_pydict(columns)

    names = cut_docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_docs.schema) + ", sequence_id bigint, offset bigint"
    return numbered.select(*names, "nth").mapInArrow(placed, schema)


def stored_pieces(docs: DataFrame, vocabulary: str, *, size: int = SEQUENCE, end: int = END_ID, with_ids: bool = True) -> DataFrame:
    """`pieces` with a unique key, written once: tokenising is not repeated and keys stay as they are."""
    keyed = pieces(docs, vocabulary, size=size, end=end, with_ids=with_ids).withColumn("key", F.monotonically_increasing_id())
    with rows_per_batch(docs.sparkSession, _TEXTS_AT_ONCE):
        return stored(keyed, "pieces")


def pack(docs: DataFrame, vocabulary: str, *, size: int = SEQUENCE, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives an empty result."""
    narrow = stored_pieces(docs, vocabulary, size=size, end=end, with_ids=False).drop("ids")
    return place(narrow, size=size).drop("key")


def sequences(cut_docs: DataFrame, *, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves, from `stored_pieces`: sequence_id, n_tokens, ids (binary), doc_ids and offsets in order."""
    placed = place(cut_docs.drop("ids"), size=size).select("key", "sequence_id", "offset", "length", "doc_id")
    parts = placed.join(cut_docs.select("key", "ids"), "key").groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("parts")  # at most `size` parts
    )
    return parts.select(
        "sequence_id",
        F.aggregate("parts.length", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
        F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.offset").alias("offsets"),
    )
