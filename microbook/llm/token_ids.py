"""Token ids in files of fixed-width packed bits.

A file holds the documents of one range of doc_id in ascending order:

    header   "MBTOK001", bits per id (uint32), ids per block (uint32)
    blocks   the ids of all documents one after the other, each in the fewest bits that the vocabulary needs, least significant
             bit first; a block of `BLOCK` ids (the last may be shorter) begins on a byte
    index    block offsets (uint64 each), then per document: doc_id (int64), flag of a NULL doc_id (uint8), number of ids (uint64)
    trailer  number of blocks, documents, ids, offset of the index (uint64 each), "MBTOKEND"

All numbers are little-endian. A block is found by its offset and unpacked alone, so any document can be read without the rest.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from microbook.llm.files import attempt_name, create_folder, open_input, open_output
from microbook.llm.tables import dealt, new_folder, stored
from microbook.llm.tokens import encoder, slices, with_end

MAGIC, END_MAGIC = b"MBTOK001", b"MBTOKEND"
BLOCK = 1 << 16  # a multiple of 8: a full block ends on a byte whatever the width
_TRAILER = 4 * 8 + len(END_MAGIC)
#: Blocks read at once.
_AT_ONCE = 64


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that hold every id of the vocabulary."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Eight ids fill `width` bytes; the eight columns are shifted into place for all groups at once."""
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, np.uint64)
    padded[: len(ids)] = ids
    columns, out = padded.reshape(groups, 8), np.zeros((groups, width), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = columns[:, j] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_bits(packed: bytes, n: int, width: int) -> np.ndarray:
    groups = -(-n // 8)
    padded = np.zeros(groups * width, np.uint8)
    padded[: len(packed)] = np.frombuffer(packed, np.uint8)
    columns, out = padded.reshape(groups, width), np.zeros((groups, 8), np.uint64)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        for k in range(-(-(shift + width) // 8)):
            out[:, j] |= columns[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] >>= np.uint64(shift)
    return (out.ravel()[:n] & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    def __init__(self, uri: str, width: int):
        self._out, self._width = open_output(uri), width
        self._out.write(MAGIC + np.array([width, BLOCK], "<u4").tobytes())
        self._at, self._offsets, self._waiting, self._held = len(MAGIC) + 8, [], [], 0
        self._docs, self._nulls, self._lengths = [], [], []

    def add(self, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        self._docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self._nulls.append(np.array([d is None for d in doc_ids], "u1"))
        self._lengths.append(lengths.astype("<u8"))
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= BLOCK:
            self._flush(self._held - self._held % BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self._waiting) if self._waiting else np.zeros(0, np.uint32)
        block_bytes = BLOCK * self._width // 8
        packed = pack_bits(ids[:n], self._width)
        self._offsets += range(self._at, self._at + len(packed), block_bytes)
        self._out.write(packed)
        self._at += len(packed)
        self._waiting, self._held = [ids[n:]], len(ids) - n

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        self._flush(self._held)
        lengths = np.concatenate(self._lengths)
        docs, total = len(lengths), int(lengths.sum())
        self._out.write(np.array(self._offsets, "<u8").tobytes())
        for column in (self._docs, self._nulls, [lengths]):
            self._out.write(np.concatenate(column).tobytes())
        self._out.write(np.array([len(self._offsets), docs, total, self._at], "<u8").tobytes() + END_MAGIC)
        self._out.close()
        return docs, total


class Reader:
    def __init__(self, uri: str):
        self._file = open_input(uri)
        size = self._file.size()
        tail = self._file.read_at(_TRAILER, size - _TRAILER)
        head = self._file.read_at(len(MAGIC) + 8, 0)
        if head[: len(MAGIC)] != MAGIC or tail[-len(END_MAGIC) :] != END_MAGIC:
            raise ValueError(f"{uri} is not a whole file of token ids")
        self.width, self.block = (int(x) for x in np.frombuffer(head[len(MAGIC) :], "<u4"))
        blocks, docs, self.n_ids, self._index_at = (int(x) for x in np.frombuffer(tail[:32], "<u8"))
        index = self._file.read_at(size - _TRAILER - self._index_at, self._index_at)
        self._offsets = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(index, "<i8", docs, at)
        self.nulls = np.frombuffer(index, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def blocks(self, first: int, upto: int) -> np.ndarray:
        """Ids of the blocks from `first` up to before `upto`."""
        if first >= upto:
            return np.zeros(0, np.uint32)
        begin = int(self._offsets[first])
        end = int(self._offsets[upto]) if upto < len(self._offsets) else self._index_at
        return unpack_bits(self._file.read_at(end - begin, begin), min(self.n_ids, upto * self.block) - first * self.block, self.width)

    def ids(self, start: int, n: int) -> np.ndarray:
        """`n` ids from place `start` of the file on; reads the blocks that hold them."""
        first = start // self.block
        return self.blocks(first, -(-(start + n) // self.block) if n else first)[start - first * self.block :][:n]

    def checksums(self) -> np.ndarray:
        """crc32 of each document's ids as little-endian uint32, reading the file once, some blocks at a time."""
        out = np.zeros(len(self.lengths), np.int64)
        ends = self.starts + self.lengths
        for first in range(0, len(self._offsets), _AT_ONCE):
            ids = memoryview(self.blocks(first, min(len(self._offsets), first + _AT_ONCE)).astype("<u4")).cast("B")
            a, b = first * self.block, first * self.block + len(ids) // 4
            for d in range(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(self.starts, b, side="left"))):
                part = ids[4 * (max(int(self.starts[d]), a) - a) : 4 * (min(int(ends[d]), b) - a)]
                out[d] = zlib.crc32(part, int(out[d]))
        return out


_MANIFEST = "range_no int, path string, n_docs bigint, n_ids bigint"


def write_token_ids(docs: DataFrame, vocabulary: str, end: int, folder: str, *, word_level: bool = False) -> DataFrame:
    """Write the ids of all rows of `docs` (doc_id, text) in ascending doc_id order; returns the stored manifest of files.

    NULL text counts as empty; a NULL doc_id comes first; rows with the same doc_id keep an order by text. Each row's ids end
    with `end`. An empty table writes no file.
    """
    create_folder(folder)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(vocabulary, word_level)
        writer, uri, task = None, "", TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            if writer is None:
                uri = attempt_name(folder, task, ".tok")
                writer = Writer(uri, width_of(max(library.vocabulary_size, end + 1)))
            ids, lengths = with_end(*library.encode(batch.column("text")), end)
            writer.add(batch.column("doc_id").to_pylist(), lengths, ids)
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict(
                {"range_no": pa.array([task], pa.int32()), "path": [uri], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(written, _MANIFEST), "token-manifest")


def read_token_ids(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = Reader(path)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids, pa.int64(), mask=file.nulls),
                        "start": pa.array(file.starts + base),
                        "n_tokens": pa.array(file.lengths),
                        "ids_crc32": pa.array(file.checksums()),
                    }
                )

    return dealt(based.select("path", "base")).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str, end: int, *, word_level: bool = False, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    manifest = write_token_ids(docs, vocabulary, end, folder or new_folder(spark, "token-ids"), word_level=word_level)
    return read_token_ids(spark, manifest)
