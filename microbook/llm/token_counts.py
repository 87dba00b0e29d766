"""Token counts per section, from one encoding of the whole text.

Encoding sections one by one gives other tokens than the text has. Here a document is encoded once; the character span of each
token is matched against the sections' intervals (both are sorted, so it is a merge by binary search), and each token counts for
exactly one section. Spans come from the words of the text, each distinct one encoded once per worker (`tokens.py`). The rule for a token that crosses a boundary: the section that has most of its characters gets it, the
earlier one if they have equally many. The counts of a document's sections therefore sum to its tokens.

One pass, no shuffle.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microbook.llm.tokens import encoder, slices

#: Text whose tokens a task holds at once, some hundred bytes each.
SLICE_BYTES = 1 << 20


def allocate(begin: np.ndarray, end: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The section of each token span [begin, end); section k reaches from ends[k - 1] (or 0) to ends[k]. A token without
    characters belongs where it begins; what lies behind the last section belongs to it."""
    last = len(ends) - 1
    first = np.minimum(np.searchsorted(ends, begin, side="right"), last)
    final = np.minimum(np.searchsorted(ends, np.maximum(end - 1, begin), side="right"), last)
    section = first.copy()
    pairs = np.flatnonzero(final == first + 1)  # one border inside, by far the most
    section[pairs] += end[pairs] - ends[first[pairs]] > ends[first[pairs]] - begin[pairs]
    for at in np.flatnonzero(final > first + 1).tolist():
        borders = np.clip(np.concatenate([[begin[at]], ends[first[at] : final[at]], [end[at]]]), begin[at], end[at])
        section[at] = first[at] + int(np.argmax(np.diff(borders)))
    return section


def section_ends(text: str, separator: str) -> np.ndarray:
    """Ends of the sections that a one-character separator makes; the separator belongs to the section before it."""
    characters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = np.flatnonzero(characters == ord(separator)) + 1
    return cuts if len(cuts) and cuts[-1] == len(characters) else np.append(cuts, len(characters))


def token_counts(docs: DataFrame, vocabulary: str, *, id_column: str = "doc_id", separator: str = "\n", ends: Column | None = None) -> DataFrame:
    """One row per section of each row of `docs` (id, text): id, section (from 0), begin, n_chars, n_tokens.

    Sections are what lies between separators, or, with `ends`, the ascending character offsets of an array<int> column. A NULL or
    empty text is one empty section without tokens. Rows with the same id are documents of their own.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (ends if ends is not None else F.lit(None)).cast("array<int>").alias("ends")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(vocabulary, with_spans=True)
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = batch.column("text").to_pylist()
            every, lengths = library.spans(batch.column("text"))
            stops = np.cumsum(lengths)
            ids, columns = batch.column("id").to_pylist(), ([], [], [], [])
            out_ids, sizes = [], []
            for doc_id, text, own, start, stop in zip(ids, texts, batch.column("ends"), stops - lengths, stops, strict=True):
                borders = np.array(own.as_py(), np.int64) if own.is_valid else section_ends(text, separator)
                if not len(borders):
                    borders = np.array([len(text)])
                spans = every[start:stop]
                tokens = np.bincount(allocate(spans[:, 0], spans[:, 1], borders), minlength=len(borders))
                begin = np.concatenate([[0], borders[:-1]])
                for column, value in zip(columns, (np.arange(len(borders)), begin, borders - begin, tokens), strict=True):
                    column.append(value)
                out_ids.append(doc_id)
                sizes.append(len(borders))
            at = pa.array(np.repeat(np.arange(len(out_ids)), sizes))
            made = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()).take(at), *made], ["id", "section", "begin", "n_chars", "n_tokens"])

    out = rows.mapInArrow(counted, "id bigint, section bigint, begin bigint, n_chars bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_column)


def field_token_counts(rows: DataFrame, vocabulary: str, fields: Sequence[str], *, id_column: str, joiner: str = "\n") -> DataFrame:
    """Tokens of each field in the text that the fields make when joined: id, field, n_chars, n_tokens. A NULL field is empty; the joiner
    belongs to the field before it."""
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(joiner if k < len(fields) - 1 else "")) for k, f in enumerate(fields)]
    ends = F.array(*[sum((F.length(p) for p in parts[1 : k + 1]), F.length(parts[0])).cast("int") for k in range(len(fields))])
    whole = rows.select(F.col(id_column), F.concat(*parts).alias("text"), ends.alias("ends"))
    found = token_counts(whole, vocabulary, id_column=id_column, ends=F.col("ends"))
    names = F.array(*[F.lit(f) for f in fields])
    return found.select(id_column, F.get(names, F.col("section").cast("int")).alias("field"), "n_chars", "n_tokens")
