"""Token ids of whole texts from the `tokenizers` library, each distinct word encoded once per Python worker.

A text is cut at single spaces; a word keeps the space before it, as the vocabularies' own word patterns do, so the ids of a text
are the ids of its words one after the other (`tests/llm/test_tokens_and_packing.py` holds this against the library). A text that holds
the literal of a token that was added to the vocabulary, such as an end mark, goes to the library whole. Arrow finds the distinct
words of a batch, the library encodes those that the worker has not met, numpy puts the ids in place.
"""

import ctypes
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space beside a space: there the byte-level pattern looks beyond the word, and the library gets the whole text.
_BESIDE_SPACE = "[\\s\\pZ\\x{85}\\x{1c}-\\x{1f}\\x{0b}] | [\\s\\pZ\\x{85}\\x{1c}-\\x{1f}\\x{0b}]|^ | $"
#: Words that a worker keeps, about 200 bytes each; beyond it words are encoded as they come and forgotten with their batch.
WORDS_KEPT = 400_000
#: Text that is encoded at once; numpy holds some forty times as much meanwhile.
SLICE_BYTES = 1 << 20
#: Words that the library encodes at once; each takes about a kilobyte until its ids are taken over.
_WORDS_AT_ONCE = 8_192


def slices(batches, column: str, most: int = SLICE_BYTES, most_rows: int = 1 << 31):
    """The batches cut so that the texts of one slice have up to `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            upto = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, done + most, side="right"))))
            yield batch.slice(at, upto - at)
            at, done = upto, int(ends[upto - 1])


def give_back() -> None:
    """Hand memory that is free, but still held by the allocators, back to the system. Workers are reused, so it would stay with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not with every C library
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, keeps_words: bool = False):
    """`task` for mapInArrow, after which its worker holds no more than before; only `keeps_words` leaves encoders to later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps_words:
            forget()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def tidy_group(task: Callable[[pa.Table], pa.Table]):
    """The same for applyInArrow."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        try:
            return task(table)
        finally:
            give_back()

    return run


class Encoder:
    """`vocabulary`: path of a tokenizers file. `word_level`: white space never gets into a token and case does not count."""

    def __init__(self, vocabulary: str, *, word_level: bool = False, words_kept: int = WORDS_KEPT, with_spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(vocabulary)
        added = [re.escape(token.content) for token in self._library.get_added_tokens_decoder().values()]
        self._added = f"(?i){'|'.join(added)}" if added else None
        self._word_level, self._words_kept, self._with_spans = word_level, words_kept, with_spans
        self._known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._spans = np.zeros((1 << 16, 2), np.int32)  # characters of each id, from the begin of its word
        self._begin, self._length, self._words = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self._kept = 0, 0  # words and ids that stay

    @property
    def vocabulary_size(self) -> int:
        return self._library.get_vocab_size(with_added_tokens=True)

    def _learn(self, words: list[str], before: str) -> int:
        """Put the ids of `words` behind those there are; returns the first one's number."""
        encode = self._library.encode_batch if self._with_spans else self._library.encode_batch_fast  # the fast one keeps no offsets
        ids, offsets = [], []
        for at in range(0, len(words), _WORDS_AT_ONCE):
            found = encode([before + w for w in words[at : at + _WORDS_AT_ONCE]], add_special_tokens=False)
            ids += [e.ids for e in found]
            if self._with_spans:
                offsets += [e.offsets for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        while self._used + total > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            self._spans = np.concatenate([self._spans, np.zeros_like(self._spans)])
        while self._words + len(words) > len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
        self._ids[self._used : self._used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        if self._with_spans:
            spans = chain.from_iterable(chain.from_iterable(offsets))
            self._spans[self._used : self._used + total] = np.fromiter(spans, np.int32, 2 * total).reshape(-1, 2)
        first = self._words
        span = slice(first, first + len(words))
        self._begin[span] = self._used + np.cumsum(lengths) - lengths
        self._length[span] = lengths
        self._used, self._words = self._used + total, first + len(words)
        return first

    def _entries(self, words: pa.Array, head: bool) -> np.ndarray:
        """Where the ids of each word are. Words met once the table is full stay only until the next texts."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        known = self._known[head]
        at = list(map(known.get, names))
        missing = [k for k, number in enumerate(at) if number is None]
        if missing:
            new = [names[k] for k in missing]
            first = self._learn(new, "" if head or self._word_level else " ")
            for number, k in enumerate(missing, first):
                at[k] = number
            if first == self._kept[0] and first < self._words_kept:
                known.update(zip(new, range(first, self._words), strict=True))
                self._kept = self._words, self._used
        return np.array(at, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each; NULL is an empty text."""
        texts = whole_texts = pc.fill_null(texts, "")
        self._words, self._used = self._kept
        odd = np.zeros(len(texts), bool)
        if self._added:  # the library cuts a text at the vocabulary's added tokens before anything else
            odd |= pc.match_substring_regex(texts, self._added).to_numpy(zero_copy_only=False)
        if self._word_level:
            texts = pc.ascii_lower(texts)
        else:
            odd |= pc.match_substring_regex(texts, _BESIDE_SPACE).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._by_words(texts)
        ids, lengths = self._by_words(pc.if_else(pa.array(odd), "", texts))
        rows = np.flatnonzero(odd)
        whole = [np.array(e.ids, np.uint32) for e in self._library.encode_batch_fast(whole_texts.take(pa.array(rows)).to_pylist(), add_special_tokens=False)]
        at = np.cumsum(lengths)
        parts, done = [], 0
        for row, own in zip(rows, whole, strict=True):
            parts += [ids[done : at[row]], own]
            done = at[row]
            lengths[row] = len(own)
        return np.concatenate([*parts, ids[done:]]), lengths

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in characters of all tokens of all texts, and the number of tokens of each; only `with_spans`, not for `word_level`."""
        texts = pc.fill_null(texts, "")
        self._words, self._used = self._kept
        odd = pc.match_substring_regex(texts, _BESIDE_SPACE).to_numpy(zero_copy_only=False)
        if self._added:
            odd |= pc.match_substring_regex(texts, self._added).to_numpy(zero_copy_only=False)
        found, lengths = self._by_words(pc.if_else(pa.array(odd), "", texts), spans=True)
        parts, done, at = [], 0, np.cumsum(lengths)
        for row in np.flatnonzero(odd):
            own = self._library.encode_batch([texts[int(row)].as_py()], add_special_tokens=False)[0].offsets
            parts += [found[done : at[row]], np.array(own, np.int64).reshape(-1, 2)]
            done, lengths[row] = at[row], len(own)
        return np.concatenate([*parts, found[done:]]), lengths

    def _by_words(self, texts: pa.Array, spans: bool = False) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten()
        ends = ends - ends[0]
        if len(words) == 0:
            return np.zeros((0, 2), np.int64) if spans else np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        entries = self._entries(words, False)
        if not self._word_level:
            heads = ends[:-1][ends[1:] > ends[:-1]]
            entries[heads] = self._entries(words.take(pa.array(heads)), True)
        lengths = self._length[entries]
        after = np.cumsum(lengths)
        places = np.arange(after[-1]) + np.repeat(self._begin[entries] - (after - lengths), lengths)
        per_text = np.diff(np.concatenate([[0], after])[ends])
        if not spans:
            return self._ids[places], per_text
        # A word begins with the space before it, the first one of a text without.
        n_chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        before = np.cumsum(n_chars) - n_chars
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        first = ends[:-1][text]
        begin = before - before[first] - (np.arange(len(words)) > first)
        return self._spans[places].astype(np.int64) + np.repeat(begin, lengths)[:, None], per_text


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, word_level: bool = False, with_spans: bool = False) -> Encoder:
    """One per Python worker, so that words met by earlier tasks are known."""
    key = (vocabulary, word_level, with_spans)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, word_level=word_level, with_spans=with_spans)
    return _ENCODERS[key]


def forget() -> None:
    """Drop the encoders that earlier tasks have left in this worker."""
    _ENCODERS.clear()


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id `end` put after the ids of each text."""
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1
