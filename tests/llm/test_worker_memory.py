"""What Python workers hold: they are reused, so what one stage leaves there adds to the next one's memory."""

import ctypes
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from microbook.llm import ngram_join, tokens

_LEFT = """
import re, sys
import pyarrow as pa
from microbook.llm import tokens

def held():
    return sum(map(int, re.findall(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

last = []

def task(batches):
    for batch in batches:
        many = [bytearray(1_000) for _ in range(100_000)]
        last.append(bytearray(1_000))  # above all others, so that the heap cannot shrink from its end
        yield batch

batch = pa.record_batch({"x": [1]})
list(tokens.tidy(lambda batches: batches)([batch]))
before = held()
assert list((tokens.tidy(task) if sys.argv[1] == "tidy" else task)([batch])) == [batch]
print(held() - before)
"""


def _left(how: str) -> float:
    done = subprocess.run([sys.executable, "-c", _LEFT, how], capture_output=True, text=True, check=True, cwd=str(tokens.__file__).rsplit("/", 3)[0])
    return float(done.stdout)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library keeps free memory its own way")
def test_a_task_leaves_no_free_memory_with_its_worker():
    assert _left("plain") > 50  # MB
    assert _left("tidy") < 20


def test_tidy_drops_encoders_of_other_stages():
    batch = pa.record_batch({"doc_id": [1], "text": ["a b"]})
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    kept = tokens.encoder(vocabulary)
    assert list(tokens.tidy(iter, keeps_words=True)([batch])) == [batch] and tokens.encoder(vocabulary) is kept
    assert list(tokens.tidy(iter)([batch])) == [batch] and tokens.encoder(vocabulary) is not kept


def test_words_encoded_in_parts_are_the_words_encoded_at_once(monkeypatch):
    texts = pa.array([" ".join(f"word{k} {k}" for k in range(50)), None, "äö word1  x", "7"])
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")

    def found():
        encoder = tokens.Encoder(vocabulary, with_spans=True)
        return [part.tolist() for part in (*encoder.encode(texts), *encoder.spans(texts))]

    whole = found()
    monkeypatch.setattr(tokens, "_WORDS_AT_ONCE", 7)
    assert found() == whole


def test_a_block_takes_few_times_its_hashes():
    random = np.random.default_rng(5)
    n, size = 100, 20_000
    sets = [np.unique(random.integers(0, 1 << 63, size).astype(np.uint64)) for _ in range(n)]
    copies = (own.copy() for own in sets)
    tracemalloc.start()
    try:
        rows = sum(1 for _ in ngram_join._block_rows(0, list(range(n)), copies, 8))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > n
    assert peak < 5.2 * 8 * n * size, peak / (8 * n * size)
