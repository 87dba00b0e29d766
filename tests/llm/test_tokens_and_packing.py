import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from microbook.llm import packing as K
from microbook.llm import token_counts as C
from microbook.llm import token_ids as T
from microbook.llm.tokens import Encoder, slices, with_end

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a ", " a", "a  b", "x\n y", "x \n", "tab\tx y", "a  b", "　x y", "it's we'll 's x", "<|endoftext|> hi",
    "hello <|endoftext|> world <|endoftext|>x", "A<|ENDOFTEXT|>B <|StartOfText|>", "<|startoftext|>One  two<|endoftext|>", "x <|endoftext |>",
    "Å İstanbul K ́x 12 345,,..!! ß ΣΑΣ Σ x", "d.,e f\x0b g\x1c h \x85i", "\U0001f600 \U0001f600\U0001f600",
]
EXTRA = "doc_id bigint, text string, key string, length string, nth string, start string"


def library(path):
    return Tokenizer.from_file(path)


def ids_of(path, texts):
    return [e.ids for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab Z'.,\n\t é1  ́s") for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize(("path", "word_level"), [(BYTES, False), (WORDS, True)])
@pytest.mark.parametrize("words_kept", [10, 100_000])
def test_encoder_gives_the_library_s_ids(path, word_level, words_kept):
    encoder = Encoder(path, word_level=word_level, words_kept=words_kept)
    for texts in (ODD + random_texts(1500), ["the same words again and again"] * 3, [], random_texts(500, 2)):
        ids, lengths = encoder.encode(pa.array(texts, pa.string()))
        assert np.split(ids, np.cumsum(lengths)[:-1])[: len(texts)] == [] or [
            x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])
        ] == ids_of(path, texts)


@pytest.mark.parametrize("words_kept", [10, 100_000])
def test_spans_are_the_library_s(words_kept):
    encoder = Encoder(BYTES, words_kept=words_kept, with_spans=True)
    for texts in (ODD + random_texts(1500), ["the same  words é again"] * 3 + [""], random_texts(500, 2), [None]):
        spans, lengths = encoder.spans(pa.array(texts, pa.string()))
        found = [x.tolist() for x in np.split(spans, np.cumsum(lengths)[:-1])]
        assert found == [[list(o) for o in e.offsets] for e in library(BYTES).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 100, 3, 3, 3)] + [None]})
    parts = list(slices([batch], "text", 6))
    assert [r for p in parts for r in p.column("text").to_pylist()] == batch.column("text").to_pylist() and len(parts) > 3
    assert max(p.num_rows for p in slices([batch], "text", 1000, 2)) == 2
    ids, lengths = with_end(np.array([7, 8], np.uint32), np.array([0, 2, 0]), 9)
    assert ids.tolist() == [9, 7, 8, 9, 9] and lengths.tolist() == [1, 3, 1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_length_as_often_as_it_occurs(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([8, 20, 64, 256]))
    histogram = {int(n): int(rng.integers(1, 200)) for n in rng.choice(np.arange(1, size + 1), rng.integers(0, min(size, 30)), replace=False)}
    used, sequences = {}, 0
    for repeats, parts in K.plan(histogram, size):
        assert repeats > 0 and sum(a * b for a, b in parts) <= size
        sequences += repeats
        for length, times in parts:
            used[length] = used.get(length, 0) + repeats * times
    assert used == histogram
    assert sequences <= 1.5 * sum(a * b for a, b in histogram.items()) / size + 1


def test_plan_is_near_the_lower_bound():
    lengths = np.minimum(2047, np.random.default_rng(5).lognormal(6, 1, 20_000).astype(int) + 1)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert sum(p.repeats for p in K.plan(histogram)) <= 1.01 * -(-lengths.sum() // 2048)


def check_packing(rows, docs, size):
    want = sorted((d, k, start, n, crc(ids[start : start + n])) for d, ids in docs for k, (start, n) in enumerate(K.cut(len(ids), size)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(places)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice(["cat", "dog", "xyzzy"]) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(150)]
    rows = [(i % 140, t, "k", "l", "n", "s") for i, t in enumerate(texts)] + [(7, None, "", "", "", "")] * 40  # repeated rows and ids
    size = 32
    cut = K.stored_pieces(spark.createDataFrame(rows, EXTRA), BYTES, size=size)
    placed = K.place(cut.drop("ids"), size=size, chunk_pieces=7).drop("key").collect()
    docs = [(r[0], ids + [0]) for r, ids in zip(rows, ids_of(BYTES, [r[1] for r in rows]), strict=True)]
    n = check_packing(placed, docs, size)
    assert n <= 1.05 * sum(len(ids) for _, ids in docs) / size + 1
    sequences = K.sequences(cut, size=size).collect()
    assert len(sequences) == n and sum(s.n_tokens for s in sequences) == sum(len(ids) for _, ids in docs)
    assert sorted(i for s in sequences for i in np.frombuffer(s.ids, "<u2").tolist()) == sorted(i for _, ids in docs for i in ids)


def test_packing_of_nothing_and_of_a_very_long_text(spark):
    assert K.pack(spark.createDataFrame([], "doc_id bigint, text string"), BYTES).collect() == []
    long = "word and more " * 30_000
    rows = K.pack(spark.createDataFrame([(1, long), (None, "x")], "doc_id bigint, text string"), BYTES).collect()
    ids = ids_of(BYTES, [long])[0] + [0]
    assert sorted(r.start for r in rows if r.doc_id == 1) == [s for s, _ in K.cut(len(ids), 2048)]
    assert sum(r.doc_id is None for r in rows) == 1


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 20, 32])
def test_bits_round_trip(width):
    for n in (0, 1, 5, 8, 9, 1000):
        ids = np.random.default_rng(n).integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        packed = T.pack_bits(ids, width)
        assert len(packed) == -(-n * width // 8) and (T.unpack_bits(packed, n, width) == ids).all()
    assert (T.width_of(49_408), T.width_of(2), T.width_of(65_537)) == (16, 1, 17)


def test_token_files_round_trip(spark, tmp_path):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD + random_texts(400))] + [(5, "same"), (5, "same"), (None, "no id"), (200, "long text " * 40_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, start string, n_tokens int").repartition(4)
    manifest = T.write_token_ids(df, WORDS, 2, str(tmp_path / "ids"), word_level=True)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read_token_ids(spark, manifest).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want, flat = 0, [], []
    for (d, _), ids in zip(ordered, ids_of(WORDS, [t for _, t in ordered]), strict=True):
        want.append((at, d, len(ids) + 1, crc(ids + [2])))
        at += len(ids) + 1
        flat += ids + [2]
    assert got == want
    base = 0
    for row in manifest.orderBy("range_no").collect():  # random access
        reader = T.Reader(row.path)
        for start, n in ((0, 5), (reader.n_ids // 2, 7), (reader.n_ids - 1, 1), (3, 0), (0, reader.n_ids)):
            assert reader.ids(start, n).tolist() == flat[base + start : base + min(start + n, reader.n_ids)]
        base += reader.n_ids
    assert T.round_trip(df.limit(0), WORDS, 2, word_level=True).collect() == []


def test_a_cut_off_file_is_refused(tmp_path):
    writer = T.Writer(str(tmp_path / "a.tok"), 16)
    writer.add([1], np.array([3]), np.array([1, 2, 3], np.uint32))
    writer.close()
    data = (tmp_path / "a.tok").read_bytes()
    (tmp_path / "b.tok").write_bytes(data[:-3])
    with pytest.raises(ValueError, match="not a whole file"):
        T.Reader(str(tmp_path / "b.tok"))


def counts_by_hand(text, separator="\n"):
    """Each token goes to the section that has most of its characters, looked at one character at a time."""
    text = text or ""
    section, of = 0, []
    for c in text:
        of.append(section)
        section += c == separator
    n = (of[-1] + 1) if of else 1
    out = [0] * n
    for a, b in library(BYTES).encode(text, add_special_tokens=False).offsets:
        inside = of[a:b] or [of[min(a, len(of) - 1)]]
        out[max(sorted(set(inside)), key=lambda s: (inside.count(s), -s))] += 1
    return out


def test_token_counts_by_section(spark):
    rows = list(enumerate(ODD + random_texts(300) + ["a\n\n\n\nb\n", "\n", "x" * 50_000 + "\n" + "y " * 9]))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id bigint, text string, section int")
    got = {}
    for r in C.token_counts(df, BYTES).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.begin, r.n_chars, r.n_tokens)
    for d, text in rows:
        parts = [got[d][k] for k in range(len(got[d]))]
        assert [p[2] for p in parts] == counts_by_hand(text), text
        assert [p[0] for p in parts] == [sum(p[1] for p in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == len(text or "")
    assert C.token_counts(df.limit(0), BYTES).collect() == []


def test_tokens_across_a_border_go_where_most_of_them_is():
    ends = np.array([4, 6, 10])
    begin, end = np.array([0, 3, 3, 2, 5, 9, 4]), np.array([4, 5, 6, 6, 9, 12, 4])
    assert C.allocate(begin, end, ends).tolist() == [0, 0, 1, 0, 2, 2, 1]


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "A title", "the body"), (2, None, "only"), (3, "", None)], "page_id bigint, title string, body string")
    rows = {(r.page_id, r.field): r.n_tokens for r in C.field_token_counts(df, BYTES, ["title", "body"], id_column="page_id").collect()}
    whole = dict(zip((1, 2, 3), map(len, ids_of(BYTES, ["A title\nthe body", "\nonly", "\n"])), strict=True))
    assert {p: rows[p, "title"] + rows[p, "body"] for p in whole} == whole
