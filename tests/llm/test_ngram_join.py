import random
import re

import numpy as np
import pytest

from microbook.llm import ngram_join as J
from microbook.llm.graph import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = {doc_id: shingles(text) for doc_id, text in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def rows_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def changed(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Texts of all sizes around the light-heavy border, edits of them, shared passages, and edge cases."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "One", "one two", "one two three four", "ONE two\nthree  four", "a b c d e", "a b c d e f"]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice([5, 6, 8, 9, 10, 12, 14, 16, 18, 22, 40, 90]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            texts.append(rng.choice([" ", "\n"]).join(changed(rng, words, rng.randrange(0, 3))))
        if rng.random() < 0.3:
            texts.append(" ".join(words[: rng.randrange(1, len(words))]))
        if rng.random() < 0.3:
            texts.append(" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 20, 60]))]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    assert rows_of(J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_force(rows)


@pytest.mark.parametrize("boundary", [0, 3, 8, 12])
def test_any_boundary_gives_the_same(spark, monkeypatch, boundary):
    rows = corpus(3)
    monkeypatch.setattr(J, "light_boundary", lambda *_: boundary)
    monkeypatch.setattr(J, "FREQUENT_IN_BLOCK", 3)
    assert rows_of(J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))) == brute_force(rows)


def test_group_of_near_copies_is_one_component(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(changed(rng, words, 1))) for i in range(120)] + [(500 + i, f"other text number {i} of its own kind") for i in range(30)]
    assert rows_of(J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_force(rows)


def test_empty_table_and_other_columns(spark):
    schema = "doc_id bigint, text string, n bigint, rep string, component string"
    assert J.similar_documents(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(2, "x y", 7, "r", "c"), (1, "X y", 8, "r", "c"), (None, None, None, None, None)], schema)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.similar_documents(df).collect()}
    assert got == {(1, 1, 1), (2, 1, 1), (None, 0, None)}
    assert J.keep_one(df.where("doc_id IS NOT NULL")).columns == df.columns


def test_very_long_text(spark):
    long = " ".join(f"w{i % 7001}x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short")]
    assert [r[2] for r in rows_of(J.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")))] == [1, 1, 3]


def test_planes_and_prefix():
    for kind in ("<u2", "<u4", "<u8"):
        values = np.random.default_rng(0).integers(0, 1 << 15, 100).astype(kind)
        assert (J._from_planes(J._planes(values), kind) == values).all()
    n = np.arange(1, 200)
    assert (J._prefix(n) == n - np.ceil(0.8 * n - 1e-9) + 1).all()
    for a in range(1, 60):
        for b in range(1, 60):
            assert J._least_shared(a, b) == min(o for o in range(a + b + 1) if 180 * o >= 80 * (a + b))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
