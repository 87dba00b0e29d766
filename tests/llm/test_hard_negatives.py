import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from microbook.llm import hard_negatives as H
from microbook.llm import queries

KIND = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchor, positives=5, negatives=5, percent=80, scale=256):
    def usable(r):
        return None not in r and all(x is not None and math.isfinite(x) for x in r[1])

    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if usable((i, v, label))]
    out = []

    def score(a, b):
        return max(-H._LARGEST, min(H._LARGEST, sum(x * y for x, y in zip(a, b))))

    for i, v, label in kept:
        if not anchor(i):
            continue
        scored = [(-score(v, w), j, other) for j, w, other in kept]
        near = sorted((s, j) for s, j, other in scored if other == label and j != i)[:positives]
        far = sorted((s, j) for s, j, other in scored if other != label)
        for p, j in near:
            fits = [(s, k) for s, k in far if percent * -p <= 100 * -s <= 100 * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, dim, labels, seed=1, spread=0.6):
    chance = random.Random(seed)
    centres = [[chance.gauss(0, 0.3) for _ in range(dim)] for _ in range(3)]
    return [(i, [c + chance.gauss(0, spread * 0.3) for c in chance.choice(centres)], chance.randrange(labels)) for i in range(n)]


def found(spark, rows, every=10, **options):
    table = spark.createDataFrame(rows, KIND)
    return sorted(tuple(r) for r in H.mine(table, F.col("vec_id") % every == 0, **options).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(H, "_BLOCK_COMPONENTS", 1)  # 64 vectors a block
    monkeypatch.setattr(H, "_AT_ONCE", 20)


def test_equals_brute_force_across_blocks(spark, small_blocks):
    rows = [(i, v, 0 if i % 3 == 0 else label) for i, v, label in vectors(400, 20, 5)]  # one label holds more than a third
    expected = brute(rows, lambda i: i % 10 == 0)
    assert len(expected) > 300 and found(spark, rows) == expected
    assert found(spark, rows, positives=2, negatives=7, percent=50, scale=16) == brute(rows, lambda i: i % 10 == 0, 2, 7, 50, 16)


def test_ties_repeated_rows_and_rows_that_take_no_part(spark, small_blocks):
    chance = random.Random(8)
    rows = [(i, [float(chance.randrange(3)) for _ in range(6)], chance.randrange(3)) for i in range(150)]
    rows += [rows[0], rows[0], rows[11], (10, [2.0] * 6, 1), (10, [2.0] * 6, 2)]
    rows += [(None, [1.0] * 6, 1), (200, None, 1), (201, [1.0] * 6, None), (202, [1.0, None], 1), (203, [math.nan] * 6, 1), (210, [math.inf, 1.0], 1)]
    rows += [(220, [], 1), (230, [1.0, 2.0], 2), (231, [1.0] * 40, 1)]  # other lengths
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_large_components_stay_exact(spark):
    for size in (2.0**22, 1e300):
        chance = random.Random(size)
        rows = [(i, [chance.uniform(-1, 2) * size for _ in range(5)], i % 3) for i in range(60)]
        assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0), size


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1.0], 1)]) == []
    rows = vectors(120, 8, 4)
    clash = spark.createDataFrame(rows, KIND).selectExpr("*", "1 AS place", "2 AS nth", "3 AS id", "4 AS block", "5 AS score", "true AS anchor", "1 AS vector")
    assert sorted(tuple(r) for r in H.mine(clash, F.col("vec_id") % 10 == 0).collect()) == brute(rows, lambda i: i % 10 == 0)


def test_summaries_bound_every_product_and_drop_most_pairs():
    chance = np.random.default_rng(3)
    base = chance.normal(size=(20, 64)) * 60
    v = np.floor(base[chance.integers(0, 20, 400)] + chance.normal(size=(400, 64)) * 4)
    block = H.Block(np.arange(400), np.zeros(400, np.int64), v, *H.summaries(v))
    products = v @ v.T
    for number in range(len(H.LEVELS)):
        means, deviations = block.level(number)
        middle, reach = means @ means.T, deviations @ deviations.T
        assert (np.abs(products - middle) <= reach + 1e-6).all()
    assert (middle + reach < np.quantile(products, 0.95)).mean() > 0.3


def test_lowest_score_of_a_window():
    scores = np.array([0, 1, 4, 5, 99, 100, 101, 12345, (1 << 62) + 7], np.int64)
    assert H.lowest(scores, 80).tolist() == [-(-80 * int(s) // 100) for s in scores]


def test_query_on_a_table(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        rows.append((r[0], r[1], (r[2] + 1) % 10 if r[0] % 7 == 0 and r[2] is not None else r[2]))
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf).collect()) == brute(rows, lambda i: i % 100 == 0)
