import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from microbook.llm import resampling as R
from microbook.llm.tables import stored

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, longest=2):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=25, least=20, buckets=10_000, longest=2):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for text in texts for f in runs(text, longest)[1])

    s, t = counts(text for _, text in docs), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, found = runs(text, longest)
        own = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        weight = own // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words), len(found), weight, score, None])
    eligible = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[5] = place
    return sorted(map(tuple, rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def texts(n, seed=3):
    chance = random.Random(seed)
    words = [*"the of And to été straße 東京 x1 9 Zürich naïve a-b".split(), *(f"w{i}" for i in range(60))]
    return [" ".join(chance.choices(words, k=chance.randint(0, 60))) for _ in range(n)]


def compared(spark, docs, target, **options):
    found = R.resample(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_equals_brute_force_with_edge_cases(spark):
    docs = list(enumerate(texts(120)))
    docs += [(500, None), (501, ""), (502, "\x00 \t!?"), (503, "ONE"), (None, texts(1, 9)[0] + " w1" * 30), (504, "é" * 300 + " ü" * 25)]
    docs += [docs[7], docs[7], (7, "other words " * 15)]  # repeated rows, and another text with the same identifier
    assert compared(spark, docs, texts(5, 11)) == brute(docs, texts(5, 11))
    assert compared(spark, docs, [None, ""], percent=60, least_words=0, buckets=64, longest=3) == brute(docs, [], 60, 0, 64, 3)


def test_empty_tables_and_clashing_columns(spark):
    assert compared(spark, [], texts(2)) == []
    target = spark.createDataFrame([("the of and",)], "text string")
    clash = table(spark, list(enumerate(texts(40)))).selectExpr("*", "1 AS score", "2 AS rank", "3 AS id", "4 AS _row", "5 AS n_words", "6 AS _place")
    plain = R.resample(clash.select("doc_id", "text"), target)
    assert sorted(R.resample(clash, target).collect(), key=repr) == sorted(plain.collect(), key=repr)
    drawn = R.resampled_documents(clash, target)
    assert drawn.columns == clash.columns and drawn.count() == plain.where("rank IS NOT NULL").count() > 0


def test_long_texts_are_cut_into_parts_without_losing_runs(spark, monkeypatch):
    monkeypatch.setattr(R, "_SLICE_BYTES", 50)
    for longest in (1, 2, 3):
        text = texts(1, 5)[0] * 20
        found = Counter()
        n_words = n_runs = 0
        for owner, n, bucket in R.Runs(997, longest)([text]):
            n_words, n_runs = n_words + int(n.sum()), n_runs + len(owner)
            found.update(bucket.tolist())
        words, expected = runs(text, longest)
        assert (n_words, n_runs) == (len(words), len(expected))
        assert found == Counter(zlib.crc32(f.encode()) % 997 for f in expected)


def test_checksums_of_joined_texts():
    chance = random.Random(1)
    heads, tails = ([chance.randbytes(chance.choice((0, 1, 5, 300, 70_000))) for _ in range(40)] for _ in range(2))
    sums = R._appended(
        np.array([zlib.crc32(x) for x in heads], np.uint32), np.array([zlib.crc32(x) for x in tails], np.uint32), np.array([len(x) for x in tails])
    )
    assert sums.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


@pytest.mark.parametrize("spread", [3, 10**9])
def test_cutoff_is_the_wanted_key(spark, monkeypatch, spread):
    """Few scores mean many ties; a third of all keys is one and the same."""
    monkeypatch.setattr(R, "_FINISH", 10)
    chance = random.Random(spread)
    rows = [(chance.randrange(spread), chance.randrange(400)) for _ in range(2_000)] + [(1, 77)] * 1_000
    keys = stored(spark.createDataFrame(rows, "score bigint, id bigint").repartition(7), "keys")
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    for wanted in (1, 2, 499, 1_500, 2_999, 3_000):
        assert R.cutoff(keys, wanted) == ordered[wanted - 1]
    assert R.cutoff(keys, 3_001) is None and R.cutoff(keys, 0) is None


def test_rounds_discard_a_guaranteed_share(spark, monkeypatch):
    """A pivot has at least a quarter of all rows on either side (up to block medians), so rounds grow with the logarithm."""
    monkeypatch.setattr(R, "_FINISH", 10)
    rounds = []
    plain = R._medians
    monkeypatch.setattr(R, "_medians", lambda *args: rounds.append(1) or plain(*args))
    keys = stored(spark.range(20_000).select((F.col("id") * 7919 % 10_007).alias("score"), "id"), "keys")
    R.cutoff(keys, 5_000)
    assert len(rounds) <= 2 + math.log(20_000 / 10) / math.log(8 / 7)


def test_query_on_a_table(spark, sf):
    from microbook.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    found = queries.op11_resampling(spark, sf)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in brute(docs, target)), key=repr)
