import hashlib
import random

import pytest
from pyspark.sql import functions as F

from microbook.llm import exact_dedup as D
from microbook.llm import licenses as L
from microbook.llm import mixing as M
from microbook.llm.tables import new_folder, stored


def level_by_rounds(sizes, weights, total, most):
    """Share by weight, cap, share the excess again until nothing is above a cap."""
    targets, open_ones = {}, dict(sizes)
    while open_ones:
        left = total - sum(targets.values())
        share = {s: left * weights[s] / sum(weights[t] for t in open_ones) for s in open_ones}
        over = [s for s in open_ones if share[s] > most * sizes[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = most * sizes[s]
            del open_ones[s]
    return targets


def documents(spark, seed=1, n=900):
    rng = random.Random(seed)
    names = [None, "a", "b", "c", "d", "zé", "zz", ""]
    rows = []
    for i in range(n):
        source = "a" if rng.random() < 0.35 else rng.choice(names)
        words = rng.choice([0, 1, 5, 40, 40, 300 if source != "b" else 2])
        rows.append((i, None if rng.random() < 0.02 else " \t".join("w" for _ in range(words)), source, 1, "x"))
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int, place string")


@pytest.mark.parametrize("chunk_rows", [13, 100_000])
def test_mix_meets_its_targets(spark, chunk_rows):
    rows, df = documents(spark)
    got = {r.doc_id: r for r in M.mix(df, chunk_rows=chunk_rows).collect()}
    assert len(got) == len(rows)
    size = {d: len((t or "").split()) for d, t, *_ in rows}
    sizes = {}
    for d, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = level_by_rounds(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    taken = dict.fromkeys(sizes, 0)
    for d, _, s, *_ in rows:
        r = got[d]
        assert (r.size, r.source_size) == (size[d], sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] <= want[s] + 1e-6 and want[s] - taken[s] <= 5 + 0.01 * want[s]
    again = {r.doc_id: r.taken for r in M.mix(df.repartition(7), chunk_rows=50).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_preference_makes_inclusion_unequal(spark):
    df = spark.createDataFrame([(i, "one two", "s" if i % 2 else "t", float(1 + 9 * (i % 4 == 1))) for i in range(4000)], "doc_id bigint, text string, source string, q double")
    rows = M.mix(df, share=0.3, preference=F.col("q")).collect()
    rate = [sum(r.copies > 0 for r in rows if r.source == "s" and (r.doc_id % 4 == 1) == liked) for liked in (False, True)]
    assert rate[1] > 1.5 * rate[0] > 0


def test_mixed_documents_repeat_rows(spark):
    rows, df = documents(spark, 2, 300)
    copies = {r.doc_id: r.copies for r in M.mix(df).collect()}
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    seen = {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: c for d, c in copies.items() if c}


def test_mix_edge_cases(spark):
    schema = "doc_id bigint, text string, source string"
    assert M.mix(spark.createDataFrame([], schema)).collect() == []
    none = M.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2
    tied = M.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")], schema)).collect()
    assert len(tied) == 3 and all(r.taken <= 2 * r.size for r in tied)


TEXTS = ["same", "same", "Same", " same", "", None, "x" * 200_000, "x" * 200_000, "x" * 199_999 + "y", "u1", "u2"] + ["hot"] * 50


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup_is_exact_even_if_digests_clash(spark, digest_bytes):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS + [f"t{i}" for i in range(300)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string, n int").repartition(3)
    got = {r.doc_id: r for r in D.exact_dedup(df, digest_bytes=digest_bytes).collect()}
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(t or "", []).append(d)
    assert len(got) == len(rows)
    for d, t, *_ in rows:
        group = groups[t or ""]
        want = (max(group), len(group), d == max(group), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == want


def test_state_goes_on_with_new_rows(spark):
    schema = "digest binary, doc_id bigint, locator string"
    path, state = new_folder(spark, "test-feed"), new_folder(spark, "test-state")
    first = spark.createDataFrame([(b"a", 1, "p"), (b"b", 9, "q"), (b"a", 3, "r")], schema)
    first.write.parquet(path)
    kept = {bytes(r.digest): (r.keeper.doc_id, r.keeper.locator, r.n) for r in D.ingest(path, first, state, files_per_batch=1).collect()}
    assert kept == {b"a": (3, "r", 2), b"b": (9, "q", 1)}
    spark.createDataFrame([(b"a", 2, "s"), (b"c", 4, "t"), (b"b", 10, "u")], schema).write.mode("append").parquet(path)
    kept = {bytes(r.digest): (r.keeper.doc_id, r.keeper.locator, r.n) for r in D.ingest(path, first, state).collect()}
    assert kept == {b"a": (3, "r", 3), b"b": (10, "u", 2), b"c": (4, "t", 1)}  # each row once


def test_dedup_of_repeated_rows_and_of_nothing(spark):
    schema = "doc_id bigint, text string, locator string"
    assert D.exact_dedup(spark.createDataFrame([], schema)).collect() == []
    df = stored(spark.createDataFrame([(1, "a", "l"), (1, "a", "l"), (None, "a", "l"), (None, "b", "l")], schema), "test-dedup")
    assert sorted(r.text for r in D.keep_one(df, locator=D.parquet_locator()).collect()) == ["a", "b"]


def test_licenses(spark):
    mit = next(t for n, t in L.KNOWN if n == "MIT" and len(t) > 500)
    rows = [
        (1, "MIT LICENCE\nCopyright (c) 2020 Jane Doe\n\n" + mit[len("MIT License\n\n") :].replace("sublicense", "sub-licence").replace('"', "”")),
        (2, "Some prose.\nReleased under the MIT   License\nlicensed under CC BY-NC 4.0"),
        (3, None),
        (4, ""),
        (5, "The MIT License is mentioned here. Released under the MIT License."),
        (6, "prose " * 50_000 + "\nLicensed under the Apache License, Version 2.0."),
        (7, mit + " And a rider."),
        (8, "Released under the MIT License."),
        (None, "Released under the MIT License."),
    ]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(d, t, "d", "l") for d, t in rows], "doc_id bigint, text string, digest string, license_id string")).collect()}
    assert {d: (r.license_id, r.n_license_lines, r.line_license_ids) for d, r in got.items()} == {
        1: ("MIT", 0, None),
        2: (None, 2, "CC-BY-NC-4.0,MIT"),
        3: (None, 0, None),
        4: (None, 0, None),
        5: (None, 0, None),
        6: (None, 1, "Apache-2.0"),
        7: (None, 0, None),
        8: ("MIT", 1, "MIT"),
        None: ("MIT", 1, "MIT"),
    }
    assert got[3].text_digest == got[4].text_digest == hashlib.sha256(b"").hexdigest()
    assert L.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_helper_names_do_not_clash_with_columns(spark):
    rows = [(i, "same words here" if i % 3 == 0 else f"text number {i}", "a", i) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, extra int").selectExpr(
        "doc_id", "text", "source", "extra AS _id", "extra AS _copies", "extra AS _COPY", "extra AS _locator"
    )
    kept = D.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._locator) for r in kept.collect()) == [(i, i) for i in range(12) if i % 3 or i == 9]
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r.doc_id, r._id) for r in mixed.collect()} <= {(i, i) for i in range(12)}
