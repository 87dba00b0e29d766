import hashlib
import random
import zlib

import numpy as np
import pytest

from microbook.llm import nn_descent as N
from microbook.llm import toxicity as T
from microbook.llm import warc as W

PAGES = "page_id bigint, url string, html string, payload string, digest string, first int"


def fake(payload=b"inner"):
    """A whole record that may stand inside a payload."""
    return W.record("response", 999, "http://fake", "0" * 64, payload).decode()


def page_rows():
    rng = random.Random(1)
    rows = [(1, "u", None), (2, "u", ""), (3, None, "short"), (4, "u", "short"), (5, "u", "x" * 100), (3000, "u", "x" * 100), (-7, "u", "y" * 99)]
    rows += [(10, "multi\r\nline", "a" + fake() + "b"), (11, "u", fake(b"z" * 300) * 20), (12, "u", "WARC/1.1\r\nContent-Length: 9\r\n")]
    rows += [(13, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"), (14, "é", "é" * 70), (15, "u", "é" * 70)]
    rows += [(20 + i, f"http://h/{i}", "".join(rng.choice(["<p>", "text ", fake(b"q"), "WARC/1.1\r\n"]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(200 + i, "hot", "hot page " * 30) for i in range(60)]
    return rows + [(400, "u", "L" * 300_000)]


def expected(rows):
    first = {}
    for p, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(p, first.get(data, p))
    out = []
    for p, _, html in rows:
        data = (html or "").encode()
        revisit = first.get(data, p) != p
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [700, 5_000, 1 << 24])
def test_pages_come_back_whatever_their_payloads_hold(spark, range_bytes):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "p", "d", 1) for r in rows], PAGES).repartition(3, "page_id")
    got = W.round_trip(spark, df, range_bytes=range_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_payloads_are_read_and_files_roll(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "p", "d", 1) for r in rows], PAGES).coalesce(1)
    manifest = W.write_warc(df, str(tmp_path / "w"), file_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    read = {r.page_id: bytes(r.payload) for r in W.read_warc(manifest, 3_000, payloads=True).collect() if r.record_type == "response"}
    assert read == {p: (html or "").encode() for p, _, html in rows if p in read} and len(read) > 100


def test_no_pages_and_null_ids(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert W.round_trip(spark, empty).collect() == []
    (row,) = W.round_trip(spark, spark.createDataFrame([(None, None, None)], empty.schema)).collect()
    assert (row.page_id, row.payload_bytes, row.record_type, row.refers_to) == (None, 0, "response", None)


@pytest.mark.parametrize("range_bytes", [5_000, 1 << 24])
def test_very_long_urls_lose_nothing(spark, range_bytes):
    rows = [(i, f"http://h/{i}", f"page {i} " * 40) for i in range(9)]
    rows[4] = (4, "data:," + "x" * 200_000, "WARC/1.1\r\nx: " + "y" * 100_000)
    rows.append((90, "u", rows[4][2]))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    got = W.round_trip(spark, df, range_bytes=range_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)


def test_broken_files_are_errors(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(9)], "page_id bigint, url string, html string").coalesce(1)
    manifest = W.write_warc(df, str(tmp_path / "w"))
    records = W.stored(W.read_warc(manifest), "records")
    W.check_complete(manifest, records)
    with pytest.raises(ValueError, match="differ"):
        W.check_complete(manifest, records.where("page_id <> 5"))
    path = manifest.first().path.removeprefix("file://")
    data = open(path, "rb").read()
    with open(path, "wb") as file:
        file.write(data.replace(b"WARC-Type: response\r\nWARC-Record-ID: <urn:page:6>", b"WARC_Type: response\r\nWARC-Record-ID: <urn:page:6>"))
    with pytest.raises(Exception, match="no whole record"):
        W.read_warc(manifest).collect()


def test_headers():
    data = W.record("response", 5, "u", "d", b"body")
    assert W.parse_header(data, 0).whole == len(data)
    for bad in (b"", b"WARC/1.1\r\n\r\n\r\n", data.replace(b"Content-Length: 4", b"Content-Length: -4"), data.replace(b"WARC-Type", b"Kind"), data[:60]):
        assert W.parse_header(bad, 0) is None
    found = {0: 10, 4: 20, 10: 50, 20: 99}
    assert W.exits(found, 40) == {20: 99, 10: 50, 4: 99, 0: 50}
    assert W.exits({0: 7}, 40) == {0: -1}


def toxic_corpus(spark, n=1500):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.choice([5, 30, 300]))]
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["idiotic!", "Scum,", "vileperson", "vilething", "vileact"]))
        docs.append((i, " ".join(text), "src0", "en", 0.5))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "s", "l", 0.1), (n + 2, "w1 " * 60_000 + "scum", "s", "l", 0.1), (None, "w1", "s", "l", 0.1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, score double"),
        spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int"),
    )


def test_held_out_toxic_texts_are_found_and_clean_ones_left_alone(spark):
    docs, labels = toxic_corpus(spark)
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    held = [(truth[d], got[d].predicted) for d in truth if d is not None and got[d].held_out]
    hits = sum(a and b for a, b in held)
    assert hits >= 0.9 * sum(a for a, _ in held) and hits >= 0.95 * sum(b for _, b in held)
    assert [r.predicted for d, r in got.items() if d is None or d in (1500, 1501)] == [0, 0, 0]
    # Labels of held-out rows never matter, nor do other columns.
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in T.toxicity(docs.selectExpr("doc_id", "text", "'z' AS source", "'z' AS lang"), flipped).collect()}
    assert again == {d: r.score for d, r in got.items()}
    kept = T.clean_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}


def test_length_alone_is_no_evidence(spark):
    docs, labels = toxic_corpus(spark)
    model = T.fit(docs, labels)
    long = " ".join(f"{i:x}{i * 7919 % 99991}q" for i in range(100_000))
    texts = spark.createDataFrame([(1, long), (2, "w1 w2 w3"), (3, "w1 vileperson idiotic!")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in T.score(texts, model).collect()}
    assert got[1] < 0.3 and got[2] < 0.3 and got[3] > 0.7
    assert T.by_chance(np.array([2.0, 2.0, 9.0]), np.array([10.0, 30.0, 50.0]), np.array([False, False, True])) == 0.1


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = toxic_corpus(spark, 20)
    assert all(r.predicted == 0 for r in T.toxicity(docs, labels.limit(0)).collect())
    assert T.toxicity(docs.limit(0), labels).collect() == []


def test_the_risk_never_goes_below_zero_for_long():
    rng = np.random.default_rng(0)
    positive = rng.random(300) < 0.3
    lengths = np.full(300, 4)
    features = rng.integers(0, 50, (300, 4))
    features[positive, 0] = 60
    weights = T.train(features.ravel(), lengths, positive, positive.mean(), bits=6)
    score = T._sigmoid(T._sums(weights[features.ravel()], lengths) + weights[-1])
    assert score[positive].min() > 0.7 > 0.3 > score[~positive].max() and np.isfinite(weights).all()


def links_by_brute_force(rows, threshold=0.98):
    usable = {}
    for v, e, label in rows:
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float64)
            usable[v] = (label, x / np.sqrt((x * x).sum()))
    links, root = {v: set() for v, *_ in rows}, {v: v for v, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(usable)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, xa), (lb, xb) = usable[a], usable[b]
            if la == lb and len(xa) == len(xb) and xa @ xb >= threshold:
                links[a].add(b)
                links[b].add(a)
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((v, len(links[v]), find(v), find(v) == v) for v in root)


def embedding_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows, v = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = rng.standard_normal(16)
            for _ in range(rng.choice([1, 1, 1, 2, 5])):
                rows.append((v, (base + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                v += 1
    base = rng.standard_normal(16)  # a saturated group, and copies of one vector
    rows += [(v + i, (base + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(80)]
    rows += [(v + 100 + i, base.astype(np.float32).tolist(), 1) for i in range(30)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1)]
    return rows + [(905, [1.0, None] * 8, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [3.0], 0)]


def test_links_and_components_match_brute_force(spark):
    rows = embedding_rows()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    want = links_by_brute_force(rows)
    found, true = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found == true and got == want  # small enough for full recall


def test_dense_groups_joined_by_weaker_links_are_one_component(spark):
    rng = np.random.default_rng(7)
    turn, rows = np.arccos(0.984), []
    for group, angle in enumerate((0.0, turn, 2 * turn, np.pi / 2)):  # the last one is on its own
        base = np.zeros(16)
        base[:2] = np.cos(angle), np.sin(angle)
        rows += [(100 * group + i, (base + 0.004 * rng.standard_normal(16)).tolist(), 1) for i in range(25)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(tuple(r) for r in N.near_duplicates(df).collect())
    assert got == links_by_brute_force(rows) and {r[2] for r in got} == {0, 300}
    nodes = N.nodes_of(df)
    lists = N.stored(N.first_graph(nodes, 8), "lists")
    apart = N.stored(N.connected_components(lists.where("cosine >= 0.98").select("a", "b")), "apart")
    across = {(r.a // 100, r.b // 100) for r in N.bridges(nodes, lists, apart, 0.98, 8, block=4).collect()}
    assert across and {tuple(sorted(x)) for x in across} <= {(0, 1), (1, 2)}


def test_the_audit_can_fail_and_sees_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.01 * rng.standard_normal(16)).tolist(), 1) for i in range(300)]  # one large group, and pairs
    rows += [(1000 + 2 * i + j, x.tolist(), 1) for i in range(40) for x in [rng.standard_normal(16)] for j, x in enumerate((x, x + 0.001))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    nodes = N.stored(N.nodes_of(df), "nodes")
    truth = N.audited_links(nodes, 8)
    assert truth.where("n <= 8").select("a").distinct().count() >= 64
    group = nodes.where("id < 1000").selectExpr("id AS node", "0L AS component")
    assert N.recall_of(truth, group, 8) == 0.0  # nearly all links are found, but no pair
    assert N.recall_of(truth, group.union(nodes.where("id >= 1000").selectExpr("id", "id - id % 2")), 8) == 1.0
    monkeypatch.setattr(N, "MOST_ENLARGED", 1)
    with pytest.raises(RuntimeError, match="recall"):
        N.near_duplicates(df.where("vec_id >= 1000"), rounds=1, enough=1.5)


def test_no_embeddings(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert N.near_duplicates(df).collect() == []
    one = spark.createDataFrame([(5, [1.0, 2.0], 3)], df.schema)
    assert [tuple(r) for r in N.near_duplicates(one).collect()] == [(5, 0, 5, True)]
