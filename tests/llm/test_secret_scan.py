import hashlib
import random
import re
import string

import pytest

from microbook.llm import queries
from microbook.llm import secret_scan as S
from tests.llm.test_resampling import table

RULES = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
                          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}
LETTERS = {"62": string.ascii_letters + string.digits, "upper": string.ascii_uppercase + string.digits, "hex": "0123456789abcdef"}


def brute_base(text):
    spans = []
    for order, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(spans)]


def randoms(alphabet, length, n, seed=2):
    chance = random.Random(f"{seed}{alphabet}{length}")
    return ["".join(chance.choices(LETTERS[alphabet], k=length)) for _ in range(n)]


@pytest.fixture(scope="module")
def models(spark):
    return S.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


ODD = [
    None, "", "secret=token: abcdefgh", 'API_KEY" :  "abc', "apikey='ABC123' Password = hunter22 token:x", "AKIAAKIA123 AKIA" + "A1" * 8,
    "0" * 23 + " " + "0" * 24 + "g" + "f" * 30, "ſecret=abcdefg paKword", "日本\U0001f600 token = " + "ab12" * 10, "tokenſ token=ſabcdef",
    "token = " + "deadbeef" * 5 + ", AKIA" + "Z9" * 10,
]


def test_rules_equal_a_plain_scan(spark):
    rows = list(enumerate(ODD)) + [(None, "token = abcdef1"), (3, "passwd:abcdef"), (3, "passwd:abcdef")]
    clash = table(spark, rows).selectExpr("*", "1 AS spans", "'x' AS kind", "2 AS value")
    found = S.scan(clash).collect()
    got = sorted((repr(r.doc_id), [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "markov"]) for r in found)
    assert got == sorted((repr(i), brute_base(text)) for i, text in rows)
    texts = dict(rows[: len(ODD)])
    assert all(texts[r.doc_id][s.start : s.end] == s.value for r in found for s in r.spans if r.doc_id not in (None, 3))
    assert S.scan(table(spark, [])).collect() == []


def test_query_keeps_the_base_and_tells_clean_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op13_secret_scan(spark, sf)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = found.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in RULES)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == base
    assert sum("markov" in r.spans for r in rows) <= 1


@pytest.mark.parametrize(("alphabet", "length", "least"), [("62", 32, 0.99), ("62", 20, 0.9), ("upper", 24, 0.99), ("hex", 23, 0.9), ("62", 16, 0.6)])
def test_held_out_random_strings_are_found_and_placed(models, alphabet, length, least):
    hits = 0
    for value in randoms(alphabet, length, 200):
        text = f"before it {value} and words after"
        spans = S.random_spans(text, models, [])
        hits += any(10 <= s.start and s.end <= 10 + length and s.end - s.start >= 0.7 * length for s in spans)
    assert hits / 200 >= least


def test_ordinary_identifiers_are_left_alone(spark, models):
    kept = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1").select("text").collect() if r.text]
    words = sorted({w for text in kept[:300] for w in re.findall("[a-z]{3,9}", text)})
    chance = random.Random(4)
    made = []
    for _ in range(400):
        parts = chance.choices(words, k=chance.randint(3, 6))
        made += ["_".join(parts), "".join(p.title() for p in parts), "/".join(parts) + ".html", "https//www." + "".join(parts) + ".com/2024/05"]
    made += ["0123456789" * 4, "4111-1111-1111-1111", "-" * 80, "=" * 80, "aaaaaaaaaaaaaaaaaaaaaaaa", "2024-01-15/2025-02-16"]
    false = [x for x in made if S.random_spans(x, models, [])]
    assert len(false) <= 0.02 * len(made), false[:20]
    assert sum(bool(S.random_spans(text, models, S.base_spans(text)[0])) for text in kept) == 0  # documents that the models have not seen


def test_stretches_of_long_runs_and_overlaps(models):
    secret, other = randoms("62", 40, 2)
    text = "thewordsofthetext/" * 5000 + secret + "/thewordsofthetext" * 5000
    (span,) = S.random_spans(text, models, [])
    assert text[span.start : span.end] in text and abs(span.start - text.index(secret)) <= 4 and span.end - span.start >= 30
    taken = [S.Span("assign", 3, 60)]
    assert S.random_spans("abc " + other, models, taken) == []
    assert list(S.stretches([1.0, 1.0, -5.0, 3.0, 3.0, -1.0], 2.0)) == [(0, 2, 2.0), (3, 5, 6.0)]


def test_counts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = S.learn(docs.coalesce(1)), S.learn(docs.repartition(9))
    assert one.threshold == many.threshold and (one.ratios == many.ratios).all()
