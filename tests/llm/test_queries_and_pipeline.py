import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from microbook.llm import mixing, packing, queries, toxicity
from microbook.llm.tables import table
from tests.llm.test_ngram_join import brute_force, rows_of
from tests.llm.test_tokens_and_packing import check_packing

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert as_rows(got.columns, [tuple(r) for r in got.collect()]) == as_rows(want.columns, want.fetchall())


def test_every_operator_is_registered():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram join", "mixing", "packing"]


def test_join_query_equals_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op1_ngram_join(spark, sf)) == brute_force(docs)


def test_pipeline_stage_by_stage(spark, sf):
    documents = table(spark, sf, "documents")
    text = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    rejected = {r.doc_id for r in toxicity.toxicity(documents, table(spark, sf, "labels")).collect() if r.predicted}
    last = {}
    for d in sorted(set(text) - rejected):
        last[text[d]] = d
    unique = sorted(last.values())
    kept = [d for d, _, component in brute_force([(d, text[d]) for d in unique]) if d == component]
    assert 0 < len(kept) < len(unique) < len(text)
    copies = {r.doc_id: r.copies for r in mixing.mix(documents.where(documents.doc_id.isin(kept))).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(d, library.encode(text[d], add_special_tokens=False).ids + [0]) for d in kept for _ in range(copies[d])]
    n = check_packing(corpus_pipeline.run(spark, sf).collect(), docs, packing.SEQUENCE)
    assert n <= 1.05 * sum(len(ids) for _, ids in docs) / packing.SEQUENCE + 1


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert [corpus_pipeline.STAGES[k][1](spark, docs.limit(0), sf).count() for k in (0, 2, 3, 4)] == [0] * 4
