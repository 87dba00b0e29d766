"""The operators over their whole tables, with the columns that their contracts name, and DuckDB SQL where SQL can say it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microbook.llm import exact_dedup, hard_negatives, licenses, mixing, ngram_join, nn_descent, packing, resampling, secret_scan, token_counts, token_ids, toxicity, warc
from microbook.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_ids.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 2, word_level=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), locator=exact_dedup.parquet_locator())
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_token_ids": op4_token_ids,
    "op5_token_counts": op5_token_counts,
    "op6_mix_sources": op6_mix_sources,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_nn_descent": op8_nn_descent,
    "op9_license_scan": op9_license_scan,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_resampling": op11_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
}



def _canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{licenses._UPPER}', '{licenses._LOWER}')"
    out = f"regexp_replace({out}, '{licenses.COPYRIGHT_LINE}', '\\1', 'g')"
    for spelling, usual in licenses.SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"regexp_replace({out}, '{licenses.PUNCTUATION}', ' ', 'g')"


def _whole_sql(lines: str) -> str:
    return f"sha256(trim(regexp_replace({lines}, '[ \n]+', ' ', 'g')))"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM firsts
    """,
    "op6_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size FROM documents
        ), totals AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight,
                   source_size * 2.0::DOUBLE AS cap
            FROM totals
        ), capped AS (
            SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0) AS left_words,
                   sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS left_weight
            FROM weighed
            WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT source, source_size, least(cap, max(left_words / left_weight) OVER () * weight) AS target FROM capped
        ), rated AS (
            SELECT doc_id, s.source, size, source_size, target,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
                   (CAST('0x' || md5('mix#' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        ), ranked AS (
            SELECT *, target - whole * source_size AS rest, (u / (1 - u)) / (1 + u / (1 - u)) AS place FROM rated
        ), first AS (
            SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS in_first FROM ranked
        ), gaps AS (
            SELECT *, rest - coalesce(sum(CASE WHEN in_first THEN size END) OVER (PARTITION BY source), 0) AS gap FROM first
        ), marked AS (
            SELECT *, NOT in_first AND size <= gap AND rest > 0 AS fits FROM gaps
        ), topped AS (
            SELECT *, fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap AS in_second
            FROM marked
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN (in_first AND rest > 0) OR in_second THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM topped
    """,
    "op9_license_scan": f"""
        WITH known AS (
            SELECT digest, min(license_id) AS license_id
            FROM (SELECT license_id, {_whole_sql(_canonical_sql("t"))} AS digest FROM (VALUES {_KNOWN_SQL}) v(license_id, t)) GROUP BY digest
        ), canonical AS (
            SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents
        ), hits AS (
            SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS ids
            FROM (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS line FROM canonical) u
            JOIN known ON sha256(line) = digest
            WHERE line <> ''
            GROUP BY doc_id
        )
        SELECT c.doc_id, {_whole_sql("lines")} AS text_digest, license_id, coalesce(n, 0) AS n_license_lines, ids AS line_license_ids
        FROM canonical c LEFT JOIN known ON {_whole_sql("lines")} = digest LEFT JOIN hits ON c.doc_id = hits.doc_id
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_resampling": r"""
        WITH steps AS (
            SELECT list(v ORDER BY b) AS step
            FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
                FROM range(256) r(b)
            )
        ), texts AS (
            SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark
        ), cut AS (
            SELECT doc_id, item_id, doc_id IS NOT NULL AS own,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM texts
        ), runs AS (
            SELECT doc_id, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
            FROM cut
        ), counted AS (
            SELECT doc_id, own, feature, count(*) AS n FROM runs GROUP BY ALL
        ), named AS (
            SELECT feature, hex(encode(feature)) AS bytes FROM (SELECT DISTINCT feature FROM counted)
        ), hashed AS (
            SELECT feature,
                   xor(list_reduce(
                       list_prepend(4294967295, list_transform(range(len(bytes) // 2), lambda i: CAST('0x' || bytes[2 * i + 1 : 2 * i + 2] AS BIGINT))),
                       lambda c, b: xor(c // 256, step[1 + (xor(c, b) & 255)])
                   ), 4294967295) % 10000 AS bucket
            FROM named, steps
        ), placed AS (
            SELECT doc_id, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (feature) GROUP BY ALL
        ), buckets AS (
            SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM placed GROUP BY bucket
        ), totals AS (
            SELECT sum(s) AS total_s, sum(t) AS total_t FROM buckets
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (total_s + 10000) / ((s + 1) * (total_t + 10000)))) AS gain FROM buckets, totals
        ), weighed AS (
            SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
            FROM placed JOIN gains USING (bucket) WHERE own GROUP BY doc_id
        ), scored AS (
            SELECT c.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(words) >= 20 AS eligible,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                       (CAST('0x' || sha256('7:' || c.doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM cut c LEFT JOIN weighed w ON c.doc_id = w.doc_id
            WHERE own
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id) AS place, count(*) FILTER (eligible) OVER () AS n FROM scored
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM ranked
    """,
    "op12_hard_negatives": """
        WITH rows AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), anchors AS (
            SELECT * FROM rows WHERE vec_id % 100 = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
            FROM anchors a JOIN rows r ON a.vec_id <> r.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, CAST(row_number() OVER own AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s USING (anchor_id)
        WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        WINDOW own AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER own <= 5
    """,
}
