"""Licence scans by canonical digests.

A text is brought to a canonical form: A-Z in lower case, copyright lines gone, equivalent spellings made one, punctuation and
white space one space. Its digest is looked up among those of known licences in a hash join. Whole documents are looked up, and
each of their lines, so that a notice at the end of a document is found too. The known licences are a list that ships with
the operator (or is given), so the broadcast side does not grow with the corpus; only documents with a hit reach a shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts of short licences and of the notices by which longer ones are named.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, '
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software.\n\n" + _AS_IS,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
# Spellings that do not change a licence.
SPELLINGS = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("&", " and "),
    ("https:", "http:"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Line by line: what a holder writes there differs between copies of the same licence.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9])|\(c\)[ \t]|©)[^\n]*"
PUNCTUATION = r"[!-/:-@\[-`{-~“”‘’–—© \t\r]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks."""
    out = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), COPYRIGHT_LINE, "$1")
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.regexp_replace(out, PUNCTUATION, " ")


def whole_digest(lines: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(lines, "[ \n]+", " ")), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """license_id and digest of each known text."""
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    return texts.select("license_id", whole_digest(canonical_lines(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_digest, license_id (of the whole text, else NULL), n_license_lines and
    line_license_ids (of lines that are a known text, sorted, comma between, NULL if there is none).

    NULL counts as empty; an empty text has the digest of nothing and no licence. Rows with the same doc_id share what their lines have.
    """
    spark = docs.sparkSession
    table = F.broadcast(known_digests(spark, known))  # as long as `known`
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    units = rows.select("doc_id", F.explode(F.split("lines", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    hits = units.where("line <> ''").select("doc_id", F.sha2("line", 256).alias("digest")).join(table, "digest")
    found = hits.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_license_ids")
    )
    whole = rows.select("doc_id", whole_digest(F.col("lines")).alias("text_digest"))
    named = whole.join(table, whole.text_digest == table.digest, "left").select("doc_id", "text_digest", "license_id")
    found = found.withColumnRenamed("doc_id", "_doc_id")
    return named.join(found, F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("n_license_lines", F.lit(0)).cast("bigint").alias("n_license_lines"), "line_license_ids"
    )
