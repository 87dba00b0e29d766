"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic. The unlabelled texts are all training rows with their labels put aside, so they hold toxic
ones at the rate of the class prior. With class prior p and a linear score f, the risk is

    p R_pos(f, +) + max(0, R_unl(f, -) - p R_pos(f, -))

where the second part estimates the risk on true negatives. When it falls below zero, that is overfitting of the
unlabelled rows, and the step goes the other way. Features are presence of words and word beginnings by 64-bit hash, of which only those
count that positives have significantly more often than unlabelled texts; a text's evidence is the sum of its features' weights, less
what a clean text with as many features has by chance. So one insult counts the same in a short and in a long text, and length alone
is no evidence.

Training rows are a bounded sample of the labelled rows (`most_rows`, chosen by hash); the class prior is counted over all of
them. Features are counted and chosen by Spark; the driver gets the chosen ones alone, 2 ** BITS
at most. Scoring is one pass over all texts without a shuffle.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microbook.llm.tables import stored, unused
from microbook.llm.tokens import slices, tidy

#: At most 2 ** BITS features are chosen.
BITS = 18
MOST_ROWS = 20_000
THRESHOLD = 0.7
BEGINNINGS = (4, 5)
#: How many deviations above its expected count among positives a feature must be.
LEAST_Z = 3.5
_STRIP = " \t\r\n\v\f.,;:!?\"'()[]{}<>|&%$#*-_/\\"
_WORDS_KEPT = 100_000


class Features:
    """Hashed features of words; a word is looked at once per worker."""

    def __init__(self):
        self._known = {}

    def _of(self, word: str) -> list[int]:
        core = word.strip(_STRIP)
        if not core:
            return []
        names = [f"w {core}", *(f"b {core[:n]}" for n in BEGINNINGS if len(core) > n)]
        return [int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) for name in names]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of all texts one after the other, and the number of features of each; NULL has none."""
        split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        if len(self._known) > _WORDS_KEPT:
            self._known.clear()
        known, lists = self._known, []
        for word in coded.dictionary.to_pylist():
            if word not in known:
                known[word] = self._of(word)
            lists.append(known[word])
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(length.sum()))
        begin = np.cumsum(length) - length
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_word = length[codes]
        after = np.cumsum(per_word)
        total = int(after[-1]) if len(after) else 0
        features = flat[np.arange(total) + np.repeat(begin[codes] - (after - per_word), per_word)]
        per_text = np.diff(np.concatenate([[0], after])[ends - ends[0]])
        # distinct within a text
        of = np.repeat(np.arange(len(texts)), per_text)
        order = np.lexsort((features, of))
        features, of = features[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (features[1:] != features[:-1]) | (of[1:] != of[:-1])
        return features[new], np.bincount(of[new], minlength=len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class Model(NamedTuple):
    features: np.ndarray  # 64-bit hashes in order
    weights: np.ndarray  # one per feature, the bias last
    chance: float  # evidence by chance for each distinct feature of a clean text


def positions(features: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Position of each feature in the ordered `chosen`, len(chosen) if it is not there."""
    at = np.searchsorted(chosen, features)
    return np.where(np.append(chosen, 0)[at] == features, at, len(chosen)) if len(chosen) else np.zeros(len(features), np.int64)


def telling(rows: DataFrame, least_z: float = LEAST_Z, most: int = 1 << BITS) -> list[int]:
    """Features that positives have significantly more often than unlabelled texts; `rows`: toxic, features. The `most` significant ones."""
    n_all, n_pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = rows.select(F.explode("features").alias("feature"), "toxic").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("in_pos")
    )
    rate = (F.col("n") + 1.0) / (n_all + 2.0)
    excess = F.col("in_pos") - n_pos * rate
    deviation = F.sqrt(n_pos * rate * (1 - rate))
    chosen = counts.where((F.col("in_pos") >= 2) & (excess > least_z * deviation)).orderBy((excess / deviation).desc(), "feature").limit(most)
    return sorted(r["feature"] for r in chosen.select("feature").collect())


def train(
    features: np.ndarray,
    lengths: np.ndarray,
    positive: np.ndarray,
    prior: float,
    *,
    bits: int = BITS,
    size: int | None = None,
    steps: int = 400,
    rate: float = 0.05,
    shrink: float = 1e-6,
) -> np.ndarray:
    """Weights (one per feature, the bias last) that minimise the non-negative risk with logistic loss, by Adam."""
    size = 1 << bits if size is None else size
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    pos, unl = np.flatnonzero(positive), np.arange(len(positive))
    if not 0 < len(pos) < len(unl):
        weights[size] = 10.0 if len(pos) else -10.0  # nothing to tell apart
        return weights
    weights[size] = np.log(prior / (1 - prior))
    starts = np.cumsum(lengths) - lengths

    def part(rows):
        n = lengths[rows]
        at = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
        return features[at], n

    (pf, pn), (uf, un) = part(pos), part(unl)
    for step in range(1, steps + 1):  # all rows in each step: batches would make the corrected risk negative by chance
        ps, us = _sums(weights[pf], pn) + weights[size], _sums(weights[uf], un) + weights[size]
        negative_risk = np.logaddexp(0, us).mean() - prior * np.logaddexp(0, ps).mean()
        d_up = -prior * _sigmoid(-ps) / len(pos)  # of p R_pos(f, +)
        d_neg_p, d_neg_u = -prior * _sigmoid(ps) / len(pos), _sigmoid(us) / len(unl)
        gp, gu = (d_up + d_neg_p, d_neg_u) if negative_risk >= 0 else (-d_neg_p, -d_neg_u)
        slope = np.bincount(pf, np.repeat(gp, pn), size + 1) + np.bincount(uf, np.repeat(gu, un), size + 1)
        slope[size] = gp.sum() + gu.sum()
        slope[:size] += shrink * weights[:size]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        np.maximum(weights[:size], 0.0, out=weights[:size])  # they were chosen as evidence for toxicity
    return weights


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, bits: int = BITS, **how) -> Model:
    """Weights learnt from the labelled rows that are not held out. A document with several labels is toxic if one says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    prior = min(max(counted["toxic"] / max(counted["n"], 1), 1e-4), 0.9)
    # By hash, so that reruns train on the same rows. `most_rows` bounds what reaches the driver.
    share = min(1.0, most_rows / max(counted["n"], 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in slices(batches, "text"):
            found, lengths = of.rows(batch.column("text"))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "features"])

    schema = "doc_id bigint, toxic int, features array<bigint>"
    rows = stored(texts.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(tidy(featured), schema), "toxic-train")
    chosen = np.array(telling(rows, most=1 << bits), np.int64)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("features")
            at = positions(found.flatten().to_numpy(), chosen)
            keep = at < len(chosen)
            ends = found.offsets.to_numpy().astype(np.int64)
            flat = pa.array(at[keep])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]], pa.int32()), flat)
            size = pa.array(np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), lists, size], ["doc_id", "toxic", "features", "size"])

    taken = rows.mapInArrow(tidy(kept), schema + ", size bigint").orderBy("doc_id").toArrow().combine_chunks()
    lists = taken.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy().astype(np.int64)) if len(taken) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy().astype(np.int64) if len(taken) else np.zeros(0, np.int64)
    positive = taken.column("toxic").to_numpy().astype(bool) if len(taken) else np.zeros(0, bool)
    weights = train(flat, lengths, positive, prior, size=len(chosen), **how)
    sizes = taken.column("size").to_numpy().astype(float) if len(taken) else np.zeros(0)
    return Model(chosen, weights, by_chance(_sums(weights[flat], lengths), sizes, positive))


def by_chance(evidence: np.ndarray, sizes: np.ndarray, positive: np.ndarray) -> float:
    """Evidence for each distinct feature of the rows that are no positives."""
    clean = sizes.sum() - sizes[positive].sum()
    return max(0.0, float(evidence.sum() - evidence[positive].sum())) / clean if clean > 0 else 0.0


def score(docs: DataFrame, model: Model, *, columns: tuple[str, ...] = ("doc_id",), out: str = "score") -> DataFrame:
    """`columns` of each row and its score as `out`; NULL or empty text scores as the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 ** BITS features

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (chosen, weights, chance) = Features(), shared.value
        known = np.append(weights[:-1], 0.0)
        for batch in slices(batches, "text"):
            found, lengths = of.rows(batch.column("text"))
            value = _sigmoid(_sums(known[positions(found, chosen)], lengths) - chance * lengths + weights[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(value)], [*columns, out])

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in columns) + f", `{out}` double"
    return docs.select(*columns, *(c for c in ("text",) if c not in columns)).mapInArrow(tidy(scored), schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    found = score(docs, fit(docs, labels, **how))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns."""
    columns = tuple(docs.columns)
    out = unused(docs, "_toxicity")
    return score(docs, fit(docs, labels, **how), columns=columns, out=out).where(F.col(out) < threshold).select(*columns)
