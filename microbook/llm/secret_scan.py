"""Secret scan: rules with a fixed form, and character Markov models for secrets that no rule names.

Rules find assignments to names such as `password`, access keys and long hexadecimal strings. They also label the samples for the models:
their values are random strings, all other runs of the same characters are ordinary words and identifiers. Counts of character pairs
are taken over all texts (Spark sums the tasks' tables of 68 x 68 pairs). The ordinary model mixes these odds with those of the same words
joined to identifiers and paths. There is one model of random strings per alphabet: it starts
from equal odds for the characters of that alphabet, as a generator of keys draws them, and takes in the samples that fit it.

A stretch of a run is reported when the log-likelihood ratio of random against ordinary exceeds a threshold. Under the model of
ordinary text the chance that a stretch from a given character ever reaches a ratio e^T is at most e^-T, so T = ln(characters searched *
alphabets / false alarms wanted) bounds the expected number of false alarms in the whole corpus.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from microbook.llm.tokens import slices

# --- fixed values: rules and their order ---
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# --- end of fixed values ---

CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Alphabets of random strings, the narrowest first.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", CHARACTERS[:62], CHARACTERS)
#: Shortest run that is searched, and shortest stretch of it: the ends of a random string may look ordinary by chance.
LEAST_RANDOM, LEAST_STRETCH = 16, 12
FALSE_ALARMS = 0.01
#: Weight of equal odds, in sample pairs per character of the alphabet, and of unseen pairs in ordinary text.
_RANDOM_PRIOR, _ORDINARY_PRIOR = 4.0, 0.5
_OUTSIDE = -30.0
_SLICE_BYTES = 1 << 20

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")  # a run of letters that are all taken: the same as dropping shorter runs afterwards
_RUN = re.compile(f"[A-Za-z0-9+/_.=-]{{{LEAST_RANDOM},}}")

_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(CHARACTERS.encode(), np.uint8)] = np.arange(1, len(CHARACTERS) + 1)
_WIDTH = len(CHARACTERS) + 1


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float | None = None

    @property
    def place(self) -> tuple[int, int]:
        return self.start, KINDS.index(self.kind)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans of the rules by start, then kind, and the places of their values (an assignment's value, else the whole match)."""
    assigned = [m for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    whole = [("access", m) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS] + [("hex", m) for m in _HEX.finditer(text)]
    spans = [Span("assign", *m.span()) for m in assigned] + [Span(kind, *m.span()) for kind, m in whole]
    return sorted(spans, key=lambda s: s.place), [m.span(2) for m in assigned] + [m.span() for _, m in whole]


def codes_of(text: str) -> np.ndarray:
    """Number of each character, 0 for those that no secret has."""
    return _CODES[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]


def pair_counts(codes: np.ndarray) -> np.ndarray:
    """Pairs (character before, character), 0 standing for the begin of a run."""
    before = np.concatenate([[0], codes[:-1]]).astype(np.int64)
    return np.bincount((before * _WIDTH + codes)[codes > 0], minlength=_WIDTH * _WIDTH)


def alphabet_of(value: str) -> int:
    """The narrowest alphabet that has all characters of the value."""
    return next(k for k, letters in enumerate(ALPHABETS) if set(value) <= set(letters))


def _teaches(value: str) -> bool:
    """A password that is a plain word or a number is no random string."""
    return len(value) >= LEAST_RANDOM and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


class Models(NamedTuple):
    """Log-likelihood ratio per character pair, one table per alphabet, and the threshold."""

    ratios: np.ndarray
    threshold: float


def identifier_model(counts: np.ndarray) -> np.ndarray:
    """Odds of the next character in identifiers, paths and addresses: the corpus's own words, in any case, joined by other characters.

    Few texts hold enough of them to count, but their words are those of the texts: letter pairs come from `counts` without regard to
    case, beginnings from what follows a character that is no letter, and only the shares of what comes next are given.
    """
    letters = np.array([CHARACTERS.index(c) + 1 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]).reshape(2, 26)
    digits = np.arange(CHARACTERS.index("0"), CHARACTERS.index("9") + 1) + 1
    others = np.arange(CHARACTERS.index("+"), len(CHARACTERS)) + 1
    no_letter = np.concatenate([[0], digits, others])
    upper, lower = letters
    inside = sum(counts[np.ix_(a, b)] for a in letters for b in letters) + 0.5
    inside = inside / inside.sum(1, keepdims=True)
    begin = sum(counts[np.ix_(no_letter, b)].sum(0) for b in letters) + 0.5
    begin = begin / begin.sum()
    odds = np.zeros((_WIDTH, _WIDTH))
    for rows, to_lower, to_upper, digit, other in (
        (lower, 0.72 * inside, 0.08 * begin, 0.05, 0.10),
        (upper, 0.25 * inside, 0.55 * inside, 0.05, 0.10),
        (digits, 0.10 * begin, 0.05 * begin, 0.65, 0.15),
        (np.concatenate([[0], others]), 0.40 * begin, 0.15 * begin, 0.15, 0.25),
    ):
        odds[np.ix_(rows, lower)], odds[np.ix_(rows, upper)] = to_lower, to_upper
        odds[np.ix_(rows, digits)], odds[np.ix_(rows, others)] = digit / 10, other / len(others)
    odds[np.arange(1, _WIDTH), np.arange(1, _WIDTH)] += 0.05  # rulers and placeholders repeat a character
    return odds[:, 1:] / odds[:, 1:].sum(1, keepdims=True)


def models_of(samples: np.ndarray, ordinary: np.ndarray, searched: int, false_alarms: float = FALSE_ALARMS) -> Models:
    """`samples`: pair counts per alphabet; `ordinary`: pair counts; `searched`: characters of runs that are long enough."""
    counts = ordinary.reshape(_WIDTH, _WIDTH)
    plain = counts[:, 1:] + _ORDINARY_PRIOR
    plain = plain / plain.sum(1, keepdims=True)
    log_plain = np.log((plain + identifier_model(counts)) / 2)
    ratios = np.full((len(ALPHABETS), _WIDTH, _WIDTH), _OUTSIDE)
    for table, letters, counts in zip(ratios, ALPHABETS, samples.reshape(len(ALPHABETS), _WIDTH, _WIDTH), strict=True):
        own = _CODES[np.frombuffer(letters.encode(), np.uint8)].astype(int)
        part = counts[:, own] + _RANDOM_PRIOR  # whatever came before: a secret may follow other characters of its run
        table[:, own] = np.log(part / part.sum(1, keepdims=True)) - log_plain[:, own - 1]
    return Models(ratios, float(np.log(max(searched, 1) * len(ALPHABETS) / false_alarms)))


def stretches(gains: list[float], threshold: float) -> Iterator[tuple[int, int, float]]:
    """(start, end, sum) of stretches whose sum reaches the threshold; one ends where its sum has fallen by the threshold or to 0."""
    start, so_far, best, best_end = 0, 0.0, 0.0, 0
    for at, gain in enumerate(gains, 1):
        so_far += gain
        if so_far > best:
            best, best_end = so_far, at
        if so_far <= 0 or best - so_far >= threshold:
            if best >= threshold:
                yield start, best_end, best
            start, so_far, best, best_end = at, 0.0, 0.0, at
    if best >= threshold:
        yield start, best_end, best


def random_spans(text: str, models: Models, taken: list[Span]) -> list[Span]:
    """Stretches that the models call random, apart from `taken` and from each other, the most certain ones first."""
    found = []
    for run in _RUN.finditer(text):
        codes = codes_of(run.group()).astype(np.int64)
        before = np.concatenate([[0], codes[:-1]])
        for table in models.ratios:
            for start, end, score in stretches(table[before, codes].tolist(), models.threshold):
                if end - start >= LEAST_STRETCH:
                    found.append(Span("markov", run.start() + start, run.start() + end, score))
    kept: list[Span] = []
    blocked = sorted((s.start, s.end) for s in taken)
    for span in sorted(found, key=lambda s: (-s.score, s.start, s.end)):
        if not _meets(blocked, span):
            kept.append(span)
            blocked.append((span.start, span.end))
            blocked.sort()
    return kept


def _meets(intervals: list[tuple[int, int]], span: Span) -> bool:
    return any(start < span.end and span.start < end for start, end in intervals)


def learn(docs: DataFrame, *, text_column: str = "text", false_alarms: float = FALSE_ALARMS) -> Models:
    """Models from all texts: what the rules find are samples of random strings, everything else is ordinary."""
    n_tables = len(ALPHABETS) + 1

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, searched = np.zeros((n_tables, _WIDTH * _WIDTH), np.int64), 0
        for batch in slices(batches, "text", _SLICE_BYTES):
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans, values = base_spans(text)
                codes = codes_of(text)
                if spans:
                    codes = codes.copy()
                    for span in spans:
                        codes[span.start : span.end] = 0
                    for start, end in sorted(set(values)):
                        if _teaches(value := text[start:end]):
                            tables[alphabet_of(value)] += pair_counts(codes_of(value))
                tables[-1] += pair_counts(codes)
                searched += sum(m.end() - m.start() for m in _RUN.finditer(text))
        number, pair = np.nonzero(tables)
        yield pa.RecordBatch.from_pydict(
            {"number": [*number.tolist(), n_tables], "pair": [*pair.tolist(), 0], "n": [*tables[number, pair].tolist(), searched]}
        )

    parts = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(counted, "number bigint, pair bigint, n bigint")
    tables, searched = np.zeros((n_tables, _WIDTH * _WIDTH)), 0
    for number, pair, n in parts.groupBy("number", "pair").agg(F.sum("n").alias("n")).collect():  # 6 tables of 68 x 68 pairs at most
        if number == n_tables:
            searched = n
        else:
            tables[number, pair] = n
    return models_of(tables[:-1], tables[-1], searched, false_alarms)


_SPANS = "array<struct<kind: string, start: int, end: int, value: string, score: double>>"


def scan(docs: DataFrame, models: Models | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, spans (kind, start, end, value, score) by start, then kind in the order of `KINDS`.

    Places count code points, `end` is exclusive; `score` is the log-likelihood ratio of a `markov` span, else NULL. A span of the
    models never overlaps one of a rule. NULL and empty texts have no spans; rows with the same identifier are documents of their
    own; an empty table gives an empty result. Without `models` they are learnt from `docs`. Other columns of `docs` are ignored.
    """
    models = models or learn(docs, text_column=text_column)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("score", pa.float64())]))
        for batch in slices(batches, "text", _SLICE_BYTES):
            out = []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)[0] if text else []
                if text:
                    spans = sorted([*spans, *random_spans(text, models, spans)], key=lambda s: s.place)
                out.append([{"kind": s.kind, "start": s.start, "end": s.end, "value": text[s.start : s.end], "score": s.score} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"doc_id bigint, spans {_SPANS}")


def joined(spans: Column) -> Column:
    """The spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
