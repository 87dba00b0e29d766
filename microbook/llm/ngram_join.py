"""Size-aware heavy-light similarity join on sets of word shingles, with exact Jaccard threshold.

Equal sets are one node from the start. Then

* light sets, up to a size that a cost model chooses, enumerate their subsets of the size that two sets of given sizes must at
  least share. Two sets with a common subset are linked, without another look at them;
* heavy sets scan inverted lists. With all shingles in one global order, rarest first, two similar sets share a shingle among the
  first n - ceil(0.8 n) + 1 of each, so only these are in the lists, and shingles that occur once need none. Pairs from the lists
  are verified on whole sets.

The order is by exact document frequency. Documents are worked on in blocks: a block sends its distinct shingle hashes, packed
and sorted, to hash ranges, which count them and send back those that another document has too. A shingle that is frequent in a
block is sent as one count, so a passage that a third of all documents share costs one entry per block; its documents wait in
the block's own row.

Components need no link inside what is already connected. Every list first pairs its members with two hubs; only members of one
list that are still in different components are then paired with each other. A group of thousands of near copies thus costs
some pairs per member, and no link between different components is lost. Before a pair is made, a lower bound of the elements in which
its sets differ rules out most: those that no other document has, and a parity sketch of the others.
"""

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from microbook.llm.graph import connected_components
from microbook.llm.tables import new_folder, rows_per_batch, stored
from microbook.llm.tokens import slices, tidy, tidy_group

WORDS = 5
#: Similarity as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 4, 5
BLOCK_BYTES = 16 << 20
BLOCK_DOCS = 60_000
#: Text of a block that is cut into shingles at once; numpy holds some forty times as much meanwhile.
SHINGLED_BYTES = 4 << 20
#: Shingles of a hash range; bounds the memory of one range.
RANGE_SHINGLES = 2_000_000
#: From this many documents of a block on, a shingle is sent as a count.
FREQUENT_IN_BLOCK = 64
#: 64-bit words of the parity sketch of a set.
SKETCH = 8
#: Subsets of larger sets are never cheaper than their lists.
LIGHT_MOST = 12
PAIRS_AT_ONCE = 256
#: Rows of a block that go to Spark at once.
ROWS_AT_ONCE = 1_024

_MIX, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


# --- shingles -------------------------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: lower-cased A-Z, words between ASCII white space."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    there = np.fromiter((w != "" for w in names), bool, len(names))[codes]
    ends = np.concatenate([[0], np.cumsum(there)])[ends - ends[0]]
    flat = hashed[codes][there]
    count = max(0, len(flat) - words + 1)
    rolled = _combined([flat[k : k + count] for k in range(words)])
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        else:
            sets.append(_combined([flat[k : k + 1] for k in range(a, b)]) if b > a else np.zeros(0, np.uint64))
    return sets


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of word hashes; the number of words counts too."""
    out = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        out = (out ^ (out >> _SHIFT)) * _MIX + column
    out ^= out >> np.uint64(32)
    out *= _MIX
    return out ^ (out >> _SHIFT)


def _least_shared(n: int, m: int) -> int:
    """Fewest common elements of similar sets of sizes n and m: |A and B| / |A or B| >= t."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def _prefix(n: np.ndarray) -> np.ndarray:
    return n + (-NUMERATOR * n // DENOMINATOR) + 1


# --- blocks and hash ranges ----------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high ones of small numbers are zeros in a row."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


_BLOCK = "kind string, block bigint, part int, doc_id bigint, n bigint, a binary, b binary, c binary"
_BLOCK_ARROW = pa.schema(
    [("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64())]
    + [(c, pa.binary()) for c in "abc"]
)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_BLOCK_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK_ARROW, strict=True)], schema=_BLOCK_ARROW)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of equal sorted keys."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begin, np.diff(np.concatenate([begin, [len(keys)]]))


def _block_rows(block: int, doc_ids: list, sets: Iterable[np.ndarray], parts: int) -> Iterator[tuple]:
    """doc: one per document (a: digest of the set, b: the set if it may be light); of documents with equal sets, the first carries
    the postings. block: a digests, b sizes, c numbers of keys. post: one per range (a: keys, b: carriers). many: keys that are
    frequent here (a: keys, b: counts), kept: their carriers (a: keys, b: counts, c: carriers)."""
    carriers, digests, seen = [], [], set()
    for doc_id, own in zip(doc_ids, sets, strict=True):
        data = own.tobytes()
        digest = xxhash.xxh3_128_digest(data)
        yield ("doc", block, -1, doc_id, len(own), digest, data if 0 < len(own) <= LIGHT_MOST else None, None)
        if len(own) and digest not in seen:
            seen.add(digest)
            carriers.append(own)
            digests.append(digest)
    sizes = np.fromiter(map(len, carriers), np.int64, len(carriers))
    flat = np.concatenate(carriers) if carriers else np.zeros(0, np.uint64)
    carrier = np.repeat(np.arange(len(carriers), dtype=np.uint16), sizes)
    del sets, carriers
    keys = flat & np.uint64(0xFFFFFFFF)  # in place from here on, as these are the largest arrays of a worker
    keys *= np.uint64(parts)
    keys >>= np.uint64(32)
    keys <<= np.uint64(32)
    flat >>= np.uint64(32)
    keys |= flat
    del flat
    order = np.argsort(keys, kind="stable")
    keys, carrier = keys[order], carrier[order]
    del order
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (carrier[1:] != carrier[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, carrier = keys[fresh], carrier[fresh]
    n_keys = np.bincount(carrier, minlength=len(sizes))
    yield ("block", block, -1, None, len(sizes), b"".join(digests), sizes.astype("<i8").tobytes(), n_keys.astype("<i8").tobytes())
    begin, length = _runs(keys)
    frequent = length >= FREQUENT_IN_BLOCK
    if frequent.any():
        of_frequent = np.repeat(frequent, length)
        many, counts = keys[begin[frequent]], length[frequent].astype("<u4")
        yield ("kept", block, -1, None, 0, many.tobytes(), counts.tobytes(), carrier[of_frequent].tobytes())
        for part in np.unique(many >> np.uint64(32)).tolist():
            here = (many >> np.uint64(32)) == part
            yield ("many", block, int(part), None, 0, many[here].tobytes(), counts[here].tobytes(), None)
        keys, carrier = keys[~of_frequent], carrier[~of_frequent]
    bounds = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    for part, (x, y) in enumerate(itertools.pairwise(bounds.tolist())):
        if x < y:
            steps = np.diff(keys[x:y].astype(np.uint32), prepend=np.uint32(0))
            yield ("post", block, part, None, 0, _planes(steps.astype("<u4")), _planes(carrier[x:y].astype("<u2")), None)


def blocks(docs: DataFrame, parts: int, words: int = WORDS) -> DataFrame:
    """Sets of all documents by blocks, written once."""

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BLOCK_BYTES, BLOCK_DOCS):
            sets = (own for part in slices([batch], "text", SHINGLED_BYTES) for own in shingle_sets(part.column("text"), words))
            for rows in itertools.batched(_block_rows(number, batch.column("doc_id").to_pylist(), sets, parts), ROWS_AT_ONCE):
                yield _rows(rows)
            number += 1

    path = new_folder(docs.sparkSession, "shingle-blocks")
    docs.select("doc_id", "text").mapInArrow(tidy(blocked), _BLOCK).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(_BLOCK).parquet(path)


def _counted(table: pa.Table) -> pa.Table:
    """One hash range: exact document frequencies; each block gets back those of its keys that two documents have."""
    post, many = ([r for r in table.to_pylist() if r["kind"] == kind] for kind in ("post", "many"))
    own = [np.cumsum(_from_planes(r["a"], "<u4"), dtype=np.uint32) for r in post]
    more = [(np.frombuffer(r["a"], "<u8"), np.frombuffer(r["b"], "<u4")) for r in many]
    keys = np.concatenate([*own, *(k.astype(np.uint32) for k, _ in more)]) if own or more else np.zeros(0, np.uint32)
    counts = np.concatenate([*(np.ones(len(k), np.int64) for k in own), *(c.astype(np.int64) for _, c in more)]) if len(keys) else keys
    order = np.argsort(keys, kind="stable")
    begin, length = _runs(keys[order])
    df = np.empty(len(keys), np.int64)
    df[order] = np.repeat(np.add.reduceat(counts[order], begin), length) if len(begin) else []
    rows, at = [], 0
    for r, k in zip(post, own, strict=True):
        mine = df[at : at + len(k)]
        at += len(k)
        shared = mine >= 2
        if shared.any():
            full = k[shared].astype("<u8") | np.uint64(r["part"] << 32)
            rows.append(("shared", r["block"], -1, None, 0, full.tobytes(), mine[shared].astype("<i8").tobytes(), _from_planes(r["b"], "<u2")[shared].tobytes()))
    for r, (k, _) in zip(many, more, strict=True):
        rows.append(("counted", r["block"], -1, None, 0, k.tobytes(), df[at : at + len(k)].astype("<i8").tobytes(), None))
        at += len(k)
    return pa.Table.from_batches([_rows(rows)])


_ENTRY = "key bigint, digest binary, n bigint, own bigint, sketch array<bigint>"
_ENTRY_ARROW = (("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("own", pa.int64()), ("sketch", pa.list_(pa.int64())))


def _sketches(keys: np.ndarray, carrier: np.ndarray, carriers: int) -> np.ndarray:
    """Per carrier, the parity of the number of its keys in each of 64 * SKETCH classes, as SKETCH numbers."""
    bits = 64 * SKETCH
    place = (keys * _MIX) >> np.uint64(64 - bits.bit_length() + 1)
    parity = np.bincount(carrier * bits + place.astype(np.int64), minlength=carriers * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(carriers, bits), axis=1).view("<i8")


def _prefixed(table: pa.Table) -> pa.Table:
    """One block: the list entries of its carriers."""
    by: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        by.setdefault(row["kind"], []).append(row)
    empty = pa.table({c: pa.array([], t) for c, t in _ENTRY_ARROW})
    if "block" not in by:
        return empty
    (head,) = by["block"]
    sizes, n_keys = np.frombuffer(head["b"], "<i8"), np.frombuffer(head["c"], "<i8")
    keys = [np.frombuffer(r["a"], "<u8") for r in by.get("shared", [])]
    dfs = [np.frombuffer(r["b"], "<i8") for r in by.get("shared", [])]
    carriers = [np.frombuffer(r["c"], "<u2") for r in by.get("shared", [])]
    if "kept" in by:
        (kept,) = by["kept"]
        many, counts = np.frombuffer(kept["a"], "<u8"), np.frombuffer(kept["b"], "<u4")
        found = np.concatenate([np.frombuffer(r["a"], "<u8") for r in by["counted"]])
        found_df = np.concatenate([np.frombuffer(r["b"], "<i8") for r in by["counted"]])
        order = np.argsort(found)
        df = found_df[order][np.searchsorted(found[order], many)]
        keys.append(np.repeat(many, counts))
        dfs.append(np.repeat(df, counts))
        carriers.append(np.frombuffer(kept["c"], "<u2"))
    if not keys:
        return empty
    key, df, carrier = np.concatenate(keys), np.concatenate(dfs), np.concatenate(carriers).astype(np.int64)
    order = np.lexsort((key, df, carrier))
    key, carrier = key[order], carrier[order]
    begin, length = _runs(carrier)
    place = np.arange(len(key)) - np.repeat(begin, length)
    shared = np.bincount(carrier, minlength=len(sizes))
    own = n_keys - shared
    # Keys of one document alone come first in the order and are in no list.
    take = place < (_prefix(sizes) - own)[carrier]
    sketch = _sketches(key, carrier, len(sizes))
    digests = np.frombuffer(head["a"], "V16")
    of = carrier[take]
    return pa.table(
        {
            "key": key[take].view(np.int64),
            "digest": pa.array(digests[of].tolist(), pa.binary()),
            "n": sizes[of],
            "own": own[of],
            "sketch": pa.array(sketch[of].tolist(), pa.list_(pa.int64())),
        }
    )


# --- linking --------------------------------------------------------------------------------------------------------------


def light_boundary(sizes: dict[int, int], scanned: dict[int, int]) -> int:
    """The largest size of light sets, by cost: rows of subsets against entries read when scanning lists.

    `sizes`: number of sets of each size, `scanned`: total length of the lists that sets of this size read.
    """
    best, best_cost, enumerated = 0, sum(scanned.values()), 0
    left = best_cost
    for n in range(1, LIGHT_MOST + 1):
        enumerated += sum(math.comb(n, c) for _, _, c in _subset_sizes(n)) * sizes.get(n, 0)
        left -= scanned.get(n, 0)
        if enumerated + left < best_cost:
            best, best_cost = n, enumerated + left
    return best


def _subset_sizes(n: int) -> Iterator[tuple[int, int, int]]:
    """(larger, smaller, subset size) of all pairs of sizes in which a set of size n can be similar to another."""
    for m in range(1, LIGHT_MOST + 1):
        large, small = max(n, m), min(n, m)
        if (c := _least_shared(large, small)) <= small:
            yield large, small, c


def light_links(light: DataFrame, boundary: int) -> DataFrame:
    """Links (a, b) among sets of up to `boundary` elements; `light`: rep, n, items (binary). Each bucket gives a star per side."""

    def enumerated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, sides, reps = [], [], []
            for rep, data in zip(batch.column("rep").to_pylist(), batch.column("items").to_pylist(), strict=True):
                items = np.frombuffer(data, "<u8").tolist()
                for large, small, c in _subset_sizes(len(items)):
                    if large > boundary:
                        continue
                    for subset in itertools.combinations(items, c):
                        buckets.append(xxhash.xxh3_128_digest(np.array([large, small, *subset], "<u8").tobytes()))
                        sides.append(0 if large == small else 1 if len(items) == large else -1)
                        reps.append(rep)
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(buckets, pa.binary()), "side": pa.array(sides, pa.int32()), "rep": pa.array(reps, pa.int64())}
            )

    rows = light.where(F.col("n") <= boundary).select("rep", "items").mapInArrow(tidy(enumerated), "bucket binary, side int, rep bigint")
    heads = rows.groupBy("bucket").agg(*[F.min(F.when(F.col("side") == k, F.col("rep"))).alias(f"of_{k + 1}") for k in (-1, 0, 1)])
    # Each side meets in the other side's head; sets of equal size have one side.
    other = F.when(F.col("side") == 0, F.col("of_1")).when(F.col("side") == 1, F.col("of_0")).otherwise(F.col("of_2"))
    return rows.join(heads, "bucket").select(F.col("rep").alias("a"), other.alias("b")).where("a <> b").distinct()


def _fits(boundary: int) -> str:
    """Whether two sets can be similar, and the larger one is heavy: (n, own, sketch) and (m, own_m, sketch_m).

    Similar sets differ in at most a ninth of n + m elements. What a set has of its own differs, and of the rest at least as
    many elements as the parities of the sketches.
    """
    rest = NUMERATOR + DENOMINATOR
    differing = " + ".join(["own + own_m", *(f"bit_count(sketch[{k}] ^ sketch_m[{k}])" for k in range(SKETCH))])
    return (
        f"greatest(n, m) > {boundary} AND least(n, m) * {DENOMINATOR} >= greatest(n, m) * {NUMERATOR}"
        f" AND ({differing}) * {rest} <= (n + m) * {DENOMINATOR - NUMERATOR}"
    )


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets (rep, items) are similar."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= _least_shared(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("rep").alias(end), F.col("items").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    with rows_per_batch(pairs.sparkSession, PAIRS_AT_ONCE):  # each row has two whole sets
        return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(compared), "a bigint, b bigint"), "ngram-links")


def heavy_links(lists: DataFrame, docs: DataFrame, boundary: int, known: DataFrame, words: int = WORDS) -> DataFrame:
    """Links with at least one set of more than `boundary` elements; `lists`: key, rep, n, own, sketch. `known` are links (a, b) found before.

    The first hub of a list is the member with the smallest share of shingles of its own, in a group of near copies the one that most
    others are edits of; the other is any.
    """
    fits = _fits(boundary)
    facts = ["rep", "n", "own", "sketch"]
    central = F.struct((F.col("own") / F.col("n")).alias("share"), F.xxhash64("rep").alias("h"), *facts)
    hubs = lists.groupBy("key").agg(
        F.min(central).alias("central"), F.min(F.struct(F.xxhash64("rep").alias("h"), *facts)).alias("other"), F.count(F.lit(1)).alias("c")
    ).where("c > 1")
    hub = F.explode(F.array(*[F.struct(*[f"{name}.{c}" for c in facts]) for name in ("central", "other")])).alias("hub")
    other_end = [F.col(f"hub.{c}").alias(as_) for c, as_ in zip(facts, ("hub", "m", "own_m", "sketch_m"), strict=True)]
    heads = hubs.select("key", hub).select("key", *other_end).distinct()
    tried = lists.join(heads, "key").where(f"rep <> hub AND {fits}")
    tried = stored(tried.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "ngram-tried")

    # Whole sets of the documents that are in a list of two or more; all pairs come from these.
    wanted = stored(lists.join(hubs.select("key"), "key", "left_semi").select("rep").distinct(), "ngram-wanted")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            items = [s.tobytes() for s in shingle_sets(batch.column("text"), words)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(items, pa.binary())], ["rep", "items"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi").select("rep", "text")
    sets = stored(texts.mapInArrow(tidy(whole), "rep bigint, items binary"), "ngram-sets")
    links = verified(tried, sets).union(known)

    component = connected_components(links)
    placed = lists.join(component, lists.rep == component.node, "left").select("key", *facts, F.coalesce("component", "rep").alias("component"))
    placed = stored(placed, "ngram-placed")
    # Components of a list meet; the one with fewer members there is spelled out first, so a stray set beside a large group is one row.
    # Two stray sets are judged right here.
    sides = placed.groupBy("key", "component").agg(
        F.count(F.lit(1)).alias("members"), F.min("n").alias("n"), F.max("n").alias("most"), F.min("own").alias("own"), F.first("sketch").alias("sketch")
    )
    few = sides.select("key", F.struct("members", "component").alias("few"), "n", "most", "own", "sketch")
    many = sides.select(
        "key", F.struct("members", "component").alias("many"), *[F.col(c).alias(as_) for c, as_ in zip(("n", "most", "own", "sketch"), ("m", "most_m", "own_m", "sketch_m"), strict=True)]
    )
    sized = f"n * {NUMERATOR} <= most_m * {DENOMINATOR} AND m * {NUMERATOR} <= most * {DENOMINATOR}"
    crossing = few.join(many, "key").where(f"few < many AND {sized} AND (many.members > 1 OR ({fits}))").select(
        "key", F.col("few.component").alias("component"), F.col("many.component").alias("component_m")
    )
    others = placed.select(
        "key", *[F.col(c).alias(as_) for c, as_ in zip([*facts, "component"], ("b", "m", "own_m", "sketch_m", "component_m"), strict=True)]
    )
    pairs = crossing.join(placed.withColumnRenamed("rep", "a"), ["key", "component"]).join(others, ["key", "component_m"]).where(fits)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.union(verified(stored(pairs, "ngram-left"), sets))


def similar_documents(docs: DataFrame, *, words: int = WORDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Documents with fewer than `words` words are one shingle of all their words; without words, or with NULL text, they have an
    empty set, no link and their own doc_id. doc_id identifies a document: rows that repeat it count as linked. Rows with NULL doc_id
    get their set's component if another document has the set, else NULL. Other columns are ignored.
    """
    characters = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(8, -(-characters // (6 * RANGE_SHINGLES)))  # a word and its space have six characters or so
    made = blocks(docs, parts, words)
    documents = made.where("kind = 'doc'").select("doc_id", "n", F.col("a").alias("digest"), F.col("b").alias("items"))
    nodes = stored(
        documents.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("items").alias("items")),
        "ngram-nodes",
    )
    counted = made.where("kind IN ('post', 'many')").groupBy("part").applyInArrow(tidy_group(_counted), _BLOCK)
    to_blocks = counted.unionByName(made.where("kind IN ('block', 'kept')"))
    entries = to_blocks.groupBy("block").applyInArrow(tidy_group(_prefixed), _ENTRY)
    lists = stored(entries.join(nodes.select("digest", "rep"), "digest").where("rep IS NOT NULL").groupBy("key", "rep").agg(*[F.first(c).alias(c) for c in ("n", "own", "sketch")]), "ngram-lists")

    small = f"n <= {LIGHT_MOST}"
    sizes = {r["n"]: r["c"] for r in nodes.where(small).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    lengths = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    scans = lists.where(small).join(lengths, "key").groupBy("n").agg(F.sum("c").alias("c"))
    boundary = light_boundary(sizes, {r["n"]: r["c"] for r in scans.collect()})

    light = light_links(nodes.where("rep IS NOT NULL"), boundary)
    least = -(-NUMERATOR * (boundary + 1) // DENOMINATOR)  # smaller sets are similar to no heavy one
    links = heavy_links(lists.where(F.col("n") >= least), docs, boundary, stored(light, "ngram-light"), words)
    component = connected_components(links)
    named = nodes.select("digest", "rep").join(component, nodes.rep == component.node, "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component"))
    return documents.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that are the first of their component, with all their columns."""
    found = similar_documents(docs, **how)
    gone = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "ngram-dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
