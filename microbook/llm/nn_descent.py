"""Near-duplicate embeddings by NN-descent.

Vectors are compared only with equal label (and dimension). Equal vectors are one node with a multiplicity. A first graph comes
from sorted orders by random hyperplanes: neighbours in an order are compared in windows. Rounds then compare all neighbours of a
node with each other (forward and reverse lists), which is how neighbours of neighbours meet, and keep the best of each node.
Rounds end when links at or above the threshold stop appearing and an audit (a bounded set of queries chosen by hash, each
compared with all vectors) finds enough of its links inside the components found so far. Recall is the mean over queries, taken apart
for those with few and with many links, of which the worse counts. If it is too low, lists get twice as long, new orders are added and
rounds go on; if that does not help either, the result is an error that names the recall.

A list that is full of links is saturated: it must be longer than it is. Inside a component, lists are enlarged to the component: its
members are compared in blocks, and only the numbers of links come out, never the pairs. A link that leaves the component is missing
in the lists only if both of its ends are saturated. These ends are therefore compared across components, without those inside: two
components meet if a bound on the angle between their vectors, from one vector and a radius of each, leaves room for a link.

The members of a node's neighbourhood are dealt to chunks by hash, anew in each round, so a hub with a third of all vectors as
reverse neighbours is many small groups. The best of a node are cut per task before they are shuffled.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from microbook.llm.graph import connected_components
from microbook.llm.tables import rows_per_batch, stored

THRESHOLD = 0.98
NEIGHBOURS = 8
ORDERS = 4
PLANES = 24
WINDOW = 64
CHUNK = 64
BLOCK = 512
MOST_ROUNDS = 8
#: Queries of one block of the audit, at most so many blocks (each twice the one before), until so many queries have few links.
AUDITED = 256
AUDIT_BLOCKS = 5
LEAST_LINKED = 64
ENOUGH = 0.95
#: How often lists are made twice as long before a failed audit is an error.
MOST_ENLARGED = 3
#: Rounds go on while they find more than this share of new links.
NEW_LINKS = 0.002


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision and of length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def nodes_of(embeddings: DataFrame) -> DataFrame:
    """One row per different usable vector: id (smallest vec_id), copies, label, size, embedding."""
    values = F.col("embedding")
    usable = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(values, lambda x: x != 0)
    )
    rows = embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", "label", F.col("embedding").cast("array<double>"))
    grouped = rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("id", "copies", "label", F.size("embedding").alias("size"), "embedding")


_EDGES = "a bigint, b bigint, cosine double"


def _best(rows: np.ndarray, cosines: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best partners of each row above its `least`: a, b, cosine."""
    np.fill_diagonal(cosines, -2.0)
    k = min(k, cosines.shape[1])
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(cosines, top, axis=1)
    keep = (value > least[:, None]) & (value > -2.0)
    return np.repeat(rows[:, None], k, axis=1)[keep], ids[top][keep], value[keep]


def _emitted(found: list[tuple]) -> pa.RecordBatch:
    a, b, c = (np.concatenate(x) if found else np.zeros(0) for x in (zip(*found, strict=True) if found else ((), (), ())))
    return pa.RecordBatch.from_pydict({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "cosine": pa.array(c.astype(float))})


def first_graph(nodes: DataFrame, k: int, orders: int = ORDERS, begin: int = 0) -> DataFrame:
    """Neighbours in `orders` sorted orders, from number `begin` on: each is one range shuffle of the vectors."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            codes = np.zeros((len(sizes), orders), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                unit = _matrix(batch.column("embedding").take(pa.array(rows)))
                for order in range(orders):
                    side = unit @ np.random.default_rng((begin + order, int(size))).standard_normal((int(size), PLANES)) > 0
                    codes[rows, order] = side @ (1 << np.arange(PLANES - 1, -1, -1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, orders), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [lists], [*kept, "codes"])

    kept = ["id", "label", "size", "embedding"]
    fields = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in kept) + ", codes array<bigint>"
    rows = nodes.select(*kept).mapInArrow(coded, schema).select(*kept, F.posexplode("codes").alias("order", "code"))
    ordered = stored(rows, "embedding-codes").repartitionByRange("label", "size", "order", "code", "id")
    ordered = ordered.sortWithinPartitions("label", "size", "order", "code", "id")

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            same = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "size", "order")], axis=1)
            cuts = [0, *(np.flatnonzero((same[1:] != same[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
            found = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                unit = _matrix(batch.column("embedding").slice(x, y - x))
                for at in range(0, y - x, WINDOW // 2):
                    part = slice(at, min(at + WINDOW, y - x))
                    own = ids[x:y][part]
                    if len(own) > 1:
                        found.append(_best(own, unit[part] @ unit[part].T, own, k, np.full(len(own), -1.5)))
            yield _emitted(found)

    return best_of(ordered.select(*kept, "order").mapInArrow(windowed, _EDGES), k)


def best_of(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each node; Spark keeps k per node and task before the shuffle."""
    ranked = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    once = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).drop("rank")


def descend(lists: DataFrame, nodes: DataFrame, k: int, number: int) -> DataFrame:
    """One round: the neighbours of each node are compared with each other, and what betters a list gets into it."""
    both = lists.select(F.col("a").alias("w"), F.col("b").alias("u")).union(lists.select(F.col("b").alias("w"), F.col("a").alias("u"))).distinct()
    chunks = both.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    worst = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).otherwise(-1.5).alias("worst"))
    member = nodes.select(F.col("id").alias("u"), "embedding").join(worst.withColumnRenamed("a", "u"), "u", "left")
    dealt = both.join(chunks, "w").withColumn("chunk", F.pmod(F.xxhash64("u", F.lit(number)), F.col("chunks")))
    # A chunk has about CHUNK members: they are a hash class of one neighbourhood.
    groups = (
        dealt.join(member, "u")
        .groupBy("w", "chunk")
        .agg(F.collect_list(F.struct("u", F.coalesce("worst", F.lit(-1.5)).alias("worst"), "embedding")).alias("members"))
        .where(F.size("members") > 1)
    )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            ends = members.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = members.flatten()
            ids, least = flat.field("u").to_numpy(), flat.field("worst").to_numpy()
            vectors, found = flat.field("embedding"), []
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                unit = _matrix(vectors.slice(x, y - x))
                found.append(_best(ids[x:y], unit @ unit.T, ids[x:y], k, least[x:y]))
            yield _emitted(found)

    return best_of(groups.select("members").mapInArrow(met, _EDGES).union(lists), k)


def audit(nodes: DataFrame, audited: int = AUDITED, skipped: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """All links (a, b, cosine) of `audited` queries in an order by hash, after the first `skipped`, by comparing them with every vector."""
    ordered = nodes.select("id", "label", "size", "embedding").orderBy(F.xxhash64("id", F.lit("audit")), "id")
    queries = ordered.offset(skipped).limit(audited).toArrow()
    ids = queries.column("id").to_numpy()
    key = list(zip(queries.column("label").to_pylist(), queries.column("size").to_pylist(), strict=True))
    by: dict[tuple, list[int]] = {}
    for at, k in enumerate(key):
        by.setdefault(k, []).append(at)
    vectors = queries.column("embedding").to_pylist()
    parts = [(k, at[i : i + AUDITED]) for k, at in by.items() for i in range(0, len(at), AUDITED)]
    asked = [(k, ids[at], _unit(np.array([vectors[i] for i in at], float))) for k, at in parts]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "size"))
            own, found = batch.column("id").to_numpy(), []
            for (wanted, dimension), of, unit in asked:
                rows = np.flatnonzero((label == wanted) & (size == dimension))
                if len(rows):
                    cosine = unit @ _matrix(batch.column("embedding").take(pa.array(rows))).T
                    q, r = np.nonzero((cosine >= threshold) & (of[:, None] != own[rows][None, :]))
                    found.append((of[q], own[rows][r], cosine[q, r]))
            yield _emitted(found)

    return nodes.select("id", "label", "size", "embedding").mapInArrow(compared, _EDGES)


def audited_links(nodes: DataFrame, few: int, least: int = LEAST_LINKED, threshold: float = THRESHOLD) -> DataFrame:
    """Links of audited queries (a, b, cosine, n: links of a). Blocks are drawn until `least` queries with at most `few` links are among them."""
    total, drawn, block, found = nodes.count(), 0, AUDITED, None
    for _ in range(AUDIT_BLOCKS):
        links = stored(audit(nodes, block, drawn, threshold), "embedding-audit")
        counted = links.join(links.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
        found = counted if found is None else found.union(counted)
        drawn, block = drawn + block, 2 * block
        if drawn >= total or found.where(F.col("n") <= few).select("a").distinct().count() >= least:
            break
    return stored(found, "embedding-audit")


def recall_of(truth: DataFrame, component: DataFrame, few: int) -> float:
    """Mean share of a query's links inside its component; the smaller one of queries with at most `few` links and with more. 1 without links."""
    ends = [component.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")) for end in ("a", "b")]
    met = F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False)).cast("double")
    shares = truth.join(ends[0], "a", "left").join(ends[1], "b", "left").groupBy("a", (F.col("n") <= few).alias("few")).agg(F.avg(met).alias("share"))
    return min((row["recall"] for row in shares.groupBy("few").agg(F.avg("share").alias("recall")).collect()), default=1.0)


def links_within(nodes: DataFrame, component: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Numbers of links of each node inside its component (id, links), counting copies: members are compared block by block."""
    member = nodes.join(component, nodes.id == component.node).select("component", "id", "copies", "embedding")
    sized = component.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = stored(
        member.join(sized, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "embedding-members"
    )
    # Each block meets every block of its component, itself too, in a group of two blocks.
    asking = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.col("block").alias("x"), F.col("other").alias("y"), F.lit(True).alias("asks"), "id", "copies", "embedding"
    )
    answering = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.col("other").alias("x"), F.col("block").alias("y"), F.lit(False).alias("asks"), "id", "copies", "embedding"
    )
    groups = asking.union(answering).groupBy("component", "x", "y").agg(F.collect_list(F.struct("asks", "id", "copies", "embedding")).alias("members"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            ends = members.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = members.flatten()
            ids, copies = flat.field("id").to_numpy(), flat.field("copies").to_numpy()
            asks, vectors = flat.field("asks").to_numpy(zero_copy_only=False), flat.field("embedding")
            out_ids, out_links = [], []
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                unit, asking_here = _matrix(vectors.slice(x, y - x)), asks[x:y].astype(bool)
                own, other = np.flatnonzero(asking_here), np.flatnonzero(~asking_here)
                linked = unit[own] @ unit[other].T >= threshold
                linked &= ids[x:y][own][:, None] != ids[x:y][other][None, :]
                out_ids.append(ids[x:y][own])
                out_links.append(linked @ copies[x:y][other])
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array(np.concatenate(out_ids or [np.zeros(0)]).astype(np.int64)), "links": pa.array(np.concatenate(out_links or [np.zeros(0)]).astype(np.int64))}
            )

    with rows_per_batch(nodes.sparkSession, 8):  # a row has 2 * BLOCK vectors or so
        found = stored(groups.select("members").mapInArrow(counted, "id bigint, links bigint"), "embedding-counts")
    return found.groupBy("id").agg(F.sum("links").alias("links"))


def _near_components(centers: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (p, q) of components that may hold a link between them; `centers`: component, label, size, embedding, radius."""
    sized = centers.groupBy("label", "size").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = centers.drop("blocks").join(sized, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("component"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component", "radius", "embedding"
    )
    groups = met.groupBy("label", "size", "x", "y").agg(
        F.collect_list(F.struct((F.col("block") == F.col("x")).alias("first"), "component", "radius", "embedding")).alias("members")
    )
    room = float(np.arccos(threshold)) + 1e-6  # beyond the rounding of an angle

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            ends = members.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = members.flatten()
            ids, radius, vectors = flat.field("component").to_numpy(), flat.field("radius").to_numpy(), flat.field("embedding")
            first = flat.field("first").to_numpy(zero_copy_only=False).astype(bool)
            inner = (batch.column("x").to_numpy() == batch.column("y").to_numpy()).tolist()
            for x, y, same in zip(ends[:-1].tolist(), ends[1:].tolist(), inner, strict=True):
                unit, own = _matrix(vectors.slice(x, y - x)), np.flatnonzero(first[x:y])
                other = own if same else np.flatnonzero(~first[x:y])
                angle = np.arccos(np.clip(unit[own] @ unit[other].T, -1.0, 1.0))
                close = angle <= radius[x:y][own][:, None] + radius[x:y][other][None, :] + room
                if same:
                    close = np.triu(close, 1)
                a, b = np.nonzero(close)
                yield pa.RecordBatch.from_pydict({"p": pa.array(ids[x:y][own][a]), "q": pa.array(ids[x:y][other][b])})

    with rows_per_batch(centers.sparkSession, 8):
        return stored(groups.select("x", "y", "members").mapInArrow(near, "p bigint, q bigint"), "embedding-near")


def bridges(nodes: DataFrame, lists: DataFrame, component: DataFrame, threshold: float, k: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b, cosine) between saturated nodes of different components: at least one for any two components that have one."""
    full = lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("worst")).where((F.col("n") >= k) & (F.col("worst") >= threshold))
    member = nodes.join(component, nodes.id == component.node).join(full.select(F.col("a").alias("id")), "id", "left_semi")
    member = stored(member.select("component", "id", "label", "size", "embedding"), "embedding-saturated")
    pivots = member.groupBy("component").agg(F.min_by("embedding", "id").alias("pivot"))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = np.zeros(len(batch))
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                one, two = (_matrix(batch.column(c).take(pa.array(rows))) for c in ("embedding", "pivot"))
                angle[rows] = np.arccos(np.clip((one * two).sum(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_pydict({"component": batch.column("component"), "angle": pa.array(angle)})

    away = member.join(pivots, "component").select("component", "size", "embedding", "pivot").mapInArrow(turned, "component bigint, angle double")
    radius = away.groupBy("component").agg(F.max("angle").alias("radius"))
    kinds = member.groupBy("component").agg(
        F.first("label").alias("label"), F.first("size").alias("size"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    centers = stored(kinds.join(pivots.withColumnRenamed("pivot", "embedding"), "component").join(radius, "component"), "embedding-centers")
    pairs = _near_components(centers, threshold, block)
    # Each block of one component meets each block of the other.
    sides = [centers.select(F.col("component").alias(c), F.col("blocks").alias(f"{c}_blocks")) for c in ("p", "q")]
    pairs = pairs.join(sides[0], "p").join(sides[1], "q")
    dealt = member.join(centers.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("component", "block", "id", "embedding")
    meeting = []
    for own, other, x, y in (("p", "q", "x", "y"), ("q", "p", "y", "x")):
        met = pairs.join(dealt.withColumnRenamed("component", own), own).withColumnRenamed("block", x)
        met = met.withColumn(y, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        meeting.append(met.select("p", "q", "x", "y", F.lit(own == "p").alias("first"), "id", "embedding"))
    groups = meeting[0].union(meeting[1]).groupBy("p", "q", "x", "y").agg(F.collect_list(F.struct("first", "id", "embedding")).alias("members"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, found = batch.column("members"), []
            ends = members.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            flat = members.flatten()
            ids, vectors = flat.field("id").to_numpy(), flat.field("embedding")
            first = flat.field("first").to_numpy(zero_copy_only=False).astype(bool)
            for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                unit, own, other = _matrix(vectors.slice(x, y - x)), np.flatnonzero(first[x:y]), np.flatnonzero(~first[x:y])
                if not len(own) or not len(other):
                    continue
                cosine = unit[own] @ unit[other].T
                a, b = np.unravel_index(cosine.argmax(), cosine.shape)
                if cosine[a, b] >= threshold:
                    found.append((ids[x:y][own[a : a + 1]], ids[x:y][other[b : b + 1]], cosine[a, b : b + 1]))
            yield _emitted(found)

    with rows_per_batch(nodes.sparkSession, 8):  # a row has 2 * BLOCK vectors or so
        return stored(groups.select("members").mapInArrow(linked, _EDGES), "embedding-bridges")


def components_of(nodes: DataFrame, lists: DataFrame, threshold: float, k: int) -> DataFrame:
    """node, component by the links in `lists` and those that saturated lists had no room for."""
    links = lists.where(F.col("cosine") >= threshold).select("a", "b")
    component = stored(connected_components(links), "embedding-components")
    across = bridges(nodes, lists, component, threshold, k).select("a", "b")
    if across.isEmpty():
        return component
    held = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stored(connected_components(held.union(across)), "embedding-components")


def near_duplicates(
    embeddings: DataFrame, *, threshold: float = THRESHOLD, k: int = NEIGHBOURS, rounds: int = MOST_ROUNDS, enough: float = ENOUGH
) -> DataFrame:
    """One row per row of `embeddings` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors that are NULL, empty, zero or hold NULL or non-finite numbers, and rows with NULL label or vec_id, link with nothing and are
    their own component. vec_id identifies a vector. An empty table gives an empty result.
    """
    nodes = stored(nodes_of(embeddings), "embedding-nodes")
    lists = stored(first_graph(nodes, k), "embedding-lists")
    few = k
    truth = audited_links(nodes, few, threshold=threshold)
    for enlarged in range(MOST_ENLARGED + 1):
        if enlarged:
            k *= 2
            lists = stored(best_of(lists.union(first_graph(nodes, k, begin=enlarged * ORDERS)), k), "embedding-lists")
        links = lists.where(F.col("cosine") >= threshold).count()
        for number in range(rounds):
            with rows_per_batch(nodes.sparkSession, 256):  # a row has CHUNK vectors or so
                lists = stored(descend(lists, nodes, k, enlarged * rounds + number), "embedding-lists")
            before, links = links, lists.where(F.col("cosine") >= threshold).count()
            if links - before <= NEW_LINKS * max(links, 1):
                break
        component = components_of(nodes, lists, threshold, k)
        recall = recall_of(truth, component, few)
        if recall >= enough:
            break
    else:
        raise RuntimeError(f"recall of audited embeddings is {recall:.4f} with lists of {k}, less than {enough}")
    counted = links_within(nodes, component, threshold)
    classes = nodes.join(component, nodes.id == component.node, "left").join(counted, "id", "left").select(
        F.col("label").alias("_label"),
        F.col("embedding").alias("_embedding"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    joined = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).join(
        classes, (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")) & F.col("vec_id").isNotNull(), "left"
    )
    component_id = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"),
    )
