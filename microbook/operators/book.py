"""Book analytics as table operators: what rests where, who is ahead, what an order would trade against."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microbook.partitioning import CHUNK, forward_fill, running_sum
from microbook.schema import KEYS, SEQ
from microbook.session import materialise

# --- order events -------------------------------------------------------------------------------------------------


def order_kind() -> Column:
    """What a message does to a resting order; NULL for hidden executions, crosses and halts."""
    kind = F.col("event_type")
    return F.when(kind == 1, "limit").when(kind == 2, "reduce").when(kind == 3, "cancel").when(kind == 4, "execute")


def order_events_of(messages: DataFrame) -> DataFrame:
    """Messages as order events. Hidden executions, crosses and halts do not touch a resting order."""
    keys = [c for c in KEYS if c in messages.columns]
    return messages.withColumn("kind", order_kind()).where("kind IS NOT NULL").select(
        *keys, SEQ, "kind", "order_id", "side", "price", F.col("size").alias("qty")
    )


def inherit_side(events: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Fill the side of replace events from the order they replace, along chains of replaces.

    An id may be entered again: a replace takes the side of the entry of its old id that came last before it. Entries are
    linked by (id, event), so links always lead back in time. Each round doubles the distance that a link spans, and only links whose
    side is still open are joined; an order from before the file leaves its side NULL.
    """
    entry = events.where(F.col("kind").isin("limit", "replace"))
    old = F.when(F.col("kind") == "replace", F.col("old_id"))
    rows = entry.select(*by, "order_id", SEQ, F.when(F.col("kind") == "limit", F.col("side")).alias("_side"), old.alias("_old"))
    earlier = rows.select(*by, F.col("order_id").alias("_old"), F.col(SEQ).alias("_at"))
    parents = rows.where("_old IS NOT NULL").join(earlier, [*by, "_old"]).where(F.col("_at") < F.col(SEQ))
    parents = parents.groupBy(*by, "order_id", SEQ).agg(F.max("_at").alias("_at"), F.first("_old").alias("_old"))
    known = materialise(rows.where("_side IS NOT NULL").select(*by, "order_id", SEQ, "_side"), "links")
    links = materialise(parents, "links")
    while links.head(1):
        up_side = known.select(*by, F.col("order_id").alias("_old"), F.col(SEQ).alias("_at"), "_side")
        found = links.join(up_side, [*by, "_old", "_at"]).select(*by, "order_id", SEQ, "_side")
        known = materialise(known.unionByName(found), "links")
        up = links.select(*by, F.col("order_id").alias("_old"), F.col(SEQ).alias("_at"), F.col("_old").alias("_farther"), F.col("_at").alias("_farther_at"))
        still = links.join(found, [*by, "order_id", SEQ], "left_anti").join(up, [*by, "_old", "_at"])
        links = materialise(still.select(*by, "order_id", SEQ, F.col("_farther_at").alias("_at"), F.col("_farther").alias("_old")), "links")
    return events.join(known, [*by, "order_id", SEQ], "left").withColumn("side", F.coalesce("side", "_side")).drop("_side")


def normalise_order_events(events: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """A replace becomes a cancel of the old order and a new limit order behind the queue; `sub_no` orders the two."""
    cancel = F.struct(
        F.lit(0).alias("sub_no"), F.lit("cancel").alias("kind"), F.col("old_id").alias("order_id"),
        F.lit(None).cast("tinyint").alias("side"), F.lit(None).cast("bigint").alias("price"), F.lit(None).cast("bigint").alias("qty"),
    )

    def same(kind: Column, number: int) -> Column:
        return F.struct(
            F.lit(number).alias("sub_no"), kind.alias("kind"), F.col("order_id"), F.col("side").cast("tinyint").alias("side"),
            F.col("price").cast("bigint").alias("price"), F.col("qty").cast("bigint").alias("qty"),
        )

    parts = F.when(F.col("kind") == "replace", F.array(cancel, same(F.lit("limit"), 1))).otherwise(F.array(same(F.col("kind"), 0)))
    return inherit_side(events, by=by).select(*by, SEQ, F.inline(parts))


_REMOVES = ("reduce", "execute")


def _fold_orders(keys: list[str]):
    """Sequential rule for order ids that are entered more than once. Rows arrive sorted by order and event."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, resting = None, 0
        for batch in batches:
            reasons, effective, after = [], [], []
            for row in batch[[*keys, "kind", "qty"]].itertuples(index=False, name=None):
                key, kind, qty = row[:-2], row[-2], row[-1]
                if key != current:
                    current, resting = key, 0
                reason, done = None, 0
                if kind == "probe":
                    pass
                elif kind != "cancel" and qty <= 0:
                    reason = "bad_qty"
                elif kind == "limit":
                    if resting:
                        reason = "duplicate_id"
                    else:
                        done = resting = qty
                elif not resting:
                    reason = "unknown_id"
                else:
                    done = resting if kind == "cancel" else min(qty, resting)
                    resting -= done
                reasons.append(reason)
                effective.append(done)
                after.append(resting)
            yield batch.assign(reason=reasons, effective_qty=effective, remaining=after)

    return fold


#: Orders with a clash and at most so many events are folded as arrays.
MOST_FOLDED = 1_024


def _short_folds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rule event by event, over the sorted array of an order's events."""
    columns = rows.columns
    order = [SEQ, *(["sub_no"] if "sub_no" in columns else [])]
    carried = [*order, *(c for c in columns if c not in keys and c not in order)]
    history = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_events"))
    start = F.struct(F.lit(0).cast("bigint").alias("rests"), F.array().cast("array<struct<reason: string, effective_qty: bigint, remaining: bigint>>").alias("done"))

    def step(state: Column, event: Column) -> Column:
        rests, qty, what = state["rests"], event["qty"].cast("bigint"), event["kind"]
        reason = (
            F.when(what == "probe", F.lit(None).cast("string")).when((what != "cancel") & (qty <= 0), "bad_qty")
            .when((what == "limit") & (rests > 0), "duplicate_id").when((what != "limit") & (rests == 0), "unknown_id")
        )
        moved = (
            F.when((what == "probe") | reason.isNotNull(), F.lit(0)).when(what == "limit", qty).when(what == "cancel", rests)
            .otherwise(F.least(qty, rests)).cast("bigint")
        )
        after = F.when(what == "limit", rests + moved).otherwise(rests - moved)
        result = F.struct(reason.alias("reason"), moved.alias("effective_qty"), after.alias("remaining"))
        return F.struct(after.alias("rests"), F.concat(state["done"], F.array(result)).alias("done"))

    played = history.withColumn("_done", F.aggregate("_events", start, step)["done"])
    both = played.select(*keys, F.explode(F.arrays_zip("_events", "_done")).alias("_row"))
    return both.select(*[F.col(c) if c in keys else F.col(f"_row._events.{c}") for c in columns], "_row._done.*")


def _histories(rows: DataFrame, keys: list[str], inputs: dict[str, Column], entry: Column) -> DataFrame:
    """Add running totals of `inputs` and `_entry`, the newest entry before the row, in one pass over the rows of each order."""
    ordered = Window.partitionBy(*keys).orderBy("_at")
    totals = rows.withColumns({name: F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for name, value in inputs.items()})
    return totals.withColumn("_entry", F.last(entry, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))


def _long_histories(rows: DataFrame, keys: list[str], inputs: dict[str, Column], entry: Column, size: int) -> DataFrame:
    """The same for orders with very many events, which are spread by chunks of events."""
    totals = running_sum(rows, inputs, by=keys, order=("_at",), size=size)
    entries = totals.select(*keys, (F.col("_at") * 2 + 1).alias("_twice"), entry.alias("_new")).where("_new IS NOT NULL")
    stacked = totals.withColumn("_twice", F.col("_at") * 2).unionByName(entries.withColumn("_only_entry", F.lit(True)), allowMissingColumns=True)
    filled = forward_fill(stacked, {"_entry": F.col("_new")}, by=keys, seq="_twice", size=size)
    return filled.where("_only_entry IS NULL").drop("_twice", "_new", "_only_entry")


def classify_order_events(events: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Add `accepted`, `reason`, `effective_qty` (size really added or removed) and `remaining` (after the event).

    Kinds: limit, reduce, execute, cancel (market and ioc never rest and are only checked for their quantity); a probe changes nothing,
    its `remaining` says what of its id rests at that moment. Replaces go through `classify_replaces`.
    Rejected: quantity not positive, id already resting, cancel or reduction of an id that does not rest.

    What rests of an order is its newest entry minus all removals since, nothing after a cancel: running totals, one shuffle by order.
    Orders with more than `size` events are spread by chunks of events. This holds as long as no id is entered while it
    rests; the few ids where that happens depend on their own history step by step and are folded in a streaming pass over
    sorted rows. The result is stored.
    """
    keys, columns = [*by, "order_id"], events.columns
    one_shot = events.where(F.col("kind").isin("market", "ioc"))
    place = F.col(SEQ) * 2 + (F.col("sub_no") if "sub_no" in columns else F.lit(0))
    keyed = events.where(F.col("kind").isin("limit", "cancel", "probe", *_REMOVES)).withColumn("_at", place)
    valid_add = (F.col("kind") == "limit") & (F.col("qty") > 0)
    removal = F.when(F.col("kind").isin(*_REMOVES) & (F.col("qty") > 0), F.col("qty")).otherwise(F.lit(0)).cast("bigint")
    kill = (F.col("kind") == "cancel").cast("bigint")
    inputs = {"_removed": removal, "_killed": kill}
    entry = F.when(valid_add, F.struct(F.col("qty").cast("bigint").alias("qty"), "_removed", "_killed"))
    long_orders = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(*keys)
    if long_orders.head(1):
        long_orders = materialise(long_orders, "long-orders")
        told = _histories(keyed.join(long_orders, keys, "left_anti"), keys, inputs, entry).unionByName(
            _long_histories(keyed.join(long_orders, keys, "left_semi"), keys, inputs, entry, size)
        )
    else:
        told = _histories(keyed, keys, inputs, entry)
    left = F.col("_entry.qty") - (F.col("_removed") - removal - F.col("_entry._removed"))
    resting = F.when(F.col("_killed") - kill == F.col("_entry._killed"), F.greatest(left, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    reason = (
        F.when(F.col("kind") == "probe", F.lit(None).cast("string"))
        .when((F.col("kind") != "cancel") & (F.col("qty") <= 0), "bad_qty")
        .when((F.col("kind") != "limit") & (F.col("_resting") == 0), "unknown_id")
    )
    effective = (
        F.when(F.col("reason").isNotNull() | (F.col("kind") == "probe"), F.lit(0))
        .when(F.col("kind") == "limit", F.col("qty"))
        .when(F.col("kind") == "cancel", F.col("_resting"))
        .otherwise(F.least("qty", "_resting"))
    ).cast("bigint")
    after = F.when(F.col("kind") == "limit", F.col("_resting") + F.col("effective_qty")).otherwise(
        F.col("_resting") - F.col("effective_qty")
    )
    clash = valid_add & (F.col("_resting") > 0)
    results = [*columns, "reason", "effective_qty", "remaining"]
    simple = (
        told.withColumn("_resting", resting).withColumn("reason", reason).withColumn("effective_qty", effective)
        .withColumn("remaining", after).select(*results, clash.alias("_clash"))
    )
    checked = one_shot.select(
        *columns, F.when(F.col("qty") <= 0, "bad_qty").alias("reason"),
        F.greatest(F.col("qty"), F.lit(0)).cast("bigint").alias("effective_qty"), F.lit(0).cast("bigint").alias("remaining"),
    )
    done = materialise(simple.unionByName(checked.withColumn("_clash", F.lit(False))), "classified")
    if done.where("_clash").head(1):
        rest = F.col("kind").isin("market", "ioc")
        clashing = done.where("_clash").select(*keys).distinct()
        counted = done.where(~rest).join(clashing, keys, "left_semi").groupBy(*keys).agg((F.count("*") > MOST_FOLDED).alias("_long"))
        clashing = materialise(counted, "clashing-orders")
        apart = done.where(~rest).join(clashing, keys)
        folded = _short_folds(apart.where("NOT _long").select(*columns), keys)
        if clashing.where("_long").head(1):
            order = [*keys, SEQ, *(["sub_no"] if "sub_no" in columns else [])]
            many = apart.where("_long").select(*columns)
            out_schema = T.StructType(
                [*many.schema.fields, T.StructField("reason", T.StringType()), T.StructField("effective_qty", T.LongType()),
                 T.StructField("remaining", T.LongType())]
            )
            folded = folded.unionByName(many.repartition(*keys).sortWithinPartitions(*order).mapInPandas(_fold_orders(keys), out_schema))
        folded = materialise(folded.select(*results), "clashing-orders")
        done = done.where(rest).unionByName(done.where(~rest).join(clashing, keys, "left_anti")).select(*results).unionByName(folded)
    return done.select(*results, F.col("reason").isNull().alias("accepted"))


def classify_replaces(events: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """As `classify_order_events`, for events that hold replaces (`old_id` -> `order_id`).

    A replace is one event with one verdict: it is refused as a whole, and the old order stays, if its quantity is not positive, its
    old order does not rest, or its new id rests already and is not the old one. An accepted one comes out as a cancel (`sub_no` 0)
    and a limit (`sub_no` 1), a refused one as a single rejected row of kind replace.

    Verdicts depend on earlier verdicts only. Rounds start with all replaces accepted; refused ones stay in as probes, which change
    nothing but see what rests. Each round settles at least the earliest open verdict of every chain, so they end. The first round plays
    all orders, each later one only the orders that a verdict of the round before has changed; all are played once more at the end.
    """
    keys = [*by, SEQ]
    replace = events.where("kind = 'replace'")
    flat = normalise_order_events(events, by=by)
    same = replace.select(*keys, "old_id", F.col("order_id").alias("_new_id"), (F.col("old_id") == F.col("order_id")).alias("_same"), (F.coalesce("qty", F.lit(0)) > 0).alias("_valid"))
    flat = materialise(flat.join(same.select(*keys, "_same", "_valid"), keys, "left"), "flat")

    def play(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
        judged = rows.join(verdicts.select(*keys, "_ok"), keys, "left")
        return classify_order_events(judged.withColumn("kind", F.when(~F.col("_ok"), F.lit("probe")).otherwise(F.col("kind"))), by=by, size=size)

    probed = F.col("kind") == "probe"
    old_rests = F.when(F.col("sub_no") == 0, F.when(probed, F.col("remaining") > 0).otherwise(F.col("accepted")))
    new_free = F.when(F.col("sub_no") == 1, F.when(probed, (F.col("remaining") == 0) | F.col("_same")).otherwise(F.col("accepted")))
    seen = {"_old_rests": old_rests, "_new_free": new_free}
    verdicts = materialise(
        same.withColumns({"_ok": F.col("_valid"), **{name: F.lit(None).cast("boolean") for name in seen}}), "verdicts"
    )
    played = flat
    while True:
        classified = play(played, verdicts)
        halves = classified.where("_valid IS NOT NULL").groupBy(*keys).agg(*[F.max(value).alias(f"_now{name}") for name, value in seen.items()])
        now = verdicts.join(halves, keys, "left").withColumns({name: F.coalesce(f"_now{name}", name) for name in seen})
        verdicts = materialise(
            now.withColumn("_before", F.col("_ok")).withColumn("_ok", F.col("_valid") & F.col("_old_rests") & F.col("_new_free"))
            .select(*same.columns, *seen, "_ok", "_before"),
            "verdicts",
        )
        changed = verdicts.where("_ok <> _before")
        if not changed.head(1):
            break
        touched = changed.select(*[F.col(c).alias(f"_at_{c}") for c in by], F.explode(F.array("old_id", "_new_id")).alias("_at_order_id")).distinct()
        same_order = F.expr(" AND ".join(f"`{c}` <=> `_at_{c}`" for c in (*by, "order_id")))
        verdicts = verdicts.drop("_before")
        played = flat.where(~F.col("kind").isin("market", "ioc")).join(touched, same_order, "left_semi")
    if played is not flat:
        classified = play(flat, verdicts)
    why = F.when(~F.col("_valid"), "bad_qty").when(~F.col("_old_rests"), "unknown_id").otherwise("duplicate_id")
    nothing = F.lit(0).cast("bigint")
    refused = replace.join(verdicts.where("NOT _ok").select(*keys, "_ok", "_valid", *seen), keys).select(
        *by, SEQ, F.lit(0).alias("sub_no"), "kind", "order_id", F.col("side").cast("tinyint").alias("side"), F.col("price").cast("bigint").alias("price"),
        F.col("qty").cast("bigint").alias("qty"), why.alias("reason"), nothing.alias("effective_qty"), nothing.alias("remaining"), F.lit(False).alias("accepted"),
    )
    return classified.where("kind <> 'probe'").select(*refused.columns).unionByName(refused)


def accepted_log(classified: DataFrame) -> DataFrame:
    """The events that would be logged: rejected ones leave no trace."""
    return classified.where("accepted")


def accepted_events(events: DataFrame, classified: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """The source events that were accepted, one row each, replaces too."""
    return events.join(classified.where("accepted").select(*by, SEQ).distinct(), [*by, SEQ], "left_semi")


def unknown_cancels(classified: DataFrame) -> DataFrame:
    return classified.where("kind = 'cancel' AND reason = 'unknown_id'")


def order_lifecycle(classified: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """One row per order that was ever entered."""

    def total(*kinds: str) -> Column:
        return F.sum(F.when(F.col("accepted") & F.col("kind").isin(*kinds), F.col("effective_qty")).otherwise(F.lit(0)))

    rows = classified.where(F.col("kind").isin("limit", "cancel", *_REMOVES)).groupBy(*by, "order_id").agg(
        total("limit").alias("submitted"),
        total("cancel", "reduce").alias("cancelled"),
        total("execute").alias("executed"),
        F.min(F.when(F.col("accepted"), F.col(SEQ))).alias("first_seq"),
        F.max(F.when(F.col("accepted"), F.col(SEQ))).alias("last_seq"),
        F.max_by(F.when(F.col("accepted") & (F.col("kind") != "limit"), F.col("kind")), F.when(F.col("accepted"), F.col(SEQ))).alias("_last"),
    ).where("submitted > 0")
    remaining = F.col("submitted") - F.col("cancelled") - F.col("executed")
    state = (
        F.when(remaining > 0, F.when(F.col("executed") > 0, "part_filled").otherwise("resting"))
        .when(F.col("_last") == "execute", "filled").otherwise("cancelled")
    )
    return rows.select(*by, "order_id", "submitted", "cancelled", "executed", remaining.alias("remaining"), "first_seq", "last_seq", state.alias("state"))


# --- price levels -------------------------------------------------------------------------------------------------


def depth_change() -> Column:
    """What a message adds to the visible size at its side and price. A hidden execution changes nothing."""
    kind, size = F.col("event_type"), F.col("size")
    return F.when(kind == 1, size).when(kind.isin(2, 3, 4), -size).otherwise(F.lit(0))


def effective_changes(messages: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Messages with `_change`, what they really add to their level: nothing for a removal of an order that does not rest, and never
    more than rests of it."""
    kind = order_kind()
    columns = messages.columns
    rows = messages.withColumns({"kind": kind, "qty": F.col("size").cast("bigint")})
    done = classify_order_events(rows.where("kind IS NOT NULL"), by=by, size=size)
    change = F.when(F.col("kind") == "limit", F.col("effective_qty")).otherwise(-F.col("effective_qty")).cast("bigint")
    still = rows.where("kind IS NULL").select(*columns, F.lit(0).cast("bigint").alias("_change"))
    return done.select(*columns, change.alias("_change")).unionByName(still)


def depth_by_level(
    messages: DataFrame, initial_depth: DataFrame | None = None, *, by: Sequence[str] = KEYS, size: int = CHUNK
) -> DataFrame:
    """Add `depth`: the size resting at the row's side and price after the row.

    Accepted events count with their effective size: removals of unseen orders change nothing. With `initial_depth` (by, side,
    price, size), what rested before the first message, orders may stem from there, so every removal counts and a level never falls
    below zero in the result. A hidden execution changes nothing.
    """
    if initial_depth is None:
        rows = effective_changes(messages, by=by, size=size)
    else:
        rows = messages.withColumn("_change", depth_change())
        start = initial_depth.select(*by, "side", "price", F.lit(-1).cast("bigint").alias(SEQ), F.col("size").alias("_change"))
        rows = rows.unionByName(start, allowMissingColumns=True)
    summed = running_sum(rows, {"_depth": F.col("_change")}, by=(*by, "side", "price"), size=size)
    return summed.where(F.col(SEQ) >= 0).withColumn("depth", F.greatest("_depth", F.lit(0))).drop("_change", "_depth")


def level_quantity(depth: DataFrame, lookups: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Resting size at each (side, price) of `lookups` after the last message; 0 for a level without orders."""
    final = depth.groupBy(*by, "side", "price").agg(F.max_by("depth", SEQ).alias("quantity"))
    return lookups.join(final, [*by, "side", "price"], "left").withColumn("quantity", F.coalesce("quantity", F.lit(0)))


def queue_ahead(messages: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """For each new order: the size that already rests at its price and is served first."""
    depth = depth_by_level(messages, by=by, size=size)
    adds = depth.where("event_type = 1")
    return adds.withColumn("queue_ahead", F.greatest(F.col("depth") - F.col("size"), F.lit(0))).drop("depth")


#: Messages of one step of the ladder: below it levels are laid out message by message, above it by ranges of steps.
LADDER_STEP = 16


def level_intervals(changed: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """(by, side, price, begin, until, quantity): when a level held which size, from `changed` (by, seq, side, price, change).

    `until` is exclusive and NULL for what holds to the end. Rows of a level are spread by chunks of `size` events; an interval ends with
    its chunk, and the chunk's total goes on from there to the level's next change. So a level that a third of all messages
    touch is many tasks.
    """
    level = [*by, "side", "price"]
    moves = changed.where(F.col("change") != 0).withColumn("_chunk", F.expr(f"{SEQ} div {size}"))
    parts = moves.groupBy(*level, "_chunk").agg(F.sum("change").alias("change"), F.min(SEQ).alias("_first"))
    along = Window.partitionBy(*level).orderBy("_chunk")
    so_far = F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = parts.withColumns({"_total": so_far, "_next": F.lead("_chunk").over(along), "_next_first": F.lead("_first").over(along)})
    behind = totals.select(*level, ((F.col("_chunk") + 1) * size).alias("begin"), F.col("_next_first").alias("until"), F.col("_total").alias("quantity"))
    carry = totals.where("_next IS NOT NULL").select(*level, F.col("_next").alias("_chunk"), F.lit(-2).cast("bigint").alias(SEQ), F.col("_total").alias("change"))
    inside = Window.partitionBy(*level, "_chunk").orderBy(SEQ)
    held = moves.select(*level, "_chunk", SEQ, "change").unionByName(carry).select(
        *level, F.col(SEQ).alias("begin"), F.coalesce(F.lead(SEQ).over(inside), (F.col("_chunk") + 1) * size).alias("until"),
        F.sum("change").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("quantity"),
    ).where("begin > -2")
    return held.unionByName(behind).where("quantity > 0 AND (until IS NULL OR until > begin)")


def _cover(first: Column, last: Column) -> Column:
    """The steps first..last - 1 as few aligned ranges of 2^h steps, (h, number) each: two at most per h."""

    def at_height(h: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), h)
        low, high = F.ceil(first / width).cast("bigint"), F.floor(last / width).cast("bigint")
        whole = low < high

        def node(number: Column) -> Column:
            return F.struct(h.cast("bigint").alias("h"), number.alias("node"))

        return F.array(F.when(whole & (low % 2 == 1), node(low)), F.when(whole & (high % 2 == 1), node(high - 1)))

    heights = F.sequence(F.lit(0), F.floor(F.log2((last - first).cast("double"))).cast("int"))
    return F.filter(F.flatten(F.transform(heights, at_height)), lambda node: node.isNotNull())


def ladder_over_time(
    messages: DataFrame,
    levels: int = 1,
    initial_depth: DataFrame | None = None,
    *,
    by: Sequence[str] = KEYS,
    size: int = LADDER_STEP,
) -> DataFrame:
    """Best `levels` prices and sizes of both sides after each message; NULL price and size 0 where a side is shallower.

    No book is replayed. Each level's sizes are intervals of the event index. An interval is laid out message by message only in the
    steps of `size` messages where it begins and ends; the whole steps between are covered by few aligned ranges of 2^h steps. A range
    keeps its best `levels` alone, so what a step inherits is bounded by the ladder and the number of heights, whatever the book holds.
    """
    if initial_depth is None:
        changed = materialise(effective_changes(messages, by=by).select(*by, SEQ, "side", "price", F.col("_change").alias("change")), "changes")
    else:
        changed = messages.select(*by, SEQ, "side", "price", depth_change().cast("bigint").alias("change"))
    side_type = dict(changed.dtypes)["side"]
    moves = changed
    if initial_depth is not None:
        start = initial_depth.select(
            *by, F.lit(-1).cast("bigint").alias(SEQ), F.col("side").cast(side_type).alias("side"), "price", F.col("size").cast("bigint").alias("change")
        )
        moves = changed.unionByName(start)
    ends = changed.groupBy(*by).agg((F.max(SEQ) + 1).alias("_end"))
    rank = (-F.col("side") * F.col("price")).cast("bigint").alias("rank")  # smaller is better
    held = level_intervals(moves, by=by).join(ends, list(by)).select(
        *by, F.col("side").cast("tinyint").alias("side"), rank, "quantity", F.greatest("begin", F.lit(0)).alias("begin"), F.coalesce("until", "_end").alias("until")
    )
    held = materialise(held.where("until > begin"), "level-intervals")  # read twice
    first, last = F.ceil(F.col("begin") / size).cast("bigint"), F.expr(f"until div {size}")  # whole steps

    # Whole steps: the best of each range, then of each step.
    spans = held.select(*by, "side", "rank", "quantity", first.alias("_first"), last.alias("_last")).where("_first < _last")
    nodes = spans.select(*by, "side", "rank", "quantity", F.inline(_cover(F.col("_first"), F.col("_last"))))
    best = Window.partitionBy(*by, "side", "h", "node").orderBy("rank")
    nodes = nodes.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= levels).drop("_n")
    begin, stop = F.expr("shiftleft(node, h)"), F.expr("shiftleft(node + 1, h) - 1")
    coarse = nodes.withColumn("_from", F.explode(F.sequence(begin, stop, F.lit(1_024).cast("bigint")))).withColumn("_to", F.least(F.col("_from") + 1_023, stop))
    inherited = coarse.select(*by, "side", "rank", "quantity", F.explode(F.sequence("_from", "_to")).alias("_step"))
    best = Window.partitionBy(*by, "_step", "side").orderBy("rank")
    inherited = inherited.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= levels)
    inherited = inherited.select(*by, "_step", "side", "rank", "quantity", (F.col("_step") * size).alias("begin"), ((F.col("_step") + 1) * size).alias("until"))

    # Parts of steps: before the first whole one and behind the last, or all of a short interval.
    edge = F.least(F.col("until"), first * size)
    parts = F.array(
        F.struct("begin", edge.alias("until")),
        F.when(F.col("until") > F.greatest(edge, last * size), F.struct(F.greatest(edge, last * size).alias("begin"), "until")),
    )
    pieces = held.select(*by, "side", "rank", "quantity", F.inline(F.filter(parts, lambda x: x["until"] > x["begin"])))
    pieces = pieces.withColumn("_step", F.expr(f"begin div {size}"))
    asked = changed.select(*by, F.expr(f"{SEQ} div {size}").alias("_step"), SEQ, F.lit(True).alias("_asked"))

    # Everything about a step meets in one task; no further shuffle.
    stacked = pieces.unionByName(inherited).unionByName(asked, allowMissingColumns=True).repartition(*by, "_step")
    at = F.when(F.col("_asked"), F.array(F.col(SEQ))).otherwise(F.sequence("begin", F.col("until") - 1))
    laid = stacked.select(*by, "_step", F.explode(at).alias(SEQ), "side", "rank", "quantity", "_asked")
    shown = F.max("_asked").alias("_asked")
    if levels == 1:
        tops = [
            (F.min(F.when(F.col("side") == side, F.col("rank"))).alias(f"{name}_rank"), F.min_by("quantity", F.when(F.col("side") == side, F.col("rank"))).alias(f"{name}_size_l1"))
            for side, name in ((1, "bid"), (-1, "ask"))
        ]
        rows = laid.groupBy(*by, "_step", SEQ).agg(shown, *[cell for pair in tops for cell in pair])
        cells = [c for side, name in ((1, "bid"), (-1, "ask")) for c in (
            (-side * F.col(f"{name}_rank")).cast("bigint").alias(f"{name}_price_l1"), F.coalesce(f"{name}_size_l1", F.lit(0)).cast("bigint").alias(f"{name}_size_l1"))]
    else:
        found = [F.collect_list(F.when(F.col("side") == side, F.struct("rank", "quantity"))).alias(name) for side, name in ((1, "bid"), (-1, "ask"))]
        rows = laid.groupBy(*by, "_step", SEQ).agg(shown, *found).withColumns({name: F.array_sort(name) for name in ("bid", "ask")})
        cells = []
        for i in range(1, levels + 1):
            for side, name in ((1, "bid"), (-1, "ask")):
                cell = F.get(name, F.lit(i - 1))
                cells += [(-side * cell["rank"]).cast("bigint").alias(f"{name}_price_l{i}"), F.coalesce(cell["quantity"], F.lit(0)).cast("bigint").alias(f"{name}_size_l{i}")]
    return rows.where("_asked").select(*by, SEQ, *cells)


def best_prices(messages: DataFrame, initial_depth: DataFrame | None = None, *, by: Sequence[str] = KEYS, size: int = LADDER_STEP) -> DataFrame:
    return ladder_over_time(messages, 1, initial_depth, by=by, size=size)


def top_levels(level_sizes: DataFrame, levels: int = 5, *, by: Sequence[str]) -> DataFrame:
    """Best prices with the sizes of the next levels, one row per `by`: L1 price and size, then sizes (0 if shallow)."""
    priority = F.when(F.col("side") == 1, -F.col("price")).otherwise(F.col("price"))
    ranked = level_sizes.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by, "side").orderBy(priority)))

    def pick(side: int, rank: int, column: str) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("_rank") == rank), F.col(column)))

    cells = []
    for side, name in ((1, "bid"), (-1, "ask")):
        cells.append(pick(side, 1, "price").alias(f"{name}_price_l1"))
        cells += [F.coalesce(pick(side, i, "quantity"), F.lit(0)).alias(f"{name}_size_l{i}") for i in range(1, levels + 1)]
    return ranked.where(F.col("_rank") <= levels).groupBy(*by).agg(*cells)


# --- the book at an event -----------------------------------------------------------------------------------------


def book_at(classified: DataFrame, positions: DataFrame, *, by: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Orders resting after each of `positions` (by, at_seq): id, side, price, remaining size, entry index.

    Events and positions are numbered together, so each event knows the first position that it counts for. Per order the net changes
    between positions add up to intervals of positions with one size; only what rests is repeated, once for each position of its
    interval. Rows grow with the events and the result, not with their product.
    """
    signed = F.when(F.col("kind") == "limit", F.col("effective_qty")).otherwise(-F.col("effective_qty"))
    moves = classified.where(F.col("accepted") & F.col("kind").isin("limit", "cancel", *_REMOVES)).select(
        *by, SEQ, "order_id", signed.alias("_net"), F.when(F.col("kind") == "limit", F.struct(SEQ, "side", "price")).alias("_entry")
    )
    stops = positions.select(*by, F.col("at_seq").cast("bigint").alias(SEQ)).distinct().withColumn("_stop", F.lit(1).cast("bigint"))
    both = moves.withColumn("_stop", F.lit(0).cast("bigint")).unionByName(stops, allowMissingColumns=True)
    # At the same index the event comes before the position, which includes it.
    passed = running_sum(both, {"_passed": F.col("_stop")}, by=by, order=(SEQ, "_stop"), size=size)
    numbered = passed.where("_stop = 1").select(*by, F.col("_passed").alias("_number"), F.col(SEQ).alias("at_seq"))
    net = passed.where("_stop = 0").groupBy(*by, "order_id", (F.col("_passed") + 1).alias("_first")).agg(
        F.sum("_net").alias("_net"), F.max("_entry").alias("_entry")
    )
    along = Window.partitionBy(*by, "order_id").orderBy("_first")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = numbered.groupBy(*by).agg(F.max("_number").alias("_last"))
    rests = net.withColumns(
        {"remaining": F.sum("_net").over(so_far), "_entry": F.max("_entry").over(so_far), "_until": F.lead("_first").over(along)}
    ).where("remaining > 0")
    spans = rests.join(last, list(by)).withColumn("_until", F.coalesce("_until", F.col("_last") + 1)).where("_first < _until")
    return (
        spans.withColumn("_number", F.explode(F.sequence("_first", F.col("_until") - 1))).join(numbered, [*by, "_number"])
        .select("at_seq", *by, "order_id", "_entry.side", "_entry.price", "remaining", F.col(f"_entry.{SEQ}").alias("entry_seq"))
    )


def level_sizes(resting: DataFrame, *, by: Sequence[str]) -> DataFrame:
    return resting.groupBy(*by, "side", "price").agg(F.sum("remaining").alias("quantity"), F.count("*").alias("orders"))


def locate_orders(ids: DataFrame, resting: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Side and price of an order, only while it rests."""
    return ids.join(resting.select(*by, "order_id", "side", "price", "remaining"), [*by, "order_id"])


# --- what an order would trade ------------------------------------------------------------------------------------


def _in_cap(price: Column) -> Column:
    limit = F.col("limit_price")
    return (F.col("kind") == "market") | F.when(F.col("side") == 1, price <= limit).otherwise(price >= limit)


def sweep_ladder(snapshots: DataFrame, levels: int) -> DataFrame:
    """Trade each row's order (`side, kind, limit_price, qty`) against the depth columns of the same row.

    Adds filled_qty, levels_touched, avg_price, slippage against the best opposite price (in price units, positive = worse),
    rests_qty (limit) and dropped_qty (market, ioc). Stays within the row: no shuffle.
    """
    ladder = F.when(
        F.col("side") == 1, F.array(*[F.struct(F.col(f"ask_price_l{i}").alias("p"), F.col(f"ask_size_l{i}").alias("q")) for i in range(1, levels + 1)])
    ).otherwise(F.array(*[F.struct(F.col(f"bid_price_l{i}").alias("p"), F.col(f"bid_size_l{i}").alias("q")) for i in range(1, levels + 1)]))
    start = F.struct(
        F.col("qty").cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("touched")
    )

    def step(acc: Column, level: Column) -> Column:
        usable = level["p"].isNotNull() & F.coalesce(_in_cap(level["p"]), F.lit(False))
        take = F.when(usable, F.least(acc["left"], F.coalesce(level["q"], F.lit(0)))).otherwise(F.lit(0))
        return F.struct(
            (acc["left"] - take).alias("left"), (acc["value"] + take * level["p"]).alias("value"),
            (acc["touched"] + (take > 0).cast("bigint")).alias("touched"),
        )

    checked = snapshots.withColumn("_swept", F.aggregate(ladder, start, step))
    filled = F.col("qty") - F.col("_swept.left")
    best = F.when(F.col("side") == 1, F.col("ask_price_l1")).otherwise(F.col("bid_price_l1"))
    average = F.try_divide(F.col("_swept.value").cast("double"), filled.cast("double"))
    return checked.withColumns(
        {
            "filled_qty": filled,
            "levels_touched": F.col("_swept.touched"),
            "avg_price": average,
            "slippage": (average - best) * F.col("side"),
            "rests_qty": F.when(F.col("kind") == "limit", F.col("_swept.left")).otherwise(F.lit(0)),
            "dropped_qty": F.when(F.col("kind") != "limit", F.col("_swept.left")).otherwise(F.lit(0)),
        }
    ).drop("_swept")


def sweep_orders(resting: DataFrame, orders: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Fills of one incoming order per `by` against resting orders, in touch order, at the maker's price.

    resting: by, order_id, side, price, remaining, entry_seq; orders: by, taker_id, side, kind, limit_price, qty.
    Level totals are accumulated by price first, then orders inside a level by entry, so a deep book is spread by level.
    An order that meets its own id is kept and flagged `self_trade`.
    """
    opposite = resting.select(
        *by, F.col("order_id").alias("maker_id"), F.col("side").alias("_maker_side"), F.col("price"), "remaining", "entry_seq"
    )
    facing = opposite.join(orders, list(by)).where((F.col("_maker_side") == -F.col("side")) & _in_cap(F.col("price")))
    priority = F.when(F.col("side") == 1, F.col("price")).otherwise(-F.col("price"))
    facing = facing.withColumn("_priority", priority)
    totals = facing.groupBy(*by, "_priority").agg(F.sum("remaining").alias("_level"))
    ahead = Window.partitionBy(*by).orderBy("_priority").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = totals.withColumn("_before", F.sum("_level").over(ahead) - F.col("_level")).drop("_level")
    queue = Window.partitionBy(*by, "_priority").orderBy("entry_seq", "maker_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = facing.join(levels, [*by, "_priority"]).where(F.col("_before") < F.col("qty"))
    placed = reached.withColumn("_before", F.col("_before") + F.sum("remaining").over(queue) - F.col("remaining"))
    taken = placed.withColumn("quantity", F.least("remaining", F.col("qty") - F.col("_before"))).where("quantity > 0")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("_priority", "entry_seq", "maker_id"))
    return taken.select(
        *by, number.alias("fill_no"), "taker_id", "maker_id", "price", "quantity",
        (F.col("taker_id") == F.col("maker_id")).alias("self_trade"),
    )


# --- invariants ---------------------------------------------------------------------------------------------------


def book_invariants(classified: DataFrame, ladder: DataFrame, *, by: Sequence[str] = KEYS) -> DataFrame:
    """Number of violations per check; all zero for a consistent stream."""
    tops = ladder.agg(
        F.count_if(F.col("bid_price_l1") >= F.col("ask_price_l1")).alias("crossed"),
        F.count_if(
            (F.col("bid_price_l1").isNotNull() & (F.col("bid_size_l1") <= 0))
            | (F.col("ask_price_l1").isNotNull() & (F.col("ask_size_l1") <= 0))
        ).alias("empty_top"),
    )
    orders = classified.where("accepted").groupBy(*by, "order_id").agg(
        F.sum((F.col("kind") == "limit").cast("int")).alias("_in"), F.sum((F.col("kind") == "cancel").cast("int")).alias("_out"),
        F.min("remaining").alias("_least"),
    )
    ids = orders.agg(
        F.count_if(F.col("_out") > F.col("_in")).alias("double_cancel"), F.count_if(F.col("_least") < 0).alias("negative_remaining")
    )
    return _rows_of(tops, ("crossed", "empty_top")).unionByName(_rows_of(ids, ("double_cancel", "negative_remaining")))


def _rows_of(counts: DataFrame, checks: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in checks]
    return counts.select(F.inline(F.array(*cells)))
