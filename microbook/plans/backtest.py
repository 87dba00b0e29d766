"""Quote policies over recorded data: every symbol and policy in one job."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from microbook.operators import quotes as K
from microbook.operators.windows import carry_last_score
from microbook.schema import KEYS, MARKOUT_EVENTS, QUOTE_THRESHOLD, SEQ, TICK_SIZE, TOB_COLUMNS


@dataclass
class Backtest:
    quotes: DataFrame
    fills: DataFrame
    summary: DataFrame


def run_backtest(
    tob: DataFrame,
    trades: DataFrame,
    scores: DataFrame,
    *,
    threshold: float = QUOTE_THRESHOLD,
    ttl_events: int = K.QUOTE_TTL,
    markout_events: int = MARKOUT_EVENTS,
    max_events: int | None = None,
    tick_size: int = TICK_SIZE,
) -> Backtest:
    """Naive and score-aware quotes, their fills from the trade tape, and the markout summary.

    `scores` has one row per book row with a NULL-able `score`; the newest one so far drives the score-aware policy.
    """
    rows = tob.select(*KEYS, SEQ, *TOB_COLUMNS)
    if max_events is not None:
        rows, trades, scores = (df.where(f"{SEQ} < {max_events}") for df in (rows, trades, scores))
    known = carry_last_score(scores.select(*KEYS, SEQ, "score")).drop("score")
    scored = rows.join(known, [*KEYS, SEQ])
    quotes = K.naive_quotes(rows).unionByName(K.score_aware_quotes(scored, threshold))
    fills = K.markouts(K.quote_fills(quotes, trades, ttl_events), rows, markout_events, tick_size=tick_size)
    return Backtest(quotes, fills, K.policy_summary(quotes, fills, rows, tick_size=tick_size))
