"""Daily, hourly and time-of-day overview of the message panel, from one pass over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import HOUR_MS, KEY, MINUTE_MS
from tickloom.operators.tape import spread_durations

CLOCK_MS = 5 * MINUTE_MS             # bucket of the time of day
LENGTHS = ("1", "2", "3", "4p")      # ticks of the spread, four and more together


def spread_counts(tape: DataFrame, size_ms: int) -> DataFrame:
    """How many intervals began at each spread, by bucket (the panel has their time)."""
    kept = spread_durations(tape).filter("NOT dropped")
    at = F.least("spread", F.lit(4))
    return kept.groupBy(*KEY, (F.floor(F.col("from_ms") / size_ms) * size_ms).alias("bucket")).agg(
        *[F.count_if(at == i).alias(f"spread_n_{k}") for i, k in enumerate(LENGTHS, 1)]
    )


def _mean_length(kind: str) -> tuple[Column, list[Column]]:
    """Mean spread in ticks and the share of each length, weighted by ``kind`` (ms or n)."""
    sums = [F.sum(f"spread_{kind}_{k}") for k in LENGTHS]
    total = sums[0] + sums[1] + sums[2] + sums[3]
    mean = sum((i * s for i, s in enumerate(sums[1:], 2)), sums[0])
    return F.try_divide(mean, total), [F.try_divide(s, total) for s in sums]


def overview(panel: DataFrame, counts: DataFrame) -> DataFrame:
    """Sums and ratios of a fine panel by day, by hour of a day, and by time of day over all days.

    ``level`` names the grouping.  Ratios are of sums: the spread is weighted by messages, the
    lengths by time and by number of intervals; ``pressure`` is the bid's part of the touch less the ask's.
    """
    rows = (
        panel.join(counts, [*KEY, "bucket"], "left")
        .fillna(0, [f"spread_n_{k}" for k in LENGTHS])
        .withColumns(
            {
                "hour": F.expr(f"bucket div {HOUR_MS}"),
                "clock": F.expr(f"bucket div {CLOCK_MS} * {CLOCK_MS}"),
                "undercuts": F.col("undercut_bid") + F.col("undercut_ask"),
                "net_undercut": F.col("undercut_bid") - F.col("undercut_ask"),
                "unchanged": F.col("join_best_bid") + F.col("join_best_ask") + F.col("behind_best_bid") + F.col("behind_best_ask"),
                "entered": F.col("new_bid") + F.col("new_ask"),
                "naive": F.col("naive_undercut_bid") + F.col("naive_undercut_ask"),
            }
        )
    )
    sets = [["sid", "day"], ["sid", "day", "hour"], ["sid", "clock"]]
    total = lambda c: F.sum(c).alias(c)
    by_time, time_shares = _mean_length("ms")
    by_number, number_shares = _mean_length("n")
    bid, ask = F.sum("touch_depth_bid"), F.sum("touch_depth_ask")
    grouped = rows.groupingSets(sets, "sid", "day", "hour", "clock").agg(
        F.when(F.grouping("clock") == 0, "clock").when(F.grouping("hour") == 0, "hour").otherwise("day").alias("level"),
        F.count("*").alias("minutes"),
        *[total(c) for c in ("undercuts", "net_undercut", "unchanged", "entered", "naive", "trade_count", "trade_volume")],
        (100 * F.try_divide(F.sum("undercuts"), F.sum("entered"))).alias("undercut_pct"),
        (100 * F.try_divide(F.sum("unchanged"), F.sum("entered"))).alias("unchanged_pct"),
        (F.sum("undercuts") / F.count("*")).alias("undercuts_a_minute"),
        F.try_divide(F.sum("spread_sum"), F.sum("mid_obs")).alias("spread"),
        F.try_divide(bid, F.sum("mid_obs")).alias("bid_depth"),
        F.try_divide(ask, F.sum("mid_obs")).alias("ask_depth"),
        F.try_divide(bid - ask, bid + ask).alias("pressure"),
        F.max_by("close_mid", F.when(F.col("close_mid").isNotNull(), F.struct("day", "bucket"))).alias("last_mid"),
        by_time.alias("length_by_time"),
        by_number.alias("length_by_number"),
        *[s.alias(f"time_share_{k}") for s, k in zip(time_shares, LENGTHS)],
        *[s.alias(f"number_share_{k}") for s, k in zip(number_shares, LENGTHS)],
    )
    return grouped
