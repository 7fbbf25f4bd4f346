"""Time that quote states stood: split at bucket borders, by spread, crossed pairs, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import HOUR_MS, KEY
from tickloom.operators.ordered import carry_scan, previous

#: Longer intervals without a message are not counted as a state, but as dropped time.
MAX_STANDING_MS = 20 * 60_000


def standing(quotes: DataFrame) -> DataFrame:
    """The interval before each message: the quote that stood in it, from ``from_ms`` to ``to_ms``."""
    scanned = carry_scan(quotes, KEY, ["rpt"], [previous("_q", "b", "a", "nb", "na", "t_ms")])
    return scanned.filter("_q.t_ms IS NOT NULL").select(
        *KEY,
        "chunk",
        "rpt",
        F.col("_q.t_ms").alias("from_ms"),
        F.col("t_ms").alias("to_ms"),
        *[F.col(f"_q.{c}").alias(c) for c in ("b", "a", "nb", "na")],
    )


def split_at(intervals: DataFrame, size_ms: int) -> DataFrame:
    """Cut every interval at the borders of buckets of ``size_ms``; empty ones give no rows."""
    first, last = F.expr(f"from_ms div {size_ms}"), F.expr(f"(to_ms - 1) div {size_ms}")
    return (
        intervals.filter("to_ms > from_ms")
        .withColumn("bucket", F.explode(F.sequence(first, last)))
        .withColumn("from_ms", F.greatest("from_ms", F.col("bucket") * size_ms))
        .withColumn("to_ms", F.least("to_ms", (F.col("bucket") + 1) * size_ms))
    )


def kind(limit_ms: int = MAX_STANDING_MS) -> Column:
    """What an interval is: ``negative``, ``gap``, ``one_sided``, ``crossed``, ``locked`` or ``normal``."""
    length, spread = F.col("to_ms") - F.col("from_ms"), F.col("a") - F.col("b")
    return (
        F.when(length < 0, "negative")
        .when(length > limit_ms, "gap")
        .when(spread.isNull(), "one_sided")
        .when(spread < 0, "crossed")
        .when(spread == 0, "locked")
        .otherwise("normal")
    )


def counted(intervals: DataFrame) -> DataFrame:
    """Intervals in which both sides stood, of acceptable length."""
    return intervals.withColumn("kind", kind()).filter("kind IN ('crossed', 'locked', 'normal')")


def spread_by_hour(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Milliseconds of each spread in each hour, and its share of the hour's covered time."""
    parts = split_at(counted(intervals), HOUR_MS).withColumn("spread", F.col("a") - F.col("b"))
    by = [*keys, F.col("bucket").alias("hour")]
    sums = parts.groupBy(*by, "spread").agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("ms"))
    covered = sums.groupBy(*keys, "hour").agg(F.sum("ms").alias("covered_ms"))
    return sums.join(covered, [*keys, "hour"]).withColumn("share", F.col("ms") / F.col("covered_ms"))


def spread_by_day(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Covered time, shares at the least spread (of normal time), crossed and locked, and irregular intervals."""
    labelled = intervals.withColumn("kind", kind()).withColumns(
        {"ms": F.col("to_ms") - F.col("from_ms"), "spread": F.col("a") - F.col("b")}
    )
    of = lambda *kinds: F.col("kind").isin(*kinds)
    by_spread = labelled.groupBy(*keys, "kind", "spread").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))
    time = lambda *kinds: F.sum(F.when(of(*kinds), F.col("ms")).otherwise(0))
    covered = time("crossed", "locked", "normal")
    number = lambda k: F.sum(F.when(of(k), F.col("n")).otherwise(0))
    least = F.when(of("normal") & (F.col("ms") > 0), F.col("spread"))
    return by_spread.groupBy(*keys).agg(
        F.sum("n").alias("intervals"),
        covered.alias("covered_ms"),
        F.try_divide(time("crossed"), covered).alias("crossed_share"),
        F.try_divide(time("locked"), covered).alias("locked_share"),
        F.min(least).alias("least_spread"),
        F.try_divide(F.min_by("ms", least), time("normal")).alias("least_share"),
        number("one_sided").alias("one_sided"),
        number("gap").alias("gaps"),
        time("gap").alias("gap_ms"),
        number("negative").alias("reversals"),
    )


def crossed_pairs(intervals: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    """The crossed quote pairs that stood longest: time, least orders on either side, when."""
    pairs = (
        counted(intervals)
        .filter("kind = 'crossed'")
        .groupBy(*keys, "b", "a")
        .agg(
            F.sum(F.col("to_ms") - F.col("from_ms")).alias("ms"),
            F.min("nb").alias("least_bid_orders"),
            F.min("na").alias("least_ask_orders"),
            F.min("from_ms").alias("first_ms"),
            F.max("to_ms").alias("last_ms"),
        )
    )
    return pairs.orderBy(F.col("ms").desc(), *keys, "b", "a").limit(most)


def coverage_by_hour(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Covered time and messages of every hour."""
    time = split_at(counted(intervals), HOUR_MS).groupBy(*keys, F.col("bucket").alias("hour")).agg(
        F.sum(F.col("to_ms") - F.col("from_ms")).alias("covered_ms")
    )
    messages = intervals.groupBy(*keys, F.expr(f"to_ms div {HOUR_MS}").alias("hour")).agg(F.count("*").alias("messages"))
    both = messages.join(time, [*keys, "hour"], "full")
    return both.fillna(0, ["messages", "covered_ms"])
