"""Book states at event closes: phase, validity, continuous segments, look-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import KEY
from tickloom.operators.ordered import carry_scan, running_last, running_sum
from tickloom.sources.calendar import phase


def with_phase(events: DataFrame, calendar: DataFrame) -> DataFrame:
    window = calendar.select(*KEY, "valid_from", "valid_to", "exclusions")
    return (
        events.join(window, KEY, "left")
        .withColumn("phase", phase("t_ms"))
        .drop("valid_from", "valid_to", "exclusions")
    )


def with_segments(events: DataFrame) -> DataFrame:
    """Event index ``k``, validity and continuous segment; every non-C event is a break."""
    two_sided = F.col("b").isNotNull() & F.col("a").isNotNull()
    valid = F.coalesce(two_sided & (F.col("b") < F.col("a")), F.lit(False))
    return carry_scan(
        events.withColumn("valid", valid),
        KEY,
        ["seq"],
        [
            running_sum("k", F.lit(1).cast("bigint")),
            running_sum("seg", F.when(F.col("phase") != "C", 1).otherwise(0).cast("bigint")),
        ],
    ).withColumn("counted", (F.col("phase") == "C") & F.col("valid"))


def with_history(events: DataFrame) -> DataFrame:
    """Previous counted state of the segment and the latest trades seen in it.

    ``prev`` is NULL on the first counted state after a break: that state is reference
    only; ``prev_any`` ignores breaks.  Trade marks include the event itself and the reference state.
    """
    counted = F.col("counted")
    mark = F.struct("seg", "seq", "t_ms")
    scanned = carry_scan(
        events,
        KEY,
        ["seq"],
        [
            running_last(
                "_prev",
                F.when(counted, F.struct("seg", "seq", "t_ms", "b", "a", "qb", "qa", "rpt", "k")),
                inclusive=False,
            ),
            running_last("_any", F.when(counted & F.col("has_trade"), mark)),
            running_last("_nr", F.when(counted & F.col("has_trade_nr"), mark)),
            running_last("_sell", F.when(counted & (F.col("aggressor") == -1) & F.col("has_trade"), mark)),
            running_last("_buy", F.when(counted & (F.col("aggressor") == 1) & F.col("has_trade"), mark)),
        ],
    )

    def same_segment(name):
        return F.when(counted & (F.col(f"{name}.seg") == F.col("seg")), F.col(name))

    return scanned.select(
        *events.columns,
        F.when(counted, F.col("_prev")).alias("prev_any"),
        F.when(
            (F.col("phase") == "C") & (F.col("_prev.seg") == F.col("seg")), F.col("_prev")
        ).alias("prev"),
        same_segment("_any").alias("trade_any"),
        same_segment("_nr").alias("trade_nr"),
        same_segment("_sell").alias("trade_sell"),
        same_segment("_buy").alias("trade_buy"),
    ).withColumn("reference", F.col("counted") & F.col("prev").isNull())
