"""Session calendar from trading-status messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import local_ms
from tickloom.functions.constants import (
    AUCTION_GUARD_MS,
    CALL_GUARD_MS,
    KEY,
    OPEN_GUARD_MS,
    ST_CALL,
    ST_CLOSED,
    ST_OPEN,
    ST_PAUSE,
    ST_PREOPEN,
)


def session_calendar(status: DataFrame) -> DataFrame:
    """One row per (day, sid): open, call, close, valid window, exclusions, valid minutes.

    ``status`` has ``day, sid, sending_time, security_trading_status``.  A day has a
    handful of status messages, so the window per day is small by nature.
    """
    s = status.select(
        *KEY,
        local_ms(F.col("sending_time")).alias("t"),
        F.col("security_trading_status").alias("st"),
    )
    day = Window.partitionBy(*KEY)
    s = s.withColumn("opened", F.min(F.when(F.col("st") == ST_OPEN, F.col("t"))).over(day))
    s = s.withColumn("call", F.min(F.when(F.col("st") == ST_CALL, F.col("t"))).over(day))
    inside = (F.col("t") > F.col("opened")) & (F.col("t") < F.col("call"))
    halted = inside & F.col("st").isin(ST_PREOPEN, ST_PAUSE)
    resumed = inside & (F.col("st") == ST_OPEN)
    ordered = day.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("last_resume", F.max(F.when(resumed, F.col("t"))).over(ordered))
    after = F.coalesce(F.col("last_resume"), F.col("opened"))
    s = s.withColumn("_after", after)
    # an auction starts at the first halt since the last resume and ends at the resume
    epoch = Window.partitionBy(*KEY, "_after").orderBy("t").rowsBetween(
        Window.unboundedPreceding, -1
    )
    s = s.withColumn("halt", F.min(F.when(halted, F.col("t"))).over(epoch))
    auction = F.when(
        resumed & F.col("halt").isNotNull(),
        F.struct(
            F.col("halt").alias("start"), (F.col("t") + AUCTION_GUARD_MS).alias("end")
        ),
    )
    return (
        s.withColumn("auction", auction)
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("n_status"),
            F.first("opened").alias("open_ms"),
            F.first("call").alias("call_ms"),
            F.min(
                F.when((F.col("st") == ST_CLOSED) & (F.col("t") >= F.col("call")), F.col("t"))
            ).alias("close_ms"),
            F.array_sort(F.collect_list("auction")).alias("exclusions"),
        )
        .withColumn("valid_from", F.col("open_ms") + OPEN_GUARD_MS)
        .withColumn("valid_to", F.col("call_ms") - CALL_GUARD_MS)
        .withColumn(
            "status",
            F.when(
                F.col("open_ms").isNotNull()
                & F.col("call_ms").isNotNull()
                & F.col("close_ms").isNotNull(),
                "ok",
            ).otherwise("incomplete"),
        )
        .withColumn(
            "excluded_ms",
            F.aggregate(
                "exclusions",
                F.lit(0).cast("bigint"),
                lambda acc, x: acc + x["end"] - x["start"],
            ),
        )
        .withColumn(
            "valid_minutes",
            F.round((F.col("valid_to") - F.col("valid_from") - F.col("excluded_ms")) / 60000.0, 2),
        )
    )


def parsed_window(text: str) -> tuple[int | None, int, int]:
    """``[DAY:]HHMMSS-HHMMSS`` as (day or None for all days, from, to) in session milliseconds."""
    day, _, span = text.rpartition(":")
    start, end = span.split("-")
    at = lambda hms: (int(hms[:2]) * 3_600 + int(hms[2:4]) * 60 + int(hms[4:6])) * 1_000
    if at(end) <= at(start):
        raise ValueError(f"a window must end after it begins: {text}")
    return (int(day) if day else None, at(start), at(end))


def merged(intervals: Column) -> Column:
    """Sorted intervals (start, end) without overlaps: those that touch become one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def take(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(done) > 0) & (last["end"] >= x["start"])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(
            F.concat(done, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))
        )

    return F.aggregate(F.array_sort(intervals), empty, take)


def excluding(calendar: DataFrame, windows: list[str], hold_out: list[int] | None = None) -> DataFrame:
    """The calendar with further exclusion windows, and without held-out days.

    ``windows`` are texts as ``parsed_window`` reads them; one with a day holds on that day alone.  What phases, segments
    and periods read is the calendar, so everything after it follows.
    """
    spark = calendar.sparkSession
    rows = [parsed_window(w) for w in windows]
    table = spark.createDataFrame(rows or [(None, 0, 0)], "_day int, start bigint, end bigint").filter("end > start")
    added = F.collect_list(F.struct(F.col("start"), F.col("end")))
    days = calendar.select("day").distinct().join(table, F.col("_day").isNull() | (F.col("_day") == F.col("day")), "left")
    by_day = days.filter("start IS NOT NULL").groupBy("day").agg(added.alias("_added"))  # the windows of a day
    kind = calendar.schema["exclusions"].dataType.simpleString()
    both = F.concat("exclusions", F.coalesce("_added", F.array().cast(kind)).cast(kind))
    kept = calendar.filter(~F.col("day").isin(hold_out)) if hold_out else calendar
    clipped = lambda x: F.greatest(
        F.lit(0), F.least(x["end"], F.col("valid_to")) - F.greatest(x["start"], F.col("valid_from"))
    )
    return (
        kept.join(by_day, "day", "left")
        .withColumn("exclusions", merged(both).cast(kind))
        .drop("_added")
        .withColumn("excluded_ms", F.aggregate("exclusions", F.lit(0).cast("bigint"), lambda s, x: s + clipped(x)))
        .withColumn(
            "valid_minutes",
            F.round((F.col("valid_to") - F.col("valid_from") - F.col("excluded_ms")) / 60000.0, 2),
        )
        .select(calendar.columns)
    )


def phase(t: str = "t_ms") -> Column:
    """'C' inside the valid window and outside every exclusion, else 'X'."""
    now = F.col(t)
    blocked = F.exists("exclusions", lambda x: (x["start"] <= now) & (now < x["end"]))
    return F.when(
        (now >= F.col("valid_from")) & (now < F.col("valid_to")) & ~blocked, "C"
    ).otherwise("X")
