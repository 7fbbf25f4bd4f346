"""Five-minute panel of the clock-ordered feed: undercut share of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import local_ms
from tickloom.functions.constants import BLOCK_MS, KEY, TICK_POINTS


def clock_panel(rows: DataFrame, size_ms: int = BLOCK_MS) -> DataFrame:
    """Undercuts per message against a forward-filled top that restarts in each window.

    ``rows`` come from ``thesis_rows``; equal clocks are ordered by message and position.
    """
    t = F.when(F.col("time_seq") >= 10**16, local_ms(F.col("time_seq")))
    base = rows.withColumn("t_ms", t).withColumn(
        "bucket", F.floor(F.col("t_ms") / size_ms) * size_ms
    )
    order = Window.partitionBy(*KEY, "bucket").orderBy("time_seq", "msg_seq_num", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bid = F.when(F.col("entry_type") == "0", F.col("price"))
    ask = F.when(F.col("entry_type") == "1", F.col("price"))
    filled = base.select(
        *KEY,
        "bucket",
        "entry_type",
        "action",
        "price",
        F.last(bid, True).over(upto).alias("bid"),
        F.last(ask, True).over(upto).alias("ask"),
        F.last(bid, True).over(before).alias("bid0"),
        F.last(ask, True).over(before).alias("ask0"),
    )
    under = (F.col("action") == 0) & (
        ((F.col("entry_type") == "0") & (F.col("price") > F.col("bid0")))
        | ((F.col("entry_type") == "1") & (F.col("price") < F.col("ask0")))
    )
    mid = (F.col("bid") + F.col("ask")) / 2.0
    panel = filled.groupBy(*KEY, "bucket").agg(
        F.count_if(under).alias("undercuts"),
        F.count("*").alias("messages"),
        F.avg(F.when(F.col("ask") > F.col("bid"), F.col("ask") - F.col("bid"))).alias("spread_mean"),
        F.avg(mid).alias("mid_mean"),
        F.stddev_samp(mid).alias("mid_sd"),
    )
    return panel.withColumn("rel_spread", F.col("spread_mean") / F.col("mid_mean")).withColumn(
        "undercut_share", F.col("undercuts") / F.col("messages")
    )


def wide_windows(panel: DataFrame) -> DataFrame:
    """Windows whose mean spread exceeds one tick and that have a ratio."""
    return panel.filter(
        (F.col("spread_mean") > TICK_POINTS) & F.col("rel_spread").isNotNull()
    )
