"""Profile of a feed: value domains, fill rates, sequence gaps, price steps, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.feed import entries, price

PROFILED = [
    "md_entry_type", "md_update_action", "order_id", "md_entry_size", "trade_condition",
    "md_entry_buyer", "md_entry_seller", "trade_id", "md_entry_px",
]


def fill_rates(feed: DataFrame) -> DataFrame:
    """Rows and share of filled fields per entry type."""
    rows = entries(feed, PROFILED)
    return rows.groupBy(F.col("e_md_entry_type").alias("entry_type")).agg(
        F.count("*").alias("n"),
        *[
            (F.count(f"e_{f}") / F.count("*")).alias(f"fill_{f}")
            for f in PROFILED
            if f != "md_entry_type"
        ],
    )


def roles(profile: DataFrame) -> DataFrame:
    """Structural role of each entry type by what it carries."""
    return profile.select(
        "entry_type",
        "n",
        F.when(F.col("fill_trade_id") > 0.5, "trade")
        .when(F.col("fill_order_id") > 0.5, "book")
        .otherwise("statistic")
        .alias("role"),
        F.when(F.col("fill_trade_id") > 0.5, None)
        .when(F.col("fill_md_entry_buyer") > F.col("fill_md_entry_seller"), "bid")
        .when(F.col("fill_md_entry_seller") > F.col("fill_md_entry_buyer"), "ask")
        .alias("book_side"),
    )


def cross_table(feed: DataFrame) -> DataFrame:
    """Entries of each type by action; whatever is none of the three known is ``other``."""
    action = F.col("e_md_update_action")
    known = {"new": 0, "change": 1, "delete": 2}
    counts = [F.count_if(action == code).alias(name) for name, code in known.items()]
    other = F.count_if(action.isNull() | ~action.isin(*known.values())).alias("other")
    rows = entries(feed, ["md_entry_type", "md_update_action"])
    return rows.groupBy(F.col("e_md_entry_type").alias("entry_type")).agg(*counts, other)


def sequence_integrity(feed: DataFrame) -> DataFrame:
    """Missing and repeated sequence numbers per day."""
    return (
        feed.filter("msg_seq_num IS NOT NULL")
        .groupBy("day")
        .agg(
            F.min("msg_seq_num").alias("first_seq"),
            F.max("msg_seq_num").alias("last_seq"),
            F.count("*").alias("n"),
            F.countDistinct("msg_seq_num").alias("distinct"),
        )
        .withColumn("duplicates", F.col("n") - F.col("distinct"))
        .withColumn(
            "missing",
            F.col("last_seq") - F.col("first_seq") + 1 - F.col("n") + F.col("duplicates"),
        )
        .drop("distinct")
    )


def price_steps(feed: DataFrame) -> DataFrame:
    """Smallest step between distinct prices, exact median price, per entry type.

    Prices are first reduced to their distinct values, so the ordered window only sees
    the price grid.
    """
    px = F.round(price(F.col("e_md_entry_px")), 2)
    rows = entries(feed, ["md_entry_type", "md_entry_px"]).select(
        F.col("e_md_entry_type").alias("entry_type"), px.alias("px")
    ).filter("px IS NOT NULL")
    grid = rows.groupBy("entry_type", "px").agg(F.count("*").alias("n"))
    order = Window.partitionBy("entry_type").orderBy("px")
    stepped = grid.withColumn("step", F.round(F.lead("px").over(order) - F.col("px"), 2))
    return stepped.groupBy("entry_type").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("prices"),
        F.min("step").alias("min_step"),
        F.expr("percentile(px, 0.5, n)").alias("median"),
    )


def normal_ms(value: Column) -> Column:
    """Any of HHMMSSmmm, YYYYMMDDHHMMSSmmm or ns since midnight to ms since midnight."""
    hms = F.when(value >= 10**16, value % 1_000_000_000).otherwise(value)
    clock = (
        F.floor(hms / 10_000_000) * 3_600_000
        + F.floor(hms / 100_000) % 100 * 60_000
        + F.floor(hms / 1_000) % 100 * 1_000
        + hms % 1_000
    )
    return F.when((value >= 10**9) & (value < 10**16), F.floor(value / 1_000_000)).otherwise(clock)


def clock_audit(feed: DataFrame) -> DataFrame:
    """Precision of the clock fields: digits, distinct values, trailing zeros, entry age."""
    rows = entries(feed, ["md_entry_time", "md_insert_time"])
    named = rows.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("field"), F.col(c).cast("bigint").alias("v"))
                    for n, c in (
                        ("sending_time", "sending_time"),
                        ("md_entry_time", "e_md_entry_time"),
                        ("md_insert_time", "e_md_insert_time"),
                    )
                ]
            )
        )
    ).filter("v IS NOT NULL")
    return named.groupBy("field").agg(
        F.count("*").alias("n"),
        F.min(F.length(F.col("v").cast("string"))).alias("min_digits"),
        F.max(F.length(F.col("v").cast("string"))).alias("max_digits"),
        F.countDistinct("v").alias("distinct"),
        F.avg((F.col("v") % 1000 == 0).cast("double")).alias("share_round_1000"),
    )


def counterparties(feed: DataFrame) -> DataFrame:
    """Orders, distinct firms and the concentration of firms per side (sum of squared shares)."""
    rows = entries(feed, ["md_entry_type", "md_entry_buyer", "md_entry_seller"])
    firm = F.coalesce("e_md_entry_buyer", "e_md_entry_seller")
    per = rows.filter("e_md_entry_type IN ('0', '1')").groupBy(
        F.col("e_md_entry_type").alias("entry_type"), firm.alias("firm")
    ).agg(F.count("*").alias("n"))
    total = F.sum("n")
    # n firms of equal size would give 1/n
    return per.groupBy("entry_type").agg(
        total.alias("n"),
        F.count("*").alias("firms"),
        (F.sum(F.col("n") * F.col("n")) / (total * total)).alias("concentration"),
        (F.sum(F.col("n") * F.col("n")) / (total * total) * F.count("*")).alias("ratio_to_equal"),
    )
