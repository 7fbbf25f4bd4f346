"""Messages of chosen time windows, slices of them, and the whole book at chosen messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import ASK, BID, CHUNK, KEY, MINUTE_MS

TRADE_ACTION = 9
ACTIONS = {"N": 0, "C": 1, "D": 2, "T": TRADE_ACTION}
SLICE_MS = 1_000
SLICE_ROWS = 16


def busiest_minute(tape: DataFrame) -> DataFrame:
    """The minute of each session with most undercuts, the earliest of equals: ``from_ms``."""
    minutes = (
        tape.filter(F.col("new_class").isin("undercut", "undercut_ambiguous"))
        .groupBy(*KEY, F.expr(f"t_ms div {MINUTE_MS}").alias("minute"))
        .agg(F.count("*").alias("n"))
    )
    return minutes.groupBy(*KEY).agg(
        (F.max_by("minute", F.struct(F.col("n"), -F.col("minute"))) * MINUTE_MS).alias("from_ms")
    )


def action() -> Column:
    out = F.lit(None).cast("int")
    for kind, code in ACTIONS.items():
        out = F.when(F.col("typ") == kind, code).otherwise(out)
    return out


def label() -> Column:
    return F.coalesce("new_class", "withdrawal", "change_class", F.when(F.col("typ") == "T", "trade"))


def window_log(tape: DataFrame, windows: DataFrame, length_ms: int = MINUTE_MS) -> DataFrame:
    """Messages within ``length_ms`` from the ``from_ms`` of their session, with the quotes around them.

    Prints are action 9.  ``windows`` has a row for each session at most.
    """
    inside = (F.col("t_ms") >= F.col("from_ms")) & (F.col("t_ms") < F.col("from_ms") + length_ms)
    return tape.join(windows, KEY).filter(inside).select(
        *CHUNK, "rpt", "t_ms", "from_ms", action().alias("action"), "side", "tick", "qty", label().alias("label"),
        "b0", "a0", "b", "a",
    )


def _summary(log: DataFrame, keys: list[str]) -> DataFrame:
    undercut = F.col("label").isin("undercut", "undercut_ambiguous")
    trade = F.col("action") == TRADE_ACTION
    spread = F.when(F.col("b") < F.col("a"), F.col("a") - F.col("b"))
    first, last = F.struct("b0", "a0"), F.struct("b", "a")
    return log.groupBy(*keys).agg(
        F.count("*").alias("messages"),
        F.min("rpt").alias("first_rpt"),
        F.max("rpt").alias("last_rpt"),
        F.count_if(undercut & (F.col("side") == BID)).alias("undercut_buy"),
        F.count_if(undercut & (F.col("side") == ASK)).alias("undercut_sell"),
        F.count_if(F.col("label") == "join_best").alias("joined"),
        F.count_if(F.col("action") == ACTIONS["D"]).alias("removed"),
        F.count_if(trade).alias("trades"),
        F.coalesce(F.sum(F.when(trade, F.col("qty"))), F.lit(0)).alias("volume"),
        F.min(spread).alias("spread_min"),
        F.max(spread).alias("spread_max"),
        F.min_by(first, "rpt").alias("_open"),
        F.max_by(last, "rpt").alias("_close"),
    ).select(
        "*",
        F.col("_open.b0").alias("open_bid"), F.col("_open.a0").alias("open_ask"),
        F.col("_close.b").alias("close_bid"), F.col("_close.a").alias("close_ask"),
    ).drop("_open", "_close")


def time_slices(log: DataFrame, slice_ms: int = SLICE_MS) -> DataFrame:
    """One row for each ``slice_ms`` of the window with a message; it opens at the quote that stood before it."""
    frame = ((F.col("t_ms") - F.col("from_ms")) / slice_ms).cast("bigint").alias("frame")
    return _summary(log.withColumn("frame", frame), [*KEY, "frame"])


def row_slices(log: DataFrame, rows: int = SLICE_ROWS) -> DataFrame:
    """Slices of so many messages each; the last of a session may have fewer."""
    order = Window.partitionBy(*KEY).orderBy("rpt")  # a window's messages
    placed = log.withColumn("frame", F.floor((F.row_number().over(order) - 1) / rows))
    return _summary(placed, [*KEY, "frame"])


# ---------------------------------------------------------------- the book at chosen messages
def book_at(chosen: DataFrame, depth: DataFrame, snapshots: DataFrame, levels: int) -> DataFrame:
    """``chosen`` (``day, sid, chunk, rpt`` and a name of its own) with the best levels just after its message.

    A level's state is its last one in the chunk up to the message, the snapshot's if none; only chunks of chosen
    messages are read, and no chunk needs another.  ``bid_book`` and ``ask_book`` list tick, size and orders, best first.
    """
    columns = [*CHUNK, "rpt", "sub", "e_side", "e_tick", "level_n", "level_q"]
    states = depth.filter("e_side IS NOT NULL").select(columns).unionByName(snapshots.select(columns))
    at = chosen.select(*CHUNK, F.col("rpt").alias("_at")).distinct()
    reached = states.join(at, CHUNK).filter("rpt <= _at")
    last = reached.groupBy(*CHUNK, "_at", "e_side", "e_tick").agg(
        F.max_by(F.struct("level_q", "level_n"), F.struct("rpt", "sub")).alias("held")
    )
    away = F.when(F.col("e_side") == BID, -F.col("e_tick")).otherwise(F.col("e_tick"))
    entry = F.struct(away.alias("away"), F.col("e_tick").alias("tick"), F.col("held.level_q").alias("qty"), F.col("held.level_n").alias("orders"))
    side = lambda code: F.slice(F.array_sort(F.collect_list(F.when(F.col("e_side") == code, entry))), 1, levels)
    books = last.filter("held.level_n > 0").groupBy(*CHUNK, F.col("_at").alias("rpt")).agg(
        side(BID).alias("bid_book"), side(ASK).alias("ask_book")  # a book's levels
    )
    return chosen.join(books, [*CHUNK, "rpt"], "left")


def book_text(column: str) -> Column:
    """A side as text, best first: ``tick x size (orders)``."""
    one = lambda x: F.concat(
        x["tick"].cast("string"), F.lit("x"), x["qty"].cast("string"), F.lit("("), x["orders"].cast("string"), F.lit(")")
    )
    return F.coalesce(F.array_join(F.transform(column, one), " "), F.lit(""))
