"""Best-quote moves: detection, refill / shift / undercut, trade windows, cause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import (
    DEFAULT_WINDOW_MS,
    KEY,
    REFILL_WINDOWS_MS,
    TRADE_WINDOWS_MS,
)
from tickloom.operators.ordered import asof_last, carry_scan, lookback_buckets, previous

CARRIED = [
    "seq", "k", "t_ms", "rpt", "seg", "b", "a", "qb", "qa", "has_trade", "has_trade_nr",
    "aggressor", "n_packets", "open_balance",
]


def price_changes(states: DataFrame) -> DataFrame:
    """Counted states whose best bid or ask differs from the previous counted state."""
    changed = (F.col("b") != F.col("prev.b")) | (F.col("a") != F.col("prev.a"))
    return states.filter(F.col("counted") & F.col("prev").isNotNull() & changed).select(
        *KEY,
        "chunk",
        *CARRIED,
        F.col("prev.b").alias("b_prev"),
        F.col("prev.a").alias("a_prev"),
        F.col("prev.qb").alias("qb_prev"),
        F.col("prev.qa").alias("qa_prev"),
        (F.col("b") - F.col("prev.b")).alias("d_bid"),
        (F.col("prev.a") - F.col("a")).alias("d_ask"),
        "trade_any",
        "trade_nr",
        "trade_sell",
        "trade_buy",
    )


def with_lookback(changes: DataFrame, windows=REFILL_WINDOWS_MS, bucket_ms=60_000) -> DataFrame:
    """Best bid / ask seen in the last W ms and latest deterioration of each side.

    A price run counts as seen when it *ended* after t-W; on this table the run ending
    at a row is the row's previous quote, so the frame is (t-W, t] up to the row itself.
    Work is cut into time buckets that carry their own look-back rows.
    """
    spread = lookback_buckets(changes, "t_ms", max(windows), bucket_ms)
    part = [*KEY, "seg", "bucket"]
    by_time = Window.partitionBy(*part).orderBy("t_ms")
    same_ms = (
        Window.partitionBy(*part, "t_ms")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    in_order = (
        Window.partitionBy(*part)
        .orderBy("t_ms", "seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # one row per instant and bucket serves every frame of the bucket
    columns = [
        F.max("b_prev").over(same_ms).alias("_b_now"),
        F.min("a_prev").over(same_ms).alias("_a_now"),
        F.max(F.when(F.col("d_bid") < 0, F.col("t_ms"))).over(in_order).alias("bid_fell_ms"),
        F.max(F.when(F.col("d_ask") < 0, F.col("t_ms"))).over(in_order).alias("ask_fell_ms"),
    ]
    for w in windows:
        frame = by_time.rangeBetween(-(w - 1), -1)
        columns.append(F.max("b_prev").over(frame).alias(f"_b_{w}"))
        columns.append(F.min("a_prev").over(frame).alias(f"_a_{w}"))
    seen = spread.select("*", *columns).filter("home")
    return seen.select(
        *changes.columns,
        "bid_fell_ms",
        "ask_fell_ms",
        *[F.greatest(f"_b_{w}", "_b_now").alias(f"max_bid_{w}") for w in windows],
        *[F.least(f"_a_{w}", "_a_now").alias(f"min_ask_{w}") for w in windows],
    )


def _improvement(is_bid, price, w: int):
    refill = F.when(is_bid, price <= F.col(f"max_bid_{w}")).otherwise(
        price >= F.col(f"min_ask_{w}")
    )
    opposite = F.when(is_bid, F.col("ask_fell_ms")).otherwise(F.col("bid_fell_ms"))
    shift = opposite > F.col("t_ms") - w
    return F.when(refill, "refill").when(shift, "shift").otherwise("undercut")


def quote_moves(seen: DataFrame, windows=REFILL_WINDOWS_MS) -> DataFrame:
    """One row per side that moved: ``kind`` improve/worsen, ticks, class per window."""
    both = seen.withColumn(
        "_m",
        F.explode(
            F.array(
                F.struct(F.lit("bid").alias("side"), F.col("d_bid").alias("d")),
                F.struct(F.lit("ask").alias("side"), F.col("d_ask").alias("d")),
            )
        ),
    ).filter(F.col("_m.d") != 0)
    is_bid = F.col("_m.side") == "bid"
    price = F.when(is_bid, F.col("b")).otherwise(F.col("a"))
    improved = F.col("_m.d") > 0
    classes = [
        F.when(improved, _improvement(is_bid, price, w)).alias(f"class_w{w}") for w in windows
    ]
    return both.select(
        *[c for c in seen.columns if c not in ("d_bid", "d_ask")],
        F.col("_m.side").alias("side"),
        F.when(improved, "improve").otherwise("worsen").alias("kind"),
        F.abs(F.col("_m.d")).alias("ticks"),
        (F.col("a_prev") - F.col("b_prev")).alias("spread_prev"),
        F.when(is_bid, F.col("b_prev")).otherwise(F.col("a_prev")).alias("left_tick"),
        *classes,
    ).withColumn("class", F.col(f"class_w{DEFAULT_WINDOW_MS}"))


def with_trade_windows(moves: DataFrame, windows=TRADE_WINDOWS_MS) -> DataFrame:
    """Flags ``r``, ``r_nr``, ``r2``: first deterioration of its side soon after a trade.

    Every trade opens one slot per side, so a deterioration holds it iff no earlier one
    of that side lies at or after the trade, and the trade is at most j ms old.
    """
    worsening = moves.filter("kind = 'worsen'")
    before = carry_scan(
        worsening.select(*KEY, "chunk", "side", "seq", "seg"),
        [*KEY, "side"],
        ["seq"],
        [previous("_before", "seg", "seq")],
    ).select(
        *KEY,
        "chunk",
        "side",
        "seq",
        F.when(F.col("_before.seg") == F.col("seg"), F.col("_before.seq")).alias("_before_seq"),
    )
    joined = moves.join(before, [*KEY, "chunk", "side", "seq"], "left")
    hitting = F.when(F.col("side") == "bid", F.col("trade_sell")).otherwise(F.col("trade_buy"))
    marks = {"r": F.col("trade_any"), "r_nr": F.col("trade_nr"), "r2": hitting}
    flags = []
    for name, mark in marks.items():
        unused = F.col("_before_seq").isNull() | (F.col("_before_seq") < mark["seq"])
        for j in windows:
            hit = mark.isNotNull() & unused & (F.col("t_ms") - mark["t_ms"] <= j)
            flags.append(
                F.when(F.col("kind") == "worsen", F.coalesce(hit, F.lit(False))).alias(
                    f"{name}_{j}ms"
                )
            )
    keep = [
        c for c in moves.columns if c not in ("trade_any", "trade_nr", "trade_sell", "trade_buy")
    ]
    return joined.select(*keep, *flags)


def level_emptyings(log: DataFrame) -> DataFrame:
    """When a level lost its last order, and whether the event executed at it."""
    so_far = (
        Window.partitionBy(*KEY, "chunk", "ev", "e_side", "e_tick")
        .orderBy("rpt", "sub")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        log.filter("e_side IS NOT NULL")
        .withColumn("exec_at_level", F.max("executed").over(so_far))
        .filter("dn = -1 AND level_n = 0")
        .select(
            *KEY,
            "chunk",
            "rpt",
            "sub",
            "ev",
            "e_side",
            "e_tick",
            "exec_at_level",
            F.when(F.col("executed"), "exec").otherwise("cancel").alias("last_reducer"),
        )
    )


def with_cause(moves: DataFrame, emptyings: DataFrame) -> DataFrame:
    """Cause of each deterioration: execution when the event that emptied the previous
    best level executed at it, else cancel; ``cause_conflict`` when the last reducer differs."""
    rest = moves.filter("kind <> 'worsen'")
    probe = (
        moves.filter("kind = 'worsen'")
        .withColumn("e_side", F.when(F.col("side") == "bid", 0).otherwise(1))
        .withColumn("e_tick", F.col("left_tick"))
        .withColumn("sub", F.lit(9))
    )
    hit = asof_last(
        probe,
        emptyings,
        [*KEY, "e_side", "e_tick"],
        ["rpt", "sub"],
        ["exec_at_level", "last_reducer"],
    )
    caused = hit.select(
        *moves.columns,
        F.when(F.col("exec_at_level"), "execution")
        .when(~F.col("exec_at_level"), "cancel")
        .alias("cause"),
        (F.col("exec_at_level") & (F.col("last_reducer") != "exec")).alias("cause_conflict"),
    )
    return caused.unionByName(rest, allowMissingColumns=True)
