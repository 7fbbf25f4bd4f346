"""Matching events: packets joined while printed volume is still unexecuted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import CHUNK, CONTINUATION_CAP_MS, KEY
from tickloom.operators.kernels import EVENT_MAP_SCHEMA, event_segmenter, sorted_map
from tickloom.operators.ordered import carry_scan, running_last


def packet_cuts(log: DataFrame, cap_ms: int = CONTINUATION_CAP_MS) -> DataFrame:
    """One row per packet with its prints and candidate removals, and whether it surely
    starts an event.

    ``log`` has one row per trade and per level effect (``typ, seq, t_ms, tick, qty,
    retail`` of the message, ``e_tick, dq, candidate`` of the effect).  An event can only
    be open at a packet when a non-retail print lies at most ``cap_ms`` before it.
    """
    non_retail = (F.col("typ") == "T") & ~F.col("retail")

    def listed(condition, value):
        return F.collect_list(F.when(condition, value.cast("bigint")))

    packets = log.repartition(*CHUNK).groupBy(*CHUNK, "seq").agg(
        F.first("t_ms").alias("t_ms"),
        F.max(non_retail).alias("printing"),
        listed(non_retail, F.col("tick")).alias("print_ticks"),
        listed(non_retail, F.col("qty")).alias("print_qtys"),
        listed(F.col("candidate"), F.col("e_tick")).alias("removal_ticks"),
        listed(F.col("candidate"), -F.col("dq")).alias("removal_qtys"),
    )
    seen = carry_scan(
        packets,
        KEY,
        ["seq"],
        [running_last("last_print", F.when(F.col("printing"), F.col("t_ms")), inclusive=False)],
        totals=log.select(*CHUNK, "seq", "t_ms", non_retail.alias("printing")),
    )
    return seen.withColumn(
        "cut",
        F.col("last_print").isNull() | (F.col("last_print") < F.col("t_ms") - cap_ms),
    ).drop("last_print")


def multi_packet_events(
    packets: DataFrame, cap_ms: int = CONTINUATION_CAP_MS, cross_clock: bool = True
) -> DataFrame:
    """Map of the packets that share an event with another packet.

    The log falls apart at the cuts; only packets near prints reach the kernel, grouped
    by the chunk in which their stretch begins.  All other packets are events of their
    own and need no row here.
    """
    zoned = carry_scan(
        packets, KEY, ["seq"], [running_last("zone", F.when(F.col("cut"), F.col("chunk")))]
    ).filter(F.col("printing") | ~F.col("cut"))
    return sorted_map(
        zoned, [*KEY, "zone"], ["seq"], event_segmenter(cap_ms, cross_clock), EVENT_MAP_SCHEMA
    )


def with_event(log: DataFrame, event_map: DataFrame) -> DataFrame:
    """Attach ``ev`` (first packet of the event), its clock and its home chunk."""
    joined = log.join(event_map, [*KEY, "seq"], "left")
    return joined.select(
        *[c for c in log.columns if c != "chunk"],
        F.coalesce("ev_chunk", "chunk").alias("chunk"),
        F.coalesce("ev", "seq").alias("ev"),
        F.coalesce("ev_ms", "t_ms").alias("ev_ms"),
        F.coalesce("ev_packets", F.lit(1)).alias("ev_packets"),
    )


def with_executions(log: DataFrame) -> DataFrame:
    """Mark the removals that an execution explains (``executed``).

    A candidate removal counts when its tick was printed by a non-retail trade of the
    event, up to its own packet, and printed volume is still unmatched before it.
    """
    non_retail = (F.col("typ") == "T") & ~F.col("retail")
    where = F.when(F.col("typ") == "T", F.col("tick")).otherwise(F.col("e_tick"))
    at_tick = Window.partitionBy(*CHUNK, "ev", "_where")
    trade_first = F.when(F.col("typ") == "T", 0).otherwise(1)
    in_event = Window.partitionBy(*CHUNK, "ev").orderBy("seq", "_late", "rpt", "sub")
    printed = F.min(F.when(non_retail, F.col("seq"))).over(at_tick)
    volume = F.sum(F.when(non_retail, F.col("qty"))).over(
        in_event.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    claimed = F.sum(F.when(F.col("_match"), -F.col("dq"))).over(
        in_event.rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        log.withColumn("_where", where)
        .withColumn("_printed", printed)
        .withColumn(
            "_match",
            F.coalesce(F.col("candidate"), F.lit(False))
            & F.coalesce(F.col("_printed") <= F.col("seq"), F.lit(False)),
        )
        .withColumn("_late", trade_first)
        .withColumn("_open", F.coalesce(volume, F.lit(0)) - F.coalesce(claimed, F.lit(0)))
        .withColumn("executed", F.col("_match") & (F.col("_open") > 0))
        .drop("_where", "_printed", "_match", "_late", "_open")
    )


def close_events(log: DataFrame) -> DataFrame:
    """One row per matching event: clock, volumes, aggressor, executions, last position."""
    trade = F.col("typ") == "T"
    non_retail = trade & ~F.col("retail")
    executed = F.col("executed")
    closed = log.groupBy(*CHUNK, "ev").agg(
        F.first("ev_ms").alias("t_ms"),
        F.first("ev_packets").alias("n_packets"),
        F.max("rpt").alias("rpt"),
        F.max(trade).alias("has_trade"),
        F.max(non_retail).alias("has_trade_nr"),
        F.coalesce(F.sum(F.when(trade, F.col("qty"))), F.lit(0)).alias("volume"),
        F.coalesce(F.sum(F.when(non_retail, F.col("qty"))), F.lit(0)).alias("volume_nr"),
        F.sum(F.when(trade, F.col("qty") * F.col("tick"))).alias("_pq"),
        F.count_if(executed).alias("n_exec"),
        F.coalesce(F.sum(F.when(executed, -F.col("dq"))), F.lit(0)).alias("q_exec"),
        F.max(executed & (F.col("e_side") == 0)).alias("_hit_bid"),
        F.max(executed & (F.col("e_side") == 1)).alias("_hit_ask"),
    )
    hit_bid = F.coalesce("_hit_bid", F.lit(False))
    hit_ask = F.coalesce("_hit_ask", F.lit(False))
    return closed.select(
        *CHUNK,
        F.col("ev").alias("seq"),
        "t_ms",
        "rpt",
        "n_packets",
        "has_trade",
        "has_trade_nr",
        "volume",
        "volume_nr",
        F.try_divide(F.col("_pq").cast("double"), F.col("volume").cast("double")).alias(
            "vwap_tick"
        ),
        "n_exec",
        "q_exec",
        F.when(hit_bid & ~hit_ask, -1).when(hit_ask & ~hit_bid, 1).otherwise(0).alias("aggressor"),
        (F.col("volume_nr") - F.col("q_exec")).alias("open_balance"),
    )
