"""Order lifecycle: feed messages to signed level changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import KEY
from tickloom.operators.ordered import Run, carry_scan, key_scan, previous, running_last, running_sum

ORDER_TYPES = ("N", "C", "D")


def with_order_state(messages: DataFrame, orphan_policy: str = "skip") -> DataFrame:
    """Order messages with the state of their order just before them.

    Adds ``live`` (the order rests in the book), ``p_side, p_tick, p_qty`` (where and how
    much), ``born_ms`` (time of its insertion).  ``orphan_policy`` "insert" lets a change
    of an unknown order create it (message-level replay); "skip" ignores it.
    """
    births = F.col("typ") == "N"
    if orphan_policy == "insert":
        births = F.col("typ").isin("N", "C")
    rows = messages.filter(F.col("typ").isin(*ORDER_TYPES))
    died = F.when(F.col("typ") == "D", F.col("rpt"))
    scanned = key_scan(
        rows,
        [*KEY, "oid"],
        ["chunk", "rpt"],
        [
            previous("_prev", "tick", "qty"),
            running_last("_died", died, inclusive=False),
            running_last(
                "_new",
                F.when(F.col("typ") == "N", F.struct("rpt", "side", "t_ms")),
                inclusive=False,
            ),
            running_last("_any_birth", F.when(births, F.col("rpt")), inclusive=False),
            *(
                [
                    running_last(
                        "_first_side",
                        F.when(F.col("typ").isin("N", "C"), F.struct("side")),
                        inclusive=False,
                    )
                ]
                if orphan_policy == "insert"
                else []
            ),
        ],
    )
    alive = F.col("_any_birth").isNotNull() & (
        F.col("_died").isNull() | (F.col("_died") < F.col("_any_birth"))
    )
    side = F.col("_new.side")
    if orphan_policy == "insert":
        side = F.col("_first_side.side")
    return scanned.select(
        *messages.columns,
        alive.alias("live"),
        F.when(alive, side).alias("p_side"),
        F.when(alive, F.col("_prev.tick")).alias("p_tick"),
        F.when(alive, F.col("_prev.qty")).alias("p_qty"),
        F.when(alive, F.col("_new.t_ms")).alias("born_ms"),
    )


def anomaly() -> Column:
    """Name of the irregularity of an order message, NULL when it is regular."""
    typ, live = F.col("typ"), F.col("live")
    moved = F.col("tick") != F.col("p_tick")
    return (
        F.when((typ == "N") & live, "duplicate_order")
        .when((typ == "D") & ~live, "orphan_delete")
        .when((typ == "C") & ~live, "orphan_change")
        .when((typ == "C") & moved, "price_change")
        .when((typ == "C") & (F.col("qty") > F.col("p_qty")), "size_increase")
    )


def level_effects(state: DataFrame) -> DataFrame:
    """Signed changes of level count (``dn``) and size (``dq``) of each order message.

    A price change and a re-used order id give two rows (``sub`` 0 removes, 1 adds).
    ``candidate`` marks the rows that an execution may explain.  Trade rows of the input
    (``typ`` 'T') are not expected here.
    """
    typ, live = F.col("typ"), F.col("live")
    moved = F.col("tick") != F.col("p_tick")

    def effect(sub, side, tick, dn, dq, candidate=False):
        return F.struct(
            F.lit(sub).alias("sub"),
            side.cast("int").alias("e_side"),
            tick.cast("bigint").alias("e_tick"),
            F.lit(dn).cast("bigint").alias("dn"),
            dq.cast("bigint").alias("dq"),
            F.lit(candidate).alias("candidate"),
        )

    def removed(candidate=False):
        return effect(0, F.col("p_side"), F.col("p_tick"), -1, -F.col("p_qty"), candidate)

    added = effect(1, F.col("side"), F.col("tick"), 1, F.col("qty"))
    moved_to = effect(1, F.col("p_side"), F.col("tick"), 1, F.col("qty"))
    resized = F.col("qty") - F.col("p_qty")
    change = (
        F.when(moved, F.array(removed(), moved_to))
        .when(
            F.col("qty") > F.col("p_qty"),
            F.array(effect(0, F.col("p_side"), F.col("p_tick"), 0, resized)),
        )
        .otherwise(F.array(effect(0, F.col("p_side"), F.col("p_tick"), 0, resized, True)))
    )
    effects = (
        F.when((typ == "N") & live, F.array(removed(), added))
        .when(typ == "N", F.array(added))
        .when((typ == "D") & live, F.array(removed(True)))
        .when((typ == "C") & live, change)
    )
    return state.withColumn("anomaly", anomaly()).select(
        "*", F.inline_outer(effects)
    )


def with_level_depth(effects: DataFrame, extra: list[Run] | None = None) -> DataFrame:
    """Order count and size of the touched level after each effect."""
    return carry_scan(
        effects,
        [*KEY, "e_side", "e_tick"],
        ["rpt", "sub"],
        [
            running_sum("level_n", F.col("dn")),
            running_sum("level_q", F.col("dq")),
            *(extra or []),
        ],
    )


def with_openings(effects: DataFrame) -> DataFrame:
    """``effects`` and, for each level that a chunk touches, what it held before the chunk.

    An opening is a row at ``rpt`` -1 without ``typ`` whose ``dn`` and ``dq`` are the sums of all earlier chunks, so
    depth is a sum inside the chunk (``depth_from_openings``) and needs no join.
    """
    level = [*KEY, "e_side", "e_tick"]
    before = Window.partitionBy(*level).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = effects.filter("e_side IS NOT NULL").groupBy(*level, "chunk").agg(F.sum("dn").alias("dn"), F.sum("dq").alias("dq"))
    openings = held.select(
        *level, "chunk", F.sum("dn").over(before).alias("dn"), F.sum("dq").over(before).alias("dq"),
        F.lit(-1).cast("bigint").alias("rpt"), F.lit(0).alias("sub"),
    ).filter("dn IS NOT NULL")
    return effects.unionByName(openings, allowMissingColumns=True)


def depth_from_openings(rows: DataFrame) -> DataFrame:
    """As ``with_level_depth`` on rows of ``with_openings``, which go."""
    so_far = (
        Window.partitionBy(*KEY, "chunk", "e_side", "e_tick")
        .orderBy("rpt", "sub")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    sums = {n: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for n, c in (("level_n", "dn"), ("level_q", "dq"))}
    return rows.withColumns(sums).filter("typ IS NOT NULL")


def occupancy_changes(depth: DataFrame) -> DataFrame:
    """Effects that fill an empty level (+1) or empty a filled one (-1)."""
    filled = (F.col("dn") == 1) & (F.col("level_n") == 1)
    emptied = (F.col("dn") == -1) & (F.col("level_n") == 0)
    return depth.filter(filled | emptied).select(
        *KEY, "chunk", "rpt", "sub", "e_side", "e_tick", F.when(filled, 1).otherwise(-1).alias("step")
    )
