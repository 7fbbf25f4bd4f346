"""Queue-priority competition at the touch and hesitation after executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BID, CHUNK, KEY
from tickloom.operators.quantiles import quantiles
from tickloom.operators.ordered import asof_last, asof_next, carry_scan, previous, running_last, running_sum

# --- fixed values ---------------------------------------------------------
AGGRESSION_MS = 1_000                # an improvement answers an aggression this long
REPRICE_MS = 1_000                   # a reprice explains an aggression this long
REST_CAP_MS = 60_000                 # longer silences are not a quote state
HORIZONS_MS = (1_000, 5_000, 30_000)
REFILL_MS = 5_000
CONTROL_STEP = 10                    # every tenth update of the touch is a control
# --- end of fixed values --------------------------------------------------


def touch_actions(tape: DataFrame, messages_firm: str = "firm") -> DataFrame:
    """Order messages at or through the touch, labelled.

    action: improve / join / execution / cancel (removals at the best), with
    ``depletes`` when the level empties, the packet's incoming firm and its prints.
    """
    own_best = F.when(F.col("side") == BID, F.col("b0")).otherwise(F.col("a0"))
    better = F.when(F.col("side") == BID, F.col("tick") > own_best).otherwise(
        F.col("tick") < own_best
    )
    packet = Window.partitionBy(*CHUNK, "seq")
    printed = F.collect_set(F.when(F.col("typ") == "T", F.col("tick"))).over(packet)
    incoming = F.max(F.when(F.col("typ") == "N", F.col(messages_firm))).over(packet)
    rows = tape.withColumn("_printed", printed).withColumn("incoming", incoming)
    update = F.col("typ").isin("N", "C")
    at_best = F.col("live") & (F.col("p_tick") == own_best)
    hit = F.array_contains("_printed", F.col("p_tick"))
    action = (
        F.when(update & (own_best.isNull() | better), "improve")
        .when(update & (F.col("tick") == own_best), "join")
        .when((F.col("typ") == "D") & at_best & hit, "execution")
        .when((F.col("typ") == "D") & at_best, "cancel")
    )
    return rows.filter("typ <> 'T'").select(
        *CHUNK, "rpt", "seq", "t_ms", "typ", "side", "tick", "qty", "p_tick", "p_qty", "firm",
        "incoming", "born_ms", "live", "order_msgs", "b0", "a0", "qb0", "qa0", "nb0", "na0",
        action.alias("action"),
        (F.col("typ").eqNullSafe("D") & F.coalesce(at_best, F.lit(False)) & (F.col("left_n") == 0)).alias("depletes"),
    )


def with_context(actions: DataFrame) -> DataFrame:
    """What came before on the side: last depletion or improvement, last aggression."""
    side_mark = F.when(
        F.col("depletes") | (F.col("action") == "improve"),
        F.struct(
            "rpt",
            "t_ms",
            "tick",
            F.when(F.col("action") == "improve", "improve").otherwise(F.col("action")).alias("what"),
        ),
    )
    scanned = carry_scan(
        actions,
        [*KEY, "side"],
        ["rpt"],
        [
            running_last("_mark", side_mark, inclusive=False),
            running_last(
                "_improved",
                F.when(F.col("action") == "improve", F.struct("rpt", "t_ms", "tick")),
                inclusive=False,
            ),
        ],
    ).select(
        *actions.columns,
        (F.col("_mark.what") == "execution").alias("after_execution"),
        F.col("_improved").alias("improved"),
    )
    return scanned


def with_aggressions(actions: DataFrame) -> DataFrame:
    """Latest execution that emptied the opposite best (aggressor and clock)."""

    def depleted(code: int) -> Column:
        return F.when(
            F.col("depletes") & (F.col("action") == "execution") & (F.col("side") == code),
            F.struct("rpt", "t_ms", F.col("incoming").alias("aggressor")),
        )

    scanned = carry_scan(
        actions,
        KEY,
        ["rpt"],
        [
            running_last("_hit_bid", depleted(0), inclusive=False),
            running_last("_hit_ask", depleted(1), inclusive=False),
        ],
    )
    return scanned.withColumn(
        "aggression", F.when(F.col("side") == BID, F.col("_hit_ask")).otherwise(F.col("_hit_bid"))
    ).drop("_hit_bid", "_hit_ask")


def races(actions: DataFrame) -> DataFrame:
    """First order to join each new best level: latency in ms and in messages."""
    joins = actions.filter(
        (F.col("action") == "join") & (F.col("improved.tick") == F.col("tick"))
    )
    return joins.groupBy(*KEY, "side", F.col("improved.rpt").alias("improved_rpt")).agg(
        F.min_by(
            F.struct(
                "t_ms",
                (F.col("t_ms") - F.col("improved.t_ms")).alias("latency_ms"),
                (F.col("rpt") - F.col("improved.rpt")).alias("latency_msgs"),
            ),
            "rpt",
        ).alias("first")
    ).select(*KEY, "side", "improved_rpt", "first.*")


def answers(actions: DataFrame) -> DataFrame:
    """First improvement within a second of an aggression: by the aggressor or another."""
    improving = actions.filter(
        (F.col("action") == "improve")
        & F.col("aggression").isNotNull()
        & F.col("aggression.aggressor").isNotNull()
    )
    first = improving.groupBy(*KEY, "side", F.col("aggression.rpt").alias("hit_rpt")).agg(
        F.min_by(F.struct("t_ms", "firm", "aggression"), "rpt").alias("i")
    )
    return first.filter(F.col("i.t_ms") - F.col("i.aggression.t_ms") <= AGGRESSION_MS).select(
        *KEY,
        "side",
        "hit_rpt",
        F.col("i.t_ms").alias("t_ms"),
        (F.col("i.firm") == F.col("i.aggression.aggressor")).alias("by_aggressor"),
    )


def aggressor_origin(actions: DataFrame) -> DataFrame:
    """Whether an emptying aggression came from an order repriced within a second."""
    repriced = actions.filter("typ = 'C' AND live AND p_tick <> tick").select(
        *KEY, "chunk", "rpt", F.col("side").alias("agg_side"), F.col("firm").alias("agg_firm"), "t_ms"
    )
    hits = actions.filter("depletes AND action = 'execution' AND incoming IS NOT NULL").select(
        *KEY, "chunk", "rpt", "t_ms", (1 - F.col("side")).alias("agg_side"), F.col("incoming").alias("agg_firm")
    )
    matched = asof_last(
        hits,
        repriced.withColumn("repriced_ms", F.col("t_ms")).withColumn("repriced_rpt", F.col("rpt")).drop("t_ms"),
        [*KEY, "agg_side", "agg_firm"],
        ["rpt"],
        ["repriced_ms", "repriced_rpt"],
    )
    # a reprice explains one aggression only: the first one after it
    used = (
        matched.filter("repriced_rpt IS NOT NULL")
        .groupBy(*KEY, "agg_side", "agg_firm", "repriced_rpt")
        .agg(F.min_by(F.col("t_ms") - F.col("repriced_ms"), "rpt").alias("gap"))
        .filter(F.col("gap") <= REPRICE_MS)
        .groupBy("day")
        .agg(F.count("*").alias("from_reprice"))
    )
    return (
        matched.groupBy("day")
        .agg(F.count("*").alias("aggressions"))
        .join(used, "day", "left")
        .fillna(0, ["from_reprice"])
        .withColumn("from_new_order", F.col("aggressions") - F.col("from_reprice"))
    )


def competition_panel(actions: DataFrame, tape: DataFrame, size_ms: int) -> DataFrame:
    """Competition measures per (day, interval, side)."""
    c = F.col
    slot = lambda t: (F.floor(c(t) / size_ms) * size_ms).alias("bucket")
    keys = [*KEY, "bucket", "side"]
    counts = actions.groupBy(*KEY, slot("t_ms"), "side").agg(
        F.count_if(c("action") == "join").alias("joins"),
        F.count_if((c("action") == "improve") & ~F.coalesce("after_execution", F.lit(False))).alias("spontaneous"),
        F.count_if((c("action") == "improve") & F.coalesce("after_execution", F.lit(False))).alias("after_execution"),
        F.count_if(c("action") == "cancel").alias("cancels"),
        F.count_if(c("action") == "execution").alias("executions"),
        F.count_if(c("action") == "improve").alias("moved_by_improvement"),
        F.count_if((c("action") == "execution") & c("depletes")).alias("moved_by_execution"),
        F.count_if((c("action") == "cancel") & c("depletes")).alias("moved_by_cancel"),
        F.avg(F.when(c("action").isin("cancel", "execution"), c("t_ms") - c("born_ms"))).alias("rest_ms"),
        F.count_if((c("typ") == "C") & c("live") & (c("p_tick") != c("tick"))).alias("price_changes"),
        F.count_if((c("typ") == "C") & c("live") & (c("p_tick") == c("tick")) & (c("p_qty") != c("qty"))).alias("size_changes"),
    )
    race = races(actions).groupBy(*KEY, slot("t_ms"), "side").agg(
        F.avg("latency_ms").alias("race_ms"), F.avg("latency_msgs").alias("race_msgs")
    )
    answer = answers(actions).groupBy(*KEY, slot("t_ms"), "side").agg(
        F.count_if("by_aggressor").alias("by_aggressor"),
        F.count_if(~c("by_aggressor")).alias("by_other"),
    )
    standing = carry_scan(
        actions.select(*CHUNK, "rpt", "t_ms", "b0", "a0", "nb0", "na0"),
        KEY,
        ["rpt"],
        [previous("_p", "t_ms")],
    ).withColumn("dt", c("t_ms") - c("_p.t_ms")).filter(
        (c("dt") > 0) & (c("dt") < REST_CAP_MS) & (c("a0") > c("b0"))
    )
    held = (
        standing.withColumn("from_ms", c("_p.t_ms"))
        .select(
            *KEY,
            slot("from_ms"),
            "dt",
            ((c("a0") - c("b0")) * c("dt")).alias("spread_dt"),
            F.inline(F.array(
                F.struct(F.lit(0).alias("side"), (c("nb0") * c("dt")).alias("orders_dt")),
                F.struct(F.lit(1).alias("side"), (c("na0") * c("dt")).alias("orders_dt")),
            )),
        )
        .groupBy(*keys)
        .agg(
            (F.sum("orders_dt") / F.sum("dt")).alias("orders_at_touch"),
            (F.sum("spread_dt") / F.sum("dt")).alias("spread_mean"),
            F.sum("dt").alias("time_ms"),
        )
    )
    traded = tape.filter("typ = 'T'").groupBy(*KEY, slot("t_ms")).agg(
        F.sum("qty").alias("volume"), F.count("*").alias("trades")
    )
    return (
        counts.join(race, keys, "left")
        .join(answer, keys, "left")
        .join(held, keys, "left")
        .join(traded, [*KEY, "bucket"], "left")
        .fillna(0, ["by_aggressor", "by_other", "volume", "trades", "time_ms"])
        .withColumn(
            "competition",
            F.try_divide(
                (c("joins") - c("cancels")).cast("double"), (c("joins") + c("cancels")).cast("double")
            ),
        )
    )


def hesitation(actions: DataFrame, tape: DataFrame, horizons=HORIZONS_MS, refill_ms: int = REFILL_MS) -> DataFrame:
    """Executions at the best: how fast and how far the level refills, and mid impact.

    Refilled volume is a difference of the level's running added volume at two as-of
    points, so no pair of rows is ever formed.
    """
    c = F.col
    hits = actions.filter((c("action") == "execution") & (c("b0") < c("a0"))).select(
        *CHUNK,
        "rpt",
        "t_ms",
        "side",
        c("p_tick").alias("level"),
        F.when(c("depletes"), "depletion").otherwise("partial").alias("kind"),
        F.when(c("depletes"), F.when(c("side") == BID, c("qb0")).otherwise(c("qa0")))
        .otherwise(c("p_qty"))
        .alias("volume"),
        ((c("b0") + c("a0")) / 2.0).alias("mid0"),
        F.when(c("side") == BID, -1).otherwise(1).alias("sign"),
    )
    added = carry_scan(
        actions.filter("typ IN ('N', 'C')").select(
            *CHUNK, "rpt", "t_ms", "side", c("tick").alias("level"), "qty"
        ),
        [*KEY, "side", "level"],
        ["rpt"],
        [running_sum("added", c("qty"))],
    )
    keys = [*KEY, "side", "level"]
    before = asof_last(hits, added.select(*CHUNK, "rpt", "side", "level", "added"), keys, ["rpt"], ["added"])
    before = before.withColumnRenamed("added", "added_before")
    by_time = lambda df, t: df.withColumn("chunk", F.floor(c(t) / 600_000))
    big = F.lit(2**62)
    until = before.withColumn("at", c("t_ms") + refill_ms).withColumn("rank", big)
    after = asof_last(
        by_time(until, "at"),
        by_time(added.select(*KEY, "side", "level", c("t_ms").alias("at"), c("rpt").alias("rank"), "added"), "at"),
        keys,
        ["at", "rank"],
        ["added"],
    ).drop("at", "rank").withColumnRenamed("added", "added_after")
    mids = tape.filter("b < a").select(
        *KEY, c("t_ms").alias("at"), c("rpt").alias("rank"), ((c("b") + c("a")) / 2.0).alias("mid_h")
    )
    probe = after.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons])))
    # the mid standing when the horizon is reached: the last state strictly before it
    reached = asof_last(
        by_time(probe.withColumn("at", c("t_ms") + c("h") - 1).withColumn("rank", big), "at"),
        by_time(mids, "at"),
        KEY,
        ["at", "rank"],
        ["mid_h"],
    )
    refilled = F.coalesce(c("added_after"), F.lit(0)) - F.coalesce(c("added_before"), F.lit(0))
    share = F.try_divide(refilled.cast("double"), c("volume").cast("double"))
    return reached.select(
        *KEY,
        "rpt",
        "t_ms",
        "side",
        "level",
        "kind",
        "volume",
        "h",
        refilled.alias("refilled"),
        F.when(share >= 1, "full").when(share > 0, "partial").otherwise("none").alias("refill_class"),
        (c("sign") * (c("mid_h") - c("mid0")) + 0.0).alias("impact"),
    )


def level_additions(actions: DataFrame) -> DataFrame:
    """Orders added to or changed at a level, with the volume added there so far."""
    c = F.col
    return carry_scan(
        actions.filter("typ IN ('N', 'C')").select(
            *CHUNK, "rpt", "t_ms", "order_msgs", "side", c("tick").alias("level"), "qty"
        ),
        [*KEY, "side", "level"],
        ["rpt"],
        [running_sum("added", c("qty"))],
    )


def refill_passage(actions: DataFrame, limit_ms: int = HORIZONS_MS[-1], span: int = 4_096) -> DataFrame:
    """When a level that an execution took from is first added to, and when all taken volume is back.

    The first addition is the next row of the level.  Full refill is a first passage: the running added volume of a
    level only grows, so the row that reaches the volume before the event plus what was taken is the next one in order of that
    running value, cut into chunks of ``span`` lots.  Both count within ``limit_ms``.
    """
    c = F.col
    hits = actions.filter((c("action") == "execution") & (c("b0") < c("a0"))).select(
        *CHUNK, "rpt", "t_ms", "order_msgs", "side", c("p_tick").alias("level"),
        F.when(c("depletes"), "depletion").otherwise("partial").alias("kind"),
        F.when(c("depletes"), F.when(c("side") == BID, c("qb0")).otherwise(c("qa0"))).otherwise(c("p_qty")).alias("volume"),
    )
    added = level_additions(actions)
    keys = [*KEY, "side", "level"]
    known = asof_last(hits, added.select(*CHUNK, "rpt", "side", "level", "added"), keys, ["rpt"], ["added"])
    aimed = known.withColumn("added", F.coalesce("added", F.lit(0)) + c("volume"))
    first = asof_next(
        aimed,
        added.select(*CHUNK, "rpt", "side", "level", c("t_ms").alias("first_t"), c("order_msgs").alias("first_n")),
        keys,
        ["rpt"],
        ["first_t", "first_n"],
    )
    by_volume = lambda df: df.withColumn("_lots", F.expr(f"added div {span}"))
    full = asof_next(
        by_volume(first),
        by_volume(added.select(*KEY, "side", "level", "added", c("t_ms").alias("full_t"), c("order_msgs").alias("full_n"))),
        keys,
        ["added"],
        ["full_t", "full_n"],
        "_lots",
    )
    within = lambda t, v: F.when(c(t) - c("t_ms") < limit_ms, v)
    return full.select(
        *KEY, "rpt", "t_ms", "side", "level", "kind", "volume",
        within("first_t", c("first_t") - c("t_ms")).alias("first_ms"),
        within("first_t", c("first_n") - c("order_msgs")).alias("first_messages"),
        within("full_t", c("full_t") - c("t_ms")).alias("full_ms"),
        within("full_t", c("full_n") - c("order_msgs")).alias("full_messages"),
    )


def control_impacts(actions: DataFrame, tape: DataFrame, horizons=HORIZONS_MS, step: int = CONTROL_STEP) -> DataFrame:
    """Mid moves after every ``step``-th order message that removes nothing, with alternating sign."""
    c = F.col
    turn = F.expr(f"order_msgs div {step}") % 2
    rows = actions.filter((c("typ") != "D") & (c("b0") < c("a0")) & (c("order_msgs") % step == 0)).select(
        *KEY, "rpt", "t_ms", ((c("b0") + c("a0")) / 2.0).alias("mid0"), F.when(turn == 1, 1).otherwise(-1).alias("sign"),
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h"),
    )
    by_time = lambda df: df.withColumn("chunk", F.floor(c("at") / 600_000))
    mids = tape.filter("b < a").select(
        *KEY, c("t_ms").alias("at"), c("rpt").alias("rank"), ((c("b") + c("a")) / 2.0).alias("mid_h")
    )
    probe = rows.withColumns({"at": c("t_ms") + c("h") - 1, "rank": F.lit(2**62)})
    reached = asof_last(by_time(probe), by_time(mids), KEY, ["at", "rank"], ["mid_h"])
    return reached.select(*KEY, "rpt", "t_ms", "h", (c("sign") * (c("mid_h") - c("mid0")) + 0.0).alias("impact"))


def excess_over_controls(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Mean impact of each kind and refill class less that of the controls of the same hour."""
    hour = F.expr("t_ms div 3600000").alias("hour")
    base = controls.filter("impact IS NOT NULL").groupBy(*KEY[1:], hour, "h").agg(F.avg("impact").alias("control"))
    matched = events.filter("impact IS NOT NULL").select("*", hour).join(base, [*KEY[1:], "hour", "h"])
    return matched.groupBy(*KEY[1:], "kind", "refill_class", "h").agg(
        F.count("*").alias("n"),
        F.avg("impact").alias("impact"),
        F.avg("control").alias("control"),
        F.avg(F.col("impact") - F.col("control")).alias("excess"),
    )


def impact_by_class(rows: DataFrame, *by: str) -> DataFrame:
    """Mean impact with a 1.96 standard-error band."""
    return rows.filter("impact IS NOT NULL").groupBy(*by, "h").agg(
        F.count("*").alias("n"),
        F.avg("impact").alias("impact"),
        (1.96 * F.stddev_samp("impact") / F.sqrt(F.count("*"))).alias("band"),
    )


def volume_quintile(rows: DataFrame) -> DataFrame:
    """Size-controlled groups: quintile of the executed volume by exact percentiles."""
    cuts = quantiles(rows, [], F.col("volume"), (0.2, 0.4, 0.6, 0.8), "_q")
    quintile = F.lit(1)
    for i in range(4):
        quintile = quintile + F.when(F.col("volume") > F.col("_q")[i], 1).otherwise(0)
    return rows.join(F.broadcast(cuts)).withColumn("quintile", quintile).drop("_q")
