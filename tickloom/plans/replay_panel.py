"""Fine panel of the message-level replay: one row per (day, bucket) at any bucket size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.constants import ASK, BID, KEY
from tickloom.operators import tape as tp

SIDES = (("bid", BID), ("ask", ASK))


def _bucket(ms: str, size_ms: int) -> Column:
    return (F.floor(F.col(ms) / size_ms) * size_ms).alias("bucket")


def _per_side(name: str, amount: Column, condition: Column, side: str = "side") -> list[Column]:
    return [
        F.when(condition & (F.col(side) == code), amount).otherwise(0).cast("bigint").alias(f"{name}_{label}")
        for label, code in SIDES
    ]


def message_counters(tape: DataFrame, size_ms: int) -> DataFrame:
    """Additive counters of each message (one narrow row, summed later)."""
    one = F.lit(1)
    cls = F.coalesce("new_class", F.lit(""))
    new = F.col("typ") == "N"
    undercut = cls.isin("undercut", "undercut_ambiguous")
    trade = F.col("typ") == "T"
    touch = F.coalesce(F.col("withdrawal") == "touch", F.lit(False))
    deep = F.coalesce(F.col("withdrawal") == "deep", F.lit(False))
    at_touch = new & F.when(F.col("side") == BID, F.col("tick") == F.col("b")).otherwise(
        F.col("tick") == F.col("a")
    )
    change = F.coalesce("change_class", F.lit(""))
    effect = F.coalesce("spread_effect", F.lit(""))
    normal = F.coalesce(F.col("b0") < F.col("a0"), F.lit(False))

    def flag(name: str, condition: Column, amount: Column = one) -> Column:
        return F.when(condition, amount).otherwise(0).cast("bigint").alias(name)

    return tape.select(
        *KEY,
        _bucket("t_ms", size_ms),
        F.lit(1).cast("bigint").alias("msg_total"),
        *_per_side("new", one, new),
        *_per_side("new_vol", F.col("qty"), new),
        *_per_side("undercut", one, undercut),
        *_per_side("undercut_resid", one, cls == "undercut_ambiguous"),
        *_per_side("uc_strict_vol", F.col("qty"), cls == "undercut"),
        *_per_side("uc_amb_vol", F.col("qty"), cls == "undercut_ambiguous"),
        *_per_side("join_best", one, cls == "join_best"),
        *_per_side("behind_best", one, cls == "behind_best"),
        *_per_side("aggressive", one, cls == "aggressive"),
        *_per_side("no_reference", one, cls == "no_reference"),
        *_per_side("touch_add_vol", F.col("qty"), at_touch),
        *_per_side("touch_cancel_n", one, touch),
        *_per_side("touch_life", F.col("life_ms"), touch),
        *_per_side("touch_wd_vol", F.col("p_qty"), touch),
        *_per_side("deep_wd_vol", F.col("p_qty"), deep),
        flag("spread_narrowed", effect == "narrowed"),
        flag("spread_unchanged", effect == "unchanged"),
        flag("spread_widened_by_new", effect == "widened"),
        flag("deletes_widening_spread", F.col("delete_widens")),
        flag("reprice_total", F.col("typ") == "C"),
        flag("reprice_size_only", change == "size_only"),
        flag("reprice_narrow", change == "narrow"),
        flag("reprice_widen", change == "widen"),
        flag("reprice_neutral", change == "neutral"),
        flag("trade_count", trade),
        flag("trade_volume", trade, F.col("qty")),
        flag("landing_n", F.col("landing").isNotNull()),
        flag("landing_ticks", F.col("landing").isNotNull(), F.col("landing")),
        flag("mid_obs", normal),
        flag("mid_sum2", normal, F.col("b0") + F.col("a0")),
        flag("mid_sq4", normal, (F.col("b0") + F.col("a0")) * (F.col("b0") + F.col("a0"))),
        flag("spread_sum", normal, F.col("a0") - F.col("b0")),
        flag("touch_depth_bid", normal, F.col("qb0")),
        flag("touch_depth_ask", normal, F.col("qa0")),
    )


def closing_prices(tape: DataFrame, size_ms: int) -> DataFrame:
    """Mid, microprice (in ticks) and last trade tick standing when the bucket closes."""
    normal = F.coalesce(F.col("b") < F.col("a"), F.lit(False))
    micro = (F.col("qb") * F.col("a") + F.col("qa") * F.col("b")) / (F.col("qb") + F.col("qa"))
    both = normal & (F.col("qb") > 0) & (F.col("qa") > 0)
    return tape.groupBy(*KEY, _bucket("t_ms", size_ms)).agg(
        F.max_by((F.col("b") + F.col("a")) / 2.0, F.when(normal, F.col("rpt"))).alias("close_mid"),
        F.max_by(micro, F.when(both, F.col("rpt"))).alias("close_micro"),
        F.max_by("tick", F.when(F.col("typ") == "T", F.col("rpt"))).alias("last_trade"),
    )


def replay_panel(tape: DataFrame, queue: DataFrame, size_ms: int) -> DataFrame:
    """All counters of the replay per bucket."""
    one = F.lit(1)
    zone = F.col("queue_zone")
    queue_rows = queue.select(
        *KEY,
        _bucket("t_ms", size_ms),
        *_per_side("fq_wd", F.col("qty"), zone == "front"),
        *_per_side("bq_wd", F.col("qty"), zone == "back"),
        *_per_side("qp_sum", F.col("position_bp"), F.lit(True)),
        *_per_side("qp_n", one, F.lit(True)),
    )
    sweep_rows = tp.sweeps(tape).select(
        *KEY, _bucket("t_ms", size_ms), *_per_side("sweep", one, F.lit(True), "print_side")
    )
    price_runs = tp.undercut_runs(tape).select(
        *KEY,
        _bucket("booked_ms", size_ms),
        *_per_side("ur_run_n", one, F.lit(True)),
        *_per_side("ur_run_len", F.col("length"), F.lit(True)),
    )
    queue_runs = tp.cancel_runs(queue, tape).select(
        *KEY,
        _bucket("booked_ms", size_ms),
        *_per_side("qcr_n", one, F.lit(True)),
        *_per_side("qcr_len", F.col("length"), F.lit(True)),
    )
    naive = tp.naive_best(tape).filter("naive_undercut").select(
        *KEY, _bucket("t_ms", size_ms), *_per_side("naive_undercut", one, F.lit(True))
    )
    spreads = tp.spread_durations(tape)
    held = spreads.select(
        *KEY,
        _bucket("from_ms", size_ms),
        *[
            F.when(~F.col("dropped") & (F.least("spread", F.lit(4)) == s), F.col("dur"))
            .otherwise(0)
            .cast("bigint")
            .alias(f"spread_ms_{s}" if s < 4 else "spread_ms_4p")
            for s in (1, 2, 3, 4)
        ],
        F.when(F.col("dropped"), F.col("dur")).otherwise(0).cast("bigint").alias("spread_ms_dropped"),
    )
    # each source is summed on its own (partial sums before the shuffle) and the small
    # panels are joined; a bucket of any source holds at least one message
    keys = [*KEY, "bucket"]

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in rows.columns if c not in keys]
        )

    panel = summed(message_counters(tape, size_ms))
    for part in (queue_rows, sweep_rows, price_runs, queue_runs, naive, held):
        panel = panel.join(summed(part), keys, "left")
    counters = [c for c in panel.columns if c not in keys]
    return panel.fillna(0, counters).join(closing_prices(tape, size_ms), keys, "left")


def coarser(panel: DataFrame, size_ms: int) -> DataFrame:
    """Re-aggregate a fine panel: counters add up, prices take the last non-null close."""
    closes = ["close_mid", "close_micro", "last_trade"]
    keys = [*KEY, "bucket"]
    counters = [c for c in panel.columns if c not in (*keys, *closes)]
    return (
        panel.withColumn("_fine", F.col("bucket"))
        .withColumn("bucket", _bucket("_fine", size_ms))
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in counters],
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_fine"))).alias(c) for c in closes],
        )
    )


def _safe(n: Column, d: Column, scale: float = 1.0, zero: bool = True) -> Column:
    value = F.when(d > 0, n / d * scale)
    return F.coalesce(value, F.lit(0.0)) if zero else value


def touch_signals(panel: DataFrame, zero: bool = True) -> DataFrame:
    """Signed touch channels of a panel; empty denominators give 0.0 (or NULL)."""
    c = F.col
    wd = c("touch_wd_vol_bid") + c("touch_wd_vol_ask")
    add = c("touch_add_vol_bid") + c("touch_add_vol_ask")
    new = c("new_vol_bid") + c("new_vol_ask")
    sw = c("sweep_bid") + c("sweep_ask")
    return panel.select(
        "*",
        _safe(c("ur_run_len_bid") - c("ur_run_len_ask"), new, 1000, zero).alias("ur_price"),
        _safe(c("fq_wd_bid") - c("fq_wd_ask"), wd, 1, zero).alias("fqcr"),
        _safe(c("bq_wd_bid") - c("bq_wd_ask"), wd, 1, zero).alias("bqcr"),
        _safe(c("touch_wd_vol_bid") - c("touch_wd_vol_ask"), wd, 1, zero).alias("agg_cancel"),
        _safe(c("qcr_len_bid") - c("qcr_len_ask"), wd, 100, zero).alias("queue_run"),
        _safe(
            c("touch_add_vol_bid") - c("touch_wd_vol_bid") - c("touch_add_vol_ask") + c("touch_wd_vol_ask"),
            add + wd,
            1,
            zero,
        ).alias("touch_ofi"),
        _safe(c("sweep_bid") - c("sweep_ask"), sw, 1, zero).alias("agr_imb"),
        (c("close_micro") - c("close_mid")).alias("obi"),
        F.try_divide(c("spread_sum").cast("double"), c("mid_obs").cast("double")).alias("spr"),
        _safe(c("uc_strict_vol_bid") - c("uc_strict_vol_ask"), new, 1, False).alias("undercut_signed"),
        F.try_divide(
            F.try_divide(c("spread_sum").cast("double"), c("mid_obs").cast("double")),
            F.try_divide(c("mid_sum2") / 2.0, c("mid_obs").cast("double")),
        ).alias("rel_spread"),
    )


def in_session(panel: DataFrame, size_ms: int) -> DataFrame:
    """Buckets of the regular session, 09:00 to 18:00 inclusive of the 18:00 minute."""
    minute = F.floor(F.col("bucket") / 60_000)
    return panel.filter((minute >= 540) & (minute <= 1080))


def daily_report(panel: DataFrame, tape: DataFrame, effects: DataFrame) -> DataFrame:
    """Validation report per day: totals, the narrowed-minus-undercut check, orphans."""
    totals = panel.groupBy(*KEY).agg(
        F.sum("msg_total").alias("messages"),
        F.sum(F.col("new_bid") + F.col("new_ask")).alias("new_orders"),
        F.sum(F.col("undercut_bid") + F.col("undercut_ask")).alias("undercuts"),
        F.sum(F.col("undercut_resid_bid") + F.col("undercut_resid_ask")).alias("ambiguous"),
        F.sum(F.col("naive_undercut_bid") + F.col("naive_undercut_ask")).alias("naive_undercuts"),
        F.sum("spread_narrowed").alias("narrowed"),
        F.sum("trade_count").alias("trades"),
    )
    irregular = effects.groupBy(*KEY).agg(
        F.count_if(F.col("orphan") == "orphan_delete").alias("orphan_deletes"),
        F.count_if(F.col("orphan") == "orphan_change").alias("orphan_changes"),
        F.count_if(F.col("level_q") < 0).alias("negative_sizes"),
    )
    return totals.join(irregular, KEY).withColumn(
        "narrowed_minus_undercut", F.col("narrowed") - F.col("undercuts")
    )
