"""Day / hour / block panels: counts, ratios, spread identity, state variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BLOCK_MS, HOUR_MS, KEY, MINUTE_MS, REFILL_WINDOWS_MS

PERIOD = [*KEY, "period_start"]


# ---------------------------------------------------------------- periods
def periods(calendar: DataFrame, grain: str, length_ms: int = BLOCK_MS) -> DataFrame:
    """All periods of every day: ``day, sid, period_start, period_end, exclusions``.

    day: the valid window.  hour: clock hours from the first five-minute mark, ends
    truncated.  block: whole clock-aligned blocks that touch no exclusion.
    """
    cal = calendar.filter("status = 'ok'").select(*KEY, "valid_from", "valid_to", "exclusions")
    if grain == "day":
        return cal.select(
            *KEY,
            F.col("valid_from").alias("period_start"),
            F.col("valid_to").alias("period_end"),
            "exclusions",
        )
    if grain == "hour":
        first = F.ceil(F.col("valid_from") / BLOCK_MS) * BLOCK_MS
        hours = F.sequence(
            F.floor(first / HOUR_MS), F.floor((F.col("valid_to") - 1) / HOUR_MS)
        )
        return (
            cal.withColumn("_first", first)
            .withColumn("_h", F.explode(hours))
            .select(
                *KEY,
                F.greatest(F.col("_h") * HOUR_MS, F.col("_first")).alias("period_start"),
                F.least((F.col("_h") + 1) * HOUR_MS, F.col("valid_to")).alias("period_end"),
                "exclusions",
            )
        )
    if grain != "block":
        raise ValueError(f"unknown grain {grain!r}")
    first = F.ceil(F.col("valid_from") / length_ms) * length_ms
    last = F.floor(F.col("valid_to") / length_ms) * length_ms - length_ms
    blocks = cal.withColumn(
        "period_start", F.explode(F.sequence(first, last, F.lit(length_ms).cast("bigint")))
    ).withColumn("period_end", F.col("period_start") + length_ms)
    touched = F.exists(
        "exclusions",
        lambda x: (x["start"] < F.col("period_end")) & (F.col("period_start") < x["end"]),
    )
    return blocks.filter(~touched).select(*PERIOD, "period_end", "exclusions")


def in_period(rows: DataFrame, period: DataFrame, grain: str, length_ms: int = BLOCK_MS) -> DataFrame:
    """Attach the period of ``t_ms``; rows outside every period are dropped."""
    if grain == "day":
        joined = rows.join(period, KEY)
    else:
        size = HOUR_MS if grain == "hour" else length_ms
        keyed = period.withColumn("_slot", F.floor(F.col("period_start") / size))
        joined = rows.withColumn("_slot", F.floor(F.col("t_ms") / size)).join(
            keyed, [*KEY, "_slot"]
        ).drop("_slot")
    return joined.filter("t_ms >= period_start AND t_ms < period_end")


# ---------------------------------------------------------------- counts
def ratio(n: Column, d: Column) -> Column:
    """(n - d) / (n + d), NULL when both are zero."""
    return F.try_divide((n - d).cast("double"), (n + d).cast("double"))


def count_columns() -> list[Column]:
    improve = F.col("kind") == "improve"
    worsen = F.col("kind") == "worsen"
    cols = [
        F.count_if(improve).alias("n_impr"),
        F.count_if(F.col("class") == "undercut").alias("n_undercut"),
        F.count_if(F.col("class") == "refill").alias("n_refill"),
        F.count_if(F.col("class") == "shift").alias("n_shift"),
        F.count_if(worsen).alias("n_det_all"),
        F.count_if(F.col("cause") == "execution").alias("n_det_exec"),
        F.count_if(F.col("cause") == "cancel").alias("n_det_cancel"),
        F.count_if(F.col("r_10ms")).alias("n_det_trade10ms"),
        F.count_if(F.col("r_1ms")).alias("n_det_trade1ms"),
        F.count_if(F.col("r2_10ms")).alias("n_det_trade10ms_r2"),
        F.count_if(F.col("r_nr_10ms")).alias("n_det_trade10ms_nr"),
    ]
    for w in REFILL_WINDOWS_MS:
        for name in ("undercut", "refill", "shift"):
            cols.append(F.count_if(F.col(f"class_w{w}") == name).alias(f"n_{name}_w{w}"))
    for side in ("bid", "ask"):
        mine = F.col("side") == side
        cols += [
            F.count_if(improve & mine).alias(f"{side}_n_impr"),
            F.count_if(worsen & mine).alias(f"{side}_n_det_all"),
            F.count_if((F.col("cause") == "execution") & mine).alias(f"{side}_n_det_exec"),
            F.count_if((F.col("cause") == "cancel") & mine).alias(f"{side}_n_det_cancel"),
            F.count_if(F.col("r_10ms") & mine).alias(f"{side}_n_det_trade10ms"),
            F.count_if((F.col("class") == "undercut") & mine).alias(f"{side}_n_undercut"),
            F.count_if((F.col("class") == "refill") & mine).alias(f"{side}_n_refill"),
            F.count_if((F.col("class") == "shift") & mine).alias(f"{side}_n_shift"),
        ]
    cols += [
        F.coalesce(F.sum(F.when(improve, F.col("ticks"))), F.lit(0)).alias("ticks_impr"),
        F.coalesce(F.sum(F.when(worsen, F.col("ticks"))), F.lit(0)).alias("ticks_det"),
        F.count_if(improve & (F.col("ticks") == 1)).alias("_one_impr"),
        F.count_if(F.col("r_10ms") & (F.col("ticks") == 1)).alias("_one_trade"),
    ]
    return cols


def event_counts(moves: DataFrame, period: DataFrame, grain: str, length_ms: int = BLOCK_MS) -> DataFrame:
    """Counts per period from one aggregate; periods without moves get zeros."""
    counted = in_period(moves, period, grain, length_ms).groupBy(*PERIOD).agg(*count_columns())
    full = period.select(*PERIOD, "period_end").join(counted, PERIOD, "left")
    return full.fillna(0)


def with_ratios(counts: DataFrame) -> DataFrame:
    c = F.col
    theta = F.try_divide(c("n_det_exec").cast("double"), c("n_det_all").cast("double"))
    return counts.select(
        *[x for x in counts.columns if not x.startswith("_")],
        F.try_divide(c("_one_impr").cast("double"), c("n_impr").cast("double")).alias("share_1tick_impr"),
        F.try_divide(c("_one_trade").cast("double"), c("n_det_trade10ms").cast("double")).alias(
            "share_1tick_det_trade"
        ),
        ratio(c("n_impr"), c("n_det_trade10ms")).alias("qcr_r"),
        ratio(c("n_impr"), c("n_det_trade1ms")).alias("qcr_r_1ms"),
        ratio(c("n_impr"), c("n_det_trade10ms_r2")).alias("qcr_r2"),
        ratio(c("n_impr"), c("n_det_trade10ms_nr")).alias("qcr_r_nr"),
        ratio(c("n_impr"), c("n_det_exec")).alias("qcr_a"),
        ratio(c("n_undercut"), c("n_det_exec")).alias("qcr_u"),
        ratio(c("bid_n_impr"), c("bid_n_det_trade10ms")).alias("bid_qcr_r"),
        ratio(c("ask_n_impr"), c("ask_n_det_trade10ms")).alias("ask_qcr_r"),
        ratio(c("bid_n_impr"), c("bid_n_det_exec")).alias("bid_qcr_a"),
        ratio(c("ask_n_impr"), c("ask_n_det_exec")).alias("ask_qcr_a"),
        F.try_divide(c("ticks_impr").cast("double"), c("n_impr").cast("double")).alias("m_impr"),
        F.try_divide(c("ticks_det").cast("double"), c("n_det_all").cast("double")).alias("m_det"),
        theta.alias("theta"),
        ((1 - theta) / (1 + theta)).alias("qcr_composition"),
    )


# ---------------------------------------------------------------- identity
def spread_identity(
    states: DataFrame, counts: DataFrame, period: DataFrame, grain: str, length_ms: int = BLOCK_MS
) -> DataFrame:
    """Spread change over the continuous stretches of a period against the move ticks.

    A stretch starts at the last state before the period or at a reference state.
    """
    rows = in_period(
        states.filter("counted").select(
            *KEY,
            "seg",
            "k",
            "t_ms",
            (F.col("a") - F.col("b")).alias("spread"),
            F.coalesce(F.col("prev.a") - F.col("prev.b"), F.col("a") - F.col("b")).alias("carry"),
        ),
        period,
        grain,
        length_ms,
    )
    stretches = rows.groupBy(*PERIOD, "seg").agg(
        (F.max_by("spread", "k") - F.min_by("carry", "k")).alias("delta")
    )
    deltas = stretches.groupBy(*PERIOD).agg(F.sum("delta").alias("delta_spread"))
    return (
        counts.select(*PERIOD, "ticks_det", "ticks_impr")
        .join(deltas, PERIOD, "left")
        .fillna(0, ["delta_spread"])
        .withColumn(
            "residual", F.col("delta_spread") - (F.col("ticks_det") - F.col("ticks_impr"))
        )
    )


# ---------------------------------------------------------------- state variables
def quote_intervals(states: DataFrame, calendar: DataFrame) -> DataFrame:
    """Time intervals [t_from, t_to] of every counted state of a day.

    Each row closes the interval of the state before it; the last state of the day
    lasts to the end of the valid window.
    """
    counted = states.filter("counted")
    closed = counted.filter("prev_any IS NOT NULL").select(
        *KEY,
        F.col("prev_any.k").alias("k"),
        F.col("prev_any.t_ms").alias("t_from"),
        F.col("t_ms").alias("t_to"),
        F.col("prev_any.b").alias("b"),
        F.col("prev_any.a").alias("a"),
    )
    last = counted.groupBy(*KEY).agg(F.max_by(F.struct("k", "t_ms", "b", "a"), "k").alias("s"))
    tail = last.join(calendar.select(*KEY, "valid_to"), KEY).select(
        *KEY,
        F.col("s.k").alias("k"),
        F.col("s.t_ms").alias("t_from"),
        F.col("valid_to").alias("t_to"),
        F.col("s.b").alias("b"),
        F.col("s.a").alias("a"),
    )
    return closed.unionByName(tail)


def interval_pieces(
    intervals: DataFrame, period: DataFrame, grain: str, length_ms: int = BLOCK_MS
) -> DataFrame:
    """Cut intervals at period edges; the state standing at a period's start opens it."""
    if grain == "day":
        joined = intervals.join(period, KEY)
    else:
        size = HOUR_MS if grain == "hour" else length_ms
        keyed = period.withColumn("_slot", F.floor(F.col("period_start") / size))
        slots = F.sequence(F.floor(F.col("t_from") / size), F.floor(F.col("t_to") / size))
        joined = intervals.withColumn("_slot", F.explode(slots)).join(
            keyed, [*KEY, "_slot"]
        ).drop("_slot")
    start, end = F.greatest("t_from", "period_start"), F.least("t_to", "period_end")
    return (
        joined.filter("t_from < period_end AND t_to >= period_start")
        .withColumn("_s", start)
        .withColumn("_e", end)
        .withColumn(
            "dur",
            F.col("_e")
            - F.col("_s")
            - F.aggregate(
                "exclusions",
                F.lit(0).cast("bigint"),
                lambda acc, x: acc
                + F.greatest(
                    F.lit(0).cast("bigint"),
                    F.least(F.col("_e"), x["end"]) - F.greatest(F.col("_s"), x["start"]),
                ),
            ),
        )
        .drop("_s", "_e")
    )


def state_variables(
    states: DataFrame,
    calendar: DataFrame,
    period: DataFrame,
    grain: str,
    length_ms: int = BLOCK_MS,
) -> DataFrame:
    """Time-weighted spread, relative spread, share of time at one tick, minute
    volatility, first / last spread and traded volume of each period."""
    pieces = interval_pieces(quote_intervals(states, calendar), period, grain, length_ms)
    spread = (F.col("a") - F.col("b")).cast("double")
    mid = (F.col("a") + F.col("b")) / 2.0
    weighted = pieces.withColumn("spread", spread).withColumn("mid", mid).groupBy(*PERIOD).agg(
        F.try_divide(F.sum(F.col("spread") * F.col("dur")), F.sum("dur").cast("double")).alias(
            "spread_tw_ticks"
        ),
        F.try_divide(
            F.sum(F.col("spread") / F.col("mid") * F.col("dur")), F.sum("dur").cast("double")
        ).alias("pct_spread_tw"),
        F.try_divide(
            F.sum(F.when(F.col("spread") == 1, F.col("dur")).otherwise(0)).cast("double"),
            F.sum("dur").cast("double"),
        ).alias("frac_1tick"),
        F.min_by("spread", "k").alias("spread_first"),
        F.max_by("spread", "k").alias("spread_last"),
    )
    volume = (
        in_period(
            states.filter("phase = 'C' AND volume > 0").select(*KEY, "t_ms", "volume"),
            period,
            grain,
            length_ms,
        )
        .filter(
            ~F.exists("exclusions", lambda x: (x["start"] <= F.col("t_ms")) & (F.col("t_ms") < x["end"]))
        )
        .groupBy(*PERIOD)
        .agg(F.sum("volume").alias("volume"))
    )
    return (
        period.select(*PERIOD)
        .join(weighted, PERIOD, "left")
        .join(minute_volatility(pieces), PERIOD, "left")
        .join(volume, PERIOD, "left")
        .fillna(0, ["volume"])
    )


def minute_volatility(pieces: DataFrame) -> DataFrame:
    """stddev of one-minute log mid returns; at least 3 grid minutes and 2 returns.

    Grid point g takes the last state with t <= g (for the period's end, t < end).
    """
    first = F.greatest(
        F.lit(1), F.ceil((F.col("t_from") - F.col("period_start")) / MINUTE_MS)
    ).cast("bigint")
    last = F.floor(
        (F.least(F.col("t_to") - 1, F.col("period_end")) - F.col("period_start")) / MINUTE_MS
    )
    closing = (F.col("t_to") == F.col("period_end")) & (
        (F.col("period_end") - F.col("period_start")) % MINUTE_MS == 0
    )
    last = F.when(closing, (F.col("period_end") - F.col("period_start")) / MINUTE_MS).otherwise(
        last
    ).cast("bigint")
    grid = (
        pieces.withColumn("_first", first)
        .withColumn("_last", last)
        .filter("_first <= _last")
        .withColumn("minute", F.explode(F.sequence("_first", "_last")))
        .withColumn("log_mid", F.log((F.col("a") + F.col("b")) / 2.0))
    )
    ordered = Window.partitionBy(*PERIOD).orderBy("minute")
    returns = grid.withColumn("_r", F.col("log_mid") - F.lag("log_mid").over(ordered))
    long_enough = F.max(F.col("period_end") - F.col("period_start")) >= 3 * MINUTE_MS
    return returns.groupBy(*PERIOD).agg(
        F.when(long_enough & (F.count("_r") >= 2), F.stddev_samp("_r")).alias("qvol")
    )


def order_flow_imbalance(states: DataFrame) -> DataFrame:
    """Signed best-level flow of each counted state; zero at a reference state."""
    b, a, qb, qa = F.col("b"), F.col("a"), F.col("qb"), F.col("qa")
    p = F.col("prev")
    zero = F.lit(0).cast("bigint")
    flow = (
        F.when(b >= p["b"], qb).otherwise(zero)
        - F.when(b <= p["b"], p["qb"]).otherwise(zero)
        - F.when(a <= p["a"], qa).otherwise(zero)
        + F.when(a >= p["a"], p["qa"]).otherwise(zero)
    )
    return states.filter("counted").select(
        *KEY, "k", "seq", "t_ms", F.when(p.isNull(), zero).otherwise(flow).alias("ofi")
    )


def panel(
    states: DataFrame,
    moves: DataFrame,
    calendar: DataFrame,
    grain: str,
    length_ms: int = BLOCK_MS,
) -> DataFrame:
    """Full period panel: counts, ratios, sizes and state variables."""
    period = periods(calendar, grain, length_ms)
    counts = event_counts(moves, period, grain, length_ms)
    variables = state_variables(states, calendar, period, grain, length_ms)
    return with_ratios(counts).join(variables, PERIOD)
