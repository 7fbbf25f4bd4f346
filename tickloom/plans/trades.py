"""Trade events, price impact after h seconds, adverse selection per block, halves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BLOCK_MS, KEY
from tickloom.operators.quantiles import quantiles
from tickloom.operators.ordered import asof_last
from tickloom.plans.panels import in_period, periods

HORIZONS_S = (5, 30, 60)
TIME_CHUNK_MS = 600_000


def trade_events(states: DataFrame) -> DataFrame:
    """Events with a print in continuous trading, with the quote before and after them."""
    return states.filter(
        (F.col("phase") == "C") & F.col("has_trade") & F.col("prev").isNotNull()
    ).select(
        *KEY,
        "seq",
        "k",
        "t_ms",
        F.col("aggressor").alias("d"),
        (~F.col("has_trade_nr")).alias("retail_only"),
        F.col("volume").alias("vol"),
        F.col("volume_nr").alias("vol_nr"),
        F.col("vwap_tick").alias("p_tick"),
        F.col("prev.b").alias("b_prev"),
        F.col("prev.a").alias("a_prev"),
        F.col("b").alias("b_after"),
        F.col("a").alias("a_after"),
        F.col("valid").alias("valid_after"),
    )


def signed_trades(trades: DataFrame, quote_rule: bool = False) -> DataFrame:
    """Trades with a sign; ``quote_rule`` also signs retail-only prints by the mid."""
    mid = (F.col("a_prev") + F.col("b_prev")) / 2.0
    sign = F.col("d")
    if quote_rule:
        sign = F.when(
            (F.col("d") == 0) & F.col("retail_only"),
            F.signum(F.col("p_tick") - mid).cast("int"),
        ).otherwise(F.col("d"))
    return (
        trades.filter("a_prev > b_prev")
        .withColumn("d", sign)
        .filter("d <> 0")
        .withColumn("mid_prev", mid)
        .withColumn("es", F.col("d") * (F.col("p_tick") - F.col("mid_prev")) + 0.0)
    )


def price_impact(
    trades: DataFrame, states: DataFrame, calendar: DataFrame, horizons=HORIZONS_S
) -> DataFrame:
    """One row per (trade, h): ``pi`` = signed mid move after h seconds, ``rs`` = es - pi.

    NULL when the horizon leaves the valid window, meets an exclusion, or a reference
    state lies in between (the segment of the two as-of states differs).
    """
    late = F.lit(2**62)
    probe = trades.withColumn("h", F.explode(F.array(*[F.lit(h) for h in (0, *horizons)])))
    probe = probe.withColumn("at", F.col("t_ms") + F.col("h") * 1000)
    build = states.filter("counted").select(
        *KEY,
        F.col("t_ms").alias("at"),
        F.col("k").alias("rank"),
        ((F.col("a") + F.col("b")) / 2.0).alias("mid_at"),
        F.col("seg").alias("seg_at"),
    )
    chunked = F.floor(F.col("at") / TIME_CHUNK_MS)
    hit = asof_last(
        probe.withColumn("rank", late).withColumn("chunk", chunked),
        build.withColumn("chunk", chunked),
        KEY,
        ["at", "rank"],
        ["mid_at", "seg_at"],
    )
    now = Window.partitionBy(*KEY, "seq")
    based = hit.withColumn("_seg0", F.max(F.when(F.col("h") == 0, F.col("seg_at"))).over(now))
    limits = calendar.select(*KEY, "valid_to", "exclusions")
    meets = F.exists("exclusions", lambda x: (F.col("at") > x["start"]) & (F.col("t_ms") < x["end"]))
    ok = (
        (F.col("at") < F.col("valid_to")) & ~meets & (F.col("seg_at") == F.col("_seg0"))
    )
    impact = F.when(ok, F.col("d") * (F.col("mid_at") - F.col("mid_prev")) + 0.0)
    return (
        based.filter("h > 0")
        .join(limits, KEY)
        .withColumn("pi", impact)
        .withColumn("rs", F.col("es") - F.col("pi"))
        .select(*trades.columns, "h", "pi", "rs")
    )


def impact_blocks(
    impact: DataFrame, calendar: DataFrame, length_ms: int = BLOCK_MS
) -> DataFrame:
    """Impact rows with their whole clock block (rows outside any block are dropped)."""
    period = periods(calendar, "block", length_ms)
    return in_period(impact, period, "block", length_ms).withColumnRenamed("period_start", "block")


def adverse_selection(rows: DataFrame) -> DataFrame:
    """Volume-weighted effective spread, impact and realised spread per (block, h), and
    the impact of odd and even trades (numbered after missing impacts are dropped)."""
    order = Window.partitionBy(*KEY, "block", "h").orderBy("t_ms", "seq")
    known = rows.filter("pi IS NOT NULL").withColumn(
        "odd", F.row_number().over(order) % 2 == 1
    )

    def mean(value: str, condition=None):
        v, w = F.col(value) * F.col("vol"), F.col("vol")
        if condition is not None:
            v, w = F.when(condition, v), F.when(condition, w)
        return F.try_divide(F.sum(v), F.sum(w).cast("double"))

    measured = known.groupBy(*KEY, "block", "h").agg(
        F.count("*").alias("n_h"),
        mean("pi").alias("as_h"),
        mean("rs").alias("rs_h"),
        mean("pi", F.col("odd")).alias("as_odd"),
        mean("pi", ~F.col("odd")).alias("as_even"),
    )
    totals = rows.groupBy(*KEY, "block", "h").agg(
        F.count("*").alias("n_trades"),
        F.sum("vol").alias("volume"),
        mean("es").alias("es_mean"),
    )
    return (
        totals.join(measured, [*KEY, "block", "h"], "left")
        .fillna(0, ["n_h"])
        .withColumn("hour", F.floor(F.col("block") / 3_600_000))
    )


def gap_halves(rows: DataFrame, length_ms: int, gap_ms: int) -> DataFrame:
    """Impact of the first and last part of a block, ``gap_ms`` apart."""
    half = (length_ms - gap_ms) / 2
    pos = F.col("t_ms") - F.col("block")
    first, last = pos < half, pos >= length_ms - half

    def mean(c):
        return F.try_divide(
            F.sum(F.when(c, F.col("pi") * F.col("vol"))), F.sum(F.when(c, F.col("vol"))).cast("double")
        )

    return (
        rows.filter("pi IS NOT NULL")
        .groupBy(*KEY, "block", "h")
        .agg(
            mean(first).alias("x"),
            mean(last).alias("y"),
            F.count_if(first).alias("n_first"),
            F.count_if(last).alias("n_last"),
        )
        .filter("x IS NOT NULL AND y IS NOT NULL")
        .withColumn("hour", F.floor(F.col("block") / 3_600_000))
    )


def block_shift(df: DataFrame, value: str, steps: int, length_ms: int, start: str = "block", keys=None) -> Column:
    """``value`` of the block ``steps`` before (negative: after), only if consecutive."""
    order = Window.partitionBy(*(keys or KEY)).orderBy(start)
    expected = F.col(start) - steps * length_ms
    return F.when(F.lag(start, steps).over(order) == expected, F.lag(value, steps).over(order))


def impact_distribution(impact: DataFrame) -> DataFrame:
    """Distribution of impact and realised spread per horizon (exact percentiles)."""
    measure = F.explode(
        F.array(
            F.struct(F.lit("pi").alias("measure"), F.col("pi").alias("v")),
            F.struct(F.lit("rs").alias("measure"), F.col("rs").alias("v")),
        )
    )
    q = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    rows = impact.select("h", "vol", measure.alias("m")).select("h", "vol", "m.*").filter("v IS NOT NULL")
    cuts = quantiles(rows, ["h", "measure"], F.col("v"), q, "_q")
    table = rows.groupBy("h", "measure").agg(
        F.count("*").alias("n"),
        (F.sum(F.col("v") * F.col("vol")) / F.sum("vol")).alias("mean_weighted"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.avg((F.col("v") == 0).cast("double")).alias("share_zero"),
    )
    names = [F.col("_q")[i].alias(f"p{int(x * 100)}") for i, x in enumerate(q)]
    return table.join(cuts, ["h", "measure"]).select("*", *names).drop("_q")
