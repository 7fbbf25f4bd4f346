"""Residual quote-competition ratio: fitted strictly before the window it scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import quarter_label, week_label
from tickloom.functions.constants import HOUR_MS
from tickloom.functions.linear import cross_sums, dot, fit_from_sums, grouped_fit, merged_sums
from tickloom.operators.quantiles import quantiles

RATIOS = ["qcr_r", "qcr_a", "qcr_u", "bid_qcr_r", "ask_qcr_r"]
EXTRA_RATIOS = ["qcr_r_nr", "qcr_r2"]


def with_controls(panel: DataFrame) -> DataFrame:
    """Labels and log controls of a period panel."""
    return panel.select(
        "*",
        F.floor(F.col("period_start") / HOUR_MS).alias("hour"),
        week_label(F.col("day")).alias("week"),
        quarter_label(F.col("day")).alias("quarter"),
        F.log(F.when(F.col("pct_spread_tw") > 0, F.col("pct_spread_tw"))).alias("ln_pct_spread"),
        F.log(F.when(F.col("spread_tw_ticks") > 0, F.col("spread_tw_ticks") * 5.0)).alias(
            "ln_spread_pts"
        ),
    )


def stacked(panel: DataFrame, specs: list[tuple[str, str, list[str]]]) -> DataFrame:
    """One row per (specification, period): ``spec, y, x0..``; all specs share their size."""
    k = len(specs[0][2])
    entries = [
        F.struct(
            F.lit(label).alias("spec"),
            F.col(y).cast("double").alias("y"),
            *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)],
        )
        for label, y, xs in specs
    ]
    if any(len(xs) != k for _, _, xs in specs):
        raise ValueError("specifications stacked together need the same number of controls")
    return panel.select(
        "day", "sid", "period_start", "hour", "week", "quarter", F.inline(F.array(*entries))
    )


def _score(rows: DataFrame, fit: DataFrame, levels: DataFrame, keys: list[str], k: int) -> DataFrame:
    """-(y - fitted) / S(y) with the parameters attached on ``keys``."""
    fitted = F.col("alpha") + dot(F.col("beta"), F.array(*[F.col(f"x{i}") for i in range(k)]))
    usable = (F.col("fit_status") == "ok") & (F.col("s_y") > 0) & F.col("alpha").isNotNull()
    return (
        rows.join(
            fit.select(*keys, F.col("status").alias("fit_status"), "beta", "s_y"), keys, "left"
        )
        .join(levels.select(*keys, "_cat", "alpha"), [*keys, "_cat"], "left")
        .withColumn(
            "residual", F.when(usable, -(F.col("y") - fitted) / F.col("s_y"))
        )
        .withColumn("status", F.when(usable, "ok").otherwise("not_identified"))
    )


def by_window(
    rows: DataFrame, window: str, k: int, category: str | None = None, fit_on=None
) -> tuple[DataFrame, DataFrame]:
    """Fit in window j-1, score window j.  Returns (scored rows, first stage).

    ``fit_on`` is an optional predicate that restricts the estimation rows only.
    """
    keys = ["spec", "sid"]
    windows = rows.select(*keys, window).distinct()
    order = Window.partitionBy(*keys).orderBy(window)
    chain = windows.withColumn("param_window", F.lag(window).over(order))
    training = rows if fit_on is None else rows.filter(fit_on)
    xs = [f"x{i}" for i in range(k)]
    fit, levels = grouped_fit(training, [*keys, window], "y", xs, category)
    as_param = {window: "param_window"}
    scored = _score(
        rows.join(chain, [*keys, window])
        .filter("param_window IS NOT NULL")
        .withColumn("_cat", F.lit("all") if category is None else F.col(category)),
        fit.withColumnsRenamed(as_param),
        levels.withColumnsRenamed(as_param),
        [*keys, "param_window"],
        k,
    )
    return scored.drop("_cat", "beta", "alpha", "s_y", "fit_status"), first_stage(
        fit, levels, [*keys, window]
    )


def first_stage(fit: DataFrame, levels: DataFrame, keys: list[str]) -> DataFrame:
    """Coefficient table: intercept of the first category, slopes, errors, R2, S(y)."""
    base = levels.select(*keys, F.col("_cat").alias("first_cat"), "alpha", "x_mean", "n_cat")
    ok = F.col("status") == "ok"
    k = F.size("x_mean")
    quadratic = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), k - 1),
            lambda i: F.get("x_mean", i)
            * dot(F.slice("inverse", i * k + 1, k), F.col("x_mean")),
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    joined = fit.join(base, [*keys, "first_cat"], "left")
    return joined.select(
        *keys,
        "n",
        "s_y",
        "status",
        F.when(ok, F.col("alpha")).alias("a"),
        F.when(ok, F.sqrt(F.col("s2") * (1.0 / F.col("n_cat") + quadratic))).alias("se_a"),
        F.when(ok, F.col("beta")).alias("b"),
        F.when(ok, F.col("se")).alias("se_b"),
        F.when(ok, F.col("r2")).alias("r2"),
    )


def rolling(rows: DataFrame, length: int, k: int, category: str | None = None) -> DataFrame:
    """Score each period with the ``length`` periods before it (own period excluded).

    Every period adds its moments to the next ``length`` targets; the panel has a few rows
    per day, so the factor is fixed and no row-range join is needed.
    """
    keys = ["spec", "sid"]
    order = Window.partitionBy(*keys).orderBy("day", "period_start")
    numbered = rows.withColumn("pos", F.row_number().over(order))
    last = F.max("pos").over(Window.partitionBy(*keys))
    training = numbered.withColumn("_last", last).withColumn(
        "target",
        F.explode(
            F.filter(
                F.sequence(F.col("pos") + 1, F.col("pos") + length),
                lambda t: (t > length) & (t <= F.col("_last")),
            )
        ),
    )
    xs = [f"x{i}" for i in range(k)]
    fit, levels = grouped_fit(training, [*keys, "target"], "y", xs, category)
    scored = _score(
        numbered.withColumnRenamed("pos", "target").withColumn(
            "_cat", F.lit("all") if category is None else F.col(category)
        ),
        fit,
        levels,
        [*keys, "target"],
        k,
    )
    return scored.drop("_cat", "beta", "alpha", "s_y", "fit_status", "target")


def intraday(rows: DataFrame, lag_sessions: int, own_day: bool, k: int = 1) -> DataFrame:
    """Score the blocks of a day with a control day ``lag_sessions`` sessions before it.

    ``own_day`` adds the scored day to the estimation (look-ahead by specification);
    without it the score is strictly out of sample.  Hour effects in both.
    """
    keys = ["spec", "sid"]
    days = rows.select(*keys, "day").distinct()
    order = Window.partitionBy(*keys).orderBy("day")
    chain = days.withColumn("control_day", F.lag("day", lag_sessions).over(order)).filter(
        "control_day IS NOT NULL"
    )
    z = [*[F.col(f"x{i}") for i in range(k)], F.col("y")]
    daily = (
        rows.dropna(subset=["y", *[f"x{i}" for i in range(k)]])
        .withColumn("_cat", F.col("hour"))
        .groupBy(*keys, "day", "_cat")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(z)],
            *cross_sums(z),
            *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(z[:k])],
            *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(z[:k])],
        )
    )
    sources = [F.col("control_day")] + ([F.col("day")] if own_day else [])
    wanted = chain.select(
        *keys, F.col("day").alias("target_day"), F.explode(F.array(*sources)).alias("day")
    )
    sums = daily.join(wanted, [*keys, "day"])
    fit, levels = fit_from_sums(merged_sums(sums, [*keys, "target_day"], k), [*keys, "target_day"], k)
    scored = _score(
        rows.join(chain, [*keys, "day"])
        .withColumn("target_day", F.col("day"))
        .withColumn("_cat", F.col("hour")),
        fit,
        levels,
        [*keys, "target_day"],
        k,
    )
    counts = fit.select(*keys, "target_day", F.col("n").alias("n_fit"), F.col("s_y").alias("s_fit"))
    return scored.join(counts, [*keys, "target_day"], "left").drop(
        "_cat", "beta", "alpha", "s_y", "fit_status", "target_day"
    )


def winsorised(scored: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip the residual of each specification at its sample percentiles."""
    bounds = quantiles(scored, ["spec"], F.col("residual"), (low, high), "_q")
    return scored.join(bounds, "spec", "left").withColumn(
        "residual",
        F.when(
            F.col("residual").isNotNull(),
            F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col("residual"))),
        ),
    ).drop("_q")


def daily_slope(rows: DataFrame, y: str, x: str, min_rows: int = 10) -> DataFrame:
    """Univariate residual per day: y - (a + b x), days with at least ``min_rows`` rows."""
    fit = rows.groupBy("day", "sid").agg(
        F.count(F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), 1)).alias("_n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )
    return (
        rows.join(fit, ["day", "sid"])
        .filter(F.col("_n") >= min_rows)
        .withColumn("residual", F.col(y) - (F.col("intercept") + F.col("slope") * F.col(x)))
        .drop("_n")
    )


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """N, mean, sd and number of days of the identified residuals."""
    return (
        scored.filter("residual IS NOT NULL")
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.avg("residual").alias("mean"),
            F.stddev_samp("residual").alias("sd"),
            F.countDistinct("day").alias("days"),
        )
    )
