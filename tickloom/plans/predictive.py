"""Predictive tests on panels: spec tables, placebo, out-of-sample, event study."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BID, KEY
from tickloom.functions.draws import uniform
from tickloom.functions.linear import cross_sums
from tickloom.operators.quantiles import quantiles
from tickloom.operators.ordered import asof_last, carry_scan, running_sum
from tickloom.plans.inference import effects_regression, hac_error

GRID_MS = 100
EVENT_HORIZONS_MS = (100, 250, 500, 1_000, 2_000, 5_000, 10_000, 30_000, 60_000)


# ---------------------------------------------------------------- targets
def day_order() -> Window:
    """Rows of one session in time order (a panel session is bounded by the clock)."""
    return Window.partitionBy(*KEY).orderBy("bucket")


def log_return(rows_ahead: int, price: str = "close_mid") -> Column:
    """Log return in basis points over ``rows_ahead`` rows of the same day (negative: past)."""
    order = day_order()
    if rows_ahead >= 0:
        return F.log(F.lead(price, rows_ahead).over(order) / F.col(price)) * 10_000
    return F.log(F.col(price) / F.lag(price, -rows_ahead).over(order)) * 10_000


def simple_return(rows_ahead: int, price: str, across_days: bool = False) -> Column:
    """Return in basis points; ``across_days`` keeps the unguarded row order of a whole
    instrument (the panel has about a hundred rows per session)."""
    order = Window.partitionBy("sid").orderBy("day", "bucket") if across_days else day_order()
    return (F.lead(price, rows_ahead).over(order) - F.col(price)) / F.col(price) * 10_000


def lagged(df: DataFrame, column: str, lags) -> DataFrame:
    order = day_order()
    for j in lags:
        df = df.withColumn(f"{column}_l{j}", F.lag(column, j).over(order))
    return df


# ---------------------------------------------------------------- spec tables
def stack(panel: DataFrame, specs: list[tuple[str, Column, list[Column]]], keep: list[str]) -> DataFrame:
    """One row per (spec, panel row): ``spec, y, x0..`` (specs of one size)."""
    entries = [
        F.struct(
            F.lit(label).alias("spec"),
            y.cast("double").alias("y"),
            *[x.cast("double").alias(f"x{i}") for i, x in enumerate(xs)],
        )
        for label, y, xs in specs
    ]
    # window expressions must be columns before they enter the generator
    return panel.withColumn("_s", F.array(*entries)).select(*keep, F.inline("_s"))


def spec_table(rows: DataFrame, k: int, lags: int, category: str | None = "hour", keys: list[str] | None = None) -> DataFrame:
    """Slope of x0 per spec with HAC z, partial R2 and effect of one sd."""
    by = keys or ["spec"]
    xs = [f"x{i}" for i in range(k)]
    fit, influence = effects_regression(rows, by, "y", xs, category)
    error = hac_error(influence, by, ["day", "bucket"], lags)
    sds = rows.dropna(subset=["y", *xs]).groupBy(*by).agg(F.stddev_samp("x0").alias("sd_x0"))
    return (
        fit.join(error, by)
        .join(sds, by)
        .select(
            *by,
            "n",
            F.col("beta_raw").alias("beta"),
            (F.col("beta") / F.col("se_hac")).alias("z"),
            "partial_r2",
            (F.col("beta_raw") * F.col("sd_x0")).alias("effect_1sd"),
        )
    )


def joint_test(rows: DataFrame, keys: list[str], y: str, tested: list[str], controls: list[str], lags: int) -> DataFrame:
    """Wald/F statistic that all ``tested`` slopes are zero, on the HAC covariance.

    One influence column per tested slope; their cross products at each lag are summed on
    Spark and only the q x q covariance is solved.
    """
    q = len(tested)
    order = Window.partitionBy(*keys).orderBy("day", "bucket")
    fits, rows_psi = effects_regression(rows, keys, y, [*tested, *controls], tested=q)
    influences = rows_psi.select(
        *keys, "day", "bucket", *[F.col("psis")[i].alias(f"p{i}") for i in range(q)]
    )
    terms = []
    lagged_rows = influences
    for l in range(1, lags + 1):
        for i in range(q):
            lagged_rows = lagged_rows.withColumn(f"p{i}_{l}", F.lag(f"p{i}", l).over(order))
    for i in range(q):
        for j in range(q):
            total = F.sum(F.col(f"p{i}") * F.col(f"p{j}"))
            for l in range(1, lags + 1):
                w = 1 - l / (lags + 1.0)
                cross = F.col(f"p{i}") * F.col(f"p{j}_{l}") + F.col(f"p{i}_{l}") * F.col(f"p{j}")
                total = total + w * F.coalesce(F.sum(cross), F.lit(0.0))
            terms.append(total)
    cov = lagged_rows.groupBy(*keys).agg(F.array(*terms).alias("cov"))

    @F.pandas_udf("double")
    def wald(cov: pd.Series, beta: pd.Series) -> pd.Series:
        out = []
        for c, b in zip(cov, beta):
            b = np.asarray(b, float)
            v = np.asarray(c, float).reshape(len(b), len(b))
            try:
                out.append(float(b @ np.linalg.solve(v, b)) / len(b))
            except np.linalg.LinAlgError:
                out.append(None)
        return pd.Series(out, dtype="float64")

    betas = F.col("betas")
    return fits.join(cov, keys).select(
        *keys,
        "n",
        betas[0].alias("b0"),
        F.aggregate(betas, F.lit(0.0), lambda a, v: a + v).alias("sum_b"),
        wald("cov", betas).alias("f_joint"),
    )


# ---------------------------------------------------------------- placebo
MOMENTS = "spec string, rep int, hour bigint, n bigint, sx double, sy double, sxx double, sxy double"
#: Permutations worked on at once.
TOGETHER = 50


def _day_permutations(reps: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Moments by hour of y with x0, as it is (replicate 0) and permuted within the day.

        A permutation orders the day's rows by a hash of (seed, replicate, day, bucket) and pairs by position.
        """
        day = int(pdf["day"].iloc[0])
        buckets = np.sort(pdf["bucket"].unique())
        out = []
        for lo in range(0, reps + 1, TOGETHER):
            numbers = range(lo, min(lo + TOGETHER, reps + 1))
            keys = np.array(
                [
                    [int(hashlib.md5(f"{seed}|{r}|{day}|{b}".encode()).hexdigest()[:8], 16) for b in buckets]
                    for r in numbers
                ],
                dtype=np.int64,
            )
            for spec, rows in pdf.groupby("spec"):
                rows = rows.sort_values("bucket")
                x, y, hour = (rows[c].to_numpy() for c in ("x0", "y", "hour"))
                drawn = np.argsort(keys[:, np.searchsorted(buckets, rows["bucket"].to_numpy())], axis=1, kind="stable")
                if lo == 0:
                    drawn[0] = np.arange(len(x))
                mixed = x[drawn]
                for h in np.unique(hour):
                    here = hour == h
                    part, target = mixed[:, here], y[here]
                    out.append(
                        pd.DataFrame(
                            {
                                "spec": spec, "rep": np.array(numbers, np.int32), "hour": int(h), "n": int(here.sum()),
                                "sx": part.sum(1), "sy": target.sum(), "sxx": (part * part).sum(1), "sxy": part @ target,
                            }
                        )
                    )
        return pd.concat(out)

    return run


def shuffle_placebo(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """|slope| of y on x0 (hour effects) against within-day permutations of x0.

    A task permutes the panel rows of one session (bounded by the clock) and returns moments by hour only.
    """
    base = rows.dropna(subset=["y", "x0"]).select("spec", "day", "sid", "bucket", "hour", "y", "x0")
    moments = base.groupBy("day", "sid").applyInPandas(_day_permutations(reps, seed), MOMENTS)
    names = ("n", "sx", "sy", "sxx", "sxy")
    sums = moments.groupBy("spec", "rep", "hour").agg(*[F.sum(c).alias(c) for c in names])
    slopes = sums.groupBy("spec", "rep").agg(
        (
            F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
            / F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
        ).alias("b")
    )
    real = slopes.filter("rep = 0").select("spec", F.abs("b").alias("real"))
    null = slopes.filter("rep > 0").join(real, "spec")
    return null.groupBy("spec").agg(
        F.first("real").alias("abs_beta"),
        F.percentile(F.abs("b"), 0.99).alias("shuffled_p99"),
        # equal slopes differ in their last digits
        F.avg((F.abs("b") >= F.col("real") * (1 - 1e-9)).cast("double")).alias("p_empirical"),
    )


# ---------------------------------------------------------------- out of sample
PREDICTION = "spec string, pos bigint, actual double, benchmark double, model double"
#: Predicted rows of one task; each task reads the rows of the series up to its last one.
TARGETS = 256


def _bounds(sorted_prefix: np.ndarray) -> tuple[float, float]:
    """Values at 1 % and 99 % of the sorted prefix, between neighbours in proportion."""
    at = np.array([0.01, 0.99]) * (len(sorted_prefix) - 1)
    below = np.floor(at).astype(int)
    above = np.minimum(below + 1, len(sorted_prefix) - 1)
    low, high = sorted_prefix[below] + (at - below) * (sorted_prefix[above] - sorted_prefix[below])
    return low, high


def _block_predictions(controls: list[str], hours: bool, first_target: int):
    def design(pdf: pd.DataFrame) -> np.ndarray:
        columns = [np.ones(len(pdf)), *(pdf[c].to_numpy(float) for c in controls)]
        if hours:
            columns += [(pdf["hour"].to_numpy() == h).astype(float) for h in sorted(set(pdf["hour"]))[1:]]
        return np.column_stack(columns)

    def solved(moments: np.ndarray, target: np.ndarray) -> np.ndarray:
        # the least solution where a control has not varied yet
        inverse = np.linalg.pinv(moments, rcond=1e-13, hermitian=True)
        return np.einsum("tij,tj->ti", inverse, target)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Predictions of the targets of one block, all solved at once.

        Moments without the signal are running sums over the series.  The signal is clipped
        at other values for each target, so its moments are one product of the clipped
        training rows of all targets with the controls.
        """
        pdf = pdf.sort_values("pos")
        begin = max(int(pdf["block"].iloc[0]) * TARGETS, first_target)
        y, x, z = pdf["y"].to_numpy(float), pdf["x0"].to_numpy(float), design(pdf)
        targets = np.arange(begin, len(y))
        if not len(targets):
            return pd.DataFrame(columns=["spec", "pos", "actual", "benchmark", "model"])
        zz = np.cumsum(z[:, :, None] * z[:, None, :], axis=0)[targets - 1]
        zy = np.cumsum(z * y[:, None], axis=0)[targets - 1]
        limits = np.array([_bounds(np.sort(x[:t])) for t in targets])
        clipped = np.clip(x[None, : targets[-1]], limits[:, :1], limits[:, 1:])
        clipped[np.arange(targets[-1])[None, :] >= targets[:, None]] = 0.0  # not seen yet
        past = slice(0, targets[-1])
        xz, xy, xx = clipped @ z[past], clipped @ y[past], np.sum(clipped**2, axis=1)
        k = z.shape[1]
        whole = np.empty((len(targets), k + 1, k + 1))
        whole[:, 1:, 1:] = zz
        whole[:, 0, 0] = xx
        whole[:, 0, 1:] = whole[:, 1:, 0] = xz
        slopes = solved(whole, np.column_stack([xy, zy]))
        now = z[targets]
        return pd.DataFrame(
            {
                "spec": pdf["spec"].iloc[0],
                "pos": targets,
                "actual": y[targets],
                "benchmark": np.sum(now * solved(zz, zy), axis=1),
                "model": slopes[:, 0] * x[targets] + np.sum(now * slopes[:, 1:], axis=1),
            }
        )

    return run


def expanding_predictions(
    rows: DataFrame, warmup: int, controls: list[str] | None = None, hours: bool = False
) -> DataFrame:
    """Prediction of y for every row after ``warmup``, fitted on the rows before it.

    A series is cut into blocks of targets that are predicted apart from one another; a
    block gets the rows up to its end.  Rows are those of a panel, a hundred or so for each
    session and spec.
    """
    controls = controls or []
    order = Window.partitionBy("spec").orderBy("day", "bucket")
    placed = rows.dropna(subset=["y", "x0", *controls]).withColumn(
        "pos", F.row_number().over(order).cast("bigint") - 1
    )
    ends = placed.groupBy("spec").agg(F.floor(F.max("pos") / TARGETS).alias("last"))
    first = F.greatest(F.floor(F.col("pos") / TARGETS), F.lit(warmup // TARGETS))
    needed = F.when(first <= F.col("last"), F.sequence(first, F.col("last")))
    parts = placed.join(ends, "spec").withColumn("block", F.explode(needed))
    return parts.groupBy("spec", "block").applyInPandas(
        _block_predictions(controls, hours, max(1, warmup)), PREDICTION
    )


def clark_west(predictions: DataFrame, lags: int = 3) -> DataFrame:
    """Out-of-sample R2 and the Clark-West statistic (HAC t of the adjusted difference)."""
    e0 = F.col("actual") - F.col("benchmark")
    e1 = F.col("actual") - F.col("model")
    gap = F.col("benchmark") - F.col("model")
    rows = predictions.withColumn("f", e0 * e0 - (e1 * e1 - gap * gap))
    mean = rows.groupBy("spec").agg(
        F.count("*").alias("n"),
        F.avg("f").alias("mean_f"),
        (1 - F.sum(e1 * e1) / F.sum(e0 * e0)).alias("r2_oos"),
    )
    error = mean_hac(rows, ["spec"], "f", ["pos"], lags)
    return mean.join(error, "spec").select(
        "spec", "n", "r2_oos", (F.col("mean_f") / F.col("se_hac")).alias("clark_west")
    )


def mean_hac(rows: DataFrame, keys: list[str], value: str, order: list[str], lags: int) -> DataFrame:
    """Newey-West error of a mean."""
    group = Window.partitionBy(*keys)
    centred = rows.filter(F.col(value).isNotNull()).withColumn(
        "psi", (F.col(value) - F.avg(value).over(group)) / F.count(value).over(group)
    )
    return hac_error(centred, keys, order, lags)


def hit_rate(predictions: DataFrame, shares=(1.0, 0.2, 0.1)) -> DataFrame:
    """Share of right signs among the largest absolute predictions."""
    order = Window.partitionBy("spec").orderBy(F.abs("model").desc(), "pos")
    ranked = predictions.withColumn("_r", F.row_number().over(order)).withColumn(
        "_n", F.count("*").over(Window.partitionBy("spec"))
    )
    right = (F.signum("model") == F.signum("actual")).cast("double")
    top = lambda s: F.greatest(F.lit(1), F.floor(F.col("_n") * s))
    return ranked.groupBy("spec").agg(
        *[F.avg(F.when(F.col("_r") <= top(s), right)).alias(f"hit_{int(s * 100)}") for s in shares]
    )


def tail_drift(rows: DataFrame) -> DataFrame:
    """Signed drift where the signal is in its top decile, absolute drift where it is zero."""
    known = rows.filter("y IS NOT NULL AND x0 IS NOT NULL")
    cut = quantiles(known, ["spec"], F.abs("x0"), (0.9,)).select("spec", F.col("q")[0].alias("_p90"))
    j = known.join(cut, "spec")
    tail = F.abs("x0") > F.col("_p90")
    return j.groupBy("spec").agg(
        F.count("*").alias("n"),
        F.count_if(tail).alias("n_tail"),
        F.avg(F.when(tail, F.col("y") * F.signum("x0"))).alias("tail_drift"),
        F.avg(F.when(F.col("x0") == 0, F.abs("y"))).alias("base_drift"),
    )


def logit(rows: DataFrame, y: Column, xs: list[str], iterations: int = 60) -> list[tuple[str, float, float, bool]]:
    """Logit by Newton steps; each step is one aggregate of gradient and Hessian.

    Returns (name, coefficient, z, whether the steps came to rest) with the constant first.
    """
    names = ["const", *xs]
    data = rows.dropna(subset=xs).select(
        y.cast("double").alias("_y"), F.lit(1.0).alias("const"), *[F.col(x).cast("double").alias(x) for x in xs]
    ).filter("_y IS NOT NULL")
    beta = np.zeros(len(names))
    hessian = np.eye(len(names))
    rested = False
    for _ in range(iterations):
        score = sum((F.col(n) * float(b) for n, b in zip(names, beta)), F.lit(0.0))
        p = 1 / (1 + F.exp(-score))
        grad = [F.sum(F.col(n) * (F.col("_y") - p)).alias(f"g{i}") for i, n in enumerate(names)]
        hess = [
            F.sum(F.col(a) * F.col(b) * p * (1 - p)).alias(f"h{i}_{j}")
            for i, a in enumerate(names)
            for j, b in enumerate(names)
        ]
        row = data.agg(*grad, *hess).first()
        g = np.array(row[: len(names)], float)
        hessian = np.array(row[len(names):], float).reshape(len(names), len(names))
        step = np.linalg.lstsq(hessian, g, rcond=None)[0]
        beta = beta + step
        if not np.all(np.isfinite(beta)):
            break
        if np.max(np.abs(step)) <= 1e-8 * max(1.0, float(np.max(np.abs(beta)))):
            rested = True
            break
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(hessian)), 0, None))
    return [(n, float(b), float(b / s) if s > 0 else float("nan"), rested) for n, b, s in zip(names, beta, se)]


# ---------------------------------------------------------------- event study
def event_responses(
    tape: DataFrame,
    open_ms: int,
    close_ms: int,
    horizons=EVENT_HORIZONS_MS,
    before: Column | None = None,
    after: Column | None = None,
) -> DataFrame:
    """Signed price moves around new orders inside (undercut) or at (join) the touch.

    ``mechanical`` is the order's own effect; ``response`` the move from just after it to
    the 100 ms grid slot h later.  A grid slot holds the price before its first message and
    quiet slots keep the last one.  The price is the mid, or what ``before`` and ``after`` give
    just before and just after a message.
    """
    c = F.col
    if before is None or after is None:
        before = F.when(c("b0") < c("a0"), (c("b0") + c("a0")) / 2.0)
        after = F.when(c("b") < c("a"), (c("b") + c("a")) / 2.0)
    session = tape.filter((c("t_ms") >= open_ms) & (c("t_ms") <= close_ms)).withColumn(
        "slot", F.floor((c("t_ms") - open_ms) / GRID_MS)
    )
    grid = (
        session.groupBy(*KEY, "slot")
        .agg(F.min_by(F.struct(before.alias("m")), "rpt").alias("g"))
        .select(*KEY, c("slot").alias("at"), c("g.m").alias("grid_mid"))
        .filter("grid_mid IS NOT NULL")
        .withColumn("chunk", F.floor(c("at") / 6_000))
    )
    kind = F.when(c("new_class") == "undercut", "undercut").when(c("new_class") == "join_best", "join")
    sign = F.when(c("side") == BID, 1).otherwise(-1)
    events = (
        session.withColumn("kind", kind)
        .filter("kind IS NOT NULL")
        .select(
            *KEY, "rpt", "slot", "kind", "side", "qty", (c("a0") - c("b0")).alias("spread_before"),
            sign.alias("sign"), before.alias("pre"), after.alias("post"),
        )
        .filter("pre IS NOT NULL AND post IS NOT NULL")
    )
    last_slot = (close_ms - open_ms) // GRID_MS + 1
    probe = events.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "at", c("slot") + F.floor(c("h") / GRID_MS)
    ).withColumn("chunk", F.floor(c("at") / 6_000))
    hit = asof_last(probe, grid, KEY, ["at"], ["grid_mid"])
    inside = c("at") <= last_slot
    return hit.select(
        *KEY, "rpt", "slot", "kind", "side", "qty", "spread_before", "h",
        (c("sign") * (c("post") - c("pre")) + 0.0).alias("mechanical"),
        F.when(inside, c("sign") * (c("grid_mid") - c("post")) + 0.0).alias("response"),
    )


def event_table(responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean response per kind and horizon: iid t, HAC t of minute means, t across days."""
    known = responses.filter("response IS NOT NULL")
    keys = keys or ["kind", "h"]
    base = known.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("mechanical").alias("mechanical"),
        F.avg("response").alias("mean"),
        F.try_divide(F.avg("response"), F.stddev_samp("response") / F.sqrt(F.count("*"))).alias("t_iid"),
    )
    minutes = known.groupBy(*keys, "day", F.floor(F.col("slot") / 600).alias("minute")).agg(
        F.avg("response").alias("v")
    )
    hac = minutes.groupBy(*keys).agg(F.avg("v").alias("_m")).join(
        mean_hac(minutes, keys, "v", ["day", "minute"], 2), keys
    ).select(*keys, F.try_divide("_m", "se_hac").alias("t_hac"))
    days = known.groupBy(*keys, "day").agg(F.avg("response").alias("v")).groupBy(*keys).agg(
        F.try_divide(F.avg("v"), F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("t_day")
    )
    return base.join(hac, keys).join(days, keys)


def excess_minutes(responses: DataFrame) -> DataFrame:
    """Minute means of undercuts minus joins where both exist."""
    minute = F.floor(F.col("slot") / 600).alias("minute")
    means = responses.filter("response IS NOT NULL").groupBy("h", "day", minute).agg(
        F.avg(F.when(F.col("kind") == "undercut", F.col("response"))).alias("u"),
        F.avg(F.when(F.col("kind") == "join", F.col("response"))).alias("j"),
    )
    return means.filter("u IS NOT NULL AND j IS NOT NULL").select(
        "h", "day", "minute", (F.col("u") - F.col("j")).alias("excess")
    )


#: Replicates drawn in one row.
REPS_A_ROW = 100


def block_bootstrap(excess: DataFrame, block: int, reps: int, seed: int) -> DataFrame:
    """Moving-block bootstrap of the mean excess; blocks never leave a day.

    The mean of a drawn block is all a replicate needs, so the pool is an array of block means, and a row
    draws for a hundred replicates from it: replicates are never rows that are shuffled.
    """
    day = Window.partitionBy("h", "day").orderBy("minute")
    frame = day.rowsBetween(0, block - 1)
    sized = excess.withColumn("_len", F.count("*").over(Window.partitionBy("h", "day"))).filter(
        F.col("_len") >= block
    )
    pool = sized.withColumn("_full", F.count("*").over(frame)).withColumn(
        "m", F.avg("excess").over(frame)
    ).filter(F.col("_full") == block)
    numbered = carry_scan(
        pool.select("h", "day", "minute", "m"),
        ["h"],
        ["minute"],
        [running_sum("i", F.lit(1).cast("bigint"), inclusive=False)],
        chunk="day",
    )
    placed = F.array_sort(F.collect_list(F.struct("i", "m")))  # a value for each minute of the sessions
    pools = numbered.groupBy("h").agg(placed["m"].alias("pool"))
    total = sized.groupBy("h").agg(F.avg("excess").alias("mean"), F.count("*").alias("minutes"))
    plan = pools.join(total, "h").select(
        "h", "pool", F.greatest(F.lit(1), F.floor(F.col("minutes") / block)).alias("draws"),
        F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // REPS_A_ROW))).alias("part"),
    )

    def drawn_mean(rep: Column) -> Column:
        place = lambda d: F.floor(uniform(seed, rep, d) * F.size("pool")).cast("int") + 1
        drawn = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("draws")), lambda d: F.element_at("pool", place(d)))
        return F.aggregate(drawn, F.lit(0.0), lambda s, m: s + m) / F.col("draws")

    first = F.col("part") * REPS_A_ROW + 1
    numbers = F.sequence(first, F.least(first + REPS_A_ROW - 1, F.lit(reps)))
    tasks = int(excess.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = plan.repartition(tasks, "h", "part").select("h", F.explode(F.transform(numbers, drawn_mean)).alias("s"))
    tested = stats.groupBy("h").agg(
        F.percentile("s", 0.025).alias("ci_low"),
        F.percentile("s", 0.975).alias("ci_high"),
        (
            2
            * F.least(
                F.avg((F.col("s") <= 0).cast("double")), F.avg((F.col("s") >= 0).cast("double"))
            )
        ).alias("p_value"),
    )
    return total.join(tested, "h")
