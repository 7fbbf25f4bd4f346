"""Cluster inference from additive moments: bootstraps reweight cluster sums, never rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.draws import six_point_weight, uniform
from tickloom.functions.linear import cross_sums, dot, packed, pairs, solve, solve_normal, square
from tickloom.operators.quantiles import quantiles


# ---------------------------------------------------------------- bootstraps
def session_draws(clusters: DataFrame, keys: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Resampled clusters: per replicate as many draws (with replacement) as clusters.

    ``clusters`` has one row per (keys, cluster).  Draw i of replicate r takes the cluster
    at position floor(u * G); the result repeats drawn rows.
    """
    order = Window.partitionBy(*keys).orderBy(cluster)
    group = Window.partitionBy(*keys)
    placed = clusters.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_g", F.count("*").over(group)
    )
    draws = placed.select(
        *keys, "_i", "_g", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    ).select(
        *keys,
        "rep",
        F.floor(uniform(seed, F.col("rep"), F.col("_i")) * F.col("_g")).cast("int").alias("_i"),
    )
    return draws.join(placed.drop("_g"), [*keys, "_i"]).drop("_i")


def wild_weights(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """Every (cluster row, replicate) with its six-point weight ``w``."""
    return clusters.withColumn(
        "rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))
    ).withColumn("w", six_point_weight(seed, F.col("rep"), F.col(cluster)))


def interval(replicates: DataFrame, keys: list[str], stat: str, reps: int) -> DataFrame:
    """Percentile interval; NULL unless 90 % of the replicates are finite."""
    finite = F.when(F.col(stat).isNotNull() & ~F.isnan(stat), F.col(stat))
    q = replicates.groupBy(*keys).agg(
        F.count(finite).alias("_n"), F.percentile(finite, F.array(F.lit(0.025), F.lit(0.975))).alias("_q")
    )
    enough = F.col("_n") >= 0.9 * reps
    return q.select(
        *keys,
        F.when(enough, F.col("_q")[0]).alias("ci_low"),
        F.when(enough, F.col("_q")[1]).alias("ci_high"),
    )


def ratio_bootstrap(rows: DataFrame, keys: list[str], cluster: str, num: Column, den: Column, reps: int, seed: int) -> DataFrame:
    """sum(num) / sum(den) with a session-bootstrap interval (means are den = 1)."""
    sums = rows.groupBy(*keys, cluster).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    point = sums.groupBy(*keys).agg(
        (F.sum("_num") / F.sum("_den")).alias("value"), F.sum("_den").alias("n")
    )
    stats = (
        session_draws(sums, keys, cluster, reps, seed)
        .groupBy(*keys, "rep")
        .agg(F.try_divide(F.sum("_num").cast("double"), F.sum("_den").cast("double")).alias("stat"))
    )
    return point.join(interval(stats, keys, "stat", reps), keys)


def _corr_from(n, sx, sy, sxx, syy, sxy) -> Column:
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-12) & (vy > 1e-12), (sxy - sx * sy / n) / F.sqrt(vx * vy))


PAIR_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def pair_sums(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    a, b = F.col(x), F.col(y)
    return rows.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"),
        F.sum(b * b).alias("syy"),
        F.sum(a * b).alias("sxy"),
    )


def correlation_bootstrap(rows: DataFrame, keys: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Pearson correlation with a session-bootstrap interval, from six sums per session."""
    sums = pair_sums(rows, [*keys, cluster])
    total = [F.sum(c).alias(c) for c in PAIR_SUMS]
    r = _corr_from(*[F.col(c) for c in PAIR_SUMS])
    point = sums.groupBy(*keys).agg(*total, F.count("*").alias("sessions")).select(
        *keys, F.col("n").cast("bigint").alias("n"), "sessions", r.alias("r")
    )
    stats = (
        session_draws(sums, keys, cluster, reps, seed)
        .groupBy(*keys, "rep")
        .agg(*total)
        .withColumn("stat", r)
    )
    return point.join(interval(stats, keys, "stat", reps), keys)


def average_rank(column: str, partition: list[str]) -> Column:
    """Rank with ties averaged (as rank correlation needs)."""
    order = Window.partitionBy(*partition).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(*partition, column))
    return F.rank().over(order) + (ties - 1) / 2.0


def correlations(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Pearson and Spearman; NULL under 5 rows or without variation."""
    known = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumn("_rx", average_rank(x, keys)).withColumn("_ry", average_rank(y, keys))
    ok = (F.count("*") >= 5) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(ok, F.corr(x, y)).alias("pearson"),
        F.when(ok, F.corr("_rx", "_ry")).alias("spearman"),
    )


def spearman_brown(r: Column) -> Column:
    return 2 * r / (1 + r)


def reliability_class(sb: Column) -> Column:
    return (
        F.when(sb >= 0.50, "varies").when(sb < 0.30, "barely_varies").otherwise("inconclusive")
    )


def without_hour_mean(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Raw and hour-demeaned versions stacked under ``version``."""
    group = Window.partitionBy(*keys, "hour")
    centred = rows
    for c in columns:
        centred = centred.withColumn(c, F.col(c) - F.avg(c).over(group))
    return rows.withColumn("version", F.lit("raw")).unionByName(
        centred.withColumn("version", F.lit("hour_mean_removed"))
    )


def wild_correlation(rows: DataFrame, keys: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Correlation of x and y with wild-cluster replicates of y around its fit on x.

    Each cluster is reduced to the sums of fitted value f, residual u, f2, fu, u2 and their
    products with x; a replicate's correlation follows from weighted sums.
    """
    sums = pair_sums(rows, keys)
    c = F.col
    slope = (c("sxy") - c("sx") * c("sy") / c("n")) / (c("sxx") - c("sx") * c("sx") / c("n"))
    fit = sums.select(
        *keys,
        c("n").alias("_n"),
        (c("sx") / c("n")).alias("_mx"),
        slope.alias("_b"),
        (c("sy") / c("n") - slope * c("sx") / c("n")).alias("_a"),
        (c("sxx") - c("sx") * c("sx") / c("n")).alias("_vx"),
        _corr_from(*[c(s) for s in PAIR_SUMS]).alias("r"),
    )
    parts = (
        rows.filter("x IS NOT NULL AND y IS NOT NULL")
        .join(fit, keys)
        .withColumn("f", c("_a") + c("_b") * c("x"))
        .withColumn("u", c("y") - c("f"))
        .withColumn("xc", c("x") - c("_mx"))
        .groupBy(*keys, cluster)
        .agg(
            F.sum("f").alias("f"), F.sum("u").alias("u"), F.sum(c("f") * c("f")).alias("ff"),
            F.sum(c("f") * c("u")).alias("fu"), F.sum(c("u") * c("u")).alias("uu"),
            F.sum(c("xc") * c("f")).alias("xf"), F.sum(c("xc") * c("u")).alias("xu"),
        )
    )
    w = c("w")
    stats = (
        wild_weights(parts, cluster, reps, seed)
        .groupBy(*keys, "rep")
        .agg(
            F.sum(c("f") + w * c("u")).alias("y1"),
            F.sum(c("ff") + 2 * w * c("fu") + w * w * c("uu")).alias("y2"),
            F.sum(c("xf") + w * c("xu")).alias("xy"),
        )
        .join(fit.select(*keys, "_n", "_vx"), keys)
        .withColumn(
            "stat",
            F.try_divide(c("xy"), F.sqrt((c("y2") - c("y1") * c("y1") / c("_n")) * c("_vx"))),
        )
    )
    sessions = parts.groupBy(*keys).agg(F.count("*").alias("sessions"))
    return (
        fit.select(*keys, c("_n").cast("bigint").alias("n"), "r")
        .join(sessions, keys)
        .join(interval(stats, keys, "stat", reps), keys)
    )


def hour_share(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the variance of ``value`` explained by the hour."""
    known = rows.filter(F.col(value).isNotNull())
    per = known.groupBy(*keys, "hour").agg(
        F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss")
    )
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    within = F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    return per.groupBy(*keys).agg((1 - within / (ss - s * s / n)).alias("hour_share"))


# ---------------------------------------------------------------- regressions
def effects_regression(rows: DataFrame, keys: list[str], y: str, xs: list[str], category: str | None = "hour", tested: int = 1) -> tuple[DataFrame, DataFrame]:
    """OLS with category effects; ``xs[0]`` is the regressor of interest.

    Returns ``(fit, influence)``: the fit per key (standardised beta, partial R2 of the
    regressor, n) and per row the residual ``u`` and the influence ``psi`` on beta, whose
    cluster sums, products and lags give every standard error.  With ``tested`` > 1 rows
    also carry ``psis``, the raw influences on the first slopes.
    """
    used = rows.dropna(subset=[y, *xs])
    group = Window.partitionBy(*keys, *([category] if category else []))
    k = len(xs)
    centred = used
    for i, c in enumerate([*xs, y]):
        centred = centred.withColumn(f"z{i}", F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(group))
    z = [F.col(f"z{i}") for i in range(k + 1)]
    moments = centred.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.stddev_samp(xs[0]).alias("sd_x"),
        F.stddev_samp(y).alias("sd_y"),
        *cross_sums(z),
    )
    solved = moments.withColumn("_f", solve(packed(k + 1)))
    beta0 = F.get("_f.beta", F.lit(0))
    gain = beta0 * beta0 / F.get("_f.inv_diag", F.lit(0))
    fit = solved.select(
        *keys,
        "n",
        beta0.alias("beta_raw"),
        (beta0 * F.col("sd_x") / F.col("sd_y")).alias("beta"),
        (F.col("sd_x") / F.col("sd_y")).alias("scale"),
        F.col("_f.ssr").alias("ssr"),
        (gain / (F.col("_f.ssr") + gain)).alias("partial_r2"),
        F.col("_f.beta").alias("_beta"),
        F.slice(F.col("_f.inverse"), 1, k).alias("_row"),
        F.slice(F.col("_f.inverse"), 1, k * tested).alias("_rows"),
    )
    x = F.array(*z[:k])
    influence = (
        centred.join(fit.select(*keys, "_beta", "_row", "_rows", "scale"), keys)
        .withColumn("u", z[k] - dot(F.col("_beta"), x))
        .withColumn("psi", dot(F.col("_row"), x) * F.col("u") * F.col("scale"))
    )
    if tested > 1:
        each = [dot(F.slice("_rows", i * k + 1, k), x) * F.col("u") for i in range(tested)]
        influence = influence.withColumn("psis", F.array(*each))
    influence = influence.drop("_beta", "_row", "_rows", *[f"z{i}" for i in range(k + 1)])
    return fit.withColumn("betas", F.slice("_beta", 1, tested)).drop("_beta", "_row", "_rows"), influence


def hac_error(influence: DataFrame, keys: list[str], order: list[str], lags: int, within: list[str] | None = None) -> DataFrame:
    """Newey-West error of beta (Bartlett): rows in table order, session edges ignored
    unless ``within`` names the session columns."""
    w = Window.partitionBy(*keys, *(within or [])).orderBy(*order)
    terms = [F.sum(F.col("psi") * F.col("psi"))]
    lagged = influence
    for l in range(1, lags + 1):
        lagged = lagged.withColumn(f"_psi{l}", F.lag("psi", l).over(w))
        terms.append(2.0 * (1 - l / (lags + 1.0)) * F.coalesce(F.sum(F.col("psi") * F.col(f"_psi{l}")), F.lit(0.0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return lagged.groupBy(*keys).agg(F.sqrt(F.greatest(F.lit(0.0), total)).alias("se_hac"))


def wild_error(influence: DataFrame, keys: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Wild cluster bootstrap of beta: one score per cluster, replicates add weighted scores.

    Basic interval bounds are offsets to subtract from beta.
    """
    scores = influence.groupBy(*keys, cluster).agg(F.sum("psi").alias("_score"))
    stats = (
        wild_weights(scores, cluster, reps, seed)
        .groupBy(*keys, "rep")
        .agg(F.sum(F.col("w") * F.col("_score")).alias("stat"))
    )
    return stats.groupBy(*keys).agg(
        F.stddev_samp("stat").alias("se_wild"),
        F.percentile("stat", 0.025).alias("d_low"),
        F.percentile("stat", 0.975).alias("d_high"),
    )


def residual_icc(influence: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    """Intraclass correlation of the residuals by session (one-way ANOVA)."""
    per = influence.groupBy(*keys, cluster).agg(
        F.count("*").alias("k"), F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("ss")
    )
    g = per.groupBy(*keys).agg(
        F.sum("k").alias("n"),
        F.count("*").alias("sessions"),
        F.sum(F.col("k") * F.col("k")).alias("kk"),
        F.sum(F.col("s") * F.col("s") / F.col("k")).alias("between"),
        F.sum("s").alias("s"),
        F.sum("ss").alias("ss"),
    )
    n, m = F.col("n"), F.col("sessions")
    n0 = (n - F.col("kk") / n) / (m - 1)
    msb = (F.col("between") - F.col("s") * F.col("s") / n) / (m - 1)
    msw = (F.col("ss") - F.col("between")) / (n - m)
    return g.select(*keys, "sessions", ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"))


def regression_table(rows: DataFrame, keys: list[str], y: str, xs: list[str], order: list[str], reps: int, seed: int, lags: int = 5, cluster: str = "day") -> DataFrame:
    """Standardised beta of ``xs[0]`` with wild and HAC intervals, partial R2, ICC and power."""
    fit, influence = effects_regression(rows, keys, y, xs)
    z80 = 1.959964 + 0.841621
    table = (
        fit.join(hac_error(influence, keys, order, lags), keys)
        .join(wild_error(influence, keys, cluster, reps, seed), keys)
        .join(residual_icc(influence, keys, cluster), keys)
    )
    per_session = F.col("n") / F.col("sessions")
    return table.select(
        *keys,
        "n",
        "sessions",
        "beta",
        (F.col("beta") - F.col("d_high")).alias("ci_low"),
        (F.col("beta") - F.col("d_low")).alias("ci_high"),
        "se_wild",
        (F.col("beta") - 1.959964 * F.col("se_hac")).alias("hac_low"),
        (F.col("beta") + 1.959964 * F.col("se_hac")).alias("hac_high"),
        "se_hac",
        "partial_r2",
        "icc",
        (1 + (per_session - 1) * F.col("icc")).alias("design_effect"),
        (z80 * F.col("se_wild")).alias("detectable_beta"),
        F.ceil(F.col("sessions") * F.pow(z80 * F.col("se_wild") / 0.10, 2)).alias("sessions_for_010"),
        F.ceil(F.col("sessions") * F.pow(z80 * F.col("se_wild") / 0.20, 2)).alias("sessions_for_020"),
    )


def _partial(drop: int):
    @F.pandas_udf(T.DoubleType())
    def udf(moments: pd.Series) -> pd.Series:
        """Partial R2 of the first ``drop`` regressors from packed moments (const included)."""
        out = []
        for flat in moments:
            k = int((math.sqrt(8 * len(flat) + 1) - 1) / 2)
            m = square(np.asarray(flat, float), k)
            full = solve_normal(m)
            keep = list(range(drop, k))
            reduced = solve_normal(m[np.ix_(keep, keep)])
            ok = full is not None and reduced is not None and reduced[2] > 0
            out.append((reduced[2] - full[2]) / reduced[2] if ok else None)
        return pd.Series(out, dtype="float64")

    return udf


def session_moments(rows: DataFrame, keys: list[str], cluster: str, columns: list[str]) -> DataFrame:
    """Cross products of (columns, with a constant before the last one) per session."""
    used = rows.dropna(subset=columns)
    z = [*[F.col(c).cast("double") for c in columns[:-1]], F.lit(1.0), F.col(columns[-1]).cast("double")]
    return used.groupBy(*keys, cluster).agg(*cross_sums(z))


def partial_r2_bootstrap(rows: DataFrame, cluster: str, equations: dict[str, tuple[str, list[str], list[str]]], reps: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Partial R2 of each equation and of their difference, sessions resampled in pairs.

    ``equations`` maps two names to (y, tested regressors, controls).  Both equations use
    the same draws; a replicate sums session moments and solves once.
    """
    keys = keys or []
    parts, sizes, drops = [], {}, {}
    for name, (y, tested, controls) in equations.items():
        sizes[name], drops[name] = len(tested) + len(controls) + 2, len(tested)
        m = session_moments(rows, keys, cluster, [*tested, *controls, y])
        parts.append(m.select(*keys, cluster, packed(sizes[name]).alias(name)))
    both = parts[0]
    for part in parts[1:]:
        both = both.join(part, [*keys, cluster])

    def added(source: DataFrame, by: list[str]) -> DataFrame:
        sums = [
            F.array(*[F.sum(F.col(name)[i]) for i in range(len(pairs(sizes[name])))]).alias(name)
            for name in equations
        ]
        return source.groupBy(*by).agg(*sums) if by else source.agg(*sums)

    def valued(df: DataFrame) -> DataFrame:
        for name in equations:
            df = df.withColumn(f"pr2_{name}", _partial(drops[name])(F.col(name)))
        first, second = list(equations)
        return df.withColumn("difference", F.col(f"pr2_{second}") - F.col(f"pr2_{first}"))

    label = [*keys, "_all"]
    tagged = both.withColumn("_all", F.lit(1))
    point = valued(added(tagged, label)).drop(*equations)
    stats = valued(added(session_draws(tagged, label, cluster, reps, seed), [*label, "rep"]))
    return point.join(interval(stats, label, "difference", reps), label).drop("_all")


# ---------------------------------------------------------------- splines and Shapley
def natural_spline(x: str, knots: str) -> list[Column]:
    """Natural cubic spline basis on five knots (four columns, no intercept).

    Textbook form: the scaled difference of the truncated cubes at a knot and at the last
    knot, less that of the last knot but one.  A knot that coincides with the last has none.
    """
    cubes = f"transform({knots}, k -> power(greatest({x} - k, 0D), 3))"
    scaled = (
        f"zip_with({cubes}, {knots}, (c, k) -> "
        f"coalesce(try_divide(c - element_at({cubes}, -1), element_at({knots}, -1) - k), 0D))"
    )
    return [F.expr(x), *(F.expr(f"{scaled}[{i}] - {scaled}[3]") for i in range(3))]


def spline_columns(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Knots at min, quartiles and max of each group's column, then its basis columns."""
    named = F.inline(F.array(*[F.struct(F.lit(g).alias("_g"), F.col(g).cast("double").alias("_x")) for g in groups]))
    marks = quantiles(rows.select(named), ["_g"], F.col("_x"), (0.0, 0.25, 0.5, 0.75, 1.0), "_k")
    knots = marks.agg(*[F.max(F.when(F.col("_g") == g, F.col("_k"))).alias(f"_k_{g}") for g in groups])
    joined = rows.join(F.broadcast(knots))  # one row by construction
    for g in groups:
        for i, c in enumerate(natural_spline(g, f"_k_{g}")):
            joined = joined.withColumn(f"{g}_s{i}", c)
    return joined.drop(*[f"_k_{g}" for g in groups])


SHAPLEY = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("phi_0", "phi_1", "phi_2", "r2_total")]
)


#: Weight of the R2 of each set of groups in each group's share, in sixths; the sets are
#: none, 0, 1, 01, 2, 02, 12, 012.
SHARE_WEIGHTS = np.array(
    [
        [-2, 2, -1, 1, -1, 1, -2, 2],
        [-2, -1, 2, 1, -1, -2, 1, 2],
        [-2, -1, -1, -2, 2, 1, 1, 2],
    ]
)


@F.pandas_udf(SHAPLEY)
def shapley_r2(moments: pd.Series) -> pd.DataFrame:
    """Shapley shares of R2 over three groups of four columns, from packed moments of
    (12 columns, constant, y)."""
    m = np.stack([square(np.asarray(flat, float), 14) for flat in moments]) if len(moments) else np.zeros((0, 14, 14))
    n = np.maximum(m[:, 12, 12], 1)
    # moments about the means, in units of the columns' own spread
    about = m - m[:, :, 12:13] * m[:, 12:13, :] / n[:, None, None]
    spread = np.sqrt(np.maximum(np.diagonal(about, axis1=1, axis2=2), 0))
    unit = np.where(spread > 0, spread, 1.0)
    about = about / (unit[:, :, None] * unit[:, None, :])
    explained = np.zeros((len(m), 8))
    for members in range(1, 8):
        used = [c for c in range(12) if members >> (c // 4) & 1]
        xx, xy = about[:, used][:, :, used], about[:, used, 13]
        inverse = np.linalg.pinv(xx, rcond=1e-12, hermitian=True)
        explained[:, members] = np.einsum("ti,tij,tj->t", xy, inverse, xy)
    explained[spread[:, 13] == 0] = np.nan
    shares = explained @ SHARE_WEIGHTS.T / 6.0
    return pd.DataFrame(
        {"phi_0": shares[:, 0], "phi_1": shares[:, 1], "phi_2": shares[:, 2], "r2_total": explained[:, 7]}
    )


def shapley_table(rows: DataFrame, y: str, groups: list[str], cluster: str, reps: int, seed: int) -> DataFrame:
    """Shapley decomposition with session-bootstrap intervals: one row per component."""
    based = spline_columns(rows.dropna(subset=[y, *groups]), groups)
    columns = [f"{g}_s{i}" for g in groups for i in range(4)]
    moments = session_moments(based, [], cluster, [*columns, y]).select(
        F.lit(1).alias("_all"), cluster, packed(14).alias("m")
    )
    size = len(pairs(14))
    added = F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m")

    def long(df, *keep):
        v = df.withColumn("_v", shapley_r2("m"))
        names = [*groups, "r2_total"]
        fields = ["phi_0", "phi_1", "phi_2", "r2_total"]
        return v.select(
            *keep,
            F.inline(F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"_v.{f}").alias("value")) for n, f in zip(names, fields)])),
        )

    point = long(moments.groupBy("_all").agg(added), "_all").drop("_all")
    stats = long(
        session_draws(moments, ["_all"], cluster, reps, seed).groupBy("_all", "rep").agg(added), "rep"
    )
    return point.join(interval(stats, ["component"], "value", reps), "component")
