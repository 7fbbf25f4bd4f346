"""Least squares from additive moments.

Rows are only ever summed on Spark: n, sums and cross products per group.  The solve is
on matrices of a few columns, vectorised over the (few) groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def cross_sums(columns: list[Column], weight: Column | None = None) -> list[Column]:
    """Sums of all products of ``columns`` (upper triangle), as ``m_i_j``."""
    out = []
    for i, j in pairs(len(columns)):
        product = columns[i] * columns[j]
        out.append(F.sum(product if weight is None else product * weight).alias(f"m_{i}_{j}"))
    return out


def packed(k: int) -> Column:
    """The ``m_i_j`` columns as one array."""
    return F.array(*[F.col(f"m_{i}_{j}").cast("double") for i, j in pairs(k)])


def square(flat: np.ndarray, k: int) -> np.ndarray:
    """Symmetric matrix from its packed upper triangle."""
    m = np.zeros((k, k))
    for value, (i, j) in zip(flat, pairs(k)):
        m[i, j] = m[j, i] = value
    return m


def solve_normal(m: np.ndarray):
    """beta, inverse of X'X and residual sum of squares of the last column on the others."""
    k = m.shape[0] - 1
    xx, xy, yy = m[:k, :k], m[:k, k], m[k, k]
    scale = np.sqrt(np.where(np.diag(xx) > 0, np.diag(xx), 1.0))
    try:
        inverse = np.linalg.inv(xx / np.outer(scale, scale)) / np.outer(scale, scale)
    except np.linalg.LinAlgError:
        return None
    if not np.all(np.isfinite(inverse)):
        return None
    beta = inverse @ xy
    return beta, inverse, float(yy - beta @ xy)


_VECTOR = T.ArrayType(T.DoubleType())
SOLUTION = T.StructType(
    [
        T.StructField("beta", _VECTOR),
        T.StructField("inv_diag", _VECTOR),
        T.StructField("inverse", _VECTOR),
        T.StructField("ssr", T.DoubleType()),
    ]
)


@F.pandas_udf(SOLUTION)
def solve(moments: pd.Series) -> pd.DataFrame:
    """Packed moments of (x1..xk, y) to coefficients; NULL entries where singular."""
    rows = []
    for flat in moments:
        none = (None, None, None, None)
        if flat is None or any(v is None or v != v for v in flat):
            rows.append(none)
            continue
        k = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
        got = solve_normal(square(np.asarray(flat, dtype=float), k))
        if got is None:
            rows.append(none)
            continue
        beta, inverse, ssr = got
        rows.append((beta.tolist(), np.diag(inverse).tolist(), inverse.ravel().tolist(), ssr))
    return pd.DataFrame(rows, columns=["beta", "inv_diag", "inverse", "ssr"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def grouped_fit(rows: DataFrame, target: list[str], y: str, xs: list[str], category: str | None):
    """OLS of ``y`` on ``xs`` (with category effects) per ``target``.

    Returns ``(fit, levels)``: one row per target with coefficients, and one row per
    (target, category) with the category's intercept.  Category effects are removed by
    within-category moments, so no dummy columns exist.
    """
    cat = F.lit("all") if category is None else F.col(category)
    used = rows.withColumn("_cat", cat).dropna(subset=[y, *xs])
    k = len(xs)
    z = [F.col(c).cast("double") for c in [*xs, y]]
    sums = used.groupBy(*target, "_cat").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(z)],
        *cross_sums(z),
        *[F.min(c).alias(f"lo_{i}") for i, c in enumerate(z[:k])],
        *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(z[:k])],
    )
    return fit_from_sums(sums, target, k)


def merged_sums(sums: DataFrame, target: list[str], k: int) -> DataFrame:
    """Add up per-category sums of several parts of a training set."""
    return sums.groupBy(*target, "_cat").agg(
        F.sum("n").alias("n"),
        *[F.sum(f"s_{i}").alias(f"s_{i}") for i in range(k + 1)],
        *[F.sum(f"m_{i}_{j}").alias(f"m_{i}_{j}") for i, j in pairs(k + 1)],
        *[F.min(f"lo_{i}").alias(f"lo_{i}") for i in range(k)],
        *[F.max(f"hi_{i}").alias(f"hi_{i}") for i in range(k)],
    )


def fit_from_sums(sums: DataFrame, target: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    inner = [
        F.sum(
            F.col(f"m_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")
        ).alias(f"m_{i}_{j}")
        for i, j in pairs(k + 1)
    ]
    pooled = sums.groupBy(*target).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("levels"),
        F.sum(f"s_{k}").alias("sy"),
        F.sum(F.col(f"m_{k}_{k}")).alias("syy"),
        F.min("_cat").alias("first_cat"),
        *inner,
        *[F.min(f"lo_{i}").alias(f"lo_{i}") for i in range(k)],
        *[F.max(f"hi_{i}").alias(f"hi_{i}") for i in range(k)],
    )
    flat = pooled.withColumn("_f", solve(packed(k + 1)))
    for i in range(k):
        flat = flat.withColumn(f"_v{i}", F.col(f"lo_{i}") < F.col(f"hi_{i}"))
    varies = F.lit(True)
    for i in range(k):
        varies = varies & F.col(f"_v{i}")
    parameters = F.lit(k + 1) + F.col("levels") - 1
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    free = F.col("n") - parameters
    fit = flat.select(
        *target,
        "n",
        "levels",
        "first_cat",
        F.when(F.col("n") >= 2, F.sqrt(F.greatest(F.lit(0.0), total) / (F.col("n") - 1))).alias("s_y"),
        F.when(F.col("n") < parameters + 2, "few_rows")
        .when(~varies, "constant_control")
        .when(F.col("_f.beta").isNull(), "singular")
        .otherwise("ok")
        .alias("status"),
        F.col("_f.beta").alias("beta"),
        F.col("_f.inverse").alias("inverse"),
        F.when(free > 0, F.col("_f.ssr") / free).alias("s2"),
        F.col("_f.inv_diag").alias("inv_diag"),
        F.when(total > 0, 1 - F.col("_f.ssr") / total).alias("r2"),
    ).withColumn(
        "se", F.transform("inv_diag", lambda v: F.sqrt(F.greatest(F.lit(0.0), v * F.col("s2"))))
    )
    levels = (
        sums.withColumnRenamed("n", "n_cat")
        .withColumn("x_mean", F.array(*[F.col(f"s_{i}") / F.col("n_cat") for i in range(k)]))
        .withColumn("y_mean", F.col(f"s_{k}") / F.col("n_cat"))
        .select(*target, "_cat", "n_cat", "x_mean", "y_mean")
        .join(fit.select(*target, "beta"), target)
        .withColumn("alpha", F.col("y_mean") - dot(F.col("beta"), F.col("x_mean")))
        .drop("beta")
    )
    return fit, levels
