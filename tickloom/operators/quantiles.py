"""Exact quantiles by rank selection: no task or buffer holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that a group's values are cut into; only those that hold a wanted rank are ordered.
BUCKETS = 256


def quantiles(rows: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], name: str = "q") -> DataFrame:
    """``keys`` and the array ``name`` of interpolated quantiles of ``value`` (NULL apart), as sorting would give.

    Equal values are counted first.  Cut points from a bounded sketch split each group into buckets; exact counts of
    the buckets tell which of them hold the wanted ranks, however good the sketch is, and only those are ordered.
    Groups without a value have no row.
    """
    keys = list(keys) or ["_all"]
    if keys == ["_all"]:
        rows = rows.withColumn("_all", F.lit(0))
    counted = (
        rows.select(*keys, value.cast("double").alias("_v"))
        .filter("_v IS NOT NULL")
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_c"))
    )
    steps = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    cuts = counted.groupBy(*keys).agg(F.percentile_approx("_v", steps, F.lit(10_000)).alias("_cuts"))
    bucketed = counted.join(cuts, keys).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))
    ).drop("_cuts")
    group = Window.partitionBy(*keys)  # a group's buckets
    sums = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.sum("_c").alias("_here"))
        .withColumns(
            {
                "_n": F.sum("_here").over(group),
                "_before": F.sum("_here").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
                - F.col("_here"),
            }
        )
    )
    # a rank between two values takes from both
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    ranks = F.flatten(
        F.transform(wanted, lambda s: F.array(F.floor(s * (F.col("_n") - 1)), F.ceil(s * (F.col("_n") - 1))))
    )
    held = sums.withColumn(
        "_ranks",
        F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_here"))),
    ).filter(F.size("_ranks") > 0)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        bucketed.join(held, [*keys, "_bucket"])
        .withColumn("_to", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_mine", F.filter("_ranks", lambda r: (r >= F.col("_to") - F.col("_c")) & (r < F.col("_to"))))
        .select(*keys, "_n", "_v", F.explode("_mine").alias("_rank"))
    )
    found = placed.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")  # wanted ranks
    )

    def between(share: Column) -> Column:
        place = share * (F.col("_n") - 1)
        low, high = F.element_at("_at", F.floor(place)), F.element_at("_at", F.ceil(place))
        return low + (place - F.floor(place)) * (high - low)

    out = found.select(*keys, F.transform(wanted, between).alias(name))
    return out.drop("_all") if keys == ["_all"] else out
