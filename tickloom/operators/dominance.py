"""Offline dominance sums: for each query the weight of all points below it in two coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.kernels import dominated, sorted_map


def dominance_sums(
    points: DataFrame, queries: DataFrame, group: list[str], x: str, y: list[str], weight: Column, ids: list[str], bits: int
) -> DataFrame:
    """``ids`` of every query with ``below``: the weight of its group's points with less ``x`` and less ``y``.

    ``x`` is below 2 ** ``bits``.  A group is streamed in order of ``y``; its state is the prefix sums over the x it has met.
    """
    rest = [c for c in ids if c not in (*group, *y)]
    kept = dict.fromkeys([*group, *y, *rest])
    asked = queries.select(*kept, F.col(x).cast("bigint").alias("x"), F.lit(True).alias("query"), F.lit(0).cast("bigint").alias("w"))
    given = points.select(*dict.fromkeys([*group, *y]), F.col(x).cast("bigint").alias("x"), F.lit(False).alias("query"), weight.cast("bigint").alias("w"))
    rows = asked.unionByName(given, allowMissingColumns=True)
    # numbers that a point has not must not turn a column of whole numbers into one of fractions
    rows = rows.fillna({c: 0 for c in rest if dict(rows.dtypes)[c] in ("bigint", "int")})
    types = dict(queries.select(*ids).dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in ids) + ", below bigint"
    # false sorts first, so queries carry the smaller key
    ordered = rows.withColumn("later", F.when(F.col("query"), 0).otherwise(1))
    return sorted_map(ordered, group, [*y, "later"], dominated(group, ids, bits, [*ids, "below"]), schema)
