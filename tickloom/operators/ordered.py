"""Ordered scans that never put a whole session into one task.

A long ordered log is cut into consecutive *chunks*.  A running value over the log is
the same value inside the chunk combined with the total of the chunks before it, so
a scan is: one partial aggregate per chunk, a tiny window over the partials, one join
back on the chunk key and one window inside the chunk.  Row data is only ever
partitioned by chunk, and a hot session or key is spread over all its chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """One running value: ``kind`` is sum, max, min or last (last skips NULL)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def running_sum(name: str, value: Column, inclusive: bool = True) -> Run:
    return Run(name, "sum", value, inclusive)


def running_max(name: str, value: Column, inclusive: bool = True) -> Run:
    return Run(name, "max", value, inclusive)


def running_last(name: str, value: Column, inclusive: bool = True) -> Run:
    return Run(name, "last", value, inclusive)


def previous(name: str, *columns: str) -> Run:
    """The row before, as a struct (NULL on the first row of the key)."""
    return Run(name, "last", F.struct(*columns), False)


def _partial(run: Run, position: Column) -> Column:
    if run.kind == "last":
        return F.max_by(run.value, F.when(run.value.isNotNull(), position))
    return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](run.value)


def _over(run: Run, value: Column, window) -> Column:
    if run.kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[run.kind](value).over(window)


def _combine(run: Run, local: Column, carried: Column) -> Column:
    if run.kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if run.kind == "max":
        return F.greatest(local, carried)
    if run.kind == "min":
        return F.least(local, carried)
    return F.coalesce(local, carried)


def carry_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    runs: list[Run],
    chunk: str = "chunk",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Add the running values of ``runs`` per ``keys`` in ``(chunk, order)`` order.

    ``chunk`` must be non-decreasing along ``order`` inside every key and ``order``
    must be unique inside a chunk.  ``totals`` are rows with the same partials as ``df`` that are
    cheaper to read, as those that ``df`` was grouped from.
    """
    groups = [*keys, chunk]
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    partial = (df if totals is None else totals).groupBy(*groups).agg(
        *[_partial(r, position).alias(f"_p_{r.name}") for r in runs]
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = partial.select(
        *groups, *[_over(r, F.col(f"_p_{r.name}"), before).alias(f"_c_{r.name}") for r in runs]
    )
    inside = Window.partitionBy(*groups).orderBy(*order)
    up_to = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(carried, groups, "left")
    local = [
        _over(r, r.value, up_to if r.inclusive else until).alias(f"_l_{r.name}") for r in runs
    ]
    scanned = joined.select("*", *local)
    result = [
        _combine(r, F.col(f"_l_{r.name}"), F.col(f"_c_{r.name}")).alias(r.name) for r in runs
    ]
    return scanned.select(*df.columns, *result)


def key_scan(df: DataFrame, keys: list[str], order: list[str], runs: list[Run]) -> DataFrame:
    """As ``carry_scan`` where a key's rows are few, as those of one order: one shuffle, no partials."""
    whole = Window.partitionBy(*keys).orderBy(*order)
    up_to = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = whole.rowsBetween(Window.unboundedPreceding, -1)
    values = [(r, _over(r, r.value, up_to if r.inclusive else until)) for r in runs]
    return df.select(
        "*", *[(F.coalesce(v, F.lit(0)) if r.kind == "sum" else v).alias(r.name) for r, v in values]
    )


def asof_last(
    probe: DataFrame,
    build: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    chunk: str = "chunk",
) -> DataFrame:
    """Latest ``build`` row at or before each ``probe`` row, as columns ``values``.

    Both sides carry ``keys``, ``chunk`` and ``order``; on equal order the build row
    counts as earlier.  Unmatched probe rows get NULL.
    """
    packed = build.select(
        *keys, chunk, *order, F.lit(0).alias("_side"), F.struct(*values).alias("_hit")
    )
    tagged = probe.withColumn("_side", F.lit(1))
    both = tagged.unionByName(packed, allowMissingColumns=True)
    scanned = carry_scan(
        both, keys, [*order, "_side"], [running_last("_found", F.col("_hit"))], chunk
    )
    return scanned.filter("_side = 1").select(
        *probe.columns, *[F.col(f"_found.{v}").alias(v) for v in values]
    )


def asof_next(
    probe: DataFrame,
    build: DataFrame,
    keys: list[str],
    order: list[str],
    values: list[str],
    chunk: str = "chunk",
) -> DataFrame:
    """Earliest ``build`` row at or after each ``probe`` row, as columns ``values``: the scan run backwards."""

    def turned(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_back_{c}": -F.col(c) for c in [chunk, *order]})

    backwards = [f"_back_{c}" for c in order]
    hit = asof_last(turned(probe), turned(build), keys, backwards, values, f"_back_{chunk}")
    return hit.drop(*backwards, f"_back_{chunk}")


def lookback_buckets(df: DataFrame, time: str, reach_ms: int, bucket_ms: int) -> DataFrame:
    """Copy each row into its time bucket and, near the end of it, into the next one.

    Windows that look back at most ``reach_ms`` can then run per ``(key, bucket)``; the
    copies (``home`` false) only serve as history and are dropped afterwards.
    """
    if reach_ms > bucket_ms:
        raise ValueError("reach must not exceed the bucket")
    home = F.expr(f"{time} div {bucket_ms}")
    last = F.expr(f"({time} + {reach_ms}) div {bucket_ms}")
    return (
        df.withColumn("_home", home)
        .withColumn("bucket", F.explode(F.sequence(F.col("_home"), last)))
        .withColumn("home", F.col("bucket") == F.col("_home"))
        .drop("_home")
    )
