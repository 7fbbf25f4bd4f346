"""The best few levels of each side at every message, and prices made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BID, CHUNK
from tickloom.operators.kernels import LEVELS_SCHEMA, best_levels, sorted_map

# --- fixed values ---------------------------------------------------------
BEST = 3                             # levels of a side
REACH = 400                          # ticks from the best within which levels count
# --- end of fixed values --------------------------------------------------


def level_changes(depth: DataFrame, snapshots: DataFrame, count: int = BEST) -> DataFrame:
    """Rows where the best levels of a side change, with their ``ticks`` and ``sizes``.

    Each chunk opens with the levels that stand at its start, so chunks are independent.
    """
    columns = [*CHUNK, "rpt", "sub", "e_side", "e_tick", "level_n", "level_q"]
    rows = depth.filter("e_side IS NOT NULL").select(columns).unionByName(snapshots.select(columns))
    return sorted_map(rows, CHUNK, ["rpt", "sub"], best_levels(count, REACH), LEVELS_SCHEMA)


def levels_at(probe: DataFrame, changes: DataFrame) -> DataFrame:
    """``probe`` (``day, sid, chunk, rpt``, unique) with ``bids`` and ``asks`` just after its position; an empty side has no levels."""
    inside = (
        Window.partitionBy(*CHUNK)
        .orderBy("rpt", "_kind", "sub")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    levels = F.struct("ticks", "sizes")
    none = F.struct(*[F.array().cast("array<bigint>").alias(c) for c in ("ticks", "sizes")])
    steps = changes.select(
        *CHUNK,
        "rpt",
        "sub",
        F.lit(0).alias("_kind"),
        F.when(F.col("side") == BID, levels).alias("_b"),
        F.when(F.col("side") != BID, levels).alias("_a"),
    )
    return (
        probe.withColumns({"_kind": F.lit(1), "sub": F.lit(0)})
        .unionByName(steps, allowMissingColumns=True)
        .withColumn("bids", F.coalesce(F.last("_b", True).over(inside), none))
        .withColumn("asks", F.coalesce(F.last("_a", True).over(inside), none))
        .filter("_kind = 1")
        .select(*probe.columns, "bids", "asks")
    )


def _total(side: str) -> Column:
    return F.aggregate(f"{side}.sizes", F.lit(0).cast("bigint"), lambda s, q: s + q)


def _weighted(side: str) -> Column:
    products = F.zip_with(f"{side}.ticks", f"{side}.sizes", lambda t, q: t * q)
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda s, x: s + x)


def level_mid() -> Column:
    """Mid of the sides' size-weighted prices, each weighted by the other side's size.

    NULL unless the best quotes ``b`` and ``a`` are apart and have sizes ``qb`` and ``qa``.
    """
    qb, qa = _total("bids"), _total("asks")
    usable = (F.col("b") < F.col("a")) & (F.col("qb") > 0) & (F.col("qa") > 0) & (qb > 0) & (qa > 0)
    bid, ask = _weighted("bids") / qb, _weighted("asks") / qa
    return F.when(usable, (qb * ask + qa * bid) / (qb + qa))


def micro_price() -> Column:
    usable = (F.col("b") < F.col("a")) & (F.col("qb") > 0) & (F.col("qa") > 0)
    return F.when(usable, (F.col("qb") * F.col("a") + F.col("qa") * F.col("b")) / (F.col("qb") + F.col("qa")))


def plain_mid() -> Column:
    return F.when(F.col("b") < F.col("a"), (F.col("b") + F.col("a")) / 2.0)
