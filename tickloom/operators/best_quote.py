"""Best bid and ask from level occupancy, chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import BID, CHUNK, KEY
from tickloom.operators.kernels import BEST_SCHEMA, best_ticks, sorted_map


def chunk_snapshots(depth: DataFrame, log: DataFrame) -> DataFrame:
    """Levels standing at the start of every chunk, as occupancy rows before it (rpt -1).

    ``log`` holds every row of the session: its last chunks may carry no level effect but
    still need the book.  A level keeps its state from the chunk that last touched it up to the next chunk
    that touches it, so the snapshot is an explode over that chunk range.
    """
    touched = depth.groupBy(*KEY, "e_side", "e_tick", "chunk").agg(
        F.max_by(F.struct("level_n", "level_q"), F.struct("rpt", "sub")).alias("end")
    )
    last_chunk = log.groupBy(*KEY).agg(F.max("chunk").alias("last_chunk"))
    ordered = Window.partitionBy(*KEY, "e_side", "e_tick").orderBy("chunk")
    return (
        touched.withColumn("next", F.lead("chunk").over(ordered))
        .filter("end.level_n > 0")
        .join(last_chunk, KEY)
        .withColumn("until", F.coalesce("next", "last_chunk"))
        .filter("until > chunk")
        .select(
            *KEY,
            F.explode(F.sequence(F.col("chunk") + 1, F.col("until"))).alias("chunk"),
            F.lit(-1).cast("bigint").alias("rpt"),
            F.lit(0).alias("sub"),
            "e_side",
            "e_tick",
            F.col("end.level_n").alias("level_n"),
            F.col("end.level_q").alias("level_q"),
        )
    )


def best_changes(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows ``(day, sid, chunk, rpt, sub, side, best)`` where the best tick changes.

    Every chunk is self-contained: its snapshot rows (rpt -1) open it.
    """
    opening = snapshots.select(
        *CHUNK, "rpt", "sub", "e_side", "e_tick", F.lit(1).alias("step")
    )
    rows = changes.select(*CHUNK, "rpt", "sub", "e_side", "e_tick", "step")
    return sorted_map(rows.unionByName(opening), CHUNK, ["rpt", "sub"], best_ticks, BEST_SCHEMA)


def quote_at(
    probe: DataFrame, best: DataFrame, depth: DataFrame, snapshots: DataFrame, state: list[str] | None = None
) -> DataFrame:
    """Best ticks and their sizes just after position ``rpt`` of each ``probe`` row.

    ``probe`` has ``day, sid, chunk, rpt`` (unique); adds ``b, a``, their sizes ``qb, qa`` and order
    counts ``nb, na`` (NULL on an empty side), and the ``state`` columns of the probe's own ``depth`` rows (the
    least, should they differ).  Probes, best ticks and level sizes are shuffled once, by chunk; two passes inside
    a chunk follow: latest best tick, then latest size of it.
    """
    inside = (
        Window.partitionBy(*CHUNK)
        .orderBy("rpt", "_kind", "sub")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    payload = [c for c in probe.columns if c not in (*CHUNK, "rpt")]
    tagged = probe.select(
        *CHUNK, "rpt", F.lit(0).alias("sub"), F.lit(1).alias("_kind"), F.struct(F.lit(True).alias("_is"), *payload).alias("_probe")
    )
    steps = best.select(
        *CHUNK,
        "rpt",
        "sub",
        F.lit(0).alias("_kind"),
        F.when(F.col("side") == BID, F.struct("best")).alias("_b"),
        F.when(F.col("side") != BID, F.struct("best")).alias("_a"),
    )
    held = F.struct(F.col("level_q").alias("q"), F.col("level_n").alias("n")).alias("_held")
    place = [*CHUNK, "rpt", "sub", F.lit(0).alias("_kind"), "e_side", "e_tick", held]
    own = [F.struct(*state).alias("_own")] if state else []
    sizes = (depth if state else depth.filter("e_side IS NOT NULL")).select(*place, *own).unionByName(
        snapshots.select(*place), allowMissingColumns=True
    )
    found = (
        tagged.unionByName(steps, allowMissingColumns=True)
        .unionByName(sizes, allowMissingColumns=True)
        .withColumn("_bb", F.last("_b", True).over(inside))
        .withColumn("_ba", F.last("_a", True).over(inside))
        .filter("_b IS NULL AND _a IS NULL")
    )
    # a probe becomes one row per side, the bid row carrying it, so that a single pass over the
    # level sizes serves both sides and no join back is needed
    probing = F.col("_kind") == 1
    quoted = F.struct("_probe", F.col("_bb.best").alias("b"), F.col("_ba.best").alias("a"))
    nothing = F.lit(None).cast(found.select(quoted.alias("q")).schema["q"].dataType)

    def side(code, tick, carried):
        return F.struct(code.cast("int").alias("e_side"), tick.alias("e_tick"), carried.alias("_quoted"))

    rows = found.select(
        *CHUNK,
        "rpt",
        "sub",
        "_kind",
        "_held",
        *(["_own"] if state else []),
        F.inline(
            F.when(
                probing, F.array(side(F.lit(0), F.col("_bb.best"), quoted), side(F.lit(1), F.col("_ba.best"), nothing))
            ).otherwise(F.array(side(F.col("e_side"), F.col("e_tick"), nothing)))
        ),
    )
    level = (
        Window.partitionBy(*CHUNK, "e_side", "e_tick")
        .orderBy("rpt", "_kind", "sub")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_at", F.when(probing, F.last("_held", True).over(level)))
        .filter(probing | F.col("_own").isNotNull() if state else probing)
        .groupBy(*CHUNK, "rpt")
        .agg(
            F.first("_quoted", ignorenulls=True).alias("_quoted"),
            *[
                F.max(F.when(F.col("e_side") == code, F.col(f"_at.{value}"))).alias(name)
                for code, value, name in ((0, "q", "qb"), (1, "q", "qa"), (0, "n", "nb"), (1, "n", "na"))
            ],
            *[F.min(f"_own.{c}").alias(c) for c in state or []],
        )
        .filter("_quoted IS NOT NULL")
        .select(
            *[F.col(c if c in (*CHUNK, "rpt") else f"_quoted._probe.{c}").alias(c) for c in probe.columns],
            *[F.col(f"_quoted.{c}").alias(c) for c in ("b", "a")],
            "qb",
            "qa",
            "nb",
            "na",
            *(state or []),
        )
    )
