"""Message tape: the book before and after every single message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import (
    ASK,
    BID,
    CHUNK,
    KEY,
    MAX_STATE_GAP_MS,
    QUEUE_BACK,
    QUEUE_FRONT,
    RESIDUE_MESSAGES,
    RUN_GAP_MS,
)
from tickloom.operators import best_quote, lifecycle
from tickloom.operators.dominance import dominance_sums
from tickloom.operators.ordered import (
    Run,
    carry_scan,
    key_scan,
    previous,
    running_last,
    running_sum,
)


# ---------------------------------------------------------------- replay by message
def replay_changes(messages: DataFrame) -> DataFrame:
    """Level effects when unknown orders are applied instead of skipped.

    A change of an unknown order inserts it; a delete of an unknown order takes one order
    and the message's size from the message's level (see ``replay_depth``).
    """
    state = lifecycle.with_order_state(messages, orphan_policy="insert")
    unknown = ~F.col("live")
    as_insert = state.withColumn("orphan", lifecycle.anomaly()).withColumn(
        "typ", F.when((F.col("typ") == "C") & unknown, "N").otherwise(F.col("typ"))
    )
    stray = (F.col("typ") == "D") & unknown
    as_delete = (
        as_insert.withColumn("stray", stray)
        .withColumn("p_side", F.when(F.col("stray"), F.col("side")).otherwise(F.col("p_side")))
        .withColumn("p_tick", F.when(F.col("stray"), F.col("tick")).otherwise(F.col("p_tick")))
        .withColumn("p_qty", F.when(F.col("stray"), F.col("qty")).otherwise(F.col("p_qty")))
        .withColumn("live", F.col("live") | F.col("stray"))
    )
    effects = lifecycle.level_effects(as_delete)
    return effects.withColumn("live", F.col("live") & ~F.col("stray")).drop("stray")


def replay_counts(effects: DataFrame) -> DataFrame:
    """Order count of each level when removals from an empty level do nothing.

    The count reflects at zero: count = sum - min(0, lowest sum so far).  The lowest sum
    over chunks follows from each chunk's total and its lowest inner sum, so one pass over
    the rows is enough.
    """
    level = [*KEY, "e_side", "e_tick"]
    groups = [*level, "chunk"]
    rows = effects.filter("e_side IS NOT NULL")
    inside = Window.partitionBy(*groups).orderBy("rpt", "sub").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = rows.withColumn("_s", F.sum("dn").over(inside))
    partial = local.groupBy(*groups).agg(F.sum("dn").alias("_total"), F.min("_s").alias("_low"))
    before = Window.partitionBy(*level).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    opened = partial.withColumn("_open", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    carried = opened.withColumn(
        "_floor", F.min(F.col("_open") + F.col("_low")).over(before)
    ).select(*groups, "_open", "_floor")
    zero = F.lit(0).cast("bigint")
    scanned = (
        local.join(carried, groups, "left")
        .withColumn("_s", F.col("_s") + F.col("_open"))
        .withColumn("_low", F.least(zero, "_floor", F.min("_s").over(inside)))
        .withColumn("level_n", F.col("_s") - F.col("_low"))
    )
    earlier = F.least(
        zero,
        F.col("_floor"),
        F.min("_s").over(inside.rowsBetween(Window.unboundedPreceding, -1)),
    )
    held = F.col("_s") - F.col("dn") - earlier
    nothing = (F.col("dn") < 0) & (held <= 0)
    return scanned.withColumn("_nothing", nothing).select(
        *[c for c in effects.columns if c not in ("dn", "dq")],
        "level_n",
        F.when(F.col("_nothing"), zero).otherwise(F.col("dn")).alias("dn"),
        F.when(F.col("_nothing"), zero).otherwise(F.col("dq")).alias("dq"),
    )


def replay_depth(counts: DataFrame) -> DataFrame:
    """Running size of each level on top of ``replay_counts``."""
    return carry_scan(
        counts, [*KEY, "e_side", "e_tick"], ["rpt", "sub"], [running_sum("level_q", F.col("dq"))]
    )


def message_quotes(
    messages: DataFrame, depth: DataFrame, best: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Every message with the quote after it and the state of its order (``live, p_tick,
    p_qty, born_ms``).  ``depth`` are the level effects with running count and size."""
    probe = messages.select(
        *CHUNK, "rpt", "seq", "t_ms", "typ", "side", "tick", "qty", "oid", "firm", "retail"
    )
    state = ["live", "p_tick", "p_qty", "born_ms"]
    quoted = best_quote.quote_at(probe, best, depth, snapshots, [*state, "level_n"])
    return quoted.withColumnRenamed("level_n", "left_n")


def with_before(after: DataFrame) -> DataFrame:
    """Add the quote before each message and the latest print before it."""
    scanned = carry_scan(
        after,
        KEY,
        ["rpt"],
        [
            previous("_before", "b", "a", "qb", "qa", "nb", "na", "t_ms", "seq"),
            running_sum("order_msgs", F.when(F.col("typ") != "T", 1).otherwise(0).cast("bigint")),
        ],
    ).select(
        *after.columns,
        "order_msgs",
        *[F.col(f"_before.{c}").alias(f"{c}0") for c in ("b", "a", "qb", "qa", "nb", "na")],
        F.col("_before.t_ms").alias("t0"),
        F.col("_before.seq").alias("seq0"),
    )
    two_sided = F.col("b0").isNotNull() & F.col("a0").isNotNull()
    aggressor = F.when(two_sided & (F.col("tick") >= F.col("a0")), BID).when(
        two_sided & (F.col("tick") <= F.col("b0")), ASK
    ).otherwise(-1)
    marked = scanned.withColumn(
        "print_side", F.when(F.col("typ") == "T", aggressor).cast("int")
    )
    return carry_scan(
        marked,
        KEY,
        ["rpt"],
        [
            running_last(
                "last_print",
                F.when(F.col("typ") == "T", F.struct("rpt", "order_msgs", "print_side", "t_ms")),
                inclusive=False,
            )
        ],
    )


# ---------------------------------------------------------------- message classes
def new_order_class() -> Column:
    """Class of a new order against the book before it."""
    t, b, a = F.col("tick"), F.col("b0"), F.col("a0")
    bid = F.col("side") == BID
    crosses = F.when(bid, t >= a).otherwise(t <= b)
    inside = F.when(bid, t > b).otherwise(t < a)
    joins = F.when(bid, t == b).otherwise(t == a)
    recent = (
        F.col("order_msgs") - 1 - F.col("last_print.order_msgs") < RESIDUE_MESSAGES
    ) & (F.col("last_print.print_side") == F.col("side"))
    return (
        F.when(F.col("typ") != "N", None)
        .when(b.isNull() | a.isNull(), "no_reference")
        .when(crosses, "aggressive")
        .when(inside & F.coalesce(recent, F.lit(False)), "undercut_ambiguous")
        .when(inside, "undercut")
        .when(joins, "join_best")
        .otherwise("behind_best")
    )


def depth_at_landing() -> Column:
    """Ticks between a resting new order and the best of its side (0 at the touch)."""
    gap = F.when(F.col("side") == BID, F.col("b0") - F.col("tick")).otherwise(
        F.col("tick") - F.col("a0")
    )
    return F.when(F.col("new_class").isin("join_best", "behind_best"), gap)


def landing_bucket(depth: Column) -> Column:
    """0..5, 6-10, 11-20, 21-50, 51-100, 100+ (fixed values)."""
    out = F.when(depth <= 5, depth.cast("string"))
    for low, high in ((6, 10), (11, 20), (21, 50), (51, 100)):
        out = out.when(depth <= high, f"{low}-{high}")
    return F.when(depth.isNull(), None).otherwise(out.otherwise("100+"))


def spread_before() -> Column:
    return F.col("a0") - F.col("b0")


def spread_after() -> Column:
    return F.col("a") - F.col("b")


def change_class() -> Column:
    """What a change of a known order did: size_only, narrow, widen or neutral."""
    s0, s1 = spread_before(), spread_after()
    return (
        F.when((F.col("typ") != "C") | ~F.col("live"), None)
        .when(F.col("p_tick") == F.col("tick"), "size_only")
        .when(~((s0 > 0) & (s1 > 0)) | s0.isNull() | s1.isNull(), None)
        .when(s1 < s0, "narrow")
        .when(s1 > s0, "widen")
        .otherwise("neutral")
    )


def withdrawal_class() -> Column:
    """touch / deep removal of a known order (filled orders are removals too)."""
    at_touch = F.when(F.col("side") == BID, F.col("p_tick") == F.col("b0")).otherwise(
        F.col("p_tick") == F.col("a0")
    )
    return (
        F.when((F.col("typ") != "D") | ~F.col("live"), None)
        .when(F.coalesce(at_touch, F.lit(False)), "touch")
        .otherwise("deep")
    )


def classified(tape: DataFrame) -> DataFrame:
    with_class = tape.withColumn("new_class", new_order_class())
    s0, s1 = spread_before(), spread_after()
    moved = (
        F.when((F.col("typ") != "N") | s0.isNull() | s1.isNull() | (s0 <= 0) | (s1 <= 0), None)
        .when(s1 < s0, "narrowed")
        .when(s1 == s0, "unchanged")
        .otherwise("widened")
    )
    widening = (F.col("typ") == "D") & s0.isNotNull() & (s0 >= 0) & (
        F.coalesce(s1, F.lit(-1)) > s0
    )
    return with_class.select(
        "*",
        depth_at_landing().alias("landing"),
        change_class().alias("change_class"),
        withdrawal_class().alias("withdrawal"),
        moved.alias("spread_effect"),
        F.coalesce(widening, F.lit(False)).alias("delete_widens"),
        F.when(F.col("typ") == "D", F.col("t_ms") - F.col("born_ms")).alias("life_ms"),
    )


# ---------------------------------------------------------------- sweeps and runs
def sweeps(tape: DataFrame) -> DataFrame:
    """Consecutive prints of one millisecond and one aggressor side: one incoming order."""
    prints = tape.filter("typ = 'T'").select(
        *CHUNK, "rpt", "t_ms", "print_side", "qty", "tick"
    )
    lagged = carry_scan(prints, KEY, ["rpt"], [previous("_p", "t_ms", "print_side")])
    opens = F.col("_p").isNull() | (F.col("_p.t_ms") != F.col("t_ms")) | (
        F.col("_p.print_side") != F.col("print_side")
    )
    numbered = carry_scan(
        lagged.withColumn("opens", opens),
        KEY,
        ["rpt"],
        [running_last("sweep", F.when(F.col("opens"), F.col("rpt")))],
    )
    return numbered.groupBy(*KEY, "sweep").agg(
        F.first("t_ms").alias("t_ms"),
        F.first("print_side").alias("print_side"),
        F.count("*").alias("prints"),
        F.sum("qty").alias("volume"),
        (F.max("tick") - F.min("tick")).alias("ticks_crossed"),
    )


def _booked_runs(rows: DataFrame, breaks: Column) -> DataFrame:
    """Runs between break rows; a run is booked at the row that breaks it.

    ``rows`` carry ``member`` (counts towards a run) and the row before (``_p``).  With
    running counts the previous run's length is the difference between two break rows.
    """
    counted = rows.filter(breaks)
    shifted = carry_scan(
        counted, KEY, ["rpt"], [previous("_q", "rpt", "side", "member", "n", "v")]
    )
    return shifted.filter("_q.member").select(
        *KEY,
        F.col("_q.rpt").alias("run"),
        F.col("_q.side").alias("side"),
        (F.col("n") - F.col("_q.n")).alias("length"),
        (F.col("v") - F.col("_q.v")).alias("volume"),
        F.col("t_ms").alias("booked_ms"),
    )


def _with_counts(rows: DataFrame, *before: str) -> DataFrame:
    """Members and their volume before each row, and the row before it."""
    return carry_scan(
        rows,
        KEY,
        ["rpt"],
        [
            previous("_p", *before),
            running_sum("n", F.when(F.col("member"), 1).otherwise(0).cast("bigint"), inclusive=False),
            running_sum("v", F.when(F.col("member"), F.col("qty")).otherwise(0).cast("bigint"), inclusive=False),
        ],
    )


def undercut_runs(tape: DataFrame) -> DataFrame:
    """Same-side undercuts until an opposite one; the last run of a day is never booked."""
    rows = tape.filter(F.col("new_class").isin("undercut", "undercut_ambiguous")).select(
        *CHUNK, "rpt", "t_ms", "side", "qty", F.lit(True).alias("member")
    )
    breaks = F.col("_p").isNull() | (F.col("_p.side") != F.col("side"))
    return _booked_runs(_with_counts(rows, "side"), breaks)


def cancel_runs(queue: DataFrame, tape: DataFrame) -> DataFrame:
    """Front-of-queue removals of one side, gaps up to one second, broken by any print."""
    fronts = queue.filter(F.col("queue_zone") == "front").select(
        *CHUNK, "rpt", "t_ms", "side", "qty", F.lit(True).alias("member")
    )
    prints = tape.filter("typ = 'T'").select(
        *CHUNK, "rpt", "t_ms", "side", "qty", F.lit(False).alias("member")
    )
    breaks = (
        ~F.col("member")
        | F.col("_p").isNull()
        | ~F.col("_p.member")
        | (F.col("_p.side") != F.col("side"))
        | (F.col("t_ms") - F.col("_p.t_ms") > RUN_GAP_MS)
    )
    return _booked_runs(
        _with_counts(fronts.unionByName(prints), "member", "side", "t_ms"), breaks
    )


# ---------------------------------------------------------------- queue position
#: Orders number their arrival within a chunk by so many bits, and chunks within a session.
_PLACE_BITS = 40


def queue_changes(depth: DataFrame, tape: DataFrame) -> DataFrame:
    """Changes of standing orders with the arrival of their order and their level's volume before them.

    ``wanted`` marks removals at the touch, whose queue position is asked for.
    """
    level = [*KEY, "e_side", "e_tick"]
    effects = depth.filter("e_side IS NOT NULL").select(
        *CHUNK, "rpt", "sub", "oid", "e_side", "e_tick", "dn", "dq"
    )
    per_order = key_scan(
        effects,
        [*level, "oid"],
        ["chunk", "rpt", "sub"],
        [
            running_sum("o_n", F.col("dn"), inclusive=False),
            running_last("_entry", F.when(F.col("dn") > 0, F.struct("rpt", "chunk"))),
        ],
    ).filter("dn > 0 OR o_n > 0")
    totals = carry_scan(per_order, level, ["rpt", "sub"], [running_sum("level_total", F.col("dq"), inclusive=False)])
    touched = tape.filter("withdrawal = 'touch'").select(*CHUNK, "rpt", F.lit(True).alias("wanted"))
    return totals.join(touched, [*CHUNK, "rpt"], "left").select(
        *CHUNK, "rpt", "sub", "e_side", "e_tick", "dq", "level_total",
        F.col("_entry.rpt").alias("entry"), F.col("_entry.chunk").alias("entry_chunk"),
        (F.coalesce("wanted", F.lit(False)) & (F.col("dn") <= 0)).alias("wanted"),
    )


def queue_positions(rows: DataFrame, tape: DataFrame) -> DataFrame:
    """Share of the level's volume ahead of each order removed at the touch, from ``queue_changes``.

    The volume ahead is the sum of all changes so far of orders that came to the level earlier: a dominance sum over
    (arrival, message).  It is cut at the chunks: changes within the removal's chunk; earlier changes of orders that arrived
    in the same chunk as the removed one; and earlier changes of orders of earlier chunks, which need only sums by
    chunk of arrival and of change.  No order is copied into later chunks.
    """
    level = [*KEY, "e_side", "e_tick"]
    wanted = rows.filter("wanted")
    ids = [*CHUNK, "rpt", "sub"]
    within = dominance_sums(
        rows, wanted, [*level, "chunk"], "entry", ["rpt", "sub"], F.col("dq"), ids, _PLACE_BITS
    )
    # changes in earlier chunks, by order and chunk, then by chunk of arrival and chunk
    crossing = wanted.filter("entry_chunk < chunk")
    cells = rows.groupBy(*level, "entry_chunk", "entry", "chunk").agg(F.sum("dq").alias("dq"))
    beside = dominance_sums(
        cells, crossing, [*level, "entry_chunk"], "entry", ["chunk"], F.col("dq"), ids, _PLACE_BITS
    )
    coarse = cells.groupBy(*level, "entry_chunk", "chunk").agg(F.sum("dq").alias("dq"))
    earlier = dominance_sums(coarse, wanted, level, "entry_chunk", ["chunk"], F.col("dq"), ids, _PLACE_BITS)
    ahead = within.unionByName(beside).unionByName(earlier).groupBy(*CHUNK, "rpt", "sub").agg(F.sum("below").alias("ahead"))
    found = ahead.join(wanted.select(*CHUNK, "rpt", "sub", "level_total"), [*CHUNK, "rpt", "sub"])
    removed = tape.filter("withdrawal = 'touch'").select(
        *CHUNK, "rpt", "t_ms", "side", F.col("p_tick").alias("tick"), F.col("p_qty").alias("qty"), "oid"
    )
    share = F.try_divide(F.col("ahead").cast("double"), F.col("level_total").cast("double"))
    return removed.join(found, [*CHUNK, "rpt"]).select(
        *removed.columns,
        "ahead",
        "level_total",
        F.rint(share * 10000).cast("bigint").alias("position_bp"),
        F.when(share <= QUEUE_FRONT, "front")
        .when(share > QUEUE_BACK, "back")
        .otherwise("middle")
        .alias("queue_zone"),
    )


# ---------------------------------------------------------------- controls
def naive_best(tape: DataFrame) -> DataFrame:
    """Top of book by forward-filled last prices (over-counts undercuts)."""
    shown = F.col("typ").isin("N", "C")
    filled = carry_scan(
        tape.filter("typ <> 'T'").select(*CHUNK, "rpt", "t_ms", "typ", "side", "tick"),
        KEY,
        ["rpt"],
        [
            running_last(
                "naive_bid", F.when(shown & (F.col("side") == BID), F.col("tick")), inclusive=False
            ),
            running_last(
                "naive_ask", F.when(shown & (F.col("side") == ASK), F.col("tick")), inclusive=False
            ),
        ],
    )
    inside = (F.col("naive_bid") < F.col("tick")) & (F.col("tick") < F.col("naive_ask"))
    return filled.withColumn(
        "naive_undercut", F.coalesce((F.col("typ") == "N") & inside, F.lit(False))
    )


def spread_durations(tape: DataFrame) -> DataFrame:
    """Time the spread before each message stood; gaps over two seconds are dropped.

    The interval belongs to the bucket where it began (``from_ms``).
    """
    dt = F.col("t_ms") - F.col("t0")
    standing = spread_before()
    return (
        tape.filter(F.col("t0").isNotNull() & (standing > 0))
        .select(*KEY, F.col("t0").alias("from_ms"), dt.alias("dur"), standing.alias("spread"))
        .filter("dur > 0")
        .withColumn("dropped", F.col("dur") > MAX_STATE_GAP_MS)
    )
