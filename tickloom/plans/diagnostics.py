"""Table of diagnostics with thresholds: values, session-bootstrap intervals and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.inference import ratio_bootstrap

# --- fixed values: thresholds of the flags ----------------------------------
R2_HIGH = 0.8                        # D2: the ratio is explained by composition alone
UNDERCUT_LOW = 0.10                  # D3: share of undercuts among improvements, one second
ONE_TICK_HIGH = 0.95                 # D4: share of time at one tick
ONE_TICK_MOVES = 0.95                # D5: both shares of one-tick moves
MEAN_LOW, NEGATIVE_HIGH = 0.10, 0.10  # D6: mean of the ratio near zero, or often negative
AGREEMENT_LOW = 0.90                 # D7: agreement of the two attributions
DAILY_SESSIONS = 20                  # rows of daily values need so many sessions
# --- end of fixed values -----------------------------------------------------

KEYS = ["id", "diagnostic", "level"]
CLASSES, WINDOWS = ("undercut", "refill", "shift"), (100, 1000, 5000)
RULES = ("r_10ms", "r_nr_10ms", "r_1ms")
RATIOS = ("qcr_r", "qcr_a", "qcr_u")


def _rows(entries: list[tuple[str, str, Column, Column]]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("id"), F.lit(d).alias("diagnostic"),
                    num.cast("double").alias("num"), den.cast("double").alias("den"),
                )
                for i, d, num, den in entries
            ]
        )
    )


def panel_parts(panel: DataFrame, level: str) -> DataFrame:
    """Sums by session of the diagnostics that are means over a panel's periods."""
    mean = lambda i, name, v: (i, name, F.sum(v), F.count(v))
    entries = [
        mean("D2", "improvements over deteriorations", F.try_divide(F.col("n_impr"), F.col("n_det_all"))),
        mean("D4", "frac_1tick", F.col("frac_1tick")),
        mean("D4", "spread_tw_ticks", F.col("spread_tw_ticks")),
        *[mean("D6", r, F.col(r)) for r in RATIOS],
        *[mean("D6", f"{r} negative", F.when(F.col(r).isNotNull(), (F.col(r) < 0).cast("double"))) for r in RATIOS],
    ]
    if level == "day":
        entries += [mean("D5", c, F.col(c)) for c in ("share_1tick_impr", "share_1tick_det_trade")]
    flat = panel.groupBy("day").agg(
        *[num.alias(f"n{k}") for k, (_, _, num, _) in enumerate(entries)],
        *[den.alias(f"d{k}") for k, (_, _, _, den) in enumerate(entries)],
    )
    named = [(i, d, F.col(f"n{k}"), F.col(f"d{k}")) for k, (i, d, _, _) in enumerate(entries)]
    return flat.select("day", F.lit(level).alias("level"), _rows(named)).filter("den > 0")


def move_parts(moves: DataFrame) -> DataFrame:
    """Sums by session of the shares over single moves."""
    improves, worsens = F.col("kind") == "improve", F.col("kind") == "worsen"
    execution = F.col("cause") == "execution"
    entries = [
        ("D3", f"{c} within {w} ms", F.count_if(improves & (F.col(f"class_w{w}") == c)), F.count_if(improves))
        for w in WINDOWS
        for c in CLASSES
    ]
    entries += [
        ("D7", f"{r} and execution agree", F.count_if(worsens & (F.col(r) == execution)), F.count_if(worsens)) for r in RULES
    ]
    flat = moves.groupBy("day").agg(
        *[num.alias(f"n{k}") for k, (_, _, num, _) in enumerate(entries)],
        *[den.alias(f"d{k}") for k, (_, _, _, den) in enumerate(entries)],
    )
    named = [(i, d, F.col(f"n{k}"), F.col(f"d{k}")) for k, (i, d, _, _) in enumerate(entries)]
    return flat.select("day", F.lit("sample").alias("level"), _rows(named)).filter("den > 0")


def explained(panel: DataFrame, level: str) -> DataFrame:
    """D2: share of the ratio's variance that composition explains (no interval)."""
    pairs = panel.select(
        F.col("qcr_composition").alias("x"),
        F.inline(F.array(*[F.struct(F.lit(f"R2 of {r} on composition").alias("diagnostic"), F.col(r).alias("y")) for r in RATIOS[:2]])),
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    r = F.corr("x", "y")
    return pairs.groupBy("diagnostic").agg(F.count("*").alias("n"), (r * r).alias("value")).select(
        F.lit("D2").alias("id"), "diagnostic", F.lit(level).alias("level"), "value", F.col("n").cast("double").alias("n")
    )


def identity(identities: DataFrame, level: str) -> DataFrame:
    """D1: periods whose spread identity leaves a residual."""
    return identities.agg(
        F.count_if(F.col("residual") != 0).cast("double").alias("value"), F.count("*").cast("double").alias("n")
    ).select(F.lit("D1").alias("id"), F.lit("periods with a residual").alias("diagnostic"), F.lit(level).alias("level"), "value", "n")


def flagged(table: DataFrame) -> DataFrame:
    """``flag``: yes, no, none (descriptive), not identified, or weakly identified.

    The ratio of undercuts is weakly identified: most periods have none of them.  Flags that need two
    rows (D5, D6) read the other one of the same level.
    """
    v, name = F.col("value"), F.col("diagnostic")
    pair = table.groupBy("level").agg(
        F.min(F.when(F.col("id") == "D5", v)).alias("_least_one_tick"),
        F.max(F.when((F.col("id") == "D6") & (name == "qcr_r negative"), v)).alias("_negative"),
    )
    yes = (
        F.when(F.col("id") == "D1", v > 0)
        .when(name.startswith("R2"), v > R2_HIGH)
        .when(name == f"undercut within {WINDOWS[1]} ms", v < UNDERCUT_LOW)
        .when(name == "frac_1tick", v > ONE_TICK_HIGH)
        .when(F.col("id") == "D5", F.col("_least_one_tick") >= ONE_TICK_MOVES)
        .when((F.col("id") == "D6") & (name == "qcr_r"), (F.abs(v) < MEAN_LOW) | (F.col("_negative") > NEGATIVE_HIGH))
        .when(F.col("id") == "D7", v < AGREEMENT_LOW)
    )
    label = (
        F.when(v.isNull() | F.isnan(v), "not identified")
        .when(name.startswith("qcr_u"), "weakly identified")
        .when(yes, "yes")
        .when(~yes, "no")
        .otherwise("none")
    )
    return table.join(pair, "level").withColumn("flag", label).drop("_least_one_tick", "_negative")


def diagnostics(
    panels: dict[str, DataFrame], identities: dict[str, DataFrame], moves: DataFrame, reps: int, seed: int
) -> DataFrame:
    """id, diagnostic, level, value, ci_low, ci_high, n, flag for one sample of sessions.

    Daily rows are left out where the sample has fewer than ``DAILY_SESSIONS`` sessions.
    """
    parts = move_parts(moves)
    for level, panel in panels.items():
        parts = parts.unionByName(panel_parts(panel, level))
    ratios = ratio_bootstrap(parts, KEYS, "day", F.col("num"), F.col("den"), reps, seed)
    table = ratios.select(*KEYS, "value", "ci_low", "ci_high", "n")
    for level, panel in panels.items():
        table = table.unionByName(explained(panel, level), allowMissingColumns=True)
        table = table.unionByName(identity(identities[level], level), allowMissingColumns=True)
    sessions = panels["day"].agg(F.count_distinct("day").alias("_sessions"))
    enough = (F.col("level") != "day") | (F.col("_sessions") >= DAILY_SESSIONS)
    return flagged(table.crossJoin(F.broadcast(sessions)).filter(enough).drop("_sessions"))  # one row
