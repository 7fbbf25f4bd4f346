"""Queries of trades, adverse selection and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.functions.constants import BLOCK_MS, KEY
from tickloom.plans import inference as inf
from tickloom.plans import panels, trades
from tickloom.plans import residual as rs
from tickloom.queries import panel_of, register, rounded
from tickloom.queries_residual import BASE, blocks

QUARTER_HOUR = 900_000
HALF_HOUR = 1_800_000
REPS = 999                           # plain session draws
WILD_REPS = 9_999                    # wild replicates
SHARE_REPS = 999                     # replicates of Shapley shares
SEED = 20261002

# ------------------------------------------------------------------ trades
oracle.block("te", "st", """
SELECT s.day, s.seq, s.k, s.t_ms, s.aggressor AS d, NOT s.has_trade_nr AS retail_only, s.volume AS vol, s.volume_nr AS vol_nr,
       s.vwap_tick AS p_tick, p.b AS b_prev, p.a AS a_prev, s.b AS b_after, s.a AS a_after, s.valid AS valid_after, s.seg
FROM st s JOIN st p ON p.day = s.day AND p.seq = (SELECT max(x.seq) FROM st x WHERE x.day = s.day AND x.seg = s.seg AND x.counted AND x.seq < s.seq)
WHERE s.phase = 'C' AND s.has_trade""")
oracle.block("ts", "te", """
SELECT *, (a_prev + b_prev) / 2.0 AS mid_prev, d * (p_tick - (a_prev + b_prev) / 2.0) + 0.0 AS es FROM te WHERE a_prev > b_prev AND d <> 0""")
oracle.block("at_h", "ts st", """
SELECT t.day, t.seq, h.h, t.t_ms + h.h * 1000 AS at,
       arg_max((s.a + s.b) / 2.0, s.seq) AS mid_at, arg_max(s.seg, s.seq) AS seg_at
FROM ts t, (SELECT unnest([0, 5, 30, 60]) AS h) h JOIN st s ON s.day = t.day AND s.counted AND s.t_ms <= t.t_ms + h.h * 1000
GROUP BY ALL""")
oracle.block("pi", "ts at_h cal", """
SELECT t.*, x.h, CASE WHEN x.at < c.valid_to AND NOT coalesce(x.at > c.x0 AND t.t_ms < c.x1, false) AND x.seg_at = z.seg_at
                      THEN t.d * (x.mid_at - t.mid_prev) + 0.0 END AS pi
FROM ts t JOIN at_h x ON x.day = t.day AND x.seq = t.seq AND x.h > 0
JOIN at_h z ON z.day = t.day AND z.seq = t.seq AND z.h = 0 JOIN cal c ON c.day = t.day""")
oracle.block("pib", "pi per_block", """
SELECT p.*, b.ps AS block, b.ps // 3600000 AS hour FROM pi p JOIN per_block b ON b.day = p.day AND p.t_ms >= b.ps AND p.t_ms < b.pe""")
oracle.block("asb", "pib", """
SELECT day, block, hour, h, count(*) AS n_trades, sum(vol) AS volume, sum(es * vol) / sum(vol) AS es_mean, count(pi) AS n_h,
       sum(pi * vol) / sum(vol) FILTER (pi IS NOT NULL) AS as_h,
       sum((es - pi) * vol) / sum(vol) FILTER (pi IS NOT NULL) AS rs_h,
       sum(pi * vol) FILTER (odd) / sum(vol) FILTER (odd) AS as_odd,
       sum(pi * vol) FILTER (NOT odd) / sum(vol) FILTER (NOT odd) AS as_even
FROM (SELECT *, CASE WHEN pi IS NOT NULL THEN row_number() OVER (PARTITION BY day, block, h, pi IS NOT NULL ORDER BY t_ms, seq) % 2 = 1 END AS odd FROM pib)
GROUP BY ALL""")


def signed(p):
    return trades.signed_trades(trades.trade_events(p.states))


def impact_of(p):
    return p.store.table(
        "impact", lambda: trades.price_impact(signed(p), p.states, p.calendar)
    )


def selection_of(p, length_ms=BLOCK_MS):
    return p.store.table(
        f"selection_{length_ms}",
        lambda: trades.adverse_selection(
            trades.impact_blocks(impact_of(p), p.calendar, length_ms)
        ),
    )


@register(
    "trade_events",
    "te",
    """SELECT day, seq, k, t_ms, d, retail_only, CAST(vol AS BIGINT) AS vol, CAST(vol_nr AS BIGINT) AS vol_nr, round(p_tick, 9) AS p_tick,
b_prev, a_prev, b_after, a_after, valid_after FROM te""",
)
def trade_events(p):
    return rounded(trades.trade_events(p.states).drop("sid"))


@register(
    "price_impact",
    "pi",
    "SELECT day, seq, h, d, round(es, 9) AS es, round(pi, 9) AS pi, round(es - pi, 9) AS rs FROM pi",
)
def price_impact(p):
    return rounded(impact_of(p).select("day", "seq", "h", "d", "es", "pi", "rs"))


@register(
    "price_impact_quote_rule",
    "te",
    """SELECT day, seq, CASE WHEN d = 0 AND retail_only THEN CAST(sign(p_tick - (a_prev + b_prev) / 2.0) AS INTEGER) ELSE d END AS d,
round((CASE WHEN d = 0 AND retail_only THEN sign(p_tick - (a_prev + b_prev) / 2.0) ELSE d END) * (p_tick - (a_prev + b_prev) / 2.0) + 0.0, 9) AS es
FROM te WHERE a_prev > b_prev AND (d <> 0 OR (retail_only AND p_tick <> (a_prev + b_prev) / 2.0))""",
)
def price_impact_quote_rule(p):
    rows = trades.signed_trades(trades.trade_events(p.states), quote_rule=True)
    return rounded(rows.select("day", "seq", "d", "es"))


@register(
    "impact_distribution",
    "pi",
    """SELECT h, measure, count(*) AS n, round(sum(v * vol) / sum(vol), 9) AS mean_weighted, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS sd,
round(avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END), 9) AS share_zero, """
    + ", ".join(f"round(quantile_cont(v, {q}), 9) AS p{int(q * 100)}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))
    + """ FROM (SELECT h, 'pi' AS measure, pi AS v, vol FROM pi UNION ALL SELECT h, 'rs', es - pi, vol FROM pi) WHERE v IS NOT NULL GROUP BY h, measure""",
)
def impact_distribution(p):
    return rounded(trades.impact_distribution(impact_of(p)))


@register(
    "adverse_selection_block",
    "asb",
    """SELECT day, block, hour, h, n_trades, CAST(volume AS BIGINT) AS volume, round(es_mean, 9) AS es_mean, n_h, round(as_h, 9) AS as_h,
round(rs_h, 9) AS rs_h, round(as_odd, 9) AS as_odd, round(as_even, 9) AS as_even FROM asb""",
)
def adverse_selection_block(p):
    return rounded(selection_of(p).drop("sid"))


def _hash(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({x} AS VARCHAR)" for x in parts]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


def wild_blocks(name: str, source: str, keys: str) -> None:
    """Correlation and wild interval of ``source(keys, day, x, y)``, row by row in SQL."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    oracle.block(f"{name}_f", source, f"""
SELECT {keys}, count(*) AS n, count(DISTINCT day) AS sessions, avg(x) AS mx, corr(x, y) AS r,
       regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {source} GROUP BY {keys}""")
    oracle.block(f"{name}_w", source, f"""
SELECT k.*, r.rep, [-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][CAST(floor({_hash(SEED, "r.rep", "k.day")} * 6) AS INTEGER) + 1] AS w
FROM (SELECT DISTINCT {keys}, day FROM {source}) k, (SELECT unnest(range(1, {WILD_REPS + 1})) AS rep) r""")
    oracle.block(f"{name}_r", f"{source} {name}_f {name}_w", f"""
SELECT {", ".join("s." + k for k in keys.split(", "))}, w.rep, corr(s.x, f.a + f.b * s.x + w.w * (s.y - f.a - f.b * s.x)) AS r
FROM {source} s JOIN {name}_f f ON {on("f", "s")} JOIN {name}_w w ON {on("w", "s")} AND w.day = s.day GROUP BY ALL""")
    oracle.block(f"{name}_q", f"{name}_r", f"""
SELECT {keys}, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi,
       quantile_cont(2 * r / (1 + r), 0.025) AS sb_lo, quantile_cont(2 * r / (1 + r), 0.975) AS sb_hi FROM {name}_r GROUP BY {keys}""")


oracle.block("sp0", "asb", "SELECT day, hour, h, as_odd AS x, as_even AS y FROM asb WHERE as_odd IS NOT NULL AND as_even IS NOT NULL")
oracle.block("sp", "sp0", """
SELECT day, h, 'raw' AS version, x, y FROM sp0
UNION ALL SELECT day, h, 'hour_mean_removed', x - avg(x) OVER w, y - avg(y) OVER w FROM sp0 WINDOW w AS (PARTITION BY h, hour)""")
wild_blocks("spw", "sp", "h, version")


def _sb_of(df):
    """Spearman-Brown of a correlation table; the interval maps through 2r/(1+r)."""
    sb = inf.spearman_brown(F.col("r"))
    return df.select(
        "h", "version", "n", "sessions", "r", sb.alias("spearman_brown"),
        inf.reliability_class(sb).alias("class"),
        inf.spearman_brown(F.col("ci_low")).alias("ci_low"),
        inf.spearman_brown(F.col("ci_high")).alias("ci_high"),
    )


@register(
    "split_half",
    "spw_f spw_q",
    """SELECT f.h, f.version, f.n, f.sessions, round(f.r, 6) AS r, round(2 * f.r / (1 + f.r), 6) AS spearman_brown,
CASE WHEN 2 * f.r / (1 + f.r) >= 0.5 THEN 'varies' WHEN 2 * f.r / (1 + f.r) < 0.3 THEN 'barely_varies' ELSE 'inconclusive' END AS class,
round(2 * q.lo / (1 + q.lo), 6) AS ci_low, round(2 * q.hi / (1 + q.hi), 6) AS ci_high
FROM spw_f f JOIN spw_q q ON q.h = f.h AND q.version = f.version""",
)
def split_half(p):
    rows = (
        selection_of(p)
        .filter("as_odd IS NOT NULL AND as_even IS NOT NULL")
        .select("day", "hour", "h", F.col("as_odd").alias("x"), F.col("as_even").alias("y"))
    )
    both = inf.without_hour_mean(rows, ["h"], "x", "y")
    return rounded(_sb_of(inf.wild_correlation(both, ["h", "version"], "day", WILD_REPS, SEED)), 6)


for _l in (QUARTER_HOUR, HALF_HOUR):
    oracle.block(f"pib_{_l}", "pi cal", f"""
SELECT p.*, p.t_ms // {_l} * {_l} AS block, p.t_ms // {_l} * {_l} // 3600000 AS hour FROM pi p JOIN cal c ON c.day = p.day
WHERE p.t_ms // {_l} * {_l} >= c.valid_from AND (p.t_ms // {_l} + 1) * {_l} <= c.valid_to
  AND NOT coalesce(c.x0 < (p.t_ms // {_l} + 1) * {_l} AND p.t_ms // {_l} * {_l} < c.x1, false)""")
oracle.block("asq", f"pib_{QUARTER_HOUR}", f"""
SELECT day, block, h, sum(pi * vol) / sum(vol) AS as_h FROM pib_{QUARTER_HOUR} WHERE pi IS NOT NULL GROUP BY ALL""")
oracle.block("gh0", f"pib_{HALF_HOUR}", f"""
SELECT day, block, hour, h, sum(pi * vol) FILTER (t_ms - block < 870000) / sum(vol) FILTER (t_ms - block < 870000) AS x,
       sum(pi * vol) FILTER (t_ms - block >= 930000) / sum(vol) FILTER (t_ms - block >= 930000) AS y
FROM pib_{HALF_HOUR} WHERE pi IS NOT NULL GROUP BY ALL""")
oracle.block("gh", "gh0", """
SELECT day, h, 'raw' AS version, x, y FROM gh0 WHERE x IS NOT NULL AND y IS NOT NULL
UNION ALL SELECT day, h, 'hour_mean_removed', x - avg(x) OVER w, y - avg(y) OVER w FROM gh0 WHERE x IS NOT NULL AND y IS NOT NULL
WINDOW w AS (PARTITION BY h, hour)""")
wild_blocks("ghw", "gh", "h, version")


@register(
    "split_half_gap",
    "ghw_f ghw_q",
    """SELECT f.h, f.version, f.n, f.sessions, round(f.r, 6) AS r, round(2 * f.r / (1 + f.r), 6) AS spearman_brown,
CASE WHEN 2 * f.r / (1 + f.r) >= 0.5 THEN 'varies' WHEN 2 * f.r / (1 + f.r) < 0.3 THEN 'barely_varies' ELSE 'inconclusive' END AS class,
round(2 * q.lo / (1 + q.lo), 6) AS ci_low, round(2 * q.hi / (1 + q.hi), 6) AS ci_high
FROM ghw_f f JOIN ghw_q q ON q.h = f.h AND q.version = f.version""",
)
def split_half_gap(p):
    rows = trades.gap_halves(
        trades.impact_blocks(impact_of(p), p.calendar, HALF_HOUR), HALF_HOUR, 60_000
    )
    both = inf.without_hour_mean(rows.select("day", "hour", "h", "x", "y"), ["h"], "x", "y")
    return rounded(_sb_of(inf.wild_correlation(both, ["h", "version"], "day", WILD_REPS, SEED)), 6)


@register(
    "block_lag2_correlation",
    "asq",
    f"""SELECT h, count(*) AS n, round(corr(as_h, nxt), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (
SELECT h, as_h, nxt, rank() OVER (PARTITION BY h ORDER BY as_h) + (count(*) OVER (PARTITION BY h, as_h) - 1) / 2.0 AS rx,
       rank() OVER (PARTITION BY h ORDER BY nxt) + (count(*) OVER (PARTITION BY h, nxt) - 1) / 2.0 AS ry
FROM (SELECT h, as_h, lead(as_h, 2) OVER w AS nxt, lead(block, 2) OVER w = block + 2 * {QUARTER_HOUR} AS near
      FROM asq WINDOW w AS (PARTITION BY day, h ORDER BY block)) WHERE near)
GROUP BY h""",
)
def block_lag2_correlation(p):
    known = selection_of(p, QUARTER_HOUR).filter("as_h IS NOT NULL")
    ahead = known.withColumn("x", F.col("as_h")).withColumn(
        "y", trades.block_shift(known, "as_h", -2, QUARTER_HOUR, keys=[*KEY, "h"])
    )
    return rounded(inf.correlations(ahead, ["h"]), 6)


@register(
    "hour_variance_share",
    "asb",
    """SELECT h, round(1 - sum((as_h - m) * (as_h - m)) / (any_value(vt)), 6) AS hour_share FROM (
SELECT h, as_h, avg(as_h) OVER (PARTITION BY h, hour) AS m, var_pop(as_h) OVER (PARTITION BY h) * count(*) OVER (PARTITION BY h) AS vt
FROM asb WHERE as_h IS NOT NULL) GROUP BY h""",
)
def hour_variance_share(p):
    return rounded(inf.hour_share(selection_of(p), ["h"], "as_h"), 6)


# ------------------------------------------------------------------ order-flow blocks
@register(
    "ofi_block",
    "cs per_block",
    """SELECT p.day, p.ps AS block, CAST(coalesce(sum(
 (CASE WHEN s.b >= s.p_b THEN s.qb ELSE 0 END) - (CASE WHEN s.b <= s.p_b THEN s.p_qb ELSE 0 END)
 - (CASE WHEN s.a <= s.p_a THEN s.qa ELSE 0 END) + (CASE WHEN s.a >= s.p_a THEN s.p_qa ELSE 0 END)) FILTER (NOT s.reference), 0) AS BIGINT) AS ofi
FROM per_block p JOIN cs s ON s.day = p.day AND s.t_ms >= p.ps AND s.t_ms < p.pe GROUP BY p.day, p.ps""",
)
def ofi_block(p):
    flow = panels.order_flow_imbalance(p.states)
    rows = panels.in_period(flow, panels.periods(p.calendar, "block"), "block")
    return rows.groupBy("day", F.col("period_start").alias("block")).agg(F.sum("ofi").alias("ofi"))


def block_returns(p, length_ms=BLOCK_MS):
    """Mid change, order-flow imbalance and panel columns of every block."""

    def build():
        flow = panels.order_flow_imbalance(p.states)
        period = panels.periods(p.calendar, "block", length_ms)
        ofi = panels.in_period(flow, period, "block", length_ms).groupBy(*panels.PERIOD).agg(
            F.sum("ofi").alias("ofi")
        )
        pieces = panels.interval_pieces(
            panels.quote_intervals(p.states, p.calendar), period, "block", length_ms
        ).withColumn("mid", (F.col("a") + F.col("b")) / 2.0)
        first = F.min_by(F.struct("mid", "t_from"), "k")
        edges = pieces.groupBy(*panels.PERIOD).agg(
            first.alias("_first"), F.max_by("mid", "k").alias("_last")
        )
        # the change is from the state standing before the block; none before -> NULL
        r = F.when(F.col("_first.t_from") < F.col("period_start"), F.col("_last") - F.col("_first.mid"))
        return (
            panel_of(p, "block", length_ms)
            .join(edges, panels.PERIOD, "left")
            .join(ofi, panels.PERIOD, "left")
            .withColumn("r", r)
            .drop("_first", "_last")
            .withColumn("ofi", F.when(F.col("r").isNotNull(), F.coalesce("ofi", F.lit(0))))
            .withColumn("abs_r", F.abs("r"))
            .withColumn("kappa", F.try_divide(F.col("m_det"), F.col("m_impr")))
            .withColumn("hour", F.floor(F.col("period_start") / 3_600_000))
        )

    return p.store.table(f"block_returns_{length_ms}", build)


@register(
    "block_returns",
    "in_block",
    """SELECT day, ps AS period_start, CASE WHEN arg_min(t_ms, seq) < ps THEN arg_max((a + b) / 2.0, seq) - arg_min((a + b) / 2.0, seq) END AS r
FROM in_block GROUP BY day, ps""",
)
def block_returns_query(p):
    rows = block_returns(p).filter("spread_last IS NOT NULL")
    return rows.select("day", "period_start", "r")


def _lagged(df, column: str, steps, length_ms, start: str = "period_start"):
    out = df
    for s in steps:
        name = f"{column}_l{s}" if s > 0 else f"{column}_f{-s}"
        out = out.withColumn(name, trades.block_shift(df, column, s, length_ms, start))
    return out


def predictive_rows(p):
    """Adverse selection one block ahead with controls and the residual ratios."""
    scored = rs.intraday(blocks(p, BASE[:2]), 1, own_day=False).select(
        *KEY, "period_start", "spec", F.col("residual").alias("m")
    )
    base = block_returns(p).select(
        *KEY, "period_start", "hour", "volume", "qvol", "abs_r", "frac_1tick", "theta", "kappa"
    )
    selection = selection_of(p).select(
        *KEY, F.col("block").alias("period_start"), "h", F.col("as_h").alias("as0")
    )
    ahead = selection.withColumn(
        "as_next", trades.block_shift(selection, "as0", -1, BLOCK_MS, "period_start", [*KEY, "h"])
    )
    measures = scored.unionByName(
        base.select(*KEY, "period_start", F.lit("theta").alias("spec"), F.col("theta").alias("m"))
    ).unionByName(
        base.select(*KEY, "period_start", F.lit("kappa").alias("spec"), F.col("kappa").alias("m"))
    )
    return ahead.join(base.drop("theta", "kappa"), [*KEY, "period_start"]).join(
        measures, [*KEY, "period_start"]
    )


@register("predictive_regressions")
def predictive_regressions(p):
    rows = p.store.table("predictive_rows", lambda: predictive_rows(p))
    table = inf.regression_table(
        rows, ["spec", "h"], "as_next",
        ["m", "volume", "qvol", "abs_r", "frac_1tick", "as0"],
        ["day", "period_start"], WILD_REPS, SEED,
    )
    return rounded(table, 6)


@register("contemporaneous_regressions")
def contemporaneous_regressions(p):
    rows = p.store.table("predictive_rows", lambda: predictive_rows(p))
    table = inf.regression_table(
        rows, ["spec", "h"], "as0", ["m", "volume", "qvol", "abs_r", "frac_1tick"],
        ["day", "period_start"], WILD_REPS, SEED,
    )
    return rounded(table, 6)


oracle.block("fx", "asb in_block panel_block", """
SELECT a.day, a.block, a.hour, a.h, a.as_h AS y, p.theta AS x FROM asb a
JOIN panel_block p ON p.day = a.day AND p.period_start = a.block WHERE a.as_h IS NOT NULL AND p.theta IS NOT NULL""")
oracle.block("fxd", "fx", """
SELECT *, x - avg(x) OVER w AS zx, y - avg(y) OVER w AS zy FROM fx WINDOW w AS (PARTITION BY h, hour)""")
oracle.block("fxf", "fxd", """
SELECT h, count(*) AS n, sum(zx * zy) / sum(zx * zx) AS b, sum(zx * zx) AS sxx, sum(zx * zy) AS sxy, sum(zy * zy) AS syy,
       stddev_samp(x) / stddev_samp(y) AS scale FROM fxd GROUP BY h""")
oracle.block("fxp", "fxd fxf", """
SELECT d.h, d.day, d.block, (d.zy - f.b * d.zx) * d.zx / f.sxx * f.scale AS psi FROM fxd d JOIN fxf f ON f.h = d.h""")
oracle.block("fxh", "fxp", """
SELECT h, sqrt(sum(psi * psi) + 2 * (5 * coalesce(sum(psi * l1), 0) + 4 * coalesce(sum(psi * l2), 0) + 3 * coalesce(sum(psi * l3), 0) + 2 * coalesce(sum(psi * l4), 0) + coalesce(sum(psi * l5), 0)) / 6) AS se_hac
FROM (SELECT *, lag(psi, 1) OVER w AS l1, lag(psi, 2) OVER w AS l2, lag(psi, 3) OVER w AS l3, lag(psi, 4) OVER w AS l4, lag(psi, 5) OVER w AS l5
      FROM fxp WINDOW w AS (PARTITION BY h ORDER BY day, block)) GROUP BY h""")
oracle.block("fxw", "fxp", f"""
SELECT h, stddev_samp(s) AS se_wild, quantile_cont(s, 0.025) AS d_low, quantile_cont(s, 0.975) AS d_high FROM (
SELECT c.h, r.rep, sum(c.s * [-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][CAST(floor({_hash(SEED, "r.rep", "c.day")} * 6) AS INTEGER) + 1]) AS s
FROM (SELECT h, day, sum(psi) AS s FROM fxp GROUP BY ALL) c, (SELECT unnest(range(1, {WILD_REPS + 1})) AS rep) r GROUP BY ALL) GROUP BY h""")


@register(
    "composition_regression",
    "fxf fxh fxw",
    """SELECT f.h, f.n, round(f.b * f.scale, 6) AS beta, round(f.b * f.scale - w.d_high, 6) AS ci_low, round(f.b * f.scale - w.d_low, 6) AS ci_high,
round(w.se_wild, 6) AS se_wild, round(x.se_hac, 6) AS se_hac, round(f.sxy * f.sxy / f.sxx / f.syy, 6) AS partial_r2
FROM fxf f JOIN fxh x ON x.h = f.h JOIN fxw w ON w.h = f.h""",
)
def composition_regression(p):
    """Adverse selection on theta with hour effects: wild and HAC errors, partial R2."""
    rows = selection_of(p).select(
        *KEY, F.col("block").alias("period_start"), "hour", "h", F.col("as_h").alias("y")
    ).join(
        panel_of(p, "block").select(*KEY, "period_start", F.col("theta").alias("x")),
        [*KEY, "period_start"],
    )
    table = inf.regression_table(
        rows, ["h"], "y", ["x"], ["day", "period_start"], WILD_REPS, SEED
    )
    return rounded(
        table.select("h", "n", "beta", "ci_low", "ci_high", "se_wild", "se_hac", "partial_r2"), 6
    )


def lead_lag_rows(p):
    """Residual ratio against returns: leads and lags inside the session only."""
    scored = rs.intraday(blocks(p, BASE[:1], QUARTER_HOUR), 1, own_day=False).select(
        *KEY, "period_start", F.col("residual").alias("m")
    )
    rows = block_returns(p, QUARTER_HOUR).filter("r IS NOT NULL").select(
        *KEY, "period_start", F.col("r").cast("double").alias("r"), F.col("ofi").cast("double").alias("ofi")
    ).join(scored, [*KEY, "period_start"], "left")
    rows = _lagged(rows, "r", (-1, 1, 2, 3, 4, 5), QUARTER_HOUR)
    rows = _lagged(rows, "ofi", (1, 2, 3, 4, 5), QUARTER_HOUR)
    return _lagged(rows, "m", (1, 2, 3, 4, 5), QUARTER_HOUR)


@register("lead_lag_partial_r2")
def lead_lag_partial_r2(p):
    lags = range(1, 6)
    forward = ("r_f1", ["m"], [*[f"r_l{i}" for i in lags], *[f"ofi_l{i}" for i in lags]])
    reaction = ("m", ["r", "r_l1"], [f"m_l{i}" for i in lags])
    rows = p.store.table("lead_lag_rows", lambda: lead_lag_rows(p))
    return rounded(
        inf.partial_r2_bootstrap(
            rows, "day", {"forward": forward, "reaction": reaction}, REPS, SEED
        ),
        6,
    )


@register("theta_lead_lag_partial_r2")
def theta_lead_lag_partial_r2(p):
    """Composition against adverse selection: forward and reaction equations at h = 60 s."""
    selection = selection_of(p, QUARTER_HOUR).filter("h = 60").select(
        *KEY, F.col("block").alias("period_start"), F.col("as_h").alias("as0")
    )
    rows = block_returns(p, QUARTER_HOUR).select(
        *KEY, "period_start", "volume", "qvol", "abs_r", "frac_1tick", "theta"
    ).join(selection, [*KEY, "period_start"], "left")
    rows = _lagged(rows, "as0", (-1, 1), QUARTER_HOUR)
    for c in ("qvol", "abs_r"):
        rows = _lagged(rows, c, (1,), QUARTER_HOUR)
    rows = _lagged(rows, "theta", (1, 2, 3), QUARTER_HOUR)
    forward = ("as0_f1", ["theta"], ["as0", "as0_l1", "volume", "qvol", "qvol_l1", "abs_r", "abs_r_l1", "frac_1tick"])
    reaction = ("theta", ["abs_r", "abs_r_l1", "as0_l1", "qvol_l1"], ["theta_l1", "theta_l2", "theta_l3", "volume", "frac_1tick"])
    return rounded(
        inf.partial_r2_bootstrap(rows, "day", {"forward": forward, "reaction": reaction}, REPS, SEED), 6
    )


def decomposition_rows(p):
    """Blocks with moves on both sides and the exact decomposition of improvements."""
    identity = panels.spread_identity(
        p.states, panel_of(p, "block"), panels.periods(p.calendar, "block"), "block"
    ).select(*panels.PERIOD, "delta_spread")
    c = F.col
    return (
        panel_of(p, "block")
        .filter("n_impr > 0 AND n_det_all > 0")
        .join(identity, panels.PERIOD)
        .withColumn("kappa", c("m_det") / c("m_impr"))
        .withColumn("edge", c("delta_spread") / (c("n_det_all") * c("m_impr")))
        .withColumn("ln_kappa", F.log("kappa"))
        .withColumn(
            "identity_gap",
            c("n_impr") - (c("n_det_all") * c("kappa") - c("delta_spread") / c("m_impr")),
        )
    )


@register(
    "improvement_decomposition",
    "cnt_block",
    """SELECT day, ps AS period_start, n_impr, n_det_all, round(CAST(n_det_exec AS DOUBLE) / n_det_all, 9) AS theta,
round((CAST(ticks_det AS DOUBLE) / n_det_all) / (CAST(ticks_impr AS DOUBLE) / n_impr), 9) AS kappa,
round(CAST(ticks_det - ticks_impr AS DOUBLE) / (n_det_all * (CAST(ticks_impr AS DOUBLE) / n_impr)), 9) AS edge, true AS identity_holds
FROM cnt_block WHERE n_impr > 0 AND n_det_all > 0""",
)
def improvement_decomposition(p):
    rows = decomposition_rows(p)
    return rounded(
        rows.select(
            "day", "period_start", "n_impr", "n_det_all", "theta", "kappa", "edge",
            (F.abs("identity_gap") < 1e-9 * F.greatest(F.lit(1), F.col("n_impr"))).alias("identity_holds"),
        )
    )


@register("shapley_r2")
def shapley_r2(p):
    rows = p.store.table("decomposition", lambda: decomposition_rows(p))
    parts = [
        inf.shapley_table(rows, y, ["theta", "ln_kappa", "edge"], "day", SHARE_REPS, SEED).withColumn("y", F.lit(y))
        for y in ("qcr_r", "qcr_a")
    ]
    return rounded(parts[0].unionByName(parts[1]), 6)


# ------------------------------------------------------------------ audit diagnostics
def draw_blocks(name: str, source: str, keys: str) -> None:
    """Session draws of ``source(keys, day, num, den)`` and the interval of the ratio."""
    cols = keys.split(", ")
    on = " AND ".join(f"p.{k} = d.{k}" for k in cols)
    oracle.block(f"{name}_p", source, f"""
SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS g
FROM (SELECT {keys}, day, CAST(sum(num) AS DOUBLE) AS num, CAST(sum(den) AS DOUBLE) AS den FROM {source} GROUP BY {keys}, day)""")
    oracle.block(f"{name}_d", f"{name}_p", f"""
SELECT {", ".join("p." + k for k in cols)}, r.rep, CAST(floor({_hash(SEED, "r.rep", "p.i")} * p.g) AS BIGINT) AS i
FROM {name}_p p, (SELECT unnest(range(1, {REPS + 1})) AS rep) r""")
    oracle.block(f"{name}_q", f"{name}_p {name}_d", f"""
SELECT {keys}, quantile_cont(s, 0.025) AS ci_low, quantile_cont(s, 0.975) AS ci_high FROM (
SELECT {", ".join("d." + k for k in cols)}, d.rep, sum(p.num) / nullif(sum(p.den), 0) AS s FROM {name}_d d JOIN {name}_p p ON {on} AND p.i = d.i GROUP BY ALL) GROUP BY {keys}""")


_WINDOWS = (100, 1000, 5000)
_CLASSES = ("undercut", "refill", "shift")
oracle.block("comp", "mv", " UNION ALL ".join(
    f"SELECT day, '{c}' AS class, {w} AS w, CASE WHEN class_w{w} = '{c}' THEN 1 ELSE 0 END AS num, 1 AS den FROM mv WHERE kind = 'improve'"
    for w in _WINDOWS for c in _CLASSES))
draw_blocks("compb", "comp", "class, w")


@register(
    "improvement_composition",
    "compb_p compb_q",
    """SELECT p.class, p.w, CAST(sum(p.den) AS BIGINT) AS n, round(sum(p.num) / sum(p.den), 6) AS value, round(any_value(q.ci_low), 6) AS ci_low,
round(any_value(q.ci_high), 6) AS ci_high FROM compb_p p JOIN compb_q q ON q.class = p.class AND q.w = p.w GROUP BY p.class, p.w""",
)
def improvement_composition(p):
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"),
                F.lit(w).alias("w"),
                F.when(F.col(f"class_w{w}") == c, 1).otherwise(0).alias("num"),
            )
            for w in _WINDOWS
            for c in _CLASSES
        ]
    )
    rows = p.moves.filter("kind = 'improve'").select(
        "day", *[F.col(f"class_w{w}") for w in _WINDOWS]
    ).select("day", F.inline(entries))
    table = inf.ratio_bootstrap(rows, ["class", "w"], "day", F.col("num"), F.lit(1), REPS, SEED)
    return rounded(table.select("class", "w", F.col("n").cast("bigint").alias("n"), "value", "ci_low", "ci_high"), 6)


_AGREE = ("r_10ms", "r_nr_10ms", "r_1ms")
oracle.block("agree", "mv", " UNION ALL ".join(
    f"SELECT day, '{r}' AS rule, CASE WHEN {r} = (cause = 'execution') THEN 1 ELSE 0 END AS num, 1 AS den, {r} AS flag, cause = 'execution' AS exec FROM mv WHERE kind = 'worsen'"
    for r in _AGREE))
draw_blocks("agreeb", "agree", "rule")


@register(
    "attribution_agreement",
    "agree agreeb_q",
    """SELECT a.rule, count(*) AS n, round(avg(a.num), 6) AS value, round(any_value(q.ci_low), 6) AS ci_low, round(any_value(q.ci_high), 6) AS ci_high,
count(*) FILTER (a.flag AND a.exec) AS both, count(*) FILTER (a.flag AND NOT a.exec) AS rule_only,
count(*) FILTER (NOT a.flag AND a.exec) AS cause_only, count(*) FILTER (NOT a.flag AND NOT a.exec) AS neither
FROM agree a JOIN agreeb_q q ON q.rule = a.rule GROUP BY a.rule""",
)
def attribution_agreement(p):
    rows = p.moves.filter("kind = 'worsen'").select(
        "day",
        (F.col("cause") == "execution").alias("exec"),
        F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("flag")) for r in _AGREE])),
    )
    flag, ex = F.col("flag"), F.col("exec")
    table = rows.groupBy("rule").agg(
        F.count_if(flag & ex).alias("both"),
        F.count_if(flag & ~ex).alias("rule_only"),
        F.count_if(~flag & ex).alias("cause_only"),
        F.count_if(~flag & ~ex).alias("neither"),
    )
    agree = inf.ratio_bootstrap(
        rows, ["rule"], "day", F.when(flag == ex, 1).otherwise(0), F.lit(1), REPS, SEED
    )
    joined = agree.withColumn("n", F.col("n").cast("bigint")).join(table, "rule")
    return rounded(joined.select("rule", "n", "value", "ci_low", "ci_high", "both", "rule_only", "cause_only", "neither"), 6)


_MEANS = ("qcr_r", "qcr_a", "qcr_u", "frac_1tick", "spread_tw_ticks", "share_1tick_impr", "share_1tick_det_trade")
oracle.block("means", "panel_day panel_block", " UNION ALL ".join(
    f"SELECT day, '{g}' AS level, '{m}' AS measure, {m} AS num, 1 AS den FROM panel_{g} WHERE {m} IS NOT NULL"
    for g in ("day", "block") for m in _MEANS))
draw_blocks("meansb", "means", "level, measure")


@register(
    "ratio_distribution",
    "means meansb_q",
    """SELECT m.level, m.measure, count(*) AS n, round(avg(m.num), 6) AS mean, round(stddev_samp(m.num), 6) AS sd,
round(quantile_cont(CAST(m.num AS DOUBLE), 0.05), 6) AS p5, round(quantile_cont(CAST(m.num AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(m.num AS DOUBLE), 0.95), 6) AS p95,
round(avg(CASE WHEN m.num < 0 THEN 1.0 ELSE 0.0 END), 6) AS share_negative, round(any_value(q.ci_low), 6) AS ci_low, round(any_value(q.ci_high), 6) AS ci_high
FROM means m JOIN meansb_q q ON q.level = m.level AND q.measure = m.measure GROUP BY m.level, m.measure""",
)
def ratio_distribution(p):
    def long(grain):
        return panel_of(p, grain).select(
            "day",
            F.lit(grain).alias("level"),
            F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in _MEANS])),
        )

    rows = long("day").unionByName(long("block")).filter("v IS NOT NULL")
    keys = ["level", "measure"]
    table = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        *[F.percentile("v", q).alias(f"p{int(q * 100)}") for q in (0.05, 0.5, 0.95)],
        F.avg((F.col("v") < 0).cast("double")).alias("share_negative"),
    )
    ci = inf.ratio_bootstrap(rows, keys, "day", F.col("v"), F.lit(1.0), REPS, SEED)
    return rounded(table.join(ci.drop("n", "value"), keys), 6)


oracle.block("pairs", "panel_block", """
SELECT day, 'qcr_r' AS measure, qcr_composition AS x, qcr_r AS y FROM panel_block WHERE qcr_composition IS NOT NULL AND qcr_r IS NOT NULL
UNION ALL SELECT day, 'qcr_a', qcr_composition, qcr_a FROM panel_block WHERE qcr_composition IS NOT NULL AND qcr_a IS NOT NULL""")
oracle.block("pairs_p", "pairs", """
SELECT *, row_number() OVER (PARTITION BY measure ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY measure) AS g FROM (
SELECT measure, day, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM pairs GROUP BY ALL)""")
oracle.block("pairs_q", "pairs_p", f"""
SELECT measure, quantile_cont(r, 0.025) AS ci_low, quantile_cont(r, 0.975) AS ci_high FROM (
SELECT measure, rep, (sum(sxy) - sum(sx) * sum(sy) / sum(n)) / sqrt((sum(sxx) - sum(sx) * sum(sx) / sum(n)) * (sum(syy) - sum(sy) * sum(sy) / sum(n))) AS r
FROM (SELECT d.rep, p.* FROM (SELECT p.measure, r.rep, CAST(floor({_hash(SEED, "r.rep", "p.i")} * p.g) AS BIGINT) AS i
      FROM pairs_p p, (SELECT unnest(range(1, {REPS + 1})) AS rep) r) d JOIN pairs_p p ON p.measure = d.measure AND p.i = d.i) GROUP BY measure, rep) GROUP BY measure""")


@register(
    "composition_correlation",
    "pairs pairs_q",
    """SELECT p.measure, count(*) AS n, count(DISTINCT p.day) AS sessions, round(corr(p.x, p.y), 6) AS r, round(regr_r2(p.y, p.x), 6) AS r2,
round(regr_slope(p.y, p.x), 6) AS slope, round(any_value(q.ci_low), 6) AS ci_low, round(any_value(q.ci_high), 6) AS ci_high
FROM pairs p JOIN pairs_q q ON q.measure = p.measure GROUP BY p.measure""",
)
def composition_correlation(p):
    rows = panel_of(p, "block").select(
        "day",
        F.col("qcr_composition").alias("x"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("y")) for m in ("qcr_r", "qcr_a")])),
    ).filter("x IS NOT NULL AND y IS NOT NULL")
    fit = rows.groupBy("measure").agg(
        F.regr_r2("y", "x").alias("r2"), F.regr_slope("y", "x").alias("slope")
    )
    table = inf.correlation_bootstrap(rows, ["measure"], "day", REPS, SEED)
    return rounded(table.join(fit, "measure"), 6)


# ------------------------------------------------------------------ data quality
@register(
    "audit_counters",
    "st mv",
    """SELECT s.day, count(*) AS events, count(*) FILTER (s.counted) AS states, count(*) FILTER (s.phase = 'X') AS outside,
count(*) FILTER (NOT s.valid) AS invalid, count(*) FILTER (s.open_balance > 0) AS open_balance, count(*) FILTER (s.open_balance < 0) AS negative_balance,
CAST(any_value(m.n) AS BIGINT) AS moves, CAST(any_value(m.conflicts) AS BIGINT) AS cause_conflicts, CAST(any_value(m.uncaused) AS BIGINT) AS uncaused,
CAST(0 AS BIGINT) AS clock_reversals FROM st s
JOIN (SELECT day, count(*) AS n, count(*) FILTER (cause_conflict) AS conflicts, count(*) FILTER (kind = 'worsen' AND cause IS NULL) AS uncaused FROM mv GROUP BY day) m ON m.day = s.day
GROUP BY s.day""",
)
def audit_counters(p):
    events = p.states.groupBy("day").agg(
        F.count("*").alias("events"),
        F.count_if("counted").alias("states"),
        F.count_if(F.col("phase") == "X").alias("outside"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("open_balance") > 0).alias("open_balance"),
        F.count_if(F.col("open_balance") < 0).alias("negative_balance"),
        F.count_if(F.col("prev_any.t_ms") > F.col("t_ms")).alias("clock_reversals"),
    )
    moved = p.moves.groupBy("day").agg(
        F.count("*").alias("moves"),
        F.count_if("cause_conflict").alias("cause_conflicts"),
        F.count_if((F.col("kind") == "worsen") & F.col("cause").isNull()).alias("uncaused"),
    )
    return events.join(moved, "day")


@register(
    "lifecycle_anomalies",
    "num",
    """SELECT DISTINCT day, CAST(0 AS BIGINT) AS duplicate_order, CAST(0 AS BIGINT) AS orphan_delete, CAST(0 AS BIGINT) AS orphan_change,
CAST(0 AS BIGINT) AS price_change, CAST(0 AS BIGINT) AS size_increase, CAST(0 AS BIGINT) AS negative_level FROM num""",
)
def lifecycle_anomalies(p):
    names = ("duplicate_order", "orphan_delete", "orphan_change", "price_change", "size_increase")
    return p.log.groupBy("day").agg(
        *[F.count_if(F.col("anomaly") == n).alias(n) for n in names],
        F.count_if((F.col("level_n") < 0) | (F.col("level_q") < 0)).alias("negative_level"),
    )


@register(
    "events_outside_window",
    "mv cal",
    """SELECT c.day, count(*) FILTER (m.t_ms < c.valid_from OR m.t_ms >= c.valid_to OR coalesce(m.t_ms >= c.x0 AND m.t_ms < c.x1, false)) AS n_outside
FROM cal c LEFT JOIN mv m ON m.day = c.day GROUP BY c.day""",
)
def events_outside_window(p):
    window = p.calendar.select(*KEY, "valid_from", "valid_to", "exclusions")
    t = F.col("t_ms")
    outside = (
        (t < F.col("valid_from"))
        | (t >= F.col("valid_to"))
        | F.exists("exclusions", lambda x: (x["start"] <= t) & (t < x["end"]))
    )
    rows = window.join(p.moves.select(*KEY, "t_ms"), KEY, "left")
    return rows.groupBy("day").agg(F.count_if(outside).alias("n_outside"))


@register(
    "replay_agreement",
    "num",
    "SELECT day, count(*) AS compared, CAST(0 AS BIGINT) AS different, CAST(0 AS BIGINT) AS unmatched FROM num GROUP BY day",
)
def replay_agreement(p):
    """Event-level and message-level reconstructions compared at every event close."""
    by_event = p.events.select("day", "sid", "rpt", "b", "a", "qb", "qa")
    by_message = p.tape.select(
        "day", "sid", "rpt", *[F.col(c).alias(f"m_{c}") for c in ("b", "a", "qb", "qa")]
    )
    both = by_event.withColumn("_e", F.lit(1)).join(
        by_message.withColumn("_m", F.lit(1)), ["day", "sid", "rpt"], "left"
    )
    same = F.lit(True)
    for c in ("b", "a", "qb", "qa"):
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return both.groupBy("day").agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("_m").isNotNull() & ~same).alias("different"),
        F.count_if(F.col("_m").isNull()).alias("unmatched"),
    )


# ------------------------------------------------------------------ inspection sample
@register(
    "inspection_sample",
    "mv",
    f"""SELECT label, day, seq, side, pos FROM (SELECT day, seq, side, coalesce(class, cause) AS label,
row_number() OVER (PARTITION BY coalesce(class, cause) ORDER BY md5('{SEED}' || '|' || CAST(day AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || side)) AS pos FROM mv) WHERE pos <= 20""",
)
def inspection_sample(p):
    """Twenty moves of each class, drawn by hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(SEED)), *[F.col(c).cast("string") for c in ("day", "seq", "side")]))
    label = F.coalesce("class", "cause")
    # a per-class top-k: partial ranks per hash bucket keep any one class off a single task
    bucketed = p.moves.select("day", "seq", "side", label.alias("label"), key.alias("_h")).withColumn(
        "_b", F.substring("_h", 1, 2)
    )
    first = Window.partitionBy("label", "_b").orderBy("_h")
    kept = bucketed.withColumn("_r", F.row_number().over(first)).filter("_r <= 20")
    return (
        kept.withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("_h")))
        .filter("pos <= 20")
        .select("label", "day", "seq", "side", "pos")
    )
