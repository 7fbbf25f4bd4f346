"""Queries of the residual ratio."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.functions.constants import BLOCK_MS
from tickloom.plans import residual as rs
from tickloom.queries import panel_of, register, rounded

BASE = [(f"{y}|base", y, ["ln_pct_spread"]) for y in rs.RATIOS + rs.EXTRA_RATIOS]
ONE_TICK = [(f"{y}|one_tick", y, ["frac_1tick"]) for y in rs.RATIOS]
FAST = [("qcr_r_1ms|1ms", "qcr_r_1ms", ["ln_pct_spread"])]
MANY = [(f"{y}|many", y, ["ln_spread_pts", "qvol", "volume"]) for y in rs.RATIOS]
SINGLE = BASE + ONE_TICK + FAST


def hourly(p, specs):
    return rs.stacked(rs.with_controls(panel_of(p, "hour")), specs)


def blocks(p, specs, length_ms=BLOCK_MS):
    return rs.stacked(rs.with_controls(panel_of(p, "block", length_ms)), specs)


def scored_hours(p, specs, name):
    """Scored rows and first stage of the weekly version, kept as stage tables."""
    rows = p.store.table(f"stack_{name}", lambda: hourly(p, specs))
    k = len(specs[0][2])
    scored = p.store.table(f"scored_{name}", lambda: rs.by_window(rows, "week", k, "hour")[0])
    return rows, scored


# ------------------------------------------------------------------ oracle blocks
def stack_sql(grain: str, specs) -> str:
    parts = []
    for label, y, xs in specs:
        x = {
            "ln_pct_spread": "ln(CASE WHEN pct_spread_tw > 0 THEN pct_spread_tw END)",
            "frac_1tick": "frac_1tick",
        }[xs[0]]
        parts.append(
            f"""SELECT day, period_start, period_start // 3600000 AS hour,
strftime(date_trunc('week', strptime(CAST(day AS VARCHAR), '%Y%m%d')), '%Y-%m-%d') AS week,
'{label}' AS spec, {y} AS y, CAST({x} AS DOUBLE) AS x FROM panel_{grain}"""
        )
    return " UNION ALL ".join(parts)


oracle.block("sh", "panel_hour", stack_sql("hour", SINGLE))
oracle.block("sb", "panel_block", stack_sql("block", BASE[:5]))


def within_fit(name: str, source: str, keys: str, cat: str = "hour") -> None:
    """Blocks ``{name}_c`` (category means) and ``{name}`` (slope) from demeaned rows."""
    join = " AND ".join(f"d.{k} = c.{k}" for k in keys.split(", "))
    oracle.block(f"{name}_c", source, f"""
SELECT {keys}, {cat} AS cat, avg(x) AS mx, avg(y) AS my, count(*) AS nc FROM {source}
WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {keys}, {cat}""")
    group = ", ".join(f"d.{k}" for k in keys.split(", "))
    oracle.block(name, f"{source} {name}_c", f"""
SELECT {group}, count(*) AS n, count(DISTINCT d.{cat}) AS levels, stddev_samp(d.y) AS s_y,
       sum((d.x - c.mx) * (d.y - c.my)) / nullif(sum((d.x - c.mx) * (d.x - c.mx)), 0) AS b,
       sum((d.x - c.mx) * (d.x - c.mx)) AS sxx, sum((d.y - c.my) * (d.y - c.my)) AS wyy,
       sum((d.x - c.mx) * (d.y - c.my)) AS sxy, var_pop(d.y) * count(*) AS syy,
       max(d.x) > min(d.x) AS varies, min(d.{cat}) AS first_cat
FROM {source} d JOIN {name}_c c ON {join} AND d.{cat} = c.cat
WHERE d.x IS NOT NULL AND d.y IS NOT NULL GROUP BY {group}""")


within_fit("wf", "sh", "spec, week")
oracle.block("wk", "sh", """
SELECT spec, week, lag(week) OVER (PARTITION BY spec ORDER BY week) AS param_window
FROM (SELECT DISTINCT spec, week FROM sh)""")
oracle.block("wscore", "sh wk wf wf_c", """
SELECT s.day, s.period_start, s.spec, s.week, k.param_window,
       CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.b IS NOT NULL AND f.s_y > 0 AND c.cat IS NOT NULL THEN 'ok' ELSE 'not_identified' END AS status,
       CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.s_y > 0 THEN -(s.y - (c.my - f.b * c.mx + f.b * s.x)) / f.s_y END AS residual
FROM sh s JOIN wk k ON k.spec = s.spec AND k.week = s.week AND k.param_window IS NOT NULL
LEFT JOIN wf f ON f.spec = s.spec AND f.week = k.param_window
LEFT JOIN wf_c c ON c.spec = s.spec AND c.week = k.param_window AND c.cat = s.hour""")


@register(
    "residual_week",
    "wscore",
    "SELECT spec, day, period_start, week, param_window, round(residual, 6) AS residual, status FROM wscore",
)
def residual_week(p):
    _, scored = scored_hours(p, SINGLE, "single")
    return rounded(
        scored.select("spec", "day", "period_start", "week", "param_window", "residual", "status"), 6
    )


@register("residual_week_many_controls")
def residual_week_many_controls(p):
    _, scored = scored_hours(p, MANY, "many")
    return rounded(
        scored.select("spec", "day", "period_start", "week", "param_window", "residual", "status"), 6
    )


@register(
    "first_stage",
    "wf wf_c",
    """SELECT f.spec, f.week, f.n, round(f.s_y, 6) AS s_y,
CASE WHEN f.n < f.levels + 3 THEN 'few_rows' WHEN NOT f.varies THEN 'constant_control' WHEN f.b IS NULL THEN 'singular' ELSE 'ok' END AS status,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies THEN c.my - f.b * c.mx END, 6) AS a,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies THEN f.b END, 6) AS b,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies THEN sqrt((f.wyy - f.b * f.sxy) / (f.n - f.levels - 1) / f.sxx) END, 6) AS se_b,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.syy > 0 THEN 1 - (f.wyy - f.b * f.sxy) / f.syy END, 6) AS r2
FROM wf f JOIN wf_c c ON c.spec = f.spec AND c.week = f.week AND c.cat = f.first_cat""",
)
def first_stage(p):
    rows, _ = scored_hours(p, SINGLE, "single")
    _, stage = rs.by_window(rows, "week", 1, "hour")
    return rounded(
        stage.select(
            "spec", "week", "n", "s_y", "status", "a",
            F.get("b", F.lit(0)).alias("b"), F.get("se_b", F.lit(0)).alias("se_b"), "r2",
        ),
        6,
    )


oracle.block("sd", "panel_day", stack_sql("day", BASE[:5]).replace("period_start // 3600000", "0"))
within_fit("df", "sd", "spec, week")


@register(
    "residual_day_week",
    "sd df df_c",
    """SELECT s.spec, s.day, s.week, k.param_window,
CASE WHEN f.n >= 4 AND f.varies AND f.s_y > 0 THEN 'ok' ELSE 'not_identified' END AS status,
round(CASE WHEN f.n >= 4 AND f.varies AND f.s_y > 0 THEN -(s.y - (c.my - f.b * c.mx + f.b * s.x)) / f.s_y END, 6) AS residual
FROM sd s JOIN (SELECT spec, week, lag(week) OVER (PARTITION BY spec ORDER BY week) AS param_window FROM (SELECT DISTINCT spec, week FROM sd)) k
  ON k.spec = s.spec AND k.week = s.week AND k.param_window IS NOT NULL
LEFT JOIN df f ON f.spec = s.spec AND f.week = k.param_window
LEFT JOIN df_c c ON c.spec = s.spec AND c.week = k.param_window""",
)
def residual_day_week(p):
    rows = rs.stacked(rs.with_controls(panel_of(p, "day")), BASE[:5])
    scored, _ = rs.by_window(rows, "week", 1)
    return rounded(scored.select("spec", "day", "week", "param_window", "status", "residual"), 6)


@register(
    "first_stage_quarter",
    "sd",
    """SELECT spec, '2024Q1' AS quarter, regr_count(y, x) AS n, round(regr_slope(y, x), 6) AS b,
round(regr_intercept(y, x), 6) AS a, round(regr_r2(y, x), 6) AS r2 FROM sd GROUP BY spec""",
)
def first_stage_quarter(p):
    rows = rs.stacked(rs.with_controls(panel_of(p, "day")), BASE[:5])
    _, stage = rs.by_window(rows, "quarter", 1)
    return rounded(
        stage.select("spec", "quarter", "n", F.get("b", F.lit(0)).alias("b"), "a", "r2"), 6
    )


oracle.block("shn", "sh", """
SELECT *, row_number() OVER (PARTITION BY spec ORDER BY day, period_start) AS pos FROM sh WHERE spec LIKE '%|base'""")
oracle.block("roll", "shn", """
SELECT t.spec, t.pos AS target, h.hour, h.x, h.y FROM shn t JOIN shn h ON h.spec = t.spec AND h.pos BETWEEN t.pos - 45 AND t.pos - 1
WHERE t.pos > 45""")
within_fit("rf", "roll", "spec, target")


@register(
    "residual_rolling",
    "shn rf rf_c",
    """SELECT s.spec, s.day, s.period_start,
CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.s_y > 0 AND c.cat IS NOT NULL AND f.b IS NOT NULL THEN 'ok' ELSE 'not_identified' END AS status,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.s_y > 0 THEN -(s.y - (c.my - f.b * c.mx + f.b * s.x)) / f.s_y END, 6) AS residual
FROM shn s LEFT JOIN rf f ON f.spec = s.spec AND f.target = s.pos
LEFT JOIN rf_c c ON c.spec = s.spec AND c.target = s.pos AND c.cat = s.hour""",
)
def residual_rolling(p):
    rows, _ = scored_hours(p, SINGLE, "single")
    scored = rs.rolling(rows.filter(F.col("spec").endswith("|base")), 45, 1, "hour")
    return rounded(scored.select("spec", "day", "period_start", "status", "residual"), 6)


@register(
    "residual_winsorised",
    "wscore",
    """SELECT w.spec, w.day, w.period_start, round(CASE WHEN w.residual IS NOT NULL THEN greatest(q.lo, least(q.hi, w.residual)) END, 6) AS residual
FROM wscore w JOIN (SELECT spec, quantile_cont(residual, 0.01) AS lo, quantile_cont(residual, 0.99) AS hi FROM wscore GROUP BY spec) q ON q.spec = w.spec
WHERE w.spec LIKE '%|base'""",
)
def residual_winsorised(p):
    _, scored = scored_hours(p, SINGLE, "single")
    clipped = rs.winsorised(scored.filter(F.col("spec").endswith("|base")))
    return rounded(clipped.select("spec", "day", "period_start", "residual"), 6)


for _mode, _lag, _own in (("spec", 5, True), ("oos", 5, False), ("oos1", 1, False)):
    oracle.block(f"ch_{_mode}", "sb", f"""
SELECT spec, day AS target_day, lag(day, {_lag}) OVER (PARTITION BY spec ORDER BY day) AS control_day
FROM (SELECT DISTINCT spec, day FROM sb)""")
    _own_sql = "OR s.day = c.target_day" if _own else ""
    oracle.block(f"tr_{_mode}", f"ch_{_mode} sb", f"""
SELECT c.spec, c.target_day, s.hour, s.x, s.y FROM ch_{_mode} c
JOIN sb s ON s.spec = c.spec AND (s.day = c.control_day {_own_sql}) WHERE c.control_day IS NOT NULL""")
    within_fit(f"if_{_mode}", f"tr_{_mode}", "spec, target_day")


def _register_intraday(mode: str, lag: int, own: bool) -> None:
    @register(
        f"residual_intraday_{mode}",
        f"sb ch_{mode} if_{mode} if_{mode}_c",
        f"""SELECT s.spec, s.day, s.period_start, h.control_day, coalesce(f.n, 0) AS n_fit,
CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.s_y > 0 AND c.cat IS NOT NULL AND f.b IS NOT NULL THEN 'ok' ELSE 'not_identified' END AS status,
round(CASE WHEN f.n >= f.levels + 3 AND f.varies AND f.s_y > 0 THEN -(s.y - (c.my - f.b * c.mx + f.b * s.x)) / f.s_y END, 6) AS residual
FROM sb s JOIN ch_{mode} h ON h.spec = s.spec AND h.target_day = s.day AND h.control_day IS NOT NULL
LEFT JOIN if_{mode} f ON f.spec = s.spec AND f.target_day = s.day
LEFT JOIN if_{mode}_c c ON c.spec = s.spec AND c.target_day = s.day AND c.cat = s.hour""",
    )
    def residual_intraday(p):
        scored = rs.intraday(blocks(p, BASE[:5]), lag, own)
        return rounded(
            scored.select(
                "spec", "day", "period_start", "control_day",
                F.coalesce("n_fit", F.lit(0)).alias("n_fit"), "status", "residual",
            ),
            6,
        )


for _mode, _lag, _own in (("spec", 5, True), ("oos", 5, False), ("oos1", 1, False)):
    _register_intraday(_mode, _lag, _own)


@register(
    "residual_summary",
    "wscore",
    """SELECT spec, count(residual) AS n, round(avg(residual), 6) AS mean, round(stddev_samp(residual), 6) AS sd,
count(DISTINCT day) FILTER (residual IS NOT NULL) AS days FROM wscore WHERE residual IS NOT NULL GROUP BY spec""",
)
def residual_summary(p):
    _, scored = scored_hours(p, SINGLE, "single")
    return rounded(rs.summary(scored, "spec"), 6)
