"""Queries of the predictive tests, placebo designs and the event study."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.operators.quantiles import quantiles
from tickloom.plans import clock_panel as ck
from tickloom.plans import predictive as pr
from tickloom.plans import residual as rs
from tickloom.queries import register, rounded
from tickloom.queries_feed import feed_of
from tickloom.queries_inference import _hash
from tickloom.queries_tape import replay_panel_of, signals_of
from tickloom.sources import feed as fd

SEED = 7_411
SIGNALS = ("ur_price", "fqcr", "queue_run", "agg_cancel")
HORIZONS = (1, 5, 10, 30)
PERMUTATIONS = 500
BLOCK_MINUTES, BLOCK_REPS = 10, 10_000
KEEP = ["day", "sid", "bucket", "hour"]
OPEN_MS, CLOSE_MS = 32_400_000, 64_800_000


def panel(p, label: str):
    return signals_of(p, label).withColumn("hour", F.floor(F.col("bucket") / 3_600_000))


# ------------------------------------------------------------------ single-signal table
def single_specs():
    specs = [
        (f"{s}|h{h}", pr.log_return(h), [F.col(s)]) for s in SIGNALS for h in HORIZONS
    ]
    specs += [(f"fqcr|past{h}", pr.log_return(-h), [F.col("fqcr")]) for h in (5, 10)]
    order = pr.day_order()
    specs += [
        (f"reaction|k{k}", F.lead("agg_cancel", k).over(order), [F.col("agr_imb")])
        for k in (1, 2, 3, 5, 10)
    ]
    return specs


def single_rows(p):
    return p.store.table(
        "single_specs",
        lambda: pr.stack(panel(p, "1s").filter("close_mid IS NOT NULL"), single_specs(), KEEP),
    )


_W = "OVER (PARTITION BY day ORDER BY bucket)"
_SINGLE = (
    [(f"{s}|h{h}", f"ln(lead(close_mid, {h}) {_W} / close_mid) * 10000", s) for s in SIGNALS for h in HORIZONS]
    + [(f"fqcr|past{h}", f"ln(close_mid / lag(close_mid, {h}) {_W}) * 10000", "fqcr") for h in (5, 10)]
    + [(f"reaction|k{k}", f"lead(agg_cancel, {k}) {_W}", "agr_imb") for k in (1, 2, 3, 5, 10)]
)
oracle.block("ss", "sig_1s", " UNION ALL ".join(
    f"SELECT '{n}' AS spec, day, bucket, bucket // 3600000 AS hour, {y} AS y, {x} AS x FROM sig_1s WHERE close_mid IS NOT NULL"
    for n, y, x in _SINGLE))


def table_blocks(name: str, source: str, keys: str, lags: int, category: str | None = "hour") -> None:
    """Slope, HAC z, partial R2 and one-sd effect of y on x (category effects)."""
    cols = keys.split(", ")
    part = ", ".join([*cols, category]) if category else keys
    on = " AND ".join(f"f.{k} = d.{k}" for k in cols)
    oracle.block(f"{name}_d", source, f"""
SELECT *, x - avg(x) OVER w AS zx, y - avg(y) OVER w AS zy FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY {part})""")
    oracle.block(f"{name}_f", f"{name}_d", f"""
SELECT {keys}, count(*) AS n, sum(zx * zy) / sum(zx * zx) AS b, sum(zx * zx) AS sxx, sum(zx * zy) AS sxy, sum(zy * zy) AS syy,
       stddev_samp(x) AS sdx FROM {name}_d GROUP BY {keys}""")
    lagcols = ", ".join(f"lag(psi, {l}) OVER w AS l{l}" for l in range(1, lags + 1))
    terms = " + ".join(f"2.0 * (1 - {l} / {lags + 1}.0) * coalesce(sum(psi * l{l}), 0)" for l in range(1, lags + 1))
    oracle.block(f"{name}_h", f"{name}_d {name}_f", f"""
SELECT {keys}, sqrt(sum(psi * psi) + {terms}) AS se FROM (
SELECT {", ".join("d." + k for k in cols)}, psi, {lagcols} FROM (
  SELECT {", ".join("d." + k for k in cols)}, d.day, d.bucket, (d.zy - f.b * d.zx) * d.zx / f.sxx AS psi FROM {name}_d d JOIN {name}_f f ON {on}) d
WINDOW w AS (PARTITION BY {", ".join("d." + k for k in cols)} ORDER BY day, bucket)) d GROUP BY {keys}""")


def table_sql(name: str, keys: str) -> str:
    cols = keys.split(", ")
    on = " AND ".join(f"f.{k} = h.{k}" for k in cols)
    return f"""SELECT {", ".join("f." + k for k in cols)}, f.n, round(f.b, 6) AS beta, round(f.b / h.se, 6) AS z,
round(f.sxy * f.sxy / f.sxx / f.syy, 6) AS partial_r2, round(f.b * f.sdx, 6) AS effect_1sd FROM {name}_f f JOIN {name}_h h ON {on}"""


table_blocks("sst", "ss", "spec", 5)


@register("signal_regressions", "sst_f sst_h", table_sql("sst", "spec"))
def signal_regressions(p):
    return rounded(pr.spec_table(single_rows(p), 1, 5), 6)


@register("signal_regressions_controls")
def signal_regressions_controls(p):
    specs = []
    for h in HORIZONS:
        y = pr.log_return(h)
        for s in ("fqcr", "bqcr"):
            specs.append((f"{s}|h{h}", y, [F.col(s), F.col("agg_cancel"), F.col("touch_ofi")]))
    for h in (5, 10):
        past = pr.log_return(-h)
        specs.append((f"fqcr|past{h}", past, [F.col("fqcr"), F.col("agg_cancel"), F.col("touch_ofi")]))
        specs.append((f"backward|k{h}", F.col("fqcr"), [past, F.col("agg_cancel"), F.col("touch_ofi")]))
    rows = pr.stack(panel(p, "1s").filter("close_mid IS NOT NULL"), specs, KEEP)
    return rounded(pr.spec_table(rows, 3, 5), 6)


@register("cancellation_ladder")
def cancellation_ladder(p):
    """Information of cancellations beyond flow: one control added at a time."""
    ladder = ["agg_cancel", "agr_imb", "obi", "touch_ofi"]
    base = panel(p, "1s").filter("close_mid IS NOT NULL")
    tables = []
    for k in range(1, 5):
        specs = [
            (f"h{h}|{k}", pr.simple_return(h, "close_mid"), [F.col(c) for c in ladder[:k]])
            for h in HORIZONS
        ]
        tables.append(pr.spec_table(pr.stack(base, specs, KEEP), k, 5))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return rounded(out, 6)


# ------------------------------------------------------------------ placebo variants
oracle.block("pv0", "rp_5m sig_5m", f"""
SELECT s.day, s.bucket, s.bucket // 3600000 AS hour, ln(lead(s.close_mid, 1) OVER w / s.close_mid) * 10000 AS y, s.agg_cancel, s.spr,
 CASE WHEN r.deep_wd_vol_bid + r.deep_wd_vol_ask > 0 THEN CAST(r.deep_wd_vol_bid - r.deep_wd_vol_ask AS DOUBLE) / (r.deep_wd_vol_bid + r.deep_wd_vol_ask) ELSE 0.0 END AS deep
FROM sig_5m s JOIN rp_5m r ON r.day = s.day AND r.bucket = s.bucket WHERE s.close_mid IS NOT NULL WINDOW w AS (PARTITION BY s.day ORDER BY s.bucket)""")
oracle.block("pv", "pv0", """
SELECT 'touch' AS spec, day, bucket, hour, y, agg_cancel AS x FROM pv0
UNION ALL SELECT 'deep', day, bucket, hour, y, deep FROM pv0
UNION ALL SELECT 'bid_side', day, bucket, hour, y, agg_cancel FROM pv0 WHERE agg_cancel > 0
UNION ALL SELECT 'ask_side', day, bucket, hour, y, agg_cancel FROM pv0 WHERE agg_cancel < 0
UNION ALL SELECT 'tight', day, bucket, hour, y, agg_cancel FROM pv0 WHERE spr <= (SELECT quantile_cont(spr, 0.5) FROM pv0)
UNION ALL SELECT 'wide', day, bucket, hour, y, agg_cancel FROM pv0 WHERE spr > (SELECT quantile_cont(spr, 0.5) FROM pv0)""")
table_blocks("pvt", "pv", "spec", 5)


@register("placebo_variants", "pvt_f pvt_h", table_sql("pvt", "spec"))
def placebo_variants(p):
    """Deep-book substitute, side split and spread split of the cancellation signal."""
    c = F.col
    deep_total = c("deep_wd_vol_bid") + c("deep_wd_vol_ask")
    deep = F.coalesce(
        F.when(deep_total > 0, (c("deep_wd_vol_bid") - c("deep_wd_vol_ask")) / deep_total), F.lit(0.0)
    )
    base = (
        panel(p, "5m")
        .filter("close_mid IS NOT NULL")
        .withColumn("y", pr.log_return(1))
        .withColumn("deep", deep)
    )
    median = quantiles(base, [], F.col("spr"), (0.5,)).select(F.col("q")[0].alias("_median"))
    rows = base.join(F.broadcast(median))  # one row by construction
    x = c("agg_cancel")
    variants = F.array(
        F.struct(F.lit("touch").alias("spec"), x.alias("x0"), F.lit(True).alias("use")),
        F.struct(F.lit("deep").alias("spec"), c("deep").alias("x0"), F.lit(True).alias("use")),
        F.struct(F.lit("bid_side").alias("spec"), x.alias("x0"), (x > 0).alias("use")),
        F.struct(F.lit("ask_side").alias("spec"), x.alias("x0"), (x < 0).alias("use")),
        F.struct(F.lit("tight").alias("spec"), x.alias("x0"), (c("spr") <= c("_median")).alias("use")),
        F.struct(F.lit("wide").alias("spec"), x.alias("x0"), (c("spr") > c("_median")).alias("use")),
    )
    return rounded(pr.spec_table(rows.select(*KEEP, "y", F.inline(variants)).filter("use"), 1, 5), 6)


oracle.block("rg", "sig_5m", f"""
SELECT CASE WHEN spr <= 1 + 1e-9 THEN 'constrained' ELSE 'unconstrained' END AS regime, s || '|h' || CAST(h AS VARCHAR) AS spec, day, bucket, hour, y, x FROM (
SELECT day, bucket, bucket // 3600000 AS hour, spr, u.h, u.s, CASE u.s WHEN 'fqcr' THEN fqcr ELSE ur_price END AS x,
 CASE u.h WHEN 1 THEN ln(lead(close_mid, 1) {_W.replace('day', 'day, u.h, u.s')} / close_mid) * 10000 ELSE ln(lead(close_mid, 3) {_W.replace('day', 'day, u.h, u.s')} / close_mid) * 10000 END AS y
FROM sig_5m, (SELECT * FROM (VALUES (1, 'fqcr'), (3, 'fqcr'), (1, 'ur_price'), (3, 'ur_price')) t(h, s)) u WHERE close_mid IS NOT NULL)""")
table_blocks("rgt", "rg", "spec, regime", 5)


@register("regime_regressions", "rgt_f rgt_h", table_sql("rgt", "spec, regime"))
def regime_regressions(p):
    base = (
        panel(p, "5m")
        .filter("close_mid IS NOT NULL")
        .withColumn("regime", F.when(F.col("spr") <= 1 + 1e-9, "constrained").otherwise("unconstrained"))
    )
    specs = [
        (f"{s}|h{h}", pr.log_return(h), [F.col(s)]) for s in ("fqcr", "ur_price") for h in (1, 3)
    ]
    rows = pr.stack(base, specs, [*KEEP, "regime"])
    return rounded(pr.spec_table(rows, 1, 5, keys=["spec", "regime"]), 6)


# ------------------------------------------------------------------ price basis, in sample
oracle.block("pb", "rp_5m sig_5m", """
SELECT 'mean_mid|1' AS spec, day, bucket, x, (lead(m, 1) OVER w - m) / m * 10000 AS y FROM (SELECT s.day, s.bucket, s.undercut_signed AS x, r.mid_sum2 / 2.0 / nullif(r.mid_obs, 0) AS m, s.close_mid, s.close_micro FROM sig_5m s JOIN rp_5m r USING (day, bucket)) WINDOW w AS (ORDER BY day, bucket)
UNION ALL SELECT 'mean_mid|3', day, bucket, x, (lead(m, 3) OVER w - m) / m * 10000 FROM (SELECT s.day, s.bucket, s.undercut_signed AS x, r.mid_sum2 / 2.0 / nullif(r.mid_obs, 0) AS m FROM sig_5m s JOIN rp_5m r USING (day, bucket)) WINDOW w AS (ORDER BY day, bucket)
UNION ALL SELECT 'close_mid|1', day, bucket, undercut_signed, (lead(close_mid, 1) OVER w - close_mid) / close_mid * 10000 FROM sig_5m WINDOW w AS (ORDER BY day, bucket)
UNION ALL SELECT 'close_micro|1', day, bucket, undercut_signed, (lead(close_micro, 1) OVER w - close_micro) / close_micro * 10000 FROM sig_5m WINDOW w AS (ORDER BY day, bucket)""")
table_blocks("pbt", "pb", "spec", 3, None)


def basis_rows(p):
    c = F.col
    base = panel(p, "5m").withColumn(
        "mean_mid", F.try_divide(c("mid_sum2") / 2.0, c("mid_obs").cast("double"))
    )
    specs = [
        ("mean_mid|1", pr.simple_return(1, "mean_mid", True), [c("undercut_signed")]),
        ("mean_mid|3", pr.simple_return(3, "mean_mid", True), [c("undercut_signed")]),
        ("close_mid|1", pr.simple_return(1, "close_mid", True), [c("undercut_signed")]),
        ("close_micro|1", pr.simple_return(1, "close_micro", True), [c("undercut_signed")]),
    ]
    return pr.stack(base, specs, KEEP)


@register("in_sample_predictive", "pbt_f pbt_h", table_sql("pbt", "spec"))
def in_sample_predictive(p):
    """Signed undercut share on returns of three price bases (row order across days kept)."""
    return rounded(pr.spec_table(basis_rows(p), 1, 3, None), 6)


# ------------------------------------------------------------------ out of sample
WARMUP = 200
oracle.block("oo", "pb", "SELECT spec, x, y, row_number() OVER (PARTITION BY spec ORDER BY day, bucket) - 1 AS pos FROM pb WHERE x IS NOT NULL AND y IS NOT NULL")
oracle.block("oq", "oo", f"""
SELECT t.spec, t.pos, t.x, t.y, quantile_cont(s.x, 0.01) AS lo, quantile_cont(s.x, 0.99) AS hi, avg(s.y) AS bench
FROM oo t JOIN oo s ON s.spec = t.spec AND s.pos < t.pos WHERE t.pos >= {WARMUP} GROUP BY ALL""")
oracle.block("op", "oo oq", """
SELECT q.spec, q.pos, q.y AS actual, q.bench, regr_intercept(s.y, greatest(q.lo, least(q.hi, s.x))) + regr_slope(s.y, greatest(q.lo, least(q.hi, s.x))) * q.x AS model
FROM oq q JOIN oo s ON s.spec = q.spec AND s.pos < q.pos GROUP BY q.spec, q.pos, q.y, q.bench, q.x""")
oracle.block("of", "op", """
SELECT *, (actual - bench) * (actual - bench) - ((actual - model) * (actual - model) - (bench - model) * (bench - model)) AS f FROM op""")
oracle.block("ofm", "of", "SELECT spec, avg(f) AS m, count(*) AS n, 1 - sum((actual - model) * (actual - model)) / sum((actual - bench) * (actual - bench)) AS r2 FROM of GROUP BY spec")
oracle.block("ofh", "of ofm", """
SELECT spec, sqrt(sum(psi * psi) + 1.5 * coalesce(sum(psi * l1), 0) + 1.0 * coalesce(sum(psi * l2), 0) + 0.5 * coalesce(sum(psi * l3), 0)) AS se FROM (
SELECT spec, psi, lag(psi, 1) OVER w AS l1, lag(psi, 2) OVER w AS l2, lag(psi, 3) OVER w AS l3 FROM (
SELECT o.spec, o.pos, (o.f - m.m) / m.n AS psi FROM of o JOIN ofm m ON m.spec = o.spec) WINDOW w AS (PARTITION BY spec ORDER BY pos)) GROUP BY spec""")


@register(
    "oos_clark_west",
    "ofm ofh",
    "SELECT m.spec, m.n, round(m.r2, 6) AS r2_oos, round(m.m / h.se, 5) AS clark_west FROM ofm m JOIN ofh h ON h.spec = m.spec",
)
def oos_clark_west(p):
    table = pr.clark_west(pr.expanding_predictions(basis_rows(p), WARMUP))
    return table.select("spec", "n", F.round("r2_oos", 6).alias("r2_oos"), F.round("clark_west", 5).alias("clark_west"))


@register("oos_clark_west_controls")
def oos_clark_west_controls(p):
    c = F.col
    base = panel(p, "5m").filter("close_micro IS NOT NULL").withColumn("rel", c("rel_spread"))
    specs = [
        (f"micro|h{h}", pr.simple_return(h, "close_micro"), [c("undercut_signed"), c("rel")]) for h in (1, 3)
    ]
    rows = pr.stack(base, specs, KEEP)
    predicted = p.store.table(
        "oos_predictions", lambda: pr.expanding_predictions(rows, WARMUP, ["x1"], hours=True)
    )
    return rounded(pr.clark_west(predicted).join(pr.hit_rate(predicted), "spec"), 6)


# ------------------------------------------------------------------ shuffle, tails, logit, joint
oracle.block("sp5", "ss", "SELECT spec, day, bucket, hour, y, x FROM ss WHERE x IS NOT NULL AND y IS NOT NULL")
oracle.block("shu", "sp5", f"""
SELECT a.spec, a.rep, a.hour, a.y, b.x FROM (
 SELECT s.*, r.rep, row_number() OVER (PARTITION BY s.spec, r.rep, s.day ORDER BY s.bucket) AS pos FROM sp5 s, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS rep) r) a
JOIN (SELECT s.spec, s.day, s.x, r.rep, row_number() OVER (PARTITION BY s.spec, r.rep, s.day ORDER BY {_hash(SEED, "r.rep", "s.day", "s.bucket")}, s.bucket) AS pos
 FROM sp5 s, (SELECT unnest(range(1, {PERMUTATIONS + 1})) AS rep) r) b ON b.spec = a.spec AND b.rep = a.rep AND b.day = a.day AND b.pos = a.pos
UNION ALL SELECT spec, 0, hour, y, x FROM sp5""")
oracle.block("shb", "shu", """
SELECT spec, rep, abs(sum(zx * y) / sum(zx * zx)) AS b FROM (
SELECT spec, rep, y, x - avg(x) OVER (PARTITION BY spec, rep, hour) AS zx FROM shu) GROUP BY spec, rep""")


@register(
    "placebo_shuffle",
    "shb",
    """SELECT n.spec, round(any_value(r.b), 6) AS abs_beta, round(quantile_cont(n.b, 0.99), 6) AS shuffled_p99,
round(avg(CASE WHEN n.b >= r.b * (1 - 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS p_empirical FROM shb n JOIN shb r ON r.spec = n.spec AND r.rep = 0 WHERE n.rep > 0 GROUP BY n.spec""",
)
def placebo_shuffle(p):
    return rounded(pr.shuffle_placebo(single_rows(p), PERMUTATIONS, SEED), 6)


@register(
    "tail_drift",
    "ss",
    """SELECT s.spec, count(*) AS n, count(*) FILTER (abs(s.x) > q.p90) AS n_tail, round(avg(s.y * sign(s.x)) FILTER (abs(s.x) > q.p90), 6) AS tail_drift,
round(avg(abs(s.y)) FILTER (s.x = 0), 6) AS base_drift FROM ss s JOIN (SELECT spec, quantile_cont(abs(x), 0.9) AS p90 FROM ss WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY spec) q ON q.spec = s.spec
WHERE s.x IS NOT NULL AND s.y IS NOT NULL GROUP BY s.spec""",
)
def tail_drift(p):
    return rounded(pr.tail_drift(single_rows(p)), 6)


@register("logit_move")
def logit_move(p):
    """P(mid moves) on queue runs, flow and aggressor imbalance."""
    rows = p.store.table(
        "logit_rows",
        lambda: panel(p, "1s")
        .filter("close_mid IS NOT NULL")
        .withColumn("ret", pr.log_return(1))
        .filter("ret IS NOT NULL")
        .select("ret", "queue_run", "touch_ofi", "agr_imb"),
    )
    fit = pr.logit(rows, (F.col("ret") != 0), ["queue_run", "touch_ofi", "agr_imb"])
    table = p.spark.createDataFrame(fit, "term string, coefficient double, z double, converged boolean")
    return rounded(table, 6)


@register("lead_lag_joint_f")
def lead_lag_joint_f(p):
    """Joint test of six signal lags after past returns and past flow."""
    base = panel(p, "1m").filter("close_mid IS NOT NULL").withColumn("ret1", pr.log_return(-1))
    rows = pr.lagged(base, "fqcr", range(1, 6))
    rows = pr.lagged(pr.lagged(rows, "ret1", range(1, 6)), "touch_ofi", range(1, 6))
    rows = p.store.table(
        "joint_rows", lambda: rows.withColumn("y", pr.log_return(1)).withColumn("spec", F.lit("fqcr|h1"))
    )
    tested = ["fqcr", *[f"fqcr_l{j}" for j in range(1, 6)]]
    controls = [f"{c}_l{j}" for c in ("ret1", "touch_ofi") for j in range(1, 6)]
    return rounded(pr.joint_test(rows, ["spec"], "y", tested, controls, 3), 6)


# ------------------------------------------------------------------ event study
oracle.block("eg", "tape", f"""
SELECT day, slot, m FROM (SELECT day, (t_ms - {OPEN_MS}) // 100 AS slot, arg_min(CASE WHEN b0 < a0 THEN (b0 + a0) / 2.0 ELSE -1 END, rpt) AS m
FROM tape WHERE t_ms BETWEEN {OPEN_MS} AND {CLOSE_MS} GROUP BY ALL) WHERE m > 0""")
oracle.block("ee", "tape", f"""
SELECT day, rpt, (t_ms - {OPEN_MS}) // 100 AS slot, CASE new_class WHEN 'undercut' THEN 'undercut' ELSE 'join' END AS kind,
 CASE WHEN side = 0 THEN 1 ELSE -1 END AS sgn, (b0 + a0) / 2.0 AS pre, (b + a) / 2.0 AS post
FROM tape WHERE new_class IN ('undercut', 'join_best') AND b0 < a0 AND b < a AND t_ms BETWEEN {OPEN_MS} AND {CLOSE_MS}""")
oracle.block("er", "ee eg", f"""
SELECT e.day, e.rpt, e.slot, e.kind, h.h, e.sgn * (e.post - e.pre) + 0.0 AS mechanical,
 CASE WHEN e.slot + h.h // 100 <= {(CLOSE_MS - OPEN_MS) // 100 + 1} THEN
  e.sgn * ((SELECT arg_max(g.m, g.slot) FROM eg g WHERE g.day = e.day AND g.slot <= e.slot + h.h // 100) - e.post) + 0.0 END AS response
FROM ee e, (SELECT unnest([{", ".join(map(str, pr.EVENT_HORIZONS_MS))}]) AS h) h""")
oracle.block("em", "er", "SELECT kind, h, day, slot // 600 AS minute, avg(response) AS v FROM er WHERE response IS NOT NULL GROUP BY ALL")
oracle.block("emh", "em", """
SELECT kind, h, m / nullif(sqrt(sum(psi * psi) + 2.0 * (2 / 3.0) * coalesce(sum(psi * l1), 0) + 2.0 * (1 / 3.0) * coalesce(sum(psi * l2), 0)), 0) AS t_hac FROM (
SELECT kind, h, m, psi, lag(psi, 1) OVER w AS l1, lag(psi, 2) OVER w AS l2 FROM (
SELECT kind, h, day, minute, avg(v) OVER (PARTITION BY kind, h) AS m, (v - avg(v) OVER (PARTITION BY kind, h)) / count(*) OVER (PARTITION BY kind, h) AS psi FROM em)
WINDOW w AS (PARTITION BY kind, h ORDER BY day, minute)) GROUP BY kind, h, m""")


def responses_of(p):
    return p.store.table("responses", lambda: pr.event_responses(p.tape, OPEN_MS, CLOSE_MS))


@register(
    "event_responses",
    "er",
    "SELECT day, rpt, kind, h, round(mechanical, 9) AS mechanical, round(response, 9) AS response FROM er",
)
def event_responses(p):
    return rounded(responses_of(p).select("day", "rpt", "kind", "h", "mechanical", "response"))


@register(
    "event_study",
    "er emh",
    """SELECT r.kind, r.h, count(*) AS n, round(avg(r.mechanical), 6) AS mechanical, round(avg(r.response), 6) AS mean,
round(avg(r.response) / nullif(stddev_samp(r.response) / sqrt(count(*)), 0), 5) AS t_iid, round(any_value(x.t_hac), 5) AS t_hac, round(any_value(d.t), 5) AS t_day
FROM er r JOIN emh x ON x.kind = r.kind AND x.h = r.h
JOIN (SELECT kind, h, avg(v) / nullif(stddev_samp(v) / sqrt(count(*)), 0) AS t FROM (SELECT kind, h, day, avg(response) AS v FROM er WHERE response IS NOT NULL GROUP BY ALL) GROUP BY kind, h) d ON d.kind = r.kind AND d.h = r.h
WHERE r.response IS NOT NULL GROUP BY r.kind, r.h""",
)
def event_study(p):
    t = pr.event_table(responses_of(p))
    return t.select(
        "kind", "h", "n", F.round("mechanical", 6).alias("mechanical"), F.round("mean", 6).alias("mean"),
        *[F.round(c, 5).alias(c) for c in ("t_iid", "t_hac", "t_day")],
    )


@register(
    "event_excess_minutes",
    "em",
    """SELECT u.h, u.day, u.minute, round(u.v - j.v, 9) AS excess FROM em u JOIN em j ON j.h = u.h AND j.day = u.day AND j.minute = u.minute AND j.kind = 'join' WHERE u.kind = 'undercut'""",
)
def event_excess_minutes(p):
    return rounded(pr.excess_minutes(responses_of(p)))


oracle.block("bbx", "em", """
SELECT u.h, u.day, u.minute, u.v - j.v AS excess FROM em u JOIN em j ON j.h = u.h AND j.day = u.day AND j.minute = u.minute AND j.kind = 'join' WHERE u.kind = 'undercut'""")
oracle.block("bbs", "bbx", f"""
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h, day) AS len FROM bbx) WHERE len >= {BLOCK_MINUTES}""")
oracle.block("bbp", "bbs", f"""
SELECT h, m, row_number() OVER (PARTITION BY h ORDER BY day, minute) - 1 AS i, count(*) OVER (PARTITION BY h) AS pool FROM (
SELECT h, day, minute, avg(excess) OVER w AS m, count(*) OVER w AS whole FROM bbs
WINDOW w AS (PARTITION BY h, day ORDER BY minute ROWS BETWEEN CURRENT ROW AND {BLOCK_MINUTES - 1} FOLLOWING)) WHERE whole = {BLOCK_MINUTES}""")
oracle.block("bbt", "bbs", f"SELECT h, avg(excess) AS mean, count(*) AS minutes, greatest(1, count(*) // {BLOCK_MINUTES}) AS draws FROM bbs GROUP BY h")
oracle.block("bbu", "bbt", f"""
SELECT r.rep, d.d, {_hash(SEED, "r.rep", "d.d")} AS u FROM (SELECT unnest(range(1, {BLOCK_REPS + 1})) AS rep) r, (SELECT unnest(range(1, (SELECT max(draws) FROM bbt) + 1)) AS d) d""")
oracle.block("bbr", "bbt bbu bbp", """
SELECT t.h, u.rep, avg(p.m) AS s FROM bbt t JOIN bbu u ON u.d <= t.draws JOIN (SELECT DISTINCT h, pool FROM bbp) z ON z.h = t.h
JOIN bbp p ON p.h = t.h AND p.i = CAST(floor(u.u * z.pool) AS BIGINT) GROUP BY t.h, u.rep""")


@register(
    "block_bootstrap",
    "bbt bbr",
    """SELECT t.h, round(any_value(t.mean), 6) AS mean, any_value(t.minutes) AS minutes, round(quantile_cont(r.s, 0.025), 6) AS ci_low, round(quantile_cont(r.s, 0.975), 6) AS ci_high,
round(2 * least(avg(CASE WHEN r.s <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN r.s >= 0 THEN 1.0 ELSE 0.0 END)), 6) AS p_value FROM bbt t JOIN bbr r ON r.h = t.h GROUP BY t.h""",
)
def block_bootstrap(p):
    rows = p.store.table("excess", lambda: pr.excess_minutes(responses_of(p)))
    return rounded(pr.block_bootstrap(rows, BLOCK_MINUTES, BLOCK_REPS, SEED), 6)


# ------------------------------------------------------------------ three price bases
BASES = ("mid", "micro", "mid3")
oracle.block("lvh", "msg life", """
SELECT m.day, m.rpt, l.side, l.tick, sum(CASE WHEN l.rc <= m.rpt THEN 3 ELSE l.qty END) AS q
FROM msg m JOIN life l ON l.day = m.day AND l.r0 <= m.rpt AND (l.r1 IS NULL OR l.r1 > m.rpt) GROUP BY ALL""")
oracle.block("lvt", "lvh", """
SELECT *, row_number() OVER (PARTITION BY day, rpt, side ORDER BY CASE side WHEN 0 THEN -tick ELSE tick END) AS place FROM lvh""")
oracle.block("lv3", "tape lvt", """
SELECT t.day, t.rpt, sum(l.q) FILTER (l.side = 0) AS tb, sum(l.q) FILTER (l.side = 1) AS ta,
 CAST(sum(l.q * l.tick) FILTER (l.side = 0) AS DOUBLE) / sum(l.q) FILTER (l.side = 0) AS vb,
 CAST(sum(l.q * l.tick) FILTER (l.side = 1) AS DOUBLE) / sum(l.q) FILTER (l.side = 1) AS va
FROM tape t JOIN lvt l ON l.day = t.day AND l.rpt = t.rpt AND l.place <= 3 GROUP BY t.day, t.rpt""")
oracle.block("tpp", "tape lv3", """
SELECT *, lag(mid) OVER w AS mid0, lag(micro) OVER w AS micro0, lag(mid3) OVER w AS mid30 FROM (
SELECT t.*, CASE WHEN b < a THEN (b + a) / 2.0 END AS mid, CASE WHEN b < a THEN CAST(qb * a + qa * b AS DOUBLE) / (qb + qa) END AS micro,
 CASE WHEN b < a THEN (tb * va + ta * vb) / (tb + ta) END AS mid3 FROM tape t LEFT JOIN lv3 l ON l.day = t.day AND l.rpt = t.rpt)
WINDOW w AS (PARTITION BY day ORDER BY rpt)""")
for _b in BASES:
    oracle.block(f"g_{_b}", "tpp", f"""
SELECT day, slot, m FROM (SELECT day, (t_ms - {OPEN_MS}) // 100 AS slot, arg_min(coalesce({_b}0, -1), rpt) AS m
FROM tpp WHERE t_ms BETWEEN {OPEN_MS} AND {CLOSE_MS} GROUP BY ALL) WHERE m > 0""")
    oracle.block(f"r_{_b}", f"tpp g_{_b}", f"""
SELECT '{_b}' AS basis, e.day, e.rpt, e.slot, e.kind, h.h, e.sgn * (e.post - e.pre) + 0.0 AS mechanical,
 CASE WHEN e.slot + h.h // 100 <= {(CLOSE_MS - OPEN_MS) // 100 + 1} THEN
  e.sgn * ((SELECT arg_max(g.m, g.slot) FROM g_{_b} g WHERE g.day = e.day AND g.slot <= e.slot + h.h // 100) - e.post) + 0.0 END AS response
FROM (SELECT day, rpt, (t_ms - {OPEN_MS}) // 100 AS slot, CASE new_class WHEN 'undercut' THEN 'undercut' ELSE 'join' END AS kind,
 CASE WHEN side = 0 THEN 1 ELSE -1 END AS sgn, {_b}0 AS pre, {_b} AS post FROM tpp
 WHERE new_class IN ('undercut', 'join_best') AND {_b}0 IS NOT NULL AND {_b} IS NOT NULL AND t_ms BETWEEN {OPEN_MS} AND {CLOSE_MS}) e,
 (SELECT unnest([{", ".join(map(str, pr.EVENT_HORIZONS_MS))}]) AS h) h""")
oracle.block("rb", " ".join(f"r_{b}" for b in BASES), " UNION ALL ".join(f"SELECT * FROM r_{b}" for b in BASES))
oracle.block("rbm", "rb", "SELECT basis, kind, h, day, slot // 600 AS minute, avg(response) AS v FROM rb WHERE response IS NOT NULL GROUP BY ALL")
oracle.block("rbh", "rbm", """
SELECT basis, kind, h, m / nullif(sqrt(sum(psi * psi) + 2.0 * (2 / 3.0) * coalesce(sum(psi * l1), 0) + 2.0 * (1 / 3.0) * coalesce(sum(psi * l2), 0)), 0) AS t_hac FROM (
SELECT basis, kind, h, m, psi, lag(psi, 1) OVER w AS l1, lag(psi, 2) OVER w AS l2 FROM (
SELECT basis, kind, h, day, minute, avg(v) OVER g AS m, (v - avg(v) OVER g) / count(*) OVER g AS psi FROM rbm WINDOW g AS (PARTITION BY basis, kind, h))
WINDOW w AS (PARTITION BY basis, kind, h ORDER BY day, minute)) GROUP BY basis, kind, h, m""")


def basis_responses(p):
    def build():
        out = None
        for basis in BASES:
            part = pr.event_responses(
                p.priced_tape, OPEN_MS, CLOSE_MS, before=F.col(f"{basis}0"), after=F.col(basis)
            ).withColumn("basis", F.lit(basis))
            out = part if out is None else out.unionByName(part)
        return out

    return p.store.table("basis_responses", build)


@register(
    "event_study_bases",
    "rb rbh",
    """SELECT r.basis, r.kind, r.h, count(*) AS n, round(avg(r.mechanical), 6) AS mechanical, round(avg(r.response), 6) AS mean,
round(avg(r.response) / nullif(stddev_samp(r.response) / sqrt(count(*)), 0), 4) AS t_iid, round(any_value(x.t_hac), 4) AS t_hac, round(any_value(d.t), 4) AS t_day
FROM rb r JOIN rbh x ON x.basis = r.basis AND x.kind = r.kind AND x.h = r.h
JOIN (SELECT basis, kind, h, avg(v) / nullif(stddev_samp(v) / sqrt(count(*)), 0) AS t FROM (SELECT basis, kind, h, day, avg(response) AS v FROM rb WHERE response IS NOT NULL GROUP BY ALL) GROUP BY ALL) d
 ON d.basis = r.basis AND d.kind = r.kind AND d.h = r.h
WHERE r.response IS NOT NULL GROUP BY r.basis, r.kind, r.h""",
)
def event_study_bases(p):
    """The event study on mid, microprice and three-level mid."""
    t = pr.event_table(basis_responses(p), ["basis", "kind", "h"])
    return t.select(
        "basis", "kind", "h", "n", F.round("mechanical", 6).alias("mechanical"), F.round("mean", 6).alias("mean"),
        *[F.round(c, 4).alias(c) for c in ("t_iid", "t_hac", "t_day")],
    )


@register(
    "closing_prices_5m",
    "tpp",
    """SELECT day, CAST(t_ms // 300000 * 300000 AS BIGINT) AS bucket, arg_max(mid, CASE WHEN mid IS NOT NULL THEN rpt END) AS close_mid,
round(arg_max(micro, CASE WHEN micro IS NOT NULL THEN rpt END), 9) AS close_micro, round(arg_max(mid3, CASE WHEN mid3 IS NOT NULL THEN rpt END), 9) AS close_mid3 FROM tpp GROUP BY ALL""",
)
def closing_prices_5m(p):
    """The three prices standing when each five minutes close."""
    bucket = (F.floor(F.col("t_ms") / 300_000) * 300_000).alias("bucket")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rpt"))).alias(f"close_{c}")
    return rounded(p.priced_tape.groupBy("day", bucket).agg(*[last(c) for c in BASES]))


# ------------------------------------------------------------------ clock-ordered panel
oracle.block("ckr", "fe", """
SELECT *, t_ms // 300000 * 300000 AS bucket FROM fe""")
oracle.block("ckf", "ckr", """
SELECT *, last_value(CASE WHEN side = 0 THEN price END IGNORE NULLS) OVER u AS bid, last_value(CASE WHEN side = 1 THEN price END IGNORE NULLS) OVER u AS ask,
 last_value(CASE WHEN side = 0 THEN price END IGNORE NULLS) OVER v AS bid0, last_value(CASE WHEN side = 1 THEN price END IGNORE NULLS) OVER v AS ask0
FROM ckr WINDOW u AS (PARTITION BY day, bucket ORDER BY rpt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 v AS (PARTITION BY day, bucket ORDER BY rpt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
oracle.block("ckp", "ckf", """
SELECT day, bucket, count(*) FILTER (action = 0 AND ((side = 0 AND price > bid0) OR (side = 1 AND price < ask0))) AS undercuts, count(*) AS messages,
 avg(ask - bid) FILTER (ask > bid) AS spread_mean, avg((bid + ask) / 2.0) AS mid_mean, stddev_samp((bid + ask) / 2.0) AS mid_sd FROM ckf GROUP BY day, bucket""")


def clock_rows(p):
    return p.store.table("clock_panel", lambda: ck.clock_panel(fd.thesis_rows(feed_of(p), 1)))


@register(
    "clock_panel_5m",
    "ckp",
    """SELECT day, bucket, undercuts, messages, round(spread_mean, 9) AS spread_mean, round(mid_mean, 6) AS mid_mean, round(mid_sd, 6) AS mid_sd,
round(spread_mean / mid_mean, 9) AS rel_spread, round(CAST(undercuts AS DOUBLE) / messages, 9) AS undercut_share FROM ckp""",
)
def clock_panel_5m(p):
    r = clock_rows(p)
    return r.select(
        "day", "bucket", "undercuts", "messages", F.round("spread_mean", 9).alias("spread_mean"),
        F.round("mid_mean", 6).alias("mid_mean"), F.round("mid_sd", 6).alias("mid_sd"),
        F.round("rel_spread", 9).alias("rel_spread"), F.round("undercut_share", 9).alias("undercut_share"),
    )


oracle.block("ckw", "ckp", "SELECT *, spread_mean / mid_mean AS x, CAST(undercuts AS DOUBLE) / messages AS y FROM ckp WHERE spread_mean > 5 AND spread_mean / mid_mean IS NOT NULL")


@register(
    "residual_daily_slope",
    "ckw",
    """SELECT w.day, w.bucket, round(w.y - (f.a + f.b * w.x), 9) AS residual FROM ckw w
JOIN (SELECT day, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ckw GROUP BY day) f ON f.day = w.day AND f.n >= 10""",
)
def residual_daily_slope(p):
    rows = rs.daily_slope(ck.wide_windows(clock_rows(p)), "undercut_share", "rel_spread")
    return rounded(rows.select("day", "bucket", "residual"))
