"""Queries of the message-level replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.operators import tape as tp
from tickloom.plans import replay_panel as rp
from tickloom.queries import register, rounded

# ------------------------------------------------------------------ oracle blocks
oracle.block("life", "msg", """
SELECT day, oid, max(rpt) FILTER (typ = 'N') AS r0, max(rpt) FILTER (typ = 'C') AS rc,
       max(rpt) FILTER (typ = 'D') AS r1, max(t_ms) FILTER (typ = 'N') AS t0,
       max(side) FILTER (typ = 'N') AS side, max(tick) FILTER (typ = 'N') AS tick,
       max(qty) FILTER (typ = 'N') AS qty
FROM msg WHERE typ <> 'T' GROUP BY day, oid""")
oracle.block("mq", "msg life", """
SELECT m.day, m.rpt, max(l.tick) FILTER (l.side = 0) AS b, min(l.tick) FILTER (l.side = 1) AS a
FROM msg m LEFT JOIN life l ON l.day = m.day AND l.r0 <= m.rpt AND (l.r1 IS NULL OR l.r1 > m.rpt)
GROUP BY ALL""")
oracle.block("mqs", "mq life", """
SELECT q.day, q.rpt, q.b, q.a,
       sum(CASE WHEN l.rc <= q.rpt THEN 3 ELSE l.qty END) FILTER (l.side = 0 AND l.tick = q.b) AS qb,
       sum(CASE WHEN l.rc <= q.rpt THEN 3 ELSE l.qty END) FILTER (l.side = 1 AND l.tick = q.a) AS qa
FROM mq q LEFT JOIN life l ON l.day = q.day AND l.r0 <= q.rpt AND (l.r1 IS NULL OR l.r1 > q.rpt)
GROUP BY ALL""")
oracle.block("tp0", "msg mqs life", """
SELECT m.day, m.seq, m.rpt, m.t_ms, m.typ, m.side, m.tick, m.qty, m.oid, m.firm, q.b, q.a, q.qb, q.qa,
       lag(q.b) OVER w AS b0, lag(q.a) OVER w AS a0, lag(q.qb) OVER w AS qb0, lag(q.qa) OVER w AS qa0,
       lag(m.t_ms) OVER w AS t0,
       CASE WHEN m.typ <> 'N' AND m.typ <> 'T' THEN l.tick END AS p_tick,
       CASE WHEN m.typ = 'D' THEN m.qty WHEN m.typ = 'C' THEN l.qty END AS p_qty,
       CASE WHEN m.typ = 'D' THEN m.t_ms - l.t0 END AS life_ms,
       max(CASE WHEN m.typ = 'T' THEN m.rpt END) OVER (PARTITION BY m.day ORDER BY m.rpt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t
FROM msg m JOIN mqs q ON q.day = m.day AND q.rpt = m.rpt
LEFT JOIN life l ON l.day = m.day AND l.oid = m.oid
WINDOW w AS (PARTITION BY m.day ORDER BY m.rpt)""")
oracle.block("tape", "tp0", """
SELECT t.*, CASE WHEN t.typ = 'T' THEN CASE WHEN t.tick >= t.a0 AND t.b0 IS NOT NULL THEN 0 WHEN t.tick <= t.b0 AND t.a0 IS NOT NULL THEN 1 ELSE -1 END END AS print_side,
       CASE WHEN t.typ <> 'N' THEN NULL
            WHEN t.b0 IS NULL OR t.a0 IS NULL THEN 'no_reference'
            WHEN (t.side = 0 AND t.tick >= t.a0) OR (t.side = 1 AND t.tick <= t.b0) THEN 'aggressive'
            WHEN (t.side = 0 AND t.tick > t.b0) OR (t.side = 1 AND t.tick < t.a0) THEN
              CASE WHEN t.rpt - p.rpt - 1 < 3 AND (CASE WHEN p.tick >= p.a0 AND p.b0 IS NOT NULL THEN 0 WHEN p.tick <= p.b0 AND p.a0 IS NOT NULL THEN 1 ELSE -1 END) = t.side
                   THEN 'undercut_ambiguous' ELSE 'undercut' END
            WHEN (t.side = 0 AND t.tick = t.b0) OR (t.side = 1 AND t.tick = t.a0) THEN 'join_best'
            ELSE 'behind_best' END AS new_class,
       CASE WHEN t.typ = 'D' THEN CASE WHEN coalesce((t.side = 0 AND t.p_tick = t.b0) OR (t.side = 1 AND t.p_tick = t.a0), false) THEN 'touch' ELSE 'deep' END END AS withdrawal,
       CASE WHEN t.typ = 'N' AND t.a0 - t.b0 > 0 AND t.a - t.b > 0 THEN
            CASE WHEN t.a - t.b < t.a0 - t.b0 THEN 'narrowed' WHEN t.a - t.b = t.a0 - t.b0 THEN 'unchanged' ELSE 'widened' END END AS spread_effect,
       coalesce(t.typ = 'D' AND t.a0 - t.b0 >= 0 AND coalesce(t.a - t.b, -1) > t.a0 - t.b0, false) AS delete_widens
FROM tp0 t LEFT JOIN tp0 p ON p.day = t.day AND p.rpt = t.last_t""")
oracle.block("tq", "tape life", """
SELECT t.day, t.rpt, t.t_ms, t.side, t.p_tick AS tick, t.p_qty AS qty, t.oid,
       coalesce(sum(CASE WHEN l.rc < t.rpt THEN 3 ELSE l.qty END) FILTER (l.r0 < o.r0), 0) AS ahead,
       sum(CASE WHEN l.rc < t.rpt THEN 3 ELSE l.qty END) AS total
FROM tape t JOIN life o ON o.day = t.day AND o.oid = t.oid
JOIN life l ON l.day = t.day AND l.side = o.side AND l.tick = o.tick AND l.r0 < t.rpt AND (l.r1 IS NULL OR l.r1 >= t.rpt)
WHERE t.withdrawal = 'touch' GROUP BY ALL""")
oracle.block("tqz", "tq", """
SELECT *, CAST(ahead AS DOUBLE) / total AS share,
       CASE WHEN CAST(ahead AS DOUBLE) / total <= 0.2 THEN 'front' WHEN CAST(ahead AS DOUBLE) / total > 0.8 THEN 'back' ELSE 'middle' END AS queue_zone
FROM tq""")
oracle.block("sweep", "tape", """
SELECT day, arg_min(t_ms, rpt) AS t_ms, arg_min(print_side, rpt) AS print_side, min(rpt) AS sweep, count(*) AS prints,
       sum(qty) AS volume, max(tick) - min(tick) AS ticks_crossed
FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY rpt) AS grp
      FROM (SELECT *, coalesce(lag(t_ms) OVER w <> t_ms OR lag(print_side) OVER w <> print_side, true) AS new
            FROM tape WHERE typ = 'T' WINDOW w AS (PARTITION BY day ORDER BY rpt)))
GROUP BY day, grp""")
oracle.block("urun", "tape", """
SELECT day, run, side, length, volume, booked_ms FROM (
  SELECT day, grp, min(rpt) AS run, any_value(side) AS side, count(*) AS length, sum(qty) AS volume,
         lead(min(t_ms)) OVER (PARTITION BY day ORDER BY grp) AS booked_ms
  FROM (SELECT *, sum(CASE WHEN side <> ps THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY rpt) AS grp
        FROM (SELECT *, lag(side) OVER (PARTITION BY day ORDER BY rpt) AS ps FROM tape WHERE new_class IN ('undercut', 'undercut_ambiguous')))
  GROUP BY day, grp) WHERE booked_ms IS NOT NULL""")
oracle.block("crun", "tape tqz", """
SELECT day, run, side, length, volume, booked_ms FROM (
  SELECT day, grp, min(rpt) AS run, bool_and(front) AS front, any_value(side) AS side, count(*) AS length, sum(qty) AS volume,
         lead(min(t_ms)) OVER (PARTITION BY day ORDER BY grp) AS booked_ms
  FROM (SELECT *, sum(CASE WHEN front AND pf AND side = ps AND t_ms - pt <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY day ORDER BY rpt) AS grp
        FROM (SELECT *, lag(front) OVER w AS pf, lag(side) OVER w AS ps, lag(t_ms) OVER w AS pt
              FROM (SELECT day, rpt, t_ms, side, qty, true AS front FROM tqz WHERE queue_zone = 'front'
                    UNION ALL SELECT day, rpt, t_ms, side, qty, false FROM tape WHERE typ = 'T')
              WINDOW w AS (PARTITION BY day ORDER BY rpt)))
  GROUP BY day, grp) WHERE front AND booked_ms IS NOT NULL""")
oracle.block("naive", "tape", """
SELECT day, rpt, t_ms, side, typ = 'N' AND coalesce(nb < tick AND tick < na, false) AS naive_undercut, nb AS naive_bid, na AS naive_ask
FROM (SELECT *, last_value(CASE WHEN side = 0 AND typ <> 'D' THEN tick END IGNORE NULLS) OVER w AS nb,
             last_value(CASE WHEN side = 1 AND typ <> 'D' THEN tick END IGNORE NULLS) OVER w AS na
      FROM tape WHERE typ <> 'T' WINDOW w AS (PARTITION BY day ORDER BY rpt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")


@register(
    "message_tape",
    "tape",
    """SELECT day, rpt, t_ms, typ, b0, a0, CAST(qb0 AS BIGINT) AS qb0, CAST(qa0 AS BIGINT) AS qa0, b, a,
CAST(qb AS BIGINT) AS qb, CAST(qa AS BIGINT) AS qa, p_tick, p_qty, life_ms FROM tape""",
)
def message_tape(p):
    return p.tape.select(
        "day", "rpt", "t_ms", "typ", "b0", "a0", "qb0", "qa0", "b", "a", "qb", "qa", "p_tick", "p_qty", "life_ms"
    )


@register(
    "new_order_class",
    "tape",
    """SELECT day, rpt, side, tick, new_class, CASE WHEN new_class IN ('join_best', 'behind_best') THEN CASE WHEN side = 0 THEN b0 - tick ELSE tick - a0 END END AS landing,
spread_effect FROM tape WHERE typ = 'N'""",
)
def new_order_class(p):
    return p.tape.filter("typ = 'N'").select(
        "day", "rpt", "side", "tick", "new_class", "landing", "spread_effect"
    )


@register(
    "landing_depth_histogram",
    "tape",
    """SELECT day, side, bucket, count(*) AS n FROM (
SELECT day, side, CASE WHEN d <= 5 THEN CAST(d AS VARCHAR) WHEN d <= 10 THEN '6-10' WHEN d <= 20 THEN '11-20' WHEN d <= 50 THEN '21-50' WHEN d <= 100 THEN '51-100' ELSE '100+' END AS bucket
FROM (SELECT day, side, CASE WHEN side = 0 THEN b0 - tick ELSE tick - a0 END AS d FROM tape WHERE new_class IN ('join_best', 'behind_best')))
GROUP BY ALL""",
)
def landing_depth_histogram(p):
    return (
        p.tape.filter("landing IS NOT NULL")
        .groupBy("day", "side", tp.landing_bucket(F.col("landing")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


@register(
    "withdrawals",
    "tape",
    "SELECT day, rpt, side, withdrawal, CAST(p_qty AS BIGINT) AS p_qty, life_ms, delete_widens FROM tape WHERE typ = 'D'",
)
def withdrawals(p):
    return p.tape.filter("typ = 'D'").select(
        "day", "rpt", "side", "withdrawal", "p_qty", "life_ms", "delete_widens"
    )


@register(
    "change_class",
    "tape",
    "SELECT day, rpt, side, 'size_only' AS change_class FROM tape WHERE typ = 'C'",
)
def change_class(p):
    return p.tape.filter("typ = 'C'").select("day", "rpt", "side", "change_class")


@register(
    "sweeps",
    "sweep",
    "SELECT day, sweep, t_ms, print_side, prints, CAST(volume AS BIGINT) AS volume, ticks_crossed FROM sweep",
)
def sweeps(p):
    return tp.sweeps(p.tape).drop("sid")


@register(
    "undercut_runs",
    "urun",
    "SELECT day, run, side, length, CAST(volume AS BIGINT) AS volume, booked_ms FROM urun",
)
def undercut_runs(p):
    return tp.undercut_runs(p.tape).drop("sid")


@register(
    "queue_position",
    "tqz",
    """SELECT day, rpt, side, tick, CAST(ahead AS BIGINT) AS ahead, CAST(total AS BIGINT) AS level_total,
CAST(round_even(share * 10000, 0) AS BIGINT) AS position_bp, queue_zone FROM tqz""",
)
def queue_position(p):
    return p.queue.select(
        "day", "rpt", "side", "tick", "ahead", "level_total", "position_bp", "queue_zone"
    )


@register(
    "cancel_runs",
    "crun",
    "SELECT day, run, side, length, CAST(volume AS BIGINT) AS volume, booked_ms FROM crun",
)
def cancel_runs(p):
    return tp.cancel_runs(p.queue, p.tape).drop("sid")


@register(
    "naive_top_of_book",
    "naive",
    "SELECT day, rpt, naive_bid, naive_ask, naive_undercut FROM naive",
)
def naive_top_of_book(p):
    return tp.naive_best(p.tape).select("day", "rpt", "naive_bid", "naive_ask", "naive_undercut")


# ------------------------------------------------------------------ fine panel
def _side(name: str, cond: str, amount: str = "1") -> dict[str, str]:
    return {
        f"{name}_{lab}": f"coalesce(sum({amount}) FILTER (side = {code} AND {cond}), 0)"
        for lab, code in rp.SIDES
    }


_TAPE_SQL = {
    "msg_total": "count(*)",
    **_side("new", "typ = 'N'"),
    **_side("new_vol", "typ = 'N'", "qty"),
    **_side("undercut", "new_class IN ('undercut', 'undercut_ambiguous')"),
    **_side("undercut_resid", "new_class = 'undercut_ambiguous'"),
    **_side("uc_strict_vol", "new_class = 'undercut'", "qty"),
    **_side("uc_amb_vol", "new_class = 'undercut_ambiguous'", "qty"),
    **_side("join_best", "new_class = 'join_best'"),
    **_side("behind_best", "new_class = 'behind_best'"),
    **_side("aggressive", "new_class = 'aggressive'"),
    **_side("no_reference", "new_class = 'no_reference'"),
    **_side("touch_add_vol", "typ = 'N' AND tick = CASE WHEN side = 0 THEN b ELSE a END", "qty"),
    **_side("touch_cancel_n", "withdrawal = 'touch'"),
    **_side("touch_life", "withdrawal = 'touch'", "life_ms"),
    **_side("touch_wd_vol", "withdrawal = 'touch'", "p_qty"),
    **_side("deep_wd_vol", "withdrawal = 'deep'", "p_qty"),
    "spread_narrowed": "count(*) FILTER (spread_effect = 'narrowed')",
    "spread_unchanged": "count(*) FILTER (spread_effect = 'unchanged')",
    "spread_widened_by_new": "count(*) FILTER (spread_effect = 'widened')",
    "deletes_widening_spread": "count(*) FILTER (delete_widens)",
    "reprice_total": "count(*) FILTER (typ = 'C')",
    "reprice_size_only": "count(*) FILTER (typ = 'C')",
    "trade_count": "count(*) FILTER (typ = 'T')",
    "trade_volume": "coalesce(sum(qty) FILTER (typ = 'T'), 0)",
    "landing_n": "count(*) FILTER (new_class IN ('join_best', 'behind_best'))",
    "landing_ticks": "coalesce(sum(CASE WHEN side = 0 THEN b0 - tick ELSE tick - a0 END) FILTER (new_class IN ('join_best', 'behind_best')), 0)",
    "mid_obs": "count(*) FILTER (b0 < a0)",
    "mid_sum2": "coalesce(sum(b0 + a0) FILTER (b0 < a0), 0)",
    "mid_sq4": "coalesce(sum((b0 + a0) * (b0 + a0)) FILTER (b0 < a0), 0)",
    "spread_sum": "coalesce(sum(a0 - b0) FILTER (b0 < a0), 0)",
    "touch_depth_bid": "coalesce(sum(qb0) FILTER (b0 < a0), 0)",
    "touch_depth_ask": "coalesce(sum(qa0) FILTER (b0 < a0), 0)",
}
_QUEUE_SQL = {
    **_side("fq_wd", "queue_zone = 'front'", "qty"),
    **_side("bq_wd", "queue_zone = 'back'", "qty"),
    **_side("qp_sum", "true", "CAST(round_even(share * 10000, 0) AS BIGINT)"),
    **_side("qp_n", "true"),
}
_SWEEP_SQL = {
    f"sweep_{lab}": f"count(*) FILTER (print_side = {code})" for lab, code in rp.SIDES
}
_UR_SQL = {**_side("ur_run_n", "true"), **_side("ur_run_len", "true", "length")}
_CR_SQL = {**_side("qcr_n", "true"), **_side("qcr_len", "true", "length")}
_NV_SQL = _side("naive_undercut", "naive_undercut")
_SP_SQL = {
    **{
        (f"spread_ms_{s}" if s < 4 else "spread_ms_4p"): (
            f"coalesce(sum(t_ms - t0) FILTER (t_ms - t0 <= 2000 AND least(a0 - b0, 4) = {s}), 0)"
        )
        for s in (1, 2, 3, 4)
    },
    "spread_ms_dropped": "coalesce(sum(t_ms - t0) FILTER (t_ms - t0 > 2000), 0)",
}
_SOURCES = [
    ("tape", "t_ms", "true", _TAPE_SQL),
    ("tqz", "t_ms", "true", _QUEUE_SQL),
    ("sweep", "t_ms", "true", _SWEEP_SQL),
    ("urun", "booked_ms", "true", _UR_SQL),
    ("crun", "booked_ms", "true", _CR_SQL),
    ("naive", "t_ms", "naive_undercut", _NV_SQL),
    ("tape", "t0", "t_ms > t0 AND a0 > b0", _SP_SQL),
]
COUNTERS = [c for s in _SOURCES for c in s[3]]
SIZES = {"1s": 1_000, "1m": 60_000, "5m": 300_000}

for _label, _ms in SIZES.items():
    _parts, _cols, _joins = [], [], []
    for _i, (_src, _t, _cond, _exprs) in enumerate(_SOURCES):
        _parts.append(
            f"(SELECT day, {_t} // {_ms} * {_ms} AS bucket, "
            + ", ".join(f"{e} AS {c}" for c, e in _exprs.items())
            + f" FROM {_src} WHERE {_cond} GROUP BY ALL) s{_i}"
        )
        _cols += [f"CAST(coalesce(s{_i}.{c}, 0) AS BIGINT) AS {c}" for c in _exprs]
        if _i:
            _joins.append(
                f"LEFT JOIN {_parts[_i]} ON s{_i}.day = s0.day AND s{_i}.bucket = s0.bucket"
            )
    oracle.block(
        f"rp_{_label}",
        "tape tqz sweep urun crun naive",
        f"""SELECT s0.day, CAST(1 AS BIGINT) AS sid, s0.bucket, {", ".join(_cols)}, c.close_mid, c.close_micro, c.last_trade
FROM {_parts[0]} {" ".join(_joins)}
LEFT JOIN (SELECT day, t_ms // {_ms} * {_ms} AS bucket,
  arg_max((b + a) / 2.0, rpt) FILTER (b < a) AS close_mid,
  arg_max(CAST(qb * a + qa * b AS DOUBLE) / (qb + qa), rpt) FILTER (b < a AND qb > 0 AND qa > 0) AS close_micro,
  arg_max(tick, rpt) FILTER (typ = 'T') AS last_trade
  FROM tape GROUP BY ALL) c ON c.day = s0.day AND c.bucket = s0.bucket""",
    )


def replay_panel_of(p, label: str):
    if label == "1s":
        return p.store.table(
            "replay_1s", lambda: rp.replay_panel(p.tape, p.queue, SIZES["1s"])
        )
    return p.store.table(
        f"replay_{label}", lambda: rp.coarser(replay_panel_of(p, "1s"), SIZES[label])
    )


def _register(label: str) -> None:
    @register(
        f"replay_panel_{label}",
        f"rp_{label}",
        f"""SELECT day, sid, bucket, {", ".join(COUNTERS)}, round(close_mid, 9) AS close_mid, round(close_micro, 9) AS close_micro, last_trade FROM rp_{label}""",
    )
    def panel(p):
        return rounded(
            replay_panel_of(p, label).select(
                "day", "sid", "bucket", *COUNTERS, "close_mid", "close_micro", "last_trade"
            )
        )


for _label in SIZES:
    _register(_label)

_WD = "(touch_wd_vol_bid + touch_wd_vol_ask)"


def _z(n: str, d: str, k: int = 1) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) * {k} ELSE 0.0 END"


SIGNAL_SQL = {
    "ur_price": _z("(ur_run_len_bid - ur_run_len_ask)", "new_vol_bid + new_vol_ask", 1000),
    "fqcr": _z("(fq_wd_bid - fq_wd_ask)", _WD),
    "bqcr": _z("(bq_wd_bid - bq_wd_ask)", _WD),
    "agg_cancel": _z("(touch_wd_vol_bid - touch_wd_vol_ask)", _WD),
    "queue_run": _z("(qcr_len_bid - qcr_len_ask)", _WD, 100),
    "touch_ofi": _z(
        "(touch_add_vol_bid - touch_wd_vol_bid - touch_add_vol_ask + touch_wd_vol_ask)",
        f"touch_add_vol_bid + touch_add_vol_ask + {_WD}",
    ),
    "agr_imb": _z("(sweep_bid - sweep_ask)", "sweep_bid + sweep_ask"),
    "obi": "close_micro - close_mid",
    "spr": "CAST(spread_sum AS DOUBLE) / nullif(mid_obs, 0)",
    "undercut_signed": "CASE WHEN new_vol_bid + new_vol_ask > 0 THEN CAST(uc_strict_vol_bid - uc_strict_vol_ask AS DOUBLE) / (new_vol_bid + new_vol_ask) END",
    "rel_spread": "(CAST(spread_sum AS DOUBLE) / nullif(mid_obs, 0)) / (mid_sum2 / 2.0 / nullif(mid_obs, 0))",
}
for _label in SIZES:
    oracle.block(
        f"sig_{_label}",
        f"rp_{_label}",
        f"""SELECT day, sid, bucket, close_mid, close_micro, {", ".join(f"{e} AS {c}" for c, e in SIGNAL_SQL.items())}
FROM rp_{_label} WHERE bucket // 60000 BETWEEN 540 AND 1080""",
    )


def signals_of(p, label: str):
    return rp.in_session(
        rp.touch_signals(replay_panel_of(p, label)), SIZES[label]
    )


@register(
    "touch_signals_5m",
    "sig_5m",
    f"""SELECT day, sid, bucket, {", ".join(f"round({c}, 9) AS {c}" for c in SIGNAL_SQL)} FROM sig_5m""",
)
def touch_signals_5m(p):
    return rounded(signals_of(p, "5m").select("day", "sid", "bucket", *SIGNAL_SQL))


@register(
    "replay_report",
    "rp_1m",
    """SELECT day, sid, CAST(sum(msg_total) AS BIGINT) AS messages, CAST(sum(new_bid + new_ask) AS BIGINT) AS new_orders,
CAST(sum(undercut_bid + undercut_ask) AS BIGINT) AS undercuts, CAST(sum(undercut_resid_bid + undercut_resid_ask) AS BIGINT) AS ambiguous,
CAST(sum(naive_undercut_bid + naive_undercut_ask) AS BIGINT) AS naive_undercuts, CAST(sum(spread_narrowed) AS BIGINT) AS narrowed,
CAST(sum(trade_count) AS BIGINT) AS trades, CAST(0 AS BIGINT) AS orphan_deletes, CAST(0 AS BIGINT) AS orphan_changes,
CAST(0 AS BIGINT) AS negative_sizes, CAST(sum(spread_narrowed) - sum(undercut_bid + undercut_ask) AS BIGINT) AS narrowed_minus_undercut
FROM rp_1m GROUP BY day, sid""",
)
def replay_report(p):
    return rp.daily_report(replay_panel_of(p, "1m"), p.tape, p.replay_log)
