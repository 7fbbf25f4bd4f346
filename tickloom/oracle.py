"""Equivalent SQL of the registered queries, written from the rules rather than from the
Spark plans: best quotes by order lifetimes, look-backs by range joins, slots by EXISTS."""

from __future__ import annotations

# Named building blocks: (blocks they need, SQL).
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, needs: str, sql: str) -> None:
    BLOCKS[name] = (tuple(needs.split()), sql.strip())


def statement(needs: str, final: str, instead: dict[str, str] | None = None) -> str:
    """WITH clause of the needed blocks in dependency order, then ``final``.

    ``instead`` gives other SQL for blocks, which may read what the block itself needs.
    """
    instead = instead or {}
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in BLOCKS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    recursive = "RECURSIVE " if any("UNION ALL /*rec*/" in BLOCKS[n][1] for n in order) else ""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({instead.get(n, BLOCKS[n][1])})" for n in order)
    return f"WITH {recursive}{ctes}\n{final.strip()}"


block("num", "", """
SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day,
       row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS n,
       count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS cnt,
       epoch_us(ts) // 1000 % 86400000 AS of_day,
       event_id, user_id, event_type
FROM events""")

block("pk", "num", """
SELECT day, n, cnt,
       CAST(32400000 + (of_day // 2400000) * 900000
            + (of_day % 2400000) * (of_day % 2400000) // 2400000 * (of_day % 2400000) // 2400000
              * 8000 // 2400000 AS BIGINT) AS t_ms
FROM num""")

block("ord0", "num", """
SELECT day, n, cnt, event_id AS oid, user_id AS firm, event_type,
       CAST((event_id * 2654435 // 1000) % 2 AS INTEGER) AS side, 1 + event_id % 5 AS qty,
       CASE WHEN (event_id * 2654435 // 1000) % 2 = 0 THEN 1000 - (event_id * 40503 // 64) % 4
            ELSE 1001 + (event_id * 30011 // 128) % 4 END AS tick,
       CASE WHEN n + 2 + (event_id * 48271 // 256) % 11 < cnt
            THEN n + 2 + (event_id * 48271 // 256) % 11 END AS n_end,
       event_type IN ('purchase', 'click') AS executed
FROM num""")

block("ord", "ord0", """
SELECT *, n_end IS NOT NULL AND executed AS fills,
       n_end IS NOT NULL AND executed AND qty = 5 AS part,
       CASE WHEN n_end IS NOT NULL AND executed AND qty = 5 THEN 3 ELSE qty END AS last_qty
FROM ord0""")

block("msg0", "ord", """
SELECT day, n_end AS seq, 0 AS rnk, 'T' AS typ, -1 AS side, tick, last_qty AS qty, oid, firm,
       false AS retail FROM ord WHERE fills
UNION ALL SELECT day, n + 1, 0, 'T', -1, tick, 2, oid, firm, false FROM ord WHERE part
UNION ALL SELECT day, n, 1, 'T', -1, tick, 1, oid, firm, true FROM ord WHERE event_type = 'signup'
UNION ALL SELECT day, n + 1, 2, 'C', side, tick, 3, oid, firm, false FROM ord WHERE part
UNION ALL SELECT day, n_end, 3, 'D', side, tick, last_qty, oid, firm, false FROM ord WHERE n_end IS NOT NULL
UNION ALL SELECT day, n, 4, 'N', side, tick, qty, oid, firm, false FROM ord""")

block("msg", "msg0 pk", """
SELECT m.*, p.t_ms,
       row_number() OVER (PARTITION BY m.day ORDER BY m.seq, m.rnk, m.oid) AS rpt
FROM msg0 m JOIN pk p ON p.day = m.day AND p.n = m.seq""")

# removals of resting volume, with the print test of their packet
block("prints", "msg", """
SELECT day, seq, tick, sum(qty) AS vol FROM msg WHERE typ = 'T' AND NOT retail GROUP BY ALL""")

block("rem", "msg ord prints", """
SELECT m.day, m.seq, m.rpt, m.typ, o.side, m.tick, m.oid,
       CASE WHEN m.typ = 'D' THEN m.qty ELSE o.qty - m.qty END AS gone,
       p.tick IS NOT NULL AS hit,
       coalesce((SELECT sum(vol) FROM prints v WHERE v.day = m.day AND v.seq = m.seq), 0) AS vol
FROM msg m JOIN ord o ON o.day = m.day AND o.oid = m.oid
LEFT JOIN prints p ON p.day = m.day AND p.seq = m.seq AND p.tick = m.tick
WHERE m.typ IN ('C', 'D')""")

block("remx", "rem", """
SELECT *, hit AND vol > coalesce(sum(CASE WHEN hit THEN gone ELSE 0 END) OVER (
         PARTITION BY day, seq ORDER BY rpt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
       AS executed
FROM rem""")

block("bq", "num ord", """
SELECT p.day, p.n,
       max(o.tick) FILTER (o.side = 0) AS b, min(o.tick) FILTER (o.side = 1) AS a
FROM num p LEFT JOIN ord o ON o.day = p.day AND o.n <= p.n AND (o.n_end IS NULL OR o.n_end > p.n)
GROUP BY p.day, p.n""")

block("quote", "bq ord", """
SELECT q.day, q.n, q.b, q.a,
       sum(CASE WHEN o.part AND q.n > o.n THEN 3 ELSE o.qty END) FILTER (o.side = 0 AND o.tick = q.b) AS qb,
       sum(CASE WHEN o.part AND q.n > o.n THEN 3 ELSE o.qty END) FILTER (o.side = 1 AND o.tick = q.a) AS qa
FROM bq q LEFT JOIN ord o ON o.day = q.day AND o.n <= q.n AND (o.n_end IS NULL OR o.n_end > q.n)
GROUP BY ALL""")

block("evt", "pk msg remx quote", """
SELECT p.day, p.n AS seq, p.t_ms, q.b, q.a, q.qb, q.qa,
       t.volume IS NOT NULL AS has_trade, coalesce(t.volume_nr, 0) > 0 AS has_trade_nr,
       coalesce(t.volume, 0) AS volume, coalesce(t.volume_nr, 0) AS volume_nr, t.vwap_tick,
       coalesce(x.n_exec, 0) AS n_exec, coalesce(x.q_exec, 0) AS q_exec,
       CASE WHEN x.hit_bid AND NOT x.hit_ask THEN -1 WHEN x.hit_ask AND NOT x.hit_bid THEN 1 ELSE 0 END AS aggressor,
       coalesce(t.volume_nr, 0) - coalesce(x.q_exec, 0) AS open_balance, r.last_rpt
FROM pk p JOIN quote q ON q.day = p.day AND q.n = p.n
JOIN (SELECT day, seq, max(rpt) AS last_rpt FROM msg GROUP BY ALL) r ON r.day = p.day AND r.seq = p.n
LEFT JOIN (SELECT day, seq, sum(qty) AS volume, sum(qty) FILTER (NOT retail) AS volume_nr,
                  CAST(sum(qty * tick) AS DOUBLE) / sum(qty) AS vwap_tick
           FROM msg WHERE typ = 'T' GROUP BY ALL) t ON t.day = p.day AND t.seq = p.n
LEFT JOIN (SELECT day, seq, count(*) AS n_exec, sum(gone) AS q_exec,
                  bool_or(side = 0) AS hit_bid, bool_or(side = 1) AS hit_ask
           FROM remx WHERE executed GROUP BY ALL) x ON x.day = p.day AND x.seq = p.n""")

block("cal", "num", """
SELECT day, CAST(33300000 AS BIGINT) AS valid_from, CAST(63900000 AS BIGINT) AS valid_to,
       CASE WHEN (strptime(CAST(day AS VARCHAR), '%Y%m%d')::DATE - DATE '1970-01-01') % 7 = 0
            THEN CAST(43200000 AS BIGINT) END AS x0,
       CASE WHEN (strptime(CAST(day AS VARCHAR), '%Y%m%d')::DATE - DATE '1970-01-01') % 7 = 0
            THEN CAST(43800000 AS BIGINT) END AS x1
FROM (SELECT DISTINCT day FROM num)""")

block("st0", "evt cal", """
SELECT e.*, CASE WHEN e.t_ms >= c.valid_from AND e.t_ms < c.valid_to
                  AND NOT coalesce(e.t_ms >= c.x0 AND e.t_ms < c.x1, false) THEN 'C' ELSE 'X' END AS phase,
       coalesce(e.b < e.a, false) AS valid,
       row_number() OVER (PARTITION BY e.day ORDER BY e.seq) AS k
FROM evt e JOIN cal c ON c.day = e.day""")

block("st", "st0", """
SELECT *, sum(CASE WHEN phase <> 'C' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY seq) AS seg,
       phase = 'C' AND valid AS counted
FROM st0""")

block("cs", "st", """
SELECT *, lag(seq) OVER w AS p_seq, lag(t_ms) OVER w AS p_t, lag(b) OVER w AS p_b, lag(a) OVER w AS p_a,
       lag(qb) OVER w AS p_qb, lag(qa) OVER w AS p_qa, lead(t_ms) OVER w AS next_t,
       row_number() OVER w = 1 AS reference
FROM st WHERE counted WINDOW w AS (PARTITION BY day, seg ORDER BY seq)""")

block("mv0", "cs", """
SELECT *, 'bid' AS side, b - p_b AS d, b AS price, p_b AS left_tick FROM cs WHERE b <> p_b
UNION ALL
SELECT *, 'ask', p_a - a, a, p_a FROM cs WHERE a <> p_a""")

block("seen", "mv0 cs", """
SELECT m.day, m.seq, m.side,
       max(c.b) FILTER (c.next_t > m.t_ms - 100) AS mb100, min(c.a) FILTER (c.next_t > m.t_ms - 100) AS ma100,
       max(c.b) FILTER (c.next_t > m.t_ms - 1000) AS mb1000, min(c.a) FILTER (c.next_t > m.t_ms - 1000) AS ma1000,
       max(c.b) FILTER (c.next_t > m.t_ms - 5000) AS mb5000, min(c.a) FILTER (c.next_t > m.t_ms - 5000) AS ma5000
FROM mv0 m JOIN cs c ON c.day = m.day AND c.seg = m.seg AND c.seq < m.seq
WHERE m.d > 0 GROUP BY ALL""")

block("fell", "mv0", """
SELECT m.day, m.seq, m.side, max(o.t_ms) AS fell_ms
FROM mv0 m JOIN mv0 o ON o.day = m.day AND o.seg = m.seg AND o.side <> m.side AND o.d < 0 AND o.seq <= m.seq
WHERE m.d > 0 GROUP BY ALL""")

block("cls", "mv0 seen fell", """
SELECT m.day, m.seq, m.side,
       CASE WHEN (m.side = 'bid' AND m.price <= s.mb100) OR (m.side = 'ask' AND m.price >= s.ma100) THEN 'refill'
            WHEN f.fell_ms > m.t_ms - 100 THEN 'shift' ELSE 'undercut' END AS class_w100,
       CASE WHEN (m.side = 'bid' AND m.price <= s.mb1000) OR (m.side = 'ask' AND m.price >= s.ma1000) THEN 'refill'
            WHEN f.fell_ms > m.t_ms - 1000 THEN 'shift' ELSE 'undercut' END AS class_w1000,
       CASE WHEN (m.side = 'bid' AND m.price <= s.mb5000) OR (m.side = 'ask' AND m.price >= s.ma5000) THEN 'refill'
            WHEN f.fell_ms > m.t_ms - 5000 THEN 'shift' ELSE 'undercut' END AS class_w5000
FROM mv0 m JOIN seen s ON s.day = m.day AND s.seq = m.seq AND s.side = m.side
LEFT JOIN fell f ON f.day = m.day AND f.seq = m.seq AND f.side = m.side""")

# latest trade of each kind at or before a deterioration, then the slot test
block("trd", "mv0 cs", """
SELECT m.day, m.seq, m.side, m.seg, m.t_ms,
       max(c.seq) FILTER (c.has_trade) AS s_any, max(c.t_ms) FILTER (c.has_trade) AS t_any,
       max(c.seq) FILTER (c.has_trade_nr) AS s_nr, max(c.t_ms) FILTER (c.has_trade_nr) AS t_nr,
       max(c.seq) FILTER (c.has_trade AND c.aggressor = CASE WHEN m.side = 'bid' THEN -1 ELSE 1 END) AS s_2,
       max(c.t_ms) FILTER (c.has_trade AND c.aggressor = CASE WHEN m.side = 'bid' THEN -1 ELSE 1 END) AS t_2
FROM mv0 m JOIN cs c ON c.day = m.day AND c.seg = m.seg AND c.seq <= m.seq
WHERE m.d < 0 GROUP BY ALL""")

block("slot", "trd", """
SELECT t.*, NOT EXISTS (SELECT 1 FROM trd e WHERE e.day = t.day AND e.seg = t.seg AND e.side = t.side AND e.seq < t.seq AND e.seq >= t.s_any) AS free_any,
       NOT EXISTS (SELECT 1 FROM trd e WHERE e.day = t.day AND e.seg = t.seg AND e.side = t.side AND e.seq < t.seq AND e.seq >= t.s_nr) AS free_nr,
       NOT EXISTS (SELECT 1 FROM trd e WHERE e.day = t.day AND e.seg = t.seg AND e.side = t.side AND e.seq < t.seq AND e.seq >= t.s_2) AS free_2
FROM trd t""")

block("flag", "slot", """
SELECT day, seq, side,
       coalesce(free_any AND t_ms - t_any <= 10, false) AS r_10ms, coalesce(free_any AND t_ms - t_any <= 1, false) AS r_1ms,
       coalesce(free_nr AND t_ms - t_nr <= 10, false) AS r_nr_10ms, coalesce(free_nr AND t_ms - t_nr <= 1, false) AS r_nr_1ms,
       coalesce(free_2 AND t_ms - t_2 <= 10, false) AS r2_10ms, coalesce(free_2 AND t_ms - t_2 <= 1, false) AS r2_1ms
FROM slot""")

block("emp", "mv0 ord", """
SELECT m.day, m.seq, m.side, m.left_tick, max(o.n_end) AS emptied
FROM mv0 m JOIN ord o ON o.day = m.day AND o.tick = m.left_tick
     AND o.side = CASE WHEN m.side = 'bid' THEN 0 ELSE 1 END AND o.n_end <= m.seq
WHERE m.d < 0 GROUP BY ALL""")

block("cause", "emp remx", """
SELECT e.day, e.seq, e.side, bool_or(r.executed) AS hit,
       arg_max(r.executed, r.rpt) FILTER (r.typ = 'D') AS last_hit
FROM emp e JOIN remx r ON r.day = e.day AND r.seq = e.emptied AND r.tick = e.left_tick
     AND r.side = CASE WHEN e.side = 'bid' THEN 0 ELSE 1 END
GROUP BY ALL""")

block("mv", "mv0 cls flag cause", """
SELECT m.day, m.seq, m.k, m.t_ms, m.seg, m.side, CASE WHEN m.d > 0 THEN 'improve' ELSE 'worsen' END AS kind,
       abs(m.d) AS ticks, m.b, m.a, m.qb, m.qa, m.p_b, m.p_a, m.p_qb, m.p_qa, m.p_a - m.p_b AS spread_prev,
       m.aggressor, m.has_trade, m.open_balance,
       c.class_w100, c.class_w1000, c.class_w5000, c.class_w1000 AS class,
       f.r_10ms, f.r_1ms, f.r_nr_10ms, f.r_nr_1ms, f.r2_10ms, f.r2_1ms,
       CASE WHEN x.hit THEN 'execution' WHEN NOT x.hit THEN 'cancel' END AS cause,
       x.hit AND NOT x.last_hit AS cause_conflict
FROM mv0 m
LEFT JOIN cls c ON c.day = m.day AND c.seq = m.seq AND c.side = m.side
LEFT JOIN flag f ON f.day = m.day AND f.seq = m.seq AND f.side = m.side
LEFT JOIN cause x ON x.day = m.day AND x.seq = m.seq AND x.side = m.side""")

# ------------------------------------------------------------------ periods
PERIOD_SQL = {
    "day": "SELECT day, valid_from AS ps, valid_to AS pe FROM cal",
    "hour": """SELECT day, greatest(h * 3600000, valid_from) AS ps, least((h + 1) * 3600000, valid_to) AS pe
FROM cal, (SELECT unnest(range(9, 18)) AS h)""",
    "block": """SELECT day, g * 300000 AS ps, (g + 1) * 300000 AS pe FROM cal, (SELECT unnest(range(108, 216)) AS g)
WHERE g * 300000 >= valid_from AND (g + 1) * 300000 <= valid_to
  AND NOT coalesce(x0 < (g + 1) * 300000 AND g * 300000 < x1, false)""",
}
for _g, _sql in PERIOD_SQL.items():
    block(f"per_{_g}", "cal", f"SELECT day, CAST(ps AS BIGINT) AS ps, CAST(pe AS BIGINT) AS pe FROM ({_sql})")

_N = {
    "n_impr": "m.kind = 'improve'",
    "n_undercut": "m.class = 'undercut'",
    "n_refill": "m.class = 'refill'",
    "n_shift": "m.class = 'shift'",
    "n_det_all": "m.kind = 'worsen'",
    "n_det_exec": "m.cause = 'execution'",
    "n_det_cancel": "m.cause = 'cancel'",
    "n_det_trade10ms": "m.r_10ms",
    "n_det_trade1ms": "m.r_1ms",
    "n_det_trade10ms_r2": "m.r2_10ms",
    "n_det_trade10ms_nr": "m.r_nr_10ms",
    **{
        f"n_{c}_w{w}": f"m.class_w{w} = '{c}'"
        for w in (100, 1000, 5000)
        for c in ("undercut", "refill", "shift")
    },
    **{
        f"{s}_{n}": f"m.side = '{s}' AND {p}"
        for s in ("bid", "ask")
        for n, p in (
            ("n_impr", "m.kind = 'improve'"),
            ("n_det_all", "m.kind = 'worsen'"),
            ("n_det_exec", "m.cause = 'execution'"),
            ("n_det_cancel", "m.cause = 'cancel'"),
            ("n_det_trade10ms", "m.r_10ms"),
            ("n_undercut", "m.class = 'undercut'"),
            ("n_refill", "m.class = 'refill'"),
            ("n_shift", "m.class = 'shift'"),
        )
    },
    "one_impr": "m.kind = 'improve' AND m.ticks = 1",
    "one_trade": "m.r_10ms AND m.ticks = 1",
}
for _g in PERIOD_SQL:
    _counts = ",\n".join(f"count(*) FILTER ({p}) AS {n}" for n, p in _N.items())
    block(
        f"cnt_{_g}",
        f"per_{_g} mv",
        f"""SELECT p.day, p.ps, p.pe, {_counts},
coalesce(sum(m.ticks) FILTER (m.kind = 'improve'), 0) AS ticks_impr,
coalesce(sum(m.ticks) FILTER (m.kind = 'worsen'), 0) AS ticks_det
FROM per_{_g} p LEFT JOIN mv m ON m.day = p.day AND m.t_ms >= p.ps AND m.t_ms < p.pe GROUP BY p.day, p.ps, p.pe""",
    )

block("ds", "st", """
SELECT *, lag(seq) OVER w AS q_seq, lead(t_ms) OVER w AS nxt FROM st WHERE counted
WINDOW w AS (PARTITION BY day ORDER BY seq)""")
for _g in PERIOD_SQL:
    # state that opens the period plus the states inside it
    block(f"in_{_g}", f"per_{_g} ds cal", f"""
SELECT p.day, p.ps, p.pe, d.seq, d.t_ms, d.b, d.a,
       greatest(d.t_ms, p.ps) AS s0,
       least(coalesce(lead(d.t_ms) OVER (PARTITION BY p.day, p.ps ORDER BY d.seq), p.pe), p.pe) AS s1
FROM per_{_g} p JOIN ds d ON d.day = p.day AND d.t_ms < p.pe
 AND (d.t_ms >= p.ps OR d.seq = (SELECT max(x.seq) FROM ds x WHERE x.day = p.day AND x.t_ms < p.ps))""")
    block(f"tw_{_g}", f"in_{_g} cal", f"""
SELECT i.day, i.ps,
       sum((i.a - i.b) * dur) / nullif(CAST(sum(dur) AS DOUBLE), 0) AS spread_tw_ticks,
       sum(CAST(i.a - i.b AS DOUBLE) / ((i.a + i.b) / 2.0) * dur) / nullif(CAST(sum(dur) AS DOUBLE), 0) AS pct_spread_tw,
       CAST(sum(CASE WHEN i.a - i.b = 1 THEN dur ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(dur) AS DOUBLE), 0) AS frac_1tick,
       CAST(arg_min(i.a - i.b, i.seq) AS DOUBLE) AS spread_first, CAST(arg_max(i.a - i.b, i.seq) AS DOUBLE) AS spread_last
FROM (SELECT i.*, i.s1 - i.s0 - CASE WHEN c.x0 IS NULL THEN 0 ELSE greatest(0, least(i.s1, c.x1) - greatest(i.s0, c.x0)) END AS dur
      FROM in_{_g} i JOIN cal c ON c.day = i.day) i
GROUP BY i.day, i.ps""")
    block(f"vol_{_g}", f"per_{_g} in_{_g}", f"""
SELECT day, ps, CASE WHEN any_value(pe) - ps >= 180000 AND count(r) >= 2 THEN stddev_samp(r) END AS qvol
FROM (SELECT day, ps, pe, ln(mid) - lag(ln(mid)) OVER (PARTITION BY day, ps ORDER BY g) AS r
      FROM (SELECT p.day, p.ps, p.pe, g.g,
                   (SELECT arg_max((i.a + i.b) / 2.0, i.seq) FROM in_{_g} i WHERE i.day = p.day AND i.ps = p.ps AND i.t_ms <= g.g) AS mid
            FROM per_{_g} p, LATERAL (SELECT unnest(range(p.ps + 60000, p.pe + 1, 60000)) AS g) g) WHERE mid IS NOT NULL)
GROUP BY day, ps""")
    block(f"tv_{_g}", f"per_{_g} st cal", f"""
SELECT p.day, p.ps, coalesce(sum(s.volume), 0) AS volume
FROM per_{_g} p JOIN cal c ON c.day = p.day
LEFT JOIN st s ON s.day = p.day AND s.phase = 'C' AND s.t_ms >= p.ps AND s.t_ms < p.pe
 AND NOT coalesce(s.t_ms >= c.x0 AND s.t_ms < c.x1, false)
GROUP BY p.day, p.ps""")


def _q(n: str, d: str) -> str:
    return f"CAST(({n}) - ({d}) AS DOUBLE) / nullif(({n}) + ({d}), 0)"


RATIO_SQL = {
    "share_1tick_impr": "CAST(one_impr AS DOUBLE) / nullif(n_impr, 0)",
    "share_1tick_det_trade": "CAST(one_trade AS DOUBLE) / nullif(n_det_trade10ms, 0)",
    "qcr_r": _q("n_impr", "n_det_trade10ms"),
    "qcr_r_1ms": _q("n_impr", "n_det_trade1ms"),
    "qcr_r2": _q("n_impr", "n_det_trade10ms_r2"),
    "qcr_r_nr": _q("n_impr", "n_det_trade10ms_nr"),
    "qcr_a": _q("n_impr", "n_det_exec"),
    "qcr_u": _q("n_undercut", "n_det_exec"),
    "bid_qcr_r": _q("bid_n_impr", "bid_n_det_trade10ms"),
    "ask_qcr_r": _q("ask_n_impr", "ask_n_det_trade10ms"),
    "bid_qcr_a": _q("bid_n_impr", "bid_n_det_exec"),
    "ask_qcr_a": _q("ask_n_impr", "ask_n_det_exec"),
    "m_impr": "CAST(ticks_impr AS DOUBLE) / nullif(n_impr, 0)",
    "m_det": "CAST(ticks_det AS DOUBLE) / nullif(n_det_all, 0)",
    "theta": "CAST(n_det_exec AS DOUBLE) / nullif(n_det_all, 0)",
    "qcr_composition": "(1 - CAST(n_det_exec AS DOUBLE) / nullif(n_det_all, 0)) / (1 + CAST(n_det_exec AS DOUBLE) / nullif(n_det_all, 0))",
}
STATE_VARS = ("spread_tw_ticks", "pct_spread_tw", "frac_1tick", "spread_first", "spread_last")

for _g in PERIOD_SQL:
    _ratios = ", ".join(f"{e} AS {n}" for n, e in RATIO_SQL.items())
    _keep = ", ".join(f"c.{n}" for n in _N if not n.startswith("one_"))
    block(f"panel_{_g}", f"cnt_{_g} tw_{_g} vol_{_g} tv_{_g}", f"""
SELECT c.day, CAST(1 AS BIGINT) AS sid, c.ps AS period_start, c.pe AS period_end, {_keep},
       CAST(c.ticks_impr AS BIGINT) AS ticks_impr, CAST(c.ticks_det AS BIGINT) AS ticks_det,
       {_ratios}, {", ".join("w." + v for v in STATE_VARS)}, v.qvol, CAST(t.volume AS BIGINT) AS volume
FROM cnt_{_g} c LEFT JOIN tw_{_g} w ON w.day = c.day AND w.ps = c.ps
LEFT JOIN vol_{_g} v ON v.day = c.day AND v.ps = c.ps
LEFT JOIN tv_{_g} t ON t.day = c.day AND t.ps = c.ps""")
