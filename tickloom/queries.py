"""Named queries over the given tables and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.functions.constants import BLOCK_MS
from tickloom.plans import panels
from tickloom.plans.pipeline import BookPipeline, pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, needs: str | None = None, sql: str | None = None, delayed: bool = False):
    """Register a function of the pipeline as query ``name`` (and its SQL)."""

    def wrap(fn: Callable[[BookPipeline], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(pipeline(spark, sf_dir, delayed))
        if sql is not None:
            ORACLE[name] = oracle.statement(needs or "", sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round the floating columns (sums may differ in the last bits between engines)."""
    return df.select(
        *[
            F.round(F.col(n), digits).alias(n) if t == "double" else F.col(n)
            for n, t in df.dtypes
        ]
    )


# ------------------------------------------------------------------ sources
@register(
    "order_flow",
    "msg",
    """SELECT day, CAST(1 AS BIGINT) AS sid, seq, t_ms, rpt, typ, side, tick, qty, oid, firm, retail FROM msg""",
)
def order_flow(p):
    return p.messages.select(
        "day", "sid", "seq", "t_ms", "rpt", "typ", "side", "tick", "qty", "oid", "firm", "retail"
    )


@register(
    "session_calendar",
    "cal",
    """SELECT day, CAST(1 AS BIGINT) AS sid, CASE WHEN x0 IS NULL THEN 4 ELSE 6 END::BIGINT AS n_status,
CAST(32400000 AS BIGINT) AS open_ms, CAST(64800000 AS BIGINT) AS call_ms, CAST(65400000 AS BIGINT) AS close_ms,
valid_from, valid_to, CASE WHEN x0 IS NULL THEN 0 ELSE 1 END::INTEGER AS n_exclusions,
x0 AS first_exclusion_from, x1 AS first_exclusion_to, 'ok' AS status,
CASE WHEN x0 IS NULL THEN 510.0 ELSE 500.0 END::DOUBLE AS valid_minutes FROM cal""",
)
def session_calendar(p):
    return p.calendar.select(
        "day", "sid", "n_status", "open_ms", "call_ms", "close_ms", "valid_from", "valid_to",
        F.size("exclusions").alias("n_exclusions"),
        F.get("exclusions", F.lit(0))["start"].alias("first_exclusion_from"),
        F.get("exclusions", F.lit(0))["end"].alias("first_exclusion_to"),
        "status", "valid_minutes",
    )


# ------------------------------------------------------------------ book
@register(
    "order_lifecycle",
    "msg ord",
    """SELECT m.day, m.rpt, m.typ, m.oid, CASE WHEN m.typ = 'N' THEN 'insert' WHEN m.typ = 'C' THEN 'reduce' ELSE 'remove' END AS effect,
o.side AS e_side, m.tick AS e_tick, CAST(CASE m.typ WHEN 'N' THEN 1 WHEN 'C' THEN 0 ELSE -1 END AS BIGINT) AS dn,
CAST(CASE m.typ WHEN 'N' THEN m.qty WHEN 'C' THEN m.qty - o.qty ELSE -m.qty END AS BIGINT) AS dq,
CASE WHEN m.typ <> 'N' THEN m.t_ms - b.t_ms END AS age_ms
FROM msg m JOIN ord o ON o.day = m.day AND o.oid = m.oid JOIN pk b ON b.day = o.day AND b.n = o.n
WHERE m.typ <> 'T'""",
)
def order_lifecycle(p):
    return p.log.filter("typ <> 'T'").select(
        "day", "rpt", "typ", "oid",
        F.when(F.col("dn") > 0, "insert").when(F.col("dn") < 0, "remove").otherwise("reduce").alias("effect"),
        "e_side", "e_tick", "dn", "dq",
        F.when(F.col("typ") != "N", F.col("t_ms") - F.col("born_ms")).alias("age_ms"),
    )


@register(
    "level_depth",
    "msg ord",
    """SELECT m.day, m.rpt, o.side AS e_side, m.tick AS e_tick,
CAST(sum(CASE m.typ WHEN 'N' THEN 1 WHEN 'C' THEN 0 ELSE -1 END) OVER w AS BIGINT) AS level_n,
CAST(sum(CASE m.typ WHEN 'N' THEN m.qty WHEN 'C' THEN m.qty - o.qty ELSE -m.qty END) OVER w AS BIGINT) AS level_q
FROM msg m JOIN ord o ON o.day = m.day AND o.oid = m.oid WHERE m.typ <> 'T'
WINDOW w AS (PARTITION BY m.day, o.side, m.tick ORDER BY m.rpt)""",
)
def level_depth(p):
    return p.log.filter("typ <> 'T'").select(
        "day", "rpt", "e_side", "e_tick", "level_n", "level_q"
    )


@register(
    "best_quote",
    "quote",
    "SELECT day, n AS seq, b, a, CAST(qb AS BIGINT) AS qb, CAST(qa AS BIGINT) AS qa FROM quote",
)
def best_quote(p):
    return p.events.select("day", "seq", "b", "a", "qb", "qa")


@register(
    "matching_events",
    "evt",
    """SELECT day, seq, t_ms, CAST(1 AS INTEGER) AS n_packets, has_trade, has_trade_nr, CAST(volume AS BIGINT) AS volume,
CAST(volume_nr AS BIGINT) AS volume_nr, round(vwap_tick, 9) AS vwap_tick, CAST(n_exec AS BIGINT) AS n_exec,
CAST(q_exec AS BIGINT) AS q_exec, aggressor, CAST(open_balance AS BIGINT) AS open_balance FROM evt""",
)
def matching_events(p):
    return rounded(
        p.events.select(
            "day", "seq", "t_ms", "n_packets", "has_trade", "has_trade_nr", "volume", "volume_nr",
            "vwap_tick", "n_exec", "q_exec", "aggressor", "open_balance",
        )
    )


oracle.block("dmsg0", "msg0 ord", """
SELECT m.* REPLACE (CASE WHEN m.typ = 'D' AND o.fills AND o.n_end % 8 <= 2 AND o.n_end + 1 < o.cnt
                         THEN m.seq + 1 ELSE m.seq END AS seq)
FROM msg0 m JOIN ord o ON o.day = m.day AND o.oid = m.oid""")
oracle.block("dmsg", "dmsg0 pk", """
SELECT m.*, p.t_ms, row_number() OVER (PARTITION BY m.day ORDER BY m.seq, m.rnk, m.oid) AS rpt
FROM dmsg0 m JOIN pk p ON p.day = m.day AND p.n = m.seq""")
# packet by packet: prints and removals as lists, balance carried along the day
oracle.block("dpk", "dmsg pk ord", """
SELECT p.day, p.n, p.t_ms,
       coalesce(sum(m.qty) FILTER (m.typ = 'T' AND NOT m.retail), 0) AS vol,
       coalesce(list(m.tick) FILTER (m.typ = 'T' AND NOT m.retail), []) AS ticks,
       coalesce(list({'tick': m.tick, 'qty': CASE WHEN m.typ = 'D' THEN m.qty ELSE o.qty - m.qty END})
                FILTER (m.typ IN ('C', 'D')), []) AS rem
FROM pk p LEFT JOIN dmsg m ON m.day = p.day AND m.seq = p.n
LEFT JOIN ord o ON o.day = m.day AND o.oid = m.oid GROUP BY ALL""")
oracle.block("dwalk", "dpk", """
SELECT CAST(0 AS BIGINT) AS n, day, n AS ev, t_ms AS ev_ms, ticks AS seen,
       CAST(vol - coalesce(list_sum(list_transform(list_filter(rem, lambda r: list_contains(ticks, r.tick)), lambda r: r.qty)), 0) AS BIGINT) AS bal
FROM dpk WHERE n = 0
UNION ALL /*rec*/
SELECT s.n, s.day, CASE WHEN s.go THEN s.ev ELSE s.n END, CASE WHEN s.go THEN s.ev_ms ELSE s.t_ms END, s.seen,
       CAST(s.before + s.vol - coalesce(list_sum(list_transform(list_filter(s.rem, lambda r: list_contains(s.seen, r.tick)), lambda r: r.qty)), 0) AS BIGINT)
FROM (SELECT p.n, p.day, p.t_ms, p.vol, p.rem, w.ev, w.ev_ms, w.bal > 0 AND p.t_ms - w.ev_ms <= 100 AS go,
             CASE WHEN w.bal > 0 AND p.t_ms - w.ev_ms <= 100 THEN list_concat(w.seen, p.ticks) ELSE p.ticks END AS seen,
             CASE WHEN w.bal > 0 AND p.t_ms - w.ev_ms <= 100 THEN w.bal ELSE 0 END AS before
      FROM dwalk w JOIN dpk p ON p.day = w.day AND p.n = w.n + 1) s""")


@register(
    "matching_events_delayed",
    "dwalk",
    """SELECT day, ev AS seq, min(ev_ms) AS t_ms, CAST(count(*) AS INTEGER) AS n_packets,
CAST(max(n) AS BIGINT) AS last_seq FROM dwalk GROUP BY day, ev""",
    delayed=True,
)
def matching_events_delayed(p):
    return p.log.groupBy("day", F.col("ev").alias("seq")).agg(
        F.first("ev_ms").alias("t_ms"),
        F.first("ev_packets").alias("n_packets"),
        F.max("seq").alias("last_seq"),
    )


@register(
    "exec_attribution",
    "remx",
    "SELECT day, rpt, seq, typ, side AS e_side, tick AS e_tick, CAST(gone AS BIGINT) AS removed, executed FROM remx",
)
def exec_attribution(p):
    return p.log.filter("candidate").select(
        "day", "rpt", "seq", "typ", "e_side", "e_tick", (-F.col("dq")).alias("removed"), "executed"
    )


@register(
    "book_states",
    "st",
    """SELECT day, seq, k, t_ms, phase, valid, CAST(seg AS BIGINT) AS seg, b, a, CAST(qb AS BIGINT) AS qb, CAST(qa AS BIGINT) AS qa,
CAST(volume AS BIGINT) AS volume, coalesce(counted AND row_number() OVER (PARTITION BY day, seg, counted ORDER BY seq) = 1, false) AS reference
FROM st""",
)
def book_states(p):
    return p.states.select(
        "day", "seq", "k", "t_ms", "phase", "valid", "seg", "b", "a", "qb", "qa", "volume", "reference"
    )


# ------------------------------------------------------------------ moves
@register(
    "quote_moves",
    "mv",
    """SELECT day, seq, k, t_ms, side, kind, ticks, p_b AS b_prev, p_a AS a_prev, CAST(p_qb AS BIGINT) AS qb_prev,
CAST(p_qa AS BIGINT) AS qa_prev, spread_prev, b, a, CAST(qb AS BIGINT) AS qb, CAST(qa AS BIGINT) AS qa FROM mv""",
)
def quote_moves(p):
    return p.moves.select(
        "day", "seq", "k", "t_ms", "side", "kind", "ticks", "b_prev", "a_prev", "qb_prev", "qa_prev",
        "spread_prev", "b", "a", "qb", "qa",
    )


@register(
    "improvement_class",
    "mv seen",
    """SELECT m.day, m.seq, m.side, m.class_w100, m.class_w1000, m.class_w5000, s.mb1000 AS max_bid_1000, s.ma1000 AS min_ask_1000
FROM mv m JOIN seen s ON s.day = m.day AND s.seq = m.seq AND s.side = m.side WHERE m.kind = 'improve'""",
)
def improvement_class(p):
    return p.moves.filter("kind = 'improve'").select(
        "day", "seq", "side", "class_w100", "class_w1000", "class_w5000", "max_bid_1000", "min_ask_1000"
    )


@register(
    "trade_window_flags",
    "mv",
    "SELECT day, seq, side, r_10ms, r_1ms, r_nr_10ms, r_nr_1ms, r2_10ms, r2_1ms FROM mv WHERE kind = 'worsen'",
)
def trade_window_flags(p):
    return p.moves.filter("kind = 'worsen'").select(
        "day", "seq", "side", "r_10ms", "r_1ms", "r_nr_10ms", "r_nr_1ms", "r2_10ms", "r2_1ms"
    )


@register(
    "deterioration_cause",
    "mv",
    "SELECT day, seq, side, ticks, cause, cause_conflict FROM mv WHERE kind = 'worsen'",
)
def deterioration_cause(p):
    return p.moves.filter("kind = 'worsen'").select(
        "day", "seq", "side", "ticks", "cause", "cause_conflict"
    )


# ------------------------------------------------------------------ panels
def panel_of(p: BookPipeline, grain: str, length_ms: int = BLOCK_MS) -> DataFrame:
    return p.store.table(
        f"panel_{grain}_{length_ms}",
        lambda: panels.panel(p.states, p.moves, p.calendar, grain, length_ms),
    )


_COUNTS = [n for n in oracle._N if not n.startswith("one_")] + ["ticks_impr", "ticks_det"]
_RATIOS = list(oracle.RATIO_SQL)
_VARS = [*oracle.STATE_VARS, "qvol"]


def _panel_sql(grain: str) -> str:
    return f"""SELECT day, sid, period_start, period_end, {", ".join(_COUNTS)},
{", ".join(f"round({c}, 9) AS {c}" for c in _RATIOS + _VARS)}, volume FROM panel_{grain}"""


def _register_panel(grain: str) -> None:
    @register(f"ratio_panel_{grain}", f"panel_{grain}", _panel_sql(grain))
    def ratio_panel(p):
        return rounded(
            panel_of(p, grain).select(
                "day", "sid", "period_start", "period_end", *_COUNTS, *_RATIOS, *_VARS, "volume"
            )
        )

    @register(
        f"spread_identity_{grain}",
        f"cnt_{grain} cs",
        f"""SELECT c.day, CAST(1 AS BIGINT) AS sid, c.ps AS period_start, CAST(c.ticks_det AS BIGINT) AS ticks_det,
CAST(c.ticks_impr AS BIGINT) AS ticks_impr, CAST(coalesce(d.delta, 0) AS BIGINT) AS delta_spread,
CAST(coalesce(d.delta, 0) - (c.ticks_det - c.ticks_impr) AS BIGINT) AS residual
FROM cnt_{grain} c LEFT JOIN (
  SELECT p.day, p.ps, sum((s.a - s.b) - (s.p_a - s.p_b)) AS delta
  FROM per_{grain} p JOIN cs s ON s.day = p.day AND s.t_ms >= p.ps AND s.t_ms < p.pe AND NOT s.reference
  GROUP BY ALL) d ON d.day = c.day AND d.ps = c.ps""",
    )
    def spread_identity(p):
        return panels.spread_identity(
            p.states, panel_of(p, grain), panels.periods(p.calendar, grain), grain
        )


for _grain in ("day", "hour", "block"):
    _register_panel(_grain)


@register(
    "ratio_daily_cause",
    "cnt_day",
    f"""SELECT day, CAST(1 AS BIGINT) AS sid, n_impr, n_det_exec, n_det_cancel, {oracle.RATIO_SQL["qcr_a"]} AS qcr_a,
{oracle.RATIO_SQL["qcr_u"]} AS qcr_u FROM cnt_day""",
)
def ratio_daily_cause(p):
    return panel_of(p, "day").select(
        "day", "sid", "n_impr", "n_det_exec", "n_det_cancel", "qcr_a", "qcr_u"
    )
