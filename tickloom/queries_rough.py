"""Queries over the rough feed: sequence gaps, books that restart, levels and time at each spread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.operators import epochs, levels
from tickloom.plans import spread_time as st
from tickloom.plans.reconcile import reconciled
from tickloom.plans.rough_pipeline import RoughPipeline, rough_pipeline
from tickloom.queries import ORACLE, QUERIES, rounded
from tickloom.sources import rough_flow as rf


def register(name: str, needs: str, sql: str):
    def wrap(fn: Callable[[RoughPipeline], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(rough_pipeline(spark, sf_dir))
        ORACLE[name] = oracle.statement(needs, sql)
        return fn

    return wrap


# ------------------------------------------------------------------ the feed in SQL
def _is(which: tuple[int, int], column: str = "oid") -> str:
    return f"{column} % {which[0]} = {which[1]}"


oracle.block("ro", "ord", f"""
SELECT day, 1 + oid % {rf.INSTRUMENTS} AS sid, n, cnt, oid, event_type, side, qty, n_end, fills, part, last_qty,
       CASE WHEN {_is(rf.CROSSING)} THEN CASE side WHEN 0 THEN {rf.CROSSING_TICKS[0]} ELSE {rf.CROSSING_TICKS[1]} END ELSE tick END AS tick,
       CASE side WHEN 0 THEN -1 ELSE 1 END AS away,
       CASE WHEN part OR n + 1 >= cnt THEN '' WHEN {_is(rf.PRICED)} THEN 'priced' WHEN {_is(rf.GROWN)} THEN 'grown' WHEN {_is(rf.REUSED)} THEN 'reused' ELSE '' END AS twist
FROM ord""")
oracle.block("rpk", "ord pk", f"""
SELECT day, n, t_ms, CAST(sum(CASE WHEN broken THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY n) AS BIGINT) AS epoch FROM (
SELECT p.day, p.n, p.t_ms, coalesce(p.n - lag(p.n) OVER (PARTITION BY p.day ORDER BY p.n) > 1, false) AS broken
FROM pk p JOIN ord o ON o.day = p.day AND o.n = p.n WHERE NOT ({_is(rf.LOST)}))""")
oracle.block("rmsg", "ro rpk", """
SELECT m.*, p.t_ms, p.epoch, row_number() OVER (PARTITION BY m.day ORDER BY m.seq, m.rnk, m.oid) AS rpt FROM (
SELECT day, sid, n_end AS seq, 0 AS rnk, 'T' AS typ, -1 AS side, tick, last_qty AS qty, oid, false AS retail FROM ro WHERE fills
UNION ALL SELECT day, sid, n + 1, 0, 'T', -1, tick, 2, oid, false FROM ro WHERE part
UNION ALL SELECT day, sid, n, 1, 'T', -1, tick, 1, oid, true FROM ro WHERE event_type = 'signup'
UNION ALL SELECT day, sid, n + 1, 2, 'C', side, tick, 3, oid, false FROM ro WHERE part
UNION ALL SELECT day, sid, n + 1, 2, 'C', side, tick + away, qty, oid, false FROM ro WHERE twist = 'priced'
UNION ALL SELECT day, sid, n + 1, 2, 'C', side, tick, qty + 2, oid, false FROM ro WHERE twist = 'grown'
UNION ALL SELECT day, sid, n_end, 3, 'D', side, tick, last_qty, oid, false FROM ro WHERE n_end IS NOT NULL
UNION ALL SELECT day, sid, n, 4, 'N', side, tick, qty, oid, false FROM ro
UNION ALL SELECT day, sid, n + 1, 4, 'N', side, tick - away, 2, oid, false FROM ro WHERE twist = 'reused') m
JOIN rpk p ON p.day = m.day AND p.n = m.seq""")


def _book_blocks(prefix: str, epoch: str) -> None:
    """Order states, level effects and quotes of the rough feed, the book restarting at each ``epoch``."""
    oracle.block(f"{prefix}s0", "rmsg", f"""
SELECT day, sid, {epoch} AS epoch, rpt, t_ms, typ, side, tick, qty, oid,
       max(CASE WHEN typ = 'N' THEN rpt END) OVER w AS born, max(CASE WHEN typ = 'D' THEN rpt END) OVER w AS died,
       last_value(CASE WHEN typ = 'N' THEN side END IGNORE NULLS) OVER w AS s_side,
       lag(tick) OVER o AS s_tick, lag(qty) OVER o AS s_qty
FROM rmsg WHERE typ <> 'T'
WINDOW o AS (PARTITION BY day, sid, {epoch}, oid ORDER BY rpt), w AS (PARTITION BY day, sid, {epoch}, oid ORDER BY rpt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
    oracle.block(f"{prefix}s", f"{prefix}s0", f"""
SELECT *, CASE WHEN live THEN s_side END AS p_side, CASE WHEN live THEN s_tick END AS p_tick, CASE WHEN live THEN s_qty END AS p_qty,
 CASE WHEN typ = 'N' AND live THEN 'duplicate_order' WHEN typ = 'D' AND NOT live THEN 'orphan_delete' WHEN typ = 'C' AND NOT live THEN 'orphan_change'
      WHEN typ = 'C' AND tick <> s_tick THEN 'price_change' WHEN typ = 'C' AND qty > s_qty THEN 'size_increase' END AS anomaly
FROM (SELECT *, born IS NOT NULL AND (died IS NULL OR died < born) AS live FROM {prefix}s0)""")
    oracle.block(f"{prefix}e", f"{prefix}s", f"""
SELECT day, sid, epoch, rpt, 0 AS sub, p_side AS e_side, p_tick AS e_tick, -1 AS dn, -p_qty AS dq FROM {prefix}s
 WHERE live AND (typ IN ('N', 'D') OR anomaly = 'price_change')
UNION ALL SELECT day, sid, epoch, rpt, 1, side, tick, 1, qty FROM {prefix}s WHERE typ = 'N'
UNION ALL SELECT day, sid, epoch, rpt, 1, p_side, tick, 1, qty FROM {prefix}s WHERE live AND anomaly = 'price_change'
UNION ALL SELECT day, sid, epoch, rpt, 0, p_side, p_tick, 0, qty - p_qty FROM {prefix}s WHERE live AND typ = 'C' AND anomaly IS DISTINCT FROM 'price_change'""")
    oracle.block(f"{prefix}l", f"{prefix}e", f"""
SELECT *, sum(dn) OVER w AS level_n, sum(dq) OVER w AS level_q FROM {prefix}e
WINDOW w AS (PARTITION BY day, sid, epoch, e_side, e_tick ORDER BY rpt, sub)""")
    oracle.block(f"{prefix}h", f"rmsg {prefix}l", f"""
SELECT m.day, m.sid, {epoch.replace('epoch', 'm.epoch')} AS epoch, m.rpt, l.e_side, l.e_tick,
       arg_max(l.level_n, l.rpt * 2 + l.sub) AS n, arg_max(l.level_q, l.rpt * 2 + l.sub) AS q
FROM rmsg m JOIN {prefix}l l ON l.day = m.day AND l.sid = m.sid AND l.epoch = {epoch.replace('epoch', 'm.epoch')} AND l.rpt <= m.rpt GROUP BY ALL""")
    oracle.block(f"{prefix}q", f"rmsg {prefix}h", f"""
SELECT m.day, m.sid, {epoch.replace('epoch', 'm.epoch')} AS epoch, m.rpt, m.seq, m.t_ms,
       max(h.e_tick) FILTER (h.e_side = 0) AS b, min(h.e_tick) FILTER (h.e_side = 1) AS a,
       arg_max(h.q, h.e_tick) FILTER (h.e_side = 0) AS qb, arg_min(h.q, h.e_tick) FILTER (h.e_side = 1) AS qa,
       arg_max(h.n, h.e_tick) FILTER (h.e_side = 0) AS nb, arg_min(h.n, h.e_tick) FILTER (h.e_side = 1) AS na
FROM rmsg m LEFT JOIN {prefix}h h ON h.day = m.day AND h.sid = m.sid AND h.rpt = m.rpt AND h.n > 0 GROUP BY ALL""")


_book_blocks("re", "epoch")
_book_blocks("rc", "0")


# ------------------------------------------------------------------ integrity of the sequence
@register(
    "sequence_integrity_channel",
    "ord",
    f"""SELECT day, channel, count(*) AS n, min(n) AS first, max(n) AS last,
CAST(greatest(0, max(n) - min(n) + 1 - count(*) + count(*) FILTER (n <= high)) AS BIGINT) AS missing, count(*) FILTER (n <= high) AS repeated
FROM (SELECT *, max(n) OVER (PARTITION BY day, channel ORDER BY place, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM (
 SELECT day, n, 1 AS channel, n * 10 AS place, c.copy FROM ord, (SELECT unnest([0, 1]) AS copy) c WHERE NOT ({_is(rf.LOST)}) AND (c.copy = 0 OR {_is(rf.REPEATED)})
 UNION ALL SELECT day, n, 2, n * 10 + CASE WHEN {_is(rf.LATE)} THEN 25 ELSE 0 END, c.copy FROM ord, (SELECT unnest([0, 1]) AS copy) c
 WHERE NOT ({_is(rf.LOST_SECOND)}) AND (c.copy = 0 OR {_is(rf.REPEATED)})))
GROUP BY day, channel""",
)
def sequence_integrity_channel(p):
    """Messages, missing and repeated numbers of both channels of each day."""
    return rf.sequence_integrity(p.arrivals)


@register(
    "epochs_of_feed",
    "rmsg",
    """SELECT day, sid, epoch, count(*) AS messages, min(seq) AS first_seq, max(seq) AS last_seq FROM rmsg GROUP BY day, sid, epoch""",
)
def epochs_of_feed(p):
    """Stretches without a break, by instrument."""
    return p.messages.groupBy("day", "sid", "epoch").agg(
        F.count("*").alias("messages"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


# ------------------------------------------------------------------ books that restart
@register(
    "rough_lifecycle",
    "rel res",
    """SELECT s.day, s.sid, s.epoch, s.rpt, s.typ, s.oid, s.anomaly, l.e_side, l.e_tick, CAST(l.dn AS BIGINT) AS dn, CAST(l.dq AS BIGINT) AS dq,
CAST(l.level_n AS BIGINT) AS level_n, CAST(l.level_q AS BIGINT) AS level_q
FROM res s LEFT JOIN rel l ON l.day = s.day AND l.sid = s.sid AND l.epoch = s.epoch AND l.rpt = s.rpt""",
)
def rough_lifecycle(p):
    """Every order message with its anomaly and its effects on the levels, per epoch."""
    names = ("day", "sid", "epoch", "rpt", "typ", "oid", "anomaly", "e_side", "e_tick", "dn", "dq", "level_n", "level_q")
    with_depth = epochs.unkeyed(p.effects()).select(*names)
    # effects without a level are rows of messages that do nothing; they have no depth
    idle = F.col("e_side").isNull()
    return with_depth.withColumns({c: F.when(~idle, F.col(c)) for c in ("level_n", "level_q")})


@register(
    "rough_anomalies",
    "res rcs",
    """SELECT day, sid, restarted, coalesce(anomaly, 'regular') AS anomaly, count(*) AS n FROM (
SELECT day, sid, true AS restarted, anomaly FROM res UNION ALL SELECT day, sid, false, anomaly FROM rcs) GROUP BY ALL""",
)
def rough_anomalies(p):
    """Irregular order messages by kind, for books that restart and for one carried through."""
    out = None
    for restart in (True, False):
        rows = epochs.unkeyed(p.effects(restart))
        part = rows.groupBy("day", "sid", F.lit(restart).alias("restarted"), F.coalesce("anomaly", F.lit("regular")).alias("anomaly")).agg(
            F.count_distinct("rpt").alias("n")  # a message has two effects at most
        )
        out = part if out is None else out.unionByName(part)
    return out


_QUOTE = "b, a, CAST(qb AS BIGINT) AS qb, CAST(qa AS BIGINT) AS qa, CAST(nb AS BIGINT) AS nb, CAST(na AS BIGINT) AS na"


@register("rough_quotes", "req", f"SELECT day, sid, epoch, rpt, seq, t_ms, {_QUOTE} FROM req")
def rough_quotes(p):
    """Best quote after every message; the book is empty again after each break."""
    return epochs.unkeyed(p.quotes()).select(
        "day", "sid", "epoch", "rpt", "seq", "t_ms", "b", "a", "qb", "qa", "nb", "na"
    )


@register(
    "restart_agreement",
    "req rcq",
    """SELECT e.day, e.sid, count(*) AS compared, CAST(0 AS BIGINT) AS only_restarted, CAST(0 AS BIGINT) AS only_carried,
count(*) FILTER (e.b IS DISTINCT FROM c.b OR e.a IS DISTINCT FROM c.a OR e.qb IS DISTINCT FROM c.qb OR e.qa IS DISTINCT FROM c.qa) AS different,
count(*) FILTER (e.b IS DISTINCT FROM c.b) AS different_bid, count(*) FILTER (e.a IS DISTINCT FROM c.a) AS different_ask
FROM req e JOIN rcq c ON c.day = e.day AND c.rpt = e.rpt GROUP BY e.day, e.sid""",
)
def restart_agreement(p):
    """Two reconstructions compared at every message: cleared at each break, and carried through."""
    columns = ["day", "sid", "rpt", "b", "a", "qb", "qa"]
    both = reconciled(
        epochs.unkeyed(p.quotes(True)).select(columns),
        epochs.unkeyed(p.quotes(False)).select(columns),
        ["day", "sid", "rpt"],
        ("restarted", "carried"),
    )
    return both.groupBy("day", "sid").agg(
        F.count_if(F.col("found_in") == "both").alias("compared"),
        F.count_if(F.col("found_in") == "restarted").alias("only_restarted"),
        F.count_if(F.col("found_in") == "carried").alias("only_carried"),
        F.count_if(F.size("differing") > 0).alias("different"),
        F.count_if(F.array_contains("differing", "b")).alias("different_bid"),
        F.count_if(F.array_contains("differing", "a")).alias("different_ask"),
    )


# ------------------------------------------------------------------ three levels
oracle.block("rtop", "reh", f"""
SELECT *, row_number() OVER w AS place, CASE e_side WHEN 0 THEN max(e_tick) OVER s - e_tick ELSE e_tick - min(e_tick) OVER s END AS away FROM reh
WHERE n > 0 AND q > 0 WINDOW w AS (PARTITION BY day, sid, rpt, e_side ORDER BY CASE e_side WHEN 0 THEN -e_tick ELSE e_tick END), s AS (PARTITION BY day, sid, rpt, e_side)""")
oracle.block("rmid", "req rtop", f"""
SELECT q.day, q.sid, q.epoch, q.rpt, q.t_ms, q.b, q.a, q.qb, q.qa,
       sum(t.q) FILTER (t.e_side = 0) AS tb, sum(t.q) FILTER (t.e_side = 1) AS ta,
       CAST(sum(t.q * t.e_tick) FILTER (t.e_side = 0) AS DOUBLE) / sum(t.q) FILTER (t.e_side = 0) AS vb,
       CAST(sum(t.q * t.e_tick) FILTER (t.e_side = 1) AS DOUBLE) / sum(t.q) FILTER (t.e_side = 1) AS va
FROM req q LEFT JOIN rtop t ON t.day = q.day AND t.sid = q.sid AND t.rpt = q.rpt AND t.place <= {levels.BEST} AND t.away < {levels.REACH} GROUP BY ALL""")


@register(
    "three_level_mid",
    "rmid",
    """SELECT day, sid, epoch, rpt, CASE WHEN b < a THEN (b + a) / 2.0 END AS mid,
CASE WHEN b < a AND qb > 0 AND qa > 0 THEN round(CAST(qb * a + qa * b AS DOUBLE) / (qb + qa), 9) END AS micro,
CASE WHEN b < a AND qb > 0 AND qa > 0 THEN round((tb * va + ta * vb) / (tb + ta), 9) END AS mid3 FROM rmid""",
)
def three_level_mid(p):
    """Plain mid, microprice and three-level mid after every message."""
    return rounded(
        epochs.unkeyed(p.quotes()).select(
            "day", "sid", "epoch", "rpt", levels.plain_mid().alias("mid"),
            levels.micro_price().alias("micro"), levels.level_mid().alias("mid3"),
        )
    )


# ------------------------------------------------------------------ time at each spread
oracle.block("rst", "req", f"""
SELECT *, CASE WHEN to_ms < from_ms THEN 'negative' WHEN to_ms - from_ms > {st.MAX_STANDING_MS} THEN 'gap' WHEN b IS NULL OR a IS NULL THEN 'one_sided'
 WHEN a < b THEN 'crossed' WHEN a = b THEN 'locked' ELSE 'normal' END AS kind, a - b AS spread FROM (
SELECT day, sid, epoch, rpt, lag(t_ms) OVER w AS from_ms, t_ms AS to_ms, lag(b) OVER w AS b, lag(a) OVER w AS a, lag(nb) OVER w AS nb, lag(na) OVER w AS na
FROM req WINDOW w AS (PARTITION BY day, sid, epoch ORDER BY rpt)) WHERE from_ms IS NOT NULL""")
oracle.block("rsh", "rst", """
SELECT s.day, s.sid, h.hour, s.spread, greatest(s.from_ms, h.hour * 3600000) AS f, least(s.to_ms, (h.hour + 1) * 3600000) AS t
FROM rst s JOIN (SELECT unnest(range(0, 24)) AS hour) h ON s.from_ms < (h.hour + 1) * 3600000 AND s.to_ms > h.hour * 3600000
WHERE s.kind IN ('crossed', 'locked', 'normal') AND s.to_ms > s.from_ms""")


@register(
    "spread_time_hour",
    "rsh",
    """SELECT day, sid, hour, spread, CAST(sum(t - f) AS BIGINT) AS ms, CAST(sum(sum(t - f)) OVER (PARTITION BY day, sid, hour) AS BIGINT) AS covered_ms,
round(CAST(sum(t - f) AS DOUBLE) / sum(sum(t - f)) OVER (PARTITION BY day, sid, hour), 9) AS share FROM rsh GROUP BY day, sid, hour, spread""",
)
def spread_time_hour(p):
    """Time at each spread in every hour, intervals cut at the hour."""
    return rounded(st.spread_by_hour(p.standing, ["day", "sid"]))


@register(
    "spread_time_day",
    "rst",
    """SELECT r.day, r.sid, count(*) AS intervals, CAST(sum(CASE WHEN kind IN ('crossed', 'locked', 'normal') THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS covered_ms,
round(sum(CASE WHEN kind = 'crossed' THEN to_ms - from_ms ELSE 0 END) / nullif(CAST(sum(CASE WHEN kind IN ('crossed', 'locked', 'normal') THEN to_ms - from_ms ELSE 0 END) AS DOUBLE), 0), 9) AS crossed_share,
round(sum(CASE WHEN kind = 'locked' THEN to_ms - from_ms ELSE 0 END) / nullif(CAST(sum(CASE WHEN kind IN ('crossed', 'locked', 'normal') THEN to_ms - from_ms ELSE 0 END) AS DOUBLE), 0), 9) AS locked_share,
any_value(x.least) AS least_spread,
round(sum(CASE WHEN kind = 'normal' AND spread = x.least THEN to_ms - from_ms ELSE 0 END) / nullif(CAST(sum(CASE WHEN kind = 'normal' THEN to_ms - from_ms ELSE 0 END) AS DOUBLE), 0), 9) AS least_share,
count(*) FILTER (kind = 'one_sided') AS one_sided, count(*) FILTER (kind = 'gap') AS gaps,
CAST(sum(CASE WHEN kind = 'gap' THEN to_ms - from_ms ELSE 0 END) AS BIGINT) AS gap_ms, count(*) FILTER (kind = 'negative') AS reversals
FROM rst r LEFT JOIN (SELECT day, sid, min(spread) AS least FROM rst WHERE kind = 'normal' AND to_ms > from_ms GROUP BY ALL) x ON x.day = r.day AND x.sid = r.sid
GROUP BY r.day, r.sid""",
)
def spread_time_day(p):
    """Covered time of a day, shares of crossed, locked and one-tick time, and irregular intervals."""
    return rounded(st.spread_by_day(p.standing, ["day", "sid"]))


@register(
    "spread_time_all",
    "rst",
    """SELECT sid, spread, CAST(sum(to_ms - from_ms) AS BIGINT) AS ms, round(CAST(sum(to_ms - from_ms) AS DOUBLE) / sum(sum(to_ms - from_ms)) OVER (PARTITION BY sid), 9) AS share
FROM rst WHERE kind IN ('crossed', 'locked', 'normal') AND to_ms > from_ms GROUP BY sid, spread""",
)
def spread_time_all(p):
    """Time at each spread over the whole sample."""
    whole = st.spread_by_hour(p.standing, ["sid"]).groupBy("sid", "spread").agg(F.sum("ms").alias("ms"))
    total = whole.groupBy("sid").agg(F.sum("ms").alias("_all"))
    return rounded(whole.join(total, "sid").select("sid", "spread", "ms", (F.col("ms") / F.col("_all")).alias("share")))


@register(
    "crossed_pairs",
    "rst",
    """SELECT sid, b, a, CAST(sum(to_ms - from_ms) AS BIGINT) AS ms, CAST(min(nb) AS BIGINT) AS least_bid_orders, CAST(min(na) AS BIGINT) AS least_ask_orders,
min(from_ms) AS first_ms, max(to_ms) AS last_ms FROM rst WHERE kind = 'crossed' GROUP BY sid, b, a ORDER BY ms DESC, sid, b, a LIMIT 15""",
)
def crossed_pairs(p):
    """The fifteen crossed pairs that stood longest."""
    return st.crossed_pairs(p.standing, ["sid"])


@register(
    "hourly_coverage",
    "rst rsh",
    """SELECT coalesce(m.day, c.day) AS day, coalesce(m.sid, c.sid) AS sid, coalesce(m.hour, c.hour) AS hour, coalesce(messages, 0) AS messages, coalesce(ms, 0) AS covered_ms
FROM (SELECT day, sid, to_ms // 3600000 AS hour, count(*) AS messages FROM rst GROUP BY ALL) m
FULL JOIN (SELECT day, sid, hour, CAST(sum(t - f) AS BIGINT) AS ms FROM rsh GROUP BY ALL) c ON c.day = m.day AND c.sid = m.sid AND c.hour = m.hour""",
)
def hourly_coverage(p):
    """Messages and covered time of every hour."""
    return st.coverage_by_hour(p.standing, ["day", "sid"])
