"""Queries of the nested feed, its profile and queue competition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.functions.constants import KEY
from tickloom.plans import competition as cp
from tickloom.plans import feed_profile as fp
from tickloom.queries import register, rounded
from tickloom.sources import feed as fd
from tickloom.sources import order_flow

oracle.block("fe", "msg ord", """
SELECT m.day, m.seq AS msg_seq_num, m.rpt, CASE WHEN m.typ = 'T' THEN 2 ELSE m.side END AS side,
       CASE m.typ WHEN 'C' THEN 1 WHEN 'D' THEN 2 ELSE 0 END AS action, CASE WHEN m.typ = 'T' THEN -1 ELSE m.oid END AS oid,
       CAST(m.tick * 5 AS DOUBLE) AS price, m.qty AS size, CASE WHEN m.retail THEN 'RL' END AS trade_condition, m.firm, m.t_ms,
       CAST(m.day AS BIGINT) * 1000000000 + (m.t_ms + 10800000) // 3600000 * 10000000 + (m.t_ms + 10800000) // 60000 % 60 * 100000
         + (m.t_ms + 10800000) // 1000 % 60 * 1000 + (m.t_ms + 10800000) % 1000 AS sending_time
FROM msg m""")


def feed_of(p):
    p.store.table(
        "feed", lambda: fd.nested_feed(p.messages, order_flow.status_messages(p.numbered))
    )
    return fd.read_feed(p.spark, f"{p.store.path}/feed")


@register(
    "feed_flatten",
    "fe",
    "SELECT day, rpt, msg_seq_num, sending_time, side, action, oid, round(price, 6) AS price, size, trade_condition FROM fe",
)
def feed_flatten(p):
    flat = fd.flat_orders(feed_of(p), sid=1)
    return rounded(flat.select("day", "rpt", "msg_seq_num", "sending_time", "side", "action", "oid", "price", "size", "trade_condition"), 6)


@register(
    "feed_by_clock",
    "fe",
    "SELECT day, sending_time AS time_seq, msg_seq_num, CAST(row_number() OVER (PARTITION BY day, msg_seq_num ORDER BY rpt) - 1 AS INTEGER) AS pos, CAST(side AS VARCHAR) AS entry_type, action, round(price, 6) AS price FROM fe",
)
def feed_by_clock(p):
    return rounded(fd.thesis_rows(feed_of(p), sid=1).drop("sid"), 6)


@register(
    "feed_to_messages",
    "msg",
    "SELECT day, seq, t_ms, rpt, typ, side, tick, qty, CASE WHEN typ = 'T' THEN -1 ELSE oid END AS oid, retail FROM msg",
)
def feed_to_messages(p):
    rows = fd.require_on_grid(fd.to_messages(fd.flat_orders(feed_of(p))))
    return rows.select("day", "seq", "t_ms", "rpt", "typ", "side", "tick", "qty", "oid", "retail")


@register(
    "trade_list",
    "fe",
    "SELECT day, rpt, sending_time, size FROM fe WHERE side = 2",
)
def trade_list(p):
    return fd.flat_orders(feed_of(p)).filter("side = 2").select("day", "rpt", "sending_time", "size")


@register(
    "status_feed",
    "cal",
    """SELECT day, CAST(day AS BIGINT) * 1000000000 + h AS sending_time, s AS security_trading_status FROM cal,
(SELECT unnest([21, 17, 101, 18]) AS s, unnest([113000000, 120000000, 210000000, 211000000]) AS h)
UNION ALL SELECT day, CAST(day AS BIGINT) * 1000000000 + h, s FROM cal, (SELECT unnest([2, 17]) AS s, unnest([150000000, 150900000]) AS h) WHERE x0 IS NOT NULL""",
)
def status_feed(p):
    return fd.status_messages(feed_of(p)).select("day", "sending_time", "security_trading_status")


@register(
    "instrument_volume",
    "fe",
    """SELECT day, CAST(1 AS BIGINT) AS largest_sid, CAST(sum(size) AS BIGINT) AS largest_volume, CAST(sum(size) AS BIGINT) AS target_volume, true AS target_is_largest
FROM fe WHERE side = 2 GROUP BY day""",
)
def instrument_volume(p):
    return fd.target_has_largest_volume(fd.volume_by_instrument(feed_of(p)), 1)


@register(
    "feed_profile",
    "fe",
    """SELECT CAST(side AS VARCHAR) AS entry_type, count(*) AS n, 1.0::DOUBLE AS fill_md_update_action,
CASE WHEN side = 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS fill_order_id, 1.0::DOUBLE AS fill_md_entry_size, round(CAST(count(trade_condition) AS DOUBLE) / count(*), 9) AS fill_trade_condition,
CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fill_md_entry_buyer, CASE WHEN side = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS fill_md_entry_seller,
CASE WHEN side = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS fill_trade_id, 1.0::DOUBLE AS fill_md_entry_px FROM fe GROUP BY side""",
)
def feed_profile(p):
    return rounded(fp.fill_rates(feed_of(p)))


@register(
    "entry_roles",
    "fe",
    """SELECT CAST(side AS VARCHAR) AS entry_type, count(*) AS n, CASE WHEN side = 2 THEN 'trade' ELSE 'book' END AS role,
CASE side WHEN 0 THEN 'bid' WHEN 1 THEN 'ask' END AS book_side FROM fe GROUP BY side""",
)
def entry_roles(p):
    return fp.roles(fp.fill_rates(feed_of(p)))


@register(
    "entry_cross_table",
    "fe",
    """SELECT CAST(side AS VARCHAR) AS entry_type, count(*) FILTER (action = 0) AS new, count(*) FILTER (action = 1) AS change,
count(*) FILTER (action = 2) AS delete, count(*) FILTER (action IS NULL OR action NOT IN (0, 1, 2)) AS other FROM fe GROUP BY side""",
)
def entry_cross_table(p):
    return fp.cross_table(feed_of(p))


@register(
    "seq_integrity",
    "num",
    """SELECT day, min(n) AS first_seq, max(n) AS last_seq, count(*) AS n, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS missing FROM num GROUP BY day""",
)
def seq_integrity(p):
    return fp.sequence_integrity(feed_of(p))


@register(
    "price_steps",
    "fe",
    """SELECT CAST(side AS VARCHAR) AS entry_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS prices, min(step) AS min_step, any_value(median) AS median FROM (
SELECT side, price, n, lead(price) OVER (PARTITION BY side ORDER BY price) - price AS step, median FROM (
SELECT side, price, count(*) AS n FROM fe GROUP BY ALL) JOIN (SELECT side, quantile_cont(price, 0.5) AS median FROM fe GROUP BY side) USING (side)) GROUP BY side""",
)
def price_steps(p):
    return fp.price_steps(feed_of(p))


@register(
    "clock_audit",
    "fe",
    """SELECT field, count(*) AS n, CAST(min(length(CAST(v AS VARCHAR))) AS INTEGER) AS min_digits, CAST(max(length(CAST(v AS VARCHAR))) AS INTEGER) AS max_digits,
count(DISTINCT v) AS distinct, round(avg(CASE WHEN v % 1000 = 0 THEN 1.0 ELSE 0.0 END), 9) AS share_round_1000 FROM (
SELECT 'sending_time' AS field, sending_time AS v FROM fe UNION ALL SELECT 'md_entry_time', t_ms * 1000000 FROM fe UNION ALL SELECT 'md_insert_time', t_ms FROM fe)
GROUP BY field""".replace("AS distinct", 'AS "distinct"'),
)
def clock_audit(p):
    return rounded(fp.clock_audit(feed_of(p)))


@register(
    "counterparties",
    "fe",
    """SELECT CAST(side AS VARCHAR) AS entry_type, CAST(sum(n) AS BIGINT) AS n, count(*) AS firms, round(CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * sum(n)), 9) AS concentration,
round(CAST(sum(n * n) AS DOUBLE) / (CAST(sum(n) AS DOUBLE) * sum(n)) * count(*), 9) AS ratio_to_equal
FROM (SELECT side, firm, count(*) AS n FROM fe WHERE side < 2 GROUP BY ALL) GROUP BY side""",
)
def counterparties(p):
    return rounded(fp.counterparties(feed_of(p)))


# ------------------------------------------------------------------ competition
def actions_of(p):
    labelled = p.store.table("touch_actions", lambda: cp.touch_actions(p.tape))
    context = p.store.table("touch_context", lambda: cp.with_context(labelled))
    return p.store.table("touch_aggressions", lambda: cp.with_aggressions(context))


oracle.block("ta", "tape", """
SELECT t.*, t.rpt AS r, CASE WHEN t.side = 0 THEN t.b0 ELSE t.a0 END AS own, i.firm AS incoming,
 EXISTS (SELECT 1 FROM tape x WHERE x.day = t.day AND x.seq = t.seq AND x.typ = 'T' AND x.tick = t.p_tick) AS hit
FROM tape t LEFT JOIN tape i ON i.day = t.day AND i.seq = t.seq AND i.typ = 'N' WHERE t.typ <> 'T'""")
oracle.block("act", "ta life", """
SELECT t.*, CASE WHEN t.typ <> 'D' AND (t.own IS NULL OR (t.side = 0 AND t.tick > t.own) OR (t.side = 1 AND t.tick < t.own)) THEN 'improve'
                 WHEN t.typ <> 'D' AND t.tick = t.own THEN 'join'
                 WHEN t.typ = 'D' AND t.p_tick = t.own THEN CASE WHEN t.hit THEN 'execution' ELSE 'cancel' END END AS action,
       t.typ = 'D' AND coalesce(t.p_tick = t.own, false) AND NOT EXISTS (
         SELECT 1 FROM life l WHERE l.day = t.day AND l.side = t.side AND l.tick = t.p_tick AND l.r0 < t.rpt AND (l.r1 IS NULL OR l.r1 > t.rpt)) AS depletes
FROM ta t""")
oracle.block("actm", "act", """
SELECT a.*, arg_max(CASE WHEN m.action = 'improve' THEN 'improve' ELSE m.action END, m.rpt) AS last_mark
FROM act a LEFT JOIN act m ON m.day = a.day AND m.side = a.side AND m.rpt < a.rpt AND (m.depletes OR m.action = 'improve')
WHERE a.action = 'improve' GROUP BY ALL""")


@register(
    "touch_actions",
    "act",
    "SELECT day, rpt, side, action, depletes FROM act WHERE action IS NOT NULL",
)
def touch_actions(p):
    return actions_of(p).filter("action IS NOT NULL").select("day", "rpt", "side", "action", "depletes")


@register(
    "refill_after_execution",
    "actm",
    """SELECT day, side, count(*) AS improvements, count(*) FILTER (last_mark = 'execution') AS after_execution,
count(*) FILTER (last_mark IS DISTINCT FROM 'execution') AS spontaneous FROM actm GROUP BY ALL""",
)
def refill_after_execution(p):
    rows = actions_of(p).filter("action = 'improve'")
    after = F.coalesce("after_execution", F.lit(False))
    return rows.groupBy("day", "side").agg(
        F.count("*").alias("improvements"),
        F.count_if(after).alias("after_execution"),
        F.count_if(~after).alias("spontaneous"),
    )


oracle.block("race", "act", """
SELECT day, side, improved, arg_min(lat_ms, rpt) AS latency_ms, arg_min(lat_n, rpt) AS latency_msgs, arg_min(t_ms, rpt) AS t_ms FROM (
SELECT j.day, j.side, j.rpt, j.t_ms, max(i.rpt) AS improved, j.t_ms - arg_max(i.t_ms, i.rpt) AS lat_ms, j.rpt - max(i.rpt) AS lat_n,
       arg_max(i.tick, i.rpt) = j.tick AS same
FROM act j JOIN act i ON i.day = j.day AND i.side = j.side AND i.action = 'improve' AND i.rpt < j.rpt WHERE j.action = 'join' GROUP BY j.day, j.side, j.rpt, j.t_ms, j.tick)
WHERE same GROUP BY ALL""")


@register(
    "priority_races",
    "race",
    "SELECT day, side, improved AS improved_rpt, t_ms, latency_ms, latency_msgs FROM race",
)
def priority_races(p):
    return cp.races(actions_of(p)).drop("sid")


oracle.block("answer", "act", f"""
SELECT day, side, hit_rpt, arg_min(t_ms, rpt) AS t_ms, arg_min(firm, rpt) = arg_min(agg, rpt) AS by_aggressor, arg_min(t_ms - hit_ms, rpt) AS gap FROM (
SELECT i.day, i.side, i.rpt, i.t_ms, i.firm, max(h.rpt) AS hit_rpt, arg_max(h.t_ms, h.rpt) AS hit_ms, arg_max(h.incoming, h.rpt) AS agg
FROM act i JOIN act h ON h.day = i.day AND h.side = 1 - i.side AND h.depletes AND h.action = 'execution' AND h.rpt < i.rpt
WHERE i.action = 'improve' GROUP BY i.day, i.side, i.rpt, i.t_ms, i.firm) GROUP BY day, side, hit_rpt""")


@register(
    "aggression_answers",
    "answer",
    "SELECT day, side, hit_rpt, t_ms, by_aggressor FROM answer WHERE gap <= 1000",
)
def aggression_answers(p):
    return cp.answers(actions_of(p)).drop("sid")


@register(
    "aggressor_origin",
    "act",
    """SELECT day, count(*) AS aggressions, CAST(0 AS BIGINT) AS from_reprice, count(*) AS from_new_order FROM act
WHERE depletes AND action = 'execution' GROUP BY day""",
)
def aggressor_origin(p):
    return cp.aggressor_origin(actions_of(p))


oracle.block("actp", "act pk num", "SELECT a.*, p.t_ms AS born_ms FROM act a LEFT JOIN num o ON o.day = a.day AND o.event_id = a.oid LEFT JOIN pk p ON p.day = a.day AND p.n = o.n")
oracle.block("stand", "act life", """
SELECT a.day, a.rpt, a.t_ms, a.b0, a.a0, lag(a.t_ms) OVER (PARTITION BY a.day ORDER BY a.rpt) AS prev_ms,
 (SELECT count(*) FROM life l WHERE l.day = a.day AND l.side = 0 AND l.tick = a.b0 AND l.r0 < a.rpt AND (l.r1 IS NULL OR l.r1 >= a.rpt)) AS nb0,
 (SELECT count(*) FROM life l WHERE l.day = a.day AND l.side = 1 AND l.tick = a.a0 AND l.r0 < a.rpt AND (l.r1 IS NULL OR l.r1 >= a.rpt)) AS na0
FROM act a""")


@register(
    "queue_competition",
    "actp actm race answer stand tape",
    """SELECT k.day, k.bucket, k.side, k.joins, k.cancels, k.executions, coalesce(m.spontaneous, 0) AS spontaneous, coalesce(m.after_execution, 0) AS after_execution,
k.moved_by_execution, k.moved_by_cancel, round(k.rest_ms, 6) AS rest_ms, round(r.race_ms, 6) AS race_ms, coalesce(a.by_aggressor, 0) AS by_aggressor, coalesce(a.by_other, 0) AS by_other,
round(CASE WHEN k.side = 0 THEN h.orders_bid ELSE h.orders_ask END, 6) AS orders_at_touch, round(h.spread_mean, 6) AS spread_mean, CAST(coalesce(h.time_ms, 0) AS BIGINT) AS time_ms,
CAST(coalesce(v.volume, 0) AS BIGINT) AS volume, coalesce(v.trades, 0) AS trades,
round(CAST(k.joins - k.cancels AS DOUBLE) / nullif(k.joins + k.cancels, 0), 9) AS competition
FROM (SELECT day, t_ms // 3600000 * 3600000 AS bucket, side, count(*) FILTER (action = 'join') AS joins, count(*) FILTER (action = 'cancel') AS cancels,
  count(*) FILTER (action = 'execution') AS executions, count(*) FILTER (action = 'execution' AND depletes) AS moved_by_execution,
  count(*) FILTER (action = 'cancel' AND depletes) AS moved_by_cancel, avg(t_ms - born_ms) FILTER (action IN ('cancel', 'execution')) AS rest_ms FROM actp GROUP BY ALL) k
LEFT JOIN (SELECT day, t_ms // 3600000 * 3600000 AS bucket, side, count(*) FILTER (last_mark = 'execution') AS after_execution, count(*) FILTER (last_mark IS DISTINCT FROM 'execution') AS spontaneous FROM actm GROUP BY ALL) m USING (day, bucket, side)
LEFT JOIN (SELECT day, t_ms // 3600000 * 3600000 AS bucket, side, avg(latency_ms) AS race_ms FROM race GROUP BY ALL) r USING (day, bucket, side)
LEFT JOIN (SELECT day, t_ms // 3600000 * 3600000 AS bucket, side, count(*) FILTER (by_aggressor) AS by_aggressor, count(*) FILTER (NOT by_aggressor) AS by_other FROM answer WHERE gap <= 1000 GROUP BY ALL) a USING (day, bucket, side)
LEFT JOIN (SELECT day, prev_ms // 3600000 * 3600000 AS bucket, sum(nb0 * (t_ms - prev_ms)) / CAST(sum(t_ms - prev_ms) AS DOUBLE) AS orders_bid, sum(na0 * (t_ms - prev_ms)) / CAST(sum(t_ms - prev_ms) AS DOUBLE) AS orders_ask,
  sum((a0 - b0) * (t_ms - prev_ms)) / CAST(sum(t_ms - prev_ms) AS DOUBLE) AS spread_mean, sum(t_ms - prev_ms) AS time_ms
  FROM stand WHERE t_ms - prev_ms > 0 AND t_ms - prev_ms < 60000 AND a0 > b0 GROUP BY ALL) h USING (day, bucket)
LEFT JOIN (SELECT day, t_ms // 3600000 * 3600000 AS bucket, sum(qty) AS volume, count(*) AS trades FROM tape WHERE typ = 'T' GROUP BY ALL) v USING (day, bucket)""",
)
def queue_competition(p):
    panel = p.store.table(
        "competition", lambda: cp.competition_panel(actions_of(p), p.tape, 3_600_000)
    )
    return panel.select(
        "day", "bucket", "side", "joins", "cancels", "executions", "spontaneous", "after_execution",
        "moved_by_execution", "moved_by_cancel", F.round("rest_ms", 6).alias("rest_ms"),
        F.round("race_ms", 6).alias("race_ms"), "by_aggressor", "by_other",
        F.round("orders_at_touch", 6).alias("orders_at_touch"), F.round("spread_mean", 6).alias("spread_mean"),
        "time_ms", "volume", "trades", F.round("competition", 9).alias("competition"),
    )


oracle.block("hes", "act tape", """
SELECT a.day, a.rpt, a.t_ms, a.side, a.p_tick AS level, CASE WHEN a.depletes THEN 'depletion' ELSE 'partial' END AS kind,
       CASE WHEN a.depletes THEN CASE WHEN a.side = 0 THEN a.qb0 ELSE a.qa0 END ELSE a.p_qty END AS volume,
       (a.b0 + a.a0) / 2.0 AS mid0, CASE WHEN a.side = 0 THEN -1 ELSE 1 END AS sgn,
       coalesce((SELECT sum(x.qty) FROM tape x WHERE x.day = a.day AND x.typ IN ('N', 'C') AND x.side = a.side AND x.tick = a.p_tick
                 AND x.rpt > a.rpt AND x.t_ms <= a.t_ms + 5000), 0) AS refilled
FROM act a WHERE a.action = 'execution' AND a.b0 < a.a0""")


@register(
    "hesitation",
    "hes tape",
    """SELECT h.day, h.rpt, h.side, h.kind, CAST(h.volume AS BIGINT) AS volume, z.h, CAST(h.refilled AS BIGINT) AS refilled,
CASE WHEN CAST(h.refilled AS DOUBLE) / h.volume >= 1 THEN 'full' WHEN h.refilled > 0 THEN 'partial' ELSE 'none' END AS refill_class,
round(h.sgn * ((SELECT arg_max((x.b + x.a) / 2.0, x.rpt) FROM tape x WHERE x.day = h.day AND x.b < x.a AND x.t_ms < h.t_ms + z.h) - h.mid0) + 0.0, 9) AS impact
FROM hes h, (SELECT unnest([1000, 5000, 30000]) AS h) z""",
)
def hesitation(p):
    rows = hesitation_of(p)
    return rounded(rows.select("day", "rpt", "side", "kind", "volume", "h", "refilled", "refill_class", "impact"))


def hesitation_of(p):
    return p.store.table("hesitation", lambda: cp.hesitation(actions_of(p), p.tape))


_HES_CUTS = ", ".join(f"quantile_cont(volume, {q}) AS q{i}" for i, q in enumerate((0.2, 0.4, 0.6, 0.8), 1))
oracle.block("hesi", "hes tape", """
SELECT h.day, h.rpt, h.t_ms, h.kind, h.volume, z.h, CASE WHEN CAST(h.refilled AS DOUBLE) / h.volume >= 1 THEN 'full' WHEN h.refilled > 0 THEN 'partial' ELSE 'none' END AS refill_class,
h.sgn * ((SELECT arg_max((x.b + x.a) / 2.0, x.rpt) FROM tape x WHERE x.day = h.day AND x.b < x.a AND x.t_ms < h.t_ms + z.h) - h.mid0) + 0.0 AS impact
FROM hes h, (SELECT unnest([1000, 5000, 30000]) AS h) z""")


@register(
    "hesitation_impact",
    "hesi",
    f"""SELECT kind, refill_class, 1 + (volume > q1)::INT + (volume > q2)::INT + (volume > q3)::INT + (volume > q4)::INT AS quintile, h, count(*) AS n,
round(avg(impact), 6) AS impact, round(1.96 * stddev_samp(impact) / sqrt(count(*)), 6) AS band
FROM hesi, (SELECT {_HES_CUTS} FROM hesi) WHERE impact IS NOT NULL GROUP BY ALL""",
)
def hesitation_impact(p):
    rows = cp.volume_quintile(hesitation_of(p))
    return rounded(cp.impact_by_class(rows, "kind", "refill_class", "quintile"), 6)


oracle.block("acn", "act", "SELECT *, row_number() OVER (PARTITION BY day ORDER BY rpt) AS om FROM act")
oracle.block("rfp", "acn hes", """
SELECT h.day, h.rpt, min(a.rpt) AS first_rpt, arg_min(a.t_ms, a.rpt) AS first_t, arg_min(a.om, a.rpt) AS first_n,
       min(a.rpt) FILTER (a.back >= h.volume) AS full_rpt, arg_min(a.t_ms, a.rpt) FILTER (a.back >= h.volume) AS full_t, arg_min(a.om, a.rpt) FILTER (a.back >= h.volume) AS full_n
FROM hes h JOIN (SELECT h.day, h.rpt AS event, a.rpt, a.t_ms, a.om, sum(a.qty) OVER (PARTITION BY h.day, h.rpt ORDER BY a.rpt) AS back
 FROM hes h JOIN acn a ON a.day = h.day AND a.typ IN ('N', 'C') AND a.side = h.side AND a.tick = h.level AND a.rpt > h.rpt) a ON a.day = h.day AND a.event = h.rpt GROUP BY h.day, h.rpt""")


@register(
    "refill_passage",
    "hes acn rfp",
    """SELECT h.day, h.rpt, h.side, h.kind, CAST(h.volume AS BIGINT) AS volume,
CASE WHEN r.first_t - h.t_ms < 30000 THEN r.first_t - h.t_ms END AS first_ms, CASE WHEN r.first_t - h.t_ms < 30000 THEN r.first_n - e.om END AS first_messages,
CASE WHEN r.full_t - h.t_ms < 30000 THEN r.full_t - h.t_ms END AS full_ms, CASE WHEN r.full_t - h.t_ms < 30000 THEN r.full_n - e.om END AS full_messages
FROM hes h JOIN acn e ON e.day = h.day AND e.rpt = h.rpt LEFT JOIN rfp r ON r.day = h.day AND r.rpt = h.rpt""",
)
def refill_passage(p):
    """Time and messages until a level is first added to, and until all taken volume is back."""
    rows = p.store.table("refill_passage", lambda: cp.refill_passage(actions_of(p)))
    return rows.select("day", "rpt", "side", "kind", "volume", "first_ms", "first_messages", "full_ms", "full_messages")


oracle.block("ctl", "acn tape", f"""
SELECT c.day, c.rpt, c.t_ms, z.h, CASE WHEN c.om // {cp.CONTROL_STEP} % 2 = 1 THEN 1 ELSE -1 END
 * ((SELECT arg_max((x.b + x.a) / 2.0, x.rpt) FROM tape x WHERE x.day = c.day AND x.b < x.a AND x.t_ms < c.t_ms + z.h) - (c.b0 + c.a0) / 2.0) + 0.0 AS impact
FROM acn c, (SELECT unnest([1000, 5000, 30000]) AS h) z WHERE c.typ <> 'D' AND c.b0 < c.a0 AND c.om % {cp.CONTROL_STEP} = 0""")


def controls_of(p):
    return p.store.table("control_impacts", lambda: cp.control_impacts(actions_of(p), p.tape))


@register("hesitation_controls", "ctl", "SELECT day, rpt, h, round(impact, 9) AS impact FROM ctl")
def hesitation_controls(p):
    """Mid moves after every tenth order message that removes nothing."""
    return rounded(controls_of(p).select("day", "rpt", "h", "impact"))


@register(
    "hesitation_excess",
    "hesi ctl",
    """SELECT e.kind, e.refill_class, e.h, count(*) AS n, round(avg(e.impact), 6) AS impact, round(avg(c.control), 6) AS control, round(avg(e.impact - c.control), 6) AS excess
FROM hesi e JOIN (SELECT t_ms // 3600000 AS hour, h, avg(impact) AS control FROM ctl WHERE impact IS NOT NULL GROUP BY ALL) c ON c.hour = e.t_ms // 3600000 AND c.h = e.h
WHERE e.impact IS NOT NULL GROUP BY e.kind, e.refill_class, e.h""",
)
def hesitation_excess(p):
    """Impact after executions less that of controls of the same hour."""
    return rounded(cp.excess_over_controls(hesitation_of(p), controls_of(p)).drop("sid"), 6)
