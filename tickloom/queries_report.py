"""Queries of the reports: overviews, diagnostics side by side, window logs, books at chosen events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom import oracle
from tickloom.functions.constants import KEY
from tickloom.plans import diagnostics as dg
from tickloom.plans import overview as ov
from tickloom.plans import panels
from tickloom.plans import replay_panel as rp
from tickloom.plans import window_log as wl
from tickloom.plans.reconcile import reconciled
from tickloom.plans.pipeline import ExcludingPipeline, pipeline
from tickloom.queries import ORACLE, QUERIES, panel_of, register, rounded
from tickloom.queries_inference import REPS, SEED, draw_blocks
from tickloom.queries_tape import replay_panel_of
from tickloom.sources import definitions as sd
from tickloom.streaming import windows as sw

# ------------------------------------------------------------------ overviews
_NUMBERED = ", ".join(
    f"count(*) FILTER (least(a0 - b0, 4) = {i}) AS spread_n_{k}" for i, k in enumerate(ov.LENGTHS, 1)
)
oracle.block("ovn", "tape", f"""
SELECT day, t0 // 60000 * 60000 AS bucket, {_NUMBERED} FROM tape WHERE t_ms > t0 AND a0 > b0 AND t_ms - t0 <= 2000 GROUP BY ALL""")
oracle.block("ovr", "rp_1m ovn", f"""
SELECT r.*, {", ".join(f"coalesce(n.spread_n_{k}, 0) AS spread_n_{k}" for k in ov.LENGTHS)}, r.bucket // 3600000 AS hour, r.bucket // 300000 * 300000 AS clock
FROM rp_1m r LEFT JOIN ovn n ON n.day = r.day AND n.bucket = r.bucket WHERE r.bucket // 60000 BETWEEN 540 AND 1080""")


def _length_sql(kind: str) -> tuple[str, list[str]]:
    total = " + ".join(f"sum(spread_{kind}_{k})" for k in ov.LENGTHS)
    weighted = " + ".join(f"{i} * sum(spread_{kind}_{k})" for i, k in enumerate(ov.LENGTHS, 1))
    per = lambda x: f"CAST({x} AS DOUBLE) / nullif({total}, 0)"
    return per(weighted), [per(f"sum(spread_{kind}_{k})") for k in ov.LENGTHS]


_BY_TIME, _TIME_SHARES = _length_sql("ms")
_BY_NUMBER, _NUMBER_SHARES = _length_sql("n")
_UNCHANGED = "join_best_bid + join_best_ask + behind_best_bid + behind_best_ask"
_OVERVIEW = {
    "undercut_pct": "100.0 * sum(undercut_bid + undercut_ask) / nullif(sum(new_bid + new_ask), 0)",
    "unchanged_pct": f"100.0 * sum({_UNCHANGED}) / nullif(sum(new_bid + new_ask), 0)",
    "undercuts_a_minute": "CAST(sum(undercut_bid + undercut_ask) AS DOUBLE) / count(*)",
    "spread": "CAST(sum(spread_sum) AS DOUBLE) / nullif(sum(mid_obs), 0)",
    "bid_depth": "CAST(sum(touch_depth_bid) AS DOUBLE) / nullif(sum(mid_obs), 0)",
    "ask_depth": "CAST(sum(touch_depth_ask) AS DOUBLE) / nullif(sum(mid_obs), 0)",
    "pressure": "CAST(sum(touch_depth_bid) - sum(touch_depth_ask) AS DOUBLE) / nullif(sum(touch_depth_bid) + sum(touch_depth_ask), 0)",
    "last_mid": "arg_max(close_mid, CAST(day AS BIGINT) * 100000000 + bucket) FILTER (close_mid IS NOT NULL)",
    "length_by_time": _BY_TIME,
    "length_by_number": _BY_NUMBER,
    **{f"time_share_{k}": s for k, s in zip(ov.LENGTHS, _TIME_SHARES)},
    **{f"number_share_{k}": s for k, s in zip(ov.LENGTHS, _NUMBER_SHARES)},
}
_SUMS = {
    "undercuts": "undercut_bid + undercut_ask",
    "net_undercut": "undercut_bid - undercut_ask",
    "unchanged": _UNCHANGED,
    "entered": "new_bid + new_ask",
    "naive": "naive_undercut_bid + naive_undercut_ask",
    "trade_count": "trade_count",
    "trade_volume": "trade_volume",
}


@register(
    "session_overview",
    "ovr",
    f"""SELECT CASE WHEN grouping(clock) = 0 THEN 'clock' WHEN grouping(hour) = 0 THEN 'hour' ELSE 'day' END AS level, day, hour, clock, count(*) AS minutes,
{", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in _SUMS.items())},
{", ".join(f"round({e}, 9) AS {n}" for n, e in _OVERVIEW.items())} FROM ovr GROUP BY GROUPING SETS ((day), (day, hour), (clock))""",
)
def session_overview(p):
    """Days, hours of days, and times of day in one table."""
    panel = rp.in_session(replay_panel_of(p, "1m"), 60_000)
    counts = p.store.table("spread_counts", lambda: ov.spread_counts(p.tape, 60_000))
    return rounded(ov.overview(panel, counts).select("level", "day", "hour", "clock", "minutes", *_SUMS, *_OVERVIEW))


# ------------------------------------------------------------------ diagnostics
SAMPLES = {"full": "true", "pilot": "day % 100 <= 15"}


def _diagnostic_blocks(sample: str, where: str) -> None:
    rows = []
    for g in ("day", "block"):
        means = [("D2", "improvements over deteriorations", "CAST(n_impr AS DOUBLE) / nullif(n_det_all, 0)")]
        means += [("D4", c, c) for c in ("frac_1tick", "spread_tw_ticks")]
        means += [("D6", r, r) for r in dg.RATIOS]
        means += [("D6", f"{r} negative", f"CASE WHEN {r} < 0 THEN 1.0 WHEN {r} >= 0 THEN 0.0 END") for r in dg.RATIOS]
        if g == "day":
            means += [("D5", c, c) for c in ("share_1tick_impr", "share_1tick_det_trade")]
        rows += [
            f"SELECT '{i}' AS id, '{d}' AS diagnostic, '{g}' AS level, day, CAST({e} AS DOUBLE) AS num, 1 AS den FROM panel_{g} WHERE ({e}) IS NOT NULL AND {where}"
            for i, d, e in means
        ]
    shares = [(f"{c} within {w} ms", "improve", f"class_w{w} = '{c}'") for w in dg.WINDOWS for c in dg.CLASSES]
    rows += [
        f"SELECT 'D3', '{d}', 'sample', day, CASE WHEN {e} THEN 1.0 ELSE 0.0 END, 1 FROM mv WHERE kind = '{k}' AND {where}" for d, k, e in shares
    ]
    rows += [
        f"SELECT 'D7', '{r} and execution agree', 'sample', day, CASE WHEN {r} = (cause = 'execution') THEN 1.0 ELSE 0.0 END, 1 FROM mv WHERE kind = 'worsen' AND {where}"
        for r in dg.RULES
    ]
    oracle.block(f"dg_{sample}", "panel_day panel_block mv", " UNION ALL ".join(rows))
    draw_blocks(f"dgb_{sample}", f"dg_{sample}", "id, diagnostic, level")
    r2 = " UNION ALL ".join(
        f"SELECT 'D2', 'R2 of {r} on composition', '{g}', corr(qcr_composition, {r}) ^ 2, NULL, NULL, CAST(count(*) AS DOUBLE) FROM panel_{g} WHERE qcr_composition IS NOT NULL AND {r} IS NOT NULL AND {where} HAVING count(*) > 0"
        for g in ("day", "block") for r in dg.RATIOS[:2])
    d1 = " UNION ALL ".join(
        f"""SELECT 'D1', 'periods with a residual', '{g}', CAST(count(*) FILTER (coalesce(d.delta, 0) - (c.ticks_det - c.ticks_impr) <> 0) AS DOUBLE), NULL, NULL, CAST(count(*) AS DOUBLE)
FROM (SELECT * FROM cnt_{g} WHERE {where}) c LEFT JOIN (SELECT p.day, p.ps, sum((s.a - s.b) - (s.p_a - s.p_b)) AS delta
 FROM per_{g} p JOIN cs s ON s.day = p.day AND s.t_ms >= p.ps AND s.t_ms < p.pe AND NOT s.reference GROUP BY ALL) d ON d.day = c.day AND d.ps = c.ps"""
        for g in ("day", "block"))
    oracle.block(f"dgt_{sample}", f"dg_{sample} dgb_{sample}_q panel_day panel_block cnt_day cnt_block per_day per_block cs", f"""
SELECT * FROM (SELECT s.id, s.diagnostic, s.level, sum(num) / sum(den) AS value, any_value(q.ci_low) AS ci_low, any_value(q.ci_high) AS ci_high, CAST(sum(den) AS DOUBLE) AS n
FROM dg_{sample} s JOIN dgb_{sample}_q q ON q.id = s.id AND q.diagnostic = s.diagnostic AND q.level = s.level GROUP BY s.id, s.diagnostic, s.level
UNION ALL {r2} UNION ALL {d1}) WHERE level <> 'day' OR (SELECT count(DISTINCT day) FROM panel_day WHERE {where}) >= {dg.DAILY_SESSIONS}""")
    oracle.block(f"dgf_{sample}", f"dgt_{sample}", f"""
SELECT t.*, CASE WHEN value IS NULL OR isnan(value) THEN 'not identified' WHEN diagnostic LIKE 'qcr_u%' THEN 'weakly identified'
 WHEN yes THEN 'yes' WHEN NOT yes THEN 'no' ELSE 'none' END AS flag FROM (
SELECT *, CASE WHEN id = 'D1' THEN value > 0 WHEN diagnostic LIKE 'R2%' THEN value > {dg.R2_HIGH}
 WHEN diagnostic = 'undercut within {dg.WINDOWS[1]} ms' THEN value < {dg.UNDERCUT_LOW} WHEN diagnostic = 'frac_1tick' THEN value > {dg.ONE_TICK_HIGH}
 WHEN id = 'D5' THEN min(CASE WHEN id = 'D5' THEN value END) OVER (PARTITION BY level) >= {dg.ONE_TICK_MOVES}
 WHEN id = 'D6' AND diagnostic = 'qcr_r' THEN abs(value) < {dg.MEAN_LOW} OR max(CASE WHEN diagnostic = 'qcr_r negative' THEN value END) OVER (PARTITION BY level) > {dg.NEGATIVE_HIGH}
 WHEN id = 'D7' THEN value < {dg.AGREEMENT_LOW} END AS yes FROM dgt_{sample}) t""")


for _sample, _where in SAMPLES.items():
    _diagnostic_blocks(_sample, _where)


def diagnostics_of(p, sample: str):
    def build():
        where = SAMPLES[sample]
        grains = {g: panel_of(p, g).filter(where) for g in ("day", "block")}
        identities = {
            g: panels.spread_identity(p.states.filter(where), grains[g], panels.periods(p.calendar.filter(where), g), g) for g in grains
        }
        return dg.diagnostics(grains, identities, p.moves.filter(where), REPS, SEED)

    return p.store.table(f"diagnostics_{sample}", build)


_DIAGNOSTIC = "round(value, 6) AS value, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, flag"


@register("diagnostics", "dgf_full", f"SELECT id, diagnostic, level, {_DIAGNOSTIC} FROM dgf_full")
def diagnostics(p):
    """Diagnostics of the whole sample with thresholds and flags."""
    table = rounded(diagnostics_of(p, "full"), 6)
    return table.select(*dg.KEYS, "value", "ci_low", "ci_high", "n", "flag")


_SIDES = ", ".join(
    f"round({s}.value, 6) AS value_{n}, round({s}.ci_low, 6) AS ci_low_{n}, round({s}.ci_high, 6) AS ci_high_{n}, {s}.n AS n_{n}, {s}.flag AS flag_{n}"
    for s, n in (("f", "full"), ("q", "pilot")))


@register(
    "diagnostics_side_by_side",
    "dgf_full dgf_pilot",
    f"""SELECT coalesce(f.id, q.id) AS id, coalesce(f.diagnostic, q.diagnostic) AS diagnostic, coalesce(f.level, q.level) AS level, {_SIDES},
CASE WHEN f.id IS NOT NULL AND q.id IS NOT NULL THEN 'both' WHEN f.id IS NOT NULL THEN 'full' ELSE 'pilot' END AS found_in,
coalesce(f.flag <> q.flag, false) AS flag_changed FROM dgf_full f FULL JOIN dgf_pilot q ON q.id = f.id AND q.diagnostic = f.diagnostic AND q.level = f.level""",
)
def diagnostics_side_by_side(p):
    """The whole sample and the first fortnight side by side, rows of either alone kept."""
    columns = [*dg.KEYS, "value", "ci_low", "ci_high", "n", "flag"]
    both = reconciled(
        diagnostics_of(p, "full").select(columns), diagnostics_of(p, "pilot").select(columns), dg.KEYS, ("full", "pilot")
    )
    return rounded(both.withColumn("flag_changed", F.array_contains("differing", "flag")).drop("differing"), 6)


# ------------------------------------------------------------------ two reconstructions, every event
oracle.block("agr", "evt mqs msg", """
SELECT e.day, e.last_rpt AS rpt, e.b, e.a, e.qb, e.qa, m.b AS mb, m.a AS ma, m.qb AS mqb, m.qa AS mqa, m.day IS NOT NULL AS found
FROM evt e LEFT JOIN mqs m ON m.day = e.day AND m.rpt = e.last_rpt""")


@register(
    "replay_reconciliation",
    "agr mqs",
    """SELECT day, count(*) FILTER (found) AS compared, count(*) FILTER (NOT found) AS only_event,
count(*) FILTER (found AND (b IS DISTINCT FROM mb OR a IS DISTINCT FROM ma OR qb IS DISTINCT FROM mqb OR qa IS DISTINCT FROM mqa)) AS different,
any_value(x.messages) - count(*) FILTER (found) AS only_message
FROM agr JOIN (SELECT day, count(*) AS messages FROM mqs GROUP BY day) x USING (day) GROUP BY day""",
)
def replay_reconciliation(p):
    """Event-level and message-level quotes by a full outer join on the position of the message."""
    columns = [*KEY, "rpt", "b", "a", "qb", "qa"]
    both = reconciled(p.events.select(columns), p.tape.select(columns), [*KEY, "rpt"], ("event", "message"))
    return both.groupBy("day").agg(
        F.count_if(F.col("found_in") == "both").alias("compared"),
        F.count_if(F.col("found_in") == "event").alias("only_event"),
        F.count_if(F.col("found_in") == "message").alias("only_message"),
        F.count_if(F.size("differing") > 0).alias("different"),
    )


# ------------------------------------------------------------------ window log and slices
oracle.block("wl0", "tape", """
SELECT day, arg_max(minute, n * 100000 - minute) * 60000 AS from_ms FROM (
SELECT day, t_ms // 60000 AS minute, count(*) AS n FROM tape WHERE new_class IN ('undercut', 'undercut_ambiguous') GROUP BY ALL) GROUP BY day""")
oracle.block("wl", "tape wl0", f"""
SELECT t.day, t.rpt, t.t_ms, w.from_ms, CASE t.typ WHEN 'N' THEN 0 WHEN 'C' THEN 1 WHEN 'D' THEN 2 ELSE {wl.TRADE_ACTION} END AS action, t.side, t.tick, t.qty,
 coalesce(t.new_class, t.withdrawal, CASE t.typ WHEN 'C' THEN 'size_only' WHEN 'T' THEN 'trade' END) AS label, t.b0, t.a0, t.b, t.a
FROM tape t JOIN wl0 w ON w.day = t.day AND t.t_ms >= w.from_ms AND t.t_ms < w.from_ms + 60000""")
_SLICE = """SELECT day, frame, count(*) AS messages, min(rpt) AS first_rpt, max(rpt) AS last_rpt,
count(*) FILTER (label IN ('undercut', 'undercut_ambiguous') AND side = 0) AS undercut_buy, count(*) FILTER (label IN ('undercut', 'undercut_ambiguous') AND side = 1) AS undercut_sell,
count(*) FILTER (label = 'join_best') AS joined, count(*) FILTER (action = 2) AS removed, count(*) FILTER (action = 9) AS trades,
CAST(coalesce(sum(qty) FILTER (action = 9), 0) AS BIGINT) AS volume, min(a - b) FILTER (b < a) AS spread_min, max(a - b) FILTER (b < a) AS spread_max,
first(b0 ORDER BY rpt) AS open_bid, first(a0 ORDER BY rpt) AS open_ask, last(b ORDER BY rpt) AS close_bid, last(a ORDER BY rpt) AS close_ask
FROM ({}) GROUP BY day, frame"""


def log_of(p):
    return p.store.table("window_log", lambda: wl.window_log(p.tape, wl.busiest_minute(p.tape)))


@register("window_event_log", "wl", "SELECT day, rpt, t_ms, action, side, tick, qty, label, b0, a0, b, a FROM wl")
def window_event_log(p):
    """Every message of each session's busiest minute with the quotes around it; prints are action 9."""
    return log_of(p).select("day", "rpt", "t_ms", "action", "side", "tick", "qty", "label", "b0", "a0", "b", "a")


@register("window_time_slices", "wl", _SLICE.format(f"SELECT *, (t_ms - from_ms) // {wl.SLICE_MS} AS frame FROM wl"))
def window_time_slices(p):
    """The busiest minute in slices of a second, each opening at the quote carried into it."""
    return wl.time_slices(log_of(p)).drop("sid")


@register(
    "window_row_slices",
    "wl",
    _SLICE.format(f"SELECT *, (row_number() OVER (PARTITION BY day ORDER BY rpt) - 1) // {wl.SLICE_ROWS} AS frame FROM wl"),
)
def window_row_slices(p):
    """The busiest minute in slices of sixteen messages."""
    return wl.row_slices(log_of(p)).drop("sid")


# ------------------------------------------------------------------ the book at sampled events
BOOK_LEVELS, SHOWN = 5, 25
oracle.block("isp", "mv cs evt", f"""
SELECT s.label, s.day, s.seq, s.side, s.pos, e.last_rpt AS upto, x.last_rpt AS before FROM (
SELECT day, seq, side, coalesce(class, cause) AS label, row_number() OVER (PARTITION BY coalesce(class, cause)
 ORDER BY md5('{SEED}' || '|' || CAST(day AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || side)) AS pos FROM mv) s
JOIN evt e ON e.day = s.day AND e.seq = s.seq JOIN cs c ON c.day = s.day AND c.seq = s.seq JOIN evt x ON x.day = s.day AND x.seq = c.p_seq
WHERE s.pos <= 20""")
oracle.block("ibk", "isp life", f"""
SELECT day, rpt, string_agg(entry, ' ' ORDER BY place) FILTER (side = 0 AND place <= {BOOK_LEVELS}) AS bids,
 string_agg(entry, ' ' ORDER BY place) FILTER (side = 1 AND place <= {BOOK_LEVELS}) AS asks FROM (
SELECT day, rpt, side, CAST(tick AS VARCHAR) || 'x' || CAST(q AS VARCHAR) || '(' || CAST(n AS VARCHAR) || ')' AS entry,
 row_number() OVER (PARTITION BY day, rpt, side ORDER BY CASE side WHEN 0 THEN -tick ELSE tick END) AS place FROM (
SELECT p.day, p.rpt, l.side, l.tick, CAST(sum(CASE WHEN l.rc <= p.rpt THEN 3 ELSE l.qty END) AS BIGINT) AS q, count(*) AS n
FROM (SELECT day, upto AS rpt FROM isp UNION SELECT day, before FROM isp) p
JOIN life l ON l.day = p.day AND l.r0 <= p.rpt AND (l.r1 IS NULL OR l.r1 > p.rpt) GROUP BY ALL)) GROUP BY day, rpt""")
oracle.block("ims", "isp msg", f"""
SELECT day, seq, count(*) AS n_messages, string_agg(entry, ' | ' ORDER BY rpt) FILTER (place <= {SHOWN}) || CASE WHEN count(*) > {SHOWN} THEN ' | ...' ELSE '' END AS messages FROM (
SELECT m.day, m.seq, m.rpt, row_number() OVER (PARTITION BY m.day, m.seq ORDER BY m.rpt) AS place,
 m.typ || CASE WHEN m.typ = 'T' THEN '' WHEN m.side = 0 THEN ' B' ELSE ' S' END || ' ' || CAST(m.tick AS VARCHAR) || 'x' || CAST(m.qty AS VARCHAR) || CASE WHEN m.retail THEN ' retail' ELSE '' END AS entry
FROM msg m WHERE EXISTS (SELECT 1 FROM isp s WHERE s.day = m.day AND s.seq = m.seq)) GROUP BY day, seq""")


@register(
    "inspection_books",
    "isp ibk ims",
    """SELECT s.label, s.pos, s.day, s.seq, s.side, coalesce(b.bids, '') AS bids_before, coalesce(b.asks, '') AS asks_before,
coalesce(a.bids, '') AS bids_after, coalesce(a.asks, '') AS asks_after, m.n_messages, m.messages
FROM isp s LEFT JOIN ibk a ON a.day = s.day AND a.rpt = s.upto LEFT JOIN ibk b ON b.day = s.day AND b.rpt = s.before JOIN ims m ON m.day = s.day AND m.seq = s.seq""",
)
def inspection_books(p):
    """Twenty moves of each class with the book before and after, and the raw messages of the event."""
    sample = p.store.table("inspection", lambda: QUERIES["inspection_sample"](p.spark, p.sf_dir))
    events = p.events.select("day", "sid", "chunk", "seq", "rpt")
    ends = p.states.filter("prev IS NOT NULL").select("day", "sid", "seq", F.col("prev.rpt").alias("before"))
    placed = sample.join(events, ["day", "seq"]).join(ends, ["day", "sid", "seq"])
    earlier = events.select("day", "sid", F.col("rpt").alias("before"), F.col("chunk").alias("before_chunk"))
    placed = p.store.table("inspection_placed", lambda: placed.join(earlier, ["day", "sid", "before"]))
    after = placed.select("day", "sid", "chunk", "rpt")
    before = placed.select("day", "sid", F.col("before_chunk").alias("chunk"), F.col("before").alias("rpt"))
    snapshots, _ = p._best("book", p.log, p.log)
    books = p.store.table(
        "inspection_depth",
        lambda: wl.book_at(after.union(before).distinct(), p.log.filter("e_side IS NOT NULL"), snapshots, BOOK_LEVELS),
    ).select("day", "sid", "rpt", wl.book_text("bid_book").alias("bids"), wl.book_text("ask_book").alias("asks"))
    typed = F.concat(
        "typ",
        F.when(F.col("typ") == "T", "").when(F.col("side") == 0, " B").otherwise(" S"),
        F.lit(" "), F.col("tick").cast("string"), F.lit("x"), F.col("qty").cast("string"),
        F.when(F.col("retail"), " retail").otherwise(""),
    )
    wanted = placed.select("day", "sid", F.col("seq").alias("ev")).distinct()
    raw = p.log.select("day", "sid", "ev", "rpt", typed.alias("entry")).distinct().join(wanted, ["day", "sid", "ev"])
    entries = F.array_sort(F.collect_list(F.struct("rpt", "entry")))  # an event's messages
    texts = raw.groupBy("day", "sid", F.col("ev").alias("seq")).agg(entries.alias("_e")).select(
        "day", "sid", "seq", F.size("_e").cast("bigint").alias("n_messages"),
        F.concat(
            F.array_join(F.slice("_e.entry", 1, SHOWN), " | "), F.when(F.size("_e") > SHOWN, " | ...").otherwise("")
        ).alias("messages"),
    )
    named = lambda when, at: books.select("day", "sid", F.col("rpt").alias(at), F.col("bids").alias(f"bids_{when}"), F.col("asks").alias(f"asks_{when}"))
    return (
        placed.join(named("after", "rpt"), ["day", "sid", "rpt"])
        .join(named("before", "before"), ["day", "sid", "before"])
        .join(texts, ["day", "sid", "seq"])
        .select("label", "pos", "day", "seq", "side", "bids_before", "asks_before", "bids_after", "asks_after", "n_messages", "messages")
    )


# ------------------------------------------------------------------ exclusion windows and hold-out days
WINDOWS = ["115000-122000", "20240113:122000-124000"]
HOLD_OUT = [20240105, 20240119]
_EXCLUDED_CAL = f"""
SELECT day, CAST(33300000 AS BIGINT) AS valid_from, CAST(63900000 AS BIGINT) AS valid_to, CAST(42600000 AS BIGINT) AS x0,
 CAST(CASE WHEN day = 20240113 THEN 45600000 ELSE 44400000 END AS BIGINT) AS x1 FROM (SELECT DISTINCT day FROM num) WHERE day NOT IN ({", ".join(map(str, HOLD_OUT))})"""
_EXCLUDED_KEYS = ("n_impr", "n_det_all", "n_det_exec", "n_undercut", "n_refill", "n_shift", "ticks_impr", "ticks_det", "volume")
_EXCLUDED_MEANS = ("qcr_r", "qcr_a", "spread_tw_ticks", "frac_1tick", "qvol")
_EXCLUDED_SQL = f"""SELECT day, sid, period_start, period_end, {", ".join(_EXCLUDED_KEYS)}, {", ".join(f"round({c}, 9) AS {c}" for c in _EXCLUDED_MEANS)} FROM panel_"""
_excluding: dict[tuple, ExcludingPipeline] = {}


def _register_excluded(grain: str, windows: list[str]) -> None:
    name = f"ratio_panel_{grain}_excluding"

    def query(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _excluding:
            _excluding[key] = ExcludingPipeline(pipeline(spark, sf_dir), windows, HOLD_OUT)
        panel = panel_of(_excluding[key], grain)
        return rounded(panel.select("day", "sid", "period_start", "period_end", *_EXCLUDED_KEYS, *_EXCLUDED_MEANS))

    QUERIES[name] = query
    ORACLE[name] = oracle.statement(f"panel_{grain}", _EXCLUDED_SQL + grain, {"cal": _EXCLUDED_CAL})


for _grain in ("day", "block"):
    _register_excluded(_grain, WINDOWS)


# ------------------------------------------------------------------ the message log as a stream
STREAM_WINDOW, STREAM_LATENESS_MS = "1 hour", 60 * 86_400_000


@register(
    "stream_window_counts",
    "msg",
    """SELECT CAST(1 AS BIGINT) AS sid, CAST((strptime(CAST(day AS VARCHAR), '%Y%m%d')::DATE - DATE '1970-01-01') * 86400000 + t_ms // 3600000 * 3600000 AS BIGINT) AS window_ms,
count(*) AS messages, count(*) FILTER (typ = 'N') AS new_orders, count(*) FILTER (typ = 'T') AS prints, CAST(coalesce(sum(qty) FILTER (typ = 'T'), 0) AS BIGINT) AS volume
FROM msg GROUP BY ALL""",
)
def stream_window_counts(p):
    """Hourly counters of the message log, read as a stream of files; no row is late at this lateness."""
    source = f"{p.store.path}/messages"
    target = f"{p.store.path}/stream-{uuid.uuid4().hex[:12]}"
    stream = sw.message_stream(p.spark, source, p.messages.schema)
    sw.run_to_tables(stream, target, STREAM_WINDOW, STREAM_LATENESS_MS)
    return sw.counts_of(p.spark, target).select("sid", F.unix_millis("window_start").alias("window_ms"), *sw.COUNTERS)


# ------------------------------------------------------------------ side lists of the messages
oracle.block("sdm", "num pk", f"""
SELECT n.day, n.n AS msg_seq, p.t_ms, n.user_id, n.event_type, n.event_id, 'S' || CAST(n.user_id % {sd.SYMBOLS} AS VARCHAR) AS symbol, n.event_id % 3 + 17 AS status
FROM num n JOIN pk p ON p.day = n.day AND p.n = n.n""")
oracle.block("sdr", "sdm", f"""
SELECT 'S' || CAST(k AS VARCHAR) AS symbol, k, unnest([0, 1]) AS part FROM (
SELECT unnest([user_id % {sd.SYMBOLS}, (user_id + 1) % {sd.SYMBOLS}]) AS k FROM sdm WHERE event_id % {sd.DEFINITION_STEP} = 0)""")


def side_messages_of(p):
    return p.store.table("side_messages", lambda: sd.side_messages(p.numbered))


@register(
    "tick_rules",
    "sdr",
    """SELECT DISTINCT symbol, CAST(CASE part WHEN 0 THEN 0.0 ELSE round((k * 1000 + 500) * 0.1, 6) END AS DOUBLE) AS start_price, CAST(CASE part WHEN 0 THEN round((k * 1000 + 500) * 0.1, 6) END AS DOUBLE) AS end_price,
round((k + 1) * CASE part WHEN 0 THEN 0.01 ELSE 0.1 END, 6)::DOUBLE AS increment, round((k + 1) * 0.01, 6)::DOUBLE AS min_price_increment FROM sdr""",
)
def tick_rules(p):
    """Tick rules of every symbol from two levels of nested lists."""
    return rounded(sd.tick_rules(side_messages_of(p)), 6).distinct()


@register("news_items", "sdm", f"SELECT DISTINCT day, t_ms, event_type AS headline FROM sdm WHERE event_id % {sd.NEWS_STEP} = 0")
def news_items(p):
    """Headlines, each time and text once."""
    return sd.news(side_messages_of(p))


@register(
    "status_changes",
    "sdm",
    """SELECT day, symbol, msg_seq, t_ms, status, lag(status) OVER w AS from_status, t_ms - lag(t_ms) OVER w AS held_ms FROM (
SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY day, symbol ORDER BY msg_seq) AS before FROM sdm) WHERE before IS DISTINCT FROM status)
WINDOW w AS (PARTITION BY day, symbol ORDER BY msg_seq)""",
)
def status_changes(p):
    """Changes of trading status by symbol, repeats left out."""
    return sd.status_changes(side_messages_of(p))
