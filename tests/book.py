"""Literal order-flow fixtures and a small runner of the book steps."""

from tickloom.operators import best_quote, lifecycle, matching, moves, states
from tickloom.plans.pipeline import raw_log
from tickloom.session import StageStore

SCHEMA = (
    "day int, sid bigint, chunk bigint, seq bigint, t_ms bigint, rpt bigint, typ string, "
    "side int, tick bigint, qty bigint, oid bigint, retail boolean"
)
CALENDAR = (
    "day int, sid bigint, valid_from bigint, valid_to bigint, "
    "exclusions array<struct<start:bigint,end:bigint>>"
)


def messages(spark, packets, chunk_packets=1000, day=1):
    """packets: list of (t_ms, [(typ, side, tick, qty, oid or retail)])."""
    return spark.createDataFrame(message_rows(packets, chunk_packets, day), SCHEMA)


def message_rows(packets, chunk_packets, day):
    rows, rpt = [], 0
    for seq, (t, msgs) in enumerate(packets):
        for typ, side, tick, qty, last in msgs:
            rpt += 1
            trade = typ == "T"
            rows.append(
                (day, 1, seq // chunk_packets, seq, t, rpt, typ, side, tick, qty,
                 -1 if trade else last, bool(last) if trade else False)
            )
    return rows


def opening():
    """Bids at 100..98, asks at 102..104, two lots each."""
    orders = [(0, 100, 1), (0, 99, 2), (0, 98, 3), (1, 102, 4), (1, 103, 5), (1, 104, 6)]
    return [(0, [("N", s, t, 2, o) for s, t, o in orders])]


def run(spark, days, chunk_packets=1000, exclusions=None, cross_clock=True):
    """(log, states, moves) of literal packets per day, every step written as a stage."""
    store = StageStore(spark, "test")
    rows = [r for day, packets in days.items() for r in message_rows(packets, chunk_packets, day)]
    msgs = spark.createDataFrame(rows, SCHEMA)
    table = store.table
    raw = table("raw", lambda: raw_log(msgs))
    cuts = table("cuts", lambda: matching.packet_cuts(raw))
    event_map = table(
        "map", lambda: matching.multi_packet_events(cuts, cross_clock=cross_clock)
    )
    executed = table(
        "executed", lambda: matching.with_executions(matching.with_event(raw, event_map))
    )
    log = table("log", lambda: lifecycle.with_level_depth(executed))
    effects = log.filter("e_side IS NOT NULL")
    snapshots = table("snapshots", lambda: best_quote.chunk_snapshots(effects, log))
    best = table(
        "best", lambda: best_quote.best_changes(lifecycle.occupancy_changes(effects), snapshots)
    )
    quotes = table(
        "quotes",
        lambda: best_quote.quote_at(matching.close_events(log), best, effects, snapshots),
    )
    calendar = spark.createDataFrame(
        [(d, 1, 0, 10**9, list((exclusions or {}).get(d, []))) for d in days], CALENDAR
    )
    events = table(
        "events", lambda: states.with_segments(states.with_phase(quotes, calendar))
    )
    history = table("states", lambda: states.with_history(events))
    changes = table("changes", lambda: moves.price_changes(history))
    flagged = table(
        "flagged",
        lambda: moves.with_trade_windows(moves.quote_moves(moves.with_lookback(changes))),
    )
    moved = table("moves", lambda: moves.with_cause(flagged, moves.level_emptyings(log)))
    return log, history, moved
