"""Literal scenarios, one day each, with exact expected rows."""

import pytest

from tests.book import opening, run

SWEEP = [
    (10_000, [("T", -1, 102, 2, False), ("T", -1, 103, 2, False), ("T", -1, 104, 2, False)]),
    (10_001, [("D", 1, 102, 2, 4), ("D", 1, 103, 2, 5)]),
    (10_002, [("N", 1, 106, 1, 9), ("D", 1, 104, 2, 6)]),
]
DAYS = {
    1: [(10_000, [("T", -1, 102, 2, False), ("D", 1, 102, 2, 4)]), (10_200, [("N", 1, 102, 2, 7)])],
    2: [(10_000, [("T", -1, 102, 2, False), ("D", 1, 102, 2, 4)]), (10_300, [("N", 0, 101, 1, 7)])],
    3: [(10_000, [("T", -1, 102, 2, False), ("D", 1, 102, 2, 4), ("N", 0, 102, 1, 7)])],
    4: SWEEP,
    5: [(10_000, [("D", 0, 100, 2, 1)])],
    6: [(9_995, [("T", -1, 101, 1, True)]), (10_000, [("D", 0, 100, 2, 1)])],
    7: [(9_950, [("T", -1, 101, 1, True)]), (10_000, [("D", 0, 100, 2, 1)])],
    8: [(10_000, [("T", -1, 100, 2, True), ("D", 0, 100, 2, 1)])],
    9: [
        (10_000, [("N", 0, 101, 1, 7)]), (15_000, [("D", 0, 101, 1, 7)]),
        (20_000, [("N", 0, 50, 1, 8)]), (21_000, [("N", 0, 101, 1, 9)]),
    ],
    10: [(10_000, [("C", 0, 101, 2, 1)]), (11_000, [("D", 0, 77, 1, 999)])],
}


@pytest.fixture(scope="module", params=[1000, 1])
def result(spark, request):
    days = {d: opening() + packets for d, packets in DAYS.items()}
    log, history, moves = run(spark, days, request.param, {9: [(9_000, 19_000)]})
    pick = lambda df, *order: [r.asDict() for r in df.orderBy("day", *order).collect()]
    return pick(log, "rpt", "sub"), pick(history, "seq"), pick(moves, "seq", "side")


def of(rows, day):
    return [r for r in rows if r["day"] == day]


def test_refill(result):
    down, up = of(result[2], 1)
    assert (down["side"], down["kind"], down["cause"], down["r_10ms"]) == ("ask", "worsen", "execution", True)
    assert (up["class_w1000"], up["class_w100"]) == ("refill", "undercut")


def test_shift(result):
    down, up = of(result[2], 2)
    assert down["cause"] == "execution"
    assert (up["side"], up["class"], up["class_w100"]) == ("bid", "shift", "undercut")


def test_same_event_shift(result):
    ask, bid = of(result[2], 3)
    assert (ask["kind"], ask["cause"]) == ("worsen", "execution")
    assert bid["kind"] == "improve"


def test_fragmented_sweep_is_one_event(result):
    last = of(result[1], 4)[-1]
    assert (last["n_packets"], last["open_balance"], last["aggressor"]) == (3, 0, 1)
    (move,) = of(result[2], 4)
    assert (move["ticks"], move["cause"], move["r_10ms"]) == (4, "execution", True)


@pytest.mark.parametrize("day,flag", [(5, False), (6, True), (7, False)])
def test_cancel_after_trade(result, day, flag):
    (move,) = of(result[2], day)
    assert (move["cause"], move["r_10ms"], move["r2_10ms"]) == ("cancel", flag, False)


def test_retail_print_does_not_execute(result):
    (move,) = of(result[2], 8)
    assert (move["cause"], move["r_10ms"], move["r_nr_10ms"]) == ("cancel", True, False)


def test_exclusion_resets_reference(result):
    states = {r["t_ms"]: r for r in of(result[1], 9)}
    assert states[20_000]["reference"] and not states[10_000]["counted"]
    (move,) = of(result[2], 9)
    assert (move["t_ms"], move["class"]) == (21_000, "undercut")


def test_price_change_and_orphans(result):
    assert {"price_change", "orphan_delete"} <= {r["anomaly"] for r in of(result[0], 10)}
    last = of(result[1], 10)[-1]
    assert (last["b"], last["a"], last["qb"]) == (101, 102, 2)
