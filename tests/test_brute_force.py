"""Spark results against a literal sequential replay, for one and many chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.book import messages, opening, run
from tickloom.functions.linear import grouped_fit
from tickloom.operators import best_quote, lifecycle, tape
from tickloom.plans import inference
from tickloom.session import StageStore


def random_packets(seed, n=150):
    rng = random.Random(seed)
    packets, live, oid, t = opening(), {}, 100, 1_000
    for _ in range(n):
        t += rng.choice([0, 1, 7, 60, 300, 2000])
        msgs = []
        for _ in range(rng.randint(1, 3)):
            if live and rng.random() < 0.5:
                o = rng.choice(sorted(live))
                side, tick, qty = live.pop(o)
                if rng.random() < 0.4:
                    msgs.append(("T", -1, tick, qty, rng.random() < 0.2))
                msgs.append(("D", side, tick, qty, o))
            else:
                oid += 1
                side = rng.randint(0, 1)
                tick = 101 - rng.randint(0, 3) if side == 0 else 102 + rng.randint(0, 3)
                live[oid] = (side, tick, 1 + rng.randint(0, 3))
                msgs.append(("N", side, tick, live[oid][2], oid))
        packets.append((t, msgs))
    return packets


def replay(packets):
    """Best quotes and sizes after each packet, one message at a time."""
    orders, out = {}, []
    for _, msgs in packets:
        for typ, side, tick, qty, oid in msgs:
            if typ == "N":
                orders[oid] = (side, tick, qty)
            elif typ == "D":
                orders.pop(oid, None)
        bids = [o for o in orders.values() if o[0] == 0]
        asks = [o for o in orders.values() if o[0] == 1]
        b = max((o[1] for o in bids), default=None)
        a = min((o[1] for o in asks), default=None)
        out.append((b, a, sum(o[2] for o in bids if o[1] == b) or None, sum(o[2] for o in asks if o[1] == a) or None))
    return out


@pytest.mark.parametrize("chunk", [1000, 7])
def test_best_quotes_match_replay(spark, chunk):
    packets = random_packets(5)
    _, history, moves = run(spark, {1: packets}, chunk)
    want = replay(packets)
    for r in history.collect():
        last = r["seq"] + r["n_packets"] - 1
        assert (r["b"], r["a"], r["qb"], r["qa"]) == want[last], r
    # identity: the spread change of each segment equals the sum of its moves
    change = {
        r["seg"]: r["d"]
        for r in history.filter("counted").groupBy("seg").agg(
            (F.max_by(F.col("a") - F.col("b"), "k") - F.min_by(F.col("a") - F.col("b"), "k")).alias("d")
        ).collect()
    }
    signed = F.when(F.col("kind") == "worsen", F.col("ticks")).otherwise(-F.col("ticks"))
    ticks = {r["seg"]: r["t"] for r in moves.groupBy("seg").agg(F.sum(signed).alias("t")).collect()}
    assert all(change[s] == ticks.get(s, 0) for s in change)


def test_replay_applies_unknown_orders(spark):
    packets = opening() + [
        (1, [("C", 0, 101, 5, 77)]),   # unknown: inserted
        (2, [("D", 1, 102, 2, 88)]),   # unknown: takes the order resting at 102
        (3, [("D", 1, 102, 2, 89)]),   # nothing rests there any more
    ]
    msgs = messages(spark, packets, 2).withColumn("firm", F.lit(0))
    store = StageStore(spark, "test")
    changes = store.table("changes", lambda: tape.replay_changes(msgs))
    counts = store.table("counts", lambda: tape.replay_counts(changes))
    depth = store.table("depth", lambda: tape.replay_depth(counts))
    rows = depth.filter("e_side IS NOT NULL")
    snapshots = best_quote.chunk_snapshots(rows, msgs)
    best = best_quote.best_changes(lifecycle.occupancy_changes(rows), snapshots)
    quotes = tape.message_quotes(msgs, depth, best, snapshots).orderBy("rpt").collect()
    assert (quotes[-1]["b"], quotes[-1]["a"]) == (101, 103)
    assert depth.agg(F.min("level_n"), F.min("level_q")).first() == (0, 0)


def test_effects_fit_matches_dummies(spark):
    rng = np.random.default_rng(3)
    x, h = rng.normal(size=(60, 2)), rng.integers(0, 4, 60)
    y = x @ [1.5, -0.5] + h + rng.normal(size=60)
    rows = spark.createDataFrame(
        [(1, int(h[i]), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)],
        "g int, hour int, y double, x0 double, x1 double",
    )
    fit, _ = grouped_fit(rows, ["g"], "y", ["x0", "x1"], "hour")
    got = fit.first()
    design = np.column_stack([x, *[(h == v).astype(float) for v in range(4)]])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    res = y - design @ beta
    s2 = res @ res / (60 - 6)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * s2)
    assert np.allclose(got["beta"], beta[:2]) and np.allclose(got["se"], se[:2])
    assert np.isclose(got["r2"], 1 - res @ res / ((y - y.mean()) ** 2).sum())


def test_partial_r2_and_shapley(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, 0.5, 0.0] + rng.normal(size=80)
    rows = spark.createDataFrame(
        [(i % 8, *map(float, x[i]), float(y[i])) for i in range(80)], "day int, a double, b double, c double, y double"
    )
    table = inference.partial_r2_bootstrap(
        rows, "day", {"first": ("y", ["a"], ["b"]), "second": ("y", ["b"], ["c"])}, 50, 1
    ).first()

    def ssr(cols):
        d = np.column_stack([np.ones(80), *[x[:, c] for c in cols]])
        r = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        return r @ r

    assert np.isclose(table["pr2_first"], 1 - ssr([0, 1]) / ssr([1]))
    assert np.isclose(table["pr2_second"], 1 - ssr([1, 2]) / ssr([2]))
    shares = {r["component"]: r["value"] for r in inference.shapley_table(rows, "y", ["a", "b", "c"], "day", 20, 1).collect()}
    assert np.isclose(sum(v for k, v in shares.items() if k != "r2_total"), shares["r2_total"], atol=1e-6)
