"""Exact quantiles, reconciliation, and the rough feed against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import epochs, levels
from tickloom.operators.ordered import asof_next
from tickloom.operators.quantiles import quantiles
from tickloom.plans import predictive as pr
from tickloom.plans import spread_time as st
from tickloom.plans.reconcile import reconciled
from tickloom.plans.rough_pipeline import RoughPipeline

SF = "/root/testdata/sf0.001"


def test_quantiles_equal_sorting(spark):
    draw = random.Random(6)
    groups = {
        "one": [3.5],
        "ties": [1.0] * 400 + [2.0] * 3,
        "many": [draw.gauss(0, 10) for _ in range(3000)],
        "few": [draw.randint(0, 5) for _ in range(700)],
        None: [1.0, 2.0],
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("ties", None)]
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {r.g: r.q for r in quantiles(frame.filter("g IS NOT NULL"), ["g"], F.col("v"), shares).collect()}
    assert set(found) == {"one", "ties", "many", "few"}
    for g, got in found.items():
        assert got == pytest.approx(list(np.quantile(groups[g], shares)), abs=1e-9)
    (whole,) = quantiles(frame, [], F.col("v"), shares).collect()
    assert whole.q == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], shares)), abs=1e-9)
    assert quantiles(frame.filter("v < -1e9"), ["g"], F.col("v"), shares).count() == 0


def test_reconciled_keeps_null_keys_and_one_sided_rows(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", None), (None, "c", 7), (9, "z", 1)], "k int, s string, v int")
    right = spark.createDataFrame([(1, "a", 5), (2, "b", 3), (None, "d", 7), (4, "y", 1)], "k int, s string, v int")
    found = {r.k: r for r in reconciled(left, right, ["k"], ("l", "r")).collect()}
    assert (found[1].found_in, found[1].differing) == ("both", [])
    assert (found[2].found_in, found[2].differing) == ("both", ["v"])
    assert (found[None].found_in, found[None].differing) == ("both", ["s"])
    assert (found[9].found_in, found[9].v_l, found[9].v_r) == ("l", 1, None)
    assert (found[4].found_in, found[4].v_l, found[4].v_r) == ("r", None, 1)


def test_asof_next_is_the_nearest_following_row(spark):
    build = [(1, i // 4, i, i * 10) for i in (2, 3, 9, 15, 21)] + [(2, 1, 5, 50)]
    probe = [(k, i // 4, i) for k in (1, 2) for i in range(0, 24, 3)]
    found = asof_next(
        spark.createDataFrame(probe, "k int, chunk bigint, p bigint"),
        spark.createDataFrame(build, "k int, chunk bigint, p bigint, x bigint"),
        ["k"],
        ["p"],
        ["x"],
    ).collect()
    assert len(found) == len(probe)
    for r in found:
        assert r.x == min((x for k, _, i, x in build if k == r.k and i >= r.p), default=None)


# ---------------------------------------------------------------- the rough feed
def replay(messages, restart):
    """Quotes and three best levels after every message, one order at a time."""
    out, orders, epoch = [], {}, None
    for m in messages:
        if restart and m.epoch != epoch:
            orders, epoch = {}, m.epoch
        if m.typ == "N":
            orders[m.oid] = (m.side, m.tick, m.qty)
        elif m.typ == "D":
            orders.pop(m.oid, None)
        elif m.typ == "C" and m.oid in orders:
            orders[m.oid] = (orders[m.oid][0], m.tick, m.qty)
        book = (defaultdict(int), defaultdict(int))
        for side, tick, qty in orders.values():
            book[side][tick] += qty
        bids = sorted(book[0].items(), reverse=True)[:3]
        asks = sorted(book[1].items())[:3]
        out.append((m.day, m.sid, m.rpt, bids, asks))
    return out


@pytest.fixture(scope="module")
def rough(spark):
    return RoughPipeline(spark, SF, per_chunk=16)


def test_rough_quotes_equal_a_replay_of_orders(rough):
    rows = sorted(rough.messages.collect(), key=lambda m: (m.day, m.sid, m.rpt))
    assert {m.sid for m in rows} == {1, 2} and max(m.epoch for m in rows) > 0
    for restart in (True, False):
        found = {
            (r.day, r.sid, r.rpt): (
                list(zip(*r.bids)),
                list(zip(*r.asks)),
                (r.b, r.a),
            )
            for r in epochs.unkeyed(rough.quotes(restart)).collect()
        }
        want = []
        for key in sorted({(m.day, m.sid) for m in rows}):
            want += replay([m for m in rows if (m.day, m.sid) == key], restart)
        assert len(want) == len(found)
        for day, sid, rpt, bids, asks in want:
            got_bids, got_asks, quote = found[day, sid, rpt]
            assert got_bids == bids and got_asks == asks
            assert quote == (bids[0][0] if bids else None, asks[0][0] if asks else None)


def test_rough_feed_does_not_depend_on_chunks(spark, rough):
    whole = RoughPipeline(spark, SF)
    columns = ["day", "sid", "rpt", "b", "a", "qb", "qa", "nb", "na", "bids", "asks"]
    assert rough.quotes().select(columns).exceptAll(whole.quotes().select(columns)).count() == 0
    kinds = {r.anomaly for r in rough.effects().select("anomaly").distinct().collect()}
    assert kinds == {None, "duplicate_order", "orphan_delete", "orphan_change", "price_change", "size_increase"}


def test_shares_of_an_hour_sum_to_its_covered_time(rough):
    by_hour = st.spread_by_hour(rough.standing, ["day", "sid"])
    sums = by_hour.groupBy("day", "sid", "hour").agg(
        F.sum("share").alias("s"), F.sum("ms").alias("ms"), F.max("covered_ms").alias("c")
    )
    assert sums.filter("abs(s - 1) > 1e-9 OR ms <> c OR c > 3600000").count() == 0
    parts = st.split_at(st.counted(rough.standing), 3_600_000).agg(F.sum(F.expr("to_ms - from_ms"))).first()[0]
    assert parts == st.counted(rough.standing).agg(F.sum(F.expr("to_ms - from_ms"))).first()[0]


def test_intervals_are_cut_at_borders(spark):
    rows = [(5, 25), (10, 10), (9, 11), (20, 30), (30, 20)]
    frame = spark.createDataFrame(rows, "from_ms bigint, to_ms bigint")
    found = sorted((r.bucket, r.from_ms, r.to_ms) for r in st.split_at(frame, 10).collect())
    assert found == [(0, 5, 10), (0, 9, 10), (1, 10, 11), (1, 10, 20), (2, 20, 25), (2, 20, 30)]


def test_best_levels_pass_over_far_and_empty_ones():
    import pandas as pd

    from tickloom.operators.kernels import best_levels

    steps = [(0, 100, 1, 5), (0, 99, 1, 0), (0, 98, 2, 7), (0, 97, 1, 1), (0, 100 - levels.REACH, 1, 9), (0, 100, 0, 0), (0, 98, 0, 0)]
    frame = pd.DataFrame(
        [(1, 1, 0, i, 0, *s) for i, s in enumerate(steps)],
        columns=["day", "sid", "chunk", "rpt", "sub", "e_side", "e_tick", "level_n", "level_q"],
    )
    (out,) = list(best_levels(3, levels.REACH)(iter([frame])))
    assert [list(t) for t in out.ticks] == [[100], [100, 98], [100, 98, 97], [98, 97, 100 - levels.REACH], [97, 100 - levels.REACH]]


# ---------------------------------------------------------------- permutations and blocks
def test_shuffle_placebo_equals_plain_permutations(spark):
    import hashlib

    draw = random.Random(2)
    rows = [
        ("s", d, 1, b * 1000, b // 10, draw.gauss(0, 1), draw.gauss(0, 1) if b % 7 else None)
        for d in (20240101, 20240102)
        for b in range(30)
    ]
    frame = spark.createDataFrame(rows, "spec string, day int, sid bigint, bucket bigint, hour bigint, y double, x0 double")
    (got,) = pr.shuffle_placebo(frame, 60, 5).collect()

    def slope(pairs):
        num = den = 0.0
        for h in {p[0] for p in pairs}:
            x, y = (np.array([p[i] for p in pairs if p[0] == h]) for i in (1, 2))
            num += ((x - x.mean()) * (y - y.mean())).sum()
            den += ((x - x.mean()) ** 2).sum()
        return abs(num / den)

    def permuted(rep):
        out = []
        for d in (20240101, 20240102):
            used = [r for r in rows if r[1] == d and r[6] is not None]
            mixed = sorted(used, key=lambda r: (hashlib.md5(f"5|{rep}|{d}|{r[3]}".encode()).hexdigest()[:8], r[3]))
            out += [(a[4], b[6], a[5]) for a, b in zip(used, mixed)]
        return slope(out)

    real = slope([(r[4], r[6], r[5]) for r in rows if r[6] is not None])
    null = [permuted(r) for r in range(1, 61)]
    assert got.abs_beta == pytest.approx(real)
    assert got.shuffled_p99 == pytest.approx(float(np.quantile(null, 0.99)))
    assert got.p_empirical == pytest.approx(np.mean([b >= real for b in null]))


def test_queue_positions_do_not_depend_on_chunks(spark):
    from tickloom.plans.pipeline import BookPipeline

    columns = ["day", "rpt", "side", "tick", "qty", "oid", "ahead", "level_total", "queue_zone"]
    whole, cut = (BookPipeline(spark, SF, per_chunk=n).queue.select(columns) for n in (4096, 7))
    assert whole.count() > 0
    assert whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_dominance_sums_equal_all_pairs(spark):
    from tickloom.operators.dominance import dominance_sums

    draw = random.Random(9)
    points = [(draw.choice("ab"), draw.randint(0, 30), draw.randint(0, 30), draw.randint(-5, 9)) for _ in range(300)]
    queries = [(i, draw.choice("abc"), draw.randint(0, 30), draw.randint(0, 30)) for i in range(80)]
    found = dominance_sums(
        spark.createDataFrame(points, "g string, x bigint, y bigint, v bigint"),
        spark.createDataFrame(queries, "i bigint, g string, x bigint, y bigint"),
        ["g"], "x", ["y"], F.col("v"), ["i"], 40,
    )
    want = {i: sum(v for h, a, b, v in points if h == g and a < x and b < y) for i, g, x, y in queries}
    assert {r.i: r.below for r in found.collect()} == want


def test_exclusions_are_merged_and_days_held_out(spark):
    from tickloom.sources.calendar import excluding, parsed_window

    assert parsed_window("20240102:140000-141530") == (20240102, 50_400_000, 51_330_000)
    assert parsed_window("115000-122000") == (None, 42_600_000, 44_400_000)
    with pytest.raises(ValueError):
        parsed_window("120000-120000")
    plain = spark.createDataFrame(
        [(20240101, 1, 32_400_000, 64_800_000, []), (20240102, 1, 32_400_000, 64_800_000, [(43_200_000, 43_800_000)]), (20240103, 1, 32_400_000, 64_800_000, [])],
        "day int, sid bigint, valid_from bigint, valid_to bigint, exclusions array<struct<start:bigint,end:bigint>>",
    ).withColumns({"excluded_ms": F.lit(0).cast("bigint"), "valid_minutes": F.lit(540.0)})
    windows = ["115000-122000", "20240102:122000-124000", "20240101:070000-093000", "20240101:130000-131000"]
    found = {r.day: r for r in excluding(plain, windows, [20240103]).collect()}
    assert set(found) == {20240101, 20240102}
    spans = lambda day: [(x.start, x.end) for x in found[day].exclusions]
    assert spans(20240102) == [(42_600_000, 45_600_000)]
    assert spans(20240101) == [(25_200_000, 34_200_000), (42_600_000, 44_400_000), (46_800_000, 47_400_000)]
    assert found[20240101].valid_minutes == 540 - 30 - 30 - 10
    assert excluding(plain, []).count() == 3
