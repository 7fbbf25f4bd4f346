"""Clock of the order flow, reading of feed files, and panel statistics against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans import inference, predictive
from tickloom.sources import feed, order_flow


def test_clock_depends_on_the_packet_alone(spark):
    """Order is kept, and a time of day has one session time whatever else the day holds."""
    rows = spark.range(0, 86_400_000, 40_009).select(
        F.expr("cast(timestamp_millis(1700000000000 div 86400000 * 86400000 + id) as timestamp_ntz)").alias("ts"), "id"
    )
    got = rows.select("id", order_flow.clock("ts").alias("t")).orderBy("id").collect()
    g = order_flow.STRETCH_MS
    for r in got:
        f = r["id"] % g
        want = 32_400_000 + r["id"] // g * 900_000 + f * f // g * f // g * 8_000 // g
        assert r["t"] == want
    times = [r["t"] for r in got]
    assert times == sorted(times) and times[0] == 32_400_000 and times[-1] < 64_800_000
    gaps = np.diff(times)
    assert (gaps < 10).any() and (gaps > 1_000).any() and (gaps > 60_000).any()


def test_feed_days_come_from_paths(spark, tmp_path):
    rows = spark.createDataFrame([("X", 1)], "msg_type string, msg_seq_num bigint")
    for folder in ("day=20250915", "2025/09/16", "20250917-part"):
        rows.write.parquet(f"{tmp_path}/{folder}")
    other = spark.createDataFrame([("f", 2, 20250101)], "msg_type string, msg_seq_num bigint, day int")
    other.write.parquet(f"{tmp_path}/20250918")
    got = feed.read_feed(spark, str(tmp_path))
    assert {(r["day"], r["msg_type"]) for r in got.collect()} == {
        (20250915, "X"), (20250916, "X"), (20250917, "X"), (20250101, "f")
    }
    some = feed.read_feed(spark, str(tmp_path), "*.parquet", "20250915,20250917-20250930")
    assert {r["day"] for r in some.collect()} == {20250915, 20250917, 20250101}
    assert not any("/2025/09/16/" in f for f in some.inputFiles())
    assert feed.read_feed(spark, str(tmp_path), days="20300101").count() == 0
    inventory = {r["day"]: r["files"] for r in feed.day_inventory(spark, str(tmp_path)).filter("day IS NOT NULL").collect()}
    assert set(inventory) == {20250915, 20250916, 20250917, 20250918}


def test_days_are_written_resumed_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/out"
    frame = lambda rows: spark.createDataFrame(rows, "day int, v int")
    feed.write_days(frame([(1, 1), (2, 1)]), path)
    feed.write_days(frame([(2, 5)]), path)
    written = spark.read.parquet(path)
    assert sorted((r["day"], r["v"]) for r in written.collect()) == [(1, 1), (2, 5)]
    assert [r["day"] for r in feed.missing_days(frame([(1, 0), (3, 0)]), written).collect()] == [3]
    merged = feed.upsert_by(frame([(1, 1), (2, 2)]), frame([(2, 9), (4, 4)]), "day")
    assert sorted((r["day"], r["v"]) for r in merged.collect()) == [(1, 1), (2, 9), (4, 4)]


@pytest.mark.parametrize("controls,hours", [([], False), (["x1"], True)])
def test_expanding_predictions_equal_refitting(spark, monkeypatch, controls, hours):
    monkeypatch.setattr(predictive, "TARGETS", 16)
    draw = np.random.default_rng(3)
    frames = []
    for spec in ("a", "b"):
        n = 70 if spec == "a" else 20
        frames.append(
            pd.DataFrame(
                {"spec": spec, "day": np.arange(n) // 10, "bucket": np.arange(n) % 10, "hour": np.arange(n) % 10 // 4,
                 "x0": draw.standard_t(2, n), "x1": draw.normal(size=n), "y": draw.normal(size=n)}
            )
        )
    pdf = pd.concat(frames)
    rows = spark.createDataFrame(pdf).repartition(3)
    got = {(r["spec"], r["pos"]): r for r in predictive.expanding_predictions(rows, 30, controls, hours).collect()}
    assert sorted(got) == [("a", t) for t in range(30, 70)]
    a = frames[0]
    base = [np.ones(70), *(a[c] for c in controls)]
    base += [(a["hour"] == h).astype(float) for h in (1, 2)] if hours else []
    base = np.column_stack(base)
    for t in range(30, 70):
        x = np.clip(a["x0"][:t], *np.percentile(a["x0"][:t], [1, 99]))
        full = np.linalg.lstsq(np.column_stack([base[:t], x]), a["y"][:t], rcond=None)[0]
        bench = np.linalg.lstsq(base[:t], a["y"][:t], rcond=None)[0]
        assert got["a", t]["benchmark"] == pytest.approx(base[t] @ bench)
        assert got["a", t]["model"] == pytest.approx(np.append(base[t], a["x0"][t]) @ full)


def test_shapley_shares_equal_orderings():
    """A group's share is its mean gain over all orders of entry."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(200, 12)) + draw.normal(size=(200, 1))
    y = x @ draw.normal(size=12) + draw.normal(size=200) * 3
    z = np.column_stack([x, np.ones(200), y])
    flat = [float((z[:, i] * z[:, j]).sum()) for i in range(14) for j in range(i, 14)]

    def r2(groups):
        keep = np.column_stack([np.ones(200), *(x[:, 4 * g : 4 * g + 4] for g in groups)])
        left = y - keep @ np.linalg.lstsq(keep, y, rcond=None)[0]
        return 1 - left @ left / ((y - y.mean()) @ (y - y.mean()))

    want = np.zeros(3)
    for order in itertools.permutations(range(3)):
        for k, g in enumerate(order):
            want[g] += (r2(order[: k + 1]) - r2(order[:k])) / math.factorial(3)
    got = inference.shapley_r2.func(pd.Series([flat])).iloc[0]
    assert np.allclose(got[["phi_0", "phi_1", "phi_2"]], want) and got["r2_total"] == pytest.approx(r2((0, 1, 2)))


def test_natural_spline_is_cubic_inside_and_straight_outside(spark):
    knots = "array(0D, 1D, 2D, 3D, 5D)"
    x = spark.range(-20, 120).select((F.col("id") / 10).alias("x"))
    rows = x.select("x", *[c.alias(f"s{i}") for i, c in enumerate(inference.natural_spline("x", knots))]).orderBy("x").collect()
    s = np.array([[r[f"s{i}"] for i in range(4)] for r in rows])
    at = np.array([r["x"] for r in rows])
    bend = np.diff(s, 2, axis=0)
    outside = (at[1:-1] < -0.05) | (at[1:-1] > 5.05)
    assert np.allclose(bend[outside], 0, atol=1e-8) and np.abs(bend[~outside, 1:]).max() > 1e-3
    same = x.select(*[c.alias(f"s{i}") for i, c in enumerate(inference.natural_spline("x", "array(0D, 1D, 1D, 5D, 5D)"))])
    assert same.filter("s3 IS NULL OR s2 IS NULL").count() == 0
