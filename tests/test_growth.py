"""Steps shared by many queries: how often rows are shuffled, and over how many partitions."""

import random

from pyspark.sql import functions as F

from tests.book import SCHEMA, message_rows, opening
from tickloom.operators import best_quote, lifecycle, matching
from tickloom.operators.kernels import _Sums
from tickloom.plans.pipeline import BookPipeline, raw_log
from tickloom.plans.rough_pipeline import RoughPipeline
from tickloom.session import StageStore
from tickloom.sources import order_flow, rough_flow


def shuffles(df):
    """Exchanges by key in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_quotes_and_order_states_are_shuffled_once(spark):
    rows = spark.createDataFrame(message_rows(opening(), 2, 1), SCHEMA).withColumn("chunk", F.col("chunk").cast("bigint"))
    store = StageStore(spark, "test")
    log = store.table("log", lambda: lifecycle.with_level_depth(raw_log(rows)))
    snapshots = store.table("snapshots", lambda: best_quote.chunk_snapshots(log, log))
    best = store.table("best", lambda: best_quote.best_changes(lifecycle.occupancy_changes(log), snapshots))
    probe = rows.select("day", "sid", "chunk", "rpt", "t_ms")
    quotes = best_quote.quote_at(probe, best, log, snapshots, ["live", "born_ms"])
    assert shuffles(quotes) == 1
    found = quotes.orderBy("rpt").select("rpt", "b", "a", "qb", "qa", "live", "born_ms").collect()
    assert [tuple(r) for r in found] == [
        (1, 100, None, 2, None, False, None), (2, 100, None, 2, None, False, None), (3, 100, None, 2, None, False, None),
        (4, 100, 102, 2, 2, False, None), (5, 100, 102, 2, 2, False, None), (6, 100, 102, 2, 2, False, None),
    ]
    assert shuffles(lifecycle.with_order_state(rows)) == 1


def test_stages_are_dealt_in_proportion_to_the_input(spark):
    store = StageStore(spark, "test")
    name = "spark.sql.shuffle.partitions"
    given, seen = spark.conf.get(name), []

    def build():
        seen.append(spark.conf.get(name))
        return spark.range(3)

    store.table("small", build)
    store.rows = 40 * StageStore.ROWS
    store.table("large", build)
    assert seen == [given, "40"] and spark.conf.get(name) == given


def test_a_late_stage_asked_for_first_follows_the_input_too(spark, monkeypatch):
    monkeypatch.setattr(StageStore, "ROWS", 50)
    name = "spark.sql.shuffle.partitions"
    for pipe in (BookPipeline(spark, "/root/testdata/sf0.001"), RoughPipeline(spark, "/root/testdata/sf0.001")):
        seen = []
        pipe.store.table("late", lambda: seen.append(spark.conf.get(name)) or pipe.numbered)  # noqa: B023
        assert seen == [str(-(-pipe.store.rows // 50))] and pipe.store.rows > 100


def test_stages_are_merged_alike_in_a_session_of_many_partitions(spark):
    store, seen = StageStore(spark, "test"), []
    name, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    given, store.rows = spark.conf.get(name), 3 * StageStore.ROWS
    spark.conf.set(name, "200")
    try:
        store.table("large", lambda: seen.append((spark.conf.get(name), spark.conf.get(merged))) or spark.range(3))
        assert seen == [("200", "16m")]
    finally:
        spark.conf.set(name, given)


def test_stages_read_in_small_splits(spark):
    store, seen, name = StageStore(spark, "test"), [], "spark.sql.files.maxPartitionBytes"
    given, store.rows = spark.conf.get(name), StageStore.ROWS
    store.table("any", lambda: seen.append(spark.conf.get(name)) or spark.range(3))
    assert seen == ["16m"] and spark.conf.get(name) == given


def test_messages_take_the_time_of_their_packet_without_a_join(spark, tmp_path):
    events = [(i, f"2024-01-0{1 + i % 2} 0{i % 7}:00:0{i % 9}", i % 5, ("purchase", "view", "signup")[i % 3]) for i in range(90)]
    rows = spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    store = StageStore(spark, "test")
    numbered = store.table("numbered", lambda: order_flow.numbered_events(spark, str(tmp_path), store))
    assert store.rows == 90
    for delayed in (False, True):
        messages = order_flow.order_messages(order_flow.orders(numbered), 8, delayed)
        assert "Join Inner" not in messages._jdf.queryExecution().optimizedPlan().toString()
        times = {(r["day"], r["n"]): r["t_ms"] for r in numbered.collect()}
        found = messages.collect()
        assert len(found) > 90 and all(r["t_ms"] == times[r["day"], r["seq"]] for r in found)


def moved_rows(df):
    """Shuffles of rows by a key that has ``chunk`` in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in x and "chunk" in x for x in plan.split("\n"))


def rough_orders(spark, tmp_path):
    events = [(i, f"2024-01-0{1 + i % 2} 0{i % 7}:00:0{i % 9}", i % 5, ("purchase", "view", "signup")[i % 3]) for i in range(400)]
    rows = spark.createDataFrame(events, "event_id bigint, ts string, user_id bigint, event_type string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    store = StageStore(spark, "test")
    return order_flow.numbered_events(spark, str(tmp_path), store)


def test_positions_of_events_are_added_without_a_shuffle(spark, tmp_path):
    name = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(name)
    spark.conf.set(name, -1)  # as on tables beyond it
    try:
        numbered = rough_orders(spark, tmp_path)
        assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, given)
    found = sorted((r["day"], r["n"], r["cnt"]) for r in numbered.collect())
    assert found == [(d, n, 200) for d in (20240101, 20240102) for n in range(200)]


def test_depth_from_openings_equals_the_scan_of_levels(spark):
    effects = spark.createDataFrame(
        [(1, 1, i // 3, i, 0, "T" if i % 5 == 4 else "N", None if i % 5 == 4 else i % 2, None if i % 5 == 4 else 100 + i % 3,
          None if i % 5 == 4 else (1, 1, -1)[i % 3], None if i % 5 == 4 else (2, 3, -2)[i % 3]) for i in range(40)],
        "day int, sid bigint, chunk bigint, rpt bigint, sub int, typ string, e_side int, e_tick bigint, dn bigint, dq bigint",
    )
    table = StageStore(spark, "test").table("effects", lambda: effects)
    deep = lifecycle.depth_from_openings(lifecycle.with_openings(table).repartition("day", "sid", "chunk"))
    columns = [*effects.columns, "level_n", "level_q"]
    expected = lifecycle.with_level_depth(table).select(columns)
    assert sorted(map(str, deep.select(columns).collect())) == sorted(map(str, expected.collect()))
    assert deep.count() == 40 and "Join" not in deep._jdf.queryExecution().optimizedPlan().toString()


def test_packets_are_shuffled_once(spark):
    rows = spark.createDataFrame(message_rows(opening() * 9, 2, 1), SCHEMA).withColumn("chunk", F.col("chunk").cast("bigint"))
    log = StageStore(spark, "test").table("log", lambda: lifecycle.with_level_depth(raw_log(rows)))
    # rows, partials of the chunks, and what the window over the partials gives to the join
    assert moved_rows(matching.packet_cuts(log)) <= 3


def test_rough_messages_are_not_joined_with_packets(spark, tmp_path):
    orders = StageStore(spark, "test").table("orders", lambda: order_flow.orders(rough_orders(spark, tmp_path)))
    dealt = rough_flow.dealt_messages(orders, 16)
    joins = [x for x in dealt._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 1 and "chunk" in joins[0] and "seq" not in joins[0]
    found = rough_flow.rough_messages(dealt, rough_flow.chunk_starts(dealt)).collect()
    own = {(r["day"], r["n"]): r for r in orders.collect()}
    for day in (20240101, 20240102):
        arrived = [n for n in range(200) if own[day, n]["oid"] % 23 != 1]
        epochs = {n: sum(b - a > 1 for a, b in zip(arrived, arrived[1:]) if b <= n) for n in arrived}
        rows = [r for r in found if r["day"] == day]
        assert {r["seq"] for r in rows} == set(arrived) and max(epochs.values()) > 3
        assert all(r["epoch"] == epochs[r["seq"]] and r["t_ms"] == own[day, r["seq"]]["t_ms"] for r in rows)
        assert sorted(r["rpt"] for r in rows) == list(range(1, len(rows) + 1))
        assert [r["seq"] for r in sorted(rows, key=lambda r: r["rpt"])] == sorted(r["seq"] for r in rows)


def test_queue_changes_are_read_back_not_computed_again(spark):
    pipe = BookPipeline(spark, "/root/testdata/sf0.001")
    assert pipe.queue.count() > 0
    assert "queue_changes" in pipe.store._ready


def test_prefix_sums_touch_few_nodes_and_equal_plain_sums():
    draw, sums, plain = random.Random(3), _Sums(40), {}
    for _ in range(2000):
        at, value = draw.choice((draw.randrange(20), draw.randrange(5000))), draw.randrange(-9, 10)
        sums.add(at, value)
        plain[at] = plain.get(at, 0) + value
        for asked in (at, at + 1, draw.randrange(20000), 2 * sums.limit + 3, 0):
            assert sums.before(asked) == sum(v for p, v in plain.items() if p < asked)
    assert sums.limit <= 8192 and max(sums.tree) <= sums.limit
