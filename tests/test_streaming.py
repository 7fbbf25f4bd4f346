"""Tumbling windows over a stream of files: counts, late rows, a run that goes on where one ended."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.streaming import windows as w

SCHEMA = "day int, sid bigint, t_ms bigint, typ string, qty bigint"
MINUTE = 60_000
FILES = [
    [(20240102, 1, t, k, q) for t, k, q in ((1_000, "N", 3), (2_000, "T", 2), (5 * MINUTE, "N", 1), (59_999, "C", 4))],
    # windows of two of these rows had ended two minutes before the highest time so far
    [(20240102, 1, t, k, q) for t, k, q in ((3_000, "T", 7), (4 * MINUTE, "T", 5), (179_999, "N", 1), (9 * MINUTE, "D", 1))],
    [(20240102, 2, 30 * MINUTE, "T", 6), (20240102, 1, 8 * MINUTE, "N", 1), (20240102, 1, 6 * MINUTE, "N", 1)],
    [(20240103, 1, 0, "T", 1)],
]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def write(spark, folder, k):
    spark.createDataFrame(FILES[k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_stream_counts_and_late_rows(spark, tmp_path):
    folder = str(tmp_path)
    late_rows, on_time, high = [], [], None
    for k, rows in enumerate(FILES):
        write(spark, folder, k)
        stream = w.message_stream(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, 1)
        w.run_to_tables(stream, f"{folder}/out", "1 minute", 2 * MINUTE)  # each run drains what is new and ends
        at = lambda r: (r[0] - 20240102) * 86_400_000 + r[2]
        for r in rows:
            ended = at(r) // MINUTE * MINUTE + MINUTE
            (late_rows if high is not None and ended <= high - 2 * MINUTE else on_time).append(r)
        high = max(at(r) for r in rows) if high is None else max(high, *(at(r) for r in rows))
    late = spark.read.parquet(f"{folder}/out/late").select("day", "sid", "t_ms", "typ", "qty")
    assert rows_of(late) == sorted(late_rows) and len(late_rows) == 3
    batch = spark.createDataFrame(on_time, SCHEMA).withColumn("event_time", w.event_time())
    want = w.window_counts(batch, "1 minute")
    found = w.counts_of(spark, f"{folder}/out").select(want.columns)
    assert rows_of(found) == rows_of(want)
    assert spark.read.parquet(f"{folder}/out/rows").select(F.count_distinct("batch")).first()[0] == 4
