"""Tumbling counters over a message stream, with a watermark and a table of the rows that came too late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.functions.clock import day_date

#: Window lengths in use.
SIZES = ("1 second", "1 minute", "5 minutes", "10 minutes", "15 minutes", "1 hour")
COUNTERS = ("messages", "new_orders", "prints", "volume")


def event_time(day: str = "day", t_ms: str = "t_ms") -> Column:
    """Exchange-clock timestamp of a message."""
    return F.timestamp_millis(F.unix_date(day_date(F.col(day))).cast("bigint") * 86_400_000 + F.col(t_ms))


def message_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Message files as a stream (new files are new data)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn("event_time", event_time())


def window_counts(rows: DataFrame, size: str) -> DataFrame:
    """Messages, new orders, prints and printed volume per instrument and window."""
    typ = F.col("typ")
    return (
        rows.groupBy("sid", F.window("event_time", size).alias("w"))
        .agg(
            F.count("*").alias("messages"),
            F.count_if(typ == "N").alias("new_orders"),
            F.count_if(typ == "T").alias("prints"),
            F.coalesce(F.sum(F.when(typ == "T", F.col("qty"))), F.lit(0)).alias("volume"),
        )
        .select("sid", F.col("w.start").alias("window_start"), *COUNTERS)
    )


def run_to_tables(stream: DataFrame, path: str, size: str, lateness_ms: int) -> None:
    """Drain the available input into ``path``: partial counts, late rows and the highest time, by micro-batch.

    A batch's watermark is the highest event time of all batches before it less ``lateness_ms``; a row whose window has
    ended by then is late and goes to ``late`` as it is, every other row into the counts of ``rows``.  Counters add
    up, so a window's counts are the sum over the batches.  Each batch overwrites its own folders: one that is run
    again after a failure leaves the same.
    """
    spark = stream.sparkSession
    millis = F.unix_millis("event_time")

    def before(number: int) -> int | None:
        if number == 0:
            return None
        marks = [f"{path}/marks/batch={n}" for n in (number - 1,)]
        return spark.read.schema("high bigint").parquet(*marks).agg(F.max("high")).first()[0]

    def save(batch: DataFrame, number: int) -> None:
        high = before(number)
        ended = F.unix_millis(F.window("event_time", size)["end"])
        late = F.lit(False) if high is None else ended <= high - lateness_ms
        marked = batch.withColumn("late", F.coalesce(late, F.lit(False)))
        kept = window_counts(marked.filter("NOT late"), size)
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        marked.filter("late").drop("late").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        reached = batch.agg(F.max(millis).alias("high")).select(F.greatest("high", F.lit(high).cast("bigint")).alias("high"))
        reached.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    query.awaitTermination()


def counts_of(spark: SparkSession, path: str) -> DataFrame:
    """Counts of every window over all batches so far."""
    return spark.read.parquet(f"{path}/rows").groupBy("sid", "window_start").agg(*[F.sum(c).alias(c) for c in COUNTERS])
