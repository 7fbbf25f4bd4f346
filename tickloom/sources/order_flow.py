"""Order flow over the ``events`` table: one session per day, one packet per event.

Integer arithmetic only, so that any SQL engine gives the same messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.constants import KEY
from tickloom.operators.ordered import carry_scan, running_sum
from tickloom.session import StageStore

# --- fixed values of the adapter ------------------------------------------
OPEN_MS = 32_400_000                 # 09:00, first packet
STRETCH_MS = 2_400_000               # 40 minutes of the table's clock become one burst
BURST_STEP_MS = 900_000              # bursts begin every 15 minutes, 36 in nine hours
BURST_MS = 8_000                     # a burst's length
PACKETS_PER_CHUNK = 4_096
EXECUTED_TYPES = ("purchase", "click")
RETAIL_TYPE = "signup"
# --- end of fixed values --------------------------------------------------


def size(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``events``, from the files' footers."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def numbered_events(spark: SparkSession, sf_dir: str, store: StageStore) -> DataFrame:
    """Rows with their position ``n`` in the day and the day's size ``cnt``.

    One range shuffle on the full sort key (unique, so no value can be hot); the
    position inside a written partition plus the sizes of the partitions before it
    gives the row number without a whole-day window.
    """

    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    store.rows = raw.count()  # from the files' footers

    def build() -> DataFrame:
        date = F.to_date("ts")
        dated = raw.withColumn("day", F.year(date) * 10000 + F.month(date) * 100 + F.day(date))
        return (
            dated.withColumn("t_ms", clock("ts"))
            .repartitionByRange("day", "ts", "event_id")
            .sortWithinPartitions("day", "ts", "event_id")
            .withColumn("_row", F.monotonically_increasing_id())
            .withColumn("_part", F.spark_partition_id())
        )

    rows = store.table("sorted_events", build)
    sizes = rows.groupBy("day", "_part").agg(
        F.count("*").alias("_size"), F.min("_row").alias("_first")
    )
    earlier = Window.partitionBy("day").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        "day",
        "_part",
        "_first",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy("day")).alias("cnt"),
    )
    # a row for each partition and day within it, so the rows themselves stay where they are
    return rows.join(F.broadcast(offsets), ["day", "_part"]).select(
        "day",
        (F.col("_before") + F.col("_row") - F.col("_first")).alias("n"),
        "cnt",
        "t_ms",
        "event_id",
        "user_id",
        "event_type",
    )


def orders(numbered: DataFrame) -> DataFrame:
    """One order per event with its start, end and way of ending."""
    side = F.expr("(event_id * 2654435 div 1000) % 2")
    tick = F.when(side == 0, F.expr("1000 - (event_id * 40503 div 64) % 4")).otherwise(
        F.expr("1001 + (event_id * 30011 div 128) % 4")
    )
    end = F.expr("n + 2 + (event_id * 48271 div 256) % 11")
    return numbered.select(
        "day",
        F.lit(1).cast("bigint").alias("sid"),
        "n",
        "cnt",
        "t_ms",
        F.col("event_id").alias("oid"),
        F.col("user_id").alias("firm"),
        "event_type",
        side.cast("int").alias("side"),
        tick.alias("tick"),
        F.expr("1 + event_id % 5").alias("qty"),
        F.when(end < F.col("cnt"), end).alias("n_end"),
        F.col("event_type").isin(*EXECUTED_TYPES).alias("executed"),
    )


def clock(ts: str):
    """Session milliseconds of a packet, from its own time of day alone.

    Each stretch of the day becomes a burst in which time runs as the cube of the time
    since the stretch began: gaps of milliseconds first, of seconds later.  The order of
    packets is kept, and a packet's time is the same on a day of any size.
    """
    of_day = F.expr(
        f"hour({ts}) * 3600000L + minute({ts}) * 60000L + bigint(floor(extract(SECOND FROM {ts}) * 1000))"
    )
    into = of_day % STRETCH_MS
    whole = lambda x: F.floor(x / STRETCH_MS)
    cube = whole(whole(whole(into * into) * into) * BURST_MS)
    return OPEN_MS + whole(of_day) * BURST_STEP_MS + cube


def order_messages(
    order_rows: DataFrame, per_chunk: int = PACKETS_PER_CHUNK, delayed: bool = False
) -> DataFrame:
    """Explode orders into feed messages and number them by arrival (``rpt``).

    ``delayed`` is the variant that publishes the removal of an executed order one
    packet after its print (positions 0-2 of a burst), so that a matching event
    spans packets.  A chunk is a fixed number of packets, ``per_chunk``.  Every packet brings one new
    order, which knows the packet's time, so the other messages take it from there.
    """
    msg = "struct<seq:bigint,rank:int,typ:string,side:int,tick:bigint,qty:bigint,retail:boolean>"

    def message(seq, rank, typ, side, qty, retail):
        return F.struct(
            seq.alias("seq"),
            F.lit(rank).alias("rank"),
            F.lit(typ).alias("typ"),
            side.cast("int").alias("side"),
            F.col("tick"),
            qty.cast("bigint").alias("qty"),
            F.lit(retail).alias("retail"),
        ).cast(msg)

    none = F.lit(-1)
    ends = F.col("n_end").isNotNull()
    fills = ends & F.col("executed")
    partial = fills & (F.col("qty") == 5)
    last_qty = F.when(partial, F.lit(3)).otherwise(F.col("qty"))
    gone = F.col("n_end")
    if delayed:
        late = fills & (F.col("n_end") % 8 <= 2) & (F.col("n_end") + 1 < F.col("cnt"))
        gone = F.when(late, F.col("n_end") + 1).otherwise(F.col("n_end"))
    parts = F.array(
        F.when(fills, message(F.col("n_end"), 0, "T", none, last_qty, False)),
        F.when(partial, message(F.col("n") + 1, 0, "T", none, F.lit(2), False)),
        F.when(
            F.col("event_type") == RETAIL_TYPE,
            message(F.col("n"), 1, "T", none, F.lit(1), True),
        ),
        F.when(partial, message(F.col("n") + 1, 2, "C", F.col("side"), F.lit(3), False)),
        F.when(ends, message(gone, 3, "D", F.col("side"), last_qty, False)),
        message(F.col("n"), 4, "N", F.col("side"), F.col("qty"), False),
    )
    exploded = order_rows.withColumn("_m", F.explode(F.filter(parts, lambda x: x.isNotNull())))
    flat = (
        exploded.select(
            *KEY,
            F.floor(F.col("_m.seq") / per_chunk).alias("chunk"),
            F.col("_m.seq").alias("seq"),
            F.when(F.col("_m.typ") == "N", F.col("t_ms")).alias("t_ms"),
            F.col("_m.rank").alias("rank"),
            F.col("_m.typ").alias("typ"),
            F.col("_m.side").alias("side"),
            F.col("_m.tick").alias("tick"),
            F.col("_m.qty").alias("qty"),
            "oid",
            "firm",
            F.col("_m.retail").alias("retail"),
        )
    )
    ranked = carry_scan(
        flat,
        KEY,
        ["seq", "rank", "oid"],
        [running_sum("rpt", F.lit(1).cast("bigint"))],
    )
    packet = Window.partitionBy(*KEY, "chunk", "seq")
    timed = ranked.withColumn("t_ms", F.max("t_ms").over(packet))
    # a message of a packet that the day does not have goes
    return timed.filter("t_ms IS NOT NULL").drop("rank")


def status_messages(numbered: DataFrame) -> DataFrame:
    """Trading-status messages of each day: pre-open, open, an auction every seventh day,
    closing call and close (``sending_time`` is YYYYMMDDHHMMSSmmm in UTC)."""
    days = numbered.select("day").distinct().withColumn(
        "epoch_day", F.unix_date(F.to_date(F.col("day").cast("string"), "yyyyMMdd"))
    )
    regular = [(21, "113000000"), (17, "120000000"), (101, "210000000"), (18, "211000000")]
    auction = [(2, "150000000"), (17, "150900000")]

    def entry(code, hms):
        return F.struct(F.lit(code).alias("status"), F.lit(hms).alias("hms"))

    plain = F.array(*[entry(*x) for x in regular])
    with_auction = F.array(*[entry(*x) for x in regular + auction])
    return (
        days.withColumn(
            "_s", F.explode(F.when(F.col("epoch_day") % 7 == 0, with_auction).otherwise(plain))
        )
        .select(
            "day",
            F.lit(1).cast("bigint").alias("sid"),
            F.lit("f").alias("msg_type"),
            F.concat(F.col("day").cast("string"), F.col("_s.hms"))
            .cast("bigint")
            .alias("sending_time"),
            F.col("_s.status").alias("security_trading_status"),
        )
    )
