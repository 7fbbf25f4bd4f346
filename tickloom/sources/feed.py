"""Nested market-by-order feed: reading, flattening, sinks.

A feed message is a header plus ``md_entries: array<struct>``.  Only the leaves a job
needs are selected before the array is exploded, so that the scan reads few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.constants import KEY, TICK_POINTS

PRICE = T.StructType(
    [T.StructField("mantissa", T.LongType()), T.StructField("exponent", T.IntegerType())]
)
ENTRY = T.StructType(
    [
        T.StructField("security_id", T.LongType()),
        T.StructField("md_entry_type", T.StringType()),
        T.StructField("md_update_action", T.IntegerType()),
        T.StructField("order_id", T.StringType()),
        T.StructField("md_entry_px", PRICE),
        T.StructField("md_entry_size", T.LongType()),
        T.StructField("rpt_seq", T.LongType()),
        T.StructField("trade_condition", T.StringType()),
        T.StructField("md_entry_buyer", T.StringType()),
        T.StructField("md_entry_seller", T.StringType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("md_entry_time", T.LongType()),
        T.StructField("md_insert_time", T.LongType()),
    ]
)
MESSAGE = T.StructType(
    [
        T.StructField("day", T.IntegerType()),
        T.StructField("msg_type", T.StringType()),
        T.StructField("msg_seq_num", T.LongType()),
        T.StructField("sending_time", T.LongType()),
        T.StructField("transact_time", T.LongType()),
        T.StructField("rpt_seq", T.LongType()),
        T.StructField("security_id", T.LongType()),
        T.StructField("last_fragment", T.LongType()),
        T.StructField("md_entries", T.ArrayType(ENTRY)),
        T.StructField("security_trading_status", T.IntegerType()),
        T.StructField("security_trading_event", T.IntegerType()),
        T.StructField("trad_ses_open_time", T.LongType()),
        T.StructField("trading_session_sub_id", T.StringType()),
        T.StructField("security_group", T.StringType()),
        T.StructField("headline", T.StringType()),
    ]
)
# --- fixed values: entry types and actions of the feed ----------------------------
ENTRY_TYPES = {"0": 0, "1": 1, "2": 2}
ACTIONS = {0: "N", 1: "C", 2: "D"}
RETAIL_MARK = "RL"
# --- end of fixed values ----------------------------------------------------------
DAY_IN_PATH = r"(?<![0-9A-Za-z])20\d{2}[/-]?(0[1-9]|1[0-2])[/-]?(0[1-9]|[12]\d|3[01])(?![0-9A-Za-z])"


def day_of_path(path: str) -> Column:
    """The last day named by a file's folders (``day=`` or year, month and day), else by its name."""

    def last_day(text: Column) -> Column:
        found = F.try_element_at(F.regexp_extract_all(text, F.lit(DAY_IN_PATH), 0), F.lit(-1))
        return F.regexp_replace(found, "[/-]", "").try_cast("int")

    folders = F.regexp_replace(path, "/[^/]*$", "/")
    return F.coalesce(last_day(folders), last_day(F.regexp_extract(path, "[^/]*$", 0)))


# ---------------------------------------------------------------- reading
def read_feed(spark: SparkSession, path: str, pattern: str | None = None, days: str | None = None) -> DataFrame:
    """Feed files under ``path`` (any depth), by name ``pattern`` and days if given.

    Absent columns read as NULL; ``day`` comes from the file's path where the file has none.
    A selection of days lists the files first and opens only those of the days.
    """
    columns = [f for f in MESSAGE if f.name != "day"]
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    paths = [path]
    if days is not None:
        listed = reader.format("binaryFile").load(path).select("path", day_of_path("path").alias("day"))
        paths = [r["path"] for r in listed.filter(day_predicate(days)).orderBy("day", "path").collect()]
        if not paths:
            return spark.createDataFrame([], MESSAGE)
    rows = reader.schema(MESSAGE).parquet(*paths)
    named = rows.withColumn("_path", F.col("_metadata.file_path"))
    day = F.coalesce("day", day_of_path("_path")) if "day" in rows.columns else day_of_path("_path")
    return named.withColumn("day", day).select("day", *(f.name for f in columns))


def parse_days(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """'20250915,20250917-20250919' to single days and closed ranges."""
    singles, ranges = [], []
    for part in filter(None, (x.strip() for x in text.split(","))):
        if "-" in part:
            low, high = part.split("-", 1)
            ranges.append((int(low), int(high)))
        else:
            singles.append(int(part))
    return singles, ranges


def day_predicate(text: str, column: str = "day") -> Column:
    """Day selection as a predicate, so that day partitions are pruned."""
    singles, ranges = parse_days(text)
    wanted = F.col(column).isin(singles) if singles else F.lit(False)
    for low, high in ranges:
        wanted = wanted | F.col(column).between(low, high)
    return wanted


def day_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per day from file metadata alone (contents are not read)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length")
    )
    return (
        files.withColumn("day", day_of_path("path"))
        .groupBy("day")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def status_messages(feed: DataFrame) -> DataFrame:
    """Trading-status and news messages."""
    return feed.filter(F.col("msg_type").isin("f", "B")).select(
        "day", F.col("security_id").alias("sid"), "msg_type", "msg_seq_num", "sending_time",
        "security_group", "trading_session_sub_id", "security_trading_status",
        "security_trading_event", "trad_ses_open_time", "headline",
    )


# ---------------------------------------------------------------- flattening
def entries(feed: DataFrame, fields: list[str]) -> DataFrame:
    """One row per entry with its parent message (``msg_seq_num, pos``) and only ``fields``."""
    narrow = F.transform(
        "md_entries", lambda e: F.struct(*[e[f].alias(f"e_{f}") for f in fields])
    )
    header = ["day", "msg_seq_num", "sending_time", "transact_time", "last_fragment", "rpt_seq", "security_id"]
    return (
        feed.filter(F.col("msg_type") == "X")
        .select(*header, F.posexplode(narrow).alias("pos", "e"))
        .select(*header, "pos", "e.*")
    )


def price(px: Column) -> Column:
    return px["mantissa"] * F.pow(F.lit(10.0), px["exponent"])


def flat_orders(feed: DataFrame, sid: int | None = None, header_first: bool = False) -> DataFrame:
    """Flat order and trade rows of one or all instruments.

    The instrument is the entry's, else the header's (``header_first`` swaps that order);
    entries without a price or with other types or actions are dropped.
    """
    rows = entries(
        feed,
        ["security_id", "md_entry_type", "md_update_action", "order_id", "md_entry_px",
         "md_entry_size", "rpt_seq", "trade_condition"],
    )
    ids = [F.col("e_security_id"), F.col("security_id")]
    rows = rows.withColumn("sid", F.coalesce(*(reversed(ids) if header_first else ids)))
    if sid is not None:
        rows = rows.filter(F.col("sid") == sid)
    return rows.filter(
        F.col("e_md_entry_type").isin(*ENTRY_TYPES)
        & F.col("e_md_update_action").isin(*ACTIONS)
        & F.col("e_md_entry_px.mantissa").isNotNull()
    ).select(
        *KEY,
        F.coalesce("e_rpt_seq", "rpt_seq").alias("rpt"),
        "msg_seq_num",
        "last_fragment",
        "sending_time",
        F.col("e_md_entry_type").cast("int").alias("side"),
        F.col("e_md_update_action").alias("action"),
        F.coalesce(F.expr("try_cast(e_order_id AS bigint)"), F.lit(-1)).alias("oid"),
        price(F.col("e_md_entry_px")).alias("price"),
        F.coalesce("e_md_entry_size", F.lit(0)).alias("size"),
        F.col("e_trade_condition").alias("trade_condition"),
    )


def thesis_rows(feed: DataFrame, sid: int | None = None) -> DataFrame:
    """Variant ordered by clock: header instrument first, price > 0, any action.

    Rows of equal clock are ordered by message and entry position.
    """
    rows = entries(feed, ["security_id", "md_entry_type", "md_update_action", "md_entry_px"])
    rows = rows.withColumn("sid", F.coalesce("security_id", "e_security_id")).withColumn(
        "price", price(F.col("e_md_entry_px"))
    )
    if sid is not None:
        rows = rows.filter(F.col("sid") == sid)
    return rows.filter("price > 0").select(
        *KEY,
        F.coalesce("transact_time", "sending_time", "msg_seq_num").alias("time_seq"),
        "msg_seq_num",
        "pos",
        F.col("e_md_entry_type").alias("entry_type"),
        F.col("e_md_update_action").alias("action"),
        "price",
    )


def volume_by_instrument(feed: DataFrame) -> DataFrame:
    """Traded volume and trades per day and instrument: four leaves reach the explode."""
    rows = entries(feed, ["security_id", "md_entry_type", "md_update_action", "md_entry_size"])
    return (
        rows.filter("e_md_entry_type = '2' AND e_md_update_action = 0")
        .withColumn("sid", F.coalesce("e_security_id", "security_id"))
        .groupBy(*KEY)
        .agg(F.sum("e_md_entry_size").alias("volume"), F.count("*").alias("trades"))
    )


def target_has_largest_volume(volumes: DataFrame, sid: int) -> DataFrame:
    return volumes.groupBy("day").agg(
        F.max_by("sid", "volume").alias("largest_sid"),
        F.max("volume").alias("largest_volume"),
        F.coalesce(F.sum(F.when(F.col("sid") == sid, F.col("volume"))), F.lit(0)).alias("target_volume"),
    ).withColumn("target_is_largest", F.col("largest_sid") == sid)


def to_messages(flat: DataFrame, packets_per_chunk: int = 65_536) -> DataFrame:
    """Flat rows to the message table of the book pipeline.

    Ticks are absolute (price / tick); chunks are slices of the channel sequence, so a
    packet never straddles one and no slice can be hot.
    """
    raw = F.col("price") / TICK_POINTS
    kind = F.when(F.col("side") == 2, "T")
    for code, name in ACTIONS.items():
        kind = kind.when(F.col("action") == code, name)
    from tickloom.functions.clock import local_ms

    return flat.select(
        *KEY,
        F.floor(F.col("msg_seq_num") / packets_per_chunk).alias("chunk"),
        F.col("msg_seq_num").alias("seq"),
        local_ms(F.col("sending_time")).alias("t_ms"),
        "rpt",
        kind.alias("typ"),
        F.when(F.col("side") == 2, -1).otherwise(F.col("side")).alias("side"),
        F.round(raw).cast("bigint").alias("tick"),
        F.col("size").alias("qty"),
        "oid",
        F.coalesce(F.col("trade_condition").contains(RETAIL_MARK), F.lit(False)).alias("retail"),
        (F.abs(raw - F.round(raw)) > 1e-9).alias("off_grid"),
    )


def require_on_grid(messages: DataFrame) -> DataFrame:
    """Fail the job on a price off the tick grid."""
    checked = F.when(F.col("off_grid"), F.raise_error(F.lit("price off the tick grid"))).otherwise(
        F.col("tick")
    )
    return messages.withColumn("tick", checked.cast("bigint")).drop("off_grid")


# ---------------------------------------------------------------- building a feed
def nested_feed(messages: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Order-flow messages packed as a nested feed (one row per packet).

    The incoming firm of a packet is the counterparty of its prints.
    """
    packet = ["day", "sid", "chunk", "seq"]
    incoming = F.max(F.when(F.col("typ") == "N", F.col("firm")))
    action = F.when(F.col("typ") == "C", 1).when(F.col("typ") == "D", 2).otherwise(0)
    kind = F.when(F.col("typ") == "T", "2").otherwise(F.col("side").cast("string"))
    entry = F.struct(
        F.col("rpt").alias("rpt_seq"),
        F.col("sid").alias("security_id"),
        kind.alias("md_entry_type"),
        action.alias("md_update_action"),
        F.when(F.col("typ") != "T", F.col("oid").cast("string")).alias("order_id"),
        F.struct((F.col("tick") * TICK_POINTS * 100).alias("mantissa"), F.lit(-2).alias("exponent")).alias("md_entry_px"),
        F.col("qty").alias("md_entry_size"),
        F.when(F.col("retail"), RETAIL_MARK).alias("trade_condition"),
        F.when(F.col("side") == 0, F.col("firm").cast("string")).alias("md_entry_buyer"),
        F.when(F.col("side") == 1, F.col("firm").cast("string")).alias("md_entry_seller"),
        F.when(F.col("typ") == "T", F.concat_ws("-", F.col("seq"), F.col("oid"))).alias("trade_id"),
        (F.col("t_ms") * 1_000_000).alias("md_entry_time"),
        F.col("t_ms").alias("md_insert_time"),
    )
    utc = F.col("t_ms") + 10_800_000
    stamp = (
        F.col("day").cast("bigint") * 1_000_000_000
        + F.floor(utc / 3_600_000) * 10_000_000
        + F.floor(utc / 60_000) % 60 * 100_000
        + F.floor(utc / 1_000) % 60 * 1_000
        + utc % 1_000
    )
    packed = messages.groupBy(*packet).agg(
        F.first("t_ms").alias("t_ms"),
        F.sort_array(F.collect_list(entry)).alias("md_entries"),
        incoming.alias("incoming"),
    )
    feed = packed.select(
        "day",
        F.lit("X").alias("msg_type"),
        F.col("seq").alias("msg_seq_num"),
        stamp.alias("sending_time"),
        F.lit(None).cast("bigint").alias("transact_time"),
        F.lit(None).cast("bigint").alias("rpt_seq"),
        F.col("sid").alias("security_id"),
        F.lit(None).cast("bigint").alias("last_fragment"),
        "md_entries",
    )
    if status is None:
        return feed
    rows = status.select(
        "day", "msg_type", "sending_time", F.col("sid").alias("security_id"), "security_trading_status"
    )
    return feed.unionByName(rows, allowMissingColumns=True)


# ---------------------------------------------------------------- sinks
def write_days(df: DataFrame, path: str) -> None:
    """One partition per day; days already written are replaced, others are kept."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(path)


def missing_days(wanted: DataFrame, written: DataFrame) -> DataFrame:
    """Days still to be processed (resume)."""
    return wanted.select("day").distinct().join(
        written.select("day").distinct(), "day", "left_anti"
    )


def upsert_by(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Replace the rows of ``old`` whose key occurs in ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        new, allowMissingColumns=True
    )
