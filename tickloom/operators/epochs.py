"""Books that start anew: every scan restarts where the feed was broken.

An epoch is made part of the instrument's key, so that each operator on the book (orders,
levels, best quotes, chunk snapshots) keeps the epochs apart without knowing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Epochs that one session can have; instrument numbers stay below 2 ** 43.
MOST = 1 << 20


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``sid`` names instrument and epoch."""
    return rows.withColumn("sid", F.col("sid") * MOST + F.col("epoch")).drop("epoch")


def unkeyed(rows: DataFrame) -> DataFrame:
    """The instrument as ``sid`` again, and its ``epoch``."""
    return rows.withColumn("epoch", F.col("sid") % MOST).withColumn("sid", F.expr(f"sid div {MOST}"))


def carried(rows: DataFrame) -> DataFrame:
    """``rows`` as one epoch: the book is kept through every break."""
    return keyed(rows.withColumn("epoch", F.lit(0).cast("bigint")))
