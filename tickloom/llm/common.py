"""Helpers shared by the corpus operators: tables, stages, and byte buffers of Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ship_package, stage_root

#: Text bytes that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch; texts are long, and Spark's default of 10,000 fills the workers.
BATCH_ROWS = 1_000


def shipped(df: DataFrame) -> DataFrame:
    """``df``, whose workers can import this package and get batches of a moderate size from
    now on; a batch size that the session has set itself is left alone."""
    spark = df.sparkSession
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives the memory that it no longer uses back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


#: Shuffle files of a stage go as soon as it is written, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ship_package(spark)
    target = f"{stage_root(spark)}/llm-{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(target)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(target)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The one name that ``packed`` gives to all columns that an operator does not read.
REST = "rest"


def packed(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and text, and the other columns of ``names`` as one struct, so that none of them clashes with an operator's own."""
    others = [F.col(f"`{c}`") for c in names if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias(REST)] if others else []))


def unpacked(names: list[str]) -> list[Column]:
    """The columns ``names`` of what was ``packed``, in their order."""
    return [F.col(c) if c in ("doc_id", "text") else F.col(REST)[c].alias(c) for c in names]


def key_remainder(column: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(0))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def passes(texts: list[bytes], limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], gap: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, each between gaps, with the start and end of each text."""
    data = np.frombuffer(gap + gap.join(texts) + gap, dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + len(gap))
    return data, ends - sizes, ends


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [start, end); ascending spans that do not overlap."""
    edges = np.column_stack((starts, ends)).ravel()
    padded = np.append(values, np.zeros(1, values.dtype))
    sums = np.add.reduceat(padded, edges)[::2]
    return np.where(ends > starts, sums, 0)
