"""Session helpers: builder for local work and the shared folder for stage tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def local_session(cores: str | int = 8, shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local master may fall back to a fresh scratch folder; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-tickloom-", dir="/tmp")
    return _local_roots[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application.

    Kernels are pickled by reference, so a worker must be able to import the package
    whatever folder it was started from.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tickloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


class StageStore:
    """Written stage tables of one input: built on first use, read back afterwards.

    A stage is a Parquet table, so it cuts the lineage, survives lost executors and
    lets every later query read only the columns it names.
    """

    #: Rows of the input that one shuffle partition of a stage should get.
    ROWS = 50_000

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.rows = 0  # of the input, as far as known
        ship_package(spark)
        self.path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._ready: set[str] = set()

    def table(self, name: str, build) -> DataFrame:
        target = f"{self.path}/{name}"
        if name not in self._ready:
            with self._partitions():
                build().write.mode("overwrite").parquet(target)
            self._ready.add(name)
        return self.spark.read.parquet(target)

    @contextmanager
    def _partitions(self) -> Iterator[None]:
        """Shuffle partitions in proportion to the input, so that what a task sorts stays in its memory."""
        wanted = -(-self.rows // self.ROWS)
        # beyond 200 partitions a task holds what it writes for a shuffle, so it reads little as well
        sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
        names = dict.fromkeys(sizes, "16m") if self.rows else {}
        if wanted > int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            names["spark.sql.shuffle.partitions"] = str(wanted)
        before = {n: self.spark.conf.get(n, None) for n in names}
        for n, value in names.items():
            self.spark.conf.set(n, value)
        try:
            yield
        finally:
            for n in names:
                if before[n] is None:
                    self.spark.conf.unset(n)
                else:
                    self.spark.conf.set(n, before[n])
