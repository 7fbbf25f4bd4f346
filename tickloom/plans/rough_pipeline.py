"""Stage tables of the rough feed: books that restart at every break, and one carried through."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.constants import CHUNK
from tickloom.operators import best_quote, epochs, levels, lifecycle
from tickloom.plans import spread_time
from tickloom.session import StageStore
from tickloom.sources import order_flow, rough_flow


class RoughPipeline:
    """Stages of the rough feed in ``sf_dir``, each written once and read back."""

    def __init__(self, spark: SparkSession, sf_dir: str, per_chunk: int = order_flow.PACKETS_PER_CHUNK):
        self.spark, self.sf_dir, self.per_chunk = spark, sf_dir, per_chunk
        self.store = StageStore(spark, "rough")
        self.store.rows = order_flow.size(spark, sf_dir)

    @cached_property
    def numbered(self) -> DataFrame:
        return order_flow.numbered_events(self.spark, self.sf_dir, self.store)

    @cached_property
    def arrivals(self) -> DataFrame:
        return rough_flow.arrivals(self.numbered, self.per_chunk)

    @cached_property
    def messages(self) -> DataFrame:
        """Messages that arrived, with their epoch."""
        dealt = self.store.table(
            "dealt", lambda: rough_flow.dealt_messages(order_flow.orders(self.numbered), self.per_chunk)
        )
        starts = self.store.table("chunk_starts", lambda: rough_flow.chunk_starts(dealt))
        return rough_flow.rough_messages(dealt, starts)

    def effects(self, restart: bool = True) -> DataFrame:
        """Level effects with running depth; ``sid`` names instrument and epoch."""
        name = "restarted" if restart else "carried"
        rows = (epochs.keyed if restart else epochs.carried)(self.messages.select(*_MESSAGE, "epoch"))
        raw = self.store.table(
            f"{name}_effects", lambda: lifecycle.level_effects(lifecycle.with_order_state(rows))
        )
        return self.store.table(f"{name}_depth", lambda: lifecycle.with_level_depth(raw))

    def quotes(self, restart: bool = True) -> DataFrame:
        """Quote and best levels after every message; ``sid`` names instrument and epoch."""
        name = "restarted" if restart else "carried"
        rows = (epochs.keyed if restart else epochs.carried)(self.messages.select(*_MESSAGE, "epoch"))
        depth = self.effects(restart).filter("e_side IS NOT NULL")
        snapshots = self.store.table(f"{name}_snapshots", lambda: best_quote.chunk_snapshots(depth, rows))
        best = self.store.table(
            f"{name}_best",
            lambda: best_quote.best_changes(lifecycle.occupancy_changes(depth), snapshots),
        )
        top = self.store.table(f"{name}_levels", lambda: levels.level_changes(depth, snapshots))
        probe = rows.select(*CHUNK, "rpt", "seq", "t_ms", "typ")
        return self.store.table(
            f"{name}_quotes",
            lambda: levels.levels_at(best_quote.quote_at(probe, best, depth, snapshots), top),
        )

    @cached_property
    def standing(self) -> DataFrame:
        """Intervals between messages of one epoch, by instrument."""
        return self.store.table(
            "standing", lambda: epochs.unkeyed(spread_time.standing(self.quotes()))
        )


_MESSAGE = ["day", "sid", "chunk", "rpt", "seq", "t_ms", "typ", "side", "tick", "qty", "oid", "retail"]

_pipelines: dict[tuple, RoughPipeline] = {}


def rough_pipeline(spark: SparkSession, sf_dir: str) -> RoughPipeline:
    """The rough pipeline of an input in this session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _pipelines:
        _pipelines[key] = RoughPipeline(spark, sf_dir)
    return _pipelines[key]
