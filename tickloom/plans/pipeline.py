"""Stage pipeline of one input: messages -> log -> states -> quote moves."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.constants import CHUNK, KEY
from tickloom.operators import best_quote, levels, lifecycle, matching, moves, states
from tickloom.operators import tape as message_tape
from tickloom.operators.ordered import carry_scan, previous
from tickloom.session import StageStore
from tickloom.sources import order_flow
from tickloom.sources.calendar import excluding, session_calendar


def raw_log(messages: DataFrame) -> DataFrame:
    effects = lifecycle.level_effects(lifecycle.with_order_state(messages))
    trades = messages.filter("typ = 'T'").withColumn("sub", F.lit(0))
    return effects.unionByName(trades, allowMissingColumns=True).fillna(
        {"sub": 0, "candidate": False}
    )


class BookPipeline:
    """Stage tables of the order flow in ``sf_dir``, each written once and read back."""

    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str,
        per_chunk: int = order_flow.PACKETS_PER_CHUNK,
        delayed: bool = False,
    ):
        self.spark = spark
        self.sf_dir = sf_dir
        self.per_chunk = per_chunk
        self.delayed = delayed
        self.store = StageStore(spark, "delayed" if delayed else "book")
        self.store.rows = order_flow.size(spark, sf_dir)  # known before the first stage, whichever is asked for

    @cached_property
    def numbered(self) -> DataFrame:
        return order_flow.numbered_events(self.spark, self.sf_dir, self.store)

    @cached_property
    def orders(self) -> DataFrame:
        return order_flow.orders(self.numbered)

    @cached_property
    def messages(self) -> DataFrame:
        return self.store.table(
            "messages",
            lambda: order_flow.order_messages(
                self.orders, self.per_chunk, self.delayed
            ),
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.store.table(
            "calendar", lambda: session_calendar(order_flow.status_messages(self.numbered))
        )

    @cached_property
    def raw_log(self) -> DataFrame:
        return self.store.table("raw_log", lambda: raw_log(self.messages))

    @cached_property
    def event_map(self) -> DataFrame:
        """Packets that share a matching event with another packet."""
        packets = self.store.table("packets", lambda: matching.packet_cuts(self.raw_log))
        return self.store.table(
            "event_map", lambda: matching.multi_packet_events(packets)
        )

    @cached_property
    def log(self) -> DataFrame:
        """Trades and level effects with event keys, execution marks and level depth."""

        def build() -> DataFrame:
            rows = lifecycle.with_openings(matching.with_event(self.raw_log, self.event_map))
            # executions and depth are windows inside a chunk: one shuffle serves both
            return lifecycle.depth_from_openings(matching.with_executions(rows.repartition(*CHUNK)))

        return self.store.table("log", build)

    def _best(self, name: str, depth: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Levels standing at chunk starts and best-tick changes of a depth log."""
        rows = depth.filter("e_side IS NOT NULL")
        snapshots = self.store.table(
            f"{name}_snapshots", lambda: best_quote.chunk_snapshots(rows, log)
        )
        best = self.store.table(
            f"{name}_best",
            lambda: best_quote.best_changes(lifecycle.occupancy_changes(rows), snapshots),
        )
        return snapshots, best

    @cached_property
    def quotes(self) -> DataFrame:
        """Matching events with best quote."""
        snapshots, best = self._best("book", self.log, self.log)
        return self.store.table(
            "quotes",
            lambda: best_quote.quote_at(
                matching.close_events(self.log),
                best,
                self.log.filter("e_side IS NOT NULL"),
                snapshots,
            ),
        )

    @cached_property
    def events(self) -> DataFrame:
        """Matching events with best quote, phase and segment."""
        return self.store.table(
            "events", lambda: states.with_segments(states.with_phase(self.quotes, self.calendar))
        )

    @cached_property
    def states(self) -> DataFrame:
        """Matching events with the previous counted state and the latest trades."""
        return self.store.table("states", lambda: states.with_history(self.events))

    @cached_property
    def moves(self) -> DataFrame:
        """Classified quote moves."""
        changes = self.store.table("changes", lambda: moves.price_changes(self.states))
        flagged = self.store.table(
            "flagged",
            lambda: moves.with_trade_windows(moves.quote_moves(moves.with_lookback(changes))),
        )
        emptyings = self.store.table("emptyings", lambda: moves.level_emptyings(self.log))
        return self.store.table("moves", lambda: moves.with_cause(flagged, emptyings))

    @cached_property
    def replay_log(self) -> DataFrame:
        """Level effects of the message-level replay (unknown orders are applied)."""
        effects = self.store.table(
            "replay_changes", lambda: message_tape.replay_changes(self.messages)
        )
        counts = self.store.table("replay_counts", lambda: message_tape.replay_counts(effects))
        return self.store.table("replay_log", lambda: message_tape.replay_depth(counts))

    @cached_property
    def tape(self) -> DataFrame:
        """Every message with the quote before and after it, classified."""
        snapshots, best = self._best("replay", self.replay_log, self.messages)
        quotes = self.store.table(
            "tape_quotes",
            lambda: message_tape.message_quotes(self.messages, self.replay_log, best, snapshots),
        )
        return self.store.table(
            "tape", lambda: message_tape.classified(message_tape.with_before(quotes))
        )

    @cached_property
    def priced_tape(self) -> DataFrame:
        """The tape with plain, micro and three-level price (in ticks) before and after each message."""

        def build() -> DataFrame:
            snapshots, _ = self._best("replay", self.replay_log, self.messages)
            top = levels.level_changes(self.replay_log, snapshots)
            prices = {"mid": levels.plain_mid(), "micro": levels.micro_price(), "mid3": levels.level_mid()}
            after = levels.levels_at(self.tape, self.store.table("replay_levels", lambda: top))
            after = after.withColumns(prices).drop("bids", "asks")
            before = carry_scan(after, KEY, ["rpt"], [previous("_before", *prices)])
            return before.withColumns({f"{n}0": F.col(f"_before.{n}") for n in prices}).drop("_before")

        return self.store.table("priced_tape", build)

    @cached_property
    def queue(self) -> DataFrame:
        """Queue position of every order removed at the touch."""
        changes = self.store.table(
            "queue_changes", lambda: message_tape.queue_changes(self.replay_log, self.tape)
        )
        return self.store.table("queue", lambda: message_tape.queue_positions(changes, self.tape))


class ExcludingPipeline(BookPipeline):
    """States, moves and panels of another pipeline's book under a calendar with further exclusions."""

    def __init__(self, base: BookPipeline, windows: list[str], hold_out: list[int] | None = None):
        super().__init__(base.spark, base.sf_dir, base.per_chunk, base.delayed)
        self.base, self.windows, self.hold_out = base, windows, hold_out

    @cached_property
    def calendar(self) -> DataFrame:
        return self.store.table("calendar", lambda: excluding(self.base.calendar, self.windows, self.hold_out))

    @cached_property
    def log(self) -> DataFrame:
        return self.base.log

    @cached_property
    def quotes(self) -> DataFrame:
        """Events of the days that are left."""
        return self.base.quotes.join(self.calendar.select(*KEY), KEY, "left_semi")


_pipelines: dict[tuple, BookPipeline] = {}


def pipeline(spark: SparkSession, sf_dir: str, delayed: bool = False) -> BookPipeline:
    """The pipeline of an input in this session; stages are shared between queries."""
    key = (spark.sparkContext.applicationId, sf_dir, delayed)
    if key not in _pipelines:
        _pipelines[key] = BookPipeline(spark, sf_dir, delayed=delayed)
    return _pipelines[key]
