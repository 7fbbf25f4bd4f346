"""Stateful per-chunk kernels run over sorted partitions.

Rows arrive sorted by group and position, batch by batch; the kernel keeps the state of
the group at hand only, so its memory does not depend on the size of a group.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tickloom.functions.constants import BID


def sorted_map(
    df: DataFrame, group: list[str], order: list[str], kernel: Callable, schema: str
) -> DataFrame:
    """Partition by ``group``, sort inside, stream through ``kernel`` (mapInPandas).

    The partition count is stated so that small-looking rows are not merged into a few
    tasks: the work per row is larger than its bytes suggest.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.repartition(parts, *group)
        .sortWithinPartitions(*group, *order)
        .mapInPandas(kernel, schema)
    )


BEST_SCHEMA = "day int, sid bigint, chunk bigint, rpt bigint, sub int, side int, best bigint"


def best_ticks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best tick of each side after every occupancy change.

    Heap with lazy removal: a level leaves the heap when it surfaces empty.
    """
    group = None
    occupied: tuple[set, set] = (set(), set())
    heaps: tuple[list, list] = ([], [])
    current: list = [None, None]
    for pdf in batches:
        out = []
        for row in zip(
            *(pdf[c].tolist() for c in ("day", "sid", "chunk", "rpt", "sub", "e_side", "e_tick", "step"))
        ):
            side, tick, step = row[5], row[6], row[7]
            if row[:3] != group:
                group = row[:3]
                occupied, heaps, current = (set(), set()), ([], []), [None, None]
            live, heap = occupied[side], heaps[side]
            key = -tick if side == BID else tick
            if step > 0:
                live.add(key)
                heapq.heappush(heap, key)
            else:
                live.discard(key)
            while heap and heap[0] not in live:
                heapq.heappop(heap)
            best = heap[0] if heap else None
            if best != current[side]:
                current[side] = best
                shown = None if best is None else (-best if side == BID else best)
                out.append((*row[:6], shown))
        frame = pd.DataFrame(out, columns=["day", "sid", "chunk", "rpt", "sub", "side", "best"])
        frame["best"] = frame["best"].astype("Int64")
        yield frame


EVENT_MAP_SCHEMA = (
    "day int, sid bigint, seq bigint, ev bigint, ev_ms bigint, ev_chunk bigint, ev_packets int"
)


def event_segmenter(cap_ms: int, cross_clock: bool) -> Callable:
    """Kernel that joins packets into events while printed volume is unexecuted."""

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = None
        members: list[tuple[int, int]] = []
        start = start_ms = balance = 0
        printed: set[int] = set()
        out: list[tuple] = []

        def close():
            if len(members) > 1:
                home = members[-1][1]
                out.extend(
                    (group[0], group[1], seq, start, start_ms, home, len(members))
                    for seq, _ in members
                )
            members.clear()

        for pdf in batches:
            for day, sid, zone, chunk, seq, t, cut, p_ticks, p_qtys, r_ticks, r_qtys in zip(
                *(pdf[c].tolist() for c in ("day", "sid", "zone", "chunk", "seq", "t_ms", "cut")),
                pdf["print_ticks"],
                pdf["print_qtys"],
                pdf["removal_ticks"],
                pdf["removal_qtys"],
            ):
                if (day, sid, zone) != group:
                    close()
                    group = (day, sid, zone)
                if members and (
                    cut or (t != start_ms and (not cross_clock or t - start_ms > cap_ms))
                ):
                    close()
                if not members:
                    start, start_ms, balance, printed = seq, t, 0, set()
                members.append((seq, chunk))
                if len(p_ticks):
                    balance += int(np.sum(p_qtys))
                    printed.update(p_ticks.tolist())
                if balance > 0:
                    # acceptance stops once the balance is used up, so the sum decides
                    balance -= sum(
                        q for k, q in zip(r_ticks.tolist(), r_qtys.tolist()) if k in printed
                    )
                if balance <= 0:
                    close()
            yield _event_frame(out)
            out.clear()
        close()
        yield _event_frame(out)

    return segment


def _event_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(
        rows, columns=["day", "sid", "seq", "ev", "ev_ms", "ev_chunk", "ev_packets"]
    )


class _Sums:
    """Prefix sums over sparse places from 0 to 2 ** ``bits`` (a binary indexed tree of the touched nodes).

    The tree grows with its places: the root of a doubled one begins as the sum of all.
    """

    __slots__ = ("tree", "limit")

    def __init__(self, bits: int):
        self.tree: dict[int, int] = {}
        self.limit = 1 << min(bits, 4)

    def add(self, place: int, value: int) -> None:
        i, tree = place + 1, self.tree
        while i > self.limit:
            tree[2 * self.limit] = tree.get(self.limit, 0)
            self.limit *= 2
        while i <= self.limit:
            tree[i] = tree.get(i, 0) + value
            i += i & -i

    def before(self, place: int) -> int:
        """Sum of the values at places below ``place``."""
        i, tree, total = min(place, self.limit), self.tree, 0
        while i > 0:
            total += tree.get(i, 0)
            i -= i & -i
        return total


def dominated(group: list[str], ids: list[str], bits: int, schema_columns: list[str]) -> Callable:
    """Kernel that answers each query with the sum of the group's points seen so far at lower places.

    Rows come in order of their second coordinate, queries before points of the same one; ``w`` is NULL in
    a query, whose ``ids`` are returned with ``below``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sums = None, _Sums(bits)
        for pdf in batches:
            out = []
            keys = list(zip(*(pdf[c].tolist() for c in group)))
            names = list(zip(*(pdf[c].tolist() for c in ids)))
            query, weight = pdf["query"].tolist(), pdf["w"].tolist()
            for key, name, place, is_query, w in zip(keys, names, pdf["x"].tolist(), query, weight):
                if key != current:
                    current, sums = key, _Sums(bits)
                if is_query:
                    out.append((*name, sums.before(place)))
                else:
                    sums.add(place, int(w))
            yield pd.DataFrame(out, columns=schema_columns)

    return run


LEVELS_SCHEMA = (
    "day int, sid bigint, chunk bigint, rpt bigint, sub int, side int, ticks array<bigint>, sizes array<bigint>"
)


def best_levels(count: int, reach: int) -> Callable:
    """Kernel that gives the best ``count`` levels of a side whenever one of them changes.

    A side is the sorted list of its occupied ticks and their sizes; levels more than ``reach`` ticks
    from the best or without size are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("day", "sid", "chunk", "rpt", "sub", "e_side", "e_tick", "level_n", "level_q")
        group = None
        ticks: tuple[list, list] = ([], [])
        sizes: tuple[dict, dict] = ({}, {})
        shown: list = [None, None]
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c].tolist() for c in names)):
                if row[:3] != group:
                    group, ticks, sizes, shown = row[:3], ([], []), ({}, {}), [None, None]
                side, tick, n, q = row[5:]
                key = -tick if side == BID else tick
                line, held = ticks[side], sizes[side]
                if n > 0:
                    if key not in held:
                        bisect.insort(line, key)
                    held[key] = q
                elif key in held:
                    del held[key]
                    line.pop(bisect.bisect_left(line, key))
                best: list[tuple[int, int]] = []
                for k in line:
                    if len(best) == count or k - line[0] >= reach:
                        break
                    if held[k] > 0:
                        best.append((-k if side == BID else k, held[k]))
                if best != shown[side]:
                    shown[side] = best
                    out.append((*row[:6], [t for t, _ in best], [s for _, s in best]))
            yield pd.DataFrame(out, columns=["day", "sid", "chunk", "rpt", "sub", "side", "ticks", "sizes"])

    return run
