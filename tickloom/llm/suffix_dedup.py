"""Removal of byte strings that occur twice, by deep-shallow sorting of sampled suffixes.

Every byte covered by a string of ``WINDOW`` bytes that starts somewhere else as well is
removed. Suffixes are sampled by content: a window's anchor is the least hash of its
``GRAM``-byte strings, so equal windows have their anchors at the same offset. The windows of
an anchor are cut by that offset into two bands; all windows of a band share a core around
the anchor, and a core that occurs once needs no further look.

Anchors with an equal core and band form a group. Their contexts to the right of the core
(and, reversed, to the left) are suffixes that are sorted deep-shallow: multikey quicksort up
to ``SHALLOW`` bytes, then a blind trie for suffixes that are still equal. From the order and
the common prefixes follow, for each anchor, all pairs of left and right extensions that
another anchor shares: nodes of the left order are merged from the deepest, smaller into
larger, and only neighbours in the right order are compared. Extensions that fill a window
mark its bytes.

Equal contexts are counted before they are sorted, so copies in any number are one entry. A
group with more than ``GROUP`` different contexts is not sorted in one task: its windows are
named by hash one by one and counted, which gives the same result.

Texts are known by 128-bit digests, cores and contexts by 128-bit hashes.

Defined cases: null and empty texts have no bytes; a text shorter than a window keeps all;
repeated rows are different documents, so their windows occur twice; doc_id may be null or
repeated; extra columns are ignored; very long texts are worked on whole.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import passes, read, shipped, staged, text_bytes, tidy
from tickloom.llm.words import powers

WINDOW = 400
GRAM = 64
#: Offsets of an anchor within its windows, cut into two bands (both ends included).
BANDS = ((0, 168), (169, WINDOW - GRAM))
SHALLOW = 16
#: Different contexts that are sorted together at most.
GROUP = 2000
#: Bytes of the table of spans that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_BYTES = 32_000_000

_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))


# --- sampling ---------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, in two passes over blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    head = np.minimum.accumulate(square, axis=1).ravel()
    tail = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(tail[:count], head[width - 1 : width - 1 + count])


def pieces(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Anchors by band over all texts: owner, place in the text, first and last offset, core key."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    long_enough = np.flatnonzero(size >= WINDOW)
    none = np.zeros(0, dtype=np.int64)
    if not len(long_enough):
        return {k: none for k in ("owner", "at", "band", "low", "high", "key")}
    data = np.frombuffer(b"".join(texts[i] for i in long_enough), dtype=np.uint8)
    end = np.cumsum(size[long_enough])
    start = end - size[long_enough]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    gram = _mixed((total[GRAM:] - total[:-GRAM]) * down[: len(data) + 1 - GRAM])
    # equal hashes in a window: the leftmost is the anchor
    ordered = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (sliding_least(ordered, WINDOW - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie within one text
    inside = np.ones(len(anchor), dtype=bool)
    for e in end[:-1].tolist():
        inside[max(0, e - WINDOW + 1) : e] = False
    first = np.flatnonzero(inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]]))
    last = np.flatnonzero(inside & np.concatenate([(anchor[1:] != anchor[:-1]) | ~inside[1:], [True]]))
    place = anchor[first]
    owner = np.searchsorted(end, place, side="right")
    found = {k: [] for k in ("owner", "at", "band", "low", "high", "key")}
    for band, (least, most) in enumerate(BANDS):
        low = np.maximum(place - last, least)
        high = np.minimum(place - first, most)
        rows = np.flatnonzero(low <= high)
        begin, stop = place[rows] - least, place[rows] - most + WINDOW
        key = _mixed(((total[stop] - total[begin]) * down[begin]) ^ np.uint64(band + 1))
        found["owner"].append(long_enough[owner[rows]])
        found["at"].append(place[rows] - start[owner[rows]])
        found["band"].append(np.full(len(rows), band))
        found["low"].append(low[rows])
        found["high"].append(high[rows])
        found["key"].append(key.view(np.int64))
    return {k: np.concatenate(v) for k, v in found.items()}


# --- deep-shallow sorting ---------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "children", "some")

    def __init__(self, depth: int, some: int):
        self.depth = depth  # bytes that all suffixes below share
        self.children: dict[int, _Node | list[int]] = {}
        self.some = some  # one suffix below


def _byte(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie_order(s: list[bytes], members: list[int], depth: int) -> list[int]:
    """``members`` in the order of their suffixes, which share ``depth`` bytes.

    A suffix goes down by the bytes at the branching depths alone, is compared once with the
    suffix it arrives at, and is inserted where the two part.
    """
    root = _Node(depth, members[0])
    root.children[_byte(s[members[0]], depth)] = [members[0]]
    for x in members[1:]:
        text = s[x]
        node: _Node | list[int] = root
        path: list[_Node] = []
        while isinstance(node, _Node):
            path.append(node)
            below = node.children.get(_byte(text, node.depth))
            if below is None:
                break
            node = below
        leaf = node[0] if isinstance(node, list) else path[-1].some
        shared = common(text, s[leaf])
        if isinstance(node, list) and shared == len(text) == len(s[leaf]):
            node.append(x)
            continue
        while path and path[-1].depth > shared:
            path.pop()
        parent = path[-1]
        if parent.depth == shared:
            parent.children[_byte(text, shared)] = [x]
            continue
        edge = _byte(text, parent.depth)
        fork = _Node(shared, leaf)
        fork.children[_byte(s[leaf], shared)] = parent.children[edge]
        fork.children[_byte(text, shared)] = [x]
        parent.children[edge] = fork
    out: list[int] = []
    stack: list[_Node | list[int]] = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            out += node
        else:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
    return out


def deep_shallow_order(s: list[bytes]) -> list[int]:
    """Order of the suffixes ``s``: multikey quicksort to a shallow depth, then blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(s))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) == 1:
            out += members
        elif depth >= SHALLOW:
            out += blind_trie_order(s, members, depth)
        else:
            pivot = _byte(s[members[len(members) // 2]], depth)
            less, equal, more = [], [], []
            for x in members:
                b = _byte(s[x], depth)
                (less if b < pivot else equal if b == pivot else more).append(x)
            if more:
                stack.append((more, depth))
            if pivot < 0:
                stack.append((equal, SHALLOW))  # all have ended: equal suffixes
            else:
                stack.append((equal, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def shared_extensions(left: list[bytes], right: list[bytes], need: int) -> list[list[tuple[int, int]]]:
    """For each entry the pairs (left, right) of extensions that another entry shares, as far as
    they add up to ``need``; ``left`` is reversed."""
    m = len(left)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        pair = (common(left[0], left[1]), common(right[0], right[1]))
        if sum(pair) >= need:
            found[0].append(pair)
            found[1].append(pair)
        return found
    by_left, by_right = deep_shallow_order(left), deep_shallow_order(right)
    rank = [0] * m
    for r, x in enumerate(by_right):
        rank[x] = r
    depth = [common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])]
    owner = list(range(m))
    sets: list[list[int]] = [[rank[x]] for x in by_left]

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for k in sorted(range(m - 1), key=lambda k: -depth[k]):
        a, b = find(k), find(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        deep = depth[k]
        places = []
        for r in sets[b]:
            i = bisect.bisect(large, r)
            for j in (i - 1, i):
                if 0 <= j < len(large):
                    x, y = by_right[r], by_right[large[j]]
                    reach = common(right[x], right[y])
                    if deep + reach >= need:
                        found[x].append((deep, reach))
                        found[y].append((deep, reach))
            places.append(r)
        sets[a] = sorted(large + places)
        sets[b] = []
        owner[b] = a
    return found


# --- Spark ------------------------------------------------------------------------------


def _digests() -> list:
    """128-bit digest of a text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def _core_keys(docs: DataFrame) -> DataFrame:
    """(key, t1, n) of the different cores of every text and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            t1 = batch.column("t1").to_numpy()
            for lo, hi in passes(texts):
                found = pieces(texts[lo:hi])
                owner, key = found["owner"], found["key"]
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])[: len(key)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[new]),
                        pa.array(t1[lo:hi][owner[new]]),
                        pa.array(np.diff(np.append(new, len(key)))),
                    ],
                    names=["key", "t1", "n"],
                )

    return docs.select("text", "t1").transform(shipped).mapInArrow(tidy(run), "key bigint, t1 bigint, n bigint")


def _signed(x: int) -> tuple[int, int]:
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


_CONTEXT = (
    "k1 bigint, k2 bigint, band int, c1 bigint, c2 bigint, left binary, right binary, "
    "t1 bigint, t2 bigint, at int"
)


def _contexts(docs: DataFrame) -> DataFrame:
    """Contexts of the cores named in ``keys``, an array column of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            t1, t2 = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            wanted = batch.column("keys")
            for lo, hi in passes(texts):
                found = pieces(texts[lo:hi])
                rows: list[tuple] = []
                order = np.argsort(found["owner"], kind="stable")
                edge = np.searchsorted(found["owner"][order], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = order[edge[i] : edge[i + 1]]
                    keys = wanted[lo + i].values.to_numpy(zero_copy_only=False)
                    own = own[np.isin(found["key"][own], keys)]
                    text = texts[lo + i]
                    for r in own.tolist():
                        at, band = int(found["at"][r]), int(found["band"][r])
                        low, high = int(found["low"][r]), int(found["high"][r])
                        least, most = BANDS[band]
                        begin, stop = at - least, at - most + WINDOW
                        core = xxhash.xxh3_128_intdigest(text[begin:stop], band)
                        left = text[at - high : begin][::-1]
                        right = text[stop : at - low + WINDOW]
                        name = xxhash.xxh3_128_intdigest(
                            b"%d,%d,%d,%d," % (core, band, len(left), len(right)) + left + right
                        )
                        rows.append((*_signed(core), band, *_signed(name), left, right, t1[lo + i], t2[lo + i], at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 10, _KINDS)], names=_NAMES
                )

    return docs.select("text", "t1", "t2", "keys").transform(shipped).mapInArrow(tidy(run), _CONTEXT)


_NAMES = [c.split(" ")[0] for c in _CONTEXT.split(", ")]
_KINDS = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split(" ")[1]] for c in _CONTEXT.split(", ")]


def _marked(contexts: DataFrame) -> DataFrame:
    """For each context (c1, c2) the bytes to remove around the anchor; of a group that is too
    large the contexts themselves (``begin`` is null)."""

    def solve(rows: list[dict]) -> Iterator[tuple]:
        least, most = BANDS[rows[0]["band"]]
        need = most - least

        def span(row: dict, left: int, right: int) -> tuple:
            return row["c1"], row["c2"], -least - left, WINDOW - most + right, None, None, None, None

        for row in rows:
            if row["n"] > 1 and len(row["left"]) + len(row["right"]) >= need:
                yield span(row, len(row["left"]), len(row["right"]))
        if len(rows) > 1:
            pairs = shared_extensions([r["left"] for r in rows], [r["right"] for r in rows], need)
            for row, found in zip(rows, pairs):
                for left, right in set(found):
                    yield span(row, left, right)

    def aside(row: dict) -> tuple:
        return row["c1"], row["c2"], None, None, row["band"], row["left"], row["right"], row["n"]

    names = ["c1", "c2", "begin", "stop", "band", "left", "right", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, out, crowded = None, [], [], False
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["k1"], row["k2"], row["band"])
                if key != group:
                    if crowded:
                        out += map(aside, rows)
                    elif rows:
                        out += solve(rows)
                    group, rows, crowded = key, [], False
                rows.append(row)
                if len(rows) > GROUP:
                    crowded = True
                    out += map(aside, rows)
                    rows = []
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
        if crowded:
            out += map(aside, rows)
        elif rows:
            out += solve(rows)
        yield batch_of(out)

    counted = contexts.groupBy("k1", "k2", "band", "c1", "c2", "left", "right").agg(F.count("*").alias("n"))
    return (
        counted.repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "band")
        .transform(shipped).mapInArrow(
            tidy(run),
            "c1 bigint, c2 bigint, begin int, stop int, band int, left binary, right binary, n bigint",
        )
    )


def _single_windows(crowded: DataFrame, cores: DataFrame) -> DataFrame:
    """Spans of the contexts of crowded groups: each window by itself, named and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                least, most = BANDS[row["band"]]
                left, right = row["left"], row["right"]
                offsets = [
                    d for d in range(least, most + 1) if d - least <= len(left) and most - d <= len(right)
                ]
                core = b"%d,%d,%d," % (row["k1"], row["k2"], row["band"])
                found = [
                    _signed(xxhash.xxh3_128_intdigest(core + b"%d," % d + left[: d - least] + right[: most - d]))
                    for d in offsets
                ]
                n = len(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["c1"]] * n, pa.int64()),
                        pa.array([row["c2"]] * n, pa.int64()),
                        pa.array([-d for d in offsets], pa.int32()),
                        pa.array([WINDOW - d for d in offsets], pa.int32()),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.int64()),
                        pa.array([row["n"]] * n, pa.int64()),
                    ],
                    names=["c1", "c2", "begin", "stop", "w1", "w2", "n"],
                )

    windows = crowded.join(cores, ["c1", "c2"]).transform(shipped).mapInArrow(
        tidy(run), "c1 bigint, c2 bigint, begin int, stop int, w1 bigint, w2 bigint, n bigint"
    )
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("total")).filter("total > 1")
    return windows.join(twice, ["w1", "w2"]).select("c1", "c2", "begin", "stop")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t1, t2, spans): by digest of a text, the byte ranges that are covered."""
    known = docs.select("text", *_digests()).filter(F.octet_length("text") >= WINDOW)
    keyed = _core_keys(known)
    twice = keyed.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    by_text = keyed.select("key", "t1").join(twice, "key").groupBy("t1").agg(F.collect_set("key").alias("keys"))
    contexts = staged(_contexts(known.join(by_text, "t1")), "contexts")
    marked = staged(_marked(contexts), "marked")
    spans = marked.filter("begin IS NOT NULL").select("c1", "c2", "begin", "stop")
    crowded = marked.filter("begin IS NULL").select("c1", "c2", "band", "left", "right", "n")
    if not crowded.isEmpty():
        cores = contexts.select("c1", "c2", "k1", "k2").distinct()
        spans = spans.unionByName(_single_windows(crowded, cores))
    each = contexts.select("c1", "c2", "t1", "t2", "at").distinct().join(spans, ["c1", "c2"])
    covered = each.groupBy("t1", "t2").agg(
        F.collect_set(
            F.struct((F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("stop")).alias("stop"))
        ).alias("spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"begin": a, "stop": b} for a, b in merged(s)] for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), pa.array(spans, _SPANS)], names=["t1", "t2", "spans"]
            )

    return covered.transform(shipped).mapInArrow(
        tidy(run), "t1 bigint, t2 bigint, spans array<struct<begin:bigint,stop:bigint>>"
    )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["begin"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (merged byte ranges to remove) and kept (bytes left) of every row."""
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<begin:bigint,stop:bigint>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            spans = [[(s["begin"], s["stop"]) for s in own or ()] for own in batch.column("spans").to_pylist()]
            kept = []
            for text, own in zip(texts, spans):
                edges = [0, *(x for s in own for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[{"begin": a, "stop": b} for a, b in own] for own in spans], _SPANS),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    spans = staged(repeated_spans(docs), "spans")
    if (spans.agg(F.sum(64 + 16 * F.size("spans"))).first()[0] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    both = docs.select("doc_id", "text", *_digests()).join(spans, ["t1", "t2"], "left")
    return both.select("doc_id", "text", "spans").transform(shipped).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes that occur elsewhere, as a digest."""
    found = removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = "aggregate(spans, 0L, (n, s) -> n + s.stop - s.begin)"
    return found.select(
        "doc_id",
        "n_bytes",
        F.expr(lengths).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
