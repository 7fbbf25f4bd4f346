"""Line deduplication with a segment-partition edit join.

A line that repeats an earlier line, exactly or within ``EDITS`` byte edits, is dropped;
earlier means smaller (doc_id, line number). Every line that is not empty takes part. Where the
shorter of two lines has less than ``LEAST`` bytes, one edit is allowed for each ``PART`` of them:
one from 10 bytes on, none below, where lines are dropped as exact repeats.

A line is cut into EDITS + 1 segments of even length. If two lines are within EDITS edits,
one segment of the shorter occurs in the longer unchanged and nearly in place; so every line
is indexed by its own segments and probes the substrings that can match a segment of each
length it can meet. Rows that share a key are candidates. Candidates are verified by a banded
edit distance whose band is a few bits of a word, advanced for all pairs of a batch at once.

A key with many rows is not paired up: its lines go on with what is left of them when the
common segment is cut out, as that must be within EDITS edits too, and are keyed anew under
their key. Each round shares more of the line, so what remains together in the end is alike.

Rows carry counts of bytes by sixteen kinds, modulo sixteen. An edit changes two of them by
one at most, so pairs whose counts are further apart are no candidates.

Lines travel as 64-bit names in the search and as 128-bit names in decisions; only lines of
candidates are fetched. Copies of a line within a task are keyed once.

A document is known by its doc_id and a hash of its text, so that rows without a doc_id, or
with the same one, are not gathered: no array is longer than the lines of one text.

Defined cases: null and empty texts have no lines to drop and stay as they are; a null
doc_id comes after all others; rows that share a doc_id (or have none) and the text are judged
as one document, so exact repeated rows keep the same lines; with other texts they are
documents of their own, by line number and then by hash; of equal lines the first stays; very
long lines are compared whole. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import packed, passes, read, shipped, staged, text_bytes, tidy, unpacked
from tickloom.llm.words import hash_spans

EDITS = 2
#: Bytes from which on EDITS edits are allowed, and bytes for each edit below.
LEAST, PART = 20, 10
#: Pairs of lines that are looked at within one key; beyond it the lines go on to finer keys.
PAIRS = 200_000
#: Rounds of keys; what is left of a line shrinks by a third or so in each.
ROUNDS = 4
#: Bytes of a table of places that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_BYTES = 32_000_000

#: Probes as (length difference, segment, shift): 0-based segments; the unshifted segment of the
#: line's own length is its index row, which probes as well.
PROBES = [
    (d, i, a)
    for d in range(EDITS + 1)
    for i in range(EDITS + 1)
    for a in range(max(-i, d - (EDITS - i)), min(i, d + (EDITS - i)) + 1)
    if d or a
]
INDEX = [(0, i, 0) for i in range(EDITS + 1)]
TAGS = INDEX + PROBES


def segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of segment ``i`` of lines of a length; the last ones are longer by one."""
    base, more = length // (EDITS + 1), length % (EDITS + 1)
    before = np.maximum(0, i - (EDITS + 1 - more))
    return i * base + before, base + (i >= EDITS + 1 - more)


def keys(lines: list[bytes], parents: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each tag the lines that have it and their keys under ``parents``."""
    data = np.frombuffer(b"".join(lines) or b"\0", dtype=np.uint8)
    size = np.array([len(x) for x in lines], dtype=np.int64)
    start = np.cumsum(size) - size
    for tag, (d, i, a) in enumerate(TAGS):
        length = size - d
        begin, width = segment(length, i)
        at = begin + a
        rows = np.flatnonzero((length > EDITS) & (at >= 0) & (at + width <= size))
        if not len(rows):
            continue
        h = hash_spans(data, start[rows] + at[rows], start[rows] + at[rows] + width[rows])
        mixed = h ^ (length[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 7919))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        yield tag, rows, (mixed ^ parents[rows].astype(np.uint64)).view(np.int64)


#: Sixteen kinds of bytes, letters spread evenly.
_KIND = (np.arange(256) * 7 + (np.arange(256) >> 4)) % 16


def counts(lines: list[bytes]) -> np.ndarray:
    """Bytes of each kind in each line, modulo 16, in four bits each."""
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    table = np.bincount(owner * 16 + _KIND[data], minlength=16 * len(lines)).reshape(-1, 16) % 16
    shift = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(table.astype(np.uint64) << shift, axis=1).view(np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least difference of the counts of each pair."""
    shift = np.arange(0, 64, 4, dtype=np.uint64)
    d = ((a.view(np.uint64)[:, None] >> shift) - (b.view(np.uint64)[:, None] >> shift)) & np.uint64(15)
    return np.minimum(d, np.uint64(16) - d).sum(axis=1)


def rest(line: bytes, path: int) -> bytes:
    """``line`` without the segments or substrings of a path of tags, four bits each."""
    if path > 15:
        line = rest(line, path >> 4)
    d, i, a = TAGS[(path & 15) - 1]
    begin, width = segment(np.array([len(line) - d]), i)
    at = int(begin[0]) + a
    return line[:at] + line[at + int(width[0]) :]


def name(line: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(line)
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def allowed(length: np.ndarray) -> np.ndarray:
    """Edits allowed between lines of which the shorter has a length."""
    return np.where(length >= LEAST, EDITS, np.minimum(length // PART, EDITS))


def within(a: list[bytes], b: list[bytes], edits: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair is within EDITS edits, or within its own number of them.

    Bit-parallel over the band: of the diagonals from -EDITS to EDITS a word holds the cells
    reachable with k errors, for each k; every byte advances all pairs that are still alive.
    """
    n = len(a)
    la = np.array([len(x) for x in a], dtype=np.int64)
    lb = np.array([len(x) for x in b], dtype=np.int64)
    ok = np.zeros(n, dtype=bool)
    pad = b"\0" * (EDITS + 1)
    da = np.frombuffer(b"".join(a) + pad, dtype=np.uint8)
    db = np.frombuffer(pad + pad.join(b) + pad, dtype=np.uint8)
    sa = np.cumsum(la) - la
    sb = np.cumsum(lb + EDITS + 1) - lb
    width = 2 * EDITS + 1
    full = (1 << width) - 1
    edits = np.full(n, EDITS) if edits is None else edits
    alive = np.flatnonzero(np.abs(lb - la) <= EDITS)
    # bit j of state[k]: cell (i, i + j - EDITS) is reachable with at most k errors
    state = [np.full(len(alive), sum(1 << (EDITS + e) for e in range(k + 1)), dtype=np.int64) for k in range(EDITS + 1)]
    i = 0
    while len(alive):
        done = la[alive] == i
        if done.any():
            goal = lb[alive[done]] - i + EDITS
            reached = np.choose(edits[alive[done]], [s[done] for s in state])
            ok[alive[done]] = (reached >> goal) & 1 == 1
            alive = alive[~done]
            state = [s[~done] for s in state]
            if not len(alive):
                break
        c = da[sa[alive] + i]
        same = np.zeros(len(alive), dtype=np.int64)
        for j in range(width):
            at = i + j - EDITS
            inside = (at >= 0) & (at < lb[alive])
            same |= ((db[sb[alive] + np.where(inside, at, 0)] == c) & inside).astype(np.int64) << j
        step = []
        for k in range(EDITS + 1):
            s = state[k] & same  # equal bytes: stay on the diagonal
            if k:
                # substitution, deletion from a, insertion of a byte of b
                s = s | state[k - 1] | (state[k - 1] >> 1) | (step[k - 1] << 1)
            step.append(s & full)
        state = step
        i += 1
        live = state[EDITS] != 0
        if not live.all():
            alive = alive[live]
            state = [s[live] for s in state]
    return ok


#: A null doc_id comes after all others.
def _id():
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id")


#: Tells texts of one doc_id apart. Should two agree in it, drops still go by the lines' own names.
def _digest():
    return F.xxhash64("text").alias("digest")


def _lines(text: bytes) -> list[tuple[int, bytes]]:
    return [(k, x) for k, x in enumerate(text.split(b"\n")) if x]


def lines(docs: DataFrame) -> DataFrame:
    """l1, l2 (name), doc_id, digest of the text and line number of every line that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, names = [], [], []
            for i, text in enumerate(text_bytes(batch.column("text"))):
                for k, x in _lines(text):
                    owner.append(i)
                    number.append(k)
                    names.append(name(x))
            both = np.array(names, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                    batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    batch.column("digest").take(pa.array(owner, pa.int64())),
                    pa.array(number, pa.int32()),
                ],
                names=["l1", "l2", "doc_id", "digest", "line"],
            )

    return docs.select(_id(), _digest(), "text").transform(shipped).mapInArrow(
        tidy(run), "l1 bigint, l2 bigint, doc_id bigint, digest bigint, line int"
    )


_ROW = "key bigint, l1 bigint, tag int, count bigint"


def _key_rows(
    lines: list[bytes], parts: list[bytes], ids: np.ndarray, parents: np.ndarray, path: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Rows of ``parts``, what a path of tags left of ``lines``; bytes are counted in the lines."""
    count = counts(lines) if lines else None
    for tag, rows, key in keys(parts, parents):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key),
                pa.array(ids[rows]),
                pa.array((path[rows] << 4 | (tag + 1)).astype(np.int32)),
                pa.array(count[rows]),
            ],
            names=["key", "l1", "tag", "count"],
        )


def _first_keys(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in passes(texts):
                fresh: dict[int, bytes] = {}
                for text in texts[lo:hi]:
                    for _, x in _lines(text):
                        if len(x) < PART:  # exact repeats only
                            continue
                        l1 = name(x)[0]
                        if l1 not in seen:
                            seen.add(l1)
                            fresh[l1] = x
                if len(seen) > 500_000:
                    seen.clear()
                ids = np.fromiter(fresh, dtype=np.int64, count=len(fresh))
                own = list(fresh.values())
                yield from _key_rows(own, own, ids, np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32))

    return docs.select("text").transform(shipped).mapInArrow(tidy(run), _ROW)


def _runs(keyed: DataFrame, last: bool) -> DataFrame:
    """Candidate pairs of each key; of a key with too many, its rows (``b`` is null)."""

    def emit(key: int, rows: list[tuple[int, int, int]], out: list[tuple]) -> None:
        count = {l1: c for l1, _, c in rows}
        owners = sorted({l1 for l1, tag, _ in rows if (tag & 15) - 1 <= EDITS})
        if len(owners) * len(count) > PAIRS and not last:
            out.extend((key, l1, None, tag) for l1, tag in dict.fromkeys(r[:2] for r in rows))
            return
        everyone = np.array(owners + sorted(count.keys() - set(owners)), dtype=np.int64)
        bytes_of = np.array([count[x] for x in everyone.tolist()], dtype=np.int64)
        for i in range(len(owners)):  # with all that come after it
            rest_of = slice(i + 1, None)
            near = everyone[rest_of][apart(bytes_of[i : i + 1], bytes_of[rest_of]) <= 2 * EDITS]
            x = owners[i]
            out.extend((key, min(x, y), max(x, y), None) for y in near.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_rows, many = None, [], False
        out: list[tuple] = []

        def close() -> None:
            if many:
                out.extend((open_key, l1, None, tag) for l1, tag, _ in open_rows)
            elif len(open_rows) > 1:
                emit(open_key, open_rows, out)

        for batch in batches:
            key = batch.column("key").to_numpy()
            if not len(key):
                continue
            l1, tag, count = (batch.column(c).to_numpy() for c in ("l1", "tag", "count"))
            edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            length = np.diff(edge)
            # a run within the batch that has one row alone gives nothing
            use = np.flatnonzero((length > 1) | (edge[:-1] == 0) | (edge[1:] == len(key)))
            for r in use.tolist():
                a, b = int(edge[r]), int(edge[r + 1])
                if open_key != key[a]:
                    close()
                    open_key, open_rows, many = int(key[a]), [], False
                open_rows.extend(zip(l1[a:b].tolist(), tag[a:b].tolist(), count[a:b].tolist()))
                # a run that goes on and on is passed on in pieces
                if len(open_rows) > 20_000 and not last:
                    many = True
                    close()
                    open_rows = []
            if len(out) > 50_000:
                yield batch_of(out)
                out = []
        close()
        yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "a", "b", "tag"]
        )

    return (
        keyed.repartition("key")
        .sortWithinPartitions("key", "l1")
        .transform(shipped).mapInArrow(tidy(run), "key bigint, a bigint, b bigint, tag int")
    )


def _small(places: DataFrame) -> DataFrame:
    """``places`` (a written table) with a broadcast hint where it is small enough."""
    size = places.agg(F.sum(56 + 24 * F.size("at"))).first()[0] or 0
    return F.broadcast(places) if size <= BROADCAST_BYTES else places


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """l1, l2 and bytes of the lines named in ``wanted``, read where they occur first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, int], bytes] = {}
            for text, at in zip(text_bytes(batch.column("text")), batch.column("at").to_pylist()):
                parts = text.split(b"\n")
                for p in at:
                    x = parts[p["line"]] if p["line"] < len(parts) else b""
                    if name(x) == (p["l1"], p["l2"]):
                        found[p["l1"], p["l2"]] = x
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.int64()),
                    pa.array([k[1] for k in found], pa.int64()),
                    pa.array(list(found.values()), pa.binary()),
                ],
                names=["l1", "l2", "bytes"],
            )

    where = (
        classes.join(wanted, "l1").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("l1", "l2", "line")).alias("at"))
    )
    where = staged(where, "places")
    rows = docs.select(_id(), _digest(), "text").join(_small(where), ["doc_id", "digest"]).select("text", "at")
    found = rows.transform(shipped).mapInArrow(tidy(run), "l1 bigint, l2 bigint, bytes binary")
    return staged(found.dropDuplicates(["l1", "l2"]), "line-texts")


def _finer(hot: DataFrame, texts: DataFrame) -> DataFrame:
    """Keys of what is left of the lines of crowded keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("l1").to_numpy()
            whole = batch.column("bytes").to_pylist()
            path = batch.column("tag").to_numpy()
            left = [rest(x, t) for x, t in zip(whole, path.tolist())]
            yield from _key_rows(whole, left, ids, batch.column("key").to_numpy(), path)

    return hot.join(texts, hot["a"] == texts["l1"]).select("key", "l1", "bytes", "tag").transform(shipped).mapInArrow(
        tidy(run), _ROW
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are within the threshold, as names of both lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                a, b = part.column("xa").to_pylist(), part.column("xb").to_pylist()
                shorter = np.array([min(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
                ok = within(a, b, allowed(shorter))
                yield part.select(["a1", "a2", "b1", "b2"]).filter(pa.array(ok))

    side = lambda x: texts.select(*(F.col(c).alias(n) for c, n in (("l1", f"{x}1"), ("l2", f"{x}2"), ("bytes", f"x{x}"))))
    both = pairs.join(side("a"), F.col("a") == F.col("a1")).join(side("b"), F.col("b") == F.col("b1"))
    near = F.abs(F.octet_length("xa") - F.octet_length("xb")) <= EDITS
    return (
        both.filter(near)
        .select("a1", "a2", "b1", "b2", "xa", "xb")
        .transform(shipped).mapInArrow(tidy(run), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    )


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of different lines within the threshold, by name: (a1, a2, b1, b2)."""
    keyed = _first_keys(docs)
    found = None
    texts = None
    for turn in range(ROUNDS):
        runs = staged(_runs(keyed, turn == ROUNDS - 1), "candidates")
        wanted = runs.select(F.explode(F.array("a", "b")).alias("l1")).filter("l1 IS NOT NULL").distinct()
        if texts is None:
            # later rounds key the same lines, or some of them, so their texts are here already
            texts = _texts(docs, classes, wanted)
        pairs = runs.filter("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        hot = runs.filter("b IS NULL").select("key", "a", "tag")
        if hot.isEmpty():
            break
        keyed = _finer(hot, texts)
    return staged(_verified(found.distinct(), texts), "line-links")


def decisions(docs: DataFrame) -> DataFrame:
    """For each document its lines to drop: (doc_id, digest, drops), an array of (line, l1, near)."""
    all_lines = staged(lines(docs), "lines")
    classes = staged(
        all_lines.groupBy("l1", "l2")
        .agg(F.min(F.struct("doc_id", "line", "digest")).alias("first"))
        .select("l1", "l2", "first.*"),
        "line-classes",
    )
    pairs = links(docs, classes)
    first = F.struct("doc_id", "line", "digest")
    a = classes.select(F.col("l1").alias("a1"), F.col("l2").alias("a2"), first.alias("fa"))
    b = classes.select(F.col("l1").alias("b1"), F.col("l2").alias("b2"), first.alias("fb"))
    placed = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    later = (
        placed.select(
            *(F.when(F.col("fa") > F.col("fb"), F.col(f"a{k}")).otherwise(F.col(f"b{k}")).alias(f"l{k}") for k in (1, 2))
        )
        .distinct()
        .withColumn("near", F.lit(True))
    )
    judged = classes.join(later, ["l1", "l2"], "left").select(
        "l1", "l2", first.alias("first"), F.coalesce("near", F.lit(False)).alias("near")
    )
    out = (
        all_lines.join(judged, ["l1", "l2"])
        .filter(F.col("near") | (first != F.col("first")))
        .groupBy("doc_id", "digest")
        .agg(F.collect_list(F.struct("line", "l1", "near")).alias("drops"))
    )
    return staged(out, "line-drops")


def _kept(text: bytes, drops: list[dict] | None) -> tuple[bytes, int, int, int]:
    """The text without its dropped lines, the lines it had, dropped in all and as near."""
    parts = text.split(b"\n") if text else []
    by_line = {(d["line"], d["l1"]): d["near"] for d in drops or ()}
    out, near = [], 0
    for k, x in enumerate(parts):
        verdict = by_line.get((k, name(x)[0])) if by_line else None
        if verdict is None:
            out.append(x)
        else:
            near += verdict
    return b"\n".join(out), len(parts), len(parts) - len(out), near


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the text left; null if it was null), n_lines, n_dropped, n_near.

    Columns of these names are replaced; all others, whatever their names, are kept.
    """
    fresh = ("kept", "n_lines", "n_dropped", "n_near")
    names = [c for c in docs.columns if c not in fresh]
    rows = packed(docs, names)
    schema = T.StructType([*rows.schema.fields, T.StructField("kept", T.StringType())])
    schema = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in fresh[1:])])
    own = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_kept((t or "").encode(), d) for t, d in zip(texts, batch.column("drops").to_pylist())]
            columns = {c: batch.column(c) for c in own}
            columns["kept"] = pa.array(
                [None if t is None else f[0].decode() for t, f in zip(texts, found)], pa.string()
            )
            for k, c in enumerate(("n_lines", "n_dropped", "n_near"), 1):
                columns[c] = pa.array([f[k] for f in found], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    drops = decisions(docs).select(F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_text"), "drops")
    same = (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("drop_id")) & (F.xxhash64("text") == F.col("drop_text"))
    both = rows.join(drops, same, "left").select(*own, "drops")
    return both.transform(shipped).mapInArrow(tidy(run), schema).select(*unpacked(names), *fresh)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines: counts and a digest of the text left."""
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", "n_near", F.sha2("kept", 256).alias("kept_sha256")
    )
