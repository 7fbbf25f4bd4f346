"""Groups of documents whose word shingles agree, by SimHash first and an exact set-similarity join for the rest.

Two documents are near copies if their sets of WORDS-word shingles (lower case) share at
least SIMILAR[0] / SIMILAR[1] of their union; near copies of near copies are one group. No
such pair is missed: shingles are put in one order for all documents, and two sets that agree
share one of the first n - ceil(s n) + 1 shingles of each of n. Which order it is affects
only the work; shingles that a sample of documents repeats come last, so that passages that
many documents share are seldom among the first.

Near copies whose fingerprints lie within ``simhash.RADIUS`` bits are found by ``simhash``: covering tables on distinct
fingerprints, star links, star contraction; a link counts if the whole sets agree. The groups that they make are where the
join begins, which finds what lies beyond the radius.

Documents that share a shingle there, and may agree by their sizes and its places, are
candidates. Two sets differ in at least as many shingles as the parities of their shingles by place of a
bitmap do, which rules out most candidates; the texts of the others are compared by their whole sets. A bitmap has as many places as
its document has shingles, as a shorter one is half full whatever the sets are. Large families are not paired up:
in a few rounds each document is compared with one hub, a document that stands for a shingle of both. In the end
only documents of different groups are paired, in slices of a bounded size: chance meetings grow with the square of the corpus.

Sequences of words and shingles travel as 64-bit hashes. Sequences that share a hash but differ in a
second one get names made of both, so that a document is known by 128 bits.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words agree
with each other; a null doc_id takes part like any other row; very long texts are compared by
their whole sets. All columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import dropped, packed, shipped, staged, text_bytes, tidy, unpacked
from tickloom.llm.graph import components
from tickloom.llm.simhash import fingerprint, shingle_hashes
from tickloom.llm.simhash import links as fingerprint_links

WORDS = 5
#: Shared part of the union, as a fraction.
SIMILAR = (4, 5)
#: Documents of the sample, and shingles kept of it, that put common shingles last.
SAMPLE, COMMON = 4_000, 100_000
#: Rounds of hubs at most, and bound on pairs for each row beyond which there is a round.
STARS, PAIRS = 5, 10
#: Pairs of rows of different groups that are always met at once; beyond it, as many as there are rows.
SLICE = 20_000_000
#: Links up to which groups are made within one task.
FEW = 50_000
#: Documents of candidates that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_IDS = 2_000_000
#: Shingles whose sets a worker remembers.
REMEMBERED = 1_000_000

#: Bits of the parities of a document's shingles, at least; a power of two.
PARITIES = 1024

#: Names that ``_marked`` adds: two halves of the words' hash, the text's, and the fingerprint; number and parities of the shingles.
_OWN = ("nd_words", "nd_more", "nd_text", "nd_print")
_SKETCH = ("nd_size", "nd_odd")
LOW = (1 << 64) - 1


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def agree(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets share the part of their union that makes near copies."""
    s, t = SIMILAR
    need = s * (len(a) + len(b))
    if (s + t) * min(len(a), len(b)) < need:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return (s + t) * both >= need


def parities(shingles: np.ndarray) -> bytes:
    """For each of as many places as shingles or more, whether an odd number of the shingles fall on it."""
    places = max(PARITIES, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else PARITIES
    counts = np.bincount((shingles % np.uint64(places)).astype(np.int64), minlength=places)
    return np.packbits(counts & 1).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of parities by fewer places: those that fall together are added up."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_agree(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs of sets can agree, by rows of their parities and by their sizes; none that agrees is ruled out."""
    s, t = SIMILAR
    width = min(a.shape[1], b.shape[1])
    apart = np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum(axis=1, dtype=np.int64)
    # the sets share at most (size_a + size_b - apart) / 2
    both = size_a + size_b
    return ((s + t) * (both - apart) >= 2 * s * both) & ((s + t) * np.minimum(size_a, size_b) >= s * both)


def first_shingles(shingles: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first of a set in the order of all sets, as many as agreeing sets cannot avoid."""
    n = len(shingles)
    if not n:
        return shingles
    weight = np.zeros(n, dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, often[at], 0)
    s, t = SIMILAR
    return shingles[np.lexsort((shingles, weight))[: n + (-s * n // t) + 1]]


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with two hashes of the sequence of words, one of the text, the fingerprint of the words, and
    the number of shingles with their parities."""
    names = rows.columns
    sketch = (T.StructField(c, kind) for c, kind in zip(_SKETCH, (T.LongType(), T.BinaryType())))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in _OWN), *sketch])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            columns = {c: batch.column(c) for c in names}
            words = [xxhash.xxh3_128_intdigest(b" ".join(t.lower().split())) for t in texts]
            own = ([w >> 64 for w in words], [w & LOW for w in words], map(xxhash.xxh3_64_intdigest, texts))
            for c, hashes in zip(_OWN, own):
                found = np.fromiter(hashes, dtype=np.uint64, count=len(texts))
                columns[c] = pa.array(found.view(np.int64))
            columns[_OWN[-1]] = pa.array(map(fingerprint, texts), pa.int64())
            sizes, odd = zip(*((len(x), parities(x)) for x in map(shingle_set, texts))) if texts else ((), ())
            columns["nd_size"], columns["nd_odd"] = pa.array(sizes, pa.int64()), pa.array(odd, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return _told_apart(staged(rows.transform(shipped).mapInArrow(tidy(run), schema), "marked"))


def _told_apart(marked: DataFrame) -> DataFrame:
    """``marked``, where sequences of words that differ in ``nd_more`` have different names ``nd_words``."""
    both = marked.groupBy("nd_words").agg(F.min("nd_more").alias("lo"), F.max("nd_more").alias("hi"))
    shared = staged(both.filter("lo < hi").select("nd_words", F.lit(True).alias("nd_shared")), "shared-names")
    n = shared.count()
    if not n:
        return marked
    # about n^2 / 2^65 names of n documents: a few, but checked like any other broadcast
    named = marked.join(F.broadcast(shared) if n <= BROADCAST_IDS else shared, "nd_words", "left")
    words = F.when(F.col("nd_shared"), F.xxhash64("nd_words", "nd_more")).otherwise(F.col("nd_words"))
    return staged(named.withColumn("nd_words", words).select(marked.columns), "named")


def _common(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of different documents repeats, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in text_bytes(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["shingle"])

    every = max(1, marked.count() // SAMPLE)
    some = marked.filter(F.pmod("nd_words", F.lit(every)) == 0).select("nd_words", "text").dropDuplicates(["nd_words"])
    counted = some.select("text").transform(shipped).mapInArrow(tidy(run), "shingle bigint").groupBy("shingle").count()
    rows = counted.filter("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    shingles = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r[1] for r in rows], dtype=np.int64)[order]


def _keyed(marked: DataFrame) -> DataFrame:
    """(shingle, id, n, at): the first shingles of each document, its size and their places."""
    shared = marked.sparkSession.sparkContext.broadcast(_common(marked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("nd_words").to_pylist()
            for lo in range(0, len(ids), 100):
                out, own, sizes = [], [], []
                for i, t in zip(ids[lo : lo + 100], text_bytes(batch.column("text").slice(lo, 100))):
                    if i in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(i)
                    whole = shingle_set(t)
                    out.append(first_shingles(whole, *shared.value))
                    own.append(i)
                    sizes.append(len(whole))
                many = [len(x) for x in out]
                keys = np.concatenate(out) if out else np.zeros(0, np.uint64)
                places = np.concatenate([np.arange(m) for m in many]) if out else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)),
                        pa.array(np.repeat(np.array(own, np.int64), many)),
                        pa.array(np.repeat(np.array(sizes, np.int32), many)),
                        pa.array(places.astype(np.int32)),
                    ],
                    names=["shingle", "id", "n", "at"],
                )

    rows = marked.select("nd_words", "text").transform(shipped)
    return rows.mapInArrow(tidy(run), "shingle bigint, id bigint, n int, at int")


def _may_agree(a: str, b: str):
    """Whether sets with sizes up to ``hi``, from ``lo``, that first share a shingle at ``at`` can agree."""
    s, t = SIMILAR
    both = f"least({a}_hi - {a}_at, {b}_hi - {b}_at)"
    return F.expr(f"{s + t} * {both} >= {s} * ({a}_lo + {b}_lo)")


def _as(rows: DataFrame, side: str, group: str = "root") -> DataFrame:
    """Rows of single documents under the names that ``_may_agree`` reads."""
    return rows.select(
        "shingle",
        F.col("id").alias(side),
        F.col(group).alias(f"{side}_root"),
        F.col("n").alias(f"{side}_lo"),
        F.col("n").alias(f"{side}_hi"),
        F.col("at").alias(f"{side}_at"),
    )


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hub_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """A pair of each document with one hub of its shingles, of another group: the one it shares most of them with.

    Other pairs are left to the rounds that follow, and to the last one.
    """
    mixed = F.xxhash64(F.lit(turn), "id")
    hub = rows.groupBy("shingle").agg(F.min(F.struct(mixed.alias("mixed"), "id", "root", "n", "at")).alias("hub"))
    hubs = _as(hub.select("shingle", "hub.*"), "a")
    pairs = _as(rows, "b").join(hubs, "shingle")
    pairs = pairs.filter(F.col("a_root") != F.col("b_root")).filter(_may_agree("a", "b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    nearest = shared.groupBy("b").agg(F.max_by("a", F.struct("n", F.xxhash64(F.lit(turn), "a"))).alias("a"))
    return _ordered_pairs(nearest)


def _group_pairs(rows: DataFrame, slices: int = 1, turn: int = 0) -> DataFrame:
    """All pairs of documents of different groups that share a shingle and may agree.

    Of ``slices`` of them, by the lesser group, those of one.
    """
    groups = rows.groupBy("shingle", "root").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("at").alias("at")
    )
    own = groups if slices == 1 else groups.filter(F.pmod(F.xxhash64("root"), F.lit(slices)) == turn)
    side = lambda x, some: some.select("shingle", *(F.col(c).alias(f"{x}_{c}") for c in ("root", "lo", "hi", "at")))
    met = side("a", own).join(side("b", groups), "shingle").filter("a_root < b_root").filter(_may_agree("a", "b"))
    met = met.select("shingle", "a_root", "b_root")
    pairs = met.join(_as(rows, "a"), ["shingle", "a_root"]).join(_as(rows, "b"), ["shingle", "b_root"])
    return _ordered_pairs(pairs.filter(_may_agree("a", "b")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            ok = []
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                sets = []
                for i, x in (("a", "xa"), ("b", "xb")):
                    own = []
                    for k, t in zip(part.column(i).to_pylist(), text_bytes(part.column(x))):
                        if k not in known:
                            if held > REMEMBERED:
                                known, held = {}, 0
                            known[k] = shingle_set(t)
                            held += len(known[k])
                        own.append(known[k])
                    sets.append(own)
                ok += [agree(x, y) for x, y in zip(*sets)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"x{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "xa", "xb")
    return both.transform(shipped).mapInArrow(tidy(run), "a bigint, b bigint")


def _likely(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) that the parities of their sets do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = lambda rows, at: np.frombuffer(b"".join(rows[i] for i in at), np.uint8).reshape(len(at), -1)
        for batch in batches:
            a, b = batch.column("a_odd").to_pylist(), batch.column("b_odd").to_pylist()
            sizes = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
            widths = np.array([(len(x), len(y)) for x, y in zip(a, b)]).reshape(-1, 2)
            ok = np.zeros(len(a), dtype=bool)
            for pair in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == pair).all(axis=1))
                ok[at] = may_agree(bits(a, at), bits(b, at), *(x[at] for x in sizes))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # copies of a sequence of words have the same set, so any of their rows will do
    sketches = marked.select("nd_words", *_SKETCH).dropDuplicates(["nd_words"])
    side = lambda x: sketches.select(*(F.col(c).alias(n) for c, n in zip(("nd_words", *_SKETCH), (x, f"{x}_n", f"{x}_odd"))))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.transform(shipped).mapInArrow(tidy(run), "a bigint, b bigint")


def _texts(marked: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and text of the documents of ``pairs`` alone."""
    own = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    ids = F.broadcast(own) if own.count() <= BROADCAST_IDS else own
    some = marked.select(F.col("nd_words").alias("id"), "text").join(ids, "id", "left_semi")
    texts = staged(some.dropDuplicates(["id"]), "pair-texts")
    dropped(own)
    return texts


def _instead(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, made of ``old``, as a table in its place."""
    table = staged(new, "met")
    dropped(old)
    return table


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the group of each document, its own name if it is linked to none."""
    found = rows.join(roots.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("root", F.coalesce("root", "id"))


def _print_pairs(marked: DataFrame) -> DataFrame:
    """Pairs of documents whose fingerprints are equal or linked: stars, linear in the number of documents."""
    prints = staged(marked.select("nd_words", F.col("nd_print").alias("fp")).distinct(), "prints")
    # of documents with one fingerprint each is paired with the least
    least = prints.groupBy("fp").agg(F.min("nd_words").alias("least"))
    equal = prints.join(least, "fp").filter("nd_words <> least").select(F.col("nd_words").alias("a"), F.col("least").alias("b"))
    near = fingerprint_links(least.select("fp"))
    side = lambda x: least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_least"))
    linked = near.join(side("a"), "a").join(side("b"), "b").select(F.col("a_least").alias("a"), F.col("b_least").alias("b"))
    pairs = staged(_ordered_pairs(equal.unionByName(linked)), "pairs")
    dropped(prints)
    return pairs


def _agreeing(marked: DataFrame, likely: DataFrame) -> DataFrame:
    """The pairs of ``likely`` whose whole sets agree."""
    texts = _texts(marked, likely)
    linked = staged(_verified(likely, texts), "near")
    dropped(texts)
    dropped(likely)
    return linked


def _squares(count: str):
    return F.sum(F.col(count).cast("double") * F.col(count))


def _links(marked: DataFrame) -> DataFrame:
    """(node, root) of the documents, by hashes of their words, that are linked to another."""
    tried = _print_pairs(marked)
    found = _agreeing(marked, staged(_likely(tried, marked), "likely"))
    roots = staged(components(found, few=FEW), "groups")
    # rows of a shingle meet in one shuffle; most are alone, and are written nowhere
    keyed = _keyed(marked).repartition("shingle").distinct()
    here = Window.partitionBy("shingle")
    met = keyed.withColumns({"lo": F.min("id").over(here), "hi": F.max("id").over(here)}).filter("lo < hi")
    rows = staged(_rooted(met.drop("lo", "hi"), roots), "met")
    for turn in range(STARS + 1):
        # what shares a shingle within one group alone is settled
        open_ = rows.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        rows = _instead(rows, rows.join(open_.select("shingle"), "shingle"))
        each = rows.groupBy("shingle").agg(F.count("*").alias("n"))
        total, squares = each.agg(F.sum("n"), _squares("n")).first()
        if not total:
            break
        last = turn == STARS or squares <= PAIRS * total
        slices = 1
        if last:
            within = rows.groupBy("shingle", "root").agg(F.count("*").alias("n")).agg(_squares("n")).first()[0]
            slices = max(1, math.ceil((squares - within) / 2 / max(total, SLICE)))
        likely = None
        for k in range(slices):
            pairs = _group_pairs(rows, slices, k) if last else _hub_pairs(rows, turn)
            pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            some = staged(_likely(pairs, marked), "likely")
            likely = some if likely is None else likely.unionByName(some)
            if last:
                dropped(pairs)
            else:
                tried = tried.unionByName(pairs)
        found = found.unionByName(_agreeing(marked, likely))
        roots = staged(components(found, few=FEW), "groups")
        if last:
            break
        rows = _instead(rows, _rooted(rows.drop("root"), roots))
    dropped(rows)
    return roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the least doc_id, null ids last, then by text."""
    names = docs.columns
    marked = _marked(packed(docs, names))
    roots = _links(marked)
    roots = roots.select(F.col("node").alias("nd_node"), F.col("root").alias("nd_root"))
    keys = marked.select("doc_id", "nd_words", "nd_text").join(roots, F.col("nd_words") == F.col("nd_node"), "left")
    keys = keys.withColumn("nd_root", F.coalesce("nd_root", "nd_words"))
    # a row given twice is one place
    places = keys.groupBy("nd_root", "doc_id", "nd_text").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("nd_text").alias("t"), "n")
    least = places.groupBy("nd_root").agg(F.min(place).alias("nd_least"), F.sum("n").alias("nd_rows"))
    # texts of rows that are alone in their group are not shuffled
    crowded = least.filter("nd_rows > 1").select(
        "nd_root", F.col("nd_least.id").alias("nd_id"), F.col("nd_least.t").alias("nd_t"), F.col("nd_least.n").alias("nd_times")
    )
    crowded = keys.select(F.col("nd_words").alias("nd_node"), "nd_root").distinct().join(crowded, "nd_root")
    crowded = staged(crowded, "crowded")
    found = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
    grouped = marked.join(found, F.col("nd_words") == F.col("nd_node"), "left")
    least = grouped.filter(
        F.col("nd_node").isNull() | F.col("doc_id").eqNullSafe(F.col("nd_id")) & (F.col("nd_text") == F.col("nd_t"))
    )
    once = least.filter("nd_node IS NULL OR nd_times = 1")
    again = least.filter("nd_times > 1").dropDuplicates(["nd_root"])
    return once.unionByName(again).select(unpacked(names))
