"""Benchmark decontamination: passages of benchmark items found through an FM-index per shard.

The windows of the items are the patterns: ten consecutive words, or all words of a shorter
item. A shard, a bounded run of texts within a partition, becomes a sequence of words
numbered by the benchmark's vocabulary; a word outside it, or the end of a text, is a gap that
no pattern holds. Stretches between gaps that are shorter than the shortest pattern hold no
occurrence and are left out of the index. All windows are searched backwards at once,
occurrences are located by sampled suffix positions, and their words are merged to spans.

Texts stay where they are: only the windows travel, in slices of at most ``SLICE_WORDS``
words of items, so that a worker holds one slice at a time however large the benchmark is.

Defined cases: null and empty texts have no words, no hit and no item; an item without words
takes no part; items that share an id count as one; a window found in several items counts
for each. Very long texts are indexed whole. Repeated rows are scanned one by one; columns
named like a result are replaced, all others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import joined, passes, read, shipped, span_sums, text_bytes, tidy
from tickloom.llm.fm_index import FmIndex
from tickloom.llm.words import FOLD, hash_spans, word_spans

WINDOW = 10
#: Words of benchmark items in one slice of patterns.
SLICE_WORDS = 2_000_000
#: Text bytes of a shard.
SHARD_BYTES = 1_500_000

RESULTS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<begin:bigint,end:bigint>>"


@dataclass
class Patterns:
    vocabulary: np.ndarray  # sorted hashes of words; a word's number is its place + 2
    rows: np.ndarray  # windows as numbers, flush left
    lengths: np.ndarray
    items: list[list[str]]  # ids of the items of each window


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of each word, and the first word of each text and the end of all."""
    data, starts, _ = joined(texts, b" ")
    folded = FOLD[data]
    begin, end = word_spans(folded)
    first = np.append(np.searchsorted(begin, starts), len(begin))
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return hash_spans(folded, begin, end), begin - starts[owner], end - starts[owner], first


def patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> Patterns:
    h, _, _, first = words_of([t for _, t in items])
    vocabulary = np.unique(h)
    number = np.searchsorted(vocabulary, h) + 2
    found: dict[tuple, set[str]] = defaultdict(set)
    for i, (item, _) in enumerate(items):
        own = number[first[i] : first[i + 1]].tolist()
        for k in range(max(1, len(own) - window + 1) if own else 0):
            found[tuple(own[k : k + window])].add(item)
    rows = np.zeros((len(found), window), dtype=np.int64)
    for k, w in enumerate(found):
        rows[k, : len(w)] = w
    return Patterns(
        vocabulary,
        rows,
        np.array([len(w) for w in found], dtype=np.int64),
        [sorted(x) for x in found.values()],
    )


def occurrences(h: np.ndarray, first: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Word index and window of every occurrence in the texts whose words hash to ``h``."""
    none = np.zeros(0, dtype=np.int64)
    if not len(h) or not len(p.rows):
        return none, none
    place = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    number = np.where(p.vocabulary[place] == h, place + 2, 1)
    # a gap before each text: insert 1 at each text's first word
    counts = np.diff(first)
    at = np.arange(len(h)) + 1 + np.repeat(np.arange(len(counts)), counts)
    s = np.ones(len(h) + len(counts) + 1, dtype=np.int64)
    s[at] = number
    word = np.full(len(s), -1, dtype=np.int64)
    word[at] = np.arange(len(h))
    gap = np.flatnonzero(s == 1)
    length = np.diff(gap) - 1
    long_enough = length >= p.lengths.min()
    keep = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(keep, gap[:-1][long_enough], 1)
    np.add.at(keep, gap[1:][long_enough], -1)
    kept = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
    if not len(kept):
        return none, none
    index = FmIndex(s[kept], len(p.vocabulary) + 2)
    lo, hi = index.search(p.rows, p.lengths)
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    end = np.cumsum(size)
    suffix = np.repeat(lo - end + size, size) + np.arange(len(which))
    return word[kept[index.locate(suffix)]], which


def scan(texts: list[bytes], slices) -> dict[str, list]:
    """Hits of each text: counts, items, and byte spans of merged runs of hit words."""
    h, begin, end, first = words_of(texts)
    hit = np.zeros(len(h) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in texts]
    for p in slices():
        at, which = occurrences(h, first, p)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + p.lengths[which], -1)
        owner = np.searchsorted(first, at, side="right") - 1
        for i, w in set(zip(owner.tolist(), which.tolist())):
            items[i].update(p.items[w])
    is_hit = np.cumsum(hit[:-1]) > 0
    spans: list[list[dict]] = [[] for _ in texts]
    step = np.diff(np.concatenate([[0], is_hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
        while a < b:  # a run may go on in the next text
            i = int(np.searchsorted(first, a, side="right")) - 1
            stop = min(b, int(first[i + 1]))
            spans[i].append({"begin": int(begin[a]), "end": int(end[stop - 1])})
            a = stop
    return {
        "n_words": np.diff(first).tolist(),
        "n_hit": span_sums(is_hit.astype(np.int64), first[:-1], first[1:]).tolist() if len(h) else [0] * len(texts),
        "items": [sorted(x) for x in items],
        "spans": spans,
    }


def slices_of(benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> list:
    """Broadcast patterns of the items, dealt by hash to slices of bounded size."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(
        "item IS NOT NULL AND text IS NOT NULL"
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // (6 * slice_words)
    made = []
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        items = [(r["item"], r["text"].encode()) for r in part.toLocalIterator()]
        made.append(spark.sparkContext.broadcast(patterns(items)))
    return made


def without(text: bytes, spans: list[dict]) -> bytes:
    """``text`` without the byte ranges."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, text[at:]])


def contaminated(docs: DataFrame, benchmark: DataFrame, cut: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans (byte ranges of merged runs of hit words);
    with ``cut`` the ranges are cut out of the text."""
    parts = slices_of(benchmark)
    fresh = ("n_words", "n_hit", "items", "spans")
    names = [c for c in docs.columns if c not in fresh]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    kinds = {
        "n_words": pa.int64(),
        "n_hit": pa.int64(),
        "items": pa.list_(pa.string()),
        "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
    }

    def slices():
        for part in parts:
            yield part.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = text_bytes(batch.column("text"))
            for lo, hi in passes(column, SHARD_BYTES):
                found = scan(column[lo:hi], slices)
                columns = {name: batch.column(name).slice(lo, hi - lo) for name in names}
                columns |= {name: pa.array(found[name], kind) for name, kind in kinds.items()}
                if cut:
                    valid = columns["text"].is_valid().to_pylist()
                    left = [
                        without(t, s).decode() if ok else None
                        for t, s, ok in zip(column[lo:hi], found["spans"], valid)
                    ]
                    columns["text"] = pa.array(left, columns["text"].type)
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(names).transform(shipped).mapInArrow(tidy(run), f"{kept}, {RESULTS}")


def cleaned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the passages of the benchmark cut out of the text, and n_hit."""
    names = [*(c for c in docs.columns if c != "n_hit"), "n_hit"]
    return contaminated(docs, benchmark, cut=True).select(names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item, w[k : k + least(len(w), {WINDOW}) - 1] AS words
  FROM i, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(k) WHERE len(w) > 0
),
m AS (SELECT DISTINCT len(words) AS m FROM p),
o AS (SELECT doc_id, k, m, w[k : k + m - 1] AS words FROM d, m, unnest(range(1, len(w) - m + 2)) AS t(k)),
h AS (SELECT doc_id, k, m, item FROM o JOIN p USING (words)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(k, k + m)) AS t(j) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
