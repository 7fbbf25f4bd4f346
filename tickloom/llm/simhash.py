"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A fingerprint is the majority of the bits of the hashes of a text's word shingles. For a
radius r, each bit position gets a nonzero vector of r + 1 bits; for each of the
2**(r+1) - 1 nonzero vectors there is a table whose key drops the positions orthogonal to
it. Any r positions have a vector orthogonal to all of them, so every pair within the
radius collides in some table: nothing is missed.

Only distinct fingerprints are keyed. Those that share a bucket are linked without emitting
the bucket's pairs: within radius 2, two fingerprints are linked exactly if one flip of
each can give the same value, so every fingerprint announces itself and its flips in the
dropped bits, and all that meet at a value link to the smallest of them. Work is linear in
the size of a bucket; there is no cap on it.

Defined cases: null and empty texts have fingerprint zero and link like any other; a text
of fewer words than a shingle is hashed as one sequence; repeated rows share a fingerprint;
a null doc_id gets its component but is never a component's name unless all are null.
Very long texts are hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import read, shipped, staged, text_bytes, tidy
from tickloom.llm.graph import components

SEED = 42
SHINGLE = 3
#: Differing bits at which fingerprints are linked; one flip of each side reaches as far.
RADIUS = 2
#: Hashes whose bits are counted at once.
BLOCK = 200_000


def shingle_hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of ``words`` words in lower case, joined by a space."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < words:
        runs = [b" ".join(w)]
    else:
        runs = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), dtype=np.uint64)


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """64 bits as a signed integer; a bit is set if it is set in over half the hashes."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(h), BLOCK):
        part = h[lo : lo + BLOCK].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (bigint) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"]
            )

    return docs.select("doc_id", "text").transform(shipped).mapInArrow(tidy(run), "doc_id bigint, fp bigint")


def covering_masks() -> list[int]:
    """Bits that each table keeps, as signed 64-bit integers."""
    draw = np.random.default_rng(5)
    top = 1 << (RADIUS + 1)
    # every nonzero vector serves about as many positions as any other
    vector = draw.permutation(np.resize(np.arange(1, top), 64))
    masks = []
    for v in range(1, top):
        keep = sum(1 << i for i, x in enumerate(vector) if int(x & v).bit_count() % 2)
        masks.append(keep - (1 << 64) if keep >> 63 else keep)
    return masks


def links(values: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between the distinct ``fp`` of ``values`` that lie within the radius.

    Links are those of stars: the fingerprints that meet at a value link to the smallest, so
    each link is within the radius and all that can reach each other do so by the links.
    """
    tables = F.array(
        *(
            F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
            for m in covering_masks()
        )
    )
    keyed = values.select("fp", F.explode(tables).alias("t")).select("fp", "t.mask", "t.key")
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    # a fingerprint's dropped bits in all tables where it shares a bucket
    open_bits = (
        keyed.join(shared, ["mask", "key"], "left_semi").groupBy("fp").agg(F.expr("bit_or(~mask)").alias("bits"))
    )
    flips = F.expr(
        "concat(array(fp), transform(filter(sequence(0, 63), b -> getbit(bits, b) = 1), "
        "b -> fp ^ shiftleft(1L, b)))"
    )
    met = open_bits.select("fp", F.explode(flips).alias("value"))
    hub = met.groupBy("value").agg(F.min("fp").alias("hub"), F.max("fp").alias("top"))
    return (
        met.join(hub.filter("hub < top").select("value", "hub"), "value")
        .filter("fp <> hub")
        .select(F.col("fp").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )


def with_components(marked: DataFrame) -> DataFrame:
    """``marked`` (doc_id, fp) with component_id, the smallest doc_id reachable by links."""
    values = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = staged(components(links(values)).withColumnRenamed("node", "fp"), "components")
    named = found.join(values, "fp")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    chosen = named.join(least, "root").select("fp", "least")
    ids = values.join(chosen, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(ids, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    marked = staged(fingerprints(read(spark, sf_dir, "documents")), "marked")
    return with_components(marked).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
