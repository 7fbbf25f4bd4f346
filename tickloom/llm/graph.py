"""Connected components of a link table, by alternating star contraction on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import dropped, shipped, staged, tidy


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select("lo", "hi")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    around = edges.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return around.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rounds on arrays of links, until nothing changes."""
    nodes, at = np.unique(np.stack((hi, lo)), return_inverse=True)
    hi, lo = at.reshape(2, -1)
    before = np.zeros(0, np.int64)
    while True:
        least = np.arange(len(nodes))
        np.minimum.at(least, hi, lo)
        lo = least[lo]
        least = np.arange(len(nodes))
        np.minimum.at(least, hi, lo)
        own = least[hi]
        links = np.unique(np.concatenate((hi, lo[lo > own])) * len(nodes) + np.concatenate((own, own[lo > own])))
        hi, lo = links // len(nodes), links % len(nodes)
        if np.array_equal(links, before):
            return nodes[hi], nodes[lo]
        before = links


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches, pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    if table.num_rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*(c.to_numpy() for c in table.columns))], names=["hi", "lo"])


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    The links are rewritten to stars in a logarithmic number of rounds; each round is a
    written table. Minimums are aggregated before the shuffle, so a node with any number of
    links is no single task. Up to ``few`` links are rewritten within one task, as the rounds of so
    small a table are mostly tasks without rows. Null ends and links of a node to itself are ignored.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    edges = staged(edges.distinct(), "links")
    mark = _mark(edges)
    if 0 < mark[0] <= few:
        following = staged(edges.coalesce(1).transform(shipped).mapInArrow(tidy(_at_once), "hi bigint, lo bigint"), "stars")
        dropped(edges)
        edges, mark = following, (0,)
    while mark[0]:
        following = staged(_small_star(_large_star(edges)), "stars")
        after = _mark(following)
        dropped(edges)
        edges = following
        if after == mark:
            break
        mark = after
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
