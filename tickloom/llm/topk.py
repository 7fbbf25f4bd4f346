"""Exact top-k by inner product, by a uniform threshold in three phases.

The components of the vectors are cut into ``PARTS`` ranges; each range scores all vectors
against a query on its own and so holds one list of partial scores, spread over chunks of
vectors. Partial scores are counted from the least one of the list, so they are not
negative. Phase one gathers the top of every list, scores what it has met and takes the k-th
largest score: no result lies below it. Phase two sends that cutoff, divided by the number
of lists, with the queries, and collects every entry at or above it; an entry absent from all
lists lies below the cutoff. Phase three drops what cannot reach the k-th largest sum any
more and resolves the remaining scores exactly.

Queries meet the chunks block by block. Equal vectors are one class, of which only the k + 1
smallest ids can be results, so copies in any number cost nothing after the first shuffle.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no
part; a null id takes no part; vectors meet only vectors of the same length; a vec_id that
occurs twice with different vectors is two rows, neither of which is a result of the other,
and one given twice with the same vector is one; ties go to the smaller vec_id; with fewer than k other rows all are returned. Components are
quantised to 64-bit integers and sums must fit them. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import read, staged

PARTS = 2
#: Times k that the first phase gathers from each list.
DEPTH = 3
#: Classes of a chunk and queries of a block: the size of one matrix product.
CHUNK = 4096
BLOCK = 1024


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``v``, the components times ``scale`` rounded down."""
    whole = (
        "embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    return vectors.select("vec_id", "embedding").filter(whole).select(
        "vec_id", F.expr(f"transform(embedding, x -> floor({scale} * double(x)))").alias("v")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("part").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(table.num_rows, -1)


def _products(queries: pa.Table, rows: pa.Table) -> np.ndarray:
    """Inner products, exactly: by floating point where every sum fits its mantissa."""
    a, b = _matrix(queries), _matrix(rows)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _top_lists(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = {"list": [], "q": [], "c": [], "s": [], "least": []}
        if queries.num_rows and rows.num_rows:
            s = _products(queries, rows)
            n = min(k, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            found = {
                "list": np.full(best.size, queries.column("list")[0].as_py(), dtype=np.int32),
                "q": np.repeat(queries.column("q").to_numpy(), n),
                "c": rows.column("c").to_numpy()[best.ravel()],
                "s": np.take_along_axis(s, best, axis=1).ravel(),
                "least": np.repeat(s.min(axis=1), n),
            }
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({name: pa.array(v, t) for (name, v), t in zip(found.items(), kinds)})

    return run


def _above(queries: pa.Table, rows: pa.Table) -> pa.Table:
    found = {"list": [], "q": [], "c": [], "s": []}
    if queries.num_rows and rows.num_rows:
        s = _products(queries, rows)
        i, j = np.nonzero(s >= queries.column("cutoff").to_numpy()[:, None])
        found = {
            "list": np.full(i.size, queries.column("list")[0].as_py(), dtype=np.int32),
            "q": queries.column("q").to_numpy()[i],
            "c": rows.column("c").to_numpy()[j],
            "s": s[i, j],
        }
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table({name: pa.array(v, t) for (name, v), t in zip(found.items(), kinds)})


def _kth(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """For each ``q`` the k-th largest ``value``; no row where there are fewer."""
    order = Window.partitionBy("q").orderBy(F.desc(value), "c")
    return (
        rows.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
        .filter(F.col("place") == k)
        .select("q", F.col(value).alias(name))
    )


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows of ``vectors`` (vec_id, v) for each
    of ``queries`` (vec_id, v), which are rows of ``vectors``."""
    keep = k + 1  # the query itself may be one of them
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    placed = vectors.distinct().withColumn("place", F.row_number().over(by_vector)).filter(F.col("place") <= keep)
    placed = staged(placed, "classes")
    firsts = placed.filter("place = 1").select(
        "v", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).alias("twin"), "vec_id"
    )
    # a class is named by its smallest id, and by a hash where that id has several vectors
    firsts = staged(
        firsts.select("v", F.expr("if(twin = 1, vec_id, xxhash64(v, vec_id))").alias("c")), "firsts"
    )
    classes = firsts.select("c", "v")
    members = placed.select("v", "vec_id").join(firsts, "v").select("c", "vec_id")
    asked = staged(
        queries.select(F.col("vec_id").alias("query_id"), "v")
        .join(firsts.withColumnRenamed("c", "q"), "v")
        .select("query_id", "q")
        .distinct(),
        "queries",
    )
    wanted = asked.select("q").distinct().join(classes.withColumnRenamed("c", "q"), "q")
    chunks = max(1, -(-classes.count() // CHUNK))
    blocks = max(1, -(-asked.select("q").distinct().count() // BLOCK))

    def split(rows: DataFrame) -> DataFrame:
        """One row for each list, with its range of components."""
        width = F.ceil(F.size("v") / PARTS)
        lists = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        return (
            rows.withColumn("list", lists)
            .withColumn("width", F.size("v"))
            .withColumn("part", F.slice("v", (F.col("list") * width + 1).cast("int"), width.cast("int")))
            .drop("v")
            .filter(F.size("part") > 0)
        )

    spread = lambda name, n: F.pmod(F.xxhash64(F.lit("spread"), name), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = split(classes).withColumn("chunk", spread("c", chunks)).withColumn("block", each(blocks))
    asking = split(wanted).withColumn("block", spread("q", blocks)).withColumn("chunk", each(chunks))
    key = ["list", "width", "chunk", "block"]

    tops = staged(
        asking.groupBy(key)
        .cogroup(dealt.groupBy(key))
        .applyInArrow(_top_lists(DEPTH * keep), "list int, q bigint, c bigint, s bigint, least bigint"),
        "tops",
    )
    floors = tops.groupBy("list", "q").agg(F.min("least").alias("floor"))
    in_list = Window.partitionBy("list", "q").orderBy(F.desc("s"), "c")
    product = F.expr("aggregate(zip_with(a, b, (x, y) -> x * y), 0L, (s, x) -> s + x)")

    def scored(pairs: DataFrame) -> DataFrame:
        """Exact scores of pairs (q, c)."""
        return (
            pairs.join(classes.withColumnRenamed("v", "b"), "c")
            .join(wanted.withColumnRenamed("v", "a"), "q")
            .select("q", "c", product.alias("score"))
        )

    first = (
        tops.withColumn("place", F.row_number().over(in_list))
        .filter(F.col("place") <= DEPTH * keep)
        .select("q", "c")
        .distinct()
    )
    bases = floors.groupBy("q").agg(F.sum("floor").alias("base"))
    safe = _kth(scored(first), "score", keep, "safe").join(bases, "q").select("q", F.expr("safe - base").alias("safe"))
    # without k entries everything is at or above the cutoff; the share is rounded down
    cutoffs = staged(
        floors.join(safe, "q", "left").select(
            "list",
            "q",
            "floor",
            F.coalesce(F.floor(F.col("safe") / PARTS), F.lit(0)).alias("share"),
        ),
        "cutoffs",
    )
    asking_again = asking.join(cutoffs, ["list", "q"]).withColumn("cutoff", F.col("floor") + F.col("share"))
    entries = (
        asking_again.groupBy(key)
        .cogroup(dealt.groupBy(key))
        .applyInArrow(_above, "list int, q bigint, c bigint, s bigint")
    )
    lists = F.count("*").alias("lists")
    sums = (
        entries.join(cutoffs, ["list", "q"])
        .groupBy("q", "c")
        .agg(
            lists,
            F.sum("s").alias("score"),
            F.sum(F.col("s") - F.col("floor")).alias("low"),
            F.max("share").alias("share"),
        )
    )
    sums = staged(sums, "sums")
    total = cutoffs.groupBy("q").agg(F.count("*").alias("of"))
    bound = _kth(sums, "low", keep, "bound")
    left = (
        sums.join(total, "q")
        .join(bound, "q", "left")
        .withColumn("high", F.col("low") + (F.col("of") - F.col("lists")) * F.col("share"))
        .filter("bound IS NULL OR high >= bound")
    )
    resolved = scored(left.filter("lists < of").select("q", "c"))
    exact = left.filter("lists = of").select("q", "c", "score").unionByName(resolved)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = (
        exact.join(members, "c")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= keep)
        .select("q", "vec_id", "score")
    )
    ranks = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(top, "q")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranks))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every row whose vec_id is divisible by 50."""
    rows = staged(quantised(read(spark, sf_dir, "embeddings")), "vectors")
    return search(rows, rows.filter("vec_id % 50 = 0"), 5)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
