"""Merkle audit of the fixity of web archive replicas.

A page is written as a record of a WARC file; a file holds ``FANOUT`` ** 2 consecutive slots of
page ids. The records of a slot are hashed, ``FANOUT`` consecutive nodes hash to their parent
together with the bytes they span, up to one root for the collection. Two replicas with equal
roots are equal. Otherwise only the branches that differ are followed down, level by level,
to the slots, and the offsets of the damage in both files are summed up from the lengths.

Every level is one aggregation whose groups have at most ``FANOUT`` members. The records of a
slot are added up hash by hash, so any number of records with one id is one small sum.

Defined cases: a null page_id counts as -1; null url and html are empty; records with the
same id share a slot, which differs if their multiset does; very long pages are hashed
whole; two empty replicas have no differing slot. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import read, staged

FANOUT = 64
#: Levels above the slots; two of them make a file.
LEVELS = 6
FILE_LEVEL = 2

#: The record of a page as Spark and other engines write it in SQL.
RECORD = (
    "concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), "
    "'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), "
    "'Content-Length: ', {length}, chr(13), chr(10), chr(13), chr(10), "
    "coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))"
)


def slots(pages: DataFrame) -> DataFrame:
    """(idx, hash, bytes) of every slot: records added up by four parts of their hashes."""
    record = RECORD.format(length="octet_length(coalesce(html, ''))")
    rows = pages.select(F.coalesce("page_id", F.lit(-1)).cast("bigint").alias("idx"), F.expr(record).alias("record"))
    rows = rows.select("idx", F.octet_length("record").cast("bigint").alias("size"), F.sha2("record", 256).alias("h"))
    parts = [
        F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{k}")
        for k in range(4)
    ]
    summed = rows.groupBy("idx").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *parts)
    return summed.select("idx", F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("hash"), "bytes")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (replica, idx, hash, bytes)."""
    child = F.struct("idx", "hash", "bytes")
    grouped = nodes.groupBy("replica", F.floor(F.col("idx") / FANOUT).alias("up")).agg(
        F.array_sort(F.collect_list(child)).alias("children"), F.sum("bytes").alias("bytes")
    )
    line = F.transform("children", lambda c: F.concat_ws(":", c["idx"], c["hash"], c["bytes"]))
    return grouped.select(
        "replica", F.col("up").alias("idx"), F.sha2(F.concat_ws(",", line), 256).alias("hash"), "bytes"
    )


def trees(left: DataFrame, right: DataFrame) -> list[DataFrame]:
    """Written levels of both replicas, slots first; the last level is the roots."""
    both = slots(left).withColumn("replica", F.lit("a")).unionByName(slots(right).withColumn("replica", F.lit("b")))
    levels = [staged(both, "level0")]
    for k in range(LEVELS):
        levels.append(staged(parents(levels[-1]), f"level{k + 1}"))
    # whatever is left, such as ids below zero, meets under the root
    if levels[-1].filter("replica = 'a'").count() > 1 or levels[-1].filter("replica = 'b'").count() > 1:
        levels[-1] = staged(
            levels[-1]
            .groupBy("replica")
            .agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("children"), F.sum("bytes").alias("bytes"))
            .select(
                "replica",
                F.lit(0).cast("bigint").alias("idx"),
                F.sha2(F.to_json("children"), 256).alias("hash"),
                "bytes",
            ),
            "root",
        )
    return levels


def _differing(nodes: DataFrame) -> DataFrame:
    """Nodes (idx) whose hashes differ between the replicas, or that only one has."""
    side = F.max(F.when(F.col("replica") == "a", F.col("hash")))
    other = F.max(F.when(F.col("replica") == "b", F.col("hash")))
    return nodes.groupBy("idx").agg(side.alias("ha"), other.alias("hb")).filter("NOT ha <=> hb")


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Slots that differ between two replicas (page_id, url, html), with their place in the files.

    page_id, file, status (changed, missing or extra in the right replica), offset and bytes
    in either file, hash in either and the roots of the two trees.
    """
    levels = trees(left, right)
    top = levels[-1].agg(
        F.max(F.when(F.col("replica") == "a", F.col("hash"))).alias("root_a"),
        F.max(F.when(F.col("replica") == "b", F.col("hash"))).alias("root_b"),
    )
    open_nodes = None
    files = None
    for k in range(LEVELS - 1, -1, -1):
        nodes = levels[k]
        if k < LEVELS - 1:  # below the roots: only children of differing nodes
            nodes = nodes.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(
                open_nodes.select(F.col("idx").alias("up")), "up", "left_semi"
            )
        open_nodes = _differing(nodes)
        if k == FILE_LEVEL:
            files = open_nodes.select(F.col("idx").alias("file"))
    size = FANOUT**FILE_LEVEL
    # at most a file's slots in each window
    before = Window.partitionBy("replica", "file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        levels[0]
        .withColumn("file", F.floor(F.col("idx") / size))
        .join(files, "file", "left_semi")
        .withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .groupBy("idx", "file")
        .agg(
            *(
                F.max(F.when(F.col("replica") == r, F.col(c))).alias(f"{c}_{r}")
                for r in "ab"
                for c in ("offset", "bytes")
            )
        )
    )
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return (
        placed.join(open_nodes, "idx")
        .join(F.broadcast(top))  # one row
        .select(
            F.col("idx").alias("page_id"),
            "file",
            status.alias("status"),
            "offset_a",
            "bytes_a",
            "offset_b",
            "bytes_b",
            F.col("ha").alias("hash_a"),
            F.col("hb").alias("hash_b"),
            "root_a",
            "root_b",
        )
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: a changed last byte, a lost and a doubled record."""
    return (
        pages.filter("NOT page_id % 211 <=> 7")
        .withColumn(
            "html", F.expr("CASE WHEN page_id % 97 = 13 THEN concat(left(html, length(html) - 1), '~') ELSE html END")
        )
        .unionByName(pages.filter("page_id % 307 = 5"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica with known damage."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


def _sql() -> str:
    record = RECORD.format(length="strlen(coalesce(html, ''))")
    parts = ", ".join(
        f"CAST(sum(CAST(CAST(concat('0x', substr(h, {1 + 15 * k}, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS s{k}"
        for k in range(4)
    )
    steps = [
        f"""pages_b AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN concat(left(html, length(html) - 1), '~') ELSE html END AS html
  FROM pages WHERE page_id % 211 IS DISTINCT FROM 7
  UNION ALL SELECT page_id, url, html FROM pages WHERE page_id % 307 = 5
)""",
        f"""records AS (
  SELECT replica, coalesce(page_id, -1) AS idx, strlen(r) AS size, sha256(r) AS h FROM (
    SELECT 'a' AS replica, page_id, {record} AS r FROM pages
    UNION ALL SELECT 'b', page_id, {record} FROM pages_b)
)""",
        f"""summed AS (
  SELECT replica, idx, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, {parts} FROM records GROUP BY ALL
)""",
        """l0 AS (
  SELECT replica, idx, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS hash, bytes FROM summed
)""",
    ]
    for k in range(LEVELS):
        steps.append(
            f"""l{k + 1} AS (
  SELECT replica, CAST(floor(idx / {FANOUT}) AS BIGINT) AS idx,
    sha256(string_agg(concat_ws(':', idx, hash, bytes), ',' ORDER BY idx)) AS hash,
    CAST(sum(bytes) AS BIGINT) AS bytes
  FROM l{k} GROUP BY replica, CAST(floor(idx / {FANOUT}) AS BIGINT)
)"""
        )
    size = FANOUT**FILE_LEVEL
    return (
        "WITH "
        + ", ".join(steps)
        + f""", placed AS (
  SELECT *, CAST(floor(idx / {size}) AS BIGINT) AS file,
    CAST(coalesce(sum(bytes) OVER (PARTITION BY replica, floor(idx / {size}) ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM l0
)
SELECT coalesce(a.idx, b.idx) AS page_id, coalesce(a.file, b.file) AS file,
  CASE WHEN b.idx IS NULL THEN 'missing' WHEN a.idx IS NULL THEN 'extra' ELSE 'changed' END AS status,
  a.off AS offset_a, a.bytes AS bytes_a, b.off AS offset_b, b.bytes AS bytes_b,
  a.hash AS hash_a, b.hash AS hash_b,
  (SELECT hash FROM l{LEVELS} WHERE replica = 'a') AS root_a, (SELECT hash FROM l{LEVELS} WHERE replica = 'b') AS root_b
FROM (SELECT * FROM placed WHERE replica = 'a') a
FULL JOIN (SELECT * FROM placed WHERE replica = 'b') b USING (idx)
WHERE a.hash IS DISTINCT FROM b.hash"""
    )


SQL = _sql()
