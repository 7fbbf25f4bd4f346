"""Merkle manifest of a dataset: trees by source under one root, proofs, and versions by path copying.

Every row is a leaf, every 16 consecutive nodes of a source become their hash until one is left,
the subroot; the subroots, in order of their sources, become the root alike. Leaves are
numbered by a range sort and offsets of its partitions, so no source is one task. An aligned
block of ``16 ** BLOCK_LEVELS`` leaves is one row; its nodes are a persistent tree. Each tampered
leaf makes a version: its ancestors within the block are copied, every other node is shared. The levels
above are tables of blocks (a 256th of the leaves), hashed and walked level by level in Spark; a version goes on
along the way of its block, which all leaves of the block share.

Defined cases: a null field is encoded as ``-``; a null doc_id comes first in its source and is
never tampered by the query; equal rows are leaves of their own, next to each other; a null
source is a tree of its own and comes first. A lone leaf is its subroot, and a lone subroot the root; without siblings the
proof is the hash of nothing. Empty texts and very long ones are hashed whole. An empty table has no rows. Columns other than
those of the leaves are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import read, shipped, staged, tidy

FANOUT = 16
#: Levels of the tree within a block; 256 leaves.
BLOCK_LEVELS = 2
#: Columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Blocks whose rows are returned together.
TOGETHER = 16

_STEP = "struct<lft:string,rgt:string>"


def hashed(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """A block's nodes; a version is the id of its top node, and versions share what is the same."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.hashes = list(leaves)
        self.kids: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[i : i + FANOUT])) for i in range(0, len(row), FANOUT)]
        (self.top,) = row

    def _node(self, kids: tuple[int, ...]) -> int:
        self.kids.append(kids)
        self.hashes.append(hashed([self.hashes[k] for k in kids]))
        return len(self.kids) - 1

    def way(self, at: int) -> list[tuple[int, int]]:
        """Ancestors of leaf ``at`` in the first version, from the top, with the child's place."""
        node, found = self.top, []
        for level in reversed(range(self.levels)):
            place = at // FANOUT**level % FANOUT
            found.append((node, place))
            node = self.kids[node][place]
        return found

    def siblings(self, at: int) -> list[str]:
        """Hashes beside the way from leaf ``at`` up, level by level, left to right."""
        return [
            self.hashes[k]
            for node, place in reversed(self.way(at))
            for i, k in enumerate(self.kids[node])
            if i != place
        ]

    def replaced(self, at: int, leaf: str) -> list[int]:
        """The nodes of a version with another leaf: it and copies of its ancestors, top last."""
        self.kids.append(())
        self.hashes.append(leaf)
        copies = [len(self.kids) - 1]
        for node, place in reversed(self.way(at)):
            kids = self.kids[node]
            copies.append(self._node(kids[:place] + (copies[-1],) + kids[place + 1 :]))
        return copies


def leaf_hash(fields: dict[str, Column]) -> Column:
    """Hash of the fields in order, each as its byte count and value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` (with ``g``) with ``pos`` from 0 within g by ``order``, and ``n``, the rows of g.

    Equal rows may share a partition only as far as a range of them does: ties are spread.
    """
    keys = ["g", *order]
    placed = staged(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "tie")
        .sortWithinPartitions(*keys, "tie")
        .drop("tie")
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        label,
    )
    # a window holds one row for each partition at most
    parts = Window.partitionBy("g")
    starts = (
        placed.groupBy("g", "part")
        .agg(F.count("*").alias("here"), F.min("row").alias("least"))
        .withColumns(
            {
                "before": F.coalesce(
                    F.sum("here").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "n": F.sum("here").over(parts),
            }
        )
    )
    return (
        placed.join(starts, ["g", "part"])
        .withColumn("pos", F.col("before") + F.col("row") - F.col("least"))
        .drop("part", "row", "here", "least", "before")
    )


def ways(nodes: DataFrame, label: str) -> DataFrame:
    """(g, idx, way, top) of every node (g, idx, hash, n): hashes left and right on its way up, and the last hash.

    ``n`` is the number of nodes of g; g and idx name a node. Levels are written one after the other, a
    sixteenth of the rows each time, and read down again from the top.
    """
    runs: list[DataFrame] = []
    level = nodes.select("g", "idx", "hash", "n")
    ended = [level]
    while level.filter("n > 1").limit(1).count():
        joined = F.col("kids.hash")
        run = (
            level.filter("n > 1")
            .groupBy("g", F.expr(f"idx div {FANOUT}").alias("up"))
            .agg(
                F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("kids"),  # FANOUT at most
                F.expr(f"(any_value(n) + {FANOUT - 1}) div {FANOUT}").alias("n"),
            )
            .withColumn("hash", F.sha2(F.concat_ws("", joined), 256))
        )
        runs.append(staged(run, f"{label}-level{len(runs) + 1}"))
        level = runs[-1].select("g", F.col("up").alias("idx"), "hash", "n")
        ended.append(level)
    none = F.array().cast(f"array<{_STEP}>")

    def finished(rows: DataFrame) -> DataFrame:
        return rows.filter("n = 1").select("g", "idx", none.alias("way"), F.col("hash").alias("top"))

    found = finished(ended.pop())
    while runs:
        step = F.struct(
            F.concat_ws("", F.expr("transform(filter(kids, k -> k.idx < kid.idx), k -> k.hash)")).alias("lft"),
            F.concat_ws("", F.expr("transform(filter(kids, k -> k.idx > kid.idx), k -> k.hash)")).alias("rgt"),
        )
        below = (
            runs.pop()
            .join(found.withColumnRenamed("idx", "up"), ["g", "up"])
            .withColumn("kid", F.explode("kids"))
            .select("g", F.col("kid.idx").alias("idx"), F.concat(F.array(step), "way").alias("way"), "top")
        )
        found = staged(below.unionByName(finished(ended.pop())), f"{label}-ways{len(runs)}")
    return found


def _height(n: int, most: int) -> int:
    """Levels within a block of ``most`` levels, in a tree of ``n`` leaves."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _block_tops(blocks: DataFrame, most: int) -> DataFrame:
    """The top node of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, sizes = batch.column("leaves").to_pylist(), batch.column("n").to_pylist()
            trees = (PersistentTree([x["leaf"] for x in row], _height(n, most)) for row, n in zip(leaves, sizes))
            tops = [t.hashes[t.top] for t in trees]
            yield pa.RecordBatch.from_pydict(
                {"g": batch.column("g"), "idx": batch.column("idx"), "hash": pa.array(tops, pa.string())}
                | {"n": batch.column("n")}
            )

    out = blocks.select("g", "idx", "n", "leaves").transform(shipped)
    return out.mapInArrow(tidy(run), "g string, idx bigint, hash string, n bigint")


def _fold(node: str, way: list[dict[str, str]]) -> list[str]:
    """Copies of the ancestors above a block, from its top node on."""
    out = [node]
    for step in way:
        out.append(hashed([step["lft"], out[-1], step["rgt"]]))
    return out


def _block_rows(row: dict, most: int, with_nodes: bool) -> Iterator[tuple]:
    """The leaves of a block with proof and version."""
    tree = PersistentTree([x["leaf"] for x in row["leaves"]], _height(row["n"], most))
    way = row["way"] + row["over"]
    above = [half for step in way for half in (step["lft"], step["rgt"])]
    untouched = _fold(tree.hashes[tree.top], way)
    for at, leaf in enumerate(row["leaves"]):
        beside = tree.siblings(at) + above
        copies: list[str] = []
        if leaf["altered"] is None:
            folded = untouched[-1]
        else:
            copies = [tree.hashes[k] for k in tree.replaced(at, leaf["altered"])]
            copies += _fold(copies[-1], way)[1:]
            folded = copies[-1]
        found = (leaf["doc_id"], row["g"][1:] or None, leaf["leaf"], row["subroot"], row["root"], hashed(beside), folded)
        yield (*found, beside, copies) if with_nodes else found


def manifest(
    docs: DataFrame, altered: Column, tampered: Column, fields: Sequence[str] = FIELDS, with_nodes: bool = False
) -> DataFrame:
    """Leaf, subroot, root, proof and folded root of every row of ``docs``.

    ``fields`` are the columns of a leaf, in order. Where ``tampered``, the last field is ``altered`` in a version of its own. With
    ``with_nodes`` also ``siblings`` (the hashes of the proof; those of a run above the block as one string for
    each side) and ``copies``, the hashes that a version does not share: its leaf and copied ancestors up to the root.
    """
    most, size = BLOCK_LEVELS, FANOUT**BLOCK_LEVELS
    now = {name: F.col(name) for name in fields}
    then = now | {fields[-1]: altered}
    g = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    leaves = numbered(
        docs.select(
            g.alias("g"), "doc_id", leaf_hash(now).alias("leaf"), F.when(tampered, leaf_hash(then)).alias("altered")
        ),
        ["doc_id", "leaf"],
        "leaves",
    )
    blocks = staged(
        leaves.groupBy("g", F.expr(f"pos div {size}").alias("idx"))
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "altered"))).alias("leaves"),  # a block
            F.any_value("n").alias("n"),
        ),
        "blocks",
    )
    tops = staged(_block_tops(blocks, most), "tops").withColumn("n", F.expr(f"(n + {size - 1}) div {size}"))
    up = ways(tops, "source")
    subroots = numbered(
        up.filter("idx = 0").select(F.lit("").alias("g"), F.col("g").alias("source"), F.col("top").alias("hash")),
        ["source"],
        "subroots",
    ).withColumnRenamed("pos", "idx")
    subroots = staged(subroots, "numbered-subroots")
    over = ways(subroots, "top").join(subroots.select("idx", "source"), "idx")
    placed = blocks.join(up.withColumnRenamed("top", "subroot"), ["g", "idx"]).join(
        over.select(F.col("source").alias("g"), F.col("way").alias("over"), F.col("top").alias("root")), "g"
    )
    names = "doc_id source leaf subroot root proof_sha256 folded_root".split()
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["string"] * 6]
    if with_nodes:
        names, kinds = [*names, "siblings", "copies"], [*kinds, *["array<string>"] * 2]
    out = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("leaves").type.value_type.field("doc_id").type, *[pa.string()] * 6]
            types += [pa.list_(pa.string())] * (len(names) - len(types))
            for lo in range(0, batch.num_rows, TOGETHER):
                rows = [x for b in batch.slice(lo, TOGETHER).to_pylist() for x in _block_rows(b, most, with_nodes)]
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = placed.select("g", "leaves", "n", "way", "over", "subroot", "root").transform(shipped)
    return rows.mapInArrow(tidy(run), out).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof against the root; a fifth of them, by key, checked after lowering A-Z."""
    docs = read(spark, sf_dir, "documents")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest(docs, lowered(F.col("text")), picked).drop("source")


def _field(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = " || ".join(_field(name) for name in FIELDS)
_ALTERED = " || ".join(
    _field(name, f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')" if name == "text" else None)
    for name in FIELDS
)
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda a, x: list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def _levels(name: str, start: str) -> str:
    return f"""{name} AS ({start} UNION ALL
  SELECT l + 1, g, idx // 16, (any_value(m) + 15) // 16, sha256(string_agg(hash, '' ORDER BY idx)) FROM {name} WHERE m > 1 GROUP BY l, g, idx // 16)"""


def _steps(tier: int, items: str, nodes: str) -> str:
    return f"""SELECT d.id, {tier} AS tier, t.l, coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx < t.idx), '') AS lft,
  coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (s.idx > t.idx), '') AS rgt
  FROM {items} d JOIN {nodes} t ON t.g = d.g AND t.m > 1 AND t.idx = d.pos // CAST(pow(16, t.l) AS BIGINT)
  JOIN {nodes} s ON s.g = t.g AND s.l = t.l AND s.idx // 16 = t.idx // 16 GROUP BY d.id, t.l"""


SQL = f"""WITH RECURSIVE
doc AS (SELECT doc_id, coalesce('+' || source, '') AS g, sha256({_LEAF}) AS leaf,
  CASE WHEN {_CRC} % 5 = 0 THEN sha256({_ALTERED}) END AS altered FROM documents),
item AS (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS id,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM doc),
{_levels("low", "SELECT 0 AS l, g, pos AS idx, count(*) OVER (PARTITION BY g) AS m, leaf AS hash FROM item")},
sub AS (SELECT g AS src, hash AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE m = 1),
{_levels("high", "SELECT 0 AS l, '' AS g, pos AS idx, count(*) OVER () AS m, subroot AS hash FROM sub")},
up AS (SELECT id, '' AS g, sub.pos FROM item JOIN sub ON src = item.g),
step AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, l) AS k FROM ({_steps(0, "item", "low")} UNION ALL {_steps(1, "up", "high")})),
fold AS (SELECT id, CAST(0 AS BIGINT) AS k, coalesce(altered, leaf) AS h FROM item UNION ALL
  SELECT f.id, s.k, sha256(s.lft || f.h || s.rgt) FROM fold f JOIN step s ON s.id = f.id AND s.k = f.k + 1),
proof AS (SELECT id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY id),
folded AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id)
SELECT doc_id, leaf, subroot, hash AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = hash AS verified
FROM item JOIN sub ON src = item.g JOIN folded USING (id) LEFT JOIN proof USING (id), (SELECT hash FROM high WHERE m = 1)"""
