"""Alignment of two tokenizers' tokens over the same bytes, as Arrow tables.

Texts are taken in chunks of about ``CHUNK_BYTES``. In a chunk the ids of both tokenizers are two list columns: flattened with
parent indices, their byte lengths become ends by cumulative sums taken back to each document's start. An Acero
full outer join of the ends on keys of document and end gives every piece of text between two neighbouring ends once; filled backwards it
names the A and the B token that cover it, which is one link, and an end that both sides have closes a group.
``Table.group_by`` counts the documents that hold an id pair linked within the chunk; Spark adds these partial
counts up and finds each A id's highest. A chunk gets back the counts of just its own pairs, so nothing
is broadcast, and a pair that every document holds is one row in each chunk.

Defined cases: a null or empty text, and one whose tokens do not give back a space and the text,
has no tokens: zeros and an empty string. Every row is a document, repeated rows and null ids too. Very long texts are encoded
whole and are a chunk of their own. An empty table has no rows. Only doc_id and text are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bpe import byte_characters
from tickloom.llm.common import passes, read, shipped, staged, text_bytes, tidy

#: Text bytes of one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Rows of totals are copied so often, and partial counts dealt to the copies by chunk: a pair that all chunks hold is split.
SALTS = 4


class ByteLevel:
    """The tokenizer of a byte-level BPE file; ``tokens`` are the bytes of its ids.

    The file's merges make ids in ascending order, so an id is the rank of its merge, and a rank encoder gives
    the ids of the file; other files are encoded by their own library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.tokens = [
            bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
            for t in (tokens.get(i, "") for i in range(max(tokens) + 1))
        ]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        vocabulary = spec["model"]["vocab"]
        if all(vocabulary[x + y] == 256 + i for i, (x, y) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            special = {x["id"] for x in spec.get("added_tokens", [])}
            ranks = {t: i for i, t in enumerate(self.tokens) if i not in special}
            ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._ids = lambda texts: [ranked.encode_ordinary(t) for t in texts]
        else:
            self._ids = _by_library(path)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._ids([" " + t for t in texts])


def _by_library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True  # their strings in a text are plain text
    library.no_truncation()
    library.no_padding()
    return lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """The tokenizer of a sentence-piece model with byte fallback, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.tokens.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.tokens.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


_open: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def opened(paths: tuple[str, str]) -> tuple[ByteLevel, Pieces]:
    """Both tokenizers, loaded once in each worker."""
    if paths not in _open:
        _open[paths] = (ByteLevel(paths[0]), Pieces(paths[1]))
    return _open[paths]


def _lists(ids: list[list[int]]) -> pa.ListArray:
    return pa.array(ids, pa.list_(pa.int32()))


def _sized(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


#: A document's number in a chunk stands above this many bits of a place in its text.
_PLACE_BITS = 40


def _ends(ids: pa.ListArray, tokens: pa.Array, name: str) -> pa.Table:
    """(at, id) of every token: its document and its end there, cumulative lengths less those of earlier documents."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    size = pc.cast(pc.take(pc.binary_length(tokens), flat), pa.int64())
    running = pc.cumulative_sum(size)
    # bytes of all tokens before a document's first
    before = np.concatenate(([0], running.to_numpy()))[ids.offsets.to_numpy()[:-1]]
    end = pc.subtract(running, pc.take(pa.array(before), doc))
    at = pc.add(pc.shift_left(pc.cast(doc, pa.int64()), _PLACE_BITS), end)
    return pa.table({"at": at, name: flat})


def _sound(ids: pa.ListArray, tokens: pa.Array, want: pa.Array) -> pa.Array:
    """Whether the joined bytes of a document's tokens are the text with a space before it."""
    parts = _sized(ids.offsets.to_numpy(), pc.take(tokens, pc.list_flatten(ids)))
    return pc.equal(pc.binary_join(parts, b""), want)


def links(a: pa.ListArray, b: pa.ListArray, tokens_a: pa.Array, tokens_b: pa.Array) -> pa.Table:
    """(doc, a, b, ends_a, ends_b), in order: a row for every pair of overlapping tokens, and which of them end it.

    Both sides end at the same byte of a document, so filling backwards never leaves it.
    """
    left, right = _ends(a, tokens_a, "a"), _ends(b, tokens_b, "b")
    found = left.join(right, keys="at", join_type="full outer", use_threads=False).sort_by("at")
    ids = {n: found[n].combine_chunks() for n in "ab"}
    return pa.table(
        {"doc": pc.shift_right(found["at"].combine_chunks(), _PLACE_BITS)}
        | {n: pc.fill_null_backward(c) for n, c in ids.items()}
        | {f"ends_{n}": pc.is_valid(c) for n, c in ids.items()}
    )


def _joined_groups(ids: pa.ListArray, ended: pa.Array, closes: pa.Array) -> pa.Array:
    """The ids of each group, comma-joined: a group ends after the tokens of a side that have ended so far."""
    so_far = np.cumsum(ended.to_numpy(zero_copy_only=False))
    offsets = np.concatenate(([0], so_far[closes.to_numpy(zero_copy_only=False)]))
    return pc.binary_join(_sized(offsets, pc.cast(pc.list_flatten(ids), pa.string())), ",")


def _per_document(doc: pa.Array, n: int) -> np.ndarray:
    """Offsets of each document's rows in rows that are in order of documents."""
    return np.concatenate(([0], np.cumsum(np.bincount(doc.to_numpy(), minlength=n))))


def group_texts(a: pa.ListArray, b: pa.ListArray, found: pa.Table) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    ended = [found[f"ends_{n}"].combine_chunks() for n in "ab"]
    closes = pc.and_(*ended)
    left, right = (_joined_groups(ids, e, closes) for ids, e in zip((a, b), ended))
    groups = pc.binary_join_element_wise(left, right, "|")
    return pc.binary_join(_sized(_per_document(found["doc"].filter(closes), len(a)), groups), ";")


def _chunk(texts: list[bytes], tools: tuple[ByteLevel, Pieces], tokens: tuple[pa.Array, pa.Array], with_groups: bool):
    """Columns of a chunk's documents, and its distinct pairs with their document counts."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    a, b = (_lists(tool.encode(strings)) for tool in tools)
    want = pa.array([b" " + t for t in texts], pa.binary())
    sound = pc.and_(_sound(a, tokens[0], want), _sound(b, tokens[1], want))
    sound = pc.and_(sound, pc.greater(pc.binary_length(want), 1))
    none = pa.scalar([], pa.list_(pa.int32()))
    a, b = pc.if_else(sound, a, none), pc.if_else(sound, b, none)
    found = links(a, b, *tokens)
    groups = group_texts(a, b, found).to_pylist()
    closing = found.filter(pc.and_(found["ends_a"], found["ends_b"]))
    # a pair of ids as one number, and the distinct ones of the chunk
    whole = pc.add(pc.shift_left(pc.cast(found["a"], pa.int64()), 32), pc.cast(found["b"], pa.int64()))
    coded = pc.dictionary_encode(whole.combine_chunks())
    linked = pa.table({"doc": found["doc"], "pair": coded.indices})
    held = linked.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    held = held.sort_by([("doc", "ascending"), ("pair", "ascending")])
    counts = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
    pairs = pa.table(
        {
            "a": pc.cast(pc.shift_right(coded.dictionary, 32), pa.int32()),
            "b": pc.cast(pc.bit_wise_and(coded.dictionary, (1 << 32) - 1), pa.int32()),
            "docs": counts["count_all"],
        }
    )
    at = _per_document(held["doc"], len(texts))
    held_pairs = pc.cast(held["pair"].combine_chunks(), pa.int32())
    held_times = pc.cast(held["count_all"].combine_chunks(), pa.int32())
    documents = {
        "n_a": pc.cast(pc.list_value_length(a), pa.int64()),
        "n_b": pc.cast(pc.list_value_length(b), pa.int64()),
        "n_groups": pa.array(np.diff(_per_document(closing["doc"], len(texts)))),
        "n_links": pa.array(np.diff(_per_document(found["doc"], len(texts)))),
        "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
        "held": _sized(at, held_pairs),
        "times": _sized(at, held_times),
    }
    return documents | ({"groups": pa.array(groups, pa.string())} if with_groups else {}), pairs


_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, held array<int>, times array<int>"
#: The row that holds a chunk's pairs instead of a document.
_PAIRS = "a array<int>, b array<int>, docs array<bigint>"


def _encoded(docs: DataFrame, paths: tuple[str, str], with_groups: bool) -> DataFrame:
    """Written chunks: a row for each document, and one with the pairs of the chunk."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    out = f"chunk string, doc_id {doc_id}, {_DOC}{', groups string' if with_groups else ''}, {_PAIRS}"
    names = [part.split()[0] for part in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools = opened(paths)
        tokens = tuple(pa.array(t.tokens, pa.binary()) for t in tools)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for lo, hi in passes(column, CHUNK_BYTES):
                documents, pairs = _chunk(column[lo:hi], tools, tokens, with_groups)
                documents["doc_id"] = ids.slice(lo, hi - lo)
                size, name = hi - lo, f"{part}-{number}"
                number += 1
                everything = np.array([0, pairs.num_rows])
                whole = {n: _sized(everything, pairs[n].combine_chunks()) for n in ("a", "b", "docs")}
                no_pairs = {n: pa.nulls(size, c.type) for n, c in whole.items()}
                rows = pa.table({"chunk": pa.array([name] * size), **documents, **no_pairs})
                row = pa.table(
                    {"chunk": pa.array([name])} | {n: pa.nulls(1, c.type) for n, c in documents.items()} | whole
                )
                for table in (rows, row):
                    yield from table.select(names).to_batches()

    return staged(docs.select("doc_id", "text").transform(shipped).mapInArrow(tidy(run), out), "aligned")


def _scores(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a chunk with the sums over their links; ``right`` has total and best of the chunk's pairs."""
    right = right.sort_by("pair")
    held = left["held"].combine_chunks()
    doc, pair = pc.list_parent_indices(held), pc.list_flatten(held)
    times = pc.cast(pc.list_flatten(left["times"].combine_chunks()), pa.int64())
    total = pc.multiply(times, pc.take(right["total"], pair))
    best = pc.multiply(times, pc.cast(pc.take(right["best"], pair), pa.int64()))
    summed = pa.table({"doc": doc, "total": total, "best": best}).group_by("doc").aggregate([("total", "sum"), ("best", "sum")])
    place = pc.index_in(pa.array(np.arange(left.num_rows)), pc.cast(summed["doc"].combine_chunks(), pa.int64()))
    columns = {n: left[n] for n in left.column_names if n not in ("of", "held", "times")}
    for name, source in (("n_best", "best_sum"), ("count_sum", "total_sum")):
        columns[name] = pc.fill_null(pc.take(summed[source].combine_chunks(), place), 0)
    return pa.table(columns)


def aligned(docs: DataFrame, paths: tuple[str, str], with_groups: bool = False) -> DataFrame:
    """Per document: tokens, groups and links of both tokenizers, and its links' document counts over all ``docs``.

    doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; ``groups`` too where asked. ``paths``
    are the files of a byte-level BPE and of a sentence-piece model, at the same place on every worker.
    """
    chunks = _encoded(docs, paths, with_groups)
    partial = chunks.filter("a IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pair", "x"))
    partial = partial.select("chunk", "pair", "x.*")
    counts = partial.groupBy("a", "b").agg(F.sum("docs").alias("total"))
    highest = counts.groupBy("a").agg(F.max("total").alias("highest"))  # rows are pairs, at most a vocabulary for an id
    totals = staged(
        counts.join(highest, "a").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best")), "pair-counts"
    )
    salted = totals.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    found = partial.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    kept = [c for c in chunks.columns if c not in ("a", "b", "docs")]
    documents = chunks.filter("a IS NULL").select(kept).withColumnRenamed("chunk", "of")
    fields = {f.name: f.dataType.simpleString() for f in documents.schema if f.name not in ("of", "held", "times")}
    out = ", ".join(f"{n} {t}" for n, t in fields.items()) + ", n_best bigint, count_sum bigint"
    return (
        documents.groupBy("of")
        .cogroup(found.select("chunk", "pair", "total", "best").groupBy("chunk"))
        .applyInArrow(_scores, out)
    )


def model_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte-level and sentence-piece tokens in every document."""
    return aligned(read(spark, sf_dir, "documents").select("doc_id", "text"), model_paths())
