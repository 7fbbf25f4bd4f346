"""Encoding and decoding with a given byte-pair vocabulary, by an index of pair occurrences.

The distinct words of a partition are laid out as one chain of symbols. An index maps each
mergeable pair to all its positions; active ranks are taken in ascending order, each merging
all its positions at once and adding the pairs that arise to the lists of their ranks. A
pair that contains a merged symbol has a later rank than the merge that made the symbol, so
one ascending pass is complete. Texts are then gathered from the words' ids. Nothing is
shuffled, and a partition's state is bounded: the table of words is emptied when it is full.

The vocabulary file gives words by a fixed pattern, in lower case, as bytes with a word end;
special tokens are recognised in the raw text. Decoding joins the tokens by a space, as a
vocabulary without a decoder asks for.

Defined cases: null text is empty; an empty text has no tokens and decodes to the empty
text; very long texts and very long words are encoded whole (a word costs n log n at most).
Repeated rows are encoded one by one; extra columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import passes, read, shipped, text_bytes, tidy

#: Words that a worker remembers between batches.
KNOWN_WORDS = 120_000
#: Text bytes encoded at once.
BATCH_BYTES = 1_500_000

_WORD = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Pair ranks, pieces and special tokens of a byte-pair vocabulary with word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        ids: dict[str, int] = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        chars = byte_characters()
        self.inner = [ids[c] for c in chars]
        self.final = [ids[c + suffix] for c in chars]
        self.pieces = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in ids.items():
            self.pieces[i] = piece.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.pieces[i] = piece.encode()
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.rank: dict[int, int] = {}
        self.left, self.right, self.merged = [], [], []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.merged.append(ids[a + b])
            self.rank[ids[a] << 20 | ids[b]] = r
        self.known: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        self.known.clear()
        self.flat = np.zeros(0, dtype=np.uint32)
        self.begin = np.zeros(1, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet and remember their ids."""
        symbols, ends = self.merge([w.encode("utf-8", "surrogatepass") for w in words])
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words))))
        self.begin = np.concatenate([self.begin, ends + self.begin[-1]])
        self.flat = np.concatenate([self.flat, symbols])

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids end."""
        sym: list[int] = []
        last: list[int] = []
        inner, final = self.inner, self.final
        for w in words:
            sym.extend([inner[b] for b in w[:-1]])
            sym.append(final[w[-1]])
            last.append(len(sym) - 1)
        n = len(sym)
        follower = list(range(1, n + 1))
        leader = list(range(-1, n - 1))
        for i in last:
            follower[i] = -1
            if i + 1 < n:
                leader[i + 1] = -1
        find = self.rank.get
        index: dict[int, list[int]] = {}
        for i, j in enumerate(follower):
            if j > 0:
                r = find(sym[i] << 20 | sym[j])
                if r is not None:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.merged[r]
            for i in sorted(index.pop(r)):
                if sym[i] != a:
                    continue
                j = follower[i]
                if j < 0 or sym[j] != b:
                    continue
                sym[i] = c
                sym[j] = -1
                k = follower[i] = follower[j]
                if k >= 0:
                    leader[k] = i
                    s = find(c << 20 | sym[k])
                    if s is not None:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heapq.heappush(active, s)
                h = leader[i]
                if h >= 0:
                    s = find(sym[h] << 20 | c)
                    if s is not None:
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heapq.heappush(active, s)
        found = np.array(sym, dtype=np.int64)
        left = found >= 0
        total = np.cumsum(left)
        return found[left].astype(np.uint32), total[np.array(last, dtype=np.int64)]

    def parts(self, text: str) -> list[str]:
        """Words of ``text`` in order; special tokens stand for themselves."""
        if self.special_pattern is None or "<|" not in text and not self.special_pattern.search(text):
            return _WORD.findall(normal(text))
        out: list[str] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += _WORD.findall(normal(text[at : m.start()]))
            out.append("\0" + m[0])  # no word has a NUL before a letter or symbol of this kind
            at = m.end()
        return out + _WORD.findall(normal(text[at:]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        lists = [self.parts(t) for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        fresh = set().union(*lists) - self.known.keys() if lists else set()
        marks = [w for w in fresh if w[0] == "\0" and w[1:] in self.special]
        if fresh:
            self.learn(sorted(fresh.difference(marks)))
        for w in marks:
            self.known[w] = len(self.begin) - 1
            self.flat = np.append(self.flat, np.uint32(self.special[w[1:]]))
            self.begin = np.append(self.begin, self.begin[-1] + 1)
        out = []
        for words in lists:
            if not words:
                out.append(np.zeros(0, dtype=np.uint32))
                continue
            w = np.array(list(map(self.known.__getitem__, words)), dtype=np.int64)
            start, size = self.begin[w], self.begin[w + 1] - self.begin[w]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(start - end + size, size) + np.arange(end[-1])])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b" ".join(map(self.pieces.__getitem__, ids.tolist()))


def normal(text: str) -> str:
    """Composed characters in lower case, each by itself."""
    if text.isascii():
        return text.lower()
    # a capital sigma is lowered without regard to its place in the word
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_open: dict[int, Vocabulary] = {}


def opened(text: str) -> Vocabulary:
    """The vocabulary of a file's content, parsed once in each worker."""
    key = hash(text)
    if key not in _open:
        _open.clear()
        _open[key] = Vocabulary(text)
    return _open[key]


def _ids_column(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _mapped(docs: DataFrame, path: str, out: str, names: list[str], make) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = opened(shared.value)
        for batch in batches:
            column = text_bytes(batch.column("text"))
            for lo, hi in passes(column, BATCH_BYTES):
                ids = vocabulary.encode([t.decode("utf-8", "replace") for t in column[lo:hi]])
                kept = {name: batch.column(name).slice(lo, hi - lo) for name in names}
                yield pa.RecordBatch.from_pydict(kept | make(vocabulary, ids))
        vocabulary.forget()

    return docs.select(*dict.fromkeys([*names, "text"])).transform(shipped).mapInArrow(tidy(run), out)


def _kept(docs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(names).schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int), by the vocabulary file at ``path`` on the driver."""
    names = [c for c in docs.columns if c != "ids"]
    return _mapped(
        docs, path, f"{_kept(docs, names)}, ids array<int>", names, lambda v, ids: {"ids": _ids_column(ids)}
    )


def digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them; the ids too."""

    def make(vocabulary: Vocabulary, found: list[np.ndarray]) -> dict[str, pa.Array]:
        decoded = (vocabulary.decode(ids) for ids in found)
        ids = {"ids": _ids_column(found)} if with_ids else {}
        return ids | {
            "n_tokens": pa.array([len(i) for i in found], pa.int64()),
            "ids_sha256": pa.array(
                [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in found], pa.string()
            ),
            "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
        }

    ids = "ids array<int>, " if with_ids else ""
    out = f"{_kept(docs, ['doc_id'])}, {ids}n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, path, out, ["doc_id"], make)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the text decoded from them, as digests."""
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
