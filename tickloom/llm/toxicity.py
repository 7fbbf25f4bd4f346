"""Toxicity scores from a convolutional text classifier trained in numpy.

A word's embedding is the sum of a row for the hashed word and one for its hashed beginning,
so that a compound counts with the word that it begins with; filters of widths 1, 2 and 3 slide over the words, the
maximum of each filter over the whole text feeds a logistic unit. A word's products with a
filter's rows are tabulated, so scoring a text is gather, add and segmented maximum.

The decision threshold is calibrated for each language (as identified from the text alone,
by ``language_id``) and folded into the score, so that 0.5 is the threshold everywhere.

Every labelled text is learned: four fifths of the keys, by hash, train the network, the last
fifth sets the thresholds. The network is trained by parameter mixing: in each epoch every shard
of about ``SHARD`` texts starts from the common network and streams its texts through stochastic
gradient descent; Spark sums the shards' moves, and a parameter moves by their mean over the shards
that touched it. Moves travel as whole multiples of a small step, so their sums do not depend on
the order of tasks. Thresholds come from counts of all calibration texts by language, label and
logit, in steps of ``1 / STEPS``. The driver gets sums by parameter and counts by step, no text.
Scoring reads every row and every word. Only the language model, ``language_id.fit``, keeps its sample.

Defined cases: null and empty texts have no words and get the score of the bias alone;
labels that are null take no part; a key labelled twice is toxic if one label says so; of
texts that share a key the least is learned; without both
classes in the labels every score is 0. Ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import language_id
from tickloom.llm.common import dropped, key_remainder, passes, read, shipped, staged, text_bytes, tidy
from tickloom.llm.words import word_hashes

#: Hashed words in the first half, beginnings of words in the second half; one more row
#: stands for the gap between texts.
VOCABULARY = 1 << 18
#: Bytes of a word's beginning.
PREFIX = 4
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Labelled texts that one shard of the training streams in an epoch, about.
SHARD = 4_000
#: Labelled keys that are broadcast at most; beyond it both sides are shuffled.
BROADCAST_KEYS = 2_000_000
EPOCHS = 12
#: Texts of one gradient step, and words beyond which it is cut.
BATCH, BATCH_WORDS = 128, 500_000
#: A word in fewer texts to train on than this keeps a zero embedding.
LEAST_TEXTS = 3
#: Steps of a logit at which thresholds may lie, and the largest logit told apart.
STEPS, FARTHEST = 1024, 200
#: Steps of one of a parameter's move and of its squared gradients, as sums of shards.
MOVE, POWER = 2.0**32, 2.0**36
#: Positive texts that a language needs for a threshold of its own.
LEAST_POSITIVE = 25


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words and of their beginnings, with a gap of the widest filter after each text,
    and each text's start."""
    word, first = embedding_rows(texts)
    return spaced(word, np.diff(np.append(first, word.shape[1])))


def embedding_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two embedding rows for each word, and the index of each text's first word."""
    whole, head, first = word_hashes(texts, PREFIX)
    half = VOCABULARY // 2
    shift = np.uint64(64 - half.bit_length() + 1)
    return np.stack([whole >> shift, (head >> shift) + np.uint64(half)]).astype(np.int32), first


def spaced(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = WIDTHS[-1]
    begin = np.cumsum(counts + gap) - counts - gap
    n = word.shape[1]
    out = np.full((2, n + gap * (len(counts) + 1)), VOCABULARY, dtype=np.int32)
    out[:, np.arange(n) + gap * np.repeat(np.arange(len(counts)), counts)] = word
    return out, begin


@dataclass
class Network:
    embedding: np.ndarray  # VOCABULARY + 1 by DIMENSIONS, the last row zero
    kernels: list[np.ndarray]  # by width: width, DIMENSIONS, FILTERS
    shifts: list[np.ndarray]  # by width: FILTERS
    out: np.ndarray
    bias: np.ndarray  # one value

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.kernels, *self.shifts, self.out, self.bias]

    def copy(self) -> Network:
        own = lambda parts: [x.copy() for x in parts]
        return Network(self.embedding.copy(), own(self.kernels), own(self.shifts), self.out.copy(), self.bias.copy())

    def tables(self, rows: np.ndarray | None = None) -> list[list[np.ndarray]]:
        """By width and offset: FILTERS by word, the word's share of each filter."""
        e = self.embedding if rows is None else self.embedding[rows]
        return [[np.ascontiguousarray((e @ k).T) for k in kernel] for kernel in self.kernels]

    def logits(self, word: np.ndarray, begin: np.ndarray, tables) -> np.ndarray:
        """One logit for each text; texts are followed by a gap, so windows never cross them."""
        z = np.full(len(begin), self.bias[0])
        if not len(begin):
            return z
        for k, width in enumerate(WIDTHS):
            n = word.shape[1] - width + 1
            for f in range(FILTERS):
                value = filtered(tables[k], f, word, n)
                top = np.maximum.reduceat(value, begin) + self.shifts[k][f]
                z += self.out[k * FILTERS + f] * np.maximum(top, 0)
        return z


def filtered(tables: list[np.ndarray], f: int, word: np.ndarray, n: int) -> np.ndarray:
    """Filter ``f`` at each of the first ``n`` words."""
    value = np.zeros(n, dtype=np.float32)
    for j, table in enumerate(tables):
        for rows in word:
            value += table[f][rows[j : n + j]]
    return value


def untrained(seen: np.ndarray) -> tuple[Network, np.ndarray]:
    """A network to begin with, and which of its embedding rows never move."""
    draw = np.random.default_rng(11)
    embedding = draw.normal(0, 0.1, (VOCABULARY + 1, DIMENSIONS)).astype(np.float32)
    fixed = seen < LEAST_TEXTS
    fixed[VOCABULARY] = True
    embedding[fixed] = 0
    net = Network(
        embedding,
        [draw.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw.normal(0, 0.3, len(WIDTHS) * FILTERS),
        np.zeros(1),
    )
    return net, fixed


def descend(
    net: Network, power: list[np.ndarray], fixed: np.ndarray, texts: list[np.ndarray], label: np.ndarray,
    weight: np.ndarray, rate: float,
) -> np.ndarray:
    """One gradient step in place, with step sizes by parameter; returns the embedding rows that moved."""
    parts = net.parts
    counts = np.array([t.shape[1] for t in texts])
    word, begin = spaced(np.concatenate(texts, axis=1), counts)
    own, local = np.unique(word, return_inverse=True)
    local = local.reshape(word.shape)
    tables = net.tables(own)
    pooled, where = [], []
    for k, width in enumerate(WIDTHS):
        n = word.shape[1] - width + 1
        for f in range(FILTERS):
            value = filtered(tables[k], f, local, n)
            top = np.maximum.reduceat(value, begin)
            equal = np.flatnonzero(value == np.repeat(top, np.diff(np.append(begin, n))))
            where.append(equal[np.searchsorted(equal, begin)])
            pooled.append(top + net.shifts[k][f])
    pooled_m = np.array(pooled)
    active = np.maximum(pooled_m, 0)
    p = 1 / (1 + np.exp(-np.clip(net.out @ active + net.bias[0], -50, 50)))
    delta = (p - label) * weight / len(texts)
    grad = [np.zeros_like(x) for x in parts[1:]]
    grad[-2][:] = active @ delta + 1e-4 * net.out
    grad[-1][:] = delta.sum()
    back = net.out[:, None] * delta[None, :] * (pooled_m > 0)
    touched, pulls = [], []
    for k, width in enumerate(WIDTHS):
        for f in range(FILTERS):
            c = k * FILTERS + f
            grad[len(WIDTHS) + k][f] = back[c].sum()
            for j in range(width):
                pull = back[c][:, None] * net.kernels[k][j, :, f][None, :]
                for rows_of in word:
                    at = rows_of[where[c] + j]
                    touched.append(at)
                    pulls.append(pull)
                    grad[k][j, :, f] += back[c] @ net.embedding[at]
    ids, slot = np.unique(np.concatenate(touched), return_inverse=True)
    pull = np.zeros((len(ids), DIMENSIONS))
    np.add.at(pull, slot, np.concatenate(pulls))
    pull[fixed[ids]] = 0
    power[0][ids] += pull**2
    net.embedding[ids] -= rate * pull / np.sqrt(power[0][ids])
    for x, s, g in zip(parts[1:], power[1:], grad):
        s += g * g
        x -= rate * g / np.sqrt(s)
    return ids[~fixed[ids]]


def _others(parts: list[np.ndarray]) -> np.ndarray:
    """All parameters but the embedding, in rows as long as one of its."""
    flat = np.concatenate([x.ravel().astype(np.float64) for x in parts[1:]])
    return np.append(flat, np.zeros(-len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)


def _change(parts: list[np.ndarray], before: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """By embedding row of ``ids``, then by row of the others, how far ``parts`` moved."""
    first = parts[0][ids].astype(np.float64) - before[0][ids]
    return np.concatenate([first, _others(parts) - _others(before)])


def _change_by(parts: list[np.ndarray], rows: np.ndarray, change: np.ndarray) -> None:
    """Move ``parts`` in place by what ``_change`` gave for ``rows``."""
    inner = rows <= VOCABULARY
    parts[0][rows[inner]] += change[inner]
    flat = np.zeros_like(_others(parts))
    flat[rows[~inner] - VOCABULARY - 1] = change[~inner]
    flat, at = flat.ravel(), 0
    for x in parts[1:]:
        x += flat[at : at + x.size].reshape(x.shape)
        at += x.size


_COLUMNS = [f"{kind}{i}" for kind in "mp" for i in range(DIMENSIONS)]


def _epoch(train: DataFrame, state: tuple, epoch: int) -> None:
    """Every shard of ``train`` (shard, toxic, word) trains for itself; ``state`` moves by the mean of their moves."""
    net, power, _, _ = state
    shared = train.sparkSession.sparkContext.broadcast(state)  # fixed size: VOCABULARY by DIMENSIONS
    rate = 0.08 * (1 - 0.8 * epoch / EPOCHS)

    def moves(net: Network, power: list[np.ndarray], moved: np.ndarray) -> pa.RecordBatch:
        old, grown, _, _ = shared.value
        ids = np.flatnonzero(moved)
        m = np.rint(_change(net.parts, old.parts, ids) * MOVE).astype(np.int64)
        p = np.rint(_change(power, grown, ids) * POWER).astype(np.int64)
        rows = np.append(ids, VOCABULARY + 1 + np.arange(len(m) - len(ids))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, m.T), *map(pa.array, p.T)], ["row", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, grown, fixed, weights = shared.value
        at = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            label = batch.column("toxic").to_numpy().astype(np.float64)
            words = [np.frombuffer(w, dtype=np.int32).reshape(2, -1) for w in batch.column("word").to_pylist()]
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if shards[lo] != at:
                    if at is not None:
                        yield moves(net, power, moved)
                    at, net, power = shards[lo], start.copy(), [x.copy() for x in grown]
                    moved = np.zeros(VOCABULARY + 1, dtype=bool)
                    draw = np.random.default_rng([epoch, int(at)])
                order = lo + draw.permutation(hi - lo)
                for step in _steps(order, words):
                    rows = [words[i] for i in step]
                    weight = np.where(label[step] > 0, weights[1], weights[0])
                    moved[descend(net, power, fixed, rows, label[step], weight, rate)] = True
        if at is not None:
            yield moves(net, power, moved)

    columns = ", ".join(f"{c} bigint" for c in _COLUMNS)
    each = train.transform(shipped).mapInArrow(tidy(run), f"row int, {columns}")
    sums = each.groupBy("row").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _COLUMNS)).toArrow()
    rows, n = sums["row"].to_numpy(), sums["n"].to_numpy()[:, None]
    mean = np.column_stack([sums[c].to_numpy() for c in _COLUMNS]) / n
    _change_by(net.parts, rows, mean[:, :DIMENSIONS] / MOVE)
    _change_by(power, rows, mean[:, DIMENSIONS:] / POWER)
    shared.unpersist()


def _steps(order: np.ndarray, words: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Texts of each gradient step: ``BATCH``, or fewer long ones."""
    start = size = 0
    for i, row in enumerate(order):
        size += words[row].shape[1]
        if i + 1 - start == BATCH or size > BATCH_WORDS:
            yield order[start : i + 1]
            start, size = i + 1, 0
    if start < len(order):
        yield order[start:]


def best_threshold(logit: np.ndarray, positive: np.ndarray, total: np.ndarray) -> float:
    """Logit with the highest F1, midway between neighbours, by how many texts have each logit."""
    order = np.argsort(-logit)
    z, hit, n = logit[order], np.cumsum(positive[order]), np.cumsum(total[order])
    f1 = 2 * hit / (n + hit[-1])
    k = int(f1.argmax())
    return float(z[k] - 0.5) if k + 1 == len(z) else float((z[k] + z[k + 1]) / 2)


@dataclass
class Model:
    network: Network | None
    languages: language_id.Model
    thresholds: dict[str, float]
    pooled: float

    def scores(self, texts: list[bytes], tables) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(texts))
        word, begin = tokens(texts)
        z = self.network.logits(word, begin, tables)
        spoken, _ = self.languages.predict(texts)
        z -= np.array([self.thresholds.get(x, self.pooled) for x in spoken])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def labelled(docs: DataFrame, labels: DataFrame, languages: language_id.Model, shard: int = SHARD) -> DataFrame:
    """(shard, held, toxic, spoken, word) of every labelled text, in an order by hash within its shard.

    ``held`` texts are those for the thresholds; only they have a language, ``spoken``.
    """
    marks = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    n = marks.count()
    shared = docs.sparkSession.sparkContext.broadcast(languages)  # FEATURES x classifiers, fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            # rows of a key follow each other, the least text first
            batch = batch.filter(pa.array([i != j for i, j in zip(ids, [last, *ids])], pa.bool_()))
            last = ids[-1] if ids else last
            texts = text_bytes(batch.column("text"))
            for lo, hi in passes(texts):
                part = batch.slice(lo, hi - lo)
                word, first = embedding_rows(texts[lo:hi])
                held = np.flatnonzero(part.column("held").to_numpy(zero_copy_only=False))
                spoken: list[str | None] = [None] * (hi - lo)
                for i, name in zip(held, shared.value.predict([texts[lo + i] for i in held])[0] if len(held) else []):
                    spoken[i] = name
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("shard"), part.column("held"), part.column("toxic"), pa.array(spoken, pa.string()),
                        pa.array([w.tobytes() for w in np.split(word, first[1:], axis=1)], pa.binary()),
                    ],
                    names=["shard", "held", "toxic", "spoken", "word"],
                )

    hashed = lambda name, m: F.pmod(F.xxhash64(F.lit(name), "doc_id"), F.lit(m))
    shards = max(1, round(n / shard))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(marks) if n <= BROADCAST_KEYS else marks, "doc_id").select(
        "doc_id", "text", F.col("toxic").cast("int").alias("toxic"), (hashed("calibration", 5) == 0).alias("held"),
        hashed("shard", shards).cast("int").alias("shard"), F.xxhash64(F.lit("order"), "doc_id").alias("draw"),
    )
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "draw", "doc_id", "text")
    schema = "shard int, held boolean, toxic int, spoken string, word binary"
    return staged(dealt.transform(shipped).mapInArrow(tidy(run), schema), "labelled")


def _seen(train: DataFrame) -> np.ndarray:
    """How many texts have each embedding row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(VOCABULARY + 1, dtype=np.int64)
        for batch in batches:
            for w in batch.column("word").to_pylist():
                seen[np.unique(np.frombuffer(w, dtype=np.int32))] += 1
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(seen[ids])], names=["row", "n"])

    each = train.select("word").transform(shipped).mapInArrow(tidy(run), "row int, n bigint")
    sums = each.groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(VOCABULARY + 1, dtype=np.int64)
    seen[sums["row"].to_numpy()] = sums["n"].to_numpy()
    return seen


def _logit_counts(held: DataFrame, net: Network):
    """spoken, step of the logit, toxic texts and all texts, over every row of ``held``."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in batches:
            raw = batch.column("word").to_pylist()
            for lo, hi in passes(raw):
                words = [np.frombuffer(w, dtype=np.int32).reshape(2, -1) for w in raw[lo:hi]]
                word, begin = spaced(np.concatenate(words, axis=1), np.array([w.shape[1] for w in words]))
                z = np.clip(shared.value.logits(word, begin, tables), -FARTHEST, FARTHEST)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("spoken"), pa.array(np.rint(z * STEPS).astype(np.int32)), part.column("toxic")],
                    names=["spoken", "step", "toxic"],
                )

    each = held.select("spoken", "toxic", "word").transform(shipped)
    each = each.mapInArrow(tidy(run), "spoken string, step int, toxic int")
    counts = each.groupBy("spoken", "step").agg(F.sum("toxic").alias("positive"), F.count("*").alias("total"))
    return counts.toPandas()


def fit(docs: DataFrame, labels: DataFrame, languages: language_id.Model, shard: int = SHARD) -> Model:
    """Learn from all of ``docs`` (doc_id, text) labelled by ``labels`` (doc_id, toxic).

    A fifth of the keys is kept for the thresholds.
    """
    rows = labelled(docs, labels, languages, shard)
    sizes = {(r["held"], int(r["toxic"])): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}
    if not (sizes.get((False, 0)) and sizes.get((False, 1))):
        return Model(None, languages, {}, 0.0)
    train = rows.filter("NOT held").select("shard", "toxic", "word")
    net, fixed = untrained(_seen(train))
    power = [np.full_like(p, 1e-4) for p in net.parts]
    every = sizes[False, 0] + sizes[False, 1]
    weights = (0.5 * every / sizes[False, 0], 0.5 * every / sizes[False, 1])  # classes weigh the same, one on average
    for epoch in range(EPOCHS):
        _epoch(train, (net, power, fixed, weights), epoch)
    if not (sizes.get((True, 0)) and sizes.get((True, 1))):
        return Model(net, languages, {}, 0.0)
    counts = _logit_counts(rows.filter("held"), net)
    dropped(rows)

    def threshold(part) -> float:
        found = part.groupby("step")[["positive", "total"]].sum()
        return best_threshold(found.index.to_numpy() / STEPS, found["positive"].to_numpy(), found["total"].to_numpy())

    thresholds = {
        x: threshold(part) for x, part in counts.groupby("spoken") if part["positive"].sum() >= LEAST_POSITIVE
    }
    return Model(net, languages, thresholds, threshold(counts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: VOCABULARY by DIMENSIONS
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(names).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value.network
        tables = net.tables() if net is not None else None
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            found = [shared.value.scores(texts[lo:hi], tables) for lo, hi in passes(texts)]
            value = np.concatenate(found) if found else np.zeros(0)
            columns = {name: batch.column(name) for name in names}
            columns["score"] = pa.array(value, pa.float64())
            columns["predicted"] = pa.array((value >= 0.5).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(names).transform(shipped).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32(doc_id) mod 5 is not 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = key_remainder("doc_id", 5) == 0
    languages = language_id.fit(docs.filter(~held), 300)
    model = fit(docs, labels.filter(~held), languages)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "score", "predicted"
    )
