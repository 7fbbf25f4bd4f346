"""Language identification in two levels: family first, then one-versus-one within the family.

A text is a bag of hashed byte trigrams of its lower-cased letters. One-versus-rest linear
support vector machines choose the language family; within a family, one linear support
vector machine for each pair of languages votes. A score is the mean weight of a text's
trigrams, so prediction is a table look-up and a sum, whatever the text's length.

Learning uses a bounded sample: ``per_language`` labelled texts of each language, taken by
the hash of the text's key over the whole table. Everything else reads all rows.

Defined cases: null text, empty text or a text without any letter is ``und`` with score 0;
a null label takes no part in learning; without any labelled text every row is ``und``;
with one label only, every text with a letter gets it. Long texts count whole. Extra
columns are ignored. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import svm
from tickloom.llm.common import joined, key_remainder, passes, read, shipped, span_sums, text_bytes, tidy

#: Hashed trigram features.
FEATURES = 4096
#: Labelled texts of each language to learn from.
PER_LANGUAGE = 600
#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk"),
    "indic": ("hi", "ur", "bn", "mr", "gu", "pa", "ne"),
}
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")

# lower-case letters and bytes of longer characters stay, all other bytes become a space
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), f"only:{language}")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each position, FEATURES where its middle byte is no letter, and text spans."""
    data, starts, ends = joined(texts, b"  ")
    b = _FOLD[data]
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)
    code[b[1:-1] == 32] = FEATURES
    # a trigram is listed where it begins, one byte before its middle
    return code, starts - 1, ends - 1


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    #: weights of each classifier by feature, the last feature being "no letter"
    weights: np.ndarray
    biases: np.ndarray
    slopes: np.ndarray
    #: what a classifier decides: ("family", f) or ("pair", a, b) by index of language
    duties: list[tuple] = field(default_factory=list)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UNDETERMINED] * n, np.zeros(n)
        code, starts, ends = trigrams(texts)
        count = np.maximum(span_sums((code < FEATURES).astype(np.int64), starts, ends), 1)
        chance = np.ones((len(self.duties), n))
        for k in range(len(self.duties)):
            margin = span_sums(self.weights[k][code], starts, ends) / count + self.biases[k]
            chance[k] = 1 / (1 + np.exp(-np.clip(self.slopes[k] * margin, -50, 50)))
        family = np.ones((len(self.families), n))
        for k, duty in enumerate(self.duties):
            if duty[0] == "family":
                family[duty[1]] = chance[k]
        family /= np.maximum(family.sum(axis=0), 1e-300)
        chosen = family.argmax(axis=0)
        score = np.zeros((len(self.languages), n))
        for f, name in enumerate(self.families):
            members = [i for i, x in enumerate(self.languages) if family_of(x) == name]
            if len(members) == 1:
                score[members[0]] = np.where(chosen == f, family[f], 0)
            for k, duty in enumerate(self.duties):
                if duty[0] == "pair" and duty[1] in members:
                    votes = len(members) * (len(members) - 1) / 2
                    score[duty[1]] += np.where(chosen == f, family[f] * chance[k] / votes, 0)
                    score[duty[2]] += np.where(chosen == f, family[f] * (1 - chance[k]) / votes, 0)
        best = score.argmax(axis=0)
        names = [self.languages[i] for i in best]
        value = np.clip(score.max(axis=0), 0, 1)
        for i, t in enumerate(texts):
            if not _LETTER.search(t.decode("utf-8", "replace")):
                names[i], value[i] = UNDETERMINED, 0.0
        return names, value


def learn(languages: list[str], x: np.ndarray) -> Model:
    """Fit the classifiers on rows ``x`` of trigram shares labelled ``languages``."""
    known = sorted(set(languages))
    families = sorted({family_of(x) for x in known})
    label = np.array(languages)
    spread = 1 / (x.std(axis=0) + 1e-5) if len(x) else np.ones(FEATURES)
    scaled = (x * (spread / np.sqrt(FEATURES))).astype(np.float32)
    duties, weights, biases, slopes = [], [], [], []

    def fit(duty: tuple, rows: np.ndarray, y: np.ndarray) -> None:
        w, b = svm.train(scaled[rows], y)
        duties.append(duty)
        slopes.append(svm.slope(scaled[rows] @ w + b, y))
        weights.append(np.append(w * spread / np.sqrt(FEATURES), 0.0))
        biases.append(b)

    owner = np.array([family_of(x) for x in languages])
    if len(families) > 1:
        for f, name in enumerate(families):
            fit(("family", f), np.arange(len(x)), np.where(owner == name, 1.0, -1.0))
    for i, a in enumerate(known):
        for j in range(i + 1, len(known)):
            if family_of(a) == family_of(known[j]):
                rows = np.flatnonzero((label == a) | (label == known[j]))
                fit(("pair", i, j), rows, np.where(label[rows] == a, 1.0, -1.0))
    return Model(
        known,
        families,
        np.array(weights).reshape(-1, FEATURES + 1),
        np.array(biases),
        np.array(slopes),
        duties,
    )


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lo, hi in passes(texts):
            code, starts, ends = trigrams(texts[lo:hi])
            rows = [np.bincount(code[s:e], minlength=FEATURES)[:FEATURES] for s, e in zip(starts, ends)]
            kept = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(langs[lo:hi], pa.string()),
                    "feature": pa.array([k.astype(np.int32).tobytes() for k in kept], pa.binary()),
                    "n": pa.array([r[k].astype(np.int32).tobytes() for r, k in zip(rows, kept)], pa.binary()),
                }
            )


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from a sample of ``labelled`` (columns doc_id, text, lang), bounded by language.

    At most about ``per_language`` rows of each language reach the driver, as sparse counts.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return learn([], np.zeros((0, FEATURES)))
    draw = (F.xxhash64(F.lit("language sample"), "doc_id") % 1_000_003 + 1_000_003) % 1_000_003
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int(1_000_003 * min(1.0, per_language / n))))
    taken = rows.filter(keep).dropDuplicates(["doc_id"]).transform(shipped).mapInArrow(
        tidy(_sample_features), "lang string, feature binary, n binary"
    )
    found = taken.collect()
    x = np.zeros((len(found), FEATURES), dtype=np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["feature"], np.int32)] = np.frombuffer(r["n"], np.int32)
    usable = x.sum(axis=1) > 0
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    return learn([r["lang"] for r, u in zip(found, usable) if u], x[usable])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x classifiers, fixed size
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            found, scores = [], []
            for lo, hi in passes(texts):
                langs, score = shared.value.predict(texts[lo:hi])
                found += langs
                scores.append(score)
            columns = {name: batch.column(name) for name in names}
            columns["lang_pred"] = pa.array(found, pa.string())
            columns["score"] = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(names).transform(shipped).mapInArrow(tidy(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned where crc32(doc_id) mod 4 is not 2."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = key_remainder("doc_id", 4) == 2
    model = fit(docs.filter(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
