"""Corpus cleaning in five stages; each is written as Parquet and read back for the next.

1. language: documents whose text has no letter, and so no language, go, and those in a language not kept;
   a document without a ``lang`` gets the predicted one.
2. lines: repeated lines are cut out; a document of which no letter is left goes.
3. near duplicates: of documents that share 0.8 of their five-word shingles one stays, that of the least doc_id.
4. decontamination: passages of the benchmark are cut out; nothing else is touched.
5. tokens: what is left is encoded; ids, their number and the text decoded from them.

Stages 1 to 4 return the columns of ``documents``; ``n_chars`` follows the text. A document is
known by its doc_id and text. Rows without a doc_id take part in every stage and come after the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, language_id, line_dedup, near_copies
from tickloom.llm.common import key_remainder, read, staged


#: Predicted languages to keep; None keeps every one that is learned.
LANGUAGES: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language to keep, each with one; learned on three quarters of those labelled."""
    model = language_id.fit(docs.filter(key_remainder("doc_id", 4) != 2))
    found = language_id.predict(docs, model)
    kept = F.col("lang_pred") != language_id.UNDETERMINED
    if LANGUAGES is not None:
        kept = kept & F.col("lang_pred").isin(*LANGUAGES)
    return found.filter(kept).withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those with no letter left go."""
    found = line_dedup.deduplicated(docs).filter(r"n_dropped = 0 OR kept RLIKE '\\p{L}'")
    return found.withColumns(
        {
            "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars")),
            "text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text")),
        }
    ).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 of the five-word shingles are shared."""
    return near_copies.one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    found = decontaminate.cleaned(docs, read(spark, sf_dir, "benchmark"))
    length = F.when(F.col("n_hit") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and digests of them and of the text decoded from them."""
    return bpe.digests(docs.select("doc_id", "text"), bpe.vocabulary_path(), with_ids=True)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Set similarities, an edit join and token merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
