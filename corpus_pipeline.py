"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from tickloom.llm.shared import saved, table


def _columns(docs: DataFrame) -> list[str]:
    """The columns of documents, as the input has them."""
    return docs.columns


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the models reject go.

    Null texts and texts without a letter are rejected; very long texts are read whole; repeated rows have one fate; an empty
    table, or one without any labelled text, keeps nothing; all columns come through, whatever their names.
    """
    model = language_id.train(table(spark, sf_dir, "documents"))
    return language_id.accepted(docs, model).select(*_columns(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are near copies of a line kept elsewhere; documents left without text go.

    `n_chars` is that of the text that is left. Null, empty and blank texts and rows with a null id stay as they are; rows that
    repeat an id lose the same lines; of equal lines the one in the smallest id, then the first, stays; an empty table gives none.
    """
    out = line_dedup.without_copies(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_columns(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by n-gram Jaccard similarity.

    Null and wordless texts and rows with a null id stay; of rows that repeat an id one stays; an empty table gives none.
    """
    return ngram_join.one_of_each(docs).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null texts contain nothing; rows with a null id stay; repeated rows have one fate; without documents or items, all rows stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: every document's size, its source's target and the words taken.

    Null and empty texts give nothing; a null source is one of its own; equal rows are taken one by one; an empty table gives none.
    """
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
]

#: SQL can't express the language models and the similarity joins; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
