"""A training corpus from ``documents``: quality, repeated lines, near-duplicates, source mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import Workspace, arrow_rows, table
from lexmill.llm.linedup import drop_repeated_lines
from lexmill.llm.mixing import repeat_documents
from lexmill.llm.neardup import drop_near_duplicates
from lexmill.llm.packing import pack_documents
from lexmill.llm.quality import keep_good, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level random field does not reject.

    Null and empty texts are judged as one empty line. Each row is judged by its
    own text, whatever its id, null or repeated. Without labels all rows stay.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")), spark)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; those that lose every line go, and ``n_chars`` follows the text.

    Null and empty texts stay as they are, and so do rows with a null id. Rows
    that repeat an id are one place and do not cover each other.
    """
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on five-word shingles.

    Null and empty texts are duplicates of nothing, and rows with a null id stay.
    Rows that repeat an id are one document: the one of the least text stays.
    """
    return drop_near_duplicates(docs, spark, k=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them, so that rows repeat.

    Documents without words, null texts among them, are not taken; null sources
    are one source, the last; rows with a null id take part.
    """
    return repeat_documents(docs, spark)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences; each row is a document, whatever its id, and a null text an end token.

    Executors share their memory with what earlier stages have left in the heap
    and in Python workers, so batches, slices and the tokenizer's memo are small.
    """
    with arrow_rows(spark, 1000):
        return Workspace(spark, "packed").save(pack_documents(docs, memo_words=100_000, slice_bytes=1_000_000), "pieces")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: The field, MinHash and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again as the next one's input.

    Stages pass on all columns of their rows, whatever else they are called. An
    empty table gives no pieces.
    """
    return apply(spark, table(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stages over any table of documents; a stage's table goes when the next one's is written."""
    space, before = Workspace(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return docs
