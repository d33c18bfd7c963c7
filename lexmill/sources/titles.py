"""Pages in, title trees out and in again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas


def read_pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``path, page_number, text`` of documents in a folder.

    ``decode`` turns a file's bytes into its pages' texts, for any format; without
    it files are text whose pages are parted by form feeds.
    """
    pages = decode or (lambda content: content.decode("utf-8", "replace").split("\f"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"], strict=True):
                texts = pages(bytes(content))
                yield pd.DataFrame({"path": p, "page_number": range(1, len(texts) + 1), "text": [t or "" for t in texts]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def _span(kind: str, tree: DataFrame) -> DataFrame:
    return tree.filter(F.col("kind") == kind).withColumnRenamed("text", "_text")


def nest(tree: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per title in the nested form: subtitles, their divisions and chapters, sections in chapters.

    ``titles`` has ``title_number, label, start_page, end_page``. Each level is one
    aggregate by parent.
    """
    def children(rows: DataFrame, parent: str, item, order) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("v"))))
        return rows.groupBy("title_number", F.col(parent).alias("_p")).agg(F.transform(listed, lambda x: x["v"]).alias("_list"))

    def attach(rows: DataFrame, lists: DataFrame, name: str) -> DataFrame:
        lists = lists.withColumnRenamed("title_number", "_t")
        return rows.join(lists, (F.col("title_number") == F.col("_t")) & (F.col("node") == F.col("_p")), "left").withColumn(name, F.coalesce("_list", F.array())).drop("_t", "_p", "_list")

    def pages(*more):
        return F.struct(*more)

    sections = _span("section", tree)
    section = pages(F.col("number").alias("citation"), F.col("title").alias("heading"), "start_page", "end_page", F.col("_text").alias("text"))
    chapters = attach(_span("chapter", tree), children(sections, "chap", section, F.col("slot")), "sections")
    chapter = pages(F.col("number").alias("citation"), "title", "start_page", "end_page", F.col("_text").alias("intro"), "sections")
    divisions = attach(_span("division", tree), children(chapters.filter("div IS NOT NULL"), "div", chapter, F.col("node")), "chapters")
    division = pages("number", "title", "start_page", "end_page", F.col("_text").alias("intro"), "chapters")
    subs = attach(_span("subtitle", tree), children(divisions, "sub", division, F.col("node")), "divisions")
    subs = attach(subs, children(chapters.filter("div IS NULL"), "sub", chapter, F.col("node")), "chapters")
    subtitle = pages("number", "title", "start_page", "end_page", F.col("_text").alias("intro"), "divisions", "chapters")
    listed = subs.withColumn("_one", F.lit(0))
    subtitles = children(listed, "_one", subtitle, F.struct("start_page", "slot")).select(F.col("title_number").alias("_t"), F.col("_list").alias("subtitles"))
    preface = _span("preface", tree).select(F.col("title_number").alias("_u"), F.col("_text").alias("preface"))
    out = titles.join(subtitles, F.col("title_number") == F.col("_t"), "left").join(preface, F.col("title_number") == F.col("_u"), "left")
    return out.select("label", F.col("title_number").alias("number"), "start_page", "end_page", F.coalesce("preface", F.lit("")).alias("preface"), F.coalesce("subtitles", F.array()).alias("subtitles"))


def write_titles(nested: DataFrame, path: str) -> None:
    """One JSON document per line and title, with nulls kept."""
    nested.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_titles(spark: SparkSession, *paths: str) -> DataFrame:
    """Title documents, one per file or line, with the file they came from."""
    return spark.read.schema(schemas.TITLE).option("mode", "FAILFAST").json(list(paths)).withColumn("source_path", F.col("_metadata.file_path"))
