"""The whole way from pages to a searchable store, in one session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import chunking, fulltext, hierarchy, vectors
from lexmill.operators.retrieval import Retriever
from lexmill.sources import chunks as store
from lexmill.sources import titles as trees


#: Columns of the full-text index.
INDEXED = ["chunk_id", "text"]


def extract(pages: DataFrame, number: int, following: int | None = None, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, title row) of one title; ``following`` defaults to the next number."""
    own = hierarchy.title_range(pages, number, number + 1 if following is None else following)
    title = own.agg(F.min("page_number").alias("start_page"), F.max("page_number").alias("end_page"))
    title = title.select(F.lit(number).alias("title_number"), F.lit(label or f"Title {number}").alias("label"), "start_page", "end_page")
    if title.first()["start_page"] is None:
        raise ValueError(f"no page opens with Title {number}")
    return hierarchy.title_tree(own), title


def run(spark: SparkSession, pages: DataFrame, titles: list[int], out: str, *, max_chars: int = chunking.MAX_CHARS, model=None, source: str = "pages") -> dict:
    """Extract, chunk, index and encode ``titles`` into ``out``; the counts of each step.

    The chunk table is written once; the store and the vectors both read it.
    """
    tree = heads = None
    for n in titles:
        own, head = extract(pages, n)
        tree, heads = (own, head) if tree is None else (tree.unionByName(own), heads.unionByName(head))
    trees.write_titles(trees.nest(tree, heads), f"{out}/titles")
    labels = heads.select("title_number", F.col("label").alias("title_label"), F.lit(source).alias("source_path"))
    made = chunking.tree_chunks(tree, labels, max_chars)
    made.write.mode("overwrite").parquet(f"{out}/chunks")
    found = spark.read.parquet(f"{out}/chunks")
    counts = store.write_chunks(found, f"{out}/chunks.jsonl") | store.write_store(found, f"{out}/store")
    index_store(spark, out)
    store.write_vectors(vectors.encode(store.unique_chunks(found, need_text=True).select("chunk_id", "text"), "text", model), f"{out}/vectors")
    return counts


def stored_rows(spark: SparkSession, out: str) -> DataFrame:
    """The store's chunks; their order is that of titles, then of the title, then of ids; rows without a place come last in their title."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{out}/store")
    rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.lit(None).cast("int"))
    order = F.struct("title_number", F.col("ord").isNull().alias("added"), "ord", "chunk_id")
    return rows.withColumn("_o", order).drop("ord").withColumnRenamed("_o", "ord")


def index_store(spark: SparkSession, out: str) -> None:
    """Writes the full-text index of the store's ids and texts."""
    fulltext.write_index(stored_rows(spark, out), "ord", INDEXED, f"{out}/index")


def open_text(spark: SparkSession, out: str) -> tuple[DataFrame, fulltext.Index]:
    """The store's chunks and their stored index."""
    return stored_rows(spark, out), fulltext.open_index(spark, f"{out}/index")


def open_store(spark: SparkSession, out: str, model=None) -> Retriever:
    """A retriever over what ``run`` has written."""
    rows, index = open_text(spark, out)
    return Retriever(spark, rows, store.read_vectors(spark, f"{out}/vectors"), index, model)
