"""Chunk tables, indexes and vectors in storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.operators.keys import keep_first, keep_last


class BadRecord(ValueError):
    """A line of a chunk file is no JSON object."""


def write_chunks(chunks: DataFrame, path: str) -> dict[str, int]:
    """Chunks as JSON lines in one atomic replacement; the counts of all and of section chunks."""
    names = [c.split()[0] for c in schemas.CHUNK.split(", ")]
    chunks.select(*names).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    total, sections = chunks.agg(F.count(F.lit(1)), F.count_if(F.col("chunk_type") == "section")).first()
    return {"chunks": total, "sections": sections}


def read_chunks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of the chunk schema with ``ord``, their order over files and lines; blank lines are skipped.

    A line that does not parse is an error that names its file and line, or, not
    strict, left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("_row", F.from_json("value", f"{schemas.CHUNK}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull()
    if strict and (first := parsed.filter(bad).orderBy("_file", "_n").select("_file", "_n").first()):
        before = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_n")).filter((F.col("_file") == first["_file"]) & (F.col("_n") < first["_n"])).count()
        raise BadRecord(f"{first['_file']}: line {before + 1} is no JSON object")
    names = [c.split()[0] for c in schemas.CHUNK.split(", ")]
    return parsed.filter(~bad).select(*(F.col(f"_row.{c}").alias(c) for c in names), F.struct("_file", "_n").alias("ord"))


def unique_chunks(chunks: DataFrame, need_text: bool = False) -> DataFrame:
    """The first row of each id; rows without an id, and without text if asked, are left out."""
    rows = chunks.filter(F.coalesce("chunk_id", F.lit("")) != "")
    return keep_first(rows.filter(F.coalesce("text", F.lit("")) != "") if need_text else rows, "chunk_id", "ord")


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """The last row of each id."""
    return keep_last(chunks.filter(F.col("chunk_id").isNotNull()), "chunk_id", "ord")


def write_store(chunks: DataFrame, path: str) -> dict[str, int]:
    """The keyed chunk table, partitioned by title so that its filter prunes files; a rebuild replaces it at once."""
    rows = unique_chunks(chunks)
    missing = rows.filter(F.col("chunk_type").isNull() | F.col("text").isNull() | F.col("source_path").isNull()).count()
    if missing:
        raise ValueError(f"{missing} chunks lack a type, text or source")
    rows.write.mode("overwrite").partitionBy("title_number").parquet(path)
    total, indexed = chunks.count(), rows.count()
    return {"indexed": indexed, "skipped": total - indexed}


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)
