"""Incremental ingest of chunk files: an extra beyond batch rebuilds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill import schemas


def new_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the chunk files that arrive in a folder; malformed lines are kept in ``_bad``."""
    return spark.readStream.schema(f"{schemas.CHUNK}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str) -> StreamingQuery:
    """Adds what is new to the store and stops; ids that the store has, or that came earlier in the batch, are skipped.

    New rows have no place, so they come after their title's others, in the order
    of ids, also in a store that ``pipeline.run`` has written. Malformed lines go to the folder
    ``<store>_rejected``, with the number of their batch.

    The file source and the checkpoint make each file count once, also after a
    failure; a batch that is run again finds its ids in the store.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.filter("_bad IS NOT NULL").select(F.lit(number).alias("batch"), F.col("_bad").alias("line")).write.mode("append").parquet(f"{store}_rejected")
        batch = batch.filter("_bad IS NULL").drop("_bad")
        fresh = batch.filter(F.coalesce("chunk_id", F.lit("")) != "").groupBy("chunk_id").agg(F.min_by(F.struct(*(c for c in batch.columns if c != "chunk_id")), F.struct("source_path", "text")).alias("r"))
        fresh = fresh.select("chunk_id", "r.*").select(*batch.columns)
        try:
            known = spark.read.parquet(store).select("chunk_id")
            fresh = fresh.join(known, "chunk_id", "left_anti").select(*batch.columns)
        except Exception as e:  # noqa: BLE001  the first batch has no store yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").partitionBy("title_number").parquet(store)

    return new_chunks(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
