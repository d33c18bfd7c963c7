"""Deterministic choices per key: first, last, distinct in order, best k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """The first row of each key in the given order; dropDuplicates would keep any."""
    return _pick(df, key, order, F.min_by)


def keep_last(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    return _pick(df, key, order, F.max_by)


def _pick(df: DataFrame, key, order, by) -> DataFrame:
    """An aggregate with partial picks before the shuffle, so a hot key arrives as one row per task."""
    keys, orders = [key] if isinstance(key, str) else key, [order] if isinstance(order, str) else order
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    at = F.struct(*(F.col(c) for c in orders))
    return df.groupBy(*keys).agg(by(row, at).alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns))


def distinct_in_order(values: Column, front: Column) -> Column:
    """A list without repeats, ``front`` before it unless it is a member; null and empty members dropped."""
    clean = F.filter(values, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.array_contains(clean, front), F.array_distinct(clean)).otherwise(F.array_distinct(F.concat(F.array(front), clean)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The k best rows per key with their ``rank``; Spark cuts each task's rows before the shuffle where k is a number."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
