"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, Workspace, free_name, table

#: Slices of the seeded order; a source of any size is cut into so many, and only one of them is sorted.
SLICES = 4096
#: Rows of the table of slices up to which it is broadcast; beyond it, it is joined.
BROADCAST_ROWS = 1_000_000


def source_targets(sizes: DataFrame, source: str, total: str, cycle: int, max_epochs: int) -> DataFrame:
    """One row per source with its ``target``, by water-filling.

    Sources in code-point order, null last, weigh 1..cycle, repeating. A source
    takes ``level * weight`` but at most ``max_epochs`` times its size; the level
    is where the targets sum to the corpus size. Sources fill up in the order of
    cap / weight, so with running sums over that order the level for "the first
    m are full" is (all - their caps) / (weights of the rest), and m is the
    number of sources whose cap the level before them exceeds: the fixed point
    of clamping and resharing, without a loop. The table has one row per source.
    """
    by_name = Window.orderBy(F.col(source).isNull(), F.col(source).cast("binary"))
    w = sizes.withColumn("_w", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("long"))
    w = w.withColumn("_cap", F.col(total) * max_epochs).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col(source).isNull(), F.col(source).cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        w.withColumn("_all", F.sum(total).over(everything))
        .withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")).cast("double") / (F.col("_weights") - F.col("_gone")))
        .withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    )
    # Taking a source as full that is not lowers the level, so the level of the first that is not is the highest.
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return w.withColumn("target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(level * F.col("_w"))).select(
        source, total, F.col("_w").alias("weight"), "target"
    )


def _seeded(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, spark: SparkSession, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: int = 3, max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """The rows of ``docs`` with ``size, source_size, target, reps``: how many times the mix takes each.

    A source with target t and size s repeats all its documents floor(t / s)
    times; the remaining r = t - floor(t / s) * s words come from the documents
    first in an order seeded by the md5 of their id: a document is taken once
    more while the words before it plus half of its own are at most r, so a
    source misses its target by half a document at most.

    Null texts have size 0; null sources are one source; null ids take part.
    Rows that repeat an id are documents of their own, in the order of their
    sizes. Columns whose names clash with the new ones keep theirs, and the new
    ones get a leading ``_``. An empty table gives no rows. A source without
    words has target 0.

    The running sums need no source in one task: words are summed by source and
    slice of the seeded order, and only the slice where r falls is sorted.
    Texts stay where they are, as the sums are broadcast while they are few.
    """
    size, source_size, target, reps, order, part = (free_name(docs, n) for n in ("size", "source_size", "target", "reps", "order_", "slice_"))
    keyed = docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")).withColumn(order, _seeded(F.col(id_col), seed))
    keyed = keyed.withColumn(part, (F.conv(F.substring(order, 1, 8), 16, 10).cast("long") / (2**32 // SLICES)).cast("int"))
    space = Workspace(spark, "mix")
    per_slice = space.save(keyed.groupBy(F.col(source_col).alias("_s"), F.col(part).alias("_k")).agg(F.sum(size).alias("_words")), "sizes")
    per_source = per_slice.groupBy("_s").agg(F.sum("_words").alias("_size"))
    targets = source_targets(per_source, "_s", "_size", cycle, max_epochs)
    targets = targets.withColumn("_whole", F.when(F.col("_size") > 0, F.floor(F.col("target") / F.col("_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("_size"))
    earlier = Window.partitionBy("_s").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    slices = per_slice.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    slices = slices.join(targets.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    # Which slices are taken whole, not at all, or cut by the limit.
    slices = slices.withColumn("_state", F.when(F.col("_before") + F.col("_words") <= F.col("_rest"), 1).when(F.col("_before") > F.col("_rest"), 0).otherwise(2))
    facts = F.struct(F.col("_size").alias("size"), "target", F.col("_whole").alias("whole"), F.col("_rest").alias("rest"), F.col("_before").alias("before"), F.col("_state").alias("state"))
    own, number, fact, more = (free_name(docs, n) for n in ("source_", "number_", "mix_", "more_"))
    slices = space.save(slices.select(F.col("_s").alias(own), F.col("_k").alias(number), facts.alias(fact)), "slices")
    small = F.broadcast(slices) if slices.count() <= BROADCAST_ROWS else slices
    joined = keyed.join(small, F.col(source_col).eqNullSafe(F.col(own)) & (F.col(part) == F.col(number)))
    inside = Window.partitionBy(source_col, part).orderBy(order, id_col, size).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(fact)
    cut = joined.filter(at["state"] == 2).withColumn(more, (at["before"] + F.sum(size).over(inside) - F.col(size) / 2 <= at["rest"]).cast("long"))
    even = joined.filter(at["state"] != 2).withColumn(more, at["state"].cast("long"))
    return even.unionByName(cut).select(
        *docs.columns, size, at["size"].alias(source_size), at["target"].alias(target), (at["whole"] + F.when(at["whole"] < max_epochs, F.col(more)).otherwise(0)).alias(reps)
    )


def repeat_documents(docs: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; documents without words are not taken."""
    reps = free_name(docs, "reps")
    size = free_name(docs, "size")
    mixed = mix(docs, spark, **options).filter(F.col(size) > 0)
    times = free_name(docs, "times_")
    return mixed.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(reps).cast("int")))).select(*docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), spark)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("reps") * F.col("size")).alias("taken"), "source")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || COALESCE(doc_id::VARCHAR, 'null')) AS ord
  FROM documents),
src AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((ROW_NUMBER() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT AS w FROM src),
ranked AS (
  SELECT *, 3 * source_size AS cap,
         SUM(source_size) OVER () AS total, SUM(w) OVER () AS weights,
         COALESCE(SUM(3 * source_size) OVER before, 0) AS capped, COALESCE(SUM(w) OVER before, 0) AS gone
  FROM weighed
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - capped)::DOUBLE / (weights - gone) AS level FROM ranked),
full_ones AS (SELECT *, level * w >= cap AS is_full FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE ELSE MAX(CASE WHEN NOT is_full THEN level END) OVER () * w END AS target
  FROM full_ones),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
upto AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
         SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized d JOIN split t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole + CASE WHEN whole < 3 AND cum - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS taken, source
FROM upto
"""
