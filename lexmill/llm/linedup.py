"""Line dedup by overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import free_name, table


def line_windows(docs: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """``key, pos, h1, h2``: two 64-bit hashes of every window of ``width`` consecutive lines; pos counts from 0."""
    lines = F.split(F.col(text_col), "\n")
    joined = F.transform(F.sequence(F.lit(0), F.size("_l") - width), lambda i: F.array_join(F.slice("_l", i + 1, width), "\n"))
    cut = docs.select(F.col(key), lines.alias("_l")).filter(F.size("_l") >= width).select(key, F.posexplode(joined).alias("pos", "_w"))
    return cut.select(key, "pos", F.xxhash64("_w").alias("h1"), F.xxhash64(F.lit(1), F.col("_w"), F.length("_w")).alias("h2"))


def covered_lines(docs: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    """``key, starts``: the sorted starts of the windows of each document that occur earlier.

    Earlier means a smaller key, or the same key and an earlier line. The first
    occurrence of each window is an aggregate with partial sums before the
    shuffle, so a window that a third of the documents share arrives as one row
    per task; only repeated windows are joined back, and adaptive execution
    splits a hot one.
    """
    windows = line_windows(docs, key, text_col, width)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct(key, "pos")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = first.select(F.col("h1").alias("_a"), F.col("h2").alias("_b"), F.col(f"_first.{key}").alias("_fk"), F.col("_first.pos").alias("_fp"))
    later = windows.join(first, (F.col("h1") == F.col("_a")) & (F.col("h2") == F.col("_b")))
    later = later.filter((F.col(key) > F.col("_fk")) | ((F.col(key) == F.col("_fk")) & (F.col("pos") > F.col("_fp"))))
    return later.groupBy(key).agg(F.sort_array(F.collect_list("pos")).alias("_starts"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` with their texts thinned and ``n_lines, n_removed, n_spans`` added.

    Lines are what ``\\n`` separates. Every window of ``width`` consecutive lines
    of a document that also occurs earlier in the corpus covers its lines;
    covered positions are merged and removed, the rest is joined by ``\\n``
    again. Windows are judged on the input, not on what is left. The first
    occurrence stays.

    A null text stays null with 0 lines, and an empty one is one empty line;
    texts of fewer lines than ``width`` are left as they are. Rows with a null
    id are never compared and stay whole. Rows that repeat an id count as one
    place: equal windows of theirs at one line do not cover each other, and both
    rows lose what occurs earlier elsewhere. Other columns pass through, also
    those whose names clash with the new ones, which then get a leading ``_``.
    """
    key = free_name(docs, "key")
    hits = covered_lines(docs.select(F.col(id_col).alias(key), F.col(text_col).alias("_t")).filter(F.col(key).isNotNull() & F.col("_t").isNotNull()), key, "_t", width)
    starts, lines, gone = (free_name(docs, n) for n in ("starts_", "lines_", "gone_"))
    out = docs.join(hits.withColumnRenamed("_starts", starts), docs[id_col] == hits[key], "left").drop(key)
    text = F.col(text_col)
    out = out.withColumn(lines, F.split(text, "\n"))
    # The covered positions, merged: every start covers itself and the next width - 1 lines.
    out = out.withColumn(gone, F.when(F.col(starts).isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + width - 1)))))).otherwise(F.array().cast("array<int>")))
    spans = F.aggregate(
        F.col(gone),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), F.when(p == a["last"] + 1, a["n"]).otherwise(a["n"] + 1).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    names = [free_name(docs, n) for n in ("n_lines", "n_removed", "n_spans")]
    # The other positions by a hash set, then one look by position a line: linear in the lines.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    kept_old = F.when(F.size(gone) == 0, text).otherwise(kept)
    return out.select(
        *[kept_old.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(names[0]),
        F.size(gone).cast("long").alias(names[1]),
        spans.alias(names[2]),
    )


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", width: int = 3) -> DataFrame:
    """The rows of ``docs`` in their own columns without the lines that ``dedup_lines`` removes.

    Rows that lose every line go; a null or empty text stays. ``chars_col``,
    where there is one, follows the text.
    """
    out = dedup_lines(docs, id_col=id_col, text_col=text_col, width=width)
    n_lines, n_removed, _ = (F.col(c) for c in out.columns[len(docs.columns) :])
    out = out.filter((n_removed < n_lines) | (n_lines == 0))
    return out.select(*[F.length(text_col).cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
windows AS (
  SELECT doc_id, pos, line || chr(10) || LEAD(line, 1) OVER w || chr(10) || LEAD(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, ROW_NUMBER() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM windows WHERE win IS NOT NULL)
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT UNNEST([0, 1, 2]) AS d)),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS lost,
         g.pos IS NOT NULL AND NOT COALESCE(LAG(g.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), FALSE) AS opens
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, COUNT(*)::BIGINT AS n_lines, COUNT(*) FILTER (lost)::BIGINT AS n_removed, COUNT(*) FILTER (opens)::BIGINT AS n_spans,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
