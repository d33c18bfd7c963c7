"""Filtered retrieval over the chunk table: predicates, hybrid gate, evidence for many requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import fulltext
from lexmill.operators.keys import keep_first, keep_last
from lexmill.operators.vectors import dot, encode

#: Evidence requests of one call.
REQUESTS = 1000
RESULT = ["chunk_id", "score", "text", "full_citation", "section_heading", "chapter_title", "title_number", "title_label"]


def every(*clauses: Column | None) -> Column:
    """The conjunction of the clauses that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def title_is(number: int | None, column: str = "title_number") -> Column | None:
    return None if number is None else F.col(column) == number


def citation_like(prefix: str | None, column: str = "section_citation") -> Column | None:
    """A prefix without regard to case, in which ``%`` and ``_`` are wildcards."""
    return None if prefix is None else F.col(column).ilike(f"{prefix}%")


def citation_starts(prefix: str | None, column: str = "section_citation") -> Column | None:
    """A raw prefix with regard to case; null never matches."""
    return None if not prefix else F.coalesce(F.col(column), F.lit("")).startswith(prefix)


def type_in(types: list[str] | None, column: str = "chunk_type") -> Column | None:
    return F.col(column).isin(*types) if types else None


def search_text(spark: SparkSession, chunks: DataFrame, index: fulltext.Index, query: str, *, title: int | None = None, citation: str | None = None, limit: int = 5) -> DataFrame:
    """Ranked full-text search with the title and citation filters; citation falls back to the id."""
    where = every(title_is(title), citation_like(citation))
    found = fulltext.search(spark, chunks, index, query, ["chunk_id", "text"], where=where, limit=limit)
    shown = F.coalesce(F.nullif("full_citation", F.lit("")), F.col("chunk_id"))
    return found.select("chunk_id", shown.alias("citation"), F.coalesce("section_heading", F.lit("")).alias("section_heading"), "title_number", "title_label", "text", "rank")


class Retriever:
    """Exact dense search over chunks and their vectors, restricted by filters and, optionally, a full-text gate.

    Where ids repeat, the first row counts for vectors and records alike. Vectors
    without a record are left out; ``orphans`` counts them. A full-text gate
    without an index is an error, not ignored.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame, index: fulltext.Index | None = None, model=None, order: str = "ord"):
        self.spark, self.index, self.model, self.order = spark, index, model, order
        self.chunks = keep_first(chunks.filter(F.col("chunk_id").isNotNull()), "chunk_id", order)
        self.vectors = vectors

    def orphans(self) -> int:
        return self.vectors.join(self.chunks, "chunk_id", "left_anti").count()

    def search(self, query: str, *, top_k: int = 5, title_number: int | None = None, section_prefix: str | None = None, chunk_types: list[str] | None = None, fts_query: str | None = None) -> DataFrame:
        request = [("query", query, title_number, section_prefix, chunk_types, fts_query, top_k)]
        found = self.gather(self.spark.createDataFrame(request, "label string, query string, title_number int, section_prefix string, chunk_types array<string>, fts_query string, top_k int"))
        return found.orderBy("rank").select(*RESULT, "metadata")

    def gather(self, requests: DataFrame) -> DataFrame:
        """The best chunks of every evidence request; of requests with one label the last counts, gate and all.

        The last is that of the highest ``position`` where there is such a column,
        and else of the frame's own order. All requests, which are what a user
        asks for one report and at most REQUESTS, run as one job: their filters
        are columns of the broadcast request rows. Only full-text gates are parsed
        one by one, as each is a query of its own.
        """
        number = F.col("position") if "position" in requests.columns else F.monotonically_increasing_id()
        last = keep_last(requests.withColumn("_no", number), "label", "_no").limit(REQUESTS + 1).collect()
        if len(last) > REQUESTS:
            raise ValueError(f"more than {REQUESTS} requests; ask for them in several calls")
        most = max([4 if r["top_k"] is None else r["top_k"] for r in last], default=0)
        kept = self.spark.createDataFrame(last, requests.schema.add("_no", "long"))
        asked = encode(kept, "query", self.model, "query_vector")
        asked = asked.select("label", "query_vector", F.col("title_number").alias("_title"), F.col("section_prefix").alias("_prefix"), F.col("chunk_types").alias("_types"), F.col("fts_query").alias("_fts"), F.coalesce("top_k", F.lit(4)).alias("_k"))
        rows = self.chunks.join(self.vectors, "chunk_id")
        fits = every(
            F.col("_title").isNull() | (F.col("title_number") == F.col("_title")),
            (F.coalesce("_prefix", F.lit("")) == "") | F.coalesce("section_citation", F.lit("")).startswith(F.col("_prefix")),
            F.col("_types").isNull() | (F.size("_types") == 0) | F.array_contains("_types", F.col("chunk_type")),
        )
        met = rows.join(F.broadcast(asked), fits)
        gated = [r for r in last if r["fts_query"]]
        if gated:
            if self.index is None:
                raise ValueError("a full-text gate needs an index")
            allowed = [
                fulltext.candidates(self.chunks, self.index, r["fts_query"], ["chunk_id", "text"], ord_col=self.order, where=every(title_is(r["title_number"]), citation_like(r["section_prefix"]))).select(F.lit(r["label"]).alias("_l"), F.col(self.order).alias("_o"))
                for r in gated
            ]
            gate = reduce(DataFrame.union, allowed)
            inside = met.filter("_fts IS NOT NULL AND _fts <> ''").join(gate, (F.col("label") == F.col("_l")) & (F.col(self.order) == F.col("_o")), "left_semi")
            met = met.filter("_fts IS NULL OR _fts = ''").unionByName(inside)
        met = met.withColumn("score", dot(F.col("embedding"), F.col("query_vector")))
        w = Window.partitionBy("label").orderBy(F.desc("score"), self.order)
        # The literal limit lets tasks drop rows before the shuffle.
        best = met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).filter(F.col("rank") <= F.col("_k"))
        record = F.struct(*(F.col(c) for c in self.chunks.columns)).alias("metadata")
        return best.select("label", "rank", *[F.coalesce("text", F.lit("")).alias("text") if c == "text" else c for c in RESULT], record)
