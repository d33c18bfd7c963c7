"""Inverted index and BM25 search with a query grammar, as DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lexmill.functions.text import fold

K1, B = 1.2, 0.75
#: Bytes of a row group of stored postings: small, so that a term reads little else.
GROUP_BYTES = 4 << 20
#: Tokens that a task sorts at a time when it writes an index.
RUN = 1 << 20
TOKENS = r"[\p{L}\p{N}\p{Co}]+"


@dataclass
class Index:
    """Postings (ord, col, pos, term), lengths (ord, dl) and the two numbers of the corpus.

    ``lists`` has one row per term, row and column (term, ord, col, tf, positions);
    ``single`` tells that no term has two of them for one row.
    """

    postings: DataFrame
    lengths: DataFrame
    rows: int
    mean_length: float
    lists: DataFrame | None = None
    single: bool = False

    def __post_init__(self):
        if self.lists is None:
            self.lists = self.postings.groupBy("term", "ord", "col").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def tokenize(df: DataFrame, ord_col: str, columns: list[str], accents: bool = True) -> DataFrame:
    """``ord, col, pos, term`` of the columns' letters and digits, lower-cased, without accents."""
    def terms(c: str) -> Column:
        text = fold(F.col(c)) if accents else F.lower(F.col(c))
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0))

    parts = [df.select(F.col(ord_col).alias("ord"), F.lit(c).alias("col"), F.posexplode(terms(c)).alias("pos", "term")) for c in columns]
    return reduce(DataFrame.unionByName, parts)


def build_index(df: DataFrame, ord_col: str, columns: list[str], accents: bool = True) -> Index:
    """Lengths count the tokens of all indexed columns. The corpus numbers are one aggregate row."""
    postings = tokenize(df, ord_col, columns, accents)
    lengths = postings.groupBy("ord").agg(F.count(F.lit(1)).alias("dl"))
    rows, total = df.agg(F.count(F.lit(1))).first()[0], lengths.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    return Index(postings, lengths, rows, total / rows if rows else 0.0)


def _lists(batches):
    """Runs of at least RUN tokens as rows ``term, ord, col, tf, positions`` in the order of terms, then of rows.

    Runs end where a text ends, so a term has one row for each text.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def flush(held):
        words, pos = held.column("term").combine_chunks().dictionary_encode(), held.column("pos").to_numpy()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        ranks = np.empty(len(words.dictionary), np.int64)
        ranks[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(ranks))
        texts = np.cumsum(pos == 0)
        key = ranks[words.indices.to_numpy()] * (int(texts[-1]) + 1) + texts
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        ends = np.append(starts, len(order)).astype(np.int32)
        first = pa.array(order[starts])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order].astype(np.int32)))
        out = held.select(["term", "ord", "col"]).take(first)
        out = out.append_column("tf", pa.array(np.diff(ends))).append_column("positions", lists)
        return out.combine_chunks().to_batches(max_chunksize=100_000)

    held, n = [], 0
    for batch in batches:
        if n >= RUN and len(at := np.flatnonzero(batch.column("pos").to_numpy() == 0)):
            yield from flush(pa.Table.from_batches([*held, batch.slice(0, at[0])]))
            held, n, batch = [], 0, batch.slice(at[0])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield from flush(pa.Table.from_batches(held))


def write_index(df: DataFrame, ord_col: str, columns: list[str], path: str, accents: bool = True) -> None:
    """Tokenises once and stores the index in the folder ``path``; a rebuild replaces it.

    Each task writes the lists of its own rows in runs sorted by term, without a
    shuffle, so that a search's terms pick row groups and pages by their
    statistics. Lengths and the corpus numbers are small tables beside them.
    """
    spark = df.sparkSession
    postings = tokenize(df, ord_col, columns, accents).select("term", "ord", "col", "pos")
    kind = StructType([*(postings.schema[c] for c in ("term", "ord", "col")), StructField("tf", IntegerType()), StructField("positions", ArrayType(IntegerType()))])
    postings.mapInArrow(_lists, kind).write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/postings")
    found = spark.read.parquet(f"{path}/postings")
    found.groupBy("ord").agg(F.sum("tf").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    numbers = df.agg(F.count(F.lit(1)).alias("rows")).crossJoin(spark.read.parquet(f"{path}/lengths").agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")))  # one row each
    numbers.write.mode("overwrite").parquet(f"{path}/numbers")
    single = F.lit(len(columns) == 1) & (F.count(F.lit(1)) == F.count_distinct(F.col(ord_col)))
    df.agg(single.alias("single")).write.mode("overwrite").parquet(f"{path}/shape")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index that ``write_index`` stored; nothing is read yet but the corpus numbers."""
    rows, total = spark.read.parquet(f"{path}/numbers").first()
    lists = spark.read.parquet(f"{path}/postings")
    postings = lists.select("ord", "col", F.explode("positions").alias("pos"), "term")
    return Index(postings, spark.read.parquet(f"{path}/lengths"), rows, total / rows if rows else 0.0, lists, spark.read.parquet(f"{path}/shape").first()[0])


def term_counts(index: Index) -> DataFrame:
    """``term, tf, df, positions``: occurrences, rows and the sum of positions of each term."""
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda s, p: s + p)
    rows = F.count(F.lit(1)) if index.single else F.count_distinct("ord")
    return index.lists.groupBy("term").agg(F.sum("tf").alias("tf"), rows.alias("df"), F.sum(total).alias("positions"))


class QueryError(ValueError):
    """The query does not parse."""


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT, NEAR
    parts: tuple
    distance: int = 10


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()+*:,{}^-])|([\w\u0080-￿]+))')


def parse(text: str, columns: list[str]) -> Phrase | Op:
    """Precedence from the tightest: column filters and phrases, a space, NOT, AND, OR. Operators are upper case.

    Parentheses stand alone between operators; a filter before them holds for all
    phrases inside, and one within another for what both allow.
    """
    toks, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError(f"syntax error near {text[at:].strip()[:10]!r}")
        toks.append(("str", m[1].replace('""', '"')) if m[1] is not None else ("sym", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    pos = 0

    def peek(k: int = 0):
        return toks[pos + k] if pos + k < len(toks) else ("end", "")

    def take(*wanted):
        nonlocal pos
        if wanted and peek() not in wanted:
            raise QueryError(f"syntax error near {peek()[1]!r}")
        pos += 1
        return toks[pos - 1]

    def words(s: str) -> tuple[str, ...]:
        import unicodedata

        s = "".join(x for x in unicodedata.normalize("NFD", s) if not unicodedata.combining(x)).lower()
        return tuple("".join(c if c.isalnum() else " " for c in s).split())

    def level(kind, inner):
        parts = [inner()]
        while peek() == ("word", kind):
            take()
            parts.append(inner())
        return parts[0] if len(parts) == 1 else Op(kind, tuple(parts))

    def either():
        return level("OR", both)

    def both():
        return level("AND", minus)

    def minus():
        left = listed()
        while peek() == ("word", "NOT"):
            take()
            left = Op("NOT", (left, listed()))
        return left

    def listed():
        """Phrases parted by spaces, all wanted, or one expression in parentheses."""
        if peek() == ("sym", "("):
            return group(None)
        parts = []
        while not parts or not (peek()[0] == "end" or peek() in (("word", "OR"), ("word", "AND"), ("word", "NOT"), ("sym", ")"))):
            scope = columns_of()
            if scope is not None and peek() == ("sym", "("):
                if parts:
                    raise QueryError("syntax error near '('")
                return group(scope)
            parts.append(near(scope) if peek() == ("word", "NEAR") and peek(1) == ("sym", "(") else phrase(scope))
        return parts[0] if len(parts) == 1 else Op("AND", tuple(parts))

    def group(scope):
        take(("sym", "("))
        inner = either()
        take(("sym", ")"))
        return scoped(inner, scope)

    def columns_of():
        """The columns of a filter that starts here, those it leaves for one that starts with a minus, or None."""
        less = peek() == ("sym", "-")
        at = 1 if less else 0
        if peek(at) == ("sym", "{"):
            names = []
            while peek(at + 1) != ("sym", "}"):
                at += 1
                if peek(at)[0] not in ("word", "str"):
                    raise QueryError(f"syntax error near {peek(at)[1]!r}")
                names.append(peek(at)[1])
            at += 2
        elif peek(at)[0] in ("word", "str") and peek(at + 1) == ("sym", ":"):
            names, at = [peek(at)[1]], at + 1
        elif less:
            raise QueryError("syntax error near '-'")
        else:
            return None
        for _ in range(at):
            take()
        take(("sym", ":"))
        named = known(names)
        return tuple(c for c in columns if c not in named) if less else named

    def near(scope):
        take()
        take()
        parts, distance = [], 10
        while peek() not in (("sym", ")"), ("sym", ",")):
            parts.append(phrase(scope))
        if peek() == ("sym", ","):
            take()
            distance = int(take()[1])
        take(("sym", ")"))
        return Op("NEAR", tuple(parts), distance)

    def known(names):
        for n in names:
            if n.lower() not in [c.lower() for c in columns]:
                raise QueryError(f"no such column: {n}")
        return tuple(c for c in columns if c.lower() in [n.lower() for n in names])

    def scoped(node, scope):
        if scope is None:
            return node
        if isinstance(node, Phrase):
            own = scope if node.columns is None else tuple(c for c in node.columns if c in scope)
            return Phrase(node.terms, node.prefix, node.first, own)
        return Op(node.kind, tuple(scoped(p, scope) for p in node.parts), node.distance)

    def phrase(scope):
        first = peek() == ("sym", "^")
        if first:
            take()
        if peek()[0] not in ("word", "str"):
            raise QueryError(f"syntax error near {peek()[1]!r}")
        terms = words(take()[1])
        while peek() == ("sym", "+"):
            take()
            terms += words(take()[1])
        prefix = peek() == ("sym", "*")
        if prefix:
            take()
        return Phrase(terms, prefix, first, scope)

    if not toks:
        raise QueryError("syntax error: empty query")
    out = either()
    if peek()[0] != "end":
        raise QueryError(f"syntax error near {peek()[1]!r}")
    return out


def _units(node) -> list[Phrase]:
    return [node] if isinstance(node, Phrase) else [u for p in node.parts for u in _units(p)]


def _phrase_starts(lists: DataFrame, u: Phrase) -> DataFrame:
    """``ord, col, starts`` of a phrase; its terms' lists meet by row, each moved to the start it implies."""
    if u.columns is not None:
        lists = lists.filter(F.col("col").isin(*u.columns))
    n, last = len(u.terms), len(u.terms) - 1
    match = [F.col("term").startswith(t) if u.prefix and i == last else F.col("term") == t for i, t in enumerate(u.terms)]
    hits = lists.filter(reduce(lambda a, b: a | b, match))
    if n == 1:
        return hits.select("ord", "col", F.col("positions").alias("starts"))

    def start(i: int) -> Column:
        return F.transform("positions", lambda p: p - i)

    moved = [F.when(m, start(i)).alias(f"s{i}") for i, m in enumerate(match)]
    held = hits.select("ord", "col", *moved).groupBy("ord", "col").agg(*(F.flatten(F.collect_list(f"s{i}")).alias(f"s{i}") for i in range(n)))
    return held.select("ord", "col", reduce(F.array_intersect, [F.col(f"s{i}") for i in range(n)]).alias("starts"))


def _phrase_hits(lists: DataFrame, u: Phrase) -> DataFrame:
    """``ord, col, pos`` where a phrase starts."""
    hits = _phrase_starts(lists, u).select("ord", "col", F.explode("starts").alias("pos"))
    return hits.filter("pos = 0") if u.first else hits


def _phrase_counts(lists: DataFrame, u: Phrase) -> DataFrame:
    """``ord, tf`` of the rows with a phrase. Of a single word no positions are read."""
    if len(u.terms) == 1 and not u.first:
        own = lists if u.columns is None else lists.filter(F.col("col").isin(*u.columns))
        found = own.filter(F.col("term").startswith(u.terms[0]) if u.prefix else F.col("term") == u.terms[0])
    else:
        starts = F.filter("starts", lambda p: p == 0) if u.first else F.col("starts")
        found = _phrase_starts(lists, u).select("ord", F.size(starts).alias("tf")).filter("tf > 0")
    return found.groupBy("ord").agg(F.sum("tf").alias("tf"))


def _near_hits(lists: DataFrame, node: Op) -> DataFrame:
    """Rows where every part occurs within the distance in one column: positions meet by joins of their rows."""
    found = None
    for i, u in enumerate(node.parts):
        own = _phrase_hits(lists, u).select("ord", "col", F.col("pos").alias(f"a{i}"), (F.col("pos") + len(u.terms) - 1).alias(f"b{i}"))
        found = own if found is None else found.join(own, ["ord", "col"])
    k = range(len(node.parts))
    gap = F.greatest(*(F.col(f"a{i}") for i in k), F.lit(-1)) - F.least(*(F.col(f"b{i}") for i in k), F.lit(2**31 - 1)) - 1
    return found.filter(gap <= node.distance).select("ord").distinct()


def match(index: Index, node: Phrase | Op) -> DataFrame:
    """``ord, rank`` of the rows that match; BM25, negative, smaller is better.

    One pass counts every unit in every row that has any; a boolean expression
    over the counts decides the match, and credits only units of sub-expressions
    that match the row.
    """
    units = list(dict.fromkeys(_units(node)))
    hits = None
    for i, u in enumerate(units):
        own = _phrase_counts(index.lists, u).select("ord", F.lit(i).alias("unit"), "tf") if u.terms else None
        hits = own if hits is None else hits if own is None else hits.unionByName(own)
    if hits is None:
        return index.lengths.limit(0).select("ord", F.lit(0.0).alias("rank"))
    rows = hits.groupBy("ord").agg(*(F.coalesce(F.max(F.when(F.col("unit") == i, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in range(len(units))))
    # One row beside all others: the lists are read once for both.
    counts = rows.agg(*(F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"n{i}") for i in range(len(units))))
    rows = rows.join(index.lengths, "ord").crossJoin(F.broadcast(counts))
    nears = [n for n in _ops(node) if n.kind == "NEAR"]
    for j, n in enumerate(nears):
        rows = rows.join(_near_hits(index.lists, n).withColumn(f"near{j}", F.lit(True)), "ord", "left")

    def hit(x) -> Column:
        if isinstance(x, Phrase):
            return F.col(f"tf{units.index(x)}") > 0
        if x.kind == "NEAR":
            return F.coalesce(F.col(f"near{nears.index(x)}"), F.lit(False))
        parts = [hit(p) for p in x.parts]
        if x.kind == "NOT":
            return parts[0] & ~parts[1]
        return reduce(lambda a, b: a & b if x.kind == "AND" else a | b, parts)

    def score(x) -> Column:
        if isinstance(x, Phrase):
            i = units.index(x)
            n, tf = F.col(f"n{i}"), F.col(f"tf{i}").cast("double")
            idf = F.ln((F.lit(float(index.rows)) - n + 0.5) / (n + 0.5))
            idf = F.when(idf <= 0, 1e-6).otherwise(idf)
            return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length or 1.0)))
        parts = x.parts[:1] if x.kind == "NOT" else x.parts
        return reduce(lambda a, b: a + b, (F.when(hit(x) & hit(p), score(p)).otherwise(0.0) for p in parts))

    return rows.filter(hit(node)).select("ord", (-score(node)).alias("rank"))


def _ops(node) -> list[Op]:
    return [] if isinstance(node, Phrase) else [node, *(o for p in node.parts for o in _ops(p))]


def search(spark: SparkSession, chunks: DataFrame, index: Index, query: str, columns: list[str], *, ord_col: str = "ord", where: Column | None = None, limit: int = 5) -> DataFrame:
    """The best ``limit`` rows with their ``rank``, after the filters; ties by ``ord``."""
    found = match(index, parse(query, columns)).withColumnRenamed("ord", "_ord")
    rows = chunks if where is None else chunks.filter(where)
    return rows.join(found, rows[ord_col] == found["_ord"]).drop("_ord").orderBy("rank", ord_col).limit(limit)


def candidates(chunks: DataFrame, index: Index, query: str, columns: list[str], *, ord_col: str = "ord", where: Column | None = None, limit: int | None = 200) -> DataFrame:
    """``ord`` of the first ``limit`` matching rows in row order: the gate of hybrid retrieval; of all in any order where it is None."""
    found = match(index, parse(query, columns)).select(F.col("ord").alias("_ord"))
    rows = chunks if where is None else chunks.filter(where)
    hits = rows.join(found, rows[ord_col] == found["_ord"], "left_semi").select(ord_col)
    return hits if limit is None else hits.orderBy(ord_col).limit(limit)
