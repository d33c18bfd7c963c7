"""Queries of full-text, vector and hybrid retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import compose, fulltext, vectors
from lexmill.operators import retrieval as R
from lexmill.plans.documents import read
from lexmill.sources.folders import scratch

_TOKENS = r"""
tok AS (SELECT doc_id AS ord, UNNEST(range(len(ts)))::INTEGER AS pos, UNNEST(ts) AS term FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS ts FROM documents)),
dl AS (SELECT ord, COUNT(*) AS dl FROM tok GROUP BY ord),
corpus AS (SELECT (SELECT COUNT(*) FROM documents) AS n, (SELECT COUNT(*) FROM tok) / (SELECT COUNT(*) FROM documents) AS avgdl)
"""


_STORED: dict[tuple, str] = {}


def _index(spark, d):
    """The documents and their stored index, which the session's first search of a folder writes."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text", "lang", "source")
    key = spark.sparkContext.applicationId, str(d)
    if key not in _STORED:
        path = scratch(spark, "postings")
        fulltext.write_index(docs, "ord", ["text"], path)
        _STORED[key] = path
    return docs, fulltext.open_index(spark, _STORED[key])


def _bm25(units: list[str]) -> str:
    """SQL of idf and tf for units whose hits are in CTEs u0, u1, … of (ord, tf)."""
    parts = [
        f"s{i} AS (SELECT u{i}.ord, CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM u{i} JOIN dl USING (ord), corpus, (SELECT COUNT(*) AS c FROM u{i}))"
        for i in range(len(units))
    ]
    return ",\n".join([f"u{i} AS ({u})" for i, u in enumerate(units)] + parts)


def _term(t: str) -> str:
    return f"SELECT ord, COUNT(*) AS tf FROM tok WHERE term = '{t}' GROUP BY ord"


def index_build(spark, d):
    """Builds the index anew and stores it: the corpus numbers."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    path = scratch(spark, "index")
    fulltext.write_index(docs, "ord", ["text"], path)
    return spark.read.parquet(f"{path}/numbers")


INDEX_BUILD = "WITH " + _TOKENS + "SELECT (SELECT COUNT(*) FROM documents) AS rows, COUNT(*) AS tokens FROM tok"


def fts_two_columns(spark, d):
    """Ids and texts are indexed, and a column filter picks one; the citation falls back to the id."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("smc-"), F.col("lang"), F.lit("-"), F.col("doc_id")).alias("chunk_id"), "text")
    docs = docs.withColumn("full_citation", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("SMC "), "ord"))).withColumn("section_heading", F.lit(None).cast("string")).withColumn("title_number", (F.col("ord") % 3).cast("int")).withColumn("title_label", F.lit("T")).withColumn("section_citation", F.lit("23.44"))
    path = scratch(spark, "two")
    fulltext.write_index(docs, "ord", ["chunk_id", "text"], path)
    found = R.search_text(spark, docs, fulltext.open_index(spark, path), "chunk_id : es AND text : para", title=1, citation="23.", limit=30)
    return found.select("chunk_id", "citation", "section_heading", "title_number", "title_label", F.round("rank", 6).alias("rank"))


FTS_TWO_COLUMNS = r"""
WITH tok AS (
  SELECT doc_id AS ord, 'text' AS col, UNNEST(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM documents
  UNION ALL SELECT doc_id, 'chunk_id', UNNEST(['smc', lang, doc_id::VARCHAR]) FROM documents),
dl AS (SELECT ord, COUNT(*) AS dl FROM tok GROUP BY ord),
corpus AS (SELECT (SELECT COUNT(*) FROM documents) AS n, (SELECT COUNT(*) FROM tok) / (SELECT COUNT(*) FROM documents) AS avgdl),
u0 AS (SELECT ord, COUNT(*) AS tf FROM tok WHERE col = 'chunk_id' AND term = 'es' GROUP BY ord),
u1 AS (SELECT ord, COUNT(*) AS tf FROM tok WHERE col = 'text' AND term = 'para' GROUP BY ord),
s0 AS (SELECT ord, greatest(ln((n - c + 0.5) / (c + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM u0 JOIN dl USING (ord), corpus, (SELECT COUNT(*) AS c FROM u0)),
s1 AS (SELECT ord, greatest(ln((n - c + 0.5) / (c + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM u1 JOIN dl USING (ord), corpus, (SELECT COUNT(*) AS c FROM u1))
SELECT 'smc-' || lang || '-' || doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'SMC ' || doc_id ELSE 'smc-' || lang || '-' || doc_id END AS citation, '' AS section_heading, (doc_id % 3)::INTEGER AS title_number, 'T' AS title_label, round(-(s0.s + s1.s), 6) AS rank
FROM documents JOIN s0 ON s0.ord = doc_id JOIN s1 ON s1.ord = doc_id WHERE doc_id % 3 = 1 ORDER BY s0.s + s1.s DESC, doc_id LIMIT 30
"""


def fts_index(spark, d):
    _, index = _index(spark, d)
    return fulltext.term_counts(index)


FTS_INDEX = "WITH " + _TOKENS + "SELECT term, COUNT(*) AS tf, COUNT(DISTINCT ord) AS df, SUM(pos)::BIGINT AS positions FROM tok GROUP BY term"


def doc_stats(spark, d):
    return _index(spark, d)[1].lengths.select(F.col("ord").alias("doc_id"), "dl")


DOC_STATS = "WITH " + _TOKENS + "SELECT ord AS doc_id, dl FROM dl"


def _ranked(spark, d, query, where=None, limit=20):
    docs, index = _index(spark, d)
    found = fulltext.search(spark, docs, index, query, ["text"], where=where, limit=limit)
    return found.select(F.col("ord").alias("doc_id"), "lang", F.round("rank", 6).alias("rank"))


def _ranked_sql(units, rank, where, limit=20):
    return "WITH " + _TOKENS + "," + _bm25(units) + f"\nSELECT d.doc_id, d.lang, round(-({rank}), 6) AS rank FROM documents d " + " ".join(f"LEFT JOIN s{i} ON s{i}.ord = d.doc_id" for i in range(len(units))) + f" WHERE {where} ORDER BY {rank} DESC, d.doc_id LIMIT {limit}"


def bm25_topk(spark, d):
    """Flagship: the best 20 documents of two terms."""
    return _ranked(spark, d, "with from")


BM25_TOPK = _ranked_sql([_term("with"), _term("from")], "s0.s + s1.s", "s0.s IS NOT NULL AND s1.s IS NOT NULL")


def bm25_filtered(spark, d):
    return _ranked(spark, d, "para OR por OR con", where=F.col("lang") == "es")


BM25_FILTERED = _ranked_sql([_term("para"), _term("por"), _term("con")], "COALESCE(s0.s, 0) + COALESCE(s1.s, 0) + COALESCE(s2.s, 0)", "d.lang = 'es' AND (s0.s IS NOT NULL OR s1.s IS NOT NULL OR s2.s IS NOT NULL)")


def bm25_gated(spark, d):
    """A row that lacks ``from`` gets no credit for ``with``."""
    return _ranked(spark, d, "this OR (with AND from)", limit=50)


BM25_GATED = _ranked_sql([_term("this"), _term("with"), _term("from")], "COALESCE(s0.s, 0) + CASE WHEN s1.s IS NOT NULL AND s2.s IS NOT NULL THEN s1.s + s2.s ELSE 0 END", "s0.s IS NOT NULL OR (s1.s IS NOT NULL AND s2.s IS NOT NULL)", 50)


def _hits(spark, d, query, limit):
    docs, index = _index(spark, d)
    return fulltext.candidates(docs, index, query, ["text"], limit=limit).select(F.col("ord").alias("doc_id"))


def fts_boolean(spark, d):
    return _hits(spark, d, "(with OR for) NOT from", None)


FTS_BOOLEAN = "WITH " + _TOKENS + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT ord FROM tok WHERE term IN ('with', 'for')) AND doc_id NOT IN (SELECT ord FROM tok WHERE term = 'from')"


def fts_precedence(spark, d):
    """NOT binds closer than AND."""
    return _hits(spark, d, "with NOT this AND for", None)


FTS_PRECEDENCE = "WITH " + _TOKENS + "SELECT doc_id FROM documents WHERE doc_id IN (SELECT ord FROM tok WHERE term = 'with') AND doc_id IN (SELECT ord FROM tok WHERE term = 'for') AND doc_id NOT IN (SELECT ord FROM tok WHERE term = 'this')"


def fts_phrase(spark, d):
    return _ranked(spark, d, '"of the"')


FTS_PHRASE = _ranked_sql(["SELECT a.ord, COUNT(*) AS tf FROM tok a JOIN tok b ON a.ord = b.ord AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.ord"], "s0.s", "s0.s IS NOT NULL")


def fts_prefix(spark, d):
    return _ranked(spark, d, "wit* AND text : that")


FTS_PREFIX = _ranked_sql(["SELECT ord, COUNT(*) AS tf FROM tok WHERE starts_with(term, 'wit') GROUP BY ord", _term("that")], "s0.s + s1.s", "s0.s IS NOT NULL AND s1.s IS NOT NULL")


def fts_near(spark, d):
    return _hits(spark, d, "NEAR(with from, 3)", None)


FTS_NEAR = "WITH " + _TOKENS + "SELECT DISTINCT a.ord AS doc_id FROM tok a JOIN tok b ON a.ord = b.ord AND abs(a.pos - b.pos) - 1 <= 3 WHERE a.term = 'with' AND b.term = 'from'"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")


def _asked(spark, d, every):
    rows = read(spark, d, "embeddings").filter(F.col("vec_id") % every == 0)
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


def _search(asked, rows, k, **more):
    return vectors.search_many(asked, rows, k, request_key="query_id", keep=["query_id", "ord"], **more)


def _top(found, *more):
    return found.select("query_id", "rank", F.col("ord").alias("vec_id"), F.round("score", 6).alias("score"), *more)


_DOT = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"
_RANKED = "SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"


def vector_topk(spark, d):
    return _top(_search(_asked(spark, d, 100), _vectors(spark, d), 5))


VECTOR_TOPK = f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) " + _RANKED.format(k=5)


def vector_filtered_topk(spark, d):
    return _top(_search(_asked(spark, d, 100), _vectors(spark, d), 10, where=F.col("label").isin(1, 3)))


VECTOR_FILTERED_TOPK = f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.label IN (1, 3)) " + _RANKED.format(k=10)


def evidence_fanout(spark, d):
    """Each request has a count of its own."""
    asked = _asked(spark, d, 100).withColumn("top_k", (F.col("query_id") / 100 % 4 + 1).cast("int"))
    return _top(_search(asked, _vectors(spark, d), F.col("top_k")))


EVIDENCE_FANOUT = f"WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= floor(query_id / 100.0 % 4 + 1)"


def hybrid_gate(spark, d):
    """Full text only restricts the rows; the vector score alone ranks them."""
    docs, index = _index(spark, d)
    gate = fulltext.candidates(docs, index, "with OR para", ["text"]).withColumnRenamed("ord", "_o")
    rows = _vectors(spark, d).join(gate, F.col("ord") == F.col("_o"), "left_semi")
    return _top(_search(_asked(spark, d, 100), rows, 5))


HYBRID_GATE = "WITH " + _TOKENS + f", g AS (SELECT DISTINCT ord FROM tok WHERE term IN ('with', 'para') ORDER BY ord LIMIT 200), s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id IN (SELECT ord FROM g)) " + _RANKED.format(k=5)


def l2_normalise(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3 + 1))
    out = read(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise(scaled)).alias("i", "x"))
    return out.select("vec_id", "i", F.round("x", 6).alias("x"))


L2_NORMALISE = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 3 + 1)) AS v FROM embeddings), n AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM v) SELECT vec_id, UNNEST(range(len(v)))::INTEGER AS i, round(UNNEST(v) / n, 6) AS x FROM n"


def mean_pool(spark, d):
    rows = read(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 2).cast("int"))
    out = vectors.masked_mean(rows, "label", "embedding", "mask").select("label", F.posexplode("pooled").alias("i", "x"))
    return out.select("label", "i", F.round("x", 6).alias("x"))


MEAN_POOL = "WITH c AS (SELECT label, vec_id % 2 AS m, UNNEST(range(len(embedding)))::INTEGER AS i, UNNEST(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i, round(SUM(x * m) / greatest(SUM(m)::DOUBLE, 1e-9), 6) AS x FROM c GROUP BY label, i"


def citation_prefix(spark, d):
    p = read(spark, d, "part")
    return p.filter(R.every(R.citation_like("br_nd#1", "p_brand"), None)).select("p_partkey", "p_brand", R.citation_starts("Brand#1", "p_brand").alias("starts"))


CITATION_PREFIX = "SELECT p_partkey, p_brand, starts_with(p_brand, 'Brand#1') AS starts FROM part WHERE p_brand ILIKE 'br_nd#1%'"


def type_filter(spark, d):
    c = read(spark, d, "customer")
    return c.filter(R.every(R.title_is(3, "c_nationkey"), R.type_in(["BUILDING", "MACHINERY"], "c_mktsegment"))).select("c_custkey", "c_mktsegment")


TYPE_FILTER = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"


def _evidence(items, text):
    rows = items.select(F.concat(F.lit("part "), (F.col("item_id") % 3).cast("string")).alias("label"), F.col("item_id").alias("rank"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("SMC "), "item_id")).alias("full_citation"), F.concat(F.lit("c"), "item_id").alias("chunk_id"), F.lit(None).cast("string").alias("section_heading"), text.alias("text"))
    return compose.evidence_blocks(rows).select("label", F.length("block").alias("n"), F.md5("block").alias("digest"))


def evidence_prompt(spark, d):
    """All items with whole texts."""
    return _evidence(read(spark, d, "benchmark"), F.col("text"))


EVIDENCE_PROMPT = r"""
WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark),
b AS (SELECT 'part ' || item_id % 3 AS label, item_id, '[' || CASE WHEN item_id % 2 = 0 THEN 'SMC ' || item_id ELSE 'c' || item_id END || '] ' || chr(10) || CASE WHEN length(t) <= 1200 THEN t ELSE regexp_replace(substr(t, 1, 1199), ' [^ ]*$', '') || ' …' END AS p FROM c),
t AS (SELECT label, upper(label) || ':' || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY item_id) AS block FROM b GROUP BY label)
SELECT label, length(block)::INTEGER AS n, md5(block) AS digest FROM t
"""

_ALL = (index_build, fts_two_columns, fts_index, doc_stats, bm25_topk, bm25_filtered, bm25_gated, fts_boolean, fts_precedence, fts_phrase, fts_prefix, fts_near, vector_topk, vector_filtered_topk, evidence_fanout, hybrid_gate, l2_normalise, mean_pool, citation_prefix, type_filter, evidence_prompt)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
