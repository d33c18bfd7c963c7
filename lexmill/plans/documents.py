"""Queries of the hierarchy, chunking and key operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import chunk_id, condense, full_citation, mend_hyphens, sanitize
from lexmill.operators import chunking, hierarchy, keys


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_explode(spark, d):
    pages = read(spark, d, "documents").select(F.lit(1).alias("title_number"), F.col("doc_id").alias("page_number"), "text")
    return hierarchy.explode_lines(pages).select(F.col("page_number").alias("doc_id"), "line_no", "raw")


LINE_EXPLODE = r"""
WITH l AS (SELECT doc_id, UNNEST(range(len(string_split(text, chr(10)))))::INTEGER AS line_no, UNNEST(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line_no, NULLIF(regexp_replace(line, '\s+$', ''), '') AS raw FROM l
"""


def page_normalise(spark, d):
    text = condense(mend_hyphens(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.length(text).alias("n"), F.md5(text).alias("digest"))


PAGE_NORMALISE = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(13), ''), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text FROM documents)
SELECT doc_id, length(text)::INTEGER AS n, md5(text) AS digest FROM t
"""


def title_pages(spark, d) -> DataFrame:
    """Documents as pages of one title per source; some of their lines turned into headings, by position."""
    docs = read(spark, d, "documents").select(F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("title_number"), F.col("doc_id").alias("page_number"), "text")

    def line(x, i):
        t = F.col("title_number").cast("string")
        sub = F.element_at(F.array(*(F.lit(v) for v in ("I", "II", "III", "IV"))), (F.col("page_number") % 4 + 1).cast("int"))
        return (
            F.when(i % 11 == 3, F.concat(F.lit("Subtitle "), sub, F.lit(" "), x))
            .when(i % 11 == 6, F.concat(F.lit("Division "), (F.col("page_number") % 3).cast("string"), F.lit(" "), x))
            .when(i % 11 == 7, F.concat(F.lit("Chapter "), t, F.lit("."), (F.col("page_number") % 5).cast("string"), F.when(F.col("page_number") % 2 == 0, F.concat(F.lit(" "), x)).otherwise("")))
            .when(i % 11 == 9, F.concat(t, F.lit("."), (F.col("page_number") % 5).cast("string"), F.lit("."), (F.col("page_number") % 7).cast("string"), F.lit(" "), x))
            .otherwise(x)
        )

    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), line), "\n"))


_LINES = r"""
l0 AS (SELECT CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS t, doc_id AS page, UNNEST(range(len(string_split(text, chr(10)))))::INTEGER AS pos, UNNEST(string_split(text, chr(10))) AS x FROM documents),
l1 AS (SELECT t, page, pos, CASE pos % 11
    WHEN 3 THEN 'Subtitle ' || (['I', 'II', 'III', 'IV'])[page % 4 + 1] || ' ' || x
    WHEN 6 THEN 'Division ' || (page % 3) || ' ' || x
    WHEN 7 THEN 'Chapter ' || t || '.' || (page % 5) || CASE WHEN page % 2 = 0 THEN ' ' || x ELSE '' END
    WHEN 9 THEN t || '.' || (page % 5) || '.' || (page % 7) || ' ' || x ELSE x END AS raw FROM l0),
l2 AS (SELECT t, page, pos, trim(raw) AS line, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS cond, ROW_NUMBER() OVER (PARTITION BY t ORDER BY page, pos) AS ord FROM l1),
l3 AS (SELECT *, CASE WHEN cond = '' THEN 'blank'
    WHEN regexp_matches(cond, '(?i)^subtitle\S*\s([IVXLCDM]+[A-Z]?)[.\-]*(\s.*)?$') AND NOT regexp_matches(trim(regexp_extract(cond, '(?i)^subtitle\S*\s([IVXLCDM]+[A-Z]?)[.\-]*(\s.*)?$', 2)), '^\p{Ll}') THEN 'subtitle'
    WHEN regexp_matches(cond, '(?i)^Division\s+(\d+)\s+(.*)$') THEN 'division'
    WHEN regexp_matches(cond, '(?i)^Chapter\s+' || t || '\.[0-9A-Za-z]+\s+.*$') OR regexp_matches(cond, '^Chapter\s+' || t || '\.[0-9A-Za-z]+\s*$') THEN 'chapter'
    WHEN regexp_matches(cond, '^' || t || '\.[0-9A-Za-z]+(\.[0-9A-Za-z]+)+\s+.*$') THEN 'section' ELSE 'text' END AS k0 FROM l2),
l4 AS (SELECT *, CASE WHEN k0 = 'division' AND COUNT(*) FILTER (k0 = 'subtitle') OVER u = 0 THEN 'text' ELSE k0 END AS k1 FROM l3 WINDOW u AS (PARTITION BY t ORDER BY ord ROWS UNBOUNDED PRECEDING)),
l5 AS (SELECT *, last_value(CASE WHEN k1 IN ('subtitle', 'division', 'chapter') THEN k1 END IGNORE NULLS) OVER (PARTITION BY t ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l4),
l6 AS (SELECT *, CASE WHEN k1 = 'section' AND COALESCE(prev, '') <> 'chapter' THEN 'text' ELSE k1 END AS kind FROM l5),
l7 AS (SELECT *, MAX(CASE WHEN kind = 'subtitle' THEN ord END) OVER u AS s1, MAX(CASE WHEN kind = 'division' THEN ord END) OVER u AS d1,
    MAX(CASE WHEN kind = 'chapter' THEN ord END) OVER u AS c1, MAX(CASE WHEN kind = 'section' THEN ord END) OVER u AS e1 FROM l6 WINDOW u AS (PARTITION BY t ORDER BY ord ROWS UNBOUNDED PRECEDING)),
l8 AS (SELECT *, s1 AS sub, CASE WHEN d1 > COALESCE(s1, 0) THEN d1 END AS div, CASE WHEN c1 > GREATEST(COALESCE(s1, 0), COALESCE(d1, 0)) THEN c1 END AS chap FROM l7),
l9 AS (SELECT *, CASE WHEN e1 > chap THEN e1 END AS sec, CASE
    WHEN kind = 'subtitle' THEN trim(regexp_extract(cond, '(?i)^subtitle\S*\s([IVXLCDM]+[A-Z]?)[.\-]*(\s.*)?$', 2))
    WHEN kind = 'division' THEN trim(regexp_extract(cond, '(?i)^Division\s+(\d+)\s+(.*)$', 2))
    WHEN kind = 'chapter' THEN trim(regexp_extract(cond, '(?i)^Chapter\s+' || t || '\.[0-9A-Za-z]+\s+(.*)$', 1))
    WHEN kind = 'section' THEN trim(regexp_extract(cond, '^' || t || '\.[0-9A-Za-z]+(\.[0-9A-Za-z]+)+\s+(.*)$', 2)) END AS title FROM l8)
"""


def heading_classify(spark, d):
    x = hierarchy.carry_forward(hierarchy.headings(hierarchy.explode_lines(title_pages(spark, d))))
    return x.groupBy("title_number", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").cast("long").alias("ords"))


HEADING_CLASSIFY = "WITH " + _LINES + "SELECT t AS title_number, kind, COUNT(*) AS n, SUM(ord)::BIGINT AS ords FROM l9 GROUP BY t, kind"


def carry_forward(spark, d):
    x = hierarchy.carry_forward(hierarchy.headings(hierarchy.explode_lines(title_pages(spark, d))))
    return x.select("title_number", "ord", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("sub", "div", "chap", "sec")))


CARRY_FORWARD = "WITH " + _LINES + "SELECT t AS title_number, ord::INTEGER AS ord, COALESCE(sub, 0)::INTEGER AS sub, COALESCE(div, 0)::INTEGER AS div, COALESCE(chap, 0)::INTEGER AS chap, COALESCE(sec, 0)::INTEGER AS sec FROM l9"


def hierarchy_nodes(spark, d):
    n = hierarchy.nodes(hierarchy.carry_forward(hierarchy.headings(hierarchy.explode_lines(title_pages(spark, d)))))
    return n.select("title_number", F.col("node").cast("long").alias("node"), "kind", "number", "title", "start_page", "end_page", F.length("text").cast("long").alias("n_text"))


_NODES = (
    _LINES
    + r""",
m1 AS (SELECT *, MAX(CASE WHEN kind = 'subtitle' THEN title END) OVER (PARTITION BY t, sub) AS st, MAX(CASE WHEN kind = 'chapter' THEN title END) OVER (PARTITION BY t, chap) AS ct FROM l9),
m2 AS (SELECT *, MIN(CASE WHEN kind = 'text' AND lower(line) <> 'sections:' AND sub IS NOT NULL AND st = '' AND chap IS NULL AND NOT regexp_matches(lower(line), '^subtitle\b') AND NOT starts_with(lower(line), 'chapter ') THEN ord END) OVER (PARTITION BY t, sub) AS fs,
    MIN(CASE WHEN kind = 'text' AND lower(line) <> 'sections:' AND chap IS NOT NULL AND ct = '' AND sec IS NULL THEN ord END) OVER (PARTITION BY t, chap) AS fc FROM m1),
m3 AS (SELECT *, CASE WHEN ord = fs THEN 1 WHEN ord = fc THEN 2 END AS fill, kind IN ('subtitle', 'division', 'chapter', 'section') AS head,
    CASE WHEN kind IN ('subtitle', 'division', 'chapter', 'section') THEN ord WHEN ord = fs THEN sub WHEN ord = fc THEN chap ELSE COALESCE(sec, chap, div, sub, 0) END AS owner FROM m2),
n0 AS (SELECT t AS title_number, owner::BIGINT AS node, COALESCE(MAX(kind) FILTER (head), 'preface') AS kind,
    MAX(CASE kind WHEN 'subtitle' THEN 'Subtitle ' || upper(regexp_extract(cond, '(?i)^subtitle\S*\s([IVXLCDM]+[A-Z]?)', 1)) WHEN 'division' THEN regexp_extract(cond, '(?i)^Division\s+(\d+)', 1)
      WHEN 'chapter' THEN regexp_extract(cond, '(?i)^Chapter\s+(\d+\.[0-9A-Za-z]+)', 1) WHEN 'section' THEN regexp_extract(cond, '^(\d+\.[0-9A-Za-z]+(\.[0-9A-Za-z]+)+)\s', 1) END) FILTER (head) AS number,
    COALESCE(NULLIF(MAX(title) FILTER (head), ''), MAX(line) FILTER (fill IS NOT NULL), '') AS title,
    MAX(page) FILTER (head) AS start_page, MAX(page) AS end_page,
    trim(COALESCE(string_agg(CASE WHEN kind = 'blank' THEN '' ELSE line END, chr(10) ORDER BY ord) FILTER (NOT head AND fill IS NULL), ''), chr(10) || ' ') AS body
  FROM m3 GROUP BY t, owner)
"""
)
HIERARCHY_NODES = "WITH " + _NODES + "SELECT title_number, node, kind, number, title, start_page, end_page, length(body)::BIGINT AS n_text FROM n0"


def section_dedup(spark, d):
    rows = read(spark, d, "documents").select("source", "lang", F.col("doc_id").alias("node"), (F.col("n_chars") > 1500).alias("has_body"))
    return hierarchy.dedup_sections(rows, ["source", "lang"]).select("source", "lang", "node", "slot")


SECTION_DEDUP = "SELECT source, lang, arg_max(doc_id, (n_chars > 1500)::BIGINT * 1000000000000 + doc_id) AS node, MIN(doc_id) AS slot FROM documents GROUP BY source, lang"


def subtitle_dedup(spark, d):
    rows = read(spark, d, "documents").select(F.lower("source").alias("number"), F.col("doc_id").alias("node"), F.floor(F.col("n_chars") / 1000).alias("weight"))
    return hierarchy.dedup_subtitles(rows, ["number"]).select("number", "node", "weight", "slot")


SUBTITLE_DEDUP = "SELECT number, arg_max(node, weight * 1000000000000 + node) AS node, MAX(weight) AS weight, MIN(node) AS slot FROM (SELECT lower(source) AS number, doc_id AS node, floor(n_chars / 1000)::BIGINT AS weight FROM documents) GROUP BY number"


def title_range(spark, d):
    docs = read(spark, d, "documents")
    text = F.concat(F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("  TITLE "), (F.col("doc_id") / 100).cast("int"), F.lit(" "))).otherwise(""), F.col("text"))
    return hierarchy.title_range(docs.select(F.col("doc_id").alias("page_number"), text.alias("text")), 1, 2).select("title_number", "page_number", F.length("text").alias("n"))


TITLE_RANGE = """
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN '  TITLE ' || (doc_id // 100) || ' ' ELSE '' END || text AS text FROM documents),
a AS (SELECT MIN(doc_id) AS lo FROM p WHERE regexp_matches(trim(text), '(?i)^Title 1\\b')),
b AS (SELECT MIN(doc_id) AS hi FROM p, a WHERE regexp_matches(trim(text), '(?i)^Title 2\\b') AND doc_id > lo)
SELECT 1 AS title_number, doc_id AS page_number, length(text)::INTEGER AS n FROM p, a, b WHERE doc_id >= lo AND (hi IS NULL OR doc_id < hi)
"""


def word_pack(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(chunking.word_pack(F.col("text"))).alias("i", "chunk"))
    return docs.select("doc_id", "i", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


_PACK = """list_reduce(list_prepend({'done': []::VARCHAR[], 'line': ''}, list_transform(%s, lambda w: {'done': []::VARCHAR[], 'line': w})),
  lambda acc, x: CASE WHEN acc.line = '' THEN {'done': acc.done, 'line': x.line}
    WHEN length(acc.line) + 1 + length(x.line) <= 900 THEN {'done': acc.done, 'line': acc.line || ' ' || x.line}
    ELSE {'done': list_append(acc.done, acc.line), 'line': x.line} END)"""
_WORDS = r"list_filter(regexp_split_to_array(%s, '\s+'), lambda w: w <> '')"
_CHUNKS = f"packed AS (SELECT doc_id, source, lang, {_PACK % (_WORDS % 'text')} AS r FROM documents),\nchunks AS (SELECT doc_id, source, lang, UNNEST(range(len(c)))::INTEGER AS i, UNNEST(c) AS chunk FROM (SELECT doc_id, source, lang, CASE WHEN r.line = '' THEN r.done ELSE list_append(r.done, r.line) END AS c FROM packed))\n"
WORD_PACK = "WITH " + _CHUNKS + "SELECT doc_id, i, length(chunk)::INTEGER AS n, md5(chunk) AS digest FROM chunks"


def paragraph_pack(spark, d):
    turns = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n\n").alias("text"))
    out = turns.select("conv_id", F.posexplode(chunking.paragraph_pack(F.col("text"))).alias("i", "chunk"))
    return out.select("conv_id", "i", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


PARAGRAPH_PACK = f"""
WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, UNNEST(range(len(ps))) AS k, trim(UNNEST(ps), ' ' || chr(10)) AS p FROM (SELECT conv_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM t)),
w AS (SELECT conv_id, k, p, {_PACK % (_WORDS % 'p')} AS r FROM p WHERE p <> ''),
x AS (SELECT conv_id, list({{'p': p, 'ws': CASE WHEN r.line = '' THEN r.done ELSE list_append(r.done, r.line) END}} ORDER BY k) AS ps FROM w GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'held': '', 'ws': []::VARCHAR[]}}, list_transform(ps, lambda q: {{'done': []::VARCHAR[], 'held': q.p, 'ws': q.ws}})),
  lambda a, q: CASE WHEN length(q.held) > 900 THEN {{'done': list_concat(CASE WHEN a.held = '' THEN a.done ELSE list_append(a.done, a.held) END, q.ws), 'held': '', 'ws': []::VARCHAR[]}}
    WHEN a.held = '' THEN {{'done': a.done, 'held': q.held, 'ws': []::VARCHAR[]}}
    WHEN length(a.held) + 2 + length(q.held) > 900 THEN {{'done': list_append(a.done, a.held), 'held': q.held, 'ws': []::VARCHAR[]}}
    ELSE {{'done': a.done, 'held': a.held || chr(10) || chr(10) || q.held, 'ws': []::VARCHAR[]}} END) AS r FROM x),
c AS (SELECT conv_id, CASE WHEN r.held = '' THEN r.done ELSE list_append(r.done, r.held) END AS c FROM f)
SELECT conv_id, i, length(chunk)::INTEGER AS n, md5(chunk) AS digest FROM (SELECT conv_id, UNNEST(range(len(c)))::INTEGER AS i, UNNEST(c) AS chunk FROM c)
"""


def document_chunks(spark, d) -> DataFrame:
    """Documents as a chunk table: source for chapter, document for section."""
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(chunking.word_pack(F.col("text"))).alias("i", "text"))
    number, section = F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.concat(F.lit("0"), F.col("source"), F.lit("."), F.col("doc_id"))
    return docs.select("doc_id", "lang", number.alias("title_number"), chunk_id(number, F.col("source"), section, F.col("i")).alias("chunk_id"), full_citation(section).alias("full_citation"), section.alias("section_citation"), "text", F.length("text").alias("char_count"))


def chunk_table(spark, d):
    return document_chunks(spark, d).select("chunk_id", "title_number", "full_citation", "char_count", F.md5("text").alias("digest"))


CHUNK_TABLE = (
    "WITH "
    + _CHUNKS
    + r"""SELECT 'smc-' || regexp_extract(source, '(\d+)', 1) || '-' || lower(source) || '-section-' || trim(lower(regexp_replace('0' || source || '.' || doc_id, '[^0-9a-zA-Z]+', '-', 'g')), '-') || '-' || i AS chunk_id,
  regexp_extract(source, '(\d+)', 1)::INTEGER AS title_number, 'SMC ' || regexp_replace('0' || source || '.' || doc_id, '^0+', '') AS full_citation, length(chunk)::INTEGER AS char_count, md5(chunk) AS digest FROM chunks"""
)


def citations(spark, d):
    p = read(spark, d, "part")
    raw = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("  00"), "p_brand", F.lit(" "))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("Chapter "), "p_type")).when(F.col("p_size") % 5 == 2, F.lit("")).when(F.col("p_size") % 5 == 3, F.lit("--")).otherwise(F.col("p_name"))
    return p.select("p_partkey", full_citation(raw).alias("citation"), sanitize(raw).alias("slug"))


CITATIONS = r"""
WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '  00' || p_brand || ' ' WHEN 1 THEN 'Chapter ' || p_type WHEN 2 THEN '' WHEN 3 THEN '--' ELSE p_name END AS raw FROM part)
SELECT p_partkey, CASE WHEN raw = '' THEN NULL WHEN regexp_matches(lower(trim(raw)), '^(smc|title|chapter)') THEN trim(raw) ELSE 'SMC ' || regexp_replace(trim(raw), '^0+', '') END AS citation,
  COALESCE(NULLIF(trim(lower(regexp_replace(raw, '[^0-9a-zA-Z]+', '-', 'g')), '-'), ''), 'unknown') AS slug FROM r
"""


def keep_first(spark, d):
    rows = read(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return keys.keep_first(rows, "key", "doc_id")


def keep_last(spark, d):
    rows = read(spark, d, "documents").select(F.md5("text").alias("key"), "doc_id", "source")
    return keys.keep_last(rows, "key", "doc_id")


_KEEP = "SELECT key, doc_id, source FROM (SELECT md5(text) AS key, doc_id, source, ROW_NUMBER() OVER (PARTITION BY md5(text) ORDER BY doc_id {0}) AS k FROM documents) WHERE k = 1"


def pipeline_counts(spark, d):
    c = document_chunks(spark, d)
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("char_count") > 450).alias("long_chunks"), F.count_distinct("chunk_id").alias("ids"))


PIPELINE_COUNTS = "WITH " + _CHUNKS + "SELECT COUNT(*) AS total, COUNT(*) FILTER (length(chunk) > 450) AS long_chunks, COUNT(DISTINCT doc_id || '-' || i) AS ids FROM chunks"

QUERIES = {f.__name__: f for f in (line_explode, page_normalise, heading_classify, carry_forward, hierarchy_nodes, section_dedup, subtitle_dedup, title_range, word_pack, paragraph_pack, chunk_table, citations, keep_first, keep_last, pipeline_counts)}
ORACLES = {"line_explode": LINE_EXPLODE, "page_normalise": PAGE_NORMALISE, "heading_classify": HEADING_CLASSIFY, "carry_forward": CARRY_FORWARD, "hierarchy_nodes": HIERARCHY_NODES, "section_dedup": SECTION_DEDUP, "subtitle_dedup": SUBTITLE_DEDUP, "title_range": TITLE_RANGE, "word_pack": WORD_PACK, "paragraph_pack": PARAGRAPH_PACK, "chunk_table": CHUNK_TABLE, "citations": CITATIONS, "keep_first": _KEEP.format("ASC"), "keep_last": _KEEP.format("DESC"), "pipeline_counts": PIPELINE_COUNTS}
