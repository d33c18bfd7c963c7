"""Queries of record matching, rules and project analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import scalars as S
from lexmill.operators import matching, rules
from lexmill.plans.documents import read

_PARCEL_SQL = """
parcels AS (SELECT c_custkey::VARCHAR AS PIN, (c_custkey % 60)::VARCHAR || ' ' || c_mktsegment || ' ' || CASE c_nationkey % 4 WHEN 0 THEN 'St' WHEN 1 THEN 'Ave' WHEN 2 THEN 'Dr' ELSE 'Rd' END AS ADDR_FULL,
  c_custkey % 60 AS ADDR_NUM, CASE WHEN c_nationkey % 5 = 0 THEN 'Tacoma' ELSE 'Seattle' END AS CTYNAME, c_mktsegment AS ADDR_SN, CASE c_nationkey % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'AVE' WHEN 2 THEN 'DR' ELSE 'RD' END AS ADDR_ST,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS PRIMARY_ADDR, CASE WHEN c_custkey % 7 = 0 THEN 'B' END AS UNIT_NUM FROM customer),
asked AS (SELECT c_custkey AS request, CASE c_custkey % 100 // 25 WHEN 0 THEN ' ' || (c_custkey % 60) || '  ' || lower(c_mktsegment) || ' Street, Seattle WA 98101' WHEN 1 THEN c_mktsegment || ' avenue' WHEN 2 THEN (c_custkey % 60) || ' ' || substr(c_mktsegment, 1, 4) || ' road' ELSE (c_custkey % 60) || ' Nowhere Boulevard' END AS asked
  FROM customer),
n0 AS (SELECT request, asked, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(trim(asked)), '\\s+', ' ', 'g'), ',.*$', ''), 'SEATTLE.*$', ''), 'WA.*$', ''), '\\d{5}.*$', '') AS a FROM asked),
n1 AS (SELECT request, asked, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\\bSTREET\\b', 'ST', 'g'), '\\bAVENUE\\b', 'AVE', 'g'), '\\bDRIVE\\b', 'DR', 'g'), '\\bROAD\\b', 'RD', 'g'), '\\bBOULEVARD\\b', 'BLVD', 'g'), '\\bNORTH\\b', 'N', 'g'), '\\bSOUTH\\b', 'S', 'g'), '\\bEAST\\b', 'E', 'g'), '\\bWEST\\b', 'W', 'g')) AS norm FROM n0),
req AS (SELECT *, NULLIF(regexp_extract(norm, '^(\\d+)\\s+(.+)$', 1), '') AS number, COALESCE(NULLIF(regexp_extract(norm, '^(\\d+)\\s+(.+)$', 2), ''), norm) AS street FROM n1)
"""


def _parcels(spark, d):
    c = read(spark, d, "customer")
    kind = F.element_at(F.array(*(F.lit(v) for v in ("St", "Ave", "Dr", "Rd"))), F.col("c_nationkey") % 4 + 1)
    return c.select(
        F.col("c_custkey").cast("string").alias("PIN"),
        F.concat_ws(" ", (F.col("c_custkey") % 60).cast("string"), "c_mktsegment", kind).alias("ADDR_FULL"),
        (F.col("c_custkey") % 60).alias("ADDR_NUM"),
        F.when(F.col("c_nationkey") % 5 == 0, "Tacoma").otherwise("Seattle").alias("CTYNAME"),
        F.lit(None).cast("string").alias("ADDR_PD"),
        F.col("c_mktsegment").alias("ADDR_SN"),
        F.upper(kind).alias("ADDR_ST"),
        F.lit(None).cast("string").alias("ADDR_SD"),
        F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("PRIMARY_ADDR"),
        F.when(F.col("c_custkey") % 7 == 0, "B").alias("UNIT_NUM"),
    )


def _requests(spark, d):
    """A request of every customer."""
    c, n = read(spark, d, "customer"), (F.col("c_custkey") % 60).cast("string")
    form = F.floor(F.col("c_custkey") % 100 / 25)
    text = F.when(form == 0, F.concat(F.lit(" "), n, F.lit("  "), F.lower("c_mktsegment"), F.lit(" Street, Seattle WA 98101"))).when(form == 1, F.concat("c_mktsegment", F.lit(" avenue")))
    text = text.when(form == 2, F.concat(n, F.lit(" "), F.substring("c_mktsegment", 1, 4), F.lit(" road"))).otherwise(F.concat(n, F.lit(" Nowhere Boulevard")))
    return matching.requests_of(c.withColumn("asked_", text), "c_custkey", "asked_")


def _norms(requests):
    return requests.select("request", "norm", "number", "street", F.array_join("required", "|").alias("tokens"))


def address_norm(spark, d):
    return _norms(_requests(spark, d))


ADDRESS_NORM = "WITH " + _PARCEL_SQL + "SELECT request, norm, number, street, array_to_string(list_filter(list_transform(string_split(street, ' '), lambda t: regexp_replace(upper(t), '[^A-Z0-9]', '', 'g')), lambda t: t <> ''), '|') AS tokens FROM req"

_FOUND = (
    _PARCEL_SQL
    + """,
p AS (SELECT *, upper(ADDR_FULL) AS f, ADDR_NUM::VARCHAR AS num FROM parcels WHERE upper(CTYNAME) = 'SEATTLE'),
att AS (
  SELECT r.*, p.*, 1 AS attempt FROM req r JOIN p ON starts_with(f, norm) AND (number IS NULL OR number = num) WHERE norm <> ''
  UNION ALL SELECT r.*, p.*, 2 FROM req r JOIN p ON number = num AND starts_with(f, number || ' ' || string_split(street, ' ')[1]) WHERE string_split(street, ' ')[1] <> ''
  UNION ALL SELECT r.*, p.*, 3 FROM req r JOIN p ON contains(f, street) WHERE street <> ''
  UNION ALL SELECT r.*, p.*, 4 FROM req r JOIN p ON number = num),
fst AS (SELECT * FROM att QUALIFY attempt = MIN(attempt) OVER (PARTITION BY request)),
found AS (SELECT * FROM fst QUALIFY ROW_NUMBER() OVER (PARTITION BY request ORDER BY ADDR_FULL, PIN) <= 10)"""
)


def cascade_lookup(spark, d):
    return matching.lookup(_requests(spark, d), _parcels(spark, d)).select("request", "attempt", "PIN")


CASCADE_LOOKUP = "WITH " + _FOUND + " SELECT request, attempt, PIN FROM found"

_SCORED = (
    _FOUND
    + """,
tk AS (SELECT *, list_filter(list_transform(string_split(street, ' '), lambda t: regexp_replace(upper(t), '[^A-Z0-9]', '', 'g')), lambda t: t <> '') AS required, [ADDR_SN, ADDR_ST] AS own, f AS nf FROM found),
h AS (SELECT *, len(required) AS need, len(list_filter(required, lambda t: list_contains(own, t))) AS hits FROM tk),
a AS (SELECT *, need = 0 OR hits = need AS street_all, MAX((need > 0 AND hits = need)::INTEGER) OVER (PARTITION BY request) AS any_all FROM h),
sc AS (SELECT *, CASE WHEN nf = norm THEN 120 WHEN starts_with(nf, norm) THEN 80 WHEN contains(nf, norm) THEN 40 ELSE 0 END
  + CASE WHEN number IS NULL THEN 0 WHEN ADDR_NUM = number::BIGINT THEN 45 ELSE -35 END
  + CASE WHEN need > 0 THEN hits * 25 + CASE WHEN hits = need THEN 35 ELSE 0 END - (need - hits) * 30 - CASE WHEN hits = 0 THEN 50 ELSE 0 END ELSE 0 END
  + CASE WHEN PRIMARY_ADDR = 1 THEN 10 ELSE 0 END - CASE WHEN COALESCE(UNIT_NUM, '') <> '' THEN 5 ELSE 0 END AS score FROM a WHERE any_all = 0 OR street_all)"""
)


def _scores(requests, parcels):
    return matching.scores(requests, parcels).select("request", "PIN", F.col("score").cast("long").alias("score"), "street_all")


def match_score(spark, d):
    return _scores(_requests(spark, d), _parcels(spark, d))


MATCH_SCORE = "WITH " + _SCORED + " SELECT request, PIN, score::BIGINT AS score, street_all FROM sc"


def _picks(asked, parcels):
    return matching.picks(asked, parcels).select("request", "PIN", "match_status")


def match_pick(spark, d):
    return _picks(_requests(spark, d), _parcels(spark, d))


MATCH_PICK = (
    "WITH "
    + _SCORED
    + """, best AS (SELECT * FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY request ORDER BY street_all DESC, score DESC, ADDR_FULL, PIN) = 1)
SELECT req.request, PIN, CASE WHEN PIN IS NULL THEN 'none' WHEN score < 40 THEN 'weak' WHEN need > 0 AND NOT street_all AND nf <> best.norm THEN 'wrong_street' ELSE 'matched' END AS match_status FROM req LEFT JOIN best ON req.request = best.request"""
)


def _lots(spark, d):
    s = read(spark, d, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("PIN"), F.col("s_name").alias("ADDR_FULL"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "").when(k % 4 == 2, "n/a").otherwise((k * 10).cast("string")).alias("LOTSQFT"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(k / 10).alias("KCA_ACRES"),
        F.when(k % 2 == 0, "LR1").when(k % 5 == 0, "").alias("KCA_ZONING"),
        F.concat((k % 5).cast("string"), F.lit("X")).alias("PROP_CLASS"),
        F.when(k % 7 == 0, "MULTI FAMILY").alias("PREUSE_DESC"),
        F.col("s_acctbal").alias("APPRLNDVAL"), F.lit("12.5").alias("APPR_IMPR"),
    )


_LOTS = """
lots AS (SELECT s_suppkey AS PIN, s_name AS ADDR_FULL, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'n/a' ELSE (s_suppkey * 10)::VARCHAR END AS sq, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey / 10.0 END::DOUBLE AS ac,
  CASE WHEN s_suppkey % 2 = 0 THEN 'LR1' WHEN s_suppkey % 5 = 0 THEN '' END AS z, s_suppkey % 5 AS cls, CASE WHEN s_suppkey % 7 = 0 THEN 'MULTI FAMILY' END AS use, s_acctbal FROM supplier),
rec AS (SELECT *, COALESCE(ac, 0.0) AS acres, CASE WHEN sq IS NULL OR sq = '' THEN 0.0 ELSE COALESCE(TRY_CAST(sq AS DOUBLE), COALESCE(ac, 0.0) * 43560) END AS sqft,
  COALESCE(NULLIF(z, ''), CASE cls WHEN 1 THEN 'SF 5000' WHEN 2 THEN 'LR1' WHEN 3 THEN 'NC2-40' ELSE CASE WHEN contains(COALESCE(use, ''), 'MULTI') THEN 'LR1' ELSE 'SF 5000' END END) AS zone FROM lots)
"""


def property_record(spark, d):
    """Every derived column; the summary that a prompt has is its JSON."""
    r = matching.property_record(_lots(spark, d))
    r = r.withColumn("lot_size_acres", F.round("lot_size_acres", 6)).withColumn("appraised_value", F.round("appraised_value", 2))
    derived = ("address", "parcel_number", "lot_size_sqft", "lot_size_acres", "property_type", "property_class", "present_use", "appraised_value", "taxable_value", "year_built", "building_area", "zone_classification", "zone_description", "jurisdiction", "neighborhood", "canopy_coverage", "tree_count", "latitude", "longitude", "legal_description", "data_source")
    return r.select("PIN", *derived, F.size(F.json_object_keys(F.to_json(matching.property_summary(r), {"ignoreNullFields": "false"}))).alias("summary_keys"))


PROPERTY_RECORD = "WITH " + _LOTS + "SELECT PIN, ADDR_FULL AS address, PIN::VARCHAR AS parcel_number, floor(sqft + 0.5)::BIGINT AS lot_size_sqft, round(CASE WHEN acres <> 0 THEN acres WHEN sqft <> 0 THEN sqft / 43560 END, 6) AS lot_size_acres, COALESCE(use, 'Residential') AS property_type, cls || 'X' AS property_class, COALESCE(use, 'Single Family') AS present_use, round(s_acctbal + 12.5, 2) AS appraised_value, 0.0::DOUBLE AS taxable_value, 'Unknown' AS year_built, '0' AS building_area, zone AS zone_classification, 'Zone: ' || zone AS zone_description, 'SEATTLE' AS jurisdiction, 'Unknown' AS neighborhood, 10 + ('0x' || substr(md5(PIN::VARCHAR), 1, 8))::BIGINT % 30 AS canopy_coverage, 1 + ('0x' || substr(md5(PIN::VARCHAR), 1, 8))::BIGINT // 256 % 5 AS tree_count, NULL::VARCHAR AS latitude, NULL::VARCHAR AS longitude, NULL::VARCHAR AS legal_description, 'parcel address table' AS data_source, 17 AS summary_keys FROM rec"


def _items(spark, d):
    r = rules.checklist(rules.with_rules(matching.property_record(_lots(spark, d)), rules.zone_rules(spark)))
    items = r.select("PIN", F.posexplode("checklist").alias("c", "_c")).select("PIN", "c", F.col("_c.category").alias("category"), F.posexplode("_c.items").alias("i", "_i"))
    return items.select("PIN", "c", "i", "category", F.col("_i.task").alias("task"), F.col("_i.required").alias("required"), F.col("_i.description").alias("description"), F.col("_i.code").alias("code"), F.col("_i.requirement").alias("requirement"))


def rule_checklist(spark, d):
    return _items(spark, d)


RULE_CHECKLIST = (
    "WITH "
    + _LOTS
    + """, zones(z, f, s, r, sc, pct, lc) AS (VALUES ('SF 5000', 20, 5, 25, 'SMC 23.44.014', 35, 'SMC 23.44.012'), ('SF 7200', 20, 5, 25, 'SMC 23.44.014', 35, 'SMC 23.44.012'), ('LR1', 10, 5, 15, 'SMC 23.45.514', 60, 'SMC 23.45.512')),
j AS (SELECT rec.PIN, rec.zone, rec.ADDR_FULL, floor(rec.sqft + 0.5)::BIGINT AS lot, 10 + ('0x' || substr(md5(rec.PIN::VARCHAR), 1, 8))::BIGINT % 30 AS canopy, k.* FROM rec JOIN zones k ON k.z = CASE WHEN rec.zone IN ('SF 7200', 'LR1') THEN rec.zone ELSE 'SF 5000' END)
SELECT PIN, 0 AS c, 0 AS i, 'Pre-Application Requirements' AS category, 'Verify property ownership' AS task, TRUE AS required, 'Proof of ownership required' AS description, 'General' AS code, 'For Parcel #' || PIN || ' at ' || ADDR_FULL AS requirement FROM j
UNION ALL SELECT PIN, 1, 0, 'Zoning Requirements', 'Verify setback compliance', TRUE, 'Setbacks for ' || zone, sc, 'Front: ' || f || 'ft | Side: ' || s || 'ft | Rear: ' || r || 'ft' FROM j
UNION ALL SELECT PIN, 1, 1, 'Zoning Requirements', 'Calculate lot coverage', TRUE, 'Maximum lot coverage', lc, 'Max ' || pct || '% of ' || format('{:,}', lot) || ' sq ft = ' || format('{:,}', floor(lot * (pct / 100.0::DOUBLE))::BIGINT) || ' sq ft' FROM j
UNION ALL SELECT PIN, 2, 0, 'Tree Protection (SMC 25.11)', 'Complete tree inventory', TRUE, 'Document all trees ≥6" diameter', 'SMC 25.11.050', 'Property shows ' || canopy || '% canopy. Inventory required.' FROM j
UNION ALL SELECT PIN, 3, 0, 'Required Permits', 'Building Permit', TRUE, 'Building permit application through Seattle Services Portal', 'SMC 22.801', 'Submit at cosaccela.seattle.gov/portal/' FROM j"""
)


def text_flags(spark, d):
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " New deck and garage, 1,200 sq ft").when(F.col("doc_id") % 3 == 1, " Graduate kitchen remodel 450sf").otherwise(""))
    r = rules.analyse_project(read(spark, d, "documents").select("doc_id", text.alias("text")), "text")
    return r.select("doc_id", F.array_join("project_types", ",").alias("types"), "square_feet", F.array_join("features", ",").alias("features"))


TEXT_FLAGS = r"""
WITH t AS (SELECT doc_id, lower(text || CASE doc_id % 3 WHEN 0 THEN ' New deck and garage, 1,200 sq ft' WHEN 1 THEN ' Graduate kitchen remodel 450sf' ELSE '' END) AS x FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN contains(x, 'adu') OR contains(x, 'accessory dwelling') THEN 'adu' END, CASE WHEN contains(x, 'addition') OR contains(x, 'expand') THEN 'addition' END, CASE WHEN contains(x, 'deck') THEN 'deck' END, CASE WHEN contains(x, 'garage') THEN 'garage' END, CASE WHEN contains(x, 'remodel') THEN 'remodel' END) AS types,
  TRY_CAST(NULLIF(regexp_extract(x, '(\d+)\s*(?:sq(?:uare)?\.?\s*f(?:ee)?t?|sf)', 1), '') AS INTEGER) AS square_feet, concat_ws(',', CASE WHEN contains(x, 'kitchen') THEN 'kitchen' END, CASE WHEN contains(x, 'bathroom') THEN 'bathroom' END) AS features FROM t
"""


def falsy_or(spark, d):
    s = read(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.lit(None)).otherwise(F.col("s_name"))
    value = F.when(F.col("s_suppkey") % 2 == 0, 0.0).otherwise(F.col("s_acctbal"))
    return s.select("s_suppkey", S.text_or(name, F.lit("other")).alias("name"), S.number_or(value, F.col("s_nationkey").cast("double")).alias("value"))


FALSY_OR = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN s_name ELSE 'other' END AS name, CASE WHEN s_suppkey % 2 = 1 AND s_acctbal <> 0 THEN s_acctbal ELSE s_nationkey::DOUBLE END AS value FROM supplier"


def to_number(spark, d):
    e = read(spark, d, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, F.lit(None)).when(F.col("event_id") % 5 == 2, "x1").when(F.col("event_id") % 5 == 3, F.concat(F.lit(" "), F.col("event_id").cast("string"))).otherwise("1e3")
    return e.select("event_id", S.to_number(raw, -1.0).alias("n"))


TO_NUMBER = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN -1.0 WHEN 3 THEN event_id::DOUBLE ELSE 1000.0 END::DOUBLE AS n FROM events"

_ALL = (address_norm, cascade_lookup, match_score, match_pick, property_record, rule_checklist, text_flags, falsy_or, to_number)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {f.__name__: globals()[f.__name__.upper()] for f in _ALL}
