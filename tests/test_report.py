import json

from test_hierarchy import PAGES

from lexmill import pipeline, settings
from lexmill.operators import matching, report, rules

PARCELS = [("1", "12 MAIN ST", 12, "Seattle", "MAIN", "ST", 5000.0), ("2", "14 MAIN ST", 14, "Seattle", "MAIN", "ST", 7000.0), ("3", "12 OAK AVE", 12, "Tacoma", "OAK", "AVE", 1.0)]


def parcels(spark):
    rows = [(p, a, n, c, None, s, t, None, 1, None, q) for p, a, n, c, s, t, q in PARCELS]
    return spark.createDataFrame(rows, "PIN string, ADDR_FULL string, ADDR_NUM int, CTYNAME string, ADDR_PD string, ADDR_SN string, ADDR_ST string, ADDR_SD string, PRIMARY_ADDR int, UNIT_NUM string, LOTSQFT double")


def echo():
    """A completion that workers get by value."""

    def run(messages, model, temperature):
        if "14 MAIN" in messages[-1]["content"]:
            raise RuntimeError("no line")
        return f" {model} {temperature} {messages[0]['role']} {len(messages)} "

    return run


def test_requests_to_memos(spark):
    asked = [(1, "12 Main Street, Seattle", "A new deck of 300 sq ft"), (2, "14 Main St", "  "), (3, "99 Nowhere Rd", None), (4, " ", "x"), (5, None, None)]
    requests = spark.createDataFrame(asked, "request int, address string, description string")
    got = {r.request: r for r in report.check_requests(requests, parcels(spark), spark, echo(), model="m").collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "ok", 3: "none", 4: "blank", 5: "blank"}
    assert got[1].property.address == "12 MAIN ST" and got[1].analysis.project_types == ["deck"] and got[1].analysis.square_feet == 300
    assert [len(c["items"]) for c in got[1].checklist] == [1, 2, 1, 1]
    assert got[1].report == "m 0.2 system 2" and got[1].report_status == "ok"
    assert got[2].analysis is None and got[2].report is None and got[2].report_status == "error: no line" and got[2].checklist
    assert got[3].property is None and got[3].report is None
    assert {r.report_status for r in report.check_requests(requests, parcels(spark), spark).collect() if r.status == "ok"} == {"no key"}


def test_memo_holds_facts_and_rules(spark):
    row = matching.property_record(parcels(spark).filter("PIN = '1'")).selectExpr("*", "cast(null as string) AS description", "cast(null as struct<a:int>) AS analysis")
    system, user = report.memo_messages(row).first().messages
    assert system.role == "system" and user.role == "user"
    body = user.content
    facts = json.loads(body.split("Property Data:\n")[1].split("\n\nProject Description:")[0])
    assert list(facts) == list(matching.SUMMARY) and facts["lot_size_sqft"] == 5000 and facts["latitude"] is None
    assert "Project Description:\nNot provided." in body and "Analysis:\n{}" in body
    code = json.loads(body.split("Code References:\n")[1].split("\n\nPlease write:")[0])
    assert code == json.loads(json.dumps(rules.code_reference())) and code["zoning"]["SF 7200"]["pitched_ft"] == 35 and code["trees"]["replacement"]["over 24 inches"]["ratio"] == 3


def test_grounded_report(spark, tmp_path):
    pipeline.run(spark, spark.createDataFrame(PAGES, "page_number int, text string"), [23], str(tmp_path))
    retriever = pipeline.open_store(spark, str(tmp_path))
    asked = [("yards", "rear yard", 23, "23.44", ["section"], "scope", 1, 1), ("yards", "rear yard", 23, "23.44", ["section"], "yard", 1, 2), ("none", "x", 99, None, None, None, 2, 3)]
    requests = spark.createDataFrame(asked, "label string, query string, title_number int, section_prefix string, chunk_types array<string>, fts_query string, top_k int, position int").repartition(3)
    out = report.report(retriever, {"address": "12 Main St"}, requests, echo())
    assert out["status"] == "ok" and "[SMC 23.44.014]" in out["prompt"] and '"address": "12 Main St"' in out["prompt"]
    assert [r["section_citation"] for r in out["evidence"]["yards"]] == ["23.44.014"] and out["evidence"]["none"] == []


def test_settings():
    env = {"A": "", "B": "b", "LIST": " x, y ,,x"}
    assert settings.first_set("A", "B", env=env) == "b" and settings.first_set("A", default="d", env=env) == "d"
    assert settings.listed(env["LIST"], "z") == ["z", "x", "y"] and settings.listed(None) == []
