import json

import pytest
from test_hierarchy import PAGES

from lexmill import pipeline
from lexmill.operators import compose, fulltext
from lexmill.sources import chunks as store
from lexmill.sources import titles as trees
from lexmill.streaming.ingest import ingest


def test_pages_to_answers(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_number int, text string")
    counts = pipeline.run(spark, pages, [23], str(tmp_path))
    assert counts == {"chunks": 4, "sections": 3, "indexed": 4, "skipped": 0}
    title = trees.read_titles(spark, f"{tmp_path}/titles").first()
    assert title.label == "Title 23" and title.subtitles[0].divisions[0].chapters[0].sections[0].citation == "23.44.010"
    r = pipeline.open_store(spark, str(tmp_path))
    assert r.orphans() == 0
    best = r.search("A rear yard of 25 feet.", top_k=2, section_prefix="23.44").collect()
    assert best[0].chunk_id == "smc-23-23-44-section-23-44-014-0" and best[0].score == pytest.approx(1, abs=1e-6) and best[0].metadata.title_number == 23
    assert r.search("yard", title_number=99).count() == 0
    asked = [("yards", "rear yard", 23, None, ["section"], "yard", 1), ("none", "x", 24, None, None, None, 3), ("scope", "scope text", None, "23.45", [], None, None)]
    found = r.gather(spark.createDataFrame(asked, "label string, query string, title_number int, section_prefix string, chunk_types array<string>, fts_query string, top_k int"))
    assert sorted((x.label, x.chunk_id) for x in found.collect()) == [("scope", "smc-23-23-45-section-23-45-001-0"), ("yards", "smc-23-23-44-section-23-44-014-0")]
    blocks = compose.evidence_blocks(found).withColumn("request", __import__("pyspark").sql.functions.lit(1))
    facts = spark.createDataFrame([(1, "12 Main St", None), (2, "none", None)], "request int, address string, lot double")
    prompts = compose.prompts(facts, blocks, "request")
    out = {x.request: x for x in compose.complete(prompts, "request", lambda p: p[-20:] if "YARDS:" in p else "").collect()}
    assert out[1].status == "ok" and "[SMC 23.44.014] Yards" in out[1].prompt and out[2].status == "empty" and compose.NO_EVIDENCE in out[2].prompt


def line(i, **more):
    return json.dumps({"chunk_id": i, "chunk_type": "section", "text": "t", "source_path": "p", "title_number": 23} | more)


def test_chunk_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join([line("a", text="first"), "", line("b"), line("a", text="last"), line(None), line("c", text="")]))
    rows = store.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert rows.count() == 5
    assert {r.chunk_id: r.text for r in store.unique_chunks(rows, need_text=True).collect()} == {"a": "first", "b": "t"}
    assert {r.chunk_id: r.text for r in store.latest_chunks(rows).collect()}["a"] == "last"
    assert store.write_store(rows, str(tmp_path / "s")) == {"indexed": 3, "skipped": 2}
    (tmp_path / "bad.jsonl").write_text(line("a") + "\n{oops\n")
    with pytest.raises(store.BadRecord, match="line 2"):
        store.read_chunks(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "null.jsonl").write_text(line("a", chunk_type=None))
    with pytest.raises(ValueError, match="1 chunks lack"):
        store.write_store(store.read_chunks(spark, str(tmp_path / "null.jsonl")), str(tmp_path / "n"))


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(line("a") + "\n{broken\n" + line("b") + "\n")
    args = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "check")
    ingest(spark, *args).awaitTermination()
    (tmp_path / "in/2.json").write_text(line("b", text="again") + "\n" + line("c") + "\n")
    ingest(spark, *args).awaitTermination()
    assert sorted((r.chunk_id, r.text) for r in spark.read.parquet(args[1]).collect()) == [("a", "t"), ("b", "t"), ("c", "t")]
    assert [r.line for r in spark.read.parquet(args[1] + "_rejected").collect()] == ["{broken"]


def test_ingest_into_a_store(spark, tmp_path):
    """What a stream adds to a store that the pipeline wrote is found there after the index is written again."""
    pages = spark.createDataFrame(PAGES, "page_number int, text string")
    pipeline.run(spark, pages, [23], str(tmp_path / "s"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(line("smc-new", text="a chimney of brick") + "\n")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "s/store"), str(tmp_path / "check")).awaitTermination()
    pipeline.index_store(spark, str(tmp_path / "s"))
    rows, index = pipeline.open_text(spark, str(tmp_path / "s"))
    assert [r.chunk_id for r in fulltext.search(spark, rows, index, "chimney", pipeline.INDEXED).collect()] == ["smc-new"]
    assert index.rows == 5
