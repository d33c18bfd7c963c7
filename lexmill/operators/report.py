"""Reports: from requests to checklists and memos, and from evidence to grounded answers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import compose, matching, rules
from lexmill.operators.retrieval import Retriever

#: A completion takes messages of ``role`` and ``content``, a model's name and a temperature, and gives a text.
Completion = Callable[[list[dict], str, float], str]
TEMPERATURE = 0.2
MEMO_ROLE = "You review building plans against a city's land-use rules. From the parcel's data, the project and the code excerpts write a memo that can be acted on: the sections that apply, permits, zoning and risks. Where something is not known, say so instead of guessing."
MEMO_PARTS = ("a short summary of the property", "the main zoning and development checks, with their sections", "permits and how to submit them", "trees and the environment", "open questions and missing data")
MESSAGES = "array<struct<role:string,content:string>>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def memo_messages(df: DataFrame, description: str = "description", analysis: str = "analysis") -> DataFrame:
    """``messages`` for every property record: the role, and its summary, project, analysis and all rules as JSON."""
    options = {"ignoreNullFields": "false", "pretty": "true"}
    wanted = "\n".join(f"{i}. {x}" for i, x in enumerate(MEMO_PARTS, 1))
    told = F.when(F.trim(F.coalesce(description, F.lit(""))) == "", F.lit("Not provided.")).otherwise(F.trim(description))
    body = F.concat(
        F.lit("Property Data:\n"), F.to_json(matching.property_summary(df), options),
        F.lit("\n\nProject Description:\n"), told,
        F.lit("\n\nDerived Project Analysis:\n"), F.coalesce(F.to_json(analysis, options), F.lit("{}")),
        F.lit("\n\nCode References:\n" + json.dumps(rules.code_reference(), indent=2, ensure_ascii=False)),
        F.lit("\n\nPlease write:\n" + wanted),
    )
    return df.withColumn("messages", F.array(_message("system", F.lit(MEMO_ROLE)), _message("user", body)))


def answer(df: DataFrame, key: str, completion: Completion | None, model: str, temperature: float = TEMPERATURE) -> DataFrame:
    """``key, report, report_status``: a stripped answer, or none where it is empty, fails, or there is no completion."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for messages in f["messages"]:
                try:
                    if completion is None:
                        out.append((None, "no key"))
                        continue
                    text = (completion([dict(role=m["role"], content=m["content"]) for m in messages], model, temperature) or "").strip()
                    out.append((text or None, "ok" if text else "empty"))
                except Exception as e:  # noqa: BLE001  the caller's function may raise anything
                    out.append((None, f"error: {e}"))
            yield f[[key]].assign(report=[r for r, _ in out], report_status=[s for _, s in out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "messages").mapInPandas(run, f"{key} {kind}, report string, report_status string")


def check_requests(requests: DataFrame, parcels: DataFrame, spark: SparkSession, completion: Completion | None = None, *, model: str = "default") -> DataFrame:
    """One row per request (``request, address, description``): its property, checklist, analysis, memo and ``status``.

    ``status`` is ``ok``, ``blank`` for a request without an address, or why no
    parcel was accepted; such rows have no property. A description that is blank
    is not analysed. A memo that fails leaves the rest of its row.
    """
    blank = F.trim(F.coalesce("address", F.lit(""))) == ""
    asked = matching.requests_of(requests.filter(~blank), "request", "address")
    picked = matching.pick(matching.score(matching.lookup(asked, parcels)), asked)
    found = picked.filter("match_status = 'matched'").drop("asked", "score", "normalized", "norm", "number", "street", "required", "word", "attempt")
    record = matching.property_record(found.join(requests.select("request", F.col("address").alias("_asked"), "description"), "request"), F.col("_asked"))
    record = rules.checklist(rules.with_rules(record, rules.zone_rules(spark)))
    record = rules.analyse_project(record, "description")
    told = F.trim(F.coalesce("description", F.lit(""))) != ""
    record = record.withColumn("analysis", F.when(told, F.struct("project_types", "square_feet", "features")))
    record = memo_messages(record)
    reports = answer(record, "request", completion, model)
    own = record.select("request", matching.property_summary(record).alias("property"), "checklist", "analysis").join(reports, "request")
    states = picked.select("request", F.when(F.col("match_status") == "matched", "ok").otherwise(F.col("match_status")).alias("_state"))
    out = requests.select("request", "address", "description").join(states, "request", "left").join(own, "request", "left")
    return out.withColumn("status", F.coalesce("_state", F.lit("blank"))).drop("_state")


def report(retriever: Retriever, facts: dict, requests: DataFrame, completion: Completion | None, *, model: str = "default", temperature: float = TEMPERATURE) -> dict:
    """A grounded report: ``report, prompt, evidence``, evidence being the records of each label's hits, best first.

    ``requests`` are evidence requests as ``Retriever.gather`` takes them. What
    comes to the driver is a few hits for each of them.
    """
    spark = retriever.spark
    hits = retriever.gather(requests)
    blocks = compose.evidence_blocks(hits).withColumn("_one", F.lit(1))
    shown = json.dumps(facts, indent=2, ensure_ascii=False)
    evidence = blocks.groupBy("_one").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label", "block"))), lambda x: x["block"]), "\n\n").alias("e"))
    one = spark.range(1).withColumn("_one", F.lit(1)).join(evidence, "_one", "left")
    text = F.concat(F.lit(f"{compose.INSTRUCTIONS}\n\nProperty context:\n{shown}\n\nMunicipal code evidence:\n"), F.coalesce("e", F.lit(compose.NO_EVIDENCE)))
    prompt = one.select("id", text.alias("prompt")).first()["prompt"]
    asked = spark.createDataFrame([(0, [{"role": "user", "content": prompt}])], f"id long, messages {MESSAGES}")
    made = answer(asked, "id", completion, model, temperature).first()
    records: dict[str, list] = {r["label"]: [] for r in requests.select("label").distinct().collect()}
    for r in hits.orderBy("label", "rank").select("label", "metadata").collect():
        records[r["label"]].append(r["metadata"].asDict(True))
    return {"report": made["report"], "status": made["report_status"], "prompt": prompt, "evidence": records}
